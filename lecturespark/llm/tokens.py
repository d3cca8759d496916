"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are emitted."""

from __future__ import annotations

import hashlib
import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .registry import query, table

LIMIT, CACHED_WORDS, CACHED_CHARS = 1024, 300_000, 64
VOCABULARY = "byte_bpe_50k.json"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class ByteMerges(dict):
    """Pre-token → number of tokens. A bounded memo: it is emptied when it is full."""

    def __init__(self, vocabulary: bytes):
        super().__init__()
        spec = json.loads(vocabulary)
        ids = spec["model"]["vocab"]
        self.letters = [ids[x] for x in byte_letters()]
        # (left id, right id) as one number → (rank, id of the merged symbol)
        self.merges = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[ids[left] << 32 | ids[right]] = (rank, ids[left + right])
        specials = sorted((regex.escape(t["content"]) for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = regex.compile("|".join(specials)) if specials else None
        # White space as the vocabulary's library understands it: without U+001C to U+001F.
        self.words = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
                                   .replace(r"\S", r"\P{White_Space}")).findall

    def __missing__(self, word: str) -> int:
        n = self.merged(word.encode())
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n

    def merged(self, word: bytes) -> int:
        """Pop the lowest-ranked adjacent pair, leftmost first, until none is left."""
        merges = self.merges
        symbols = [self.letters[b] for b in word]
        n = count = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [found[0] << 32 | i for i in range(n - 1) if (found := merges.get(symbols[i] << 32 | symbols[i + 1]))]
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), 1 << 32)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = merges.get(symbols[i] << 32 | symbols[j])
            if found is None or found[0] != rank:  # one of the two has been merged meanwhile
                continue
            symbols[i], symbols[j] = found[1], -1
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get(symbols[i] << 32 | symbols[k]):
                    heappush(heap, found[0] << 32 | i)
            if (h := before[i]) >= 0 and (found := merges.get(symbols[h] << 32 | symbols[i])):
                heappush(heap, found[0] << 32 | h)
        return count

    def tokens(self, text: str) -> int:
        if self.specials is None:
            return sum(map(self.__getitem__, self.words(text)))
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.words(p))) for p in parts)


_LOADED: dict[str, ByteMerges] = {}


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_tokens, over_limit. No shuffle.

    ``vocabulary``: the path of a byte-level vocabulary on the driver. Null and empty texts
    have 0 bytes and tokens; texts are never cut, and special strings in them are one
    token each. Repeated rows give repeated rows; a null id stays null.
    """
    with open(vocabulary, "rb") as file:
        data = file.read()
    name, shared = hashlib.sha256(data).hexdigest(), docs.sparkSession.sparkContext.broadcast(data)

    def counted(batches):
        if name not in _LOADED:  # a worker process parses the vocabulary once
            _LOADED.clear()
            _LOADED[name] = ByteMerges(shared.value)
        merges = _LOADED[name]
        for batch in batches:
            size, tokens = [], []
            for text in batch.column(1):
                value = text.as_py() or ""
                size.append(len(value.encode()))
                tokens.append(merges.tokens(value))
            n_tokens = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), n_tokens, pa.array([n > limit for n in tokens], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(counted, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


@query("op7_token_counts")
def token_query(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
