"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k is cut into k + 1 pieces. Wherever it occurs with
at most k edits, one piece occurs unchanged; every such hit is verified with Myers'
bit-parallel distance. Short items must stand between word boundaries. Documents are never shuffled; the pieces go to the tasks in
blocks of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table

RATE, MIN_CHARS, BLOCK_CHARS = 0.1, 24, 16_000_000


def normal(text: str | None) -> str:
    """Lower case, every run of white space one space."""
    return " ".join((text or "").lower().split())


def distances(pattern: dict[str, int], m: int, text: str, at_most: int) -> tuple[int, int]:
    """(distance, end) of the best, earliest occurrence of a pattern in ``text``; (at_most + 1, -1) if none is that near.

    ``pattern`` maps a character to the bits of its positions, ``m`` is its length.
    """
    ones, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = ones, 0, m
    best, end, left = at_most + 1, -1, len(text)
    for i, c in enumerate(text):
        equal = pattern.get(c, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(across | plus) & ones, plus & across
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up, down = up << 1 & ones, down << 1 & ones
        plus, minus = down | ~(vertical | up) & ones, up & vertical
        left -= 1
        if score < best:
            best, end = score, i + 1
        if score - left >= best:
            break
    return best, end


def positions(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        bits[c] |= 1 << i
    return dict(bits)


def bounded(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit inside a part of the text goes on outside."""
    return not ((start > 0 and text[start - 1].isalnum() and text[start].isalnum()) or (end < len(text) and text[end - 1].isalnum() and text[end].isalnum()))


class Matcher:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[tuple], rate: float, min_chars: int = MIN_CHARS):
        self.items, self.bits, self.min_chars, pieces = [], {}, min_chars, defaultdict(list)
        for item_id, text in items:
            k = int(len(text) * rate)
            bounds = [len(text) * i // (k + 1) for i in range(k + 2)]
            for leaf, (a, b) in enumerate(zip(bounds, bounds[1:])):
                pieces[text[a:b]].append((len(self.items), b, _ancestors(bounds, leaf)))
            self.items.append((item_id, text, k))
        self.pieces = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.pieces.add_word(piece, uses)
        self.pieces.make_automaton()

    def holds(self, item: int, text: str, start: int, nodes: list[tuple]) -> bool:
        """Whether every node above a hit occurs around it; ``start``: where the item would start."""
        for a, b, budget in nodes:
            key = item, a, b
            if key not in self.bits:
                self.bits[key] = positions(self.items[item][1][a:b])
            if distances(self.bits[key], b - a, text[max(0, start + a - budget):max(0, start + b + budget)], budget)[1] < 0:
                return False
        return True

    def find(self, text: str) -> Iterator[tuple]:
        """(item id, distance, start, end) of the best occurrence of each item that occurs."""
        windows: dict[int, list[list[int]]] = {}
        for end, uses in self.pieces.iter(text) if self.items else ():
            for item, offset, above in uses:
                if not self.holds(item, text, end + 1 - offset, above):
                    continue
                _, own, k = self.items[item]
                start = end + 1 - offset - k
                found = windows.setdefault(item, [])
                # Hits come by their end, so starts are out of order by less than an item.
                if found and start <= found[-1][1] and start >= found[-1][0] - len(own):
                    found[-1] = [min(start, found[-1][0]), max(start + len(own) + 2 * k, found[-1][1])]
                else:
                    found.append([start, start + len(own) + 2 * k])
        for item, spans in windows.items():
            item_id, own, k = self.items[item]
            if len(own) < self.min_chars:
                best = min((x for a, b in spans for x in standing(own, text, max(0, a), b, k)), default=None)
                if best is not None:
                    yield item_id, best[0], best[2], best[1]
                continue
            at = text.find(own)
            if at >= 0:
                yield item_id, 0, at, at + len(own)
                continue
            if item not in self.bits:
                self.bits[item] = positions(own)
            best = (k + 1, -1)
            for a, b in spans:
                a = max(0, a)
                near, end = distances(self.bits[item], len(own), text[a:b], min(k, best[0] - 1))
                if end >= 0 and near < best[0]:
                    best = near, a + end
            if best[1] >= 0:
                back = text[max(0, best[1] - len(own) - k):best[1]][::-1]
                # The start: the shortest piece of the reversed text that gives the same distance from its first character.
                yield item_id, best[0], best[1] - start_back(own[::-1], back, best[0]), best[1]


def standing(pattern: str, text: str, a: int, b: int, at_most: int) -> Iterator[tuple[int, int, int]]:
    """(distance, end, start) of the parts of ``text[a:b]`` between word boundaries that are a short pattern with few edits."""
    for start in range(a, min(b, len(text))):
        if not (text[start].isalnum() and start > 0 and text[start - 1].isalnum()):
            row = list(range(len(pattern) + 1))
            for n, c in enumerate(text[start:min(b, start + len(pattern) + at_most)], start + 1):
                new = [n - start]
                for j, p in enumerate(pattern, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != p)))
                row = new
                if row[-1] <= at_most and bounded(text, start, n):
                    yield row[-1], n, start


def _ancestors(bounds: list[int], leaf: int) -> list[tuple]:
    """(start, end, budget) of the nodes above a leaf, without the leaf and the root, from below."""
    a, b, nodes = 0, len(bounds) - 1, []
    while b - a > 1:
        middle = (a + b) // 2
        a, b = (a, middle) if leaf < middle else (middle, b)
        nodes.append((bounds[a], bounds[b], b - a - 1))
    return nodes[-2::-1]


def start_back(pattern: str, text: str, distance: int) -> int:
    """The least n with edit distance ``distance`` between the pattern and the first n characters of ``text``."""
    row = list(range(len(pattern) + 1))
    if row[-1] == distance:
        return 0
    for n, c in enumerate(text, 1):
        new = [n]
        for j, p in enumerate(pattern, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != p)))
        row = new
        if row[-1] == distance:
            return n
    return len(text)


_BUILT: dict[str, Matcher] = {}


def _matcher(name: str, shared, rate: float, min_chars: int) -> Matcher:
    """The matcher of a block, built once a worker; another block takes its place."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Matcher(shared.value, rate, min_chars)
    return _BUILT[name]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple]]:
    """The usable items as lists of at most about ``block_chars`` characters, one after the other."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    for block in range(n):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == block).orderBy("id", "text").collect()
        found = [(r.id, normal(r.text)) for r in rows]
        yield [(i, t) for i, t in found if t]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item id, distance, start, end): each test item that occurs in a document with at most ``rate`` edits per character.

    Both sides are normalised (lower case, runs of white space one space); ``start`` and
    ``end`` are positions in the normalised text, of the nearest, then first, occurrence.
    Items of under ``min_chars`` normalised characters must stand between word boundaries;
    they may have as many edits for their length as others. Empty and null items match nothing, nor do null and empty texts. Items with equal texts each give a row, repeated documents
    repeat their rows, null ids stay null. Larger benchmarks go through the documents in blocks.
    """
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    out = f"`{id_col}` {kind.simpleString()}, `{item_col}` {item_kind.simpleString()}, distance int, start long, end long"

    def pass_over(items: list[tuple]) -> DataFrame:
        shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid4().hex

        def found(batches):
            matcher = _matcher(name, shared, rate, min_chars)
            for batch in batches:
                hits = [(at, *hit) for at, text in enumerate(batch.column(1)) for hit in matcher.find(normal(text.as_py()))]
                at, item, *rest = zip(*hits) if hits else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, _arrow(item_kind)), pa.array(rest[0], pa.int32()),
                     pa.array(rest[1], pa.int64()), pa.array(rest[2], pa.int64())], [id_col, item_col, "distance", "start", "end"])

        return docs.select(id_col, text_col).mapInArrow(found, out)

    return reduce(DataFrame.union, [pass_over(items) for items in _blocks(benchmark, item_col, item_text_col, block_chars)])


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no test item occurs, in the sense of ``leaks``, with all their columns."""
    column = docs.columns.index(text_col)
    for items in _blocks(benchmark, item_col, item_text_col, block_chars):
        shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid4().hex

        def clean(batches, shared=shared, name=name):
            matcher = _matcher(name, shared, rate, min_chars)
            for batch in batches:
                yield batch.filter(pa.array([next(matcher.find(normal(t.as_py())), None) is None for t in batch.column(column)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


@query("op3_decontaminate")
def decontaminate_query(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
