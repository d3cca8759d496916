"""Language-model scoring with a hashed maximum-entropy model.

The classes of words are nested by counts: a tree of 32-way nodes in which frequent words
sit near the root and the average word passes hardly more nodes than its entropy asks for.
Every node is a softmax over hashed features of the words before: the last one, near the
root also the one before it (a skip), and at the root the pair. A leaf is a frequent word, or a hash bucket of rarer ones,
which divide the bucket by their counts. Every task improves the weights by gradient
updates over its documents, and rows of weights are averaged by the number of updates they
saw; a fixed number of rounds over disjoint shares of the documents start from the last
average each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .shared import stored
from .words import mixed, slices, word_codes, word_hashes

WAYS = 32  # branches of a node
TABLES = 3  # tables of weights: for the root, the nodes below it, and all others
# Features of each table's rows, of (last, skip, pair). Rows of deeper nodes meet so few tokens that more features
# mostly add collisions: on held-out texts they gained 5 % for a third of all work.
USED = (3, 2, 1)
ROW_BITS = (4, 14, 16)  # bits of a table's row numbers: the vocabulary's, less 4, at least and at most
BLOCK = 8192  # weights that a task sends in one row
RATE, BATCH, CHUNK = 0.25, 32768, 2048
LIMIT = 20  # of a weight's size, so that no sum of three can leave the range of exp
LAYERS = 32  # slopes of a row that are added for all rows at once
ROUNDS = 2  # passes over disjoint shares of the documents
DISCOUNT = 0.5
FREQUENT = 1 << 18  # words whose counts every task holds; the others are joined
BUCKETS = 1 << 16  # leaves that the other words share
SLICE_BYTES = 4_000_000
END = ""  # no word is empty
END_HASH, START_HASH = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 1, F.lit(False))


@dataclass(frozen=True)
class Tree:
    """Nodes (0 is the root) and branches on the way to every leaf, level by level; -1 beyond the leaf."""
    nodes: np.ndarray
    branches: np.ndarray
    bias: np.ndarray  # the log share of every branch in its node's mass

    @classmethod
    def of(cls, masses: np.ndarray) -> Tree:
        """The tree of least average depth: the lightest nodes or leaves are joined, as many as a node has branches."""
        size = len(masses)
        if size == 0:
            return cls(np.empty((0, 0), np.int32), np.empty((0, 0), np.int8), np.empty((0, WAYS), np.float32))
        spare = -(size - 1) % (WAYS - 1)  # leaves without mass that fill the deepest node
        order = np.argsort(masses, kind="stable")
        leaves, items = np.concatenate([np.zeros(spare), masses[order]]), np.concatenate([np.full(spare, -1), order])
        n_nodes = (len(leaves) - 1) // (WAYS - 1)
        # Joined nodes come out by rising mass, so both queues stay sorted.
        joined, parent, way, share = np.zeros(n_nodes), np.full(size + n_nodes, -1), np.zeros(size + n_nodes, np.int8), np.zeros((n_nodes, WAYS))
        a = b = 0
        for made in range(n_nodes):
            light, nodes = leaves[a:a + WAYS], joined[b:min(b + WAYS, made)]
            both = np.concatenate([light, nodes])
            chosen = np.argsort(both, kind="stable")[:WAYS]
            of_leaf = chosen < len(light)
            members = np.where(of_leaf, items[np.minimum(a + chosen, len(items) - 1)], size + b + chosen - len(light))
            share[made] = both[chosen]
            joined[made] = share[made].sum()
            real = members >= 0
            parent[members[real]], way[members[real]] = made, np.flatnonzero(real)
            a, b = a + int(of_leaf.sum()), b + int((~of_leaf).sum())
        at, steps = np.arange(size), []
        while (inside := parent[at] >= 0).any():
            steps.append((np.where(inside, parent[at], -1), way[at]))
            at = np.where(inside, size + parent[at], at)
        depth = sum((up >= 0).astype(np.int64) for up, _ in steps) if steps else np.zeros(size, np.int64)
        nodes, branches = np.full((len(steps), size), -1, np.int32), np.full((len(steps), size), -1, np.int8)
        for back, (up, branch) in enumerate(steps):
            real = np.flatnonzero(up >= 0)
            nodes[depth[real] - 1 - back, real] = n_nodes - 1 - up[real]
            branches[depth[real] - 1 - back, real] = branch[real]
        with np.errstate(divide="ignore", invalid="ignore"):
            bias = np.where(share > 0, np.log(share / share.sum(axis=1, keepdims=True)), -1e4)
        return cls(nodes, branches, bias[::-1].astype(np.float32))


@dataclass(frozen=True)
class Counts:
    """What every task holds of the training counts: totals, the most frequent words, the buckets of all others."""
    n: int
    n_distinct: int
    words: pa.Array  # by falling count; at most FREQUENT
    counts: np.ndarray
    buckets: np.ndarray  # the mass of each bucket: its words' counts, each less the discount, as every leaf's
    tree: Tree

    @classmethod
    def of(cls, n: int, n_distinct: int, words, counts: np.ndarray, buckets: np.ndarray | None = None) -> Counts:
        buckets = np.zeros(0) if buckets is None else buckets
        return cls(n, n_distinct, pa.array(words, pa.string()) if isinstance(words, list) else words, counts, buckets,
                   Tree.of(np.concatenate([counts - DISCOUNT, buckets[buckets > 0]])))

    def others(self) -> tuple[int, int]:
        """(tokens, distinct words) in buckets."""
        return self.n - int(self.counts.sum()), self.n_distinct - len(self.words)

    def unseen(self) -> float:
        """The probability of the one event of all unseen words: what the discounts of all words took."""
        return DISCOUNT * self.n_distinct / self.n if self.n else 1.0

    def bucket_of(self, hashes: np.ndarray) -> np.ndarray:
        bits = max(len(self.buckets), 1).bit_length() - 1
        return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)

    def rows(self) -> int:
        """Rows of each table of weights; they follow the vocabulary."""
        less, least, most = ROW_BITS
        return 1 << min(max(max(self.n_distinct, 1).bit_length() - less, least), most)


@dataclass(frozen=True)
class Weights:
    rows: np.ndarray  # (table, row, branch)
    squares: np.ndarray  # (table, row): what the next round's steps divide by

    @classmethod
    def start(cls, counts: Counts) -> Weights:
        return cls(np.zeros((TABLES, counts.rows(), WAYS), np.float32), np.full((TABLES, counts.rows()), 1e-6, np.float32))


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all texts, the end of a text counted as the empty word."""

    def counted(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for batch in slices(whole, 0, SLICE_BYTES):
                _, codes, words = word_codes(batch.column(0))
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(words)).astype(np.int64))], ["word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([batch.num_rows])], ["word", "n"])

    return docs.select(text_col).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def summary(vocabulary: DataFrame, frequent: int = FREQUENT) -> Counts:
    """Totals, every word above a count that at most ``frequent`` words reach, and the masses of the other words' buckets.

    The count is found from a histogram of count magnitudes, so no task sorts all words.
    """
    level = F.floor(F.log2("c") * 16).cast("int")
    bars = sorted(((r.level, r.words, r.tokens) for r in vocabulary.groupBy(level.alias("level")).agg(
        F.count("*").alias("words"), F.sum("c").alias("tokens")).collect()), reverse=True)
    least, held = None, 0
    for bar, words, _ in bars:
        if held + words > frequent:
            break
        held += words
        least = bar
    n, n_distinct = sum(b[2] for b in bars), sum(b[1] for b in bars)
    words, c = pa.array([], pa.string()), np.zeros(0, np.int64)
    if least is not None:
        rows = vocabulary.filter(level >= least).select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
        words, c = pa.concat_arrays(rows.column("word").chunks).cast(pa.string()), rows.column("c").to_numpy()
    if held == n_distinct:
        return Counts.of(n, n_distinct, words, c)
    empty = replace(Counts.of(n, n_distinct, [], np.zeros(0)), buckets=np.zeros(1 << min((n_distinct - held - 1).bit_length(), BUCKETS.bit_length() - 1)))

    def placed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            own = batch.column(0)
            hashes = np.where(pc.equal(own, END).to_numpy(zero_copy_only=False), END_HASH, word_hashes(own))
            buckets = empty.bucket_of(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(batch.column(1).to_numpy(zero_copy_only=False) - DISCOUNT)], ["bucket", "mass"])

    rare = vocabulary if least is None else vocabulary.filter(level < least)
    found = rare.select("word", "c").mapInArrow(placed, "bucket long, mass double").groupBy("bucket").agg(F.sum("mass").alias("mass")).toArrow()
    buckets = empty.buckets.copy()
    buckets[found.column("bucket").to_numpy()] = found.column("mass").to_numpy()
    return Counts.of(n, n_distinct, words, c, buckets)


class Model:
    """Forward and update steps on batches of tokens."""

    def __init__(self, counts: Counts, weights: Weights | None = None):
        weights = weights or Weights.start(counts)
        self.counts, self.tree = counts, counts.tree
        self.weights = list(weights.rows.astype(np.float32))
        self.squares = list(weights.squares.astype(np.float64))
        self.shift = np.uint32(33 - len(self.weights[0]).bit_length())
        self.salts = (mixed(np.arange(1, len(self.tree.bias) + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
        self.leaf_of_bucket = np.where(counts.buckets > 0, len(counts.words) + np.cumsum(counts.buckets > 0) - 1, -1)
        self.seen = [np.zeros(len(w), np.int64) for w in self.weights]
        self.slopes, self.ones = np.empty((BATCH, WAYS), np.float32), np.ones(WAYS, np.float32)
        self.chunks = [np.empty((CHUNK, WAYS), np.float32) for _ in range(2)]  # stay in the cache

    def tokens(self, texts: pa.Array):
        """(document, leaf, features) of every token, and (offsets, codes, words, leaf and bucket of each word and the end).

        A word that no training text has may have the leaf -1; the bucket of a frequent word is -1.
        """
        offsets, codes, words = word_codes(texts)
        counts = np.diff(offsets)
        document = np.repeat(np.arange(len(counts)), counts + 1)
        ends = np.cumsum(counts + 1) - 1
        code = np.full(len(document), len(words))
        is_word = np.ones(len(document), bool)
        is_word[ends] = False
        code[is_word] = codes
        hashes = np.append(word_hashes(words), END_HASH)
        every = pa.concat_arrays([words.cast(pa.string()), pa.array([END])])
        leaf = pc.fill_null(pc.index_in(every, self.counts.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        bucket = np.full(len(leaf), -1)
        if len(self.counts.buckets):
            rare = np.flatnonzero(leaf < 0)
            bucket[rare] = self.counts.bucket_of(hashes[rare])
            leaf[rare] = self.leaf_of_bucket[bucket[rare]]
        own = hashes[code]
        place = np.arange(len(document)) - np.concatenate([[0], ends[:-1] + 1])[document] if len(document) else document
        last, skip = np.full(len(own), START_HASH), np.full(len(own), START_HASH)
        last[1:], skip[2:] = own[:-1], own[:-2]
        last[place < 1] = START_HASH
        skip[place < 2] = START_HASH
        pair = mixed(last * np.uint64(3) + (skip ^ (skip >> np.uint64(29))))
        features = np.stack([(x >> np.uint64(32)).astype(np.uint32) for x in (last * np.uint64(0x9E3779B97F4A7C15), skip * np.uint64(0xC2B2AE3D27D4EB4F), pair)])
        return (document, leaf[code], features), (code, every, leaf, bucket)

    def levels(self, leaf: np.ndarray, features: np.ndarray, slopes: bool):
        """(table, tokens, row numbers, log of the taken branch's chance, slopes of all branches) of each level that tokens reach.

        The slopes are overwritten by the next level.
        """
        at, chunk = np.flatnonzero(leaf >= 0), self.chunks[0]
        for level in range(len(self.tree.nodes)):
            if level:
                at = at[self.tree.nodes[level][leaf[at]] >= 0]
            if len(at) == 0:
                return
            node, branch = self.tree.nodes[level][leaf[at]], self.tree.branches[level][leaf[at]].astype(np.int64)
            which = min(level, TABLES - 1)
            rows = (((features[:USED[which], at] ^ self.salts[node]) * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)
            gains, every = np.empty(len(at)), self.slopes[:len(at)]
            for a in range(0, len(at), CHUNK):
                part = slice(a, a + CHUNK)
                logits, taken = every[part], branch[part]
                added, own = chunk[:len(taken)], np.arange(len(taken))
                np.take(self.tree.bias, node[part], axis=0, out=logits, mode="clip")
                for r in rows:
                    logits += np.take(self.weights[which], r[part], axis=0, out=added, mode="clip")
                gains[part] = logits[own, taken]
                total = np.exp(logits, out=logits) @ self.ones
                gains[part] -= np.log(total)
                if slopes:
                    logits /= total[:, None]
                    logits[own, taken] -= 1
            yield which, at, rows, gains, every

    def log10(self, leaf: np.ndarray, features: np.ndarray) -> np.ndarray:
        """log10 of each token's leaf; 0 without a leaf."""
        out = np.zeros(len(leaf))
        for a in range(0, len(leaf), BATCH):
            for _, at, _, gains, _ in self.levels(leaf[a:a + BATCH], features[:, a:a + BATCH], False):
                out[a + at] += gains / np.log(10)
        return out

    def update(self, leaf: np.ndarray, features: np.ndarray) -> None:
        for a in range(0, len(leaf), BATCH):
            for which, _, rows, _, slopes in self.levels(leaf[a:a + BATCH], features[:, a:a + BATCH], True):
                self._descend(which, rows, slopes)

    def _descend(self, which: int, rows: np.ndarray, slope: np.ndarray) -> None:
        """Adaptive steps: a row moves by its summed slope over the root of its squares so far."""
        weights, flat = self.weights[which], rows.reshape(-1).astype(np.uint16)  # sorts in linear time
        order = np.argsort(flat, kind="stable")
        flat, order = flat[order], order % len(slope)
        firsts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        counts = np.diff(firsts, append=len(flat))
        # The rows by falling number of slopes: those with a further slope come first, so their sums grow in place.
        falling = np.argsort((LAYERS + 1 - np.minimum(counts, LAYERS + 1)).astype(np.uint16), kind="stable")
        firsts, counts = firsts[falling], counts[falling]
        for a in range(0, len(firsts), CHUNK):
            first, times = firsts[a:a + CHUNK], counts[a:a + CHUNK]
            touched = flat[first].astype(np.int64)
            sums, other = (c[:len(first)] for c in self.chunks)
            np.take(slope, order[first], axis=0, out=sums, mode="clip")
            most = int((times > LAYERS).sum())
            for i in range(most):
                sums[i] = np.take(slope, order[first[i]:first[i] + times[i]], axis=0).sum(axis=0)
            for layer in range(1, int(times[most:].max(initial=1))):
                end = most + int((times[most:] > layer).sum())
                sums[most:end] += np.take(slope, order[first[most:end] + layer], axis=0, out=other[most:end], mode="clip")
            squares = self.squares[which][touched] + np.square(sums, out=other) @ self.ones
            self.squares[which][touched] = squares
            self.seen[which][touched] += times
            sums *= (-RATE / np.sqrt(squares)).astype(np.float32)[:, None]
            sums += np.take(weights, touched, axis=0, out=other, mode="clip")
            weights[touched] = np.clip(sums, -LIMIT, LIMIT, out=sums)


def train(docs: DataFrame, counts: Counts, text_col: str = "text", rounds: int = ROUNDS) -> Weights:
    """Weights after one pass over all documents, in ``rounds`` shares by the hash of the text.

    Each round starts from the average of the one before, the first from the unigram model. A
    task sends the blocks of rows that it has changed with the number of updates of each row,
    weights in half precision; equal blocks meet after a shuffle and only their averages, at
    most 26 MB, reach the driver.
    """
    context, weights = docs.sparkSession.sparkContext, Weights.start(counts)
    names = ["of", "block", "n", "squares", "weights"]
    out, per = "of int, block int, n binary, squares binary, weights binary", BLOCK // WAYS

    def rows(of, block, n, squares, weights):
        binary = [pa.array([x.tobytes() for x in column], pa.binary()) for column in (n, squares, weights)]
        return pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(block, pa.int32()), *binary], names)

    def averaged(batches):
        sums = {}
        for batch in batches:
            for of, block, n, squares, weights in zip(*[c.to_pylist() for c in batch.columns]):
                n = np.frombuffer(n, np.int32).astype(np.int64)
                new = [n, np.frombuffer(squares, np.float32) * n, np.frombuffer(weights, np.float16).reshape(per, WAYS).astype(np.float32) * n[:, None].astype(np.float32)]
                sums[of, block] = [x + y for x, y in zip(sums[of, block], new)] if (of, block) in sums else new
        for (of, block), (n, squares, weights) in sums.items():
            yield rows([of], [block], [n], [(squares / np.maximum(n, 1)).astype(np.float32)], [(weights / np.maximum(n, 1)[:, None]).astype(np.float32)])

    for turn in range(rounds):
        shared = context.broadcast((counts, weights))

        def improved(batches, shared=shared):
            model = Model(*shared.value)
            for whole in batches:
                for batch in slices(whole, 0, SLICE_BYTES):
                    (_, leaf, features), _ = model.tokens(batch.column(0))
                    model.update(leaf, features)
            for of, (own, squares, seen) in enumerate(zip(model.weights, model.squares, model.seen)):
                seen, squares, own = seen.astype(np.int32).reshape(-1, per), squares.astype(np.float32).reshape(-1, per), own.astype(np.float16).reshape(-1, BLOCK)
                changed = np.flatnonzero(seen.any(axis=1))
                for some in np.array_split(changed, len(changed) // 64 + 1):
                    yield rows(np.full(len(some), of), some, seen[some], squares[some], own[some])

        share = docs.select(text_col).filter(F.pmod(F.xxhash64(text_col), F.lit(rounds)) == turn)
        means, squares = weights.rows.copy(), weights.squares.copy()
        for r in share.mapInArrow(improved, out).repartition("of", "block").mapInArrow(averaged, out).collect():
            here, changed = slice(r.block * per, (r.block + 1) * per), np.frombuffer(r.n, np.int64) > 0
            means[r.of, here][changed] = np.frombuffer(r.weights, np.float32).reshape(per, WAYS)[changed]
            squares[r.of, here][changed] = np.frombuffer(r.squares, np.float32)[changed]
        weights = Weights(means, squares)
        shared.unpersist()
    return weights


def score_texts(docs: DataFrame, vocabulary: DataFrame, counts: Counts, weights: Weights,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) per row of ``docs``.

    Tokens are the words, A-Z lower-cased, and one end. ``base_score`` is the unigram score with
    half a count added; ``score`` is the model's, in which all unseen words are one event, as in
    the base. Null and empty texts are an end alone. Repeated rows give repeated rows, and a
    null id stays null. Without training rows both scores are 0 per unseen word.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((counts, weights))
    unseen = counts.unseen()
    log_total, log_seen, log_unseen = (float(np.log10(x)) if x > 0 else 0.0 for x in (counts.n + 0.5 * (counts.n_distinct + 1), 1 - unseen, unseen))
    kind = docs.schema[id_col].dataType

    def scored(batches):
        model = Model(*shared.value)
        base = np.log10(model.counts.counts + 0.5) - log_total
        log_mass = np.log10(np.where(model.counts.buckets > 0, model.counts.buckets, 1))
        n_frequent, row = len(model.counts.words), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                (document, leaf, features), (code, words, leaves, bucket) = model.tokens(batch.column(1))
                size, chance = batch.num_rows, model.log10(leaf, features) + log_seen
                n_tokens = np.bincount(document, minlength=size)
                known = (leaf >= 0) & (leaf < n_frequent)
                n_known = np.bincount(document[known], minlength=size)
                total = np.bincount(document[known], base[leaf[known]], size) if n_frequent else np.zeros(size)
                score = np.bincount(document[known], chance[known], size)
                # Words that are not frequent, and the end if it is not, are looked up by a join; unseen ones have no leaf.
                rare = np.flatnonzero(~known)
                pairs, of, times = np.unique(document[rare] * len(words) + code[rare], return_inverse=True, return_counts=True)
                shares = chance[rare] - log_mass[bucket[code[rare]]] if len(log_mass) else np.zeros(len(rare))
                late = np.bincount(of, shares, len(pairs))
                texts = words.take(pa.array(pairs % len(words)))
                ids = row + np.arange(size)
                row += size
                none = pa.nulls(size, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), batch.column(0), none, pa.array(n_tokens), pa.array(n_known), pa.array(total, pa.float64()), pa.array(score, pa.float64())], names)
                blank = pa.nulls(len(pairs), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[pairs // len(words)]), pa.nulls(len(pairs), batch.column(0).type), texts, pa.array(times), pa.nulls(len(pairs), pa.int64()), blank, pa.array(late, pa.float64())], names)

    names = ["row", "id", "word", "n", "known", "base", "score"]
    made = stored(docs.select(id_col, text_col).mapInArrow(scored, f"row long, id {kind.simpleString()}, word string, n long, known long, base double, score double"))
    joined = made.filter("word IS NOT NULL").select("row", "word", "n", F.col("score").alias("leaf")).join(vocabulary, "word", "left")
    c = F.coalesce("c", F.lit(0))
    late = joined.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"),
                                     F.sum(F.col("n") * (F.log10(c + 0.5) - log_total)).alias("base_more"),
                                     F.sum(F.when(F.col("c").isNotNull(), F.col("leaf") + F.col("n") * F.log10(F.col("c") - DISCOUNT))
                                           .otherwise(F.col("n") * log_unseen)).alias("score_more"))
    zero = F.lit(0.0)
    return made.filter("word IS NULL").drop("word").join(late, "row", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("base_more", zero)).alias("base_score"), (F.col("score") + F.coalesce("score_more", zero)).alias("score"))


@query("op9_lm_score")
def language_model_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    training = docs.filter(~held_out(F.col("doc_id")))
    vocabulary = stored(count_words(training))
    counts = summary(vocabulary)
    scores = score_texts(docs, vocabulary, counts, train(training, counts))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(counts.n).cast("long").alias("train_tokens"), "base_score", "score")
