"""Suffix-array dedup: every byte covered by a long string that also starts elsewhere goes.

Suffixes are taken at anchors only: in each window of ``LENGTH`` bytes the anchor is the
k-gram of least hash, so equal windows have equal anchors at equal places. Anchors that
occur twice pull the bytes around them into buckets. A bucket's suffixes are sorted by
mergesort, in which prefix polynomial hashes and a binary search find the common
extension of two suffixes in logarithmic time; runs of common extensions and hashes
of what stands left of the anchor tell which windows are equal. Every match is then
verified on its bytes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .shared import stored
from .words import mixed, runs, slices

LENGTH, GRAM = 200, 40
CHUNK = 1 << 20
#: Buckets of more distinct strings than this are split by window instead of sorted in one task.
LARGE = 4096
POSITION_BITS = 22


class Prefixes:
    """Prefix polynomial hashes modulo 2^64: the hash of any part in constant time."""

    BASE = 0x9E3779B97F4A7C15
    VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(self.powers) < n:
            for name, factor in (("powers", self.BASE), ("inverses", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(type(self), name, np.multiply.accumulate(steps))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self.VALUES[data] * self.powers[:n - 1], out=self.sums[1:])

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverses[start]

    def grams(self, size: int) -> np.ndarray:
        return mixed((self.sums[size:] - self.sums[:-size]) * self.inverses[:len(self.sums) - size])


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of each anchor of a text of up to 2^POSITION_BITS bytes."""
    hashes = Prefixes(data).grams(gram)
    width = length - gram + 1
    low = np.uint64((1 << POSITION_BITS) - 1)
    ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # of equal grams the leftmost
    # The least of every ``width`` neighbours, from running minima of blocks in both directions.
    blocks = np.full(-(-len(ranked) // width) * width, ~np.uint64(0))
    blocks[:len(ranked)] = ranked
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(data) - length + 1
    place = (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    return hashes[place[first]], place[first], first, last


def text_anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchors`` of a text of any size, in chunks of windows."""
    whole = np.frombuffer(data, np.uint8)
    parts = []
    for start in range(0, max(0, len(whole) - length + 1), CHUNK):
        h, *places = anchors(whole[start:start + CHUNK + length - 1], length, gram)
        parts.append((h, *[p + start for p in places]))
    if not parts:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    return tuple(np.concatenate(c) for c in zip(*parts))


class Bucket:
    """Suffixes at the anchors of some strings: string i is ``data[start[i]:end[i]]`` with its anchor at ``at[i]``."""

    def __init__(self, strings: list[bytes], offsets: np.ndarray, groups: np.ndarray):
        self.bytes = b"".join(strings)
        self.data = np.frombuffer(self.bytes + b"\0", np.uint8)
        sizes = np.array([len(s) for s in strings], np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.at = self.start + offsets
        self.groups = groups
        self.prefixes = Prefixes(self.data)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the common prefix of the suffixes i and j, by binary search over hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.end[i] - self.at[i], self.end[j] - self.at[j])
        a, b = self.at[i], self.at[j]
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.prefixes.part(a, a + middle) == self.prefixes.part(b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before suffix j: by group, then by its bytes, a prefix first."""
        result = self.groups[i] < self.groups[j]
        same = np.flatnonzero(self.groups[i] == self.groups[j])
        if len(same):
            x, y = i[same], j[same]
            common = self.extension(x, y)
            a, b = self.at[x] + common, self.at[y] + common
            over_a, over_b = a >= self.end[x], b >= self.end[y]
            result[same] = np.where(over_a | over_b, over_a & ~over_b, self.data[np.minimum(a, len(self.data) - 1)] < self.data[np.minimum(b, len(self.data) - 1)])
        return result

    def sorted(self) -> np.ndarray:
        """Bottom-up mergesort of all suffixes; every merge of a level is done at once. ``groups`` must rise."""
        n = len(self.groups)
        order, width = np.arange(n), 1
        while width < n:
            position = np.arange(n)
            pair, right = position // (2 * width), position // width % 2 == 1
            first = pair * 2 * width
            middle, last = np.minimum(first + width, n), np.minimum(first + 2 * width, n)
            # Runs that end in different groups are in order already.
            inner = np.minimum(middle, n - 1)
            mixed_runs = (middle < last) & (self.groups[order[inner]] == self.groups[order[np.maximum(inner - 1, 0)]])
            own = np.flatnonzero(mixed_runs)
            if len(own):
                side = right[own]
                low, high = np.where(side, first[own], middle[own]), np.where(side, middle[own], last[own])
                base = low.copy()
                todo = np.flatnonzero(low < high)
                while len(todo):
                    probe = (low[todo] + high[todo]) // 2
                    me, other = order[own[todo]], order[probe]
                    # Equal suffixes: those of the left run first.
                    goes = np.where(side[todo], ~self.before(me, other), self.before(other, me))
                    low[todo] = np.where(goes, probe + 1, low[todo])
                    high[todo] = np.where(goes, high[todo], probe)
                    todo = todo[low[todo] < high[todo]]
                start = np.where(side, middle[own], first[own])
                target = first[own] + (own - start) + (low - base)
                merged = order.copy()
                merged[target] = order[own]
                order = merged
            width *= 2
        return order

    def repeated(self, length: int, many: np.ndarray) -> np.ndarray:
        """strings x offsets: whether the window with that many bytes left of the anchor occurs in another string, or the string does."""
        n, most = len(self.groups), int((self.at - self.start).max(initial=0))
        found = np.zeros((n, most + 1), bool)
        order = self.sorted()
        common = np.full(n, -1)
        if n > 1:
            inside = np.flatnonzero(self.groups[order[1:]] == self.groups[order[:-1]]) + 1
            common[inside] = self.extension(order[inside - 1], order[inside])
        left, right = (self.at - self.start)[order], (self.end - self.at)[order]
        pairs: dict[tuple[int, int], list[int]] = {}
        ones, twos, lefts = [], [], []
        for a in range(most + 1):
            run = np.cumsum(common < length - a)
            fits = np.flatnonzero((left >= a) & (right >= length - a))
            fits = fits[np.bincount(run[fits], minlength=n + 1)[run[fits]] > 1]
            if len(fits) == 0:
                continue
            at = self.at[order[fits]]
            key = mixed(self.prefixes.part(at - a, at) + mixed(run[fits].astype(np.uint64)))
            by = np.argsort(key, kind="stable")
            same = np.concatenate([[False], key[by][1:] == key[by][:-1]])
            hit = np.flatnonzero(same)
            x, y = order[fits[by[hit - 1]]], order[fits[by[hit]]]
            found[x, a] = found[y, a] = True
            ones.append(x)
            twos.append(y)
            lefts.append(np.full(len(x), a))
        if ones and not self._verified(np.concatenate(ones), np.concatenate(twos), np.concatenate(lefts), length):
            found = self._by_bytes(length, most)
        offsets = np.arange(most + 1)[None, :]
        own = (offsets <= (self.at - self.start)[:, None]) & (length - offsets <= (self.end - self.at)[:, None])
        return np.where(many[:, None], own, found)

    def _verified(self, x: np.ndarray, y: np.ndarray, a: np.ndarray, length: int) -> bool:
        """Whether the bytes of all matches are equal; a pair's matches are compared once, over all they cover."""
        if len(x) == 0:
            return True
        code = x * np.int64(len(self.groups)) + y
        by = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], code[by][1:] != code[by][:-1]]))
        most, least = np.maximum.reduceat(a[by], first), np.minimum.reduceat(a[by], first)
        i, j = self.at[x[by][first]], self.at[y[by][first]]
        text = self.bytes
        return all(text[p - m:p + length - k] == text[q - m:q + length - k] for p, q, m, k in zip(i.tolist(), j.tolist(), most.tolist(), least.tolist()))

    def _by_bytes(self, length: int, most: int) -> np.ndarray:
        """The same from the windows' own bytes: the way out if two different strings share a hash."""
        def windows():
            for i, (s, p, e) in enumerate(zip(self.start.tolist(), self.at.tolist(), self.end.tolist())):
                for a in range(most + 1):
                    if p - a >= s and p - a + length <= e:
                        yield i, a, (self.groups[i], a, self.bytes[p - a:p - a + length])

        counts = Counter(w for _, _, w in windows())
        found = np.zeros((len(self.groups), most + 1), bool)
        for i, a, w in windows():
            found[i, a] = counts[w] > 1
        return found


def _text_id(digest: Column) -> Column:
    return F.unhex(F.substring(digest, 1, 32))


def _table(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def _ranges(row: np.ndarray, start: np.ndarray, rows: int) -> list[pa.Array]:
    """Runs of consecutive starts per row, as lists of first and of last starts; rows and starts rise."""
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])[:len(row)]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(row)]])[:len(first)] - 1
    sizes = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=rows))]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(sizes), pa.array(start[at].astype(np.int32))) for at in (first, last)]


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """Which bytes of each distinct text go, judged over all rows of ``docs``.

    Two tables: (digest, n_rows) for every distinct text, and (digest, data, spans) for texts of
    which some part occurs in another text, or twice in themselves; the spans are sorted
    and may overlap. A text that several rows hold goes as a whole if it has ``length``
    bytes, whatever its spans. Null texts are empty; shorter texts lose nothing; matches
    never cross rows.
    """
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    texts = docs.select(data.alias("data")).withColumn("digest", F.sha2("data", 256))
    held = stored(texts.groupBy("digest").agg(F.count("*").alias("n_rows")))
    long = texts.filter(F.octet_length("data") >= length).select(_text_id(F.col("digest")).alias("text_id"), "data")

    def found_anchors(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, 1, CHUNK):
                for text_id, text in zip(part.column(0), part.column(1)):
                    h, place, _, _ = text_anchors(text.as_py(), length, gram)
                    ids = pa.array([text_id.as_py()] * len(h), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids, pa.array(place)], ["hash", "text_id", "place"])

    every = long.mapInArrow(_gathered(found_anchors), "hash long, text_id binary, place long")
    every = stored(every)
    # Copies of a text give equal keys, so an anchor counts once per distinct text and place.
    key = F.xxhash64("text_id", "place")
    # Stored, so that the join has two plain sides and a common anchor can be split.
    twice = stored(every.groupBy("hash").agg(F.min(key).alias("low"), F.max(key).alias("high")).filter("low <> high").select("hash"))
    places = stored(every.join(twice, "hash").select("text_id", "place").distinct().groupBy("text_id").agg(F.collect_list("place").alias("places")))
    single = long.groupBy("text_id").agg(F.first("data").alias("data"))
    touched = stored(single.join(places, "text_id"))

    schema = "hash long, text_id binary, first long, offset int, string_id binary, string binary"

    def cut(batches):
        for batch in batches:
            for part in slices(batch, 1, CHUNK):
                rows = []
                for text_id, text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    h, place, first, last = text_anchors(text, length, gram)
                    for i in np.flatnonzero(np.isin(place, wanted.values.to_numpy())).tolist():
                        string = text[first[i]:last[i] + length]
                        offset = int(place[i] - first[i])
                        rows.append((int(h[i:i + 1].view(np.int64)[0]), text_id, int(first[i]), offset,
                                     hashlib.blake2b(string + offset.to_bytes(4, "big"), digest_size=16).digest(), string))
                yield pa.RecordBatch.from_pylist([dict(zip(_table(schema), r)) for r in rows], _arrow_schema)

    _arrow_schema = pa.schema([("hash", pa.int64()), ("text_id", pa.binary()), ("first", pa.int64()), ("offset", pa.int32()), ("string_id", pa.binary()), ("string", pa.binary())])
    strings = stored(touched.select("text_id", "data", "places").mapInArrow(cut, schema))
    # Equal strings meet before the buckets do: of a common passage one string is left but for its edges.
    distinct = stored(strings.groupBy("hash", "string_id").agg(F.count("*").alias("n"), F.first("offset").alias("offset"), F.first("string").alias("string")))
    crowded = distinct.groupBy("hash").agg(F.count("*").alias("size")).filter(F.col("size") > large)
    out = "hash long, string_id binary, starts array<int>, ends array<int>"

    def judged(batches):
        for rows in runs(batches, 1):
            if rows.num_rows == 0:
                continue
            offsets, hashes = rows.column("offset").to_numpy().astype(np.int64), rows.column("hash").to_numpy()
            groups = np.concatenate([[0], np.cumsum(hashes[1:] != hashes[:-1])])
            bucket = Bucket(rows.column("string").to_pylist(), offsets, groups)
            found = bucket.repeated(length, rows.column("n").to_numpy() > 1)
            some = np.flatnonzero(found.any(axis=1))
            # Windows as rising starts in the string instead of bytes left of the anchor.
            which, back = np.nonzero(found[some][:, ::-1])
            starts = offsets[some][which] - (found.shape[1] - 1 - back)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[some]), rows.column("string_id").combine_chunks().take(pa.array(some)), *_ranges(which, starts, len(some))], _table(out))

    usual = distinct.join(crowded, "hash", "left_anti").repartition("hash").sortWithinPartitions("hash", "string_id").mapInArrow(judged, out)

    def windows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("string")[i].as_py()
                offset = batch.column("offset")[i].as_py()
                n = len(text) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("hash")[i].as_py()] * n, pa.int64()), pa.array([batch.column("string_id")[i].as_py()] * n, pa.binary()),
                     pa.array([batch.column("n")[i].as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)),
                     pa.array([hashlib.blake2b(text[w:w + length] + (offset - w).to_bytes(4, "big"), digest_size=16).digest() for w in range(n)], pa.binary())],
                    ["hash", "string_id", "n", "start", "window"])

    spread = stored(distinct.join(crowded, "hash").select("hash", "string_id", "n", "offset", "string").mapInArrow(
        _gathered(windows), "hash long, string_id binary, n long, start int, window binary"))
    equal = spread.groupBy("hash", "window").agg(F.sum("n").alias("n_window")).filter("n_window > 1").select("hash", "window")
    split = spread.join(equal, ["hash", "window"]).groupBy("hash", "string_id").agg(F.sort_array(F.collect_set("start")).alias("windows"))

    def listed(batches):
        for batch in batches:
            windows = batch.column("windows")
            row = np.repeat(np.arange(batch.num_rows), np.diff(windows.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("string_id"), *_ranges(row, windows.flatten().to_numpy().astype(np.int64), batch.num_rows)], _table(out))

    covered = usual.union(split.mapInArrow(listed, out))
    found = strings.select("hash", "string_id", "text_id", "first").join(covered, ["hash", "string_id"])
    found = found.select("text_id", "first", F.explode(F.arrays_zip("starts", "ends")).alias("range"))
    found = found.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct(
        (F.col("first") + F.col("range.starts")).alias("start"), (F.col("first") + F.col("range.ends") + length).alias("end")))).alias("spans"))
    return held, touched.select("text_id", "data").join(found, "text_id").select(F.sha2("data", 256).alias("digest"), "data", "spans")


def _gathered(step, most: int = 50_000):
    """The same rows as ``step`` gives, in batches of about ``most`` rows."""
    def run(batches):
        waiting, rows = [], 0
        for batch in step(batches):
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, rows = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    return run


def without_repeats(spans: DataFrame) -> DataFrame:
    """(digest, kept, starts, ends, n_removed) of the texts of ``repeated_spans``: what stays, and the maximal spans that go."""

    def cut(batches):
        for batch in batches:
            for part in slices(batch, 1):
                kept, firsts, lasts, removed = [], [], [], []
                for data, spans in zip(part.column("data").to_pylist(), part.column("spans").to_pylist()):
                    runs_of: list[list[int]] = []
                    for span in spans:
                        if runs_of and span["start"] <= runs_of[-1][1]:
                            runs_of[-1][1] = max(runs_of[-1][1], span["end"])
                        else:
                            runs_of.append([span["start"], span["end"]])
                    firsts.append([a for a, _ in runs_of])
                    lasts.append([b for _, b in runs_of])
                    removed.append(sum(b - a for a, b in runs_of))
                    kept.append(b"".join(data[a:b] for a, b in zip([0, *lasts[-1]], [*firsts[-1], len(data)])))
                long = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(kept, pa.binary()), pa.array(firsts, long), pa.array(lasts, long), pa.array(removed, pa.int64())],
                                                 ["digest", "kept", "starts", "ends", "n_removed"])

    return spans.mapInArrow(cut, "digest string, kept binary, starts array<long>, ends array<long>, n_removed long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, large: int = LARGE) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends, kept) per row of ``docs``.

    ``kept`` and the spans are null where nothing goes, and where a whole text goes.
    Repeated rows are each other's repeats. Null ids stay null.
    """
    held, spans = repeated_spans(docs, text_col, length, large=large)
    cut = without_repeats(spans).withColumn("cut_sha256", F.sha2("kept", 256)).withColumn("n_spans", F.size("starts"))
    per_text = held.join(cut, "digest", "left")
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col), F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("digest"))
    copies = (F.col("n_rows") > 1) & (F.col("n_bytes") >= length)
    return rows.join(per_text, "digest", "left").select(
        id_col, "n_bytes", F.when(copies, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copies, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copies, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("cut_sha256", "digest")).alias("kept_sha256"),
        *[F.when(~copies, F.col(c)).alias(c) for c in ("starts", "ends", "kept")])


@query("op6_suffix_dedup")
def suffix_query(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
