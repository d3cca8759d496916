"""Words and word shingles of whole texts as arrays, for tasks that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
SLICE_BYTES = 4_000_000


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text, a single row at least; no row is cut."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        yield batch.slice(a, b - a)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, distinct words): text i has the words codes[offsets[i]:offsets[i + 1]], A-Z lower-cased.

    Words are runs of characters other than U+0020 and U+0009 to U+000D. A null text has none.
    """
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pa.concat_arrays([pc.fill_null(texts, "")])))
    lists = pc.ascii_split_whitespace(trimmed)
    counts = np.where(pc.binary_length(trimmed).to_numpy(zero_copy_only=False) == 0, 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = pc.list_flatten(lists)
    words = words.filter(pc.greater(pc.binary_length(words), 0))
    coded = words.dictionary_encode()
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    if len(words) == 0:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the sorted distinct shingles of each text as 64-bit hashes.

    A text of fewer than ``size`` words has its whole word sequence as one shingle, a text without words none.
    """
    offsets, codes, words = word_codes(texts)
    hashes = word_hashes(words)[codes]
    counts = np.diff(offsets)
    rows = np.repeat(np.arange(len(counts)), np.where(counts > 0, np.maximum(counts - size + 1, 1), 0))
    firsts = np.concatenate([[0], np.cumsum(np.where(counts > 0, np.maximum(counts - size + 1, 1), 0))])
    starts = offsets[rows] + np.arange(len(rows)) - firsts[rows]
    value = np.zeros(len(rows), np.uint64)
    ends = offsets[rows + 1] if len(rows) else offsets[:0]
    for i in range(size):
        at = starts + i
        inside = at < ends
        word = np.where(inside, hashes[np.minimum(at, max(len(hashes) - 1, 0))] if len(hashes) else 0, np.uint64(i + 1)).astype(np.uint64)
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + word)
    order = np.lexsort((value, rows))
    rows, value = rows[order], value[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    return np.concatenate([[0], np.cumsum(np.bincount(rows[first], minlength=len(counts)))]).astype(np.int64), value[first]


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups: rows sorted by their first ``keys`` columns, cut only where these change."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            column = batch.column(k).to_numpy(zero_copy_only=False)
            changed[1:] |= column[1:] != column[:-1]
            if rest:
                changed[0] |= rest[-1].column(k)[-1].as_py() != column[0]
        cuts = np.flatnonzero(changed)
        if len(cuts) == 0:
            rest.append(batch)
            continue
        last = int(cuts[-1])
        if rest or last:
            yield pa.Table.from_batches([*rest, batch.slice(0, last)])
        rest = [batch.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest)
