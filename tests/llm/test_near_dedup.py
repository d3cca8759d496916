"""Near-dedup against all pairs, and the sketch against its theory."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lecturespark.llm import line_dedup
from lecturespark.llm import near_dedup as n
from lecturespark.llm.words import shingle_sets, slices, word_codes

from .plain import classes, lower, near_classes, shingles, words

SCHEMA = "doc_id long, text string, n_shingles string, component_id string"
ODD = [None, "", " \t", "a\x0bb\x1cc d", "A É\x85x \xa0y", "one two three four", "one two three four five", "One  two\nthree FOUR"]


def texts(rng, count):
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))
    out = []
    for _ in range(count):
        base = [word() for _ in range(rng.choice([3, 8, 30, 120]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            out.append(rng.choice([" ", "\n"]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return out


def test_against_all_pairs(spark):
    rows = list(enumerate(texts(random.Random(1), 120) + ODD))
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in n.near_duplicates(docs).collect()}
    assert got == {i: (k, c, i == c) for i, (k, c) in near_classes(rows).items()}
    kept = n.without_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in got.items() if v[2])


def test_group_without_a_centre(spark):
    # A chain: neighbours are similar, the ends are not; no member is near to all.
    base = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(base[k * 20:k * 20 + 200])) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in n.near_duplicates(docs).collect()}
    assert got == near_classes(rows) and {c for _, c in got.values()} == {0}


def test_large_group_in_many_blocks(spark, monkeypatch):
    # Chains that share their words meet in one candidate group, cut into blocks of a few members.
    monkeypatch.setattr(n, "BLOCK", 4)
    base = [f"w{i}" for i in range(900)]
    rows = [(k, " ".join(base[k * 20:k * 20 + 200])) for k in range(30)]
    rows += [(100 + k, " ".join(base[k * 20:k * 20 + 120] + [f"v{k}x{j}" for j in range(80)])) for k in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_classes(rows)


def exact_classes(rows):
    """Classes by counting shared shingles of every pair that shares any."""
    sets = {i: shingles(t) for i, t in rows}
    holders, shared, links = defaultdict(list), Counter(), []
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    for ids in holders.values():
        if len(ids) > 1:
            shared.update(combinations(ids, 2))
    for (a, b), both in shared.items():
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    return classes(sets, links)


def test_whole_table_against_exact_pairs(spark):
    # No linked pair of the table is missed, also where lines that documents share are gone.
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).select("doc_id", F.col("kept_text").alias("text"))
    for table in (docs.select("doc_id", "text"), cut):
        got = {r.doc_id: r.component_id for r in n.near_duplicates(table).collect()}
        assert got == exact_classes([tuple(r) for r in table.collect()])


def test_null_and_repeated_ids(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (3, text), (3, text), (4, text), (3, "other words that stand alone in here"), (9, "other words that stand alone in here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in n.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, 3, None, True), (3, 3, 3, True), (3, 3, 3, True), (4, 3, 3, False), (3, 3, 3, True), (9, 3, 3, False)], key=repr)
    assert n.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(map(str, [r.doc_id for r in n.without_duplicates(docs).collect()])) == ["3", "3", "None"]


def test_words_of_sliced_batches():
    rng = random.Random(4)
    values = [*ODD, *texts(rng, 30), "é à ö" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(values)], ["t"])
    for parts in ([batch], list(slices(batch, 0, 300))):
        at = 0
        for part in parts:
            offsets, codes, distinct = word_codes(part.column(0))
            sets, hashes = shingle_sets(part.column(0))
            for i in range(part.num_rows):
                text = values[at + i]
                assert [distinct[int(k)].as_py() for k in codes[offsets[i]:offsets[i + 1]]] == words(lower(text))
                assert sets[i + 1] - sets[i] == len(shingles(text)) == len(set(hashes[sets[i]:sets[i + 1]].tolist()))
            at += part.num_rows
        assert at == len(values)


def test_registers_agree_as_often_as_sets():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.75, 0.9):
        common, own = int(1000 * share), int(1000 * (1 - share) / 2)
        agree = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, common + 2 * own).astype(np.uint64)
            a, b = pool[:common + own], np.concatenate([pool[:common], pool[common + own:]])
            x, y = n.sketch(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]))
            agree.append((x == y).mean())
            both = n.sketch(np.array([0, len(pool)]), pool)[0]
            assert (np.maximum(x, y) == both).all()  # sketches merge
            sizes = np.array([float(len(a))])
            assert n.likely(sizes, sizes, np.array([(x > y).sum()]), np.array([(x < y).sum()]), 0.75)[0] == (share >= 0.7)
        assert abs(np.mean(agree) - share) < 0.02
