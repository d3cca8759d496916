"""Mixing against the stated loop."""

import hashlib
import random

import pytest

from lecturespark.llm import mixing as m

from .plain import mix, words

SCHEMA = "doc_id long, text string, source string, size string, taken string"


def key(doc_id):
    return int(hashlib.md5(f"{m.SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:15], 16)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    mixed = m.mix_sources(docs)
    got = sorted((tuple(r) for r in mixed.select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)
    want = sorted(((r[0], *w) for r, w in zip(rows, mix(rows, key))), key=repr)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    again = sorted((tuple(r) for r in m.mix_sources(docs.repartition(3)).select("doc_id", "taken").collect()), key=repr)
    assert again == sorted(((g[0], g[4]) for g in got), key=repr)
    return docs, mixed


def test_random_sources(spark):
    rng = random.Random(9)
    share = ["big"] * 30 + ["a", "b", "Z", "é", None, "tiny"]
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 5, 40]))), rng.choice(share)) for i in range(300)]
    rows += [(None, "one two", "a"), (None, "one two", "a"), (5, None, "b"), (5, "", "b"), (400, " \t\x0b ", "zero"), (401, "long " * 5000, "b"), rows[0], rows[0]]
    docs, mixed = check(spark, rows)
    taken = {r.source: r.words for r in mixed.join(docs.select("doc_id", "source").distinct(), "doc_id").groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "words").collect()}
    assert taken


def test_mixed_corpus(spark):
    rows = [(i, " ".join(f"w{i}.{j}" for j in range(10)) + " ", "big" if i < 50 else "small") for i in range(55)]
    docs, mixed = check(spark, rows)
    amounts = {r.doc_id: r.taken for r in mixed.collect()}
    corpus = m.apply_mix(docs, mixed)
    assert corpus.columns == [*docs.columns, "copy"]
    assert m.apply_mix(docs.withColumnRenamed("taken", "copy"), mixed).columns == ["doc_id", "text", "source", "size", "copy"]
    counts = {}
    for r in corpus.collect():
        assert rows[r.doc_id][1].startswith(r.text)
        counts[r.doc_id] = counts.get(r.doc_id, 0) + len(words(r.text))
    assert counts == {i: n for i, n in amounts.items() if n}


def test_nothing_to_mix(spark):
    check(spark, [(1, None, "a"), (2, "", None)])
    assert m.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_cut_copy_is_marked(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (40 + 7 * i), source) for i, source in enumerate("aaabbbbbbbbbcccccccc")], "doc_id long, text string, source string")
    corpus = m.apply_mix(docs, m.mix_sources(docs), mark="cut")
    assert corpus.columns == [*docs.columns, "copy", "cut"]
    rows = corpus.collect()
    assert any(r.cut for r in rows) and all(r.cut == (len(words(r.text)) < 40 + 7 * r.doc_id) for r in rows)
