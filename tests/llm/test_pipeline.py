"""The pipeline and the registered queries."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lecturespark.llm import decontaminate, language, mixing
from lecturespark.llm.queries import ORACLES, QUERIES

from ..compare import difference, duck, duck_rows, spark_rows
from .plain import kept_lines, lower, mix, near_classes, nearest_edits, words
from .test_mixing import key

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_with_oracle(spark, name):
    assert difference(spark_rows(QUERIES[name](spark, DATA)), duck_rows(duck(DATA), ORACLES[name])) == ""


def test_registered():
    names = [*entry.queries()]
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names


def fitting(model, text):
    """Word by word: the cheapest path through the languages, and whether its n-grams are likely enough for them."""
    own, score, least, spread, letters = 0, 0.0, 0.0, 0.0, 0
    price, back = np.zeros(len(model.languages)), []
    read = []
    for word in words(lower(text)):
        points, firsts = language._letters(pa.array([word]))
        bins, _ = language._grams(points, firsts)
        script = int(language._word_scripts(points, firsts)[0])
        value = model.scores[bins].sum(axis=0) + (np.where(model.uses[script], 0, language.NARROWED) if script >= 0 else 0)
        read.append((value, int(firsts[-1]), script >= 0 and bool(model.learned[script])))
        moved = price.max() - language.SWITCH
        back.append([int(price.argmax()) if moved > p else n for n, p in enumerate(price)] if len(read) > 1 else None)
        price = (np.maximum(price, moved) if len(read) > 1 else price) + value
    path = [int(price.argmax())] if read else []
    for step in reversed(back[1:]):
        path.append(step[path[-1]])
    for (value, n, learned), state in zip(read, reversed(path)):
        letters += n
        if learned:
            own += n
            grams = len(language.GRAMS) * n + 2
            score, least, spread = score + value[state] * len(language.GRAMS) - grams * model.floors[state], least + grams, spread + n * model.spreads[state]
    return letters > 0 and own >= language.LABELLED * letters and own > 0 and score / max(least, 1) >= -language.ERRORS * spread / max(own, 1) / max(own, 1) ** 0.5


def test_run_against_plain_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit_languages(docs)
    rows = [r for r in docs.collect() if fitting(model, r.text)]
    texts = [(r.doc_id, w[2]) for r, w in zip(rows, kept_lines([(r.doc_id, r.text) for r in rows]))]
    classes = near_classes(texts)
    texts = [(i, t) for i, t in texts if classes[i][1] == i]
    tests = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert min(map(len, tests)) >= decontaminate.MIN_CHARS
    budgets = np.array([int(len(t) * decontaminate.RATE) for t in tests])
    # The plain table takes minutes for the longest texts.
    matcher = decontaminate.Matcher(list(enumerate(tests)), decontaminate.RATE)
    leaks = lambda t: (nearest_edits(tests, t) <= budgets).any() if len(t) < 4000 else next(matcher.find(t), None) is not None
    clean = [(i, t) for i, t in texts if not leaks(decontaminate.normal(t))]
    assert len(clean) < len(texts)
    source = {r.doc_id: r.source for r in rows}
    amounts = mix([(i, t, source[i]) for i, t in clean], key)
    want = Counter({i: a[3] for (i, _), a in zip(clean, amounts) if a[3]})
    got = Counter()
    for r in corpus_pipeline.run(spark, DATA).select("doc_id", mixing.word_count(mixing.F.col("text")).alias("n")).collect():
        got[r.doc_id] += r.n
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "one two", "en", "s", 7), (2, "", "en", None, 0), (3, "one two three four", None, "s", None), (3, "one two three four", None, "s", None)],
                                 spark.read.parquet(f"{DATA}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, DATA)
            assert out.columns[:5] == docs.columns and out.count() <= 10
            assert name == "mix_sources" or out.columns == docs.columns
