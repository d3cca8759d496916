"""Language identification: paths against all paths, held-out accuracy, and odd inputs."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from lecturespark.llm import language as g

DATA = "/root/testdata/sf0.01"


def test_best_paths_against_all_paths():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 5, 3, 0, 6, 2]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(0, 3, (offsets[-1], 3)).astype(np.float32)
    states = g.best_paths(scores, offsets, switch=2.5)
    for a, b in zip(offsets, offsets[1:]):
        value = lambda p: sum(scores[a + i, s] for i, s in enumerate(p)) - 2.5 * sum(x != y for x, y in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=b - a), key=value)
        assert value(tuple(states[a:b])) >= value(best) - 1e-4
    assert len(g.best_paths(np.zeros((0, 3), np.float32), np.array([0]))) == 0


def test_held_out_accuracy(spark):
    rows = g.language_query(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    unseen = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(unseen) > 150
    assert sum(r.lang == r.lang_pred for r in unseen) / len(unseen) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


TRAIN = [("the house and the garden with the trees " * 5, "en"), ("das haus und der garten mit den bäumen " * 5, "de"),
         ("дом и сад с большими деревьями у реки " * 5, "ru"), (None, "en"), ("text without a language", None), ("123 456", "en")]


def model(spark):
    return g.fit_languages(spark.createDataFrame(TRAIN, "text string, lang string"))


def test_scripts_and_spans(spark):
    mixed = "the house and the garden " * 4 + "das haus und der garten " * 4 + "дом и сад " * 4
    docs = spark.createDataFrame([(1, mixed, "x")], "doc_id long, text string, lang string")
    spans = sorted(tuple(r) for r in g.language_spans(docs, model(spark)).collect())
    assert spans == [(1, 0, 19, "en"), (1, 20, 39, "de"), (1, 40, 51, "ru")]
    # A word of a script that one language alone uses is that language's, known or not.
    odd = spark.createDataFrame([(2, "щука", "x"), (3, "漢字 漢字", "x")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in g.identify(odd, model(spark)).collect()}
    assert got[2] == "ru" and got[3] in ("de", "en", "ru")


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "123 !? \t \u0301"), (None, "the house"), (4, "the house"), (4, "the house"), (5, "das haus und " * 20_000)]
    docs = spark.createDataFrame([(*r, "x", "clash") for r in rows], "doc_id long, text string, lang string, score string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.lang_pred, r.score) for r in g.identify(docs, model(spark)).collect())
    assert got == [(False, 1, "und", 0.0), (False, 2, "und", 0.0), (False, 3, "und", 0.0), (False, 4, "en", 1.0), (False, 4, "en", 1.0),
                   (False, 5, "de", 1.0), (True, 0, "en", 1.0)]
    kept = g.with_language(docs.withColumn("lang", F.lit(None).cast("string")), model(spark), min_share=0.5)
    assert kept.columns == docs.columns and sorted(r.lang for r in kept.collect()) == ["de", "en", "en", "en"]
    assert g.identify(docs.limit(0), model(spark)).count() == 0


def test_without_training_rows(spark):
    none = g.fit_languages(spark.createDataFrame([], "text string, lang string"))
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert [tuple(r) for r in g.identify(docs, none).collect()] == [(1, "und", 0.0)]
    assert g.language_spans(docs, none).count() == 0


def test_only_texts_that_fit_stay(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("lang IS NOT NULL AND length(text) > 600").limit(600).collect()]
    learned = g.fit_languages(spark.createDataFrame([r for r in rows if r[1] != "de"], "text string, lang string"))
    rng = np.random.default_rng(3)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 900)) for _ in range(20)]
    parts = {lang: next(t for t, own in rows if own == lang)[:300] for lang in ("en", "fr", "es")}
    cases = [*[(t, lang) for t, lang in rows], *[(t, "noise") for t in noise], ("漢字 " * 200, "script"), (" ".join(parts.values()), "mixture"), (parts["en"][:12], "short")]
    docs = spark.createDataFrame([(t, kind, None) for t, kind in cases], "text string, kind string, lang string")
    kept = g.with_language(docs, learned, fitting=True).groupBy("kind").count()
    kept = {r["kind"]: r["count"] for r in kept.collect()}
    count = lambda kind: sum(k == kind for _, k in cases)
    assert kept.get("de", 0) <= 0.05 * count("de") and "noise" not in kept and "script" not in kept
    assert all(kept[k] >= 0.99 * count(k) for k in ("en", "fr", "es", "mixture", "short"))


def test_without_labels_all_texts_with_letters_stay(spark):
    rows = [(1, "one two", None), (2, "", None), (3, None, None), (4, "123 !", None), (5, "ключ", None), (6, "x" * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = g.fit_languages(docs)
    for fitting in (True, False):
        kept = g.with_language(docs, model, fitting=fitting)
        assert sorted((r.doc_id, r.lang) for r in kept.collect()) == [(1, None), (5, None), (6, None)]
