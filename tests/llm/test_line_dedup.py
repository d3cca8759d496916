"""Line dedup against a plain version."""

import random

from lecturespark.llm import line_dedup as d

from .plain import kept_lines

SCHEMA = "doc_id long, text string, n_dropped string, kept_text string"


def check(spark, rows, **limits):
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    bitmaps = d.keep_bitmaps(docs, **limits)
    got = d.apply_bitmaps(docs, bitmaps).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    want = [(r[0], *w) for r, w in zip(rows, kept_lines(rows, **limits))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    return bitmaps


def test_random_lines(spark):
    rng = random.Random(3)
    pool = ["Line %d of the common kind, long enough to count here" % i for i in range(40)] + ["short", "", "ÄÖÜ É" * 10, "x" * 40, "x" * 39]
    change = lambda s: rng.choice([s, s.upper(), f" \t{s}\x0b ", f"{s}\r"])
    rows = [(i, "\n".join(change(rng.choice(pool)) for _ in range(rng.randint(0, 150)))) for i in range(60)]
    rows += [(None, "\n".join(pool)), (None, pool[0]), (7, rows[7][1]), (8, pool[1]), (100, None), (101, ""), (102, "\n\n"), (103, pool[2] * 5000 + "\n" + pool[0])]
    check(spark, rows)
    check(spark, rows, min_chars=5, min_docs=2)


def test_words_of_64_lines(spark):
    line = "A line that every one of the documents repeats, over and over"
    rows = [(i, "\n".join([f"own {i}", *[line] * 200, "end"])) for i in range(6)]
    found = check(spark, rows).collect()
    assert len(found) == 5 and all(len(r.keep) == 4 and r.n_dropped == 200 for r in found)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert d.apply_bitmaps(docs, d.keep_bitmaps(docs)).count() == 0
