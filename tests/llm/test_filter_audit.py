"""The filter audit against a document-by-document recount."""

import re
from itertools import permutations

from lecturespark.llm import filter_audit as d

from .plain import words

SCHEMA = "doc_id long, text string, lang string, digest string, n long, part string"


def failing(rows, at):
    i, text, _ = rows[at]
    text = text or ""
    w = words(text)
    return {letter for letter, fails in (
        ("A", len(w) < 100), ("B", 100 * len(set(w)) < 80 * len(w)),
        ("C", 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)), ("D", bool(re.search(r"[#$%&*|]", text))),
        ("E", i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows))) if fails}


def plain_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    fails = [failing(rows, at) for at in range(len(rows))]
    out = {}
    for part in {lang or "" for *_, lang in rows}:
        own = [at for at, r in enumerate(rows) if (r[2] or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = set(own)
            for step, letter in enumerate(order, 1):
                gone = {at for at in left if letter in fails[at]}
                before, left = set(own) - left, left - gone
                removed_by[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in fails[at] for at in before), sum(fails[at] == {letter} for at in own),
                    sum(rows[at][0] in good for at in gone), sum(rows[at][0] in toxic for at in gone), letter]
        for key, value in out.items():
            if key[0] == part:
                value[-1] = removed_by[value[-1]] if isinstance(value[-1], str) else value[-1]
    return {k: tuple(v) for k, v in out.items()}


def check(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = d.audit(d.mask_cells(docs, marks))
    assert dict(got.dtypes)["step"] == "int" and all(dict(got.dtypes)[c] == "bigint" for c in (*d.COUNTS, "shapley"))
    got = {(r.part, r.filter_order, r.step): (*[r[c] for c in d.COUNTS], r.shapley) for r in got.collect()}
    assert got == plain_audit(rows, labels)


def test_odd_documents(spark):
    long = " ".join(f"word{i}" for i in range(120))
    rows = [(1, long, "en"), (2, long, "de"), (3, long, "de"), (3, long, "de"), (4, "A", None), (5, None, ""), (6, "", "fr"), (None, long, "en"),
            (None, None, None), (7, "same " * 300, "en"), (8, "Ab " * 50 + "#", "en"), (9, "X" * 99 + "$", "en"), (10, "x" * 9 + "A", "en"),
            (11, long + " |", "fr"), (12, "w x " * 101, "fr"), (13, long * 400, "en"), (0, "same " * 300, "fr"),
            (14, "a\x0bb\x0cc\rd\te\nf " * 20, "en"), (2, "another text", "en")]
    labels = [(1, 1, 1), (2, 0, 1), (2, 1, 0), (3, 1, 0), (7, None, 1), (8, 1, None), (None, 1, 1), (99, 1, 1), (5, 1, 1)]
    check(spark, rows, labels)


def test_empty_tables(spark):
    check(spark, [(1, "one", "en"), (2, "one", "en")], [])
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert d.audit(d.mask_cells(docs, labels)).count() == 0


def test_one_text_in_most_rows(spark):
    check(spark, [(i, "copy of one text" if i % 3 else f"text {i} " * i, "en" if i % 2 else "fr") for i in range(60)], [(i, i % 2, int(i % 5 == 0)) for i in range(50)])
