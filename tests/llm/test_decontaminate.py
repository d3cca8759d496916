"""Leaks against a plain edit distance over every window."""

import random

from lecturespark.llm import decontaminate as d

ITEMS = "item_id long, text string, doc_id string"
DOCS = "doc_id long, text string, item_id string"


def nearest(pattern, text):
    """The least edit distance between the pattern and any part of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(pattern, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != p)))
        row = new
        best = min(best, row[-1])
    return best


def distance(a, b):
    row = list(range(len(a) + 1))
    for n, c in enumerate(b, 1):
        new = [n]
        for j, p in enumerate(a, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != p)))
        row = new
    return row[-1]


def edited(text, n, rng):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at:at + 1] = [[], [rng.choice("abcde ")], [out[at], rng.choice("abcde ")]][kind]
    return "".join(out)


def test_against_plain_distance(spark):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(i, words(rng.randint(6, 14))) for i in range(12)]
    docs = []
    for i in range(60):
        body = words(rng.randint(0, 25))
        if i % 2:
            leak = rng.choice(items)[1]
            body += " " + edited(leak, rng.randint(0, int(len(leak) * 0.16)), rng) + " " + words(rng.randint(0, 8))
        docs.append((i, body))
    items += [(100, None), (101, ""), (102, "short"), (103, items[0][1].upper().replace(" ", "\n \t"))]
    docs += [(200, None), (201, ""), (202, "xyz " * 30_000 + items[1][1]), (None, items[2][1]), (1, docs[1][1])]
    want = sorted((i, j, nearest(d.normal(t), d.normal(x))) for i, x in docs if x and len(x) < 10_000 for j, t in items
                  if t and len(d.normal(t)) >= 24 and nearest(d.normal(t), d.normal(x)) <= int(len(d.normal(t)) * d.RATE) and i is not None)
    assert any(w[2] for w in want)
    bench = spark.createDataFrame([(*x, "clash") for x in items], ITEMS)
    table = spark.createDataFrame([(*x, "clash") for x in docs], DOCS)
    for block in (d.BLOCK_CHARS, 100):
        rows = d.leaks(table, bench, block_chars=block).collect()
        assert sorted((r.doc_id, r.item_id, r.distance) for r in rows if r.doc_id not in (None, 202)) == want
        assert {r.item_id for r in rows if r.doc_id is None} == {2} and {r.item_id for r in rows if r.doc_id == 202} == {1}
        texts, tests = dict((i, d.normal(t)) for i, t in docs), dict((i, d.normal(t)) for i, t in items)
        for r in rows:
            assert distance(tests[r.item_id], texts[r.doc_id][r.start:r.end]) == r.distance
        kept = d.without_leaks(table, bench, block_chars=block)
        assert kept.columns == table.columns
        assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(str(i) for i, _ in docs if i is not None and i not in {r.doc_id for r in rows})


def test_empty_tables(spark):
    bench, docs = spark.createDataFrame([(1, "a long enough test item for all", "")], ITEMS), spark.createDataFrame([(1, "text", "")], DOCS)
    assert d.leaks(docs.limit(0), bench).count() == 0
    assert d.leaks(docs, bench.limit(0)).count() == 0
    assert d.without_leaks(docs, bench.limit(0)).count() == 1


def plain_standing(item, text, k):
    """The least distance of a part of the text between word boundaries."""
    cut = lambda at: at == 0 or at == len(text) or not (text[at - 1].isalnum() and text[at].isalnum())
    spans = [(a, b) for a in range(len(text)) for b in range(a + 1, min(len(text), a + len(item) + k) + 1) if cut(a) and cut(b) and abs(b - a - len(item)) <= k]
    return min((distance(item, text[a:b]) for a, b in spans), default=k + 1)


def test_short_items_stand_between_word_boundaries(spark):
    rng = random.Random(9)
    items = [(1, "What is  2+2?", "clash"), (2, "art", "clash"), (3, "art", "clash"), (4, " ", "clash"), (5, "What is 2+3?", "clash"),
             (6, "a man of the sea", "clash"), (7, "capital of the land?", "clash")]
    docs = [(1, "Asked: what is\n2+2? Four.", "clash"), (2, "a party, then ART", "clash"), (3, "party", "clash"), (4, "what is 2+2", "clash"), (5, "", "clash")]
    for n in range(6, 90):
        own = d.normal(rng.choice([i for i in items if i[1] != " "])[1])
        body = edited(own, rng.randint(0, min(3, len(own) // 2)), rng)
        docs.append((n, rng.choice(["", "so ", "so", "1, "]) + body + rng.choice(["", " on", "on", "."]), "clash"))
    bench, table = spark.createDataFrame(items, ITEMS), spark.createDataFrame(docs, DOCS)
    rows = d.leaks(table, bench).collect()
    tests, texts = {i: d.normal(t) for i, t, _ in items}, {i: d.normal(t) for i, t, _ in docs}
    want = [(i, j, plain_standing(t, x, int(len(t) * d.RATE))) for i, x in texts.items() for j, t in tests.items() if t and x]
    want = sorted(w for w in want if w[2] <= int(len(tests[w[1]]) * d.RATE))
    assert sorted((r.doc_id, r.item_id, r.distance) for r in rows) == want and any(w[2] for w in want)
    assert all(distance(tests[r.item_id], texts[r.doc_id][r.start:r.end]) == r.distance and d.bounded(texts[r.doc_id], r.start, r.end) for r in rows)
    assert sorted(r.doc_id for r in d.without_leaks(table, bench).collect()) == sorted(set(texts) - {w[0] for w in want})
