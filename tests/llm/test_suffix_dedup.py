"""Suffix dedup against all windows."""

import hashlib
import random

import numpy as np
import pytest

from lecturespark.llm import suffix_dedup as s

from .plain import repeat_spans


def corpus(rng):
    text = lambda size: "".join(rng.choice("abcdefghij é\n") for _ in range(size))
    passages = [text(rng.choice([150, 199, 200, 201, 260, 900])) for _ in range(8)]
    rows = [text(rng.randint(0, 300)) + "".join(rng.choice([rng.choice(passages), text(rng.randint(1, 150))]) for _ in range(rng.randint(0, 4))) for _ in range(50)]
    rows += [rows[3], rows[3], "x" * 450, "ab" * 300, "y" * 199, "y" * 199, "z" * 200, "z" * 200, None, "", passages[5][:200], passages[4] * 40, "é" * 101]
    return rows


@pytest.mark.parametrize("large", [s.LARGE, 2])
def test_against_all_windows(spark, large):
    texts = corpus(random.Random(8))
    docs = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, digest string").repartition(4)
    want = []
    for i, (t, spans) in enumerate(zip(texts, repeat_spans(texts))):
        data = (t or "").encode()
        kept = b"".join(data[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[x for x, _ in spans], len(data)]))
        want.append((i if i else None, len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in s.remove_repeats(docs, large=large).drop("starts", "ends", "kept").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mergesort_and_extensions():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    strings += strings[:20]
    offsets = np.array([rng.randrange(len(x)) for x in strings])
    groups = np.sort(np.array([rng.randrange(12) for _ in strings]))
    bucket = s.Bucket(strings, offsets, groups)
    order = bucket.sorted()
    suffix = [strings[i][offsets[i]:] for i in range(len(strings))]
    assert [(groups[i], suffix[i]) for i in order] == sorted((groups[i], suffix[i]) for i in range(len(strings)))
    common = bucket.extension(order[:-1], order[1:])
    for i, j, n in zip(order[:-1], order[1:], common):
        a, b = suffix[i], suffix[j]
        assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_way_out_of_a_hash_collision(monkeypatch):
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"abc") for _ in range(30)) for _ in range(6)]
    strings = [strings[i % 6][:20] + bytes(rng.choice(b"abc") for _ in range(10)) for i in range(18)]
    offsets, groups, many = np.full(18, 5), np.zeros(18, np.int64), np.zeros(18, bool)
    right = s.Bucket(strings, offsets, groups).repeated(12, many)
    assert right.any()
    # With a hash that is always 0 every suffix looks equal; the bytes must tell.
    monkeypatch.setattr(s.Prefixes, "part", lambda self, start, end: np.zeros(len(start), np.uint64))
    assert (s.Bucket(strings, offsets, groups).repeated(12, many) == right).all()


def test_equal_suffixes_without_a_common_window():
    # The right sides agree over the whole window, what stands left of the anchors never does.
    strings = [bytes([97 + i]) * 6 + b"z" * 9 for i in range(4)]
    bucket = s.Bucket(strings, np.full(4, 6), np.zeros(4, np.int64))
    assert not bucket.repeated(12, np.zeros(4, bool)).any()


def test_long_text_in_chunks(monkeypatch):
    rng = random.Random(5)
    data = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = s.text_anchors(data, 200, 40)
    monkeypatch.setattr(s, "CHUNK", 700)
    parts = s.text_anchors(data, 200, 40)
    windows = lambda found: [(p, h) for h, p, a, b in zip(*found) for _ in range(a, b + 1)]
    assert windows(whole) == windows(parts) and len(windows(whole)) == len(data) - 199
