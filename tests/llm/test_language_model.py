"""The language model: base score against plain counts, probabilities that sum to one, gain on unseen texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lecturespark.llm import language_model as m

from .plain import lower, words

DATA = "/root/testdata/sf0.001"


def tokens(text):
    return [*words(lower(text)), m.END]


def fitted(spark, texts, frequent=m.FREQUENT):
    docs = spark.createDataFrame([(t, "clash") for t in texts], "text string, word string")
    vocabulary = m.stored(m.count_words(docs))
    counts = m.summary(vocabulary, frequent)
    return vocabulary, counts, m.train(docs, counts)


def test_base_score_and_gain(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    unseen = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    counts = Counter(t for i, x in texts.items() if i not in unseen for t in tokens(x))
    total, distinct = sum(counts.values()), len(counts)
    rows = m.language_model_query(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens(texts[r.doc_id])
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in unseen, len(own), sum(counts[t] > 0 for t in own), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


@pytest.mark.parametrize("frequent", [m.FREQUENT, 1100, 40, 0])
def test_probabilities_sum_to_one(spark, frequent):
    texts = [" ".join(f"w{(i * j) % 1500}" for j in range(300)) for i in range(1, 40)]
    vocabulary, counts, weights = fitted(spark, texts, frequent)
    known = [r.word for r in vocabulary.collect() if r.word]
    # One next word after the same two: all known ones, the end, and the one event of an unseen word.
    ways = [*[f"w1 w2 {w}" for w in known], "w1 w2 unseen", "w1 w2"]
    docs = spark.createDataFrame(list(enumerate(ways)), "doc_id long, text string")
    scores = {r.doc_id: r for r in m.score_texts(docs, vocabulary, counts, weights).collect()}
    model = m.Model(counts, weights)
    last = {}
    for i, text in enumerate(ways):
        parts = text.split()
        # The end after three words is scored by the model again, so take it off.
        (_, leaf, features), _ = model.tokens(pa.array([text]))
        last[i] = scores[i].score
        if len(parts) == 3:
            last[i] -= end_score(model, counts, vocabulary, leaf[-1:], features[:, -1:])
    start = last[len(ways) - 1] - end_score(model, counts, vocabulary, *[x[..., -1:] for x in model.tokens(pa.array(["w1 w2"]))[0][1:]])
    assert sum(10 ** (s - start) for s in last.values()) == pytest.approx(1, abs=1e-3)


def end_score(model, counts, vocabulary, leaf, features):
    score = model.log10(leaf, features)[0] + math.log10(1 - counts.unseen())
    if leaf[0] >= len(counts.words):
        c = vocabulary.filter("word = ''").first().c
        score += math.log10((c - m.DISCOUNT) / counts.buckets[counts.bucket_of(np.array([m.END_HASH]))[0]])
    return score


def plain_score(model, vocabulary, text):
    """The score of a whole text, one token and one node at a time."""
    counts, tree, c_of = model.counts, model.tree, {r.word: r.c for r in vocabulary.collect()}
    place = {w: i for i, w in enumerate(counts.words.to_pylist())}
    (_, leaves, features), _ = model.tokens(pa.array([text]))
    total = 0.0
    for at, word in enumerate(tokens(text)):
        if word not in c_of:
            total += math.log10(counts.unseen())
            continue
        total += math.log10(1 - counts.unseen())
        leaf = place.get(word)
        if leaf is None:
            own = m.END_HASH if word == m.END else m.word_hashes(pa.array([word]))[0]
            bucket = int(own) >> (65 - len(counts.buckets).bit_length()) if len(counts.buckets) > 1 else 0
            leaf = len(counts.words) + sum(mass > 0 for mass in counts.buckets[:bucket])
            total += math.log10((c_of[word] - m.DISCOUNT) / counts.buckets[bucket])
        assert leaf == leaves[at]
        for level, (nodes, branches) in enumerate(zip(tree.nodes, tree.branches)):
            if (node := int(nodes[leaf])) < 0:
                break
            table = min(level, m.TABLES - 1)
            odds = tree.bias[node].astype(float)
            for feature in features[:m.USED[table], at]:
                row = ((int(feature) ^ int(model.salts[node])) * 0x9E3779B1 % 2**32) >> int(model.shift)
                odds = odds + model.weights[table][row]
            total += (odds[branches[leaf]] - math.log(sum(math.exp(x) for x in odds))) / math.log(10)
    return total


@pytest.mark.parametrize("frequent", [m.FREQUENT, 300])
def test_scores_equal_plain_ones(spark, frequent):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    vocabulary, counts, weights = fitted(spark, [x for i, x in texts.items() if i % 5], frequent)
    assert weights.rows.any(axis=(1, 2)).all() and (len(counts.buckets) > 0) == (frequent == 300)
    docs = spark.createDataFrame([(i, x) for i, x in texts.items() if i % 25 == 0], "doc_id long, text string")
    model = m.Model(counts, weights)
    for r in m.score_texts(docs, vocabulary, counts, weights).collect():
        assert r.score == pytest.approx(plain_score(model, vocabulary, texts[r.doc_id]), rel=1e-4)


def test_context_is_learned(spark):
    vocabulary, counts, weights = fitted(spark, ["a b " * 400, "c d " * 400] * 4)
    docs = spark.createDataFrame([(1, "a b a b a b"), (2, "a d a d a d")], "doc_id long, text string")
    got = {r.doc_id: r.score - r.base_score for r in m.score_texts(docs, vocabulary, counts, weights).collect()}
    assert got[1] > got[2]


def test_odd_texts(spark):
    vocabulary, counts, weights = fitted(spark, ["one two three", None, "", "two"])
    rows = [(None, "one"), (1, None), (2, ""), (3, "ONE one"), (3, "ONE one"), (4, "new " * 30_000)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, score string, row string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known) for r in m.score_texts(docs, vocabulary, counts, weights).collect()))
    assert got == [(False, 1, 1, 1), (False, 2, 1, 1), (False, 3, 3, 3), (False, 3, 3, 3), (False, 4, 30_001, 1), (True, 0, 2, 2)]
    assert m.score_texts(docs.limit(0), vocabulary, counts, weights).count() == 0


def test_without_training_rows(spark):
    vocabulary, counts, weights = fitted(spark, [])
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    row = m.score_texts(docs, vocabulary, counts, weights).first()
    assert (row.n_tokens, row.n_known, row.base_score) == (3, 0, 0.0) and row.score == pytest.approx(0, abs=1e-6)


def test_updates_follow_the_gradient():
    counts = m.Counts.of(100, 40, [f"w{i}" for i in range(40)], np.arange(40, 0, -1))
    model = m.Model(counts)
    (_, leaf, features), _ = model.tokens(pa.array(["w1 w2 w1 w39 w35 other"]))
    before = model.log10(leaf, features).sum()
    for _ in range(20):
        model.update(leaf, features)
    assert model.log10(leaf, features).sum() > before


def test_rare_words_learn_their_context(spark):
    # 3000 words of equal count, so two thirds have no slot; each is followed by its own next word.
    rng = np.random.default_rng(4)
    starts = np.concatenate([rng.permutation(3000) for _ in range(30)])
    vocabulary, counts, weights = fitted(spark, [" ".join(f"a{i} b{i}" for i in part) for part in np.array_split(starts, 60)], 900)
    assert len(counts.words) < 1000 and counts.others()[1] > 5000
    rare = [i for i in range(3000) if not {f"a{i}", f"b{i}"} & set(counts.words.to_pylist())][:400]
    docs = spark.createDataFrame([(0, " ".join(f"a{i} b{i}" for i in rare)), (1, " ".join(f"a{i} b{j}" for i, j in zip(rare, rare[1:] + rare[:1])))], "doc_id long, text string")
    right, wrong = (r.score for r in sorted(m.score_texts(docs, vocabulary, counts, weights).collect()))
    assert right - wrong > 0.3 * len(rare)


def test_rows_and_buckets_follow_the_vocabulary(spark):
    sizes = []
    for n in (50, 1200, 40_000):
        _, counts, _ = fitted(spark, [" ".join(f"w{i}" for i in range(n))], 100)
        sizes.append(len(counts.buckets))
        assert counts.buckets.sum() == pytest.approx(counts.others()[0] - m.DISCOUNT * counts.others()[1])
    assert sizes == [0, 2048, 65536] and m.Counts.of(1, 1 << 22, [], np.array([])).rows() > m.Counts.of(1, 1000, [], np.array([])).rows()


@pytest.mark.parametrize("size", [0, 1, 2, 32, 33, 500, 5000])
def test_tree_is_the_shallowest(size):
    masses = np.floor(1e6 / np.arange(1, size + 1)) + 0.5
    tree = m.Tree.of(np.random.default_rng(size).permutation(masses) if size else masses)
    masses = np.random.default_rng(size).permutation(masses) if size else masses
    depth = (tree.nodes >= 0).sum(axis=0) if tree.nodes.size else np.zeros(size)
    heap = [0.0] * (-(size - 1) % (m.WAYS - 1) if size else 0) + sorted(masses)
    best = 0.0
    while len(heap) > 1:  # the classic way: join the lightest, add up what is joined
        heap.sort()
        joined = sum(heap[:m.WAYS])
        best += joined
        heap = [*heap[m.WAYS:], joined]
    assert (depth * masses).sum() == pytest.approx(best)
    # The chances of all leaves without context are their shares.
    chance = np.zeros(size)
    for nodes, branches in zip(tree.nodes, tree.branches):
        chance += np.where(nodes >= 0, tree.bias[nodes, branches], 0)
    assert np.allclose(np.exp(chance), masses / max(masses.sum(), 1), rtol=1e-3)
    assert len(set(map(tuple, np.concatenate([tree.nodes, tree.branches]).T.tolist()))) == (size if size > 1 else min(size, 1))


def test_steps_are_those_of_plain_sums():
    counts = m.Counts.of(100, 1 << 20, [f"w{i}" for i in range(40)], np.arange(40, 0, -1))
    model, rng = m.Model(counts), np.random.default_rng(3)
    # Some rows with hundreds of slopes, most with one.
    rows = np.concatenate([rng.integers(0, 60, (3, 4000)), rng.integers(0, counts.rows(), (3, 4000))], axis=1)
    slopes = rng.normal(size=(8000, m.WAYS)).astype(np.float32)
    model._descend(1, rows, slopes)
    sums = np.zeros((counts.rows(), m.WAYS))
    np.add.at(sums, rows.reshape(-1), np.concatenate([slopes] * 3).astype(float))
    steps = m.RATE * sums / np.sqrt(1e-6 + (sums ** 2).sum(axis=1, keepdims=True))
    assert np.allclose(model.weights[1], -steps, atol=1e-5)
    assert (model.seen[1] == np.bincount(rows.reshape(-1), minlength=counts.rows())).all()


def test_rounds_start_from_the_last_average(spark):
    texts = [f"x{i % 7} y{i % 7} " * 30 + f"tail{i}" for i in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = m.summary(m.stored(m.count_words(docs)))
    shares = [m.train(docs, counts, rounds=n) for n in (1, 3)]
    leaf, features = m.Model(counts).tokens(pa.array(texts))[0][1:]
    plain, *gains = [m.Model(counts, w).log10(leaf, features).sum() for w in (None, *shares)]
    assert min(gains) > plain and all(np.isfinite(w.rows).all() and (w.squares > 0).all() for w in shares)
