"""URL rules and scores against plain versions."""

import math

import pytest

from lecturespark.llm import url_filter as u

URLS = [None, "", "no scheme", "http://", "http://x.net", "http://x.net/", "HTTP://WWW.Example.NET/en/1?q=/fr/", "https://a.example.net/EN/1", "https://example.net/en",
        "https://badexample.net/en/1", "https://example.com/de/", "https://m.example.com/de/x#y", "https://example.com?x=/de/", "https://foo.org/fr/a", "https://foo.org/en/a",
        "https://É.org/fr/É", "a://b://c.net/d", "https://casino-bonus.example.com/x", "https://example.com/" + "long/" * 20_000, "https://u:p@h.net:80/x", "x\ny://z.net/a\nb?c"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    return rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path[:min([path.index(c) for c in "?#" if c in path] or [len(path)])]


def rule(host, path):
    fits = [(verdict, r) for verdict, r in u.RULES for on, _, below in [r.partition("/")]
            if (host == on or host.endswith("." + on)) and path.startswith("/" + below)]
    return max(fits, key=lambda f: len(f[1]), default=(None, None))


def test_rules_and_scores(spark):
    model = u.fit_url_model(u.labelled_urls(spark))
    pages = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(URLS)] + [(None, URLS[6], "clash")], "page_id long, url string, verdict string")
    judged = u.judge_urls(pages, model).withColumn("bins", u.url_bins(u.F.col("host"), u.F.col("path"))).collect()
    assert len(judged) == len(URLS) + 1
    for r in judged:
        host, path = parts(URLS[6] if r.page_id is None else URLS[r.page_id])
        verdict, name = rule(host, path)
        score = 1 / (1 + math.exp(-model.bias - sum(model.weights[b] for b in r.bins)))
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert r.unwanted_probability == pytest.approx(score)
        assert r.verdict == (verdict or ("block" if score >= u.BLOCK_FROM else "allow"))


def test_grams(spark):
    row = spark.range(1).select(u._gram_bins(u.F.lit("ab"), "host").alias("bins"), u._gram_bins(u.F.lit(""), "host").alias("none")).first()
    assert len(row.bins) == 2 + 1 and row.none == []  # ^ab ab$ ^ab$


def test_hosts_not_seen_in_training(spark):
    model = u.fit_url_model(u.labelled_urls(spark))
    bad, good = ["online-casino.example.com", "cheap-pills.example.com", "mega-bets.example.com"], ["city-library.example.com", "www.weather-notes.example.com"]
    pages = spark.createDataFrame([(f"https://{h}/es/5",) for h in bad + good], "url string")
    got = {r.host: r.verdict for r in u.judge_urls(pages, model, rules=()).collect()}
    assert got == {**dict.fromkeys(bad, "block"), **dict.fromkeys(good, "allow")}


def test_held_out_labels_and_threshold(spark):
    scores = u.held_out_scores(u.labelled_urls(spark))
    rows = [(r.unwanted, r.unwanted_probability) for r in scores.collect()]
    assert len(rows) == 4 * len(u.WANTED) + 4 * len(u.UNWANTED)
    cost = lambda t: sum(u.WRONGLY_BLOCKED if k == 0 else 0 for k, p in rows if p >= t) + sum(k for k, p in rows if p < t)
    cut = u.threshold_of(scores)
    assert cost(cut) == min(cost(p) for _, p in [*rows, (1, 2.0)])
    caught, blocked = (sum(k == kind and p >= cut for k, p in rows) for kind in (1, 0))
    print("held out: threshold", cut, "unwanted caught", caught, "wanted blocked", blocked, "of", len(rows))
    assert caught >= 0.8 * 4 * len(u.UNWANTED) and blocked <= 0.1 * 4 * len(u.WANTED)
    assert u.threshold_of(scores.filter("unwanted = 1")) == u.threshold_of(scores.limit(0)) == u.BLOCK_FROM


def test_labelled_table(spark):
    assert set(u.fit_url_model(u.labelled_urls(spark).limit(0)).weights) == {0.0}
    with pytest.raises(ValueError):
        u.fit_url_model(u.labelled_urls(spark), max_rows=10)
    one_kind = spark.createDataFrame([("https://a.example/b", 0), (None, 1), ("https://c", None)], "url string, unwanted int")
    empty = spark.createDataFrame([], "page_id long, url string")
    assert u.judge_urls(empty, u.fit_url_model(one_kind)).count() == 0
