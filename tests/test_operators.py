"""Small literal inputs for the rules of the operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lecturespark.functions import codes, digests, urls
from lecturespark.functions.model_json import json_value, shape_of, strip, unfence
from lecturespark.functions.text import clean_text, clock
from lecturespark.operators import (align, enrich, grids, grounding, integrity, intervals, jobs, messages, policy,
                                    redirects, segments, slides)
from lecturespark.plans import q_catalog, registry  # noqa: F401
from lecturespark.sources import catalog
from lecturespark.sources import files as file_source
from lecturespark.sources import jobs as job_records
from lecturespark.sources import snapshots


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, schema, rows, *columns):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


def test_clean_text_is_split_and_join(spark):
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["\u200b", "\ufeff", "x"]
    texts = [f"{b}a{b}{b}b c{b}" for b in blanks] + [None, ""]
    assert one(spark, "t STRING", texts, clean_text("t")) == [" ".join((t or "").split()) for t in texts]
    assert one(spark, "t STRING", texts, strip(F.coalesce("t", F.lit("")))) == [(t or "").strip() for t in texts]


def test_clock(spark):
    got = one(spark, "ms BIGINT", [-5, 0, 999, 3_599_999, 360_000_000, 3_600_000_000_001], clock("ms", ","))
    assert got == ["00:00:00,000", "00:00:00,000", "00:00:00,999", "00:59:59,999", "100:00:00,000", "1000000:00:00,001"]


@pytest.mark.parametrize("text, shape", [
    ("[1]", "array"), ("```json\n{}\n```", "object"), ("```\n[1]\n``` done", "array"), ("```[]```", "invalid"),
    ("[1] tail", "invalid"), ("[1]]", "invalid"), ("1,2", "invalid"), ("", "invalid"), (None, "invalid"), ("  {}  ", "object"),
    ("```json\n[2]", "array"), ("[1", "invalid")])
def test_model_json(spark, text, shape):
    assert one(spark, "t STRING", [text], shape_of(json_value(unfence("t")))) == [shape]


def test_corrections_fill_in_order(spark):
    a = spark.createDataFrame([(1, i, 0 if i == 0 else i * 1000, 0, f"a{i}") for i in range(25)],
                              "lecture_id INT, ord INT, start_ms BIGINT, end_ms BIGINT, text STRING")
    b = spark.createDataFrame([(1, i, i * 1000 + 7, i * 1000 + 500, "" if i == 21 else f"b{i}") for i in range(24)],
                              "lecture_id INT, ord INT, start_ms BIGINT, end_ms BIGINT, text STRING")
    pairs = align.align_recognisers(a, b)
    assert pairs.where("idx = 0").first()["start_ms"] == 7 and pairs.count() == 25
    packed = align.pack_requests(pairs).orderBy("window_id").collect()
    assert [r["items"] for r in packed] == [20, 5]
    assert [i["index"] for i in json.loads(packed[1]["request"])] == [20, 21, 22, 23, 24]
    fixes = spark.createDataFrame(
        [(1, 1, '[{"index":20,"text":"x"},{"index":20,"text":"y"},{"index":22,"text":""},{"index":3,"text":"wrong window"}]')],
        "lecture_id INT, window_id BIGINT, response STRING")
    done = align.apply_corrections(pairs, align.parse_corrections(fixes)).where("ord >= 20 OR ord = 3").orderBy("ord")
    assert [r["text"] for r in done.collect()] == ["b3", "y", "a21", "b22", "b23", "a24"]


def test_only_open_windows_are_left(spark):
    todo = spark.createDataFrame([(1, w, "standard") for w in (0, 1)], "job INT, window_id INT, mode STRING")
    done = spark.createDataFrame([(1, 0)], "job INT, window_id INT")
    for mode, status in (("standard", "todo"), ("fast", "checkpoint_mode_mismatch")):
        saved = spark.createDataFrame([(1, mode)], "job INT, checkpoint_mode STRING")
        assert values(jobs.resume_windows(todo, done, saved, ["job"]).select("window_id", "status")) == [(1, status)]


def test_slides_meet_windows_at_both_ends(spark):
    windows = spark.createDataFrame([(1, 0, 0, 10_000), (1, 1, 10_000, 20_000), (1, 2, 40_000, 30_000), (2, 0, 0, 10**12)],
                                    "lecture_id INT, window_id INT, lower_ms BIGINT, upper_ms BIGINT")
    pages = spark.createDataFrame([(1, i, s) for i, s in enumerate((0, 10, 20, 21, None, 35))] + [(2, 9, 10**8)],
                                  "lecture_id INT, ord INT, created_sec BIGINT")
    got = values(slides.slides_to_windows(pages, windows).select("lecture_id", "ord", "window_id"))
    assert got == [(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 2, 1), (1, 4, 0), (2, 9, 0)]


def test_interval_join_is_brute_force(spark):
    rng = random.Random(1)
    points = [(0 if rng.random() < 0.8 else 1, i, rng.randint(-10**6, 10**6)) for i in range(400)]
    ranges = [(0 if rng.random() < 0.8 else 1, i, low, low + rng.choice([0, 5, 20_000, 10**6, -1]))
              for i in range(80) for low in [rng.randint(-10**6, 10**6)]]
    p = spark.createDataFrame(points, "k INT, p INT, at BIGINT")
    r = spark.createDataFrame(ranges, "k INT, r INT, low BIGINT, high BIGINT")
    got = values(intervals.join_points_to_intervals(p, r, ["k"], "at", "low", "high").select("p", "r"))
    want = sorted(((a[1], b[1]) for a in points for b in ranges if a[0] == b[0] and b[2] <= a[2] <= b[3]), key=str)
    assert got == want and len(want) > 500


def test_equal_slides_make_one_page(spark):
    pages = spark.createDataFrame([(1, 0, "aa"), (1, 1, "aa"), (1, 2, ""), (1, 3, None), (2, 4, "aa")], "lecture_id INT, ord INT, dhash STRING")
    assert values(slides.dedup_slides(pages).select("lecture_id", "ord")) == [(1, 0), (2, 4)]


def test_fingerprint_of_grids(spark):
    rng = random.Random(2)
    grids_ = [[rng.randint(0, 255) for _ in range(72)] for _ in range(50)] + [list(range(9)) * 8, [5] * 72]

    def fold(g):
        bits = "".join("1" if g[r * 9 + c + 1] > g[r * 9 + c] else "0" for r in range(8) for c in range(8))
        return f"{int(bits, 2):016x}"

    df = spark.createDataFrame([(g,) for g in grids_], "g ARRAY<INT>")
    assert [r[0] for r in df.select(slides.dhash_bits(F.col("g"))).collect()] == [fold(g) for g in grids_]


def test_answers_need_evidence(spark):
    evidence = spark.createDataFrame([(1, "real", "t"), (1, "blank", ""), (2, "other", "t")], "query_id INT, citation_id STRING, text STRING")
    answers = spark.createDataFrame(
        [(1, 1, " yes ", True, ["real", "fake", "real"]), (2, 1, "no", True, ["fake", "blank", "other"]),
         (3, 1, "unsure", False, ["real"]), (4, 3, "none", True, ["real"]), (5, 1, "many", True, ["real"] * 12)],
        "answer_id INT, query_id INT, answer STRING, grounded BOOLEAN, citations ARRAY<STRING>")
    got = {r["answer_id"]: r for r in grounding.ground_citations(answers, evidence).collect()}
    assert got[1]["answer"] == "yes" and got[1]["citations"] == ["real", "real"] and got[1]["grounded"]
    for refused in (2, 3, 4):
        assert got[refused]["answer"] == grounding.REFUSAL and got[refused]["citations"] == [] and not got[refused]["grounded"]
    assert len(got[5]["citations"]) == 12
    short = grounding.ground_citations(answers, evidence, limit=8).where("answer_id = 5").first()
    assert len(short["citations"]) == 8


def test_month_grid_and_catalogue(spark):
    anchor = spark.sql("SELECT DATE'2024-01-31' AS anchor")
    months = [r["month"] for r in catalog.month_grid(anchor).orderBy("month").collect()]
    assert months[0] == "2023-01" and months[-1] == "2024-02" and len(months) == 14
    detail = spark.createDataFrame([(1, '{"sub_list":{"2024":{"5":{"3":[{"id":"0","duration":"x","playback_status":1},{"id":0},7]}}}}'),
                                    (2, "{}"), (3, "no"), (4, None), (5, '{"sub_list":[1]}'),
                                    (6, '{"sub_list":{"2024":{"5":{"3":"day","4":[{"id":"k"}]},"6":[7]},"2025":"x","y":{"1":{"2":[{"id":"z"}]}}}}')],
                                   "course_id INT, detail STRING")
    flat = catalog.flatten_catalog(detail)
    assert values(flat.where("problem IS NULL").select("course_id", "sub_id", "date", "has_playback", "duration_seconds")) == [
        (1, "0", "2024-05-03", True, 0), (6, "k", "2024-05-04", False, 0)]
    assert values(flat.where("problem IS NOT NULL").select("course_id", "problem", "sub_id")) == [
        (3, "not_json", None), (5, "bad_years", None), (6, "bad_date", "z"), (6, "bad_days", None), (6, "bad_items", None), (6, "bad_months", None)]


def test_chunks_and_windows(spark):
    recordings = spark.createDataFrame([(1, 0.0, 1250.0), (2, 5.0, 600.5), (3, 0.0, 0.0), (4, -1.0, 60.0), (5, None, 43200.0),
                                        (6, 0.0, 43201.0), (7, 0.0, 0.2)], "r INT, start_seconds DOUBLE, duration_seconds DOUBLE")
    got = grids.chunk_grid(recordings, ["r"])
    assert values(got.where("r < 3").select("r", "offset_seconds", "duration_seconds")) == [
        (1, 0.0, 600.0), (1, 1200.0, 50.0), (1, 600.0, 600.0), (2, 5.0, 600.0), (2, 605.0, 0.5)]
    assert values(got.where("r > 2").groupBy("r", "recording_error").count()) == [
        (3, "invalid_duration", 1), (4, "invalid_start", 1), (5, None, 72), (6, "invalid_duration", 1), (7, None, 1)]
    chunks = spark.createDataFrame([(1, 0.0, 480_000 + 7999), (2, 600.0, 480_000 + 8000), (3, 0.0, 0)], "c INT, offset_seconds DOUBLE, samples BIGINT")
    assert values(grids.window_grid(chunks, ["c"])) == [
        (1, 0, 0, 30_000, False), (1, 1, 30_000, 30_499, True), (2, 0, 600_000, 630_000, False), (2, 1, 630_000, 630_500, False)]


def test_responses(spark):
    rows = [(200, "video/mp4", b"\x00\x00\x00\x18ftypisom"), (200, "text/html; a=b", b" \n<!DOCTYPE HTML>"),
            (403, "application/json", b'{"e":1}'), (0, None, None), (206, "Application/LD+JSON", b"[")]
    got = one(spark, "s INT, c STRING, p BINARY", rows, codes.response_http("s"), codes.response_content("c"), codes.response_magic("p"))
    assert got == [("http_2xx", "content_video", "magic_iso_bmff"), ("http_2xx", "content_html", "magic_html"),
                   ("http_403", "content_json", "magic_json"), ("http_other", "content_missing", "magic_unknown"),
                   ("http_2xx", "content_json", "magic_json")]
    verdict = codes.response_verdict(codes.response_http("s"), codes.response_content("c"), codes.response_magic("p"))
    assert one(spark, "s INT, c STRING, p BINARY", rows, verdict) == [
        None, "media_content_html", "media_http_403", "media_http_status_rejected", "media_content_json"]


def test_errors_never_echo(spark):
    rows = [("asr", "media start is invalid"), ("asr", "secret"), ("source", "source request failed: secret"), ("source", "secret"),
            ("platform", "platform_auth_failed"), ("platform", "secret"), ("other", "secret")]
    got = one(spark, "f STRING, m STRING", rows, codes.error_code("f", "m"))
    assert got == ["invalid_start", "asr_error", "connection_failed", "source_security_error", "platform_auth_failed",
                   "platform_session_failed", ""]


def test_headers(spark):
    df = spark.createDataFrame([({"COOKIE": "a", "Host": "x\n", "Range": "r", "user-agent": "u"},), ({"cookie": "a\r\nb"},), ({},)],
                               "h MAP<STRING, STRING>")
    twice = spark.sql("SELECT map('Cookie', 'a', 'cookie', 'b', 'Host', 'x', 'HOST ', 'y') AS h").select(urls.safe_headers("h")).first()[0]
    assert twice == {"Cookie": "b"}
    assert [r[0] for r in df.select(urls.safe_headers("h")).collect()] == [{"Cookie": "a", "User-Agent": "u"}, None, {}]


def test_urls(spark):
    cases = {"https://h/x": "ok", "https://h:443/": "ok", "https://h:/": "ok", "https://@h/": "ok", "http://h/": "invalid_https_url",
             "https://u@h/": "invalid_https_url", "https://:p@h/": "invalid_https_url", "https:///x": "invalid_https_url",
             "https://h:80/": "invalid_https_port", "https://[::1]:443/": "ok", "https://[::1]:8/": "invalid_https_port",
             " https://h/ ": "ok", "": "invalid_https_url", "h/x": "invalid_https_url"}
    assert one(spark, "u STRING", list(cases), urls.url_reason("u")) == list(cases.values())


def test_addresses(spark):
    cases = {"127.0.0.1": "non_public", "10.0.0.1": "non_public", "93.184.216.34": "public", "not-an-ip": "unreadable",
             "100.64.0.1": "non_public", "100.128.0.1": "public", "192.0.0.9": "public", "192.0.0.8": "non_public",
             "255.255.255.255": "non_public", "224.0.0.1": "public", "1.2.3": "unreadable", "1.2.3.256": "unreadable",
             "01.2.3.4": "unreadable", "::1": "non_public", "::": "non_public", "fd00::5": "non_public", "FE80::1": "non_public",
             "::ffff:10.0.0.1": "non_public", "::ffff:8.8.8.8": "public", "::ffff:a00:1": "non_public", "2606:4700::1": "public",
             "2606:4700:0:0:0:0:0:1": "public", "2001:db8::1": "non_public", "2001:4:112::1": "public", "2002::1": "non_public",
             "1::2::3": "unreadable", "1:2:3:4:5:6:7": "unreadable", "1:2:3:4:5:6:7:8": "public", "1:2:3:4:5:6:7::8": "unreadable", ":1::2": "unreadable",
             "::12345": "unreadable", "fe80::1%eth0": "unreadable", "64:ff9b:1::8.8.8.8": "non_public", "::1.2.3.256": "unreadable", "": "unreadable"}
    assert one(spark, "ip STRING", list(cases), policy.address_status("ip")) == list(cases.values())
    rows = [(1, 0, "2606:4700::1"), (1, 1, "8.8.8.8"), (2, 0, "8.8.8.8"), (2, 1, "10.0.0.1"), (3, 0, "8.8.8.8"), (3, 1, "::1"),
            (4, 0, "8.8.8.8"), (4, 1, "junk"), (5, 0, "8.8.8.8"), (5, 1, None), (6, 0, "2606:4700::1")]
    df = spark.createDataFrame(rows, "h INT, ord INT, ip STRING")
    refused = "non_public_address"
    assert values(policy.host_addresses(df, ["h"])) == [(1, "ok", "8.8.8.8"), (2, refused, None), (3, refused, None), (4, refused, None),
                                                        (5, refused, None), (6, "ok", "2606:4700::1")]


def test_month_documents_are_parsed_once(spark):
    course = '{"course":[{"id":"a","title":"T"}]}'
    docs = [(1, f'{{"code":0,"list":[{course},{course}]}}'), (2, f'{{"code":500,"list":[{course}]}}'), (3, "garbage"), (4, None),
            (5, f'{{"code":200,"list":[{",".join([course] * 32)}]}}'), (6, '{"code":0,"list":[{"course":[' + ",".join(['{"id":1}'] * 1001) + "]}]}"),
            (7, '{"code":200,"list":"x"}'), (8, '{"code":0,"list":[{"course":[{"course_id":" b "}]}]}')]
    rows = catalog.flatten_schedule(spark.createDataFrame(docs, "m INT, doc STRING"), ["m"])
    accepted = rows.where("month_status = 'ok'").select("m", "pos", "course_id")
    # A filter on the verdict that is moved below the reading parses each document again at every place that names it.
    assert accepted._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert values(accepted) == [(1, 0, "a"), (1, 1, "a"), (8, 0, "b")]
    assert values(rows.groupBy("m", "month_status").count()) == [
        (1, "ok", 2), (2, "bad_code", 1), (5, "too_many_days", 32), (6, "too_many_rows", 1001), (8, "ok", 1)]


def test_schedule_documents_are_dealt_out(spark, tmp_path):
    # One small file, whose documents are much larger: its rows must not all be one task.
    customers = spark.range(400).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "CAST(id % 25 AS INT) AS c_nationkey", "'M' AS c_mktsegment")
    customers.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    docs = registry.load(spark, str(tmp_path), "schedule_json")
    sizes = docs.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 4 and max(n for _, n in sizes) <= 200
    assert sorted(r.month_id for r in docs.select("month_id").collect()) == list(range(400))


def test_address_expression_stays_small(spark):
    # Each step of the reading is named many times; written out at each place, the plan takes the driver's memory.
    assert len(str(policy.address_status("ip"))) < 20_000
    cases = {"1:2:3:4:5:6:7.8.9.10": "public", "::ffff:8.8.8.8": "public", "2A00::10.0.0.1": "public", "::ffff:8.8.8.256": "unreadable",
             "1:2:3:4:5:6:7:8:9": "unreadable", "": "unreadable", "8.8.8.256": "unreadable", "100::1": "non_public", None: "unreadable"}
    assert one(spark, "ip STRING", list(cases), policy.address_status("ip")) == list(cases.values())


def test_manifest_diff_with_nulls(spark):
    schema = "k INT, path STRING, size BIGINT, sha256 STRING"
    listed = spark.createDataFrame([(1, "a", None, "x"), (1, "b", 3, None), (1, "c", None, None), (1, "d", 1, "x"), (1, "e", 1, "x")], schema)
    there = spark.createDataFrame([(1, "a", 9, "x"), (1, "b", 3, "y"), (1, "c", None, None), (1, "d", 1, "x"), (1, "f", None, None)], schema)
    assert values(integrity.manifest_diff(listed, there, ["k"])) == [
        (1, "a", "digest_mismatch"), (1, "b", "digest_mismatch"), (1, "c", "ok"), (1, "d", "ok"), (1, "e", "missing"), (1, "f", "unknown")]


def test_redirects(spark):
    hop = "url STRING, ord INT, status INT, location STRING"
    chain = [(f"https://a/{i}", i, 302, f"/{i + 1}") for i in range(10)] + [
        ("https://a/10", 10, 200, None), ("https://b/x", 0, 302, "https://c/y/z"), ("https://c/y/z", 0, 307, "w"),
        ("https://c/y/w", 0, 200, None), ("https://d/", 0, 301, "http://d/"), ("https://e/", 0, 302, "")]
    starts = spark.createDataFrame([(u,) for u in ("https://a/0", "https://a/5", "https://b/x", "https://d/", "https://e/", "https://f/", "ftp://g")],
                                   "url STRING").withColumn("s", F.col("url"))
    got = {r["s"]: tuple(r)[1:] for r in redirects.resolve_redirects(starts, spark.createDataFrame(chain, hop), ["s"]).collect()}
    assert got["https://a/0"] == ("https://a/6", True, 6, "redirect_limit")
    assert got["https://a/5"] == ("https://a/10", True, 5, "ok")
    assert got["https://b/x"] == ("https://c/y/w", False, 2, "ok")
    assert got["https://d/"][3] == "invalid_https_url" and got["https://e/"][3] == "redirect_without_location"
    assert got["https://f/"][3] == "connection_failed" and got["ftp://g"][3] == "invalid_https_url"


def test_renewed_urls(spark):
    rows = [(1, 0, "https://h/m?t=1"), (1, 1, "HTTPS://H/m?t=2"), (1, 2, "https://other/m"), (1, 3, "https://h/m"), (1, 4, "https://h/n")]
    df = spark.createDataFrame(rows, "s INT, seq INT, url STRING")
    got = redirects.same_media_identity(df, ["s"]).orderBy("seq").select("accepted").collect()
    assert [r[0] for r in got] == [True, True, False, True, False]


def test_parts_go_there_and_back(spark):
    texts = [(i, "é" * n) for i, n in enumerate((0, 1, 700, 5000))]
    parts = messages.split_parts(spark.createDataFrame(texts, "task_id INT, payload STRING"), ["task_id"], size=1024)
    sent = parts.select("task_id", F.col("part").alias("ord"),
                        F.concat(F.lit("part "), "part", F.lit("/"), "total", F.lit("\n"), "piece").alias("body"))
    extra = spark.createDataFrame([(3, 0, "part 2/14\nAAAA"), (3, 0, "hello"), (2, 99, "part 1/9\nAAAA"), (9, 0, "part 0/0\nAAAA")],
                                  "task_id INT, ord BIGINT, body STRING")
    every = sent.union(extra).repartition(5)
    got = {r["task_id"]: r["status"] for r in messages.reassemble_parts(every, ["task_id"]).collect()}
    assert got == {1: "complete", 2: "part_count_mismatch", 3: "complete", 9: "incomplete"}
    import base64
    whole = {r["task_id"]: r["payload"] for r in messages.join_parts(messages.complete_parts(every, ["task_id"]), ["task_id"]).collect()}
    assert {k: base64.b64decode(v).decode() for k, v in whole.items()} == {1: "é", 3: "é" * 5000}
    with pytest.raises(ValueError):
        messages.split_parts(sent, ["task_id"], "body", size=100)


def test_pieces_of_complete_tasks(spark):
    df = spark.createDataFrame([(1, 1, "part 1/2\nAAAA"), (1, 2, "part 2/2\nBBBB"), (2, 1, "part 1/2\nAAAA")], "task_id INT, ord INT, body STRING")
    assert values(messages.complete_parts(df, ["task_id"])) == [(1, 1, "AAAA"), (1, 2, "BBBB")]


def test_strict_base64(spark):
    cases = {"YQ==": b"a", "YWI=": b"ab", "": b"", "YQ": None, "YQ==\n": None, "Y Q=": None, "*": None, "YQ==YQ==": None}
    got = one(spark, "t STRING", list(cases), digests.strict_base64("t"))
    assert [None if g is None else bytes(g) for g in got] == list(cases.values())


def test_jobs_credentials_and_results(spark, tmp_path):
    text = json.dumps({"schema": "job.v2", "task_id": "a", "payload": {"title": "t"}, "secrets": {"source_credentials": {"account": "x"}}})
    read = job_records.read_jobs(spark.createDataFrame([(text,)], "job STRING"))
    assert "secrets" not in read.columns and read.first()["payload"]["title"] == "t"
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("h1", 2, "b"), ("h1", 1, "a"), ("h2", 1, "c")], "input_hash STRING, n INT, v STRING")
    for _ in range(2):
        job_records.write_results(rows, path, "n")
    assert values(job_records.read_results(spark, path).select("input_hash", "v")) == [("h1", "a"), ("h2", "c")]


def test_the_model_is_loaded_per_partition_and_failures_keep_rows(spark):
    def make():
        loaded = {"calls": 0}

        def model(request):
            loaded["calls"] += 1
            if request == "bad":
                raise ValueError("secret")
            return f"{request} {loaded['calls']}"

        return model

    requests = spark.createDataFrame([("a",), ("bad",), ("c",)], "request STRING").coalesce(1)
    got = {r: (a, e) for r, a, e in values(enrich.enrich_windows(requests, make))}
    assert got["bad"] == (None, "ValueError")
    # One loaded model has answered all three, in any order.
    assert sorted([int(got["a"][0][2:]), int(got["c"][0][2:])]) in ([1, 2], [1, 3], [2, 3]) and got["a"][0][:2] == "a " and got["c"][0][:2] == "c "


def test_files_and_links(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("x")
    (tmp_path / "_b.txt").write_text("")
    (tmp_path / "docs" / "deep").mkdir()
    (tmp_path / "docs" / "deep" / ".c").write_text("y")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "config").write_text("z")
    import hashlib
    got = values(file_source.file_inventory(spark, str(tmp_path)))
    assert got == [("_b.txt", 0, hashlib.sha256(b"").hexdigest()), ("docs/a.md", 1, hashlib.sha256(b"x").hexdigest()),
                   ("docs/deep/.c", 1, hashlib.sha256(b"y").hexdigest())]
    docs = spark.createDataFrame([("docs/a.md", "[x](../README.md) [y](b%20c.md#z) [z](./) [u](../../x) ![i](no.png) [v](/etc) [w](gone)")],
                                 "path STRING, text STRING")
    paths = spark.createDataFrame([("docs/a.md",), ("README.md",), ("docs/b c.md",)], "path STRING")
    assert values(policy.dangling_links(docs, paths)) == [
        ("docs/a.md", "../../x", "escapes"), ("docs/a.md", "/etc", "escapes"), ("docs/a.md", "gone", "missing")]


def test_rules_by_scope(spark):
    files = spark.createDataFrame([
        ("src/a.py", "get_sub_info()"), ("src/con.py", "get_sub_info(); mkstemp()"), ("docs/a.md", "token = abcdef"),
        ("docs/a.txt", "token = abcdef"), ("src/a.txt", "download_video"), ("src/con.py", "download_video")], "path STRING, text STRING")
    got = values(policy.rule_scan(files, code_prefixes=("src/",), doc_prefixes=("docs/",), connectors=("src/con.py",)))
    assert got == sorted([("src/a.py", "course URL acquisition"), ("src/con.py", "connector persistence"),
                          ("docs/a.md", "credential example"), ("src/con.py", "original media persistence")], key=str)


def test_snapshots_and_manifests(spark):
    rows = [(1, 10, "state-a", False), (1, 20, "state-b", False), (1, 30, "state-c", True), (1, 40, "x", False)]
    df = spark.createDataFrame(rows, "repo INT, at INT, name STRING, expired BOOLEAN")
    assert values(snapshots.latest(df, ["repo"], "state-", ["at"])) == [(1, "state-b", 1)]
    assert values(snapshots.superseded(df, ["repo"], "state-", ["at"]).select("name")) == [("state-a",)]
    entries = spark.createDataFrame([("a/b", "100644", 1, "0" * 64), ("/a", "100644", 1, "0" * 64), ("a\\..\\b", "100644", 1, "0" * 64),
                                     ("meta", "100644", 1, "0" * 64), ("a", "120000", 1, "0" * 64), ("a", "100755", -1, "0" * 64),
                                     ("a", "100755", 0, "xyz")], "path STRING, mode STRING, size BIGINT, sha256 STRING")
    assert [r[0] for r in entries.select(integrity.entry_reason(("meta",))).collect()] == [
        "ok", "path", "path", "path", "mode", "size", "sha256"]


def test_recogniser_text_without_silence(spark):
    from lecturespark.functions.text import clean_asr_text
    df = spark.createDataFrame([(1, "a<sil> <sil>b"), (2, "<sil>")], "i INT, text STRING")
    assert values(segments.clean_segments(df, clean_asr_text)) == [(1, "a b")]


def test_rules_from_a_table(spark):
    files = spark.createDataFrame([("a.py", "x TOKEN=1 (a+b)"), ("b.md", "nothing"), ("c/d.py", None), (None, "token=2"), ("z.py", "aab")], "path STRING, text STRING")
    rules = [policy.ScanRule("token", "(?i)token=", ("token",), suffixes=(".py",)), policy.ScanRule("sum", r"\(a\+b\)", ("(a+b)",)),
             policy.ScanRule("free", "t.*[23]", ()), policy.ScanRule("overlap", "aab", ("aab", "ab")), policy.ScanRule("not here", "nothing", ("nothing",), exempt=("b.md",))]
    want = [("None", "free"), ("a.py", "sum"), ("a.py", "token"), ("z.py", "overlap")]
    assert sorted((str(r["path"]), r["rule"]) for r in policy.scan_rules(files, rules).collect()) == want
    table = spark.createDataFrame([(r.name, r.pattern, list(r.factors), list(r.suffixes), list(r.exempt) or None) for r in rules],
                                  "name STRING, pattern STRING, factors ARRAY<STRING>, suffixes ARRAY<STRING>, exempt ARRAY<STRING>")
    assert sorted((str(r["path"]), r["rule"]) for r in policy.scan_rules(files, table).collect()) == want
    assert policy.scan_rules(files, []).count() == 0
