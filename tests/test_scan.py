"""Ordered operators on large groups: the blocked plan, the direct plan and a plain loop agree."""

import random

import pytest
from pyspark.sql import functions as F

from lecturespark.operators import admission, captions, health, integrity, messages, scan, segments, slides

PLANS = [{"blocked": False}, {"rows_per_task": 40}]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def lectures(seed, hot=400, others=20):
    """A lecture with most of the rows, some small ones, times with gaps, ties and nonsense."""
    rng = random.Random(seed)
    rows = []
    for lecture in [0] * hot + [rng.randint(1, 12) for _ in range(others)]:
        start = rng.choice([None, 0, -500, rng.randint(0, 40_000)])
        end = rng.choice([None, 0, -1, rng.randint(0, 45_000)])
        rows.append((lecture, len(rows), start, end, rng.choice(["a b", "  ", None, " x\x1cy ", "z"])))
    rng.shuffle(rows)
    return rows


def loop_normalise(rows):
    out = []
    for lecture in sorted({r[0] for r in rows}):
        previous, n = 0, 0
        mine = sorted((r for r in rows if r[0] == lecture), key=lambda r: (r[2] or 0, r[1]))
        for _, _, start, end, text in mine:
            words = " ".join((text or "").split())
            if words:
                begin = max(previous, start or 0)
                previous = max(begin + 200, end or begin + 1000)
                out.append((lecture, n, begin, previous, words))
                n += 1
    return out


SEGMENTS = "lecture_id BIGINT, ord BIGINT, start_ms BIGINT, end_ms BIGINT, text STRING"


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("seed", [1, 2])
def test_normalise_is_the_loop(spark, plan, seed):
    rows = lectures(seed)
    df = spark.createDataFrame(rows, SEGMENTS).repartition(5)
    done = segments.normalise_segments(df, **plan)
    assert rows_of(done) == loop_normalise(rows)
    again = segments.normalise_segments(done, **plan)
    assert rows_of(again) == rows_of(done)


def test_captions_in_parts_join_to_the_whole(spark):
    df = spark.createDataFrame(lectures(3), SEGMENTS)
    for make in (captions.captions_srt, captions.captions_vtt):
        whole = {r["lecture_id"]: r["text"] for r in make(df, per_part=10**6, blocked=False).collect()}
        parts = make(df, per_part=7, rows_per_task=40).orderBy("lecture_id", "part").collect()
        joined = {}
        for r in parts:
            joined[r["lecture_id"]] = joined.get(r["lecture_id"], "") + r["text"]
        assert joined == whole
        assert max(r["part"] for r in parts) > 10


def test_captions_of_nothing(spark):
    df = spark.createDataFrame([(1, 0, 0, 1, " ")], SEGMENTS)
    assert captions.captions_srt(df).first()["text"] == ""
    assert captions.captions_vtt(df).first()["text"] == "WEBVTT\n"


def test_written_captions_keep_part_order(spark, tmp_path):
    df = spark.createDataFrame(lectures(4), SEGMENTS)
    path = str(tmp_path / "srt")
    captions.write_captions(captions.captions_srt(df, per_part=9), path)
    whole = {r["lecture_id"]: r["text"] for r in captions.captions_srt(df, per_part=10**6).collect()}
    for lecture, text in whole.items():
        files = sorted((tmp_path / "srt" / f"lecture_id={lecture}").glob("*.txt"))
        assert "".join(f.read_text() for f in files) == text


def test_carry_stays_small(spark):
    df = spark.range(20_000).select((F.col("id") % 2000 * 0).alias("k"), F.col("id").alias("o")).union(
        spark.range(5000).select(F.col("id") + 1, F.lit(0)))
    rows = scan.OrderedRows(df, ["k"], ["o"], rows_per_task=2000)
    assert rows.blocked
    assert rows.df.where(f"k = 0 AND {scan.BLOCK} < 0").count() == 0
    assert rows.df.where(f"k <> 0 AND {scan.BLOCK} >= 0").count() == 0
    blocks = rows.df.groupBy("k", scan.BLOCK).count()
    cut = blocks.groupBy("k").agg(F.count("*").alias("n"), F.max("count").alias("most")).where("n > 1")
    # 20 000 rows in blocks of about 2000, whatever the session's number of partitions; ranges are sampled.
    assert cut.agg(F.sum("n")).first()[0] <= 10
    assert cut.agg(F.max("most")).first()[0] < 3000


def test_positions_and_null_keys(spark):
    rows = [(None, i) for i in range(50)] + [(1, i) for i in range(3)]
    df = spark.createDataFrame(rows, "k INT, o INT")
    for plan in PLANS:
        got = scan.list_positions(df, ["k"], ["o"], **plan)
        assert got.where("idx <> o").count() == 0 and got.count() == 53


def attempts(seed, n=600):
    rng = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += rng.choice([0, 3600, 7200, 86_400 if rng.random() < 0.05 else 600]) * 1_000_000
        outcome = rng.choices(["ok", "transient", "auth_failed", "other"], [1, 8, 1, 2])[0]
        rows.append((i, 0 if rng.random() < 0.9 else rng.randint(1, 4), at, outcome))
    return rows


def loop_circuit(rows):
    state, out = {}, []
    for event, key, at, outcome in sorted(rows, key=lambda r: (r[2], r[0])):
        failures = state.get(key, [])
        if outcome == "other":
            continue
        retry = 0
        if outcome == "ok":
            failures, name = [], "closed"
        elif outcome == "auth_failed":
            failures, name = [at], "open"
        else:
            failures = [f for f in failures if at - f < 86_400_000_000] + [at]
            name = "open" if len(failures) >= 5 else "degraded"
            retry = at + 6 * 3600 * 1_000_000 if name == "open" else 0
        state[key] = failures
        out.append((event, key, name, len(failures), retry))
    return sorted(out)


@pytest.mark.parametrize("plan", PLANS)
def test_ai_circuit_is_the_loop(spark, plan):
    rows = attempts(5)
    df = spark.createDataFrame(rows, "event_id BIGINT, key_id BIGINT, at_us BIGINT, outcome STRING").repartition(3)
    got = health.ai_circuit(df, ["key_id"], **plan).select("event_id", "key_id", "state", "failures", "retry_after_us")
    assert rows_of(got) == loop_circuit(rows)


@pytest.mark.parametrize("plan", PLANS)
def test_auth_circuit_is_the_loop(spark, plan):
    rows = attempts(6)
    df = spark.createDataFrame(rows, "event_id BIGINT, key_id BIGINT, at_us BIGINT, outcome STRING").repartition(3)
    state, want = {}, []
    for event, key, _, outcome in sorted(rows, key=lambda r: (r[2], r[0])):
        auth, platform = state.get(key, (0, 0))
        if outcome == "ok":
            auth, platform = 0, 0
        elif outcome == "auth_failed":
            auth += 1
        elif outcome == "transient":
            platform += 1
        else:
            continue
        state[key] = (auth, platform)
        want.append((event, auth, platform, "closed" if not auth else "open" if auth >= 3 else "degraded"))
    got = health.auth_circuit(df, ["key_id"], **plan).select("event_id", "auth_failures", "platform_failures", "auth_state")
    assert rows_of(got) == sorted(want)


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("limits", [(50, 300, 10**9), (10**6, 400, 10**9), (10**6, 10**6, 20_000), (0, 30, 0)])
def test_budget_is_the_loop(spark, plan, limits):
    rng = random.Random(7)
    rows = [(0 if rng.random() < 0.8 else 1, i, f"2024-01-{rng.randint(1, 9):02d}", rng.randint(0, 3), rng.random() < 0.3,
             rng.choice(["fast", "standard", None, ""]), rng.random() < 0.2, rng.random() < 0.2, rng.random() < 0.3,
             rng.choice([None, 30, 60]), rng.choice([None, 0, 1000, 4000]), rng.choice(["ok", "failed"]),
             rng.randint(0, 400_000), rng.randint(0, 400), i % 3) for i in range(500)]
    names = ["run", "sub_id", "lecture_date", "priority", "discovery_only", "subtitle_mode", "summary", "chapters",
             "ai_circuit_open", "max_lecture_minutes", "duration_seconds", "outcome", "cost_ms", "tokens", "course_id"]
    df = spark.createDataFrame(rows, "run INT, sub_id BIGINT, lecture_date STRING, priority INT, discovery_only BOOLEAN, "
                               "subtitle_mode STRING, summary BOOLEAN, chapters BOOLEAN, ai_circuit_open BOOLEAN, "
                               "max_lecture_minutes INT, duration_seconds INT, outcome STRING, cost_ms BIGINT, tokens BIGINT, "
                               "course_id BIGINT")
    most, minutes, tokens = max(1, limits[0] or 2), max(0, (limits[1] or 300) - 30) * 60_000, limits[2] or 100_000
    used, want = {}, []
    for values in sorted(rows, key=lambda r: (-r[3], r[2], str(r[1]))):
        r = dict(zip(names, values))
        lectures_, ms, tok = used.get(r["run"], (0, 0, 0))
        ai = (r["subtitle_mode"] or "fast") == "standard" or r["summary"] or r["chapters"]
        if lectures_ >= most or ms >= minutes or tok >= tokens:
            decision = "deferred_budget"
        elif r["discovery_only"]:
            decision, lectures_ = "discovered", lectures_ + 1
        elif ai and r["ai_circuit_open"]:
            decision = "deferred_circuit"
        elif (r["duration_seconds"] or 0) > (r["max_lecture_minutes"] or 240) * 60:
            decision = "deferred_duration"
        elif r["outcome"] == "ok":
            decision, lectures_, ms, tok = "processed", lectures_ + 1, ms + r["cost_ms"], tok + r["tokens"]
        else:
            decision, ms = "failed", ms + r["cost_ms"]
        used[r["run"]] = (lectures_, ms, tok)
        want.append((r["sub_id"], decision))
    got = admission.budget_admission(df, ["run"], max_lectures=limits[0], max_runner_minutes=limits[1],
                                     max_tokens=limits[2], **plan).select("sub_id", "decision")
    assert rows_of(got) == sorted(want)


@pytest.mark.parametrize("plan", PLANS)
def test_sequence_guard_is_the_loop(spark, plan):
    rng = random.Random(8)
    rows = [(i, 0 if rng.random() < 0.9 else 1, rng.randint(0, 60) + i // 10, rng.choice(["h", "h", "h", "bad"]),
             rng.choice(["progress", "cancel_ack", "odd"])) for i in range(400)]
    df = spark.createDataFrame(rows, "arrival INT, task_id INT, sequence INT, input_hash STRING, control_kind STRING")
    expected = spark.createDataFrame([(0, "h"), (1, "h")], "task_id INT, expected_hash STRING")
    highest, want = {}, []
    for arrival, task, sequence, digest, kind in rows:
        if digest != "h":
            status = "tampered"
        elif kind == "odd":
            status = "unknown_kind"
        elif sequence <= highest.get(task, -1):
            status = "out_of_sequence"
        else:
            status, highest[task] = "accepted", sequence
        want.append((arrival, status))
    got = messages.sequence_guard(df.repartition(4), expected, ["task_id"], **plan).select("arrival", "status")
    assert rows_of(got) == sorted(want)


@pytest.mark.parametrize("plan", PLANS)
def test_progress_throttle_is_the_loop(spark, plan):
    rng = random.Random(9)
    at, rows = 0, []
    for i in range(800):
        at += rng.choice([0, 1, 1, 2, 5, 20]) * 1_000_000
        rows.append((0 if rng.random() < 0.9 else 1, i, at, "asr" if i % 300 < 250 else "ocr", "running",
                     rng.choice([None, i, i // 2]), rng.choice([None, 0, 500, 500]), ""))
    sent, want = {}, []
    for task, arrival, at, stage, status, completed, total, _ in rows:
        last, done = sent.get(task), completed or 0
        if last is None or last[:2] != (stage, status) or at - last[2] >= 15_000_000 or (
                total and done - last[3] >= max(1, int(total * 0.02))):
            sent[task] = (stage, status, at, done)
            want.append(arrival)
    df = spark.createDataFrame(rows, "task_id INT, arrival INT, at_us BIGINT, stage STRING, status STRING, completed BIGINT, "
                               "total BIGINT, error_code STRING")
    got = messages.progress_throttle(df.repartition(4), ["task_id"], **plan).select("arrival")
    assert [r[0] for r in rows_of(got)] == sorted(want)


def test_progress_of_a_hundred(spark):
    rows = [(1, 0, 0, "asr", "waiting", None, None, "")] + [(1, i, i, "asr", "running", i, 100, "") for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "task_id INT, arrival INT, at_us BIGINT, stage STRING, status STRING, completed BIGINT, "
                               "total BIGINT, error_code STRING")
    assert rows_of(messages.progress_throttle(df, ["task_id"]).select("arrival")) == [(0,), (1,), (3,)]


@pytest.mark.parametrize("plan", PLANS)
def test_tree_digest_and_order_of_a_large_manifest(spark, plan):
    import hashlib
    import json

    entries = [{"mode": "100644", "path": f"f{i:05d}" if i != 7 else "a", "sha256": "0" * 64, "size": i} for i in range(2500)]
    df = spark.createDataFrame([(1, i, *e.values()) for i, e in enumerate(entries)],
                               "release INT, ord INT, mode STRING, path STRING, sha256 STRING, size BIGINT").repartition(6)
    text = json.dumps(entries, sort_keys=True, separators=(",", ":"))
    got = integrity.tree_digest(df, ["release"], **plan).first()["tree_sha256"]
    assert got == hashlib.sha256(text.encode()).hexdigest()
    flagged = integrity.manifest_order(df, ["release"], **plan).where("out_of_order OR duplicate")
    assert [r["ord"] for r in flagged.collect()] == [7]


@pytest.mark.parametrize("plan", PLANS)
def test_page_numbers_of_kept_rows(spark, plan):
    rows = [(1, i, None if i % 3 else 5, '{"pptimgurl":"u"}' if i % 2 else "{") for i in range(60)]
    df = spark.createDataFrame(rows, "lecture_id INT, ord INT, created_sec INT, content STRING").repartition(4)
    got = slides.slide_rows(df, **plan).select("page_num").orderBy("page_num").collect()
    assert [r[0] for r in got] == list(range(1, 31))
