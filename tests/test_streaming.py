"""Streams over several micro-batches and restarts equal their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from lecturespark import session
from lecturespark.operators import admission, courses, health, messages
from lecturespark.plans.catalogue import load
from lecturespark.sources import jobs
from lecturespark.sources import seen as known_pairs
from lecturespark.streaming import carried, control, intake, sinks

FOLDER = "/root/testdata/sf0.001"


def values(df):
    return sorted(tuple(r) for r in df.collect())


def in_batches(spark, df, order, path, batches=4):
    """The rows as files in order, read one file per micro-batch."""
    top = df.agg(F.max(order)).first()[0] + 1
    step = -(-top // batches)
    for i in range(batches):
        df.where((F.col(order) >= i * step) & (F.col(order) < (i + 1) * step)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


PLANS = [{"blocked": False}, {"rows_per_task": 10}]


@pytest.mark.parametrize("plan", PLANS)
def test_control_over_batches(spark, tmp_path, plan):
    rows = load(spark, FOLDER, "control")
    expected = rows.select("task_id", F.concat(F.lit("h"), F.col("task_id").cast("string")).alias("expected_hash")).distinct()
    stream = in_batches(spark, rows, "arrival", str(tmp_path / "in"))
    got = carried.guard_control(stream, expected, str(tmp_path / "out"), **plan)
    want = messages.sequence_guard(rows, expected, ["task_id"])
    assert values(got.select("arrival", "status")) == values(want.select("arrival", "status"))


def test_control_forgets_ended_jobs(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 9, "h", "progress", 0), (1, 2, 1, "h", "progress", 100), (2, 1, 5, "h", "progress", 100)],
                                 "arrival INT, task_id INT, sequence INT, input_hash STRING, control_kind STRING, at_us BIGINT")
    expected = spark.createDataFrame([(1, "h"), (2, "h")], "task_id INT, expected_hash STRING")
    for forget, status in ((None, "out_of_sequence"), (50, "accepted")):
        stream = in_batches(spark, rows, "arrival", str(tmp_path / f"in{forget}"), batches=3)
        got = carried.guard_control(stream, expected, str(tmp_path / f"out{forget}"), forget)
        assert [r["status"] for r in got.orderBy("arrival").collect()] == ["accepted", "accepted", status]


@pytest.mark.parametrize("plan", PLANS)
def test_throttle_over_batches(spark, tmp_path, plan):
    rows = load(spark, FOLDER, "progress")
    stream = in_batches(spark, rows, "arrival", str(tmp_path / "in"))
    got = carried.throttle_progress(stream, str(tmp_path / "out"), **plan)
    want = messages.progress_throttle(rows, ["task_id"])
    assert values(got.select("arrival")) == values(want.select("arrival"))


def plain_beats(rows, lifetime, until):
    """(arrival, time, beat) of the publisher: messages (task, arrival, at, stage, status, done, step) and its repetitions."""
    out, tasks, every = [], {}, 15_000_000
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        tasks.setdefault(r[0], []).append(r)
    for own in tasks.values():
        sent = None
        for n, (_, arrival, at, stage, status, done, step) in enumerate(own):
            if sent is None or at - own[n - 1][2] > lifetime or (stage, status) != sent[:2] or at - sent[2] >= every or (step and done - sent[3] >= step):
                sent = (stage, status, at, done)
                out.append((arrival, at, False))
            end = min(own[n + 1][2] if n + 1 < len(own) else until, at + lifetime + 1)
            while sent[2] + every < end:
                sent = (stage, status, sent[2] + every, done)
                out.append((arrival, sent[2], True))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_heartbeats_replay_in_any_batches(spark, tmp_path, batches):
    rng = random.Random(2)
    rows, at = [], 10 ** 15  # the engine takes the year 1970 for late
    for n in range(200):
        at += rng.choice([0, 1_000_000, 4_000_000, 15_000_000, 31_000_000] + [200_000_000] * (n % 50 == 7))
        rows.append((rng.randrange(4), n, at, rng.choice(["asr", "asr", "asr", "ocr"]), "running", n % 40, 100, ""))
    df = spark.createDataFrame(rows, "task_id BIGINT, arrival BIGINT, at_us BIGINT, stage STRING, status STRING, completed BIGINT, total BIGINT, error_code STRING")
    stream = in_batches(spark, df, "arrival", str(tmp_path / "in"), batches)
    got = sinks.drain_to_parquet(control.throttle_live(stream, "20 seconds", 60_000_000), str(tmp_path / "out"), timers=True)
    want = plain_beats([(*r[:6], 2) for r in rows], 60_000_000, (at // 1000 - 20_000) * 1000)
    assert values(got.select("arrival", "at_us", "beat")) == want and any(beat for *_, beat in want)


@pytest.mark.parametrize("plan", PLANS)
def test_circuit_over_batches(spark, tmp_path, plan):
    # Half a minute between attempts instead of hours, so that failures pile up over batches.
    rows = load(spark, FOLDER, "attempts").withColumn("at_us", F.col("event_id") * 30_000_000).withColumn("key_id", F.col("key_id") % 5)
    stream = in_batches(spark, rows, "event_id", str(tmp_path / "in"))
    got = carried.watch_circuit(stream, str(tmp_path / "out"), **plan)
    columns = ["key_id", "event_id", "state", "failures", "retry_after_us"]
    assert values(got.select(columns)) == values(health.ai_circuit(rows, ["key_id"]).select(columns))


def test_ledger_over_batches(spark, tmp_path):
    rows = load(spark, FOLDER, "usage")
    stream = in_batches(spark, rows.withColumn("n", F.col("at_us") - rows.agg(F.min("at_us")).first()[0]), "n", str(tmp_path / "in"))
    got = sinks.drain_updates(intake.ledger_stream(stream, ["key_id"]), str(tmp_path / "out"), ["key_id", "day"])
    assert values(got) == values(admission.daily_ledger(rows, ["key_id"]))


def test_ledger_counts_late_use(spark, tmp_path):
    day = 86_400_000_000
    rows = spark.createDataFrame([(0, 1, 10 * day, 1, 5, 7), (1, 1, 14 * day, 1, 6, -2), (2, 1, 10 * day + 1, 1, 8, None), (3, 2, 6 * day, 1, 9, 1), (4, 1, None, 1, 4, 3)],
                                 "n INT, key_id INT, at_us BIGINT, lectures INT, cost_ms BIGINT, tokens BIGINT")
    stream = in_batches(spark, rows, "n", str(tmp_path / "in"), batches=5)
    got = sinks.drain_updates(intake.ledger_stream(stream, ["key_id"]), str(tmp_path / "out"), ["key_id", "day"])
    text = lambda df: sorted(map(str, df.collect()))
    assert text(got) == text(admission.daily_ledger(rows, ["key_id"]))


def test_discovery_over_a_restart(spark, tmp_path):
    rows = load(spark, FOLDER, "lectures").withColumn("n", F.col("sub_id"))
    seen = load(spark, FOLDER, "seen")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):  # the same catalogue is dropped twice, the stream stops in between
        stream = in_batches(spark, rows, "n", source, batches=2)
        got = intake.drain_discovery(stream, seen, out).select("course_id", "sub_id")
    want = rows.where("has_playback").join(seen, ["course_id", "sub_id"], "left_anti").select("course_id", "sub_id")
    assert values(got) == values(want)


def test_results_over_a_restart(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("h"), (F.col("id") % 10).cast("string")).alias("input_hash"), "id")
    table, mark = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for _ in range(2):
        stream = in_batches(spark, rows, "id", str(tmp_path / "in"))
        intake.resume_results(stream, table, mark, "id")
    assert values(jobs.read_results(spark, table)) == [(f"h{i}", i) for i in range(10)]


def test_latest_status_is_replaced(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "b", 0), (1, 9, "c", 1), (1, 7, "late", 2), (2, 1, "x", 3)],
                                 "task_id INT, sequence INT, stage STRING, n INT")
    stream = in_batches(spark, rows, "n", str(tmp_path / "in"))
    got = sinks.drain_updates(control.latest_status(stream, ["stage"]), str(tmp_path / "out"), ["task_id"])
    assert values(got.select("task_id", "sequence", "stage")) == [(1, 9, "c"), (2, 1, "x")]


def test_a_cluster_must_name_its_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_known_pairs_stay_where_they_are(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 7).alias("course_id"), F.col("id").alias("sub_id"), F.lit(True).alias("has_playback"))
    table = known_pairs.seen_table(spark, str(tmp_path / "seen"), rows, buckets=8)
    known_pairs.remember(rows.where("sub_id < 200"), table, 0)
    known_pairs.remember(rows.where("sub_id BETWEEN 150 AND 249"), table, 1)
    assert values(courses.discover_new(rows, known_pairs.known(spark, table)).select("sub_id")) == [(i,) for i in range(250, 300)]
    assert courses.discover_new(rows, known_pairs.known(spark, table, before=1)).count() == 100
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = courses.discover_new(rows, known_pairs.known(spark, table))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # One exchange, that of the lectures; the pairs are scanned in buckets.
    assert plan.count("Exchange") == 1 and "SelectedBucketsCount: 8 out of 8" in plan
