"""Stateful streams whose keys may be of any size and number.

A state-store operator hands all rows of a key to one task. Here every micro-batch
runs the batch operator, which cuts large keys into blocks, and the state between
batches is a table of small rows: what a key must remember, put in front of its next
rows. A batch reads the buckets of its own keys and adds what these keys now remember as
a generation of its own (``sources.generations``), so its cost follows the batch and not
the keys there have ever been. Results and state carry the batch's number, and a batch
reads generations of earlier ones only, so it repeats exactly if it runs again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import health, messages
from ..sources import generations
from .sinks import drain

# A step takes the batch and the carried rows of its keys (None at first) and returns the results.
Step = Callable[[DataFrame, DataFrame | None], DataFrame]
# A memory takes the written results and the carried rows of their keys and returns the rows to add to the state.
Memory = Callable[[DataFrame, DataFrame | None], DataFrame]
# What counts of the stored rows of some keys, and of merged ones, at the stream's clock.
Combine = Callable[[DataFrame, int | None], DataFrame]


def carried_rows(spark: SparkSession, path: str, batch_id: int, batch: DataFrame, keys: list[str], combine: generations.Combine) -> DataFrame | None:
    """What the keys of a batch remember from the batches before it; other buckets are not read."""
    chosen = generations.cover(generations.spans(spark, path), batch_id - 1)
    if not chosen:
        return None
    rows = generations.read(spark, path, chosen, generations.buckets_in(batch, keys))
    if rows is None:
        return None
    return combine(rows.join(batch.select(*keys).distinct(), keys, "left_semi")).drop("bucket", "_batch")


def drain_carried(stream: DataFrame, folder: str, keys: list[str], step: Step, memory: Memory, combine: Combine, clock: Column | None = None) -> DataFrame:
    """Run a stream to the end of its input and read the results of all batches.

    ``clock`` is a value of the results; its greatest so far is one row beside the state.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        session, state = batch.sparkSession, f"{folder}/state"
        now = session.read.parquet(f"{folder}/clock/batch={batch_id - 1}").first()[0] if clock is not None and batch_id else None
        before = carried_rows(session, state, batch_id, batch, keys, lambda rows: combine(rows, now))
        path = f"{folder}/table/batch={batch_id}"
        step(batch, before).write.mode("overwrite").parquet(path)
        results = session.read.parquet(path)
        if clock is not None:
            latest = results.select(F.greatest(F.max(clock), F.lit(now).cast("bigint")).alias("now"))
            latest.write.mode("overwrite").parquet(f"{folder}/clock/batch={batch_id}")
            now = session.read.parquet(f"{folder}/clock/batch={batch_id}").first()[0]
        generations.append(memory(results, before), state, batch_id, keys)
        generations.merge_tiers(session, state, batch_id, lambda rows: combine(rows, now))
        generations.forget(session, state, batch_id)

    drain(spark, stream.writeStream.foreachBatch(write), f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/table").drop("batch")


def _newest(keys: list[str]) -> Combine:
    return lambda rows, now: generations.newest(keys)(rows)


def _with_carried(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    fresh = batch.withColumn("carried", F.lit(False))
    if before is None:
        return fresh
    return before.withColumn("carried", F.lit(True)).unionByName(fresh, allowMissingColumns=True)


def _of_both(results: DataFrame, before: DataFrame | None, columns: list[str]) -> DataFrame:
    rows = results.select(columns)
    return rows if before is None else rows.unionByName(before.select(columns))


def guard_control(stream: DataFrame, expected: DataFrame, folder: str, forget_after_us: int | None = None,
                  **options) -> DataFrame:
    """Accept control messages in strictly rising sequence per task.

    Carried: the last accepted message of each task; ``forget_after_us`` drops tasks
    whose last message is older than the newest accepted so far by more (a job lives 30 minutes).
    """
    kept = ["task_id", "arrival", "sequence", "input_hash", "control_kind", "at_us"]

    def combine(rows, now):
        last = generations.newest(["task_id"])(rows)
        return last if forget_after_us is None or now is None else last.where(F.col("at_us") >= now - forget_after_us)

    def step(batch, before):
        rows = _with_carried(batch, before)
        # What was carried came first, whatever its number.
        rows = rows.withColumn("fresh", ~F.col("carried"))
        checked = messages.sequence_guard(rows, expected, ["task_id"], ("fresh", "arrival"), **options)
        return checked.where("fresh").drop("carried", "fresh")

    def memory(results, before):
        accepted = _of_both(results.where("status = 'accepted'"), before, kept)
        last = accepted.groupBy("task_id").agg(F.max_by(F.struct(*kept[1:]), "sequence").alias("_l"))
        return last.select("task_id", "_l.*")

    clock = None if forget_after_us is None else F.when(F.col("status") == "accepted", F.col("at_us"))
    return drain_carried(stream, folder, ["task_id"], step, memory, combine, clock)


def watch_circuit(stream: DataFrame, folder: str, **options) -> DataFrame:
    """State of a key's circuit after each attempt.

    Carried: each key's failures since its last restart that a day has not passed since. A
    batch adds its own such rows; which of them still count is decided when they are read, and
    a merge drops the others.
    """
    kept = ["key_id", "event_id", "at_us", "outcome"]

    def step(batch, before):
        rows = _with_carried(batch.select(kept), before)
        return health.ai_circuit(rows, ["key_id"], ("carried",), **options).where("NOT carried").drop("carried")

    def counting(rows, now=None):
        place = F.struct("at_us", "event_id")
        stops = rows.groupBy("key_id").agg(
            F.max("at_us").alias("_newest"), F.max(F.when(F.col("outcome") == "ok", place)).alias("_ok"),
            F.max(F.when(F.col("outcome") == "auth_failed", place)).alias("_auth"))
        open_ = ((F.col("_ok").isNull() | (place >= F.col("_ok"))) & (F.col("_auth").isNull() | (place >= F.col("_auth")))
                 & (F.col("at_us") > F.col("_newest") - F.lit(health.DAY_US)))
        return rows.join(stops, "key_id").where(open_).select(*rows.columns)

    def memory(results, before):
        return counting(results.select(kept))

    return drain_carried(stream, folder, ["key_id"], step, memory, counting)


def throttle_progress(stream: DataFrame, folder: str, **options) -> DataFrame:
    """The progress messages that are sent on. Carried: the last one sent of each task."""
    kept = ["task_id", "arrival", "at_us", "stage", "status", "completed", "total", "error_code"]

    def step(batch, before):
        rows = _with_carried(batch.select(kept), before)
        return messages.progress_throttle(rows, ["task_id"], **options).where("NOT carried").drop("carried")

    def memory(results, before):
        sent = _of_both(results, before, kept)
        last = sent.groupBy("task_id").agg(F.max_by(F.struct(*kept[1:]), F.struct("at_us", "arrival")).alias("_l"))
        return last.select("task_id", "_l.*")

    return drain_carried(stream, folder, ["task_id"], step, memory, _newest(["task_id"]))
