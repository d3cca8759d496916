"""Circuit breakers and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .admission import AI_AUTH_FAILED, AI_TRANSIENT
from .scan import OrderedRows, Running

DAY_US = 86_400 * 1_000_000
RETRY_US = 6 * 3600 * 1_000_000
AI_FAILURES_TO_OPEN = 5
AUTH_FAILURES_TO_OPEN = 3
RECENT = 5


def ai_failure_kind(message: str | Column) -> Column:
    """Whether a failed model request is about credentials or may pass by itself."""
    text = F.col(message) if isinstance(message, str) else message
    # What marks a credential problem.
    signs = ("HTTP 401", "HTTP 403", "does not contain an AI API key")
    found = F.lit(False)
    for sign in signs:
        found = found | F.contains(text, F.lit(sign))
    return F.when(found, AI_AUTH_FAILED).otherwise(AI_TRANSIENT)


def ai_circuit(attempts: DataFrame, keys: list[str], extra: tuple[str, ...] = (), **options) -> DataFrame:
    """Circuit state after each model attempt (ok, transient or auth_failed).

    Failures count for less than 24 hours and until the next success; five open
    the circuit for six hours. A credential failure opens it at once, restarts the
    count at itself and sets no retry time. The count over the trailing day is a
    running sum in which every failure enters as +1 and leaves as -1 a day later,
    so that large keys need no range frame in one task.
    """
    relevant = attempts.where(F.col("outcome").isin("ok", "transient", "auth_failed"))
    rows = OrderedRows(relevant, keys, ["at_us", "event_id"], **{"sized_by": attempts, **options})
    one = lambda outcome: F.when(F.col("outcome") == outcome, 1).otherwise(0).cast("bigint")
    rows = rows.running(_successes=Running("sum", one("ok"), exclusive=True),
                        _restarts=Running("sum", one("auth_failed")))
    failed = F.col("outcome") != "ok"

    def event(at: Column, kind: int, weight: Column) -> Column:
        return F.struct(at.alias("t"), F.lit(kind).alias("kind"), weight.cast("bigint").alias("weight"))

    enter = event(F.col("at_us"), 1, F.when(failed, 1).otherwise(0))
    leave = event(F.col("at_us") + F.lit(DAY_US), 0, F.lit(-1))
    events = rows.result().withColumn("_epoch", F.col("_successes") + F.col("_restarts")).withColumn(
        "_e", F.explode(F.when(failed, F.array(enter, leave)).otherwise(F.array(enter))))
    events = events.select("*", "_e.*").drop("_e", "_successes", "_restarts")
    counted = OrderedRows(events, [*keys, "_epoch"], ["t", "kind", "event_id"], like=rows)
    counted = counted.running(_recent=Running("sum", F.col("weight"))).result().where("kind = 1")
    auth, recent = F.col("outcome") == "auth_failed", F.col("_recent")
    opened = failed & (auth | (recent >= AI_FAILURES_TO_OPEN))
    return counted.select(
        *keys, *extra, "event_id", "at_us", "outcome",
        F.when(~failed, "closed").when(opened, "open").otherwise("degraded").alias("state"),
        F.when(failed, recent).otherwise(0).cast("bigint").alias("failures"),
        F.when(opened & ~auth, F.col("at_us") + F.lit(RETRY_US)).otherwise(0).cast("bigint").alias("retry_after_us"),
        F.when(~failed, "").when(auth, AI_AUTH_FAILED).otherwise(AI_TRANSIENT).alias("last_error_code"),
    )


def auth_circuit(attempts: DataFrame, keys: list[str], **options) -> DataFrame:
    """Consecutive failures since the last success, for sign-in and for the platform.

    Three sign-in failures open the circuit; platform failures only degrade it.
    """
    relevant = attempts.where(F.col("outcome").isin("ok", "transient", "auth_failed"))
    rows = OrderedRows(relevant, keys, ["at_us", "event_id"], **{"sized_by": attempts, **options})
    one = lambda outcome: F.when(F.col("outcome") == outcome, 1).otherwise(0).cast("bigint")
    rows = rows.running(_auth=Running("sum", one("auth_failed")), _platform=Running("sum", one("transient")))
    at_success = lambda name: F.when(F.col("outcome") == "ok", F.col(name))
    rows = rows.running(_auth_base=Running("max", at_success("_auth")),
                        _platform_base=Running("max", at_success("_platform")))
    since = lambda name: (F.col(name) - F.coalesce(f"{name}_base", F.lit(0))).cast("bigint")
    counted = rows.result().select(*keys, "event_id", "outcome", since("_auth").alias("auth_failures"),
                                   since("_platform").alias("platform_failures"))
    return counted.withColumns({
        "auth_state": F.when(F.col("auth_failures") == 0, "closed")
        .when(F.col("auth_failures") >= AUTH_FAILURES_TO_OPEN, "open").otherwise("degraded"),
        "platform_state": F.when(F.col("platform_failures") == 0, "closed").otherwise("degraded"),
    })


def recent_failures(attempts: DataFrame, keys: list[str], limit: int = RECENT) -> DataFrame:
    """The last failures of each key; Spark keeps only ``limit`` per task before the shuffle."""
    latest = Window.partitionBy(*keys).orderBy(F.desc("at_us"), F.desc("event_id"))
    failures = attempts.where(F.col("outcome").isin("transient", "auth_failed"))
    return failures.withColumn("nth", F.row_number().over(latest).cast("bigint")).where(F.col("nth") <= limit)


def token_usage(usage: DataFrame, keys: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Token totals; negative or missing counts are nothing."""
    return usage.groupBy(*keys).agg(*[
        F.sum(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))).cast("bigint").alias(c) for c in columns])


def pipeline_metrics(chunks: DataFrame, segments: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks, media and run time, segments, pages and speed of each result."""
    timed = chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("duration_ms").cast("bigint").alias("duration_ms"),
        F.sum("elapsed_ms").cast("bigint").alias("elapsed_ms"))
    counts = {"transcript_segments": segments, "ppt_pages": pages}
    for name, rows in counts.items():
        timed = timed.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "left")
    speed = F.round(F.col("duration_ms") / F.nullif("elapsed_ms", F.lit(0)), 3)
    return timed.fillna(0, list(counts)).withColumn("speed", speed)


def expiring_soon(snapshots: DataFrame, now_us: Column, prefix: str, days: int = 3) -> DataFrame:
    """Unexpired results that expire within the next days; unreadable times are left out."""
    zoned = F.regexp_replace("expires_at", r"Z\z", "+00:00")
    zoned = F.when(zoned.rlike(r"[+-]\d\d:\d\d\z"), zoned).otherwise(F.concat(zoned, F.lit("+00:00")))
    expiry = F.unix_micros(F.try_to_timestamp(zoned))
    return snapshots.where(F.startswith("name", F.lit(prefix)) & ~F.coalesce("expired", F.lit(False))).withColumn(
        "expires_us", expiry).where((F.col("expires_us") > now_us) & (F.col("expires_us") <= now_us + F.lit(days * DAY_US)))
