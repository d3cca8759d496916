"""Rules, candidate order, budgets and run results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_present, present
from .scan import OrderedRows, Running, list_positions

# Defaults of a budget.
DEFAULT_LECTURES = 2
DEFAULT_RUNNER_MINUTES = 300
RESERVED_MINUTES = 30
DEFAULT_TOKENS = 100_000
DEFAULT_LECTURE_MINUTES = 240

# Codes of a daily run.
COMPLETED = "cloud_daily_completed"
BUDGET_EXHAUSTED = "budget_exhausted"
AI_CIRCUIT_OPEN = "deepseek_circuit_open"
AI_TRANSIENT = "deepseek_transient"
AI_AUTH_FAILED = "deepseek_auth_failed"
SUCCESS_CODES = (COMPLETED, BUDGET_EXHAUSTED, AI_TRANSIENT, AI_CIRCUIT_OPEN)

ORDER = ["_rank_priority", "lecture_date", "_rank_id", "course_id"]


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def uses_ai() -> Column:
    """Whether a rule's outputs need a language model."""
    mode = first_present("subtitle_mode", missing="", default="fast")
    return (mode == "standard") | _flag("summary") | _flag("chapters")


def needs_ai() -> Column:
    """As the connection check sees it: a missing ``discovery_only`` counts as set here."""
    return ~F.coalesce(F.col("discovery_only"), F.lit(True)) & uses_ai()


def rules_need_ai(rules: DataFrame, keys: list[str]) -> DataFrame:
    return rules.groupBy(*keys).agg(F.bool_or(needs_ai()).alias("needs_ai"))


def requested_outputs() -> Column:
    extra = [F.when(_flag(name), F.lit(name)) for name in ("ocr", "summary", "chapters")]
    return F.array_compact(F.array(F.lit("subtitle"), *extra))


def with_rank(candidates: DataFrame) -> DataFrame:
    """Sort columns: higher priority, earlier date, smaller id as text."""
    return candidates.withColumns({
        "_rank_priority": -first_present("priority").cast("bigint"),
        "_rank_id": F.col("sub_id").cast("string"),
    })


def candidate_order(candidates: DataFrame, keys: list[str], **options) -> DataFrame:
    """Position of every candidate within its run."""
    ranked = list_positions(with_rank(candidates), keys, ORDER, name="position", **options)
    return ranked.drop("_rank_priority", "_rank_id")


def budget_admission(candidates: DataFrame, keys: list[str], *, max_lectures: int | None = None,
                     max_runner_minutes: float | None = None, max_tokens: int | None = None,
                     opening: DataFrame | None = None, **options) -> DataFrame:
    """Decide which candidates a run takes before its budget is used up.

    ``opening`` (keys, ``lectures``, ``cost_ms``, ``tokens``) is what earlier runs of the same
    day have used; several rows of a key add up, and keys without one start at zero.

    Costs are recorded or estimated per candidate: ``outcome`` (ok or failed),
    ``cost_ms`` and ``tokens``. A candidate is deferred once the earlier ones have
    used up a limit, so the last one taken may overshoot. Use never goes down;
    therefore the use of all earlier eligible candidates reaches a limit exactly
    when the use of the taken ones does, and running sums decide every row.
    A token limit of 0 means the default, as a missing one does.
    """
    lecture_limit = max(1, int(max_lectures or DEFAULT_LECTURES))
    stop_ms = int(max(0.0, float(max_runner_minutes or DEFAULT_RUNNER_MINUTES) - RESERVED_MINUTES) * 60_000)
    token_limit = max(0, int(max_tokens or DEFAULT_TOKENS))
    longest = first_present("max_lecture_minutes", default=DEFAULT_LECTURE_MINUTES) * 60
    # What would happen to the candidate if there were budget left.
    fate = (
        F.when(_flag("discovery_only"), "discovered")
        .when(uses_ai() & _flag("ai_circuit_open"), "deferred_circuit")
        .when(F.coalesce("duration_seconds", F.lit(0)) > longest, "deferred_duration")
        .when(F.col("outcome") == "ok", "processed").otherwise("failed"))
    zero = F.lit(0).cast("bigint")
    rows = OrderedRows(with_rank(candidates).withColumn("_fate", fate), keys, ORDER, **options)
    rows = rows.running(
        _lectures=Running("sum", F.when(F.col("_fate").isin("discovered", "processed"), 1).otherwise(0).cast("bigint"), True),
        _ms=Running("sum", F.when(F.col("_fate").isin("processed", "failed"), F.col("cost_ms")).otherwise(zero), True),
        _tokens=Running("sum", F.when(F.col("_fate") == "processed", F.col("tokens")).otherwise(zero), True),
    )
    counted = rows.result()
    before = {c: zero for c in ("lectures", "cost_ms", "tokens")}
    if opening is not None:
        # One row per key: the join leaves a large key to adaptive execution on the side that can be split.
        used = opening.groupBy(*keys).agg(*[F.sum(c).alias(f"_open_{c}") for c in before])
        counted = counted.join(used, keys, "left")
        before = {c: F.coalesce(f"_open_{c}", zero) for c in before}
    used_up = ((F.col("_lectures") + before["lectures"] >= lecture_limit) | (F.col("_ms") + before["cost_ms"] >= stop_ms)
               | (F.col("_tokens") + before["tokens"] >= token_limit))
    decided = counted.withColumn("decision", F.when(used_up, "deferred_budget").otherwise(F.col("_fate")))
    return decided.drop("_fate", "_lectures", "_ms", "_tokens", "_rank_priority", "_rank_id", *[f"_open_{c}" for c in before])


def run_counts(decisions: DataFrame, keys: list[str], expiring: DataFrame | None = None, account: list[str] | None = None) -> DataFrame:
    """Discovered, processed, failed and deferred candidates of each run.

    ``expiring`` has a row per result that expires soon; those of the run's ``account``
    columns (all of ``keys`` unless named) are counted as ``expiring_results``.
    """
    decision = F.col("decision")
    counts = decisions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(decision == "processed").alias("processed"),
        F.count_if(decision == "failed").alias("failed"),
        F.count_if(decision.startswith("deferred")).alias("deferred"))
    if expiring is None:
        return counts
    account = account or keys
    soon = expiring.groupBy(*account).agg(F.count(F.lit(1)).alias("expiring_results"))
    return counts.join(soon, account, "left").fillna(0, ["expiring_results"])


def decision_code(error_code: str = "error_code") -> Column:
    """The run code a decision sets, if any."""
    return (F.when(F.col("decision") == "deferred_budget", BUDGET_EXHAUSTED)
            .when(F.col("decision") == "deferred_circuit", AI_CIRCUIT_OPEN)
            .when(F.col("decision") == "failed", F.coalesce(present(error_code, ""), F.lit("cloud_processing_failed"))))


def run_code(codes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The code of a run is the last one set; four codes count as success."""
    position = F.when(F.col("code").isNotNull(), F.struct(*order))
    last = codes.groupBy(*keys).agg(F.max_by("code", position).alias("code"))
    return last.withColumn("code", F.coalesce("code", F.lit(COMPLETED))).withColumn(
        "success", F.col("code").isin(*SUCCESS_CODES))


def local_day(at_us: str, zone: str = "Asia/Shanghai") -> Column:
    """Calendar day of an instant (microseconds) in a zone, whatever the session's zone."""
    return F.expr(f"CAST(CAST(convert_timezone('UTC', '{zone}', timestampadd(MICROSECOND, {at_us}, "
                  f"TIMESTAMP_NTZ'1970-01-01 00:00:00')) AS DATE) AS STRING)")


def daily_ledger(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Lectures, run time and tokens used per key and local day."""
    return usage.groupBy(*keys, local_day("at_us").alias("day")).agg(
        F.sum("lectures").cast("bigint").alias("lectures"),
        F.sum("cost_ms").cast("bigint").alias("cost_ms"),
        F.sum(F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0))).cast("bigint").alias("tokens"))
