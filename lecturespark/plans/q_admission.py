"""Rules, discovery, budgets, ledgers and circuits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admission, courses, health
from . import inputs  # noqa: F401
from .registry import define_input, query

define_input("snapshots", """
SELECT event_id, user_id AS account_id,
       CASE WHEN event_id % 4 = 0 THEN concat('other-', CAST(event_id AS STRING)) ELSE concat('result-', CAST(event_id AS STRING)) END AS name,
       event_id % 7 = 0 AS expired, {ts_us} AS at_us,
       CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 11 = 1 THEN 'soon'
            WHEN event_id % 11 = 2 THEN concat(substr(replace(CAST(ts AS STRING), ' ', 'T'), 1, 19), '+08:00')
            ELSE concat(substr(replace(CAST(ts AS STRING), ' ', 'T'), 1, 19), 'Z') END AS expires_at
FROM {events}""")

# What an earlier run of the same day has used, for some of the runs, in two rows.
define_input("opening_usage", """
SELECT o_custkey % 25 AS account_id, year(CAST(o_orderdate AS DATE)) AS run, max(o_orderkey) % 9 AS lectures,
       max(o_orderkey) % 5 * 1000000 AS cost_ms, max(o_orderkey) % 7 * 4000 AS tokens
FROM {orders} WHERE o_custkey % 3 <> 0 GROUP BY o_custkey % 25, year(CAST(o_orderdate AS DATE)), o_custkey % 2""")

RULED = """last_rule AS (SELECT * FROM $rules),
ruled AS (
  SELECT l.*, r.course_id IS NOT NULL AS has_rule, coalesce(r.discovery_only, true) AS discovery_only,
         coalesce(r.priority, 0) AS priority, r.subtitle_mode, r.ocr, r.summary, r.chapters, r.max_lecture_minutes
  FROM $lectures l LEFT JOIN last_rule r USING (course_id)),
fresh AS (
  SELECT * FROM ruled r WHERE has_playback AND NOT EXISTS (
    SELECT 1 FROM $seen s WHERE s.course_id = r.course_id AND s.sub_id = r.sub_id)),
cand AS (
  SELECT *, course_id % 25 AS account_id, year(lecture_date) AS run,
         CASE WHEN sub_id % 9 = 0 THEN 'failed' ELSE 'ok' END AS outcome, duration_seconds * 300 AS cost_ms,
         duration_seconds * 2 AS tokens, sub_id % 10 = 3 AS ai_circuit_open
  FROM fresh)"""

# The admission loop itself, candidate by candidate, as a recursive query.
ADMITTED = RULED + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY account_id, run
      ORDER BY priority DESC, lecture_date, CAST(sub_id AS VARCHAR), course_id) AS n,
    CASE WHEN discovery_only THEN 'discovered'
         WHEN (coalesce(subtitle_mode, 'fast') = 'standard' OR coalesce(summary, false) OR coalesce(chapters, false))
              AND ai_circuit_open THEN 'deferred_circuit'
         WHEN duration_seconds > coalesce(max_lecture_minutes, 240) * 60 THEN 'deferred_duration'
         WHEN outcome = 'ok' THEN 'processed' ELSE 'failed' END AS fate FROM cand),
run_rows AS (
  SELECT account_id, run, 0 AS n, CAST(coalesce(o.lectures, 0) AS BIGINT) AS lectures, CAST(coalesce(o.ms, 0) AS BIGINT) AS ms,
         CAST(coalesce(o.tok, 0) AS BIGINT) AS tok, CAST(NULL AS BIGINT) AS sub_id, CAST(NULL AS VARCHAR) AS decision
  FROM (SELECT DISTINCT account_id, run FROM ranked) LEFT JOIN (
    SELECT account_id, run, sum(lectures) AS lectures, sum(cost_ms) AS ms, sum(tokens) AS tok FROM $opening_usage GROUP BY ALL) o USING (account_id, run)
  UNION ALL
  SELECT p.account_id, p.run, r.n,
         p.lectures + CASE WHEN NOT full_up AND fate IN ('discovered', 'processed') THEN 1 ELSE 0 END,
         p.ms + CASE WHEN NOT full_up AND fate IN ('processed', 'failed') THEN r.cost_ms ELSE 0 END,
         p.tok + CASE WHEN NOT full_up AND fate = 'processed' THEN r.tokens ELSE 0 END,
         r.sub_id, CASE WHEN full_up THEN 'deferred_budget' ELSE fate END
  FROM (SELECT *, lectures >= 20 OR ms >= 16200000 OR tok >= 100000 AS full_up FROM run_rows) p
  JOIN ranked r ON r.account_id = p.account_id AND r.run = p.run AND r.n = p.n + 1)"""


def ruled(load):
    return courses.apply_rules(load("lectures"), load("rules"))


def candidates(load):
    return courses.discover_new(ruled(load), load("seen")).withColumns({
        "account_id": F.col("course_id") % 25, "run": F.year("lecture_date").cast("bigint"),
        "outcome": F.when(F.col("sub_id") % 9 == 0, "failed").otherwise("ok"),
        "cost_ms": F.col("duration_seconds") * 300, "tokens": F.col("duration_seconds") * 2,
        "ai_circuit_open": F.col("sub_id") % 10 == 3})


def lecture_keys(load):
    """The run of every lecture, new or not: a cheap upper bound of a run's size."""
    return load("lectures").select((F.col("course_id") % 25).alias("account_id"), F.year("lecture_date").cast("bigint").alias("run"))


def decisions(load):
    return admission.budget_admission(candidates(load), ["account_id", "run"], max_lectures=20, max_tokens=0,
                                      opening=load("opening_usage"), sized_by=lecture_keys(load))


@query("apply_rules", f"""
WITH {RULED}
SELECT course_id, sub_id, CAST(lecture_date AS VARCHAR) AS lecture_date, has_playback, duration_seconds, has_rule,
       discovery_only, priority, subtitle_mode, ocr, summary, chapters, max_lecture_minutes FROM ruled""")
def _(load):
    return ruled(load).withColumn("lecture_date", F.col("lecture_date").cast("string"))


@query("discover_new", f"WITH {RULED} SELECT course_id, sub_id, priority, discovery_only FROM fresh")
def _(load):
    return courses.discover_new(ruled(load), load("seen")).select("course_id", "sub_id", "priority", "discovery_only")


@query("seen_state", "SELECT DISTINCT course_id, sub_id FROM $seen")
def _(load):
    return courses.seen_state(load("seen"))


@query("needs_ai", """
SELECT course_id % 25 AS account_id, bool_or(NOT coalesce(discovery_only, true) AND
       (coalesce(subtitle_mode, 'fast') = 'standard' OR coalesce(summary, false) OR coalesce(chapters, false))) AS needs_ai
FROM $rules GROUP BY 1""")
def _(load):
    return admission.rules_need_ai(load("rules").withColumn("account_id", F.col("course_id") % 25), ["account_id"])


@query("requested_outputs", """
SELECT course_id, 'subtitle' || CASE WHEN ocr THEN ',ocr' ELSE '' END || CASE WHEN summary THEN ',summary' ELSE '' END
       || CASE WHEN chapters THEN ',chapters' ELSE '' END AS outputs FROM $rules""")
def _(load):
    return load("rules").select("course_id", F.concat_ws(",", admission.requested_outputs()).alias("outputs"))


@query("candidate_order", f"""
WITH {RULED}
SELECT account_id, run, sub_id, row_number() OVER (PARTITION BY account_id, run
  ORDER BY priority DESC, lecture_date, CAST(sub_id AS VARCHAR), course_id) - 1 AS position FROM cand""")
def _(load):
    return admission.candidate_order(candidates(load), ["account_id", "run"], sized_by=lecture_keys(load)).select(
        "account_id", "run", "sub_id", "position")


@query("budget_admission", f"""
WITH RECURSIVE {ADMITTED} SELECT account_id, run, sub_id, decision FROM run_rows WHERE n > 0""")
def _(load):
    return decisions(load).select("account_id", "run", "sub_id", "decision")


@query("run_counts", f"""
WITH RECURSIVE {ADMITTED},
soon AS (
  SELECT account_id, count(*) AS n FROM (
    SELECT account_id, name, expired, CASE WHEN event_id % 11 = 2 THEN at_us // 1000000 * 1000000 - 28800000000
                                           WHEN event_id % 11 > 2 THEN at_us // 1000000 * 1000000 END AS expires_us FROM $snapshots)
  WHERE name LIKE 'result-%' AND NOT expired AND expires_us > 1705000000000000 AND expires_us <= 1705000000000000 + 259200000000 GROUP BY 1)
SELECT account_id, run, coalesce((SELECT n FROM soon WHERE soon.account_id = run_rows.account_id), 0) AS expiring_results, count(*) AS discovered, count(*) FILTER (decision = 'processed') AS processed,
       count(*) FILTER (decision = 'failed') AS failed, count(*) FILTER (decision LIKE 'deferred%') AS deferred
FROM run_rows WHERE n > 0 GROUP BY ALL""")
def _(load):
    soon = health.expiring_soon(load("snapshots"), F.lit(1705000000000000), "result-")
    return admission.run_counts(decisions(load), ["account_id", "run"], soon, ["account_id"])


@query("run_code", f"""
WITH RECURSIVE {ADMITTED},
codes AS (SELECT account_id, run, n, CASE decision WHEN 'deferred_budget' THEN 'budget_exhausted'
            WHEN 'deferred_circuit' THEN 'deepseek_circuit_open'
            WHEN 'failed' THEN CASE WHEN sub_id % 2 = 0 THEN 'deepseek_transient' ELSE 'cloud_processing_failed' END END AS code
          FROM run_rows),
last AS (SELECT account_id, run, coalesce(arg_max(code, n) FILTER (code IS NOT NULL), 'cloud_daily_completed') AS code
         FROM codes GROUP BY ALL)
SELECT *, code IN ('cloud_daily_completed', 'budget_exhausted', 'deepseek_transient', 'deepseek_circuit_open') AS success
FROM last""")
def _(load):
    errors = F.when(F.col("sub_id") % 2 == 0, admission.AI_TRANSIENT).otherwise("")
    codes = admission.with_rank(decisions(load).withColumn("error_code", errors)).withColumn(
        "code", admission.decision_code())
    return admission.run_code(codes, ["account_id", "run"], admission.ORDER)


@query("daily_ledger", """
SELECT key_id, CAST(CAST(make_timestamp(at_us + 28800000000) AS DATE) AS VARCHAR) AS day,
       count(*) FILTER (outcome = 'ok') AS lectures, CAST(sum(event_id % 1000) AS BIGINT) AS cost_ms,
       CAST(sum(greatest(tokens, 0)) AS BIGINT) AS tokens
FROM $attempts GROUP BY ALL""")
def _(load):
    usage = load("attempts").withColumns({
        "lectures": F.when(F.col("outcome") == "ok", 1).otherwise(0), "cost_ms": F.col("event_id") % 1000})
    return admission.daily_ledger(usage, ["key_id"])


@query("token_usage", """
SELECT key_id, CAST(sum(greatest(tokens, 0)) AS BIGINT) AS prompt_tokens,
       CAST(sum(greatest(tokens - 100, 0)) AS BIGINT) AS completion_tokens,
       CAST(sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE greatest(tokens, 0) END) AS BIGINT) AS total_tokens
FROM $attempts GROUP BY key_id""")
def _(load):
    usage = load("attempts").select("key_id", F.col("tokens").alias("prompt_tokens"),
                                    (F.col("tokens") - 100).alias("completion_tokens"),
                                    F.when(F.col("event_id") % 5 != 0, F.col("tokens")).alias("total_tokens"))
    return health.token_usage(usage, ["key_id"], ("prompt_tokens", "completion_tokens", "total_tokens"))


# Brute force over each key's trailing day, with the restarts found by lookup.
@query("ai_circuit", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY at_us, event_id) AS n FROM $attempts
           WHERE outcome IN ('ok', 'transient', 'auth_failed')),
s AS (SELECT x.key_id, x.n, max(CASE WHEN y.outcome = 'ok' AND y.n < x.n THEN y.n + 1
                                     WHEN y.outcome = 'auth_failed' THEN y.n END) AS since
      FROM a x LEFT JOIN a y ON y.key_id = x.key_id AND y.n <= x.n GROUP BY ALL),
c AS (SELECT x.key_id, x.event_id, x.at_us, x.outcome,
             count(y.n) FILTER (y.outcome <> 'ok') AS recent
      FROM a x JOIN s ON s.key_id = x.key_id AND s.n = x.n
      LEFT JOIN a y ON y.key_id = x.key_id AND y.n <= x.n AND y.n >= coalesce(s.since, 0)
                    AND x.at_us - y.at_us < 86400000000
      GROUP BY ALL)
SELECT key_id, event_id, at_us, outcome,
  CASE WHEN outcome = 'ok' THEN 'closed' WHEN outcome = 'auth_failed' OR recent >= 5 THEN 'open' ELSE 'degraded' END AS state,
  CASE WHEN outcome = 'ok' THEN 0 ELSE recent END AS failures,
  CASE WHEN outcome = 'transient' AND recent >= 5 THEN at_us + 21600000000 ELSE 0 END AS retry_after_us,
  CASE outcome WHEN 'ok' THEN '' WHEN 'auth_failed' THEN 'deepseek_auth_failed' ELSE 'deepseek_transient' END AS last_error_code
FROM c""")
def _(load):
    return health.ai_circuit(load("attempts"), ["key_id"])


@query("auth_circuit", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY at_us, event_id) AS n FROM $attempts
           WHERE outcome IN ('ok', 'transient', 'auth_failed')),
e AS (SELECT *, count(*) FILTER (outcome = 'ok') OVER (PARTITION BY key_id ORDER BY n) AS epoch FROM a),
f AS (SELECT *, count(*) FILTER (outcome = 'auth_failed') OVER (PARTITION BY key_id, epoch ORDER BY n) AS auth_failures,
             count(*) FILTER (outcome = 'transient') OVER (PARTITION BY key_id, epoch ORDER BY n) AS platform_failures FROM e)
SELECT key_id, event_id, outcome, auth_failures, platform_failures,
       CASE WHEN auth_failures = 0 THEN 'closed' WHEN auth_failures >= 3 THEN 'open' ELSE 'degraded' END AS auth_state,
       CASE WHEN platform_failures = 0 THEN 'closed' ELSE 'degraded' END AS platform_state FROM f""")
def _(load):
    return health.auth_circuit(load("attempts"), ["key_id"])


@query("recent_failures", """
SELECT key_id, event_id, outcome, nth FROM (
  SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY at_us DESC, event_id DESC) AS nth FROM $attempts
  WHERE outcome IN ('transient', 'auth_failed')) WHERE nth <= 5""")
def _(load):
    return health.recent_failures(load("attempts"), ["key_id"]).select("key_id", "event_id", "outcome", "nth")


@query("ai_failure_kind", """
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN 'deepseek_auth_failed' ELSE 'deepseek_transient' END AS code FROM events""")
def _(load):
    message = F.expr("""CASE event_id % 4 WHEN 0 THEN 'AI request returned HTTP 401' WHEN 1 THEN 'x HTTP 403'
        WHEN 2 THEN 'the encrypted job does not contain an AI API key' ELSE 'AI request returned HTTP 500' END""")
    return load("events").select("event_id", health.ai_failure_kind(message).alias("code"))


@query("pipeline_metrics", """
WITH c AS (SELECT o_custkey AS task_id, count(*) AS chunks, sum(o_orderkey % 600000) AS duration_ms,
                  sum(o_orderkey % 7 * 1000) AS elapsed_ms FROM orders GROUP BY 1),
s AS (SELECT user_id AS task_id, count(*) AS n FROM events GROUP BY 1),
p AS (SELECT page_id % 300 AS task_id, count(*) AS n FROM pages GROUP BY 1)
SELECT c.task_id, chunks, CAST(duration_ms AS BIGINT) AS duration_ms, CAST(elapsed_ms AS BIGINT) AS elapsed_ms,
       coalesce(s.n, 0) AS transcript_segments, coalesce(p.n, 0) AS ppt_pages,
       round(duration_ms / nullif(elapsed_ms, 0), 3) AS speed
FROM c LEFT JOIN s USING (task_id) LEFT JOIN p USING (task_id)""")
def _(load):
    chunks = load("orders").select(F.col("o_custkey").alias("task_id"), (F.col("o_orderkey") % 600000).alias("duration_ms"),
                                   (F.col("o_orderkey") % 7 * 1000).alias("elapsed_ms"))
    segments = load("events").select(F.col("user_id").alias("task_id"))
    pages = load("pages").select((F.col("page_id") % 300).alias("task_id"))
    return health.pipeline_metrics(chunks, segments, pages, ["task_id"])


@query("expiring_soon", """
WITH t AS (SELECT *, CASE WHEN event_id % 11 = 2 THEN at_us // 1000000 * 1000000 - 28800000000
                          WHEN event_id % 11 > 2 THEN at_us // 1000000 * 1000000 END AS expires_us FROM $snapshots)
SELECT event_id, name, expires_us FROM t
WHERE name LIKE 'result-%' AND NOT expired AND expires_us > 1705000000000000
  AND expires_us <= 1705000000000000 + 259200000000""")
def _(load):
    now = F.lit(1705000000000000)
    return health.expiring_soon(load("snapshots"), now, "result-").select("event_id", "name", "expires_us")


@query("latest_snapshot", """
SELECT account_id, arg_max(name, struct_pack(a := at_us, b := event_id)) AS latest, count(*) - 1 AS to_delete
FROM $snapshots WHERE name LIKE 'result-%' AND NOT expired GROUP BY account_id""")
def _(load):
    from ..sources import snapshots
    return snapshots.latest(load("snapshots"), ["account_id"], "result-", ["at_us", "event_id"])


@query("snapshot_retention", """
SELECT account_id, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY at_us DESC, event_id DESC) AS r FROM $snapshots
  WHERE name LIKE 'result-%' AND NOT expired) WHERE r > 1""")
def _(load):
    from ..sources import snapshots
    return snapshots.superseded(load("snapshots"), ["account_id"], "result-", ["at_us", "event_id"]).select(
        "account_id", "event_id")
