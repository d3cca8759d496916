"""Joining catalogue, schedule, rules and earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import present
from ..sources.catalog import MAX_COURSES


def course_first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each course with the attributes of its first schedule row."""
    attributes = F.struct("title", "teacher", "department", "term")
    first = rows.groupBy(*keys, "course_id").agg(F.min_by(attributes, F.struct(*order)).alias("_a"))
    return first.select(*keys, "course_id", "_a.*")


def course_limit(courses: DataFrame, keys: list[str]) -> DataFrame:
    """Whether an account has more courses than one catalogue may hold."""
    counted = courses.groupBy(*keys).agg(F.count(F.lit(1)).alias("courses"))
    return counted.withColumn("status", F.when(F.col("courses") > MAX_COURSES, "too_many_courses").otherwise("ok"))


def schedule_durations(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last positive duration of each scheduled lecture."""
    known = rows.where("sub_id <> '' AND duration > 0")
    return known.groupBy(*keys, "course_id", "sub_id").agg(
        F.max_by("duration", F.struct(*order)).alias("scheduled_seconds"))


def override_durations(lectures: DataFrame, durations: DataFrame, on: list[str]) -> DataFrame:
    """Scheduled durations replace those of the catalogue."""
    joined = lectures.join(durations, on, "left")
    return joined.withColumn("duration_seconds", F.coalesce("scheduled_seconds", "duration_seconds")).drop("scheduled_seconds")


def verified_courses(candidates: DataFrame, details: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose detail could be read; term and department are the candidate's."""
    readable = details.where(F.col("code").isin(0, 200))
    return candidates.select(*keys, "course_id", "term", "department").join(readable, [*keys, "course_id"]).withColumn(
        "authorization_state", F.lit("verified")).drop("code")


def verification_status(candidates: DataFrame, details: DataFrame, keys: list[str]) -> DataFrame:
    """An account fails when it has candidates and none could be verified."""
    readable = details.where(F.col("code").isin(0, 200)).select(*keys, "course_id", F.lit(1).alias("_ok"))
    counted = candidates.join(readable, [*keys, "course_id"], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"), F.count("_ok").alias("verified"))
    return counted.withColumn("status", F.when(F.col("verified") == 0, "platform_course_request_failed").otherwise("ok"))


def apply_rules(courses: DataFrame, rules: DataFrame) -> DataFrame:
    """The last rule of each course; without one a course is discovery-only."""
    rest = [c for c in rules.columns if c not in ("course_id", "ord")]
    last = rules.groupBy("course_id").agg(F.max_by(F.struct(*rest), "ord").alias("_rule"))
    joined = courses.join(last, "course_id", "left")
    return joined.select(
        *courses.columns, F.col("_rule").isNotNull().alias("has_rule"),
        F.when(F.col("_rule").isNull(), True).otherwise(F.coalesce("_rule.discovery_only", F.lit(False))).alias("discovery_only"),
        F.coalesce("_rule.priority", F.lit(0)).cast("bigint").alias("priority"),
        *[F.col(f"_rule.{c}") for c in rest if c not in ("discovery_only", "priority")],
    )


def playable(lectures: DataFrame) -> DataFrame:
    """Lectures with a recording and an id."""
    return lectures.where(F.col("has_playback") & present(F.col("sub_id").cast("string"), "").isNotNull())


def discover_new(lectures: DataFrame, seen: DataFrame) -> DataFrame:
    """Playable lectures with an id that no earlier run has seen.

    ``seen`` may name a pair more than once. As ``sources.seen.known`` it stays where it is, and
    only the lectures are shuffled, to its buckets.
    """
    return playable(lectures).join(seen.select("course_id", "sub_id"), ["course_id", "sub_id"], "left_anti")


def seen_state(seen: DataFrame) -> DataFrame:
    """Every lecture seen so far, once per course."""
    return seen.select("course_id", "sub_id").distinct()
