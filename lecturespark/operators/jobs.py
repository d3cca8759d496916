"""Checking, routing and reconciling jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import strict_base64
from ..functions.model_json import field, shape_of, strip, truthy
from ..functions.text import first_present

# Versions, kinds and limits of a job.
SCHEMA = "job.v2"
PROTOCOL_VERSION = "2"
KINDS = ("echo", "subtitle", "summary", "chapters", "learning_pack")
PROVIDER = "runner-session-v1"
SKEW_SECONDS = 120
LIFETIME_SECONDS = 30 * 60
KEY_BYTES = 32
ACCOUNT_CHARS, PASSWORD_CHARS = 64, 512
SLIDE_OUTPUTS = ("ocr", "summary", "chapters")


def _shape_rules(document: str) -> list[tuple[Column, str]]:
    """What the parts of a job document must be; missing and empty parts are fine, a text that is no JSON is not."""
    root = F.try_parse_json(document)
    part = lambda of, name: field(of, name, "variant")
    payload, outputs = part(root, "payload"), part(root, "requested_outputs")
    media = part(payload, "media")
    items = F.try_variant_get(outputs, "$", "array<variant>")
    texts = F.forall(items, lambda v: F.schema_of_variant(v) == "STRING")
    media_set = media.isNotNull() & (shape_of(media) != "void")
    return [
        (root.isNull() | (truthy(payload) & (shape_of(payload) != "object")), "job payload must be an object"),
        (truthy(outputs) & ~F.coalesce(texts, F.lit(False)), "requested_outputs must be a string list"),
        (media_set & (shape_of(media) != "object"), "media must be an object"),
    ]


def job_error(now: Column, document: str | None = None) -> Column:
    """The first rule a job breaks, or null; ``document`` names the column of the job's JSON text, whose shape is checked too.

    Columns: schema, task_id, protocol_version, job_kind, created_at, expires_at,
    result_public_key, start_seconds, duration_seconds, provider, course_id, sub_id,
    wants_media, wants_slides, account, password, input_hash, expected_hash.
    """
    c = F.col
    text = lambda name: F.coalesce(c(name).cast("string"), F.lit(""))
    created, expires = first_present("created_at"), first_present("expires_at")
    key = strict_base64(text("result_public_key"))
    session = c("provider").isNotNull()
    checks = (
        (text("schema") != SCHEMA, "job schema must be job.v2"),
        (~F.lower(strip(text("task_id"))).rlike(r"\A[0-9a-f]{32}\z"), "task_id must be a 32-character lowercase UUID hex value"),
        (text("protocol_version") != PROTOCOL_VERSION, "unsupported protocol version"),
        (~text("job_kind").isin(*KINDS), "unsupported job kind"),
        ((created <= 0) | (expires <= created), "invalid job validity window"),
        (expires - created > LIFETIME_SECONDS, "job validity window is too long"),
        (created > now + SKEW_SECONDS, "job was created in the future"),
        (expires < now - SKEW_SECONDS, "job has expired"),
        (key.isNull(), "result_public_key is not valid base64"),
        (F.length(key) != KEY_BYTES, "result_public_key has the wrong length"),
        *(_shape_rules(document) if document else []),
        (first_present("start_seconds") < 0, "media.start_seconds cannot be negative"),
        (F.coalesce(c("duration_seconds") <= 0, F.lit(False)), "media.duration_seconds must be positive"),
        (session & (c("provider") != PROVIDER), "source_session provider is unsupported"),
        (session & ~text("course_id").rlike(r"\A\d+\z"), "source_session course_id is invalid"),
        (session & ~text("sub_id").rlike(r"\A\d+\z"), "source_session sub_id is invalid"),
        (session & ~F.coalesce(c("wants_media"), F.lit(False)) & ~F.coalesce(c("wants_slides"), F.lit(False)),
         "source_session requested no resources"),
        (session & (~F.length(text("account")).between(1, ACCOUNT_CHARS) | ~F.length(text("password")).between(1, PASSWORD_CHARS)),
         "source_session credentials are invalid"),
        (text("input_hash") != c("expected_hash"), "job input_hash does not match its payload"),
    )
    error = F.when(checks[0][0], checks[0][1])
    for broken, reason in checks[1:]:
        error = error.when(broken, reason)
    return error


def validate_jobs(jobs: DataFrame, now: Column, document: str | None = None) -> DataFrame:
    """Add ``error``; the credentials end here."""
    return jobs.withColumn("error", job_error(now, document)).drop("account", "password", "expected_hash")


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where("error IS NULL").drop("error")


def quarantine(validated: DataFrame) -> DataFrame:
    return validated.where("error IS NOT NULL")


def slide_outputs(requested: str = "requested_outputs") -> Column:
    """The requested outputs that need slides."""
    return F.array_intersect(F.coalesce(F.col(requested), F.array().cast("array<string>")),
                             F.array(*[F.lit(o) for o in SLIDE_OUTPUTS]))


def route_outputs(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per step a job runs; an unsupported kind runs none.

    Columns: job_kind, requested_outputs and has_slides.
    """
    kind, asked = F.col("job_kind"), F.coalesce("requested_outputs", F.array().cast("array<string>"))
    pack = kind == "learning_pack"
    notes = kind.isin("summary", "chapters")
    wants = lambda name: pack & F.array_contains(asked, name)
    slides = F.coalesce("has_slides", F.lit(False)) & (notes | (pack & (F.size(slide_outputs()) > 0)))
    steps = (
        (kind == "echo", "echo"), ((kind == "subtitle") | wants("subtitle"), "subtitle"), (wants("answer"), "answer"),
        (slides, "slides"), (notes | wants("ocr"), "output:ppt_pages"),
        (notes | wants("summary") | wants("chapters"), "summarise"),
        ((kind == "summary") | wants("summary"), "output:summary"),
        ((kind == "chapters") | wants("chapters"), "output:chapters"),
    )
    names = F.array_compact(F.array(*[F.when(on, F.lit(name)) for on, name in steps]))
    return jobs.select(*keys, F.explode(names).alias("step"))


def resume_windows(windows: DataFrame, done: DataFrame, checkpoints: DataFrame, keys: list[str]) -> DataFrame:
    """Windows still to do; a checkpoint of another mode stops the job instead."""
    left = windows.join(done.select(*keys, "window_id").distinct(), [*keys, "window_id"], "left_anti")
    checked = left.join(checkpoints, keys, "left")
    differs = F.col("checkpoint_mode").isNotNull() & (F.col("checkpoint_mode") != F.col("mode"))
    return checked.withColumn("status", F.when(differs, "checkpoint_mode_mismatch").otherwise("todo")).drop("checkpoint_mode")


def reconcile_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Results against their jobs: ok, the field that differs, orphan, or missing.

    A left join of the results, which Spark can split when one task holds very many,
    and the jobs without a result.
    """
    expected = jobs.select("task_id", F.col("input_hash").alias("expected_hash"), F.col("job_kind").alias("expected_kind"))
    joined = results.join(expected, "task_id", "left")
    status = (
        F.when(F.col("expected_hash").isNull(), "orphan")
        .when(F.coalesce("input_hash", F.lit("")) != F.col("expected_hash"), "input_hash_mismatch")
        .when(~F.coalesce(F.col("job_kind").isin(*KINDS), F.lit(False)), "job_kind_invalid")
        .when(F.col("job_kind") != F.col("expected_kind"), "job_kind_mismatch").otherwise("ok"))
    seen = joined.select("task_id", "result_id", status.alias("status"))
    missing = jobs.join(results.select("task_id").distinct(), "task_id", "left_anti").select(
        "task_id", F.lit(None).cast(results.schema["result_id"].dataType).alias("result_id"), F.lit("missing").alias("status"))
    return seen.unionByName(missing)


def materialise_sources(jobs: DataFrame, media: DataFrame, slides: DataFrame, on: list[str]) -> DataFrame:
    """Jobs with the media they asked for and how many slides wait for them.

    The slides themselves stay rows (``requested_slides``); a lecture's list is never
    put into one value.
    """
    counts = slides.groupBy(*on).agg(F.count(F.lit(1)).alias("_slides"))
    joined = jobs.join(media, on, "left").join(counts, on, "left")
    return joined.withColumns({
        "media_url": F.when(F.col("wants_media"), F.col("media_url")),
        "slides": F.when(F.col("wants_slides"), F.coalesce("_slides", F.lit(0))).otherwise(0).cast("bigint"),
    }).drop("_slides", "account", "password")


def requested_slides(jobs: DataFrame, slides: DataFrame, on: list[str]) -> DataFrame:
    """The slides that any job asked for, once per lecture whatever the number of jobs.

    A job finds its slides by lecture; pairs of jobs and slides are never written out.
    """
    return slides.join(jobs.where("wants_slides").select(*on).distinct(), on, "left_semi")
