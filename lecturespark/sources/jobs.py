"""Job records: reading, checking, routing and storing results."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import generations

# Everything of a job that later steps may see. Credentials are read for the
# check and never leave it.
JOB_SCHEMA = """schema STRING, protocol_version STRING, task_id STRING, job_kind STRING, created_at DOUBLE,
expires_at DOUBLE, input_hash STRING, result_public_key STRING, requested_outputs ARRAY<STRING>,
payload STRUCT<mode: STRING, title: STRING, query: STRING,
  media: STRUCT<start_seconds: DOUBLE, duration_seconds: DOUBLE>,
  source_session: STRUCT<provider: STRING, course_id: STRING, sub_id: STRING, media: BOOLEAN, slides: BOOLEAN>>,
pipeline STRUCT<version: STRING>,
secrets STRUCT<source_credentials: STRUCT<account: STRING, password: STRING>>"""


def read_jobs(texts: DataFrame, column: str = "job") -> DataFrame:
    """Typed job columns from JSON records, without the secrets."""
    return parse_jobs(texts, column).drop("secrets")


def parse_jobs(texts: DataFrame, column: str = "job") -> DataFrame:
    return texts.select(F.from_json(column, JOB_SCHEMA).alias("_j")).select("_j.*")


BLOOM = {"parquet.bloom.filter.enabled#input_hash": "true"}


def unstored(results: DataFrame, path: str, order: str) -> DataFrame:
    """The first of each ``input_hash`` whose result is not stored; only buckets that the hashes fall into are read."""
    rest = [c for c in results.columns if c != "input_hash"]
    first = results.groupBy("input_hash").agg(F.min_by(F.struct(*rest), order).alias("_r")).select("input_hash", "_r.*")
    first = first.withColumn("bucket", generations.bucket_of(["input_hash"]))
    spark = results.sparkSession
    stored = generations.read(spark, path, generations.cover(generations.spans(spark, path)), generations.buckets_in(results, ["input_hash"]))
    return first if stored is None else first.join(stored.select("bucket", "input_hash"), ["bucket", "input_hash"], "left_anti").select(*first.columns)


def write_results(results: DataFrame, path: str, order: str) -> None:
    """Append results whose ``input_hash`` is not stored yet.

    The hash names the work, not the attempt, so a repeated run adds nothing. Copies
    in one batch are reduced to the first before anything is compared. The store is
    partitioned by hash, with Bloom filters inside its files. Results are written aside and
    then claim the next number; a writer that finds the number taken compares again with
    what the other one has stored, so two writers never store one hash twice.
    """
    spark = results.sparkSession
    while True:
        found = generations.spans(spark, path)
        number = max((last for _, last in found), default=-1) + 1
        trial = f"{path}/_try-{uuid4().hex}"
        fresh = unstored(results, path, order).withColumn("_batch", F.lit(number).cast("bigint"))
        generations.write(fresh, path, (number, number), BLOOM, trial)
        if generations.claim(spark, trial, generations.folder(path, (number, number))):
            generations.merge_tiers(spark, path, number, lambda rows: rows, BLOOM, claimed=True)
            return


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All stored results."""
    return generations.read(spark, path, generations.cover(generations.spans(spark, path))).drop("bucket", "_batch")
