"""Named queries over the test tables, each next to its oracle SQL.

Input tables are written once as SQL that both engines accept; ``{ts_us}`` and
the like are the few spots where the dialects differ. In an oracle, ``$name``
stands for the input of that name as a subquery.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
INPUTS: dict[str, str] = {}
# Inputs whose rows take far more work than their bytes in the tables suggest.
SPREAD: set[str] = set()

SPARK_DIALECT = {
    "ts_us": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)",
    "sha256": "sha2",
    "sha_arg": ", 256",
    "b64": "replace(base64(encode(%s, 'UTF-8')), concat(char(13), char(10)), '')",
    "nl": "char(10)",
}
DUCK_DIALECT = {
    "ts_us": "epoch_us(ts)",
    "sha256": "sha256",
    "sha_arg": "",
    "b64": "to_base64(encode(%s))",
    "nl": "chr(10)",
}


def define_input(name: str, sql: str, spread: bool = False) -> None:
    INPUTS[name] = sql
    if spread:
        SPREAD.add(name)


def _b64(sql: str, template: str) -> str:
    return re.sub(r"\{b64:([^}]*)\}", lambda m: template % m.group(1), sql)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table dealt out evenly, for a table of few bytes is read in a few large tasks."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return table(spark, folder, name).repartition(parts)


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # A pattern, because a stream reads a single file only by one.
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parquet*")


def stream_in_batches(spark: SparkSession, folder: str, name: str, order: str, batches: int) -> DataFrame:
    """An input as a stream of ``batches`` micro-batches, by equal ranges of ``order``."""
    rows, path = load(spark, folder, name), f"{shared_dir(spark)}/stream-{name}-{uuid4().hex}"
    low, high = rows.agg(F.min(order), F.max(order)).first()
    width = -(-(high - low + 1) // batches)
    for n in range(batches):  # one after the other, as a source sorts its files by time
        part = rows.where((F.col(order) >= low + n * width) & (F.col(order) < low + (n + 1) * width))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def load(spark: SparkSession, folder: str, name: str, read=table) -> DataFrame:
    """An input table as a DataFrame; scans stay prunable."""
    sql = _b64(INPUTS[name], SPARK_DIALECT["b64"])
    if name in SPREAD and read is table:
        read = spread_table
    used = {t: read(spark, folder, t) for t in TABLES if "{" + t + "}" in sql}
    fixed = {k: v for k, v in SPARK_DIALECT.items() if k != "b64"}
    for key, value in fixed.items():
        sql = sql.replace("{" + key + "}", value)
    sql = sql.replace("{", "{{").replace("}", "}}")  # braces of JSON literals
    for t in used:
        sql = sql.replace("{{" + t + "}}", "{" + t + "}")
    return spark.sql(sql, **used)


def duck_input(name: str) -> str:
    sql = _b64(INPUTS[name], DUCK_DIALECT["b64"])
    for key, value in DUCK_DIALECT.items():
        if key != "b64":
            sql = sql.replace("{" + key + "}", value)
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def expand(sql: str) -> str:
    return re.sub(r"\$(\w+)", lambda m: "(" + duck_input(m.group(1)) + ")", sql)


def query(name: str, oracle: str | None = None):
    """Register ``f(load) -> DataFrame`` under ``name``; ``load(input)`` reads an input."""

    def register(build: Callable) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            def read(source: str) -> DataFrame:
                return load(spark, folder, source) if source in INPUTS else table(spark, folder, source)

            def stream(source: str, order: str | None = None, batches: int = 4) -> DataFrame:
                if order is not None:
                    return stream_in_batches(spark, folder, source, order, batches)
                if source in INPUTS:
                    return load(spark, folder, source, stream_table)
                return stream_table(spark, folder, source)

            read.spark, read.folder, read.stream = spark, folder, stream
            return build(read)

        run.__wrapped_module__ = build.__module__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = expand(oracle)
        return build

    return register
