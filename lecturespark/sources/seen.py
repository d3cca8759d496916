"""Pairs that are known for ever, in a table that joins without being shuffled."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
KEYS = ["course_id", "sub_id"]


def seen_table(spark: SparkSession, path: str, like: DataFrame, buckets: int | None = None) -> str:
    """The name of the table of known pairs at ``path``, defined for this session if it is not.

    It is bucketed by both columns, in as many buckets as shuffles have partitions, ``BUCKETS`` at
    least, so the rows that are compared with it go to its buckets and its own rows stay where they
    are. The number of buckets belongs to the data at ``path`` and must not change.
    """
    name = "seen_" + hashlib.sha256(path.encode()).hexdigest()[:24]
    n = buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = ", ".join(f"{c} {like.schema[c].dataType.simpleString()}" for c in KEYS)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, batch BIGINT) USING parquet CLUSTERED BY ({', '.join(KEYS)}) "
              f"SORTED BY ({', '.join(KEYS)}) INTO {n} BUCKETS LOCATION '{path}'")
    spark.catalog.refreshTable(name)
    return name


def known(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """The known pairs, of the batches before one if it is given."""
    rows = spark.table(table)
    return rows.select(*KEYS) if before is None else rows.where(F.col("batch") < before).select(*KEYS)


def remember(pairs: DataFrame, table: str, batch: int) -> None:
    """Add pairs. A batch that runs again may add them twice, which no comparison minds."""
    spark = pairs.sparkSession
    n = int(next(r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r["col_name"] == "Num Buckets"))
    rows = pairs.select(*KEYS).dropna().withColumn("batch", F.lit(batch).cast("bigint"))
    rows.repartition(n, *KEYS).sortWithinPartitions(*KEYS).write.insertInto(table)
