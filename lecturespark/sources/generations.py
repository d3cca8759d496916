"""Tables that grow by numbered batches without being read or rewritten whole.

Batch ``n`` writes one folder, ``gen=nton``, in hash buckets of the key. The batch that
fills a tier of ``FAN`` folders also writes what they hold together as one larger folder,
say ``gen=0to7``, so a row is rewritten once a tier and a reader opens at most ``FAN - 1``
folders a tier. Which folders count follows from their names: from the newest batch
backwards, always the widest one. A batch that runs again overwrites its own folders.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN, BUCKETS = 8, 64
Span = tuple[int, int]
# What a merge keeps of the rows of several folders; they carry the number of their batch in ``_batch``.
Combine = Callable[[DataFrame], DataFrame]


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folder(path: str, span: Span) -> str:
    return f"{path}/gen={span[0]}to{span[1]}"


def spans(spark: SparkSession, path: str) -> list[Span]:
    """All complete folders of the table."""
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    found = [tuple(map(int, m.groups())) for m in (re.fullmatch(r"gen=(\d+)to(\d+)", n) for n in names) if m]
    return [s for s in found if fs.exists(_place(spark, f"{folder(path, s)}/_SUCCESS")[1])]


def cover(found: list[Span], upto: int | None = None, since: int = 0) -> list[Span]:
    """The folders to read: disjoint, from batch ``upto`` (the newest, if not given) down to ``since``."""
    widest: dict[int, int] = {}
    for first, last in found:
        if first >= since and (upto is None or last <= upto):
            widest[last] = min(first, widest.get(last, first))
    out, below = [], None
    for last in sorted(widest, reverse=True):
        if below is None or last < below:
            below = widest[last]
            out.append((below, last))
    return out


def read(spark: SparkSession, path: str, chosen: list[Span], buckets: Sequence[int] | None = None) -> DataFrame | None:
    """The rows of some folders, of the given buckets only; None without a folder that has rows."""
    if not chosen:
        return None
    try:
        rows = spark.read.option("basePath", path).parquet(*[folder(path, s) for s in chosen]).drop("gen")
    except AnalysisException as empty:
        if empty.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return None
    return rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))


def buckets_in(rows: DataFrame, keys: Sequence[str]) -> list[int]:
    """The buckets that some rows touch: at most ``BUCKETS`` numbers."""
    return sorted(r["bucket"] for r in rows.select(bucket_of(keys).alias("bucket")).distinct().collect())


def write(rows: DataFrame, path: str, span: Span, options: dict[str, str] | None = None, place: str | None = None) -> None:
    """Write rows that have ``bucket`` as one folder, a task a bucket; small buckets share one."""
    rows.repartition("bucket").write.mode("overwrite").options(**(options or {})).partitionBy("bucket").parquet(place or folder(path, span))


def append(rows: DataFrame, path: str, batch: int, keys: Sequence[str], options: dict[str, str] | None = None) -> None:
    write(rows.withColumns({"bucket": bucket_of(keys), "_batch": F.lit(batch).cast("bigint")}), path, (batch, batch), options)


def newest(keys: Sequence[str]) -> Combine:
    """A merge that keeps each key's row of the newest batch."""

    def combine(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "bucket", "_batch")]
        last = rows.groupBy(*keys, "bucket").agg(F.max_by(F.struct(F.lit(0).alias("_one"), *rest), "_batch").alias("_v"), F.max("_batch").alias("_batch"))
        return last.select(*keys, *[f"_v.{c}" for c in rest], "bucket", "_batch")

    return combine


def merge_tiers(spark: SparkSession, path: str, batch: int, combine: Combine, options: dict[str, str] | None = None, claimed: bool = False) -> None:
    """Write the tiers that ``batch`` fills. ``claimed``: other writers may do the same, one of them wins."""
    size = FAN
    while (batch + 1) % size == 0:
        span = (batch + 1 - size, batch)
        found = spans(spark, path)
        rows = None if claimed and span in found else read(spark, path, cover([s for s in found if s != span], batch, span[0]))
        if rows is not None:
            trial = f"{path}/_try-{uuid4().hex}" if claimed else None
            write(combine(rows), path, span, options, trial)
            if trial:
                claim(spark, trial, folder(path, span))
        size *= FAN


def claim(spark: SparkSession, trial: str, target: str) -> bool:
    """Give a written folder its name unless another writer holds it; the rename is atomic where the file system's is."""
    jvm = spark._jvm
    how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    rename = spark.sparkContext._gateway.new_array(how, 1)
    rename[0] = how.NONE
    fs, source = _place(spark, trial)
    named = _place(spark, target)[1]
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, named, rename)
        return True
    except Exception:  # noqa: BLE001 - whatever the file system calls it, the name is taken or it is not
        if not fs.exists(named):
            raise
        fs.delete(source, True)
        return False


def forget(spark: SparkSession, path: str, batch: int) -> None:
    """Delete folders that a wider one of a batch before ``batch`` has replaced."""
    found = spans(spark, path)
    for first, last in found:
        if any(a <= first and last <= b < batch and (a, b) != (first, last) for a, b in found):
            fs, place = _place(spark, folder(path, (first, last)))
            fs.delete(place, True)
