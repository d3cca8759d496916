"""Running streams to the end of their input and storing what they update."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..session import shared_dir
from ..sources import generations


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def drain(spark: SparkSession, writer: DataStreamWriter, checkpoint: str, timers: bool = False) -> None:
    """Process all input there is, then stop; a later call goes on from the checkpoint.

    Batches without data are off, unless ``timers`` of event time wait for the last
    watermark. The query takes the setting when it starts.
    """
    before = spark.conf.get(NO_DATA_BATCHES)
    spark.conf.set(NO_DATA_BATCHES, str(timers).lower())
    try:
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(NO_DATA_BATCHES, before)
    query.awaitTermination()


def drain_to_parquet(stream: DataFrame, folder: str, timers: bool = False) -> DataFrame:
    """Append a stream to a table and read it back."""
    drain(stream.sparkSession, stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/table"),
          f"{folder}/checkpoint", timers)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def upsert_to(path: str, keys: list[str]):
    """A batch writer that keeps each batch's updates as a generation under its own number.

    A batch that runs again after a failure overwrites itself, so updates are stored
    exactly once. The batch that fills a tier merges it to the newest row of each key, so
    reading costs the current rows and a few folders, whatever the number of batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        generations.append(batch, path, batch_id, keys)
        generations.merge_tiers(batch.sparkSession, path, batch_id, generations.newest(keys))
        generations.forget(batch.sparkSession, path, batch_id)

    return write


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of each key."""
    rows = generations.read(spark, path, generations.cover(generations.spans(spark, path)))
    return generations.newest(keys)(rows).drop("bucket", "_batch")


def drain_updates(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Run an updating aggregation to the end of its input and read its current rows."""
    drain(stream.sparkSession, stream.writeStream.outputMode("update").foreachBatch(upsert_to(f"{folder}/table", keys)),
          f"{folder}/checkpoint")
    return latest_rows(stream.sparkSession, f"{folder}/table", keys)
