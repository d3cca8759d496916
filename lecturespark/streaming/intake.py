"""Discovery, ledgers and results as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.admission import daily_ledger
from ..operators.courses import discover_new
from ..sources import seen as known_pairs
from ..sources.jobs import write_results
from .sinks import drain


def drain_discovery(lectures: DataFrame, seen: DataFrame, folder: str, buckets: int | None = None) -> DataFrame:
    """New playable lectures, each (course, lecture) pair once: runs to the end of the input and reads all that were found.

    A pair stays known for ever. Known pairs are rows of a bucketed table, not state: a
    micro-batch is compared with them bucket by bucket and adds its own, so memory follows
    the batch. ``seen`` is added once, before the first batch. Results and pairs carry the batch's number, and a batch
    looks at pairs of earlier ones only, so it repeats exactly if it runs again. A lecture without
    a course is found in every batch that names it.
    """
    spark = lectures.sparkSession
    table = known_pairs.seen_table(spark, f"{folder}/seen", lectures, buckets)
    if spark.table(table).isEmpty():
        known_pairs.remember(seen.select(*known_pairs.KEYS).distinct(), table, -1)

    def find(batch: DataFrame, batch_id: int) -> None:
        session, results = batch.sparkSession, f"{folder}/table/batch={batch_id}"
        fresh = discover_new(batch, known_pairs.known(session, table, before=batch_id))
        fresh.dropDuplicates(known_pairs.KEYS).write.mode("overwrite").parquet(results)
        known_pairs.remember(session.read.schema(batch.schema).parquet(results), table, batch_id)

    drain(spark, lectures.writeStream.foreachBatch(find), f"{folder}/checkpoint")
    return spark.read.schema(lectures.schema).parquet(f"{folder}/table")


def ledger_stream(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Use per key and Shanghai day (update mode).

    Use counts however late it comes, so there is no watermark: the state keeps one row per
    key and day, as the ledger itself does, spread over the cluster by both.
    """
    return daily_ledger(usage, keys)


def resume_results(results: DataFrame, path: str, checkpoint: str, order: str) -> None:
    """Store results of a stream; after a stop the next call goes on where it was.

    The checkpoint remembers the input that is done, and the sink ignores work it has
    already stored, so a batch that runs twice adds nothing.
    """
    store = results.writeStream.foreachBatch(lambda batch, _: write_results(batch, path, order))
    drain(results.sparkSession, store, checkpoint)
