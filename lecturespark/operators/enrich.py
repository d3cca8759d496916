"""Calling a user's model over packed requests, each request once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

PIECE, PIECES_A_WAVE = 16, 512
ANSWERS = "digest STRING, response STRING, error STRING"
# A finished task's file is there at once and stays if the job fails later.
COMMIT = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}

Model = Callable[[str], str]


def request_digest(request: Column, model_name: str = "") -> Column:
    """What names a request and the model that answers it; null without a request."""
    return F.when(request.isNotNull(), F.sha2(F.concat(F.lit(f"{len(model_name)}:{model_name}:"), request), 256))


def logged_answers(spark: SparkSession, log: str) -> DataFrame:
    """(digest, response, error): one row a digest, an answer before an error."""
    try:
        rows = spark.read.schema(ANSWERS).parquet(log)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ANSWERS)
    best = rows.groupBy("digest").agg(F.min(F.struct(F.col("error").isNotNull().alias("failed"), "error", "response")).alias("a"))
    return best.select("digest", "a.response", "a.error")


def open_requests(requests: DataFrame, log: str, column: str = "request", model_name: str = "") -> DataFrame:
    """(digest, request): the distinct requests that the log has no answer for; logged errors are asked again."""
    asked = requests.select(request_digest(F.col(column), model_name).alias("digest"), F.col(column).alias("request"))
    distinct = asked.where("digest IS NOT NULL").groupBy("digest").agg(F.first("request").alias("request"))
    return distinct.join(logged_answers(requests.sparkSession, log).where("error IS NULL").select("digest"), "digest", "left_anti")


def _asking(make_model: Callable[[], Model]):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            answers = []
            for request in batch["request"]:
                model = model or make_model()
                try:
                    answers.append((model(request), None))
                except Exception as failure:  # noqa: BLE001 - the row reports it
                    answers.append((None, type(failure).__name__))
            yield pd.DataFrame({"digest": batch["digest"], "response": [a for a, _ in answers], "error": [e for _, e in answers]})

    return ask


def ask_open(requests: DataFrame, make_model: Callable[[], Model], log: str, *, column: str = "request", model_name: str = "",
             calls_at_once: int | None = None, piece: int = PIECE) -> None:
    """Answer the open requests and add the answers to the log.

    Requests are dealt by digest into waves of pieces of about ``piece`` requests. A piece is
    one task, whose answers are committed as a file of the log when it ends; a wave is one
    write job, of ``calls_at_once`` pieces if that is given. A lost executor costs the pieces it
    was at, a failed job those of its wave that had not ended; whatever the log has is not
    asked again. Calls in flight when a worker dies cannot be known, and a speculative copy of a
    task asks its piece again, so run paid models without speculation.
    """
    spark = requests.sparkSession
    todo = f"{shared_dir(spark)}/requests-{uuid4().hex}"
    open_requests(requests, log, column, model_name).write.parquet(todo)
    rows = spark.read.parquet(todo)
    pieces = -(-rows.count() // piece)
    at_once = min(pieces, calls_at_once or PIECES_A_WAVE)
    if not pieces:
        return
    waves = -(-pieces // at_once)
    if waves > 1:
        wave = F.pmod(F.xxhash64(F.lit("wave"), "digest"), F.lit(waves)).cast("int")
        rows.withColumn("wave", wave).repartition("wave").write.partitionBy("wave").parquet(f"{todo}-waves")
        rows = spark.read.parquet(f"{todo}-waves")
    for n in range(waves):
        own = rows.where(F.col("wave") == n).drop("wave") if waves > 1 else rows
        asked = own.select("digest", "request").repartition(at_once, "digest").mapInPandas(_asking(make_model), ANSWERS)
        asked.write.mode("append").options(**COMMIT).parquet(log)


def enrich_windows(requests: DataFrame, make_model: Callable[[], Model], *, column: str = "request", log: str | None = None,
                   model_name: str = "", calls_at_once: int | None = None, piece: int = PIECE) -> DataFrame:
    """Add ``response`` and ``error`` from a model that is called once for every distinct request.

    ``make_model`` runs once a task and returns the function that answers a request.
    ``calls_at_once`` bounds how many tasks, and so calls, there are at a time. Answers come from
    the ``log`` folder, keyed by digest (a new folder if none is given): requests that it
    answers are not asked, in this or any later run, and using the result twice asks nothing. A
    failed request keeps its row with the error's type, never its text, and is asked
    again by the next run. A null request has neither response nor error.
    """
    spark = requests.sparkSession
    log = log or f"{shared_dir(spark)}/answers-{uuid4().hex}"
    ask_open(requests, make_model, log, column=column, model_name=model_name, calls_at_once=calls_at_once, piece=piece)
    answers = logged_answers(spark, log).withColumnRenamed("digest", "_digest")
    named = requests.drop("response", "error").withColumn("_d", request_digest(F.col(column), model_name))
    return named.join(answers, F.col("_d") == F.col("_digest"), "left").drop("_d", "_digest")
