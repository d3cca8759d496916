"""Message parts, control sequences and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import strict_base64
from ..functions.model_json import json_value, shape_of, strip
from ..session import as_table, materialise
from .chains import first_at_least, walked
from .scan import OrderedRows, Running, list_positions, rows_of_large_keys

PART_CHARS = 48 * 1024
SMALLEST_PART = 1024
# Form of a message part, its first line and its second.
PART_HEAD = r"\A(?:job )?part (\d+)/(\d+)\z"
PART_PIECE = r"\A[A-Za-z0-9+/=]+\z"
# Kinds of control messages and states of progress.
CONTROL_KINDS = ("progress", "checkpoint", "refresh_request", "cancel_ack")
PROGRESS_STATES = ("running", "waiting", "failed", "completed")
SHORT_CHARS = 80
SEND_EVERY_US = 15 * 1_000_000
SEND_SHARE = 0.02
FOLD_ROWS = 1024


def split_parts(payloads: DataFrame, keys: list[str], column: str = "payload", size: int = PART_CHARS) -> DataFrame:
    """Payloads to base64 message parts of at most ``size`` characters."""
    if size < SMALLEST_PART:
        raise ValueError("size is too small")
    encoded = F.regexp_replace(F.base64(F.encode(column, "UTF-8")), r"\s", "")
    rows = payloads.select(*keys, F.encode(encoded, "UTF-8").alias("_b")).where(F.length("_b") > 0)
    starts = F.sequence(F.lit(1), F.length("_b"), F.lit(size))
    pieces = F.transform(starts, lambda at: F.decode(F.substring(F.col("_b"), at, F.lit(size)), "UTF-8"))
    cut = rows.select(*keys, F.size(starts).cast("bigint").alias("total"), F.posexplode(pieces).alias("_i", "piece"))
    return cut.select(*keys, (F.col("_i") + 1).cast("bigint").alias("part"), "total", "piece")


def part_rows(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Messages that are parts; the last message of a part number wins.

    The short first line is matched by itself, so that long texts are read once.
    """
    body = messages.select(*keys, "ord", strip(F.coalesce("body", F.lit(""))).alias("_body"))
    cut = F.instr("_body", "\n")
    lines = body.select(*keys, "ord", F.when(cut > 0, F.substring("_body", F.lit(1), cut - 1)).alias("_head"),
                        F.expr("substring(_body, instr(_body, char(10)) + 1)").alias("piece"))
    parts = lines.where(F.col("_head").rlike(PART_HEAD) & F.col("piece").rlike(PART_PIECE))
    number = lambda g: F.regexp_extract("_head", PART_HEAD, g).try_cast("bigint")
    return parts.groupBy(*keys, number(1).alias("part")).agg(
        F.max_by("piece", "ord").alias("piece"), F.min(number(2)).alias("low"), F.max(number(2)).alias("high"))


def part_status(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the parts of each task are complete, by counts alone."""
    counted = parts.groupBy(*keys).agg(
        F.min("low").alias("low"), F.max("high").alias("total"), F.count(F.lit(1)).alias("received"),
        F.min("part").alias("first"), F.max("part").alias("last"), F.sum(F.length("piece")).cast("bigint").alias("chars"))
    complete = (F.col("total") > 0) & (F.col("received") == F.col("total")) & (F.col("first") == 1) & (F.col("last") == F.col("total"))
    status = F.when(F.col("low") != F.col("total"), "part_count_mismatch").when(~complete, "incomplete").otherwise("complete")
    return counted.select(*keys, "total", "received", "chars", status.alias("status"))


def reassemble_parts(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Status of each task's message parts; ``complete_parts`` has the pieces, of any size."""
    return part_status(part_rows(messages, keys), keys)


def join_parts(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """The pieces of ``complete_parts`` as one ``payload`` per task, for payloads that the caller knows to fit a value."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "piece")))
    return pieces.groupBy(*keys).agg(F.concat_ws("", F.transform(ordered, lambda x: x["piece"])).alias("payload"))


def decode_payload(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Adds ``decode_status`` and ``document``: the JSON text of a base64 payload, which must be an object.

    A null payload, as of an incomplete task, has a null status.
    """
    data = strict_base64(F.col(column))
    read = payloads.withColumn("_bytes", data).withColumn("_text", F.when(F.is_valid_utf8(F.col("_bytes").cast("string")), F.col("_bytes").cast("string")))
    value = json_value("_text")
    status = (F.when(F.col(column).isNull(), None).when(F.col("_bytes").isNull(), "not_base64")
              .when(F.col("_text").isNull() | value.isNull(), "not_json").when(shape_of(value) != "object", "not_object").otherwise("ok"))
    return read.withColumn("decode_status", status).withColumn("document", F.when(F.col("decode_status") == "ok", F.col("_text"))).drop("_bytes", "_text")


def complete_parts(messages: DataFrame, keys: list[str]) -> DataFrame:
    """The ordered pieces of every complete task, of any size."""
    parts = part_rows(messages, keys)
    done = part_status(parts, keys).where("status = 'complete'").select(*keys)
    return parts.where("low = high").join(done, keys, "left_semi").select(*keys, "part", "piece")


def sequence_guard(messages: DataFrame, expected: DataFrame, keys: list[str], order: tuple[str, ...] = ("arrival",),
                   **options) -> DataFrame:
    """Accept control messages only in strictly rising sequence.

    ``expected`` has the right ``expected_hash`` of each task. A message of another
    hash or an unknown kind is refused before it could raise the sequence.
    """
    checked = messages.join(expected, keys, "left")
    genuine = F.coalesce(F.col("input_hash") == F.col("expected_hash"), F.lit(False))
    known = F.col("control_kind").isin(*CONTROL_KINDS)
    checked = checked.withColumn("_valid", genuine & known)
    rows = OrderedRows(checked, keys, list(order), **{"sized_by": messages, **options})
    rows = rows.running(_highest=Running("max", F.when(F.col("_valid"), F.col("sequence")), exclusive=True))
    status = (F.when(~genuine, "tampered").when(~known, "unknown_kind")
              .when(F.col("_highest").isNotNull() & (F.col("sequence") <= F.col("_highest")), "out_of_sequence")
              .otherwise("accepted"))
    return rows.result().withColumn("status", status).drop("_valid", "_highest", "expected_hash")


def sanitise_progress(messages: DataFrame) -> DataFrame:
    """Progress fields: known states, counts not below zero, whole texts and short forms beside them."""
    count = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0))).cast("bigint")
    return messages.withColumns({
        "error_code": F.coalesce("error_code", F.lit("")),
        "stage_short": F.substring("stage", 1, SHORT_CHARS), "error_code_short": F.substring(F.coalesce("error_code", F.lit("")), 1, SHORT_CHARS),
        "status": F.when(F.col("status").isin(*PROGRESS_STATES), F.col("status")).otherwise("running"),
        "completed": count("completed"), "total": count("total"),
    })


def send_step() -> Column:
    """Progress that is worth a message; null where the total is unknown."""
    share = F.floor(F.col("total") * F.lit(SEND_SHARE)).cast("bigint")
    return F.when(F.coalesce("total", F.lit(0)) > 0, F.greatest(F.lit(1).cast("bigint"), share))


def _folded(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The sent messages of runs that fit into one row each; the last one sent is what a step remembers."""
    columns = runs.columns
    rest = [c for c in columns if c not in (*keys, "_run", "at_us", "arrival")]
    whole = runs.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct("at_us", "arrival", *rest))).alias("_m"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("done"), F.filter("_m", lambda m: F.lit(False)).alias("sent"))

    def step(state: Column, m: Column) -> Column:
        progressed = F.coalesce(m["_done"] - state["done"] >= m["_step"], F.lit(False))
        send = m["_first"] | (m["at_us"] - state["at"] >= SEND_EVERY_US) | progressed
        return F.when(send, F.struct(m["at_us"].alias("at"), m["_done"].alias("done"), F.concat(state["sent"], F.array(m)).alias("sent"))).otherwise(state)

    sent = whole.select(*keys, "_run", F.explode(F.aggregate("_m", start, step, lambda state: state["sent"])).alias("_s"))
    return sent.select(*[F.col(c) if c in (*keys, "_run") else F.col(f"_s.{c}") for c in columns])


def _followed(runs: DataFrame, keys: list[str], **options) -> DataFrame:
    """The sent messages of runs of any length: each row's successor is looked up, and the walk from the first row marked."""
    # One column, whose parts may be null.
    group = ["_group"]
    runs = runs.withColumn("_group", F.struct(*keys, "_run"))
    rows = materialise(list_positions(runs, group, ["at_us", "arrival"], name="pos", **options))
    asks = materialise(rows.select(*group, "pos", "at_us", (F.col("at_us") + F.lit(SEND_EVERY_US)).alias("_late"), "_done",
                                   (F.col("_done") - F.col("_step")).alias("_worth")))
    later = first_at_least(asks, group, "at_us", "_late").unionByName(first_at_least(asks, group, "_worth", "_done"))
    steps = later.groupBy(*group, "pos").agg(F.min("next").alias("next"))
    sent = walked(steps, asks.where("pos = 0"), group)
    return rows.join(sent, [*group, "pos"], "left_semi").drop("_group", "pos")


def progress_throttle(messages: DataFrame, keys: list[str], force: str | None = None, fold_rows: int = FOLD_ROWS, **options) -> DataFrame:
    """The progress messages that are sent on.

    One is sent if it is the first, changes stage or status, comes 15 s or 2 % of
    the total after the last one sent, or if the column named by ``force`` is true. Whether it is sent depends on what was sent
    before, but not across every row: a message that differs in stage or status
    from the one right before it, or comes 15 s after it, is sent in any case. These
    rows cut a task into runs that no longer depend on each other. A run of up to
    ``fold_rows`` rows is folded in one row; in a longer one every message finds the next
    one that would be sent after it, and the walk from the first message is marked by
    doubling, so that a run of any length is spread over the cluster. Both give the same rows.
    """
    rows = OrderedRows(sanitise_progress(messages), keys, ["at_us", "arrival"], **{"sized_by": messages, **options})
    here = F.struct("at_us", "arrival", "stage", "status")
    rows = rows.running(_prev=Running("max", here, exclusive=True))
    prev = F.col("_prev")
    first = prev.isNull() | (prev["stage"] != F.col("stage")) | (prev["status"] != F.col("status")) | (
        F.col("at_us") - prev["at_us"] >= SEND_EVERY_US)
    if force:
        first = first | F.coalesce(F.col(force), F.lit(False))
    rows = rows.derive(_first=first)
    rows = rows.running(_run=Running("sum", F.col("_first").cast("bigint")))
    ready = rows.result().drop("_prev").withColumns({
        "_step": send_step(), "_done": F.coalesce("completed", F.lit(0)).cast("bigint")})
    # Only a key of so many rows can have such a run.
    long = None
    if rows_of_large_keys(messages, keys, fold_rows):
        ready = as_table(ready)
        long = materialise(ready.groupBy(*keys, "_run").count().where(F.col("count") > fold_rows).drop("count"))
        long = None if long.isEmpty() else long
    if long is None:
        sent = _folded(ready, keys)
    else:
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in (*keys, "_run")]
        part = lambda how: ready.alias("r").join(long.alias("l"), same, how)
        sent = _folded(part("left_anti"), keys).unionByName(_followed(part("left_semi"), keys, **options))
    return sent.drop("_first", "_run", "_step", "_done")
