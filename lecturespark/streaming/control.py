"""Live status and progress as messages arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.messages import SEND_EVERY_US, sanitise_progress, send_step


def _in_order(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch; the source's batch limit bounds them."""
    return pd.concat(list(frames), ignore_index=True).sort_values(order, ignore_index=True)


def latest_status(messages: DataFrame, columns: list[str]) -> DataFrame:
    """The one live status of each task: the payload of its highest sequence (update mode)."""
    newest = messages.groupBy("task_id").agg(
        F.max("sequence").alias("sequence"), F.max_by(F.struct(*columns), "sequence").alias("_p"))
    return newest.select("task_id", "sequence", "_p.*")


_SENT = ["task_id", "arrival", "at_us", "stage", "status", "completed", "total", "error_code"]
LIFETIME_US = 30 * 60 * 1_000_000  # of a job


def _throttle(lifetime_us: int):
    # State: last sent stage, status, time and progress; the latest message as sent columns.
    number = lambda v: None if pd.isna(v) else int(v)

    def beats(sent: list, latest: list, before: int) -> Iterator[tuple]:
        """The latest message again after each 15 s without one sent, up to a time and the end of the job's life."""
        while sent[2] + SEND_EVERY_US < before and sent[2] + SEND_EVERY_US <= latest[1] + lifetime_us:
            sent[:] = [latest[2], latest[3], sent[2] + SEND_EVERY_US, latest[4] or 0]
            yield (latest[0], sent[2], *latest[2:], True)

    def throttle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent, latest = (list(state.get[:4]), list(state.get[4:])) if state.exists else (None, None)
        watermark = state.getCurrentWatermarkMs()
        out = []
        if state.hasTimedOut:
            out += beats(sent, latest, watermark * 1000)
        else:
            rows = _in_order(frames, ["at_us", "arrival"])
            steps, done = rows["step"].fillna(-1), rows["completed"].fillna(0)
            for row, step, done_now in zip(rows[_SENT[1:]].itertuples(index=False, name=None), steps, done):
                arrival, at, stage, status, completed, total, error = row
                if sent is not None:
                    out += beats(sent, latest, at)
                latest_at = latest[1] if latest else at
                latest = [int(arrival), int(at), stage, status, number(completed), number(total), error]
                if sent is None or at - latest_at > lifetime_us or [stage, status] != sent[:2] or at - sent[2] >= SEND_EVERY_US or (
                        step > 0 and done_now - sent[3] >= step):
                    sent = [stage, status, int(at), int(done_now)]
                    out.append((*latest, False))
        due = (sent[2] + SEND_EVERY_US) // 1000
        if latest[1] + lifetime_us < watermark * 1000:
            state.remove()  # what comes now is later than the job lives, and a first message again
        else:
            state.update((*sent, *latest))
            state.setTimeoutTimestamp(max(due, watermark + 1))
        frame = pd.DataFrame(out, columns=[*_SENT[1:], "beat"])
        frame.insert(0, "task_id", key[0])
        yield frame

    return throttle


def throttle_live(messages: DataFrame, late: str = "10 minutes", lifetime_us: int = LIFETIME_US) -> DataFrame:
    """Send on progress that matters, and the latest message again after every 15 s of silence.

    Columns of the message, its time or that of the repetition as ``at_us``, and ``beat`` for
    repetitions. Time is the messages' own: repetitions are due when the watermark has passed
    them, or when the task's next message shows that they were, so a replay in any batches gives
    the same rows. Silence ends ``lifetime_us`` after a task's last message, and its state with it.
    A message more than ``late`` behind the newest of all tasks comes too late to be judged and is
    dropped by the engine. A task's messages of one micro-batch are sorted in one task, so the
    source's batch limit bounds them; ``carried.throttle_progress`` takes batches of any size,
    without repetitions.
    """
    rows = sanitise_progress(messages).withColumn("step", send_step()).withColumn("at", F.timestamp_micros("at_us"))
    rows = rows.withWatermark("at", late).select(*_SENT, "step", "at")
    fields = ("task_id BIGINT, arrival BIGINT, at_us BIGINT, stage STRING, status STRING, completed BIGINT, "
              "total BIGINT, error_code STRING")
    state = ("sent_stage STRING, sent_status STRING, sent_at BIGINT, sent_done BIGINT, arrival BIGINT, at_us BIGINT, "
             "stage STRING, status STRING, completed BIGINT, total BIGINT, error_code STRING")
    return rows.groupBy("task_id").applyInPandasWithState(
        _throttle(lifetime_us), f"{fields}, beat BOOLEAN", state, "append", GroupStateTimeout.EventTimeTimeout)
