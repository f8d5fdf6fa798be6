"""State over a stream of events: sessions, cooldowns, deadlines, hourly sums.

The transforms are plain DataFrame operations, so they run on a table and, where
Structured Streaming has the operation, on a stream: hourly() with a watermark.
live_hourly() and live_sessions() are streaming queries over the same rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_S, COOLDOWN_S, DEADLINE_S = 600, 120, 6
#: What a kind of event does to a session's status.
STATUS = {"signup": "searching", "view": "scraping_done", "click": "llm_batch", "purchase": "wiped", "error": "searching"}


def _seconds(events: DataFrame) -> DataFrame:
    return events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)


def _status() -> Any:
    out = F.lit("searching")
    for kind, status in STATUS.items():
        out = F.when(F.col("event_type") == kind, status).otherwise(out)
    return out


def sessions(events: DataFrame, ttl: int = TTL_S) -> DataFrame:
    """(user_id, sessions, longest, last_status): a session ends when nothing happened for ``ttl`` seconds."""
    order = Window.partitionBy("user_id").orderBy("at", "event_id")
    gap = _seconds(events).withColumn("new", (F.coalesce(F.col("at") - F.lag("at").over(order), F.lit(float(ttl))) >= ttl).cast("int"))
    numbered = gap.withColumn("session", F.sum("new").over(order))
    each = numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.max_by(_status(), F.struct("at", "event_id")).alias("status"))
    return each.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), F.max_by("status", "session").alias("last_status"))


def cooldowns(events: DataFrame, cooldown: int = COOLDOWN_S) -> DataFrame:
    """(event_id, user_id, cooling): whether a user's last outcome is a failure less than ``cooldown`` seconds ago; a success clears it."""
    order = Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = _seconds(events).withColumn("last", F.max_by(F.struct("at", "event_type"), F.struct("at", "event_id")).over(order))
    return rows.select("event_id", "user_id", F.coalesce((F.col("last.event_type") == "error") & (F.col("at") - F.col("last.at") < cooldown), F.lit(False)).alias("cooling"))


def within_deadline(events: DataFrame, deadline: int = DEADLINE_S) -> DataFrame:
    """(minute, kept, dropped): events within ``deadline`` seconds of the first of their minute."""
    rows = _seconds(events).withColumn("minute", F.floor(F.col("at") / 60))
    first = rows.groupBy("minute").agg(F.min("at").alias("first"))
    late = F.col("at") - F.col("first") > deadline
    return rows.join(first, "minute").groupBy("minute").agg(F.count_if(~late).alias("kept"), F.count_if(late).alias("dropped"))


def count_or_timeout(events: DataFrame, most: int = 30, seconds: int = 5) -> DataFrame:
    """(user_id, batch, n, start): a batch opens with an event and closes at ``most`` events or ``seconds`` after it opened.

    A batch's end depends on where it began, so each user's events are folded in
    order; they come as a sorted stream, and state is one open batch. Events
    without a time are left out.
    """

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, number, n, start = None, 0, 0, 0.0
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * 4
            types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["user_id", "batch", "n", "start"])
            out.clear()
            return done

        for batch in batches:
            users, ats = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.r_[True, users[1:] != users[:-1], True]) if len(users) else np.zeros(1, int)
            for i, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if users[i] != user:
                    if n:
                        out.append((user, number, n, start))
                    user, number, n = int(users[i]), 0, 0
                while i < end:
                    if n and (n >= most or ats[i] - start > seconds):
                        out.append((user, number, n, start))
                        number, n = number + 1, 0
                    if not n:
                        start = float(ats[i])
                    taken = max(1, int(np.searchsorted(ats[i : min(end, i + most - n)] - start, seconds, side="right")))
                    n, i = n + taken, i + taken
            yield told()
        if n:
            out.append((user, number, n, start))
        yield told()

    rows = _seconds(events).where("at is not null and user_id is not null").select(F.col("user_id").cast("bigint"), "at", "event_id")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").select("user_id", "at").mapInArrow(folded, "user_id bigint, batch int, n bigint, start double")


def keep_tail(tail: int) -> Callable[[str, str], str]:
    """The step that keeps a report's last ``tail`` characters and adds the next text on a line of its own."""

    def step(report: str, text: str) -> str:
        return f"{report[-tail:] if tail else ''}\n{text}" if report else text

    return step


def folded_reports(batches: DataFrame, step: Callable[[str, str], str]) -> DataFrame:
    """(key, report, steps, stopped): batches (key, ord, text) folded in order by ``step`` (report so far, next text) -> report.

    A key's batches come as a sorted stream, and one report is in memory. Where
    a step raises, the report so far is the key's result, stopped is true, and
    its other batches are passed over. Batches of one ord go by their text; null
    texts are left out; a null key is a key.
    """

    def fold(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, report, steps, stopped, seen = None, "", 0, False, False
        out: list[tuple] = []
        for batch in arrived:
            names, texts = batch.column(0), batch.column(1)
            for i, own in enumerate(names.to_pylist()):
                if not seen or own != key:
                    if seen:
                        out.append((key, report, steps, stopped))
                    key, report, steps, stopped, seen = own, "", 0, False, True
                if stopped:
                    continue
                try:
                    report = step(report, texts[i].as_py())
                    steps += 1
                except Exception:  # whatever a reducer raises ends its key, not the query
                    stopped = True
            if out:
                yield told(out, names.type)
                out.clear()
        if seen:
            yield told([(key, report, steps, stopped)], names.type)

    def told(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = (kind, pa.string(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["key", "report", "steps", "stopped"])

    rows = batches.where("text is not null").select("key", "ord", F.col("text").cast("string").alias("text"))
    shape = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("report", T.StringType()), T.StructField("steps", T.LongType()), T.StructField("stopped", T.BooleanType())])
    return rows.repartition("key").sortWithinPartitions("key", "ord", "text").select("key", "text").mapInArrow(fold, shape)


def reports(batches: DataFrame, tail: int = 3000) -> DataFrame:
    """(key, report): batches (key, ord, text) folded in order, each step keeping the last ``tail`` characters and adding the next text."""
    return folded_reports(batches, keep_tail(tail)).select("key", "report")


def hourly(events: DataFrame) -> DataFrame:
    """(hour, event_type, n, total), hour in seconds."""
    rows = _seconds(events).withColumn("hour", F.floor(F.col("at") / 3600) * 3600)
    return rows.groupBy("hour", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def live_hourly(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """hourly() of a stream with event time ``ts``; rows later than ``late`` are dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.unix_seconds("window.start").alias("hour"), "event_type", "n", "total")


def live_sessions(stream: DataFrame, ttl: int = TTL_S, late: str = "10 minutes") -> DataFrame:
    """(user_id, events, status) whenever a user's session changes; it is wiped ``ttl`` seconds of event time after its last event."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            n, _ = held.get
            held.remove()
            yield pd.DataFrame({"user_id": [key[0]], "events": [n], "status": ["wiped"]})
            return
        n, status, last = (*held.get, 0) if held.exists else (0, "searching", 0)
        for frame in frames:
            frame = frame.sort_values(["ts", "event_id"])
            n += len(frame)
            status = STATUS.get(frame["event_type"].iloc[-1], "searching")
            last = max(last, int(frame["ts"].iloc[-1].timestamp() * 1000))
        held.update((n, status))
        held.setTimeoutTimestamp(max(last, held.getCurrentWatermarkMs()) + ttl * 1000)
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "status": [status]})

    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("user_id", "event_id", "ts", "event_type")
    return timed.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, events bigint, status string", "n bigint, status string", "update", GroupStateTimeout.EventTimeTimeout)
