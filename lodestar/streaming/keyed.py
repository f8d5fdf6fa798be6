"""State kept by key on a stream: sessions, a session store, batches by count or time, deadlines, first addresses.

Each processor here gives on a stream what its table form gives on a table. Rows
may come in any order within the watermark's delay: InOrder holds them until the
watermark has passed them, and hands them over in order of time and id. What a key
needs besides is one small value. Timers by event time close what is due when
nothing else comes. Everything lives in Spark's state store, so a query that is
started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import COOLDOWN_S, DEADLINE_S, STATUS, TTL_S

SECOND = 1_000_000
#: The state store that keeps values, lists and timers.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Rows (at in microseconds, id, word) of a key, in order; ``step`` takes one, ``due`` says when the value wants a timer.

    A batch's rows wait as one entry of arrays: each call of the state store costs more than a row does. A subclass gives HELD, the value's fields, and OUT, those of what it tells.
    """

    HELD = ""
    OUT = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.HELD)
        self.waiting = handle.getListState("waiting", "at array<bigint>, id array<bigint>, word array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        at, id_, word = zip(*((r.at, r.id, r.word) for r in rows), strict=True)
        self.waiting.appendValue((list(at), list(id_), list(word)))
        self.handle.registerTimer(min(at) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((r for entry in self.waiting.get() for r in zip(*entry, strict=True)), key=lambda r: r[:2])
        ready = [r for r in rows if r[0] <= now]
        held, out = self.held.get(), []
        value = None if held is None else list(held)
        for row in ready:
            value = self.expired(key, value, row[0], out)
            value = self.step(key, value, row, out)
        value = self.expired(key, value, now, out)
        if len(ready) < len(rows):
            self.waiting.put([tuple(map(list, zip(*rows[len(ready) :], strict=True)))])
            self.handle.registerTimer(rows[len(ready)][0] // 1000 + 1)
        elif rows:
            self.waiting.clear()
        if value is None:
            self.held.clear()
        else:
            self.held.update(tuple(value))
            if (at := self.due(value)) is not None:
                self.handle.registerTimer(max(at, now) // 1000 + 1)
        self.told(key, value, bool(ready), out)
        return iter(out)

    def step(self, key: Any, value: list | None, row: tuple, out: list[Row]) -> list | None:
        raise NotImplementedError

    def due(self, value: list) -> int | None:
        """When the value must be looked at though no row comes."""
        return None

    def expired(self, key: Any, value: list | None, now: int, out: list[Row]) -> list | None:
        """The value as it is at ``now``, before a row of that time."""
        return value

    def told(self, key: Any, value: list | None, changed: bool, out: list[Row]) -> None:
        """What is told once the rows that were ready are done with."""

    def close(self) -> None:
        pass


class Sessions(InOrder):
    """(key, seq, sessions, longest, last_status) whenever a key had events; the row of the greatest seq is what state.sessions() gives."""

    HELD = "seq bigint, sessions bigint, longest bigint, n bigint, status string, last bigint"
    OUT = "seq bigint, sessions bigint, longest bigint, last_status string"

    def __init__(self, ttl: int = TTL_S):
        self.ttl = ttl * SECOND

    def step(self, key, value, row, out):
        seq, sessions, longest, n, _, last = value or (0, 0, 0, 0, "", None)
        if last is None or row[0] - last >= self.ttl:
            sessions, n = sessions + 1, 0
        return [seq + 1, sessions, max(longest, n + 1), n + 1, STATUS.get(row[2], "searching"), row[0]]

    def told(self, key, value, changed, out):
        if changed:
            out.append(Row(key=key[0], seq=value[0], sessions=value[1], longest=value[2], last_status=value[4]))


class Store(InOrder):
    """Answers of a session store to commands: 'create' begins a session anew, 'wipe' ends it, 'get' asks for it, all else updates it.

    A session lives ``ttl`` seconds from its creation or last update, then it is swept. An update of none does nothing.
    Told are (key, id, found, status, updates) for each get, and (key, null, ...) for each session that was swept.
    """

    HELD = "status string, updates bigint, last bigint"
    OUT = "id bigint, found boolean, status string, updates bigint"

    def __init__(self, ttl: int = TTL_S):
        self.ttl = ttl * SECOND

    def step(self, key, value, row, out):
        at, id_, word = row
        command, _, status = word.partition(" ")
        if command == "get":
            out.append(Row(key=key[0], id=id_, found=value is not None, status=value and value[0], updates=value and value[1]))
            return value
        if command == "wipe":
            return None
        if command == "create":
            return [status, 0, at]
        return value and [status, value[1] + 1, at]

    def due(self, value):
        return value[2] + self.ttl

    def expired(self, key, value, now, out):
        if value is not None and now - value[2] >= self.ttl:
            out.append(Row(key=key[0], id=None, found=False, status=value[0], updates=value[1]))
            return None
        return value


class Batches(InOrder):
    """(key, batch, n, start): state.count_or_timeout(); a batch that nothing follows is closed by a timer."""

    HELD = "batch bigint, n bigint, start bigint"
    OUT = "batch int, n bigint, start double"

    def __init__(self, most: int = 30, seconds: int = 5):
        self.most, self.wait = most, seconds * SECOND

    def step(self, key, value, row, out):
        batch, n, start = value or (0, 0, 0)
        value = [batch, n + 1, start if n else row[0]]
        return self._closed(key, value, out) if value[1] >= self.most else value

    def due(self, value):
        return value[2] + self.wait + 1000 if value[1] else None

    def expired(self, key, value, now, out):
        return self._closed(key, value, out) if value and value[1] and now - value[2] > self.wait else value

    def _closed(self, key, value, out):
        out.append(Row(key=key[0], batch=value[0], n=value[1], start=value[2] / SECOND))
        return [value[0] + 1, 0, 0]


class Deadline(InOrder):
    """A search ends ``seconds`` after its first row: told are (key, kept, null) then, and (key, null, id) for each row that comes later."""

    HELD = "first bigint, kept bigint, open boolean"
    OUT = "kept bigint, late bigint"

    def __init__(self, seconds: int = DEADLINE_S):
        self.wait = seconds * SECOND

    def step(self, key, value, row, out):
        if value is None:
            return [row[0], 1, True]
        if not value[2]:
            out.append(Row(key=key[0], kept=None, late=row[1]))
            return value
        return [value[0], value[1] + 1, True]

    def due(self, value):
        return value[0] + self.wait + 1000 if value[2] else None

    def expired(self, key, value, now, out):
        if value and value[2] and now - value[0] > self.wait:
            out.append(Row(key=key[0], kept=value[1], late=None))
            return [value[0], value[1], False]
        return value


class Cooldowns(InOrder):
    """(key, id, cooling): state.cooldowns()."""

    HELD = "failed bigint"
    OUT = "id bigint, cooling boolean"

    def __init__(self, seconds: int = COOLDOWN_S):
        self.wait = seconds * SECOND

    def step(self, key, value, row, out):
        out.append(Row(key=key[0], id=row[1], cooling=value is not None and row[0] - value[0] < self.wait))
        return [row[0]] if row[2] == "error" else None


class FirstAddresses(InOrder):
    """(key, seq, id) of the first row of each different word, at most ``most`` of a key; what comes behind them isn't held."""

    HELD = "seen array<string>"
    OUT = "seq int, id bigint"

    def __init__(self, most: int):
        self.most = most

    def step(self, key, value, row, out):
        seen = list(value[0]) if value else []
        if row[2] not in seen and len(seen) < self.most:
            seen.append(row[2])
            out.append(Row(key=key[0], seq=len(seen), id=row[1]))
        return [seen]


def kept(stream: DataFrame, key: Column, ts: Column, id_: Column, word: Column, processor: InOrder, late: str = "10 minutes") -> DataFrame:
    """What ``processor`` tells of a stream's rows; those without key or time are left out, later ones than ``late`` dropped."""
    rows = stream.select(key.alias("key"), ts.cast("timestamp").alias("ts"), id_.cast("bigint").alias("id"), word.alias("word")).where("key is not null and ts is not null")
    timed = rows.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("key").transformWithState(processor, f"key {rows.schema['key'].dataType.simpleString()}, {processor.OUT}", "append", "eventTime")


def replayed(rows: DataFrame, follow: Callable[[DataFrame], DataFrame], folder: str, ts: str = "ts", starts: int = 2, beyond: str = "400 days") -> DataFrame:
    """What ``follow`` tells of ``rows`` when they come as a stream in ``starts`` parts by time, each after a start of the query on the same checkpoint.

    A last row, of id null and ``beyond`` all others, brings the watermark behind them; it is no one's. ``folder`` must be new and shared.
    """
    spark = rows.sparkSession
    known = rows.agg(F.percentile_approx(F.col(ts).cast("timestamp"), [i / starts for i in range(1, starts)], 1000).alias("cuts"), F.max(F.col(ts).cast("timestamp")).alias("last")).first()
    was = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        for i in range(starts):
            at = F.col(ts).cast("timestamp")
            part = rows
            if i:
                part = part.where(at > F.lit(known.cuts[i - 1]))
            if i < starts - 1:
                part = part.where(at <= F.lit(known.cuts[i]))
            elif known.last is not None:
                end = F.lit(known.last) + F.expr(f"interval {beyond}")
                last = spark.range(1).select(*(end.cast(rows.schema[c].dataType).alias(c) if c == ts else (F.lit(END).cast(rows.schema[c].dataType)).alias(c) for c in rows.columns))
                part = part.unionByName(last)
            part.write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            query = follow(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
            if query.exception():
                raise query.exception()
    finally:
        spark.conf.unset(PROVIDER[0]) if was is None else spark.conf.set(PROVIDER[0], was)
    return spark.read.parquet(f"{folder}/out")


#: Key of the row that ends a replay.
END = "-1"
