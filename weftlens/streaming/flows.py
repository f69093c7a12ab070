"""Value and redirect flows of a growing stream of exchanges, with state that is bounded by what can still be read.

Two streams, with a table between them.  The first puts each session's exchanges in order: it waits until the watermark says that nothing
earlier can come, or until the session is marked as complete, and numbers them.  The second keeps, by session, the
sources of each value (or url) that a later request may still read.  In any number of batches the rows are those of operators.traces over the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A redirect can be followed for so long.
REDIRECT_NS = 30 * 10**9

ORDERED = "session string, seq long, t long, pos long, tied boolean, body string"
FLOWS = "session string, value string, from_pos long, to_pos long, delay long"


def _moment(ns: Column) -> Column:
    return F.timestamp_micros(F.floor(ns / 1000))


class _Order(StatefulProcessor):
    """Numbers a session's rows by (t, seq) as soon as nothing earlier can come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "seq long, t long, body string")
        self._reached = handle.getValueState("reached", "pos long, t long")

    def _out(self, key, rows: list[tuple], until: int | None, ended: bool) -> Iterator[pd.DataFrame]:
        """Rows before the watermark `until` in ms, or all of them if the session has ended; the rest waits."""
        ready = sorted((r for r in rows if ended or r[1] // 10**6 < until), key=lambda r: (r[1], r[0]))
        rest = [r for r in rows if not (ended or r[1] // 10**6 < until)]
        if rest:
            self._waiting.put(rest)
            self._handle.registerTimer(min(r[1] for r in rest) // 10**6 + 1)
        else:
            self._waiting.clear()
        if not ready:
            return
        pos, last = self._reached.get() if self._reached.exists() else (0, None)
        out = []
        for seq, t, body in ready:
            out.append((key[0], seq, t, pos, t == last, body))
            pos, last = pos + 1, t
        if ended:
            self._reached.clear()
        else:
            self._reached.update((pos, last))
        yield pd.DataFrame(out, columns=["session", "seq", "t", "pos", "tied", "body"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self._waiting.get()] if self._waiting.exists() else []
        ended = False
        for part in rows:
            ended |= bool(part["ended"].any())
            held += [(int(s), int(t), b) for s, t, b, e in zip(part["seq"], part["t"], part["body"], part["ended"]) if not e]
        yield from self._out(key, held, timerValues.getCurrentWatermarkInMs(), ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self._waiting.get()] if self._waiting.exists() else []
        yield from self._out(key, held, timerValues.getCurrentWatermarkInMs(), False)

    def close(self) -> None:
        pass


def ordered_steps(exchanges: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """A stream (session, seq, t, pos, tied, body) of a stream exchanges (session, seq, t, ended, ...), in order within a session.

    t is in nanoseconds, body the other columns as JSON; tied says whether the step before starts in the same moment.  Rows that come more than `delay`
    behind the latest t are too late and dropped by the watermark.  A row with ended set is the session's completion marker: it is no step, and whatever of
    the session still waits is put out with it.
    """
    exchanges.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    others = [c for c in exchanges.columns if c not in ("session", "seq", "t", "ended")]
    body = F.to_json(F.struct(*others)) if others else F.lit("{}")
    rows = exchanges.select("session", "seq", "t", F.coalesce("ended", F.lit(False)).alias("ended"), body.alias("body"), _moment(F.col("t")).alias("at")).withWatermark("at", delay)
    return rows.groupBy("session").transformWithStateInPandas(_Order(), ORDERED, "Append", "EventTime")


class _LastSource(StatefulProcessor):
    """By session: the sources of each value that a later request may still read.

    A call into the state costs far more than a row, so a session has one list of all its values.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._sources = handle.getListState("sources", "value string, at long, pos long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sources: dict[str, list[tuple[int, int]]] = {}
        asked: dict[str, list[tuple[int, int]]] = {}
        for value, at, pos in self._sources.get():
            sources.setdefault(value, []).append((at, pos))
        now, out, kept = 0, [], []
        for part in rows:
            for reads, value, at, t, pos in zip(part["reads"], part["value"], part["at"], part["t"], part["pos"]):
                (asked if reads else sources).setdefault(value, []).append((int(at), int(pos)))
                now = max(now, int(t))
        for value, own in sources.items():
            own.sort()
            k = -1
            for at, pos in sorted(asked.get(value, ())):
                while k + 1 < len(own) and own[k + 1][0] <= at:
                    k += 1
                if k >= 0 and own[k][1] != pos:
                    out.append((key[0], value, own[k][1], pos, at - own[k][0]))
            # later requests start at `now` or after it: of the sources before, the last one is enough
            past = sum(at <= now for at, _ in own)
            kept += [(value, at, pos) for at, pos in own[max(past - 1, 0) :]]
        if kept:
            self._sources.put(kept)
        if out:
            yield pd.DataFrame(out, columns=["session", "value", "from_pos", "to_pos", "delay"])

    def close(self) -> None:
        pass


def value_flow_stream(steps: DataFrame) -> DataFrame:
    """The rows of traces.value_flows as a stream, from a stream of ordered steps (session, t, pos, tied, available, given, asked).

    given and asked are the values (arrays) that a step's response and request carry.  A session's state holds, for each value, the last source
    available so far and those that will be available later.
    """
    steps.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kept = F.when((F.col("available") > F.col("t")) | F.col("tied"), F.array_distinct("given"))
    event = lambda values, at, reads: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(v.alias("value"), at.alias("at"), F.lit(reads).alias("reads")))
    events = F.concat(event(kept, F.col("available"), False), event(F.array_distinct("asked"), F.col("t"), True))
    rows = steps.select("session", "t", "pos", F.inline(events)).where("value is not null")
    return rows.groupBy("session").transformWithStateInPandas(_LastSource(), FLOWS, "Append", "None")


class _OpenRedirects(StatefulProcessor):
    """By session: redirects that no request has followed yet, until they expire."""

    def __init__(self, within: int):
        self._within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getListState("open", "value string, at long, pos long")

    def _hold(self, sources: list[tuple[str, int, int]]) -> None:
        if sources:
            self._open.put(sources)
            self._handle.registerTimer((min(at for _, at, _ in sources) + self._within) // 10**6 + 1)
        else:
            self._open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self._open.get()]
        events = [(at, False, pos, value) for value, at, pos in held]
        for part in rows:
            events += [(int(at), bool(reads), int(pos), value) for reads, value, at, pos in zip(part["reads"], part["value"], part["at"], part["pos"])]
        out: list[tuple] = []
        waiting: dict[str, list[tuple[int, int]]] = {}
        for at, reads, pos, value in sorted(events):
            last = waiting.get(value)
            if not reads:
                waiting.setdefault(value, []).append((at, pos))
            elif last and last[-1][1] != pos:  # a request doesn't take the redirect that it led to itself
                if at - last[-1][0] <= self._within:
                    out.append((key[0], value, last[-1][1], pos, at - last[-1][0]))
                del waiting[value]
        # redirects that lie after the last request are still open
        still = [(value, at, pos) for value, own in waiting.items() for at, pos in own]
        if held or still:
            self._hold(still)
        if out:
            yield pd.DataFrame(out, columns=["session", "value", "from_pos", "to_pos", "delay"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self._hold([r for r in map(tuple, self._open.get()) if (r[1] + self._within) // 10**6 + 1 > now])
        yield pd.DataFrame([], columns=["session", "value", "from_pos", "to_pos", "delay"])

    def close(self) -> None:
        pass


def redirect_flow_stream(steps: DataFrame, within: int = REDIRECT_NS, delay: str = "10 seconds") -> DataFrame:
    """The rows of traces.redirect_flows with `within`, as a stream, from a stream of ordered steps (session, t, pos, tied, available, url, target).

    A redirect is used once, and forgotten `within` nanoseconds after it was there, when the watermark has passed that moment.
    """
    steps.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    sent = F.when(F.col("target").isNotNull() & ((F.col("available") > F.col("t")) | F.col("tied")), F.struct(F.col("target").alias("value"), F.col("available").alias("at"), F.lit(False).alias("reads")))
    read = F.struct(F.col("url").alias("value"), F.col("t").alias("at"), F.lit(True).alias("reads"))
    rows = steps.withColumn("_at", _moment(F.col("t"))).withWatermark("_at", delay)
    rows = rows.select("session", "pos", "_at", F.inline(F.array_compact(F.array(sent, read))))
    return rows.groupBy("session").transformWithStateInPandas(_OpenRedirects(within), FLOWS, "Append", "EventTime")


def append(stream: DataFrame, table: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """The stream's rows, appended to a Parquet table; without an interval it takes what is there and ends."""
    writer = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def read_steps(spark: SparkSession, table: str, body: str) -> DataFrame:
    """The table of ordered steps as a stream again, its body as columns of the given schema."""
    rows = spark.readStream.schema(ORDERED).parquet(table)
    return rows.select("session", "seq", "t", "pos", "tied", F.from_json("body", body).alias("_b")).select("session", "seq", "t", "pos", "tied", "_b.*")
