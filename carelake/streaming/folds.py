"""Read models over live input: the folds of operators/projections as Structured Streaming queries, and keyed state machines.

Input is any streaming DataFrame of the log's columns. Everything restarts from its checkpoint folder; writes by batch id are idempotent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery


def read_log(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """The log's folder as a stream of its new files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def statistics(log: DataFrame) -> DataFrame:
    """Running counts by type and source."""
    return log.groupBy("event_type", F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("events"))


def windowed(log: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and type; windows close when the watermark has passed them, and later events are left to the batch read model."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "event_type", "events")


class LastState(StatefulProcessor):
    """Active keys: an opening starts a state, a move changes its location, a closing ends it. Emits the state after each batch of a key's events."""

    def __init__(self, opens: list[str], moves: list[str], closes: list[str], location: str):
        self.opens, self.moves, self.closes, self.location = opens, moves, closes, location

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "opened timestamp, location string, position long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = self.state.get() if self.state.exists() else None
        events = pd.concat(list(rows)).sort_values(["ts", "position"])
        for e in events.itertuples():
            if e.event_type in self.opens:
                own = (e.ts.to_pydatetime(), getattr(e, self.location), int(e.position))
            elif own is not None and e.event_type in self.moves:
                own = (own[0], getattr(e, self.location), int(e.position))
            elif e.event_type in self.closes:
                own = None
        if own is None:
            self.state.clear()
            yield pd.DataFrame({"stream_id": [key[0]], "active": [False], "opened": [pd.NaT], "location": [None]})
        else:
            self.state.update(own)
            yield pd.DataFrame({"stream_id": [key[0]], "active": [True], "opened": [own[0]], "location": [own[1]]})

    def close(self) -> None:
        pass


def active(log: DataFrame, opens: list[str], moves: list[str], closes: list[str], location: str) -> DataFrame:
    return log.groupBy("stream_id").transformWithStateInPandas(LastState(opens, moves, closes, location), "stream_id string, active boolean, opened timestamp, location string", "Update", "None")


class Breaker(StatefulProcessor):
    """Circuit of an endpoint: closed until so many failures in a row, then open for a while, then half open until so many successes."""

    def __init__(self, failures: int = 5, successes: int = 2, open_seconds: float = 30.0):
        self.failures, self.successes, self.open_seconds = failures, successes, open_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "mode string, n int, since timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mode, n, since = self.state.get() if self.state.exists() else ("closed", 0, None)
        out = []
        for e in pd.concat(list(rows)).sort_values(["ts", "position"]).itertuples():
            mode, n, since, allowed = step(mode, n, since, e.ts.to_pydatetime(), bool(e.ok), self.failures, self.successes, self.open_seconds)
            out.append((key[0], int(e.position), allowed, mode))
        self.state.update((mode, n, since))
        yield pd.DataFrame(out, columns=["endpoint", "position", "allowed", "mode"])

    def close(self) -> None:
        pass


def step(mode: str, n: int, since, at, ok: bool, failures: int, successes: int, open_seconds: float) -> tuple:
    """State of a circuit after a call at a time, and whether the call was let through."""
    if mode == "open":
        if (at - since).total_seconds() < open_seconds:
            return mode, n, since, False
        mode, n = "half_open", 0
    if mode == "half_open":
        if not ok:
            return "open", 0, at, True
        return ("closed", 0, None, True) if n + 1 >= successes else (mode, n + 1, since, True)
    if ok:
        return "closed", 0, None, True
    return ("open", 0, at, True) if n + 1 >= failures else ("closed", n + 1, None, True)


def breaker(calls: DataFrame, **limits) -> DataFrame:
    """calls (endpoint, position, ts, ok) with whether each was let through and the circuit's mode after it."""
    return calls.groupBy("endpoint").transformWithStateInPandas(Breaker(**limits), "endpoint string, position long, allowed boolean, mode string", "Append", "None")


class Bucket(StatefulProcessor):
    """Token bucket of a key: so many tokens a second, so many at most."""

    def __init__(self, rate: float = 10.0, burst: float = 20.0):
        self.rate, self.burst = rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "tokens double, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tokens, at = self.state.get() if self.state.exists() else (self.burst, None)
        out = []
        for e in pd.concat(list(rows)).sort_values(["ts", "position"]).itertuples():
            now = e.ts.to_pydatetime()
            tokens = min(self.burst, tokens + self.rate * max(0.0, (now - at).total_seconds() if at else 0.0))
            allowed = tokens >= 1
            tokens, at = tokens - allowed, now
            out.append((key[0], int(e.position), bool(allowed)))
        self.state.update((float(tokens), at))
        yield pd.DataFrame(out, columns=["key", "position", "allowed"])

    def close(self) -> None:
        pass


def rate_limited(calls: DataFrame, rate: float = 10.0, burst: float = 20.0) -> DataFrame:
    """calls (key, position, ts) with whether each is within its key's limit."""
    return calls.groupBy("key").transformWithStateInPandas(Bucket(rate, burst), "key string, position long, allowed boolean", "Append", "None")


def once(batch: DataFrame, late: str = "1 day") -> DataFrame:
    """Each idempotency key once, as long as the watermark remembers it."""
    return batch.withWatermark("ts", late).dropDuplicatesWithinWatermark(["idempotency_key"])


def to_folder(rows: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what there is and stops: run again for more."""
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(folder)


def each_batch(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Hands each micro-batch with its number to write, which must do nothing for a number that it has written already."""
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def relay(outbox: DataFrame, deliver: Callable[[pd.DataFrame], list[str | None]]) -> DataFrame:
    """outbox rows (message_id, payload, attempts) with status and error after one attempt: published, retry, or failed after the fifth.

    deliver gets a batch and returns an error or null for each row; it runs on the executors and must stand being called again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            errors = deliver(b)
            n = b["attempts"] + 1
            yield pd.DataFrame({"message_id": b["message_id"], "attempts": n, "status": ["published" if e is None else "failed" if k >= 5 else "retry" for e, k in zip(errors, n, strict=True)], "error": errors})

    return outbox.select("message_id", "payload", "attempts").mapInPandas(run, "message_id long, attempts long, status string, error string")
