"""The append-only event log: append with version checks, reads, statistics, archive, compaction, retention, idempotent submission.

A log is a DataFrame with position, stream_id, stream_version, event_type, source, data (JSON), ts. At scale it is a table partitioned by date;
time predicates then prune partitions, and stream reads are served by bucketing on stream_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stream_versions(events: DataFrame, start: Column | int = 0) -> DataFrame:
    """events with stream_version, counted from start in order of position within each stream."""
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("position")).cast("long")
    return events.withColumn("stream_version", number - 1 + (F.lit(start) if isinstance(start, int) else start))


def append(log: DataFrame, batch: DataFrame, parts: int = 64) -> tuple[DataFrame, DataFrame]:
    """(rows to write, rejected streams) of a batch with stream_id, seq, expected_version and the event's columns.

    expected_version -2 takes any state, -1 wants a stream that isn't there yet, others the stream's version. One writer appends at a time.
    """
    heads = log.groupBy("stream_id").agg(F.max("stream_version").alias("head"))
    last = log.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("last"))
    wanted = batch.groupBy("stream_id").agg(F.min_by("expected_version", "seq").alias("wanted"))
    state = wanted.join(heads, "stream_id", "left").withColumn("head", F.coalesce("head", F.lit(-1).cast("long")))
    ok = (F.col("wanted") == -2) | (F.col("wanted") == F.col("head"))
    rejected = state.where(~ok).select("stream_id", F.col("wanted").alias("expected_version"), F.col("head").alias("actual_version"))
    rows = batch.join(state.where(ok).select("stream_id", "head"), "stream_id")
    version = F.row_number().over(Window.partitionBy("stream_id").orderBy("seq")) + F.col("head")
    numbered = rows.withColumn("stream_version", version.cast("long"))
    # positions follow seq over the whole batch, which is cut at fixed points into parts that are numbered each by itself
    points = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    cuts = sorted(set(batch.agg(F.percentile_approx("seq", points, F.lit(10_000))).first()[0] or [])) if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), lambda c: c < F.col("seq"))) if cuts else F.lit(0)
    numbered = numbered.withColumn("part", part)
    counts = numbered.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.crossJoin(F.broadcast(last)).select("part", (before + F.col("last")).alias("start"))  # a row for each part
    position = F.row_number().over(Window.partitionBy("part").orderBy("seq")) + F.col("start")
    return numbered.join(F.broadcast(starts), "part").withColumn("position", position.cast("long")).drop("part", "start", "head", "seq", "expected_version"), rejected


def read_all(log: DataFrame, start: int, limit: int) -> DataFrame:
    return log.where(F.col("position") >= start).orderBy("position").limit(limit)


def read_stream(log: DataFrame, stream_id: str, version: int = 0, limit: int | None = None) -> DataFrame:
    out = log.where((F.col("stream_id") == stream_id) & (F.col("stream_version") >= version)).orderBy("stream_version")
    return out.limit(limit) if limit else out


def time_range(log: DataFrame, start: str, end: str, after: int | None = None) -> DataFrame:
    """Half open: from start on, before end."""
    out = log.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return out if after is None else out.where(F.col("position") > after)


def filtered(log: DataFrame, types: list[str] | None = None, sources: list[str] | None = None, start: str | None = None, end: str | None = None, payload: dict[str, str] | None = None) -> DataFrame:
    """The query interface's filter: all given conditions; the time range is closed."""
    out = log
    if types:
        out = out.where(F.col("event_type").isin(types))
    if sources:
        out = out.where(F.col("source").isin(sources))
    if start:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    for path, value in (payload or {}).items():
        out = out.where(F.get_json_object("data", f"$.{path}") == value)
    return out


def page(log: DataFrame, first: int, after: int | None = None) -> DataFrame:
    """Newest first, keyset by (ts, position) below the cursor; one row more than a page tells whether there is a next one."""
    out = log
    if after is not None:
        cursor = log.where(F.col("position") == after).select(F.struct("ts", "position").alias("cursor"))
        out = log.crossJoin(F.broadcast(cursor)).where(F.struct("ts", "position") < F.col("cursor")).drop("cursor")
    return out.orderBy(F.desc("ts"), F.desc("position")).limit(first + 1)


def cursor(position: Column) -> Column:
    return F.base64(position.cast("string").cast("binary"))


def statistics(log: DataFrame) -> DataFrame:
    """Counts in total, by type, by source, by hour and by type and source, from one pass."""
    own = log.select("event_type", F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source"), F.date_trunc("hour", "ts").alias("hour"))
    sets = [[], [F.col("event_type")], [F.col("source")], [F.col("hour")], [F.col("event_type"), F.col("source")]]
    return own.groupingSets(sets, F.col("event_type"), F.col("source"), F.col("hour")).agg(F.grouping_id().alias("grouping"), F.count("*").alias("events"))


def counts_by(log: DataFrame, *columns: str) -> DataFrame:
    """Counts by event_type, source or hour, whichever are asked for: one grouping, combined before its shuffle."""
    of = {"event_type": F.col("event_type"), "source": F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")), "hour": F.date_trunc("hour", "ts")}
    return log.groupBy(*[of[c].alias(c) for c in columns]).agg(F.count("*").alias("events"))


def stream_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("events"), F.countDistinct("stream_id").alias("streams"), F.coalesce(F.max("position"), F.lit(-1)).cast("long").alias("last_position"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def stream_listing(log: DataFrame) -> DataFrame:
    """Version and count of each stream, most recently written first."""
    return log.groupBy("stream_id").agg(F.max("stream_version").alias("version"), F.count("*").alias("events"), F.max("position").alias("last_position")).orderBy(F.desc("last_position"))


def position_at(log: DataFrame, times: DataFrame) -> DataFrame:
    """For each row of times (at): the last position at or before it; -1 where there is none. Both sides go through one window over their union."""
    marks = log.select(F.col("ts").alias("at"), F.col("position"), F.lit(None).cast("timestamp").alias("asked"))
    asked = times.select("at", F.lit(None).cast("long").alias("position"), F.col("at").alias("asked"))
    day = F.to_date("at")
    # what all earlier days end with comes from a table of a row for each day, so that no window spans the whole log
    tops = log.groupBy(F.to_date("ts").alias("day")).agg(F.max("position").alias("top")).unionByName(times.select(day.alias("day"), F.lit(None).cast("long").alias("top")))
    upto = F.max("top").over(Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    before = tops.groupBy("day").agg(F.max("top").alias("top")).select("day", upto.alias("upto"))
    own = Window.partitionBy("day").orderBy("at", F.col("asked").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marks.unionByName(asked).withColumn("day", day).withColumn("within", F.max("position").over(own)).where("asked IS NOT NULL")
    return found.join(F.broadcast(before), "day").select(F.col("asked").alias("at"), F.coalesce(F.greatest("within", "upto"), F.lit(-1)).cast("long").alias("position"))


def snapshot_at(states: DataFrame, key: str, state: str, position: int) -> DataFrame:
    """The latest state of each key at or before a position."""
    return states.where(F.col("position") <= position).groupBy(key).agg(F.max_by(state, "position").alias(state), F.max("position").alias("position"))


def retention_days(event_type: Column, stream_id: Column, by_type: dict[str, int], by_prefix: dict[str, int], default: int, floor: int = 6 * 365) -> Column:
    """Days that an event is kept: its type's, else its longest stream prefix's, else the default; never fewer than the floor."""
    out = F
    for t, days in by_type.items():
        out = out.when(event_type == t, F.lit(days))
    for prefix, days in sorted(by_prefix.items(), key=lambda x: -len(x[0])):
        out = out.when(stream_id.startswith(prefix), F.lit(days))
    out = out.otherwise(F.lit(default)) if out is not F else F.lit(default)
    return F.greatest(out, F.lit(floor))


def archivable(log: DataFrame, now: str, cutoff: str, days: Column) -> DataFrame:
    """Events strictly older than the cutoff and than what their policy keeps."""
    age_limit = F.lit(now).cast("timestamp") - F.make_dt_interval(days)
    return log.where((F.col("ts") < F.lit(cutoff).cast("timestamp")) & (F.col("ts") < age_limit))


def compaction_candidates(log: DataFrame, least: int, before: str) -> DataFrame:
    return log.groupBy("stream_id").agg(F.count("*").alias("events"), F.min("ts").alias("oldest"), F.max("stream_version").alias("version")).where((F.col("events") >= least) & (F.col("oldest") < F.lit(before).cast("timestamp")))


def without(log: DataFrame, archived: DataFrame) -> DataFrame:
    return log.join(archived.select("position"), "position", "left_anti")


def submit(receipts: DataFrame, batch: DataFrame) -> DataFrame:
    """batch (idempotency_key, fingerprint, seq) with outcome: accepted, duplicate (same key and fingerprint) or conflict (same key, another one)."""
    known = receipts.select("idempotency_key", F.col("fingerprint").alias("kept"))
    first = batch.groupBy("idempotency_key").agg(F.min_by("fingerprint", "seq").alias("first"), F.min("seq").alias("first_seq"))
    state = first.join(known, "idempotency_key", "left").withColumns({"owner": F.coalesce("kept", "first"), "is_new": F.col("kept").isNull()})
    out = batch.join(state, "idempotency_key")
    outcome = F.when(F.col("fingerprint") != F.col("owner"), "conflict").when(F.col("is_new") & (F.col("seq") == F.col("first_seq")), "accepted").otherwise("duplicate")
    return out.select(*batch.columns, outcome.alias("outcome"))


def event_id(*parts: Column) -> Column:
    """The same id for the same parts: a digest of each part's length and text."""
    return F.sha2(F.concat(*[F.concat(F.octet_length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts]), 256)


def due(outbox: DataFrame, now: str, limit: int) -> DataFrame:
    """Messages to deliver next: pending, scheduled by now, whose endpoint has no open circuit (circuits are a column here), oldest first."""
    at = F.lit(now).cast("timestamp")
    return outbox.where((F.col("status") == "pending") & (F.coalesce("scheduled_at", at) <= at)).orderBy("created_at", "message_id").limit(limit)


def purge(events: DataFrame, now: str, days: int, held: DataFrame) -> DataFrame:
    """events with expired payloads emptied, except those that open deliveries or dead letters (held: position) still need."""
    expired = F.col("ts") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    marked = events.join(held.select("position", F.lit(True).alias("is_held")).distinct(), "position", "left")
    gone = expired & F.col("is_held").isNull()
    return marked.withColumns({"data": F.when(~gone, F.col("data")), "purged": gone}).drop("is_held")
