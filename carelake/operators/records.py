"""Keeping things going: rebuilt read models, dead-letter queues, outbox clean-up, object ledgers, summaries, metrics, look-ups of encounters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rebuilt(log: DataFrame, fold: Callable[[DataFrame], DataFrame], start: int = 0, stop: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """A read model made anew from the log: from a position up to one that is left out, or from a time up to one that is left out."""
    own = log.where(F.col("position") >= start)
    if stop is not None:
        own = own.where(F.col("position") < stop)
    if since:
        own = own.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until:
        own = own.where(F.col("ts") < F.lit(until).cast("timestamp"))
    return fold(own)


def counts_from_snapshot(snapshot: DataFrame, log: DataFrame, key: str, position: int) -> DataFrame:
    """(key, events): counts kept up to a position, carried on with what the log has after it."""
    later = log.where(F.col("position") > position).groupBy(key).agg(F.count("*").alias("events"))
    return snapshot.select(key, "events").unionByName(later).groupBy(key).agg(F.sum("events").alias("events"))


def rebuild_plan(log: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """What a rebuild would read: events, first and last position."""
    own = log.where((F.col("position") >= start) & (F.lit(stop is None) | (F.col("position") < (stop or 0))))
    return own.agg(F.count("*").alias("events"), F.min("position").alias("first"), F.max("position").alias("last"))


def without_old(outbox: DataFrame, now: str, days: int) -> DataFrame:
    """The outbox without published and failed messages that are older than so many days; pending ones stay whatever their age."""
    old = F.col("created_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return outbox.where(~(old & F.col("status").isin("published", "failed")))


def queue_page(dead: DataFrame, limit: int) -> DataFrame:
    """The dead letters that have waited longest."""
    return dead.orderBy("failed_at", "id").limit(limit)


def popped(dead: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(the letters that have waited longest, the queue without them)."""
    taken = queue_page(dead, limit)
    return taken, dead.join(taken.select("id"), "id", "left_anti")


def removed(dead: DataFrame, ids: DataFrame) -> DataFrame:
    return dead.join(ids.select("id"), "id", "left_anti")


def streams_by_prefix(log: DataFrame, prefix: str) -> DataFrame:
    return log.where(F.col("stream_id").startswith(prefix)).select("stream_id").distinct()


def encounters(active: DataFrame, **wanted: str) -> DataFrame:
    """Active encounters by patient, location, class or unit, whichever are given."""
    for name, value in wanted.items():
        active = active.where(F.col(name) == value)
    return active


def replay_summary(diffs: DataFrame) -> DataFrame:
    """Of replay differences (added, removed, changed): events, changed ones, routes added and removed."""
    return diffs.agg(F.count("*").alias("events"), F.count_if("changed").alias("changed"), F.coalesce(F.sum(F.size("added")), F.lit(0)).alias("added"), F.coalesce(F.sum(F.size("removed")), F.lit(0)).alias("removed"))


def suggestion_report(suggestions: DataFrame, threshold: float, review: float) -> DataFrame:
    """Of the best suggestion of each code (score, null where there is none): codes mapped by themselves, to review, and without."""
    s = F.col("score")
    return suggestions.agg(F.count("*").alias("codes"), F.count_if(s >= threshold).alias("mapped"), F.count_if((s >= review) & (s < threshold)).alias("review"), F.count_if(s.isNull() | (s < review)).alias("none"))


def evaluation(scores: DataFrame, passed: float) -> DataFrame:
    """By kind of case: cases, mean score, share that passed."""
    return scores.groupBy("kind").agg(F.count("*").alias("cases"), F.avg("score").alias("mean"), F.avg((F.col("score") >= passed).cast("double")).alias("passed"))


#: Upper bounds of the duration buckets in seconds.
BUCKETS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0]


def metrics(processed: DataFrame, bounds: list[float] | None = None) -> DataFrame:
    """(event_type, source, success, events, seconds, le): counters, and for each bound how many took at most so long; the last one takes all."""
    bounds = [*(bounds or BUCKETS), float("inf")]
    own = processed.groupBy("event_type", "source", "success").agg(F.count("*").alias("events"), F.sum("seconds").alias("seconds"), *[F.count_if(F.col("seconds") <= b).alias(f"le_{k}") for k, b in enumerate(bounds)])
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"le_{k}").alias("count")) for k, b in enumerate(bounds)])
    return own.select("event_type", "source", "success", "events", "seconds", F.explode(pairs).alias("p")).select("event_type", "source", "success", "events", "seconds", "p.*")


def most_common(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): the value that each column has most often, the least of equal ones."""
    long = rows.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value IS NOT NULL AND value <> ''")
    n = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return n.groupBy("column").agg(F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("best")).select("column", "best.value", "best.n")


def objects(files: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Objects of a batch source (path, length, modified) that no earlier run completed in this state, oldest first: those to claim."""
    known = done.where("status = 'completed'").select("path", F.col("length").alias("done_length"), F.col("modified").alias("done_modified"))
    left = files.join(known, (files["path"] == known["path"]) & (files["length"] == known["done_length"]) & (files["modified"] == known["done_modified"]), "left_anti").orderBy("modified", "path")
    return left.limit(limit) if limit else left


def ledger(claimed: DataFrame, results: DataFrame) -> DataFrame:
    """claimed objects with what came of them: results (path, records, failed, digest) complete an object, or fail it where a record failed; others stay claimed."""
    out = claimed.join(results, "path", "left")
    status = F.when(F.col("records").isNull(), "claimed").when(F.col("failed") > 0, "failed").otherwise("completed")
    return out.select("path", "length", "modified", status.alias("status"), F.when(status == "completed", F.col("records")).alias("offset"), "digest")


def durable(events: DataFrame, allowed: list[str]) -> DataFrame:
    """What of admissions is kept for good: an id made of their parts, names and numbers as sent, the protection class, and the warnings that are allowed."""
    from .eventlog import event_id

    p = F.col("patient")
    kept = F.filter(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: w.isin(allowed))
    return events.select(event_id(F.lit("hl7v2"), F.col("control_id"), p["mrn"]).alias("event_id"), "event_type", "control_id", p["mrn"].alias("mrn"), p["family"].alias("family"), p["given"].alias("given"), F.lit("phi").alias("protection"), kept.alias("warnings"))


def source_times(sent: Column, recorded: Column, occurred: Column, admitted: Column) -> Column:
    """The time at which an admission happened: when the visit began, else the event, else its recording, else the message."""
    return F.coalesce(admitted, occurred, recorded, sent)
