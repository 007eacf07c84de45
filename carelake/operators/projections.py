"""Read models over the event log, as batch queries; streaming/ has the same folds over live input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timeline(log: DataFrame, key: str = "stream_id") -> DataFrame:
    """Events of each key in order of time; of equal times the later arrival comes first, and a position counts once."""
    once = log.dropDuplicates(["position"])
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("ts", F.desc("position"))).cast("long"))


def timeline_first(log: DataFrame, key: str, n: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """The earliest n events of each key in a closed range."""
    own = log
    if start:
        own = own.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        own = own.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return timeline(own, key).where(F.col("place") <= n)


def active(log: DataFrame, key: str, opens: list[str], moves: list[str], closes: list[str], location: str) -> DataFrame:
    """Keys whose last state isn't closed: opened at, where they are now, and by which event.

    An opening starts a state over, a move overlays its location, a closing ends it; moves without an opening don't count. One aggregation with
    map-side combining finds the last opening and closing, a second one the last location since then.
    """
    order = F.struct("ts", "position")
    kind = F.col("event_type")
    ends = log.where(kind.isin(opens + closes)).groupBy(key).agg(F.max_by(kind, order).alias("last_kind"), F.max(order).alias("last"))
    live = ends.where(F.col("last_kind").isin(opens)).select(key, F.col("last").alias("opened"))
    since = log.where(kind.isin(opens + moves)).join(live, key).where(order >= F.col("opened"))
    return since.groupBy(key).agg(F.min("opened.ts").alias("opened_at"), F.max_by(location, order).alias("location"), F.max("position").alias("last_position"))


def consecutive_failures(log: DataFrame, key: str, failed: str, least: int) -> DataFrame:
    """Runs of failures of each key that are at least so long: gaps and islands."""
    w = Window.partitionBy(key).orderBy("ts", "position")
    is_failed = F.col("event_type") == failed
    marked = log.select(key, "ts", "position", is_failed.alias("failed"), F.sum(F.when(~is_failed, 1).otherwise(0)).over(w).alias("island"))
    return marked.where("failed").groupBy(key, "island").agg(F.count("*").alias("failures"), F.min("ts").alias("started"), F.max("ts").alias("ended")).where(F.col("failures") >= least).drop("island")


def requests_in_window(log: DataFrame, key: str, seconds: int) -> DataFrame:
    """Each event with the number of events of its key in the seconds up to it."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return log.withColumn("in_window", F.count("*").over(Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0)))


def latency_summary(values: DataFrame, value: str, group: str, percentiles: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99, 0.999), cuts: int = 64) -> DataFrame:
    """Count, least, most, mean, population deviation and percentiles: the value at place floor(n * p), counted from 0, of the sorted values.

    No group is sorted in one task: approximate quantiles cut each group into buckets, the buckets' counts tell which few hold the wanted places,
    and only their values, counted by value before the shuffle, are put in order.
    """
    own = values.select(group, F.col(value).alias("v")).where("v IS NOT NULL")
    points = F.array(*[F.lit(k / cuts) for k in range(1, cuts)])
    totals = own.groupBy(group).agg(
        F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("deviation"), F.percentile_approx("v", points, F.lit(1000)).alias("cuts")
    )
    counted = own.groupBy(group, "v").agg(F.count("*").alias("c")).join(totals.select(group, "cuts"), group)
    placed = counted.select(group, "v", "c", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("bucket"))
    per_bucket = placed.groupBy(group, "bucket").agg(F.sum("c").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = [(p, f"p{str(100 * p).rstrip('0').rstrip('.').replace('.', '_')}") for p in percentiles]
    wanted = totals.select(group, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.floor(F.col("n") * p).alias("place")) for p, name in named])).alias("w")).select(group, "w.*")
    starts = per_bucket.withColumn("start", before)
    hit = wanted.join(starts, group).where("place >= start AND place < start + c").select(group, "name", "place", "bucket", "start")
    inside = placed.join(hit, [group, "bucket"])
    running = F.col("start") + F.coalesce(F.sum("c").over(Window.partitionBy(group, "name").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = inside.withColumn("from", running).where("place >= `from` AND place < `from` + c")
    wide = found.groupBy(group).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for _, name in named])
    return totals.drop("cuts").join(wide, group, "left")
