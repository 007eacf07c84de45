"""Queries over the events table as an event log: statistics, reads, projections, workflows, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import eventlog, projections, quality, workflow
from .register import query, table

#: The log's columns in SQL, for the oracles.
LOG = """log AS (SELECT event_id AS position, 'user:' || user_id AS stream_id, event_type,
  CASE user_id % 4 WHEN 0 THEN 'epic' WHEN 1 THEN 'cerner' WHEN 2 THEN 'lab' ELSE '' END AS source, props AS data, value, user_id, ts FROM events)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log: one stream for each user, a source by user."""
    e = table(spark, sf_dir, "events")
    k = F.col("user_id") % 4
    source = F.when(k == 0, "epic").when(k == 1, "cerner").when(k == 2, "lab").otherwise("")
    return e.select(F.col("event_id").alias("position"), F.concat(F.lit("user:"), "user_id").alias("stream_id"), "event_type", source.alias("source"), F.col("props").alias("data"), "value", "user_id", "ts")


@query(f"WITH {LOG} SELECT event_type, count(*) AS events FROM log GROUP BY event_type")
def event_statistics_by_type(spark, sf_dir):
    return eventlog.counts_by(log(spark, sf_dir), "event_type")


@query(f"WITH {LOG} SELECT coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS events FROM log GROUP BY 1")
def event_statistics_by_source(spark, sf_dir):
    return eventlog.counts_by(log(spark, sf_dir), "source")


@query(f"WITH {LOG} SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS events FROM log GROUP BY 1")
def event_statistics_by_hour(spark, sf_dir):
    return eventlog.counts_by(log(spark, sf_dir), "hour")


@query(f"WITH {LOG} SELECT event_type, coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS events FROM log GROUP BY 1, 2")
def event_statistics_by_type_source(spark, sf_dir):
    return eventlog.counts_by(log(spark, sf_dir), "event_type", "source")


@query(f"""WITH {LOG}, own AS (SELECT event_type, coalesce(nullif(source, ''), 'unknown') AS source, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour FROM log)
SELECT event_type, source, hour, CAST(GROUPING_ID(event_type, source, hour) AS BIGINT) AS grouping, count(*) AS events FROM own GROUP BY GROUPING SETS ((), (event_type), (source), (hour), (event_type, source))""")
def event_statistics(spark, sf_dir):
    return eventlog.statistics(log(spark, sf_dir))


@query(f"WITH {LOG} SELECT event_type, count(*) AS events FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_event_types(spark, sf_dir):
    return log(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "event_type").limit(3)


@query(f"WITH {LOG} SELECT count(*) AS events, count(DISTINCT stream_id) AS streams, CAST(coalesce(max(position), -1) AS BIGINT) AS last_position, min(ts) AS first_ts, max(ts) AS last_ts FROM log")
def stream_stats(spark, sf_dir):
    return eventlog.stream_stats(log(spark, sf_dir))


VERSIONED = f"{LOG}, versioned AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY position) - 1 AS stream_version FROM log)"


@query(f"WITH {VERSIONED} SELECT position, stream_id, stream_version FROM versioned")
def stream_versions(spark, sf_dir):
    return eventlog.stream_versions(log(spark, sf_dir)).select("position", "stream_id", "stream_version")


@query(f"WITH {VERSIONED} SELECT stream_id, max(stream_version) AS version, count(*) AS events, max(position) AS last_position FROM versioned GROUP BY 1")
def stream_listing(spark, sf_dir):
    return eventlog.stream_listing(eventlog.stream_versions(log(spark, sf_dir)))


@query(f"WITH {VERSIONED} SELECT position, stream_version, event_type, ts FROM versioned WHERE stream_id = 'user:7' AND stream_version >= 5")
def stream_read(spark, sf_dir):
    return eventlog.read_stream(eventlog.stream_versions(log(spark, sf_dir)), "user:7", 5).select("position", "stream_version", "event_type", "ts")


@query(f"WITH {LOG} SELECT position, stream_id, event_type FROM log WHERE position >= 100 ORDER BY position LIMIT 50")
def log_scan(spark, sf_dir):
    return eventlog.read_all(log(spark, sf_dir), 100, 50).select("position", "stream_id", "event_type")


@query(f"WITH {LOG} SELECT position, event_type, ts FROM log WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-08 00:00:00' AND position > 10")
def events_time_range(spark, sf_dir):
    return eventlog.time_range(log(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-08 00:00:00", 10).select("position", "event_type", "ts")


@query(f"WITH {LOG} SELECT position, source, ts FROM log WHERE event_type IN ('purchase', 'error') AND source IN ('epic', 'lab') AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
def events_filter(spark, sf_dir):
    return eventlog.filtered(log(spark, sf_dir), ["purchase", "error"], ["epic", "lab"], "2024-01-03 00:00:00", "2024-01-20 12:00:00").select("position", "source", "ts")


@query(f"WITH {LOG} SELECT position, ts FROM log WHERE (ts, position) < (SELECT (ts, position) FROM log WHERE position = 500) ORDER BY ts DESC, position DESC LIMIT 26")
def events_page(spark, sf_dir):
    return eventlog.page(log(spark, sf_dir), 25, 500).select("position", "ts")


@query(f"WITH {LOG} SELECT position, CAST(json_extract_string(data, '$.k') AS BIGINT) AS k FROM log WHERE CAST(json_extract_string(data, '$.k') AS BIGINT) >= 90")
def json_path_filter(spark, sf_dir):
    k = F.get_json_object("data", "$.k").try_cast("long")
    return log(spark, sf_dir).select("position", k.alias("k")).where("k >= 90")


@query(f"""WITH {LOG}, asked AS (SELECT TIMESTAMP '2023-12-31 00:00:00' + d * INTERVAL 7 HOUR AS moment FROM range(0, 110) r(d))
SELECT moment AS at_time, CAST(coalesce((SELECT max(position) FROM log WHERE ts <= moment), -1) AS BIGINT) AS position FROM asked""")
def position_at_time(spark, sf_dir):
    start = F.timestamp_micros(F.unix_micros(F.lit("2023-12-31 00:00:00").cast("timestamp")) + F.col("id") * 7 * 3_600_000_000)
    return eventlog.position_at(log(spark, sf_dir), spark.range(110).select(start.alias("at"))).select(F.col("at").alias("at_time"), "position")


@query(f"WITH {LOG} SELECT stream_id, arg_max(event_type, position) AS event_type, max(position) AS position FROM log WHERE position <= 600 GROUP BY stream_id")
def snapshot_asof(spark, sf_dir):
    return eventlog.snapshot_at(log(spark, sf_dir), "stream_id", "event_type", 600)


@query(f"WITH {LOG} SELECT stream_id, position, row_number() OVER (PARTITION BY stream_id ORDER BY ts, position DESC) AS place FROM log")
def timeline_per_user(spark, sf_dir):
    return projections.timeline(log(spark, sf_dir)).select("stream_id", "position", "place")


@query(f"""WITH {LOG} SELECT stream_id, position, place FROM (SELECT stream_id, position, row_number() OVER (PARTITION BY stream_id ORDER BY ts, position DESC) AS place FROM log
  WHERE ts >= TIMESTAMP '2024-01-04 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00') WHERE place <= 5""")
def timeline_first_n(spark, sf_dir):
    return projections.timeline_first(log(spark, sf_dir), "stream_id", 5, "2024-01-04 00:00:00", "2024-01-25 00:00:00").select("stream_id", "position", "place")


@query(f"""WITH {LOG}, ends AS (SELECT stream_id, arg_max(event_type, (ts, position)) AS kind, max((ts, position)) AS last FROM log WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY 1),
live AS (SELECT stream_id, last FROM ends WHERE kind = 'signup')
SELECT l.stream_id, min(struct_extract(live.last, 1)) AS opened_at, arg_max(l.data, (l.ts, l.position)) AS location, max(l.position) AS last_position
FROM log l JOIN live ON l.stream_id = live.stream_id WHERE l.event_type IN ('signup', 'click') AND (l.ts, l.position) >= live.last GROUP BY 1""")
def active_sessions(spark, sf_dir):
    return projections.active(log(spark, sf_dir), "stream_id", ["signup"], ["click"], ["purchase", "error"], "data")


@query(f"""WITH {LOG}, marked AS (SELECT stream_id, ts, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY ts, position) AS island FROM log)
SELECT stream_id, count(*) AS failures, min(ts) AS started, max(ts) AS ended FROM marked WHERE failed GROUP BY stream_id, island HAVING count(*) >= 2""")
def consecutive_failures(spark, sf_dir):
    return projections.consecutive_failures(log(spark, sf_dir), "stream_id", "error", 2)


@query(f"WITH {LOG} SELECT position, count(*) OVER (PARTITION BY stream_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM log")
def rate_window(spark, sf_dir):
    return projections.requests_in_window(log(spark, sf_dir), "stream_id", 3600).select("position", "in_window")


@query(f"""WITH {LOG}, ranked AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM log)
SELECT event_type, count(*) AS n, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation,
  max(CASE WHEN k = floor(n * 0.5::DOUBLE) THEN v END) AS p50, max(CASE WHEN k = floor(n * 0.9::DOUBLE) THEN v END) AS p90, max(CASE WHEN k = floor(n * 0.95::DOUBLE) THEN v END) AS p95,
  max(CASE WHEN k = floor(n * 0.99::DOUBLE) THEN v END) AS p99, max(CASE WHEN k = floor(n * 0.999::DOUBLE) THEN v END) AS p99_9 FROM ranked GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return projections.latency_summary(log(spark, sf_dir), "value", "event_type")


WORKFLOW = {
    "name": "orders", "version": "1",
    "routes": [
        {"name": "large-purchases", "filter": {"event_type": "purchase", "condition": "event.value > 100 && event.k in [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]"}, "transform": [{"set_field": "review.level = high"}], "actions": [{"type": "queue"}]},
        {"name": "errors", "filter": {"event_type": ["error"], "source": ["epic", "lab"]}, "actions": [{"type": "log"}]},
        {"name": "late-hours", "filter": {"condition": "event.event_type.startsWith('s') || (event.k >= 50 && !(event.source == ''))"}, "transform": [{"redact": {"fields": ["k"]}}], "actions": [{"type": "file"}]},
    ],
}
ROUTES = f"""{LOG}, typed AS (SELECT *, CAST(json_extract_string(data, '$.k') AS DOUBLE) AS k FROM log),
routed AS (SELECT position, 'large-purchases' AS route FROM typed WHERE event_type = 'purchase' AND value > 100 AND k IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)
  UNION ALL SELECT position, 'errors' FROM typed WHERE event_type = 'error' AND source IN ('epic', 'lab')
  UNION ALL SELECT position, 'late-hours' FROM typed WHERE event_type LIKE 's%' OR (k >= 50 AND NOT source = ''))"""


@query(f"WITH {ROUTES} SELECT position, route FROM routed")
def workflow_route_matches(spark, sf_dir):
    return workflow.matched_routes(log(spark, sf_dir), workflow.load(WORKFLOW)).select("position", "route")


@query(f"WITH {ROUTES} SELECT route, count(*) AS matched FROM routed GROUP BY route")
def workflow_dry_run(spark, sf_dir):
    return workflow.matched_routes(log(spark, sf_dir), workflow.load(WORKFLOW)).groupBy("route").agg(F.count("*").alias("matched"))


@query(f"WITH {LOG} SELECT position, json_extract_string(data, '$.k') AS k, 'high' AS level FROM log WHERE event_type = 'purchase'")
def workflow_transform_set_field(spark, sf_dir):
    route = workflow.load(WORKFLOW).routes[0]
    out = workflow.transformed(log(spark, sf_dir).where("event_type = 'purchase'"), route)
    return out.select("position", F.get_json_object("data", "$.k").alias("k"), F.get_json_object("data", "$.review.level").alias("level"))


@query(f"WITH {LOG} SELECT position, CAST(NULL AS VARCHAR) AS k, '{{}}' AS data FROM log WHERE event_type = 'view'")
def workflow_redact(spark, sf_dir):
    out = workflow.transformed(log(spark, sf_dir).where("event_type = 'view'"), workflow.load(WORKFLOW).routes[2])
    return out.select("position", F.get_json_object("data", "$.k").alias("k"), "data")


@query(f"WITH {LOG} SELECT position, 'type ' || event_type || ' k ' || json_extract_string(data, '$.k') || ' x <no value>' AS line FROM log")
def workflow_template(spark, sf_dir):
    e = log(spark, sf_dir)
    return e.select("position", workflow.template("type {{.event_type}} k {{ .k }} x {{.missing.field}}", e.columns).alias("line"))


REPLAY = f"""{LOG}, both_runs AS (SELECT position, list_filter([CASE WHEN event_type = 'purchase' THEN 'a' END, CASE WHEN value > 50 THEN 'b' END, CASE WHEN source = 'lab' THEN 'c' END], lambda x: x IS NOT NULL) AS before,
  list_filter([CASE WHEN event_type = 'purchase' THEN 'a' END, CASE WHEN value > 80 THEN 'b' END, CASE WHEN source IN ('lab', 'epic') THEN 'c' END], lambda x: x IS NOT NULL) AS after FROM log)"""


@query(f"""WITH {REPLAY}, d AS (SELECT position, list_filter(after, lambda x: NOT list_contains(before, x)) AS added, list_filter(before, lambda x: NOT list_contains(after, x)) AS removed FROM both_runs)
SELECT position, array_to_string(added, ',') AS added, array_to_string(removed, ',') AS removed, len(added) + len(removed) > 0 AS changed FROM d""")
def replay_diff(spark, sf_dir):
    e = log(spark, sf_dir)
    old = F.array_compact(F.array(F.when(F.col("event_type") == "purchase", "a"), F.when(F.col("value") > 50, "b"), F.when(F.col("source") == "lab", "c")))
    new = F.array_compact(F.array(F.when(F.col("event_type") == "purchase", "a"), F.when(F.col("value") > 80, "b"), F.when(F.col("source").isin("lab", "epic"), "c")))
    out = workflow.replay_diff(e.select("position", old.alias("routes")), e.select("position", new.alias("routes")), "position")
    return out.select("position", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"), "changed")


@query(f"""WITH {LOG}, r AS (SELECT position, CASE WHEN event_type = 'error' THEN (CASE user_id % 5 WHEN 0 THEN 'dial tcp: connection refused' WHEN 1 THEN 'context deadline exceeded' WHEN 2 THEN 'status 503' WHEN 3 THEN 'status 401 Unauthorized' ELSE 'odd' END) END AS error FROM log)
SELECT position, CASE WHEN error LIKE '%deadline%' THEN 'timeout' WHEN error LIKE '%connection%' THEN 'connection' WHEN error LIKE '%401%' THEN 'auth' WHEN error LIKE '%503%' THEN 'server_error' ELSE 'unknown' END AS error_class FROM r WHERE error IS NOT NULL""")
def dlq_split(spark, sf_dir):
    k = F.col("user_id") % 5
    said = F.when(k == 0, "dial tcp: connection refused").when(k == 1, "context deadline exceeded").when(k == 2, "status 503").when(k == 3, "status 401 Unauthorized").otherwise("odd")
    results = log(spark, sf_dir).withColumn("error", F.when(F.col("event_type") == "error", said))
    return workflow.split_failed(results)[1].select("position", "error_class")


POLICY = "CASE WHEN event_type = 'error' THEN greatest(2200, 2190) WHEN stream_id LIKE 'user:1%' THEN greatest(3650, 2190) WHEN stream_id LIKE 'user:%' THEN greatest(100, 2190) ELSE 2555 END"


def _days():
    return eventlog.retention_days(F.col("event_type"), F.col("stream_id"), {"error": 2200}, {"user:": 100, "user:1": 3650}, 2555)


@query(f"WITH {LOG} SELECT position, {POLICY} AS days FROM log WHERE ts < TIMESTAMP '2024-01-20 00:00:00' AND ts < TIMESTAMP '2030-01-15 00:00:00' - to_days(CAST({POLICY} AS INTEGER))")
def retention_eligible(spark, sf_dir):
    return eventlog.archivable(log(spark, sf_dir).withColumn("days", _days()), "2030-01-15 00:00:00", "2024-01-20 00:00:00", F.col("days")).select("position", "days")


@query(f"WITH {LOG} SELECT event_type, count(*) AS events, CAST(sum(octet_length(encode(data))) AS BIGINT) AS bytes FROM log WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def archive_estimate(spark, sf_dir):
    old = log(spark, sf_dir).where(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return old.groupBy("event_type").agg(F.count("*").alias("events"), F.sum(F.octet_length("data")).alias("bytes"))


@query(f"WITH {VERSIONED} SELECT stream_id, count(*) AS events, min(ts) AS oldest, max(stream_version) AS version FROM versioned GROUP BY 1 HAVING count(*) >= 60 AND min(ts) < TIMESTAMP '2024-01-03 00:00:00'")
def compaction_candidates(spark, sf_dir):
    return eventlog.compaction_candidates(eventlog.stream_versions(log(spark, sf_dir)), 60, "2024-01-03 00:00:00")


@query(f"""WITH {LOG}, sent AS (SELECT position, user_id || ':' || (position % 3) AS key, event_type AS fp FROM log),
firsts AS (SELECT key, arg_min(fp, position) AS owner, min(position) AS first_seq FROM sent GROUP BY key)
SELECT position, CASE WHEN fp <> owner THEN 'conflict' WHEN position = first_seq THEN 'accepted' ELSE 'duplicate' END AS outcome FROM sent JOIN firsts USING (key)""")
def idempotent_submit(spark, sf_dir):
    e = log(spark, sf_dir)
    batch = e.select(F.col("position").alias("seq"), F.concat_ws(":", "user_id", F.col("position") % 3).alias("idempotency_key"), F.col("event_type").alias("fingerprint"))
    none = batch.limit(0).select("idempotency_key", "fingerprint")
    return eventlog.submit(none, batch).select(F.col("seq").alias("position"), "outcome")


@query(f"""WITH {LOG} SELECT position, sha256(octet_length(encode(stream_id)) || ':' || stream_id || octet_length(encode(event_type)) || ':' || event_type) AS event_id FROM log""")
def deterministic_event_id(spark, sf_dir):
    return log(spark, sf_dir).select("position", eventlog.event_id(F.col("stream_id"), F.col("event_type")).alias("event_id"))


@query(f"WITH {LOG} SELECT position, ts < TIMESTAMP '2024-01-10 00:00:00' AND event_type <> 'error' AS purged, CASE WHEN NOT (ts < TIMESTAMP '2024-01-10 00:00:00' AND event_type <> 'error') THEN data END AS data FROM log")
def retention_purge(spark, sf_dir):
    e = log(spark, sf_dir).select("position", "event_type", "data", "ts")
    return eventlog.purge(e, "2024-02-09 00:00:00", 30, e.where("event_type = 'error'")).select("position", "purged", "data")


@query(f"WITH {LOG} SELECT position, ts AS created_at FROM log WHERE event_type = 'purchase' AND ts + to_seconds(CAST(value AS BIGINT)) <= TIMESTAMP '2024-01-10 00:00:00' ORDER BY created_at, position LIMIT 40")
def outbox_due(spark, sf_dir):
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round("value").cast("long") * 1_000_000)
    box = log(spark, sf_dir).select(F.col("position").alias("message_id"), F.when(F.col("event_type") == "purchase", "pending").otherwise("published").alias("status"), F.col("ts").alias("created_at"), at.alias("scheduled_at"))
    return eventlog.due(box, "2024-01-10 00:00:00", 40).select(F.col("message_id").alias("position"), "created_at")


@query(f"""WITH {LOG} SELECT position, round((CASE WHEN source <> '' THEN 1 ELSE 0 END + CASE WHEN event_type <> '' THEN 1 ELSE 0 END + CASE WHEN data IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN stream_id <> '' THEN 1 ELSE 0 END) / 4.0::DOUBLE, 6) AS completeness FROM log""")
def completeness_score(spark, sf_dir):
    e = log(spark, sf_dir)
    return e.select("position", F.round(quality.completeness([F.col(c) for c in ("source", "event_type", "data", "stream_id")]), 6).alias("completeness"))


@query(f"WITH {LOG} SELECT least(60.0::DOUBLE, power(2.0::DOUBLE, k)) AS delay, CAST(k + 1 AS BIGINT) AS attempt FROM range(0, 10) r(k)")
def retry_delays(spark, sf_dir):
    from ..functions import dates

    return spark.range(1, 11).select(dates.retry_delay(F.col("id")).alias("delay"), F.col("id").alias("attempt"))
