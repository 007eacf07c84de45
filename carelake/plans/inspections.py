"""Queries of sinks, simulation, load and inspection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inspection, sinks, workflow
from ..sources import hl7v2
from .events import LOG, ROUTES, WORKFLOW, log
from .messages import hl7_messages
from .register import query, table


@query(f"WITH {ROUTES} SELECT route, CASE route WHEN 'large-purchases' THEN 'queue' WHEN 'errors' THEN 'log' ELSE 'file' END AS action, count(*) AS invocations FROM routed GROUP BY 1, 2")
def workflow_simulation(spark, sf_dir):
    return inspection.simulate(log(spark, sf_dir), workflow.load(WORKFLOW))


@query(f"WITH {ROUTES}, r AS (SELECT position, string_agg(route, ',' ORDER BY CASE route WHEN 'large-purchases' THEN 1 WHEN 'errors' THEN 2 ELSE 3 END) AS routes FROM routed GROUP BY 1) SELECT log.position, coalesce(routes, '') AS routes FROM log LEFT JOIN r ON log.position = r.position")
def workflow_recording(spark, sf_dir):
    return inspection.record(log(spark, sf_dir), workflow.load(WORKFLOW)).select("position", F.array_join("routes", ",").alias("routes"))


@query(f"WITH {LOG} SELECT position, json_extract_string(data, '$.k') AS k, event_type AS kind FROM log")
def database_projection(spark, sf_dir):
    return sinks.projected(log(spark, sf_dir), {"position": "position", "k": "event.k", "kind": "event_type"})


@query(f"""WITH {LOG}, old AS (SELECT stream_id, arg_max(event_type, position) AS event_type, arg_max(value, position) AS value FROM log WHERE position % 2 = 0 GROUP BY 1),
new AS (SELECT stream_id, arg_max(event_type, position) AS event_type, arg_max(value, position) AS value FROM log WHERE position % 2 <> 0 GROUP BY 1)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE stream_id NOT IN (SELECT stream_id FROM new)""")
def database_upsert(spark, sf_dir):
    e = log(spark, sf_dir)
    old = e.where("position % 2 = 0").groupBy("stream_id").agg(F.max_by("event_type", "position").alias("event_type"), F.max_by("value", "position").alias("value"))
    return sinks.upsert(old, e.where("position % 2 <> 0"), ["stream_id"], "position")


@query(f"WITH {LOG} SELECT 'events' AS topic, stream_id AS key, position FROM log")
def queue_messages(spark, sf_dir):
    q = sinks.queue_rows(log(spark, sf_dir), "events", "event.stream_id", {"source": "log"})
    return q.select("topic", "key", F.get_json_object("value", "$.position").cast("long").alias("position"))


@query(f"WITH {LOG} SELECT path, kind, count(*) AS n FROM (SELECT unnest([('$', 'object'), ('k', 'number')]) AS s, struct_extract(s, 1) AS path, struct_extract(s, 2) AS kind FROM log) GROUP BY 1, 2")
def payload_shape(spark, sf_dir):
    each = log(spark, sf_dir).select(F.explode(inspection.payload_shape(F.col("data"))).alias("s")).select("s.*")
    return each.groupBy("path", "kind").agg(F.count("*").alias("n"))


@query("SELECT segment, CAST(field AS INTEGER) AS field, (SELECT count(*) FROM customer) AS messages, masked FROM (VALUES ('PID', 3, true), ('PID', 5, true), ('PID', 7, true), ('PID', 8, false), ('PID', 1, false), ('PV1', 1, false), ('PV1', 2, false), ('PV1', 3, false)) v(segment, field, masked)")
def field_lineage(spark, sf_dir):
    parsed = hl7v2.parse(hl7_messages(spark, sf_dir))
    rows = inspection.lineage(parsed, "control_id").where("segment IN ('PID', 'PV1')")
    return rows.groupBy("segment", "field").agg(F.count("*").alias("messages"), F.bool_and(F.col("preview") == "***").alias("masked"))


@query("SELECT (SELECT count(*) FROM customer) AS messages, 'ADT^A01' AS type, '2.5' AS version, '' AS optional_segments")
def source_profile(spark, sf_dir):
    p = inspection.source_profile(hl7v2.parse(hl7_messages(spark, sf_dir)))
    return p.select("messages", "type", "version", F.array_join("optional_segments", ",").alias("optional_segments"))


@query("""WITH b AS (SELECT o_orderpriority AS name, min(o_totalprice) AS baseline FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), c AS (SELECT o_orderpriority AS name, min(o_totalprice) AS current FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT name, baseline, current, round(current / baseline, 6) AS ratio, CASE WHEN baseline IS NULL THEN 'new' WHEN current IS NULL THEN 'missing' WHEN current / baseline > 1.6 THEN 'slower' WHEN current / baseline < 1 / 1.6::DOUBLE THEN 'faster' ELSE 'same' END AS verdict FROM b FULL OUTER JOIN c USING (name)""")
def benchmark_comparison(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("value"), "o_orderkey")
    return inspection.compare_runs(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"))


@query("SELECT CAST(i AS BIGINT) AS position, CAST(epoch_ms(CAST(1704067200000 + i * 1000 AS BIGINT)) AS TIMESTAMP) AS ts, CASE i % 2 WHEN 0 THEN 'a' ELSE 'b' END AS source FROM range(0, 1000) r(i)")
def synthetic_load(spark, sf_dir):
    return inspection.load(spark, 1000, {"admit": 0.5, "result": 0.3, "discharge": 0.2}, 7, ["a", "b"]).select("position", F.col("ts").cast("timestamp_ntz").alias("ts"), "source")
