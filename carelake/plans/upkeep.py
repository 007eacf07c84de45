"""Queries of appends, rebuilds, queues, ledgers, summaries, event input and workflow transforms that look codes up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eventlog, records, workflow
from ..sources import eventinput
from .events import LOG, REPLAY, log, replay_diff
from .register import query, table
from .streams import _folders


@query(f"""WITH {LOG}, old AS (SELECT position, stream_id FROM log WHERE user_id % 2 = 0), new AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY position) - 1 AS v, row_number() OVER (ORDER BY position) AS n FROM log WHERE user_id % 2 <> 0)
SELECT stream_id, v AS stream_version, n + (SELECT max(position) FROM old) AS position, event_type FROM new""")
def event_append(spark, sf_dir):
    """The events of odd users appended to a log of the others'; each stream must not be there yet."""
    e = log(spark, sf_dir)
    old = eventlog.stream_versions(e.where("user_id % 2 = 0")).select("position", "stream_id", "stream_version")
    batch = e.where("user_id % 2 <> 0").select("stream_id", F.col("position").alias("seq"), F.lit(-1).cast("long").alias("expected_version"), "event_type")
    return eventlog.append(old, batch)[0].select("stream_id", "stream_version", "position", "event_type")


@query(f"WITH {LOG} SELECT event_type, count(*) AS events FROM log WHERE position >= 100 AND position < 900 GROUP BY 1")
def projection_rebuild(spark, sf_dir):
    return records.rebuilt(log(spark, sf_dir), lambda x: eventlog.counts_by(x, "event_type"), 100, 900)


@query(f"WITH {LOG} SELECT event_type, CAST(count(*) AS BIGINT) AS events FROM log GROUP BY 1")
def projection_from_snapshot(spark, sf_dir):
    e = log(spark, sf_dir)
    kept = eventlog.counts_by(e.where("position <= 400"), "event_type")
    return records.counts_from_snapshot(kept, e, "event_type", 400)


@query("SELECT o_orderkey AS message_id FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1997-01-01 00:00:00' AND o_orderstatus IN ('F', 'P'))")
def outbox_collected(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    box = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return records.without_old(box, "1997-01-31 00:00:00", 30).select("message_id")


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def dead_letter_page(spark, sf_dir):
    return records.queue_page(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("failed_at")), 25).select("id")


@query("WITH t AS (SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25) SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM t)")
def dead_letters_left(spark, sf_dir):
    return records.popped(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("failed_at")), 25)[1].select("id")


@query(f"WITH {LOG} SELECT DISTINCT stream_id FROM log WHERE starts_with(stream_id, 'user:1')")
def streams_by_prefix(spark, sf_dir):
    return records.streams_by_prefix(log(spark, sf_dir), "user:1")


@query(f"""WITH {REPLAY}, d AS (SELECT list_filter(after, lambda x: NOT list_contains(before, x)) AS added, list_filter(before, lambda x: NOT list_contains(after, x)) AS removed FROM both_runs)
SELECT count(*) AS events, count(*) FILTER (WHERE len(added) + len(removed) > 0) AS changed, CAST(sum(len(added)) AS BIGINT) AS added, CAST(sum(len(removed)) AS BIGINT) AS removed FROM d""")
def replay_summary(spark, sf_dir):
    d = replay_diff(spark, sf_dir)
    names = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return records.replay_summary(d.select("changed", names("added").alias("added"), names("removed").alias("removed")))


@query("SELECT count(*) AS codes, count(*) FILTER (WHERE s >= 0.9) AS mapped, count(*) FILTER (WHERE s >= 0.5 AND s < 0.9) AS review, count(*) FILTER (WHERE s IS NULL OR s < 0.5) AS none FROM (SELECT CASE WHEN p_size % 7 <> 0 THEN p_size / 50.0::DOUBLE END AS s FROM part)".replace(" AS none", ' AS "none"'))
def suggestion_report(spark, sf_dir):
    return records.suggestion_report(table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 50).alias("score")), 0.9, 0.5)


@query("SELECT p_brand AS kind, count(*) AS cases, round(avg(p_size / 50.0::DOUBLE), 9) AS mean, round(avg(CASE WHEN p_size >= 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS passed FROM part GROUP BY 1")
def evaluation_scores(spark, sf_dir):
    e = records.evaluation(table(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), (F.col("p_size") / 50).alias("score")), 0.6)
    return e.select("kind", "cases", F.round("mean", 9).alias("mean"), F.round("passed", 9).alias("passed"))


@query(f"WITH {LOG}, b AS (SELECT unnest([1, 10, 100, 1000]) AS le) SELECT event_type, source, le, count(*) FILTER (WHERE value <= le) AS count FROM log, b GROUP BY ALL".replace("AS count FROM", 'AS "count" FROM').replace("unnest([1, 10, 100, 1000])", "unnest([1.0::DOUBLE, 10, 100, 'Infinity'])"))
def duration_histogram(spark, sf_dir):
    e = log(spark, sf_dir).select("event_type", "source", (F.col("event_type") != "error").alias("success"), F.col("value").alias("seconds"))
    return records.metrics(e, [1.0, 10.0, 100.0]).groupBy("event_type", "source", "le").agg(F.sum("count").alias("count"))


@query("""WITH l AS (UNPIVOT (SELECT c_mktsegment AS segment, c_nationkey::VARCHAR AS nation FROM customer) ON segment, nation INTO NAME "column" VALUE value), n AS (SELECT "column", value, count(*) AS n FROM l GROUP BY ALL)
SELECT "column", value, n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place FROM n) WHERE place = 1""")
def most_common_values(spark, sf_dir):
    return records.most_common(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")), ["segment", "nation"])


OBJECTS = """files AS (SELECT 'o/' || o_orderkey AS path, CAST(o_totalprice AS BIGINT) AS length, o_orderdate AS modified, o_orderkey AS k FROM orders)"""


def _objects(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("o/"), "o_orderkey").alias("path"), F.round("o_totalprice").cast("long").alias("length"), F.col("o_orderdate").alias("modified"), F.col("o_orderkey").alias("k"))


@query(f"WITH {OBJECTS} SELECT path FROM files WHERE k % 3 <> 0 OR k % 5 = 0")
def batch_objects(spark, sf_dir):
    """Every third object was completed before, but every fifth has another length since."""
    f = _objects(spark, sf_dir)
    done = f.where("k % 3 = 0").select("path", F.when(F.col("k") % 5 == 0, F.col("length") + 1).otherwise(F.col("length")).alias("length"), "modified", F.lit("completed").alias("status"))
    return records.objects(f, done).select("path")


@query("""WITH r AS (SELECT l_orderkey AS k, count(*) AS records, count(*) FILTER (WHERE l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1)
SELECT 'o/' || o_orderkey AS path, CASE WHEN records IS NULL THEN 'claimed' WHEN failed > 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN failed = 0 THEN records ELSE 0 END AS "offset" FROM orders LEFT JOIN r ON k = o_orderkey""")
def batch_ledger(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("o/"), "l_orderkey").alias("path")).agg(F.count("*").alias("records"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    return records.ledger(_objects(spark, sf_dir), lines.withColumn("digest", F.sha2("path", 256))).select("path", "status", F.coalesce("offset", F.lit(0)).alias("offset"))


@query("SELECT conv_id, CAST(turn AS BIGINT) AS turn, role FROM conversations")
def event_input(spark, sf_dir):
    """Each conversation as lines of JSON, or as an array for every second one."""
    one = F.to_json(F.struct("turn", "role"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(one).alias("turns"))
    raw = F.when(F.xxhash64("conv_id") % 2 == 0, F.concat(F.lit(" ["), F.array_join("turns", ", "), F.lit("]"))).otherwise(F.array_join("turns", "\n\n"))
    e = eventinput.event_rows(c.select("conv_id", raw.alias("raw"))).where("error IS NULL")
    return e.select("conv_id", F.get_json_object("data", "$.turn").cast("long").alias("turn"), F.get_json_object("data", "$.role").alias("role"))


@query(f"WITH {LOG} SELECT event_type, count(*) AS events, CAST(sum(position) AS BIGINT) AS positions FROM log GROUP BY 1")
def archive_roundtrip(spark, sf_dir):
    rows = log(spark, sf_dir).select("position", "event_type", "data", F.col("ts").cast("timestamp").alias("ts"))
    folder = _folders(spark)[0]
    eventinput.write_archive(rows, folder)
    back = eventinput.read_archive(spark, folder, rows.schema)
    return back.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("position").alias("positions"))


MAPPED = f"""{LOG}, coded AS (SELECT position, json_extract_string(data, '$.k') AS code FROM log), m AS (SELECT p_partkey::VARCHAR AS code, min(('T' || p_size, 'to ' || p_brand || ' "x"')) AS best FROM part GROUP BY 1)"""


@query(f"""WITH {MAPPED} SELECT position, coalesce(struct_extract(best, 1), code) AS code, struct_extract(best, 2) AS display FROM coded LEFT JOIN m USING (code)""")
def workflow_map_terminology(spark, sf_dir):
    flow = workflow.load({"name": "w", "version": "1", "routes": [{"name": "r", "transform": [{"map_terminology": {"field": "event.test.code", "from": "local", "to": "std"}}], "actions": [{"type": "log"}]}]})
    mapping = table(spark, sf_dir, "part").select(F.lit("LOCAL").alias("source_system"), F.col("p_partkey").cast("string").alias("source_code"), F.lit("STD").alias("target_system"), F.concat(F.lit("T"), "p_size").alias("target_code"), F.concat(F.lit("to "), "p_brand", F.lit(' "x"')).alias("target_display"))
    e = log(spark, sf_dir).withColumn("data", F.to_json(F.struct(F.struct(F.get_json_object("data", "$.k").alias("code")).alias("test"))))
    out = workflow.transformed(e, flow.routes[0], mapping=mapping)
    return out.select("position", F.get_json_object("data", "$.test.code").alias("code"), F.get_json_object("data", "$.test.code_display").alias("display"))


@query(f"""WITH {LOG} SELECT position, CASE WHEN event_type = 'error' THEN 'Send dates as YYYYMMDD.' END AS fix, event_type = 'error' AS explained FROM log""")
def workflow_explain_warnings(spark, sf_dir):
    flow = workflow.load({"name": "w", "version": "1", "routes": [{"name": "r", "transform": [{"explain_warnings": {"include_fix": True}}], "actions": [{"type": "log"}]}]})
    code = F.when(F.col("event_type") == "error", "INVALID_DATE").otherwise("ODD")
    e = log(spark, sf_dir).withColumn("data", F.to_json(F.struct(F.array(F.struct(code.alias("code"), F.lit("m").alias("message"))).alias("warnings"))))
    out = workflow.transformed(e, flow.routes[0])
    return out.select("position", F.get_json_object("data", "$.warnings[0].fix_suggestion").alias("fix"), F.get_json_object("data", "$.warnings[0].explanation").isNotNull().alias("explained"))
