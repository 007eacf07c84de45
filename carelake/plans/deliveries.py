"""Queries of delivery and operator views: orders as outbox messages, line items as attempts, events as receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delivery
from .events import LOG, log
from .register import query, table


@query("""WITH r AS (SELECT o_orderkey AS receipt_id FROM orders), a AS (SELECT l_orderkey AS receipt_id, l_linestatus, l_returnflag FROM lineitem)
SELECT r.receipt_id, (SELECT count(*) FROM a WHERE a.receipt_id = r.receipt_id AND l_returnflag = 'R') AS events, (SELECT count(*) FROM a WHERE a.receipt_id = r.receipt_id) AS attempts,
  (SELECT count(*) FROM a WHERE a.receipt_id = r.receipt_id AND l_linestatus = 'O') AS queued, (SELECT count(*) FROM a WHERE a.receipt_id = r.receipt_id AND l_returnflag = 'A') AS dead_letters FROM r""")
def receipt_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("receipt_id"), F.when(F.col("l_linestatus") == "O", "queued").otherwise("done").alias("status"), "l_returnflag")
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("receipt_id"))
    return delivery.receipts(r, lines.where("l_returnflag = 'R'"), lines, lines.where("l_returnflag = 'A'"))


@query("""SELECT l_orderkey AS message_id, l_orderkey * 10 + l_linenumber AS attempt_id, o_orderpriority AS endpoint, CASE WHEN EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = l.l_orderkey AND r.l_linenumber = l.l_linenumber AND r.l_returnflag = 'R') THEN 'refused' END AS reason FROM lineitem l JOIN orders ON l_orderkey = o_orderkey""")
def attempts_view(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    attempts = lines.select(F.col("l_orderkey").alias("message_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("attempt_id"), "l_returnflag")
    outbox = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message_id"), F.col("o_orderpriority").alias("endpoint"))
    dead = attempts.where("l_returnflag = 'R'").select("attempt_id", F.lit("refused").alias("reason")).distinct()
    return delivery.attempts_view(attempts, outbox, dead).select("message_id", "attempt_id", "endpoint", "reason")


@query("""SELECT o_orderkey AS message_id, o_orderpriority AS endpoint FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1999-01-01 00:00:00' AND o_orderpriority NOT IN ('2-HIGH', '5-LOW') ORDER BY o_orderdate, o_orderkey LIMIT 30""")
def outbox_claim(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    outbox = o.select(F.col("o_orderkey").alias("message_id"), F.col("o_orderpriority").alias("endpoint"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("published").alias("status"), F.col("o_orderdate").cast("timestamp").alias("scheduled_at"), F.col("o_orderdate").alias("created_at"))
    circuits = spark.createDataFrame([("2-HIGH", "open"), ("1-URGENT", "closed"), ("5-LOW", "open")], "endpoint string, mode string")
    return delivery.claimable(outbox, circuits, "1999-01-01 00:00:00", 30).select("message_id", "endpoint")


@query("""WITH a AS (SELECT o_orderkey AS attempt_id, CASE o_orderstatus WHEN 'O' THEN 'leased' ELSE 'done' END AS status, o_orderdate AS lease_until FROM orders)
SELECT CASE WHEN status = 'leased' AND lease_until < TIMESTAMP '1998-06-01 00:00:00' THEN 'pending' ELSE status END AS status, count(*) AS attempts FROM a GROUP BY 1""")
def lease_reclaim(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("attempt_id"), F.when(F.col("o_orderstatus") == "O", "leased").otherwise("done").alias("status"), F.col("o_orderdate").cast("timestamp").alias("lease_until"))
    return delivery.expired_leases(a, "1998-06-01 00:00:00")[0].groupBy("status").agg(F.count("*").alias("attempts"))


@query("""SELECT o_orderkey AS message_id, CAST(0 AS BIGINT) AS attempts, 'pending' AS status FROM orders WHERE o_orderstatus = 'F'""")
def dead_letter_replay(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    dead = o.select(F.col("o_orderkey").alias("attempt_id"), F.when(F.col("o_orderstatus") == "F", "active").otherwise("resolved").alias("status"))
    attempts = o.select(F.col("o_orderkey").alias("attempt_id"), F.col("o_orderkey").alias("message_id"))
    outbox = o.select(F.col("o_orderkey").alias("message_id"), F.col("o_orderpriority").alias("endpoint"), F.lit("{}").alias("payload"))
    return delivery.resubmitted(dead, attempts, outbox).select("message_id", "attempts", "status")


@query("""WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'rejected' ELSE 'pending' END AS status, c_custkey % 10 < 7 AS live, CASE WHEN c_custkey % 2 = 0 THEN 'approved' WHEN c_custkey % 5 = 0 THEN 'rejected' END AS decision FROM customer)
SELECT CASE WHEN status = 'pending' AND live AND decision IS NOT NULL THEN decision WHEN status = 'pending' AND NOT live THEN 'expired' ELSE status END AS status, count(*) AS n FROM p GROUP BY 1""")
def mapping_review(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    pending = c.select(k.alias("id"), F.when(k % 9 == 0, "rejected").otherwise("pending").alias("status"), F.lit("c").alias("code"), F.lit("t").alias("target"), F.when(k % 10 < 7, "2025-01-01 00:00:00").otherwise("2023-01-01 00:00:00").cast("timestamp").alias("expires_at"))
    first = c.select(k.alias("id"), F.lit("rejected").alias("decision"), F.lit(1).alias("seq")).where("id % 2 = 0 OR id % 5 = 0")
    second = c.where("c_custkey % 2 = 0").select(k.alias("id"), F.lit("approved").alias("decision"), F.lit(2).alias("seq"))
    return delivery.reviewed(pending, first.unionByName(second), "2024-01-01 00:00:00")[0].groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS id, c_name AS family FROM customer WHERE contains(lower(c_name), '00012')""")
def patient_search(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("mrn"), F.col("c_name").alias("family"), F.lit(None).cast("string").alias("given"))
    return delivery.patient_search(p, "00012").select("id", "family")


@query(f"""WITH {LOG} SELECT stream_id, count(*) AS events, CAST(round(sum(CAST(value AS DECIMAL(12, 2))), 4) AS DOUBLE) AS total, arg_max(event_type, position) AS last_type, max(position) AS position FROM log GROUP BY 1 HAVING count(*) >= 60""")
def stream_compaction(spark, sf_dir):
    e = log(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(12,2)"))
    busy = e.groupBy("stream_id").agg(F.count("*").alias("n")).where("n >= 60")
    return delivery.compacted(e, busy, "value")[0].withColumn("total", F.col("total").cast("double"))


@query(f"""WITH {LOG}, v AS (SELECT stream_id, count(*) - 1 AS version FROM log GROUP BY 1), k AS (SELECT stream_id, version - CAST(regexp_extract(stream_id, '[0-9]+') AS BIGINT) % 40 AS kept, version % 2 = 0 AS old FROM v WHERE CAST(regexp_extract(stream_id, '[0-9]+') AS BIGINT) % 3 <> 0)
SELECT stream_id, version FROM v LEFT JOIN k USING (stream_id) WHERE version - coalesce(kept, -1) >= 20 AND (kept IS NULL OR old)""")
def snapshots_due(spark, sf_dir):
    v = log(spark, sf_dir).groupBy("stream_id").agg((F.count("*") - 1).alias("version"))
    k = F.split_part("stream_id", F.lit(":"), F.lit(2)).cast("long")
    kept = v.where(k % 3 != 0).select("stream_id", (F.col("version") - k % 40).alias("version"), F.when(F.col("version") % 2 == 0, "2024-01-01 00:00:00").otherwise("2024-01-01 00:59:00").cast("timestamp").alias("at"))
    return delivery.snapshots_due(v, kept, 20, 300, F.lit("2024-01-01 01:00:00").cast("timestamp"))


@query("""WITH s AS (SELECT l_orderkey AS saga, l_linenumber AS n, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2), b AS (SELECT saga, min(CASE WHEN flag = 'R' THEN n END) AS failed_at, count(*) AS steps, count(*) FILTER (WHERE flag = 'A') AS done FROM s GROUP BY 1)
SELECT b.saga, CASE WHEN failed_at IS NOT NULL THEN 'compensated' WHEN done = steps THEN 'completed' ELSE 'running' END AS status, coalesce((SELECT string_agg('s' || n, ',' ORDER BY n DESC) FROM s WHERE s.saga = b.saga AND flag = 'A' AND failed_at IS NOT NULL AND n < failed_at), '') AS undo FROM b""")
def saga_outcomes(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("saga"), F.col("l_linenumber").alias("n")).agg(F.min("l_returnflag").alias("flag"))
    steps = s.select("saga", "n", F.concat(F.lit("s"), "n").alias("name"))
    results = s.where("flag <> 'N'").select("saga", "n", (F.col("flag") == "A").alias("ok"))
    out = delivery.saga(steps, results)
    return out.select("saga", "status", F.array_join("undo", ",").alias("undo"))


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence FROM conversations""")
def session_sequence(spark, sf_dir):
    return delivery.numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")
