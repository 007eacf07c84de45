"""Queries of claims: orders as claims, line items as service lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import claims
from .register import query, table


@query("""SELECT l_orderkey AS claim, count(*) AS lines, round(sum(l_extendedprice), 2) AS charged, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))), 2) AS DOUBLE) AS paid FROM lineitem GROUP BY 1""")
def claim_totals(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_extendedprice").alias("amount"), (F.expr("CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))")).alias("paid"))
    return claims.totals(lines, "claim", "amount", "paid").withColumn("paid", F.col("paid").cast("double"))


@query("""SELECT l_orderkey AS claim, string_agg(l_linenumber || ':' || l_partkey, ';' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY 1""")
def claim_lines_nested(spark, sf_dir):
    lines = claims.nested(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_partkey"])
    text = F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"]))
    return lines.select(F.col("l_orderkey").alias("claim"), F.array_join(text, ";").alias("lines"))


ADJUSTED = """adjusted AS (SELECT l_orderkey AS claim, l_extendedprice AS submitted, CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) AS benefit, CASE l_returnflag WHEN 'A' THEN 'CO' WHEN 'N' THEN 'PR' ELSE 'OA' END AS grp, CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_discount AS DECIMAL(4, 2)) AS amount FROM lineitem)"""


def _adjusted(spark, sf_dir) -> DataFrame:
    group = F.when(F.col("l_returnflag") == "A", "CO").when(F.col("l_returnflag") == "N", "PR").otherwise("OA")
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), price.alias("submitted"), F.expr("CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))").alias("benefit"), group.alias("group"), F.expr("CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_discount AS DECIMAL(4, 2))").alias("amount"))


@query(f"""WITH {ADJUSTED} SELECT claim, round(sum(submitted), 2) AS submitted, CAST(round(sum(benefit), 2) AS DOUBLE) AS benefit, """ + ", ".join(f"CAST(round(sum(CASE WHEN grp = '{g}' THEN amount ELSE 0 END), 2) AS DOUBLE) AS adjusted_{g.lower()}" for g in ("CO", "OA", "PI", "PR")) + " FROM adjusted GROUP BY claim")
def eob_adjudication(spark, sf_dir):
    out = claims.explained(_adjusted(spark, sf_dir), "claim")
    return out.select([F.col(c).cast("double") if c not in ("claim",) else F.col(c) for c in out.columns])


BENEFITS = """benefits AS (SELECT p_type AS service_type, p_partkey % 3 <> 0 AS in_network, p_retailprice AS amount, CAST(1 + p_partkey % 8 AS VARCHAR) AS info_code, p_brand AS member FROM part)"""


def _benefits(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("service_type"), (k % 3 != 0).alias("in_network"), F.col("p_retailprice").alias("amount"), (1 + k % 8).cast("string").alias("info_code"), F.col("p_brand").alias("member"), "p_size")


@query(f"WITH {BENEFITS} SELECT service_type, in_network, count(*) AS benefits, round(max(amount), 2) AS highest, array_to_string(list_sort(list_distinct(list(info_code))), ',') AS codes FROM benefits GROUP BY 1, 2")
def benefit_grouping(spark, sf_dir):
    return claims.benefits(_benefits(spark, sf_dir))


@query(f"WITH {BENEFITS} SELECT member, CASE WHEN bool_or(info_code IN ('6', '7', '8')) THEN 'inactive' WHEN bool_or(info_code IN ('1', '2', '3', '4', '5')) THEN 'active' ELSE 'unknown' END AS status FROM benefits GROUP BY 1")
def eligibility_status(spark, sf_dir):
    return claims.eligibility(_benefits(spark, sf_dir), "member")


@query("""WITH c AS (SELECT o_orderkey AS claim, CASE o_orderstatus WHEN 'F' THEN 'F1:65' WHEN 'O' THEN 'P1:20' ELSE 'F2:88' END AS stc FROM orders)
SELECT claim, CASE stc WHEN 'F1:65' THEN 'paid' WHEN 'P1:20' THEN 'pending' ELSE 'denied' END AS status FROM c""")
def claim_status(spark, sf_dir):
    stc = F.when(F.col("o_orderstatus") == "F", "F1:65").when(F.col("o_orderstatus") == "O", "P1:20").otherwise("F2:88")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim"), claims.claim_status(stc).alias("status"))


@query("""WITH a AS (SELECT l_orderkey AS claim, l_linenumber AS line, l_partkey AS part, l_quantity AS q, l_tax AS t FROM lineitem)
SELECT claim, line, part, CAST(CASE WHEN t = 0 THEN 1 ELSE 2 END AS BIGINT) AS adjustments, round(q + t * 100, 2) AS patient FROM a""")
def cas_adjustments(spark, sf_dir):
    segment = F.array(F.lit("CAS"), F.lit("PR"), F.lit("1"), F.col("l_quantity").cast("string"), F.lit(""), F.when(F.col("l_tax") == 0, "").otherwise("2"), (F.col("l_tax") * 100).cast("string"))
    rows = table(spark, sf_dir, "lineitem").withColumn("segment", segment)
    return rows.select(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.size(claims.adjustments(F.col("segment"))).cast("long").alias("adjustments"), F.round(claims.patient_share(F.col("segment")), 2).alias("patient"))


@query("""SELECT o_custkey AS provider, count(*) AS claims, CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) AS charged, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS paid FROM orders GROUP BY 1""")
def claims_by_provider(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("provider")).agg(F.count("*").alias("claims"), F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double").alias("charged"), F.count_if(F.col("o_orderstatus") == "F").alias("paid"))
