"""Queries of terminologies: nations and regions as a hierarchy of codes, parts as concepts, embeddings as a vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import terminology
from .register import query, table

#: Parts as concepts of two sources that share a concept id by name and type.
CONCEPTS = """concepts AS (SELECT p_name || ':' || (p_partkey % 40) AS cui, CASE WHEN p_partkey % 2 = 0 THEN 'LOCAL' ELSE 'STANDARD' END AS source, 'C' || p_partkey AS code, p_name || ' ' || lower(p_type) AS name,
  CASE WHEN p_partkey % 3 = 0 THEN 'N' ELSE 'Y' END AS is_preferred, p_size AS rank FROM part)"""


def concepts(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat("p_name", F.lit(":"), (k % 40).cast("string")).alias("cui"),
        F.when(k % 2 == 0, "LOCAL").otherwise("STANDARD").alias("source"), F.concat(F.lit("C"), k.cast("string")).alias("code"), F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("name"),
        F.when(k % 3 == 0, "N").otherwise("Y").alias("is_preferred"), F.col("p_size").alias("rank"),
    )


@query(f"""WITH {CONCEPTS}, s AS (SELECT DISTINCT code, cui AS c FROM concepts WHERE source = 'LOCAL'), t AS (SELECT cui AS c, code AS target_code, name AS target_name, rank FROM concepts WHERE source = 'LOCAL' AND is_preferred = 'Y')
SELECT code, target_code, arg_min(target_name, (rank, target_name)) AS target_name FROM s JOIN t USING (c) GROUP BY 1, 2""")
def crosswalk_concepts(spark, sf_dir):
    c = concepts(spark, sf_dir)
    return terminology.crosswalk(c, c.select("code"), "LOCAL", "LOCAL")


@query("SELECT n.n_nationkey AS code, n.n_name AS name, r.r_name AS target FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def crosswalk_nation_region(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("target"))


MAPPINGS = """mappings AS (SELECT 'ERP' AS system, 'b' || p_partkey AS code, 'STD' AS target_system, 'P' || p_size AS target_code, 'site' AS profile FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT 'erp', 'B' || p_partkey, 'STD', 'G' || p_size, NULL FROM part WHERE p_partkey % 3 = 0)"""


def mappings(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    own = p.where(k % 4 == 0).select(F.lit("ERP").alias("system"), F.concat(F.lit("b"), k).alias("code"), F.lit("STD").alias("target_system"), F.concat(F.lit("P"), size).alias("target_code"), F.lit("site").alias("profile"))
    general = p.where(k % 3 == 0).select(F.lit("erp").alias("system"), F.concat(F.lit("B"), k).alias("code"), F.lit("STD").alias("target_system"), F.concat(F.lit("G"), size).alias("target_code"), F.lit(None).cast("string").alias("profile"))
    return own.unionByName(general)


@query(f"""WITH {MAPPINGS}, asked AS (SELECT 'Erp' AS system, 'B' || p_partkey AS code FROM part),
r AS (SELECT a.system, a.code, m.target_system, m.target_code, m.profile, row_number() OVER (PARTITION BY a.code ORDER BY m.profile IS NULL) AS n FROM asked a LEFT JOIN mappings m ON upper(a.system) = upper(m.system) AND upper(a.code) = upper(m.code))
SELECT system, code, target_system, target_code, profile IS NOT NULL AS from_profile FROM r WHERE n = 1""")
def mapping_lookup_fallback(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.lit("Erp").alias("system"), F.concat(F.lit("B"), F.col("p_partkey")).alias("code"))
    return terminology.lookup(asked, mappings(spark, sf_dir), "site")


@query("""SELECT DISTINCT l_orderkey AS panel, l_partkey AS member, p_name AS name, l_linenumber AS sequence FROM lineitem JOIN part ON l_partkey = p_partkey""")
def panel_expand(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("panel"), F.col("l_partkey").alias("member"), F.col("l_linenumber").alias("sequence")).distinct()
    return terminology.panel_members(lines, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name")))


@query("""WITH rel AS (SELECT 'N' || n_nationkey AS cui1, 'isa' AS relation, 'R' || (n_regionkey * 2) AS cui2 FROM nation), c AS (SELECT 'R' || r_regionkey AS cui, r_name AS name FROM region)
SELECT cui1, relation, cui2, name FROM rel LEFT JOIN c ON cui2 = cui ORDER BY cui1, relation, cui2 LIMIT 100""")
def relation_left_join(spark, sf_dir):
    rel = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("cui1"), F.lit("isa").alias("relation"), F.concat(F.lit("R"), F.col("n_regionkey") * 2).alias("cui2"))
    names = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("cui"), F.col("r_name").alias("name"), F.lit("Y").alias("is_preferred"))
    return terminology.relations(rel, names).select("cui1", "relation", "cui2", "name")


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS descendant, 'r' || n_regionkey AS ancestor FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region),
up AS (SELECT descendant, ancestor, 1 AS depth FROM e UNION ALL SELECT u.descendant, e.ancestor, u.depth + 1 FROM up u JOIN e ON e.descendant = u.ancestor)
SELECT descendant, ancestor, CAST(min(depth) AS BIGINT) AS depth FROM up GROUP BY 1, 2""")
def closure_region_nation(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    return terminology.closure(n.unionByName(r), "child", "parent", spark)


@query(f"WITH {CONCEPTS} SELECT code, name FROM concepts WHERE contains(lower(name), 'bolt') ORDER BY CASE is_preferred WHEN 'Y' THEN 0 ELSE 1 END, length(name), name, code LIMIT 20")
def ranked_text_search(spark, sf_dir):
    return terminology.text_search(concepts(spark, sf_dir), "Bolt", 20).select("code", "name")


@query(f"""WITH {CONCEPTS} SELECT code, round(0.7::DOUBLE + 0.2::DOUBLE * 4 / length(name), 9) AS confidence FROM concepts WHERE contains(lower(name), 'ring') AND NOT starts_with(lower(name), 'ring') ORDER BY confidence DESC, code LIMIT 15""")
def fuzzy_search(spark, sf_dir):
    return terminology.fuzzy(concepts(spark, sf_dir), "ring", 15, 0.7).select("code", F.round("confidence", 9).alias("confidence"))


DECISIONS = """decisions AS (SELECT event_type AS type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 100) / 100.0::DOUBLE END AS confidence, value AS millis FROM events)"""


@query(f"""WITH {DECISIONS}, e AS (SELECT type, count(*) AS n, avg(confidence) AS c, avg(millis) AS m FROM decisions GROUP BY type)
SELECT CAST(sum(n) AS BIGINT) AS decisions, round(sum(n * coalesce(c, 0)) / sum(n), 6) AS confidence, round(sum(n * coalesce(m, 0)) / sum(n), 6) AS millis FROM e""")
def decision_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return terminology.decision_stats(e.select(F.col("event_type").alias("type"), F.when(k % 5 != 0, (k % 100) / 100).alias("confidence"), F.col("value").alias("millis")))


@query(f"WITH {DECISIONS} SELECT CASE WHEN confidence >= 0.9 THEN 'auto' WHEN confidence >= 0.7 THEN 'review' ELSE 'none' END AS decision, count(*) AS n FROM decisions GROUP BY 1")
def decision_classes(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(terminology.decision(F.when(k % 5 != 0, (k % 100) / 100)).alias("decision")).groupBy("decision").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'pending' END AS status, ts AS expires FROM events)
SELECT CASE WHEN status = 'pending' AND expires < TIMESTAMP '2024-01-16 00:00:00' THEN 'expired' ELSE status END AS status, count(*) AS n FROM p GROUP BY 1""")
def pending_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "rejected").otherwise("pending").alias("status"), F.col("ts").cast("timestamp").alias("expires"))
    now = F.lit("2024-01-16 00:00:00").cast("timestamp")
    return e.groupBy(terminology.effective_status(F.col("status"), F.col("expires"), now).alias("status")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT 'C' || p_partkey AS code, p_size / 50.0::DOUBLE AS confidence FROM part), s AS (SELECT 'C' || (p_partkey + 15) AS code, (p_partkey % 10) / 10.0::DOUBLE AS score FROM part)
SELECT coalesce(e.code, s.code) AS code, round(coalesce(greatest(CASE WHEN s.code IS NOT NULL THEN confidence END, 0.6::DOUBLE * confidence + 0.4::DOUBLE * score), confidence, 0.4::DOUBLE * score), 9) AS score FROM e FULL OUTER JOIN s ON e.code = s.code""")
def hybrid_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    e = p.select(F.concat(F.lit("C"), "p_partkey").alias("code"), (F.col("p_size") / 50).alias("confidence"))
    s = p.select(F.concat(F.lit("C"), (F.col("p_partkey") + 15).cast("string")).alias("code"), ((F.col("p_partkey") % 10) / 10).alias("score"))
    return terminology.hybrid(e, s, 0.4).select("code", F.round("score", 9).alias("score"))


@query("""WITH f AS (SELECT c_nationkey AS code, c_mktsegment AS target, c_acctbal > 0 AS accepted FROM customer), t AS (SELECT code, target, 0.95::DOUBLE + 0.01::DOUBLE * count(*) AS score FROM f WHERE accepted GROUP BY 1, 2),
s AS (SELECT s_nationkey AS code, 'MACHINERY' AS target, max((s_suppkey % 10) / 9.0::DOUBLE) AS score FROM supplier GROUP BY 1), u AS (SELECT *, 'feedback' AS strategy FROM t UNION ALL SELECT *, 'semantic' FROM s),
b AS (SELECT code, target, max(score) AS score, arg_max(strategy, score) AS strategy FROM u GROUP BY 1, 2 HAVING max(score) >= 0.5)
SELECT code, target, round(score, 9) AS score, strategy, place FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY score DESC, target) AS place FROM b) WHERE place <= 3""")
def suggestion_merge(spark, sf_dir):
    f = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("code"), F.col("c_mktsegment").alias("target"), (F.col("c_acctbal") > 0).alias("accepted"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("code")).agg(F.max((F.col("s_suppkey") % 10) / 9).alias("score")).withColumn("target", F.lit("MACHINERY"))
    return terminology.suggestions(f, s, 3, 0.5).withColumn("score", F.round("score", 9)).select("code", "target", "score", "strategy", "place")


@query(f"""WITH {MAPPINGS}, m AS (SELECT upper(code) AS code, min(target_code) AS mapped FROM mappings WHERE profile = 'site' GROUP BY 1), s AS (SELECT 'B' || p_partkey AS code, max((p_retailprice % 100 / 100.0::DOUBLE, p_brand)) AS hit FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT a.code, coalesce(mapped, CASE WHEN struct_extract(hit, 1) >= 0.9 THEN struct_extract(hit, 2) END) AS target, CASE WHEN mapped IS NOT NULL THEN 'mapping' WHEN struct_extract(hit, 1) >= 0.9 THEN 'autoroute' ELSE 'none' END AS via
FROM (SELECT 'B' || p_partkey AS code FROM part) a LEFT JOIN m USING (code) LEFT JOIN s USING (code)""")
def resolve_cascade(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    code = F.concat(F.lit("B"), "p_partkey").alias("code")
    stored = mappings(spark, sf_dir).where("profile = 'site'").select(F.upper("code").alias("code"), F.col("target_code").alias("target"))
    semantic = p.where("p_partkey % 2 = 0").select(code, (F.col("p_retailprice") % 100 / 100).alias("score"), F.col("p_brand").alias("target"))
    return terminology.resolve(p.select(code), stored, semantic)


@query("""WITH c AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN (p_partkey % 99999) || '-' || (p_partkey % 10) WHEN 1 THEN 'E11.' || (p_partkey % 100) WHEN 2 THEN '9' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') WHEN 3 THEN (100000 + p_partkey)::VARCHAR WHEN 4 THEN 'J' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') ELSE 'x' || p_partkey END AS code FROM part)
SELECT k, code, CASE p_partkey_class WHEN 0 THEN 'LOINC' WHEN 1 THEN 'ICD-10-CM' WHEN 2 THEN 'CPT' WHEN 3 THEN 'SNOMED' WHEN 4 THEN 'HCPCS' ELSE 'unknown' END AS system FROM (SELECT *, k % 6 AS p_partkey_class FROM c)""")
def code_system_inference(spark, sf_dir):
    k = F.col("p_partkey")
    four = F.lpad((k % 10000).cast("string"), 4, "0")
    code = (
        F.when(k % 6 == 0, F.concat((k % 99999).cast("string"), F.lit("-"), (k % 10).cast("string"))).when(k % 6 == 1, F.concat(F.lit("E11."), (k % 100).cast("string"))).when(k % 6 == 2, F.concat(F.lit("9"), four))
        .when(k % 6 == 3, (100000 + k).cast("string")).when(k % 6 == 4, F.concat(F.lit("J"), four)).otherwise(F.concat(F.lit("x"), k.cast("string")))
    )
    return table(spark, sf_dir, "part").select(k.alias("k"), code.alias("code")).select("k", "code", terminology.code_system(F.col("code")).alias("system"))


@query("""WITH u AS (SELECT c_custkey AS row, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE 'ERP' END AS a, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'c' END AS b, CASE c_custkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN '1.5' WHEN 2 THEN '' ELSE '0.5' END AS confidence FROM customer)
SELECT row, array_to_string(list_filter([CASE WHEN trim(a) = '' THEN 'MISSING_SOURCE_SYSTEM' END, CASE WHEN b IS NULL THEN 'MISSING_SOURCE_CODE' END, CASE WHEN confidence = 'x' THEN 'INVALID_CONFIDENCE' WHEN confidence = '1.5' THEN 'CONFIDENCE_RANGE' END], lambda x: x IS NOT NULL), ',') AS errors FROM u""".replace(" AS row", ' AS "row"').replace("SELECT row,", 'SELECT "row",'))
def mapping_upload_validation(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("row"), F.when(k % 7 == 0, " ").otherwise("ERP").alias("source_system"), F.when(k % 11 != 0, "c").alias("source_code"), F.lit("STD").alias("target_system"), F.lit("t").alias("target_code"),
        F.when(k % 5 == 0, "x").when(k % 5 == 1, "1.5").when(k % 5 == 2, "").otherwise("0.5").alias("confidence"),
    )
    return terminology.upload_errors(rows).select("row", F.array_join("errors", ",").alias("errors"))


@query("SELECT p_partkey AS k, substr(d, 1, 5) || '-' || substr(d, 6, 4) || '-' || substr(d, 10, 2) AS ndc FROM (SELECT p_partkey, lpad(p_partkey::VARCHAR, 11, '0') AS d FROM part)")
def ndc_format(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), terminology.ndc(F.lpad(F.col("p_partkey").cast("string"), 11, "0")).alias("ndc"))


@query("""WITH b AS (SELECT event_id AS seq, user_id % 13 AS k FROM events), o AS (SELECT k, min(seq) AS seq FROM b GROUP BY k), n AS (SELECT * FROM o WHERE k NOT IN (0, 1, 2))
SELECT count(*) AS created, (SELECT count(*) FROM b) - count(*) AS duplicate FROM n""")
def mapping_insert_counts(spark, sf_dir):
    b = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 13).alias("k"))
    return terminology.insert_mappings(spark.range(3).select(F.col("id").alias("k")), b, ["k"])[1]


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 5) AS score FROM e q JOIN e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s WHERE score >= 0.1) WHERE place <= 5""")
def semantic_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return terminology.top_k(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked")), e, 5, 0.1)
