"""Queries of terminology releases: parts as drugs, diagnoses and laboratory codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codelists
from ..operators import lookups
from .codes import CONCEPTS, concepts
from .register import query, table

#: Parts as drugs: a term type by key, some of them suppressed; each has a national code, with dashes for every third.
DRUGS = """drugs AS (SELECT 'R' || p_partkey AS rxcui, ['IN', 'BN', 'SCD', 'SBD', 'DF'][CAST(1 + p_partkey % 5 AS INTEGER)] AS tty, lower(p_name) || ' ' || p_size AS name, CASE WHEN p_partkey % 11 = 0 THEN 'Y' ELSE 'N' END AS suppress, 1 AS release_id, p_partkey AS k FROM part)"""


def drugs(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    tty = F.get(F.array(*[F.lit(x) for x in ("IN", "BN", "SCD", "SBD", "DF")]), (k % 5).cast("int"))
    name = F.concat(F.lower("p_name"), F.lit(" "), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("R"), k).alias("rxcui"), tty.alias("tty"), name.alias("name"), F.when(k % 11 == 0, "Y").otherwise("N").alias("suppress"), F.lit(1).alias("release_id"), k.alias("k"))


def _dashed(digits):
    return F.concat_ws("-", F.substring(digits, 1, 5), F.substring(digits, 6, 4), F.substring(digits, 10, 2))


def xref(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    digits = F.lpad(k.cast("string"), 11, "0")
    return table(spark, sf_dir, "part").select(F.when(k % 3 == 0, _dashed(digits)).otherwise(digits).alias("ndc"), F.concat(F.lit("R"), k).alias("rxcui"), F.lit(1).alias("release_id"))


@query(f"WITH {DRUGS} SELECT lpad(k::VARCHAR, 11, '0') AS ndc, rxcui, tty, name FROM drugs WHERE suppress = 'N' AND tty IN ('SCD', 'SBD', 'GPCK', 'BPCK')")
def drugs_of_ndc(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 11, "0").alias("ndc"))
    return lookups.drugs_of_ndc(asked, xref(spark, sf_dir), drugs(spark, sf_dir))


@query("SELECT 'R' || p_partkey AS rxcui, substr(d, 1, 5) || '-' || substr(d, 6, 4) || '-' || substr(d, 10, 2) AS ndc FROM (SELECT p_partkey, lpad(p_partkey::VARCHAR, 11, '0') AS d FROM part)")
def ndcs_of_drug(spark, sf_dir):
    return lookups.ndcs_of(drugs(spark, sf_dir), xref(spark, sf_dir))


def relations(spark, sf_dir, rela: str, a: str, b: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("R"), c)
    return table(spark, sf_dir, "lineitem").select(name(a).alias("rxcui1"), F.lit(rela).alias("rela"), name(b).alias("rxcui2"), F.lit(1).alias("release_id"))


@query(f"WITH {DRUGS} SELECT 'R' || l_partkey AS rxcui, d.rxcui AS ingredient, d.name FROM lineitem JOIN drugs d ON d.rxcui = 'R' || l_suppkey JOIN part ON p_partkey = l_partkey WHERE d.suppress = 'N' AND d.tty = 'IN'")
def drug_ingredients(spark, sf_dir):
    own = drugs(spark, sf_dir)
    return lookups.ingredients(own, relations(spark, sf_dir, "has_ingredient", "l_partkey", "l_suppkey"), own)


@query(f"WITH {DRUGS} SELECT DISTINCT 'R' || l_suppkey AS rxcui, d.rxcui AS brand, d.name FROM lineitem JOIN drugs d ON d.rxcui = 'R' || l_partkey JOIN part ON p_partkey = l_suppkey WHERE d.suppress = 'N' AND d.tty = 'BN'")
def drug_brand_names(spark, sf_dir):
    own = drugs(spark, sf_dir)
    return lookups.brand_names(own, relations(spark, sf_dir, "tradename_of", "l_partkey", "l_suppkey"), own)


@query(f"WITH {DRUGS} SELECT rxcui, tty, name FROM drugs WHERE contains(name, 'bolt') AND suppress = 'N' ORDER BY CASE tty WHEN 'IN' THEN 0 WHEN 'BN' THEN 1 WHEN 'SCD' THEN 2 WHEN 'SBD' THEN 3 ELSE 4 END, length(name), name, rxcui LIMIT 40")
def drug_search(spark, sf_dir):
    return lookups.drug_search(drugs(spark, sf_dir), "Bolt", 40).select("rxcui", "tty", "name")


@query(f"WITH {CONCEPTS} SELECT source, count(*) AS concepts FROM concepts GROUP BY 1")
def concepts_by_source(spark, sf_dir):
    return lookups.counts_by_source(concepts(spark, sf_dir))


@query("SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier".replace("AS rows", 'AS "rows"'))
def terminology_counts(spark, sf_dir):
    return lookups.table_counts({n: table(spark, sf_dir, n) for n in ("nation", "part", "supplier")})


@query(f"WITH {CONCEPTS}, asked AS (SELECT DISTINCT 'LOCAL' AS source, 'C' || l_partkey AS code FROM lineitem) SELECT cui, code, name FROM concepts JOIN asked USING (source, code)")
def concepts_by_code(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select(F.lit("LOCAL").alias("source"), F.concat(F.lit("C"), "l_partkey").alias("code"))
    return lookups.by_code(concepts(spark, sf_dir), asked).select("cui", "code", "name")


@query(f"WITH {CONCEPTS} SELECT DISTINCT cui, p_type AS sty FROM concepts JOIN part ON code = 'C' || p_partkey")
def semantic_types(spark, sf_dir):
    c = concepts(spark, sf_dir)
    types = c.join(table(spark, sf_dir, "part").select(F.concat(F.lit("C"), "p_partkey").alias("code"), F.col("p_type").alias("sty")), "code")
    return lookups.semantic_types(types, c)


#: Parts as diagnoses: a letter and three digits, the category above, whether they can be billed.
ICD = """icd AS (SELECT chr(CAST(65 + p_partkey % 20 AS INTEGER)) || lpad((p_partkey % 100)::VARCHAR, 2, '0') || (p_partkey % 7) AS code, chr(CAST(65 + p_partkey % 20 AS INTEGER)) || lpad((p_partkey % 100)::VARCHAR, 2, '0') AS parent, p_name AS description, p_brand AS chapter, p_partkey % 4 <> 0 AS is_billable, p_partkey AS k FROM part)"""


def icd(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    parent = F.concat(F.chr(65 + k % 20), F.lpad((k % 100).cast("string"), 2, "0"))
    return table(spark, sf_dir, "part").select(F.concat(parent, (k % 7).cast("string")).alias("code"), parent.alias("parent"), F.col("p_name").alias("description"), F.col("p_brand").alias("chapter"), (k % 4 != 0).alias("is_billable"), k.alias("k"))


@query(f"WITH {ICD} SELECT code, is_billable FROM icd WHERE contains(lower(description), 'red') ORDER BY is_billable DESC, code LIMIT 25")
def icd_search(spark, sf_dir):
    return lookups.icd_search(icd(spark, sf_dir), "RED", 25).select("code", "is_billable")


@query(f"WITH {ICD} SELECT parent, code FROM icd")
def icd_children(spark, sf_dir):
    own = icd(spark, sf_dir)
    return lookups.icd_children(own, own.select("parent"))


@query(f"WITH {ICD} SELECT code, k FROM icd WHERE is_billable AND starts_with(code, 'C1')")
def icd_billable(spark, sf_dir):
    return lookups.icd_billable(icd(spark, sf_dir), "c1").select("code", "k")


@query(f"WITH {ICD} SELECT code, chapter FROM icd WHERE NOT is_billable")
def icd_categories(spark, sf_dir):
    return lookups.icd_categories(icd(spark, sf_dir)).select("code", "chapter")


@query("""WITH t AS (SELECT p_partkey AS code, list_distinct(list_filter(string_split(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')) AS words FROM part),
q AS (SELECT DISTINCT p_name AS query, list_distinct(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')) AS wanted FROM part)
SELECT query, code, CAST(len(wanted) AS BIGINT) AS hits FROM q JOIN t ON len(list_intersect(words, wanted)) = len(wanted)""")
def lab_words(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    index = lookups.lab_index(p.select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_type").alias("component")))
    return lookups.lab_by_words(index, p.select(F.col("p_name").alias("query"), F.col("p_name").alias("text")).distinct())


@query("SELECT p_partkey AS code FROM part WHERE p_brand = 'Brand#11' ORDER BY 1 LIMIT 50")
def lab_class(spark, sf_dir):
    return lookups.lab_class(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("class")), "Brand#11", 50).select("code")


@query("SELECT p_partkey AS code, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = p_partkey) AS is_panel FROM part")
def lab_panels(spark, sf_dir):
    panels = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("panel"), F.col("l_partkey").alias("member"))
    return lookups.with_panels(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code")), panels)


SHORT = {"RED": "CRIMSON", "BOLT": "THREADED FASTENER", "SMALL": "S"}


@query("SELECT p_partkey AS k, array_to_string(list_transform(string_split(upper(p_name), ' '), lambda w: CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SHORT.items()) + " ELSE w END), ' ') AS long FROM part")
def abbreviations_expanded(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), lookups.expanded(F.col("p_name"), SHORT).alias("long"))


@query("SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'wider' WHEN 1 THEN 'narrower' WHEN 2 THEN 'inexact' ELSE 'equivalent' END AS equivalence FROM part")
def equivalences(spark, sf_dir):
    k = F.col("p_partkey")
    said = F.when(k % 5 == 0, " Broader").when(k % 5 == 1, "more specific").when(k % 5 == 2, "APPROXIMATE").when(k % 5 == 3, "odd").otherwise(F.lit(None))
    return table(spark, sf_dir, "part").select(k.alias("k"), lookups.equivalence(said).alias("equivalence"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'Active Coverage' WHEN 1 THEN 'Co-Payment' WHEN 2 THEN 'Unknown: ZZ' END AS benefit, CASE p_partkey % 3 WHEN 0 THEN 'Pharmacy' WHEN 1 THEN '' ELSE 'Urgent Care' END AS service,
  CASE p_partkey % 2 WHEN 0 THEN 'Subscriber/Insured Not Found' ELSE 'Reject Reason: 99' END AS rejection FROM part""")
def code_descriptions(spark, sf_dir):
    k = F.col("p_partkey")
    benefit, service = F.when(k % 4 == 0, "1").when(k % 4 == 1, "B").when(k % 4 == 2, "ZZ"), F.when(k % 3 == 0, "88").when(k % 3 == 1, "??").otherwise("UC")
    rejection = F.when(k % 2 == 0, "75").otherwise("99")
    return table(spark, sf_dir, "part").select(k.alias("k"), codelists.described(benefit, "benefit").alias("benefit"), codelists.described(service, "service").alias("service"), codelists.described(rejection, "rejection").alias("rejection"))


@query("SELECT p_partkey AS k FROM part WHERE p_size % 5 = 2")
def release_pinned(spark, sf_dir):
    """Parts by release: release 1 is active, 2 is pinned."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 5).cast("int").alias("release_id"))
    releases = spark.createDataFrame([("drugs", n, n == 1) for n in range(5)], "vocabulary string, release_id int, is_active boolean")
    return lookups.in_release(rows, releases, "drugs", spark.createDataFrame([("drugs", 2)], "vocabulary string, release_id int")).select("k")
