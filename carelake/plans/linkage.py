"""Queries of identifiers, similarity and record linkage over customers, suppliers and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers, similarity
from ..operators import matching, terminology
from .register import query, table


def _names(spark, sf_dir) -> DataFrame:
    """Neighbouring part names as pairs of strings to compare."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.upper("p_name").alias("a"), F.upper("p_type").alias("b"))
    return p


#: Half transpositions count here; SQL engines round them down, so the tests hold these two against a plain statement instead.
@query()
def jaro_names(spark, sf_dir):
    return _names(spark, sf_dir).select("k", F.round(similarity.jaro(F.col("a"), F.col("b")), 9).alias("jaro"))


@query()
def jaro_winkler_names(spark, sf_dir):
    return _names(spark, sf_dir).select("k", F.round(similarity.jaro_winkler(F.col("a"), F.col("b")), 9).alias("jaro_winkler"))


@query("SELECT p_partkey AS k, CAST(levenshtein(upper(p_name), upper(p_type)) AS BIGINT) AS distance, round(1 - levenshtein(upper(p_name), upper(p_type)) / greatest(length(p_name), length(p_type))::DOUBLE, 9) AS similarity FROM part")
def levenshtein_names(spark, sf_dir):
    n = _names(spark, sf_dir)
    return n.select("k", F.levenshtein("a", "b").cast("long").alias("distance"), F.round(similarity.edit_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


SOUNDEX = """regexp_replace(translate(upper({x}[1:1]) || regexp_replace(upper(regexp_replace({x}[2:], '[^A-Za-z]', '', 'g')), '[HWY]', '', 'g'), 'BFPVCGJKQSXZDTLMNRAEIOU', '11112222222233455600000'), '(1)1+|(2)2+|(3)3+|(4)4+|(5)5+|(6)6+|(0)0+', '\\1\\2\\3\\4\\5\\6\\7', 'g')"""


@query(f"SELECT p_partkey AS k, rpad(upper(p_name[1:1]) || regexp_replace(({SOUNDEX.format(x='p_name')})[2:], '0', '', 'g'), 4, '0') AS code FROM part")
def soundex_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), similarity.soundex(F.col("p_name")).alias("code"))


@query("""WITH w AS (SELECT p_partkey AS k, list_filter(string_split(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS t, ['red', 'bolt', 'eco'] AS q FROM part)
SELECT k, round(list_sum(list_transform(q, lambda w: CASE WHEN list_contains(t, w) THEN 1.0::DOUBLE WHEN len(list_filter(t, lambda u: contains(u, w) OR contains(w, u))) > 0 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END)) / 3, 9) AS score FROM w""")
def fuzzy_token_overlap(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("k"), F.round(similarity.token_overlap(F.lit("red bolt eco"), F.concat_ws(" ", "p_name", "p_type")), 9).alias("score"))


@query("""WITH w AS (SELECT p_partkey AS k, list_distinct(string_split(lower(p_name), ' ')) AS a, ['red', 'blue', 'bolt'] AS b FROM part)
SELECT k, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 9) AS score FROM w""")
def jaccard_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.round(similarity.jaccard(F.col("p_name"), F.lit("red blue bolt")), 9).alias("score"))


def _digit(k: int) -> str:
    return f"CAST(substr('80840' || v, {k}, 1) AS INTEGER)"


#: Fifteen digits with the prefix; those at even places count double.
LUHN = " + ".join(f"(CASE WHEN 2 * {_digit(k)} > 9 THEN 2 * {_digit(k)} - 9 ELSE 2 * {_digit(k)} END)" if k % 2 == 0 else _digit(k) for k in range(1, 16))


@query(f"""WITH i AS (SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN lpad(c_custkey::VARCHAR, 9, '1') WHEN 1 THEN lpad(c_custkey::VARCHAR, 10, '0') WHEN 2 THEN '12345-6789' || chr(CAST(65 + c_custkey % 20 AS INTEGER)) ELSE rpad('1' || c_custkey, 10, '3') END AS raw FROM customer),
b AS (SELECT k, replace(replace(raw, '-', ''), ' ', '') AS v FROM i),
n AS (SELECT k, v, CASE WHEN regexp_full_match(v, '[0-9]{{10}}') THEN ({LUHN}) END AS total FROM b)
SELECT k, CASE WHEN length(v) <> 10 THEN 'INVALID_NPI_LENGTH' WHEN NOT regexp_full_match(v, '[0-9]+') THEN 'INVALID_NPI_FORMAT' WHEN v LIKE '0%' THEN 'INVALID_NPI_START' WHEN total % 10 <> 0 THEN 'INVALID_NPI_CHECKSUM' END AS error FROM n""")
def npi_validate(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    letter = F.chr(65 + k % 20)
    raw = F.when(k % 7 == 0, F.lpad(text, 9, "1")).when(k % 7 == 1, F.lpad(text, 10, "0")).when(k % 7 == 2, F.concat(F.lit("12345-6789"), letter)).otherwise(F.rpad(F.concat(F.lit("1"), text), 10, "3"))
    return c.select(k.alias("k"), identifiers.npi_error(raw).alias("error"))


@query("""WITH i AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN '666' || lpad(c_custkey::VARCHAR, 6, '1') WHEN 1 THEN '123-00-' || lpad(c_custkey::VARCHAR, 4, '1') WHEN 2 THEN lpad(c_custkey::VARCHAR, 5, '0') || '0000' WHEN 3 THEN '111111111' WHEN 4 THEN '12345678' ELSE '219-09-' || lpad(c_custkey::VARCHAR, 4, '0') END AS raw FROM customer),
b AS (SELECT k, replace(replace(raw, '-', ''), ' ', '') AS v FROM i)
SELECT k, CASE WHEN length(v) <> 9 THEN 'INVALID_SSN_LENGTH' WHEN NOT regexp_full_match(v, '[0-9]+') THEN 'INVALID_SSN_FORMAT' WHEN left(v, 3) IN ('000', '666') OR v LIKE '9%' THEN 'INVALID_SSN_AREA'
  WHEN substr(v, 4, 2) = '00' THEN 'INVALID_SSN_GROUP' WHEN substr(v, 6, 4) = '0000' THEN 'INVALID_SSN_SERIAL' WHEN v IN ('000000000', '123456789', '111111111', '999999999') THEN 'INVALID_SSN_PATTERN' END AS error FROM b""")
def ssn_validate(spark, sf_dir):
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit("666"), F.lpad(text, 6, "1"))).when(k % 6 == 1, F.concat(F.lit("123-00-"), F.lpad(text, 4, "1"))).when(k % 6 == 2, F.concat(F.lpad(text, 5, "0"), F.lit("0000")))
        .when(k % 6 == 3, "111111111").when(k % 6 == 4, "12345678").otherwise(F.concat(F.lit("219-09-"), F.lpad(text, 4, "0")))
    )
    return table(spark, sf_dir, "customer").select(k.alias("k"), identifiers.ssn_error(raw).alias("error"))


@query("""WITH i AS (SELECT c_custkey AS k, chr(CAST(65 + c_custkey % 26 AS INTEGER)) || 'S' || lpad(c_custkey::VARCHAR, CASE WHEN c_custkey % 9 = 0 THEN 8 ELSE 7 END, '2') AS v FROM customer),
d AS (SELECT k, v, CAST(substr(v, 3, 1) AS INTEGER) + CAST(substr(v, 5, 1) AS INTEGER) + CAST(substr(v, 7, 1) AS INTEGER) + 2 * (CAST(substr(v, 4, 1) AS INTEGER) + CAST(substr(v, 6, 1) AS INTEGER) + CAST(substr(v, 8, 1) AS INTEGER)) AS total FROM i)
SELECT k, CASE WHEN length(v) <> 9 THEN 'INVALID_DEA_LENGTH' WHEN NOT regexp_matches(v, '^[ABFGMPRX]') THEN 'INVALID_DEA_REGISTRANT' WHEN total % 10 <> CAST(substr(v, 9, 1) AS INTEGER) THEN 'INVALID_DEA_CHECKSUM' END AS error FROM d""")
def dea_validate(spark, sf_dir):
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    digits = F.when(k % 9 == 0, F.lpad(text, 8, "2")).otherwise(F.lpad(text, 7, "2"))
    return table(spark, sf_dir, "customer").select(k.alias("k"), identifiers.dea_error(F.concat(F.chr(65 + k % 26), F.lit("S"), digits)).alias("error"))


MBI_CASES = " ".join(f"WHEN NOT regexp_full_match(substr(v, {k}, 1), '{x}') THEN 'INVALID_MBI_POS{k}'" for k, x in enumerate(identifiers.MBI_POSITIONS, 1))


@query(f"""WITH i AS (SELECT c_custkey AS k, '1' || chr(CAST(65 + c_custkey % 26 AS INTEGER)) || chr(CAST(65 + (c_custkey // 3) % 26 AS INTEGER)) || '4-TE5-' || (c_custkey % 10) || 'K73' AS raw FROM customer),
b AS (SELECT k, replace(raw, '-', '') AS v FROM i) SELECT k, CASE WHEN length(v) <> 11 THEN 'INVALID_MBI_LENGTH' {MBI_CASES} END AS error FROM b""")
def mbi_validate(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.concat(F.lit("1"), F.chr(65 + k % 26), F.chr(65 + F.floor(k / 3) % 26), F.lit("4-TE5-"), (k % 10).cast("string"), F.lit("K73"))
    return table(spark, sf_dir, "customer").select(k.alias("k"), identifiers.mbi_error(raw).alias("error"))


@query("""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\+?1?[ -]?\\([0-9]{3}\\) [0-9]{3}-[0-9]{4}')) AS raw FROM documents), d AS (SELECT doc_id, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS v FROM f)
SELECT doc_id, raw, CASE WHEN length(v) = 11 AND v LIKE '1%' THEN substr(v, 2) WHEN length(v) = 10 THEN v ELSE '' END AS phone FROM d""")
def phone_extract_normalize(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("\\+?1?[ -]?\\([0-9]{3}\\) [0-9]{3}-[0-9]{4}"), F.lit(0))).alias("raw"))
    return d.select("doc_id", "raw", identifiers.phone(F.col("raw")).alias("phone"))


#: Customers as patients: names from a short list, so that people share them, and birth years, postcodes and phones by arithmetic.
PEOPLE = """people AS (SELECT c_custkey AS id, ['SMITH', 'SMYTH', 'JONES', 'JOHNSON', 'BROWN', 'BRAUN', 'GARCIA'][CAST(1 + c_custkey % 7 AS INTEGER)] AS family, ['ANN', 'ANNE', 'BOB', 'EVE'][CAST(1 + (c_custkey // 5) % 4 AS INTEGER)] AS given,
  CAST(1950 + (c_custkey // 11) % 40 AS BIGINT) AS birth_year, 'Z' || (c_nationkey % 10) AS zip, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'S' || (c_custkey % 60) END AS mbi, c_mktsegment AS gender FROM customer)"""


def people(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")

    def pick(names: list[str], at) -> object:
        return F.get(F.array(*[F.lit(n) for n in names]), at.cast("int"))

    return table(spark, sf_dir, "customer").select(
        k.alias("id"), pick(["SMITH", "SMYTH", "JONES", "JOHNSON", "BROWN", "BRAUN", "GARCIA"], k % 7).alias("family"), pick(["ANN", "ANNE", "BOB", "EVE"], F.floor(k / 5) % 4).alias("given"),
        (1950 + F.floor(k / 11) % 40).cast("long").alias("birth_year"), F.concat(F.lit("Z"), (F.col("c_nationkey") % 10).cast("string")).alias("zip"),
        F.when(k % 10 != 0, F.concat(F.lit("S"), (k % 60).cast("string"))).alias("mbi"), F.col("c_mktsegment").alias("gender"),
    )


PAIRS = f"""{PEOPLE}, pairs AS (SELECT l.id AS a, r.id AS b, l.family AS lf, r.family AS rf, l.given AS lg, r.given AS rg, l.zip AS lz, r.zip AS rz, l.mbi AS lm, r.mbi AS rm, l.gender AS le, r.gender AS re
  FROM people l JOIN people r ON l.birth_year = r.birth_year AND l.zip = r.zip AND l.id < r.id)"""


def _jw(a: str, b: str) -> str:
    prefix = " + ".join(f"(CASE WHEN length({a}) >= {k} AND length({b}) >= {k} AND left({a}, {k}) = left({b}, {k}) THEN 1 ELSE 0 END)" for k in range(1, 5))
    return f"(jaro_similarity({a}, {b}) + ({prefix}) * 0.1::DOUBLE * (1 - jaro_similarity({a}, {b})))"


SCORE = f"""({_jw('lf', 'rf')} * 0.15::DOUBLE + {_jw('lg', 'rg')} * 0.10::DOUBLE + (CASE WHEN lm IS NOT NULL AND rm IS NOT NULL AND lm = rm THEN 0.20::DOUBLE ELSE 0 END) + 0.04::DOUBLE + (CASE WHEN le = re THEN 0.03::DOUBLE ELSE 0 END))
  / (0.15::DOUBLE + 0.10::DOUBLE + (CASE WHEN lm IS NOT NULL AND rm IS NOT NULL THEN 0.20::DOUBLE ELSE 0 END) + 0.04::DOUBLE + 0.03::DOUBLE)"""


def _pairs(spark, sf_dir) -> DataFrame:
    p = people(spark, sf_dir)
    return matching.sided_pairs(p, "id", F.array(F.concat_ws(":", "birth_year", "zip")), [c for c in p.columns if c != "id"])


FIELDS = ["family", "given", "mbi", "zip", "gender"]


def _rated(spark, sf_dir, met: DataFrame, kept: list[str]) -> DataFrame:
    """Pairs with their score and whether their beneficiary numbers agree."""
    met = matching.name_similarities(met, people(spark, sf_dir))
    return met.select(*kept, matching.rule(["mbi"]).alias("rule"), F.round(matching.score(FIELDS, known=met.columns), 6).alias("score"))


def _scored(spark, sf_dir) -> DataFrame:
    return _rated(spark, sf_dir, _pairs(spark, sf_dir), ["a", "b"])


@query(f"WITH {PAIRS} SELECT a, b FROM pairs")
def blocking_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b")


RULED = f"""{PEOPLE}, known AS (SELECT *, birth_year AS birth_date, CASE WHEN id % 6 = 0 THEN 'N' || (id // 30) END AS ssn, 'R' || (id % 500) AS mrn, CASE WHEN id % 4 = 0 THEN 'A' ELSE 'B' END AS system FROM people)"""


@query(f"""WITH {RULED}, ruled AS (SELECT l.id AS a, r.id AS b, CASE WHEN l.ssn = r.ssn THEN 'SSN_EXACT' WHEN l.mbi = r.mbi THEN 'MBI_EXACT' WHEN l.mrn = r.mrn AND l.system = r.system THEN 'MRN_SYSTEM'
  WHEN l.family = r.family AND l.given = r.given AND l.birth_date = r.birth_date AND l.gender = r.gender THEN 'NAME_DOB_GENDER'
  WHEN l.family = r.family AND l.given = r.given AND l.birth_date = r.birth_date AND l.zip = r.zip THEN 'NAME_DOB_ZIP' END AS rule FROM known l JOIN known r ON l.birth_year = r.birth_year AND l.id < r.id)
SELECT a, b, rule FROM ruled WHERE rule IS NOT NULL""")
def deterministic_match(spark, sf_dir):
    """All five rules, over people of one birth year."""
    k = F.col("id")
    p = people(spark, sf_dir).withColumns({"birth_date": F.col("birth_year"), "ssn": F.when(k % 6 == 0, F.concat(F.lit("N"), F.floor(k / 30).cast("string"))), "mrn": F.concat(F.lit("R"), (k % 500).cast("string")), "system": F.when(k % 4 == 0, "A").otherwise("B")})
    return matching.ruled_pairs(p, "id", "birth_year")


@query(f"WITH {PAIRS} SELECT a, b, round({SCORE}, 6) AS score FROM pairs")
def probabilistic_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("a", "b", "score")


@query(f"""WITH {PAIRS}, s AS (SELECT round({SCORE}, 6) AS score, lm = rm AS sure FROM pairs)
SELECT CASE WHEN coalesce(sure, false) OR score >= 0.95 THEN 'confirmed' WHEN score >= 0.70 THEN 'review' WHEN score >= 0.50 THEN 'possible' ELSE 'none' END AS class, count(*) AS pairs FROM s GROUP BY 1""")
def match_classification(spark, sf_dir):
    s = _rated(spark, sf_dir, matching.alike_pairs(people(spark, sf_dir), "id", ["birth_year", "zip"], FIELDS), ["pairs"])
    return s.groupBy(matching.classify(F.col("rule"), F.col("score")).alias("class")).agg(F.sum("pairs").alias("pairs"))


@query(f"""WITH {PAIRS}, s AS (SELECT a, b, round({SCORE}, 6) AS score, CASE WHEN lm = rm THEN 'MBI_EXACT' END AS rule FROM pairs)
SELECT a, b, rule, score FROM s WHERE rule IS NOT NULL OR score >= 0.95""")
def dedupe_customers(spark, sf_dir):
    # a filter would be given a copy of the whole score, and the method that holds both is too large to be compiled
    sure = F.filter(F.array(F.struct("a", "b", "rule", "score")), lambda x: matching.confirmed(x["rule"], x["score"]))
    return _scored(spark, sf_dir).select(F.inline_outer(sure)).where("a IS NOT NULL")


@query(f"""WITH {PEOPLE}, known AS (SELECT mbi, min(id) AS existing_id FROM people WHERE id < 50 AND mbi IS NOT NULL GROUP BY mbi)
SELECT p.id AS record_id, k.existing_id FROM people p JOIN known k ON p.mbi = k.mbi WHERE p.id >= 50""")
def mpi_add(spark, sf_dir):
    p = people(spark, sf_dir).withColumnRenamed("id", "record_id")
    return matching.index_add(p.where("record_id < 50"), p.where("record_id >= 50"), ["mbi"])[0]


@query("""WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 9 THEN 'merged' ELSE 'active' END AS status FROM customer), m AS (SELECT c_custkey AS from_id, c_custkey - 1 AS to_id FROM customer WHERE c_custkey % 10 = 9),
l AS (SELECT c_custkey AS a, c_custkey + 2 AS b FROM customer WHERE c_custkey % 3 = 0), x AS (SELECT coalesce(m1.to_id, l.a) AS a, coalesce(m2.to_id, l.b) AS b FROM l LEFT JOIN m m1 ON l.a = m1.from_id LEFT JOIN m m2 ON l.b = m2.from_id)
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM x WHERE a <> b""")
def mpi_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    merges = c.where("k % 10 = 9").select(F.col("k").alias("from_id"), (F.col("k") - 1).alias("to_id"))
    links = c.where("k % 3 = 0").select(F.col("k").alias("a"), (F.col("k") + 2).alias("b"), F.lit("confirmed").alias("status"))
    return matching.merged(links, merges).select("a", "b")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 5) AS score FROM e q JOIN e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 5""")
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return terminology.top_k(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked")), e, 5)
