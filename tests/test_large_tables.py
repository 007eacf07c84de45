"""Plans that larger tables need: what is read once, compiled, or met by keys, beside the rows that come out."""

import itertools

import pytest
from pyspark.sql import functions as F

from carelake.functions import similarity
from carelake.operators import fhir, matching, terminology
from carelake.plans import catalog

DATA = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def readings(frame):
    text = plan(frame)
    return text.count("get_json_object(") + text.count("from_json(")


def test_a_resource_is_read_once(spark):
    odd = {
        "": ["error:structure:resourceType"], '{"resourceType":null,"birthDate":"x"}': ["error:structure:resourceType", "error:value:birthDate"], '{"resourceType":"Patient","a":NaN}': ["error:structure:resourceType"],
        '{"resourceType":"Goal","status":"x","description":{"a":1}}': ["error:required:Goal.lifecycleStatus", "error:required:Goal.subject", "error:unknown:Goal.status"], '[{"resourceType":"Patient"}]': ["error:structure:resourceType"],
        '{"resourceType":"CarePlan","category":{"a":1},"status":"a","intent":"b","subject":{}}': ["error:structure:CarePlan.category"], '{"resourceType":"Zzz"}': [],
    }
    frame = spark.createDataFrame([(x,) for x in odd], "r string").select("r", fhir.issues(F.col("r")).alias("i"))
    assert {x.r: x.i for x in frame.collect()} == odd
    assert readings(frame.select("i")) == 1


@pytest.mark.parametrize("name, most", [("fhir_medication_request", 2), ("fhir_resources_valid", 23), ("fhir_bundle_by_event", 1)])
def test_resources_are_read_once_by_queries(spark, name, most):
    assert readings(catalog.QUERIES[name](spark, DATA)) <= most


def test_records_of_one_key_compare_no_lists(spark):
    r = spark.range(6).select("id", F.array(F.lit("k")).alias("keys"))
    met = matching.pairs(r.unionByName(spark.createDataFrame([(6, ["k", "l"]), (7, ["l", "k"])], "id long, keys array<string>")), "id", F.col("keys"))
    assert "(size(all" in plan(met)
    assert met.count() == 28 == met.distinct().count()


def test_ruled_pairs_meet_by_their_fields(spark):
    rows = [(k, "S" if k < 3 else None, "" if k == 5 else "M", f"R{k % 2}", "A", "F", "G", 1, "m" if k % 3 else None, "Z", None if k == 7 else 1950 + k // 8) for k in range(16)]
    names = ["ssn", "mbi", "mrn", "system", "family", "given", "birth_date", "gender", "zip", "year"]
    r = spark.createDataFrame(rows, "id long, ssn string, mbi string, mrn string, system string, family string, given string, birth_date long, gender string, zip string, year long")
    every = r.select(F.col("id").alias("a"), F.struct(*names).alias("l")).crossJoin(r.select(F.col("id").alias("b"), F.struct(*names).alias("r"))).where("a < b AND l.year = r.year")
    want = every.select("a", "b", matching.rule(names).alias("rule")).where("rule IS NOT NULL")
    got = matching.ruled_pairs(r, "id", "year")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20
    # strangers of one year don't meet
    apart = spark.range(100).select("id", F.concat(F.lit("S"), "id").alias("ssn"), F.lit(1950).alias("year"))
    met = matching.ruled_pairs(apart, "id", "year")
    assert met.count() == 0 and "a_SSN_EXACT" in plan(met)
    assert "a_NAME_DOB_ZIP" in plan(catalog.QUERIES["deterministic_match"](spark, DATA))


@pytest.mark.parametrize("few", [512, 2])
def test_names_are_compared_once(spark, monkeypatch, few):
    monkeypatch.setattr(matching, "FEW_NAMES", few)
    names = ["Smith", "SMYTH ", "", None, "Jones"]
    r = spark.createDataFrame([(k, names[k % 5], names[k % 3], None if k % 4 else "Z") for k in range(20)], "id long, family string, given string, zip string")
    met = matching.sided_pairs(r, "id", F.array(F.lit("k")))
    known = matching.name_similarities(met, r)
    want = {(x.a, x.b): x.s for x in met.select("a", "b", matching.score(r.columns).alias("s")).collect()}
    got = {(x.a, x.b): x.s for x in known.select("a", "b", matching.score(r.columns, known=known.columns).alias("s")).collect()}
    assert len(got) == 190 and got == pytest.approx(want)
    assert ("family_similarity" in known.columns) == (few > 2)


@pytest.mark.parametrize("name", ["probabilistic_score", "match_classification", "dedupe_customers"])
def test_queries_compare_names_before_their_records_meet(spark, name):
    text = plan(catalog.QUERIES[name](spark, DATA))
    assert text.count("ArrowEvalPython") == 2 and "strategy=broadcast" in text


def test_duplicates_have_their_score_once(spark):
    text = plan(catalog.QUERIES["dedupe_customers"](spark, DATA))
    assert text.count("family_similarity") == plan(catalog.QUERIES["probabilistic_score"](spark, DATA)).count("family_similarity")


@pytest.mark.parametrize("few", [512, 2])
def test_alike_pairs_are_those_made_one_by_one(spark, monkeypatch, few):
    monkeypatch.setattr(matching, "FEW_NAMES", few)
    family, given = ["Smith", "SMYTH ", "", None, "Jones", "Martha", "Marhta"], ["Ann", None, "Anne"]
    rows = [
        (None if k == 9 else k - k % 37 // 36, k % 3 if k % 11 else None, family[k * k % 7], given[k % 3], ["m", "n", "", None][k // 3 % 4], ["x", "y", None][k % 5 % 3], "Z" if k % 4 else "", "219099999" if k % 6 == 0 else f"21909{k % 4}999", "555-010-1234" if k % 8 else "455-010-1234")
        for k in range(150)
    ] + [(20, 2, "Jones", "Ann", "m", "x", "Z", None, None)] * 3
    fields = ["family", "given", "mbi", "gender", "zip", "ssn", "phone"]
    r = spark.createDataFrame(rows, "id long, year long, family string, given string, mbi string, gender string, zip string, ssn string, phone string")

    def told(met, pairs):
        met = matching.name_similarities(met, r)
        rated = met.select(matching.rule(fields).alias("rule"), F.round(matching.score(fields, known=met.columns), 9).alias("score"), pairs.alias("pairs"))
        return {(x.rule, x.score): x.pairs for x in rated.groupBy("rule", "score").agg(F.sum("pairs").alias("pairs")).collect()}

    every = r.select(F.col("id").alias("a"), "year", "zip", F.struct(*fields).alias("l")).join(r.select(F.col("id").alias("b"), "year", "zip", F.struct(*fields).alias("r")), ["year", "zip"]).where("a < b")
    want = told(every, F.lit(1))
    assert len(want) > 50 and sum(want.values()) > 1000
    assert told(matching.alike_pairs(r, "id", ["year", "zip"], fields), F.col("pairs")) == want
    # fields of which none is what records meet within
    want = told(every.where("zip = 'Z'"), F.lit(1))
    assert told(matching.alike_pairs(r.where("zip = 'Z'"), "id", ["year"], fields), F.col("pairs")) == want


def test_alike_pairs_of_one_block_are_not_made(spark):
    n = 2_000_000
    r = spark.range(n).select("id", F.lit(1950).alias("year"), F.lit("SMITH").alias("family"), F.when(F.col("id") % 2 == 0, "m").otherwise("n").alias("mbi"))
    got = {(x.l.mbi == x.r.mbi): x.pairs for x in matching.alike_pairs(r, "id", ["year"], ["family", "mbi"]).collect()}
    assert got == {True: n // 2 * (n // 2 - 1), False: (n // 2) ** 2}


def test_match_classification_counts_alike_pairs(spark):
    text = plan(catalog.QUERIES["match_classification"](spark, DATA))
    assert "l_n" in text and "(a#" not in text


def test_jaro_is_the_same_from_either_side():
    texts = ["".join(p) for n in range(1, 7) for p in itertools.product("AB", repeat=n)] + ["ABCABDC", "CABDABC", "DCBAABCA", "JOHNSON", "JONES", "MARHTA", "MARTHA"]
    assert all(similarity.jaro_of(a, b) == similarity.jaro_of(b, a) for a, b in itertools.combinations(texts, 2))


@pytest.mark.parametrize("listed, wide", [(64, 8192), (64, 3), (2, 8192), (1, 2)])
def test_crosswalk_of_codes_with_several_concepts(spark, monkeypatch, listed, wide):
    monkeypatch.setattr(terminology, "LISTED", listed)
    monkeypatch.setattr(terminology, "WIDE", wide)
    rows = [(f"u{k * k % 11}", "AB"[k % 2], f"c{k * 7 % (23 if k % 3 else 9)}", None if k % 13 == 0 else f"n{k % 5}", "N" if k % 4 == 0 else "Y", None if k % 7 == 0 else k % 3) for k in range(300)] + [(None, "A", "c1", "x", "Y", 0)] * 2
    concepts = spark.createDataFrame(rows, "cui string, source string, code string, name string, is_preferred string, rank int")
    asked = spark.createDataFrame([(f"c{k % 20}",) for k in range(40)], "code string")
    for source, target in ("AB", "AA"):
        want = {}
        for x, y in itertools.product(rows, rows):
            if x[0] is not None and x[0] == y[0] and x[1] == source and y[1] == target and y[4] == "Y" and int(x[2][1:]) < 20:
                place = y[3] is None, y[5] is None, y[5] or 0, y[3] or ""  # as arg_min of SQL: no name and no rank come last
                want[x[2], y[2]] = min(want.get((x[2], y[2]), (place, y[3])), (place, y[3]))
        got = [tuple(x) for x in terminology.crosswalk(concepts, asked, source, target).collect()]
        assert len(got) > 100 and sorted(got, key=repr) == sorted(((a, b, name) for (a, b), (_, name) in want.items()), key=repr)


def test_crosswalk_deals_a_wide_concept_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(terminology, "WIDE", 100)
    concepts = spark.range(1000).select(F.when(F.col("id") < 1000, "u").otherwise("v").alias("cui"), F.lit("A").alias("source"), F.concat(F.lit("c"), "id").alias("code"), F.lit("n").alias("name"), F.lit("Y").alias("is_preferred"), F.lit(1).alias("rank"))
    made = terminology.crosswalk(concepts, concepts.select("code"), "A", "A").groupBy(F.spark_partition_id()).count().collect()
    assert sum(x["count"] for x in made) == 1_000_000 and len(made) == 4 and max(x["count"] for x in made) < 500_000


def test_crosswalk_neither_shuffles_nor_sorts_its_pairs(spark):
    top = [line.strip(" :+-") for line in plan(catalog.QUERIES["crosswalk_concepts"](spark, DATA)).splitlines()]
    join = next(n for n, line in enumerate(top) if line.startswith("Join"))
    assert not [line for line in top[:join] if line.startswith(("Aggregate", "Sort", "Window", "Repartition", "Deduplicate"))]
