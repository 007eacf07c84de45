"""Scalar functions on literals with known values."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from carelake.functions import dates, hl7text, identifiers, similarity
from carelake.operators import cel, terminology, workflow


def values(spark, rows, function):
    n = len(rows[0]) if isinstance(rows[0], tuple) else 1
    data = [(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)]
    frame = spark.createDataFrame(data, "k int, " + ", ".join(f"c{i} string" for i in range(n)))
    out = function(*[F.col(f"c{i}") for i in range(n)])
    return [r.v for r in frame.select("k", out.alias("v")).orderBy("k").collect()]


def plain_jaro(a, b):
    """The definition, character by character."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, used, left = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            left.append(c)
    if not left:
        return 0.0
    swapped = sum(x != b[j] for x, j in zip(left, sorted(used), strict=True)) / 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def test_jaro(spark):
    words = ["MARTHA", "MARHTA", "DWAYNE", "DUANE", "", "A", "DIXON", "DICKSONX", "ECONOMY", "YMONOCE"]
    pairs = list(itertools.product(words, words))
    assert values(spark, pairs, similarity.jaro) == pytest.approx([plain_jaro(a, b) for a, b in pairs])
    assert values(spark, [("MARTHA", "MARHTA"), ("DWAYNE", "DUANE")], similarity.jaro_winkler) == pytest.approx([0.9611111, 0.84], abs=1e-6)


def test_soundex(spark):
    assert values(spark, ["Robert", "Rupert", "Tyde", "Smith", "Smyth", "", "123", "Ashcraft", "Tymczak", "Pfister", "Lee"], similarity.soundex) == ["R163", "R163", "T000", "S530", "S530", "", "", "A261", "T522", "P236", "L000"]


def test_names_and_numbers(spark):
    assert values(spark, ["Dr. Ann  O'Neil Jr", "mrs smith", "José III"], identifiers.person_name) == ["ANN ONEIL", "SMITH", "JOSÉ"]
    assert values(spark, ["+1 (541) 555-3219", "541.555.3219", "12", "2541555321"], identifiers.phone) == ["5415553219", "5415553219", "", "2541555321"]
    assert values(spark, [("5415553219", "5415553219"), ("5415553219", "2125553219"), ("1", "1")], identifiers.phone_score) == [1.0, 0.7, 0.0]
    assert values(spark, ["123-45-6788", "123456789", "12"], identifiers.ssn) == ["123456788", "", ""]


def test_checks(spark):
    assert values(spark, ["1234567893", "1234567890", "123", "0234567893", "12345678AB", "123-456-7893"], identifiers.npi_error) == [None, "INVALID_NPI_CHECKSUM", "INVALID_NPI_LENGTH", "INVALID_NPI_START", "INVALID_NPI_FORMAT", None]
    assert values(spark, ["AS1234563", "AS1234564", "1S1234563", "ZS1234563", "AS12345X3", "A"], identifiers.dea_error) == [None, "INVALID_DEA_CHECKSUM", "INVALID_DEA_PREFIX", "INVALID_DEA_REGISTRANT", "INVALID_DEA_DIGITS", "INVALID_DEA_LENGTH"]
    assert values(spark, ["1EG4-TE5-7K73", "0EG4TE57K73", "1SG4TE57K73", "1EGXTE57K73", "1"], identifiers.mbi_error) == [None, "INVALID_MBI_POS1", "INVALID_MBI_POS2", "INVALID_MBI_POS4", "INVALID_MBI_LENGTH"]
    assert values(spark, ["219-09-9999", "666-12-3456", "912-12-3456", "219-00-9999", "219-09-0000", "111111111", "x", "2190999x9"], identifiers.ssn_error) == [None, "INVALID_SSN_AREA", "INVALID_SSN_AREA", "INVALID_SSN_GROUP", "INVALID_SSN_SERIAL", "INVALID_SSN_PATTERN", "INVALID_SSN_LENGTH", "INVALID_SSN_FORMAT"]


def test_times(spark):
    got = values(spark, ["2024", "20240203", "20240203040506.25", "202402030405+0200", "20240203040506-0530^S", "", "2024x", "20241399"], dates.hl7_timestamp)
    at = datetime.datetime
    assert got == [at(2024, 1, 1), at(2024, 2, 3), at(2024, 2, 3, 4, 5, 6, 250000), at(2024, 2, 3, 2, 5), at(2024, 2, 3, 9, 35, 6), None, None, None]
    assert values(spark, ["20240203", "240203", "690203", "99"], dates.edi_date) == [datetime.date(2024, 2, 3), datetime.date(2024, 2, 3), datetime.date(1969, 2, 3), None]
    assert values(spark, ["2024-02-03", "02/03/2024", "2/3/2024", "20240203", "no"], dates.csv_date) == [datetime.date(2024, 2, 3)] * 4 + [None]


def test_unescape(spark):
    assert values(spark, [r"a\F\b\S\c\T\d\R\e\E\f", r"x\.br\y", r"\X41C3A9\!", r"\E\F\E\ ", "plain", r"\Q\ "], hl7text.unescape) == ["a|b^c&d~e\\f", "x\ny", "Aé!", "\\F\\ ", "plain", r"\Q\ "]


def test_code_shapes(spark):
    assert values(spark, ["2345-7", "E11.9", "J1234", "99213", "123456789", "12345-6789-01", "?"], terminology.code_system) == ["LOINC", "ICD-10-CM", "HCPCS", "CPT", "SNOMED", "NDC", "unknown"]


CONDITIONS = [
    ("event.n > 10", True), ("event.n > 10.5 && event.kind == 'a'", True), ("event.n in [1, 20]", True), ("event.missing == 'x'", False), ("!(event.missing == 'x')", False), ("event.missing == 'x' || event.n == 20", True),
    ("event.missing == 'x' && event.n == 20", False), ("has(event.p.name) && !has(event.p.none)", True), ("event.p.name.startsWith('A') && event.p.name.endsWith('n') && event.p.name.contains('nn')", True), ("size(event.tags) == 2", True),
    ("event.tags.exists(t, t == 'x')", True), ("event.rows.exists(r, r.v > 4 && r.k == 'b')", True), ("event.rows.all(r, r.v > 4)", False), ("event.n % 6 == 2 ? event.flag : false", True), ("event.n * 2 + 1 == 41", True), ("event.p.name.matches('^A.*n$')", True),
    ("event.p.none == null", True), ("event.n - 5 >= 15.0", True), ("event.flag", True), ("event.tags[0] == 'x'", True), ("'x' in event.tags", True), ("-event.n < 0", True), ('"q\\"" == "q\\""', True),
]


@pytest.mark.parametrize(("text", "want"), CONDITIONS)
def test_conditions(spark, text, want):
    data = '{"n": 20, "kind": "a", "flag": true, "p": {"name": "Ann"}, "tags": ["x", "y"], "rows": [{"k": "a", "v": 1}, {"k": "b", "v": 5}]}'
    frame = spark.createDataFrame([(1, data)], "position long, data string")
    column = cel.compile_condition(text, cel.event_scope(frame.columns))
    assert frame.select(column.alias("v")).first().v is want


@pytest.mark.parametrize("text", ["event.n >", "1 +", "event..x", "foo(", "unknown(1)", "x == 1", "event.a ? 1", "[1, 2]", "#"])
def test_bad_conditions(spark, text):
    with pytest.raises(cel.CelError):
        cel.compile_condition(text, cel.event_scope(["data"]))


def test_lint(spark):
    flow = workflow.load({"name": "a b", "routes": [{"name": "r", "filter": {"condition": "event.("}, "transform": [{}, {"set_field": "x"}, {"redact": {}}, {"map_terminology": {}, "redact": ["a"]}], "actions": [{"type": "teleport"}, {}]}, {"name": "r"}, {}]})
    codes = {c for _, c, _ in workflow.lint(flow)}
    assert codes == {"INVALID_NAME_CHARS", "MISSING_VERSION", "INVALID_CEL", "EMPTY_TRANSFORM", "INVALID_SET_FIELD", "MISSING_REDACT_FIELDS", "MISSING_TERMINOLOGY_FIELD", "MULTIPLE_TRANSFORMS", "UNKNOWN_ACTION_TYPE", "MISSING_ACTION_TYPE", "DUPLICATE_ROUTE_NAME", "NO_ACTIONS", "NO_FILTER", "MISSING_ROUTE_NAME"}
    assert workflow.lint(workflow.load({"name": "ok", "version": 1, "routes": [{"name": "r", "filter": {"event_type": "x"}, "actions": [{"type": "log"}]}]})) == []


def test_transforms(spark):
    frame = spark.createDataFrame([(1, '{"a":{"b":1},"s":5}'), (2, None), (3, "[1]"), (4, "{bad")], "position long, data string")
    done = frame.select("position", workflow.set_field(F.col("data"), "event.a.c = 'x y'").alias("s"), workflow.redact(F.col("data"), ["a.b", "none.x", "s.t"]).alias("r"), workflow.set_field(F.col("data"), "s.t = 1").alias("scalar"))
    rows = {r.position: r for r in done.collect()}
    assert rows[1].s == '{"a":{"b":1,"c":"x y"},"s":5}' and rows[1].r == '{"a":{},"s":5}' and rows[1].scalar == '{"a":{"b":1},"s":5}'
    assert rows[2].s == '{"a":{"c":"x y"}}' and rows[3].s == "[1]" and rows[4].r == "{bad"
    assert [workflow.literal(x) for x in ("true", "null", "3", "2.5", "'q'", "text")] == [True, None, 3, 2.5, "q", "text"]


def test_run_goes_on_after_failures(spark):
    frame = spark.createDataFrame([(1, "a", "s", "{}")], "position long, event_type string, source string, data string")
    flow = workflow.load({"name": "w", "version": "1", "routes": [{"name": "r1", "actions": [{"type": "bad"}, {"type": "good"}]}, {"name": "r2", "filter": {"event_type": "b"}, "actions": [{"type": "good"}]}]})
    seen = []

    def bad(rows, action):
        raise RuntimeError("connection refused")

    failed = workflow.run(frame, flow, {"bad": bad, "good": lambda rows, action: seen.append(rows.count())})
    assert seen == [1, 0] and [(r, a) for r, a, _ in failed] == [("r1", "bad")]
