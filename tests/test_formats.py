"""Message formats and read models on small inputs, the odd cases included."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from carelake.functions.similarity import cosine
from carelake.functions import clinical
from carelake.operators import eventlog, fhir, lookups, matching, projections, quality, sinks, terminology, workflow
from carelake.sources import companion, csvfiles, documents, eventinput, hl7v2, x12
from carelake.streaming import folds


def test_hl7_own_delimiters(spark):
    raw = "MSH#^~\\&#A#B###20240101##ORU^R01#7#P#2.5\nPID#1##M1^^^H^MR##Fam^Giv\nOBX#1#NM#g^Glucose^LN##5.5#mg#4-6#PANIC HIGH###F\nOBX#2#TX#n^Note^L##a~b\\T\\c###"
    row = hl7v2.events(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (row.event_type, row.control_id, row.version, row.patient.mrn, row.patient.family, row.is_critical, row.error) == ("lab_result", "7", "2.5", "M1", "Fam", True, None)
    assert [(o.code, o.number) for o in row.results] == [("g", 5.5), ("n", None)]


def test_hl7_errors_and_tolerance(spark):
    rows = spark.createDataFrame([(1, "nothing"), (2, "MSH|^~\\&|A|B|||1||ADT^A01|1|P|2.5\rPID|1||9"), (3, ""), (4, "MSH|^~\\&|A|B|||1||ADT^A01|1|P|2.5")], "k int, raw string")
    strict = {r.k: r.error for r in hl7v2.events(rows, "raw", False).collect()}
    assert strict == {1: "MISSING_MSH", 2: "MISSING_PV1", 3: "MISSING_MSH", 4: "MISSING_PID"}
    tolerant = {r.k: (r.error, r.warnings) for r in hl7v2.events(rows).collect()}
    assert tolerant[2] == (None, ["MISSING_PV1"])


def test_x12_payment_needs_lx(spark):
    isa = "ISA*00*          *00*          *ZZ*A              *ZZ*B              *240102*1253*^*00501*000000001*0*P*:~\n"
    body = "GS*HP*S*R*20240102*1253*1*X*005010X221A1~ST*835*0001~CLP*LOST*1*1*1~LX*1~CLP*C1*1*100*80**MC*P1~CAS*PR*1*5**2*7~CAS*CO*45*10*1**20~CLP*C2*4*50*0~SE*1*0001~"
    p = x12.payments_835(x12.enveloped(x12.segments(spark.createDataFrame([("f", "﻿" + isa + body)], "file string, raw string")))).collect()
    rows = {r.claim_id: r for r in p}
    assert set(rows) == {"C1", "C2"}
    assert rows["C1"].patient_share == 12.0 and [a.reason for a in rows["C1"].adjustments] == ["1", "2", "45"]
    assert rows["C2"].adjustments == []


def test_x12_eligibility_and_status(spark):
    isa = "ISA*00*          *00*          *ZZ*A              *ZZ*B              *240102*1253*^*00501*000000001*0*P*:~"
    text = "GS*HB*S*R*20240102*1253*1*X*005010X279A1~ST*271*0001*005010X279A1~NM1*IL*1*F*G****MI*M9~EB*1**30~EB*B**98***27*20.5*****Y~SE*1*0001~ST*277*0002*005010X212~TRN*2*T1~STC*F2:88*20240105**75.5~SE*1*0002~"
    rows = x12.enveloped(x12.segments(spark.createDataFrame([("f", isa + text)], "file string, raw string")))
    b = [(r.member, r.info_code, r.amount, r.in_network) for r in x12.benefits_271(rows).orderBy("info_code").collect()]
    assert b == [("M9", "1", None, False), ("M9", "B", 20.5, True)]
    s = x12.statuses_277(rows).first()
    assert (s.trace, s.status, s.effective, s.charge) == ("T1", "denied", datetime.date(2024, 1, 5), 75.5)
    rules = spark.createDataFrame([("EB", 1, "required", "^[0-9]$", 1, 1), ("EB", 12, "not_used", None, None, None)], "segment string, element int, usage string, pattern string, least int, most int")
    assert sorted((r.element, r.issue, r.severity) for r in x12.companion_issues(rows, rules).collect()) == [(1, "INVALID_PATTERN", "error"), (12, "ELEMENT_NOT_USED", "warning")]


def test_csv_types_patients_and_releases(spark, tmp_path):
    (tmp_path / "p.csv").write_text('MRN, Last Name,DOB,phone_number,\n1,"O, N",2001-02-03,5415553219,x\n2,B,2002-02-03,5415553218,y\n')
    rows = csvfiles.read(spark, str(tmp_path / "p.csv"))
    assert rows.columns == ["mrn", "last_name", "dob", "phone_number", "col_4"]
    p = csvfiles.patients(rows).orderBy("mrn").first()
    assert (p.mrn, p.family, p.birth_date, p.gender) == ("1", "O, N", datetime.date(2001, 2, 3), "U")
    types = {r.column: r.type for r in csvfiles.infer_types(rows).collect()}
    assert types["mrn"] == "integer" and types["dob"] == "date" and types["phone_number"] == "phone"
    both = spark.createDataFrame([("p1", "m1", " ", "s1")], "patient_id string, medical_record_number string, last_name string, surname string")
    assert tuple(csvfiles.patients(both).select("mrn", "family").first()) == ("m1", "s1")
    shapes = ["123-45-6789", "a@b.c", "(541) 555-3219", "A123456", "F", "E11.9", "2024/1/2", "42", "4.5", "x y"]
    got = spark.createDataFrame([(x,) for x in shapes], "v string").select(csvfiles.value_type(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == ["ssn", "email", "phone", "mrn", "gender", "code", "date", "integer", "float", "string"]
    (tmp_path / "MRCONSO.RRF").write_text('C1|ENG|P|L1|PF|S1|Y|A1||||SNOMEDCT_US|PT|123|Heart "attack"|0|N||\nC2|FRE|P|L1|PF|S1|Y|A1||||SNOMEDCT_US|PT|124|Coeur|0|N||\nC3|ENG|P|L1|PF|S1|N|A1||||LNC|PT|5-1|Old|0|O||\n')
    c = csvfiles.concepts(csvfiles.read_rrf(spark, str(tmp_path / "MRCONSO.RRF"), csvfiles.MRCONSO)).collect()
    assert [(r.cui, r.name) for r in c] == [("C1", 'Heart "attack"')]
    icd = spark.createDataFrame([("E11.9", "Diabetes", "E11", "true"), ("E11", "Group", "E", "0"), ("", "x", "", "1")], "code string, description string, category string, is_billable string")
    assert [(r.code, r.parent) for r in csvfiles.icd10(icd).collect()] == [("E119", "E11")]


def test_cda(spark):
    xml = '<d xmlns="urn:hl7-org:v3" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><section><code code="8716-3"/><entry><observation><code code="8480-6" codeSystem="2.16.840.1.113883.6.1"/><effectiveTime value="202401020304"/><value xsi:type="PQ" value="120" unit="mmHg"/></observation></entry><entry><observation><code code="8462-4"/><value xsi:type="CD" code="x"/></observation></entry></section></d>'
    s = documents.cda_sections(spark.createDataFrame([(1, xml), (2, "<bad"), (3, None)], "k long, xml string"), "k")
    assert {r.k: (r.error or "")[:11] for r in s.collect()} == {1: "", 2: "INVALID_XML", 3: "INVALID_XML"}
    e = documents.cda_events(s, "k").collect()
    assert [(r.event_type, r.code, r.system, r.number, r.unit) for r in e] == [("vital_sign", "8480-6", "LOINC", 120.0, "mmHg")]


def test_fhir_resources(spark):
    frame = spark.createDataFrame([(7, "Ann")], "k long, name string")
    p = json.loads(frame.select(fhir.to_json(fhir.patient(F.col("k"), F.lit("M7"), F.lit("Fam"), F.col("name"), F.lit("F"), F.lit("1990-01-02").cast("date"), F.lit("555"), F.lit("12345")))).first()[0])
    assert p["resourceType"] == "Patient" and p["gender"] == "female" and p["birthDate"] == "1990-01-02" and p["telecom"][0]["value"] == "555" and "middle" not in p
    o = json.loads(frame.select(fhir.to_json(fhir.observation(F.col("k"), F.lit("7"), F.lit("2345-7"), F.lit("Glucose"), F.lit("LOINC"), F.lit("5.5"), F.lit("mg"), F.lit("H"), F.lit("F"), F.lit("2024-01-01").cast("timestamp")))).first()[0])
    assert o["valueQuantity"]["value"] == 5.5 and "valueString" not in o and o["interpretation"][0]["coding"][0]["display"] == "High" and o["code"]["coding"][0]["system"] == "http://loinc.org"
    bad = spark.createDataFrame([('{"resourceType":"Patient","birthDate":"1.1.1990"}',), ("{}",)], "r string").select(fhir.issues(F.col("r")).alias("i")).collect()
    assert bad[0].i == ["error:required:Patient.identifier", "error:required:Patient.name", "error:required:Patient.gender", "error:value:birthDate"] and bad[1].i == ["error:structure:resourceType"]


def test_append_checks_versions(spark):
    log = spark.createDataFrame([(0, "a", 0), (1, "a", 1)], "position long, stream_id string, stream_version long")
    batch = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("b", 3, -1, "z"), ("c", 4, 3, "w"), ("d", 5, -2, "v")], "stream_id string, seq long, expected_version long, event_type string")
    rows, rejected = eventlog.append(log, batch)
    assert sorted((r.stream_id, r.stream_version, r.position) for r in rows.collect()) == [("a", 2, 2), ("a", 3, 3), ("b", 0, 4), ("d", 0, 5)]
    assert [(r.stream_id, r.expected_version, r.actual_version) for r in rejected.collect()] == [("c", 3, -1)]


def test_submission_against_receipts(spark):
    receipts = spark.createDataFrame([("k1", "f1")], "idempotency_key string, fingerprint string")
    batch = spark.createDataFrame([("k1", "f1", 1), ("k1", "f2", 2), ("k2", "f1", 3), ("k2", "f1", 4)], "idempotency_key string, fingerprint string, seq long")
    assert {r.seq: r.outcome for r in eventlog.submit(receipts, batch).collect()} == {1: "duplicate", 2: "conflict", 3: "accepted", 4: "duplicate"}


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_are_exact(spark, seed):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.floor(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(50 if seed else 100000)) / 3).cast("double").alias("v"))
    got = {r.g: r for r in projections.latency_summary(rows, "v", "g").collect()}
    for g in range(3):
        own = sorted(r.v for r in rows.where(f"g = {g}").collect())
        assert [got[g].p50, got[g].p90, got[g].p95, got[g].p99, got[g].p99_9] == [own[int(len(own) * p)] for p in (0.5, 0.9, 0.95, 0.99, 0.999)]


def test_scores(spark):
    frame = spark.createDataFrame([('{"a":1,"b":"","c":{"d":null,"e":0}}', '{"a":1,"t":"red bolt","l":[1,2]}', '{"a":2,"t":"red nut","l":[2]}')], "d string, want string, got string")
    r = frame.select(quality.json_completeness(F.col("d")).alias("q"), quality.json_match(F.col("want"), F.col("got")).alias("m")).first()
    assert r.q == pytest.approx(2 / 5) and r.m == pytest.approx((0.5 + 1 / 3 + 0.75) / 3)
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(x.c, 6) for x in v.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.707107, 0.0, 0.0]


def test_pairs_meet_once(spark):
    r = spark.range(40).select("id", F.when(F.col("id") < 30, "hot").alias("k"), (F.col("id") % 10).alias("second"))
    keys = F.array_compact(F.array(F.col("k"), F.concat(F.lit("s"), F.col("second"))))
    got = [tuple(x) for x in matching.pairs(r, "id", keys).collect()]
    assert sorted(got) == [(a, b) for a in range(40) for b in range(a + 1, 40) if b < 30 or a % 10 == b % 10]


def test_paths_and_upserts(spark):
    assert sinks.safe_path("/base", "a/b") == "/base/a/b"
    with pytest.raises(ValueError, match="leaves"):
        sinks.safe_path("/base", "../x")
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    n = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, seq long")
    assert sorted(map(tuple, sinks.upsert(t, n, ["k"], "seq").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    sent = sinks.delivered(t, "k", lambda b: [None if v == "a" else "status 503" for v in b["v"]])
    assert sorted((r.k, r.error) for r in sent.collect()) == [(1, None), (2, "status 503")]


def test_fuzzy_tiers(spark):
    c = spark.createDataFrame([("1-8", "Glucose"), ("2-6", "Glucose level"), ("3-4", "Blood glucose"), ("4-2", "Glucosa"), ("5-9", "Iron")], "code string, name string")
    got = [(r.code, round(r.confidence, 3)) for r in terminology.fuzzy(c, "glucose", 10).collect()]
    assert got[:2] == [("1-8", 0.98), ("2-6", 0.96)] and {x for x, _ in got} == {"1-8", "2-6", "3-4", "4-2"}


def test_breaker_steps():
    at, state, allowed = datetime.datetime(2024, 1, 1), ("closed", 0, None), []
    for seconds, ok in [(0, False), (1, False), (2, False), (3, True), (40, True), (41, True), (42, False)]:
        *state, through = folds.step(*state, at + datetime.timedelta(seconds=seconds), ok, 3, 2, 30.0)
        allowed.append((through, state[0]))
    assert allowed == [(True, "closed"), (True, "closed"), (True, "open"), (False, "open"), (True, "half_open"), (True, "closed"), (True, "closed")]


def test_breaker_and_bucket_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    calls = spark.range(30).select(F.col("id").alias("position"), F.lit("e").alias("endpoint"), F.lit("e").alias("key"), F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("id") / 10)).alias("ts"), (F.col("id") % 7 == 6).alias("ok"))
    calls.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/in")
    folds.to_folder(folds.rate_limited(stream, 2.0, 5.0), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    got = {r.position: r.allowed for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert [sum(got[k] for k in range(a, a + 10)) for a in (0, 10, 20)] == [5, 2, 2]
    folds.to_folder(folds.breaker(stream, failures=5, successes=2, open_seconds=30.0), f"{tmp_path}/out2", f"{tmp_path}/c2").awaitTermination()
    got = {r.position: r.allowed for r in spark.read.parquet(f"{tmp_path}/out2").collect()}
    assert [got[k] for k in range(7)] == [True] * 5 + [False] * 2


def test_hl7_orders_vaccines_and_strict_reading(spark):
    head = "MSH|^~\\&|A|B|C|D|20240101||{}|1|P|2.5\r"
    rows = [(1, head.format("VXU^V04") + "PID|1||9^^^H^MR\rRXA|0|1|20240102||08^HepB^CVX|0.5|mL||||||||L1|||||CP\rZXT|1|local"), (2, head.format("RDE^O11") + "PID|1||9\rORC|NW|77\rRXE||313782^Acet^RXNORM|1|2|tab|T"), (3, "\x0bMSH|x\x1c\rnoise\x0bMSH|y\x1c\r")]
    m = hl7v2.parse(spark.createDataFrame(rows, "k int, raw string"))
    r = {x.k: x for x in m.select("k", hl7v2.event_type(F.col("type")).alias("e"), hl7v2.immunization().alias("i"), hl7v2.medication_order().alias("o"), hl7v2.extensions({"ZXT": {2: "origin", 3: "none"}}).alias("z"), hl7v2.strict_issues().alias("s"), hl7v2.acknowledgement(F.lit("accept")).alias("a")).collect()}
    assert (r[1].e, r[1].i.code, r[1].i.amount, r[1].i.lot, r[1].z) == ("immunization", "08", 0.5, "L1", {"origin": "local"})
    assert (r[2].e, r[2].o.code, r[2].o.most, r[2].o.order_number, r[2].o.control) == ("medication_order", "313782", 2.0, "77", "NW")
    assert r[1].s == ["MISSING_EVN", "MISSING_PV1"] and r[1].a == "MSH|^~\\&|C|D|A|B|||ACK|1|P|2.5\rMSA|AA|1"
    assert m.where("k = 3").select(hl7v2.unframed(F.col("raw"))).first()[0] == ["MSH|x", "MSH|y"]


def test_fhir_members(spark):
    one = spark.range(1)
    k, t = F.lit(5), F.lit("t")
    made = [fhir.organization(k, t, F.lit("1234567893")), fhir.practitioner(k, t, t, F.lit(None).cast("string")), fhir.practitioner_role(k, k, k, t, t), fhir.location(k, t, k), fhir.related_person(k, k, t, t, F.lit("mother")), fhir.care_team(k, k, F.array(F.struct(k.alias("practitioner"), t.alias("role")))), fhir.provenance(k, F.lit("Patient/1"), F.lit("2024-01-01").cast("timestamp"), k), fhir.coverage(k, k, t, t, F.lit(True)), fhir.procedure(k, k, t, t, F.lit("CPT"), F.lit("2024-01-01").cast("timestamp")), fhir.immunization(k, k, t, t, F.lit("CVX"), F.lit("2024-01-01").cast("timestamp")), fhir.claim(k, k, F.lit(2.0), F.lit("2024-01-01").cast("timestamp"), F.array(F.struct(F.lit(1).alias("number"), t.alias("procedure"), F.lit(2.0).alias("charge"))))]
    got = [json.loads(x) for x in one.select(*[fhir.to_json(m).alias(f"c{n}") for n, m in enumerate(made)]).first()]
    assert [x["resourceType"] for x in got] == ["Organization", "Practitioner", "PractitionerRole", "Location", "RelatedPerson", "CareTeam", "Provenance", "Coverage", "Procedure", "Immunization", "Claim"]
    assert got[5]["participant"][0]["member"]["reference"] == "Practitioner/5" and got[9]["patient"]["reference"] == "Patient/5" and "identifier" not in got[1] and got[10]["item"][0]["net"]["currency"] == "USD"


def test_companion_paths_and_guides(spark):
    path = companion.parse_path("2010BB.NM1[2].3-1")
    assert (path.loop, path.segment, path.occurrence, path.element, path.component) == ("2010BB", "NM1", 1, 3, 1)
    assert companion.parse_path("CLM.2").occurrence is None and companion.parse_path("LX[*].1").occurrence == -1
    for bad in ("", "CLM", "2300.CLM", "a.b.c.d", "CLM.x", "CLM[0x].1"):
        with pytest.raises(companion.PathError):
            companion.parse_path(bad)
    isa = "ISA*00*          *00*          *ZZ*A              *ZZ*RCV            *240102*1253*^*00501*000000001*0*P*:~"
    text = isa + "GS*HC*S*R*20240102*1253*1*X*005010X222A1~ST*837*0001*005010X222A1~NM1*85*2*CLINIC*****XX*1234567893~CLM*7*50***11:B:1~LX*1~SV1*HC:99213*50~LX*2~SV1*HC:99214*9~SE*1*0001~"
    t = companion.transactions(x12.enveloped(x12.segments(spark.createDataFrame([("f", text)], "file string, raw string"))))
    got = t.select(companion.values("LX[*].1").alias("all"), companion.values("2400.SV1[2].1-2").alias("second"), companion.values("2300.CLM.5-1").alias("place"), companion.values("CLM[3].1").alias("none"), companion.values("1000A.NM1.1").alias("loop")).first()
    assert (got["all"], got.second, got.place, got.none, got.loop) == (["1", "2"], ["99214"], ["11"], [], [])
    conditions = ["CLM.1=7", "CLM.1!=7", "exists(CLM.1)", "!exists(CLM.1)", "odd", "", "no path=1"]
    assert list(t.select(*[companion.holds(c).alias(f"c{k}") for k, c in enumerate(conditions)]).first()) == [True, False, True, False, True, True, True]
    guides = [{"name": "kind", "kind": "837P"}, {"name": "other", "receiver": "X", "kind": "837P"}, {"name": "own", "receiver": "RCV"}]
    assert t.select(companion.detected(guides).alias("g")).first().g == "own"
    assert t.select(companion.detected(guides[:2]).alias("g")).first().g == "kind" and t.select(companion.detected(guides[1:2]).alias("g")).first().g is None
    rules = {"rules": [{"path": "NM1.9", "type": "luhn"}, {"path": "CLM.1", "type": "mbi"}, {"path": "CLM.2", "type": "range", "min_value": 60}, {"path": "CLM.1", "type": "strange"}]}
    assert [(x.path, x.issue) for x in t.select(companion.issues(rules).alias("i")).first().i] == [("NM1.9", "INVALID_CHECKSUM"), ("CLM.1", "INVALID_MBI_LENGTH"), ("CLM.2", "VALUE_TOO_LOW")]


def test_event_input(spark):
    rows = [(1, '[{"type":"a"}, {"type":"b"}]'), (2, '{"type":"c"}\n\n {"type":"d"} '), (3, ""), (4, None), (5, '{"type":"e"}\n[1]\nbad'), (6, "[]"), (7, "[bad")]
    out = eventinput.envelope(eventinput.event_rows(spark.createDataFrame(rows, "k int, raw string"))).collect()
    assert sorted((r.k, r.event_type) for r in out if r.error is None) == [(1, "a"), (1, "b"), (2, "c"), (2, "d"), (5, "e")]
    assert sorted((r.k, r.error) for r in out if r.error) == [(3, "EMPTY_INPUT"), (4, "EMPTY_INPUT"), (5, "INVALID_JSON"), (5, "INVALID_JSON"), (6, "INVALID_JSON"), (7, "INVALID_JSON")]


def test_clinical_values(spark):
    one = spark.range(1)
    dose = lambda d, u: one.select(clinical.dose_quantity(F.lit(d), F.lit(u)).alias("q")).first().q
    assert tuple(dose("2.5 to 5", "Tablets")) == (2.5, "Tablets", "http://unitsofmeasure.org", "{tbl}") and dose(" ", "mg") is None and tuple(dose("some", "mg")) == (None, "mg", None, None)
    t = one.select(clinical.timing(F.lit("bid")).alias("a"), clinical.timing(F.lit("PRN")).alias("b"), clinical.timing(F.lit("noon")).alias("c")).first()
    assert (t.a.repeat.frequency, t.a.code.coding[0].code, t.b.repeat, t.b.code.coding[0].code, t.c.code.coding, t.c.code.text) == (2, "BID", None, "PRN", None, "noon")


def test_lab_matches(spark):
    codes = spark.createDataFrame([("6690-2", "Leukocytes [#/volume] in Blood", "Leukocytes"), ("2345-7", "Glucose [Mass/volume] in Serum", "Glucose"), ("2823-3", "Potassium in Serum", "Potassium"), ("1-1", "Glucosa", "Glucosa")], "code string, name string, component string")
    best = lambda q: [(r.code, r.confidence, r.via) for r in lookups.matched(codes, q, 3).collect()]
    assert best("2345-7")[0] == ("2345-7", 1.0, "code") and best("wbc")[0] == ("6690-2", 1.0, "alias") and best("k")[0] == ("2823-3", 0.98, "abbreviation")
    assert best("blood sugar")[0] == ("2345-7", round(0.95 * 0.98, 9), "synonym") and best("glucose")[0][0] == "2345-7" and best("glucosx")[0][2] == "fuzzy"
    r = spark.range(1).select(lookups.lab_code(F.lit("hba1c")).alias("a"), lookups.panel_code(F.lit("cbc")).alias("b"), lookups.lab_code(F.lit("x")).alias("c"), lookups.synonyms_of(F.lit(" hb ")).alias("d"), lookups.expanded(F.lit("serum k")).alias("e")).first()
    assert tuple(r) == ("4548-4", "58410-2", None, ["HEMOGLOBIN", "HGB"], "SERUM POTASSIUM")


def test_unknown_transforms_are_refused(spark):
    frame = spark.createDataFrame([(1, "{}")], "position long, data string")
    for t in ({"shout": "x"}, {}, {"map_terminology": {"field": "a", "from": "x", "to": "y"}}):
        with pytest.raises(ValueError, match="route r"):
            workflow.transformed(frame, workflow.Route("r", transforms=[t]))


def test_release_loaders(spark, tmp_path):
    (tmp_path / "RXNCONSO.RRF").write_text("1|ENG||||||A1||||RXNORM|IN|1|Aspirin||N||\n2|SPA||||||A2||||RXNORM|IN|2|Aspirina||N||\n3|ENG||||||A3||||RXNORM|BN|3|Bayer||O||\n")
    (tmp_path / "RXNREL.RRF").write_text("3|||RO|1|||tradename_of|||RXNORM|||||\n|9||RO||8||x|||RXNORM|||||\n")
    (tmp_path / "Loinc.csv").write_text('"LOINC_NUM","LONG_COMMON_NAME","SHORTNAME","COMPONENT","CLASS","STATUS"\n"1-8","Glucose, x","Gluc","Glucose","CHEM","ACTIVE"\n"2-6","Old","O","Old","CHEM","DEPRECATED"\n')
    (tmp_path / "Panels.csv").write_text('"ParentLoinc","LOINC","LoincName","SEQUENCE"\n"5-9","1-8","Glucose",2\n')
    c = csvfiles.drugs(csvfiles.read_rrf(spark, str(tmp_path / "RXNCONSO.RRF"), csvfiles.RXNCONSO), 4).collect()
    assert [(r.rxcui, r.name, r.release_id) for r in c] == [("1", "Aspirin", 4)]
    assert [(r.rxcui1, r.rela, r.rxcui2) for r in csvfiles.drug_relations(csvfiles.read_rrf(spark, str(tmp_path / "RXNREL.RRF"), csvfiles.RXNREL), 4).collect()] == [("3", "tradename_of", "1")]
    assert [tuple(r) for r in csvfiles.labs(csvfiles.read(spark, str(tmp_path / "Loinc.csv"))).select("code", "name", "class").collect()] == [("1-8", "Glucose, x", "CHEM")]
    assert [tuple(r) for r in csvfiles.panels(csvfiles.read(spark, str(tmp_path / "Panels.csv"))).collect()] == [("5-9", "1-8", "Glucose", 2)]
