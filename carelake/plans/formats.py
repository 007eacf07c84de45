"""Queries of resources and of message kinds beyond admissions and claims: each renders messages that vary from row to row, and reads them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clinical
from ..operators import fhir, records
from ..sources import companion, eventinput, hl7v2, x12
from .register import query, table


def _json(path: str):
    return F.get_json_object("resource", f"$.{path}")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows over all cores, where their files or a small shuffle would leave them to fewer tasks."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _passes():
    return F.size(fhir.issues(F.col("resource"))).cast("long")


@query("""SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'unknown' END AS status, 'order' AS intent, CAST(o_custkey % 9 AS DOUBLE) AS dose, 'mg' AS unit,
  CASE o_orderkey % 3 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE END AS times, CASE o_orderkey % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'h' END AS period, CAST(o_custkey % 4 AS BIGINT) AS refills, CAST(0 AS BIGINT) AS issues FROM orders""")
def fhir_medication_request(spark, sf_dir):
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("odd")
    often = F.when(k % 3 == 0, "bid").when(k % 3 == 1, "Q6H").otherwise("as told")
    m = fhir.medication_request(k, F.col("o_custkey"), F.lit("313782"), F.lit("Acetaminophen"), F.lit("RXNORM"), F.col("o_orderdate"), status, none, (F.col("o_custkey") % 9).cast("string"), F.lit("MG"), F.lit("po"), often, F.lit(30.0), F.col("o_custkey") % 4)
    o = _dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"))
    dosage = "array<struct<doseAndRate:array<struct<doseQuantity:struct<value:double,code:string>>>,timing:struct<repeat:struct<frequency:double,periodUnit:string>>>>"
    read = F.from_json("resource", f"status string, intent string, dosageInstruction {dosage}, dispenseRequest struct<numberOfRepeatsAllowed:long>")
    r = o.select(k.alias("k"), fhir.to_json(m).alias("resource")).select("k", read.alias("m"), _passes().alias("issues"))
    given = F.get("m.dosageInstruction", F.lit(0))
    amount, repeat = F.get(given["doseAndRate"], F.lit(0))["doseQuantity"], given["timing"]["repeat"]
    return r.select(
        "k", "m.status", "m.intent", amount["value"].alias("dose"), amount["code"].alias("unit"), repeat["frequency"].alias("times"), repeat["periodUnit"].alias("period"), F.col("m.dispenseRequest.numberOfRepeatsAllowed").alias("refills"), "issues",
    )


@query("""SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'resolved' ELSE 'active' END AS clinical, CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS criticality, 'rash ' || c_nationkey AS manifestation,
  CASE WHEN c_custkey % 2 = 0 THEN 'severe' END AS severity, CAST(0 AS BIGINT) AS issues FROM customer""")
def fhir_allergy(spark, sf_dir):
    k = F.col("c_custkey")
    reaction = F.array(F.struct(F.concat(F.lit("rash "), "c_nationkey").alias("manifestation"), F.when(k % 2 == 0, "Severe").otherwise("odd").alias("severity")))
    a = fhir.allergy(k, k, F.lit("7980"), F.lit("Penicillin"), F.lit("RXNORM"), F.lit("2024-01-02").cast("timestamp"), F.when(F.col("c_acctbal") < 0, "Resolved").otherwise("?"), F.when(k % 3 == 0, "HIGH").when(k % 3 == 1, "low").otherwise("odd"), reaction)
    r = table(spark, sf_dir, "customer").select(k.alias("k"), fhir.to_json(a).alias("resource"))
    return r.select("k", _json("clinicalStatus.coding[0].code").alias("clinical"), _json("criticality").alias("criticality"), _json("reaction[0].manifestation[0].text").alias("manifestation"), _json("reaction[0].severity").alias("severity"), _passes().alias("issues"))


def _kinds() -> dict:
    """A resource of each kind for an order."""
    k, p, t = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    words, day = F.col("o_orderpriority"), F.to_date("o_orderdate")
    coded = (k, p, F.lit("c"), words, F.lit("SNOMED"), t)
    lines = F.array(F.struct(F.lit(1).alias("number"), F.lit("99213").alias("procedure"), F.col("o_totalprice").alias("charge")))
    benefit = F.array(F.struct(F.lit("30").alias("service_type"), F.lit("1").alias("info_code"), F.col("o_totalprice").alias("amount"), F.lit(True).alias("in_network")))
    return {
        "Procedure": fhir.procedure(*coded), "Immunization": fhir.immunization(*coded), "MedicationRequest": fhir.medication_request(*coded), "AllergyIntolerance": fhir.allergy(*coded), "ServiceRequest": fhir.service_request(*coded),
        "DocumentReference": fhir.document_reference(*coded, words), "DiagnosticReport": fhir.diagnostic_report(*coded, F.array(k)), "Goal": fhir.goal(k, p, F.lit("c"), words, F.lit("SNOMED"), day), "CarePlan": fhir.care_plan(*coded),
        "Condition": fhir.condition(k, p, F.lit("E11"), words, F.lit("ICD-10-CM"), day, F.lit("active")), "Encounter": fhir.encounter(k, p, F.lit("I"), t, t), "Observation": fhir.vital_sign(k, p, F.lit("Heart rate"), F.lit("72"), F.lit("bpm"), t),
        "Claim": fhir.claim(k, p, F.col("o_totalprice"), t, lines, diagnoses=F.array(F.lit("E119"))), "ExplanationOfBenefit": fhir.explanation(k, k, p, F.col("o_totalprice"), F.lit(1.0), F.lit(0.0), t, words, words),
        "CoverageEligibilityResponse": fhir.eligibility_response(k, p, t, words, F.lit("active"), benefit), "Coverage": fhir.coverage(k, p, words, F.lit("m"), F.lit(True)), "Organization": fhir.organization(k, words, F.lit("1234567893")),
        "Practitioner": fhir.practitioner(k, words, words, F.lit("1234567893")), "PractitionerRole": fhir.practitioner_role(k, k, k, F.lit("c"), words), "Location": fhir.location(k, words, k), "RelatedPerson": fhir.related_person(k, p, words, words, words),
        "CareTeam": fhir.care_team(k, p, F.array(F.struct(k.alias("practitioner"), words.alias("role")))), "Provenance": fhir.provenance(k, F.lit("Patient/1"), t, k),
    }


KINDS = ["Procedure", "Immunization", "MedicationRequest", "AllergyIntolerance", "ServiceRequest", "DocumentReference", "DiagnosticReport", "Goal", "CarePlan", "Condition", "Encounter", "Observation", "Claim", "ExplanationOfBenefit", "CoverageEligibilityResponse", "Coverage", "Organization", "Practitioner", "PractitionerRole", "Location", "RelatedPerson", "CareTeam", "Provenance"]


@query(f"SELECT kind, (SELECT count(*) FROM orders) AS resources, CAST(0 AS BIGINT) AS issues FROM (VALUES {', '.join(f'({x!r})' for x in KINDS)}) v(kind)")
def fhir_resources_valid(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    # a kind at a time: all in one expression make a method that is too large to be compiled
    each = reduce(DataFrame.unionByName, [o.select(fhir.checked(fhir.to_json(r)).alias("c")) for r in _kinds().values()])
    return each.groupBy(F.col("c.kind").alias("kind")).agg(F.count("*").alias("resources"), F.sum(F.size("c.issues").cast("long")).alias("issues"))


def results(spark, sf_dir) -> DataFrame:
    """A message for each order: a result with a line for each of its line items, an admission, an update, or a text without a patient, by key."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "ORU^R01").when(k % 4 == 1, "ADT^A01").when(k % 4 == 2, "ADT^A08").otherwise("ADT^A03")
    head = F.concat(F.lit("MSH|^~\\&|APP|FAC|||20240102||"), kind, F.lit("|"), k, F.lit("|P|2.5"))
    pid = F.when(k % 4 != 3, F.concat(F.lit("PID|1||"), "o_custkey", F.lit("^^^H^MR||Fam"), "o_custkey", F.lit("^Giv||19600102|M")))
    pv1 = F.when(k % 4 == 1, F.concat(F.lit("PV1|1|I|"), "o_orderpriority", F.lit("^1^A")))
    obx = F.when(k % 4 == 0, F.array_join(F.transform("lines", lambda x: F.concat(F.lit("OBX|"), x["l_linenumber"].cast("string"), F.lit("|NM|"), x["l_partkey"].cast("string"), F.lit("^T^LN||"), x["l_quantity"].cast("string"), F.lit("|mg|||||F"))), "\r"))
    return o.select(k.alias("k"), F.concat_ws("\r", head, pid, pv1, obx).alias("raw"))


@query("""WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 2 + coalesce(n, 0) WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS resources, CAST(0 AS BIGINT) AS issues, o_orderkey % 4 = 3 AS unsupported FROM orders LEFT JOIN n ON k = o_orderkey""")
def fhir_bundle_by_event(spark, sf_dir):
    e = fhir.by_event(hl7v2.events(_dealt(results(spark, sf_dir))))
    wrong = F.aggregate(F.transform("resources", lambda r: F.size(fhir.issues(r)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return e.select("k", F.size("resources").cast("long").alias("resources"), wrong.alias("issues"), F.col("unsupported").isNotNull().alias("unsupported"))


@query("SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '8867-4' WHEN 1 THEN '8310-5' WHEN 2 THEN '59408-5' END AS code, CASE c_custkey % 3 WHEN 0 THEN '/min' WHEN 1 THEN 'Cel' ELSE 'odd' END AS unit FROM customer")
def vital_codes(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, "Pulse rate").when(k % 4 == 1, "Body Temperature").when(k % 4 == 2, "SpO2").otherwise("mood")
    unit = F.when(k % 3 == 0, "BPM").when(k % 3 == 1, "°C").otherwise("odd")
    return table(spark, sf_dir, "customer").select(k.alias("k"), clinical.vital_code(name).alias("code"), clinical.vital_unit(unit).alias("unit"))


def _message(kind, key, *segments):
    head = F.concat(F.lit("MSH|^~\\&|APP|FAC|||20240102||"), kind, F.lit("|"), key, F.lit("|P|2.5"))
    return F.concat_ws("\r", head, F.concat(F.lit("PID|1||"), key, F.lit("^^^H^MR||Fam^Giv")), *segments)


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'appointment_booked' WHEN 1 THEN 'appointment_cancelled' WHEN 2 THEN 'appointment_noshow' ELSE 'appointment_rescheduled' END AS event_type, 'A' || o_orderkey AS id, o_orderpriority AS reason,
  date_trunc('day', o_orderdate) AS day FROM orders""")
def hl7_appointments(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "SIU^S12").when(k % 4 == 1, "SIU^S15").when(k % 4 == 2, "SIU^S26").otherwise("SIU^S13")
    sch = F.concat(F.lit("SCH|A"), k, F.lit("||||||x^"), "o_orderpriority", F.lit("||||^^^"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("1015^"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("1045"))
    m = hl7v2.parse(table(spark, sf_dir, "orders").select(k.alias("k"), _message(kind, k, sch).alias("raw"))).withColumn("a", hl7v2.appointment())
    return m.select("k", hl7v2.event_type(F.col("type")).alias("event_type"), "a.id", "a.reason", F.date_trunc("day", "a.start").alias("day"))


@query("""SELECT l_orderkey AS k, count(*) AS lines, round(sum(l_extendedprice), 2) AS amount, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1""")
def hl7_transactions(spark, sf_dir):
    line = F.concat(F.lit("FT1|"), "l_linenumber", F.lit("|T||20240102||CG|"), "l_partkey", F.lit("^Part|||"), F.col("l_quantity").cast("string"), F.lit("|"), F.col("l_extendedprice").cast("string"), F.lit(" USD"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.collect_list(line), "\r").alias("ft1"))
    m = hl7v2.parse(rows.select("k", _message(F.lit("DFT^P03"), F.col("k"), F.col("ft1")).alias("raw"))).withColumn("t", hl7v2.transactions())
    total = lambda name: F.round(F.aggregate(F.transform("t", lambda x: x[name]), F.lit(0.0), lambda s, x: s + x), 2)
    return m.select("k", F.size("t").cast("long").alias("lines"), total("amount").alias("amount"), total("quantity").alias("quantity"))


@query("""SELECT p_partkey AS k, p_name || chr(10) || p_type AS text, 'document' AS event_type FROM part""")
def hl7_documents(spark, sf_dir):
    k = F.col("p_partkey")
    obx = F.concat(F.lit("OBX|1|TX|x||"), "p_name", F.lit("~"), "p_type")
    m = hl7v2.parse(table(spark, sf_dir, "part").select(k.alias("k"), _message(F.lit("MDM^T02"), k, obx).alias("raw")))
    return m.select("k", hl7v2.document_text().alias("text"), hl7v2.event_type(F.col("type")).alias("event_type"))


@query("""SELECT p_partkey AS k, CASE WHEN p_size % 4 <> 0 THEN p_size::VARCHAR END AS code, CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS amount, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS lot FROM part""")
def hl7_immunizations(spark, sf_dir):
    """Every fourth message has no vaccine."""
    k = F.col("p_partkey")
    rxa = F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("RXA|0|1|20240102||"), "p_size", F.lit("^Vac^CVX|"), F.col("p_retailprice").cast("string"), F.lit("|mL||||||||"), "p_brand", F.lit("|||||CP")))
    m = hl7v2.parse(table(spark, sf_dir, "part").select(k.alias("k"), _message(F.lit("VXU^V04"), k, rxa).alias("raw"))).withColumn("v", hl7v2.immunization())
    return m.select("k", "v.code", "v.amount", "v.lot")


@query("""SELECT o_orderkey AS k, array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'MISSING_EVN' END, CASE WHEN o_orderkey % 5 = 0 THEN 'MISSING_PV1' END, CASE WHEN o_orderkey % 7 = 0 THEN 'REPEATED_PID' END], lambda x: x IS NOT NULL), ',') AS issues FROM orders""")
def hl7_strict_admissions(spark, sf_dir):
    k = F.col("o_orderkey")
    head = F.concat(F.lit("MSH|^~\\&|A|B|C|D|20240101||ADT^A01|"), k, F.lit("|P|2.5"))
    pid = F.concat(F.lit("PID|1||"), k, F.lit("^^^H^MR"))
    raw = F.concat_ws("\r", head, F.when(k % 3 != 0, "EVN|A01|20240101"), pid, F.when(k % 7 == 0, pid), F.when(k % 5 != 0, "PV1|1|I"))
    m = hl7v2.parse(table(spark, sf_dir, "orders").select(k.alias("k"), raw.alias("raw")))
    return m.select("k", F.array_join(hl7v2.strict_issues(), ",").alias("issues"))


@query("""SELECT o_orderkey::VARCHAR AS control_id, 'C' || o_custkey AS mrn, CASE WHEN o_orderkey % 5 = 0 THEN 'MISSING_PV1' ELSE '' END AS warnings, sha256('5:hl7v2' || length(o_orderkey::VARCHAR) || ':' || o_orderkey || (1 + length(o_custkey::VARCHAR)) || ':C' || o_custkey) AS event_id FROM orders""")
def durable_admissions(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.concat_ws("\r", F.concat(F.lit("MSH|^~\\&|A|B|C|D|20240101||ADT^A01|"), k, F.lit("|P|2.5")), F.concat(F.lit("PID|1||C"), "o_custkey", F.lit("^^^H^MR||F^G")), F.when(k % 5 != 0, "PV1|1|I"))
    e = records.durable(hl7v2.events(table(spark, sf_dir, "orders").select(raw.alias("raw"))), ["MISSING_PV1"])
    return e.select("control_id", "mrn", F.array_join("warnings", ",").alias("warnings"), "event_id")


ISA = "ISA*00*          *00*          *ZZ*SENDER         *ZZ*RECEIVER       *240102*1253*^*00501*000000001*0*P*:~"


def _files(spark, sf_dir, body) -> DataFrame:
    """An interchange for each order."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("file"), F.concat(F.lit(ISA), body, F.lit("GE*1*1~IEA*1*000000001~")).alias("raw"))
    return x12.enveloped(x12.segments(rows))


@query("""SELECT o_orderkey AS k, 'M' || o_custkey AS member, CASE WHEN o_orderkey % 2 = 0 THEN '6' ELSE '1' END AS info_code, o_totalprice AS amount, o_orderkey % 3 = 0 AS in_network FROM orders""")
def edi_benefits(spark, sf_dir):
    k = F.col("o_orderkey")
    body = F.concat(F.lit("GS*HB*S*R*20240102*1253*1*X*005010X279A1~ST*271*0001*005010X279A1~NM1*IL*1*F*G****MI*M"), "o_custkey", F.lit("~EB*"), F.when(k % 2 == 0, "6").otherwise("1"), F.lit("**30****"), F.col("o_totalprice").cast("string"), F.lit("*****"), F.when(k % 3 == 0, "Y").otherwise("N"), F.lit("~SE*4*0001~"))
    return x12.benefits_271(_files(spark, sf_dir, body)).select(F.col("file").cast("long").alias("k"), "member", "info_code", "amount", "in_network")


@query("""SELECT o_orderkey AS k, 'M' || o_custkey AS member, 'ACME' AS payer, o_orderpriority[1:1] AS service_type FROM orders""")
def edi_inquiries(spark, sf_dir):
    body = F.concat(F.lit("GS*HS*S*R*20240102*1253*1*X*005010X279A1~ST*270*0001*005010X279A1~NM1*PR*2*ACME~NM1*IL*1*F*G****MI*M"), "o_custkey", F.lit("~EQ*"), F.left("o_orderpriority", F.lit(1)), F.lit("~SE*5*0001~"))
    return x12.inquiries_270(_files(spark, sf_dir, body)).select(F.col("file").cast("long").alias("k"), "member", "payer", "service_type")


@query("""SELECT o_orderkey AS k, 'T' || o_orderkey AS trace, CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'denied' END AS status, CAST(o_orderdate AS DATE)::VARCHAR AS effective, o_totalprice AS charge FROM orders""")
def edi_statuses(spark, sf_dir):
    stc = F.when(F.col("o_orderstatus") == "F", "F1:65").when(F.col("o_orderstatus") == "O", "P1:20").otherwise("F2:88")
    body = F.concat(F.lit("GS*HN*S*R*20240102*1253*1*X*005010X212~ST*277*0001*005010X212~TRN*2*T"), "o_orderkey", F.lit("~STC*"), stc, F.lit("*"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("**"), F.col("o_totalprice").cast("string"), F.lit("~SE*4*0001~"))
    s = x12.statuses_277(_files(spark, sf_dir, body))
    return s.select(F.col("file").cast("long").alias("k"), "trace", "status", F.col("effective").cast("string").alias("effective"), "charge")


GUIDES = [
    {"name": "any", "kind": "837P"},
    {
        "name": "acme", "payer": "P1", "kind": "837P",
        "rules": [
            {"path": "CLM.1", "type": "length", "max_length": 3}, {"path": "CLM.2", "type": "range", "min_value": 0, "max_value": 200000}, {"path": "2010AA.NM1.9", "type": "pattern", "pattern": "^[0-9]{10}$"},
            {"path": "CLM.5-3", "usage": "required"}, {"path": "2010BA.NM1.9", "usage": "not_used", "condition": "CLM.5-1=12"}, {"path": "DTP.3", "type": "date"},
        ],
        "codes": [{"path": "CLM.5-1", "values": ["11", "12"], "severity": "warning"}],
    },
]


@query("""WITH o AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN '11' WHEN o_orderkey % 3 = 0 THEN '12' ELSE '99' END AS place FROM orders WHERE o_custkey % 4 <> 0),
i AS (SELECT o_orderkey AS k, 'CLM.1' AS path, 'LENGTH_TOO_LONG' AS issue FROM o WHERE length(o_orderkey::VARCHAR) > 3 UNION ALL SELECT o_orderkey, 'CLM.2', 'VALUE_TOO_HIGH' FROM o WHERE o_totalprice > 200000
  UNION ALL SELECT o_orderkey, 'CLM.5-3', 'MISSING_REQUIRED' FROM o WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, '2010BA.NM1.9', 'ELEMENT_NOT_USED' FROM o WHERE place = '12'
  UNION ALL SELECT o_orderkey, 'CLM.5-1', 'INVALID_CODE' FROM o WHERE place = '99' UNION ALL SELECT o_orderkey, 'DTP.3', 'INVALID_DATE' FROM o WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, '2010AA.NM1.9', 'INVALID_PATTERN' FROM o WHERE o_orderkey % 11 = 0)
SELECT k, 'acme' AS guide, path, issue, CASE WHEN issue IN ('ELEMENT_NOT_USED', 'INVALID_CODE') THEN 'warning' ELSE 'error' END AS severity FROM i""")
def companion_checks(spark, sf_dir):
    """Claims of two payers; one payer's guide has rules."""
    k = F.col("o_orderkey")
    place = F.when(k % 2 == 0, "11").when(k % 3 == 0, "12").otherwise("99")
    body = F.concat(
        F.lit("GS*HC*S*R*20240102*1253*1*X*005010X222A1~ST*837*0001*005010X222A1~HL*1**20*1~NM1*85*2*CLINIC*****XX*"), F.when(k % 11 == 0, "123").otherwise("1234567893"), F.lit("~HL*2*1*22*0~NM1*IL*1*F*G****MI*M1~NM1*PR*2*PAYER*****PI*"),
        F.when(F.col("o_custkey") % 4 == 0, "P2").otherwise("P1"), F.lit("~CLM*"), k, F.lit("*"), F.col("o_totalprice").cast("string"), F.lit("***"), place, F.lit(":B"), F.when(k % 5 != 0, ":1").otherwise(""), F.lit("~DTP*431*D8*"),
        F.when(k % 7 == 0, "20241345").otherwise("20240102"), F.lit("~SE*9*0001~"),
    )
    found = companion.checked(_files(spark, sf_dir, body), GUIDES)
    return found.select(F.col("file").cast("long").alias("k"), "guide", "path", "issue", "severity")


@query("""SELECT o_orderkey AS k, CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'rest' END AS route, 'lab_result' AS event_type FROM orders WHERE o_orderstatus <> 'P'""")
def subscription_routes(spark, sf_dir):
    """Notifications of results; those of one state don't meet the criteria. Each goes to the first route that takes it."""
    o = table(spark, sf_dir, "orders")
    r = fhir.to_json(fhir.observation(F.col("o_orderkey"), F.col("o_custkey"), F.lit("2345-7"), F.lit("Glucose"), F.lit("LOINC"), F.col("o_totalprice").cast("string"), F.lit("mg"), F.lit("N"), F.when(F.col("o_orderstatus") == "P", "P").otherwise("F"), F.col("o_orderdate")))
    bundle = F.concat(F.lit('{"resourceType":"Bundle","type":"history","entry":[{"resource":{"resourceType":"SubscriptionStatus","status":"active"}},{"resource":'), r, F.lit("}]}"))
    e = eventinput.notifications(o.select(bundle.alias("raw")), criteria="event.status == 'final'")
    out = eventinput.routed(e, [("high", F.col("value").cast("double") > 150000), ("rest", F.lit(True))], first_only=True)
    return out.select(F.col("id").cast("long").alias("k"), "route", "event_type")
