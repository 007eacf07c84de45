"""Queries of message formats: messages are rendered from the tables and parsed back; threads, pages and columns are profiled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fhir
from ..sources import csvfiles, documents, hl7v2, x12
from .register import query, table


def hl7_messages(spark, sf_dir) -> DataFrame:
    """An admission with a result for each customer; the name has an escaped delimiter."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    lines = [
        F.concat(F.lit("MSH|^~\\&|APP|FAC|||20240102030405||ADT^A01|"), k, F.lit("|P|2.5")),
        F.concat(F.lit("PID|1||"), k, F.lit("^^^HOSP^MR~9"), k, F.lit("^^^SSA^SS||"), F.col("c_name"), F.lit("\\T\\Co^Given||19"), F.lpad((50 + F.col("c_custkey") % 40).cast("string"), 2, "0"), F.lit("0615|F")),
        F.concat(F.lit("PV1|1|I|"), F.col("c_nationkey").cast("string"), F.lit("^12^A^MAIN")),
        F.concat(F.lit("OBX|1|NM|2345-7^Glucose^LN||"), F.col("c_acctbal").cast("string"), F.lit("|mg/dL|70-99|"), F.when(F.col("c_acctbal") < 0, "CRITICAL LOW").otherwise("N"), F.lit("|||F")),
    ]
    return c.select(F.concat_ws("\r\n", *lines).alias("raw"))


@query("""SELECT c_custkey AS mrn, c_name || '&Co' AS family, 'Given' AS given, CAST(1950 + c_custkey % 40 AS BIGINT) AS birth_year, c_nationkey::VARCHAR AS unit, c_acctbal AS glucose, c_acctbal < 0 AS critical, 'patient_admit' AS event_type FROM customer""")
def hl7_parse_roundtrip(spark, sf_dir):
    e = hl7v2.events(hl7_messages(spark, sf_dir))
    return e.select(F.col("patient.mrn").cast("long").alias("mrn"), "patient.family", "patient.given", F.year("patient.birth_date").cast("long").alias("birth_year"), "encounter.unit", F.col("results")[0]["number"].alias("glucose"), F.col("is_critical").alias("critical"), "event_type")


@query("""SELECT s AS segment, (SELECT count(*) FROM customer) AS present_in, true AS in_all FROM (VALUES ('MSH'), ('PID'), ('PV1'), ('OBX')) v(s)""")
def segment_presence(spark, sf_dir):
    return hl7v2.profile(hl7_messages(spark, sf_dir))


@query("""WITH t AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS message FROM conversations)
SELECT conv_id, CAST(message AS BIGINT) AS message, count(*) AS segments FROM t WHERE message > 0 GROUP BY 1, 2""")
def message_batch_split(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    lines = c.select("conv_id", "turn", F.concat(F.when(F.col("role") == "user", "MSH|").otherwise("NTE|"), "role").alias("text"))
    parts = hl7v2.split_batch(lines, "conv_id", "turn", "text")
    return parts.select("conv_id", F.col("message").cast("long").alias("message"), F.size(F.split("raw", "\r")).cast("long").alias("segments"))


def edi_files(spark, sf_dir) -> DataFrame:
    """An 837 for each order with its lines as service lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))).alias("lines"))
    service = F.array_join(F.transform("lines", lambda x, i: F.concat(F.lit("LX*"), (i + 1).cast("string"), F.lit("~SV1*HC:"), x["l_partkey"].cast("string"), F.lit("*"), x["l_extendedprice"].cast("string"), F.lit("*UN*"), x["l_quantity"].cast("string"), F.lit("~"))), "")
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("o_orderkey").cast("string")
    isa = F.concat(F.lit("ISA*00*          *00*          *ZZ*SENDER         *ZZ*RECEIVER       *240102*1253*^*00501*"), F.lpad(k, 9, "0"), F.lit("*0*P*:~"))
    body = F.concat(F.lit("GS*HC*S*R*20240102*1253*1*X*005010X222A1~ST*837*0001*005010X222A1~HL*1**20*1~NM1*85*2*CLINIC*****XX*1234567893~HL*2*1*22*0~NM1*IL*1*"), F.lit("FAM*GIV****MI*"), F.col("o_custkey").cast("string"), F.lit("~CLM*"), k, F.lit("*"), F.col("o_totalprice").cast("string"), F.lit("***11:B:1~HI*ABK:E119*ABF:I10~"))
    return o.select(k.alias("file"), F.concat(isa, body, service, F.lit("SE*9*0001~GE*1*1~IEA*1*1~")).alias("raw"))


@query("""SELECT o_orderkey AS claim_id, o_totalprice AS charge, o_custkey AS member, '11' AS place, '1234567893' AS npi, 'E119,I10' AS diagnoses, count(*) AS lines, round(max(l_extendedprice), 2) AS highest
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def edi_parse_roundtrip(spark, sf_dir):
    rows = x12.enveloped(x12.segments(edi_files(spark, sf_dir)))
    c = x12.claims_837(rows)
    return c.select(F.col("claim_id").cast("long").alias("claim_id"), "charge", F.col("subscriber.member_id").cast("long").alias("member"), "place", F.col("billing.npi").alias("npi"), F.array_join("diagnoses", ",").alias("diagnoses"), F.size("lines").cast("long").alias("lines"), F.round(F.array_max(F.transform("lines", lambda x: x["charge"])), 2).alias("highest"))


def payment_files(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string")
    isa = F.concat(F.lit("ISA*00*          *00*          *ZZ*PAYER          *ZZ*CLINIC         *240102*1253*^*00501*"), F.lpad(k, 9, "0"), F.lit("*0*P*:~"))
    body = F.concat(F.lit("GS*HP*S*R*20240102*1253*1*X*005010X221A1~ST*835*0001~BPR*I*"), price, F.lit("*C*ACH************20240105~TRN*1*CHK"), k, F.lit("~LX*1~CLP*"), k, F.lit("*1*"), price, F.lit("*10.5*5*MC*PC"), k, F.lit("~CAS*PR*1*5*1*2*2.5~CAS*CO*45*"), price, F.lit("~SE*7*0001~GE*1*1~IEA*1*1~"))
    return o.select(k.alias("file"), F.concat(isa, body).alias("raw"))


@query("""SELECT o_orderkey AS claim_id, o_totalprice AS charged, 10.5::DOUBLE AS paid, 'CHK' || o_orderkey AS check_number, DATE '2024-01-05'::VARCHAR AS check_date, CAST(3 AS BIGINT) AS adjustments, 7.5::DOUBLE AS patient_share FROM orders""")
def edi_payment_roundtrip(spark, sf_dir):
    p = x12.payments_835(x12.enveloped(x12.segments(payment_files(spark, sf_dir))))
    return p.select(F.col("claim_id").cast("long").alias("claim_id"), "charged", "paid", "check_number", F.col("check_date").cast("string").alias("check_date"), F.size("adjustments").cast("long").alias("adjustments"), "patient_share")


TYPE_CASES = " ".join(f"WHEN regexp_matches(value, '{shape}') THEN '{name}'" for name, shape in csvfiles.VALUE_SHAPES)


@query(f"""WITH s AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 10),
l AS (UNPIVOT (SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_acctbal::VARCHAR AS c_acctbal, c_mktsegment FROM s) ON COLUMNS(*) INTO NAME "column" VALUE value),
v AS (SELECT "column", CASE {TYPE_CASES} ELSE 'string' END AS type, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT "column", sum(n) AS total, arg_max(type, (n, type)) AS top, max(n) AS n FROM v GROUP BY 1)
SELECT "column", CASE WHEN n >= 2 AND n >= total // 2 + 1 THEN top ELSE 'string' END AS type FROM t""")
def csv_type_inference(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("order_of_sample", F.col("c_custkey"))
    return csvfiles.infer_types(c, 10, "order_of_sample")


@query("""SELECT c_custkey AS k, 'Patient/' || c_custkey AS url, CASE c_mktsegment WHEN 'MACHINERY' THEN 'male' WHEN 'FURNITURE' THEN 'female' ELSE 'unknown' END AS gender, c_name AS family, CAST(0 AS BIGINT) AS issues FROM customer""")
def fhir_patient_json(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    gender = F.when(F.col("c_mktsegment") == "MACHINERY", "M").when(F.col("c_mktsegment") == "FURNITURE", "F")
    p = fhir.to_json(fhir.patient(k, F.concat(F.lit("M"), k), F.col("c_name"), F.lit(None).cast("string"), gender, F.lit("1980-02-03").cast("date")))
    r = c.select(k.alias("k"), p.alias("resource"))
    return r.select("k", F.concat(F.get_json_object("resource", "$.resourceType"), F.lit("/"), F.get_json_object("resource", "$.id")).alias("url"), F.get_json_object("resource", "$.gender").alias("gender"), F.get_json_object("resource", "$.name[0].family").alias("family"), F.size(fhir.issues(F.col("resource"))).cast("long").alias("issues"))


@query("""SELECT o_custkey AS patient, count(*) AS entries FROM orders GROUP BY 1""")
def fhir_bundle(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    e = fhir.explanation(F.col("o_orderkey"), F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice"), F.lit(1.0), F.lit(0.0))
    b = fhir.bundles(o.select(F.col("o_custkey").alias("patient"), fhir.to_json(e).alias("resource")), "patient")
    return b.select("patient", F.json_array_length(F.get_json_object("bundle", "$.entry")).cast("long").alias("entries"))


@query("""SELECT p_partkey AS k, p_name AS title, CAST(p_size AS VARCHAR) AS value, 'mg' AS unit FROM part""")
def cda_parse_roundtrip(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    xml = F.concat(F.lit('<ClinicalDocument xmlns="urn:hl7-org:v3" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><component><structuredBody><component><section><code code="30954-2"/><title>'), "p_name", F.lit('</title><entry><observation><code code="2345-7" codeSystem="2.16.840.1.113883.6.1"/><effectiveTime value="20240102"/><value xsi:type="PQ" value="'), F.col("p_size").cast("string"), F.lit('" unit="mg"/></observation></entry></section></component></structuredBody></component></ClinicalDocument>'))
    s = documents.cda_sections(p.select(F.col("p_partkey").alias("k"), xml.alias("xml")), "k")
    return documents.cda_events(s, "k").join(s.select("k", "title"), "k").select("k", "title", "value", "unit")


@query("""SELECT o_orderkey AS id, 'lab_result' AS event_type, 'P' || o_custkey AS subject, CAST(round(o_totalprice, 2) AS VARCHAR) IS NOT NULL AS has_value FROM orders""")
def fhir_parse_roundtrip(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    resource = fhir.observation(F.col("o_orderkey"), F.concat(F.lit("P"), "o_custkey"), F.lit("2345-7"), F.lit("Glucose"), F.lit("LOINC"), F.col("o_totalprice").cast("string"), F.lit("mg/dL"), F.lit("N"), F.lit("F"), F.col("o_orderdate"))
    bundle = F.concat(F.lit('{"resourceType":"Bundle","entry":[{"resource":'), fhir.to_json(resource), F.lit("}]}"))
    e = documents.fhir_events(documents.fhir_resources(o.select(bundle.alias("raw"))))
    return e.select(F.col("id").cast("long").alias("id"), "event_type", "subject", F.col("value").isNotNull().alias("has_value"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS BIGINT) AS headings, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def xml_sections(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    n = lambda x: F.size(F.regexp_extract_all("html", F.lit(x), F.lit(0))).cast("long")
    return p.select("page_id", n("<h[1-6][^>]*>").alias("headings"), n("<p[ >]").alias("paragraphs"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
