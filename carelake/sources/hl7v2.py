"""HL7 v2 messages: text to segments, and segments to events. Delimiters are each message's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, identifiers
from ..functions.hl7text import component, field, part, unescape


def segments(raw: Column) -> Column:
    """Array of segments, each an array of its fields; MSH gets its separator as field 1, so that field numbers are the standard's."""
    lines = F.filter(F.split(F.regexp_replace(raw, "\r\n|\n", "\r"), "\r"), lambda x: F.trim(x) != "")
    separator = F.substring(F.regexp_extract(raw, "MSH(.)", 1), 1, 1)
    return F.transform(lines, lambda x: _fields(x, separator))


def _fields(line: Column, separator: Column) -> Column:
    cut = F.split(line, F.concat(F.lit("\\Q"), separator, F.lit("\\E")))
    return F.when(F.startswith(line, F.lit("MSH")), F.concat(F.array(F.lit("MSH"), separator), F.slice(cut, F.lit(2), F.size(cut)))).otherwise(cut)


def parse(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """messages with segments, the first one of each type, type (MSH-9), control_id (MSH-10) and version (MSH-12); texts without an MSH segment get an error."""
    out = messages.withColumn("segments", segments(F.col(raw)))
    names = F.transform("segments", lambda s: s[0])
    kinds = F.array_distinct(names)
    # the first segment of each type is looked for once and not by each field
    out = out.withColumn("firsts", F.map_from_arrays(kinds, F.transform(kinds, lambda n: F.element_at("segments", F.array_position(names, n).cast("int")))))
    msh = first("MSH")
    return out.withColumns({"type": field(msh, 9), "control_id": field(msh, 10), "version": field(msh, 12), "error": F.when(msh.isNull(), "MISSING_MSH")})


def of_type(name: str) -> Column:
    """All segments of a type."""
    return F.filter("segments", lambda s: s[0] == name)


def first(name: str) -> Column:
    return F.element_at(F.col("firsts"), name)


# Message types and the events that they mean.
EVENT_TYPES = {
    "ADT^A01": "patient_admit", "ADT^A02": "patient_transfer", "ADT^A03": "patient_discharge", "ADT^A04": "patient_register", "ADT^A08": "patient_update", "ORU^R01": "lab_result", "SIU^S12": "appointment_booked",
    "SIU^S13": "appointment_rescheduled", "SIU^S14": "appointment_modified", "SIU^S15": "appointment_cancelled", "SIU^S26": "appointment_noshow", "MDM^T": "document", "DFT^P03": "financial_transaction", "DFT^P11": "financial_transaction",
    "VXU^V04": "immunization", "RDE^O11": "medication_order",
}


def event_type(message_type: Column) -> Column:
    out = F
    for k, v in EVENT_TYPES.items():
        out = out.when(F.startswith(message_type, F.lit(k)), v)
    return out.otherwise("unknown")


def identifier_list(pid3: Column) -> Column:
    """Repetitions of PID-3 as structs of value, assigner and type."""
    reps = F.filter(F.split(pid3, "~"), lambda r: F.trim(r) != "")
    return F.transform(reps, lambda r: F.struct(part(r, 0, "^").alias("value"), part(r, 3, "^").alias("assigner"), identifiers.identifier_type(part(r, 4, "^")).alias("type")))


def patient() -> Column:
    """Patient of PID: record number is the first MR identifier, else the first of all; gender and phone as sent."""
    pid = first("PID")
    ids = identifier_list(field(pid, 3))
    mrn = F.coalesce(F.get(F.filter(ids, lambda i: i["type"] == "MRN"), F.lit(0)), F.get(ids, F.lit(0)))["value"]
    name, address = field(pid, 5), field(pid, 11)
    return F.when(pid.isNotNull(), F.struct(
        mrn.alias("mrn"), ids.alias("identifiers"), unescape(component(name, 0)).alias("family"), unescape(component(name, 1)).alias("given"), component(name, 2).alias("middle"), component(name, 3).alias("suffix"), component(name, 4).alias("prefix"),
        dates.hl7_timestamp(field(pid, 7)).cast("date").alias("birth_date"), field(pid, 8).alias("gender"), component(address, 0).alias("line"), component(address, 2).alias("city"), component(address, 3).alias("state"), component(address, 4).alias("zip"),
        component(address, 5).alias("country"), field(pid, 13).alias("phone"),
    ))


def encounter() -> Column:
    pv1 = first("PV1")
    where, doctor = field(pv1, 3), field(pv1, 7)
    return F.when(pv1.isNotNull(), F.struct(
        field(pv1, 19).alias("id"), field(pv1, 2).alias("class"), component(where, 0).alias("unit"), component(where, 1).alias("room"), component(where, 2).alias("bed"), component(where, 3).alias("facility"),
        component(doctor, 0).alias("attending_id"), component(doctor, 1).alias("attending_family"), component(doctor, 2).alias("attending_given"), dates.hl7_timestamp(field(pv1, 44)).alias("admitted"), dates.hl7_timestamp(field(pv1, 45)).alias("discharged"),
    ))


def observations() -> Column:
    """OBX segments as results, in order; numbers only for numeric types."""
    def one(s: Column) -> Column:
        code = field(s, 3)
        return F.struct(
            component(code, 0).alias("code"), component(code, 1).alias("name"), component(code, 2).alias("system"), field(s, 5).alias("value"), F.when(field(s, 2) == "NM", field(s, 5).try_cast("double")).alias("number"), component(field(s, 6), 0).alias("unit"),
            field(s, 7).alias("range"), field(s, 8).alias("flag"), field(s, 11).alias("status"), dates.hl7_timestamp(field(s, 14)).alias("observed"),
        )

    return F.transform(of_type("OBX"), one)


def is_critical() -> Column:
    """Any flag that says critical or panic; HH and LL alone don't."""
    return F.exists(of_type("OBX"), lambda s: F.upper(F.coalesce(field(s, 8), F.lit(""))).rlike("CRITICAL|PANIC"))


def document_text() -> Column:
    """Text of a document message: repetitions are lines, escapes are undone after that."""
    return unescape(F.array_join(F.transform(of_type("OBX"), lambda s: F.regexp_replace(F.coalesce(field(s, 5), F.lit("")), "~", "\n")), "\n"))


def transactions() -> Column:
    """FT1 segments; amounts take the number that a text begins with."""
    def number(x: Column) -> Column:
        return F.regexp_extract(F.coalesce(x, F.lit("")), "^\\s*([-+]?[0-9]*\\.?[0-9]+)", 1).try_cast("double")

    return F.transform(of_type("FT1"), lambda s: F.struct(field(s, 1).alias("set_id"), field(s, 2).alias("id"), dates.hl7_timestamp(field(s, 4)).alias("date"), field(s, 6).alias("type"), component(field(s, 7), 0).alias("code"), component(field(s, 7), 1).alias("text"), number(field(s, 10)).alias("quantity"), number(field(s, 11)).alias("amount")))


def appointment() -> Column:
    sch, ais = first("SCH"), first("AIS")
    when = field(sch, 11)
    return F.when(sch.isNotNull(), F.struct(field(sch, 1).alias("id"), component(field(sch, 7), 1).alias("reason"), dates.hl7_timestamp(component(when, 3)).alias("start"), dates.hl7_timestamp(component(when, 4)).alias("end"), field(sch, 25).alias("status"), component(field(ais, 3), 1).alias("location")))


def warnings(tolerate_missing_pv1: bool = True) -> Column:
    """What is odd about a message: a missing PV1 where one is due, invalid identifiers."""
    due = F.col("type").rlike("^ADT\\^A0[1238]") & first("PV1").isNull()
    bad = F.filter(F.transform(identifier_list(field(first("PID"), 3)), lambda i: identifiers.validated(i["type"], i["value"])), lambda e: e.isNotNull())
    missing = F.when(due, F.array(F.lit("MISSING_PV1"))).otherwise(F.array().cast("array<string>"))
    return F.concat(missing if tolerate_missing_pv1 else F.array().cast("array<string>"), F.coalesce(bad, F.array().cast("array<string>")))


def events(messages: DataFrame, raw: str = "raw", tolerate_missing_pv1: bool = True) -> DataFrame:
    """Events of messages: envelope, patient, encounter, results; messages that can't be taken have an error."""
    parsed = parse(messages, raw)
    no_pv1 = F.lit(not tolerate_missing_pv1) & F.col("type").rlike("^ADT\\^A0[123]") & first("PV1").isNull()
    error = F.coalesce("error", F.when(first("PID").isNull(), "MISSING_PID"), F.when(no_pv1, "MISSING_PV1"))
    return parsed.withColumns({"event_type": event_type(F.col("type")), "patient": patient(), "encounter": encounter(), "results": observations(), "is_critical": is_critical(), "warnings": warnings(tolerate_missing_pv1), "error": error})


def split_batch(lines: DataFrame, file: str = "file", line: str = "line", text: str = "text") -> DataFrame:
    """(file, message, raw): messages of concatenated files, each from an MSH line up to the next; lines before the first one are left out."""
    from pyspark.sql import Window

    number = F.sum(F.when(F.col(text).startswith("MSH"), 1).otherwise(0)).over(Window.partitionBy(file).orderBy(line))
    parts = lines.withColumn("message", number).where("message > 0").groupBy(file, "message").agg(F.array_sort(F.collect_list(F.struct(line, text))).alias("parts"))
    return parts.select(file, "message", F.array_join(F.transform("parts", lambda p: p[text]), "\r").alias("raw"))


def profile(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Of a sample of messages: how many hold each segment, and whether all do."""
    parsed = parse(messages, raw)
    n = parsed.agg(F.count("*").alias("messages"))
    held = parsed.select(F.explode(F.array_distinct(F.transform("segments", lambda s: s[0]))).alias("segment")).groupBy("segment").agg(F.count("*").alias("present_in"))
    return held.crossJoin(F.broadcast(n)).select("segment", "present_in", (F.col("present_in") == F.col("messages")).alias("in_all"))


def immunization() -> Column:
    """Vaccine of a VXU message: RXA's times, code, amount, lot and status."""
    rxa = first("RXA")
    code = field(rxa, 5)
    return F.when(rxa.isNotNull(), F.struct(component(code, 0).alias("code"), component(code, 1).alias("name"), component(code, 2).alias("system"), dates.hl7_timestamp(field(rxa, 3)).alias("given"), field(rxa, 6).try_cast("double").alias("amount"), component(field(rxa, 7), 0).alias("unit"), field(rxa, 15).alias("lot"), field(rxa, 20).alias("status")))


def medication_order() -> Column:
    """Order of an RDE message: RXE's code, amounts and dosage form, ORC's number and control code."""
    rxe, orc = first("RXE"), first("ORC")
    code = field(rxe, 2)
    return F.when(rxe.isNotNull(), F.struct(component(code, 0).alias("code"), component(code, 1).alias("name"), component(code, 2).alias("system"), field(rxe, 3).try_cast("double").alias("least"), field(rxe, 4).try_cast("double").alias("most"), component(field(rxe, 5), 0).alias("unit"), component(field(rxe, 6), 0).alias("form"), component(field(orc, 2), 0).alias("order_number"), field(orc, 1).alias("control")))


def diagnoses() -> Column:
    """DG1 segments: code, text, system, time and type."""
    return F.transform(of_type("DG1"), lambda s: F.struct(component(field(s, 3), 0).alias("code"), component(field(s, 3), 1).alias("text"), component(field(s, 3), 2).alias("system"), dates.hl7_timestamp(field(s, 5)).alias("at"), field(s, 6).alias("type")))


def insurance() -> Column:
    """IN1 segments: plan, company and policy."""
    return F.transform(of_type("IN1"), lambda s: F.struct(component(field(s, 2), 0).alias("plan"), component(field(s, 3), 0).alias("company_id"), component(field(s, 4), 0).alias("company"), field(s, 36).alias("policy")))


def extensions(fields: dict[str, dict[int, str]]) -> Column:
    """Map of a profile's names to the values of local (Z) segments' fields; empty fields have no entry."""
    entries = [F.when(field(first(seg), number).isNotNull(), F.struct(F.lit(name), field(first(seg), number))) for seg, own in fields.items() for number, name in own.items()]
    return F.map_from_entries(F.array_compact(F.array(*entries))) if entries else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


# Segments that an admission must have, in order.
ADMISSION_ORDER = ["MSH", "EVN", "PID", "PV1"]


def strict_issues() -> Column:
    """What strict reading of an admission rejects: missing, repeated or misplaced segments, no control number, no record number, bad times."""
    names = F.transform("segments", lambda s: s[0])
    at = [F.array_position(names, n) for n in ADMISSION_ORDER]
    tests = [F.when(a == 0, f"MISSING_{n}") for n, a in zip(ADMISSION_ORDER, at, strict=True)]
    tests += [F.when(F.size(of_type(n)) > 1, f"REPEATED_{n}") for n in ADMISSION_ORDER]
    tests += [F.when((a > 0) & (b > 0) & (a > b), f"ORDER_{n}") for a, b, n in zip(at, at[1:], ADMISSION_ORDER[1:], strict=False)]
    time = field(first("MSH"), 7)
    tests += [F.when(F.col("control_id").isNull(), "MISSING_CONTROL_ID"), F.when(patient()["mrn"].isNull(), "MISSING_MRN"), F.when(time.isNotNull() & dates.hl7_timestamp(time).isNull(), "INVALID_TIME")]
    return F.array_compact(F.array(*tests))


# Acknowledgement codes in original and enhanced mode.
ACKNOWLEDGED = {"original": {"accept": "AA", "error": "AE", "reject": "AR"}, "enhanced": {"accept": "CA", "error": "CE", "reject": "CR"}}


def acknowledgement(outcome: Column, mode: str = "original") -> Column:
    """ACK message of a parsed one, by outcome accept, error or reject."""
    codes = F.create_map(*[F.lit(x) for kv in ACKNOWLEDGED[mode].items() for x in kv])
    msh = first("MSH")
    return F.concat(F.lit("MSH|^~\\&|"), F.concat_ws("|", *[F.coalesce(field(msh, k), F.lit("")) for k in (5, 6, 3, 4)]), F.lit("|||ACK|"), F.coalesce("control_id", F.lit("")), F.lit("|P|"), F.coalesce("version", F.lit("2.5")), F.lit("\rMSA|"), F.element_at(codes, outcome), F.lit("|"), F.coalesce("control_id", F.lit("")))


# Framing bytes of the transport.
FRAME_START, FRAME_END = "\x0b", "\x1c\r"


def unframed(text: Column) -> Column:
    """Messages of a stretch of framed transport text; what stands outside of frames is left out."""
    return F.regexp_extract_all(text, F.lit(f"(?s){FRAME_START}(.*?){FRAME_END[0]}\r"), F.lit(1))
