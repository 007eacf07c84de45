"""X12 interchanges: delimiters, segments, envelopes, hierarchical levels, and claims, payments, eligibility and status from them.

Order matters in X12, so state that carries on from segment to segment is a last-value window over each interchange's segment positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import claims

# Implementation references and the transactions that they tell.
REFERENCES = {"X222": "837P", "X223": "837I", "X224": "837D", "X221": "835", "X279": "270", "X212": "276", "X220": "834", "X217": "278"}


def segments(files: DataFrame, key: str = "file", raw: str = "raw") -> DataFrame:
    """(key, pos, id, elements): segments of each interchange in order; elements[n] is element n. Separators come from the fixed-width ISA."""
    text = F.regexp_replace(F.col(raw), "^(﻿)?\\s*", "")
    element, end = F.substring(text, 4, 1), F.substring(text, 106, 1)
    lit = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    cut = files.select(key, F.substring(text, 105, 1).alias("component"), element.alias("element"), F.posexplode(F.split(text, lit(end))).alias("pos", "segment")).withColumn("segment", F.trim(F.regexp_replace("segment", "[\r\n]", "")))
    out = cut.where("segment <> ''").withColumn("elements", F.split("segment", lit(F.col("element"))))
    return out.select(key, "pos", F.col("elements")[0].alias("id"), "elements", "component")


def at(number: int) -> Column:
    """Element of a segment, null if absent or empty."""
    return F.nullif(F.get("elements", F.lit(number)), F.lit(""))


def composite(number: int, part: int) -> Column:
    """Component of a composite element, from 1."""
    return F.nullif(F.split_part(F.coalesce(at(number), F.lit("")), F.col("component"), F.lit(part)), F.lit(""))


def enveloped(rows: DataFrame, key: str = "file") -> DataFrame:
    """Segments with the control numbers of their interchange, group and transaction, and the transaction's kind."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    carried = {"interchange": ("ISA", at(13)), "group": ("GS", at(6)), "transaction": ("ST", at(2)), "code": ("ST", at(1)), "reference": ("ST", F.coalesce(at(3), F.lit("-"))), "sender": ("ISA", F.trim(at(6))), "receiver": ("ISA", F.trim(at(8)))}
    out = rows.withColumns({name: F.last(F.when(F.col("id") == seg, value), True).over(w) for name, (seg, value) in carried.items()})
    kind = F
    for mark, name in REFERENCES.items():
        kind = kind.when(F.contains("reference", F.lit(mark)) & ((F.lit(name[:3]) == F.left("code", F.lit(3))) | (name not in ("270", "276"))), name)
    return out.withColumn("kind", kind.otherwise(F.col("code")))


def hierarchy(rows: DataFrame, key: str = "file") -> DataFrame:
    """Segments with their level: HL id, parent and code (20 billing, 22 subscriber, 23 dependent ...) carried on to the next HL."""
    w = Window.partitionBy(key, "transaction").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = {"level_id": at(1), "level_parent": at(2), "level": at(3)}
    return rows.withColumns({name: F.last(F.when(F.col("id") == "HL", F.coalesce(value, F.lit("-"))), True).over(w) for name, value in own.items()})


def claims_837(rows: DataFrame, key: str = "file") -> DataFrame:
    """Claims of 837 transactions: billing provider, subscriber, charge, place, diagnoses and service lines.

    A subscriber belongs to the latest billing provider. Everything after a CLM up to the next one is the claim's; LX begins its lines.
    """
    own = hierarchy(rows, key).where(F.left("code", F.lit(3)) == "837")
    w = Window.partitionBy(key, "transaction").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    nm1 = lambda who: (F.col("id") == "NM1") & (at(1) == who)
    marked = own.withColumns({
        "billing": F.last(F.when(nm1("85"), F.struct(at(3).alias("name"), at(9).alias("npi"))), True).over(w),
        "subscriber": F.last(F.when(nm1("IL"), F.struct(at(3).alias("family"), at(4).alias("given"), at(9).alias("member_id"))), True).over(w),
        "claim_pos": F.last(F.when(F.col("id") == "CLM", F.col("pos")).when(F.col("id") == "HL", F.lit(-1)), True).over(w),
        "line": F.last(F.when(F.col("id") == "LX", at(1).try_cast("int")).when(F.col("id") == "CLM", F.lit(0)), True).over(w),
    })
    inside = marked.where(F.col("claim_pos") >= 0)
    is_clm, service = F.col("id") == "CLM", F.col("id").isin("SV1", "SV2")
    line = F.struct(F.col("line").alias("number"), composite(1, 2).alias("procedure"), at(2).try_cast("double").alias("charge"), at(4).try_cast("double").alias("units"))
    return inside.groupBy(key, "transaction", "claim_pos").agg(
        F.max(F.when(is_clm, at(1))).alias("claim_id"), F.max(F.when(is_clm, F.coalesce(at(2).try_cast("double"), F.lit(0.0)))).alias("charge"), F.max(F.when(is_clm, F.split_part(at(5), F.lit(":"), F.lit(1)))).alias("place"),
        F.first(F.when(is_clm, F.col("billing")), True).alias("billing"), F.first(F.when(is_clm, F.col("subscriber")), True).alias("subscriber"),
        F.first(F.when(F.col("id") == "HI", claims.diagnoses(F.col("elements"))), True).alias("diagnoses"), F.array_sort(F.collect_list(F.when(service, line))).alias("lines"),
    ).drop("claim_pos")


def payments_835(rows: DataFrame, key: str = "file") -> DataFrame:
    """Claims of 835 transactions with what was charged and paid, adjustments and the patient's share; a CLP without an LX before it is left out."""
    w = Window.partitionBy(key, "transaction").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.where("code = '835'").withColumns({
        "lx": F.last(F.when(F.col("id") == "LX", F.col("pos")), True).over(w),
        "total": F.last(F.when(F.col("id") == "BPR", at(2).try_cast("double")), True).over(w),
        "check_date": F.last(F.when(F.col("id") == "BPR", dates.edi_date(at(16))), True).over(w),
        "check_number": F.last(F.when(F.col("id") == "TRN", at(2)), True).over(w),
        "claim_pos": F.last(F.when(F.col("id") == "CLP", F.col("pos")).when(F.col("id") == "LX", F.lit(-1)), True).over(w),
    })
    clp, cas = F.col("id") == "CLP", F.col("id") == "CAS"
    return marked.where(F.col("claim_pos").isNotNull() & (F.col("claim_pos") >= 0) & F.col("lx").isNotNull()).groupBy(key, "transaction", "claim_pos").agg(
        F.max(F.when(clp, at(1))).alias("claim_id"), F.max(F.when(clp, at(2))).alias("status"), F.max(F.when(clp, at(3).try_cast("double"))).alias("charged"), F.max(F.when(clp, at(4).try_cast("double"))).alias("paid"), F.max(F.when(clp, at(7))).alias("payer_claim_id"),
        F.max("total").alias("total"), F.max("check_date").alias("check_date"), F.max("check_number").alias("check_number"),
        F.flatten(F.collect_list(F.when(cas, claims.adjustments(F.col("elements"))))).alias("adjustments"), F.sum(F.when(cas, claims.patient_share(F.col("elements"))).otherwise(0.0)).alias("patient_share"),
    ).drop("claim_pos")


def benefits_271(rows: DataFrame, key: str = "file") -> DataFrame:
    """Benefits of 271 transactions with the subscriber that they belong to."""
    w = Window.partitionBy(key, "transaction").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.where("code = '271'").withColumn("member", F.last(F.when((F.col("id") == "NM1") & (at(1) == "IL"), at(9)), True).over(w))
    return marked.where("id = 'EB'").select(key, "transaction", "member", at(1).alias("info_code"), at(3).alias("service_type"), at(7).try_cast("double").alias("amount"), (F.coalesce(at(12), F.lit("")) == "Y").alias("in_network"))


def inquiries_270(rows: DataFrame, key: str = "file") -> DataFrame:
    """Inquiries of 270 transactions: the subscriber asked about and the service types."""
    w = Window.partitionBy(key, "transaction").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.where("code = '270'").withColumns({"member": F.last(F.when((F.col("id") == "NM1") & (at(1) == "IL"), at(9)), True).over(w), "payer": F.last(F.when((F.col("id") == "NM1") & (at(1) == "PR"), at(3)), True).over(w)})
    return marked.where("id = 'EQ'").select(key, "transaction", "payer", "member", at(1).alias("service_type"))


def statuses_277(rows: DataFrame, key: str = "file") -> DataFrame:
    """Claim statuses of 276 and 277 transactions, by trace number."""
    w = Window.partitionBy(key, "transaction").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.where(F.col("code").isin("276", "277")).withColumn("trace", F.last(F.when(F.col("id") == "TRN", at(2)), True).over(w))
    return marked.where("id = 'STC'").select(key, "transaction", "trace", claims.claim_status(at(1)).alias("status"), at(1).alias("composite"), dates.edi_date(at(2)).alias("effective"), at(4).try_cast("double").alias("charge"))


def companion_issues(rows: DataFrame, rules: DataFrame, key: str = "file") -> DataFrame:
    """Issues by companion rules (segment, element, usage, pattern, least, most): a row for each rule that a segment breaks.

    usage required asks for a value, not_used warns of one; pattern, least and most length hold for values that are there.
    """
    met = rows.join(F.broadcast(rules), rows["id"] == rules["segment"])  # a guide is a fixed small table
    value = F.nullif(F.get("elements", F.col("element")), F.lit(""))
    code = (
        F.when((F.col("usage") == "required") & value.isNull(), "MISSING_REQUIRED").when((F.col("usage") == "not_used") & value.isNotNull(), "ELEMENT_NOT_USED")
        .when(F.col("pattern").isNotNull() & ~F.rlike(value, F.col("pattern")), "INVALID_PATTERN").when((F.length(value) < F.col("least")) | (F.length(value) > F.col("most")), "INVALID_LENGTH")
    )
    return met.withColumn("issue", code).where("issue IS NOT NULL").select(key, "pos", "segment", "element", "issue", F.when(F.col("issue") == "ELEMENT_NOT_USED", "warning").otherwise("error").alias("severity"))
