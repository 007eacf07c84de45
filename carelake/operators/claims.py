"""Claims, payments, eligibility and explanations of benefit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(lines: DataFrame, claim: str, amount: str, paid: str) -> DataFrame:
    return lines.groupBy(claim).agg(F.count("*").alias("lines"), F.round(F.sum(amount), 2).alias("charged"), F.round(F.sum(paid), 2).alias("paid"))


def nested(lines: DataFrame, claim: str, order: str, fields: list[str]) -> DataFrame:
    """Each claim with its lines as an array in order of their number."""
    return lines.groupBy(claim).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("lines"))


def adjustments(segment: Column) -> Column:
    """Adjustments of a CAS segment (array of its elements, group code at 1): reason, amount and quantity by threes until one has no reason.

    The patient's share adds up all amounts, so that isn't cut short; see patient_share.
    """
    triples = F.transform(F.array(*[F.lit(k) for k in range(2, 18, 3)]), lambda k: F.struct(F.get(segment, F.lit(1)).alias("group"), F.get(segment, k).alias("reason"), F.coalesce(F.get(segment, k + 1).try_cast("double"), F.lit(0.0)).alias("amount"), F.get(segment, k + 2).try_cast("double").alias("quantity"), k.alias("at")))
    empty = F.array_min(F.transform(F.filter(triples, lambda t: F.coalesce(t["reason"], F.lit("")) == ""), lambda t: t["at"]))
    return F.filter(triples, lambda t: t["at"] < F.coalesce(empty, F.lit(99)))


def patient_share(segment: Column) -> Column:
    amounts = F.transform(F.array(*[F.lit(k) for k in range(3, 19, 3)]), lambda k: F.coalesce(F.get(segment, k).try_cast("double"), F.lit(0.0)))
    return F.when(F.get(segment, F.lit(1)) == "PR", F.aggregate(amounts, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def diagnoses(segment: Column) -> Column:
    """Codes of an HI segment's composites, at most twelve, up to the first empty one."""
    codes = F.transform(F.slice(segment, 2, 12), lambda x: F.nullif(F.split_part(x, F.lit(":"), F.lit(2)), F.lit("")))
    first = F.array_position(F.transform(codes, lambda c: F.coalesce(c, F.lit(""))), "")
    return F.when(first > 0, F.slice(codes, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int"))).otherwise(codes)


def explained(lines: DataFrame, claim: str) -> DataFrame:
    """Explanation of benefit by claim from lines (submitted, benefit, group, amount): each adjustment group's sum; PR sums are the patient's."""
    sums = {f"adjusted_{g.lower()}": F.round(F.sum(F.when(F.col("group") == g, F.col("amount")).otherwise(F.lit(0))), 2) for g in ("CO", "OA", "PI", "PR")}
    return lines.groupBy(claim).agg(F.round(F.sum(F.when(F.col("submitted") > 0, F.col("submitted")).otherwise(0.0)), 2).alias("submitted"), F.round(F.sum("benefit"), 2).alias("benefit"), *[c.alias(k) for k, c in sums.items()])


def benefits(rows: DataFrame) -> DataFrame:
    """Benefits by service type and network: how many, the best coverage, and the information codes in order."""
    return rows.groupBy("service_type", "in_network").agg(F.count("*").alias("benefits"), F.round(F.max("amount"), 2).alias("highest"), F.array_join(F.array_sort(F.collect_set("info_code")), ",").alias("codes"))


def eligibility(rows: DataFrame, member: str) -> DataFrame:
    """Status of each member: any inactive code wins over active ones."""
    code = F.col("info_code")
    status = F.when(F.bool_or(code.isin("6", "7", "8")), "inactive").when(F.bool_or(code.isin("1", "2", "3", "4", "5")), "active").otherwise("unknown")
    return rows.groupBy(member).agg(status.alias("status"))


# Categories of claim status codes.
STATUS_CATEGORIES = {"A": "acknowledged", "P": "pending", "F": "finalized", "R": "request for more information", "D": "error", "E": "error"}


def claim_status(composite: Column) -> Column:
    """Status of an STC composite: its category letter's meaning, with F2 and F3F as denied and F1 as paid."""
    code = F.split_part(composite, F.lit(":"), F.lit(1))
    first = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_CATEGORIES.items() for x in kv]), F.left(code, F.lit(1)))
    return F.when(code == "F1", "paid").when(code.isin("F2", "F3F"), "denied").otherwise(F.coalesce(first, F.lit("unknown")))
