"""Companion guides: paths into transactions, conditional rules on elements, code restrictions, and the guide that fits a transaction.

A guide is a mapping: name, receiver, payer, kind, base, rules and codes. Rules are compiled to one Column over a transaction's segments, so that a
scan checks all rules of a guide; the segments of a transaction stand in one row, as a transaction is one message.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers

# The segments that open loops, by their identifier and, for names, their qualifier.
LOOPS = {"1000A": ("NM1", "41"), "1000B": ("NM1", "40"), "2010AA": ("NM1", "85"), "2010AB": ("NM1", "87"), "2010BA": ("NM1", "IL"), "2010BB": ("NM1", "PR"), "2300": ("CLM", None), "2400": ("LX", None)}


class PathError(ValueError):
    """The path isn't well formed."""


@dataclass(frozen=True)
class Path:
    """occurrence counts from 0; None is the first one, -1 all."""

    loop: str | None
    segment: str
    occurrence: int | None
    element: int
    component: int | None


def parse_path(text: str) -> Path:
    """LOOP.SEGMENT[n].element-component; loop, index and component may be left out, [*] takes all occurrences."""
    parts = text.split(".")
    if len(parts) not in (2, 3) or len(parts) == 2 and parts[0][:1].isdigit():
        raise PathError(f"segment and element expected: {text!r}")
    segment = re.fullmatch(r"([A-Z0-9]+)(?:\[(\*|[0-9]+)\])?", parts[-2])
    element = re.fullmatch(r"([0-9]+)(?:-([0-9]+))?", parts[-1])
    if not segment or not element:
        raise PathError(f"not a path: {text!r}")
    index = segment[2]
    return Path(parts[0] if len(parts) == 3 else None, segment[1], None if index is None else -1 if index == "*" else int(index) - 1, int(element[1]), int(element[2]) if element[2] else None)


def transactions(rows: DataFrame, key: str = "file") -> DataFrame:
    """(key, transaction, kind, reference, receiver, payer, segs) of enveloped rows: each transaction's segments in order, with the loop that they are in."""
    opened = F
    for name, (segment, qualifier) in LOOPS.items():
        own = F.col("id") == segment
        opened = opened.when(own & (F.get("elements", F.lit(1)) == qualifier) if qualifier else own, name)
    w = Window.partitionBy(key, "transaction").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.where("transaction IS NOT NULL").withColumn("loop", F.last(opened.otherwise(F.when(F.col("id") == "HL", "")), True).over(w))
    payer = F.max(F.when((F.col("id") == "NM1") & (F.get("elements", F.lit(1)) == "PR"), F.get("elements", F.lit(9))))
    return marked.groupBy(key, "transaction").agg(
        F.first("kind").alias("kind"), F.first("reference").alias("reference"), F.first("receiver").alias("receiver"), payer.alias("payer"),
        F.array_sort(F.collect_list(F.struct("pos", "id", "elements", "component", F.coalesce("loop", F.lit("")).alias("loop")))).alias("segs"),
    )


def values(path: str, segs: str = "segs") -> Column:
    """Array of the filled values at a path."""
    p = parse_path(path)
    own = F.filter(segs, lambda s: (s["id"] == p.segment) & ((s["loop"] == p.loop) if p.loop else F.lit(True)))
    taken = own if p.occurrence == -1 else F.slice(own, (p.occurrence or 0) + 1, 1)

    def value(s: Column) -> Column:
        out = F.get(s["elements"], F.lit(p.element))
        return out if p.component is None else F.split_part(F.coalesce(out, F.lit("")), s["component"], F.lit(p.component))

    return F.filter(F.transform(taken, value), lambda v: v.isNotNull() & (v != ""))


def holds(condition: str | None) -> Column:
    """a=b, a!=b or exists(path); no condition, and one of another form, holds."""
    text = (condition or "").strip()
    try:
        for sign in ("!=", "="):
            if sign in text:
                path, want = (x.strip() for x in text.split(sign, 1))
                same = F.coalesce(F.get(values(path), F.lit(0)), F.lit("")) == want
                return ~same if sign == "!=" else same
        if found := re.fullmatch(r"(!?)exists\((.*)\)", text):
            some = F.size(values(found[2].strip())) > 0
            return ~some if found[1] else some
    except PathError:
        pass
    return F.lit(True)


def _date_issue(v: Column) -> Column:
    layout = F.when(F.length(v) == 8, F.try_to_timestamp(v, F.lit("yyyyMMdd"))).otherwise(F.try_to_timestamp(v, F.lit("yyMMdd")))
    return F.when(~F.length(v).isin(6, 8), "INVALID_DATE_LENGTH").when(layout.isNull(), "INVALID_DATE")


def _broken(rule: dict, v: Column) -> Column:
    """Code of what is wrong with a value, null if nothing; rules of an unknown type pass."""
    kind, number = rule.get("type"), v.try_cast("double")
    if kind == "pattern":
        return F.when(~v.rlike(rule["pattern"]), "INVALID_PATTERN")
    if kind == "luhn":
        return F.when(~F.coalesce(F.call_function("luhn_check", v), F.lit(False)), "INVALID_CHECKSUM")
    if kind == "mbi":
        return identifiers.mbi_error(v)
    if kind == "length":
        return F.when(F.length(v) < rule.get("min_length", 0), "LENGTH_TOO_SHORT").when(F.lit(bool(rule.get("max_length"))) & (F.length(v) > (rule.get("max_length") or 0)), "LENGTH_TOO_LONG")
    if kind == "range":
        low, high = rule.get("min_value"), rule.get("max_value")
        return F.when(number.isNull(), "NOT_NUMERIC").when(F.lit(low is not None) & (number < (low or 0)), "VALUE_TOO_LOW").when(F.lit(high is not None) & (number > (high or 0)), "VALUE_TOO_HIGH")
    if kind == "date":
        return _date_issue(v)
    if kind == "codes":
        return F.when(~v.isin(rule["values"]), "INVALID_CODE")
    return F.lit(None).cast("string")


EMPTY = "array<struct<path:string,issue:string,severity:string,value:string>>"


def _issue(path: str, code: Column, severity: str, value: Column) -> Column:
    return F.struct(F.lit(path).alias("path"), code.alias("issue"), F.lit(severity).alias("severity"), value.alias("value"))


def _found(rule: dict) -> Column:
    """Array of the issues of one rule, null if there are none."""
    path, own, usage = rule["path"], values(rule["path"]), rule.get("usage")
    if usage == "required":
        return F.when(F.size(own) == 0, F.array(_issue(path, F.lit("MISSING_REQUIRED"), "error", F.lit(None).cast("string"))))
    if usage == "not_used":
        return F.when(F.size(own) > 0, F.array(_issue(path, F.lit("ELEMENT_NOT_USED"), "warning", F.get(own, F.lit(0)))))
    return F.filter(F.transform(own, lambda v: _issue(path, _broken(rule, v), rule.get("severity") or "error", v)), lambda x: x["issue"].isNotNull())


def issues(guide: dict) -> Column:
    """Array of (path, issue, severity, value) for a transaction row: what its rules of usage, shape and codes find, where their condition holds."""
    empty = F.array().cast(EMPTY)
    rules = [*guide.get("rules", []), *[{"type": "codes", **c} for c in guide.get("codes", [])]]
    return F.concat(empty, *[F.when(holds(r.get("condition")), F.coalesce(_found(r), empty)).otherwise(empty) for r in rules])


def detected(guides: list[dict], kind: str = "kind", receiver: str = "receiver", payer: str = "payer", reference: str = "reference") -> Column:
    """Name of the guide that fits best: 100 for its receiver, 50 for its payer, 20 for its base, 10 for its kind and 1 more for professional claims; null if none fits.

    A guide that names a receiver or payer fits no other one's transactions. Of equal ones the first holds.
    """
    def score(g: dict) -> Column:
        tests = [("receiver", receiver, 100), ("payer", payer, 50), ("base", reference, 20), ("kind", kind, 10)]
        out, fits = F.lit(0), F.lit(True)
        for name, column, points in tests:
            if g.get(name):
                same = F.coalesce(F.col(column) == g[name], F.lit(False))
                out = out + F.when(same, points).otherwise(0)
                fits = fits & (same if name in ("receiver", "payer") else F.lit(True))
        out = out + F.when((F.lit(g.get("kind") == "837P")) & (F.col(kind) == "837P"), 1).otherwise(0)
        return F.when(fits, out).otherwise(0)

    best = F.array_max(F.array(*[F.struct(score(g).alias("score"), F.lit(-k).alias("rank"), F.lit(g["name"]).alias("name")) for k, g in enumerate(guides)]))
    return F.when(best["score"] > 0, best["name"])


def checked(rows: DataFrame, guides: list[dict], key: str = "file") -> DataFrame:
    """(key, transaction, guide, path, issue, severity, value): a row for each issue of a transaction by the guide that fits it."""
    found = transactions(rows, key).withColumn("guide", detected(guides))
    own = F
    for g in guides:
        own = own.when(F.col("guide") == g["name"], issues(g))
    each = found.withColumn("issues", own.otherwise(F.lit(None))).select(key, "transaction", "guide", F.explode("issues").alias("x"))
    return each.select(key, "transaction", "guide", "x.*")
