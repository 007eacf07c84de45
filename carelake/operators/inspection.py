"""Looking into messages and runs: payload shapes, field lineage, recordings, simulations, synthetic load, benchmark comparison, source profiles."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import workflow

SHAPE = ArrayType(StructType([StructField("path", StringType()), StructField("kind", StringType())]))
#: Fields whose values lineage never shows, and characters of others that it does.
HIDDEN = {"PID": [3, 5, 7, 11, 13, 19]}
PREVIEW = 80


def _walk(value: object, path: str, out: list, depth: int) -> None:
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
    out.append((path or "$", kind))
    if depth:
        for k, v in value.items() if isinstance(value, dict) else [("[]", v) for v in value[:1]] if isinstance(value, list) else []:
            _walk(v, f"{path}.{k}" if path else k, out, depth - 1)


def payload_shape(data: Column, depth: int = 6) -> Column:
    """Paths and kinds of a JSON text down to a depth, lists by their first item; values are never shown."""

    @F.pandas_udf(SHAPE)
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list:
            out: list = []
            try:
                _walk(json.loads(text), "", out, depth)
            except (TypeError, ValueError):
                return []
            return [{"path": p, "kind": k} for p, k in out]

        return texts.map(one)

    return run(data)


def lineage(messages: DataFrame, key: str) -> DataFrame:
    """(key, segment, field, preview) of all filled fields of parsed messages; identifying fields are masked."""
    segs = messages.select(key, F.posexplode("segments").alias("n", "fields"))
    each = segs.select(key, F.col("fields")[0].alias("segment"), F.posexplode("fields").alias("field", "value")).where("field > 0 AND value <> ''")
    hidden = F.lit(False)
    for name, fields in HIDDEN.items():
        hidden = hidden | ((F.col("segment") == name) & F.col("field").isin(fields))
    return each.select(key, "segment", F.col("field").cast("int").alias("field"), F.when(hidden, "***").otherwise(F.left("value", F.lit(PREVIEW))).alias("preview"))


def record(events: DataFrame, flow: workflow.Workflow, key: str = "position") -> DataFrame:
    """(key, routes) of a run, to keep and to compare a later run with."""
    return workflow.plan(events, flow).select(key, F.transform(F.filter("plan", lambda s: s["matched"]), lambda s: s["route"]).alias("routes"))


def simulate(events: DataFrame, flow: workflow.Workflow) -> DataFrame:
    """(route, action, invocations): what a run would call, without calling it."""
    rows = workflow.matched_routes(events, flow).select("route", F.explode("actions").alias("action"))
    return rows.groupBy("route", "action").agg(F.count("*").alias("invocations"))


def unmet(simulated: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (route, action, least, most) that a simulation doesn't meet, with what it made."""
    both = expected.join(simulated, ["route", "action"], "left").withColumn("invocations", F.coalesce("invocations", F.lit(0)))
    return both.where((F.col("invocations") < F.col("least")) | (F.col("invocations") > F.col("most")))


def load(spark: SparkSession, count: int, types: dict[str, float], seed: int = 1, sources: list[str] | None = None) -> DataFrame:
    """Synthetic events: types by their weights, sources in turn, times a second apart; the same for the same seed, whatever the partitions."""
    total, at, pick = sum(types.values()), 0.0, F
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    for name, weight in types.items():
        at += weight / total
        pick = pick.when(draw < at, name)
    names = sources or ["load"]
    return spark.range(count).select(
        F.col("id").alias("position"), F.concat(F.lit("patient:"), F.pmod(F.xxhash64("id"), F.lit(max(1, count // 10))).cast("string")).alias("stream_id"), pick.otherwise(next(reversed(types))).alias("event_type"),
        F.get(F.array(*[F.lit(s) for s in names]), (F.col("id") % len(names)).cast("int")).alias("source"), F.to_json(F.struct((F.col("id") % 100).alias("k"))).alias("data"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("ts"),
    )


def compare_runs(baseline: DataFrame, current: DataFrame, tolerance: float = 1.6) -> DataFrame:
    """(name, baseline, current, ratio, verdict) of benchmark results (name, value), by the best of each name."""
    a = baseline.groupBy("name").agg(F.min("value").alias("baseline"))
    b = current.groupBy("name").agg(F.min("value").alias("current"))
    ratio = F.try_divide(F.col("current"), F.col("baseline"))
    verdict = F.when(F.col("baseline").isNull(), "new").when(F.col("current").isNull(), "missing").when(ratio > tolerance, "slower").when(ratio < 1 / tolerance, "faster").otherwise("same")
    return a.join(b, "name", "full_outer").select("name", "baseline", "current", F.round(ratio, 6).alias("ratio"), verdict.alias("verdict"))


def source_profile(parsed: DataFrame) -> DataFrame:
    """One row for a source's parsed messages: how many, most common type and version, segments that not all have."""
    n = parsed.count()
    held = parsed.select(F.explode(F.array_distinct(F.transform("segments", lambda s: s[0]))).alias("segment")).groupBy("segment").agg(F.count("*").alias("present_in"))
    optional = held.where(F.col("present_in") < n).agg(F.array_sort(F.collect_list("segment")).alias("optional_segments"))
    main = parsed.agg(F.count("*").alias("messages"), F.mode("type", True).alias("type"), F.mode("version", True).alias("version"))
    return main.crossJoin(F.broadcast(optional))  # a row each
