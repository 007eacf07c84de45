"""Events from JSON text: lines, arrays, archives, recordings, and notifications of resource subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cel
from . import documents


def event_rows(inputs: DataFrame, raw: str = "raw") -> DataFrame:
    """inputs with data and error: each event of a text, which is an array of objects or has an object in each line.

    Blank lines are passed over; a text without events has an error, as has a line that isn't an object.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    listed = F.from_json(text, "array<string>")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.when(text.startswith("["), F.coalesce(listed, F.array(F.lit(None).cast("string")))).otherwise(lines)
    each = inputs.withColumn("data", F.explode_outer(F.when(F.size(parts) > 0, parts)))
    is_object = F.coalesce(F.typeof(F.try_parse_json("data")).isNotNull() & F.ltrim("data").startswith("{") & F.try_parse_json("data").isNotNull(), F.lit(False))
    return each.withColumns({"error": F.when(text == "", "EMPTY_INPUT").when(~is_object, "INVALID_JSON"), "data": F.when(is_object, F.col("data"))})


def envelope(rows: DataFrame, data: str = "data") -> DataFrame:
    """rows with event_type, source and ts from the payload's own fields."""
    at = lambda p: F.get_json_object(data, f"$.{p}")
    return rows.withColumns({"event_type": F.coalesce(at("type"), at("event_type")), "source": F.coalesce(at("source"), F.lit("")), "ts": F.try_to_timestamp(F.coalesce(at("timestamp"), at("ts")))})


def write_archive(log: DataFrame, folder: str) -> None:
    """The log as compressed JSON lines."""
    log.write.mode("append").json(folder, compression="gzip")


def read_archive(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def notifications(bundles: DataFrame, raw: str = "raw", criteria: str = "") -> DataFrame:
    """Events of subscription notifications: each resource of a bundle but its status, that meets the criteria (a condition over event)."""
    found = documents.fhir_events(documents.fhir_resources(bundles, raw)).where("resource_type NOT IN ('SubscriptionStatus', 'Parameters')")
    if not criteria:
        return found
    return found.where(cel.compile_condition(criteria, cel.event_scope(found.columns, "resource")))


def routed(events: DataFrame, routes: list[tuple[str, Column]], first_only: bool = False) -> DataFrame:
    """events with route: a row for each route (name, condition) that takes the event, or for the first of them; events that none takes are left out."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in routes]))
    return events.withColumn("route", F.explode(F.slice(hits, 1, 1) if first_only else hits))
