"""Workflows: routes with filters, transforms and actions, compiled so that one scan evaluates all routes."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import cel

#: Action types that exist without registration.
ACTION_TYPES = ["log", "webhook", "fhir", "email", "exec", "file", "database", "queue", "event_store", "athena"]


@dataclass
class Route:
    name: str
    event_types: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    condition: str = ""
    transforms: list[dict] = field(default_factory=list)
    actions: list[dict] = field(default_factory=list)


@dataclass
class Workflow:
    name: str
    version: str
    routes: list[Route]


def _listed(value: object) -> list[str]:
    return [] if value in (None, "") else [str(x) for x in value] if isinstance(value, list) else [str(value)]


def load(text_or_dict: str | dict) -> Workflow:
    """A workflow from its mapping, JSON, or YAML where a YAML reader is installed."""
    data = text_or_dict
    if isinstance(data, str):
        try:
            data = json.loads(data)
        except ValueError:
            import yaml

            data = yaml.safe_load(data)
    data = data.get("workflow", data)
    routes = []
    for r in data.get("routes") or []:
        f = r.get("filter") or {}
        routes.append(Route(r.get("name") or "", _listed(f.get("event_type")), _listed(f.get("source")), f.get("condition") or "", r.get("transform") or [], r.get("actions") or []))
    return Workflow(data.get("name") or "", str(data.get("version") or ""), routes)


def lint(workflow: Workflow, known_actions: list[str] | None = None) -> list[tuple[str, str, str]]:
    """(severity, code, where) of everything that is wrong or doubtful."""
    out, seen = [], set()
    known = set(known_actions or []) | set(ACTION_TYPES)

    def say(severity: str, code: str, where: str) -> None:
        out.append((severity, code, where))

    if not workflow.name:
        say("error", "MISSING_NAME", "workflow")
    elif not all(c.isalnum() or c in "-_" for c in workflow.name):
        say("warning", "INVALID_NAME_CHARS", "workflow")
    if not workflow.version:
        say("warning", "MISSING_VERSION", "workflow")
    for k, r in enumerate(workflow.routes):
        where = r.name or f"routes[{k}]"
        if not r.name:
            say("error", "MISSING_ROUTE_NAME", where)
        elif r.name in seen:
            say("error", "DUPLICATE_ROUTE_NAME", where)
        seen.add(r.name)
        if not r.actions:
            say("error", "NO_ACTIONS", where)
        if not (r.event_types or r.sources or r.condition):
            say("warning", "NO_FILTER", where)
        if r.condition:
            try:
                cel.to_column(cel.parse(r.condition), lambda _: F.lit(None).cast("string"), "bool") if _has_session() else cel.parse(r.condition)
            except cel.CelError:
                say("error", "INVALID_CEL", where)
        for t in r.transforms:
            kinds = [x for x in ("set_field", "map_terminology", "redact", "explain_warnings") if x in t]
            if not kinds:
                say("error", "EMPTY_TRANSFORM", where)
            if len(kinds) > 1:
                say("warning", "MULTIPLE_TRANSFORMS", where)
            if "set_field" in t and len(str(t["set_field"]).split("=", 1)) != 2:
                say("error", "INVALID_SET_FIELD", where)
            if "map_terminology" in t and not (t["map_terminology"] or {}).get("field"):
                say("error", "MISSING_TERMINOLOGY_FIELD", where)
            if "redact" in t and not _listed((t["redact"] or {}).get("fields") if isinstance(t["redact"], dict) else t["redact"]):
                say("error", "MISSING_REDACT_FIELDS", where)
        for a in r.actions:
            if not a.get("type"):
                say("error", "MISSING_ACTION_TYPE", where)
            elif a["type"] not in known:
                say("warning", "UNKNOWN_ACTION_TYPE", where)
    return out


def _has_session() -> bool:
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() is not None


def matches(route: Route, columns: list[str], payload: str = "data") -> Column:
    """True where the route takes the event; an empty list of types or sources takes all, a condition that can't be evaluated none."""
    out = F.lit(True)
    if route.event_types:
        out = out & F.coalesce(F.col("event_type").isin(route.event_types), F.lit(False))
    if route.sources:
        out = out & F.coalesce(F.col("source").isin(route.sources), F.lit(False))
    if route.condition:
        out = out & cel.compile_condition(route.condition, cel.event_scope(columns, payload))
    return out


def plan(events: DataFrame, workflow: Workflow, payload: str = "data") -> DataFrame:
    """events with ``plan``: for each route whether it matches, how many transforms it would make, its actions, and INVALID_CEL if it doesn't compile."""
    steps = []
    for r in workflow.routes:
        try:
            matched, diagnostic = matches(r, events.columns, payload), F.lit(None).cast("string")
        except cel.CelError:
            matched, diagnostic = F.lit(False), F.lit("INVALID_CEL")
        actions = F.array(*[F.lit(str(a.get("type") or "")) for a in r.actions]).cast("array<string>")
        steps.append(F.struct(F.lit(r.name).alias("route"), matched.alias("matched"), F.lit(len(r.transforms)).alias("transforms"), actions.alias("actions"), diagnostic.alias("diagnostic")))
    return events.withColumn("plan", F.array(*steps))


def matched_routes(events: DataFrame, workflow: Workflow, payload: str = "data") -> DataFrame:
    """One row for each event and route that matches, from a single scan: the dry run."""
    planned = plan(events, workflow, payload).withColumn("step", F.explode(F.filter("plan", lambda s: s["matched"])))
    return planned.select(*events.columns, F.col("step.route").alias("route"), F.col("step.actions").alias("actions"))


def literal(text: str) -> object:
    """Constants of set_field: booleans, null, numbers, quoted or bare strings."""
    text = text.strip()
    if text in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[text]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def _edit(data: str | None, change: Callable[[dict], None]) -> str | None:
    try:
        value = json.loads(data) if data else {}
    except ValueError:
        return data
    if not isinstance(value, dict):
        return data
    change(value)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _set(value: dict, path: list[str], to: object) -> None:
    for name in path[:-1]:
        value = value.setdefault(name, {})
        if not isinstance(value, dict):
            return  # a scalar has no fields: the event goes on as it is
    value[path[-1]] = to


def _drop(value: object, path: list[str]) -> None:
    for name in path[:-1]:
        value = value.get(name) if isinstance(value, dict) else None
    if isinstance(value, dict):
        value.pop(path[-1], None)


Step = tuple[str, list[str], object]


def _assigned(assignment: str) -> Step:
    target, _, constant = assignment.partition("=")
    return "set", target.strip().removeprefix("event.").split("."), literal(constant)


def _dropped(paths: list[str]) -> list[Step]:
    return [("drop", p.removeprefix("event.").split("."), None) for p in paths]


def edited(payload: Column, steps: list[Step]) -> Column:
    """The JSON payload after all steps, read and written once; absent payloads become an object, other texts stay as they are."""

    def change(value: dict) -> None:
        for kind, path, to in steps:
            _set(value, path, to) if kind == "set" else _drop(value, path)

    @F.pandas_udf(StringType())
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: _edit(x, change))

    return run(payload)


def set_field(payload: Column, assignment: str) -> Column:
    """The JSON payload with a constant at a path; objects on the way are made. Absent payloads become an object."""
    return edited(payload, [_assigned(assignment)])


def redact(payload: Column, paths: list[str]) -> Column:
    """The JSON payload without what stands at the paths; absent paths don't matter."""
    return edited(payload, _dropped(paths))


@F.pandas_udf(StringType())
def _put(data: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
    """value is a JSON text; rows without one keep their payload."""
    return pd.Series([d if v is None else _edit(d, lambda x, p=p, v=v: _set(x, p.split("."), json.loads(v))) for d, p, v in zip(data, path, value, strict=True)], dtype=object)


def map_terminology(events: DataFrame, mapping: DataFrame, code: str, system: str, to_system: str) -> DataFrame:
    """events with mapped_code and mapped_display of the first mapping by target code; the code itself where there is none."""
    wanted = mapping.where((F.upper("source_system") == system.upper()) & (F.upper("target_system") == to_system.upper()))
    best = wanted.groupBy(F.upper("source_code").alias("key_of_mapping")).agg(F.min(F.struct("target_code", "target_display")).alias("best_of_mapping"))
    out = events.join(best, F.upper(F.col(code)) == F.col("key_of_mapping"), "left")
    return out.withColumns({"mapped_code": F.coalesce("best_of_mapping.target_code", code), "mapped_display": F.col("best_of_mapping.target_display")}).drop("key_of_mapping", "best_of_mapping")


def map_field(events: DataFrame, field: str, mapping: DataFrame, system: str, to_system: str, payload: str = "data") -> DataFrame:
    """The code at a path of the payload replaced by the first mapping's target code, with its display beside it under <field>_display.

    Payloads without the field, fields that aren't texts, and codes without a mapping stay as they are.
    """
    path = field.removeprefix("event.")
    code = F.get_json_object(payload, cel.json_path(path.split(".")))
    aside = events.withColumn("code_of_route", code)
    found = map_terminology(aside, mapping, "code_of_route", system, to_system)
    hit = F.col("mapped_display").isNotNull() | (F.col("mapped_code") != F.col("code_of_route"))

    def quoted(c: Column) -> Column:
        """A text as JSON: what stands between the brackets of a list of it."""
        listed = F.to_json(F.array(c))
        return F.substr(listed, F.lit(2), F.length(listed) - 2)

    first = _put(F.col(payload), F.lit(path), F.when(hit, quoted(F.col("mapped_code"))))
    second = _put(F.col(payload), F.lit(f"{path}_display"), F.when(hit & (F.col("mapped_display") != ""), quoted(F.col("mapped_display"))))
    return found.withColumn(payload, first).withColumn(payload, second).drop("code_of_route", "mapped_code", "mapped_display")


# Explanations of common warnings: what it means, how to mend it, what it does if it is left.
WARNINGS = {
    "INVALID_NPI": ("The provider number isn't ten digits with a right check digit.", "Look the provider up in the registry and correct the source.", "Claims with this number may be rejected."),
    "INVALID_MBI": ("The beneficiary number doesn't have the required pattern of letters and digits.", "Compare it with the card; look for typing errors.", "Medicare claims may be rejected."),
    "INVALID_SSN": ("The social security number isn't one that is issued.", "Check it at the source, or leave it out.", "Matching by this number may fail."),
    "MISSING_PV1": ("The message has no visit segment.", "Ask the sender for PV1, or allow its absence for this type.", "The event has no class, location or doctor."),
    "MISSING_PID": ("The message has no patient segment.", "Ask the sender for PID.", "The message can't be taken."),
    "EMPTY_MRN": ("The record number is empty.", "Look at PID-3 and at the sender's settings.", "The patient may be entered twice."),
    "INVALID_DATE": ("A date can't be read.", "Send dates as YYYYMMDD.", "The date is left out."),
    "UNKNOWN_MESSAGE_TYPE": ("The message type isn't known here.", "Check MSH-9, or add the type to the profile.", "The message may not be routed."),
    "SEGMENT_TRUNCATED": ("A segment seems to be cut off.", "Check the sender's length limits.", "What stood behind the cut is lost."),
    "DUPLICATE_IDENTIFIER": ("One kind of identifier came more than once.", "Find out which of them holds.", "Matching may go wrong."),
    "CODE_NOT_MAPPED": ("A local code has no standard code.", "Add a mapping for it.", "The standard code is empty."),
}


def explain_warnings(payload: Column, field: str = "warnings", include_fix: bool = True) -> Column:
    """The JSON payload with an explanation, an impact and, if wanted, a fix on each warning object whose code is known; others stay as they are."""
    path = field.removeprefix("event.").split(".")

    def change(value: dict) -> None:
        for name in path[:-1]:
            value = value.get(name) if isinstance(value, dict) else None
        items = value.get(path[-1]) if isinstance(value, dict) else None
        for w in items if isinstance(items, list) else []:
            if isinstance(w, dict) and w.get("code") in WARNINGS:
                meaning, fix, impact = WARNINGS[w["code"]]
                w |= {"explanation": meaning, **({"fix_suggestion": fix} if include_fix else {}), "impact": impact}

    @F.pandas_udf(StringType())
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: _edit(x, change) if x else x)

    return run(payload)


def transformed(events: DataFrame, route: Route, payload: str = "data", mapping: DataFrame | None = None) -> DataFrame:
    """events with the route's transforms of the payload, in order; neighbouring edits are one pass. map_terminology needs a mapping table.

    A transform of another kind is an error, as is one that lacks what it needs.
    """
    steps: list[Step] = []

    def flush(rows: DataFrame) -> DataFrame:
        out = rows.withColumn(payload, edited(F.col(payload), list(steps))) if steps else rows
        steps.clear()
        return out

    for t in route.transforms:
        if "set_field" in t:
            steps.append(_assigned(str(t["set_field"])))
        elif "redact" in t:
            steps += _dropped(_listed(t["redact"].get("fields") if isinstance(t["redact"], dict) else t["redact"]))
        elif "map_terminology" in t:
            if mapping is None:
                raise ValueError(f"route {route.name}: map_terminology needs a mapping table")
            own = t["map_terminology"]
            events = map_field(flush(events), own["field"], mapping, own["from"], own["to"], payload)
        elif "explain_warnings" in t:
            own = t["explain_warnings"] or {}
            events = flush(events)
            events = events.withColumn(payload, explain_warnings(F.col(payload), own.get("warnings_field") or "warnings", bool(own.get("include_fix"))))
        else:
            raise ValueError(f"route {route.name}: unknown transform {', '.join(map(str, t)) or '(empty)'}")
    return flush(events)


def template(text: str, columns: list[str], payload: str = "data") -> Column:
    """{{.a.b}} placeholders filled from the event, <no value> where there is nothing."""
    scope, parts, at = cel.event_scope(columns, payload), [], 0
    while (start := text.find("{{", at)) >= 0 and (end := text.find("}}", start)) >= 0:
        path = text[start + 2 : end].strip().lstrip(".").split(".")
        parts += [F.lit(text[at:start]), F.coalesce(scope(["event", *path]).cast("string"), F.lit("<no value>"))]
        at = end + 2
    return F.concat(*parts, F.lit(text[at:]))


def run(events: DataFrame, workflow: Workflow, handlers: dict[str, Callable[[DataFrame, dict], None]], payload: str = "data", mapping: DataFrame | None = None) -> list[tuple[str, str, str]]:
    """Carries out each route's actions on its transformed events; (route, action, error) of those that failed, while the others go on."""
    failed = []
    for r in workflow.routes:
        taken = transformed(events.where(matches(r, events.columns, payload)), r, payload, mapping)
        for a in r.actions:
            try:
                handlers[a["type"]](taken, a)
            except Exception as e:  # an action's failure never stops the others
                failed.append((r.name, str(a.get("type")), f"{type(e).__name__}: {e}"[:300]))
    return failed


# Failure classes and the texts that tell them, in order of trial.
ERROR_CLASSES = [("timeout", ["timeout", "deadline exceeded"]), ("connection", ["connection", "dial", "no such host"]), ("auth", ["401", "403", "unauthorized", "forbidden"]), ("server_error", ["500", "502", "503", "504"]), ("client_error", ["400", "404", "422"])]


def error_class(message: Column) -> Column:
    out = F
    text = F.lower(message)
    for name, marks in ERROR_CLASSES:
        test = F.lit(False)
        for m in marks:
            test = test | F.contains(text, F.lit(m))
        out = out.when(test, name)
    return out.otherwise("unknown")


def split_failed(results: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(delivered, dead letters with their class): a dead letter is a row with an error text."""
    bad = F.col(error).isNotNull() & (F.col(error) != "")
    return results.where(~bad), results.where(bad).withColumn("error_class", error_class(F.col(error)))


def replay_diff(recorded: DataFrame, replayed: DataFrame, key: str) -> DataFrame:
    """(key, added, removed, changed): route sets (array column routes) of both runs, by event."""
    a = recorded.select(key, F.col("routes").alias("before"))
    b = replayed.select(key, F.col("routes").alias("after"))
    empty = F.array().cast("array<string>")
    both = a.join(b, key, "full_outer").select(key, F.coalesce("before", empty).alias("before"), F.coalesce("after", empty).alias("after"))
    added, removed = F.array_sort(F.array_except("after", "before")), F.array_sort(F.array_except("before", "after"))
    return both.select(key, added.alias("added"), removed.alias("removed"), ((F.size(added) + F.size(removed)) > 0).alias("changed"))
