"""Clinical documents in XML and FHIR resources in JSON."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

SECTIONS = "code string, title string, text string, entries array<struct<kind:string,template:string,code:string,display:string,system:string,value:string,unit:string,effective:string,status:string>>"
_LOINC = "2.16.840.1.113883.6.1"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _find(node, *names: str):
    for name in names:
        node = next((c for c in node if _local(c.tag) == name), None) if node is not None else None
    return node


def _value(node) -> tuple[str | None, str | None]:
    """Value and unit of an entry by its type: quantities, codes, intervals as low-high, else the text."""
    if node is None:
        return None, None
    kind = next((v for k, v in node.attrib.items() if _local(k) == "type"), "")
    if kind == "PQ":
        return node.get("value"), node.get("unit")
    if kind in ("CD", "CE", "CV"):
        return node.get("displayName") or node.get("code"), None
    if kind == "IVL_PQ":
        low, high = _find(node, "low"), _find(node, "high")
        a, b = (x.get("value") if x is not None else None for x in (low, high))
        return (f"{a}-{b}" if a and b else f">= {a}" if a else f"<= {b}" if b else None), (low if low is not None else high).get("unit") if a or b else None
    return node.get("value") or (node.text or "").strip() or None, None


def sections_of(xml: str | None) -> tuple[str | None, list[dict]]:
    """(error, sections) of a document; entries are all acts, observations, procedures and so on at any depth."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError as e:
        return f"INVALID_XML: {e}", []
    out = []
    for node in root.iter():
        if _local(node.tag) != "section":
            continue
        code, title, text = _find(node, "code"), _find(node, "title"), _find(node, "text")
        entries = []
        for entry in (c for c in node if _local(c.tag) == "entry"):
            for x in entry.iter():
                if _local(x.tag) in ("observation", "act", "procedure", "substanceAdministration", "encounter"):
                    c, when, template = _find(x, "code"), _find(x, "effectiveTime"), _find(x, "templateId")
                    value, unit = _value(_find(x, "value"))
                    at = when.get("value") if when is not None else None
                    if when is not None and not at and (low := _find(when, "low")) is not None:
                        at = low.get("value")
                    system = c.get("codeSystem") if c is not None else None
                    status = _find(x, "statusCode")
                    entries.append({"kind": _local(x.tag), "template": template.get("root") if template is not None else None, "code": c.get("code") if c is not None else None, "display": c.get("displayName") if c is not None else None, "system": "LOINC" if system == _LOINC else system, "value": value, "unit": unit, "effective": at, "status": status.get("code") if status is not None else None})
        out.append({"code": code.get("code") if code is not None else None, "title": "".join(title.itertext()).strip() if title is not None else None, "text": " ".join("".join(text.itertext()).split()) if text is not None else None, "entries": entries})
    return None, out


def cda_sections(docs: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """(key, error, section columns): a row for each section; documents that don't parse have one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch["xml_of_document"], strict=True):
                error, found = sections_of(text)
                rows += [{key: k, "error": None, **s} for s in found] or [{key: k, "error": error or "NO_SECTIONS", "code": None, "title": None, "text": None, "entries": []}]
            yield pd.DataFrame(rows, columns=[key, "error", "code", "title", "text", "entries"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(xml).alias("xml_of_document")).mapInPandas(run, f"{key} {kind}, error string, {SECTIONS}")


# Section codes and the events of their entries.
SECTION_EVENTS = {"30954-2": "lab_result", "8716-3": "vital_sign", "11450-4": "condition", "47519-4": "procedure", "11369-6": "immunization", "10160-0": "medication", "48765-2": "allergy", "29762-2": "social_history"}


def cda_events(sections: DataFrame, key: str) -> DataFrame:
    """Events of section entries: vital signs need a quantity, results a value."""
    kinds = F.create_map(*[F.lit(x) for kv in SECTION_EVENTS.items() for x in kv])
    rows = sections.withColumn("event_type", F.element_at(kinds, F.col("code"))).where("event_type IS NOT NULL").select(key, "event_type", F.explode("entries").alias("entry"))
    numeric = F.col("entry.value").try_cast("double")
    kept = ~((F.col("event_type") == "vital_sign") & numeric.isNull()) & ~((F.col("event_type") == "lab_result") & F.col("entry.value").isNull())
    return rows.where(kept & F.col("entry.code").isNotNull()).select(key, "event_type", "entry.code", "entry.display", "entry.system", "entry.value", numeric.alias("number"), "entry.unit", dates.cda_timestamp(F.col("entry.effective")).alias("at"), "entry.status")


def fhir_resources(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """docs with resource: the text's own resource, or each entry of a bundle."""
    kind = F.get_json_object(raw, "$.resourceType")
    entries = F.from_json(F.get_json_object(raw, "$.entry"), "array<struct<resource:string>>")
    each = F.when(kind == "Bundle", F.transform(entries, lambda e: e["resource"])).otherwise(F.array(raw))
    return docs.withColumn("resource", F.explode(each))


def fhir_events(resources: DataFrame, resource: str = "resource") -> DataFrame:
    """Event type and main fields of resources; kinds without an event are unknown."""
    def at(path: str) -> Column:
        return F.get_json_object(F.col(resource), f"$.{path}")

    kinds = {"Patient": "patient_update", "Observation": "lab_result", "Condition": "condition", "Encounter": "encounter", "Procedure": "procedure", "Immunization": "immunization"}
    kind = at("resourceType")
    event = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), kind), F.lit("unknown"))
    event = F.when((kind == "Observation") & at("category[0].coding[0].code").eqNullSafe("vital-signs"), "vital_sign").otherwise(event)
    code = F.coalesce(at("code.coding[0].code"), at("vaccineCode.coding[0].code"))
    flag = F.upper(F.coalesce(at("interpretation[0].coding[0].code"), F.lit("")))
    return resources.withColumns({
        "resource_type": kind, "event_type": event, "id": at("id"), "code": code, "display": F.coalesce(at("code.coding[0].display"), at("vaccineCode.coding[0].display")), "value": F.coalesce(at("valueQuantity.value"), at("valueString"), at("valueCodeableConcept.text")),
        "unit": at("valueQuantity.unit"), "subject": F.regexp_extract(F.coalesce(at("subject.reference"), at("patient.reference"), F.lit("")), "([^/]*)$", 1), "family": at("name[0].family"), "given": at("name[0].given[0]"), "birth_date": at("birthDate").try_cast("date"), "gender": at("gender"),
        "is_critical": flag.isin("CRITICAL", "HH", "LL", "AA", "A"),
    })


