"""FHIR R4 resources from event columns, as structs and JSON, with bundles and structural checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clinical, codelists, identifiers

# Profiles and code systems.
US_CORE = "http://hl7.org/fhir/us/core/StructureDefinition/us-core-"
SYSTEMS = {"LOINC": "http://loinc.org", "SNOMED": "http://snomed.info/sct", "ICD-10-CM": "http://hl7.org/fhir/sid/icd-10-cm", "CPT": "http://www.ama-assn.org/go/cpt", "RXNORM": "http://www.nlm.nih.gov/research/umls/rxnorm", "NDC": "http://hl7.org/fhir/sid/ndc", "CVX": "http://hl7.org/fhir/sid/cvx", "UCUM": "http://unitsofmeasure.org"}
ENCOUNTER_CLASSES = {"I": "IMP", "O": "AMB", "E": "EMER", "P": "PRENC"}


def _profile(name: str) -> Column:
    return F.struct(F.array(F.lit(US_CORE + name)).alias("profile")).alias("meta")


def system(name: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SYSTEMS.items() for x in kv]), F.upper(name)), name)


def concept(code: Column, display: Column, code_system: Column) -> Column:
    coding = F.when(code.isNotNull(), F.array(F.struct(system(code_system).alias("system"), code.alias("code"), display.alias("display"))))
    return F.struct(coding.alias("coding"), F.coalesce(display, code).alias("text"))


def reference(kind: str, key: Column) -> Column:
    return F.when(key.isNotNull(), F.struct(F.concat(F.lit(f"{kind}/"), key.cast("string")).alias("reference")))


def date_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def time_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def patient(key: Column, mrn: Column, family: Column, given: Column, gender: Column, birth_date: Column, phone: Column | None = None, zip_code: Column | None = None, assigner: Column | None = None) -> Column:
    """Patient with its record number, name, and where given phone and address."""
    number = F.struct(F.struct(F.array(F.struct(F.lit("http://terminology.hl7.org/CodeSystem/v2-0203").alias("system"), F.lit("MR").alias("code"))).alias("coding")).alias("type"), (assigner if assigner is not None else F.lit("urn:mrn")).alias("system"), mrn.alias("value"))
    parts = [F.lit("Patient").alias("resourceType"), key.cast("string").alias("id"), _profile("patient"), F.when(mrn.isNotNull(), F.array(number)).alias("identifier"), F.array(F.struct(family.alias("family"), F.when(given.isNotNull(), F.array(given)).alias("given"))).alias("name"), identifiers.fhir_gender(F.coalesce(gender, F.lit(""))).alias("gender"), date_text(birth_date).alias("birthDate")]
    if phone is not None:
        parts.append(F.when(phone.isNotNull(), F.array(F.struct(F.lit("phone").alias("system"), phone.alias("value")))).alias("telecom"))
    if zip_code is not None:
        parts.append(F.when(zip_code.isNotNull(), F.array(F.struct(zip_code.alias("postalCode")))).alias("address"))
    return F.struct(*parts)


def encounter(key: Column, patient_key: Column, class_code: Column, start: Column, end: Column) -> Column:
    known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ENCOUNTER_CLASSES.items() for x in kv]), F.upper(class_code)), F.lit("AMB"))
    return F.struct(F.lit("Encounter").alias("resourceType"), key.cast("string").alias("id"), _profile("encounter"), F.when(end.isNotNull(), "finished").otherwise("in-progress").alias("status"), F.struct(F.lit("http://terminology.hl7.org/CodeSystem/v3-ActCode").alias("system"), known.alias("code")).alias("class"), reference("Patient", patient_key).alias("subject"), F.struct(time_text(start).alias("start"), time_text(end).alias("end")).alias("period"))


# Abnormal flags and the interpretation that they mean.
INTERPRETATIONS = {"H": "High", "L": "Low", "HH": "Critical high", "LL": "Critical low", "N": "Normal", "A": "Abnormal", "AA": "Critical abnormal"}
STATUSES = {"F": "final", "P": "preliminary", "C": "corrected", "X": "cancelled"}


def observation(key: Column, patient_key: Column, code: Column, display: Column, code_system: Column, value: Column, unit: Column, flag: Column, status: Column, at: Column, category: str = "laboratory") -> Column:
    """Observation with a quantity where the value is a number, else a string."""
    number = value.try_cast("double")
    meaning = F.element_at(F.create_map(*[F.lit(x) for kv in INTERPRETATIONS.items() for x in kv]), F.upper(flag))
    profile = "observation-lab" if category == "laboratory" else "vital-signs"
    return F.struct(
        F.lit("Observation").alias("resourceType"), key.cast("string").alias("id"), _profile(profile), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv]), F.upper(status)), F.lit("final")).alias("status"),
        F.array(F.struct(F.array(F.struct(F.lit("http://terminology.hl7.org/CodeSystem/observation-category").alias("system"), F.lit(category).alias("code"))).alias("coding"))).alias("category"), concept(code, display, code_system).alias("code"), reference("Patient", patient_key).alias("subject"),
        time_text(at).alias("effectiveDateTime"), F.when(number.isNotNull(), F.struct(number.alias("value"), unit.alias("unit"), F.when(unit.isNotNull(), F.lit(SYSTEMS["UCUM"])).alias("system"), unit.alias("code"))).alias("valueQuantity"), F.when(number.isNull(), value).alias("valueString"),
        F.when(meaning.isNotNull(), F.array(F.struct(F.array(F.struct(F.upper(flag).alias("code"), meaning.alias("display"))).alias("coding")))).alias("interpretation"),
    )


def condition(key: Column, patient_key: Column, code: Column, display: Column, code_system: Column, onset: Column, status: Column) -> Column:
    clinical = F.when(F.lower(status).isin("active", "inactive", "resolved", "recurrence", "remission"), F.lower(status)).otherwise("active")
    return F.struct(F.lit("Condition").alias("resourceType"), key.cast("string").alias("id"), _profile("condition-problems-health-concerns"), F.struct(F.array(F.struct(F.lit("http://terminology.hl7.org/CodeSystem/condition-clinical").alias("system"), clinical.alias("code"))).alias("coding")).alias("clinicalStatus"), concept(code, display, code_system).alias("code"), reference("Patient", patient_key).alias("subject"), date_text(onset).alias("onsetDateTime"))


def simple(kind: str, profile: str, key: Column, patient_key: Column, code: Column, display: Column, code_system: Column, at: Column, status: str, code_field: str = "code", subject: str = "subject", when: str = "performedDateTime") -> Column:
    """Resources of the common shape: status, coded subject matter, patient, time. Procedures, immunisations, orders, allergies and plans are such."""
    return F.struct(F.lit(kind).alias("resourceType"), key.cast("string").alias("id"), _profile(profile), F.lit(status).alias("status"), concept(code, display, code_system).alias(code_field), reference("Patient", patient_key).alias(subject), time_text(at).alias(when))


def procedure(*a: Column) -> Column:
    return simple("Procedure", "procedure", *a, "completed")


def immunization(*a: Column) -> Column:
    return simple("Immunization", "immunization", *a, "completed", "vaccineCode", "patient", "occurrenceDateTime")


def _status_concept(kind: str, code: Column) -> Column:
    return F.struct(F.array(F.struct(F.lit(f"http://terminology.hl7.org/CodeSystem/{kind}").alias("system"), code.alias("code"))).alias("coding"))


def medication_request(
    key: Column, patient_key: Column, code: Column, display: Column, code_system: Column, at: Column,
    status: Column | None = None, intent: Column | None = None, dose: Column | None = None, unit: Column | None = None, route: Column | None = None, frequency: Column | None = None,
    quantity: Column | None = None, refills: Column | None = None,
) -> Column:
    """MedicationRequest with its dosage (text, timing, route, dose) and what is to be dispensed; unknown statuses are unknown, unknown intents orders."""
    none = F.lit(None).cast("string")
    dose, unit, route, frequency = (none if x is None else x for x in (dose, unit, route, frequency))
    sig = F.nullif(F.concat_ws(" ", dose, unit, route, frequency), F.lit(""))
    way = clinical.known(clinical.ROUTES, F.lower(F.trim(route)))
    amount = clinical.dose_quantity(dose, unit)
    dosage = F.struct(
        sig.alias("text"), clinical.timing(frequency).alias("timing"), F.when(route.isNotNull(), F.struct(F.when(way.isNotNull(), F.array(F.struct(F.lit(SYSTEMS["SNOMED"]).alias("system"), way.alias("code")))).alias("coding"), route.alias("text"))).alias("route"),
        F.when(amount.isNotNull(), F.array(F.struct(amount.alias("doseQuantity")))).alias("doseAndRate"),
    )
    number = F.lit(None).cast("int") if refills is None else refills.cast("int")
    supply = F.lit(None).cast("double") if quantity is None else quantity.cast("double")
    dispense = F.when(number.isNotNull() | supply.isNotNull(), F.struct(number.alias("numberOfRepeatsAllowed"), F.when(supply.isNotNull(), F.struct(supply.alias("value"))).alias("quantity")))
    return _member(
        "MedicationRequest", "medicationrequest", key, status=F.lit("active") if status is None else clinical.one_of(F.coalesce(status, F.lit("active")), clinical.ORDER_STATUSES, "unknown"),
        intent=F.lit("order") if intent is None else clinical.one_of(F.coalesce(intent, F.lit("order")), clinical.ORDER_INTENTS, "order"), medicationCodeableConcept=concept(code, display, code_system),
        subject=reference("Patient", patient_key), authoredOn=time_text(at), dosageInstruction=F.when(sig.isNotNull(), F.array(dosage)), dispenseRequest=dispense,
    )


def allergy(key: Column, patient_key: Column, code: Column, display: Column, code_system: Column, at: Column, clinical_status: Column | None = None, criticality: Column | None = None, reactions: Column | None = None) -> Column:
    """AllergyIntolerance; reactions: array of structs of manifestation and severity."""
    state = clinical.one_of(F.coalesce(clinical_status, F.lit("active")), ["active", "inactive", "resolved"], "active") if clinical_status is not None else F.lit("active")
    own = F.lit(None).cast("array<struct<manifestation:array<struct<text:string>>,severity:string>>")
    if reactions is not None:
        own = F.transform(reactions, lambda r: F.struct(F.array(F.struct(r["manifestation"].alias("text"))).alias("manifestation"), F.when(F.lower(r["severity"]).isin("mild", "moderate", "severe"), F.lower(r["severity"])).alias("severity")))
    risk = F.lit(None).cast("string") if criticality is None else F.when(F.lower(criticality).isin("low", "high", "unable-to-assess"), F.lower(criticality))
    return _member("AllergyIntolerance", "allergyintolerance", key, clinicalStatus=_status_concept("allergyintolerance-clinical", state), verificationStatus=_status_concept("allergyintolerance-verification", F.lit("confirmed")), criticality=risk, code=concept(code, display, code_system), patient=reference("Patient", patient_key), recordedDate=time_text(at), reaction=own)


def service_request(key: Column, patient_key: Column, code: Column, display: Column, code_system: Column, at: Column) -> Column:
    return _member("ServiceRequest", "servicerequest", key, status=F.lit("active"), intent=F.lit("order"), code=concept(code, display, code_system), subject=reference("Patient", patient_key), authoredOn=time_text(at))


def document_reference(key: Column, patient_key: Column, code: Column, display: Column, code_system: Column, at: Column, text: Column | None = None) -> Column:
    """DocumentReference with its text as an attachment."""
    data = F.base64(F.encode(F.coalesce(text if text is not None else F.lit(""), F.lit("")), "UTF-8"))
    return _member("DocumentReference", "documentreference", key, status=F.lit("current"), type=concept(code, display, code_system), subject=reference("Patient", patient_key), date=time_text(at), content=F.array(F.struct(F.struct(F.lit("text/plain").alias("contentType"), data.alias("data")).alias("attachment"))))


def diagnostic_report(key: Column, patient_key: Column, code: Column, display: Column, code_system: Column, at: Column, results: Column | None = None) -> Column:
    """DiagnosticReport; results: array of keys of its observations."""
    own = F.lit(None).cast("array<struct<reference:string>>") if results is None else F.transform(results, lambda k: F.struct(F.concat(F.lit("Observation/"), k.cast("string")).alias("reference")))
    return _member("DiagnosticReport", "diagnosticreport-lab", key, status=F.lit("final"), category=F.array(F.struct(F.array(F.struct(F.lit("http://terminology.hl7.org/CodeSystem/v2-0074").alias("system"), F.lit("LAB").alias("code"))).alias("coding"))), code=concept(code, display, code_system), subject=reference("Patient", patient_key), effectiveDateTime=time_text(at), result=own)


def goal(key: Column, patient_key: Column, code: Column, display: Column, code_system: Column, start: Column) -> Column:
    return _member("Goal", "goal", key, lifecycleStatus=F.lit("active"), description=concept(code, display, code_system), subject=reference("Patient", patient_key), startDate=date_text(start))


def care_plan(key: Column, patient_key: Column, code: Column, display: Column, code_system: Column, at: Column) -> Column:
    return _member("CarePlan", "careplan", key, status=F.lit("active"), intent=F.lit("plan"), category=F.array(concept(code, display, code_system)), subject=reference("Patient", patient_key), created=time_text(at))


def vital_sign(key: Column, patient_key: Column, name: Column, value: Column, unit: Column, at: Column, code: Column | None = None) -> Column:
    """Observation of a vital sign; a code that isn't given is inferred from the name, units become unified codes."""
    found = clinical.vital_code(name)
    own = found if code is None else F.coalesce(code, found)
    return observation(key, patient_key, own, name, F.lit("LOINC"), value, clinical.vital_unit(unit), F.lit(None).cast("string"), F.lit("F"), at, "vital-signs")


def _member(kind: str, profile: str, key: Column, **fields: Column) -> Column:
    return F.struct(F.lit(kind).alias("resourceType"), key.cast("string").alias("id"), _profile(profile), *[v.alias(k) for k, v in fields.items()])


def _number(value: Column, number_system: str) -> Column:
    return F.when(value.isNotNull(), F.array(F.struct(F.lit(number_system).alias("system"), value.alias("value"))))


NPI = "http://hl7.org/fhir/sid/us-npi"


def organization(key: Column, name: Column, npi: Column) -> Column:
    return _member("Organization", "organization", key, identifier=_number(npi, NPI), active=F.lit(True), name=name)


def practitioner(key: Column, family: Column, given: Column, npi: Column) -> Column:
    return _member("Practitioner", "practitioner", key, identifier=_number(npi, NPI), name=F.array(F.struct(family.alias("family"), F.when(given.isNotNull(), F.array(given)).alias("given"))))


def practitioner_role(key: Column, practitioner_key: Column, organization_key: Column, code: Column, display: Column) -> Column:
    return _member("PractitionerRole", "practitionerrole", key, practitioner=reference("Practitioner", practitioner_key), organization=reference("Organization", organization_key), code=F.array(concept(code, display, F.lit("http://nucc.org/provider-taxonomy"))))


def location(key: Column, name: Column, organization_key: Column) -> Column:
    return _member("Location", "location", key, status=F.lit("active"), name=name, managingOrganization=reference("Organization", organization_key))


def related_person(key: Column, patient_key: Column, family: Column, given: Column, relation: Column) -> Column:
    return _member("RelatedPerson", "relatedperson", key, active=F.lit(True), patient=reference("Patient", patient_key), relationship=F.when(relation.isNotNull(), F.array(F.struct(relation.alias("text")))), name=F.array(F.struct(family.alias("family"), F.when(given.isNotNull(), F.array(given)).alias("given"))))


def care_team(key: Column, patient_key: Column, members: Column) -> Column:
    """members: array of structs of practitioner and role."""
    own = F.transform(members, lambda m: F.struct(F.array(F.struct(m["role"].alias("text"))).alias("role"), F.struct(F.concat(F.lit("Practitioner/"), m["practitioner"].cast("string")).alias("reference")).alias("member")))
    return _member("CareTeam", "careteam", key, status=F.lit("active"), subject=reference("Patient", patient_key), participant=own)


def provenance(key: Column, target: Column, recorded: Column, agent_key: Column) -> Column:
    """target: reference text such as Patient/1."""
    return _member("Provenance", "provenance", key, target=F.array(F.struct(target.alias("reference"))), recorded=time_text(recorded), agent=F.array(F.struct(reference("Organization", agent_key).alias("who"))))


def coverage(key: Column, patient_key: Column, payer: Column, member_id: Column, active: Column) -> Column:
    return _member("Coverage", "coverage", key, status=F.when(active, "active").otherwise("cancelled"), subscriberId=member_id, beneficiary=reference("Patient", patient_key), payor=F.array(F.struct(payer.alias("display"))))


def _money(x: Column) -> Column:
    return F.struct(x.alias("value"), F.lit("USD").alias("currency"))


CLAIM_TYPE = "http://terminology.hl7.org/CodeSystem/claim-type"


def _insurance(coverage_key: Column) -> Column:
    return F.array(F.struct(F.lit(1).alias("sequence"), F.lit(True).alias("focal"), F.struct(F.concat(F.lit("Coverage/"), coverage_key.cast("string")).alias("reference")).alias("coverage")))


def claim(key: Column, patient_key: Column, total: Column, created: Column, lines: Column, line: str = "number", procedure_code: str = "procedure", charge: str = "charge", provider: Column | None = None, diagnoses: Column | None = None) -> Column:
    """Claim with its items from an array of line structs, and its diagnoses from an array of codes; money is in dollars. The coverage has the patient's key."""
    items = F.transform(lines, lambda x: F.struct(x[line].alias("sequence"), F.struct(F.array(F.struct(F.lit(SYSTEMS["CPT"]).alias("system"), x[procedure_code].cast("string").alias("code"))).alias("coding")).alias("productOrService"), _money(x[charge]).alias("net")))
    coded = F.lit(None).cast("array<struct<sequence:int,diagnosisCodeableConcept:struct<coding:array<struct<system:string,code:string>>>>>")
    if diagnoses is not None:
        coded = F.transform(diagnoses, lambda d, k: F.struct((k + 1).alias("sequence"), F.struct(F.array(F.struct(F.lit(SYSTEMS["ICD-10-CM"]).alias("system"), d.alias("code"))).alias("coding")).alias("diagnosisCodeableConcept")))
    by = F.struct((provider if provider is not None else F.lit("unknown")).alias("display"))
    return F.struct(
        F.lit("Claim").alias("resourceType"), key.cast("string").alias("id"), F.lit("active").alias("status"), F.struct(F.array(F.struct(F.lit(CLAIM_TYPE).alias("system"), F.lit("professional").alias("code"))).alias("coding")).alias("type"), F.lit("claim").alias("use"),
        reference("Patient", patient_key).alias("patient"), time_text(created).alias("created"), by.alias("provider"), F.struct(F.array(F.struct(F.lit("normal").alias("code"))).alias("coding")).alias("priority"),
        coded.alias("diagnosis"), _insurance(patient_key).alias("insurance"), _money(total).alias("total"), items.alias("item"),
    )


def explanation(key: Column, claim_key: Column, patient_key: Column, submitted: Column, benefit: Column, patient_share: Column, created: Column | None = None, insurer: Column | None = None, provider: Column | None = None) -> Column:
    """Explanation of benefit: totals of what was submitted (if any), paid, and left to the patient."""

    def entry(code: str, amount: Column) -> Column:
        return F.struct(F.struct(F.array(F.struct(F.lit(code).alias("code"))).alias("coding")).alias("category"), _money(amount.cast("double")).alias("amount"))

    totals = F.array_compact(F.array(F.when(submitted > 0, entry("submitted", submitted)), entry("benefit", benefit), F.when(patient_share > 0, entry("deductible", patient_share))))
    named = lambda x: F.struct((x if x is not None else F.lit("unknown")).alias("display"))
    return F.struct(
        F.lit("ExplanationOfBenefit").alias("resourceType"), key.cast("string").alias("id"), F.lit("active").alias("status"), F.struct(F.array(F.struct(F.lit(CLAIM_TYPE).alias("system"), F.lit("professional").alias("code"))).alias("coding")).alias("type"),
        F.lit("claim").alias("use"), reference("Patient", patient_key).alias("patient"), time_text(created if created is not None else F.lit("1970-01-01").cast("timestamp")).alias("created"), named(insurer).alias("insurer"), named(provider).alias("provider"),
        F.lit("complete").alias("outcome"), reference("Claim", claim_key).alias("claim"), _insurance(patient_key).alias("insurance"), totals.alias("total"),
    )


def eligibility_response(key: Column, patient_key: Column, created: Column, insurer: Column, status: Column, benefits: Column) -> Column:
    """CoverageEligibilityResponse from a member's status and an array of benefit structs (service_type, info_code, amount, in_network)."""
    item = F.transform(benefits, lambda b: F.struct(
        F.struct(codelists.described(b["service_type"], "service").alias("text")).alias("category"), F.struct(F.array(F.struct(F.when(b["in_network"], "in").otherwise("out").alias("code"))).alias("coding")).alias("network"),
        F.array(F.struct(F.struct(codelists.described(b["info_code"], "benefit").alias("text")).alias("type"), F.when(b["amount"].isNotNull(), _money(b["amount"])).alias("allowedMoney"))).alias("benefit"),
    ))
    covered = F.array(F.struct(F.struct(F.concat(F.lit("Coverage/"), patient_key.cast("string")).alias("reference")).alias("coverage"), (status == "active").alias("inforce"), item.alias("item")))
    return F.struct(
        F.lit("CoverageEligibilityResponse").alias("resourceType"), key.cast("string").alias("id"), F.lit("active").alias("status"), F.array(F.lit("benefits")).alias("purpose"), reference("Patient", patient_key).alias("patient"), time_text(created).alias("created"),
        F.struct(F.concat(F.lit("CoverageEligibilityRequest/"), key.cast("string")).alias("reference")).alias("request"), F.when(status == "unknown", "error").otherwise("complete").alias("outcome"), F.struct(insurer.alias("display")).alias("insurer"), covered.alias("insurance"),
    )


def by_event(events: DataFrame) -> DataFrame:
    """events (event_type, control_id, patient, encounter, results) with resources: an array of JSON texts, and unsupported: why there is none.

    Admissions, discharges, transfers and registrations give a patient and an encounter, results a patient, an observation each and a report;
    any other event with a patient gives the patient alone.
    """
    p, e = F.col("patient"), F.col("encounter")
    who = to_json(patient(p["mrn"], p["mrn"], p["family"], p["given"], p["gender"], p["birth_date"], p["phone"], p["zip"]))
    visit = to_json(encounter(F.coalesce(e["id"], F.col("control_id")), p["mrn"], e["class"], e["admitted"], e["discharged"]))
    name = lambda k: F.concat_ws("-", F.col("control_id"), (k + 1).cast("string"))
    found = F.transform("results", lambda r, k: to_json(observation(name(k), p["mrn"], r["code"], r["name"], F.when(r["system"] == "LN", "LOINC").otherwise(r["system"]), r["value"], r["unit"], r["flag"], r["status"], r["observed"])))
    first = F.get("results", F.lit(0))
    report = to_json(diagnostic_report(F.col("control_id"), p["mrn"], first["code"], first["name"], F.when(first["system"] == "LN", "LOINC").otherwise(first["system"]), first["observed"], F.transform("results", lambda r, k: name(k))))
    kind = F.col("event_type")
    made = (
        F.when(kind == "lab_result", F.concat(F.array(who), found, F.array(report))).when(kind.isin("patient_admit", "patient_discharge", "patient_transfer", "patient_register") & e.isNotNull(), F.array(who, visit)).otherwise(F.array(who))
    )
    return events.withColumns({"resources": F.when(p.isNotNull(), made).otherwise(F.array().cast("array<string>")), "unsupported": F.when(p.isNull(), F.concat(F.lit("unsupported event type: "), F.coalesce(kind, F.lit(""))))})


def to_json(resource: Column) -> Column:
    """JSON without empty fields."""
    return F.to_json(resource, {"ignoreNullFields": "true"})


def bundles(resources: DataFrame, group: str, resource: str = "resource", kind: str = "transaction") -> DataFrame:
    """(group, bundle): JSON of one bundle for each group, entries in order of their JSON. Entries are a group's own resources, such as a patient's."""
    row = F.struct(F.concat(F.get_json_object(resource, "$.resourceType"), F.lit("/"), F.get_json_object(resource, "$.id")).alias("url"), F.col(resource).alias("json"))
    own = resources.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    request = lambda r: F.concat(F.lit('{"resource":'), r["json"], F.lit(',"request":{"method":"PUT","url":"'), r["url"], F.lit('"}}')) if kind == "transaction" else F.concat(F.lit('{"resource":'), r["json"], F.lit("}"))
    return own.select(group, F.concat(F.lit(f'{{"resourceType":"Bundle","type":"{kind}","entry":['), F.array_join(F.transform("rows", request), ","), F.lit("]}")).alias("bundle"))


# What a resource of a kind must have.
REQUIRED = {
    "Patient": ["identifier", "name", "gender"], "Encounter": ["status", "class", "subject"], "Observation": ["status", "code", "subject"], "Condition": ["code", "subject"], "Procedure": ["status", "code", "subject"],
    "Immunization": ["status", "vaccineCode", "patient"], "MedicationRequest": ["status", "intent", "medicationCodeableConcept", "subject"], "AllergyIntolerance": ["clinicalStatus", "code", "patient"],
    "ServiceRequest": ["status", "intent", "code", "subject"], "CarePlan": ["status", "intent", "category", "subject"], "Goal": ["lifecycleStatus", "description", "subject"], "CareTeam": ["status", "subject", "participant"],
    "DocumentReference": ["status", "type", "subject", "content"], "DiagnosticReport": ["status", "category", "code", "subject"], "Coverage": ["status", "beneficiary", "payor"],
    "Claim": ["status", "type", "use", "patient", "created", "provider", "priority", "insurance"], "ExplanationOfBenefit": ["status", "type", "use", "patient", "created", "insurer", "provider", "outcome", "insurance"],
    "CoverageEligibilityResponse": ["status", "purpose", "patient", "created", "request", "outcome", "insurer"], "Organization": ["active", "name"], "Practitioner": ["name"], "PractitionerRole": ["practitioner", "organization"],
    "Location": ["name"], "RelatedPerson": ["active", "patient"], "Provenance": ["target", "recorded", "agent"],
}
# Elements that a kind doesn't have, and elements that are lists.
FOREIGN = {"AllergyIntolerance": ["status"], "Goal": ["status"], "Condition": ["status"]}
LISTS = {"CarePlan": ["category"], "MedicationRequest": ["dosageInstruction"], "Claim": ["insurance"], "DocumentReference": ["content"]}


def _texts(entries: dict[str, list[str]], kind: Column) -> Column:
    """The list that a kind has in entries, empty for other kinds."""
    known = F.map_from_arrays(F.array(*[F.lit(k) for k in entries]), F.array(*[F.array(*[F.lit(f) for f in v]) for v in entries.values()]))
    return F.coalesce(F.element_at(known, kind), F.array().cast("array<string>"))


def issues(resource: Column) -> Column:
    """Array of issue texts: no type, unknown required fields missing, bad dates; empty for resources that pass."""
    return checked(resource)["issues"]


def checked(resource: Column) -> Column:
    """Struct of a resource's kind and issues.

    A resource is read once, into the texts of its members; a kind's fields are looked up there. Texts that aren't JSON objects have no type.
    """

    def found(m: Column) -> Column:
        kind, has = m["resourceType"], lambda f: F.element_at(m, f).isNotNull()

        def told(entries: dict[str, list[str]], wrong, what: str) -> Column:
            return F.transform(F.filter(_texts(entries, kind), wrong), lambda f: F.concat(F.lit(f"error:{what}:"), kind, F.lit("."), f))

        born = m["birthDate"]
        odd = F.when(born.isNotNull() & ~born.rlike("^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$"), F.array(F.lit("error:value:birthDate"))).otherwise(F.array().cast("array<string>"))
        listed = told(LISTS, lambda f: has(f) & ~F.startswith(F.element_at(m, f), F.lit("[")), "structure")
        own = F.concat(told(REQUIRED, lambda f: ~has(f), "required"), told(FOREIGN, has, "unknown"), listed, odd)
        return F.struct(kind.alias("kind"), F.when(kind.isNull(), F.concat(F.array(F.lit("error:structure:resourceType")), odd)).otherwise(own).alias("issues"))

    members = F.coalesce(F.from_json(resource, "map<string,string>", {"allowNonNumericNumbers": "false"}), F.create_map().cast("map<string,string>"))
    return F.element_at(F.transform(F.array(members), found), 1)  # a lambda's argument is computed once
