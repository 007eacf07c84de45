"""Delimited files: headers, column types from samples, patients and results from differing layouts, release files of terminologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, identifiers


def read(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """All columns as text under trimmed lower-case names; columns without a name are col_i."""
    raw = spark.read.option("sep", separator).option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).csv(path)
    return raw.toDF(*[n.strip().lower().replace(" ", "_") if n.strip() and not n.startswith("_c") else f"col_{k}" for k, n in enumerate(raw.columns)])


# Name parts that settle a column's type, and shapes of values in order of trial.
NAME_HINTS = [("date", ["date", "dob"]), ("datetime", ["time"])]
VALUE_SHAPES = [
    ("ssn", r"^[0-9]{3}-?[0-9]{2}-?[0-9]{4}$"), ("email", r"^[^@]+@[^@]+\.[^@]+$"), ("phone", r"^[0-9() \t.-]{7,}$"), ("mrn", r"^[A-Z]?[0-9]{6,10}$"), ("gender", r"^([MFOUmfou]|male|female|other|unknown)$"),
    ("code", r"^[A-Z][0-9]{2,4}(\.[0-9]+)?$"), ("date", r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$"), ("integer", r"^-?[0-9]+$"), ("float", r"^-?[0-9]+\.?[0-9]*$"),
]


def value_type(value: Column) -> Column:
    out = F
    for name, shape in VALUE_SHAPES:
        out = out.when(value.rlike(shape), name)
    return out.otherwise("string")


def infer_types(rows: DataFrame, sample: int = 10, order: str | None = None) -> DataFrame:
    """(column, type) from a sample of rows: a name's hint decides, else the type of most filled values if at least two and more than half agree.

    A sample is the operator's purpose here; order fixes which rows it takes.
    """
    names = [c for c in rows.columns if c != order]
    taken = (rows.orderBy(order) if order else rows).limit(sample).select([F.col(f"`{c}`").cast("string").alias(c) for c in names])
    long = taken.unpivot([], names, "column", "value").where("value IS NOT NULL AND trim(value) <> ''")
    votes = long.groupBy("column", value_type(F.trim("value")).alias("type")).agg(F.count("*").alias("n"))
    best = votes.groupBy("column").agg(F.sum("n").alias("total"), F.max_by("type", F.struct("n", "type")).alias("top"), F.max("n").alias("n"))
    hint = F
    for name, marks in NAME_HINTS:
        hint = hint.when(F.lower("column").rlike("|".join(marks)), name)
    agreed = F.when((F.col("n") >= 2) & (F.col("n") >= F.floor(F.col("total") / 2) + 1), F.col("top")).otherwise("string")
    return best.select("column", F.coalesce(hint, agreed).alias("type"))


def _either(columns: list[str], names: list[str]) -> Column:
    """The first filled value of the columns that are there."""
    found = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


# Names under which exports keep a patient's and a result's fields.
PATIENT_FIELDS = {
    "mrn": ["mrn", "medical_record_number", "patient_id", "patientid", "id"],
    "family": ["last_name", "family_name", "lastname", "surname"],
    "given": ["first_name", "given_name", "firstname", "forename"],
    "middle": ["middle_name", "middlename", "middle_initial"],
    "gender": ["gender", "sex"],
    "birth_date": ["dob", "date_of_birth", "birthdate", "birth_date"],
    "line": ["address", "address1", "street", "address_line_1"],
    "city": ["city"],
    "state": ["state", "province"],
    "zip": ["zip", "zipcode", "postal_code", "postcode"],
    "country": ["country"],
    "phone": ["phone", "phone_number", "telephone"],
    "email": ["email", "email_address"],
    "ssn": ["ssn", "social_security", "social_security_number"],
}
RESULT_FIELDS = {
    "mrn": ["mrn", "patient_id", "patientid"],
    "family": ["last_name", "patient_last_name"],
    "given": ["first_name", "patient_first_name"],
    "code": ["test_code", "code", "lab_code"],
    "name": ["test_name", "test_description", "description", "test"],
    "loinc": ["loinc", "loinc_code"],
    "value": ["result", "value", "result_value"],
    "unit": ["unit", "units", "uom"],
    "range": ["reference_range", "ref_range", "normal_range"],
    "flag": ["interpretation", "flag", "abnormal_flag"],
    "status": ["status", "result_status"],
    "observed": ["collection_date", "collected_date", "specimen_date", "date"],
}


def patients(rows: DataFrame) -> DataFrame:
    got = {k: _either(rows.columns, v) for k, v in PATIENT_FIELDS.items()}
    got |= {"birth_date": dates.csv_date(got["birth_date"]), "gender": identifiers.gender(F.coalesce(got["gender"], F.lit("")))}
    return rows.select(*[c.alias(k) for k, c in got.items()])


def results(rows: DataFrame) -> DataFrame:
    got = {k: _either(rows.columns, v) for k, v in RESULT_FIELDS.items()}
    got["observed"] = dates.csv_timestamp(got["observed"])
    return rows.select(*[c.alias(k) for k, c in got.items()], got["value"].try_cast("double").alias("number"))


# Columns of the release files.
MRCONSO = "cui lat ts lui stt sui ispref aui saui scui sdui sab tty code str srl suppress cvf".split()
MRREL = "cui1 aui1 stype1 rel cui2 aui2 stype2 rela rui srui sab sl rg dir suppress cvf".split()
MRSTY = "cui tui stn sty atui cvf".split()
RXNCONSO = "rxcui lat ts lui stt sui ispref rxaui saui scui sdui sab tty code str srl suppress cvf".split()
RXNREL = "rxcui1 rxaui1 stype1 rel rxcui2 rxaui2 stype2 rela rui srui sab sl dir rg suppress cvf".split()
RXNSAT = "rxcui lui sui rxaui stype code atui satui atn sab atv suppress cvf".split()


def read_rrf(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A release file: bars between fields and after the last one, no header and no quotes."""
    schema = ", ".join(f"`{c}` string" for c in [*columns, "after_last"])
    return spark.read.schema(schema).option("sep", "|").option("quote", "").option("mode", "PERMISSIVE").csv(path).drop("after_last")


def concepts(mrconso: DataFrame, sources: list[str] | None = None, english: bool = True, skip_suppressed: bool = True) -> DataFrame:
    out = mrconso
    if sources:
        out = out.where(F.col("sab").isin(sources))
    if english:
        out = out.where("lat = 'ENG'")
    if skip_suppressed:
        out = out.where("suppress = 'N'")
    return out.select("cui", F.col("sab").alias("source"), "code", F.col("str").alias("name"), F.col("ispref").alias("is_preferred"), "tty")


def restricted(rows: DataFrame, concept_rows: DataFrame, columns: list[str]) -> DataFrame:
    """Relations or types of loaded concepts only."""
    ids = concept_rows.select("cui").distinct()
    for c in columns:
        rows = rows.join(ids.withColumnRenamed("cui", c), c, "left_semi")
    return rows


def ndc_codes(rxnsat: DataFrame) -> DataFrame:
    from ..operators.terminology import ndc

    return rxnsat.where("atn = 'NDC'").select("rxcui", ndc(F.col("atv")).alias("ndc"))


def icd10(rows: DataFrame, headers: bool = False) -> DataFrame:
    """Codes without their dot, whether billable, and the category above; rows without code or text are left out, headers unless asked for."""
    billable = ~F.lower(F.coalesce("is_billable", F.lit("true"))).isin("false", "0", "no")
    out = rows.where("trim(coalesce(code, '')) <> '' AND trim(coalesce(description, '')) <> ''")
    out = out.select(F.replace(F.upper(F.trim("code")), F.lit("."), F.lit("")).alias("code"), "description", billable.alias("is_billable"), F.replace("category", F.lit("."), F.lit("")).alias("parent"))
    return out if headers else out.where("is_billable")


def drugs(rxnconso: DataFrame, release_id: int, skip_suppressed: bool = True) -> DataFrame:
    """(rxcui, tty, name, code, source, suppress, release_id) in English."""
    out = rxnconso.where("lat = 'ENG'")
    out = out.where("suppress = 'N'") if skip_suppressed else out
    return out.select("rxcui", "tty", F.col("str").alias("name"), "code", F.col("sab").alias("source"), "suppress", F.lit(release_id).alias("release_id"))


def drug_relations(rxnrel: DataFrame, release_id: int) -> DataFrame:
    """Relations between concepts; those between atoms are left out."""
    return rxnrel.where("coalesce(rxcui1, '') <> '' AND coalesce(rxcui2, '') <> ''").select("rxcui1", "rela", "rxcui2", F.lit(release_id).alias("release_id"))


# Columns of the laboratory code table and of its panel hierarchy, and the names that they get here.
LAB_COLUMNS = {"loinc_num": "code", "long_common_name": "name", "shortname": "short_name", "component": "component", "class": "class", "status": "status"}
PANEL_COLUMNS = {"parentloinc": "panel", "loinc": "member", "loincname": "name", "sequence": "sequence"}


def labs(rows: DataFrame, active_only: bool = True) -> DataFrame:
    """Laboratory codes of a table read with ``read``; deprecated ones are left out unless asked for."""
    out = rows.select(*[F.col(a).alias(b) for a, b in LAB_COLUMNS.items()])
    return out.where("status = 'ACTIVE'") if active_only else out


def panels(rows: DataFrame) -> DataFrame:
    out = rows.select(*[F.col(a).alias(b) for a, b in PANEL_COLUMNS.items()])
    return out.withColumn("sequence", F.col("sequence").try_cast("int"))
