"""Clinical values: doses, units, routes and timings, vital signs by name, race and ethnicity, statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of doses and of vital signs in the unified code.
DOSE_UNITS = {"mg": "mg", "g": "g", "mcg": "ug", "ml": "mL", "l": "L", "tablet": "{tbl}", "tablets": "{tbl}", "tab": "{tbl}", "capsule": "{cap}", "cap": "{cap}", "patch": "{patch}", "puff": "{puff}", "puffs": "{puff}", "drop": "{drop}", "drops": "{drop}", "unit": "[iU]", "units": "[iU]", "iu": "[iU]"}
VITAL_UNITS = {
    "°c": "Cel", "°f": "[degF]", "celsius": "Cel", "fahrenheit": "[degF]", "c": "Cel", "f": "[degF]", "bpm": "/min", "beats/min": "/min", "breaths/min": "/min", "/min": "/min", "cm": "cm", "in": "[in_i]", "inches": "[in_i]", "m": "m",
    "ft": "[ft_i]", "feet": "[ft_i]", "kg": "kg", "lb": "[lb_av]", "lbs": "[lb_av]", "pounds": "[lb_av]", "oz": "[oz_av]", "g": "g", "mmhg": "mm[Hg]", "mm hg": "mm[Hg]", "%": "%", "percent": "%", "kg/m2": "kg/m2", "kg/m^2": "kg/m2",
}
# Routes of administration by name.
ROUTES = {
    "oral": "26643006", "po": "26643006", "by mouth": "26643006", "sublingual": "37839007", "sl": "37839007", "intravenous": "47625008", "iv": "47625008", "intramuscular": "78421000", "im": "78421000", "subcutaneous": "34206005",
    "subq": "34206005", "sc": "34206005", "topical": "6064005", "rectal": "37161004", "pr": "37161004", "inhalation": "447694001", "inhaled": "447694001", "nasal": "46713006", "ophthalmic": "54485002", "otic": "10547007",
    "vaginal": "16857009", "transdermal": "45890007",
}
# Timings by abbreviation: code, times, period and its unit.
TIMINGS = {
    "QD": ("QD", 1, 1.0, "d"), "DAILY": ("QD", 1, 1.0, "d"), "BID": ("BID", 2, 1.0, "d"), "TID": ("TID", 3, 1.0, "d"), "QID": ("QID", 4, 1.0, "d"), "Q4H": ("Q4H", 1, 4.0, "h"), "Q6H": ("Q6H", 1, 6.0, "h"), "Q8H": ("Q8H", 1, 8.0, "h"),
    "Q12H": ("Q12H", 1, 12.0, "h"), "QHS": ("QHS", 1, 1.0, "d"), "QW": ("QW", 1, 1.0, "wk"), "QOD": ("QOD", 1, 2.0, "d"),
}
# Vital signs by parts of their names, in order of trial.
VITAL_CODES = [
    (["heart rate", "pulse rate"], "8867-4"), (["respiratory rate", "breathing rate"], "9279-1"), (["temperature"], "8310-5"), (["height"], "8302-2"), (["weight"], "29463-7"), (["bmi", "body mass index"], "39156-5"),
    (["oxygen saturation", "spo2", "o2 sat"], "59408-5"), (["systolic"], "8480-6"), (["diastolic"], "8462-4"), (["blood pressure"], "85354-9"), (["head circumference"], "9843-4"),
]
# Statuses and intents of orders.
ORDER_STATUSES = ["active", "on-hold", "cancelled", "completed", "entered-in-error", "stopped", "draft", "unknown"]
ORDER_INTENTS = ["proposal", "plan", "order", "original-order", "reflex-order", "filler-order", "instance-order", "option"]


def known(entries: dict[str, str], key: Column) -> Column:
    return F.element_at(F.map_from_arrays(F.array(*[F.lit(k) for k in entries]), F.array(*[F.lit(v) for v in entries.values()])), key)


def leading_number(text: Column) -> Column:
    """The number that a text begins with."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([-+]?[0-9]*\.?[0-9]+)", 1).try_cast("double")


def dose_quantity(dose: Column, unit: Column) -> Column:
    """Struct of value, unit, system and code of a dose; null without a dose, without a value where no number begins it."""
    code = known(DOSE_UNITS, F.lower(F.trim(unit)))
    value = leading_number(dose)
    has = code.isNotNull() & value.isNotNull()
    return F.when(F.trim(F.coalesce(dose, F.lit(""))) != "", F.struct(value.alias("value"), unit.alias("unit"), F.when(has, F.lit("http://unitsofmeasure.org")).alias("system"), F.when(has, code).alias("code")))


def timing(frequency: Column) -> Column:
    """Struct of a timing's text, code and repeat; repeat is null for what isn't a regular one."""
    key = F.upper(F.trim(frequency))
    # one look-up and not a branch for each timing: methods of over 8000 bytes of code are never compiled, and resources are made many to a method
    repeats = F.array(*[F.struct(F.lit(times).alias("frequency"), F.lit(period).alias("period"), F.lit(unit).alias("periodUnit")) for _, times, period, unit in TIMINGS.values()])
    repeat = F.element_at(F.map_from_arrays(F.array(*[F.lit(k) for k in TIMINGS]), repeats), key)
    code = F.coalesce(known({k: v[0] for k, v in TIMINGS.items()}, key), F.when(key.isin("PRN", "STAT"), key))
    coding = F.when(code.isNotNull(), F.array(F.struct(F.lit("http://terminology.hl7.org/CodeSystem/v3-GTSAbbreviation").alias("system"), code.alias("code"))))
    return F.when(key != "", F.struct(F.struct(coding.alias("coding"), frequency.alias("text")).alias("code"), repeat.alias("repeat")))


def vital_code(name: Column) -> Column:
    """Code of a vital sign by its name, null for unknown ones."""
    out, low = F, F.lower(name)
    for marks, code in VITAL_CODES:
        out = out.when(low.rlike("|".join(marks)), code)
    return out.otherwise(F.lit(None).cast("string"))


def vital_unit(unit: Column) -> Column:
    return F.coalesce(known(VITAL_UNITS, F.lower(F.trim(unit))), unit)


def one_of(value: Column, allowed: list[str], default: str) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(allowed), v).otherwise(default)
