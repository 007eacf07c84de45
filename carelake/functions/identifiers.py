"""Healthcare identifiers: checks that return an error code (null for valid values) and normal forms, all as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Social security numbers that are never issued, registrant letters, letters that a beneficiary number leaves out.
REJECTED_SSN = ["000000000", "123456789", "111111111", "999999999"]
DEA_REGISTRANTS = "ABFGMPRX"
MBI_LETTERS = "ACDEFGHJKMNPQRTUVWXY"
# Character class of each position of a beneficiary number.
MBI_POSITIONS = ["[1-9]", f"[{MBI_LETTERS}]", f"[0-9{MBI_LETTERS}]", "[0-9]", f"[{MBI_LETTERS}]", f"[0-9{MBI_LETTERS}]", f"[0-9{MBI_LETTERS}]", "[0-9]"] + [f"[0-9{MBI_LETTERS}]"] * 3
# Identifier types of table 0203 and what they stand for here.
IDENTIFIER_TYPES = {"MR": "MRN", "SS": "SSN", "MC": "MBI", "NPI": "NPI", "DEA": "DEA", "DL": "DL", "PI": "PI", "AN": "AN", "VN": "VN", "MA": "MEDICAID"}


def first_error(checks: list[tuple[Column, str]]) -> Column:
    """The code of the first condition that holds, null if none does."""
    return reduce(lambda out, x: out.when(*x), [(c, F.lit(code)) for c, code in checks], F).otherwise(F.lit(None).cast("string")) if checks else F.lit(None)


def bare(value: Column) -> Column:
    return F.regexp_replace(value, "[ -]", "")


def npi_error(value: Column) -> Column:
    v = bare(value)
    return first_error([
        (F.length(v) != 10, "INVALID_NPI_LENGTH"),
        (~v.rlike("^[0-9]+$"), "INVALID_NPI_FORMAT"),
        (v.startswith("0"), "INVALID_NPI_START"),
        (~F.call_function("luhn_check", F.concat(F.lit("80840"), v)), "INVALID_NPI_CHECKSUM"),
    ])


def dea_error(value: Column) -> Column:
    v = F.upper(F.trim(value))
    digit = [F.substring(v, k, 1).try_cast("int") for k in range(3, 10)]
    total = digit[0] + digit[2] + digit[4] + 2 * (digit[1] + digit[3] + digit[5])
    return first_error([
        (F.length(v) != 9, "INVALID_DEA_LENGTH"),
        (~v.rlike("^[A-Z]{2}"), "INVALID_DEA_PREFIX"),
        (~v.rlike(f"^[{DEA_REGISTRANTS}]"), "INVALID_DEA_REGISTRANT"),
        (~v.rlike("^..[0-9]{7}$"), "INVALID_DEA_DIGITS"),
        (total % 10 != digit[6], "INVALID_DEA_CHECKSUM"),
    ])


def mbi_error(value: Column) -> Column:
    v = F.upper(bare(value))
    return first_error([(F.length(v) != 11, "INVALID_MBI_LENGTH"), *[(~F.substring(v, k, 1).rlike(x), f"INVALID_MBI_POS{k}") for k, x in enumerate(MBI_POSITIONS, 1)]])


def ssn_error(value: Column, rejected: list[str] | None = None) -> Column:
    v = bare(value)
    return first_error([
        (F.length(v) != 9, "INVALID_SSN_LENGTH"),
        (~v.rlike("^[0-9]+$"), "INVALID_SSN_FORMAT"),
        (v.rlike("^(000|666|9)"), "INVALID_SSN_AREA"),
        (F.substring(v, 4, 2) == "00", "INVALID_SSN_GROUP"),
        (F.substring(v, 6, 4) == "0000", "INVALID_SSN_SERIAL"),
        (v.isin(REJECTED_SSN if rejected is None else rejected), "INVALID_SSN_PATTERN"),
    ])


def identifier_type(code: Column) -> Column:
    """Table 0203 code to the engine's type; codes that aren't listed stay as they are."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in IDENTIFIER_TYPES.items() for x in kv]), F.upper(code)), code)


def validated(type_name: Column, value: Column) -> Column:
    """Error code of an identifier by its type; types without a check have none."""
    return F.when(type_name == "NPI", npi_error(value)).when(type_name == "DEA", dea_error(value)).when(type_name == "MBI", mbi_error(value)).when(type_name == "SSN", ssn_error(value))


def phone(value: Column) -> Column:
    """Ten digits without the country code, empty if there aren't ten."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    digits = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(F.length(digits) == 10, digits).otherwise(F.lit(""))


def phone_score(a: Column, b: Column) -> Column:
    """1 for equal numbers, 0.7 for equal last seven digits, else 0."""
    x, y = phone(a), phone(b)
    both = (x != "") & (y != "")
    return F.when(both & (x == y), 1.0).when(both & (F.right(x, F.lit(7)) == F.right(y, F.lit(7))), 0.7).otherwise(0.0)


def ssn(value: Column) -> Column:
    """Nine digits, empty for anything else and for numbers that are never issued."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when((F.length(digits) == 9) & ~digits.isin(REJECTED_SSN), digits).otherwise(F.lit(""))


# Forms of address before a name and generations or degrees after it.
TITLES = ["MR", "MRS", "MS", "DR", "MISS"]
SUFFIXES = ["JR", "SR", "II", "III", "IV", "MD", "PHD", "DO", "RN", "ESQ"]


def person_name(value: Column) -> Column:
    """Upper-case letters and single spaces, without one title and one suffix."""
    name = F.upper(F.trim(value))
    name = F.regexp_replace(name, f"^({'|'.join(TITLES)})\\.? ", "")
    name = F.regexp_replace(name, f" ({'|'.join(SUFFIXES)})$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(name, "[^\\p{L}\\s]", ""), "\\s+", " "))


def gender(value: Column) -> Column:
    """M, F, O or U from the usual spellings; anything else is U."""
    v = F.upper(F.trim(value))
    return F.when(v.isin("M", "MALE"), "M").when(v.isin("F", "FEMALE"), "F").when(v.isin("O", "OTHER"), "O").otherwise("U")


def fhir_gender(value: Column) -> Column:
    v = F.upper(F.trim(value))
    return F.when(v.isin("M", "MALE"), "male").when(v.isin("F", "FEMALE"), "female").when(v.isin("O", "OTHER", "A", "N"), "other").otherwise("unknown")
