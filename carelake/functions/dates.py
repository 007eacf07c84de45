"""Timestamps of the message formats as Column expressions; what doesn't parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hl7_timestamp(value: Column) -> Column:
    """HL7 times of 4 to 14 digits with an optional fraction and offset; a precision component after ^ is dropped. UTC where no offset stands."""
    v = F.trim(F.split_part(value, F.lit("^"), F.lit(1)))
    parts = "^([0-9]{4}(?:[0-9]{2}){0,5})(\\.[0-9]{1,4})?([+-][0-9]{4})?$"
    digits, fraction, offset = (F.regexp_extract(v, parts, k) for k in (1, 2, 3))
    whole = F.concat(digits, F.substr(F.lit("00000101000000"), F.length(digits) + 1))
    stamp = F.try_to_timestamp(F.concat(whole, F.when(fraction == "", ".0000").otherwise(F.rpad(fraction, 5, "0"))), F.lit("yyyyMMddHHmmss.SSSS"))
    minutes = F.when(offset == "", 0).otherwise((F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 4, 2).try_cast("int")) * F.when(offset.startswith("-"), -1).otherwise(1))
    return F.when((digits != "") & (F.length(digits) % 2 == 0), stamp - F.make_dt_interval(F.lit(0), F.lit(0), minutes))


# Date and time layouts that CSV exports use, in order of trial.
CSV_LAYOUTS = ["yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "MM-dd-yyyy", "yyyy/MM/dd", "yyyyMMdd"]
CSV_TIME_LAYOUTS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyyMMddHHmmss"]


def csv_date(value: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(value), F.lit(x)) for x in CSV_LAYOUTS]).cast("date")


def csv_timestamp(value: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(value), F.lit(x)) for x in CSV_TIME_LAYOUTS + CSV_LAYOUTS])


def edi_date(value: Column) -> Column:
    """CCYYMMDD, or YYMMDD where years from 69 on are in the last century."""
    year = F.substring(value, 1, 2).try_cast("int")
    short = F.concat(F.when(year >= 69, "19").otherwise("20"), value)
    return F.when(F.length(value) == 8, F.try_to_timestamp(value, F.lit("yyyyMMdd"))).when(F.length(value) == 6, F.try_to_timestamp(short, F.lit("yyyyMMdd"))).cast("date")


def cda_timestamp(value: Column) -> Column:
    """CDA times are HL7 times."""
    return hl7_timestamp(value)


def retry_delay(attempt: Column, initial: float = 1.0, factor: float = 2.0, cap: float = 60.0) -> Column:
    """Seconds before the attempt after the given number of failures, without jitter."""
    return F.least(F.lit(float(cap)), F.lit(float(initial)) * F.pow(F.lit(float(factor)), attempt - 1))
