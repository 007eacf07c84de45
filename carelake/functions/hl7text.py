"""Access to delimited message text and its escapes, as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Escape letters and what they stand for under the usual delimiters.
ESCAPES = {"F": "|", "S": "^", "T": "&", "R": "~", "E": "\\", ".br": "\n"}
_ESCAPE = re.compile(r"\\(F|S|T|R|E|\.br|X(?:[0-9A-Fa-f]{2})+)\\")


def unescape_text(text: str) -> str:
    """One pass from left to right, so that an escaped backslash can't start another escape; hexadecimal escapes are bytes of UTF-8."""
    return _ESCAPE.sub(lambda m: bytes.fromhex(m[1][1:]).decode("utf-8", "replace") if m[1][0] == "X" else ESCAPES[m[1]], text)


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unescape_text(t) for t in text], dtype=object)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), _unescape(text)).otherwise(text)


def part(value: Column, number: int, separator: str | Column) -> Column:
    """The part with that number, from 0; null beyond the last one, and for empty parts."""
    sep = F.lit(separator) if isinstance(separator, str) else separator
    out = F.get(F.split(value, F.concat(F.lit("\\Q"), sep, F.lit("\\E"))), F.lit(number))
    return F.nullif(out, F.lit(""))


def field(segment: Column, number: int) -> Column:
    """Field of a segment given as an array of its fields, null if absent or empty."""
    return F.nullif(F.get(segment, F.lit(number)), F.lit(""))


def component(value: Column, number: int, separator: str = "^") -> Column:
    """Component of the first repetition of a field."""
    return part(F.split_part(value, F.lit("~"), F.lit(1)), number, separator)
