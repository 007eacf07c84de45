"""Scores of data quality and of extracted results."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def completeness(columns: list[Column]) -> Column:
    """Share of the columns that are neither null nor empty; zero and false count as filled."""
    filled = [F.when(c.isNotNull() & (c.cast("string") != ""), 1.0).otherwise(0.0) for c in columns]
    return sum(filled[1:], filled[0]) / len(columns)


def _count(value: object) -> tuple[int, int]:
    """(filled, all) fields of a JSON object; a nested object is a field that never counts as filled itself."""
    filled = total = 0
    for x in value.values():
        total += 1
        if isinstance(x, dict):
            f, t = _count(x)
            filled, total = filled + f, total + t
        elif x not in (None, "") and x != []:
            filled += 1
    return filled, total


@F.pandas_udf(DoubleType())
def _json_completeness(data: pd.Series) -> pd.Series:
    def one(text: str | None) -> float | None:
        try:
            value = json.loads(text) if text else None
        except ValueError:
            return None
        if not isinstance(value, dict):
            return None
        filled, total = _count(value)
        return filled / total if total else 0.0

    return pd.Series([one(t) for t in data], dtype="float64")


def json_completeness(data: Column) -> Column:
    """Share of filled fields of a JSON object at all depths; null for what isn't an object."""
    return _json_completeness(data)


def _match(want: object, got: object) -> float:
    """How far a result agrees with what is expected: objects and lists by their parts, texts by shared words, numbers by closeness."""
    if isinstance(want, dict):
        if not want:
            return 1.0
        return sum(_match(v, got[k]) if isinstance(got, dict) and k in got else 0.0 for k, v in want.items()) / len(want)
    if isinstance(want, list):
        if not want:
            return 1.0 if got in ([], None) else 0.0
        return sum(max((_match(w, g) for g in got), default=0.0) for w in want) / len(want) if isinstance(got, list) else 0.0
    if isinstance(want, bool) or want is None:
        return float(want is got)
    if isinstance(want, (int, float)):
        if not isinstance(got, (int, float)) or isinstance(got, bool):
            return 0.0
        return 1.0 if want == got else max(0.0, 1 - abs(want - got) / max(abs(want), abs(got)))
    if not isinstance(got, str):
        return 0.0
    a, b = set(str(want).lower().split()), set(got.lower().split())
    return 1.0 if want == got or a == b else len(a & b) / len(a | b) if a | b else 1.0


def json_match(expected: Column, actual: Column) -> Column:
    """Score from 0 to 1 of a JSON result against an expected one; 0 where either doesn't parse."""

    @F.pandas_udf(DoubleType())
    def run(want: pd.Series, got: pd.Series) -> pd.Series:
        out = []
        for w, g in zip(want, got, strict=True):
            try:
                out.append(_match(json.loads(w), json.loads(g)))
            except (TypeError, ValueError):
                out.append(0.0)
        return pd.Series(out, dtype="float64")

    return run(expected, actual)
