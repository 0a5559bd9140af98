"""Formulas as JSON trees, turned into columns; nothing of a formula is ever evaluated as code."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATIONS = {"add", "sub", "mul", "div", "sum", "mean", "ratio", "percent_change", "weighted_sum", "round", "min", "max"}


def check(spec: dict, names: set[str], depth: int = 0) -> None:
    """Raises ValueError unless the tree holds known operations, known names and numbers only."""
    if depth > 20 or not isinstance(spec, dict):
        raise ValueError("a formula is a tree of at most 20 levels")
    if "const" in spec:
        if isinstance(spec["const"], bool) or not isinstance(spec["const"], (int, float)):
            raise ValueError("a constant must be a number")
    elif "ref" in spec:
        if spec["ref"] not in names:
            raise ValueError(f"unknown operand {spec['ref']!r}")
    elif spec.get("op") in OPERATIONS and isinstance(spec.get("args"), list) and spec["args"]:
        for a in spec["args"]:
            check(a, names, depth + 1)
    else:
        raise ValueError(f"unknown formula node {spec!r}")


def to_column(spec: dict, names: set[str]) -> Column:
    """The formula over columns of doubles; a zero divisor gives null."""
    check(spec, names)
    return _column(spec)


def _column(spec: dict) -> Column:
    if "const" in spec:
        return F.lit(float(spec["const"]))
    if "ref" in spec:
        return F.col(spec["ref"]).cast("double")
    a = [_column(x) for x in spec["args"]]
    match spec["op"]:
        case "add" | "sum":
            return reduce(lambda x, y: x + y, a)
        case "sub":
            return a[0] - a[1]
        case "mul":
            return reduce(lambda x, y: x * y, a)
        case "div" | "ratio":
            return F.try_divide(a[0], a[1])
        case "mean":
            return reduce(lambda x, y: x + y, a) / len(a)
        case "percent_change":
            return F.try_divide((a[1] - a[0]) * 100, a[0])
        case "weighted_sum":
            return reduce(lambda x, y: x + y, [p * q for p, q in zip(a[::2], a[1::2], strict=True)])
        case "round":
            return F.round(a[0].cast("decimal(38,10)"), int(spec["args"][1]["const"]) if len(a) > 1 else 0).cast("double")
        case "min":
            return F.least(*a) if len(a) > 1 else a[0]
        case _:
            return F.greatest(*a) if len(a) > 1 else a[0]


def _exact(spec: dict, row: dict) -> Fraction | None:
    if "const" in spec:
        return Fraction(str(spec["const"]))
    if "ref" in spec:
        v = row[spec["ref"]]
        return None if v is None or v != v else Fraction(str(v))
    a = [_exact(x, row) for x in spec["args"]]
    if any(x is None for x in a):
        return None
    match spec["op"]:
        case "add" | "sum":
            return sum(a, Fraction(0))
        case "sub":
            return a[0] - a[1]
        case "mul":
            return reduce(lambda x, y: x * y, a)
        case "div" | "ratio":
            return a[0] / a[1] if a[1] else None
        case "mean":
            return sum(a, Fraction(0)) / len(a)
        case "percent_change":
            return (a[1] - a[0]) * 100 / a[0] if a[0] else None
        case "weighted_sum":
            return sum((p * q for p, q in zip(a[::2], a[1::2], strict=True)), Fraction(0))
        case "round":
            unit = Fraction(10) ** int(a[1] if len(a) > 1 else 0)
            scaled = abs(a[0] * unit)
            return (1 if a[0] >= 0 else -1) * Fraction(int(scaled + Fraction(1, 2))) / unit
        case "min":
            return min(a)
        case _:
            return max(a)


def exact_value(spec: dict, names: list[str]) -> Column:
    """The same formula in exact fractions: an independent second computation."""
    check(spec, set(names))

    def run(rows: pd.DataFrame) -> pd.Series:
        values = [_exact(spec, r) for r in rows.to_dict("records")]
        return pd.Series([None if v is None else float(v) for v in values], dtype="float64")

    return F.pandas_udf(run, T.DoubleType())(F.struct(*names))


def slash_zip(labels: Column, values: Column) -> Column:
    """Labels and values that are written with slashes, paired; null where their numbers differ."""
    a, b = F.split(labels, " ?/ ?"), F.split(values, " ?/ ?")
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("label"), b.alias("value")))
