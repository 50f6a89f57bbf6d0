"""Conformance of rows to a table specification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.scalars import ntz_literal
from driftloom.schema import FieldSpec, TableSpec

# Spark type a value of each field kind must be castable to.
CAST_TYPES = {"float": "double", "int": "bigint", "datetime": "timestamp_ntz"}


def _rules(f: FieldSpec, df: DataFrame) -> list[tuple[str, Column]]:
    """(rule, row violates it) pairs of one field."""
    raw = F.col(f"`{f.name}`")
    rules = [("not_null", raw.isNull())]
    value = raw
    if f.kind in CAST_TYPES:
        if isinstance(df.schema[f.name].dataType, T.StringType):
            value = raw.try_cast(CAST_TYPES[f.kind])
        wrong = raw.isNotNull() & value.isNull()
        if f.kind == "int" and isinstance(df.schema[f.name].dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            wrong = raw.isNotNull() & (raw != F.floor(raw))
        rules.append(("type", wrong))
    if f.kind in ("float", "int"):
        low, high = (f.low, f.high) if f.kind == "float" else f.int_range
        if low is not None:
            rules.append(("min", value < F.lit(low)))
        if high is not None:
            rules.append(("max", value > F.lit(high)))
    elif f.kind == "datetime":
        start, end = f.dates
        rules.append(("date_range", (value < ntz_literal(start)) | (value > ntz_literal(end))))
    elif f.kind == "category":
        rules.append(("known_category", raw.isNotNull() & ~raw.isin(f.categories)))
    return rules


def conformance(df: DataFrame, spec: TableSpec, tolerance: float = 0.05) -> DataFrame:
    """Violations per field and rule: ``(field, rule, checked, violations)``.

    One aggregate over the table however many rules there are.  ``category_share`` counts the
    categories whose share is further than ``tolerance`` from their probability.
    """
    reports = []
    for f in spec.fields:
        if f.name not in df.columns:
            reports.append(_report(f.name, "present", F.count("*"), F.lit(1)))
            continue
        for rule, violated in _rules(f, df):
            reports.append(_report(f.name, rule, F.count("*"), F.count_if(violated)))
        if f.kind == "category":
            reports.append(_category_share(f, tolerance))
    return df.agg(F.array(*reports).alias("r")).select(F.inline("r"))


def _report(field: str, rule: str, checked: Column, violations: Column) -> Column:
    return F.struct(
        F.lit(field).alias("field"),
        F.lit(rule).alias("rule"),
        checked.cast("long").alias("checked"),
        violations.cast("long").alias("violations"),
    )


def _category_share(f: FieldSpec, tolerance: float) -> Column:
    raw = F.col(f"`{f.name}`")
    off = F.lit(0)
    for category, p in zip(f.categories, f.probabilities):
        share = F.try_divide(F.count_if(raw == F.lit(category)), F.count(raw))
        off = off + F.coalesce((F.abs(share - F.lit(p)) > F.lit(tolerance)).cast("int"), F.lit(0))
    return _report(f.name, "category_share", F.count("*"), off)
