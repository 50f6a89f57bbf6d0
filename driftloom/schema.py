"""Table specifications: a schema dictionary becomes a validated, typed spec."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date, datetime
from typing import Any

# Settings of a time series that live next to the fields in a schema dictionary.
RESERVED = ("time_field", "time_interval_seconds", "trends", "seasonality")
DEFAULT_SEED = 42


class SpecError(ValueError):
    """A schema dictionary that cannot be generated from."""


@dataclass(frozen=True)
class FieldSpec:
    name: str
    kind: str
    params: Mapping[str, Any]

    @property
    def low(self) -> float | None:
        return self.params.get("min")

    @property
    def high(self) -> float | None:
        return self.params.get("max")

    @property
    def mean(self) -> float:
        return float(self.params.get("mean", 0.0))

    @property
    def std(self) -> float:
        return float(self.params.get("std", 1.0))

    @property
    def int_range(self) -> tuple[int, int]:
        return int(self.params.get("min", 0)), int(self.params.get("max", 100))

    @property
    def categories(self) -> list[Any]:
        return list(self.params.get("categories", ["A", "B", "C"]))

    @property
    def probabilities(self) -> list[float]:
        given = self.params.get("probabilities")
        n = len(self.categories)
        return [float(p) for p in given] if given is not None else [1.0 / n] * n

    @property
    def dates(self) -> tuple[Any, Any]:
        return self.params.get("start_date", "2020-01-01"), self.params.get("end_date", "2023-12-31")


@dataclass(frozen=True)
class TableSpec:
    name: str
    fields: tuple[FieldSpec, ...]
    seed: int = DEFAULT_SEED
    time_field: str | None = None
    interval_seconds: float = 60.0
    trends: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    seasonality: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)

    def __getitem__(self, name: str) -> FieldSpec:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    @property
    def interval_us(self) -> int:
        return int(round(self.interval_seconds * 1_000_000))

    @staticmethod
    def of(
        name: str, schema: Mapping[str, Any], seed: int = DEFAULT_SEED, series: bool | None = None
    ) -> TableSpec:
        """Read a schema dictionary; all problems found are reported in one error."""
        problems: list[str] = []
        fields: list[FieldSpec] = []
        for key, value in schema.items():
            if key in RESERVED:
                continue
            if not isinstance(value, Mapping):
                problems.append(f"{key}: a field is a mapping")
                continue
            spec = FieldSpec(key, str(value.get("type", "float")), dict(value))
            problems.extend(f"{key}: {p}" for p in _problems(spec))
            fields.append(spec)
        if series is None:
            series = any(key in schema for key in RESERVED)
        time_field = schema.get("time_field", "timestamp") if series else None
        if series and not isinstance(time_field, str):
            problems.append("time_field: must be text")
        interval = schema.get("time_interval_seconds", 60)
        if not _is_number(interval) or interval <= 0:
            problems.append("time_interval_seconds: must be a positive number")
        if problems:
            raise SpecError("; ".join(problems))
        return TableSpec(
            name,
            tuple(fields),
            seed,
            time_field,
            float(interval),
            dict(schema.get("trends", {})),
            dict(schema.get("seasonality", {})),
        )


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _problems(spec: FieldSpec) -> list[str]:
    params, found = spec.params, []
    if spec.kind == "float":
        for key in ("mean", "std", "min", "max"):
            if key in params and not _is_number(params[key]):
                found.append(f"{key} must be a number")
        if _is_number(params.get("std")) and params["std"] < 0:
            found.append("std must not be negative")
    elif spec.kind == "int":
        for key in ("min", "max"):
            if key in params and (not isinstance(params[key], int) or isinstance(params[key], bool)):
                found.append(f"{key} must be an integer")
        if not found and spec.int_range[0] > spec.int_range[1]:
            found.append("min is above max")
    elif spec.kind == "category":
        found.extend(_category_problems(spec))
    elif spec.kind == "datetime":
        for value in spec.dates:
            if not isinstance(value, (str, date, datetime)):
                found.append("dates must be ISO text or datetimes")
            elif isinstance(value, str):
                try:
                    datetime.fromisoformat(value)
                except ValueError:
                    found.append(f"{value!r} is not an ISO date")
    return found


def _category_problems(spec: FieldSpec) -> list[str]:
    categories = spec.params.get("categories", ["A", "B", "C"])
    if not isinstance(categories, (list, tuple)) or not categories:
        return ["categories must be a non-empty list"]
    found = []
    if len({type(c) for c in categories}) > 1:
        found.append("categories must share one type")
    given = spec.params.get("probabilities")
    if given is not None:
        if not isinstance(given, (list, tuple)) or len(given) != len(categories):
            found.append("probabilities must match the categories")
        elif not all(_is_number(p) and p >= 0 for p in given):
            found.append("probabilities must be non-negative numbers")
        elif not math.isclose(sum(given), 1.0, abs_tol=1e-4):
            found.append("probabilities must sum to 1")
    return found


# --- preset schemas: fixed values --------------------------------------------

PRESET_TABULAR = {
    "id": {"type": "int", "min": 1000, "max": 9999},
    "name": {"type": "name"},
    "email": {"type": "email"},
    "age": {"type": "int", "min": 18, "max": 90},
    "income": {"type": "float", "mean": 50000, "std": 20000, "min": 0},
    "created_at": {"type": "datetime", "start_date": "2020-01-01", "end_date": "2023-12-31"},
    "status": {
        "type": "category",
        "categories": ["active", "inactive", "pending"],
        "probabilities": [0.7, 0.2, 0.1],
    },
}

PRESET_SERIES = {
    "time_field": "timestamp",
    "time_interval_seconds": 300,
    "value": {"type": "float", "mean": 100, "std": 15, "min": 0},
    "count": {"type": "int", "min": 0, "max": 1000},
    "category": {
        "type": "category",
        "categories": ["A", "B", "C", "D"],
        "probabilities": [0.4, 0.3, 0.2, 0.1],
    },
    "trends": {"value": {"type": "linear", "strength": 0.1}},
    "seasonality": {"value": {"period": 24, "amplitude": 0.2}},
}

CUSTOMER_SCHEMA = {
    "customer_id": {"type": "int", "min": 10000, "max": 99999},
    "name": {"type": "name"},
    "email": {"type": "email"},
    "age": {"type": "int", "min": 18, "max": 85},
    "gender": {
        "type": "category", "categories": ["M", "F", "Other"], "probabilities": [0.48, 0.48, 0.04],
    },
    "location": {
        "type": "category",
        "categories": ["North", "South", "East", "West", "Central"],
        "probabilities": [0.2, 0.2, 0.2, 0.2, 0.2],
    },
    "signup_date": {"type": "datetime", "start_date": "2020-01-01", "end_date": "2023-12-31"},
    "is_premium": {"type": "category", "categories": [True, False], "probabilities": [0.25, 0.75]},
    "lifetime_value": {"type": "float", "mean": 500, "std": 300, "min": 0},
}

TRANSACTION_SCHEMA = {
    "time_field": "timestamp",
    "time_interval_seconds": 300,
    "transaction_id": {"type": "int", "min": 1000000, "max": 9999999},
    "customer_id": {"type": "int", "min": 10000, "max": 99999},
    "product_id": {"type": "int", "min": 1, "max": 1000},
    "quantity": {"type": "int", "min": 1, "max": 10},
    "price": {"type": "float", "mean": 50, "std": 30, "min": 5, "max": 500},
    "discount": {"type": "float", "mean": 0.1, "std": 0.1, "min": 0, "max": 0.5},
    "payment_method": {
        "type": "category",
        "categories": ["credit_card", "debit_card", "paypal", "apple_pay", "google_pay"],
        "probabilities": [0.4, 0.3, 0.15, 0.1, 0.05],
    },
    "trends": {"price": {"type": "linear", "strength": 0.05}},
    "seasonality": {
        "quantity": {"period": 24, "amplitude": 0.3},
        "discount": {"period": 168, "amplitude": 0.2},
    },
}
