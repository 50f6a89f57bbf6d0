"""All registered queries."""

from __future__ import annotations

from driftloom.plans import drifting, fallbacks, forecasting, generation, ingesting, profiling, repairing, streams  # noqa: F401
from driftloom.plans.tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
