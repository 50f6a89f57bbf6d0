"""All queries of this package and the SQL that states them."""

from __future__ import annotations

from driftloom.llm import (  # noqa: F401
    exact_dedup, html_text, langid, lm_scoring, mixing, packing, pii, quality, simhash, url_filter, va_clusters, vector_search, whitening,
)
from driftloom.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
