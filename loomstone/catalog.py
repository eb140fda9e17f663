"""Every query by name, with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from loomstone.plans import evaluation, relations, texts, training  # noqa: F401
from loomstone.plans.base import ORACLES, QUERIES

FLAGSHIP = "agg1_source_shares"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
