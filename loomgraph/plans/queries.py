"""All registered queries of the library (the corpus operators register themselves apart)."""

from __future__ import annotations

from loomgraph.plans import change_queries, code_queries, delivery_queries, issue_queries, more_queries, record_queries  # noqa: F401
from loomgraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
