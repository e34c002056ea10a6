"""Registered queries (Spark builders + SQL oracles).

Importing this package registers every query module in ``REGISTRY``.
"""

from cohortlens.plans import core_queries, evaluation_queries, ml_queries, report_queries, stream_queries  # noqa: F401
from cohortlens.plans.registry import REGISTRY, Query, present, register

__all__ = ["REGISTRY", "Query", "present", "register"]
