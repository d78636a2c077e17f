"""All registered queries."""

from trilect.plans import (  # noqa: F401
    catalog_queries,
    corpus,
    export_queries,
    profile_queries,
    relational_queries,
    repair_queries,
    scalar_queries,
    score_queries,
    text_queries,
)
from trilect.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
