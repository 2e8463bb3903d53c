"""All registered queries."""

from clozeframe.plans import catalog_results, catalog_stats, catalog_text  # noqa: F401
from clozeframe.plans.registry import QUERIES

__all__ = ["QUERIES"]
