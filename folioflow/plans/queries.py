"""Named queries over the test tables, and the SQL they are checked against."""

from folioflow.plans import corpus_queries, search_queries  # noqa: F401
from folioflow.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
