"""All registered graph queries."""

from loomgraph.plans import language, passes, stores, summaries, traversal  # noqa: F401
from loomgraph.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
