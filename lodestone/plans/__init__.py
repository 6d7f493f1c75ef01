"""All queries: importing this package registers them."""

from lodestone.plans import contexts, evidence, files, graph, lifecycle, operations, retrieval, shapes, streams  # noqa: F401
from lodestone.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
