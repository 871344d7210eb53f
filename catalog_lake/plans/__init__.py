"""Queries over the given tables: the operators applied to projections of them."""

from catalog_lake.plans import image_queries, merge_queries, source_queries, stream_queries, vector_queries  # noqa: F401
from catalog_lake.plans import bitmap_queries, bucket_queries  # noqa: F401  (take parts of the others)
from catalog_lake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
