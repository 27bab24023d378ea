"""Every query over the input tables that the library's own operators answer."""

from lorespring.plans import acquisition_queries, chunking_queries, discovery_queries, memory_queries, recall_queries, retrieval_queries, screening_queries, store_queries, text_queries, upkeep_queries, upload_queries  # noqa: F401
from lorespring.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
