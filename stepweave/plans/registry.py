"""Every query of the library outside the training-data subpackage, and its oracle."""

from __future__ import annotations

from stepweave.plans import acceptance_queries, audit_queries, box_queries, catalog_queries, image_queries, page_queries, repair_queries, sequence_queries, source_queries, state_queries, stream_queries
from stepweave.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "acceptance_queries", "audit_queries", "box_queries", "catalog_queries", "image_queries", "page_queries", "repair_queries", "sequence_queries", "source_queries", "state_queries", "stream_queries"]
