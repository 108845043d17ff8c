"""Registered queries; importing this package registers all of them."""

from premia.plans import (  # noqa: F401
    catalog_queries,
    decision_queries,
    document_queries,
    flow_queries,
    stream_queries,
    tabular_queries,
)
from premia.plans.registry import ORACLES, QUERIES  # noqa: F401
