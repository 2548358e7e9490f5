"""All registered queries. Importing the query modules fills the registry."""

from orderflow.plans import (  # noqa: F401
    health_queries,
    order_queries,
    stream_queries,
    window_queries,
)
from orderflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
