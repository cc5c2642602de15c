"""All registered queries; importing a plan module registers its queries."""

from freshness.plans import (  # noqa: F401
    aggs, docs, factors, io, joins, maintained_docs, prep, priority, report, scalars, seasonal, streams, windows,
)
from freshness.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
