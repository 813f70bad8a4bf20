"""All queries of the analytics engine."""

from tidemill.plans import audit, decide, forecast, prepare, sinks  # noqa: F401  they register themselves
from tidemill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
