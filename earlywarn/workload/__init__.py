"""The registered queries: every operator over the given tables, with its SQL counterpart."""

from earlywarn.workload import cleaning, features, labels, models, profiling, quality, reports  # noqa: F401
from earlywarn.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
