"""The workloads, and the registered queries over the driver's tables."""

from symbridge.jobs import join_queries, score_queries, source_queries, workload_queries  # noqa: F401
from symbridge.jobs.registry import ORACLES, QUERIES  # noqa: F401
