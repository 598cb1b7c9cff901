"""The runnable queries, one per operator."""

from parity.plans import (  # noqa: F401
    bench_queries,
    diff_queries,
    frame_queries,
    metric_queries,
    profile_queries,
    record_queries,
)
from parity.plans.catalog import ORACLE, QUERIES  # noqa: F401
