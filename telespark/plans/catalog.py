"""All registered queries."""

from telespark.plans import bill_queries, log_queries, metric_queries, service_queries, source_queries, stream_queries, trace_queries  # noqa: F401
from telespark.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "service_stats"
