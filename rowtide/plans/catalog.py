"""All registered queries."""

from rowtide.plans import (  # noqa: F401
    decode_queries,
    lookup_queries,
    metric_queries,
    replay_queries,
    schema_queries,
    stream_queries,
)
from rowtide.plans.registry import ORACLES, QUERIES  # noqa: F401
