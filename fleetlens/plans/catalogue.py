"""All registered queries."""

from fleetlens.plans import (  # noqa: F401
    dataset_queries,
    derive_queries,
    files_queries,
    logs_queries,
    stream_queries,
)
from fleetlens.plans.registry import ORACLES, QUERIES  # noqa: F401
