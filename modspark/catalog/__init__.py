"""Registered queries: each Spark query next to its check in SQL."""

from modspark.catalog import (  # noqa: F401
    datasets,
    evaluation,
    flows,
    moderation,
    ordered,
    streams,
    texts,
)
from modspark.catalog.common import CHECKS, QUERIES  # noqa: F401
