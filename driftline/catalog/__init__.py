"""All registered queries and their oracles."""

from driftline.catalog import (  # noqa: F401
    changes,
    copying,
    documents,
    expressions,
    files,
    progress,
    store,
    streams,
)
from driftline.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
