"""Registered queries over the benchmark tables, with their SQL counterparts."""

from farpoint.catalog import (  # noqa: F401  (importing registers the queries)
    clusters,
    density,
    detectors,
    distances,
    encoding,
    evaluation,
    rows,
    streams,
    svm,
    thresholds,
)
from farpoint.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
