"""Decisions before a search: checks, the metric, and which of the three ways to take."""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass

from nearfield.functions.vectors import check_metric
from nearfield.operators.ranges import select_clusters
from nearfield.sources.table import VectorTable

ALGORITHMS = ("auto", "exact", "binary")
TOP_K, RERANK = 10, 10


@dataclass(frozen=True)
class SearchPlan:
    query: list[float]
    #: The metric that scores rows, and the one that the caller asked for and that orders results.
    scoring: str
    metric: str
    exact: bool
    pool: int
    code: list[int]
    #: Clusters to read, or None for all rows.
    clusters: list[int] | None


def float32(values: Sequence[float]) -> list[float]:
    return list(struct.unpack(f"<{len(values)}f", struct.pack(f"<{len(values)}f", *values)))


def normalized(values: list[float]) -> list[float]:
    norm = math.sqrt(sum(v * v for v in values))
    return float32([v / norm for v in values]) if norm else values


def code_of(values: list[float]) -> list[int]:
    words = [0] * -(-len(values) // 64)
    for i, v in enumerate(values):
        if v >= 0:
            words[i // 64] |= 1 << i % 64
    return words


def plan_search(table: VectorTable, query: Sequence[float], top_k: int = TOP_K, metric: str | None = None, rerank_factor: float = RERANK, probe: float | None = None, algorithm: str = "auto") -> SearchPlan:
    """Exact if asked for, or without codes, or with a rerank factor of 0; otherwise codes first, then floats."""
    meta = table.meta
    if len(query) != meta.dimension:
        raise ValueError(f"the query has dimension {len(query)}, the table {meta.dimension}")
    if any(v is None or math.isnan(v) for v in query):
        raise ValueError("the query has a null or NaN")
    if top_k < 1:
        raise ValueError(f"top_k must be 1 or more, not {top_k}")
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unsupported algorithm {algorithm!r}: one of {', '.join(ALGORITHMS)}")
    metric = metric or meta.metric
    check_metric(metric)
    values, scoring = float32(query), metric
    if metric == "cosine" and meta.normalized:
        values, scoring = normalized(values), "dot"
    exact = algorithm == "exact" or rerank_factor == 0 or (algorithm == "auto" and not meta.binary)
    if not exact and not meta.binary:
        raise ValueError("algorithm 'binary' needs codes, the table has none")
    code = code_of(values)
    clusters = select_clusters(table.centroids, code, probe) if table.centroids and not exact else None
    return SearchPlan(values, scoring, metric, exact, max(math.ceil(top_k * rerank_factor), top_k), code, clusters)
