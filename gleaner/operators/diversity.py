"""Greedy choice within each query's few candidates: maximal marginal relevance, then demotion of near copies from other sources."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gleaner.functions.vectors import TINY
from gleaner.params import Params

CAP_PENALTY = 100.0


def similarities(vectors: list) -> np.ndarray:
    """Pairwise cosine; 0 where a vector is missing."""
    width = next((len(v) for v in vectors if v is not None), 1)
    there = np.array([v is not None for v in vectors])
    matrix = np.array([v if v is not None else np.zeros(width) for v in vectors], np.float64)
    lengths = np.sqrt((matrix * matrix).sum(axis=1))
    out = (matrix @ matrix.T) / (lengths[:, None] * lengths[None, :] + TINY)
    return np.where(there[:, None] & there[None, :], out, 0.0)


def choose(relevance: np.ndarray, similar: np.ndarray, sources: np.ndarray, top_k: int, params: Params) -> list[int]:
    """Indices in the order chosen. All candidates come back as they are where there are no more than top_k."""
    n = len(relevance)
    if n <= top_k:
        return list(range(n))
    _, source = np.unique(sources, return_inverse=True)
    taken = np.zeros(source.max() + 1, int)
    nearest, open_, out = np.zeros(n), np.ones(n, bool), []
    pick = 0
    while len(out) < top_k:
        out.append(pick)
        open_[pick] = False
        taken[source[pick]] += 1
        nearest = np.maximum(nearest, similar[pick])
        worth = params.mmr_lambda * relevance - (1 - params.mmr_lambda) * nearest - CAP_PENALTY * (taken[source] >= params.max_per_source)
        worth = np.where(open_, np.round(worth, 9), -np.inf)
        pick = int(worth.argmax())
    return out


def demoted(order: list[int], similar: np.ndarray, sources: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each of ``order`` is too like one before it that was kept and comes from another source."""
    out, kept = [], []
    for i in order:
        out.append(any(sources[j] != sources[i] and similar[i, j] > threshold for j in kept))
        if not out[-1]:
            kept.append(i)
    return np.array(out, bool)


def diversify(candidates: DataFrame, query: str = "query_id", key: str = "key", params: Params = Params(), top_k: int | None = None) -> DataFrame:
    """(query, key, stage, position) from candidates (query, key, rank, rrf_raw, source, vector): stage 0 kept, 1 demoted. A query has a few dozen candidates."""
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    k = top_k or params.top_k

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", key]).reset_index(drop=True)
        similar = similarities(rows["vector"].tolist())
        sources = rows["source"].fillna("").to_numpy()
        order = choose(rows["rrf_raw"].to_numpy(float), similar, sources, k, params)
        return pd.DataFrame({query: rows[query].iloc[order], key: rows[key].iloc[order], "stage": demoted(order, similar, sources, params.dedup_similarity).astype("int32"), "position": np.arange(1, len(order) + 1, dtype="int32")})

    return candidates.select(query, key, "rank", "rrf_raw", "source", "vector").groupBy(query).applyInPandas(group, f"{query} {kinds[query]}, {key} {kinds[key]}, stage int, position int")
