"""Sequential re-rankers, per query over its pool: MMR and window de-duplication."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MMRConfig


def mmr_order(relevance: np.ndarray, vectors: list[np.ndarray | None], weight: float, k: int) -> list[int]:
    """Greedy choice of k places: weight * relevance - (1 - weight) * the greatest similarity to a chosen one.

    Similarities below 0 count as 0, those without a vector too; the first of equals wins.
    """
    n = len(relevance)
    width = max([len(v) for v in vectors if v is not None], default=1)
    unit, lengths = np.zeros((n, width)), np.zeros(n, int)
    for i, v in enumerate(vectors):
        if v is not None:
            unit[i, : len(v)], lengths[i] = v, len(v)
    penalty, left, out = np.zeros(n), np.ones(n, bool), []
    for _ in range(min(k, n)):
        score = np.where(left, weight * relevance - (1 - weight) * penalty, -np.inf)
        best = int(np.argmax(score))
        out.append(best)
        left[best] = False
        if lengths[best]:
            # Cosine over the shorter of both lengths, as elsewhere.
            m = np.minimum(lengths, lengths[best])
            inside = np.arange(width)[None, :] < m[:, None]
            a, b = np.where(inside, unit, 0), np.where(inside, unit[best][None, :], 0)
            size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
            penalty = np.maximum(penalty, np.where(size > 0, (a * b).sum(1) / np.where(size > 0, size, 1), 0))
    return out


def mmr(pooled: DataFrame, config: MMRConfig, limit: int, relevance: str = "score", vec: str = "vec", order: str = "rank") -> DataFrame:
    """pooled in MMR order of each query: ``rank`` is set anew, and rows beyond k (or limit) go."""
    k, names = config.k or limit, pooled.columns

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        vectors = [None if v is None else np.asarray(v, float) for v in group.column(vec).to_pylist()]
        chosen = mmr_order(group.column(relevance).to_numpy().astype(float), vectors, config.relevance_weight, k)
        out = group.take(pa.array(chosen))
        place = out.column_names.index("rank")
        return out.set_column(place, "rank", pa.array(range(1, len(chosen) + 1), out.schema.field("rank").type))

    return pooled.select(*names).groupBy("query_id").applyInArrow(run, pooled.schema)


def mmr_index(scored: DataFrame, config: MMRConfig, limit: int, start: int = 256) -> DataFrame:
    """MMR over all rows of (query_id, key, score, vec), exactly, from pools that grow as needed.

    A row's MMR score is at most weight * relevance, so a choice is exact while
    it is not below that bound of the best row outside the pool; queries whose
    choices are not all exact are tried again with pools four times as large.
    """
    from .rank import top_by

    weight, k = config.relevance_weight, config.k or limit
    key = next(c for c in scored.columns if c not in ("query_id", "score", "vec"))
    todo, size, done = scored, start, None
    schema = f"query_id {scored.schema['query_id'].dataType.simpleString()}, {key} {scored.schema[key].dataType.simpleString()}, score double, rank int, exact boolean"

    while True:
        pooled = top_by(todo, "query_id", [F.desc("score"), F.col(key)], size + 1)
        got = pooled.groupBy("query_id").applyInArrow(_mmr_pool(key, size, weight, k), schema).persist()
        finished = got.where("exact").drop("exact")
        done = finished if done is None else done.unionByName(finished)
        open_ = got.where("NOT exact").select("query_id").distinct()
        if open_.isEmpty():
            return done
        todo, size = scored.join(open_, "query_id", "left_semi"), size * 4


def _mmr_pool(key: str, size: int, weight: float, k: int):
    """MMR over the first ``size`` rows of a group, and whether the row after them could change it."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        beyond = float(group.column("score")[size].as_py()) if group.num_rows > size else None
        group = group.slice(0, size)
        relevance = group.column("score").to_numpy().astype(float)
        vectors = [None if v is None else np.asarray(v, float) for v in group.column("vec").to_pylist()]
        chosen = mmr_order(relevance, vectors, weight, k)
        exact = True
        if beyond is not None:
            for n, c in enumerate(chosen):
                worst = max([_cosine(vectors[c], vectors[p]) for p in chosen[:n]], default=0.0)
                exact &= bool(weight * relevance[c] - (1 - weight) * max(0.0, worst) >= weight * beyond)
        out = group.take(pa.array(chosen))
        return pa.table({"query_id": out.column("query_id"), key: out.column(key), "score": pa.array(relevance[chosen]), "rank": pa.array(range(1, len(chosen) + 1), pa.int32()), "exact": pa.array([exact] * len(chosen))})

    return run


def _cosine(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return 0.0
    n = min(len(a), len(b))
    size = np.linalg.norm(a[:n]) * np.linalg.norm(b[:n])
    return float(a[:n] @ b[:n] / size) if size else 0.0


def window_dedup(ranked: DataFrame, limit: int, key: str = "chunk_id", window: str = "window_ids") -> DataFrame:
    """Ranked hits of each query without those that stand in the window of an earlier kept one.

    ``window`` is the array of the keys in a hit's window; at most ``limit``
    hits stay, and ``place`` is their order from 1.
    """
    schema = T.StructType([*ranked.schema.fields, T.StructField("place", T.IntegerType())])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        used: set = set()
        keep = []
        for i, (k, ids) in enumerate(zip(group.column(key).to_pylist(), group.column(window).to_pylist())):
            if len(keep) == limit:
                break
            if k in used:
                continue
            keep.append(i)
            used.update(ids or [k])
        out = group.take(pa.array(keep, pa.int64()))
        return out.append_column("place", pa.array(range(1, len(keep) + 1), pa.int32()))

    return ranked.groupBy("query_id").applyInArrow(run, schema)
