"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

A block of vectors has one list per dimension, sorted by component. For a query
the lists are walked from the end that its sign prefers, to one depth after the
other; vectors met on the way are scored in full, and the walk ends when the
bound, the query's product with the components at that depth, cannot reach the
k-th best score (a bound that equals it goes on, as a smaller id may win the
tie). The k best so far go from block to block, so later blocks often end at
depth 0; what each task finds is merged by query.

Components become floor(256 * x), so scores are integers. They are exact: vectors
whose components are so large that a product could leave the integers of a double
are scored by themselves in whole numbers of any size, batch by batch, and a score
beyond the range of a long is given as the end of that range. Queries go to the workers by broadcast, in blocks of at most ``QUERY_BLOCK`` queries: one
pass over the vectors for each block, never a broadcast that grows.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do rows without an id; only vectors of equal length are compared;
rows that repeat a query's id are not its candidates, rows that repeat another
id are one candidate each; ties go to the smaller id; fewer candidates than k
give fewer rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 8192
VECTOR_BLOCK = 8192
DEPTHS = (0, 16, 128, 1024)


def integers(ids: pa.Array, vectors: pa.Array) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], dict[int, list[tuple[int, list[int]]]]]:
    """By length: ids and floor(256 * x) as float64 of the vectors that take part; and likewise those too large for exact doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors, ids = vectors.combine_chunks(), ids.combine_chunks()
    flat = vectors.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    known = np.isfinite(flat)
    lengths = np.asarray(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    ok = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), bool) & (lengths > 0)
    full = np.concatenate([[0], np.cumsum(~known)])
    ok &= full[first[1:]] == full[first[:-1]]
    ident = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    exact: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    large: dict[int, list[tuple[int, list[int]]]] = {}
    for d in np.unique(lengths[ok]).tolist():
        rows = np.flatnonzero(ok & (lengths == d))
        values = flat[first[rows][:, None] + np.arange(d)]
        # Sums of d products of two such numbers stay below 2**53.
        far = (np.abs(values) > np.sqrt(2.0**53 / d) / 256 - 1).any(1)
        if not far.all():
            exact[d] = ident[rows[~far]], np.floor(values[~far] * 256)
        if far.any():
            # A double times 256 is a double again unless it is too large, and then it is a whole number.
            large[d] = [(i, [int(np.floor(x * 256)) if abs(x) < 1e300 else int(x) * 256 for x in v]) for i, v in zip(ident[rows[far]].tolist(), values[far].tolist())]
    return exact, large


def _whole(exact: tuple[np.ndarray, np.ndarray] | None) -> list[tuple[int, list[int]]]:
    return [(i, [int(x) for x in v]) for i, v in zip(exact[0].tolist(), exact[1].tolist())] if exact else []


def _in_whole_numbers(asked: list[tuple[int, list[int]]], rows: list[tuple[int, list[int]]], k: int) -> Iterator[tuple[int, int, int]]:
    """(query, id, score) of the k best of these rows for each query."""
    end = (1 << 63) - 1
    for q, u in asked:
        scored = ((-max(-end, min(end, sum(x * y for x, y in zip(u, v)))), i) for i, v in rows if i != q)
        yield from ((q, i, -s) for s, i in heapq.nsmallest(k, scored))


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.positive, self.negative = np.maximum(vectors, 0), np.minimum(vectors, 0)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def update(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        kth = self.scores[q, -1]
        near = scores >= kth
        near &= ids != self.ids[q]
        if not near.any():
            return
        ids, scores = np.concatenate([self.found[q], ids[near]]), np.concatenate([self.scores[q], scores[near]])
        if len(scores) > 8 * self.k:
            cut = np.partition(scores, -self.k)[-self.k]
            ids, scores = ids[scores >= cut], scores[scores >= cut]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.found[q] = scores[order], ids[order]

    def block(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """The threshold algorithm over one block."""
        n, d = vectors.shape
        lists = np.argsort(vectors, axis=0, kind="stable")  # per dimension, ascending
        ordered = np.take_along_axis(vectors, lists, axis=0)
        depths = [t for t in DEPTHS if t < n]
        bounds = np.stack([self.positive @ ordered[n - 1 - t] + self.negative @ ordered[t] for t in depths], 1)
        last = np.zeros(len(self.ids), np.int64)
        live = np.flatnonzero(bounds[:, 0] >= self.scores[:, -1])
        seen = np.zeros(n, bool)
        rest: list[int] = []
        for q in live.tolist():
            up = self.vectors[q] >= 0
            seen[:] = False
            for step, t in enumerate(depths[1:], 1):
                near = np.concatenate([lists[n - t :, up].ravel(), lists[:t, ~up].ravel()])
                fresh = np.unique(near[~seen[near]])
                if len(fresh) > n // 2:  # most of the block: score what is left in one product
                    rest.append(q)
                    break
                seen[fresh] = True
                self.update(q, ids[fresh], vectors[fresh] @ self.vectors[q])
                last[q] = step
                if bounds[q, step] < self.scores[q, -1]:
                    break
            else:
                rest.append(q)
        for a in range(0, len(rest), 128):
            part = rest[a : a + 128]
            scores = self.vectors[part] @ vectors.T
            for row, q in enumerate(part):
                best = self.scores[q, -1]
                at = np.flatnonzero(scores[row] >= best)
                # Vectors that the walk has scored may come again: they are told apart by place, not by id.
                if last[q]:
                    up = self.vectors[q] >= 0
                    t = depths[last[q]]
                    walked = np.concatenate([lists[n - t :, up].ravel(), lists[:t, ~up].ravel()])
                    at = np.setdiff1d(at, walked)
                self.update(q, ids[at], scores[row, at])


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query; both have vec_id and embedding."""
    spark = rows.sparkSession
    asked = queries.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    blocks = max(1, -(-asked.count() // (query_block // 2)))
    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        got = part.toArrow()
        sent = spark.sparkContext.broadcast(integers(got.column(0), got.column(1)))

        def search(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names = ["query_id", "vec_id", "score"]
            asked, asked_large = sent.value
            best = {d: Best(ids, vectors, k) for d, (ids, vectors) in asked.items()}
            for batch in batches:
                exact, large = integers(batch.column(0), batch.column(1))
                for d, (ids, vectors) in exact.items():
                    if d in best:
                        for a in range(0, len(ids), VECTOR_BLOCK):
                            best[d].block(ids[a : a + VECTOR_BLOCK], vectors[a : a + VECTOR_BLOCK])
                found = [x for d, v in large.items() for x in _in_whole_numbers(_whole(asked.get(d)) + asked_large.get(d, []), v, k)]
                found += [x for d, q in asked_large.items() for x in _in_whole_numbers(q, _whole(exact.get(d)), k)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=names)
            for x in best.values():
                q, j = np.nonzero(np.isfinite(x.scores))
                yield pa.RecordBatch.from_arrays([pa.array(x.ids[q]), pa.array(x.found[q, j]), pa.array(x.scores[q, j].astype(np.int64))], names=names)

        one = rows.select("vec_id", "embedding").mapInArrow(search, "query_id long, vec_id long, score long")
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
