"""Exact nearest vectors of many queries, and MMR over all vectors: blocks of vectors against blocks of queries.

Vectors are packed into blocks where they are read. A task meets its blocks with
a broadcast block of queries in matrix products and keeps the best rows of each
query only, so neither pairs nor vectors are shuffled. The product only finds
candidates: their scores are summed anew row by row, so that equal vectors tie
wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MMRConfig
from ..session import scratch_dir
from .rank import PLACES, top_by

#: Vectors of a packed block, queries of one broadcast, and queries of one matrix product.
BLOCK, QUERY_BLOCK, STEP = 4096, 4096, 256
#: Products and row sums differ by less.
SLACK = 1e-8
#: Stands for a score that is no number; such rows come first, as in a sort.
NAN = 2.0


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, vec) in blocks: keys, lengths (-1: no vector, or one with a null), and components as doubles."""
    n = 0
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            keys, vec = batch.column(0).slice(a, BLOCK), batch.column(1).slice(a, BLOCK)
            flat = vec.flatten()
            if vec.null_count or flat.null_count:
                lists = [None if v is None or None in v else v for v in vec.to_pylist()]
                sizes = np.array([-1 if v is None else len(v) for v in lists], np.int64)
                values = np.array([x for v in lists if v is not None for x in v], np.float64)
            else:
                sizes, values = pc.list_value_length(vec).to_numpy(zero_copy_only=False).astype(np.int64), flat.to_numpy(zero_copy_only=False).astype(np.float64)
            listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            yield pa.RecordBatch.from_arrays([pa.array([n]), listed, pa.array([sizes.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["n", "keys", "sizes", "vals"])
            n += 1


def packed(rows: DataFrame, key: str, vec: str, prefix: str) -> DataFrame:
    """Blocks of rows under names with a prefix; the first column numbers those of a task."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, vec).mapInArrow(_pack, f"n long, keys array<{kind}>, sizes binary, vals binary").toDF(*[prefix + c for c in ("n", "keys", "sizes", "vals")])


class Side:
    """Vectors of a block: rows of a matrix filled up with zeros, their lengths, and the rows of each length."""

    def __init__(self, sizes: bytes, values: bytes) -> None:
        self.sizes, flat = np.frombuffer(sizes, np.int64), np.frombuffer(values, np.float64)
        own = np.maximum(self.sizes, 0)
        width = int(own.max(initial=0))
        if (own == width).all():
            self.full = flat.reshape(len(own), width)
        else:
            self.full = np.zeros((len(own), width))
            self.full[np.arange(width)[None, :] < own[:, None]] = flat
        self.groups = [(int(n), np.flatnonzero(own == n)) for n in np.unique(own)]

    def row(self, i: int) -> np.ndarray | None:
        return None if self.sizes[i] < 0 else self.full[i, : self.sizes[i]].copy()

    def units(self, at: np.ndarray, n: int) -> np.ndarray:
        """The first n components of rows, scaled to length 1, or zeros."""
        x = self.full[at, :n]
        size = np.sqrt((x * x).sum(1))[:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(size == 0, 0.0, x / size)


def pair_cosines(a: Side, i: np.ndarray, b: Side, j: np.ndarray) -> np.ndarray:
    """Cosine of row i of a and row j of b over the shorter length, each pair by itself; 0 if a side has no length."""
    out = np.empty(len(i))
    width = min(a.full.shape[1], b.full.shape[1])
    for s in range(0, len(i), 1 << 15):
        p, q = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
        x, y = a.full[p, :width], b.full[q, :width]
        least = np.minimum(a.sizes[p], b.sizes[q])
        if (least < width).any():
            inside = np.arange(width)[None, :] < least[:, None]
            x, y = np.where(inside, x, 0.0), np.where(inside, y, 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            size = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
            got = np.where(size == 0, 0.0, (x * y).sum(1) / size)
        out[s : s + (1 << 15)] = np.where(np.isnan(got), NAN, got)
    return out


def products(q: Side, v: Side) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of q, rows of v, matrix of cosines) that together make up all pairs."""
    for n, at in v.groups:
        made = {}
        for m, asked in q.groups:
            w = min(n, m)
            if w not in made:
                made[w] = v.units(at, w).T
            unit = q.units(asked, w)
            for a in range(0, len(asked), STEP):
                s = unit[a : a + STEP] @ made[w]
                yield asked[a : a + STEP], at, np.nan_to_num(s, copy=False, nan=NAN)


class Best:
    """The k best rows of each of n queries so far, by value, then by the rounded score, then by the smaller key."""

    def __init__(self, n: int, k: int, kind: pa.DataType) -> None:
        self.k, self.query, self.score, self.value = k, np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        self.keys, self.rows, self.worst = pa.array([], kind), [], np.full(n, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, value: np.ndarray, keys: pa.Array, side: Side | None = None, rows: np.ndarray | None = None) -> None:
        if not len(query):
            return
        query, score, value = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.value, value)))
        keys = pa.concat_arrays([self.keys, keys])
        code = pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        order = np.lexsort((code, -np.round(score, PLACES), -value, query))
        start = np.flatnonzero(np.concatenate([[True], np.diff(query[order]) != 0]))
        place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        kept, last = order[place < self.k], order[place == self.k - 1]
        self.query, self.score, self.value, self.keys = query[kept], score[kept], value[kept], keys.take(pa.array(kept))
        self.worst[query[last]] = value[last]
        if rows is not None:
            old = len(query) - len(rows)
            self.rows = [self.rows[i] if i < old else side.row(rows[i - old]) for i in kept.tolist()]


def _blocks(spark, query_vectors: DataFrame, block: int) -> list[DataFrame]:
    """The queries, a stated set, in parts of about ``block``."""
    n = max(1, -(-query_vectors.count() // block))
    return [query_vectors if n == 1 else query_vectors.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) for b in range(n)]


def _number(score: np.ndarray) -> pa.Array:
    return pa.array(np.where(score == NAN, np.nan, score))


def nearest(rows: DataFrame, query_vectors: DataFrame, key: str, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, score, rank): the k rows of (key, vec) with the greatest cosine to each (query_id, query_vec), ties to the smaller key."""
    kinds = [query_vectors.schema["query_id"].dataType.simpleString(), rows.schema[key].dataType.simpleString()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[pa.Array, Side, Best]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                number, keys = batch.column(4)[r].as_py(), batch.column(1)[r].values
                if number not in held:
                    ids = batch.column(5)[r].values
                    held[number] = ids, Side(batch.column(6)[r].as_py(), batch.column(7)[r].as_py()), Best(len(ids), k, keys.type)
                _, q, best = held[number]
                v, found = Side(batch.column(2)[r].as_py(), batch.column(3)[r].as_py()), []
                for asked, at, s in products(q, v):
                    bound = best.worst[asked]
                    if k < s.shape[1] and np.isneginf(bound).any():
                        bound = np.maximum(bound, np.partition(s, -k, axis=1)[:, -k])
                    i, j = np.nonzero(s >= bound[:, None] - SLACK)
                    score = pair_cosines(q, asked[i], v, at[j])
                    found.append((asked[i], score, at[j]))
                    if sum(len(f[0]) for f in found) > 1 << 20:
                        _met(best, found, keys)
                _met(best, found, keys)
        for ids, _, best in held.values():
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.query)), best.keys, _number(best.score)], names=["query_id", key, "score"])

    out, blocks = None, packed(rows, key, "vec", "v_")
    for part in _blocks(rows.sparkSession, query_vectors, block):
        asked = packed(part.select("query_id", "query_vec").repartition(1), "query_id", "query_vec", "q_")
        one = blocks.crossJoin(F.broadcast(asked)).mapInArrow(run, f"query_id {kinds[0]}, {key} {kinds[1]}, score double")
        out = one if out is None else out.unionByName(one)
    return top_by(out, "query_id", [F.round("score", PLACES).desc(), F.col(key).asc()], k)


def _met(best: Best, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], keys: pa.Array) -> None:
    if found:
        query, score, at = (np.concatenate(x) for x in zip(*found))
        best.add(query, score, np.round(score, PLACES), keys.take(pa.array(at)))
        found.clear()


def mmr_nearest(rows: DataFrame, query_vectors: DataFrame, key: str, config: MMRConfig, limit: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, score, rank): MMR over all rows of (key, vec), exactly, one pass over the rows for each place.

    The first place has the greatest score. For the others a row's value is at
    most weight * score, so only rows whose bound reaches the best value yet are
    compared with what is chosen. A task sends one row for each query, and what a
    round chose is written to the shared folder. A key is chosen once.
    """
    spark, weight, k = rows.sparkSession, config.relevance_weight, config.k or limit
    kinds = [query_vectors.schema["query_id"].dataType.simpleString(), rows.schema[key].dataType.simpleString()]

    def chooser(nth: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple] = {}
            for batch in batches:
                for r in range(batch.num_rows):
                    get = lambda c: batch.column(c)[r]  # noqa: B023, E731
                    keys, number = get(1).values, get(4).as_py()
                    if number not in held:
                        ids = get(5).values
                        chosen = [(get(c + 1).values, Side(get(c + 2).as_py(), get(c + 3).as_py())) for c in range(8, 8 + 4 * nth, 4)]
                        held[number] = ids, Side(get(6).as_py(), get(7).as_py()), chosen, Best(len(ids), 1, keys.type)
                    _, q, chosen, best = held[number]
                    v = Side(get(2).as_py(), get(3).as_py())
                    code = pa.concat_arrays([keys, *(c for c, _ in chosen)]).dictionary_encode(null_encoding="encode").indices.to_numpy().reshape(-1)
                    own, gone = code[: len(keys)], code[len(keys) :].reshape(nth, len(q.sizes))

                    def take(i: np.ndarray, j: np.ndarray) -> None:
                        """Pairs of a query and a row: the best row of each query, if it is better than before."""
                        free = ~(gone[:, i] == own[j]).any(0)
                        i, j = i[free], j[free]
                        score = pair_cosines(q, i, v, j)
                        near = np.zeros(len(i))
                        for _, c in chosen:
                            near = np.maximum(near, pair_cosines(c, i, v, j))
                        value = np.round(score, PLACES) if not nth else weight * score - (1 - weight) * near
                        best.add(i, score, value, keys.take(pa.array(j)), v, j)

                    for asked, at, s in products(q, v):
                        upper = weight * s if nth else s
                        few = min(nth + 1, s.shape[1])
                        first = np.argpartition(s, -few, axis=1)[:, -few:]  # one of them is not chosen yet
                        worth = np.take_along_axis(upper, first, 1).max(1) >= best.worst[asked] - SLACK
                        take(np.repeat(asked[worth], few), at[first[worth].ravel()])
                        i, j = np.nonzero(upper >= best.worst[asked][:, None] - SLACK)
                        take(asked[i], at[j])
            for ids, _, _, best in held.values():
                vec = pa.array([None if x is None else np.asarray(x) for x in best.rows], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.query)), best.keys, _number(best.score), pa.array(best.value), vec], names=["query_id", key, "score", "value", "vec"])

        return run

    at, blocks, done = scratch_dir(spark, "mmr"), packed(rows, key, "vec", "v_"), None
    parts = _blocks(spark, query_vectors, block)
    schema = f"query_id {kinds[0]}, {key} {kinds[1]}, score double, value double, vec array<double>"
    for nth in range(k):
        out = None
        for part in parts:
            asked = _with_chosen(part.select("query_id", "query_vec"), done, key, nth)
            one = blocks.crossJoin(F.broadcast(asked)).mapInArrow(chooser(nth), schema)
            out = one if out is None else out.unionByName(one)
        made = top_by(out, "query_id", [F.col("value").desc(), F.round("score", PLACES).desc(), F.col(key).asc()], 1).withColumn("rank", F.lit(nth + 1))
        made.write.parquet(f"{at}/{nth}")
        made = spark.read.schema(made.schema).parquet(f"{at}/{nth}")
        if nth and made.isEmpty():
            break
        done = made if done is None else done.unionByName(made)
    return done.select("query_id", key, "score", "rank")


def _with_chosen(asked: DataFrame, done: DataFrame | None, key: str, nth: int) -> DataFrame:
    """One packed row of queries in the order of their ids, with a packed part for each place that is chosen."""
    if not nth:
        return packed(asked.repartition(1), "query_id", "query_vec", "q_")
    flat = asked
    for n in range(nth):
        flat = flat.join(done.where(F.col("rank") == n + 1).select("query_id", F.col(key).alias(f"k{n}"), F.col("vec").alias(f"c{n}")), "query_id")
    kinds = [flat.schema[c].dataType.simpleString() for c in ("query_id", "k0")]
    columns = ["query_id", "query_vec", *[c for n in range(nth) for c in (f"k{n}", f"c{n}")]]
    names = [f"{p}{c}" for p in ["q_", *[f"c{n}_" for n in range(nth)]] for c in ("n", "keys", "sizes", "vals")]
    types = ["long", f"array<{kinds[0]}>", "binary", "binary"] + ["long", f"array<{kinds[1]}>", "binary", "binary"] * nth

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            for a in range(0, batch.num_rows, BLOCK):
                made = [next(_pack([pa.RecordBatch.from_arrays([batch.column(c).slice(a, BLOCK), batch.column(c + 1).slice(a, BLOCK)], names=["k", "v"])])) for c in range(0, 2 + 2 * nth, 2)]
                number = pa.array([n * (1 << 32) + a])
                yield pa.RecordBatch.from_arrays([x for m in made for x in (number, *m.columns[1:])], names=names)

    return flat.select(*columns).repartition(1).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types)))
