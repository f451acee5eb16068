"""The lexical candidate pool of many queries: blocks of chunks against blocks of queries.

Postings of the terms asked for are dealt out by chunk once, whatever the number
of queries. A task packs them into blocks of chunks, scores a block for all
queries of a broadcast block in one product, and keeps the best of each query;
scores of pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .rank import B, K1, PLACES, idf, top_by

#: Chunks of a block, queries of a broadcast block, and terms of one product.
CHUNK_BLOCK, QUERY_BLOCK, TERMS = 1024, 512, 4096
SLACK = 1e-8


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, and of a size that plans know."""
    at = scratch_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def pool(posts: DataFrame, stats: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, bm25, rank), written: the k best chunks of each query by BM25.

    ``posts`` has (chunk_id, term, tf, dl), ``queries`` (query_id, term), and
    ``chunks`` (chunk_id, ingest_seq, source_id, ordinal) of those that may be
    found: ties go to the least of these. Frequencies count all postings.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = settled(queries.groupBy("query_id", "term").agg(F.count("*").alias("times")), "asked")
    # Distinct terms of the questions only are numbered in one task.
    terms = settled(asked.select("term").distinct().withColumn("t", F.row_number().over(Window.orderBy("term")) - 1), "terms")
    hits = posts.join(F.broadcast(terms), "term").select("chunk_id", "t", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))
    df = hits.groupBy("t").agg(F.count("*").alias("df"))
    weighted = asked.join(F.broadcast(terms), "term").join(df, "t").crossJoin(F.broadcast(stats))
    weighted = settled(weighted.select("query_id", "t", (F.col("times") * idf(F.col("n"), F.col("df"))).alias("w"), "avgdl"), "weights")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    listed = chunks.select("chunk_id", *none("int", "t", "tf", "dl"), F.col("ingest_seq").cast("long").alias("ingest_seq"), "source_id", "ordinal")
    rows = hits.select("chunk_id", "t", "tf", "dl", *none("long", "ingest_seq"), *none("string", "source_id"), *none("int", "ordinal")).unionByName(listed)
    blocks = rows.repartition("chunk_id").sortWithinPartitions("chunk_id").mapInArrow(_blocks, _BLOCK)
    n = max(1, -(-weighted.select("query_id").distinct().count() // QUERY_BLOCK))
    out = None
    for b in range(n):
        part = weighted if n == 1 else weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b)
        lists = part.groupBy("query_id").agg(F.collect_list("t").alias("t"), F.collect_list("w").alias("w"), F.first("avgdl").alias("avgdl"))
        packed = lists.groupBy().agg(F.collect_list(F.struct("query_id", "t", "w", "avgdl")).alias("asked"))
        one = blocks.crossJoin(F.broadcast(packed)).mapInArrow(_scored(k), f"query_id {kind}, chunk_id string, bm25 double, ingest_seq long, source_id string, ordinal int")
        out = one if out is None else out.unionByName(one)
    order = [F.round("bm25", PLACES).asc(), F.col("ingest_seq").asc(), F.col("source_id").asc(), F.col("ordinal").asc()]
    return settled(top_by(out, "query_id", order, k).select("query_id", "chunk_id", "bm25", "rank"), "pool")


_BLOCK = "chunk_id array<string>, source_id array<string>, ingest_seq array<bigint>, ordinal array<int>, dl array<int>, start array<int>, t array<int>, tf array<int>"


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their chunks to blocks of chunks that may be found and have a hit."""

    def made(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = rows.column("chunk_id").combine_chunks()
        code = ids.dictionary_encode().indices.to_numpy()
        hit = rows.column("t").is_valid().to_numpy()
        at = np.full(int(code[-1]) + 1 if len(code) else 0, -1)
        at[code[~hit]] = np.flatnonzero(~hit)  # where a chunk's own row is
        kept = np.flatnonzero(hit)[at[code[hit]] >= 0]
        order = kept[np.argsort(code[kept], kind="stable")]
        t, tf, dl = (rows.column(c).combine_chunks().fill_null(0).to_numpy()[order] for c in ("t", "tf", "dl"))
        first = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0])) if len(order) else np.zeros(0, int)
        own, stops = at[code[order[first]]], np.append(first, len(order))
        for a in range(0, len(first), CHUNK_BLOCK):
            b = min(a + CHUNK_BLOCK, len(first))
            lo, hi = stops[a], stops[b]
            cells = [*(rows.column(c).combine_chunks().take(pa.array(own[a:b])) for c in ("chunk_id", "source_id", "ingest_seq", "ordinal")), pa.array(dl[first[a:b]], pa.int32()), pa.array(stops[a : b + 1] - lo, pa.int32()), pa.array(t[lo:hi], pa.int32()), pa.array(tf[lo:hi], pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cells], names=["chunk_id", "source_id", "ingest_seq", "ordinal", "dl", "start", "t", "tf"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < 1 << 18:
            continue
        rows = pa.Table.from_batches(held)
        ids = rows.column("chunk_id")
        whole = size - int(pc.sum(pc.equal(ids, ids[size - 1])).as_py())  # the last chunk may go on
        yield from made(rows.slice(0, whole))
        held = rows.slice(whole).combine_chunks().to_batches()
        size -= whole
    if size:
        yield from made(pa.Table.from_batches(held))


def _scored(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for r in range(batch.num_rows):
                if state is None:
                    state = _Asked(batch.column(8)[r].values, k)
                state.meet(*[batch.column(c)[r].values for c in range(8)])
        if state is not None:
            yield from state.out()

    return run


class _Asked:
    """A block of queries, and the best chunks of each so far."""

    def __init__(self, asked: pa.StructArray, k: int) -> None:
        self.ids, self.k, n = asked.field("query_id"), k, len(asked)
        lists = asked.field("t")
        query, t, w = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy(), asked.field("w").flatten().to_numpy()
        self.avgdl = asked.field("avgdl")[0].as_py()
        self.terms, at = np.unique(t, return_inverse=True)
        self.weights, self.n = [], n
        for a in range(0, len(self.terms), TERMS):
            inside = (at >= a) & (at < a + TERMS)
            self.weights.append((at[inside] - a, query[inside], w[inside], min(TERMS, len(self.terms) - a)))
        self.dense = None
        self.query, self.score, self.ingest, self.ordinal = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.source = self.chunk = pa.array([], pa.string())
        self.worst = np.full(n, 0.0)

    def _weights(self, s: int) -> np.ndarray:
        if self.dense is not None:
            return self.dense
        t, query, w, size = self.weights[s]
        made = np.zeros((size, self.n))
        made[t, query] = w
        if len(self.weights) == 1:
            self.dense = made
        return made

    def meet(self, chunk, source, ingest, ordinal, dl, start, t, tf) -> None:
        dl, tf = dl.to_numpy().astype(float), tf.to_numpy().astype(float)
        row = np.repeat(np.arange(len(dl)), np.diff(start.to_numpy()))
        share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / self.avgdl))
        t = t.to_numpy()
        at = np.minimum(np.searchsorted(self.terms, t), len(self.terms) - 1)
        here = self.terms[at] == t
        good = np.zeros((len(dl), self.n))
        for s, (_, _, _, size) in enumerate(self.weights):
            inside = here & (at >= s * TERMS) & (at < s * TERMS + size)
            x = np.zeros((len(dl), size))
            x[row[inside], at[inside] - s * TERMS] = share[inside]
            good += x @ self._weights(s)
        good = good.T
        bound = self.worst
        if self.k < len(dl) and (bound == 0).any():
            bound = np.maximum(bound, np.partition(good, -self.k, axis=1)[:, -self.k])
        query, j = np.nonzero((good >= bound[:, None] - SLACK) & (good > 0))
        if len(query):
            self._add(query, good[query, j], ingest.to_numpy()[j], source.take(pa.array(j)), ordinal.to_numpy()[j], chunk.take(pa.array(j)))

    def _add(self, query, score, ingest, source, ordinal, chunk) -> None:
        query, score, ingest, ordinal = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.ingest, ingest), (self.ordinal, ordinal)))
        source, chunk = pa.concat_arrays([self.source, source]), pa.concat_arrays([self.chunk, chunk])
        name = pc.rank(source, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        rounded = np.round(score, PLACES)
        order = np.lexsort((ordinal, name, ingest, -rounded, query))
        first = np.flatnonzero(np.concatenate([[True], np.diff(query[order]) != 0]))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        kept, last = order[place < self.k], order[place == self.k - 1]
        self.query, self.score, self.ingest, self.ordinal = query[kept], score[kept], ingest[kept], ordinal[kept]
        self.source, self.chunk = source.take(pa.array(kept)), chunk.take(pa.array(kept))
        self.worst[query[last]] = rounded[last]

    def out(self) -> Iterator[pa.RecordBatch]:
        cells = [self.ids.take(pa.array(self.query)), self.chunk, pa.array(-self.score), pa.array(self.ingest), self.source, pa.array(self.ordinal, pa.int32())]
        yield pa.RecordBatch.from_arrays(cells, names=["query_id", "chunk_id", "bm25", "ingest_seq", "source_id", "ordinal"])
