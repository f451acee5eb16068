"""The lexical pool of many queries equals the definition: scores of all pairs, then the best of each query."""

import random

import pytest
from pyspark.sql import functions as F

from passages.operators import pool, rank


@pytest.mark.parametrize("blocks", [(1024, 512, 4096), (7, 3, 4)])
def test_pool_equals_all_pairs(spark, monkeypatch, blocks):
    rng = random.Random(3)
    monkeypatch.setattr(pool, "QUERY_BLOCK", blocks[1])
    texts = [[f"t{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(1, 25))] for _ in range(80)]
    texts += [texts[0]] * 9  # copies tie
    rows = spark.createDataFrame([(f"c{i:02d}", f"s{i % 5}", i, t) for i, t in enumerate(texts)], "chunk_id string, source_id string, ordinal int, terms array<string>")
    posts = rank.postings(rows, "chunk_id", F.col("terms"))
    stats = rank.corpus_stats(rows, "chunk_id", F.col("terms"))
    asked = [(q, f"t{rng.randrange(34)}") for q in range(8) for _ in range(5)] + [(8, "nowhere"), (9, "t1"), (9, "t1")]
    queries = spark.createDataFrame(asked, "query_id long, term string")
    allowed = rows.where("ordinal % 7 <> 3").withColumn("ingest_seq", F.col("ordinal") % 2).select("chunk_id", "ingest_seq", "source_id", "ordinal")
    scored = rank.bm25(posts, stats, queries, "chunk_id").join(allowed, "chunk_id")
    order = [F.round("bm25", rank.PLACES).asc(), F.col("ingest_seq").asc(), F.col("source_id").asc(), F.col("ordinal").asc()]
    of = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.bm25, 8)) for r in df.collect())
    got = pool.pool(posts.repartition(3), stats, queries, allowed, 6)
    assert of(got) == of(rank.top_by(scored, "query_id", order, 6))
    assert not pool.pool(posts, stats, queries.where("query_id = 8"), allowed, 6).count()
