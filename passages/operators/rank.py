"""Inverted index tables, BM25 for many queries at once, fusion, and top-k.

Scores are negative, lower is better. The statistics (rows, mean length,
document frequencies) are those of the whole index; filters only remove rows
afterwards, so they never change a score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.once import let, once

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Ties are decided on scores rounded so far, as sums differ in their last digits between plans.
PLACES = 9


def term_groups(placed: Column) -> Column:
    """Array of (term, spots) of the distinct terms of an array of (term, spot), by sorting it in the row: no shuffle."""

    def cut(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i)["term"] != F.get(x, i - 1)["term"]))
        return F.struct(x.alias("placed"), starts.alias("starts"))

    def grouped(y: Column) -> Column:
        def one(a: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(y["starts"], k + 1), F.size(y["placed"]))
            return F.struct(F.get(y["placed"], a)["term"].alias("term"), F.transform(F.sequence(a, stop - 1), lambda i: F.get(y["placed"], i)["spot"]).alias("spots"))

        return F.transform(y["starts"], one)

    return F.when(F.size(placed) > 0, let(let(F.sort_array(placed), cut), grouped))


def term_counts(terms: Column) -> Column:
    """Array of (term, tf) of the distinct terms of an array, likewise."""

    def cut(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1)))
        return F.struct(x.alias("terms"), starts.alias("starts"))

    def counted(y: Column) -> Column:
        return F.transform(y["starts"], lambda a, k: F.struct(F.get(y["terms"], a).alias("term"), (F.coalesce(F.get(y["starts"], k + 1), F.size(y["terms"])) - a).alias("tf")))

    return F.when(F.size(terms) > 0, let(let(F.sort_array(terms), cut), counted))


def postings(rows: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf, dl): one row for each distinct term of a row.

    Counting happens inside the row, so building the table needs no shuffle.
    """
    listed = rows.select(key, once(terms.alias("terms"))).select(key, F.size("terms").alias("dl"), once(term_counts(F.col("terms")).alias("counts")))
    return listed.select(key, "dl", F.inline("counts")).select(key, "term", "tf", "dl")


def corpus_stats(rows: DataFrame, key: str, terms: Column) -> DataFrame:
    """One row (n, avgdl) over all rows, those without a term included."""
    return rows.select(F.size(terms).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_df(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def bm25_term(tf: Column, dl: Column, avgdl: Column, weight: Column) -> Column:
    """A term's share of the score."""
    return -weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(posts: DataFrame, stats: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(query_id, key, bm25) of every row that holds a term of the query; queries is (query_id, term).

    A term that a query repeats counts as often. Query terms restrict the
    postings before anything is summed; frequencies of the terms asked for are
    counted once and met with them. One row of stats is broadcast.
    """
    asked = queries.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    hits = posts.join(asked.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weighted = asked.join(df, "term").crossJoin(F.broadcast(stats))
    score = F.col("times") * bm25_term(F.col("tf"), F.col("dl"), F.col("avgdl"), idf(F.col("n"), F.col("df")))
    return hits.join(weighted, "term").groupBy("query_id", key).agg(F.sum(score).alias("bm25"))


def top_by(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with ``rank`` from 1; partial limits come before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def pool_size(limit: int) -> int:
    """Candidates that are fetched for so many results."""
    return max(6 * limit, 60)


def pool(scored: DataFrame, limit: int, key: str) -> DataFrame:
    """The candidate pool of each query by score, ties by key."""
    return top_by(scored, "query_id", [F.round("bm25", PLACES).asc(), F.col(key).asc()], pool_size(limit))


def fuse(pooled: DataFrame, weight: float = 0.5, bm25_name: str = "bm25", cosine_name: str = "cosine") -> DataFrame:
    """pooled with ``score``: the pool's scaled BM25 and the cosine in shares; without a cosine BM25 alone."""
    w = Window.partitionBy("query_id")
    low, high = F.min(bm25_name).over(w), F.max(bm25_name).over(w)
    lexical = F.when(high == low, F.lit(1.0)).otherwise((high - F.col(bm25_name)) / (high - low))
    semantic = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(cosine_name) + 1) / 2))
    return pooled.withColumn("score", F.when(F.col(cosine_name).isNull(), lexical).otherwise(weight * lexical + (1 - weight) * semantic))
