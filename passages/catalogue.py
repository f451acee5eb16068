"""The registered queries of the engine's own operators, over the driver's tables, and their SQL.

Documents stand for sources, pages for HTML inputs, embeddings for vectors,
benchmark for questions, and conversations for chunks (source = conv_id,
ordinal = turn). Floats are rounded to 6 places in both engines.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import grounding as G
from .functions import text as X
from .functions.once import once
from .functions.vector import cosine, from_blob, to_blob
from .operators import chunking, match, nearest, rank, rerank, windows
from .plans import evaluate
from .plans.retrieve import score_vectors
from .session import scratch_dir, spread
from .schema import AnswerPolicy, ChunkingConfig, MMRConfig, RetrievalFilter

Query = Callable[[SparkSession, str], DataFrame]

TERMS = ("thation", "nicht", "que")
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


# Lexical ranking

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{Co}_-]+')"
_INDEX = f"""
tok AS (SELECT doc_id, lang, {_TOKENS} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, df, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS w FROM dfs, st)
"""
_SCORE = "-w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def _terms_of(rows: DataFrame) -> Column:
    return X.plain_tokens(F.coalesce(F.col("text"), F.lit("")))


def _lexical(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    docs = spread(_documents(spark, sf_dir).select("doc_id", "text"))
    posts = rank.postings(docs, "doc_id", _terms_of(docs))
    return rank.bm25(posts, rank.corpus_stats(docs, "doc_id", _terms_of(docs)), asked, "doc_id")


def _one_query(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, t) for t in TERMS], "query_id long, term string")


_IN = ", ".join(f"'{t}'" for t in TERMS)


@_query(
    "bm25_topk",
    f"""WITH {_INDEX}, s AS (SELECT doc_id, sum({_SCORE}) AS s FROM post JOIN idf USING (term), st WHERE term IN ({_IN}) GROUP BY doc_id)
    SELECT doc_id, CAST(row_number() OVER (ORDER BY round(s, 9), doc_id) AS INTEGER) AS rank, round(s, 6) AS score FROM s QUALIFY rank <= 10""",
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of a query of three terms."""
    scored = _lexical(spark, sf_dir, _one_query(spark))
    top = rank.top_by(scored, "query_id", [F.round("bm25", rank.PLACES).asc(), F.col("doc_id").asc()], 10)
    return top.select("doc_id", "rank", F.round("bm25", 6).alias("score"))


@_query(
    "bm25_batch_topk",
    f"""WITH {_INDEX}, q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
    s AS (SELECT query_id, doc_id, sum({_SCORE}) AS s FROM q JOIN post USING (term) JOIN idf USING (term), st GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9), doc_id) AS INTEGER) AS rank, round(s, 6) AS score FROM s QUALIFY rank <= 10""",
)
def bm25_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark text, in one job."""
    bench = _table(spark, sf_dir, "benchmark")
    asked = bench.select(F.col("item_id").alias("query_id"), F.explode(_terms_of(bench)).alias("term")).distinct()
    top = rank.top_by(_lexical(spark, sf_dir, asked), "query_id", [F.round("bm25", rank.PLACES).asc(), F.col("doc_id").asc()], 10)
    return top.select("query_id", "doc_id", "rank", F.round("bm25", 6).alias("score"))


@_query(
    "bm25_filtered_lang",
    f"""WITH {_INDEX}, s AS (SELECT doc_id, sum({_SCORE}) AS s FROM post JOIN idf USING (term), st WHERE term IN ({_IN}) GROUP BY doc_id)
    SELECT doc_id, CAST(row_number() OVER (ORDER BY round(s, 9), doc_id) AS INTEGER) AS rank, round(s, 6) AS score
    FROM s JOIN (SELECT doc_id FROM documents WHERE lang = 'de') USING (doc_id) QUALIFY rank <= 10""",
)
def bm25_filtered_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter removes rows after scoring; statistics stay those of the whole index."""
    german = _documents(spark, sf_dir).where("lang = 'de'").select("doc_id")
    scored = _lexical(spark, sf_dir, _one_query(spark)).join(german, "doc_id", "left_semi")
    top = rank.top_by(scored, "query_id", [F.round("bm25", rank.PLACES).asc(), F.col("doc_id").asc()], 10)
    return top.select("doc_id", "rank", F.round("bm25", 6).alias("score"))


@_query("term_df_stats", f"WITH {_INDEX} SELECT term, CAST(df AS BIGINT) AS df, round(w, 6) AS idf FROM idf")
def term_df_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(_documents(spark, sf_dir).select("doc_id", "text"))
    posts = rank.postings(docs, "doc_id", _terms_of(docs))
    stats = rank.corpus_stats(docs, "doc_id", _terms_of(docs))
    return rank.term_df(posts).crossJoin(F.broadcast(stats)).select("term", "df", F.round(rank.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@_query("corpus_stats", f"WITH {_INDEX} SELECT CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return rank.corpus_stats(docs, "doc_id", _terms_of(docs)).select("n", F.round("avgdl", 6).alias("avgdl"))


def _matched(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    docs = spread(_documents(spark, sf_dir).select("doc_id", "text", "source"))
    columns = {"content": _terms_of(docs), "source": X.plain_tokens(F.coalesce(F.col("source"), F.lit("")))}
    return match.search(docs, "doc_id", columns, expression).select("doc_id", F.round("bm25", 6).alias("score"))


def _match_sql(counts: list[str], where: str) -> str:
    """SQL of a match over token lists t (content) and u (source): counts of the scored phrases, and the condition."""
    tf = ", ".join(f"{c} AS f{i}" for i, c in enumerate(counts))
    df = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS d{i}" for i in range(len(counts)))
    score = " + ".join(f"-(CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) ELSE 1e-6 END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(counts)))
    return f"""WITH tok AS (SELECT doc_id, {_TOKENS} AS t, regexp_extract_all(lower(coalesce(source, '')), '[\\p{{L}}\\p{{N}}\\p{{Co}}_-]+') AS u FROM documents),
    c AS (SELECT doc_id, len(t) + len(u) AS dl, {tf}, {where} AS hit FROM tok),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c)
    SELECT doc_id, round({score}, 6) AS score FROM c, st WHERE hit"""


def _term_sql(term: str) -> str:
    return f"(len(list_filter(t, lambda x: x = '{term}')) + len(list_filter(u, lambda x: x = '{term}')))"


_HAS = "(list_contains(t, '{0}') OR list_contains(u, '{0}'))"
_PREFIX = "(len(list_filter(t, lambda x: starts_with(x, 'thati'))) + len(list_filter(u, lambda x: starts_with(x, 'thati'))))"
_PHRASE = "len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the'))"
_MATCHES = {
    "match_and": ("the AND nicht", _match_sql([_term_sql("the"), _term_sql("nicht")], _HAS.format("the") + " AND " + _HAS.format("nicht"))),
    "match_or": ("nicht OR que", _match_sql([_term_sql("nicht"), _term_sql("que")], _HAS.format("nicht") + " OR " + _HAS.format("que"))),
    "match_not": ("the NOT of", _match_sql([_term_sql("the")], _HAS.format("the") + " AND NOT " + _HAS.format("of"))),
    "match_prefix": ("thati*", _match_sql([_PREFIX], _PREFIX + " > 0")),
    "match_phrase": ('"of the"', _match_sql([_PHRASE], _PHRASE + " > 0")),
    "match_column": ("source:src1", _match_sql(["len(list_filter(u, lambda x: x = 'src1'))"], "list_contains(u, 'src1')")),
    "match_group": ("(nicht OR que) AND der", _match_sql([_term_sql("nicht"), _term_sql("que"), _term_sql("der")], f"({_HAS.format('nicht')} OR {_HAS.format('que')}) AND {_HAS.format('der')}")),
}
for _name, (_expression, _sql) in _MATCHES.items():
    _query(_name, _sql)(lambda spark, sf_dir, _expression=_expression: _matched(spark, sf_dir, _expression))


_NEAR_AT = "len(list_filter(range(1, len({0}) + 1), lambda i: {0}[i] = 'the' AND list_contains(list_slice({0}, greatest(1, i - 4), i + 4), 'of'))) > 0"


@_query("match_near", _match_sql([_term_sql("the"), _term_sql("of")], f"({_NEAR_AT.format('t')}) OR ({_NEAR_AT.format('u')})"))
def match_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two terms with three tokens between them at most, in one column; tests compare it with another full-text engine."""
    return _matched(spark, sf_dir, "NEAR(the of, 3)")


# Vectors, fusion, diversity

_COS = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


@_query(
    "vector_topk",
    f"""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, {_COS.format('embedding', 'q')} AS s FROM embeddings, q)
    SELECT vec_id, CAST(row_number() OVER (ORDER BY round(s, 9) DESC, vec_id) AS INTEGER) AS rank, round(s, 6) AS score FROM s QUALIFY rank <= 10""",
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    asked = rows.where("vec_id = 0").select(F.lit(0).alias("query_id"), F.col("vec").alias("query_vec"))
    top = rank.top_by(score_vectors(rows, asked, "vec_id").drop("vec"), "query_id", [F.round("score", rank.PLACES).desc(), F.col("vec_id").asc()], 10)
    return top.select("vec_id", "rank", F.round("score", 6).alias("score"))


@_query(
    "vector_topk_batch",
    f"""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, {_COS.format('embedding', 'q')} AS s FROM embeddings, q)
    SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS INTEGER) AS rank, round(s, 6) AS score FROM s QUALIFY rank <= 10""",
)
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with an id divisible by 50 as queries against all."""
    rows = _vectors(spark, sf_dir)
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query_vec"))
    return nearest.nearest(spread(rows), asked, "vec_id", 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


_POOL = f"""WITH {_INDEX}, s AS (SELECT doc_id, sum({_SCORE}) AS s FROM post JOIN idf USING (term), st WHERE term IN ({_IN}) GROUP BY doc_id),
p AS (SELECT doc_id, s, row_number() OVER (ORDER BY round(s, 9), doc_id) AS r FROM s QUALIFY r <= 60),
c AS (SELECT p.*, e.embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS q FROM p LEFT JOIN embeddings e ON e.vec_id = p.doc_id)"""


def _fused(spark: SparkSession, sf_dir: str, vectors: DataFrame) -> DataFrame:
    pooled = rank.pool(_lexical(spark, sf_dir, _one_query(spark)), 10, "doc_id")
    asked = _vectors(spark, sf_dir).where("vec_id = 0").select(F.lit(0).cast("long").alias("query_id"), F.col("vec").alias("query_vec"))
    met = pooled.join(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left").join(F.broadcast(asked), "query_id", "left")
    met = met.withColumn("cosine", F.when(F.col("vec").isNotNull(), cosine(F.col("vec"), F.col("query_vec"))))
    fused = rank.fuse(met).withColumnRenamed("rank", "pool_rank")
    top = rank.top_by(fused, "query_id", [F.round("score", rank.PLACES).desc(), F.col("pool_rank").asc()], 10)
    return top.select("doc_id", "rank", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


def _fusion_sql(vector: str) -> str:
    return f"""{_POOL}, f AS (SELECT doc_id, r, CASE WHEN {vector} THEN {_COS.format('embedding', 'q')} END AS c,
      CASE WHEN max(s) OVER () = min(s) OVER () THEN 1.0 ELSE (max(s) OVER () - s) / (max(s) OVER () - min(s) OVER ()) END AS b FROM c),
    g AS (SELECT doc_id, r, c, CASE WHEN c IS NULL THEN b ELSE 0.5 * b + 0.5 * least(1.0, greatest(0.0, (c + 1) / 2)) END AS f FROM f)
    SELECT doc_id, CAST(row_number() OVER (ORDER BY round(f, 9) DESC, r) AS INTEGER) AS rank, round(c, 6) AS cosine, round(f, 6) AS score FROM g QUALIFY rank <= 10"""


@_query("hybrid_fusion", _fusion_sql("embedding IS NOT NULL"))
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical pool, re-scored by vectors of the same id."""
    return _fused(spark, sf_dir, _vectors(spark, sf_dir))


@_query("fusion_no_vector", _fusion_sql("false"))
def fusion_no_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without vectors the fused score is the scaled lexical one, unweighted."""
    return _fused(spark, sf_dir, _vectors(spark, sf_dir).where(F.lit(False)))


@_query(
    "mmr_rerank",
    f"""WITH RECURSIVE q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
    p AS (SELECT vec_id, embedding AS e, s, row_number() OVER (ORDER BY round(s, 9) DESC, vec_id) AS r FROM (SELECT vec_id, embedding, {_COS.format('embedding', 'q')} AS s FROM embeddings, q WHERE vec_id <> 0) QUALIFY r <= 20),
    sim AS (SELECT a.r AS a, b.r AS b, {_COS.format('a.e', 'b.e')} AS c FROM p a, p b),
    pick AS (
      SELECT 1 AS n, [CAST(1 AS BIGINT)] AS chosen
      UNION ALL
      SELECT n + 1, list_append(chosen, (SELECT p.r FROM p WHERE NOT list_contains(chosen, p.r)
        ORDER BY 0.5 * p.s - 0.5 * greatest(0.0, (SELECT max(c) FROM sim WHERE sim.a = p.r AND list_contains(chosen, sim.b))) DESC, p.r LIMIT 1)) FROM pick WHERE n < 5
    ), last AS (SELECT chosen FROM pick WHERE n = 5), u AS (SELECT unnest(range(1, 6)) AS rank, chosen FROM last)
    SELECT CAST(u.rank AS INTEGER) AS rank, p.vec_id, round(p.s, 6) AS score FROM u JOIN p ON p.r = chosen[u.rank]""",
)
def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five diverse vectors of the twenty nearest to vector 0, itself left out: it would make all others tie."""
    every = _vectors(spark, sf_dir)
    rows, asked = every.where("vec_id <> 0"), every.where("vec_id = 0").select(F.lit(0).alias("query_id"), F.col("vec").alias("query_vec"))
    pooled = rank.top_by(score_vectors(rows, asked, "vec_id"), "query_id", [F.round("score", rank.PLACES).desc(), F.col("vec_id").asc()], 20)
    return rerank.mmr(pooled, MMRConfig(0.5, 5), 5).select("rank", "vec_id", F.round("score", 6).alias("score"))


@_query(
    "mmr_whole_index",
    f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    c AS (SELECT q.vec_id AS query_id, v.vec_id, v.e, {_COS.format('v.e', 'q.e')} AS s FROM v q JOIN v ON q.vec_id % 50 = 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS r FROM c),
    step AS (
      SELECT 1 AS n, query_id, vec_id, e, s, r, CAST(0 AS DOUBLE) AS near, CASE WHEN r = 1 THEN 1 END AS picked FROM o
      UNION ALL
      SELECT n + 1, query_id, vec_id, e, s, r, near2, CASE WHEN picked IS NOT NULL THEN picked WHEN row_number() OVER (PARTITION BY query_id ORDER BY picked IS NOT NULL, 0.7 * s - 0.3 * near2 DESC, r) = 1 THEN n + 1 END
      FROM (SELECT *, greatest(near, {_COS.format('e', 'last')}) AS near2 FROM (SELECT *, first_value(e) OVER (PARTITION BY query_id ORDER BY CASE WHEN picked = n THEN 0 ELSE 1 END) AS last FROM step WHERE n < 5))
    )
    SELECT query_id, CAST(picked AS INTEGER) AS rank, vec_id, round(s, 6) AS score FROM step WHERE n = 5 AND picked IS NOT NULL""",
)
def mmr_whole_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MMR over all vectors, one pass for each of five places."""
    rows = _vectors(spark, sf_dir)
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query_vec"))
    return nearest.mmr_nearest(spread(rows), asked, "vec_id", MMRConfig(0.7, 5), 5).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


# Windows and documents in part; conversations are the chunks

_NEAR = "string_agg(text, chr(10) || chr(10) ORDER BY turn)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").cast("string").alias("source_id"), F.col("turn").cast("int").alias("ordinal"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.concat_ws(":", "conv_id", "role").alias("parent_id"), F.col("turn").cast("int").alias("page"), F.col("text").alias("content"))


@_query(
    "window_neighbors",
    f"""SELECT a.conv_id || ':' || a.turn AS chunk_id, CAST(count(*) AS BIGINT) AS n, sha256(string_agg(b.text, chr(10) || chr(10) ORDER BY b.turn)) AS digest
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY a.conv_id, a.turn""",
)
def window_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    wide = windows.neighbours(turns.withColumn("query_id", F.lit(0)), turns, 1)
    return wide.select("chunk_id", F.col("window_size").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))


@_query(
    "parent_expansion",
    """SELECT a.conv_id || ':' || a.turn AS chunk_id, CAST(count(*) AS BIGINT) AS n, sha256(string_agg(b.text, chr(10) || chr(10) ORDER BY b.turn)) AS digest
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = b.role GROUP BY a.conv_id, a.turn""",
)
def parent_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit's window is all chunks of its parent: here the turns of one role."""
    turns = _turns(spark, sf_dir)
    wide = windows.parents(turns.withColumn("query_id", F.lit(0)), turns, 1)
    return wide.select("chunk_id", F.col("window_size").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))


@_query(
    "window_dedup",
    """WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations),
    w AS (SELECT conv_id, 0 AS r, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT conv_id FROM t)
      UNION ALL
      SELECT w.conv_id, t.r, CASE WHEN list_contains(used, t.turn) OR len(kept) >= 3 THEN used ELSE list_concat(used, [t.turn - 1, t.turn, t.turn + 1]) END,
        CASE WHEN list_contains(used, t.turn) OR len(kept) >= 3 THEN kept ELSE list_append(kept, t.turn) END
      FROM w JOIN t ON t.conv_id = w.conv_id AND t.r = w.r + 1),
    e AS (SELECT conv_id, arg_max(kept, r) AS kept FROM w GROUP BY conv_id)
    SELECT conv_id AS query_id, kept[i] AS turn, CAST(i AS INTEGER) AS place FROM (SELECT conv_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM e)""",
)
def window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation the longest turns, without those in the window of an earlier kept one, three at most."""
    turns = _turns(spark, sf_dir)
    hits = turns.withColumn("query_id", F.col("source_id").cast("long"))
    ranked = rank.top_by(hits, "query_id", [F.length("content").desc(), F.col("ordinal").asc()], 1000)
    kept = rerank.window_dedup(windows.neighbours(ranked, turns, 1).select("query_id", "chunk_id", "ordinal", "rank", "window_ids"), 3)
    return kept.select("query_id", F.col("ordinal").cast("long").alias("turn"), "place")


@_query(
    "fetch_from_page",
    f"""WITH p AS (SELECT conv_id, min(turn) FILTER (turn >= 2) AS pv FROM conversations GROUP BY conv_id)
    SELECT conv_id, CAST(min(turn) AS BIGINT) AS start_page, CAST(max(turn) AS BIGINT) AS end_page, sha256({_NEAR}) AS digest FROM conversations JOIN p USING (conv_id) WHERE turn >= pv GROUP BY conv_id""",
)
def fetch_from_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document from its first chunk of page 2 or later on."""
    rows = _table(spark, sf_dir, "conversations")
    pivot = rows.where("turn >= 2").groupBy("conv_id").agg(F.min("turn").alias("at"))
    kept = rows.join(pivot, "conv_id").where(F.col("turn") >= F.col("at"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    return kept.groupBy("conv_id").agg(F.min("turn").alias("start_page"), F.max("turn").alias("end_page"), F.sha2(text, 256).alias("digest"))


@_query(
    "fetch_anchor",
    f"""WITH p AS (SELECT conv_id, min(turn) AS pv FROM conversations WHERE contains(lower(text), 'the') GROUP BY conv_id)
    SELECT conv_id, CAST(pv AS BIGINT) AS anchor, CAST(count(*) AS BIGINT) AS n, sha256({_NEAR}) AS digest FROM conversations JOIN p USING (conv_id) WHERE turn BETWEEN pv - 1 AND pv + 1 GROUP BY conv_id, pv""",
)
def fetch_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document around its first chunk that holds the anchor."""
    turns = _turns(spark, sf_dir)
    first = turns.where(F.contains(F.lower("content"), F.lit("the"))).groupBy("source_id").agg(F.min_by("chunk_id", "ordinal").alias("chunk_id"), F.min("ordinal").alias("ordinal"))
    wide = windows.neighbours(first.withColumn("query_id", F.lit(0)), turns, 1)
    return wide.select(F.col("source_id").cast("long").alias("conv_id"), F.col("ordinal").cast("long").alias("anchor"), F.col("window_size").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))


# Filters and joins

@_query("source_listing", "SELECT source, CAST(count(*) AS BIGINT) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def source_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@_query("tag_semi_join", "SELECT doc_id, lang FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND l.quality = 1)")
def tag_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with any of some tags: here the label of quality."""
    tagged = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return _documents(spark, sf_dir).join(tagged, "doc_id", "left_semi").select("doc_id", "lang")


@_query("page_range_filter", "SELECT conv_id, CAST(turn AS BIGINT) AS turn FROM conversations WHERE turn BETWEEN 1 AND 2")
def page_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").where(F.col("turn").between(1, 2)).select("conv_id", "turn")


@_query("source_scope", "SELECT doc_id FROM documents WHERE source = 'src1' OR starts_with(source, 'src1 p.')")
def source_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source itself or one of its pages, literally: src10 is another source."""
    from .operators.index import in_scope

    return _documents(spark, sf_dir).where(in_scope(F.col("source"), "src1")).select("doc_id")


@_query("missing_vector_anti", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = doc_id)")
def missing_vector_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return _documents(spark, sf_dir).join(vectors, "doc_id", "left_anti").select("doc_id")


# Loaders and text

_STRIP = r"regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_ENTITIES = "replace(replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&#39;', '''')"
_SQUEEZE = r"trim(regexp_replace({0}, '[\s\p{{Z}}]+', ' ', 'g'))"


@_query("html_to_text", f"SELECT page_id, {_SQUEEZE.format(_ENTITIES.format(_STRIP))} AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.loaders import html_text

    return _table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@_query("html_entities", f"SELECT page_id, sha256({_ENTITIES.format('html')}) AS digest FROM pages")
def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.loaders import decode_entities

    return _table(spark, sf_dir, "pages").select("page_id", F.sha2(decode_entities(F.col("html")), 256).alias("digest"))


@_query(
    "text_normalize",
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(text, ' ', '-' || chr(10)), '\r\n|[\r\x{2028}\x{2029}]', chr(10), 'g'), '[-\x{2010}\x{2011}]\n([\p{L}\p{M}])', '\1', 'g'), '[\x00-\x08\x0b-\x1f\x7f-\x{9f}\x{ad}\x{200b}-\x{200f}\x{feff}\x{fffc}\x{f8ff}]', '', 'g')) AS digest FROM documents""",
)
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newlines, hyphens at line ends and controls; each space becomes such a line end first."""
    wrapped = F.replace("text", F.lit(" "), F.lit("-\n"))
    return _documents(spark, sf_dir).select("doc_id", F.sha2(X.strip_controls(X.join_hyphens(X.newlines(wrapped))), 256).alias("digest"))


@_query("tableish_flag", r"SELECT doc_id, regexp_matches(text, '[\t|]|[^\s\p{Z}][\s\p{Z}]{2,}[^\s\p{Z}]') AS tableish FROM documents")
def tableish_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", X.tableish(F.col("text")).alias("tableish"))


@_query(
    "heading_parse",
    r"""WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
    l AS (SELECT doc_id, line_no, repeat('#', CAST((doc_id + line_no) % 8 AS INTEGER)) || ' ' || text AS line FROM t)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(length(regexp_extract(line, '^[\s\p{Z}]*(#{1,6}) +[\s\p{Z}]*[^\s\p{Z}]', 1)) AS INTEGER) AS level,
      regexp_replace(regexp_extract(line, '^[\s\p{Z}]*#{1,6} +(.*)$', 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS title
    FROM l WHERE regexp_extract(line, '^[\s\p{Z}]*(#{1,6}) +[\s\p{Z}]*[^\s\p{Z}]', 1) <> ''""",
)
def heading_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines behind 0 to 7 marks: one to six make a heading."""
    lines = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    line = F.concat(F.repeat(F.lit("#"), ((F.col("doc_id") + F.col("line_no")) % 8).cast("int")), F.lit(" "), "text")
    rows = lines.select("doc_id", "line_no", X.heading(line).alias("h")).where("h IS NOT NULL")
    return rows.select("doc_id", "line_no", "h.level", "h.title")


@_query(
    "running_lines",
    r"""WITH l AS (SELECT list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
    e AS (SELECT 'first' AS "end", l[1] AS line FROM l UNION ALL SELECT 'last', l[len(l)] FROM l)
    SELECT "end", line, CAST(count(*) AS BIGINT) AS n FROM e WHERE line IS NOT NULL GROUP BY "end", line QUALIFY row_number() OVER (PARTITION BY "end" ORDER BY n DESC, line) <= 10""",
)
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent first and last lines of documents: the counting half of the header filter."""
    lines = X.lines(F.col("text"))
    ends = _documents(spark, sf_dir).select(once(lines.alias("l"))).select(F.explode(F.array(F.struct(F.lit("first").alias("end"), F.get("l", F.lit(0)).alias("line")), F.struct(F.lit("last").alias("end"), F.when(F.size("l") > 0, F.element_at("l", -1)).alias("line")))).alias("e"))
    counts = ends.where("e.line IS NOT NULL").groupBy("e.end", "e.line").agg(F.count("*").alias("n"))
    return rank.top_by(counts, "end", [F.desc("n"), F.col("line").asc()], 10).select("end", "line", "n")


_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@_query(
    "header_footer_strip",
    f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page FROM documents),
    l AS (SELECT *, list_filter(['Running head', {_TRIM.format('line')}], lambda x: x <> '') AS ls, count(*) OVER (PARTITION BY doc_id) AS pages FROM p),
    feet AS (SELECT doc_id, ls[-1] AS foot FROM l WHERE pages >= 3 GROUP BY doc_id, ls[-1] HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(page), ls[-1]) <= 2),
    f AS (SELECT doc_id, list(foot) AS feet FROM feet GROUP BY doc_id),
    c AS (SELECT l.*, list_filter(range(1, len(ls) + 1), lambda i: ls[i] <> 'Running head')[1] AS a, list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(coalesce(feet, []), ls[i]))[-1] AS b FROM l LEFT JOIN f USING (doc_id))
    SELECT CAST(doc_id AS VARCHAR) AS source_id, CAST(page AS INTEGER) AS page,
      sha256(CASE WHEN pages < 3 THEN 'Running head' || chr(10) || line WHEN a IS NULL OR b IS NULL OR b < a THEN '' ELSE array_to_string(ls[a : b], chr(10)) END) AS digest FROM c""",
)
def header_footer_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as pages, each with a running head; tests compare with brute force."""
    lines = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_id"), F.posexplode(F.split("text", "\n")).alias("page", "line"))
    pages = lines.select("source_id", F.lit("n").alias("name"), F.lit("public.plain-text").alias("uti"), "page", F.concat(F.lit("Running head\n"), F.col("line")).alias("text"))
    return chunking.strip_running_lines(pages).select("source_id", "page", F.sha2("text", 256).alias("digest"))


_SENTENCES = r"""list_filter(list_transform(CASE WHEN regexp_matches(text, '[\t|]|[^\s\p{Z}][\s\p{Z}]{2,}[^\s\p{Z}]') THEN string_split(text, chr(10))
  ELSE string_split(regexp_replace(text, '([.!?]+)[\s\p{Z}]+', '\1' || chr(10), 'g'), chr(10)) END, lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '')"""


@_query(
    "chunk_pack",
    f"""WITH RECURSIVE u AS (SELECT doc_id, {_SENTENCES} AS u, CASE WHEN regexp_matches(text, '[\\t|]|[^\\s\\p{{Z}}][\\s\\p{{Z}}]{{2,}}[^\\s\\p{{Z}}]') THEN chr(10) ELSE ' ' END AS j FROM documents),
    f AS (SELECT doc_id, 0 AS i, CAST([] AS VARCHAR[]) AS out, '' AS buf FROM u
      UNION ALL
      SELECT f.doc_id, i + 1,
        CASE WHEN buf <> '' AND length(buf) + 1 + length(u.u[i + 1]) > 720 THEN list_append(out, buf) ELSE out END,
        CASE WHEN buf = '' THEN u.u[i + 1]
          WHEN length(buf) + 1 + length(u.u[i + 1]) > 720 THEN CASE WHEN length(right(buf, 72) || chr(10) || u.u[i + 1]) > 720 THEN u.u[i + 1] ELSE right(buf, 72) || chr(10) || u.u[i + 1] END
          ELSE buf || u.j || u.u[i + 1] END
      FROM f JOIN u ON u.doc_id = f.doc_id WHERE i < len(u.u)),
    e AS (SELECT doc_id, list_append(out, buf) AS c FROM f JOIN u USING (doc_id) WHERE i = len(u.u) AND buf <> '')
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS ordinal, sha256(c[i]) AS digest FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM e)""",
)
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks of 720 characters at most where units allow, 72 of them shared."""
    docs = spread(_documents(spark, sf_dir).select("doc_id", "text"))
    joiner = F.when(X.tableish(F.col("text")), "\n").otherwise(" ")
    packed = docs.select("doc_id", once(chunking.pack(X.units(F.col("text")), joiner, ChunkingConfig(200, 20)).alias("texts"))).select("doc_id", F.posexplode("texts").alias("ordinal", "c"))
    return packed.select("doc_id", "ordinal", F.sha2("c", 256).alias("digest"))


def _pack_sql(rows: str, top: int, overlap: int) -> str:
    """CTEs ``parts`` (source_id, section, title, body, i, content): the rows (source_id, section, title, body) cut into chunks."""
    table = r"regexp_matches(body, '[\t|]|[^\s\p{Z}][\s\p{Z}]{2,}[^\s\p{Z}]')"
    return f"""b AS ({rows}),
    u AS (SELECT *, {_SENTENCES.replace('text', 'body')} AS u, CASE WHEN {table} THEN chr(10) ELSE ' ' END AS j FROM b),
    f AS (SELECT source_id, section, 0 AS i, CAST([] AS VARCHAR[]) AS out, '' AS buf FROM u
      UNION ALL
      SELECT f.source_id, f.section, i + 1,
        CASE WHEN buf <> '' AND length(buf) + 1 + length(u.u[i + 1]) > {top} THEN list_append(out, buf) ELSE out END,
        CASE WHEN buf = '' THEN u.u[i + 1]
          WHEN length(buf) + 1 + length(u.u[i + 1]) > {top} THEN CASE WHEN length(right(buf, {overlap}) || chr(10) || u.u[i + 1]) > {top} THEN u.u[i + 1] ELSE right(buf, {overlap}) || chr(10) || u.u[i + 1] END
          ELSE buf || u.j || u.u[i + 1] END
      FROM f JOIN u ON u.source_id = f.source_id AND u.section = f.section WHERE i < len(u.u)),
    e AS (SELECT u.*, list_append(out, buf) AS c FROM f JOIN u ON u.source_id = f.source_id AND u.section = f.section WHERE i = len(u.u) AND buf <> ''),
    parts AS (SELECT source_id, section, title, unnest(c) AS content, generate_subscripts(c, 1) AS i FROM e)"""


#: CTEs up to ``chunk``: the chunks of ingested documents, one page each, with their ids and rule prefixes.
_INGESTED = f"""{_pack_sql("SELECT 'd' || doc_id AS source_id, 0 AS section, CAST(NULL AS VARCHAR) AS title, " + _TRIM.format('text') + " AS body FROM documents WHERE length(text) > 0", 2340, 288)},
chunk AS (SELECT source_id, i - 1 AS ordinal, content, source_id || ':' || (i - 1) || ':' || substr(sha256({_TRIM.format('content')}), 1, 16) AS chunk_id,
  '[' || source_id || ' · p.1' || coalesce(' · ' || h, '') || '] - ' AS prefix
  FROM parts JOIN (SELECT 'd' || doc_id AS source_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '^page\\s*[0-9]+$'))[1] AS h FROM documents) USING (source_id))"""


@_query(
    "chunk_sections",
    f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS r FROM documents),
    h AS (SELECT *, regexp_full_match(line, '.{{1,80}}ing[.]') AS head FROM l),
    n AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY r) AS section FROM h),
    s AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, section, max(CASE WHEN head THEN {_TRIM.format('line')} END) AS title, {_TRIM.format("coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY r), '')")} AS body FROM n GROUP BY doc_id, section),
    {_pack_sql("SELECT * FROM s WHERE body <> ''", 2340, 288)},
    o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY section, i) - 1 AS ordinal FROM parts)
    SELECT source_id || ':' || ordinal || ':' || substr(sha256({_TRIM.format('content')}), 1, 16) AS chunk_id, CAST(ordinal AS INTEGER) AS ordinal, title AS section_title, CASE WHEN section > 0 THEN source_id || ':p0:s' || section END AS parent_id FROM o""",
)
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from pages to chunks; every line of a document that ends in 'ing.' is made a heading."""
    marked = F.regexp_replace("text", r"(?m)^(.{1,80}ing\.)$", "## $1")
    pages = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_id"), F.lit("n").alias("name"), F.lit("public.plain-text").alias("uti"), F.lit(0).alias("page"), marked.alias("text"))
    return chunking.chunks(pages).select("chunk_id", "ordinal", "section_title", "parent_id")


@_query(
    "chunk_ids",
    r"""SELECT doc_id, source || ':' || (doc_id % 7) || ':' || substr(sha256(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), 1, 16) AS chunk_id,
    sha256(source || '|' || -1 || '|' || text) AS cache_key FROM documents""",
)
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = X.content_hash(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", X.chunk_id(F.col("source"), F.col("doc_id") % 7, digest).alias("chunk_id"), X.cache_key(F.col("source"), F.lit(None).cast("int"), F.col("text")).alias("cache_key"))


@_query(
    "context_prefix",
    r"""WITH h AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^page\s*[0-9]+$'))[1] AS h FROM documents)
    SELECT doc_id, '[' || source || ' · p.' || (doc_id % 9 + 1) || coalesce(' · ' || h, '') || '] - ' AS prefix FROM h""",
)
def context_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", chunking.rule_prefix(F.col("source"), F.col("doc_id") % 9, chunking.page_header(F.col("text"))).alias("prefix"))


@_query(
    "query_sanitize",
    r"""SELECT item_id, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(text, '[^\p{L}\p{M}\p{N}]', ' ', 'g'), ' +'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')), lambda x: '"' || x || '"'), ' OR ') AS expression FROM benchmark""",
)
def query_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", X.sanitize(F.col("text"), compat=True).alias("expression"))


@_query(
    "excerpt",
    r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END AS excerpt FROM t""",
)
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


@_query("needs_ocr", r"SELECT conv_id, turn, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) = 0 AS needs FROM conversations")
def needs_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", X.needs_ocr(F.col("text")).alias("needs"))


def _loaded(spark: SparkSession, rows: DataFrame, uti: str) -> DataFrame:
    from .sources.loaders import load

    kind = rows.select("source_id", F.lit("data").alias("kind"), F.lit(uti).alias("uti"), F.lit("n").alias("name"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("text"), "bytes")
    return load(kind)


@_query("json_flatten", "SELECT event_id, string_agg(k || ': ' || json_extract_string(props, '$.' || k), chr(10) ORDER BY k) AS text FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) GROUP BY event_id")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("source_id"), F.col("props").cast("binary").alias("bytes"))
    return _loaded(spark, events, "public.json").select(F.col("source_id").cast("long").alias("event_id"), "text")


@_query("csv_row_pages", "SELECT 'n' || n_nationkey AS source_id, CAST(1 AS INTEGER) AS page, 'key: ' || n_nationkey || ', name: ' || n_name AS text FROM nation")
def csv_row_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation")
    table = F.concat(F.lit("key,name\r\n"), F.col("n_nationkey").cast("string"), F.lit(',"'), F.col("n_name"), F.lit('"\r\n'))
    made = rows.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source_id"), table.cast("binary").alias("bytes"))
    return _loaded(spark, made, "public.comma-separated-values-text").select("source_id", "page", "text")


@_query("yaml_lines", "SELECT CAST(n_nationkey AS VARCHAR) AS source_id, 'name: ' || n_name || chr(10) || '- ' || n_regionkey AS text FROM nation")
def yaml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("---\n# a nation\nname: "), F.col("n_name"), F.lit("  # its name\n\n  - "), F.col("n_regionkey").cast("string"), F.lit("\n...\n"))
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("source_id"), text.cast("binary").alias("bytes"))
    return _loaded(spark, rows, "public.yaml").select("source_id", "text")


@_query("xml_flatten", "SELECT CAST(n_nationkey AS VARCHAR) AS source_id, 'n.@k: ' || n_nationkey || chr(10) || 'n.name: ' || n_name AS text FROM nation")
def xml_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<n k='"), F.col("n_nationkey").cast("string"), F.lit("'><name> "), F.col("n_name"), F.lit(" </name></n>"))
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("source_id"), text.cast("binary").alias("bytes"))
    return _loaded(spark, rows, "public.xml").select("source_id", "text")


@_query("rtf_load", "SELECT CAST(n_nationkey AS VARCHAR) AS source_id, n_name || ' é' || chr(10) || n_regionkey AS text FROM nation")
def rtf_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}{\\b "), F.col("n_name"), F.lit("} \\'e9\\par "), F.col("n_regionkey").cast("string"), F.lit("}"))
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("source_id"), text.cast("binary").alias("bytes"))
    return _loaded(spark, rows, "public.rtf").select("source_id", "text")


@_query("file_types", "SELECT * FROM (VALUES ('a.csv', 'comma-separated-values-text', 'csv'), ('b.pdf', 'pdf', 'pdf'), ('c.md', 'markdown', 'markdown'), ('d.docx', 'docx', 'docx'), ('e.png', 'image', 'image'), ('f', 'text', 'text'), ('g.JSON', 'json', 'json')) AS t(path, file_type, loader)")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.types import file_type, loader_of, uti_of

    rows = spark.createDataFrame([(p,) for p in ("a.csv", "b.pdf", "c.md", "d.docx", "e.png", "f", "g.JSON")], "path string")
    return rows.select("path", file_type(uti_of(F.col("path"))).alias("file_type"), loader_of(uti_of(F.col("path"))).alias("loader"))


# Answers and metrics; turns are replies, numbered marks are added

def _passages(n: int) -> Column:
    """n passages with scores .9, .5, ... and one citation each, built from the row's text."""
    def one(i: int) -> Column:
        cite = F.struct(F.lit(f"s{i}").alias("source_id"), F.lit(f"S{i}").alias("source_name"), F.lit("text").alias("file_type"), F.lit(0).alias("page"), F.lit(None).cast("string").alias("section_title"), F.lit(f"c{min(i, 2)}").alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("x").alias("excerpt"))
        return F.struct(F.col("text"), F.lit(round(0.9 - 0.4 * (i - 1), 1)).alias("score"), F.array(cite).alias("citations"))

    return F.array(*[one(i) for i in range(1, n + 1)])


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    first, second = F.pmod(F.col("turn"), F.lit(5)), F.pmod(F.col("conv_id"), F.lit(4))
    reply = F.concat(F.col("text"), F.lit(" ["), first.cast("string"), F.lit("]["), second.cast("string"), F.lit("] ["), first.cast("string"), F.lit("]"))
    return rows.withColumn("reply", reply).withColumn("passages", _passages(3))


_MARKS = "WITH m AS (SELECT conv_id, turn, list_distinct(list_filter([turn % 5, conv_id % 4], lambda x: x BETWEEN 1 AND 3)) AS d, [turn % 5, conv_id % 4] AS l FROM conversations WHERE NOT regexp_matches(text, '\\[[0-9]+\\]'))"


@_query(
    "citation_resolve",
    _MARKS + """, k AS (SELECT conv_id, turn, CASE WHEN l[1] BETWEEN 1 AND 3 THEN 'c' || least(l[1], 2) END AS a, CASE WHEN l[2] BETWEEN 1 AND 3 THEN 'c' || least(l[2], 2) END AS b FROM m)
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN a IS NULL THEN coalesce(b, '') WHEN b IS NULL OR a = b THEN a ELSE a || ',' || b END AS chunks FROM k""",
)
def citation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _replies(spark, sf_dir).where(~F.col("text").rlike(r"\[[0-9]+\]"))
    return rows.select("conv_id", "turn", F.array_join(F.transform(G.resolve(F.col("reply"), F.col("passages")), lambda c: c["chunk_id"]), ",").alias("chunks"))


@_query("confidence", _MARKS + " SELECT conv_id, CAST(turn AS BIGINT) AS turn, round(CASE WHEN len(d) = 0 THEN 0 ELSE least(1, greatest(0, list_sum(list_transform(d, lambda x: 0.9 - 0.4 * (x - 1))) / len(d))) END, 6) AS confidence FROM m")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _replies(spark, sf_dir).where(~F.col("text").rlike(r"\[[0-9]+\]"))
    return rows.select("conv_id", "turn", F.round(G.confidence(F.col("reply"), F.col("passages")), 6).alias("confidence"))


@_query("refusal", _MARKS + " SELECT conv_id, CAST(turn AS BIGINT) AS turn, len(d) = 0 OR list_sum(list_transform(d, lambda x: 0.9 - 0.4 * (x - 1))) / len(d) < 0.3 AS refused FROM m")
def refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict policy on marked replies."""
    rows = _replies(spark, sf_dir).where(~F.col("text").rlike(r"\[[0-9]+\]"))
    cites, trust = F.size(G.resolve(F.col("reply"), F.col("passages"))), G.confidence(F.col("reply"), F.col("passages"))
    return rows.select("conv_id", "turn", G.refused(F.col("reply"), cites, trust, F.col("text"), AnswerPolicy.strict()).alias("refused"))


_WORD = "split_part(text, ' ', 1)"


@_query("quote_grounding", f"SELECT conv_id, turn, CASE WHEN contains({_WORD}, '\"') OR {_WORD} = '' THEN NULL ELSE CAST(0.5 AS DOUBLE) END AS share FROM conversations")
def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quote from the text and one invented."""
    word = F.substring_index("text", " ", 1)
    reply = F.concat(F.lit('"'), word, F.lit('" and "zzz zzz"'))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(~(F.contains(word, F.lit('"')) | (word == "")), G.quote_grounding(reply, F.col("text"))).alias("share"))


@_query("numeric_consistency", "SELECT conv_id, turn, CASE WHEN contains(text || ' 1985', '99.9') THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS share FROM conversations")
def numeric_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", G.numeric_consistency(F.lit("It was 1985, or 99.9."), F.concat("text", F.lit(" 1985"))).alias("share"))


@_query(
    "citation_coverage",
    r"""WITH s AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text || ' [1]. End.', '[^.!?]*[.!?]|[^.!?]+$'), lambda x: regexp_replace(x, '[\s\p{Z}.!?]', '', 'g') <> '') AS s FROM conversations)
    SELECT conv_id, turn, round(len(list_filter(s, lambda x: regexp_matches(x, '\[[0-9]+\]'))) / len(s), 6) AS coverage FROM s""",
)
def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(G.citation_coverage(F.concat("text", F.lit(" [1]. End."))), 6).alias("coverage"))


@_query(
    "eval_recall_mrr_precision",
    f"""WITH {_INDEX}, q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
    s AS (SELECT query_id, doc_id, sum({_SCORE}) AS s FROM q JOIN post USING (term) JOIN idf USING (term), st GROUP BY query_id, doc_id),
    r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9), doc_id) AS rank FROM s QUALIFY rank <= 5),
    m AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, split_part(b.text, '.', 1))),
    c AS (SELECT query_id, count(*) AS n FROM m GROUP BY query_id),
    h AS (SELECT c.query_id, c.n, count(r.rank) AS hits, coalesce(1.0 / min(r.rank), 0) AS rr FROM c LEFT JOIN m USING (query_id) LEFT JOIN r ON r.query_id = m.query_id AND r.doc_id = m.doc_id GROUP BY c.query_id, c.n)
    SELECT CAST(count(*) AS BIGINT) AS queries, round(coalesce(avg(hits / n), 0), 6) AS recall_at_k, round(coalesce(avg(hits / 5), 0), 6) AS precision_at_k, round(coalesce(avg(rr), 0), 6) AS mrr FROM h""",
)
def eval_recall_mrr_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the batch search; relevant are documents that hold a benchmark text's first sentence."""
    bench = _table(spark, sf_dir, "benchmark")
    first = bench.select(F.col("item_id").alias("query_id"), F.substring_index("text", ".", 1).alias("s"))
    held = _documents(spark, sf_dir).join(F.broadcast(first), F.contains("text", "s")).groupBy("query_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("must"))
    found = bm25_batch_topk(spark, sf_dir).where("rank <= 5").select("query_id", "rank", F.col("doc_id").cast("string").alias("source_id"))
    out = evaluate.summary(evaluate.retrieval_metrics(found, held.withColumn("k", F.lit(5))))
    return out.select("queries", *[F.round(c, 6).alias(c) for c in ("recall_at_k", "precision_at_k", "mrr")])


# Whole ways through the engine; tests check what they return

def _engine(spark: SparkSession, **more):
    from .plans.engine import Engine
    from .sources.embedders import BagEmbedder

    return Engine(spark, provider=BagEmbedder(32), **more)


def _ingested(spark: SparkSession, sf_dir: str, embed: bool = True, tags=None, **more):
    engine = _engine(spark, **more)
    docs = spread(_documents(spark, sf_dir).where("length(text) > 0"))  # an empty text has no chunk
    rows = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.lit("text").alias("kind"), F.lit("public.plain-text").alias("uti"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("path"), "text", F.lit(None).cast("binary").alias("bytes"))
    engine.ingest(rows, tags(docs) if tags else None, embed=embed)
    return engine


@_query("embed_backfill", f"WITH RECURSIVE {_INGESTED} SELECT chunk_id, CAST(32 AS INTEGER) AS dim FROM chunk")
def embed_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest all documents (an empty text has no chunk), embed all chunks; (chunk_id, dim) of the vectors."""
    return _ingested(spark, sf_dir).store.read("vectors").select("chunk_id", "dim")


# The chunk index in SQL: terms of prefix, text and source, then the pool of each benchmark question.
_FOLDED = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}\p{{Co}}_-]+')"
_CHUNK_INDEX = f"""{_INGESTED},
tk AS (SELECT *, list_concat({_FOLDED.format('prefix || content')}, {_FOLDED.format('source_id')}) AS t FROM chunk),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk),
post AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tk) GROUP BY chunk_id, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS w FROM dfs, st)"""
_POOLED = f"""WITH RECURSIVE {_CHUNK_INDEX},
asked AS (SELECT query_id, strip_accents(lower(w)) AS term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(regexp_replace(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}_-]', ' ', 'g'), ' +'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) AS w FROM benchmark) GROUP BY ALL),
hit AS (SELECT query_id, chunk_id, sum(times * ({_SCORE})) AS bm25 FROM asked JOIN post USING (term) JOIN idf USING (term), st GROUP BY query_id, chunk_id),
pool AS (SELECT query_id, chunk_id, source_id, ordinal, prefix, content, bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), source_id, ordinal) AS r FROM hit JOIN chunk USING (chunk_id) QUALIFY r <= 60)"""
_WINDOW = "(SELECT string_agg(c.content, chr(10) || chr(10) ORDER BY c.ordinal) FROM chunk c WHERE c.source_id = {0}.source_id AND c.ordinal BETWEEN {0}.ordinal - 1 AND {0}.ordinal + 1)"


def _bag_sql(name: str, rows: str) -> str:
    """CTE ``name`` (id, v): BagEmbedder(32) of the rows (id, text)."""
    return f"""{name}_w AS (SELECT id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 32 AS k, CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) & 1 = 1 THEN 1 ELSE -1 END AS x FROM (SELECT id, sha256(unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS h FROM ({rows}))),
    {name}_s AS (SELECT id, k, sum(x) AS x FROM {name}_w GROUP BY id, k),
    {name}_n AS (SELECT id, sqrt(sum(x * x)) AS n FROM {name}_s GROUP BY id),
    {name} AS (SELECT i.id, list(CASE WHEN n > 0 THEN CAST(CAST(coalesce(s.x, 0) / n AS FLOAT) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END ORDER BY d.k) AS v FROM {name}_n i CROSS JOIN (SELECT range AS k FROM range(32)) d LEFT JOIN {name}_s s ON s.id = i.id AND s.k = d.k GROUP BY i.id)"""


_HYBRID = f"""{_POOLED},
{_bag_sql('cv', "SELECT DISTINCT chunk_id AS id, prefix || content AS text FROM pool")},
{_bag_sql('qv', 'SELECT item_id AS id, text FROM benchmark')},
sim AS (SELECT pool.*, list_cosine_similarity(cv.v, qv.v) AS cosine, min(bm25) OVER p AS low, max(bm25) OVER p AS high FROM pool JOIN cv ON cv.id = chunk_id JOIN qv ON qv.id = query_id WINDOW p AS (PARTITION BY query_id)),
fused AS (SELECT *, 0.5 * CASE WHEN high = low THEN 1.0 ELSE (high - bm25) / (high - low) END + 0.5 * least(1.0, greatest(0.0, (cosine + 1) / 2)) AS score FROM sim),
best AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, r) = 1),
top AS (SELECT query_id, source_id, bm25, cosine, score, {_WINDOW.format('best')} AS text FROM best)"""


@_query("engine_search", f"""WITH RECURSIVE {_CHUNK_INDEX}, s AS (SELECT chunk_id, sum({_SCORE}) AS s FROM post JOIN idf USING (term), st WHERE term IN ('nicht', 'que') GROUP BY chunk_id)
    SELECT source_id, CAST(0 AS INTEGER) AS page, round(s, 6) AS score, CAST(row_number() OVER (ORDER BY round(s, 9), source_id, ordinal) AS INTEGER) AS rank FROM s JOIN chunk USING (chunk_id) QUALIFY rank <= 10""")
def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest all documents and answer a match expression from the postings."""
    found = _ingested(spark, sf_dir, embed=False).search("nicht OR que", 10)
    return found.select("source_id", "page", F.round("score", 6).alias("score"), "rank")


@_query(
    "engine_context",
    f"""{_POOLED},
    walk AS (SELECT query_id, 0 AS r, CAST([] AS VARCHAR[]) AS used, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT query_id FROM pool)
      UNION ALL
      SELECT walk.query_id, pool.r, CASE WHEN list_contains(used, source_id || ':' || ordinal) OR len(kept) >= 3 THEN used ELSE list_concat(used, [source_id || ':' || (ordinal - 1), source_id || ':' || ordinal, source_id || ':' || (ordinal + 1)]) END,
        CASE WHEN list_contains(used, source_id || ':' || ordinal) OR len(kept) >= 3 THEN kept ELSE list_append(kept, pool.r) END
      FROM walk JOIN pool ON pool.query_id = walk.query_id AND pool.r = walk.r + 1),
    fin AS (SELECT query_id, arg_max(kept, r) AS kept FROM walk GROUP BY query_id),
    place AS (SELECT query_id, unnest(kept) AS r, generate_subscripts(kept, 1) AS rank FROM fin)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, pool.source_id, round(bm25, 6) AS score, sha256({_WINDOW.format('pool')}) AS digest FROM place JOIN pool USING (query_id, r)""",
)
def engine_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest all documents; three passages with their neighbours for every benchmark text, by words alone."""
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    found = _ingested(spark, sf_dir, embed=False).search_with_context(asked, 3, 1)
    return found.select("query_id", "rank", "source_id", F.round("score", 6).alias("score"), F.sha2("text", 256).alias("digest"))


@_query("engine_hybrid", f"{_HYBRID} SELECT query_id, source_id, round(bm25, 6) AS bm25, round(cosine, 6) AS cosine, round(score, 6) AS score, sha256(text) AS digest FROM top")
def engine_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest and embed all documents; the best passage by words and vectors for every benchmark text."""
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    found = _ingested(spark, sf_dir).search_hybrid(asked, 1, 1)
    return found.select("query_id", "source_id", *[F.round(c, 6).alias(c) for c in ("bm25", "cosine", "score")], F.sha2("text", 256).alias("digest"))


@_query(
    "engine_upkeep",
    f"""WITH RECURSIVE {_INGESTED}, n AS (SELECT source_id, count(*) AS chunks FROM chunk GROUP BY source_id)
    SELECT source_id, CAST(CASE WHEN source_id = 'd1' THEN 1 ELSE chunks END AS INTEGER) AS chunks, CAST(CASE WHEN source_id = 'd1' THEN 2 ELSE 0 END AS BIGINT) AS tags FROM n WHERE source_id <> 'd0'""",
)
def engine_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest all documents, delete one source, put another text and tags in place of a second, and list the sources."""
    engine = _ingested(spark, sf_dir, embed=False)
    engine.delete("d0")
    engine.set_tags("d1", ["red", "blue", "red"])
    engine.ingest_text("Another text altogether.", "d1")  # tags stay
    tags = engine.store.read("tags").groupBy("source_id").agg(F.count("*").alias("tags"))
    return engine.store.read("sources").join(tags, "source_id", "left").select("source_id", "chunks", F.coalesce("tags", F.lit(0)).alias("tags"))


@_query(
    "answer_batch",
    f"""{_HYBRID}, w AS (SELECT query_id, score, split_part(text, chr(10), 1) AS line FROM top)
    SELECT query_id, trim(CASE WHEN regexp_matches(line, '^.+?[.!?](\\s|$)') THEN regexp_extract(line, '^(.+?[.!?])(\\s|$)', 1) ELSE line END) || ' [1]' AS text,
      CAST(1 AS INTEGER) AS n_citations, round(least(1, greatest(0, score)), 6) AS confidence, false AS refused FROM w""",
)
def answer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a question to an index of all documents."""
    from .sources.generators import FirstSentenceGenerator

    engine = _ingested(spark, sf_dir, generator=FirstSentenceGenerator())
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return engine.answer(asked).select("query_id", "text", F.size("citations").alias("n_citations"), F.round("confidence", 6).alias("confidence"), "refused")


@_query("docx_load", "SELECT CAST(n_nationkey AS VARCHAR) AS source_id, n_name || chr(10) || 'end' AS text FROM nation")
def docx_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as small word-processing documents."""
    def packed(name: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{name}</w:t></w:r><w:r><w:br/><w:t>end</w:t></w:r></w:p></w:body></w:document>')
        return out.getvalue()

    pack = F.udf(packed, T.BinaryType(), useArrow=True)
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("source_id"), pack("n_name").alias("bytes"))
    return _loaded(spark, rows, "org.openxmlformats.wordprocessingml.document").select("source_id", "text")


@_query("stream_ingest", "SELECT CAST(0 AS INTEGER) AS ordinal, r_name || ' is a region.' AS content FROM region")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a directory as a stream of ingests; the chunks that result."""
    from .streaming.ingest import ingest_stream

    at = scratch_dir(spark, "stream")
    _table(spark, sf_dir, "region").repartitionByRange(5, "r_regionkey").select(F.concat("r_name", F.lit(" is a region."))).write.text(f"{at}/in")
    engine = _engine(spark)
    ingest_stream(engine, f"{at}/in", f"{at}/checkpoint", "*.txt").awaitTermination()
    return engine.store.read("chunks").select("ordinal", "content")


@_query(
    "engine_filters",
    f"""WITH RECURSIVE {_CHUNK_INDEX}, s AS (SELECT chunk_id, sum({_SCORE}) AS s FROM post JOIN idf USING (term), st WHERE term IN ('nicht', 'que') GROUP BY chunk_id),
    kept AS (SELECT source_id, CASE WHEN CAST(substr(source_id, 2) AS BIGINT) % 3 = 0 THEN 'tags' ELSE 'scope' END AS filter, s, ordinal FROM s JOIN chunk USING (chunk_id)
      WHERE CAST(substr(source_id, 2) AS BIGINT) % 3 = 0 OR CAST(substr(source_id, 2) AS BIGINT) < 150)
    SELECT filter, source_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY filter ORDER BY round(s, 9), source_id, ordinal) AS INTEGER) AS rank FROM kept QUALIFY rank <= 10""",
)
def engine_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters by tag, and by a set of sources with a range of pages and file types; statistics stay those of all chunks."""
    engine = _ingested(spark, sf_dir, embed=False, tags=lambda docs: docs.where("doc_id % 3 = 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.lit("third").alias("tag")))
    kinds = {"tags": RetrievalFilter(tags={"third", "none"}), "scope": RetrievalFilter(source_ids={f"d{i}" for i in range(150) if i % 3}, page_range=(0, 3), file_types={"text"})}
    found = [engine.search("nicht OR que", 10, where).select(F.lit(name).alias("filter"), "source_id", F.round("score", 6).alias("score"), "rank") for name, where in kinds.items()]
    return found[0].unionByName(found[1])


@_query(
    "engine_vectors",
    f"""WITH RECURSIVE {_INGESTED}, {_bag_sql('cv', "SELECT chunk_id AS id, prefix || content AS text FROM chunk")}, {_bag_sql('qv', 'SELECT item_id AS id, text FROM benchmark')},
    sim AS (SELECT qv.id AS query_id, source_id, ordinal, chunk_id, list_cosine_similarity(cv.v, qv.v) AS score FROM qv, cv JOIN chunk ON chunk_id = cv.id),
    best AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) = 1)
    SELECT query_id, source_id, round(score, 6) AS score, sha256({_WINDOW.format('best')}) AS digest FROM best""",
)
def engine_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passage by vectors alone for every benchmark text."""
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    found = _ingested(spark, sf_dir).search_vectors(asked, 1, 1)
    return found.select("query_id", "source_id", F.round("score", 6).alias("score"), F.sha2("text", 256).alias("digest"))


@_query(
    "prefix_by_model",
    f"""WITH RECURSIVE {_INGESTED}, n AS (SELECT *, coalesce(lag(content) OVER w, '') AS l, coalesce(lead(content) OVER w, '') AS r FROM chunk WINDOW w AS (PARTITION BY source_id ORDER BY ordinal))
    SELECT chunk_id, length(right(l, 800)) || ' ' || length(left(content, 1600)) || ' ' || length(left(r, 800)) AS prefix FROM n""",
)
def prefix_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context prefixes by a generator that counts the characters of the prompt's three parts."""
    from .schema import EngineConfig, IndexingConfig
    from .sources.generators import ModelPrefix

    class Counting:
        def generate(self, messages):
            before, rest = messages[-1][1].split("\nBefore:\n", 1)[1].split("\nPassage:\n", 1)
            passage, after = rest.rsplit("\nAfter:\n", 1)
            return f"Answer: {len(before)} {len(passage)} {len(after)}."

    engine = _ingested(spark, sf_dir, embed=False, config=EngineConfig(indexing=IndexingConfig(context_fn=ModelPrefix(Counting()))))
    return engine.store.read("chunks").select("chunk_id", F.col("context_prefix").alias("prefix"))


@_query("fake_vectors", "SELECT doc_id, list_transform(range(4), lambda i: CAST(CAST(0.01 * i + CAST('0x' || substr(sha256(text), 1, 2) AS BIGINT) + 1 AS FLOAT) AS DOUBLE)) AS vec FROM documents")
def fake_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.embedders import ConstantEmbedder, embed

    return embed(_documents(spark, sf_dir).select("doc_id", "text"), ConstantEmbedder(4), "text").select("doc_id", F.col("vec").cast("array<double>").alias("vec"))


@_query("local_embedder", "SELECT doc_id, [CAST(0.6 AS FLOAT)::DOUBLE, CAST(0.8 AS FLOAT)::DOUBLE] AS vec FROM documents")
def local_embedder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that each worker loads once; vectors are cut to the dimension and scaled to unit length."""
    from .schema import EmbeddingModel
    from .sources.embedders import LocalEmbedder, embed

    provider = LocalEmbedder(EmbeddingModel("three-four", 2), lambda: lambda texts: [[3.0, 4.0, 12.0]] * len(texts))
    return embed(_documents(spark, sf_dir).select("doc_id", "text"), provider, "text").select("doc_id", F.col("vec").cast("array<double>").alias("vec"))


def _as_bytes(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    return _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_id"), text.cast("binary").alias("bytes"))


_PLAIN = r"replace(text, ' ', chr(13) || chr(10))"


@_query("load_plain", f"SELECT CAST(doc_id AS VARCHAR) AS source_id, sha256(replace(replace({_PLAIN}, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM documents")
def load_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text with other line ends."""
    rows = _as_bytes(spark, sf_dir, F.replace("text", F.lit(" "), F.lit("\r\n")))
    return _loaded(spark, rows, "public.plain-text").select("source_id", F.sha2("text", 256).alias("digest"))


@_query("load_markdown", "SELECT CAST(doc_id AS VARCHAR) AS source_id, sha256('# ' || replace(text, ' ', '-' || chr(10))) AS digest FROM documents")
def load_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown keeps its marks, and hyphens at line ends."""
    rows = _as_bytes(spark, sf_dir, F.concat(F.lit("# "), F.replace("text", F.lit(" "), F.lit("-\r\n"))))
    return _loaded(spark, rows, "net.daringfireball.markdown").select("source_id", F.sha2("text", 256).alias("digest"))


@_query(
    "load_pdf",
    """WITH p AS (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), [''])) AS t, generate_subscripts(list_concat(string_split(text, chr(10)), ['']), 1) - 1 AS page FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS source_id, CAST(page AS INTEGER) AS page, sha256(CASE WHEN length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) = 0 THEN 'read ' || page
      WHEN length(regexp_replace(t, '[\\s\\p{Z}]', '', 'g')) >= 64 AND length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) < 0.1 * length(regexp_replace(t, '[\\s\\p{Z}]', '', 'g')) THEN 'read ' || page ELSE t END) AS digest FROM p""",
)
def load_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that takes lines for pages, and a recogniser for those without text."""
    from .sources.loaders import load

    rows = _as_bytes(spark, sf_dir, F.concat("text", F.lit("\n")))
    made = rows.select("source_id", F.lit("data").alias("kind"), F.lit("com.adobe.pdf").alias("uti"), F.lit("n").alias("name"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("text"), "bytes")
    pages = load(made, pdf=lambda data: data.decode().replace("a", "\xada").split("\n"), ocr=lambda data, page: f"read {page}")
    return pages.select("source_id", "page", F.sha2("text", 256).alias("digest"))


@_query("load_image", "SELECT CAST(doc_id AS VARCHAR) AS source_id, CAST(0 AS INTEGER) AS page, CASE WHEN doc_id % 7 = 0 THEN '' ELSE CAST(octet_length(encode(text)) AS VARCHAR) END AS text FROM documents WHERE text <> ''")
def load_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recogniser that tells the size of an image, and fails for some."""
    from .sources.loaders import load

    rows = _documents(spark, sf_dir).where("text <> ''").select(F.col("doc_id").cast("string").alias("source_id"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("!"), "text")).otherwise(F.col("text")).cast("binary").alias("bytes"))
    made = rows.select("source_id", F.lit("data").alias("kind"), F.lit("public.png").alias("uti"), F.lit("n").alias("name"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("text"), "bytes")

    def size(data: bytes) -> str:
        if data[:1] == b"!":
            raise ValueError("unreadable")
        return str(len(data))

    return load(made, ocr=size).select("source_id", "page", "text")


_WORDS = r"string_split(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), ' ')"


@_query(
    "snippet",
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), l AS (SELECT doc_id, w, list_transform(w, lambda x: lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}_-]', '', 'g'))) AS f FROM w),
    s AS (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 18) + 1)) AS a, f FROM l),
    c AS (SELECT doc_id, w, a, len(list_filter({list(TERMS)}, lambda t: list_contains(f[a + 1 : a + 18], t))) AS n FROM s),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, a) = 1)
    SELECT doc_id, CASE WHEN a > 0 THEN '…' ELSE '' END || array_to_string(w[a + 1 : a + 18], ' ') || CASE WHEN a + 18 < len(w) THEN '…' ELSE '' END AS snippet FROM b""",
)
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eighteen words of each document with the most of three terms."""
    terms = F.array(*[F.lit(t) for t in TERMS])
    return spread(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", windows.snippet(F.col("text"), terms).alias("snippet"))


@_query("answer_metrics", """WITH a AS (SELECT conv_id % 2 = 0 AS must, turn % 3 = 0 AS no, contains(lower(text), 'the') AS the, conv_id % 5 = 0 AS asked FROM conversations)
    SELECT CAST(count(*) AS BIGINT) AS queries, round(coalesce(avg(CASE WHEN NOT no THEN 0.5 END), 0), 6) AS citation_coverage,
      round(coalesce(avg(CASE WHEN asked THEN CASE WHEN the AND NOT no THEN 1.0 ELSE 0.0 END END), 0), 6) AS expected_contained, round(avg(CASE WHEN no = must THEN 1.0 ELSE 0.0 END), 6) AS refusal_correct FROM a""")
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of replies of two sentences of which one is marked, or of refusals."""
    rows = _table(spark, sf_dir, "conversations").withColumn("query_id", F.concat_ws(":", "conv_id", "turn"))
    flat = F.regexp_replace("text", r"[.!?\[\]]", " ")
    answers = rows.select("query_id", F.when(F.col("turn") % 3 == 0, F.lit("sorry, no")).otherwise(F.concat(flat, F.lit(" x. Marked [1]."))).alias("text"))
    judged = rows.select("query_id", F.when(F.col("conv_id") % 5 == 0, F.array(F.lit("THE"))).alias("expected_answer_contains"), (F.col("conv_id") % 2 == 0).alias("must_refuse"))
    out = evaluate.answer_metrics(answers, judged, "sorry, no")
    return out.select("queries", *[F.round(c, 6).alias(c) for c in ("citation_coverage", "expected_contained", "refusal_correct")])


@_query("vector_blob", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE embedding IS NOT NULL")
def vector_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors to little-endian blobs and back."""
    rows = _vectors(spark, sf_dir).where("vec IS NOT NULL")
    return rows.select("vec_id", from_blob(to_blob(F.col("vec"))).cast("array<double>").alias("vec"))
