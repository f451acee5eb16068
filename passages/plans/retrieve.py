"""Retrieval plans: every function takes a table of queries (query_id, question) and answers all of them in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vector import cosine, norm
from ..operators import match, rank, windows
from ..operators.index import GAP, MATCH_COLUMNS, IndexStore, filtered
from ..operators.nearest import mmr_nearest, nearest
from ..operators.pool import pool, settled
from ..operators.rerank import mmr, window_dedup
from ..schema import CITATION, EngineError, MMRConfig, RetrievalFilter
from ..sources.embedders import EmbeddingProvider, embed


#: Rows of written hits that are broadcast; more are dealt out.
SENT_ROWS = 1 << 19


def _sent(hits: DataFrame) -> DataFrame:
    """Hits as the small side of a join, if they are few."""
    return F.broadcast(hits) if hits.count() <= SENT_ROWS else hits


class Searcher:
    """An index opened for retrieval, as it was when opened."""

    def __init__(self, store: IndexStore, index_id: str = "default", provider: EmbeddingProvider | None = None, index_text: str = "augmented", compat: bool = False) -> None:
        self.store, self.index_id, self.provider, self.compat = store, index_id, provider, compat
        self.chunks = store.read("chunks")
        self.index_text = index_text
        # Postings and lengths are tables of the index; only the one row of statistics is computed here.
        self.posts = store.read("postings").drop("source_id")
        self.stats = store.read("lengths").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))

    def terms(self, queries: DataFrame) -> DataFrame:
        """(query_id, term): index terms of each question; a question without words has none and finds nothing."""
        words = F.flatten(F.transform(X.query_terms(F.col("question"), self.compat), lambda w: F.array(w)))
        rows = queries.select("query_id", F.explode(words).alias("term"))
        return rows.withColumn("term", X.fold(F.col("term")))

    def hits(self, queries: DataFrame, limit: int, where: RetrievalFilter | None = None, source: str | None = None, hierarchical: bool = False) -> DataFrame:
        """The candidate pool: chunks with bm25 and rank; filters come after the scores and before the limit."""
        allowed = filtered(self.chunks.select("chunk_id", "ingest_seq", "source_id", "ordinal", "page"), self.store, where, source, hierarchical)
        return self._texts(pool(self.posts.select("chunk_id", "term", "tf", "dl"), self.stats, self.terms(queries), allowed, limit))

    def _texts(self, found: DataFrame) -> DataFrame:
        """Written hits with the columns of their chunks; texts of other chunks are not dealt out."""
        return self.chunks.join(_sent(found), "chunk_id")

    def matched(self, expression: str, limit: int, where: RetrievalFilter | None = None, source: str | None = None, hierarchical: bool = True) -> DataFrame:
        """The pool of one match expression, as query 0; it is ranked by keys, before texts are read."""
        found = match.search_postings(self.posts, self.stats, "chunk_id", MATCH_COLUMNS, GAP, expression)
        keys = self.chunks.select("chunk_id", "ingest_seq", "source_id", "ordinal", "page")
        scored = filtered(found.withColumn("query_id", F.lit(0)).join(keys, "chunk_id"), self.store, where, source, hierarchical)
        order = [F.round("bm25", rank.PLACES).asc(), F.col("ingest_seq").asc(), F.col("source_id").asc(), F.col("ordinal").asc()]
        return self._texts(settled(rank.top_by(scored, "query_id", order, limit).select("query_id", "chunk_id", "bm25", "rank"), "matched"))

    def search(self, expression: str, limit: int = 10, where: RetrievalFilter | None = None, source: str | None = None) -> DataFrame:
        """(source_id, page, excerpt, score, rank) of a match expression."""
        node = match.parse(expression)
        terms = F.array(*[F.lit(t) for p in match.scored_phrases(node) for t in p.terms]) if match.scored_phrases(node) else F.array().cast("array<string>")
        found = self.matched(expression, limit, where, source)
        return found.select("source_id", "page", windows.snippet(F.col("content"), terms).alias("excerpt"), F.col("bm25").alias("score"), "rank")

    def _window(self, ranked: DataFrame, expand: int, to_parent: bool) -> DataFrame:
        return windows.parents(ranked, self.chunks, expand, _sent) if to_parent else windows.neighbours(ranked, self.chunks, expand, sent=_sent)

    def _emitted(self, ranked: DataFrame, limit: int, expand: int, to_parent: bool) -> DataFrame:
        """Windows of the ranked hits, de-duplicated, with citations."""
        ranked = settled(ranked, "ranked")
        wide = self._window(ranked, expand, to_parent)
        kept = window_dedup(wide, limit)
        names = self.store.read("sources").select("source_id", F.col("display_name").alias("source_name"), "file_type")
        rows = kept.join(names, "source_id", "left")
        cite = F.struct(
            "source_id", F.coalesce("source_name", "source_id").alias("source_name"), "file_type", "page", "section_title", "chunk_id", "parent_id", X.excerpt(F.col("content")).alias("excerpt")
        ).cast(CITATION)
        cosine_ = F.col("cosine") if "cosine" in kept.columns else F.lit(None).cast("double")
        score = F.col("score") if "score" in kept.columns else F.col("bm25")
        return rows.select(
            "query_id", F.col("place").alias("rank"), "source_id", F.col("page").alias("start_page"), X.excerpt(F.col("content")).alias("excerpt"), "text",
            "bm25", cosine_.alias("cosine"), score.alias("score"), F.array(cite).alias("citations"), "chunk_id",
        )

    def with_context(self, queries: DataFrame, limit: int = 5, expand: int = 1, where: RetrievalFilter | None = None, source: str | None = None, to_parent: bool = False, score: Column | None = None) -> DataFrame:
        """Lexical passages: the pool's hits in their windows; ``score`` maps bm25, by default to itself."""
        if limit <= 0:
            raise ValueError("limit is positive")
        out = self._emitted(self.hits(queries, rank.pool_size(limit), where, source), limit, expand, to_parent)
        return out if score is None else out.withColumn("score", score)

    def _query_vectors(self, queries: DataFrame) -> DataFrame:
        return embed(queries.select("query_id", "question"), self.provider, "question", "query_vec").drop("question")

    def hybrid(self, queries: DataFrame, limit: int = 5, expand: int = 1, weight: float = 0.5, where: RetrievalFilter | None = None, source: str | None = None, to_parent: bool = False, diversify: MMRConfig | None = None) -> DataFrame:
        """Passages by fused score; only lexical hits are candidates, vectors only re-score them."""
        if limit <= 0:
            raise ValueError("limit is positive")
        pooled = self.hits(queries, rank.pool_size(limit), where, source)
        if self.provider is None:
            pooled = pooled.withColumn("vec", F.lit(None).cast("array<float>")).withColumn("cosine", F.lit(None).cast("double"))
        else:
            vectors = self.store.read("vectors").where(F.col("index_id") == self.index_id).select("chunk_id", "vec")
            pooled = settled(pooled, "pooled")
            own = vectors.join(_sent(pooled.select("chunk_id").distinct()), "chunk_id")
            pooled = pooled.join(own, "chunk_id", "left").join(self._query_vectors(queries), "query_id", "left")
            pooled = pooled.withColumn("cosine", F.when(F.col("vec").isNotNull(), cosine(F.col("vec"), F.col("query_vec")))).drop("query_vec")
        fused = rank.fuse(pooled, weight).withColumnRenamed("rank", "pool_rank")
        ranked = rank.top_by(fused, "query_id", [F.round("score", rank.PLACES).desc(), F.col("pool_rank").asc()], rank.pool_size(limit))
        if diversify is not None:
            ranked = mmr(ranked, diversify, limit)
        return self._emitted(ranked.drop("vec"), limit, expand, to_parent)

    def vectors(self, queries: DataFrame, limit: int = 5, expand: int = 1, where: RetrievalFilter | None = None, source: str | None = None, to_parent: bool = False, diversify: MMRConfig | None = None) -> DataFrame:
        """Passages by cosine over the whole index; bm25 is 0 and the score the cosine."""
        if self.provider is None:
            raise EngineError(412, "a search by vectors needs an embedding provider")
        vectors = self.store.read("vectors").where(F.col("index_id") == self.index_id).select("chunk_id", "vec")
        rows = filtered(self.chunks, self.store, where, source).select("chunk_id").join(vectors, "chunk_id")
        if diversify is not None:
            ranked = mmr_nearest(rows, self._query_vectors(queries), "chunk_id", diversify, limit)
        else:
            ranked = nearest(rows, self._query_vectors(queries), "chunk_id", rank.pool_size(limit))
        ranked = ranked.select("query_id", "chunk_id", "rank", "score", F.col("score").alias("cosine"), F.lit(0.0).alias("bm25"))
        return self._emitted(self._texts(settled(ranked, "nearest")), limit, expand, to_parent)

    def retrieve(self, queries: DataFrame, limit: int = 5, expand: int = 1, diversify: MMRConfig | None = None, **options) -> DataFrame:
        """Hybrid with a provider, else lexical (whose scores are negative; diversity does not apply)."""
        if self.provider is not None:
            return self.hybrid(queries, limit, expand, diversify=diversify, **options)
        options.pop("weight", None)
        return self.with_context(queries, limit, expand, **options)


#: Queries of one broadcast when vectors are scored.
QUERY_BLOCK = 4096


def score_vectors(rows: DataFrame, query_vectors: DataFrame, key: str, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, vec, score): each row's cosine to each query.

    The queries are a stated set: they are sent in blocks of bounded size, and
    each block is one pass over the vectors.
    """
    n = query_vectors.count()
    blocks = max(1, -(-n // block))
    # Lengths are computed once for each vector, not for each pair.
    rows = rows.select(key, "vec", norm(F.col("vec")).alias("__n"))
    asked = query_vectors.select("query_id", "query_vec", norm(F.col("query_vec")).alias("__q"))
    same, both = F.size("vec") == F.size("query_vec"), F.col("__n") * F.col("__q")
    inner = F.aggregate(F.zip_with("vec", "query_vec", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    score = F.when(~same, cosine(F.col("vec"), F.col("query_vec"))).when(both > 0, inner / both).otherwise(F.lit(0.0))
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        one = rows.crossJoin(F.broadcast(part)).select("query_id", key, "vec", score.alias("score"))
        out = one if out is None else out.unionByName(one)
    return out
