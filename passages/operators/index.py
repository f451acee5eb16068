"""The index: tables in buckets of sources, and numbered manifests that name the current files.

A source and its pages are in one of ``BUCKETS`` buckets, each of some files, and a
change writes only the touched buckets of a table anew: its rows that stay, by an
anti join, and the new ones. A commit then puts the next manifest beside the last one by a rename.
Readers take the manifest with the highest number, so they see the old or the new
state and never half of one, also if a writer dies at any step; of two writers that
began with the same manifest the later one fails with code 409. What is replaced
stays until vacuum().

Postings are dealt out by source too, in each file in runs sorted by term, so a
search reads of every bucket the pages of its terms.
"""

from __future__ import annotations

import contextlib
import json
import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..schema import CHUNKS, INDEXES, LENGTHS, POSTINGS, PREFIXES, SOURCES, TAGS, VECTORS, EmbeddingModel, EngineError, RetrievalFilter
from ..sources.embedders import EmbeddingProvider, embed
from . import inrow

TABLES: dict[str, T.StructType] = {"sources": SOURCES, "chunks": CHUNKS, "tags": TAGS, "vectors": VECTORS, "postings": POSTINGS, "lengths": LENGTHS, "indexes": INDEXES, "prefixes": PREFIXES}


BUCKETS = 32  # a listing of more paths is a job of its own
_MANIFEST = re.compile(r"manifest-([0-9]{12})\.json")


def bucket(table: str) -> Column:
    """The bucket of a row: by its source without the page, or by the key of a cached prefix."""
    if table == "indexes":
        return F.lit(0)
    key = F.col("key") if table == "prefixes" else F.substring_index("source_id", " p.", 1)
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


#: Bytes of a row group of chunks, and of chunk files that one task makes postings from: it sorts them in runs of bounded size.
GROUP_BYTES, SPLIT_BYTES = 8 << 20, 32 << 20
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.maxConcurrentOutputFileWriters": str(BUCKETS),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.files.maxPartitionBytes": str(SPLIT_BYTES),
    "spark.sql.files.openCostInBytes": str(1 << 20),
}


@contextlib.contextmanager
def _conf(spark: SparkSession, *keys: str) -> Iterator[None]:
    """These settings of _WRITING hold inside."""
    before = {key: spark.conf.get(key) for key in keys}
    for key in keys:
        spark.conf.set(key, _WRITING[key])
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def writing(spark: SparkSession, derived: bool):
    """Inside, what a query has shuffled is deleted at its end, not when the driver happens to collect its garbage; a task
    holds a file of each bucket open, and what is derived is read in small splits."""
    keys = list(_WRITING)
    return _conf(spark, *(keys if derived else keys[:4]))


class IndexStore:
    """The tables under one directory of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._path(self.path))

    def _names(self) -> list[str]:
        return [status.getPath().getName() for status in self._fs.listStatus(self._path(self.path))]

    def version(self) -> int:
        """The number of the newest manifest, 0 before the first commit."""
        return max((int(m[1]) for m in map(_MANIFEST.fullmatch, self._names()) if m), default=0)

    def _manifest(self, version: int | None = None) -> dict[str, dict[str, str]]:
        """By table and bucket, the directory of its rows."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.path}/manifest-{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, touched: set[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        parts = [f"{self.path}/{at}/__b={b}" for b, at in self._manifest().get(table, {}).items() if touched is None or int(b) in touched]
        if not parts:
            return self._empty(table)
        return self.spark.read.schema(TABLES[table]).parquet(*parts)

    def _empty(self, table: str) -> DataFrame:
        """No rows, and the optimizer knows it: else joins with them deal out texts or broadcast ids."""
        return self.spark.createDataFrame([], TABLES[table]).limit(0)

    def touched(self, rows: DataFrame, table: str = "sources") -> set[int]:
        """The buckets of rows that have a source_id (or a key, for prefixes): BUCKETS numbers at most."""
        return {r[0] for r in rows.select(bucket(table)).distinct().collect()}

    def of(self, source: str) -> set[int]:
        return self.touched(self.spark.range(1).select(F.lit(source).alias("source_id")))

    def commit(self, tables: dict[str, tuple[DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame], set[int] | Callable[[Callable[[str], DataFrame]], set[int]]]], base: int) -> None:
        """Write these buckets of the tables anew and switch to them together; ``base`` is the version they were made from.

        Rows, and the buckets too, may come from a function of what this commit has
        written before: it gets a reader of these tables. Texts are not dealt out:
        each task writes its rows to a file of each bucket, so that an ingest's
        disk is that of its tables. Postings are made file by file.
        """
        written: dict[str, DataFrame] = {}
        manifest = self._manifest(base)
        for name, (rows, touched) in tables.items():
            version = f"{name}-{uuid.uuid4().hex}"
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]]
            in_place = name == "chunks" or callable(rows) and name == "postings"
            with writing(self.spark, callable(rows) and name in ("postings", "lengths")):
                touched = touched(written.__getitem__) if callable(touched) else touched
                rows = rows(written.__getitem__) if callable(rows) else rows
                rows = rows.withColumn("__b", F.col("__b") if "__b" in rows.columns else bucket(name)).select(*columns, "__b")
                rows = rows if in_place else rows.hint("rebalance", "__b")
                if name == "postings" and not in_place:  # a term's rows lie together, so a reader skips the row groups of other terms
                    rows = rows.sortWithinPartitions("__b", "term", "chunk_id")
                out = rows.write.option("compression", "zstd").partitionBy("__b")
                (out.option("parquet.block.size", str(GROUP_BYTES)) if in_place else out).parquet(f"{self.path}/{version}")
            made = {status.getPath().getName() for status in self._fs.listStatus(self._path(f"{self.path}/{version}"))}
            parts = sorted(f"{self.path}/{version}/{b}" for b in made if b.startswith("__b="))
            written[name] = self.spark.read.schema(TABLES[name]).parquet(*parts) if parts else self._empty(name)
            kept = {b: at for b, at in manifest.get(name, {}).items() if int(b) not in touched}
            manifest[name] = kept | {str(b): version for b in sorted(touched) if f"__b={b}" in made}
        fresh, target = self._path(f"{self.path}/fresh-{uuid.uuid4().hex}"), self._path(f"{self.path}/manifest-{base + 1:012d}.json")
        out = self._fs.create(fresh)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self.version() != base or self._fs.exists(target) or not self._fs.rename(fresh, target):
            self._fs.delete(fresh, False)
            raise EngineError(409, "another writer has changed the index")

    def vacuum(self) -> None:
        """Delete what the newest manifest does not name; no writer may be at work."""
        version = self.version()
        live = {at for parts in self._manifest(version).values() for at in parts.values()} | {f"manifest-{version:012d}.json"}
        for name in self._names():
            if name not in live:
                self._fs.delete(self._path(f"{self.path}/{name}"), True)


def in_scope(column, source: str):
    """A source itself or one of its pages, as ``source p.N``."""
    return (column == source) | F.startswith(column, F.lit(f"{source} p."))


def replace_sources(store: IndexStore, sources: DataFrame, chunk_rows: DataFrame, tags: DataFrame | None = None, prefixes: Callable[[DataFrame], DataFrame] | None = None, index_text: str = "augmented", wrote: Callable[[DataFrame], None] = lambda rows: None) -> None:
    """Put new sources with their chunks in place of what the index has under their ids.

    imported_at stays as it was, updated_at is new; tags stay unless given; the
    vectors of replaced chunks go. Only the buckets of these sources are written.
    Chunks are written first, and all else is made from what was written: they are
    computed once, and their postings where their bucket is. ``prefixes`` makes the
    rows that the prefix cache lacks from them; ``wrote`` gets them before the commit.
    """
    base = store.version()
    ids = sources.select("source_id").distinct()
    buckets = store.touched(ids)
    old = store.read("sources", buckets)
    kept = old.select("source_id", F.col("imported_at").alias("__imported"))
    # The commit's number, one for all sources of an ingest: no global order is needed.
    numbered = sources.withColumn("ingest_seq", F.lit(base + 1).cast("long")).join(kept, "source_id", "left")
    new_chunks = lambda of: of("chunks").where(F.col("ingest_seq") == base + 1)

    def listed(of) -> DataFrame:
        counts = new_chunks(of).groupBy("source_id").agg(F.count("*").alias("__chunks"))
        fresh = numbered.join(counts, "source_id", "left")
        fresh = fresh.withColumn("imported_at", F.coalesce("__imported", F.current_timestamp())).withColumn("updated_at", F.current_timestamp()).withColumn("chunks", F.coalesce("__chunks", F.lit(0)))
        return fresh.select(*SOURCES.names)

    text, title = augmented(None, index_text).alias("text"), F.coalesce("section_title", F.lit("")).alias("title")

    def posts(of) -> DataFrame:
        return new_chunks(of).select("chunk_id", "source_id", bucket("postings").alias("__b"), text, title).mapInArrow(inrow.poster(GAP), inrow.POSTING)

    def lengths(of) -> DataFrame:
        return new_chunks(of).select("chunk_id", "source_id", text, title).mapInArrow(inrow.counter, inrow.LENGTH)

    placed = chunk_rows.withColumn("ingest_seq", F.lit(base + 1).cast("long"))
    new = {
        "chunks": placed.select(*CHUNKS.names), "sources": listed, "vectors": None, "postings": posts,
        "lengths": lengths, "tags": _clean_tags(tags) if tags is not None else None,
    }
    tables = {}
    for name, rows in new.items():
        if name == "tags" and rows is None:
            continue
        stay = store.read(name, buckets).join(ids, "source_id", "left_anti")
        stay = stay.withColumn("__b", bucket(name)) if name == "postings" else stay
        if callable(rows):
            tables[name] = (lambda of, stay=stay, rows=rows, name=name: (wrote(new_chunks(of)) if name == "sources" else None, stay.unionByName(rows(of), allowMissingColumns=True))[1], buckets)
        else:
            tables[name] = (stay if rows is None else stay.unionByName(rows, allowMissingColumns=True), buckets)
    if prefixes is not None:
        keys: set[int] = set()  # buckets of the new rows, known once chunks are written

        def cached(of) -> DataFrame:
            return store.read("prefixes", keys).unionByName(prefixes(new_chunks(of)).select(*PREFIXES.names))

        def found(of) -> set[int]:
            keys.update(store.touched(prefixes(new_chunks(of)), "prefixes"))
            return keys

        tables["prefixes"] = (cached, found)
    store.commit(tables, base)


def _clean_tags(tags: DataFrame) -> DataFrame:
    return tags.select("source_id", X.trim(F.col("tag")).alias("tag")).where("tag <> ''").distinct()


def _without(store: IndexStore, source: str, names: tuple[str, ...]) -> None:
    base, buckets = store.version(), store.of(source)
    store.commit({name: (store.read(name, buckets).where(~in_scope(F.col("source_id"), source)), buckets) for name in names}, base)


def delete_chunks(store: IndexStore, source: str) -> None:
    """Remove the chunks and vectors of a source and its pages; the source itself stays."""
    _without(store, source, ("chunks", "vectors", "postings", "lengths"))


def delete_source(store: IndexStore, source: str) -> None:
    """Remove a source with its chunks, vectors and tags; the prefix cache stays."""
    _without(store, source, ("sources", "chunks", "vectors", "tags", "postings", "lengths"))


def set_tags(store: IndexStore, source: str, tags: list[str]) -> None:
    base, buckets = store.version(), store.of(source)
    rows = store.spark.createDataFrame([(source, t) for t in tags], TAGS)
    store.commit({"tags": (store.read("tags", buckets).where(F.col("source_id") != source).unionByName(_clean_tags(rows)), buckets)}, base)


def tags_of(store: IndexStore, source: str) -> list[str]:
    return [r.tag for r in store.read("tags").where(F.col("source_id") == source).orderBy("tag").collect()]


def listed(store: IndexStore) -> DataFrame:
    """Sources, the last imported first."""
    return store.read("sources").orderBy(F.desc("imported_at"), "source_id")


def check_model(store: IndexStore, index_id: str, model: EmbeddingModel) -> bool:
    """True if the index is registered for this model, False if it is new; 530 for another model."""
    row = store.read("indexes").where(F.col("index_id") == index_id).first()
    if row is None:
        return False
    if (row.model_id, row.dimension) != (model.model_id, model.dimension):
        raise EngineError(530, f"the index holds vectors of {row.model_id} ({row.dimension})")
    return True


def index_info(store: IndexStore, index_id: str) -> tuple[str, int] | None:
    row = store.read("indexes").where(F.col("index_id") == index_id).first()
    return (row.model_id, row.dimension) if row else None


#: What is added to a term's place in a chunk for each column of MATCH_COLUMNS before its own, so that no phrase reaches from one into the next.
GAP = 700_000_000
MATCH_COLUMNS = ("content", "source_id", "section_title")


def index_terms(index_text: str = "augmented"):
    """Array of (term, spot) of a chunk: its indexed text, source and section title."""
    columns = (augmented(None, index_text), F.col("source_id"), F.coalesce("section_title", F.lit("")))
    return F.concat(*[spotted(X.tokens(c), k) for k, c in enumerate(columns)])


def spotted(terms: Column, column: int) -> Column:
    """Array of (term, spot) of the terms of a column of MATCH_COLUMNS."""
    return F.transform(terms, lambda t, i: F.struct(t.alias("term"), (i + column * GAP).alias("spot")))


def augmented(chunk_rows: DataFrame | None, index_text: str = "augmented"):
    """The text that is indexed and embedded: prefix and content, or the content alone."""
    return F.concat(F.coalesce("context_prefix", F.lit("")), F.col("content")) if index_text == "augmented" else F.col("content")


def backfill(store: IndexStore, index_id: str, provider: EmbeddingProvider | None, source: str | None = None, index_text: str = "augmented") -> int:
    """Embed the chunks that lack a vector, in one job; the number of them."""
    if provider is None:
        raise EngineError(410, "no embedding provider")
    base = store.version()
    known = check_model(store, index_id, provider.model)
    missing = store.read("chunks").join(store.read("vectors").where(F.col("index_id") == index_id).select("chunk_id"), "chunk_id", "left_anti")
    if source is not None:
        missing = missing.where(in_scope(F.col("source_id"), source))
    fresh = embed(missing.select("chunk_id", "source_id", augmented(missing, index_text).alias("text")), provider, "text").select("chunk_id", "source_id", F.lit(index_id).alias("index_id"), F.size("vec").alias("dim"), "vec")
    fresh = fresh.persist()
    n = fresh.count()
    buckets = store.touched(fresh)
    tables = {"vectors": (store.read("vectors", buckets).unionByName(fresh), buckets)}
    if not known:
        tables |= _registered(store, index_id, provider.model)
    store.commit(tables, base)
    fresh.unpersist()
    return n


def put_vectors(store: IndexStore, index_id: str, model: EmbeddingModel, rows: DataFrame) -> None:
    """Insert or replace vectors of chunks, from (chunk_id, source_id, vec); 530 if a dimension or the model differs."""
    base = store.version()
    known = check_model(store, index_id, model)
    size = rows.agg(F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("b")).first()
    if size.a is not None and (size.a, size.b) != (model.dimension, model.dimension):
        raise EngineError(530, f"vectors of {size.a} to {size.b} components for a model of {model.dimension}")
    fresh = rows.select("chunk_id", "source_id", F.lit(index_id).alias("index_id"), F.size("vec").alias("dim"), "vec")
    buckets = store.touched(fresh)
    tables = {"vectors": (store.read("vectors", buckets).join(fresh.select("chunk_id", "index_id"), ["chunk_id", "index_id"], "left_anti").unionByName(fresh), buckets)}
    if not known:
        tables |= _registered(store, index_id, model)
    store.commit(tables, base)


def _registered(store: IndexStore, index_id: str, model: EmbeddingModel) -> dict[str, tuple[DataFrame, set[int]]]:
    """The list of vector indexes with this one."""
    return {"indexes": (store.read("indexes").unionByName(store.spark.createDataFrame([(index_id, model.model_id, model.dimension)], INDEXES)), {0})}


def filtered(rows: DataFrame, store: IndexStore, where: RetrievalFilter | None, source: str | None = None, hierarchical: bool = False) -> DataFrame:
    """Rows with source_id and page that pass the filter; empty sets filter nothing, null pages fail a range."""
    if source is not None:
        rows = rows.where(in_scope(F.col("source_id"), source) if hierarchical else F.col("source_id") == source)
    if where is None:
        return rows
    if where.source_ids:
        rows = rows.where(F.col("source_id").isin(*sorted(where.source_ids)))
    if where.page_range:
        rows = rows.where(F.col("page").between(*where.page_range))
    if where.file_types:
        rows = rows.join(store.read("sources").where(F.col("file_type").isin(*sorted(where.file_types))).select("source_id"), "source_id", "left_semi")
    if where.tags:
        rows = rows.join(store.read("tags").where(F.col("tag").isin(*sorted(where.tags))).select("source_id"), "source_id", "left_semi")
    return rows
