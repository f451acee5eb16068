"""The engine: one object for ingest, retrieval, answers and upkeep of an index directory."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, windows
from ..operators import index as ix
from ..operators.pool import settled
from ..session import scratch_dir
from ..schema import AnswerPolicy, EngineConfig, EngineError, MMRConfig, RetrievalFilter
from ..sources import loaders
from ..sources.embedders import EmbeddingProvider
from ..sources.generators import TextGenerator
from ..sources.types import file_type
from . import evaluate as ev
from .answer import answer, answer_stream
from .retrieve import Searcher

#: A step of an ingest: (phase, rows done, rows in all).
Progress = Callable[[str, int, int | None], None]


class Task:
    """A call in a thread of its own, whose Spark jobs can be cancelled together."""

    def __init__(self, spark: SparkSession, call: Callable[[], object]) -> None:
        self._context, self._group, self._cancelled = spark.sparkContext, f"passages-{uuid.uuid4().hex}", False
        self._result: object = None
        self._error: BaseException | None = None

        def run() -> None:
            self._context.setJobGroup(self._group, "passages", interruptOnCancel=True)
            try:
                self._result = call()
            except BaseException as e:  # noqa: BLE001  handed to result()
                self._error = e

        self._thread = InheritableThread(target=run, daemon=True)
        self._thread.start()

    def done(self) -> bool:
        return not self._thread.is_alive()

    def cancel(self) -> None:
        self._cancelled = True
        while self._thread.is_alive():  # a call may be between two jobs
            self._context.cancelJobGroup(self._group)
            self._thread.join(0.1)

    def result(self, timeout: float | None = None) -> object:
        """What the call returned; code 499 if it was cancelled before its end."""
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError
        if self._error is not None:
            raise EngineError(499, "cancelled") if self._cancelled else self._error
        return self._result


class Engine:
    """An index at a path, or in a folder of its own under spark.checkpoint.dir (in local mode, where that is unset, a temporary one)."""

    def __init__(self, spark: SparkSession, path: str | None = None, provider: EmbeddingProvider | None = None, generator: TextGenerator | None = None, config: EngineConfig = EngineConfig(), pdf=None, ocr=None) -> None:
        self.spark, self.provider, self.generator, self.config, self.pdf, self.ocr = spark, provider, generator, config, pdf, ocr
        self.store = ix.IndexStore(spark, path or scratch_dir(spark, "index"))

    # ingest

    def ingest(self, rows: DataFrame | Iterable[dict], tags: dict[str, list[str]] | DataFrame | None = None, embed: bool = True, progress: Progress | None = None) -> DataFrame:
        """Load, clean, chunk and store inputs, replacing sources of the same id; (source_id, pages, chunks) of each."""
        say = progress or (lambda *a: None)
        inputs = rows if isinstance(rows, DataFrame) else loaders.inputs(self.spark, rows)
        say("loading", 0, None)
        listed = settled(inputs.drop("text", "bytes"), "listed")  # what needs no text is read from here
        kinds = loaders.kinds_of(listed)
        raw = loaders.load(inputs, self.pdf, self.ocr, kinds=kinds)
        if self.pdf or self.ocr:
            raw = settled(raw, "raw")  # each page is read and recognised once
        counts = settled((listed if kinds <= loaders.ONE_PAGE else raw).groupBy("source_id").agg(F.count("*").cast("int").alias("pages")), "counts")
        say("loading", counts.agg(F.sum("pages")).first()[0] or 0, None)
        pages = chunking.strip_running_lines(raw, settle=lambda df: settled(df, "running"), counts=counts)
        # The header comes along with its page, and texts are dealt out only for sources of several pages.
        one_page, prefix = counts.where("pages > 1").isEmpty(), self.config.indexing.use_prefix
        made = chunking.chunks(pages, self.config.chunking, one_page, prefix and getattr(self.config.indexing.context_fn, "prompted", False), prefix)
        cache, made_prefixes = self.store.read("prefixes"), None
        if self.config.indexing.use_prefix:
            asked = self.config.indexing.context_fn is not None
            made, made_prefixes = chunking.with_prefixes(made, pages, self.config.indexing.context_fn, cache)[0], (lambda rows: chunking.cache_rows(rows, cache)) if asked else None
        else:
            made = made.withColumn("context_prefix", F.lit(""))
        sources = listed.select(
            "source_id", F.col("name").alias("display_name"), F.col("path").alias("file_path"), F.lit(None).cast("string").alias("url"), "uti", file_type(F.col("uti")).alias("file_type")
        ).dropDuplicates(["source_id"]).join(counts, "source_id", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
        tag_rows = None
        if isinstance(tags, DataFrame):
            tag_rows = tags.select("source_id", "tag")
        elif tags is not None:
            tag_rows = self.spark.createDataFrame([(s, t) for s, ts in tags.items() for t in ts], "source_id string, tag string")
        ix.replace_sources(self.store, sources, made, tag_rows, made_prefixes, self.config.indexing.index_text, lambda rows: say("chunking", rows.count(), None))
        if embed and self.provider is not None:
            say("embedding", ix.backfill(self.store, self.config.index_id, self.provider, None, self.config.indexing.index_text), None)
        out = self.store.read("sources").join(sources.select("source_id"), "source_id", "left_semi").select("source_id", "pages", "chunks")
        return out

    def ingest_async(self, rows: DataFrame | Iterable[dict], **options) -> Task:
        """ingest() in a thread; cancel() of the task stops its Spark jobs, and the index stays as it was."""
        return Task(self.spark, lambda: self.ingest(rows, **options))

    def ingest_text(self, text: str, name: str = "text", tags: list[str] | None = None) -> str:
        self.ingest([{"source_id": name, "text": text, "name": name}], {name: tags} if tags is not None else None)
        return name

    def ingest_files(self, path: str) -> DataFrame:
        """Files of a path or pattern; the file name is the source id."""
        return self.ingest(loaders.files(self.spark, path))

    def backfill(self, source: str | None = None) -> int:
        return ix.backfill(self.store, self.config.index_id, self.provider, source, self.config.indexing.index_text)

    # upkeep

    def delete(self, source: str) -> None:
        ix.delete_source(self.store, source)

    def set_tags(self, source: str, tags: list[str]) -> None:
        ix.set_tags(self.store, source, tags)

    def tags(self, source: str) -> list[str]:
        return ix.tags_of(self.store, source)

    def sources(self) -> DataFrame:
        return ix.listed(self.store)

    def source(self, source: str) -> dict | None:
        row = self.store.read("sources").where(F.col("source_id") == source).first()
        return row.asDict() if row else None

    def chunks(self, source: str) -> DataFrame:
        return self.store.read("chunks").where(F.col("source_id") == source).orderBy("ordinal")

    def index_info(self) -> tuple[str, int] | None:
        return ix.index_info(self.store, self.config.index_id)

    # retrieval

    def searcher(self) -> Searcher:
        return Searcher(self.store, self.config.index_id, self.provider, self.config.indexing.index_text)

    def queries(self, questions: str | Iterable[str] | DataFrame) -> DataFrame:
        if isinstance(questions, DataFrame):
            return questions
        rows = [questions] if isinstance(questions, str) else list(questions)
        return self.spark.createDataFrame(list(enumerate(rows)), "query_id long, question string")

    def search(self, expression: str, limit: int = 10, where: RetrievalFilter | None = None, source: str | None = None) -> DataFrame:
        return self.searcher().search(expression, limit, where, source)

    def search_with_context(self, questions, limit: int = 5, expand: int = 1, **options) -> DataFrame:
        return self.searcher().with_context(self.queries(questions), limit, expand, **options)

    def search_hybrid(self, questions, limit: int = 5, expand: int = 1, **options) -> DataFrame:
        return self.searcher().hybrid(self.queries(questions), limit, expand, **options)

    def search_vectors(self, questions, limit: int = 5, expand: int = 1, **options) -> DataFrame:
        return self.searcher().vectors(self.queries(questions), limit, expand, **options)

    def retrieve(self, questions, limit: int = 5, expand: int = 1, diversify: MMRConfig | None = None, **options) -> DataFrame:
        return self.searcher().retrieve(self.queries(questions), limit, expand, diversify, **options)

    def fetch_document(self, source: str, anchor: str | None = None, start_page: int | None = None, expand: int = 1, max_chars: int = 8000) -> dict:
        return windows.fetch_document(self.store.read("chunks"), source, anchor, start_page, expand, max_chars)

    # answers

    def answer(self, questions, policy: AnswerPolicy = AnswerPolicy(), limit: int = 5, strict: bool = False) -> DataFrame:
        return answer(self.searcher(), self.queries(questions), self.generator, policy, limit, strict)

    def answer_stream(self, question: str, policy: AnswerPolicy = AnswerPolicy(), limit: int = 5, strict: bool = False):
        return answer_stream(self.searcher(), question, self.generator, policy, limit, strict)

    def evaluate(self, path: str, policy: AnswerPolicy = AnswerPolicy(), limit: int = 5) -> dict[str, float]:
        """Ingest a fixture's documents with their tags, ask all its queries in one job, and measure what is found and answered."""
        fix = ev.fixture(self.spark, path).persist()
        docs = ev.fixture_documents(fix)
        inputs = docs.select("source_id", F.lit("text").alias("kind"), F.lit("public.plain-text").alias("uti"), "name", F.lit(None).cast("string").alias("path"), "text", F.lit(None).cast("binary").alias("bytes"))
        self.ingest(inputs, docs.select("source_id", F.explode("tags").alias("tag")))
        asked = ev.fixture_queries(fix)
        widest = max(limit, asked.agg(F.max("limit")).first()[0] or 0)
        found = self.retrieve(asked.select("query_id", "question"), widest).select("query_id", "rank", "source_id")
        judged = asked.select("query_id", F.col("must_cite_source_ids").alias("must"), F.col("limit").alias("k"))
        out = ev.summary(ev.retrieval_metrics(found, judged)).first().asDict()
        if self.generator is not None:
            answers = self.answer(asked.select("query_id", "question"), policy, limit)
            out |= ev.answer_metrics(answers, asked.select("query_id", "expected_answer_contains", "must_refuse"), policy.refusal_text).first().asDict()
        fix.unpersist()
        return out
