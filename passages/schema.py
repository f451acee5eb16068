"""Row schemas, settings and errors of the engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T


class EngineError(Exception):
    """An error with the numeric code that callers test for."""

    def __init__(self, code: int, message: str) -> None:
        super().__init__(f"{message} (code {code})")
        self.code = code


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(),
    "array<int>": T.ArrayType(T.IntegerType()), "array<float>": T.ArrayType(T.FloatType()),
}


def _struct(text: str) -> T.StructType:
    """A flat schema from "name type, ..."; workers import this module, so no session may be needed."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in text.split(","))])


SOURCES = _struct(
    "source_id string, display_name string, file_path string, url string, uti string, file_type string, "
    "pages int, chunks int, imported_at timestamp, updated_at timestamp, ingest_seq bigint"
)
CHUNKS = _struct(
    "chunk_id string, source_id string, ordinal int, page int, content string, section_title string, "
    "context_prefix string, parent_id string, content_hash string, ingest_seq bigint"
)
POSTINGS = _struct("term string, chunk_id string, source_id string, tf int, dl int, spots array<int>")
LENGTHS = _struct("chunk_id string, source_id string, dl int")
VECTORS = _struct("chunk_id string, source_id string, index_id string, dim int, vec array<float>")
INDEXES = _struct("index_id string, model_id string, dimension int")
TAGS = _struct("source_id string, tag string")
PREFIXES = _struct("key string, value string, meta string, created_at timestamp")
PAGES = _struct("source_id string, name string, uti string, page int, text string")
INPUTS = _struct("source_id string, kind string, uti string, name string, path string, text string, bytes binary")
CITATION = "struct<source_id:string,source_name:string,file_type:string,page:int,section_title:string,chunk_id:string,parent_id:string,excerpt:string>"
FIXTURE = (
    "name string, documents array<struct<name:string,text:string,tags:array<string>>>, "
    "queries array<struct<question:string,must_cite_source_ids:array<string>,must_cite_chunk_ids:array<string>,"
    "expected_answer_contains:array<string>,must_refuse:boolean,limit:int>>"
)


@dataclass(frozen=True)
class ChunkingConfig:
    max_tokens: int = 650
    overlap_tokens: int = 80
    #: Characters that count as one token, in tenths.
    chars_per_token: float = 3.6
    least_chars: int = 200

    @property
    def max_chars(self) -> int:
        return max(self.least_chars, int(self.max_tokens * self.chars_per_token))

    @property
    def overlap_chars(self) -> int:
        return int(self.overlap_tokens * self.chars_per_token)


@dataclass(frozen=True)
class IndexingConfig:
    use_prefix: bool = True
    #: Text of a chunk with its page and document to a prefix; None for the rule.
    context_fn: Callable[[dict], str] | None = None
    #: ``augmented`` indexes prefix and text, ``raw`` the text alone.
    index_text: str = "augmented"


@dataclass(frozen=True)
class RetrievalFilter:
    """Empty collections and None mean no filter."""

    source_ids: frozenset[str] | None = None
    file_types: frozenset[str] | None = None
    tags: frozenset[str] | None = None
    page_range: tuple[int, int] | None = None


@dataclass(frozen=True)
class MMRConfig:
    relevance_weight: float = 0.5
    k: int | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.relevance_weight <= 1:
            raise ValueError("the weight of relevance is between 0 and 1")
        if self.k is not None and self.k <= 0:
            raise ValueError("k is positive")


@dataclass(frozen=True)
class EmbeddingModel:
    model_id: str
    dimension: int


@dataclass(frozen=True)
class AnswerPolicy:
    min_confidence: float | None = None
    require_citations: bool = False
    min_quote_grounding: float | None = None
    min_numeric_consistency: float | None = None
    refusal_text: str = "The sources at hand do not answer this question."

    @classmethod
    def strict(cls) -> AnswerPolicy:
        return cls(min_confidence=0.3, require_citations=True)


@dataclass(frozen=True)
class EngineConfig:
    chunking: ChunkingConfig = field(default_factory=ChunkingConfig)
    indexing: IndexingConfig = field(default_factory=IndexingConfig)
    index_id: str = "default"
