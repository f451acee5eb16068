"""Loaders: rows of inputs become rows of pages (source_id, name, uti, page, text).

Each format is one branch of a union, taken by the rows whose identifier it
supports. Text formats are expressions; binary ones parse in Arrow batches.
PDF and image text come from functions that the caller plugs in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as X
from ..schema import INPUTS, PAGES, EngineError
from . import parsers
from .types import loader_of, uti_of

PdfPages = Callable[[bytes], list[str]]
Ocr = Callable[[bytes], str]

_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Inputs from files: the extension gives the identifier, the file name the source."""
    rows = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(name.alias("source_id"), F.lit("data").alias("kind"), uti_of(F.col("path")).alias("uti"), name.alias("name"), "path", F.lit(None).cast("string").alias("text"), F.col("content").alias("bytes"))


def inputs(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Inputs from dictionaries with source_id and text or bytes; uti defaults to plain text."""
    full = []
    for r in rows:
        kind = "text" if r.get("bytes") is None else "data"
        full.append((r["source_id"], kind, r.get("uti") or "public.plain-text", r.get("name") or r["source_id"], r.get("path"), r.get("text"), r.get("bytes")))
    return spark.createDataFrame(full, INPUTS)


def _decoded(rows: DataFrame) -> Column:
    """Text of a row; bytes that are not UTF-8 count as empty."""
    return F.coalesce("text", F.when(F.is_valid_utf8(F.col("bytes").cast("string")), F.col("bytes").cast("string")), F.lit(""))


def html_text(markup: Column) -> Column:
    """Markup removed, entities decoded, white space collapsed."""
    out = F.regexp_replace(markup, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return X.collapse(decode_entities(out))


@F.pandas_udf(StringType())
def _numeric(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda x: x if x is None else parsers.numeric_entities(x))


def decode_entities(text: Column) -> Column:
    """The named entities in their order, then numeric ones (in Python, only for texts that have any)."""
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.coalesce(_numeric(F.when(F.contains(text, F.lit("&#")), text)), text)


def yaml_lines(text: Column) -> Column:
    """YAML without comments, document marks and blank lines."""
    bare = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda x: X.trim(F.regexp_replace(x, "#.*$", "")))
    return F.array_join(F.filter(bare, lambda x: ~x.isin("", "---", "...")), "\n")


def _parsed(rows: DataFrame, parse: Callable[[bytes], list[tuple[int, str]]]) -> DataFrame:
    """Rows with bytes (or text) through a parser of bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for source, name, uti, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for page, text in parse(data or b""):
                    for column, value in zip(out, (source, name, uti, page, text)):
                        column.append(value)
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=PAGES.names)

    data = F.coalesce("bytes", F.col("text").cast("binary"))
    return rows.select("source_id", "name", "uti", data.alias("data")).mapInArrow(run, PAGES)


#: Loaders that make one page of each input.
ONE_PAGE = {"text", "markdown", "html", "yaml", "image"}


def _loader() -> Column:
    found = loader_of(F.col("uti"))
    return F.when((F.col("kind") == "text") & found.isNull(), "text").otherwise(found)


def kinds_of(rows: DataFrame) -> set[str | None]:
    """The loaders of all inputs, a dozen at most, None for what has none."""
    return {r[0] for r in rows.select(_loader().alias("loader")).distinct().collect()}


def load(rows: DataFrame, pdf: PdfPages | None = None, ocr: Ocr | None = None, check: bool = True, kinds: set[str | None] | None = None) -> DataFrame:
    """Pages of all inputs. ``check`` fails with 400 if some row has no loader (one small job, unless ``kinds`` are known)."""
    kinds = kinds_of(rows) if kinds is None else kinds
    rows = rows.withColumn("loader", _loader())
    if check and None in kinds:
        raise EngineError(400, "no loader takes this type of input")

    def of(loader: str) -> DataFrame:
        return rows.where(F.col("loader") == loader)

    def one_page(part: DataFrame, text: Column) -> DataFrame:
        return part.select("source_id", "name", "uti", F.lit(0).alias("page"), text.alias("text"))

    def strictly(what: str) -> Column:
        """Decoded bytes; fails with 404 where they are not UTF-8."""
        good = F.col("bytes").isNull() | F.is_valid_utf8(F.col("bytes").cast("string"))
        return F.when(good, F.coalesce("text", F.col("bytes").cast("string"))).otherwise(F.raise_error(F.lit(f"{what} is not UTF-8 (code 404)")))

    branches = {
        "text": lambda: one_page(of("text"), X.normalize(_decoded(rows))),
        "markdown": lambda: one_page(of("markdown"), X.normalize_markdown(strictly("markdown"))),
        "html": lambda: one_page(of("html"), html_text(strictly("HTML"))),
        "yaml": lambda: one_page(of("yaml"), yaml_lines(strictly("YAML"))),
        "docx": lambda: _parsed(of("docx"), parsers.docx),
        "rtf": lambda: _parsed(of("rtf"), parsers.rtf),
        "csv": lambda: _parsed(of("csv"), lambda b: parsers.delimited(b, ",")),
        "tsv": lambda: _parsed(of("tsv"), lambda b: parsers.delimited(b, "\t")),
        "json": lambda: _parsed(of("json"), parsers.flat_json),
        "xml": lambda: _parsed(of("xml"), parsers.flat_xml),
        "pdf": lambda: _pdf(of("pdf"), pdf, ocr),
        "image": lambda: _image(of("image"), ocr),
    }
    out = None
    for kind in sorted(k for k in kinds if k):
        part = branches[kind]()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], PAGES)


def _pdf(rows: DataFrame, pdf: PdfPages | None, ocr: Ocr | None) -> DataFrame:
    """Pages from the plugged-in reader; soft hyphens go, and pages without text go through OCR if there is one."""
    if pdf is None:
        raise EngineError(401, "no PDF reader is plugged in")

    def parse(data: bytes) -> list[tuple[int, str]]:
        try:
            return [(i, t.replace("\xad", "")) for i, t in enumerate(pdf(data))]
        except EngineError:
            raise
        except Exception as e:
            raise EngineError(401, f"the PDF cannot be opened: {e}") from None

    pages = _parsed(rows, parse)
    text = X.normalize(F.col("text"))
    if ocr is not None:
        data = rows.select("source_id", F.coalesce("bytes", F.col("text").cast("binary")).alias("data"))
        read = F.udf(lambda data, page: _recognised(ocr, data, page), "string", useArrow=True)
        pages = pages.join(data, "source_id").withColumn("text", F.when(X.needs_ocr(F.col("text")), F.coalesce(read("data", "page"), "text")).otherwise(F.col("text")))
    return pages.select("source_id", "name", "uti", "page", text.alias("text"))


def _recognised(ocr: Ocr, data: bytes, page: int) -> str | None:
    """OCR of a page; a failure keeps the extracted text. The function may take the page's number."""
    try:
        return ocr(data, page) if ocr.__code__.co_argcount > 1 else ocr(data)
    except Exception:  # noqa: BLE001  whatever a plugged-in recogniser raises
        return None


def _image(rows: DataFrame, ocr: Ocr | None) -> DataFrame:
    """Recognised text of images; empty where recognition fails."""
    if ocr is None:
        raise EngineError(408, "no text recogniser is plugged in")

    def parse(data: bytes) -> list[tuple[int, str]]:
        if not data:
            raise EngineError(408, "the image cannot be decoded")
        return [(0, _recognised(ocr, data, 0) or "")]

    pages = _parsed(rows, parse)
    return pages.select("source_id", "name", "uti", "page", X.normalize(F.col("text")).alias("text"))
