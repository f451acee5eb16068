"""Text transforms as Column expressions.

White space is ASCII white space and the Unicode separators. Only normalize(),
which is one pass over a text, and compatibility composition and accent folding
of texts that are not plain ASCII leave the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\p{Z}]"


def trim(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """White space runs become one space; trimmed."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


@F.pandas_udf(StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def _fold_one(text: str) -> str:
    """Lower case without marks."""
    apart = unicodedata.normalize("NFD", text.lower())
    return unicodedata.normalize("NFC", "".join(c for c in apart if not unicodedata.combining(c)))


@F.pandas_udf(StringType())
def _fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda x: x if x is None else _fold_one(x))


def _ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def compose(text: Column) -> Column:
    """NFKC. ASCII texts, which it does not change, are sent to Python as nulls: a condition alone would not hold them back."""
    return F.coalesce(_nfkc(F.when(~_ascii(text), text)), text)


def fold(text: Column) -> Column:
    """Lower case, accents removed."""
    return F.coalesce(_fold(F.when(~_ascii(text), text)), F.lower(text))


def newlines(text: Column) -> Column:
    """CRLF, CR and the Unicode line and paragraph separators become newline."""
    return F.regexp_replace(text, r"\r\n|[\r\u2028\u2029]", "\n")


def join_hyphens(text: Column) -> Column:
    """A hyphen at a line's end is removed with the newline if a letter follows."""
    return F.regexp_replace(text, r"[-\u2010\u2011]\n(?=[\p{L}\p{M}])", "")


def strip_controls(text: Column, placeholders: bool = True) -> Column:
    """Without control and format characters but newline and tab, and object placeholders."""
    more = r"\uFFFC\uF8FF" if placeholders else ""
    return F.regexp_replace(text, rf"[[\p{{Cc}}\p{{Cf}}{more}]&&[^\n\t]]", "")


_JOINED = re.compile("[-\u2010\u2011]\n(?=(.))", re.S)
_CONTROL = re.compile(
    "[\x00-\x08\x0b-\x1f\x7f-\x9f\xad\u0600-\u0605\u061c\u06dd\u070f\u08e2\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb\ufffc\uf8ff"
    "\U000110bd\U000110cd\U00013430-\U00013438\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0001\U000e0020-\U000e007f]"
)
_ASCII_CONTROL = bytes([*range(9), *range(11, 32), 127])


def _normal(text: str) -> str:
    """strip_controls(join_hyphens(newlines(compose()))) of a text."""
    plain = text.isascii()
    if not plain:
        text = re.sub("[\u2028\u2029]", "\n", unicodedata.normalize("NFKC", text))
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "-\n" in text or "\u2010\n" in text or "\u2011\n" in text:
        text = _JOINED.sub(lambda m: "" if unicodedata.category(m[1])[0] in "LM" else m[0], text)
    return text.encode().translate(None, _ASCII_CONTROL).decode() if plain else _CONTROL.sub("", text)


@F.pandas_udf(StringType())
def _normals(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda x: x if x is None else _normal(x))


def normalize(text: Column) -> Column:
    """Plain text: composed, one kind of newline, words joined over line ends, no controls; in one pass."""
    return _normals(text)


def normalize_markdown(text: Column) -> Column:
    """As normalize, but hyphens at line ends stay and placeholders too."""
    return strip_controls(newlines(compose(text)), placeholders=False)


def needs_ocr(text: Column) -> Column:
    """True for extracted page text that holds nothing to read."""
    rest = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}\p{Cc}\uFFFC\uF8FF]", "")
    readable = F.length(F.regexp_replace(rest, r"[^\p{L}\p{N}]", ""))
    size = F.length(rest)
    return (size == 0) | (readable == 0) | ((size >= 64) & (readable < 0.1 * size))


def tableish(text: Column) -> Column:
    """Looks like a table: a tab, a bar, or two white spaces between words."""
    return text.rlike(rf"[\t|]|[^\s\p{{Z}}]{SPACE}{{2,}}[^\s\p{{Z}}]")


def tokens(text: Column) -> Column:
    """Index terms: runs of letters, digits, private-use characters, hyphen and underscore, folded."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}\p{Co}_-]+)"), F.lit(1))


def plain_tokens(text: Column) -> Column:
    """tokens() with lower case only, accents kept: wholly native."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}\p{Co}_-]+)"), F.lit(1))


def query_terms(question: Column, compat: bool = False) -> Column:
    """Words of a question as index terms; with compat, hyphens and underscores split them."""
    keep = r"[^\p{L}\p{M}\p{N}]" if compat else r"[^\p{L}\p{M}\p{N}_-]"
    return F.filter(F.split(F.regexp_replace(question, keep, " "), " +"), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def sanitize(question: Column, compat: bool = False) -> Column:
    """The question as a match expression: its words quoted and joined by OR; empty if it has none."""
    return F.array_join(F.transform(query_terms(question, compat), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ")


def excerpt(text: Column, limit: int = 200) -> Column:
    """Trimmed text, cut at the limit with an ellipsis."""
    short = trim(text)
    return F.when(F.length(short) > limit, F.concat(F.substring(short, 1, limit), F.lit("…"))).otherwise(short)


def content_hash(text: Column) -> Column:
    return F.sha2(trim(text), 256)


def chunk_id(source: Column, ordinal: Column, digest: Column) -> Column:
    return F.concat_ws(":", source, ordinal.cast("string"), F.substring(digest, 1, 16))


def cache_key(source: Column, page: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", source, F.coalesce(page, F.lit(-1)).cast("string"), text), 256)


def heading(line: Column) -> Column:
    """struct(level, title) of a heading line, null for other lines."""
    mark = F.regexp_extract(line, rf"^{SPACE}*(#{{1,6}}) +{SPACE}*[^\s\p{{Z}}]", 1)
    title = trim(F.regexp_extract(line, rf"^{SPACE}*#{{1,6}} +(.*)$", 1))
    return F.when(mark != "", F.struct(F.length(mark).alias("level"), title.alias("title")))


def sentences(text: Column) -> Column:
    """Sentences: up to closing marks that white space or the end follows, and at line ends."""
    marked = F.regexp_replace(text, rf"([.!?]+){SPACE}+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), trim), lambda x: x != "")


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != "")


def units(text: Column) -> Column:
    """What chunks are packed from: lines of table-like text, else sentences."""
    return F.when(tableish(text), lines(text)).otherwise(sentences(text))


def clip_prompt(left: Column, chunk: Column, right: Column) -> Column:
    """A prompt for a context prefix: neighbouring text clipped to 800 characters, the chunk to 1600."""
    return F.concat(
        F.lit("Say in one short sentence where this passage stands in its document.\nBefore:\n"),
        F.substring(left, -800, 800),
        F.lit("\nPassage:\n"),
        F.substring(chunk, 1, 1600),
        F.lit("\nAfter:\n"),
        F.substring(right, 1, 800),
    )


def clean_prefix(text: Column) -> Column:
    """A model's prefix: one line, at most 600 characters, no leading label, no closing full stop."""
    flat = F.substring(trim(F.regexp_replace(text, r"\n", " ")), 1, 600)
    return F.regexp_replace(F.regexp_replace(flat, r"(?i)^answer:\s*", ""), r"\.$", "")
