"""HTML extraction: page structure, and a suffix array per host that every page's text goes through.

A page is read as blocks, each in one of three zones: the article (inside
``article``, or ``main`` if a page has no article), chrome (menus, headers,
footers, asides, forms, adverts, notices, comments and the like, by element,
role or class), or open. Its text is what the array leaves of its article, or of
its open blocks if it has none. Every page is parsed once, into a written table.

The token streams of a host's pages outside their articles (open and chrome
blocks) form its suffix array, cut at depth ``DEPTH`` by prefix doubling: the
suffixes that share their first DEPTH tokens are one interval, and a repeated run
of DEPTH tokens or more is covered by those that begin in it, however long it is.
A block of fewer tokens is an interval as a whole, as if marks stood around it.
Each task sorts its suffixes and counts the pages of each interval, and intervals
meet by host and name, so a large host is never in one task. An interval is
boilerplate if it stands on ``SHARE`` of the host's distinct pages, and on
``MIN_PAGES`` of them (on both, if there are two). Open tokens that it covers go.

The suffixes of the articles are looked up in that array, all of them. Repetition
alone is not enough there: copies of an article on one host and the license line of
all of its articles repeat as boilerplate does, and a headline stands in the menus
of other pages. So tokens of an article go where an interval of DEPTH tokens covers
them that is boilerplate outside the articles and also stands in as many distinct
articles of the host; shorter blocks of an article stay. What is unique and inside
chrome (an advert, a comment) no array can tell; there the zones decide.

Defined cases: null html is an empty text of 0 characters; broken or unclosed
markup is read as far as it goes; a null url is a host of its own; repeated
rows get the same result each, and count as one page of their host; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import bounded_batches, forget, written

DEPTH = 8  # a power of two
MIN_PAGES = 3
SHARE = 0.2
#: Bits of the sieve for each interval, and in all at most (32 MB): a full sieve holds back less, but loses nothing.
SIEVE_BITS, SIEVE_MOST, SIEVE_SHIFTS = 16, 1 << 28, (0, 18, 36)

# Elements of HTML by their role here.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
HIDDEN = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "math", "select", "button", "textarea", "canvas", "audio", "video"}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
CHROME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "form", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup",
    "promo", "promotion", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
    "complementary", "contentinfo", "dialog",
}
#: Of these, names that also begin a compound name of chrome, as in ad-slot; the others end one, as in site-header.
LEADING_WORDS = {"ad", "ads", "advert", "adverts", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "footer", "menu", "nav", "navbar", "newsletter", "sidebar", "social", "sponsored"}
#: Inside an article these name parts of it.
ARTICLE_WORDS = {"header", "masthead", "banner"}
SELF_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|textarea|svg|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDE = re.compile(r"\bhidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")

ARTICLE, MAIN, OPEN, CHROMED = 3, 2, 1, 0


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks in order, white space collapsed, none empty."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    zone, text, at = OPEN, [], 0

    def flush() -> None:
        if text:
            words = entities.unescape("".join(text)).split()
            text.clear()
            if words and zone >= 0:
                out.append((zone, " ".join(words)))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE and not (m["attributes"] and _ATTRIBUTE.search(m["attributes"])):
            if not m["close"] and name not in VOID:
                continue
            if m["close"] and not any(n == name for n, _ in stack):
                continue
        if name not in INLINE:
            flush()
        if m["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    flush()
                    zone = stack[i][1]
                    del stack[i:]
                    break
        elif name not in VOID and not m["attributes"].endswith("/"):
            if name in SELF_CLOSING:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        zone = stack[i][1]
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE and stack[i][0] not in SELF_CLOSING:
                        break
            entered = _zone(name, m["attributes"], zone)
            if entered != zone and name in INLINE:
                flush()
            stack.append((name, zone))
            zone = entered
    if at < len(page) and not page[at:].startswith("<"):
        text.append(page[at:])
    flush()
    return out


def _parts(name: str) -> set[str]:
    """What a class name, id or role says: itself, and its end and beginning if it is compound."""
    parts = [x for x in _PART.findall(name) if not x.isdigit()]
    if not parts:
        return set()
    return {name, parts[-1], *({parts[0]} & LEADING_WORDS)}


def _zone(name: str, attributes: str, zone: int) -> int:
    """The zone inside an element; -1 is hidden, and nothing leaves chrome or hidden again."""
    if zone < OPEN:
        return zone
    if name in HIDDEN:
        return -1
    words: set[str] = set()
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            for word in (m[2] or m[3] or m[4] or "").lower().split():
                words |= _parts(word)
        if _HIDE.search(attributes):
            return -1
    inside = zone > OPEN
    if name in CHROME and not (inside and name == "header"):
        return CHROMED
    if name not in ("html", "body", "article", "main") or "comment" in words or "comments" in words:
        chrome = words & CHROME_WORDS
        if chrome - (ARTICLE_WORDS if inside else set()):
            return CHROMED
    if name == "article":
        return ARTICLE
    if (name == "main" or "main" in words and "role" in attributes.lower()) and zone < MAIN:
        return MAIN
    return zone


def _best(parts: list[tuple[int, str]]) -> int:
    """ARTICLE or MAIN if the page has such a zone, else OPEN."""
    return max([z for z, _ in parts if z >= MAIN], default=OPEN)


def _windows(first: np.ndarray) -> np.ndarray:
    """Names of the windows of DEPTH tokens, by prefix doubling, from those of the tokens."""
    name, step = first, 1
    while step < DEPTH:
        name = kernels.mix(name[:-step] * np.uint64(0x9E3779B97F4A7C15) + kernels.mix(name[step:] + np.uint64(step))) if len(name) > step else name[:0]
        step *= 2
    return name


def _article_windows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, name, place) of all windows of DEPTH tokens inside each text; a null text has none."""
    for row, end, data, offs in kernels.slices(texts):
        first, begin = kernels.words(data, offs, kernels.SPACED)
        name = _windows(first)
        of = np.repeat(np.arange(row, end), np.diff(begin))
        at = np.flatnonzero(of[: len(name)] == of[DEPTH - 1 :])
        yield of[at], name[at].view(np.int64), (at - begin[of[at] - row]) * (2 * DEPTH) + DEPTH


def _names(tokens: list[str], short: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the windows of DEPTH tokens, by prefix doubling, and of the short blocks; and the place of each."""
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = kernels.words(*_bytes(tokens), kernels.SPACED)[0]
    name = _windows(first)
    starts = np.array([a for a, _ in short], np.int64)
    sizes = np.array([n for _, n in short], np.int64)
    blocks_ = np.array([kernels.mix(kernels.mix(first[a : a + n] + np.arange(n, dtype=np.uint64)).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))[0] for a, n in short], np.uint64)
    places = np.concatenate([np.arange(len(name)) * (2 * DEPTH) + DEPTH, starts * (2 * DEPTH) + sizes])
    return np.concatenate([name, blocks_]).view(np.int64), places


def _bytes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(" ".join(tokens).encode("utf-8", "surrogatepass"), np.uint8)
    return data, np.array([0, len(data)], np.int64)


def _stream(parts: list[tuple[int, str]], best: int) -> tuple[list[str], list[bool], list[tuple[int, int]]]:
    """Tokens outside the article in page order, whether each is of an open block, and (start, tokens) of the short blocks."""
    tokens, open_, short = [], [], []
    for zone, text in parts:
        if zone < max(best, MAIN):
            ws = [w for w in text.split(" ") if w]
            if 0 < len(ws) < DEPTH:
                short.append((len(tokens), len(ws)))
            tokens += ws
            open_ += [zone == OPEN] * len(ws)
    return tokens, open_, short


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def parsed(pages: DataFrame) -> DataFrame:
    """One row of each page, written: the text of its article (null: the page has none, but open blocks), or its stream; and the names of its intervals."""
    bounded_batches(pages.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for page in batch.column(5).to_pylist():
                parts = blocks(page or "")
                best = _best(parts)
                tokens, open_, short = _stream(parts, best)
                names, places = _names(tokens, short)
                if best == OPEN and any(open_):
                    made.append((None, tokens, open_, names.tobytes(), places.tobytes()))
                else:
                    made.append((" ".join(t for z, t in parts if z == best and z >= MAIN), None, None, names.tobytes(), None))
            types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
            columns = [batch.column(i) for i in range(5)] + [pa.array([m[i] for m in made], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "page", "row", "text", "tokens", "open", "names", "places"])

    read = pages.select("page_id", "url", _host().alias("host"), F.when(F.col("html").isNotNull(), F.xxhash64("html")).alias("page"), F.monotonically_increasing_id().alias("row"), "html")
    schema = f"page_id {kind['page_id']}, url {kind['url']}, host string, page long, row long, text string, tokens array<string>, open array<boolean>, names binary, places binary"
    return written(read.mapInArrow(parse, schema), "pages", codec="zstd")


def host_intervals(rows: DataFrame) -> DataFrame:
    """(host, name, least): intervals of each host's suffix array that ``least`` or more of its distinct pages share, from parsed rows."""

    def intervals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, found = batch.column(0).to_pylist(), [np.unique(np.frombuffer(x, np.int64)) for x in batch.column(1).to_pylist()]  # a page counts once in an interval
            if not found:
                continue
            name = np.concatenate(found)
            code = {h: i for i, h in enumerate(dict.fromkeys(hosts))}
            host = np.repeat(np.array([code[h] for h in hosts], np.int64), [len(f) for f in found])
            if not len(name):
                continue
            order = np.lexsort((name, host))  # the suffix array of the task's pages, host by host
            name, host = name[order], host[order]
            start = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (host[1:] != host[:-1])]))
            count = np.diff(np.append(start, len(name)))
            texts = np.array(list(code), dtype=object)
            yield pa.RecordBatch.from_arrays([pa.array(texts[host[start]], pa.string()), pa.array(name[start]), pa.array(count)], names=["host", "name", "n"])

    # Rows that repeat are one page, else a page listed three times would be boilerplate.
    distinct = rows.select("host", "url", "page", "names").where("page IS NOT NULL").dropDuplicates(["host", "url", "page"])
    counted = distinct.where(F.length("names") > 0).select("host", "names").mapInArrow(intervals, "host string, name long, n long")
    shared = counted.groupBy("host", "name").agg(F.sum("n").alias("n")).where("n > 1")
    hosts = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    least = F.greatest(F.least(F.lit(MIN_PAGES), F.col("pages")), F.ceil(F.col("pages") * F.lit(SHARE)))
    return shared.join(hosts.select("host", least.alias("least")), "host").where("n >= least").select("host", "name", "least")


def _sieve(intervals: DataFrame) -> np.ndarray:
    """A Bloom filter of the intervals: a window that it does not hold is in none, so only the others need a join."""
    bits, least = 64, min(SIEVE_MOST, SIEVE_BITS * intervals.count())
    while bits < least:
        bits *= 2
    key = F.xxhash64("host").bitwiseXOR(F.col("name"))
    at = intervals.select(F.explode(F.array(*(F.shiftrightunsigned(key, by).bitwiseAND(F.lit(bits - 1)) for by in SIEVE_SHIFTS))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("held")).toArrow()
    sieve = np.zeros(bits // 64, np.uint64)
    sieve[words["word"].to_numpy()] = words["held"].to_numpy().view(np.uint64)
    return sieve


def _passes(sieve: np.ndarray, key: np.ndarray) -> np.ndarray:
    found = np.ones(len(key), bool)
    for by in SIEVE_SHIFTS:
        at = ((key.view(np.uint64) >> np.uint64(by)) & np.uint64(64 * len(sieve) - 1)).view(np.int64)
        found &= (sieve[at >> 6] >> (at & 63).view(np.uint64)) & np.uint64(1) == 1
    return found


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    rows = parsed(pages)
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    known = written(host_intervals(rows).withColumn("interval", F.monotonically_increasing_id()), "intervals")
    sieve = rows.sparkSession.sparkContext.broadcast(_sieve(known))

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = [[np.frombuffer(x or b"", np.int64) for x in batch.column(i).to_pylist()] for i in (5, 6)]
            found = [(np.repeat(np.arange(batch.num_rows), [len(x) for x in stored[0]]), *map(np.concatenate, stored))] if batch.num_rows else []
            hosts = batch.column(2).to_numpy()
            for of, name, place in (*found, *_article_windows(batch.column(4))):
                held = np.flatnonzero(_passes(sieve.value, hosts[of] ^ name))
                if len(held):
                    at = pa.array(of[held])
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in (0, 1, 3)), pa.array(name[held]), pa.array(place[held])], names=["row", "host", "article", "name", "place"])

    # Of open pages the suffixes of the whole stream, of others those of the article. They meet the intervals one by one;
    # what comes back to a page is the places covered.
    is_open = F.col("text").isNull()
    streams = rows.select("row", "host", F.xxhash64("host").alias("of"), F.when(~is_open, F.xxhash64("text")).alias("article"), "text", F.when(is_open, F.col("names")).alias("names"), "places")
    windows = streams.mapInArrow(spread, "row long, host string, article long, name long, place long")
    met = written(windows.join(known, ["host", "name"]).select("row", "place", "article", "interval", "least"), "covered")
    inside = met.where("article IS NOT NULL")
    often = inside.groupBy("interval", "least").agg(F.count_distinct("article").alias("n")).where("n >= least").select("interval")

    def places(covered: DataFrame) -> DataFrame:
        return covered.groupBy("row").agg(F.collect_list("place").alias("covered"))

    # Written, so that its size is known: where it is small, no article is shuffled for it.
    in_articles = written(places(inside.join(often, "interval", "left_semi")), "covered")
    forget(known)

    def unique_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, tokens, open_, places in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                if text is not None and not places:
                    texts.append(text)
                    continue
                if text is not None:
                    tokens = text.split(" ")
                    open_ = [True] * len(tokens)
                gone = np.zeros(len(tokens) + 1, np.int64)
                at, size = np.divmod(np.array(places or [], np.int64), 2 * DEPTH)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + size, -1)
                gone = np.cumsum(gone)[:-1] > 0
                texts.append(" ".join(t for t, o, g in zip(tokens, open_, gone) if o and not g))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    candidates = rows.select("row", "page_id", "url", "text", "tokens", "open")
    of_articles = candidates.where(~is_open).join(in_articles, "row", "left")
    of_open = candidates.where(is_open).join(places(met.where("article IS NULL")), "row", "left")
    runs = of_articles.unionByName(of_open).drop("row").mapInArrow(unique_runs, f"page_id {kind['page_id']}, url {kind['url']}, text string")
    return runs.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
