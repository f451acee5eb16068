"""Pages to chunks: running headers and footers, sections, greedy packing, context prefixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.once import let, once
from ..schema import ChunkingConfig
from . import inrow

#: Identifiers whose pages are table rows: they have no running lines.
ROW_PAGES = ("public.comma-separated-values-text", "public.tab-separated-values-text")


#: Characters of neighbouring text that a prompt takes.
CLIP = 800

#: A page with a heading mark.
HEADED = r"(?m)^[\s\p{Z}]*#{1,6} "


def strip_running_lines(pages: DataFrame, least_pages: int = 3, top: int = 2, min_repeat: int = 2, settle: Callable[[DataFrame], DataFrame] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Pages without running headers and footers.

    In sources of ``least_pages`` pages or more, the ``top`` most frequent first
    lines that stand on ``min_repeat`` pages or more are headers, last lines
    likewise footers (ties: the one on the earliest page); leading header and
    trailing footer lines are dropped, and so are blank lines of those pages.
    ``settle`` writes a small table: then only lines of such sources are counted,
    and no text is dealt out for sources without running lines. ``counts`` has
    (source_id, pages), if they are known.
    """
    sizes = (pages.groupBy("source_id").agg(F.count("*").alias("pages")) if counts is None else counts).where(F.col("pages") >= least_pages)
    if settle is not None:
        sizes = settle(sizes)
        if sizes.isEmpty():
            return pages
    rows = pages.withColumn("__lines", X.lines(F.col("text")))
    edge = F.explode(
        F.array(
            F.struct(F.lit("first").alias("end"), F.get("__lines", F.lit(0)).alias("line")),
            F.struct(F.lit("last").alias("end"), F.when(F.size("__lines") > 0, F.element_at("__lines", -1)).alias("line")),
        )
    )
    long = rows.join(sizes.select("source_id"), "source_id", "left_semi") if settle is not None else rows
    counted = long.where(~F.col("uti").isin(*ROW_PAGES)).select("source_id", "page", edge.alias("e")).where("e.line IS NOT NULL")
    counts = counted.groupBy("source_id", "e.end", "e.line").agg(F.count("*").alias("n"), F.min("page").alias("at"))
    rank = F.row_number().over(Window.partitionBy("source_id", "end").orderBy(F.desc("n"), "at", "line"))
    frequent = counts.where(F.col("n") >= min_repeat).withColumn("rank", rank).where(F.col("rank") <= top)
    running = frequent.join(sizes, "source_id").groupBy("source_id").agg(
        F.collect_list(F.when(F.col("end") == "first", F.col("line"))).alias("__heads"),
        F.collect_list(F.when(F.col("end") == "last", F.col("line"))).alias("__feet"),
    )
    running = settle(running) if settle is not None else running
    marked = rows.join(running, "source_id", "left")
    # The first line that is no header, and the last that is no footer.
    places = F.sequence(F.lit(0), F.size("__lines") - 1)
    start = F.get(F.filter(places, lambda i: ~F.array_contains("__heads", F.get("__lines", i))), F.lit(0))
    kept_feet = F.filter(places, lambda i: ~F.array_contains("__feet", F.get("__lines", i)))
    end = F.when(F.size(kept_feet) > 0, F.element_at(kept_feet, -1))
    body = F.when(start.isNull() | end.isNull() | (end < start), F.lit("")).otherwise(F.array_join(F.slice("__lines", start + 1, end - start + 1), "\n"))
    text = F.when(F.col("__heads").isNull() | (F.size("__lines") == 0), F.col("text")).otherwise(body)
    return marked.select(*[text.alias("text") if c == "text" else F.col(c) for c in pages.columns])


def sections(pages: DataFrame) -> DataFrame:
    """(source_id, name, page, section, title, parent_id, body): a page's parts between headings.

    The title is the path of headings above; text before the first heading has
    none, and no parent. Parts without text are dropped; numbers of parents
    restart on each page and count every heading.

    Only the headings are folded; a part's text is put together once, from its
    first line to the line before the next heading.
    """
    none = F.lit(None).cast("string")
    path_of = "array<struct<level:int,title:string>>"
    part = "struct<n:int,titles:array<string>,start:int,stop:int>"

    def located(lines: Column) -> Column:
        marked = F.transform(lines, lambda x, i: F.struct(i.alias("at"), X.heading(x).alias("h")))
        return F.struct(lines.alias("lines"), F.filter(marked, lambda m: m["h"].isNotNull()).alias("heads"))

    def parts(x: Column) -> Column:
        heads, last = x["heads"], F.size(x["lines"])

        def step(acc: Column, i: Column) -> Column:
            head = F.get(heads, i)
            path = F.concat(F.filter(acc["path"], lambda h: h["level"] < head["h"]["level"]), F.array(head["h"].cast("struct<level:int,title:string>")))
            stop = F.coalesce(F.get(heads, i + 1)["at"], last)
            made = let(path, lambda p: F.struct(p.alias("path"), F.struct((i + 1).alias("n"), F.transform(p, lambda h: h["title"]).alias("titles"), (head["at"] + 1).alias("start"), stop.alias("stop")).cast(part).alias("part")))
            return let(made, lambda m: F.struct(m["path"].alias("path"), F.concat(acc["done"], F.array(m["part"])).alias("done")))

        before = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("titles"), F.lit(0).alias("start"), F.coalesce(F.get(heads, F.lit(0))["at"], last).alias("stop")).cast(part)
        begin = F.struct(F.array().cast(path_of).alias("path"), F.array(before).alias("done"))
        folded = F.aggregate(F.sequence(F.lit(0), F.size(heads) - 1), begin, step, lambda acc: acc["done"])
        listed = F.when(F.size(heads) > 0, folded).otherwise(F.array(before))
        body = lambda p: F.when(p["stop"] > p["start"], F.array_join(F.transform(F.sequence(p["start"], p["stop"] - 1), lambda i: F.get(x["lines"], i)), "\n")).otherwise("")
        return F.transform(listed, lambda p: F.struct(p["n"].alias("n"), p["titles"].alias("titles"), body(p).alias("body")))

    # Pages without a heading mark, which are most, are one part and are not split.
    whole = F.array(F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("titles"), F.col("text").alias("body")))
    cut = F.when(F.col("text").rlike(HEADED), let(let(F.split("text", "\n"), located), parts)).otherwise(whole)
    names = ["source_id", "name", "page", *[c for c in ("__header",) if c in pages.columns]]
    rows = pages.select(*names, once(cut.alias("parts"))).select(*names, F.explode("parts").alias("p"))
    title = F.when(F.size("p.titles") > 0, F.array_join("p.titles", " > "))
    parent = F.when(F.col("p.n") > 0, F.concat(F.col("source_id"), F.lit(":p"), F.col("page").cast("string"), F.lit(":s"), F.col("p.n").cast("string")))
    return rows.select(*names, F.col("p.n").alias("section"), F.coalesce(title, none).alias("title"), parent.alias("parent_id"), X.trim(F.col("p.body")).alias("body")).where("body <> ''")


def pack(units: Column, joiner: Column, config: ChunkingConfig = ChunkingConfig()) -> Column:
    """Units to chunk texts, greedily; a new chunk begins with the end of the last one if that fits.

    The fold over the units holds lengths and places only; texts are joined
    once for each chunk.
    """
    top, overlap = config.max_chars, config.overlap_chars

    def cuts(sizes: Column) -> Column:
        """2 * the first unit of each chunk, and 1 more if the end of the chunk before goes ahead of it."""

        def step(acc: Column, i: Column) -> Column:
            size = F.get(sizes, i)
            begun = F.least(F.lit(overlap), acc["held"]) + 1 + size
            fits = F.lit(bool(overlap)) & (begun <= top)
            opened = F.struct(F.when(fits, begun).otherwise(size).alias("held"), F.concat(acc["out"], F.array(2 * i + fits.cast("int"))).alias("out"))
            grown = F.struct((acc["held"] + 1 + size).alias("held"), acc["out"].alias("out"))
            return F.when(acc["held"] + 1 + size > top, opened).otherwise(grown)

        start = F.struct(F.get(sizes, F.lit(0)).alias("held"), F.array(F.lit(0)).alias("out"))
        folded = F.aggregate(F.sequence(F.lit(1), F.size(sizes) - 1), start, step, lambda acc: acc["out"])
        return F.when(F.size(sizes) > 1, folded).when(F.size(sizes) == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))

    def own(x: Column) -> Column:
        """(tail, own text) of each chunk."""

        def one(c: Column, k: Column) -> Column:
            start, stop = F.floor(c / 2).cast("int"), F.coalesce(F.floor(F.get(x["cuts"], k + 1) / 2).cast("int"), F.size(x["units"]))
            lines = F.transform(F.sequence(start, stop - 1), lambda i: F.get(x["units"], i))
            return F.struct((c % 2 == 1).alias("tail"), F.call_function("array_join", lines, joiner).alias("own"))

        return F.transform(x["cuts"], one)

    def texts(parts: Column) -> Column:
        """Each chunk with the end of the one before; only these ends are folded."""

        def step(acc: Column, p: Column) -> Column:
            whole = F.when(p["tail"], F.concat(acc["end"], F.lit("\n"), p["own"])).otherwise(p["own"])
            return F.struct(F.substring(whole, -overlap, overlap).alias("end"), F.concat(acc["ends"], F.array(acc["end"])).alias("ends"))

        start = F.struct(F.lit("").alias("end"), F.array().cast("array<string>").alias("ends"))
        ends = F.aggregate(parts, start, step, lambda acc: acc["ends"])
        return F.zip_with(parts, ends, lambda p, e: F.when(p["tail"], F.concat(e, F.lit("\n"), p["own"])).otherwise(p["own"]))

    def packed(u: Column) -> Column:
        return let(F.struct(u.alias("units"), cuts_of(u).alias("cuts")), own)

    def cuts_of(u: Column) -> Column:
        return let(F.transform(u, lambda x: F.length(x)), cuts)

    parts = let(units, packed)
    return let(parts, texts) if overlap else F.transform(parts, lambda p: p["own"])


def chunks(pages: DataFrame, config: ChunkingConfig = ChunkingConfig(), one_page: bool = False, beside: bool = False, header: bool = False) -> DataFrame:
    """(chunk_id, source_id, name, ordinal, page, content, section_title, parent_id, content_hash).

    Ordinals run over a source in page and section order; the window that
    numbers them meets the texts. If each source has one page (``one_page``), a
    page's chunks are made and numbered in one pass over its text, without window
    and shuffle. ``header`` adds the page's header, ``__header``, and ``beside`` the
    texts before and after a chunk in its source, clipped, ``__before`` and ``__after``.
    """
    if one_page:
        more = ", __header string" * header + ", __before string, __after string" * beside
        run = inrow.chunker(config.max_chars, config.overlap_chars, header, CLIP if beside else 0)
        return pages.select("source_id", "name", "page", "text").mapInArrow(run, inrow.CHUNK + more)
    return _numbered(pages.withColumn("__header", page_header(F.col("text"))) if header else pages, config, beside)


def _numbered(pages: DataFrame, config: ChunkingConfig, beside: bool = False) -> DataFrame:
    rows = sections(pages)
    joiner = F.when(X.tableish(F.col("body")), "\n").otherwise(" ")
    texts = once(pack(X.units(F.col("body")), joiner, config).alias("texts"))
    more = [c for c in ("__header",) if c in pages.columns]
    packed = rows.select("source_id", "name", "page", "section", "title", "parent_id", *more, texts)
    before = Window.partitionBy("source_id").orderBy("page", "section").rowsBetween(Window.unboundedPreceding, -1)
    numbered = packed.withColumn("first", F.coalesce(F.sum(F.size("texts")).over(before), F.lit(0)))
    flat = numbered.select("source_id", "name", "page", "title", "parent_id", *more, "first", F.posexplode("texts").alias("i", "content"))
    ordinal = (F.col("first") + F.col("i")).cast("int")
    digest = X.content_hash(F.col("content"))
    made = flat.select(
        X.chunk_id(F.col("source_id"), ordinal, digest).alias("chunk_id"), "source_id", "name", ordinal.alias("ordinal"), "page", "content",
        F.col("title").alias("section_title"), "parent_id", digest.alias("content_hash"), *more,
    )
    if beside:
        order = Window.partitionBy("source_id").orderBy("ordinal")
        made = made.withColumn("__before", F.substring(F.lag("content").over(order), -CLIP, CLIP)).withColumn("__after", F.substring(F.lead("content").over(order), 1, CLIP))
    return made


def page_header(text: Column) -> Column:
    """A page's first line that is not blank and no page number."""
    return F.get(F.filter(X.lines(text), lambda x: ~x.rlike(r"^page\s*[0-9]+$")), F.lit(0))


def rule_prefix(name: Column, page: Column, header: Column) -> Column:
    """``[name · p.N · header] - ``; parts that are missing are left out."""
    at = F.when(page.isNotNull(), F.concat(F.lit("p."), (page + 1).cast("string")))
    return F.concat(F.lit("["), F.concat_ws(" · ", name, at, F.when(header != "", header)), F.lit("] - "))


def _asked(context_fn, chunks: list[dict]) -> list[str | None]:
    """The function's answers, by one call for all if it has ``many``; None where it fails."""
    if hasattr(context_fn, "many"):
        try:
            answers = list(context_fn.many(chunks)) if chunks else []
            return answers if len(answers) == len(chunks) else [None] * len(chunks)
        except Exception:  # noqa: BLE001  whatever a plugged-in model raises
            return [None] * len(chunks)
    out = []
    for chunk in chunks:
        try:
            out.append(context_fn(chunk))
        except Exception:  # noqa: BLE001
            out.append(None)
    return out


def with_prefixes(chunk_rows: DataFrame, pages: DataFrame, context_fn=None, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Chunks with context_prefix, and the new rows of the prefix cache.

    Without a function the rule gives the prefix. With one, the cache is asked
    first and the function only for what it lacks, an Arrow batch at a time if it
    has ``many(list of dicts)``; one with ``prompted`` set is a model, and gets a
    prompt with the text before and after: columns ``__before`` and ``__after`` if
    there are, else that of the neighbouring rows. A failure or an empty answer
    falls back to the rule, and what results is cached either way. A cached prefix
    is used even without a function. To have each answer asked for once, write the
    chunks and take the cache's rows from what was written, by cache_rows().
    """
    rows = chunk_rows
    if "__header" not in chunk_rows.columns:
        rows = rows.join(pages.select("source_id", "page", page_header(F.col("text")).alias("__header")), ["source_id", "page"], "left")
    rows = rows.withColumn("__rule", rule_prefix(F.col("name"), F.col("page"), F.col("__header"))).withColumn("__key", X.cache_key(F.col("source_id"), F.col("page"), F.col("content")))
    if cache is not None:
        known = cache.select(F.col("key").alias("__key"), F.col("value").alias("__cached"))
        rows = rows.join(known, "__key", "left")
    else:
        rows = rows.withColumn("__cached", F.lit(None).cast("string"))
    if context_fn is None:
        return rows.withColumn("context_prefix", F.coalesce("__cached", "__rule")).drop("__rule", "__key", "__cached", "__header"), None

    if getattr(context_fn, "prompted", False):  # a model: it is asked with the neighbouring text
        order = Window.partitionBy("source_id").orderBy("ordinal")
        beside = "__before" in rows.columns
        left, right = (F.col("__before"), F.col("__after")) if beside else (F.lag("content").over(order), F.lead("content").over(order))
        left, right = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
        rows = rows.withColumn("__prompt", X.clip_prompt(left, F.col("content"), right))
    else:
        rows = rows.withColumn("__prompt", F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def ask(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        names = ("text", "name", "page", "header", "prompt")
        for content, name, page, header, prompt, cached in parts:
            places = [i for i, c in enumerate(cached) if c is None]
            columns = [x.astype(object).where(x.notna(), None).tolist() for x in (content, name, page, header, prompt)]
            asked = [dict(zip(names, (c[i] for c in columns))) for i in places]
            out = pd.Series([None] * len(content), dtype=object)
            out.iloc[places] = _asked(context_fn, asked)
            yield out

    raw = ask("content", "name", "page", "__header", "__prompt", "__cached")
    flat = F.substring(X.trim(F.replace(raw, F.lit("\n"), F.lit(" "))), 1, 600)
    asked = F.when(flat != "", X.clean_prefix(flat) if getattr(context_fn, "prompted", False) else flat)
    rows = rows.withColumn("context_prefix", F.coalesce("__cached", asked, "__rule"))
    made = rows.drop("__rule", "__key", "__cached", "__header", "__prompt", "__before", "__after")
    return made, cache_rows(made, cache)


def cache_rows(chunk_rows: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Rows of the prefix cache for chunks with their prefixes, without those that it has."""
    key = X.cache_key(F.col("source_id"), F.col("page"), F.col("content"))
    fresh = chunk_rows.select(key.alias("key"), F.col("context_prefix").alias("value"), F.to_json(F.struct("source_id", "page")).alias("meta"), F.current_timestamp().alias("created_at"))
    return (fresh if cache is None else fresh.join(cache.select("key"), "key", "left_anti")).dropDuplicates(["key"])
