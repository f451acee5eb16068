from pyspark.sql import functions as F

from passages.functions import text as X
from passages.operators import chunking
from passages.schema import ChunkingConfig


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


def test_normalize_joins_words_over_line_ends(spark):
    assert one(spark, "a water-\nmill with co-\nworkers, wind-up", X.normalize) == "a watermill with coworkers, wind-up"
    assert one(spark, "a\r\nb\rc\N{LINE SEPARATOR}d", X.normalize) == "a\nb\nc\nd"
    assert one(spark, "\N{LATIN SMALL LIGATURE FI}ne\N{ZERO WIDTH SPACE}x\ty", X.normalize) == "finex\ty"
    assert one(spark, "water-\nmill", X.normalize_markdown) == "water-\nmill"


def test_sanitize(spark):
    assert one(spark, "Which pump leaks, then?", X.sanitize) == '"Which" OR "pump" OR "leaks" OR "then"'
    assert one(spark, "?! ...", X.sanitize) == ""
    assert one(spark, "wind-up", X.sanitize) == '"wind-up"'
    assert one(spark, "wind-up", lambda c: X.sanitize(c, compat=True)) == '"wind" OR "up"'


def test_tokens_fold_accents(spark):
    assert one(spark, "Éte wind-up x_1, naïve", X.tokens) == ["ete", "wind-up", "x_1", "naive"]


def test_needs_ocr(spark):
    assert one(spark, " \n ", X.needs_ocr) and one(spark, "...", X.needs_ocr) and one(spark, "." * 70 + "a", X.needs_ocr)
    assert not one(spark, "plain words", X.needs_ocr)


def test_heading(spark):
    assert tuple(one(spark, "  ## Title here ", X.heading)) == (2, "Title here")
    assert one(spark, "####### no", X.heading) is None and one(spark, "#no", X.heading) is None


def test_excerpt_and_hash(spark):
    assert one(spark, "  " + "x" * 201, X.excerpt) == "x" * 200 + "…"
    assert one(spark, " a ", X.content_hash) == one(spark, "a", X.content_hash)


def pages(spark, *rows):
    return spark.createDataFrame([(r[0], r[0], r[3] if len(r) > 3 else "public.plain-text", r[1], r[2]) for r in rows], "source_id string, name string, uti string, page int, text string")


def test_sections_and_ids(spark):
    text = "before\n# Manual\nfirst part\n## Oiling\nsecond part\n# Spares\nthird"
    got = chunking.chunks(pages(spark, ("s", 0, text))).orderBy("ordinal").collect()
    assert [(r.section_title, r.parent_id, r.content) for r in got] == [
        (None, None, "before"), ("Manual", "s:p0:s1", "first part"), ("Manual > Oiling", "s:p0:s2", "second part"), ("Spares", "s:p0:s3", "third"),
    ]
    again = chunking.chunks(pages(spark, ("s", 0, text))).orderBy("ordinal").collect()
    assert [r.chunk_id for r in got] == [r.chunk_id for r in again]


def test_packing_boundaries(spark):
    config = ChunkingConfig(60, 5)  # 216 and 18 characters
    text = " ".join(f"{'w' * 98}{i}." for i in range(5))
    got = [r.content for r in chunking.chunks(pages(spark, ("s", 0, text)), config).orderBy("ordinal").collect()]
    assert got[0] == f"{'w' * 98}0. {'w' * 98}1."
    assert got[1].startswith("w" * 16 + "1.\n") and all(len(c) <= 216 for c in got)
    long = chunking.chunks(pages(spark, ("s", 0, "x" * 900)), config).collect()
    assert [len(r.content) for r in long] == [900]


def test_running_lines(spark):
    rows = [("s", i, f"Title\nbody {i}\nmore {i}\nfoot") for i in range(3)] + [("t", 0, "Title\nx"), ("c", 1, "a: 1", "public.comma-separated-values-text")]
    got = {(r.source_id, r.page): r.text for r in chunking.strip_running_lines(pages(spark, *rows)).collect()}
    assert got[("s", 1)] == "body 1\nmore 1" and got[("t", 0)] == "Title\nx" and got[("c", 1)] == "a: 1"


def test_prefix_cache_and_function(spark):
    p = pages(spark, ("s", 0, "page 1\nHead\nbody"))
    made = chunking.chunks(p)
    rule, none = chunking.with_prefixes(made, p)
    assert none is None and rule.first().context_prefix == "[s · p.1 · Head] - "
    asked, cache = chunking.with_prefixes(made, p, lambda c: f"about\n{c['name']}")
    assert asked.first().context_prefix == "about s"
    failed, _ = chunking.with_prefixes(made, p, lambda c: 1 / 0)
    assert failed.first().context_prefix == "[s · p.1 · Head] - "
    cached, _ = chunking.with_prefixes(made, p, None, cache)
    assert cached.first().context_prefix == "about s"
