"""Chunks of sources of one page are made without dealing out their texts, and are the same."""

from passages.operators import chunking


def test_chunks_of_one_page_need_no_shuffle(spark):
    texts = ["plain words. " * 80, "before\n# A\none\n## B\ntwo", "", "last"]
    rows = [(f"s{i}", f"s{i}", "public.plain-text", 0, t) for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "source_id string, name string, uti string, page int, text string")
    got, want = chunking.chunks(pages, one_page=True), chunking.chunks(pages)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plain = chunking.chunks(pages.where("text NOT LIKE '%#%'"), one_page=True)
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1  # that of pages with headings
