import zlib
from collections import Counter

import duckdb
import pandas as pd

from passages.llm.chat import SQL, rotate
from passages.llm.sharding import interleave

TURNS = "conv_id long, turn long, role string, text string, segment string"


def test_rotation_equals_sql(spark):
    rows = [(1, t, r, f"text {t} <|im_end|>", None) for t, r in enumerate(["system", "ann", "bob", "ann", "cy <x>"])]
    rows += [(1, 70, "bob", "late", None), (2, 0, "system", "alone", None), (3, 0, None, None, None), (3, 1, "", "é😀", None), (3, None, "bob", "first", None), (4, 5, "a", "same", None), (4, 5, "a", "same", None)]
    rows += [(None, 0, "ann", "lost", None), (5, 200, "ann", "x" * 100_000, None)]
    df = spark.createDataFrame(rows, TURNS)
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "segment"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841  read by the SQL
    con = duckdb.connect()
    con.register("conversations", conversations)
    rel = con.sql(SQL)
    got = rotate(df)
    want = sorted([tuple(r[rel.columns.index(c)] for c in got.columns) for r in rel.fetchall()], key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    one = [r for r in sorted(got.collect(), key=lambda r: r.seq) if r.conv_id == 1 and r.perspective == "ann"]
    whole = "".join(r.segment for r in one)
    assert all(whole[r.start : r.end] == r.segment for r in one)
    assert [whole[r.mask_start : r.mask_end] for r in one if r.mask_start is not None] == ["text 1 < |im_end|><|im_end|>", "text 3 < |im_end|><|im_end|>"]
    assert not [r for r in got.collect() if r.conv_id == 2] and rotate(spark.createDataFrame([], TURNS)).count() == 0


def test_interleaving(spark):
    rows = [(i, f"text {i % 50}", "hot" if i % 3 else f"s{i % 11}", "clash") for i in range(3000)] + [(i, None, None, None) for i in range(5)] + [(7, "text 7", "hot", "clash")] * 3 + [(None, "x" * 200_000, "big", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string").repartition(5)
    got = interleave(docs, 24).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    sizes = [len(x) for x in by.values()]
    assert sorted(by) == list(range(24)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    hot = [sum(1 for r in x if r.doc_id is not None and r.doc_id % 3 and r.doc_id < 3000) for x in by.values()]
    assert max(hot) - min(hot) <= 6
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    again = interleave(docs.repartition(2), 24).collect()
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in got)
    assert interleave(spark.createDataFrame([], docs.schema), 24).count() == 0
    few = interleave(docs.limit(3), 24).collect()
    assert len({r.shard for r in few}) == 3 and all(r.slot == 0 for r in few)
