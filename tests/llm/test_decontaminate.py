import re
import random

import numpy as np

from passages.llm.decontaminate import FMIndex, decontaminate, sha_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 5, 400)
    text[100:160] = text[10:70]
    index = FMIndex(text)
    for n in (1, 2, 3, 5, 8):
        at = rng.integers(0, 392, 30)
        phrases = np.zeros((30, 8), np.int64)
        for i, a in enumerate(at):
            phrases[i, 8 - n :] = text[a : a + n]
        low, high = index.search(phrases, np.full(30, n))
        for i, a in enumerate(at):
            want = [p for p in range(401 - n) if (text[p : p + n] == text[a : a + n]).all()]
            assert sorted(index.locate(np.arange(low[i], high[i]))) == want
    absent = np.full((1, 8), 99)
    low, high = index.search(absent, np.array([8]))
    assert low[0] == high[0]


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for a in range(max(1, len(w) - 12)) if w and i is not None else []:
            windows.setdefault(tuple(w[a : a + 13]), set()).add(str(i))
    for d, t in docs:
        w, hit, found = WORD.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        yield d, len(w), len(hit), len(found), sha_of(found), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_equals_brute_force(spark):
    rng = random.Random(6)
    v = [f"w{i}" for i in range(40)] + ["É", "x9"]
    items = [(i, ", ".join(rng.choice(v) for _ in range(rng.choice([2, 5, 13, 14, 30])))) for i in range(30)] + [(90, None), (91, "..."), (3, "dup of three"), (92, "one")]
    docs = []
    for d in range(150):
        w = [rng.choice(v) for _ in range(rng.randint(0, 200))]
        if rng.random() < 0.5:
            t = (rng.choice(items)[1] or "").split(", ")
            a = rng.randrange(len(t))
            at = rng.randrange(len(w) + 1)
            w[at:at] = t[a : a + rng.choice([5, 13, 40])]
        docs.append((d, " ".join(w).upper() if d % 7 == 0 else "-".join(w)))
    docs += [(900, None), (901, ""), (902, "q " * 60_000 + items[0][1])]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, n_hit string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items))
    got = decontaminate(df, bench, ["doc_id"])
    assert sorted(map(tuple, got.drop("spans").collect())) == want
    from passages.llm import decontaminate as module

    blocks = module.contaminated_spans(df, bench, ["doc_id"], block_words=40)
    merged = {r.doc_id: sum(s.end - s.start for s in r.spans) for r in blocks.collect()}
    assert merged == {w[0]: w[2] for w in want}
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate(df, bench.limit(0), ["doc_id"]).collect())
    assert decontaminate(df.limit(0), bench, ["doc_id"]).count() == 0


def test_blocks_keep_rows_apart(spark):
    from passages.llm.decontaminate import contaminated_spans

    items = [(i, " ".join(f"i{i}w{j}" for j in range(15))) for i in range(12)]
    docs = [(None, f"a {items[0][1]} b"), (None, f"{items[1][1]} and {items[2][1]}"), (None, "clean"), (None, None)]
    docs += [(7, f"{items[3][1]} x"), (7, f"x y {items[4][1]}"), (7, "clean too"), (8, items[5][1]), (8, items[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")

    def rows(found):
        return sorted((str(r.doc_id), r.n_words, tuple(map(tuple, r.spans)), tuple(r.items)) for r in found.collect())

    one = rows(contaminated_spans(df, bench, ["doc_id"]))
    assert len(one) == len(docs) and rows(contaminated_spans(df, bench, ["doc_id"], block_words=80)) == one
    whole = contaminated_spans(df, bench, ["doc_id", "text"], block_words=80)
    assert whole.columns == ["doc_id", "text", "n_words", "spans", "items"] and rows(whole) == one
