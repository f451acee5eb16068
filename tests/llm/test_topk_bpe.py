import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from passages.llm import topk
from passages.llm.bpe import Codec, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(900, 6)) * np.array([3, 1, 1, 0.1, 0.1, 2])
    vectors[200:230] = vectors[5]
    rows = [(i, [float(x) for x in v], "c") for i, v in enumerate(vectors)]
    bad = [(900, None, "c"), (950, [1.0, None, 0.0, 0.0, 0.0, 0.0], "c"), (1000, [float("nan")] * 6, "c"), (1050, [float("inf")] * 6, "c"), (1100, [1.0, 2.0], "c"), (None, [1.0] * 6, "c"), (1101, [], "c")]
    df = spark.createDataFrame(rows + bad + [rows[0]], "vec_id long, embedding array<double>, score string").repartition(4)
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0"), 5).where("query_id > 0").collect()))
    x = np.floor(vectors * 256)
    want = []
    for q in range(50, 900, 50):
        s = x @ x[q]
        ids = np.append(np.arange(900), 0)
        s = np.append(s, s[0])
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:5]
        want += [(q, k + 1, int(ids[keep][o]), int(s[keep][o])) for k, o in enumerate(order)]
    assert got == want
    blocks = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, query_block=6).where("query_id > 0").collect()
    assert sorted(map(tuple, blocks)) == want
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0
    two = spark.createDataFrame(rows[:2], df.schema)
    assert topk.top_k(two, two, 5).count() == 2


def test_scores_of_huge_components_are_exact(spark):
    rng = np.random.default_rng(4)
    sizes = rng.choice([1.0, 5e4, 2.0**30, 1e20], 300)
    vectors = (rng.normal(size=(300, 4)) * sizes[:, None]).tolist() + [[1e160, -1e160, 1.0, 0.0], [1.7e308, 0.0, 0.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0 or vec_id > 299"), 5).collect()))
    whole = [[math.floor(Fraction(x) * 256) for x in v] for v in vectors]
    want = []
    for q in [*range(0, 300, 50), 300, 301]:
        scores = [(-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in enumerate(whole) if i != q]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(sorted(scores)[:5], 1)]
    assert got == sorted(want)


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(9)
    vectors = np.floor(rng.normal(size=(4000, 2)) * 1000)
    best = topk.Best(np.array([-1]), np.array([[1.0, 1.0]]), 3)
    seen = []
    real = best.update
    best.update = lambda q, ids, scores: (seen.append(len(ids)), real(q, ids, scores))[1]
    best.block(np.arange(4000), vectors)
    assert sum(seen) < 1500 and best.found[0].tolist() == np.lexsort((np.arange(4000), -(vectors.sum(1))))[:3].tolist()


def test_tokens_equal_the_library(spark):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(1)
    letters = "abcABC 'sStTrelmd  \n\t\x0b\x1c\x1f\x85<|>aaaa0123!?…--__\x00\x07ΣσςİıßéÉñ½Ⅷ中文か👍🏽" + "\N{COMBINING ACUTE ACCENT}\N{ZERO WIDTH JOINER}\N{NO-BREAK SPACE}"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["<|startoftext|>Hello it's<|endoftext|>WE'RE aaaaaaaaa " * 3, "", "a" * 3000, "ΑΣ ΣΑΣ", "word " * 40_000]
    for text, (n, ids, decoded) in zip(texts, Codec(PATH).encode_decode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want))) and decoded == library.decode(want, skip_special_tokens=False)
    df = spark.createDataFrame([(1, None, "c"), (2, "Hi there", "c"), (2, "Hi there", "c")], "doc_id long, text string, ids string")
    got = sorted(map(tuple, tokens(df, PATH, ["doc_id"]).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = library.encode("Hi there", add_special_tokens=False).ids
    one = (2, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert got == [(1, 0, sha(""), sha("")), one, one]
    assert tokens(df.limit(0), PATH, ["doc_id"]).count() == 0
    full = tokens(df, PATH, ["doc_id"], with_ids=True).where("doc_id = 2").first()
    assert list(full.ids) == ids


def test_cleared_table_gives_the_same(monkeypatch):
    from passages.llm import bpe

    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    small, large = bpe.Codec(PATH), Codec(PATH)
    texts = [f"word{i} the and of thing{i * 7}" for i in range(50)]
    assert [list(small.encode_decode([t])) for t in texts] == [list(large.encode_decode([t])) for t in texts]
