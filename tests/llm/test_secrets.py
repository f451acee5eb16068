import hashlib
import math
import random
import re
import string

import numpy as np

from passages.llm.secrets import ENCODINGS, scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(4)
    bits = ["password", "PassWd=", "token", "secret: ", "api_key", "apikey=", '"', "'", " ", "=", ":", "abc.def", "AKIA", "Z9" * 9, "0a" * 13, "é", "😀", "x", "\n", "token=token: abcdefg", "hunter2-"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "a" * 100_000, "token=" + "b" * 50_000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: r for r in scan(docs, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        want = base(t or "")
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (t, text)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("random")] == ([s for s in text.split(",") if s])


def explained(token):
    """(length, p-value that structured text explains the token, 1 if it is not random), from the definitions."""
    v = token.rstrip("=").replace("=", "+").replace("-", "+").replace("_", "/")
    n = len(v)
    if n < 8 or re.fullmatch("[0-9]+", v):
        return n, 1.0
    alphabet = next(a for _, pattern, a in ENCODINGS if re.fullmatch(pattern, v))
    m = len(alphabet)
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    codes = np.array([alphabet.index(x) for x in v])
    chi = m / n * (np.bincount(codes, minlength=m) ** 2).sum() - n
    free = m - 1
    z = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    high = codes < m / 2
    turns = int((high[1:] != high[:-1]).sum())
    away = codes - free / 2
    serial = (away[1:] * away[:-1]).sum() / ((m * m - 1) / 12) / math.sqrt(n - 1)
    three = [min(1, 2 * tail(abs(z))), min(1, 2 * tail(max(0, abs(turns - (n - 1) / 2) - 0.5) / math.sqrt((n - 1) / 4))), 2 * tail(abs(serial))]
    x = -sum(math.log(max(p, 1e-300)) for p in three)
    if math.exp(-x) * (1 + x + x * x / 2) < 0.001:
        return n, 1.0
    uneven = n * max(0.5, m * 0.0667 - 1)
    classes = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in v]
    changes = sum(a != b for a, b in zip(classes, classes[1:]))
    uniform = tail((free + uneven - chi) / math.sqrt(2 * (free + 2 * uneven)))
    if alphabet in (string.ascii_lowercase, string.ascii_uppercase):
        return n, uniform
    x = -math.log(uniform) - math.log(tail((changes - 0.5 - (n - 1) / 4) / math.sqrt((n - 1) * 3 / 16)))
    return n, math.exp(-x) * (1 + x)


def battery(texts):
    """Random spans of each text: the Benjamini-Hochberg step by bands of length on p-values rounded up to half powers of two."""
    found = [[(m.start(), m.end(), *explained(m[0])) for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", t or "") if not re.fullmatch("[0-9]+", m[0])] for t in texts]
    band = lambda n: max(0, min(7, math.floor(2 * math.log2(max(1, n) / 16))))
    up = lambda p: 2.0 ** (-min(63, math.floor(-2 * math.log2(p))) / 2)
    limit = {}
    for b in range(8):
        ps = sorted(up(p) for t in found for _, _, n, p in t if band(n) == b)
        limit[b] = max((p for k, p in enumerate(ps, 1) if p * len(ps) <= 0.01 * k), default=0)
    return [[f"random:{s}:{e}" for s, e, n, p in spans if up(p) <= limit[band(n)] and not any(a < e and s < z for a, _, z in base(t or ""))] for t, spans in zip(texts, found)]


def planted(rng):
    texts = []
    for _, _, alphabet in ENCODINGS[1:]:
        for n in (16, 20, 32, 64, 200):
            texts += [f"key is {''.join(rng.choice(alphabet) for _ in range(n))} here" for _ in range(6)]
    for i in range(120):
        texts.append(f"chapter_{i}_of_the_long_running_book http/path/to/some/file/version{i}/index.html Donaudampfschifffahrtsgesellschaft{'en' * (i % 3)}")
    poor = rng.sample(string.ascii_letters, 8)
    texts += ["".join(rng.choice(poor) for _ in range(40)) for _ in range(20)]  # a small alphabet
    texts += [("".join(rng.sample(string.ascii_letters + string.digits, 9)) * 9)[:60] for _ in range(20)]  # periods
    return [*texts, string.ascii_lowercase + string.digits, "a" * 50_000, "=" * 20, "4" * 30, "4" * 30 + "==", None, ""]


def test_battery_equals_brute_force(spark):
    texts = planted(random.Random(5))
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], None)], "doc_id long, text string, n_random string").repartition(3)
    rows = scan(df, ["doc_id"]).collect()
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("random")] for r in rows}
    # Texts that repeat count twice in the step, so the brute force has them twice as well.
    want = battery([*texts, texts[0]])[:-1]
    assert len(rows) == len(texts) + 1 and [got[i] for i in range(len(texts))] == want


def test_random_tokens_found_and_words_left(spark):
    texts = planted(random.Random(6))
    rows = {r.doc_id: r for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()}
    got = {i: r.n_random + r.n_hex for i, r in rows.items()}  # hexadecimal runs are base spans
    kinds = [name for name, _, _ in ENCODINGS[1:]]
    share = {(k, n): sum(got[(i * 5 + j) * 6 + c] for c in range(6)) / 6 for i, k in enumerate(kinds) for j, n in enumerate((16, 20, 32, 64, 200))}
    assert all(share[k, 200] >= 5 / 6 for k in kinds) and all(share[k, 64] >= 4 / 6 for k in kinds if k not in ("lower", "upper"))
    assert all(share[k, 32] >= 5 / 6 for k in ("letters", "base62", "base64"))
    words = range(6 * 5 * len(kinds), len(texts))
    assert sum(rows[i].n_random for i in words) <= 1


def test_empty(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0
