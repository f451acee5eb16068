"""Secret scans: fixed patterns, and a battery of randomness tests.

Fixed patterns give the base spans. The battery adds spans of kind ``random``:
runs of ``CANDIDATE_LENGTH`` token characters or more. A token's encoding, and so
its alphabet, is inferred (hexadecimal, letters of one case, base32, base36,
letters, base62, base64), its characters become numbers in the alphabet, and

* a chi-squared test of the alphabet's uniformity, a runs test about the alphabet's
  middle and a lag-1 serial correlation test give three p-values, all two-sided,
  under the hypothesis that the token is random. Fisher's method combines them to
  one; below ``ALPHA`` the token is not random (too uneven, too even or periodic);
* two p-values tell how well structured text explains it: the chi-squared statistic
  against the noncentral distribution that letters as frequent as in words give
  at this length, and the changes of character class against those of words (of
  encodings with several classes). Fisher's method combines them to one p-value;
* these go through a Benjamini-Hochberg step in bands of length, so that long and
  short tokens each keep the false-discovery rate ``FDR``; tokens that are not
  random count there as words. The step reads a histogram of p-values (``BANDS`` x
  ``BINS`` rows at most, whatever the input), never the tokens.

All of it is DataFrame functions. Positions are code points, ends exclusive;
matches are leftmost and do not overlap within a kind; a random span that
overlaps a base span is not reported again.

Defined cases: a null text counts as empty and has no spans; repeated rows get
equal results; an empty table gives no rows; a token of digits alone is a number
and not tested; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: kinds in order, patterns, least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LENGTH = 20
HEX = r"[0-9a-f]+"
HEX_LENGTH = 24
KINDS = ("assign", "access", "hex", "random")

#: Token characters in a row that are tested; fewer have no power (README).
CANDIDATE_LENGTH = 16
FDR = 0.01
#: A random token is taken for a word at this rate.
ALPHA = 0.001
BANDS, BINS = 8, 64
#: In words, the class of character changes at this share of the places.
WORD_CHANGES = 0.25
#: The sum of the squares of the letters' shares in words.
WORD_SQUARES = 0.0667
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings, the first that fits is inferred: name, pattern, alphabet in order.
ENCODINGS = (
    ("decimal", "[0-9]+", _DIGITS),
    ("hex", "[0-9a-f]+", _DIGITS + _LOWER[:6]),
    ("HEX", "[0-9A-F]+", _DIGITS + _UPPER[:6]),
    ("lower", "[a-z]+", _LOWER),
    ("upper", "[A-Z]+", _UPPER),
    ("base32", "[A-Z2-7]+", _UPPER + _DIGITS[2:8]),
    ("base36", "[a-z0-9]+", _DIGITS + _LOWER),
    ("BASE36", "[A-Z0-9]+", _DIGITS + _UPPER),
    ("letters", "[A-Za-z]+", _UPPER + _LOWER),
    ("base62", "[A-Za-z0-9]+", _UPPER + _LOWER + _DIGITS),
    ("base64", "[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
)
#: Matches whose positions are gathered in one array before it joins the others.
BLOCK = 128


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _positions(text: Column, pattern: str, group: int) -> Column:
    """Array of (start, end, value) of all matches of a pattern, from the pieces between them.

    Matches come in blocks, as an array that grows by one match at a time is copied each time.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("found"), value.alias("value"))
    spans, blocks = "array<struct<s:int,e:int,v:string>>", "array<array<struct<s:int,e:int,v:string>>>"

    def block(matches: Column, at: Column, first: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            m = F.get(matches, i)
            start = acc["at"] + m["gap"]
            end = start + F.length(m["found"])
            one = F.array(F.struct(start.alias("s"), end.alias("e"), m["value"].alias("v")))
            return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

        last = F.least(first + BLOCK, F.size(matches)) - 1
        return F.aggregate(F.sequence(first, last), F.struct(at.alias("at"), F.array().cast(spans).alias("out")), step)

    def walk(matches: Column) -> Column:
        def step(acc: Column, b: Column) -> Column:
            return _let(block(matches, acc["at"], b * BLOCK), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        many = F.ceil(F.size(matches) / F.lit(BLOCK)).cast("int")
        whole = F.aggregate(F.sequence(F.lit(0), many - 1), F.struct(F.lit(0).alias("at"), F.array().cast(blocks).alias("out")), step, lambda acc: F.flatten(acc["out"]))
        return F.when(many > 0, whole).otherwise(F.array().cast(spans))

    # The last piece has no match after it.
    return _let(F.filter(zipped, lambda x: x["found"].isNotNull()), walk)


def _spans(text: Column, kind: str) -> Column:
    """Array of (start, end) for one base kind; text is scanned for positions only if the kind may occur."""
    nothing = F.array().cast("array<struct<s:int,e:int,v:string>>")
    if kind == "assign":
        found = F.when(text.rlike(ASSIGN), _positions(text, ASSIGN, 2))
        return F.filter(F.coalesce(found, nothing), lambda x: F.length(x["v"]) >= ASSIGN_VALUE)
    if kind == "access":  # runs that are too short hold no longer one inside, so the length may be in the pattern
        pattern = rf"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}"
        return F.coalesce(F.when(text.rlike(pattern), _positions(text, pattern, 0)), nothing)
    pattern = rf"[0-9a-f]{{{HEX_LENGTH},}}"
    return F.coalesce(F.when(text.rlike(pattern), _positions(text, pattern, 0)), nothing)


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution (a rational approximation to 1e-7, |z| up to 30)."""
    x = F.least(F.abs(z), F.lit(30.0))
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z < 0, 1.0 - upper).otherwise(upper)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * _normal_tail(F.abs(z)))


def _fisher(*p: Column) -> Column:
    """The p-value of two or three independent p-values by Fisher's method."""
    half = sum((-F.ln(F.greatest(x, F.lit(1e-300))) for x in p), F.lit(0.0))
    tail = lambda x: F.exp(-x) * (1.0 + x + (x * x / 2 if len(p) == 3 else 0.0))
    return _let(half, tail)


def _inferred(body: Column, pick: int) -> Column:
    """The name (0) or alphabet (2) of the first encoding that fits."""
    out = F.lit(ENCODINGS[-1][pick])
    for row in reversed(ENCODINGS[:-1]):
        out = F.when(body.rlike(f"^{row[1]}$"), row[pick]).otherwise(out)
    return out


def _battery(token: Column) -> Column:
    """struct(encoding, n, p): p tells how well structured text explains the token; 1 if it is not random."""
    body = F.translate(F.regexp_replace(token, "=+$", ""), "-_=", "+/+")

    def numbered(x: Column) -> Column:
        return F.struct(x.alias("body"), _inferred(x, 0).alias("encoding"), _inferred(x, 2).alias("alphabet"))

    def coded(x: Column) -> Column:
        signs = F.filter(F.split(x["body"], ""), lambda c: c != "")
        return F.struct(
            x["body"].alias("body"), x["encoding"].alias("encoding"), F.length(x["alphabet"]).cast("double").alias("m"), F.length(x["body"]).cast("double").alias("n"),
            F.transform(signs, lambda c: F.position(c, x["alphabet"]).cast("double") - 1.0).alias("codes"), F.array_distinct(signs).alias("signs"),
        )

    def measured(x: Column) -> Column:
        n, m, body = x["n"], x["m"], x["body"]
        squares = F.aggregate(x["signs"], F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0)))
        size = F.size(x["codes"])
        pairs = F.zip_with(F.slice(x["codes"], F.lit(1), size - 1), F.slice(x["codes"], F.lit(2), size - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        middle = (m - 1) / 2
        lagged = F.aggregate(pairs, F.lit(0.0), lambda s, y: s + (y["a"] - middle) * (y["b"] - middle))
        turns = F.aggregate(pairs, F.lit(0.0), lambda s, y: s + F.when((y["a"] < m / 2) != (y["b"] < m / 2), 1.0).otherwise(0.0))
        # Runs of classes: each maximal run becomes one letter.
        classes = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), r"[^aA0]+", "-")).cast("double")
        return F.struct(
            x["encoding"].alias("encoding"), n.alias("n"), (m - 1).alias("free"), (m / n * squares - n).alias("chi"),
            (lagged / ((m * m - 1) / 12) / F.sqrt(n - 1)).alias("serial"), turns.alias("turns"), (classes - 1).alias("changes"), (n - 1).alias("places"),
            (n * F.greatest(m * WORD_SQUARES - 1, F.lit(0.5))).alias("uneven"),
        )

    def judged(x: Column) -> Column:
        free, chi, places = x["free"], x["chi"], x["places"]
        spread = 2.0 / (9.0 * free)
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1.0 - spread)) / F.sqrt(spread)  # Wilson-Hilferty
        z_runs = F.greatest(F.abs(x["turns"] - places / 2) - 0.5, F.lit(0.0)) / F.sqrt(places / 4)
        random = _fisher(_two_sided(z_chi), _two_sided(z_runs), _two_sided(x["serial"]))
        uniform = _normal_tail((free + x["uneven"] - chi) / F.sqrt(2.0 * (free + 2.0 * x["uneven"])))
        mixed = _normal_tail((x["changes"] - places * WORD_CHANGES - 0.5) / F.sqrt(places * WORD_CHANGES * (1 - WORD_CHANGES)))
        fair = (random >= ALPHA) & (x["encoding"] != "decimal")
        return F.struct(x["encoding"].alias("encoding"), x["n"].cast("int").alias("n"), F.when(~fair, F.lit(1.0)).when(x["encoding"].isin("lower", "upper"), uniform).otherwise(_fisher(uniform, mixed)).alias("p"))

    few = F.struct(F.lit("").alias("encoding"), F.length(body).alias("n"), F.lit(1.0).alias("p"))  # little but padding
    return F.when(F.length(body) < CANDIDATE_LENGTH // 2, few).otherwise(_let(_let(_let(_let(body, numbered), coded), measured), judged))


def _candidates(text: Column) -> Column:
    """Array of (s, e, encoding, n, p) of the text's tokens that are no numbers."""
    kind = "array<struct<s:int,e:int,encoding:string,n:int,p:double>>"
    pattern = rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_LENGTH},}}"
    tokens = F.filter(_positions(text, pattern, 0), lambda x: ~x["v"].rlike("^[0-9]+$"))
    tested = F.transform(tokens, lambda x: _let(_battery(x["v"]), lambda t: F.struct(x["s"].alias("s"), x["e"].alias("e"), t["encoding"].alias("encoding"), t["n"].alias("n"), t["p"].alias("p"))))
    return F.coalesce(F.when(text.rlike(rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_LENGTH}}}"), tested), F.array().cast(kind))


def _band(n: Column) -> Column:
    """Length band: from 16, 23, 32, 46, ... each about 1.4 times the one before."""
    return F.least(F.greatest(F.floor(F.log2(n / CANDIDATE_LENGTH) * 2), F.lit(0)), F.lit(BANDS - 1)).cast("int")


def _bin(p: Column) -> Column:
    """Bin of a p-value: twice its negative binary exponent; a bin's p-values are at most 2 ** (-bin / 2)."""
    return F.least(F.floor(-2 * F.log2(F.greatest(p, F.lit(1e-300)))), F.lit(BINS - 1)).cast("int")


def thresholds(histogram: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Per band the smallest bin that Benjamini-Hochberg rejects, from rows (band, bin, n); 0 < fdr < 1."""
    rows: dict[int, dict[int, int]] = {}
    for band, b, n in histogram.collect():  # BANDS * BINS rows at most
        rows.setdefault(band, {})[b] = n
    out = {}
    for band, bins in rows.items():
        total, seen, least = sum(bins.values()), 0, None
        for b in range(BINS - 1, -1, -1):
            seen += bins.get(b, 0)
            if seen and 2.0 ** (-b / 2) * total <= fdr * seen:
                least = b
        if least is not None:
            out[band] = least
    return out


def scan(docs: DataFrame, keep: list[str], fdr: float = FDR) -> DataFrame:
    """keep, n_assign, n_access, n_hex, n_random, base_sha256, spans (see the module) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = docs.select(F.explode(_candidates(text)).alias("t"))
    found = thresholds(tokens.groupBy(_band(F.col("t.n")).alias("band"), _bin(F.col("t.p")).alias("bin")).agg(F.count("*").alias("n")), fdr)

    def rejected(x: Column) -> Column:
        out = F.lit(False)
        for band, least in sorted(found.items()):
            out = out | ((_band(x["n"]) == band) & (_bin(x["p"]) >= least))
        return out

    base = docs.select(*keep, text.alias("__text")).select(*keep, *[_spans(F.col("__text"), k).alias(f"__{k}") for k in KINDS[:3]], _candidates(F.col("__text")).alias("__tokens"))

    def tag(column: str, kind: int) -> Column:
        return F.transform(column, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))

    tagged = F.concat(*[tag(f"__{k}", i) for i, k in enumerate(KINDS[:3])])
    rows = base.withColumn("__base", F.array_sort(tagged))
    rows = rows.withColumn("__hits", F.filter("__tokens", lambda x: rejected(x) & ~F.exists("__base", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))))
    rows = rows.withColumn("__random", tag("__hits", 3))
    names = F.array(*map(F.lit, KINDS))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")
    return rows.select(
        *keep,
        *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(written(F.col("__base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("__base", "__random"))).alias("spans"),
    )
