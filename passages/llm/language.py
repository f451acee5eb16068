"""Language ID by error-correcting output codes.

Every language has a codeword; one binary n-gram classifier per bit (ridge
regression on hashed byte trigrams) predicts it, and decoding chooses the
codeword with the least weighted exponential loss, each bit weighted by how
well its classifier separates the training rows. If the runner-up's loss is
close, the row is flagged as ambiguous.

The classifiers are fitted on a sample of about ``SAMPLE_ROWS`` labelled rows
(``SAMPLE_ROWS / languages`` of each language, at least 32, chosen by a hash of
the id, and at least one row of every language that has a text with a letter);
the driver holds about 256 KB for each language above 32. Prediction reads the
whole of every text, in one pass without a shuffle.

Defined cases: a null text, or one without any letter, is ``und`` with score 0;
so is every text if there are no labelled rows; labels that are null do not
take part, nor do rows without a letter count for a label's rate; of equally near
codewords the first label in order wins; a label with few rows is learned from
those; very long texts are read whole; repeated rows get the same prediction each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .common import bounded_batches, with_text

SAMPLE_ROWS = 1024
BINS = 2048
#: A row is ambiguous if the best probability is below this.
AMBIGUOUS = 0.6

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def trigram_bins(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The bin of the trigram at each byte; BINS where it would leave its row."""
    n = len(data)
    folded = _FOLD[data]
    key = folded << np.uint32(16)
    key[:-1] |= folded[1:] << np.uint32(8)
    key[:-2] |= folded[2:]
    bins = ((key * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)
    for back in (1, 2):
        at = offs[1:] - back
        bins[at[(at >= 0) & (at < n)]] = BINS
    return bins


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """+1/-1 per language and bit: every split for up to 7 languages, else the most distant random code."""
    if languages == 1:
        return np.ones((1, 1), np.float32)
    if languages <= 7:
        splits = [s for s in range(1, 1 << (languages - 1))]
        return np.array([[1 if l == 0 or not (s >> (l - 1)) & 1 else -1 for s in splits] for l in range(languages)], np.float32)
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(6 * np.log2(languages)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (languages, bits))
        apart = bits - (code @ code.T)
        np.fill_diagonal(apart, np.inf)
        if apart.min() > far and (np.abs(code.sum(0)) < languages).all():
            best, far = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # BINS + 1 x bits
    bias: np.ndarray
    trust: np.ndarray  # per bit, sums to the number of bits

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest codeword, its probability) per row."""
        m, plus = np.clip(margins, -4, 4), (self.code > 0).T.astype(np.float64)
        loss = (np.exp(-m) * self.trust) @ plus + (np.exp(m) * self.trust) @ (1 - plus)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best]

    def margins(self, text: pa.Array) -> np.ndarray:
        out = np.tile(self.bias.astype(np.float64), (len(text), 1))
        limit = max(1 << 16, (8 << 20) // self.weights.shape[1])
        for a, b, data, offs in kernels.slices(text, limit):
            length = np.diff(offs)
            full = np.flatnonzero(length)
            if not len(full):
                continue
            sums = np.add.reduceat(self.weights[trigram_bins(data, offs)], offs[:-1][full], axis=0)
            out[a + full] += sums / length[full, None]
        return out


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, train: Column, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on a bounded sample of the rows where ``train`` holds and lang is known."""
    bounded_batches(docs.sparkSession)
    labelled = docs.where(train & F.col("lang").isNotNull()).select("lang", "text", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)).alias("at"))
    letters = has_letter(F.col("text"))
    counts = labelled.groupBy("lang").agg(F.count(F.when(letters, 1)).alias("n"), F.min(F.when(letters, F.col("at"))).alias("least")).where("least IS NOT NULL").orderBy("lang").collect()
    if not counts:
        return None
    each = max(32, sample_rows // len(counts))
    # A language's first row is below its bound too, so that every language is learned.
    below = [max(int(min(1.0, each / r.n) * (1 << 20)) + 1, r.least + 1) for r in counts]
    bounds = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array([r.lang for r in counts], pa.string()), "below": pa.array(below, pa.int64())}))
    chosen = labelled.join(F.broadcast(bounds), "lang").where((F.col("at") < F.col("below")) & letters)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, data, offs in kernels.slices(batch.column(1), 1 << 20):
                bins = trigram_bins(data, offs)
                for a, b in zip(offs[:-1], offs[1:]):
                    rows.append((np.bincount(bins[a:b], minlength=BINS + 1)[:BINS] / max(1, b - a)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "x"])

    # At most 4 * each rows a language, whatever the hash does; ordered so that the model does not depend on tasks.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at", F.xxhash64("text")))
    chosen = chosen.withColumn("place", place).where(F.col("place") <= 4 * each)
    got = chosen.select("lang", "text").mapInArrow(features, "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    order = sorted(zip(got.column("lang").to_pylist(), got.column("x").to_pylist()))
    del got
    labels, x = [lang for lang, _ in order], np.frombuffer(b"".join([b for _, b in order]), np.float32).reshape(len(order), BINS).copy()
    del order
    languages = sorted(set(labels))
    number = {lang: i for i, lang in enumerate(languages)}
    y = np.array([number[lang] for lang in labels])
    scale = 1 / np.sqrt(x.mean(0, dtype=np.float64) + 1e-5)
    x *= scale.astype(np.float32)
    code = codewords(len(languages))
    share = np.bincount(y, minlength=len(languages)) / len(y)
    target = code[y].astype(np.float64)
    weight = (1 / (share * len(languages)))[y]  # languages count alike
    mean_x, mean_t = (weight / weight.sum()) @ x, np.average(target, 0, weight)
    root = np.sqrt(weight)[:, None]
    x -= mean_x.astype(np.float32)
    x *= root.astype(np.float32)
    # The same ridge solution by rows or, if there are more rows than bins, by bins.
    by_rows = len(x) <= BINS
    gram = (x @ x.T if by_rows else x.T @ x).astype(np.float64)
    gram[np.diag_indices(len(gram))] += 0.02 * np.trace(gram) / len(x) + 1e-9
    goal = (target - mean_t) * root
    if by_rows:
        w = x.T @ np.linalg.solve(gram, goal).astype(np.float32)
    else:
        w = np.linalg.solve(gram, sum(x[a : a + BINS].T.astype(np.float64) @ goal[a : a + BINS] for a in range(0, len(x), BINS)))
    bias = mean_t - mean_x @ w
    agree = np.clip(1 - 2 * np.average(np.sign((x @ w) / root + mean_t) != target, 0, weight), 0.05, 1)
    del x, gram
    pa.default_memory_pool().release_unused()
    weights = np.zeros((BINS + 1, code.shape[1]), np.float32)
    weights[:BINS] = w * scale[:, None]
    return Model(languages, code, weights, bias, agree * code.shape[1] / agree.sum())


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """keep, lang_pred, score and ambiguous, for every row of docs."""
    schema = docs.select(*keep).schema
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "lang_pred string, score double, ambiguous boolean"])
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*sent.value.languages, "und"], dtype=object)
        for batch in batches:
            texts, letters = batch.column(place), batch.column(batch.num_columns - 1)
            known = np.asarray(letters.to_numpy(zero_copy_only=False), dtype=bool)
            best, p = sent.value.decode(sent.value.margins(texts))
            best, p = np.where(known, best, len(names) - 1), np.where(known, p, 0.0)
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(names[best], pa.string()), pa.array(p, pa.float64()), pa.array(p < AMBIGUOUS)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "ambiguous"])

    rows, place = with_text(docs, keep, text)
    return rows.withColumn("__letters", has_letter(F.col("__text" if place == len(keep) else text))).mapInArrow(label, out_schema)
