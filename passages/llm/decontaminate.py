"""Benchmark decontamination by an FM-index per training shard.

A shard is one Arrow batch of documents. Its words become symbols (the words of
the benchmark get one each, all others are one separator), and runs of symbols
too short for the shortest test phrase leave the shard, as no phrase can occur
there. The shard's suffix array gives its Burrows-Wheeler transform, kept as a
wavelet matrix whose ranks drive a backward search of all test phrases at once.
Occurrences are located from sampled suffix positions by LF steps, and the
spans that they cover are merged.

Test phrases reach the workers by broadcast, in blocks of at most
``BLOCK_WORDS`` words, so its size is bounded whatever the benchmark holds:
with more than one block, the rows are written once, each with a number of its
own, each block is one pass over them, and spans are merged by that number.

Defined cases: a null or empty text has no words and no hits; an item without
words is no phrase; repeated documents or items count each for itself; a null
item_id never names an item; with no items nothing is hit; columns beside the
named ones are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import with_text, written

WINDOW = 13
#: Words of test phrases in one broadcast. A phrase takes 13 * 8 bytes, its length and its items: about 100 MB on a worker, and as much on the driver.
BLOCK_WORDS = 500_000
#: One suffix position in this many is kept.
SAMPLE = 8

Windows = tuple[list[np.ndarray], list[str]]


class FMIndex:
    """Full-text index of a sequence of small integers (1 or more)."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE) -> None:
        self.text = np.append(seq, 0).astype(np.int64)  # 0 ends the text and occurs once
        self.n = n = len(self.text)
        rank = np.unique(self.text, return_inverse=True)[1].astype(np.int64)
        step = 1
        while n > 1 and rank.max() < n - 1:  # prefix doubling until every suffix has its own rank
            after = np.zeros(n, dtype=np.int64)
            after[: n - step] = rank[step:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            step *= 2
        suffixes = np.empty(n, dtype=np.int64)
        suffixes[rank] = np.arange(n)
        self.bwt = self.text[suffixes - 1]
        symbols = int(self.text.max()) + 1
        self.before = np.zeros(symbols + 1, dtype=np.int64)
        np.cumsum(np.bincount(self.text, minlength=symbols), out=self.before[1:])
        self.levels: list[tuple[int, int, np.ndarray]] = []
        column = self.bwt
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = ((column >> bit) & 1).astype(bool)
            counts = np.zeros(n + 1, dtype=np.int64)
            np.cumsum(ones, out=counts[1:])
            self.levels.append((bit, n - int(counts[-1]), counts))
            column = np.concatenate([column[~ones], column[ones]])
        self.marked = suffixes % sample == 0
        self.marks_before = np.cumsum(self.marked) - self.marked
        self.samples = suffixes[self.marked]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each row."""
        low, high = np.zeros_like(row), row
        for bit, zeros, counts in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            low = np.where(one, zeros + counts[low], low - counts[low])
            high = np.where(one, zeros + counts[high], high - counts[high])
        return high - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase; phrases are padded at the left."""
        width = phrases.shape[1]
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        known = len(self.before) - 1
        for j in range(width - 1, -1, -1):
            live = np.flatnonzero((width - j <= lengths) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, j]
            absent = symbol >= known
            symbol = np.where(absent, 0, symbol)
            a = self.before[symbol] + self.rank(symbol, low[live])
            b = self.before[symbol] + self.rank(symbol, high[live])
            low[live], high[live] = a, np.where(absent, a, b)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row's suffix."""
        out, row, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.marked[row[live]]
            hit = live[done]
            out[hit] = self.samples[self.marks_before[row[hit]]] + steps[hit]
            live = live[~done]
            symbol = self.bwt[row[live]]
            row[live] = self.before[symbol] + self.rank(symbol, row[live])
            steps[live] += 1
        return out


def _hashed(texts: list[str | None]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, offs in kernels.slices(pa.array(texts, pa.large_string())):
        h, first = kernels.words(data, offs, kernels.ALNUM)
        out += [h[a:b] for a, b in zip(first[:-1], first[1:])]
    return out


class Phrases:
    """Test phrases of some items: symbols of words, padded phrases, and the items of each."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW) -> None:
        items = [(i, h) for i, h in zip(ids, _hashed(texts)) if i is not None and len(h)]
        every = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        self.vocabulary = every  # the symbol of a word is its place here plus 2; 1 separates
        found: dict[bytes, tuple[np.ndarray, set[str]]] = {}
        for i, h in items:
            symbols = np.searchsorted(every, h).astype(np.int64) + 2
            for a in range(max(1, len(h) - window + 1)):
                phrase = symbols[a : a + window]
                found.setdefault(phrase.tobytes(), (phrase, set()))[1].add(str(i))
        self.lengths = np.array([len(p) for p, _ in found.values()], np.int64)
        self.items = [sorted(x) for _, x in found.values()]
        self.phrases = np.zeros((len(found), window), np.int64)
        for row, (p, _) in enumerate(found.values()):
            self.phrases[row, window - len(p) :] = p
        self.least = int(self.lengths.min()) if len(found) else 0
        self.quick = np.zeros(1 << 20, dtype=bool)
        self.quick[(every >> np.uint64(44)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), np.int64)
        maybe = np.flatnonzero(self.quick[(hashes >> np.uint64(44)).astype(np.int64)])
        if len(maybe):
            h = hashes[maybe]
            at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == h
            out[maybe[same]] = at[same] + 2
        return out


def _runs(symbols: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of runs of at least ``least`` benchmark words that stay in one document."""
    inside = symbols > 1
    edge = np.zeros(len(symbols) + 1, dtype=bool)
    edge[first] = True
    left = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    right = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    start, end = np.flatnonzero(inside & ~left), np.flatnonzero(inside & ~right) + 1
    keep = end - start >= least
    return start[keep], end[keep]


def find(text: pa.Array, phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
    """Per row: its number of words, the indices of the words hit, the items that occur."""
    n_words, parts, where, total = [], [], [], 0
    firsts = [np.zeros(1, np.int64)]
    for _, _, data, offs in kernels.slices(text):
        hashes, first = kernels.words(data, offs, kernels.ALNUM)
        n_words.append(np.diff(first))
        if len(phrases.lengths) and len(hashes):
            symbols = phrases.symbols(hashes)
            for a, b in zip(*_runs(symbols, first, phrases.least)):
                parts += [symbols[a:b], np.ones(1, np.int64)]
                where += [np.arange(a, b) + total, np.full(1, -1)]
        firsts.append(first[1:] + total)
        total += len(hashes)
    counts = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
    bounds = np.concatenate(firsts)
    hits: list[np.ndarray] = [np.zeros(0, np.int64)] * len(counts)
    items: list[set[str]] = [set() for _ in counts]
    if not parts:
        return counts, hits, items
    seq, place = np.concatenate(parts), np.concatenate(where)
    index = FMIndex(seq)
    low, high = index.search(phrases.phrases, phrases.lengths)
    which = np.repeat(np.arange(len(low)), high - low)
    if not len(which):
        return counts, hits, items
    rows = np.concatenate([np.arange(a, b) for a, b in zip(low, high) if a < b])
    at = index.locate(rows)
    cover = np.zeros(len(seq) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + phrases.lengths[which], -1)
    covered = place[np.flatnonzero(np.cumsum(cover[:-1]) > 0)]
    covered.sort()
    doc_of = np.searchsorted(bounds, covered, side="right") - 1
    for d in np.unique(doc_of):
        hits[d] = covered[doc_of == d] - bounds[d]
    for d, w in set(zip((np.searchsorted(bounds, place[at], side="right") - 1).tolist(), which.tolist())):
        items[d].update(phrases.items[w])
    return counts, hits, items


def _spans(words: np.ndarray) -> list[dict[str, int]]:
    """Merged [start, end) runs of ascending word indices."""
    if not len(words):
        return []
    cut = np.flatnonzero(np.diff(words) > 1)
    starts, ends = words[np.append(0, cut + 1)], words[np.append(cut, len(words) - 1)] + 1
    return [{"start": int(a), "end": int(b)} for a, b in zip(starts, ends)]


def _block_count(benchmark: DataFrame, block_words: int) -> int:
    """An item's share of a block is its bytes: a word has at least two with its separator."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // (2 * block_words)))


def _blocks(benchmark: DataFrame, blocks: int) -> Iterator[tuple[list, list]]:
    """Items in blocks of bounded size; the whole benchmark is never on the driver at once."""
    items = benchmark.select(F.col("item_id").alias("i"), F.col("text").alias("t"))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else items
        got = part.toArrow()
        yield got.column("i").to_pylist(), got.column("t").to_pylist()


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, block_words: int = BLOCK_WORDS, text: str = "text") -> DataFrame:
    """Columns ``keep`` of docs with n_words, spans (merged word spans) and items of each row.

    With one block of items this is one pass without a shuffle.
    """
    spark = docs.sparkSession
    blocks = _block_count(benchmark, block_words)
    rows, place = with_text(docs, keep, text)
    sent_back = keep
    if blocks > 1:
        # Neither doc_id nor all columns tell rows apart, and a number is stable only once it is written.
        number = "__row"
        while number in rows.columns:
            number += "_"
        numbered = written(rows.withColumn(number, F.monotonically_increasing_id()), "numbered")
        rows, place, sent_back = numbered.select(number, F.col(rows.columns[place]).alias(f"{number}text")), 1, [number]
    schema = rows.select(*sent_back).schema
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"])
    passes = []
    for b, (ids, texts) in enumerate(_blocks(benchmark, blocks)):
        sent = spark.sparkContext.broadcast(Phrases(ids, texts, window))

        def shard(batches: Iterable[pa.RecordBatch], sent=sent, every=b == 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, hits, items = find(batch.column(place), sent.value)
                span = pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64())])
                columns = [batch.column(i) for i in range(len(sent_back))]
                columns += [pa.array(counts, pa.int64()), pa.array([_spans(h) for h in hits], pa.list_(span)), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays(columns, names=[*sent_back, "n_words", "spans", "items"])
                # The first pass has every row; of the others only rows with a hit say more.
                yield out if every else out.take(pa.array([i for i, h in enumerate(hits) if len(h)], pa.int64()))

        passes.append(rows.mapInArrow(shard, out_schema))
    if len(passes) == 1:
        return passes[0]
    # What meets is a row's spans, not its text.
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    met = every.groupBy(number).agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.expr(
        "aggregate(array_sort(spans), cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) -> "
        "if(size(a) > 0 and element_at(a, -1).end >= x.start, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))), "
        "concat(a, array(x))))"
    )
    met = met.select(F.col(number), F.col("n_words").alias(f"{number}n"), joined.alias(f"{number}spans"), F.col("items").alias(f"{number}items"))
    back = numbered.select(*keep, number).join(met, number)
    return back.select(*keep, F.col(f"{number}n").alias("n_words"), F.col(f"{number}spans").alias("spans"), F.col(f"{number}items").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, text: str = "text") -> DataFrame:
    """keep, n_words, n_hit, n_items, items_sha256, contaminated and the merged word spans."""
    found = contaminated_spans(docs, benchmark, keep, window, text=text)
    n_hit = F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.start)")
    return found.select(
        *keep,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.col("spans"),
    )


def sha_of(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
