"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch form one sequence of symbols. An index maps each
adjacent pair to all its positions; the active ranks are applied in ascending
order, each at all its positions at once, and only the lists of the pairs at
the touched places are updated. Every worker keeps the words it has encoded in
a table of bounded size, which is cleared when full.

The result equals that of the tokenizers library with add_special_tokens=False
and decode(skip_special_tokens=False) for files of this kind: NFC, white space
runs to one space, lower case, a split pattern, byte-level symbols, an
end-of-word suffix, and special tokens found in the raw text.

Defined cases: a null text counts as empty, which has no tokens; an empty table
gives no rows; very long texts are encoded whole; repeated rows get equal results;
ties do not arise, as of equal ranks the first place goes first; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import with_text

#: Words kept by a worker: about 50 MB.
KEPT_WORDS = 150_000

_SPACE = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Codec:
    """A vocabulary, its merges, and the words encoded so far."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.number = {i: str(i) for i in self.token}
        self.size = max(self.token) + 1
        split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(split)
        ascii_split = split.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r ").replace("[[", "[").replace("]]", "]")
        self.ascii_pattern = re.compile(ascii_split, re.ASCII)
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbol = byte_symbols()
        absent = -1
        self.inner = np.array([vocab.get(c, absent) for c in symbol], np.int64)
        self.last = np.array([vocab.get(c + suffix, absent) for c in symbol], np.int64)
        self.rank: dict[int, int] = {}
        self.left, self.right, self.made = [], [], []
        for r, (a, b) in enumerate(model["merges"]):
            self.rank[vocab[a] * self.size + vocab[b]] = r
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.made.append(vocab[a + b])
        keys = np.array(sorted(self.rank), np.int64)
        self.keys, self.ranks = keys, np.array([self.rank[k] for k in keys.tolist()], np.int64)
        self.words: dict[str, tuple[str, int, str]] = {}

    def normal(self, text: str) -> str:
        """Normalised text; lower case is taken character by character."""
        if text.isascii():
            return text.lower()  # white space runs only separate, so they need no rewriting here
        text = _SPACE.sub(" ", unicodedata.normalize("NFC", text))
        return text.replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        text = self.normal(text)
        return self.ascii_pattern.findall(text) if text.isascii() else self.pattern.findall(text)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Token ids of distinct words, by the pair occurrence index, and the bounds of each word's ids."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths)
        n = len(data)
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(raw)), lengths)
        known = sym >= 0
        if not known.all():  # symbols outside the vocabulary vanish
            sym, word = sym[known], word[known]
            n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        same = word[1:] == word[:-1]
        if n:
            nxt[-1], prv[0] = -1, -1
            nxt[:-1][~same] = -1
            prv[1:][~same] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            """Enter the pairs that begin at these positions."""
            if not len(at):
                return
            rank = self._ranks(sym[at], sym[nxt[at]])
            good = rank >= 0
            at, rank = at[good], rank[good]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for part, r in zip(np.split(at, cut), rank[np.append(0, cut)].tolist()):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(part)

        add(np.flatnonzero(nxt >= 0))
        while heap:
            r = heapq.heappop(heap)
            at = index.pop(r)
            at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            a, b = self.left[r], self.right[r]
            after = nxt[at]
            at = at[(sym[at] == a) & (after >= 0) & (sym[after] == b)]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # of overlapping places the leftmost counts
                at = np.sort(at)
                taken, keep = -1, []
                for p in at.tolist():
                    if p != taken:
                        keep.append(p)
                        taken = nxt[p]
                at = np.array(keep, np.int64)
            gone = nxt[at]
            sym[at] = self.made[r]
            sym[gone] = -1
            following = nxt[gone]
            nxt[at] = following
            has = following >= 0
            prv[following[has]] = at[has]
            nxt[gone] = -1
            before = prv[at]
            add(np.unique(np.concatenate([before[before >= 0], at[has]])))
        left = sym >= 0
        ids, owner = sym[left], word[left]
        return ids.tolist(), np.searchsorted(owner, np.arange(len(raw) + 1)).tolist()

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > KEPT_WORDS:
            self.words.clear()
            new = list(words)
        for a in range(0, len(new), 200_000):
            part = new[a : a + 200_000]
            ids, bounds = self.merge(part)
            for w, i, j in zip(part, bounds, bounds[1:]):
                own = ids[i:j]
                self.words[w] = (" ".join([self.number[x] for x in own]), j - i, " ".join([self.token[x] for x in own]))

    def pieces(self, text: str) -> list[str]:
        """Words of a text in order; special tokens as (themselves,)."""
        if self.parts is None or "<|" not in text:
            return self.split(text)
        out: list = []
        for k, part in enumerate(self.parts.split(text)):
            out += [(part,)] if k % 2 else self.split(part)
        return out

    def encode_decode(self, texts: list[str], limit: int = 2 << 20) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, ids joined by spaces, decoded text) of each text, in slices of bounded size."""
        row = 0
        while row < len(texts):
            end, size = row, 0
            while end < len(texts) and (end == row or size + len(texts[end]) <= limit):
                size += len(texts[end])
                end += 1
            split = [self.pieces(t) for t in texts[row:end]]
            fresh: set = set()
            for ws in split:
                fresh.update(ws)
            for special in [w for w in fresh if isinstance(w, tuple)]:
                fresh.discard(special)
                self.words.setdefault(special, (str(self.special[special[0]]), 1, special[0]))
            self.learn(fresh)
            for special, i in self.special.items():
                self.words.setdefault((special,), (str(i), 1, special))
            known = self.words
            for ws in split:
                got = [known[w] for w in ws]
                got = [g for g in got if g[1]]
                yield sum([g[1] for g in got]), " ".join([g[0] for g in got]), " ".join([g[2] for g in got])
            row = end


_codecs: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """The worker's codec of a file: read once, and with the words of earlier tasks."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(path)
    return _codecs[path]


def tokens(docs: DataFrame, path: str, keep: list[str], with_ids: bool = False, text: str = "text") -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded."""
    schema = docs.select(*keep).schema
    more = ", ids array<int>, decoded string" if with_ids else ""
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + more])

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            n, ids, decoded, raw = [], [], [], []
            texts = batch.column(place).fill_null("")
            for a in range(0, len(texts), 768):  # few of the batch's texts are Python strings at a time
                for count, joined, back in codec.encode_decode(texts.slice(a, 768).to_pylist()):
                    n.append(count)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        raw.append(([int(i) for i in joined.split()], back))
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array([r[0] for r in raw], pa.list_(pa.int32())), pa.array([r[1] for r in raw], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows, place = with_text(docs, keep, text)
    return rows.mapInArrow(code, out_schema)
