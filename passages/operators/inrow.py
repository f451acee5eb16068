"""Chunks and postings of Arrow batches: what chunking and the index say as expressions, many times as fast.

Expressions on arrays are interpreted for each element. Here a page is cut by
string operations, and the terms of many chunks are numbered, sorted and grouped
as arrays. Batches and what is held of them are of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.text import _fold_one

#: What the JVM's [\s\p{Z}] matches.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The JVM's $: the end, or before a line end that is the last thing.
_END = r"(?=[\n\r\x85\u2028\u2029]?\Z)"
_MARK = re.compile(rf"[{SPACES}]*(#{{1,6}}) +[{SPACES}]*[^{SPACES}]")
_TITLE = re.compile(rf"[{SPACES}]*#{{1,6}} +([^\n\r\x85\u2028\u2029]*){_END}")
_PAGE = re.compile(rf"page[ \t\n\x0b\x0c\r]*[0-9]+{_END}")
_RARE = re.compile(f"[{SPACES.replace(' ', '').replace(chr(10), '')}]")  # neither space nor newline
_WIDE = re.compile(f"[{SPACES}]{{2}}")
_STOP = re.compile(f"([.!?])[{SPACES}]")
_TERM = re.compile(r"[\w\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd-]+")


def trim(text: str) -> str:
    """functions.text.trim(): its pattern also ends before a last U+0085."""
    return text[:-1].strip(SPACES) + "\x85" if text.endswith("\x85") else text.strip(SPACES)


def page_header(text: str) -> str | None:
    """chunking.page_header() of a text."""
    at = 0
    while at <= len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = trim(text[at:stop])
        if line and not _PAGE.match(line):
            return line
        at = stop + 1
    return None


def sections(text: str) -> list[tuple[int, list[str], str]]:
    """(number, titles, body) of a page's parts, as chunking.sections() has them."""
    if "# " not in text:
        return [(0, [], text)]
    lines = text.split("\n")
    heads = []
    for i, line in enumerate(lines):
        mark = _MARK.match(line) if "# " in line else None
        if mark:
            title = _TITLE.match(line)
            heads.append((i, len(mark[1]), trim(title[1]) if title else ""))
    stops = [at for at, *_ in heads] + [len(lines)]
    out, path = [(0, [], "\n".join(lines[: stops[0]]))], []
    for n, (at, level, title) in enumerate(heads, 1):
        path = [h for h in path if h[0] < level] + [(level, title)]
        out.append((n, [t for _, t in path], "\n".join(lines[at + 1 : stops[n]])))
    return out


def packed(body: str, top: int, overlap: int) -> list[str]:
    """The chunk texts of a trimmed body, as chunking.pack() makes them of functions.text.units()."""
    rare = _RARE.search(body) is not None
    if rare:
        table = "\t" in body or "|" in body or _WIDE.search(body) is not None
    else:
        table = "|" in body or "  " in body or "\n\n" in body or " \n" in body or "\n " in body
    if table:
        cut = body
    elif rare:
        cut = _STOP.sub("\\1\n", body)
    else:
        cut = body.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n")
    units = [u for u in map(trim, cut.split("\n")) if u]
    if not units:
        return []
    starts, tails, held = [0], [False], len(units[0])
    for i in range(1, len(units)):
        size = len(units[i])
        if held + 1 + size > top:
            begun = min(overlap, held) + 1 + size
            fits = bool(overlap) and begun <= top
            held = begun if fits else size
            starts.append(i)
            tails.append(fits)
        else:
            held += 1 + size
    starts.append(len(units))
    joiner, out = "\n" if table else " ", []
    for k, tail in enumerate(tails):
        own = joiner.join(units[starts[k] : starts[k + 1]])
        out.append(f"{out[-1][-overlap:]}\n{own}" if tail else own)
    return out


CHUNK = "chunk_id string, source_id string, name string, ordinal int, page int, content string, section_title string, parent_id string, content_hash string"
#: Rows of a batch of chunks or postings that is handed back.
OUT_ROWS, OUT_CHUNKS = 1 << 14, 1 << 11


def chunker(top: int, overlap: int, header: bool, beside: int):
    """Batches of pages (source_id, name, page, text), each a whole source, to batches of chunks."""
    names = [x.split()[0] for x in CHUNK.split(", ")] + ["__header"] * header + ["__before", "__after"] * bool(beside)
    kinds = [pa.int32() if n in ("ordinal", "page") else pa.string() for n in names]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for source, name, page, text in zip(*(c.to_pylist() for c in batch.columns[:4])):
                if text is None:
                    continue
                first = (page_header(text),) if header else ()
                found = []
                for n, titles, body in sections(text):
                    body = trim(body)
                    title = " > ".join(titles) if titles else None
                    parent = f"{source}:p{page}:s{n}" if n and source is not None and page is not None else None
                    found += [(t, title, parent) for t in packed(body, top, overlap)] if body else []
                for i, (content, title, parent) in enumerate(found):
                    digest = hashlib.sha256(trim(content).encode()).hexdigest()
                    key = f"{i}:{digest[:16]}" if source is None else f"{source}:{i}:{digest[:16]}"
                    near = (found[i - 1][0][-beside:] if i else None, found[i + 1][0][:beside] if i + 1 < len(found) else None) if beside else ()
                    rows.append((key, source, name, i, page, content, title, parent, digest, *first, *near))
                    if len(rows) >= OUT_CHUNKS:
                        yield made(rows)
                        rows = []
        if rows:
            yield made(rows)

    return run


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() or c in b"_-" else 32 for c in range(256))


class _Folded(dict):
    """The terms of pieces of text that are not ASCII, with spaces between; no term reaches over a space, and none is folded by what is beyond it."""

    def __missing__(self, piece: str) -> str:
        out = self[piece] = " ".join(_TERM.findall(_fold_one(piece)))
        return out

    def terms(self, text: str) -> list[bytes]:
        """functions.text.tokens() of a text, in UTF-8."""
        if not text.isascii():
            text = " ".join([p if p.isascii() else self[p] for p in text.split(" ")])
            if len(self) >= PIECES:
                self.clear()
        return text.encode().translate(_LOWER).split()


class _Codes(dict):
    """Numbers of terms, in the order in which they are met."""

    def __missing__(self, term: bytes) -> int:
        out = self[term] = len(self)
        return out


#: Terms of one sorted run of postings, and different pieces that are remembered.
RUN_TERMS, PIECES = 1 << 20, 1 << 17

POSTING = "term string, chunk_id string, source_id string, tf int, dl int, spots array<int>, __b int"


def poster(gap: int):
    """Batches of (chunk_id, source_id, __b, text, section_title) to postings, sorted by bucket, term and chunk in runs of RUN_TERMS."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded, codes, ids, sources, buckets, parts, spots, sizes = _Folded(), _Codes(), [], [], [], [], [], []
        held = 0
        for batch in batches:
            for key, source, b, *columns in zip(*(c.to_pylist() for c in batch.columns[:5])):
                size = 0
                for k, text in enumerate((columns[0], source, columns[1])):
                    if text:
                        terms = folded.terms(text)
                        one = np.fromiter(map(codes.__getitem__, terms), np.int32, len(terms))
                        parts.append(one)
                        spots.append(np.arange(k * gap, k * gap + len(one), dtype=np.int32))
                        size += len(one)
                ids.append(key)
                sources.append(source)
                buckets.append(b)
                sizes.append(size)
                held += size
                if held >= RUN_TERMS:
                    yield from _sorted_run(codes, ids, sources, buckets, parts, spots, sizes)
                    codes, ids, sources, buckets, parts, spots, sizes, held = _Codes(), [], [], [], [], [], [], 0
        if held:
            yield from _sorted_run(codes, ids, sources, buckets, parts, spots, sizes)

    return run


def _sorted_run(codes: _Codes, ids: list, sources: list, buckets: list, parts: list, spots: list, sizes: list) -> Iterator[pa.RecordBatch]:
    rows = sorted(range(len(ids)), key=lambda i: (buckets[i], ids[i]))
    place = np.empty(len(ids), np.int64)
    place[rows] = np.arange(len(ids))
    names = pa.array(codes, pa.binary())
    by_name = pc.sort_indices(names)
    rank = np.empty(len(names), np.int64)
    rank[by_name.to_numpy()] = np.arange(len(names))
    dl, b = np.array(sizes, np.int32), np.array(buckets, np.int64)
    row = np.repeat(np.arange(len(ids)), dl)
    keys = (b[row] * len(names) + rank[np.concatenate(parts)]) * len(ids) + place[row]
    order = np.argsort(keys, kind="stable")  # spots of a chunk come in order
    keys, spot = keys[order], np.concatenate(spots)[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    stops = np.append(first[1:], len(keys))
    of = np.array(rows)[keys[first] % len(ids)]
    term = keys[first] // len(ids) % len(names)
    terms, chunk_ids, source_ids = names.take(by_name).cast(pa.string()), pa.array(ids, pa.string()), pa.array(sources, pa.string())
    for a in range(0, len(first), OUT_ROWS):
        z = min(a + OUT_ROWS, len(first))
        own, lo, hi = pa.array(of[a:z]), first[a], stops[z - 1]
        offsets = pa.array(np.append(first[a:z], hi) - lo, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                terms.take(pa.array(term[a:z])), chunk_ids.take(own), source_ids.take(own), pa.array((stops[a:z] - first[a:z]).astype(np.int32)),
                pa.array(dl[of[a:z]]), pa.ListArray.from_arrays(offsets, pa.array(spot[lo:hi])), pa.array(b[of[a:z]].astype(np.int32)),
            ],
            names=[x.split()[0] for x in POSTING.split(", ")],
        )


LENGTH = "chunk_id string, source_id string, dl int"


def counter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (chunk_id, source_id, text, section_title) to (chunk_id, source_id, dl)."""
    folded = _Folded()
    for batch in batches:
        dl = [sum(len(folded.terms(t)) for t in texts if t) for texts in zip(*(c.to_pylist() for c in batch.columns[1:4]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dl, pa.int32())], names=["chunk_id", "source_id", "dl"])
