"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Two sets with 100 |A and B| >= 80 |A or B| differ in at most (|A| + |B|) / 9
elements. Sets fall into bands of size; in each band a hash deals the universe
of shingles out to so many segments that, of any (allowed difference + 1)
segments, two similar sets agree on one. Every set indexes all its non-empty
segments in its own band; as a probe, there and in the band below, it chooses
just as many as the principle needs: the fullest ones, whose contents are the
least likely to be shared by chance. If too few are non-empty, the first
``DOUBLES`` segments also count with one deletion: they are indexed and probed
with every one of their elements left out, and each then counts as two. A set
for which even that is not enough is compared with all sets, in blocks.

Signatures travel packed: each task sorts its entries by bucket, so a shuffled
row is a block of them. A group of sets with one signature gives all its pairs
if it is small, else the pairs with its least member; after those are verified,
groups that still hold several components are compared between these, by a
parity sketch that bounds the difference from below (two parts of ``PART`` sets of a
group meet in a task, never the whole of it), and what it does not exclude is verified too: first so many pairs as join the components, then all
that are left between those still apart. So no link is lost, and a large group of copies costs
one verification per copy and signature at most. Verification compares the
whole sets.

Equal sets are one set throughout (each task emits a set once, and documents
meet their set by its fingerprint); components are computed on distributed
edges, never on the driver.

Defined cases: a null text, or one without words, is an empty set, linked with
nothing; fewer words than a shingle has are one shingle; rows that repeat a
doc_id are rows of their own; a null doc_id never names a component unless no
other id is in it; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import bounded_batches, forget, written
from .components import components, joined

WIDTH = 5
#: Ratio of a band's largest to its smallest size.
BAND = 1.5
#: Segments that are also indexed with one deletion.
DOUBLES = 4
#: Segments per needed one.
SPARE = 1.1
#: Groups of at most so many sets give all their pairs.
SMALL_GROUP = 8
#: Sets in a part of a larger group; two parts meet in a task.
PART = 1024
#: Entries that a task gathers before it sends them, and entries of a bucket.
FLUSH, BUCKET_ENTRIES = 300_000, 400_000
#: Keys of candidate documents that may be broadcast (16 bytes each); above, texts are shuffled.
BROADCAST_KEYS = 500_000

_U = np.uint64


def _bands(largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest size of each band, its number of segments; and for each size up to ``largest`` its band."""
    tops = [1]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, int(tops[-1] * BAND)))
    tops_ = np.array(tops, np.int64)
    most = (tops_ + tops_ * 5 // 4) // 9 + 1
    segments = np.maximum(most + 2, np.ceil(most * SPARE).astype(np.int64))
    return tops_, segments, np.searchsorted(tops_, np.arange(largest + 1))


def fingerprint(rows: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key of each set, 0 for the empty one."""
    return np.array([int(kernels.mix(np.array([kernels.mix(r ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + _U(len(r))], np.uint64))[0]) | 1 if len(r) else 0 for r in rows], np.uint64)


def sets_of(text: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) of slices of the rows."""
    for a, _, data, offs in kernels.slices(text):
        hashes, first = kernels.words(data, offs, kernels.SPACED)
        yield a, kernels.shingles(hashes, first, width)


def _segment_sums(elements: np.ndarray, owner: np.ndarray, segments: np.ndarray, bands: np.ndarray):
    """Per owner and segment: offset of the owner's segments, counts, and signature sums; plus each element's slot."""
    base = np.concatenate([[0], np.cumsum(segments)])
    salt = kernels.mix(bands.astype(np.uint64) + _U(1))
    deal = kernels.mix(elements ^ salt[owner])
    seg = ((deal >> _U(32)) * segments[owner].astype(np.uint64)) >> _U(32)
    slot = base[owner] + seg.astype(np.int64)
    n = int(base[-1])
    value = kernels.mix(elements + _U(0x94D049BB133111EB))
    low, high = value & _U(0xFFFFFFFF), value >> _U(32)
    count = np.bincount(slot, minlength=n)
    # Sums of 32-bit halves are exact as doubles.
    low_sum = np.bincount(slot, weights=low.astype(np.float64), minlength=n).astype(np.uint64)
    high_sum = np.bincount(slot, weights=high.astype(np.float64), minlength=n).astype(np.uint64)
    return base, slot, count, low, high, low_sum, high_sum


def _sign(low: np.ndarray, high: np.ndarray, place: np.ndarray, deleted: bool) -> np.ndarray:
    """Signature of a segment's content; place tells band and segment, deleted the space of deletions."""
    return kernels.mix(low * _U(0x9E3779B97F4A7C15) + high * _U(0xC2B2AE3D27D4EB4F) + place * _U(0xD6E8FEB86659FD93) + _U(0x2545F4914F6CDD1D if deleted else 0))


def entries(rows: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures with the probe flag as lowest bit, keys, keys of sets to compare with all)."""
    sizes = np.array([len(r) for r in rows], np.int64)
    if not len(sizes) or not sizes.max():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    tops, segment_counts, band_of = _bands(int(sizes.max()))
    signs, owners, beyond = [], [], []

    def emit(signature: np.ndarray, owner: np.ndarray, probe) -> None:
        signs.append((signature & ~_U(1)) | np.asarray(probe).astype(np.uint64))
        owners.append(keys[owner])

    for below in (0, 1):
        band = band_of[sizes] - below
        use = (sizes > 0) & (band >= 0)
        if below:
            use &= np.ceil(sizes * 4 / 5).astype(np.int64) <= tops[np.maximum(band, 0)]
        which = np.flatnonzero(use)
        if not len(which):
            continue
        size, band = sizes[which], band[which]
        need = (size + np.minimum(size, tops[band])) // 9 + 1
        segments = segment_counts[band]
        elements = np.concatenate([rows[i] for i in which])
        owner = np.repeat(np.arange(len(which)), size)
        base, slot, count, low, high, low_sum, high_sum = _segment_sums(elements, owner, segments, band)
        of = np.repeat(np.arange(len(which)), segments)
        seg = np.arange(len(of)) - base[of]
        place = band[of].astype(np.uint64) * _U(1 << 32) + seg.astype(np.uint64)
        signature = _sign(low_sum, high_sum, place, False)
        full = count > 0
        # The fullest segments of each owner, as many as it needs.
        order = np.lexsort((-count, of))
        rank = np.empty(len(of), np.int64)
        rank[order] = np.arange(len(of)) - base[of[order]]
        probe = full & (rank < need[of])
        lack = need - np.add.reduceat(full, base[:-1])
        keep = full if not below else probe
        emit(signature[keep], which[of[keep]], probe[keep])
        # One deletion: indexed always, probed by those that lack segments.
        double = (count >= 2) & (seg < DOUBLES)
        wanted = double & (np.where(double, np.cumsum(double) - 1, 0) - np.concatenate([[0], np.cumsum(double)])[base[of]] < lack[of])
        beyond.append(keys[which[lack > np.add.reduceat(double, base[:-1])]])
        part = double[slot] if not below else wanted[slot]
        at = slot[part]
        if len(at):
            left_low, left_high = low_sum[at] - low[part], high_sum[at] - high[part]
            if not below:
                emit(_sign(left_low, left_high, place[at], True), which[owner[part]], np.zeros(len(at), bool))
            ask = wanted[at]
            emit(_sign(left_low[ask], left_high[ask], place[at][ask], False), which[owner[part]][ask], np.ones(int(ask.sum()), bool))
        if wanted.any():
            emit(_sign(low_sum[wanted], high_sum[wanted], place[wanted], True), which[of[wanted]], np.ones(int(wanted.sum()), bool))
    return np.concatenate(signs), np.concatenate(owners), np.concatenate(beyond)


def _packed(signs: np.ndarray, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows (bucket, data): 6 bytes of each signature with its flag, then 8 of each key."""
    bucket = ((kernels.mix(signs | _U(1)) >> _U(32)) * _U(buckets)) >> _U(32)
    order = np.argsort(bucket, kind="stable")
    bucket, signs, keys = bucket[order], signs[order], keys[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).astype(np.int64)
    data = [signs[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + keys[a:b].astype("<u8").tobytes() for a, b in zip(cut[:-1], cut[1:])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "data"])


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    signs, keys = [], []
    for blob in blobs:
        n = len(blob) // 14
        raw = np.zeros((n, 8), np.uint8)
        raw[:, :6] = np.frombuffer(blob, np.uint8, 6 * n).reshape(n, 6)
        signs.append(raw.view("<u8").ravel())
        keys.append(np.frombuffer(blob, "<u8", n, 6 * n))
    return np.concatenate(signs), np.concatenate(keys)


def _groups(signs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Candidate pairs (a < b) of one bucket, and the members of its large groups."""
    probe, signs = (signs & _U(1)).astype(bool), signs >> _U(1)
    order = np.lexsort((keys, signs))
    signs, keys, probe = signs[order], keys[order], probe[order]
    new = np.ones(len(signs), bool)
    new[1:] = (signs[1:] != signs[:-1]) | (keys[1:] != keys[:-1])
    probe = np.maximum.reduceat(probe, np.flatnonzero(new))
    signs, keys = signs[new], keys[new]
    start = np.flatnonzero(np.concatenate([[True], signs[1:] != signs[:-1]]))
    size = np.diff(np.append(start, len(signs)))
    asked = np.maximum.reduceat(probe, start)
    live = (size > 1) & asked
    left, right, large = [], [], []
    for n in np.unique(size[live]):
        at = start[live & (size == n)]
        if n <= SMALL_GROUP:
            for i in range(n):
                for j in range(i + 1, n):
                    ok = probe[at + i] | probe[at + j]
                    left.append(keys[at[ok] + i])
                    right.append(keys[at[ok] + j])
        else:
            for a in at.tolist():
                left.append(np.full(n - 1, keys[a]))
                right.append(keys[a + 1 : a + n])
                large.append(keys[a : a + n])
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), large
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1], large


def _candidates(docs: DataFrame, buckets: int, width: int) -> DataFrame:
    """(kind, a, b): kind 0 pairs of keys; 1 members b of large group a; 2 keys a to compare with all."""

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task sends each set once
        signs, owners, held = [], [], 0
        for batch in batches:
            for _, rows in sets_of(batch.column(0), width):
                keys = fingerprint(rows)
                fresh = []
                for i, k in enumerate(keys.tolist()):
                    if k and k not in seen:
                        seen.add(k)
                        fresh.append(i)
                s, o, beyond = entries([rows[i] for i in fresh], keys[fresh])
                if len(beyond):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(1, -1, np.int32)), pa.array([beyond.astype("<u8").tobytes()], pa.binary())], names=["bucket", "data"])
                signs.append(s)
                owners.append(o)
                held += len(s)
                if held >= FLUSH:
                    yield _packed(np.concatenate(signs), np.concatenate(owners), buckets)
                    signs, owners, held = [], [], 0
        if held:
            yield _packed(np.concatenate(signs), np.concatenate(owners), buckets)

    def match(group: pa.Table) -> pa.Table:
        blobs = group.column("data").to_pylist()
        if group.column("bucket")[0].as_py() < 0:
            a = np.unique(np.frombuffer(b"".join(blobs), "<u8"))
            kind, b = np.full(len(a), 2), np.zeros(len(a), np.uint64)
        else:
            a, b, large = _groups(*_unpacked(blobs))
            known = {m.tobytes(): m for m in large}  # groups of the same sets count once
            parts = [(kernels.mix(np.array([kernels.mix(m).sum(dtype=np.uint64)], np.uint64))[0], m) for m in known.values()]
            kind = np.concatenate([np.zeros(len(a)), np.ones(sum(len(m) for _, m in parts))])
            a = np.concatenate([a, *[np.full(len(m), g) for g, m in parts]])
            b = np.concatenate([b, *[m for _, m in parts]])
        return pa.table({"kind": pa.array(kind.astype(np.int32)), "a": pa.array(a.astype(np.uint64).view(np.int64)), "b": pa.array(b.astype(np.uint64).view(np.int64))})

    packed = docs.select("text").mapInArrow(index, "bucket int, data binary")
    return packed.groupBy("bucket").applyInArrow(match, "kind int, a long, b long")


def _pack_set(row: np.ndarray) -> bytes:
    """6 bytes of each element, ascending."""
    return (row >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack_set(blob: bytes) -> np.ndarray:
    raw = np.zeros((len(blob) // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return raw.view("<u8").ravel()


def _similar(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_a, last = -1, np.zeros(0, np.uint64)
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                if a[i].as_py() != last_a:
                    last_a, last = a[i].as_py(), _unpack_set(x[i].as_buffer())
                keep[i] = _similar(last, _unpack_set(y[i].as_buffer()))
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    right = sets.select(F.col("key").alias("b"), F.col("items").alias("y"))
    left = sets.select(F.col("key").alias("a"), F.col("items").alias("x"))
    met = pairs.join(right, "b").join(left, "a")
    return met.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _candidate_sets(docs: DataFrame, members: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(key, items) of the sets with these keys, one document standing for all that have it; written."""
    # Copies meet map-side first, so a set that very many documents have is one row of a task, not all of them.
    chosen = members.groupBy("key").agg(F.min("ident").alias("ident")).join(keys, "key", "left_semi")
    chosen = written(chosen, "chosen")
    small = chosen.count() <= BROADCAST_KEYS
    texts = docs.select("text", _ident().alias("ident"))
    rows = texts.join(F.broadcast(chosen) if small else chosen, "ident")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, items = [], []
            for _, rows in sets_of(batch.column(1), width):
                keys += fingerprint(rows).view(np.int64).tolist()
                items += [_pack_set(r) for r in rows]
            got = pa.array(keys, pa.int64())
            # Rows that share an id may have another text: only the key's own set stands for it.
            mask = pa.compute.equal(got, batch.column(0))
            yield pa.RecordBatch.from_arrays([got.filter(mask), pa.array(items, pa.binary()).filter(mask)], names=["key", "items"])

    out = written(rows.select("key", "text").mapInArrow(pack, "key long, items binary"), "sets")
    forget(chosen)
    return out


def _ident():
    """A row's identity: its doc_id, or one of its text where that is null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def _members(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, ident, hash, n_shingles, key) of every row; written."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for _, rows in sets_of(batch.column(3), width):
                sizes += [len(r) for r in rows]
                keys += fingerprint(rows).view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())], names=["doc_id", "ident", "hash", "n_shingles", "key"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.select("doc_id", _ident().alias("ident"), F.xxhash64("text").alias("hash"), "text").mapInArrow(measure, f"doc_id {kind}, ident long, hash long, n_shingles long, key long"), "members")


def _sketch(row: np.ndarray) -> bytes:
    """Parities of the set's elements in 2**k cells, 4 to 8 for each element: two sets differ in as many cells at most as in elements."""
    bits = max(9, int(np.ceil(np.log2(max(1, len(row))))) + 2)
    odd = np.bincount((row >> _U(48 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """The sketches at the size of the smallest, as 64-bit words: parities of joined cells are those of both."""
    cells = 8 * min(map(len, sketches))
    rows = []
    for x in sketches:
        if 8 * len(x) > cells:
            bits = np.unpackbits(np.frombuffer(x, np.uint8)).reshape(cells, -1)
            rows.append(np.packbits(np.bitwise_xor.reduce(bits, axis=1)))
        else:
            rows.append(np.frombuffer(x, np.uint8))
    return np.stack(rows).view(np.uint64)


def _across(group: pa.Table, forest: bool) -> pa.Table:
    """Pairs of two parts of a large group, or of one, between its components that the sketches do not exclude.

    With ``forest`` only so many as join what may be joined: each set with the nearest of each component.
    """
    two = group.column("x")[0].as_py() != group.column("y")[0].as_py()
    order = np.argsort(group.column("n").to_numpy(), kind="stable")
    keys, roots, sizes, own = (group.column(c).to_numpy()[order] for c in ("key", "root", "n", "own"))
    sketches = _folded([group.column("sketch")[int(i)].as_py() for i in order])
    _, part = np.unique(roots, return_inverse=True)
    left, right = [], []
    for i in range(len(keys) - 1):
        end = int(np.searchsorted(sizes, sizes[i] * 5 // 4, side="right"))
        near = np.arange(i + 1, end)
        near = near[part[near] != part[i]]
        if two:
            near = near[own[near] != own[i]]
        if not len(near):
            continue
        apart = np.bitwise_count(sketches[near] ^ sketches[i]).sum(1, dtype=np.int64)
        ok = 9 * apart <= sizes[near] + sizes[i]
        near, apart = near[ok], apart[ok]
        if forest and len(near):
            nearest = near[np.argsort(apart, kind="stable")]
            parts, first = np.unique(part[nearest], return_index=True)
            near = nearest[first]
            part[np.isin(part, parts)] = part[i]
        left.append(np.full(len(near), keys[i]))
        right.append(keys[near])
    none = np.zeros(0, np.int64)
    return pa.table({"a": pa.array(np.concatenate([none, *left])), "b": pa.array(np.concatenate([none, *right]))})


def key_roots(docs: DataFrame, members: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, root): components of the keys of sets that are linked with another set; written."""
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(128, int(total * 0.5 / BUCKET_ENTRIES))
    found = written(_candidates(docs, buckets, width), "candidates")
    pairs = found.where("kind = 0").select("a", "b").distinct()
    keys = found.where("kind = 0").select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = _candidate_sets(docs, members, keys, width)
    edges = written(_verified(pairs, sets), "links")
    roots = components(edges)
    forget(edges)
    large = found.where("kind = 1").select(F.col("a").alias("g"), F.col("b").alias("key")).distinct()
    for forest in (True, False):  # what joins the components first; then all that is left between those still apart
        if large.isEmpty():
            break
        edges = _between(large, roots, sets, forest)
        roots = joined(roots, edges)
        forget(edges)
    alone = found.where("kind = 2").select(F.col("a").alias("key")).distinct()
    if not alone.isEmpty():
        links = _against_all(docs, members, alone, width)
        roots = joined(roots, links)
        forget(*links._parts)
    forget(found, sets)
    return roots


def _between(large: DataFrame, roots: DataFrame, sets: DataFrame, forest: bool) -> DataFrame:
    """Links between the components that large groups still hold; written."""
    labelled = written(large.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "labelled")
    mixed = labelled.groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).where("x != y").select("g", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    rows = written(labelled.join(mixed, "g"), "mixed")

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_unpack_set(x.as_buffer()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([_sketch(r) for r in rows], pa.binary())], names=["key", "n", "sketch"])

    sketches = sets.join(rows.select("key").distinct(), "key", "left_semi").select("key", "items").mapInArrow(sketch, "key long, n long, sketch binary").dropDuplicates(["key"])
    # A group is dealt out by a hash, and a task gets two parts of it, or one with itself.
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("g", "key", "root", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    crossing = dealt.join(sketches, "key").select("g", "x", "y", "own", "key", "root", "n", "sketch").groupBy("g", "x", "y").applyInArrow(lambda group: _across(group, forest), "a long, b long")
    pairs = crossing.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    out = written(_verified(pairs, sets), "links")
    forget(labelled, rows)
    return out


#: Shingles of the sets that are sent to all tasks at once, 8 bytes each; a larger set goes alone.
SENT_SHINGLES = 2_000_000


def _against_all(docs: DataFrame, members: DataFrame, alone: DataFrame, width: int, block: int = 1000) -> DataFrame:
    """Links of the few sets that no allocation of segments covers, each compared with all sets; written."""
    sizes = members.join(alone, "key", "left_semi").groupBy("key").agg(F.max("n_shingles").alias("n"))
    size = sizes.agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).first()
    blocks = max(1, -(-size.sets // (block // 2)), -(-(size.shingles or 0) // (SENT_SHINGLES // 2)))
    parts = []
    for i in range(blocks):
        keys = {r[0] for r in alone.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i).collect()}

        def own(batches: Iterable[pa.RecordBatch], keys=keys) -> Iterator[pa.RecordBatch]:
            seen = set()
            for batch in batches:
                for _, rows in sets_of(batch.column(0), width):
                    got = [(k, r.tobytes()) for k, r in zip(fingerprint(rows).view(np.int64).tolist(), rows) if k in keys and not (k in seen or seen.add(k))]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([r for _, r in got], pa.binary())], names=["key", "items"])

        mine = {r.key: r.items for r in docs.select("text").mapInArrow(own, "key long, items binary").dropDuplicates(["key"]).collect()}
        sent = docs.sparkSession.sparkContext.broadcast(mine)

        def compare(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked = [(k, np.frombuffer(x, np.uint64)) for k, x in sent.value.items()]
            for batch in batches:
                for _, rows in sets_of(batch.column(0), width):
                    got = [(k, o) for o, r in zip(fingerprint(rows).view(np.int64).tolist(), rows) if o for k, x in asked if k != o and _similar(x, r)]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([o for _, o in got], pa.int64())], names=["a", "b"])

        parts.append(written(docs.select("text").mapInArrow(compare, "a long, b long").distinct(), "links"))
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    out._parts = parts
    return out


def _chosen(docs: DataFrame, width: int, order) -> tuple[DataFrame, DataFrame]:
    """The members of docs, and (key, root, first): the least ``order`` of each component of sets; written.

    Rows meet by their set first, map-side, so neither copies nor a large component come to a task row by row.
    """
    members = _members(docs, width)
    roots = key_roots(docs, members, width)
    sets = members.where("n_shingles > 0").groupBy("key").agg(F.min(order).alias("first"))
    sets = sets.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    return members, written(sets, "set-roots")


def jaccard_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    members, sets = _chosen(docs, width, F.col("doc_id"))
    least = written(sets.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    # Both sides of each join are tables, so a key that very many rows share can be split.
    named = written(sets.select("key", "root").join(least, "root").select("key", "component_id"), "named")
    out = members.where("n_shingles > 0").join(named, "key").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs that stay: of each component the one with the least doc_id, and all empty sets.

    Of several texts with that doc_id the first by hash stays, and of rows equal in
    doc_id and text one; a text of another component stays whatever its doc_id.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("ident"), F.col("hash"))
    members, sets = _chosen(docs, width, order)
    linked = sets.groupBy("root").agg(F.min("first").alias("m")).select("m.ident", "m.hash")
    chosen = linked.unionByName(members.where("n_shingles = 0").select("ident", "hash").distinct())
    chosen = chosen.select(F.col("ident").alias("__ident"), F.col("hash").alias("__hash"))
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    known = docs.withColumn("__ident", _ident()).withColumn("__hash", F.xxhash64("text")).withColumn("__row", F.when(wordless, F.monotonically_increasing_id()))
    return known.join(chosen, ["__ident", "__hash"]).dropDuplicates(["__ident", "__hash", "__row"]).drop("__ident", "__hash", "__row")
