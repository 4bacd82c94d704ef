"""Repeated passages: a count-min prefilter, then exact groups of what may repeat.

A window is `window` consecutive words. First pass: each task adds its windows to
count-min sketches and sends them on, cut into segments; segments are merged by
sums that stop at two. A cell only ever counts too much, so a window whose cells
do not all reach two occurs once and is done. Second pass: the windows that may
repeat are grouped by fingerprint, and all but the first of each group (smallest
doc_id, then start) are marked. Last, the words under marked windows go.

Sizes. The merged sketch is one bit for each cell and has at most `2 ** MAX_LOG2_CELLS`
cells (64 MB), whatever the input: that bound is what is broadcast. With more
windows than cells the prefilter passes more of them on to the exact pass; the
result stays the same. Windows are looked at in slices of texts; within a slice all but the first
occurrence of a window are marked at once, so that the most frequent window sends
one entry for each slice. Segments of the fingerprint range hold a bounded number
of entries; marks travel by document bucket, and buckets are read in streams, so
no task holds more than a segment or a bucket's marks.

Fingerprints have 96 bits: sums over a window of position-weighted word hashes
(XXH3, 128 bits). Among 10^12 different windows the chance that any two agree is
about 10^-5.

Edge cases: null text has no words; texts shorter than a window keep all. Rows that
share a doc_id are documents of their own, in the order of their text keys; rows
equal in both are one document to the others and all get its result. Null doc_ids
come first. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from absentia.llm.texts import map_batches, slices, text_bytes, text_key
from absentia.sources.storage import settle

MAX_LOG2_CELLS = 29
MIN_LOG2_CELLS = 22
LOG2_SEGMENT = 20
ROWS = 2
SKETCH_BYTES = 6 << 20
PART_WINDOWS = 1_000_000
BUCKET_BYTES = 2 << 20
LEAST_PARTS = 48
_NULL_ID = -(1 << 63)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _window_sums(hashes: np.ndarray, base: int, window: int) -> np.ndarray:
    """The weighted sum over the window at each place; by doubling, so that a window of
    20 takes six steps."""
    total, size, run, length = None, 0, hashes, 1
    left = window
    while left:
        if left & 1:
            if total is None:
                total = run
            else:
                n = len(run) - size
                total = total[:n] + _power(base, size) * run[size : size + n]
            size += length
        left >>= 1
        if left:
            n = len(run) - length
            run = run[:n] + _power(base, length) * run[length : length + n]
            length *= 2
    return total


def _power(base: int, k: int) -> np.uint64:
    return np.uint64(pow(base, k, 1 << 64))


class _Slice:
    """The windows of a run of texts: their fingerprints, document and start."""

    def __init__(self, texts: list[bytes], window: int):
        split = [t.split() for t in texts]
        size = np.array([len(w) for w in split], np.int64)
        first = np.cumsum(size) - size
        if size.sum() < window:
            self.hash = np.zeros((0, 2), np.uint64)
            self.doc = self.start = np.zeros(0, np.int64)
            return
        digests = b"".join(map(xxhash.xxh3_128_digest, chain.from_iterable(split)))
        del split
        words = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        count = np.maximum(size - window + 1, 0)
        self.doc = np.repeat(np.arange(len(size)), count)
        self.start = np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count)
        place = first[self.doc] + self.start
        self.hash = np.empty((len(place), 2), np.uint64)
        for r, base in enumerate(_BASES):
            h = _window_sums(np.ascontiguousarray(words[:, r]), base, window)[place]
            # Sums of odd multiples leave their low bits weak; mixing spreads the high ones.
            h ^= h >> np.uint64(32)
            h *= _MIX
            h ^= h >> np.uint64(29)
            self.hash[:, r] = h


def _cells(hashes: np.ndarray, log2_cells: int) -> list[np.ndarray]:
    """The cell of each window in every row of the sketch; rows share the cells."""
    shift = np.uint64(64 - log2_cells)
    return [(hashes[:, r] >> shift).astype(np.uint32) for r in range(ROWS)]


def _deltas(values: np.ndarray) -> bytes:
    """Steps between sorted values, byte by byte: the high ones are mostly zero."""
    steps = np.diff(values, prepend=values.dtype.type(0)).astype("<u4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _sums(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _sketch(docs: DataFrame, window: int, log2_cells: int) -> np.ndarray:
    """One bit for each cell: whether two windows or more fell into it."""
    segment_cells = 1 << LOG2_SEGMENT

    def partial(batches):
        for _, texts in slices(batches, "text", SKETCH_BYTES):
            found = _Slice(texts, window)
            if not len(found.hash):
                continue
            cells = np.sort(np.concatenate(_cells(found.hash, log2_cells)))
            fresh = np.flatnonzero(np.diff(cells, prepend=~cells[:1]))
            often = np.diff(fresh, append=len(cells)) > 1
            cells = cells[fresh]
            cuts = np.searchsorted(cells, np.arange(0, 1 << log2_cells, segment_cells))
            ends = np.append(cuts[1:], len(cells))
            here = [s for s in range(len(cuts)) if ends[s] > cuts[s]]
            at = [slice(cuts[s], ends[s]) for s in here]
            low = cells & np.uint32(segment_cells - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(here, pa.int32()), pa.array([_deltas(low[a]) for a in at], pa.binary()),
                 pa.array([_deltas(low[a][often[a]]) for a in at], pa.binary())],
                names=["segment", "once", "more"],
            )

    def merge(batches):
        """Rows come sorted by segment; the count of a cell stops at two."""
        now, counts = None, np.zeros(segment_cells, np.uint8)

        def closed():
            bits = zlib.compress(np.packbits(counts >= 2).tobytes(), 1)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([bits], pa.binary())],
                names=["segment", "bits"],
            )

        for batch in batches:
            for segment, once, more in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != now:
                    if now is not None:
                        yield closed()
                    now, counts[:] = segment, 0
                for data in (once, more):
                    cells = _sums(data)
                    counts[cells] = np.minimum(counts[cells] + 1, 2)
        if now is not None:
            yield closed()

    parts = map_batches(docs.select("text"), partial, "segment int, once binary, more binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment")
    merged = map_batches(merged, merge, "segment int, bits binary")
    bits = np.zeros((1 << log2_cells) // 8, np.uint8)
    # At most 2 ** log2_cells bits in all, packed.
    for row in merged.collect():
        at = row.segment * (segment_cells // 8)
        own = np.frombuffer(zlib.decompress(row.bits), np.uint8)
        bits[at : at + len(own)] = own
    return bits


_ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("doc", "<i8"), ("key", "<i8"), ("start", "<u4")])


def _dump(entries: np.ndarray) -> bytes:
    """Columns one after the other, the repetitive ones compressed."""
    tail = [entries[n].tobytes() for n in ("doc", "key", "start")]
    body = zlib.compress(b"".join(tail), 1)
    return entries["h1"].tobytes() + entries["h2"].tobytes() + body


def _load(data: bytes, n: int) -> np.ndarray:
    entries = np.empty(n, _ENTRY)
    entries["h1"] = np.frombuffer(data, "<u8", n)
    entries["h2"] = np.frombuffer(data, "<u4", n, 8 * n)
    rest = zlib.decompress(data[12 * n :])
    entries["doc"] = np.frombuffer(rest, "<i8", n)
    entries["key"] = np.frombuffer(rest, "<i8", n, 8 * n)
    entries["start"] = np.frombuffer(rest, "<u4", n, 16 * n)
    return entries


def _repeats(entries: np.ndarray) -> np.ndarray:
    """For each entry, whether the same window also starts earlier among them."""
    order = np.lexsort((entries["start"], entries["key"], entries["doc"], entries["h2"], entries["h1"]))
    e = entries[order]
    same = (e["h1"][1:] == e["h1"][:-1]) & (e["h2"][1:] == e["h2"][:-1])
    group = np.concatenate([[0], np.cumsum(~same)]) if len(e) else np.zeros(0, np.int64)
    first = np.searchsorted(group, group)
    later = np.zeros(len(e), bool)
    for n in ("doc", "key", "start"):
        later |= e[n] != e[n][first]
    out = np.zeros(len(e), bool)
    out[order] = later
    return out


def _marks(entries: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, int]]:
    """Marked windows as (bucket of the document, entries without hashes, count)."""
    bucket = _bucket(entries["doc"], entries["key"], buckets)
    order = np.lexsort((entries["start"], entries["key"], entries["doc"], bucket))
    entries, bucket = entries[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(bucket))):
        part = entries[a:b]
        body = b"".join(part[n].tobytes() for n in ("doc", "key", "start"))
        yield int(bucket[a]), zlib.compress(body, 1), b - a


def _bucket(doc: np.ndarray, key: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (doc.astype("<i8") ^ key.astype("<i8")).view(np.uint64) * _MIX
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


_CANDIDATES, _MARKED, _TEXT = 0, 1, 2
_PACKED_SQL = "part int, kind int, n int, data binary"
_PACKED = {"part": pa.int32(), "kind": pa.int32(), "n": pa.int32(), "data": pa.binary()}


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, _PACKED.values())], names=list(_PACKED)
    )


def _marked_windows(docs: DataFrame, window: int, size: int) -> tuple[DataFrame, int]:
    """Packed marks of windows that also start earlier, by bucket of their document."""
    spark = docs.sparkSession
    windows = max(1, size // 6)  # sets sizes only
    log2_cells = min(MAX_LOG2_CELLS, max(MIN_LOG2_CELLS, (4 * windows - 1).bit_length()))
    parts = max(LEAST_PARTS, -(-windows // PART_WINDOWS))
    buckets = max(LEAST_PARTS, -(-size // BUCKET_BYTES))
    sketch = spark.sparkContext.broadcast(_sketch(docs, window, log2_cells))

    def candidates(batches):
        bits = sketch.value
        for rows, texts in slices(batches, "text"):
            found = _Slice(texts, window)
            may = np.ones(len(found.hash), bool)
            for cells in _cells(found.hash, log2_cells):
                may &= (bits[cells >> np.uint32(3)] >> (7 - (cells & np.uint32(7))).astype(np.uint8)) & 1 > 0
            at = np.flatnonzero(may)
            if not len(at):
                continue
            doc = rows.column(0).to_numpy(zero_copy_only=False)
            key = rows.column(1).to_numpy(zero_copy_only=False)
            entries = np.empty(len(at), _ENTRY)
            entries["h1"], entries["h2"] = found.hash[at, 0], found.hash[at, 1] >> np.uint64(32)
            entries["doc"], entries["key"] = doc[found.doc[at]], key[found.doc[at]]
            entries["start"] = found.start[at]
            later = _repeats(entries)
            out = [(b, _MARKED, n, d) for b, d, n in _marks(entries[later], buckets)]
            first = entries[~later]
            part = (first["h1"] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            first, part = first[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(part))):
                out.append((int(part[a]), _CANDIDATES, b - a, _dump(first[a:b])))
            yield _packed(out)

    def exact(batches):
        """Sorted by kind and part: the candidates of a part meet, marks pass."""
        now, held, done = None, [], []

        def close():
            if held:
                entries = np.concatenate(held)
                done.append(entries[_repeats(entries)])
                held.clear()

        def flush():
            out = [(b, _MARKED, n, d) for b, d, n in _marks(np.concatenate(done), buckets)]
            done.clear()
            return _packed(out)

        for batch in batches:
            passed = []
            for part, kind, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == _MARKED:
                    passed.append((part, kind, n, data))
                    continue
                if part != now:
                    close()
                    now = part
                held.append(_load(data, n))
                if sum(map(len, done)) > PART_WINDOWS:
                    yield flush()
            yield _packed(passed)
        close()
        if done:
            yield flush()

    own = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc"),
        text_key().alias("key"), "text",
    )
    found = map_batches(own, candidates, _PACKED_SQL)
    dealt = found.repartition("kind", "part").sortWithinPartitions("kind", "part")
    return map_batches(dealt, exact, _PACKED_SQL), buckets


_OUT = {
    "doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string(),
    "kept_sha256": pa.string(),
}


def remove_repeats(docs: DataFrame, window: int = 20, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space; null if
    not `with_text`) and kept_sha256, for every row."""
    size = text_bytes(docs)
    marked, buckets = _marked_windows(docs, window, size)

    def bucketed(batches):
        for batch in batches:
            doc, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            part = pa.array(_bucket(doc, key, buckets), pa.int32())
            yield pa.RecordBatch.from_arrays([part, *batch.columns], names=["part", *batch.schema.names])

    def clean(batches):
        """Sorted by bucket, its marks before its texts."""
        now, marks = None, {}
        for batch in batches:
            out = []
            cols = (batch.column(i).to_pylist() for i in range(batch.num_columns))
            for part, kind, n, data, doc, key, doc_id in zip(*cols):
                if part != now:
                    now, marks = part, {}
                if kind == _MARKED:
                    for d, k, starts in _unmark(data, n):
                        marks.setdefault((d, k), []).append(starts)
                    continue
                words = (data or b"").split()
                gone = np.zeros(len(words) + 1, np.int64)
                for starts in marks.get((doc, key), ()):
                    gone[starts] += 1
                    gone[starts + window] -= 1
                stay = np.cumsum(gone)[:-1] == 0
                text = b" ".join([words[i] for i in np.flatnonzero(stay)])
                out.append((doc_id, len(words), len(words) - int(stay.sum()),
                            text if with_text else None, hashlib.sha256(text).hexdigest()))
            columns = list(zip(*out)) or [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary()).cast(t) if n == "kept" else pa.array(c, t)
                 for c, (n, t) in zip(columns, _OUT.items())], names=list(_OUT)
            )

    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc"),
        text_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("data"),
    )
    texts = map_batches(texts, bucketed, "part int, doc long, key long, doc_id long, data binary")
    fields = ("part", "kind", "n", "data", "doc", "key", "doc_id")
    texts = texts.withColumns({"kind": F.lit(_TEXT), "n": F.lit(0)}).select(*fields)
    none = F.lit(None).cast("long")
    marks = marked.withColumns({"doc": none, "key": none, "doc_id": none}).select(*fields)
    dealt = marks.unionByName(texts).repartition("part").sortWithinPartitions("part", "kind")
    types = {pa.int64(): "long", pa.string(): "string"}
    return map_batches(dealt, clean, ", ".join(f"{n} {types[t]}" for n, t in _OUT.items()))


def _unmark(data: bytes, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(document, text key, starts) of packed marks, which come sorted."""
    body = zlib.decompress(data)
    doc, key = np.frombuffer(body, "<i8", n), np.frombuffer(body, "<i8", n, 8 * n)
    start = np.frombuffer(body, "<u4", n, 16 * n).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    for a, b in zip(cuts, np.append(cuts[1:], n)):
        yield int(doc[a]), int(key[a]), start[a:b]
