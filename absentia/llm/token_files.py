"""Token ids in patched frame-of-reference blocks, in document order.

Format. A table of frames; a frame holds whole documents in ascending order.

| column | holds |
| --- | --- |
| part, frame | place of the frame: part of the sort order, number within it |
| n_tokens | ids in the frame |
| doc_id, lengths | the documents and how many ids each has (its end id counted) |
| minimum, width, n_exceptions | the block index: for each block of 128 ids its least id, its bit width, its number of exceptions |
| starts | the byte at which each block begins in `packed` |
| packed | per block, ids less the minimum, `width` low bits each, least bit first |
| exception_at, exception_high | exceptions of all blocks: place within the block (a byte), and the bits above the width (four bytes) |

A block's width is the least that holds its 90th percentile; ids that need more
keep their low bits in place and their high bits in the exception list. Any block
can be read alone: `starts` gives its bytes, the running sum of `n_exceptions` its
part of the list.

Documents are dealt out by ranges of the order, sorted, encoded and packed within
tasks; no text passes through the driver. A frame grows to `FRAME_IDS` ids, then
the next begins; a document is never split over frames.

Edge cases: null text is empty and gives the end id alone. Rows that share a
doc_id follow each other by text. Null doc_ids come first. An empty table gives no
frames. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from absentia.llm.texts import map_batches, slices, text_bytes, text_key
from absentia.sources.storage import settle

BLOCK = 128
PERCENTILE = 90
FRAME_IDS = 1 << 16
PART_BYTES = 24 << 20
KNOWN_PIECES = 400_000
SLICE = 4 << 20
# Pieces joined for one call: more of them leave the processor's caches.
_JOINED = 100
# Marks that follow words, and letters and digits by any version of Unicode.
_MARKS = ".,;:!?%#$&*|)"
_LETTERS = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"

_FRAMES = pa.schema([
    ("part", pa.int32()), ("frame", pa.int32()), ("n_tokens", pa.int64()),
    ("doc_id", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("minimum", pa.binary()), ("width", pa.binary()), ("n_exceptions", pa.binary()),
    ("starts", pa.binary()), ("packed", pa.binary()),
    ("exception_at", pa.binary()), ("exception_high", pa.binary()),
])
_FRAMES_SQL = (
    "part int, frame int, n_tokens long, doc_id array<long>, lengths array<long>, minimum binary, "
    "width binary, n_exceptions binary, starts binary, packed binary, exception_at binary, "
    "exception_high binary"
)


def pack(ids: np.ndarray) -> dict[str, bytes]:
    """Blocks of unsigned 32-bit ids. The last block is filled up with its last id."""
    blocks = -(-len(ids) // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1] if len(ids) else 0
    grid = full.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = grid - low[:, None]
    at = BLOCK * PERCENTILE // 100 - 1
    typical = np.sort(rest, axis=1)[:, at] if blocks else low
    # frexp's exponent is the number of bits of a whole number.
    width = np.frexp(typical.astype(np.float64))[1].astype(np.uint8)
    size = width.astype(np.int64) * (BLOCK // 8)
    start = np.cumsum(size) - size
    packed = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(
            rest[rows].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little"
        )[:, :w]
        there = start[rows][:, None] + np.arange(w * (BLOCK // 8))
        packed[there] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
    high = rest.astype(np.uint64) >> width[:, None].astype(np.uint64)
    odd = np.nonzero(high)
    return {
        "minimum": low.astype("<u4").tobytes(),
        "width": width.tobytes(),
        "n_exceptions": np.bincount(odd[0], minlength=blocks).astype(np.uint8).tobytes(),
        "starts": start.astype("<u4").tobytes(),
        "packed": packed.tobytes(),
        "exception_at": odd[1].astype(np.uint8).tobytes(),
        "exception_high": high[odd].astype("<u4").tobytes(),
    }


def unpack(frame: dict[str, bytes], n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (all of them by default), of a frame of n ids."""
    blocks = slice(first, last)
    low = np.frombuffer(frame["minimum"], "<u4")[blocks]
    width = np.frombuffer(frame["width"], np.uint8)[blocks]
    start = np.frombuffer(frame["starts"], "<u4")[blocks].astype(np.int64)
    counts = np.frombuffer(frame["n_exceptions"], np.uint8).astype(np.int64)
    packed = np.frombuffer(frame["packed"], np.uint8)
    words = packed.view("<u4")  # blocks are whole numbers of words
    rest = np.zeros((len(low), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        own = np.zeros((len(rows), w * (BLOCK // 32) + 1), np.uint64)
        own[:, :-1] = words[start[rows][:, None] // 4 + np.arange(w * (BLOCK // 32))]
        bit = np.arange(BLOCK) * w
        two = own[:, bit // 32] | own[:, bit // 32 + 1] << np.uint64(32)
        rest[rows] = two >> (bit % 32).astype(np.uint64) & np.uint64((1 << w) - 1)
    before = int(counts[:first].sum())
    counts = counts[blocks]
    mine = slice(before, before + int(counts.sum()))
    at = np.frombuffer(frame["exception_at"], np.uint8)[mine]
    high = np.frombuffer(frame["exception_high"], "<u4")[mine]
    row = np.repeat(np.arange(len(low)), counts)
    rest[row, at] |= (high.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
    flat = (rest + low[:, None]).reshape(-1)
    return flat[: n - first * BLOCK] if last is None or last * BLOCK >= n else flat


class _Encoder:
    """A tokenizer, and the ids of pieces met lately.

    Known pieces are one Arrow array beside one array of all their ids, so a slice's
    pieces are looked up in one call. When there are more than `KNOWN_PIECES`, the half
    of that used most since the last time stays; so memory is bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        line_end = self._ids("\n")
        # Pieces can be encoded apart only if the library itself cuts the text there.
        self.separator = int(line_end[0]) if len(line_end) == 1 and self._cuts() else None
        # These two can't be told apart in a list joined by line ends; they always stay.
        self.known = pa.array(["", "\n"], pa.large_string())
        self.ids, self.sizes = line_end, np.array([0, 1])
        self.used = np.zeros(2, np.int64)

    def _cuts(self) -> bool:
        kind = type(self.tokenizer.pre_tokenizer).__name__
        return kind == "ByteLevel" and self.tokenizer.normalizer is None and not (
            self.tokenizer.pre_tokenizer.add_prefix_space
        )

    def _ids(self, text: str) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(found.ids, "<u4")

    def _encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has. Pieces are joined by line ends,
        whose id parts them again."""
        cuts = np.append(np.arange(0, len(pieces), _JOINED), len(pieces))
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pieces)
        joined = pc.binary_join(lists, pa.scalar("\n", pieces.type))
        found = [self._ids(some + "\n") for some in joined.to_pylist()]
        ids = np.concatenate(found) if found else np.zeros(0, "<u4")
        ends = np.flatnonzero(ids == self.separator)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _forget(self) -> None:
        order = np.argsort(-self.used[2:], kind="stable")[: KNOWN_PIECES // 2] + 2
        stay = np.append([0, 1], np.sort(order))
        starts = np.cumsum(self.sizes) - self.sizes
        self.ids = self.ids[_places(starts[stay], self.sizes[stay])]
        self.known, self.sizes = self.known.take(pa.array(stay)), self.sizes[stay]
        self.used = np.zeros(len(stay), np.int64)

    def look_up(self, pieces: pa.Array) -> np.ndarray:
        """Where each of these distinct pieces is among the known ones; those that were
        not become known."""
        if len(self.known) > KNOWN_PIECES:
            self._forget()
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(at))
        at = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        ids, sizes = self._encode(new)
        at[at < 0] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.ids, self.sizes = np.append(self.ids, ids), np.append(self.sizes, sizes)
        self.used = np.append(self.used, np.zeros(len(new), np.int64))
        self.used[at] += 1
        return at

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.separator is None:
            return [self._ids(t).tobytes() for t in texts]
        whole = [None if _cuttable(t) else self._ids(t).tobytes() for t in texts]
        cut = [t for t, ids in zip(texts, whole) if ids is None]
        parts = iter(self._of_pieces(cut) if cut else ())
        return [next(parts) if ids is None else ids for ids in whole]

    def _of_pieces(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts that may be cut: each distinct piece is looked up once, and the
        ids of all places are taken from those."""
        marked = pa.array(texts, pa.large_string())
        # A word and the marks after it are cut apart by the library, too.
        marked = pc.replace_substring_regex(marked, f"([{_LETTERS}])([{_MARKS}])", "\\1\x00\\2")
        for mark, cut in ((" ", "\x00 "), ("\n", "\x00\n\x00")):
            marked = pc.replace_substring(marked, mark, cut)
        lists = pc.split_pattern(marked, "\x00")
        coded = lists.flatten().dictionary_encode()
        at = self.look_up(coded.dictionary)[coded.indices.to_numpy()]
        counts = self.sizes[at]
        ends = np.append(0, np.cumsum(counts))
        starts = np.cumsum(self.sizes) - self.sizes
        data = self.ids[_places(starts[at], counts)].tobytes()
        cuts = (ends[lists.offsets.to_numpy()] * 4).tolist()
        for start, end in zip(cuts, cuts[1:]):
            yield data[start:end]


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at `starts`, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


_encoder = cache(_Encoder)


def _cuttable(text: str) -> bool:
    """Whether a text may be cut at spaces and line ends, and its parts encoded apart.

    A byte-level tokenizer never joins across a space or line end between two
    characters that are no white space. Texts in which white space meets white
    space, or with control characters or unusual spaces, are not cut.
    """
    return not text or not (
        text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text
        or "\n\n" in text or not text.replace("\n", "").isprintable()
    )


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text, as little-endian unsigned 32-bit integers.

    Every piece is encoded by the library, once for its occurrences while it is kept;
    the ids of a text are those of its pieces, one after the other.
    """
    return _encoder(path).encode(texts)


def _frame(part: int, number: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    data = np.frombuffer(b"".join(texts), "<u4")
    row = {"part": part, "frame": number, "n_tokens": len(data), "doc_id": ids,
           "lengths": [len(t) // 4 for t in texts], **pack(data)}
    return pa.RecordBatch.from_pylist([row], schema=_FRAMES)


def write_tokens(
    docs: DataFrame, path: str, end_id: int, order: Column | None = None
) -> DataFrame:
    """Encode every text, append `end_id`, write frames in the order of doc_id (or of
    `order`) to the shared folder, and return the table read back from there.

    path: a tokenizer file of the tokenizers library, the same on every machine.
    """
    parts = max(1, -(-text_bytes(docs) // PART_BYTES))
    place = F.col("doc_id").cast("long") if order is None else order
    dealt = docs.select(
        place.alias("place"), F.col("doc_id").cast("long"), text_key().alias("key"), "text"
    )
    dealt = dealt.repartitionByRange(parts, "place", "key")
    dealt = dealt.sortWithinPartitions("place", "key").select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        part, number, ids, done, size = TaskContext.get().partitionId(), 0, [], [], 0
        for rows, texts in slices(batches, "text", SLICE):
            found = encode([t.decode("utf-8", "replace") for t in texts], path)
            for doc_id, t in zip(rows.column(0).to_pylist(), found):
                ids.append(doc_id)
                done.append(t + end)
                size += len(t) // 4 + 1
                if size >= FRAME_IDS:
                    yield _frame(part, number, ids, done)
                    number, ids, done, size = number + 1, [], [], 0
            pa.default_memory_pool().release_unused()  # else it stays with the worker
        if ids:
            yield _frame(part, number, ids, done)

    return settle(map_batches(dealt, run, _FRAMES_SQL), "tokens")


_PACKED = ("minimum", "width", "n_exceptions", "starts", "packed", "exception_at", "exception_high")


def read_tokens(frames: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, decoded from
    the frames, one row for each document."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names)}
                data = unpack(row, row["n_tokens"]).astype("<u4").tobytes()
                sums, starts, at = [], [], 0
                for n in row["lengths"]:
                    sums.append(zlib.crc32(data[4 * at : 4 * (at + n)]))
                    starts.append(at)
                    at += n
                k = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * k, pa.int32()), pa.array([row["frame"]] * k, pa.int32()),
                     pa.array(row["doc_id"], pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(row["lengths"], pa.int64()), pa.array(sums, pa.int64())],
                    names=["part", "frame", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    decoded = map_batches(
        frames.select("part", "frame", "n_tokens", "doc_id", "lengths", *_PACKED),
        run, "part int, frame int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    return decoded.join(_frame_starts(frames), ["part", "frame"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def _frame_starts(frames: DataFrame) -> DataFrame:
    """part, frame, before (ids of all frames before it): sums within parts, then one
    row for each part, of which there is one for `PART_BYTES` of text."""
    sizes = frames.select("part", "frame", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("total").over(running), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return own.join(parts, "part").select(
        "part", "frame", (F.col("base") + F.col("own")).alias("before")
    )
