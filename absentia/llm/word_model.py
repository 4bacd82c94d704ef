"""A word model of the corpus: modified Kneser-Ney of order `ORDER`, in Spark throughout.

Texts are halved by a hash of the text, and each half is judged by the model of the
other, so no text vouches for itself. Words are lower-cased runs of letters and digits
(single characters where a script has no spaces), known by 48-bit hashes.

Every occurrence of an n-gram u, v, w is sent once, to the partition of its middle word:
there meet the counts of u v w, what follows u v, and what stands around v. Slices of
texts send packed arrays, one for each partition. What a partition cannot know is
summed at the partition of a word and sent back: the words that stand before w, and for
a v that is dealt to several partitions, by u and w, its counts of u v and v w. Then each
partition sends every slice the sums of its log probabilities by text, in whole
2**-`FRACTION`ths, so that sums do not depend on any order. All tables are shared out;
the driver gets how many counts are one to four, and the totals of the v dealt out.

The n-grams are sent in `ROUNDS` rounds, made again for the way back, and each round's
files are removed once it is worked up, so that one round is on disk at a time.

Short codes for the `CODES` words most frequent in about `SAMPLE_BYTES` of text make the
arrays small, and tell which v to deal out. Another sample changes sizes only: every
other word is sent by its hash.

Edge cases: texts without words get no value. Copies of a text share its value. If the
other half is empty all words are alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame, functions as F

from absentia.llm.texts import map_batches, ship, slices, text_bytes, text_key

ORDER = 3
CODES = 1 << 18
SAMPLE_BYTES = 64 << 20
PART_BYTES = 10 << 20
ROUNDS = 3
FRACTION = 20
_ALONE = "぀-ヿ㐀-鿿豈-﫿"
_WORD = re.compile(rf"[{_ALONE}]|[^\W{_ALONE}]+")
# The same for texts of the first 256 characters: lower case, blanks between words.
_PLAIN = "".join(c.lower() if _WORD.fullmatch(c) else " " for c in map(chr, range(256))).encode("latin-1")
_RUN = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_OF_BYTE = np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64)
_IS_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
# Of a word's hash so many bits tell it from others.
_BITS = 48


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _lowered(text: str) -> bytes:
    """The words of a text, with blanks around them."""
    try:
        plain = text.encode("latin-1").translate(_PLAIN)
        return plain if plain.isascii() else plain.decode("latin-1").encode()
    except UnicodeEncodeError:
        return " ".join(words(text)).encode("utf-8", "replace")


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, runs without white space, and how many each text has.

    A word's hash is a polynomial of its bytes: with sums from the start of a run of
    texts, all come out of a few operations on arrays.
    """
    hashes, sizes, start = [], [], 0
    while start < len(texts):
        stop, size = start + 1, len(texts[start])
        while stop < len(texts) and size + len(texts[stop]) <= _RUN:
            size += len(texts[stop])
            stop += 1
        some = texts[start:stop]
        a = np.frombuffer(b" ".join(some) + b" ", np.uint8)
        edges = np.flatnonzero(np.diff(_IS_SPACE[a], prepend=True))
        first, last = edges[::2], edges[1::2]
        power = np.full(len(a), _BASE, np.uint64)
        up = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_OF_BYTE[a] * np.multiply.accumulate(power), out=up[1:])
        power[:] = _INVERSE
        h = (up[last] - up[first]) * np.multiply.accumulate(power)[first]
        h ^= h >> np.uint64(32)
        h *= _MIX
        hashes.append(h ^ (h >> np.uint64(29)))
        ends = np.cumsum([len(t) + 1 for t in some])
        sizes.append(np.diff(np.searchsorted(first, ends), prepend=0))
        start = stop
    empty = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    return np.concatenate(hashes or empty[0]), np.concatenate(sizes or empty[1])


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and where they came from; sorting both as one number is faster."""
    bits = len(keys).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + bits > 63:
        order = np.argsort(keys)
        return keys[order], order
    both = keys << bits
    both |= np.arange(len(keys))
    both.sort()
    return both >> bits, (both & ((1 << bits) - 1)).astype(np.int32 if bits < 32 else np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers not below zero, the same bytes of all numbers together."""
    sizes, planes = [], []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        a = a.astype("<u4" if top < 1 << 32 else "<u8")
        a = a.view(np.uint8).reshape(-1, a.itemsize)[:, : max(1, (top.bit_length() + 7) // 8)]
        sizes += [a.shape[1], len(a)]
        planes.append(np.ascontiguousarray(a.T).tobytes())
    raw = np.array(sizes, "<u8").tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    sizes, at, out = np.frombuffer(raw, "<u8", 2 * n), 16 * n, []
    for width, length in sizes.reshape(-1, 2).tolist():
        a = np.zeros((length, 8), np.uint8)
        a[:, :width] = np.frombuffer(raw, np.uint8, width * length, at).reshape(width, length).T
        out.append(a.view("<u8").reshape(-1))
        at += width * length
    return out


@dataclass
class Codes:
    """The hashes of the words with a code, the empty word first, then by falling
    frequency; and to how many of `parts` partitions the n-grams around each are dealt."""

    hashes: np.ndarray
    spread: np.ndarray
    parts: int

    def __post_init__(self):
        self.by_hash = np.argsort(self.hashes).astype(np.int32)
        self.sorted = np.r_[self.hashes[self.by_hash], np.uint64(1 << 63)]
        # Where the words begin whose hashes have the same first bits.
        self.shift = np.uint64(max(0, _BITS - len(self.hashes).bit_length() - 1))
        starts = np.arange(1 << (_BITS - int(self.shift)), dtype=np.uint64) << self.shift
        self.buckets = np.searchsorted(self.sorted, starts).astype(np.int32)
        self.most = int(np.diff(self.buckets, append=len(self.hashes)).max())
        self.dealt = self.spread > 1
        # A v that is not dealt out is known by its place among those of its partition.
        home = (self.hashes % np.uint64(self.parts)).astype(np.int64)
        home[self.dealt] = -1
        self.by_home = np.argsort(home, kind="stable").astype(np.int32)
        home = home[self.by_home]
        self.starts = np.searchsorted(home, np.arange(self.parts + 1))
        self.places = np.empty(len(home), np.int32)
        self.places[self.by_home] = np.arange(len(home)) - np.r_[0, self.starts][home + 1] + (home >= 0) * self.starts[0]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The codes of words, the number of codes for those that have none."""
        out = np.full(len(hashes), len(self.hashes), np.int32)
        at, todo = self.buckets[hashes >> self.shift], np.arange(len(hashes))
        for _ in range(self.most):
            found = self.sorted[at]
            hit = found == hashes[todo]
            out[todo[hit]] = self.by_hash[at[hit]]
            more = found < hashes[todo]
            todo, at = todo[more], at[more] + 1
        return out

    def here(self, part: int) -> np.ndarray:
        """The codes a v of a partition may have, in the order of their places."""
        return np.r_[self.by_home[: self.starts[0]], self.by_home[self.starts[part] : self.starts[part + 1]]]


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, size = word_hashes([_lowered(t.decode("utf-8", "replace")) for t in texts])
    return hashes >> np.uint64(64 - _BITS), size


def _codes(docs: DataFrame, column: str, parts: int, size: int) -> Codes:
    def run(batches):
        for _, texts in slices(batches, column):
            hashes, size = _words_of(texts)
            found, n = np.unique(np.r_[hashes, np.zeros((size > 0).sum(), np.uint64)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["word", "n"])

    some = docs.select(column)
    if size > SAMPLE_BYTES:
        some = some.sample(SAMPLE_BYTES / size, seed=1)
    counted = map_batches(some, run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.desc("n"), "word").limit(CODES).toArrow()
    hashes, n = found["word"].to_numpy().view(np.uint64), found["n"].to_numpy().astype(float)
    empty = hashes == 0
    hashes = np.r_[np.zeros(1, np.uint64), hashes[~empty]]
    n = np.r_[n[empty].sum(), n[~empty]]
    # A word is dealt out if there are more n-grams around it than in half a partition.
    spread = np.ceil(2 * parts * n / max(1, n.sum())) if parts > 1 else np.ones(len(n))
    return Codes(hashes, np.clip(spread, 1, parts).astype(np.int32), parts)


def _runs(rows: Iterable[tuple[int, str]], limit: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Runs of rows whose texts add up to about `limit` bytes: their keys and texts."""
    keys, texts, size = [], [], 0
    for key, text in rows:
        text = (text or "").encode("utf-8", "replace")
        if size and size + len(text) > limit:
            yield np.array(keys, np.int64), texts
            keys, texts, size = [], [], 0
        keys.append(key)
        texts.append(text)
        size += len(text)
    if keys:
        yield np.array(keys, np.int64), texts


def _send(source: RDD, model, rounds: int, turn: int) -> RDD:
    """For each partition of a round, the n-grams of each slice that go there, and for
    each slice a head: the keys of its texts and how many words they have."""

    def run(rows):
        codes: Codes = model.value
        parts, none = codes.parts, len(codes.hashes)
        place = TaskContext.get().partitionId() - (1 << 32)
        for keys, texts in _runs(rows, PART_BYTES // 2):
            hashes, size = _words_of(texts)
            total = len(hashes)
            if not total:
                continue
            place += 1 << 32
            text = np.repeat(np.arange(len(size), dtype=np.int32), size)
            # Every text begins after ORDER - 1 empty words.
            last = np.arange(total) + 2 * (text + 1)
            flat = np.zeros(total + 2 * len(size), np.uint64)
            flat[last] = hashes
            code = np.zeros(len(flat), np.int32)
            code[last] = codes.of(hashes)
            v = code[last - 1]
            spread = np.r_[codes.spread, np.int32(1)][v]
            part = (flat[last - 1] % np.uint64(parts)).astype(np.int32)
            out = np.flatnonzero(spread > 1)
            deal = (flat[last[out] - 2] * _MIX + flat[last[out]]) * _MIX >> np.uint64(33)
            part[out] = (part[out] + (deal % spread[out].astype(np.uint64)).astype(np.int32)) % parts
            order = np.flatnonzero(part % rounds == turn)
            order = order[np.argsort(part[order].astype(np.uint16 if parts <= 1 << 16 else np.int32), kind="stable")]
            ends = np.cumsum(np.bincount(part[order], minlength=parts))
            # Which half a text is in goes with it.
            text = 2 * text + (keys & 1).astype(np.int32)[text]
            place_of = np.r_[codes.places, np.int32(-1)][v]
            if turn == 0:
                yield place % parts, ("head", place, _pack(keys.view(np.uint64), size))
            for p in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
                at = order[(ends[p - 1] if p else 0) : ends[p]]
                places = place_of[at]
                places[places < 0] = codes.starts[0] + codes.starts[p + 1] - codes.starts[p]
                us, vs, ws = (last[at] - k for k in (2, 1, 0))
                rare = [flat[x[code[x] == none]] for x in (us, vs, ws)]
                packed = _pack(code[us], places, code[ws], *rare, np.diff(text[at], prepend=0))
                yield p, ("block", place, packed)

    return source.mapPartitions(run).partitionBy(model.value.parts)


def _written(made: RDD, read: RDD) -> RDD:
    """Have a shuffle written, and the files of the one it has read removed."""
    made.foreachPartition(lambda _: None)
    read._jrdd.rdd().cleanShuffleDependencies(False)
    return made


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


def _firsts(ranked: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)


def _classes(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4 and any, and their sum."""
    n = np.bincount(np.minimum(counts, 5), minlength=6)
    return np.r_[n[1:5], n[1:].sum(), counts.sum()].astype(np.int64)


class _Part:
    """The n-grams of one partition: counts are of shape (2, n), by half."""

    def __init__(self, codes: Codes, part: int, blocks: list[tuple[int, bytes]]):
        self.parts = codes.parts
        none, here = len(codes.hashes), codes.here(part)
        us, vs, ws, rares, texts = [], [], [], [], []
        for _, data in blocks:
            u, v, w, ru, rv, rw, t = _unpack(data, 7)
            us.append(u.astype(np.int32)), ws.append(w.astype(np.int32)), rares.append((ru, rv, rw))
            vs.append(np.r_[here, np.int32(none)][v.astype(np.int32)])
            texts.append(np.cumsum(t.astype(np.int32), dtype=np.int32))
        rare = np.unique(np.concatenate([x for r in rares for x in r]))
        self.names = np.concatenate([codes.hashes, rare])
        self.dealt = np.concatenate([codes.dealt, np.zeros(len(rare), bool)])
        ids = []
        for k, xs in enumerate((us, vs, ws)):
            x = np.concatenate(xs)
            xs.clear()
            x[x == none] = none + np.searchsorted(rare, np.concatenate([r[k] for r in rares]))
            ids.append(x)
        u, v, w = ids
        self.texts, n = texts, max(1, len(self.names))
        pair = v * np.int64(n) + u
        if n >= 1 << 21:
            pair = np.unique(pair, return_inverse=True)[1]
        pair *= n
        pair += w
        ranked, self.order = _ranked(pair)
        first = _firsts(ranked)
        at = self.order[first]
        self.u, self.v, self.w = (x[at].astype(np.int64) for x in (u, v, w))
        half = (np.concatenate(texts) & 1).astype(np.int8)[self.order]
        size = np.diff(first, append=len(ranked))
        odd = np.add.reduceat(half, first, dtype=np.int64)
        self.size, self.half = size, half
        self.c = np.array([size - odd, odd])
        # Pairs u v: sums of counts, and how many counts are 1, 2, and 3 or more.
        self.of_uv = np.cumsum(np.r_[False, ranked[first][1:] // n != ranked[first][:-1] // n])
        uv = _firsts(self.of_uv)
        self.uv_u, self.uv_v = self.u[uv], self.v[uv]
        kinds = [_sums((c == 1).astype(np.int64), uv) for c in self.c], [_sums((c == 2).astype(np.int64), uv) for c in self.c]
        threes = [_sums((c > 2).astype(np.int64), uv) for c in self.c]
        self.uv = np.array([[_sums(c, uv), a, b, d] for c, a, b, d in zip(self.c, *kinds, threes)])
        # Pairs v w: after how many u they stand.
        ranked, order = _ranked(self.v * n + self.w)
        first = _firsts(ranked)
        pairs, self.of_vw = ranked[first], np.empty(len(ranked), np.int64)
        self.of_vw[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(ranked)))
        self.vw_v, self.vw_w = pairs // n, pairs % n
        self.vw = np.array([np.bincount(self.of_vw, c > 0, len(pairs)).astype(np.int64) for c in self.c])
        self.ends = np.flatnonzero(np.bincount(self.w, minlength=n))
        # What is summed elsewhere, in an order both ways know.
        self.asked = self._dealt(self.names[self.ends], self.names[self.ends])
        self.hot_vw = np.flatnonzero(self.dealt[self.vw_v])
        self.asked_vw = self._dealt(self.names[self.vw_w[self.hot_vw]], self.names[self.vw_v[self.hot_vw]])
        self.hot_uv = np.flatnonzero(self.dealt[self.uv_v])
        self.asked_uv = self._dealt(self.names[self.uv_u[self.hot_uv]], self.names[self.uv_v[self.hot_uv]])

    def _dealt(self, owner: np.ndarray, other: np.ndarray) -> dict[int, np.ndarray]:
        """Which entries each partition sums: that of the first word."""
        to = owner % np.uint64(self.parts)
        order = np.lexsort((other, owner, to))
        first = _firsts(to[order])
        return dict(zip(to[order][first].tolist(), np.split(order, first[1:])))

    def questions(self) -> Iterator[tuple[int, tuple]]:
        """For each partition what it shall add up."""
        own = self.vw[:, ~self.dealt[self.vw_v]]
        ends = self.vw_w[~self.dealt[self.vw_v]]
        before = [np.bincount(ends, c > 0, len(self.names)).astype(np.int64)[self.ends] for c in own]
        for q in sorted({*self.asked, *self.asked_vw, *self.asked_uv}):
            e, vw, uv = (x.get(q, np.zeros(0, np.int64)) for x in (self.asked, self.asked_vw, self.asked_uv))
            b, h = self.hot_vw[vw], self.hot_uv[uv]
            yield q, (_pack(
                self.names[self.ends[e]], before[0][e], before[1][e],
                self.names[self.vw_v[b]], self.names[self.vw_w[b]], *self.vw[:, b],
                self.names[self.uv_u[h]], self.names[self.uv_v[h]], *self.uv.reshape(8, -1)[:, h],
            ))

    def levels(self) -> np.ndarray:
        """By half, the classes of the counts of n-grams and of pairs v w at home here."""
        pairs = self.vw[:, ~self.dealt[self.vw_v]]
        return np.array([[_classes(c), _classes(p)] for c, p in zip(self.c, pairs)])


def _parts(records: Iterable[tuple]) -> tuple[dict, dict, list]:
    """Blocks and answers by partition, and heads of slices."""
    blocks, answers, heads = {}, {}, []
    for part, (kind, of, data) in records:
        if kind == "head":
            heads.append((of, data))
        else:
            (blocks if kind == "block" else answers).setdefault(part, []).append((of, data))
    return blocks, answers, heads


def _added(codes: Codes, asked: list[tuple[int, bytes]]):
    """The sums one partition makes, dealt to those that asked; and all its counts of words
    before a word, and of dealt pairs v w with the codes of their v."""
    sent = [_unpack(data, 17) for _, data in asked]

    def joined(k: int) -> np.ndarray:
        return np.concatenate([s[k] for s in sent])

    def both(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
        pairs, of = np.unique(left[1] * max(1, len(right[0])) + right[1], return_inverse=True)
        at = np.zeros(len(pairs), np.int64)
        at[of] = np.arange(len(of))
        return at, of

    def added(of: np.ndarray, k: int, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        np.add.at(out, of, joined(k).astype(np.int64))
        return out

    ends, of_end = np.unique(joined(0), return_inverse=True)
    before = np.array([added(of_end, k, len(ends)) for k in (1, 2)])
    at, of_vw = both(joined(3), joined(4))
    vw = np.array([added(of_vw, k, len(at)) for k in (5, 6)])
    v, w = joined(3)[at], np.searchsorted(ends, joined(4)[at])
    for m in (0, 1):
        before[m] += np.bincount(w, vw[m] > 0, len(ends)).astype(np.int64)
    at, of_uv = both(joined(7), joined(8))
    uv = np.array([added(of_uv, k, len(at)) for k in range(9, 17)])
    cuts = [np.cumsum([len(s[k]) for s in sent])[:-1] for k in (0, 3, 7)]
    split = [np.split(x, c, axis=1) for x, c in zip((before[:, of_end], vw[:, of_vw], uv[:, of_uv]), cuts)]
    answers = [(p, sums) for (p, _), sums in zip(asked, zip(*split))]
    return answers, before, vw, codes.of(v)


@dataclass
class _Levels:
    """By model: the discounts of counts 0 to 3 and more, and what a word not seen gets;
    for the v dealt out, by code, the sum of their counts and the weight left over."""

    discounts: np.ndarray
    total: np.ndarray
    unseen: np.ndarray
    hot: dict[int, int]
    hot_total: np.ndarray
    hot_left: np.ndarray


def _levels(classes: np.ndarray, hot: dict[int, int], kinds: np.ndarray) -> _Levels:
    """classes: (half, level, class); kinds: for each v dealt out and half, the sum of the
    counts of its pairs and how many are 1, 2, and 3 or more."""
    from absentia.llm.perplexity import discounts_of

    d = np.array([[discounts_of(c[:4].astype(float)) for c in half] for half in classes])
    ones = classes[:, 2]
    some = np.c_[ones[:, 0], ones[:, 1], ones[:, 4] - ones[:, 0] - ones[:, 1]]
    total = ones[:, 5].astype(float)
    left = (some * d[:, 2, 1:]).sum(1) / np.maximum(total, 1)
    sums = kinds[..., 0].astype(float)
    return _Levels(d, total, left / (ones[:, 4] + 1), hot, sums, (kinds[..., 1:] * d[:, 1, 1:]).sum(-1) / np.maximum(sums, 1))


def _log_probabilities(part: _Part, levels: _Levels, answers: list[tuple[int, bytes]]) -> np.ndarray:
    """Of each n-gram under each model, minus the log probability in 2**-FRACTIONths."""
    n = len(part.names)
    before, vw, uv = np.zeros((2, n), np.int64), part.vw.copy(), part.uv.reshape(8, -1).copy()
    for q, data in answers:
        sums = [x.astype(np.int64) for x in _unpack(data, 12)]
        if q in part.asked:
            before[:, part.ends[part.asked[q]]] = sums[:2]
        if q in part.asked_vw:
            vw[:, part.hot_vw[part.asked_vw[q]]] = sums[2:4]
        if q in part.asked_uv:
            uv[:, part.hot_uv[part.asked_uv[q]]] = sums[4:]
    uv = uv.reshape(2, 4, -1)
    hot = np.full(n, -1)
    hot[list(levels.hot)] = list(levels.hot.values())
    of = hot[part.vw_v]
    out = []
    for m, (d3, d2, d1) in enumerate(levels.discounts):
        cut = np.minimum(before[m], 3)
        p1 = (before[m] - d1[cut]) / levels.total[m] + levels.unseen[m] if levels.total[m] else np.ones(n)
        c = vw[m]
        lost = d2[np.minimum(c, 3)]
        total = np.bincount(part.vw_v, c, n)
        left = np.bincount(part.vw_v, lost, n) / np.maximum(total, 1)
        total, left = total[part.vw_v], left[part.vw_v]
        if len(levels.hot):
            total = np.where(of < 0, total, levels.hot_total[of, m])
            left = np.where(of < 0, left, levels.hot_left[of, m])
        p1 = p1[part.vw_w]
        p2 = np.where(total > 0, (c - lost) / np.maximum(total, 1) + left * p1, p1)[part.of_vw]
        total = uv[m, 0]
        left = (d3[1:] @ uv[m, 1:] / np.maximum(total, 1))[part.of_uv]
        total, c = total[part.of_uv], part.c[m]
        p3 = np.where(total > 0, (c - d3[np.minimum(c, 3)]) / np.maximum(total, 1) + left * p2, p2)
        # N-grams the other half has not are not asked of this model.
        p3[part.c[1 - m] == 0] = 1.0
        out.append(np.rint(-np.log(p3) * (1 << FRACTION)).astype(np.int64))
    return np.array(out)


def _scores(part: _Part, values: np.ndarray, blocks: list[tuple[int, bytes]]) -> Iterator[tuple[int, tuple]]:
    """For each slice the sums of its texts."""
    of = np.repeat(np.arange(len(part.size), dtype=np.int32), part.size)
    each = np.empty(len(of), np.int64)
    each[part.order] = np.where(part.half == 0, values[1][of], values[0][of])
    start = 0
    for (place, _), text in zip(blocks, part.texts):
        first = _firsts(text)
        sums = _sums(each[start : start + len(text)], first)
        yield place, ("sums", _pack(np.diff(text[first] >> 1, prepend=0), np.maximum(sums, 0)))
        start += len(text)


def word_perplexity(docs: DataFrame, column: str = "text") -> DataFrame:
    """word_key (of the text) and word_log_perplexity of every text that has words."""
    spark = docs.sparkSession
    size = text_bytes(docs, column)
    parts = max(1, -(-size // PART_BYTES))
    model = spark.sparkContext.broadcast(_codes(docs, column, parts, size))
    hot = {int(code): i for i, code in enumerate(np.flatnonzero(model.value.dealt))}

    def ask(records):
        blocks, _, _ = _parts(records)
        for p in list(blocks):
            part = _Part(model.value, p, blocks.pop(p))
            yield p, ("levels", p, part.levels())
            for q, data in part.questions():
                yield q, ("asked", p, data)

    def by_owner(records):
        asked, levels = {}, []
        for q, (kind, p, data) in records:
            if kind == "levels":
                levels.append(data)
            else:
                asked.setdefault(q, []).append((p, data))
        return asked, levels

    def count(records):
        asked, levels = by_owner(records)
        classes, kinds = np.zeros((2, 3, 6), np.int64), np.zeros((len(hot), 2, 4), np.int64)
        for own in levels:
            classes[:, :2] += own
        for some in asked.values():
            _, before, vw, v = _added(model.value, some)
            at = np.array([hot[x] for x in v.tolist()], np.int64)
            for m in (0, 1):
                classes[m, 2] += _classes(before[m])
                classes[m, 1] += _classes(vw[m])
                for k, c in enumerate((vw[m], vw[m] == 1, vw[m] == 2, vw[m] > 2)):
                    np.add.at(kinds[:, m, k], at, c.astype(np.int64))
        yield classes, kinds

    def answer(records):
        asked, _ = by_owner(records)
        for q in list(asked):
            for p, sums in _added(model.value, asked.pop(q))[0]:
                yield p, ("answer", q, _pack(*[x for some in sums for x in some]))

    # One round is on disk at a time; its n-grams are made again for the way back.
    ship(spark)
    source = docs.select(text_key(column).alias("key"), F.col(column).cast("string")).rdd
    rounds = min(ROUNDS, parts)
    asked = []
    for turn in range(rounds):
        sent = _send(source, model, rounds, turn)
        asked.append(_written(sent.mapPartitions(ask).partitionBy(parts), sent))
    owners = reduce(RDD.union, asked).partitionBy(parts)
    classes, kinds = owners.mapPartitions(count).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
    levels = spark.sparkContext.broadcast(_levels(classes, hot, kinds))

    def score(records):
        blocks, answers, heads = _parts(records)
        for place, data in heads:
            yield place, ("head", data)
        for p in list(blocks):
            some = blocks.pop(p)
            part = _Part(model.value, p, some)
            yield from _scores(part, _log_probabilities(part, levels.value, answers.get(p, [])), some)

    def by_text(records):
        of: dict[int, dict[str, list[bytes]]] = {}
        for place, (kind, data) in records:
            of.setdefault(place, {"head": [], "sums": []})[kind].append(data)
        for found in of.values():
            keys, size = _unpack(found["head"][0], 2)
            total = np.zeros(len(keys), np.int64)
            for data in found["sums"]:
                text, sums = _unpack(data, 2)
                total[np.cumsum(text.astype(np.int64))] += sums.astype(np.int64)
            some = size > 0
            yield from zip(keys.view(np.int64)[some].tolist(), total[some].tolist(), size[some].tolist())

    answers = owners.mapPartitions(answer).partitionBy(parts)
    scored = []
    for turn in range(rounds):
        sent = _send(source, model, rounds, turn)
        both = sent.union(answers).partitionBy(parts)
        scored.append(_written(both.mapPartitions(score).partitionBy(parts), sent))
    scored = reduce(RDD.union, scored).partitionBy(parts).mapPartitions(by_text)
    found = spark.createDataFrame(scored, "word_key long, total long, n long")
    # Copies of a text have the same sum.
    return found.groupBy("word_key").agg(
        (F.max("total") / F.lit(float(1 << FRACTION)) / F.max("n")).alias("word_log_perplexity"))
