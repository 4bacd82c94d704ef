"""Ranked lexical search: the best documents for each item, by buckets of vector lengths.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z
lower-cased. A document is a vector of impacts, an item a vector of term weights, a
score their inner product. Impacts are whole numbers, and so are weights, so scores are
exact (64 bits).

The method (LEMP): documents are ordered by the length of their vectors and fall into
buckets of similar length. For an item with length |q| that already has k documents of
score `least` or more, a bucket whose longest vector is l is left out if l * |q| < least.
Within a bucket, an item's heaviest coordinates are its focus. From `least`, its unit
vector and l follows the range that a unit vector in reach must have in a focus
coordinate; if the range excludes zero, only documents with that term come into
question. The partial product over the focus plus the product of the lengths outside it
bounds the score; whoever stays under `least` goes. What is left is scored in whole
numbers. Bounds get a margin far above the error of their doubles, and documents that tie
with `least` stay, so the result is that of scoring everything.

In Spark: one pass over the texts leaves, for each document, its number of terms and the
counts of the terms that items have (a narrow table in the shared folder). From it come
N, L and document frequencies by aggregation. Vectors are then dealt out by ranges of
length; ties (copies) are told apart by a hash of their place, so no length is one task. The
longest vectors go first and give every item a first `least`, at most one number an item;
then all other ranges run with it. Each task returns at most k documents an item, and the
best k of those are the result.

Items are a stated query set. They go through in blocks of about `BLOCK_BYTES` of text,
chosen by a hash; terms and weights of a block are what a task holds beside a bucket.

Edge cases: null text has no terms. An item without terms, or whose terms no document
has, has no rows. Each row of the items is an item of its own, each row of the documents
a document, also if ids repeat or are null (null ids come last among equal scores; what
else ties is told apart by nothing, so the rows are the same). An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from absentia.llm.texts import map_batches, slices
from absentia.sources.storage import settle

BLOCK_BYTES = 8 << 20
# Postings of a bucket at most; a longer document is a bucket of its own.
BUCKET_POSTINGS = 1 << 18
BUCKET_ROWS = 4096
# The shortest vector of a bucket has at least this share of the longest one's length.
BUCKET_SPREAD = 0.8
# Share of an item's squared length that its focus holds.
FOCUS = 0.6
# One in so many documents, the longest vectors, goes first.
FIRST = 32
MARGIN = 1 + 1e-9

_KEPT = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_VECTORS = "doc_id long, n long, terms array<int>, counts array<long>"
_FOUND = "item int, doc_id long, score long"


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_KEPT).split()


def impacts(counts: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m), m = 10 + (90 n N) div L, in whole numbers."""
    if 90 * int(n.max(initial=0)) * documents < 1 << 62:
        m = 10 + 90 * n * documents // length
    else:
        m = np.array([10 + 90 * int(x) * documents // length for x in n], np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Bucket:
    """Documents of similar vector length: postings by term."""

    def __init__(
        self, ids: np.ndarray, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, squares: np.ndarray
    ):
        order = np.argsort(terms, kind="stable")
        self.ids, self.squares = ids, squares
        self.rows, self.values = rows[order], values[order]
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self.longest = math.sqrt(squares.max(initial=0.0))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.terms, term)
        if at == len(self.terms) or self.terms[at] != term:
            return self.rows[:0], self.values[:0]
        span = slice(self.starts[at], self.starts[at + 1])
        return self.rows[span], self.values[span]

    def scores(self, item: Item, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that reach `least` (more than 0), and their exact scores."""
        found = np.arange(0)
        if not len(self.ids) or self.longest * item.length * MARGIN < least:
            return found, found
        focus, rest = item.terms[: item.focus], item.terms[item.focus :]
        partial, seen = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        possible = np.ones(len(self.ids), bool)
        floors = item.floors(least / (self.longest * item.length * MARGIN))
        for k, term in enumerate(focus):
            rows, values = self.postings(term)
            # rows of a term are distinct: a document has one posting for it
            partial[rows] += item.weights[k] * values
            seen[rows] += values.astype(float) ** 2
            if floors[k] > 0:
                reach = np.zeros(len(self.ids), bool)
                reach[rows[values * MARGIN >= floors[k] * np.sqrt(self.squares[rows])]] = True
                possible &= reach
        open_length = np.sqrt(np.maximum(self.squares - seen, 0) + 1e-9 * self.squares)
        possible &= (partial + item.rest * open_length) * MARGIN >= least
        if not possible.any():
            return found, found
        exact = np.zeros(len(self.ids), np.int64)
        for k, term in enumerate((*focus, *rest)):
            rows, values = self.postings(term)
            kept = possible[rows]
            exact[rows[kept]] += int(item.weights[k]) * values[kept]
        found = np.flatnonzero(possible & (exact >= max(least, 1)))
        return found, exact[found]


class Item:
    """Terms with weights, heaviest first; `focus` of them make up the focus."""

    def __init__(self, number: int, weighted: Iterable[tuple[int, int]]):
        self.number = number
        ordered = sorted((p for p in weighted if p[1] > 0), key=lambda p: (-p[1], p[0]))
        self.terms = [t for t, _ in ordered]
        self.weights = np.array([w for _, w in ordered], np.int64)
        squares = np.cumsum(self.weights.astype(float) ** 2)
        total = float(squares[-1]) if ordered else 0.0
        self.length = math.sqrt(total)
        self.focus = int(np.searchsorted(squares, FOCUS * total) + 1) if ordered else 0
        self.rest = math.sqrt(float((self.weights[self.focus :].astype(float) ** 2).sum()))

    def floors(self, cosine: float) -> np.ndarray:
        """The least each focus coordinate of a unit vector may be, if its cosine with
        the item is to reach the given one: q t - sqrt((1 - t^2) (1 - q^2))."""
        q = self.weights[: self.focus] / self.length
        t = min(cosine, 1.0)
        return q * t - np.sqrt((1 - t * t) * (1 - q * q)) - 1e-9


def _ranked(scores: np.ndarray, ids: np.ndarray, absent: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, absent, -scores))[:k]


def _buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Bucket, np.ndarray]]:
    """Buckets of a sorted stream of vectors (longest first), and where ids are null."""

    def made(parts: list[tuple]) -> tuple[Bucket, np.ndarray]:
        ids, absent, sizes, terms_, values, squares = (np.concatenate(x) for x in zip(*parts))
        rows = np.repeat(np.arange(len(ids)), sizes)
        return Bucket(ids, rows, terms_, values, squares), absent

    parts, postings, held, longest = [], 0, 0, 0.0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("doc_id")
        absent = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        lists = batch.column("terms")
        sizes = lists.value_lengths().to_numpy()
        ends = np.append(0, np.cumsum(sizes))
        all_terms, all_values = lists.flatten().to_numpy(), batch.column("values").flatten().to_numpy()
        squares = batch.column("squares").to_numpy()
        start = 0
        while start < len(ids):
            if not parts:
                longest = squares[start]
            # Squares fall: all before `stop` are in reach of this bucket.
            stop = start + int(np.searchsorted(-squares[start:], -longest * BUCKET_SPREAD**2, "right"))
            stop = min(stop, start + BUCKET_ROWS - held)
            stop = min(stop, int(np.searchsorted(ends, ends[start] + BUCKET_POSTINGS - postings, "right")) - 1)
            if stop <= start and not parts:
                stop = start + 1
            if stop > start:
                span = slice(ends[start], ends[stop])
                parts.append((ids[start:stop], absent[start:stop], sizes[start:stop], all_terms[span],
                              all_values[span], squares[start:stop]))
                postings += ends[stop] - ends[start]
                held += stop - start
            if stop < len(ids) or postings >= BUCKET_POSTINGS or held >= BUCKET_ROWS:
                yield made(parts)
                parts, postings, held = [], 0, 0
            start = max(stop, start)
    if parts:
        yield made(parts)


def best_of(items: list[Item], least: dict[int, int], k: int) -> Callable:
    """For mapInArrow over vectors sorted by falling length: the best k a task has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {i.number: (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for i in items}
        bar = {i.number: max(1, least.get(i.number, 1)) for i in items}
        for bucket, absent in _buckets(batches):
            for item in items:
                rows, scores = bucket.scores(item, bar[item.number])
                if not len(rows):
                    continue
                had = best[item.number]
                scores = np.concatenate((had[0], scores))
                ids = np.concatenate((had[1], bucket.ids[rows]))
                gone = np.concatenate((had[2], absent[rows]))
                kept = _ranked(scores, ids, gone, k)
                best[item.number] = scores[kept], ids[kept], gone[kept]
                if len(kept) == k:
                    bar[item.number] = max(bar[item.number], int(scores[kept[-1]]))
        numbers = np.concatenate([np.full(len(s), i, np.int32) for i, (s, _, _) in best.items()] or [np.empty(0, np.int32)])
        if not len(numbers):
            return
        scores, ids, gone = (np.concatenate(x) for x in zip(*best.values()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers), pa.array(ids, mask=gone), pa.array(scores)], ["item", "doc_id", "score"]
        )

    return run


def _counted(vocabulary: dict[bytes, int]) -> Callable:
    """For mapInArrow over doc_id, text: number of terms, and counts of the known ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, "text"):
            n, found, counts, ends, kept = [], [], [], [0], []
            for i, text in enumerate(texts):
                words = terms(text)
                if not words:
                    continue
                of = Counter(words)
                known = of.keys() & vocabulary.keys()
                kept.append(i)
                n.append(len(words))
                found += [vocabulary[t] for t in known]
                counts += [of[t] for t in known]
                ends.append(len(found))
            if kept:
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(kept)),
                        pa.array(n, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                    ],
                    ["doc_id", "n", "terms", "counts"],
                )

    return run


def _weighted(weights: np.ndarray, documents: int, length: int) -> Callable:
    """For mapInArrow over counted documents: impact vectors and their squared lengths."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, counts = batch.column("terms"), batch.column("counts").flatten().to_numpy()
            sizes = lists.value_lengths().to_numpy()
            n = np.repeat(batch.column("n").to_numpy(), sizes)
            values = impacts(counts, n, documents, length) if length else counts
            values = np.where(weights[lists.flatten().to_numpy()] > 0, values, 0)
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            squares = np.bincount(rows, values.astype(float) ** 2, batch.num_rows)
            ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists, pa.ListArray.from_arrays(ends, pa.array(values, pa.int64())),
                 pa.array(squares, pa.float64())],
                ["doc_id", "terms", "values", "squares"],
            )

    return run


def _search_block(docs: DataFrame, block: list[tuple[int | None, bytes]], k: int) -> DataFrame:
    """item (a place in the block), doc_id, score of the best k documents of each item."""
    spark = docs.sparkSession
    of_items = [set(terms(text)) for _, text in block]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*of_items)))}
    counted = settle(map_batches(docs.select("doc_id", "text"), _counted(vocabulary), _VECTORS), "counted")
    documents, length = counted.agg(F.count("*"), F.sum("n")).first()
    # At most a row for each term of the block.
    frequencies = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(max(1, len(vocabulary)), np.int64)
    for term, df in frequencies:
        weights[term] = term_weight(documents, df)
    items = [
        Item(i, [(vocabulary[t], int(weights[vocabulary[t]])) for t in found])
        for i, found in enumerate(of_items)
    ]
    items = [i for i in items if i.terms]
    vectors = settle(
        map_batches(
            counted, _weighted(weights, documents, length or 0),
            "doc_id long, terms array<int>, values array<long>, squares double",
        ).where("squares > 0"),
        "vectors",
    )
    # A row's place in the table tells copies apart, also those of one id.
    place = F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    vectors = vectors.withColumn("spread", place)
    by_length = (F.desc("squares"), F.col("spread"))

    def best(rows: DataFrame, least: dict[int, int]) -> DataFrame:
        dealt = rows.repartitionByRange(*by_length).sortWithinPartitions(F.desc("squares"))
        found = map_batches(dealt, best_of(items, least, k), _FOUND)
        return _first(found, "item", k)

    # The length from which on one in FIRST vectors is: a number, by a sketch of bounded size.
    cut = vectors.agg(F.percentile_approx("squares", 1 - 1 / FIRST)).first()[0]
    if cut is None or not items:
        return spark.createDataFrame([], _FOUND)
    first = settle(best(vectors.where(F.col("squares") > cut), {}), "first")
    kept = first.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    least = {r["item"]: r["least"] for r in kept.where(F.col("n") >= k).collect()}
    others = best(vectors.where(F.col("squares") <= cut), least)
    return _first(first.unionByName(others), "item", k)


def _first(found: DataFrame, of: str, k: int) -> DataFrame:
    """The first k of each item; Spark keeps k a task before it shuffles."""
    order = Window.partitionBy(of).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.drop("rank")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents with a score for each item."""
    spark = docs.sparkSession
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    for b in range(blocks):
        rows = items.where(number == b).select("item_id", F.col("text").cast("binary").alias("text")).collect()
        block = [(r["item_id"], bytes(r["text"] or b"")) for r in rows]
        found = _search_block(docs, block, k)
        ids = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], "item int, item_id long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        # As many rows as the block has items: bounded with it.
        part = found.withColumn("rank", F.row_number().over(order)).join(F.broadcast(ids), "item")
        out = part if out is None else out.unionByName(part)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
