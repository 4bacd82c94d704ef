"""Benchmark items inside documents: size-partitioned MinHash containment search,
in DataFrame functions.

Words are runs of letters and digits of the lower-cased text; shingles are `SHINGLE`
words. An item of n distinct shingles is contained in a document that has at least
`threshold` of them, however long the document is. So items are partitioned by size
(powers of two), and each keeps the k least hashes of its shingles, its MinHash
sketch, with k = floor((1 - threshold) * largest size of the partition) + 1: a
document that contains the item misses fewer shingles than that and must have one
of the sketch. Documents that have none are done; for the others the shingles
themselves are compared. Nothing contained is missed and nothing else is reported.

Items of fewer words than a shingle are one shingle of all their words; documents
are then cut into shingles of that length too. They are reported like any other, but a
document goes for one (`clean`) only if it has no other words: a word or two in a longer
text is no leak. Items whose words agree are one item,
the one with the least item_id.

Sizes. The sketches are broadcast if the benchmark has at most `BROADCAST_BYTES` of
text, else joined by shuffle. Shingles of documents are made, looked up and dropped
in the task that reads them; only hits are shuffled, a row for each document and item.
Up to `BROADCAST_KEYS` documents with hits (counted) are broadcast by id and text key, so
that no other text leaves its place; beyond that texts meet them by shuffle.

Edge cases: null and wordless texts contain nothing and, as items, are found
nowhere. Rows that share a doc_id are judged one by one; the best containment of an id is
reported. A null doc_id is reported like any other. Empty tables give no rows. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from absentia.functions.lateral import with_computed
from absentia.llm.texts import text_bytes, text_key, whole_row
from absentia.sources.storage import settle

SHINGLE = 5
THRESHOLD = 0.8
BROADCAST_BYTES = 8 << 20
BROADCAST_KEYS = 200_000  # of two numbers each


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(w: Column, length: int) -> Column:
    """All runs of `length` words, as text."""
    at = F.sequence(F.lit(1), F.size(w) - length + 1)
    found = F.transform(at, lambda i: F.array_join(F.slice(w, i, length), " "))
    return F.when(F.size(w) >= length, found).otherwise(F.array().cast("array<string>"))


def _hashes(w: Column, length: int) -> Column:
    """Hashes of all runs of `length` words; `w` must be a column, not an expression,
    as it is looked up for each run."""
    at = F.sequence(F.lit(0), F.size(w) - length)
    found = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(length)]))
    return F.when(F.size(w) >= length, found).otherwise(F.array().cast("array<bigint>"))


def _split(rows: DataFrame, *columns: Column) -> DataFrame:
    """The columns, and `w`, the words, made once for each row."""
    return with_computed(rows.select(*columns, "text"), {"w": words(F.col("text"))}).drop("text")


def items_of(benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item (digest of its words), item_id, length (of its shingles), shingles (distinct),
    n, sketch."""
    split = _split(benchmark, F.col("item_id").cast("long"))
    split = split.where(F.size("w") > 0).groupBy("w").agg(F.min("item_id").alias("item_id"))
    length = F.least(F.size("w"), F.lit(SHINGLE))
    cases = [
        (F.col("length") == n, F.array_distinct(_shingles(F.col("w"), n)),
         F.array_distinct(_hashes(F.col("w"), n)))
        for n in range(1, SHINGLE + 1)
    ]
    shingles = F.coalesce(*[F.when(c, s) for c, s, _ in cases])
    hashes = F.coalesce(*[F.when(c, h) for c, _, h in cases])
    own = split.withColumn("length", length).select(
        F.md5(F.array_join("w", " ")).alias("item"), "item_id", "length", shingles.alias("shingles"), hashes.alias("hashes")
    )
    n = F.size("hashes")
    largest = F.pow(F.lit(2), F.floor(F.log2(n)) + 1) - 1
    # A little is added, so that no rounding makes a sketch too small.
    k = F.floor(largest * (1 - threshold) + 1e-9).cast("int") + 1
    return own.select(
        "item", "item_id", "length", "shingles", F.size("shingles").alias("n"),
        F.slice(F.sort_array("hashes"), F.lit(1), F.least(k, n)).alias("sketch"),
    )


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key (of the text), item_id, n_found, n_shingles, containment, for every
    document and item with containment of at least `threshold`."""
    return _found(docs, benchmark, threshold).drop("telling").distinct()


def _found(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """The same, and whether the item is long enough, or all of the document, to tell."""
    items = settle(items_of(benchmark, threshold), "items")
    small = text_bytes(benchmark) <= BROADCAST_BYTES
    hint = F.broadcast if small else lambda t: t
    sketches = hint(items.select("item", "length", F.explode("sketch").alias("hash")))
    # At most SHINGLE lengths.
    lengths = sorted(r.length for r in items.select("length").distinct().collect())
    split = _split(docs, F.col("doc_id").cast("long"), text_key().alias("key"))
    candidates = None
    for n in lengths:
        own = split.select("doc_id", "key", F.explode(_hashes(F.col("w"), n)).alias("hash"))
        hits = own.join(sketches.where(F.col("length") == n).drop("length"), "hash")
        hits = hits.select("doc_id", "key", "item").distinct()
        candidates = hits if candidates is None else candidates.unionByName(hits)
    if candidates is None:
        return split.where(F.lit(False)).select(
            "doc_id", "key", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("n_found"),
            F.lit(0).alias("n_shingles"), F.lit(0.0).alias("containment"),
            F.lit(True).alias("telling"),
        )
    candidates = settle(candidates, "candidates").select(
        F.col("doc_id").alias("cid"), F.col("key").alias("ckey"), "item"
    )
    pairs = candidates.join(hint(items.drop("sketch")), "item")
    keyed = docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("cid")) & (F.col("key") == F.col("ckey"))
    # Few candidates: other texts are left out before anything is shuffled.
    own = settle(candidates.select("cid", "ckey").distinct(), "candidate-keys")
    if own.count() <= BROADCAST_KEYS:
        keyed = keyed.join(F.broadcast(own), same, "left_semi")
    both = with_computed(keyed.join(pairs, same), {"w": words(F.col("text"))})
    found = None
    for n in lengths:
        shared = F.size(F.array_intersect(F.col("shingles"), _shingles(F.col("w"), n)))
        found = F.when(F.col("length") == n, shared) if found is None else (
            found.when(F.col("length") == n, shared)
        )
    telling = (F.col("length") >= SHINGLE) | (F.size("w") == F.col("length"))
    checked = both.select(
        "doc_id", "key", "item_id", found.alias("n_found"), F.col("n").alias("n_shingles"), telling.alias("telling")
    )
    checked = checked.withColumn("containment", F.col("n_found") / F.col("n_shingles"))
    return checked.where(F.col("containment") >= threshold).select(
        "doc_id", "key", "item_id", "n_found", "n_shingles", "containment", "telling")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item of `SHINGLE` words or more and are no shorter
    one; all columns as they came."""
    hit = settle(
        _found(docs, benchmark, threshold).where("telling")
        .select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "hits"
    )
    own = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), text_key().alias("key"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    # Few hits: rows stay where they are.
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_KEYS else hit
    return own.join(hit, same, "left_anti").select("row.*")
