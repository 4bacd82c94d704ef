"""SimHash near-duplicates: popcount embedding, range join in its grid, exact check.

Every distinct fingerprint is embedded as its bit counts per two-bit segment (32
coordinates of 0..2). One flipped bit moves one coordinate by one, so the
Manhattan distance of two embeddings never exceeds the bit distance. Coordinates
are kept in unary (each segment's bits sorted), so that distance is the popcount
of an exclusive or, in one 64-bit word.

Grid: the coordinates form `GROUPS` groups. Within Manhattan distance d at most d
groups differ, so two embeddings in range share the cell of at least one choice of
GROUPS - d groups; joining on every choice finds them all. Candidates pass the
Manhattan bound, then the exact bit distance.

A cell with many fingerprints is not joined with itself. Its members are linked
through the fingerprints within half the distance of them: two are within d bits
exactly if those neighbourhoods meet (radii d // 2 and d - d // 2). That emits a
fixed number of rows for each member, whatever the size of the cell, and leaves
the same components.

Edge cases: null text is empty; a text without words has fingerprint zero and is
linked like any other; fewer words than a shingle make one shingle of all. Rows
that share a doc_id are told apart by text. A null doc_id takes part and is never
the smallest. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from absentia.llm.components import components
from absentia.llm.texts import map_batches, slices, text_key, whole_row
from absentia.sources.storage import settle

GROUPS = 6
CROWDED = 64
SEED = 42
_BLOCK = 1 << 16
_ODD = 0x5555555555555555


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, _BLOCK):
        end = min(n, at + _BLOCK)
        if len(words) <= shingle:
            parts = [b" ".join(words)]
        else:
            parts = map(b" ".join, zip(*(words[at + k : end + k] for k in range(shingle))))
        hashes = np.frombuffer(b"".join([digest(p, SEED) for p in parts]), np.uint8)
        counts += np.unpackbits(hashes).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, key (of the text), fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for rows, texts in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(fps)], names=["doc_id", "key", "fp"]
            )

    source = docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), "text")
    return map_batches(source, run, "doc_id long, key long, fp long")


def _unary(fp: Column) -> Column:
    """Each two-bit segment's count in unary: the segment's bits, sorted."""
    high = F.shiftrightunsigned(fp, 1)
    either, both = fp.bitwiseOR(high), fp.bitwiseAND(high)
    odd = F.lit(_ODD)
    return either.bitwiseAND(odd).bitwiseOR(F.shiftleft(both.bitwiseAND(odd), 1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cell_masks(distance: int) -> list[int]:
    """A mask of kept coordinates for each choice of GROUPS - distance groups."""
    edges = [round(i * 32 / GROUPS) * 2 for i in range(GROUPS + 1)]
    groups = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [
        _signed(sum(groups[i] for i in kept))
        for kept in combinations(range(GROUPS), GROUPS - distance)
    ]


def _ball(fp: Column, radius: int) -> Column:
    """All words within `radius` (0 or 1) bits of fp."""
    if radius == 0:
        return F.array(fp)
    flips = [fp] + [fp.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]
    return F.array(*flips)


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within `distance` bits.

    `distinct` has one row for each fingerprint, in `fp`. Sparse cells give their
    pairs; crowded ones a chain through shared neighbours.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    probes = F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("u").bitwiseAND(F.lit(m)).alias("cell"))
        for i, m in enumerate(_cell_masks(distance))
    ])
    embedded = distinct.select("fp", _unary(F.col("fp")).alias("u"))
    cells = embedded.select("fp", "u", F.inline(probes).alias("choice", "cell"))
    sizes = cells.groupBy("choice", "cell").agg(F.count("*").alias("n")).where("n > 1")
    full = settle(cells.join(sizes, ["choice", "cell"]), "cells")
    sparse = full.where(F.col("n") <= CROWDED)
    left = sparse.select("choice", "cell", F.col("fp").alias("a"), F.col("u").alias("ua"))
    right = sparse.select("choice", "cell", F.col("fp").alias("b"), F.col("u").alias("ub"))
    pairs = (
        left.join(right, ["choice", "cell"])
        .where("a < b")
        .where(F.bit_count(F.col("ua").bitwiseXOR(F.col("ub"))) <= distance)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        .select("a", "b")
    )
    crowded = full.where(F.col("n") > CROWDED).select("fp").distinct()
    near, far = distance // 2, distance - distance // 2
    points = crowded.select("fp", F.explode(_ball(F.col("fp"), far)).alias("point"))
    if near < far:
        # One bit apart: a fingerprint in another's neighbourhood.
        own = crowded.select(F.col("fp").alias("b"), F.col("fp").alias("point"))
        chained = points.join(own, "point").where("fp <> b").select(F.col("fp").alias("a"), "b")
        return pairs.unionByName(chained).distinct()
    centres = points.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n"))
    chained = (
        points.join(centres.where("n > 1"), "point")
        .where("fp <> b")
        .select(F.col("b").alias("a"), F.col("fp").alias("b"))
    )
    return pairs.unionByName(chained).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, key, fp, component_id (the smallest doc_id reachable) and root (the smallest
    fingerprint of the component, which alone tells components apart) of every row."""
    prints = settle(fingerprints(docs, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = links(distinct, distance)
    label = components(edges)
    roots = distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = roots.join(named, "root").select("fp", "component_id", "root")
    return prints.join(of_print, "fp").select("doc_id", "key", "fp", "component_id", "root")


def keep_one_per_group(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """The document with the smallest doc_id of each group; all columns as they came.

    Of rows of a group that share this doc_id the one with the smallest text key stays,
    once; groups whose smallest doc_id is the same, or null, are groups all the same.
    """
    found = near_duplicates(docs, shingle, distance)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "key", "fp")
    kept = found.groupBy("root").agg(F.min(place).alias("k"))
    kept = settle(kept.select(F.col("k.doc_id").alias("_id"), F.col("k.key").alias("_key")), "kept")
    repeated = found.groupBy("doc_id", "key").count().where("count > 1")
    own = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), text_key().alias("key"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    stay = own.join(kept, same, "left_semi")
    if not repeated.isEmpty():
        stay = stay.dropDuplicates(["id", "key"])
    return stay.select("row.*")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
