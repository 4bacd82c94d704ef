import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from absentia.llm import simhash
from absentia.llm.components import components
from absentia.llm.queries import QUERIES


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(prints, distance=2):
    """Root (an index) of each fingerprint."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def test_query_agrees_with_brute_force(spark, sf_dir, documents):
    rows = documents.orderBy("doc_id").collect()
    prints = [brute_print(r.text) for r in rows]
    roots = brute_components(prints)
    want = {(r.doc_id, f"{p:016x}", rows[k].doc_id) for r, p, k in zip(rows, prints, roots)}
    got = QUERIES["op2_simhash"](spark, sf_dir)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got.collect()} == want


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("crowded", [1, 64])
def test_links_find_every_component(spark, monkeypatch, distance, crowded):
    """Chains, balls around a centre and strangers, in sparse and crowded cells."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(distance)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        p = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(12):
            prints.add(p)
            for b in rng.integers(0, 64, int(rng.integers(1, 4))):
                p ^= 1 << int(b)
    prints = sorted(prints)
    roots = brute_components(prints, distance)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = {r.node: r.root for r in components(simhash.links(frame, distance)).collect()}
    groups = {}
    for p, r in zip(prints, roots):
        groups.setdefault(r, set()).add(signed(p))
    for group in groups.values():
        assert {found.get(p, p) for p in group} == {min(group)}


def test_popcounts_bound_the_distance(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-(1 << 63), 1 << 63, (200, 2))]
    u = spark.createDataFrame(pairs, "a long, b long").select(
        "a", "b", simhash._unary(F.col("a")).alias("ua"), simhash._unary(F.col("b")).alias("ub")
    )
    for r in u.collect():
        def counts(x):
            return [(x >> 2 * i & 3).bit_count() for i in range(32)]
        manhattan = sum(abs(p - q) for p, q in zip(counts(r.a), counts(r.b)))
        assert ((r.ua ^ r.ub) & (2**64 - 1)).bit_count() == manhattan
        assert manhattan <= ((r.a ^ r.b) & (2**64 - 1)).bit_count()


def test_odd_rows(docs, no_docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id != 5}
    assert {r.component_id for r in rows if r.fp == 0} == {2}
    assert by_id[3].fp == 0 and by_id[4].fp == 0
    assert sorted(r.component_id for r in rows if r.doc_id == 5) == [1, 1, 5]
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each_group_stays(docs, no_docs, spark):
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    # 2 stands for the empty ones, 1 for its copies; the other text of id 5 has no copy.
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 6, 7, 8, 9]
    assert simhash.keep_one_per_group(no_docs).count() == 0
    twice = spark.createDataFrame([(1, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    assert simhash.keep_one_per_group(twice).count() == 1


def test_groups_with_one_doc_id_or_none_stay_apart(spark):
    a, b, near = ("alpha beta gamma delta " * 5 + "a", "one two three four five six " * 5 + "b",
                  " ".join(f"word{i}" for i in range(400)))
    rows = [(7, a), (9, a), (7, b), (10, b), (None, near), (None, near + " "), (None, near + "\n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one_per_group(frame).collect()
    assert sorted(r.text for r in kept if r.doc_id == 7) == sorted([a, b])
    assert sorted((r.doc_id or 0) for r in kept) == [0, 7, 7]
    # Near copies whose fingerprints differ are one group, too.
    c = " ".join(f"word{i}" for i in range(399)) + " other"
    prints = {simhash.fingerprint(t.encode()) for t in (near, c)}
    assert len(prints) == 2 and (prints.pop() ^ prints.pop()).bit_count() <= 2
    frame = spark.createDataFrame([(None, near), (None, c)], "doc_id long, text string")
    assert simhash.keep_one_per_group(frame).count() == 1
