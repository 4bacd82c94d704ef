import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from absentia.llm import lexical
from absentia.llm.queries import ORACLES, QUERIES

ITEMS = [
    (1, "The quick brown FOX"),
    (2, None),
    (3, "... --- ..."),
    (4, "日本語 çödé Ünï"),
    (None, "lazy lazy dog"),
    (5, "termsthatnodocumenthas"),
    (6, "word1 word2 word3 and1 and2 here two"),
    (6, "another text of the same id"),
]
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Rows by the contract's words, every document scored for every item."""
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    total, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) for t in set(words(text))}
        scored = []
        for doc, c, n in counted:
            m = 10 + 90 * n * total // length
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weights.items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc, score))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, doc, score) for r, (_, _, doc, score) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def rows_of(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def items(spark):
    df = spark.createDataFrame(ITEMS, "item_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("item", "score", "rank", "doc_id")})


@pytest.mark.parametrize("k", [1, 3, 10])
def test_odd_rows_against_brute_force(docs, items, k):
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(lexical.search(docs, items, k)) == brute(plain, ITEMS, k)


def test_blocks_of_items_change_nothing(docs, items, monkeypatch):
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 60)
    assert rows_of(lexical.search(docs, items)) == brute(plain, ITEMS)


def test_whole_table_against_brute_force(spark, sf_dir, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert rows_of(QUERIES["op12_lexical"](spark, sf_dir)) == brute(docs, items)
    assert "op12_lexical" in ORACLES


def test_empty_tables(spark, docs, no_docs, items):
    assert lexical.search(no_docs, items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []


def test_many_copies_of_one_text(spark, items):
    """Equal lengths are spread over tasks; ties go by id."""
    docs = [(i, "the quick dog" if i % 3 else f"the lazy fox {i}") for i in range(3000)]
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert rows_of(found) == brute(docs, ITEMS)


def _bucket(rng, rows, terms):
    ids, at, of, values = np.arange(rows), [], [], []
    for r in range(rows):
        for t in rng.sample(range(terms), rng.randint(1, 6)):
            at.append(r), of.append(t), values.append(rng.randint(1, 1000))
    at, of, values = (np.array(x, np.int64) for x in (at, of, values))
    squares = np.bincount(at, values.astype(float) ** 2, rows)
    return lexical.Bucket(ids, at, of, values, squares), (at, of, values)


def test_bounds_lose_nothing():
    """Any threshold: the survivors are exactly the documents that reach it."""
    rng = random.Random(1)
    pruned = 0
    for _ in range(200):
        bucket, (at, of, values) = _bucket(rng, 30, 12)
        item = lexical.Item(0, [(t, rng.randint(0, 900)) for t in rng.sample(range(14), 5)])
        weights = dict(zip(item.terms, item.weights))
        exact = np.bincount(at, [weights.get(t, 0) * v for t, v in zip(of, values)], 30).astype(int)
        out_of_reach = int(bucket.longest * item.length) + 1
        for least in {1, int(exact.max()), int(np.median(exact)) or 1, int(exact.max()) + 1, out_of_reach}:
            rows, scores = bucket.scores(item, least)
            want = np.flatnonzero(exact >= max(least, 1))
            assert rows.tolist() == want.tolist() and scores.tolist() == exact[want].tolist()
            pruned += bucket.longest * item.length < least
    assert pruned


def test_long_buckets_are_left_out(spark):
    """Cauchy-Schwarz: no posting of a bucket out of reach is looked at."""
    rng = random.Random(2)
    bucket, _ = _bucket(rng, 30, 12)
    item = lexical.Item(0, [(1, 5), (2, 9)])
    bucket.postings = None
    assert len(bucket.scores(item, int(bucket.longest * item.length) + 1)[0]) == 0


def test_impacts_beyond_64_bits_of_products():
    n = np.array([10**9, 3], np.int64)
    got = lexical.impacts(np.array([2, 1], np.int64), n, 10**10, 10**12)
    want = [10**9 * c // (1000 * c + 8 * (10 + 90 * int(x) * 10**10 // 10**12)) for c, x in zip((2, 1), n)]
    assert got.tolist() == want
