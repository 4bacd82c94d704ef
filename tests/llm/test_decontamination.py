import re

import pytest
from pyspark.sql import functions as F

from absentia.llm import decontamination as d
from absentia.llm.queries import ORACLES, QUERIES
from workload.check import compare, duck


def brute(docs, items, threshold=0.8):
    def words(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    least = {}
    for item_id, text in items:
        if w := tuple(words(text)):
            least[w] = min(item_id, least.get(w, item_id))
    found = set()
    for doc_id, text in docs:
        w = words(text)
        for item, item_id in least.items():
            n = min(len(item), 5)
            own = {item[i : i + n] for i in range(len(item) - n + 1)}
            theirs = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
            if len(own & theirs) / len(own) >= threshold:
                found.add((doc_id, item_id, len(own & theirs), len(own)))
    return found


def test_query_agrees_with_sql(spark, sf_dir):
    name = "op7_decontamination"
    ok, note = compare(spark, duck(sf_dir), sf_dir, name, QUERIES[name], ORACLES[name])
    assert ok and "types" not in note, note


LETTERS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
ITEM = " ".join(LETTERS)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, ITEM), (2, ITEM.upper() + "!"), (3, None), (4, ""), (5, "?!"), (6, "two words"),
            (7, "lazy"), (None, "the quick brown fox jumps"), (8, "x " * 40), (9, ITEM + " pi rho")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumns(
        {c: F.lit(0) for c in ("w", "length", "n", "hash")})


@pytest.mark.parametrize("limit, keys", [(0, 0), (8 << 20, 200_000), (8 << 20, 0)])
def test_agrees_with_brute_force(spark, docs, benchmark, monkeypatch, limit, keys):
    """Broadcast and shuffled sketches and keys; items of all sizes; near misses."""
    monkeypatch.setattr(d, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(d, "BROADCAST_KEYS", keys)
    more = spark.createDataFrame([
        (100, f"long text {'filler ' * 3000}{ITEM} and on"), (101, " ".join(LETTERS[:12])),
        (102, " ".join(LETTERS[:13])), (103, " ".join(LETTERS[:7] + ["no"] + LETTERS[7:])),
        (104, "Alpha, BETA -- gamma; delta (epsilon) zeta\neta theta iota kappa lambda mu nu xi omicron"),
        (105, "x x x x x x"), (105, "x x x x x x"), (106, "the quick brown fox jumps"),
    ], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    got = {tuple(r) for r in d.contained(every, benchmark).select(
        "doc_id", "item_id", "n_found", "n_shingles").collect()}
    want = brute([tuple(r) for r in every.collect()],
                 [(r.item_id if r.item_id is not None else None, r.text) for r in benchmark.collect()
                  if r.item_id is not None])
    assert {g for g in got if g[1] is not None} == want
    # An item without an id is found, too.
    assert {(i, None, 1, 1) for i in (106, 1, 5)} <= got


def test_sketches_miss_nothing(benchmark):
    for r in d.items_of(benchmark).collect():
        allowed = r.n - next(k for k in range(r.n + 1) if k / r.n >= 0.8)
        assert len(r.sketch) >= min(allowed + 1, r.n)


@pytest.mark.parametrize("keys", [0, 200_000])
def test_documents_that_contain_an_item_go(spark, docs, no_docs, benchmark, monkeypatch, keys):
    monkeypatch.setattr(d, "BROADCAST_KEYS", keys)
    kept = d.clean(docs, benchmark)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted((i is None, i or 0) for i in ids) == [
        (False, i) for i in (2, 3, 4, 5, 7, 8, 9)] + [(True, 0)]
    assert d.clean(no_docs, benchmark).count() == 0
    assert d.clean(docs, benchmark.where("false")).count() == docs.count()
    assert d.contained(docs, benchmark.where("false")).count() == 0
    assert d.contained(no_docs, benchmark).count() == 0


def test_short_items_do_not_take_longer_documents(spark):
    rows = [(1, "yes, it is so"), (2, "Yes!"), (3, "a b c d is not all"), (4, "one two three four five and on")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "a b c d"), (3, "one two three four five")], "item_id long, text string")
    assert sorted(r.doc_id for r in d.clean(docs, items).collect()) == [1, 3]
    assert sorted((r.doc_id, r.item_id) for r in d.contained(docs, items).collect()) == [(1, 1), (2, 1), (3, 2), (4, 3)]
