import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from absentia.llm import whitening
from absentia.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, most=32):
    """vec_id, whole numbers and whitened values (signs of the largest entry positive)."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept], np.int64)
    n = len(x)
    sums = x.sum(0)
    deviation = ((n * x - sums) ** 2).sum(1)
    y = x - sums / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return [i for i, _ in kept], deviation, (y @ vectors) / np.sqrt(values), values / np.trace(y.T @ y / n)


def check(found, rows, most=32):
    ids, deviation, z, explained = brute(rows, most)
    k = z.shape[1]
    got = found.collect()
    assert len(got) == len(ids) * k
    n = len(ids)
    table = {}
    for r in got:
        assert r.n == n and abs(r.explained / explained[r.component - 1] - 1) < 1e-6
        assert r.identity_error < 1e-6
        table.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    signs = {}
    for i, dev, want in zip(ids, deviation, z):
        of = table[i, int(dev)]
        for c in range(1, k + 1):
            close = [v for v in of[c] if abs(abs(v) - abs(want[c - 1])) < 1e-6]
            assert close
            if abs(want[c - 1]) > 1e-3:
                signs.setdefault(c, set()).update(v * want[c - 1] > 0 for v in close)
    assert len(signs) == k
    return signs


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    signs = check(QUERIES["op13_whitening"](spark, sf_dir), rows)
    assert all(len(s) == 1 for s in signs.values())  # one sign a component for all rows


@pytest.fixture
def odd(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=4)]) for i in range(40)]
    good += [(7, good[7][1]), (None, good[3][1]), (None, [50.0, -50.0, 3.5, 0.0])]
    nan, inf = float("nan"), float("inf")
    bad = [
        (100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, nan, 2.0, 3.0]),
        (104, [1.0, inf, 2.0, 3.0]), (105, [1.0, -inf, 2.0, 3.0]), (106, [1.0, 2.0]),
        (107, [3e38, 2.0, 1.0, 1.0]),
    ]
    rows = [(i, v, 1) for i, v in good + bad]
    names = ("x", "at", "n", "component", "index", "vector", "_file")
    return good, spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in names})


def test_odd_rows_against_brute_force(odd):
    good, df = odd
    check(whitening.whiten(df), good)
    assert {r.component for r in whitening.whiten(df, most=2).collect()} == {1, 2}


def test_many_small_blocks_and_splits(odd, monkeypatch):
    good, df = odd
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 3 * 8 * 4)
    monkeypatch.setattr(whitening, "SPLIT_BLOCKS", 2)
    check(whitening.whiten(df.repartition(5)), good)


def test_numbers_have_no_gaps(spark):
    rows = spark.range(1000).repartition(7).where("id % 3 > 0")
    at = [r["at"] for r in whitening.numbered(rows, "at").collect()]
    assert sorted(at) == list(range(len(at)))


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, None)], [(1, [])]])
def test_nothing_varies(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    found = whitening.whiten(df)
    assert found.collect() == []
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_flat_dimensions_are_left_out(spark):
    rows = [(i, [float(i % 5), 2.0, float(i % 7)], 0) for i in range(70)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in found} == {1, 2}


def test_deviations_beyond_64_bits(spark):
    rows = [(i, [float(i) * 1e13, 1.0], 0) for i in range(5)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: r.deviation for r in found}[2] is not None and {r.vec_id: r.deviation for r in found}[0] is None
