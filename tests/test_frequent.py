"""Leading values by summary and recount, beside counting everything."""

import random
from collections import Counter

import pytest

from absentia.operators import frequent, profile


def brute(rows, n):
    counts = Counter(v for v in rows if v is not None)
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]


def spread(rng, kind, n):
    return {
        "few": lambda: [rng.choice(["a", "b", None, "c"]) for _ in range(n)],
        "skewed": lambda: [f"v{int(rng.paretovariate(0.9))}" for _ in range(n)],
        "tied": lambda: [f"v{i % 40:02d}" for i in range(n)],
        "different": lambda: [f"v{i:06d}" for i in range(n)],
        "tied near the cut": lambda: [f"v{i % 5000:05d}" for i in range(n - 500)] + ["hot"] * 500,
        "missing": lambda: [None] * n,
    }[kind]()


KINDS = ["few", "skewed", "tied", "different", "tied near the cut", "missing"]


@pytest.mark.parametrize("kind", KINDS)
def test_leading_values_are_exact(spark, kind):
    rows = spread(random.Random(1), kind, 20_000)
    df = spark.createDataFrame([(v,) for v in rows], "v string").repartition(5)
    assert [tuple(r) for r in profile.top_values(df, "v", 12).collect()] == brute(rows, 12)
    view = profile.column_value_view(df).orderBy("rank").collect()
    assert [r.value for r in view] == [v for v, _ in brute(rows, 12)]


def test_summaries_shuffle_a_bounded_number_of_rows(spark, monkeypatch):
    """Columns that the summary settles are never counted in full; others are."""
    full = []
    real = frequent._pairs
    monkeypatch.setattr(frequent, "_pairs", lambda df, cs: full.append(list(cs)) or real(df, cs))
    rng = random.Random(2)
    columns = {k: spread(rng, k, 20_000) for k in KINDS} | {
        "numbers": [float(i) for i in range(20_000)],
        "texts of numbers": [str(i) for i in range(20_000)],
        "few numbers": [float(i % 9) for i in range(20_000)],
    }
    kinds = ", ".join(f"`{c}` {'double' if isinstance(v[0], float) else 'string'}" for c, v in columns.items())
    df = spark.createDataFrame(list(zip(*columns.values())), kinds)
    profile.column_value_view(df)
    assert full == [list(columns), ["different", "tied near the cut"]]


def test_numbers_in_any_spelling(spark):
    texts = [f"{'0' * (i % 900)}{i % 3}" for i in range(9000)]  # thousands of spellings of three numbers
    zeros = [0.0 if i % 2 else -0.0 for i in range(9000)]
    rows = [(t, float(i % 13), float(i % 12), z, None) for i, (t, z) in enumerate(zip(texts, zeros))]
    df = spark.createDataFrame(rows, "t string, many double, few double, z double, none double")
    view = {}
    for r in profile.column_value_view(df).orderBy("rank").collect():
        assert r.value is None
        view.setdefault(r.column_name, []).append(r.number_value)
    assert view == {"t": [0.0, 1.0, 2.0], "many": [0.0, 12.0], "few": [float(i) for i in range(12)], "z": [0.0]}


def test_no_rows(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert profile.column_value_view(df).collect() == []
    assert profile.top_values(df, "a").collect() == []


def test_top_values_read_no_numbers(spark):
    """Texts are counted as they are, also where all of them are numbers."""
    rows = ["01"] * 3 + ["1"] * 2 + ["1.0"] + [str(i) for i in range(2, 3000)]
    df = spark.createDataFrame([(v, float(v)) for v in rows], "v string, x double")
    assert [tuple(r) for r in profile.top_values(df, "v", 2).collect()] == [("01", 3), ("1", 2)]
    assert [tuple(r) for r in profile.top_values(df, "x", 2).collect()] == [("1.0", 6), ("10.0", 1)]
    assert "regexp" not in frequent._pairs(df, ["v"], numbers=False)._jdf.queryExecution().toString()
