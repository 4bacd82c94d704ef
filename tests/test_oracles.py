"""Every registered query beside its SQL, on the smallest scale."""

import pytest

import __spark_entry__ as entry
from workload.check import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_agrees_with_sql(spark, con, sf_dir, name):
    ok, note = compare(
        spark, con, sf_dir, name, entry.queries()[name], entry.oracle_sql().get(name)
    )
    assert ok, note
    assert "types" not in note, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_fixture_bands_are_the_counted_ones(spark, sf_dir):
    row = entry.queries()["band_counts"](spark, sf_dir).first()
    assert (row.below_deductible, row.in_cc_range, row.high_claimant) == (8, 178, 14)
    stats = entry.queries()["cleaning_stats_exact"](spark, sf_dir).first()
    assert (stats.original_rows, stats.after_rule1, stats.after_rule2) == (6000, 4996, 3463)
