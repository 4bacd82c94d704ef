"""Histories and exports that are whole or absent."""

import pytest
from pyspark.sql import functions as F

from absentia.sources import csv_files, runs, storage
from absentia.sources.csv_files import export_csv, export_manifest, read_export, scan_csv
from absentia.sources.runs import append_failed_run, append_run, compact_runs, read_runs, run_row


def _row(spark, run_id="a/b%1", status="success", rows_raw=1):
    return run_row(spark, status, run_id=run_id, rows_raw=rows_raw)


def _history(spark, folder):
    return sorted((r.run_id or "", r.status, r.rows_raw) for r in read_runs(spark, folder).collect())


def test_a_run_is_added_once(spark, tmp_path):
    folder = str(tmp_path / "runs")
    assert append_run(_row(spark), folder)
    assert not append_run(_row(spark, rows_raw=2), folder)
    assert append_run(_row(spark, "other", rows_raw=3), folder)
    assert append_run(_row(spark, None), folder) and append_run(_row(spark, None), folder)
    append_failed_run(spark, folder, "clean", ValueError("x"), run_id="a/b%1")
    assert _history(spark, folder) == [
        ("", "success", 1), ("", "success", 1), ("a/b%1", "error", None), ("a/b%1", "success", 1), ("other", "success", 3)]


def test_an_attempt_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "runs")
    append_run(_row(spark, "first"), folder)

    def die(*_):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(runs, "publish", die)
        with pytest.raises(RuntimeError):
            append_run(_row(spark, "second"), folder)
    assert _history(spark, folder) == [("first", "success", 1)]
    assert append_run(_row(spark, "second"), folder)
    assert [h[0] for h in _history(spark, folder)] == ["first", "second"]


def test_of_two_attempts_one_is_published(spark, tmp_path, monkeypatch):
    """Both looked before either was there."""
    folder = str(tmp_path / "runs")
    monkeypatch.setattr(runs, "_has_run", lambda *_: False)
    assert append_run(_row(spark), folder) and not append_run(_row(spark, rows_raw=2), folder)
    assert _history(spark, folder) == [("a/b%1", "success", 1)]
    assert storage.folders_in(spark, f"{folder}/_staging") == []


def test_compaction_keeps_rows_and_runs(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "runs")
    compact_runs(spark, folder)
    for i in range(5):
        append_run(_row(spark, f"r{i}%", rows_raw=i), folder)
    before = _history(spark, folder)
    with monkeypatch.context() as m:  # stopped before the old folders went
        m.setattr(runs, "remove", lambda *_: None)
        compact_runs(spark, folder)
    assert _history(spark, folder) == before
    compact_runs(spark, folder)
    assert _history(spark, folder) == before and len(storage.folders_in(spark, folder)) == 1
    assert not append_run(_row(spark, "r3%", rows_raw=9), folder)
    assert append_run(_row(spark, "r9"), folder) and len(_history(spark, folder)) == 6


def test_export_keeps_the_order_of_the_source(spark, tmp_path):
    source = tmp_path / "a.csv"
    cells = [f'{i * 7919 % 1000},"say ""x"", {i}\nnext line"' for i in range(1000)]
    source.write_text("n,t\n" + "\n".join(cells) + "\n")
    df = scan_csv(spark, str(source), multi_line=True, with_row_order=True)
    folder = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # else one part
    try:
        export_csv(df, folder, shown={"n": "N (n)"})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    manifest = export_manifest(spark, folder).collect()
    assert len(manifest) > 1 and sum(r.n_rows for r in manifest) == 1000
    back = read_export(spark, folder).orderBy("_row_order").collect()
    assert [(r["N (n)"], r.t) for r in back] == [tuple(r) for r in df.orderBy("_row_order").select("n", "t").collect()]
    # The parts one after the other, as a program without Spark would read them.
    import csv

    lines = []
    for r in manifest:
        with open(f"{folder}/{r.part}", newline="") as part:
            lines += list(csv.reader(part))[1:]
    assert [x[0] for x in lines] == [str(i * 7919 % 1000) for i in range(1000)]
    with pytest.raises(ValueError, match="exists"):
        export_csv(df, folder)


def test_a_killed_export_leaves_no_folder(spark, tmp_path):
    folder = str(tmp_path / "out")
    bad = spark.range(100).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("killed"))).alias("x"))
    with pytest.raises(Exception, match="killed"):
        export_csv(bad, folder, ["id"])
    assert not storage.exists(spark, folder) and storage.folders_in(spark, str(tmp_path)) == []
    export_csv(bad.drop("x"), folder, ["id"])
    assert csv_files.read_export(spark, folder).count() == 100


def test_export_query_can_be_written(spark, sf_dir, tmp_path):
    """Its columns "line" and "Line" stay apart; the caller's session is left as it is."""
    import pyarrow.dataset as ds

    import __spark_entry__ as entry

    numbered = entry.queries()["export_csv"](spark, sf_dir)
    numbered.write.parquet(str(tmp_path / "written"))
    written = ds.dataset(str(tmp_path / "written")).to_table()
    assert written.column_names == ["line", "Order", "Line", "Date", "Emp ID"]
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert sorted(written.column(0).to_pylist()) == list(range(1, n + 1))
    assert spark.conf.get("spark.sql.caseSensitive") == "false"
