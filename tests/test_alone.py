"""The library without the text operators: it imports, and its queries run."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
{before}
import __spark_entry__ as entry
names = entry.queries()
assert len(names) > 100 and not any(n == "pipeline" or n.startswith("op") and n[2].isdigit() for n in names), names
assert set(entry.oracle_sql()) <= set(names)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert entry.entry(spark).count() > 0
assert names["first_rows"](spark, "/root/testdata/sf0.001").count() == 5000
print("done")
"""


@pytest.mark.parametrize("before", ["", "sys.modules['tokenizers'] = sys.modules['xxhash'] = sys.modules['public_tokenizers'] = None"])
def test_the_rest_does_without(tmp_path, before):
    root = ROOT
    if not before:
        left_out = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "*.json")
        root = tmp_path / "repo"
        shutil.copytree(ROOT, root, ignore=left_out)
        assert not (root / "absentia" / "llm").exists()
    script = SCRIPT.format(root=str(root), before=before)
    run = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=tmp_path, timeout=300)
    assert run.stdout.strip().endswith("done"), run.stderr[-2000:]
