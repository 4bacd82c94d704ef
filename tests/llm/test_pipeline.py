"""Every stage beside a brute-force version, on its own input."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from absentia.llm import mixing
from absentia.llm.queries import END_ID, TOKENIZER
from absentia.sources.storage import settle
from tests.llm.test_decontamination import brute as brute_contained
from tests.llm.test_simhash import brute_components, brute_print


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """The input of each stage, and the last result."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in p.STAGES:
        out.append(docs)
        docs = settle(stage(spark, docs, sf_dir), name)
    return [*out, docs]


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_columns_stay(steps):
    assert len(p.STAGES) == 5
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_clean_documents_pass_the_toxicity_stage(spark, sf_dir, steps):
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.toxic}
    known = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = set(ids(steps[0])) - set(ids(steps[1]))
    assert not (gone & known) - toxic


def test_one_document_of_each_group(steps):
    rows = steps[1].orderBy("doc_id").collect()
    roots = brute_components([brute_print(r.text) for r in rows])
    assert ids(steps[2]) == sorted({rows[k].doc_id for k in roots})


def test_no_benchmark_item_is_left(spark, sf_dir, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = brute_contained([(r.doc_id, r.text) for r in steps[2].collect()], items)
    assert found
    assert ids(steps[3]) == sorted(set(ids(steps[2])) - {f[0] for f in found})


def test_files_hold_the_mixed_order(steps):
    assert ids(steps[4]) == ids(steps[3])
    want = [r.row.doc_id for r in mixing.schedule(steps[3]).orderBy("slot", "place").collect()]
    written = steps[4].select("doc_id", "_metadata.file_name", "_metadata.row_index")
    assert [r.doc_id for r in written.orderBy("file_name", "row_index").collect()] == want


def test_tokens_follow_that_order(steps):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = steps[4].select("doc_id", "text", "_metadata.file_name", "_metadata.row_index").orderBy(
        "file_name", "row_index").collect()
    start, want = 0, []
    for r in rows:
        found = tokenizer.encode(r.text, add_special_tokens=False).ids + [END_ID]
        want.append((r.doc_id, start, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        start += len(found)
    assert [tuple(r) for r in steps[5].orderBy("start").collect()] == want


def test_run_is_the_stages(spark, sf_dir, steps):
    got = sorted(tuple(r) for r in p.run(spark, sf_dir).collect())
    assert got == sorted(tuple(r) for r in steps[5].collect())


def test_odd_rows_pass_every_stage(spark, sf_dir, docs, no_docs):
    for frame in (docs, no_docs):
        for name, stage in p.STAGES:
            frame = settle(stage(spark, frame, sf_dir), name)
    assert frame.count() == 0
