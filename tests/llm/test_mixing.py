import hashlib
import random

import pytest
from pyspark.sql import functions as F

from absentia.llm import mixing
from absentia.llm.queries import ORACLES, QUERIES
from workload.check import compare, duck


def test_query_agrees_with_sql(spark, sf_dir):
    name = "op9_mixing"
    ok, note = compare(spark, duck(sf_dir), sf_dir, name, QUERIES[name], ORACLES[name])
    assert ok and "types" not in note, note


def brute_edf(jobs):
    """Slot by slot; jobs: (src, b, released, due)."""
    waiting, out, t = sorted(jobs, key=lambda j: (j[3], j[2], j[0], j[1])), {}, 0
    while waiting:
        ready = next((j for j in waiting if j[2] <= t), None)
        if ready:
            waiting.remove(ready)
            out[ready[:2]] = t
        t += 1
    return out


def placed(spark, jobs):
    rows = mixing.earliest_deadline_first(
        spark.createDataFrame(jobs, "src string, b long, released long, due long")).collect()
    assert len(rows) == len(jobs)
    return {(r.src, r.b): r.slot for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_any_jobs_agree_with_brute_force(spark, monkeypatch, seed):
    # Small, so that every step has several buckets and halvings; deadlines may be missed.
    monkeypatch.setattr(mixing, "BUCKET", 16)
    monkeypatch.setattr(mixing, "LEAF", 4)
    rng = random.Random(seed)
    last = rng.choice([30, 90, 400])
    jobs = []
    for i in range(rng.choice([1, 7, 130])):
        released = rng.randrange(last)
        jobs.append((rng.choice("abc"), i, released, released + rng.randrange(1, 40)))
    jobs += [("z", i, 5, 60) for i in range(20)]
    assert placed(spark, jobs) == brute_edf(jobs)


def pfair_jobs(weights, blocks):
    total = sum(weights.values())
    return [(s, b, b * total // w, -(-(b + 1) * total // w))
            for s, w in weights.items() for b in range(blocks[s])]


WEIGHTS = [{"a": 1, "b": 1, "c": 1}, {"a": 70, "b": 20, "c": 10}, {"a": 997, "b": 2, "c": 1},
           {"a": 1, "b": 500, "c": 499}, {"a": 10007, "b": 9001, "c": 8009}]


@pytest.mark.parametrize("weights", WEIGHTS)
def test_deviation_from_the_given_weights_stays_below_one_block(spark, weights):
    total, last = sum(weights.values()), 4000
    jobs = [j for j in pfair_jobs(weights, dict.fromkeys(weights, last)) if j[2] < last]
    rows = mixing.windows(
        spark.createDataFrame([(s, b, weights[s]) for s, b, _, _ in jobs], "src string, b long, w long"), total)
    assert sorted(tuple(r) for r in rows.select("src", "b", "released", "due").collect()) == sorted(jobs)
    slots = placed(spark, jobs)
    owner = {t: s for (s, _), t in slots.items()}
    done = dict.fromkeys(weights, 0)
    for t in range(last):
        done[owner[t]] += 1
        assert all(abs(done[s] * total - (t + 1) * w) < total for s, w in weights.items())
    assert all(released <= slots[s, b] < due for s, b, released, due in jobs)


def test_twenty_thousand_sources(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id")).alias("source"), F.lit("t").alias("text"))
    rows = mixing.schedule(docs).collect()
    assert sorted(r.slot for r in rows) == list(range(20_000))
    assert all(r.released <= r.slot < r.due for r in rows)


def test_weights_out_of_range(docs):
    for weights in ({"a": 0}, {"a": mixing.MOST}):
        with pytest.raises(ValueError):
            mixing.schedule(docs, weights)


def test_every_document_once_in_its_shuffled_order(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "_GROUP_ROWS", 2)
    rows = mixing.schedule(docs, block_docs=2).collect()
    assert len(rows) == docs.count()
    by_source = {}
    for r in rows:
        by_source.setdefault(r.row.source, []).append(((r.block - 1) * 2 + r.place, r.row.doc_id))
        assert r.released <= r.slot < r.due
    for found in by_source.values():
        found.sort()
        assert [n for n, _ in found] == list(range(len(found)))
        # Rows without an id are shuffled by their text.
        mixes = [hashlib.md5(f"0|{i}".encode()).hexdigest() for _, i in found if i is not None]
        assert mixes == sorted(mixes)
    # Another slot is another block.
    assert len({r.slot for r in rows}) == len({(r.row.source, r.block) for r in rows})


def test_mixed_keeps_rows_and_columns_in_order(docs, no_docs, tmp_path, spark):
    mixed = mixing.mixed(docs, {"a": 3, "b": 1}, block_docs=1)
    assert mixed.columns == docs.columns
    assert sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))
    assert mixing.mixed(no_docs).count() == 0
    sources = [r.source for r in mixed.collect()]
    placed = mixing.schedule(docs, {"a": 3, "b": 1}, block_docs=1).orderBy("slot", "place").collect()
    assert sources == [r.row.source for r in placed]
