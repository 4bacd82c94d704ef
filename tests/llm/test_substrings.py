import hashlib

import numpy as np
import pytest

from absentia.llm import substrings
from absentia.llm.queries import QUERIES
from absentia.llm.texts import text_key


def brute(rows, window=20):
    """rows: (text) in their order; kept words of each."""
    seen, out = set(), []
    for text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        out.append((len(words), sum(gone), [w for w, g in zip(words, gone) if not g]))
    return out


def test_query_agrees_with_brute_force(spark, sf_dir, documents):
    rows = documents.orderBy("doc_id").collect()
    want = {
        (r.doc_id, n, gone, hashlib.sha256(b" ".join(kept)).hexdigest())
        for r, (n, gone, kept) in zip(rows, brute([r.text for r in rows]))
    }
    assert {tuple(r) for r in QUERIES["op3_substrings"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize("cells", [10, 20])
def test_small_alphabet_and_full_sketch(spark, monkeypatch, cells):
    """Overlapping and self-repeating windows; a sketch so full that it stops nothing."""
    monkeypatch.setattr(substrings, "MAX_LOG2_CELLS", cells)
    monkeypatch.setattr(substrings, "MIN_LOG2_CELLS", cells)
    monkeypatch.setattr(substrings, "LOG2_SEGMENT", 8)
    rng = np.random.default_rng(3)
    texts = [" ".join("ab"[b] for b in rng.integers(0, 2, n)) for n in rng.integers(0, 60, 40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.remove_repeats(frame.repartition(5), 6).collect()}
    for i, (n, gone, kept) in enumerate(brute(texts, 6)):
        assert (got[i].n_words, got[i].n_removed) == (n, gone)
        assert got[i].kept == b" ".join(kept).decode()


def test_one_passage_in_all_texts(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    texts = [f"head{i} {passage} tail{i}" for i in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in substrings.remove_repeats(frame.repartition(7)).collect()}
    assert got.pop(0) == texts[0]
    assert all(t == f"head{i} tail{i}" for i, t in got.items())


def test_odd_rows(docs, no_docs):
    keyed = docs.select("doc_id", "text", text_key().alias("key")).collect()
    ordered = sorted({(-(1 << 63) if r.doc_id is None else r.doc_id, r.key, r.text or "") for r in keyed})
    want = {o: b for o, b in zip(ordered, brute([t for _, _, t in ordered]))}
    got = substrings.remove_repeats(docs).collect()
    assert len(got) == len(keyed)
    expected = sorted(
        (r.doc_id is None, r.doc_id or 0, *want[-(1 << 63) if r.doc_id is None else r.doc_id, r.key, r.text or ""][:2])
        for r in keyed
    )
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in got) == expected
    assert substrings.remove_repeats(no_docs).count() == 0
