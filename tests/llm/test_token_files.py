import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from absentia.llm import token_files
from absentia.llm.queries import END_ID, QUERIES, TOKENIZER
from absentia.llm.texts import text_key

ODD = ["a  b", "\n a b", " x", "x ", "it's don't, 12.5%)%% foo...bar", "tab\tx y", "\x00 a", "", "\n",
       "a\n\nb", "é…, “x”. y’s a.'s", "日本 語。a", "1٣.² b", "a b c", "x\ny. z!\nw", "(a) [b]; {c}",
       "don't. can't) we'll, 'tis", "Straße#tag** $5 &amp; |x|"]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t, add_special_tokens=False).ids


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_pieces_give_the_ids_of_the_whole(plain, documents):
    texts = ODD + [r.text for r in documents.limit(60).collect()]
    assert [ids_of(d) for d in token_files.encode(texts, TOKENIZER)] == [plain(t) for t in texts]


def test_forgotten_pieces_are_encoded_again(plain, monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_PIECES", 8)
    encoder = token_files._Encoder(TOKENIZER)
    texts = ["one two\nthree four", "five six seven", "", "eight nine ten two", "ten one\ntwo eleven"]
    for _ in range(3):
        for t in texts:
            assert [ids_of(d) for d in encoder.encode([t, "", t])] == [plain(t), [], plain(t)]
            assert len(encoder.known) < 8 + 5
            assert encoder.known[:2].to_pylist() == ["", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Z9.,'!\n\t é’日 %)"), max_size=25))
def test_any_text_has_the_ids_of_the_whole(plain, text):
    assert ids_of(token_files.encode([text], TOKENIZER)[0]) == plain(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=500))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    frame = token_files.pack(ids)
    assert (token_files.unpack(frame, len(ids)) == ids).all()
    # Any block can be read alone.
    for b in range(-(-len(ids) // token_files.BLOCK)):
        some = token_files.unpack(frame, len(ids), b, b + 1)
        assert (some[: len(ids) - b * 128] == ids[b * 128 : (b + 1) * 128]).all()


def test_outliers_are_exceptions():
    ids = np.r_[np.arange(120), np.full(8, 2**31)].astype(np.uint32)
    frame = token_files.pack(ids)
    assert frame["width"] == b"\x07" and frame["n_exceptions"] == b"\x08"
    assert len(frame["packed"]) == 7 * 16


def expected(rows, plain):
    start = 0
    for doc_id, text in rows:
        ids = plain(text or "") + [END_ID]
        yield doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_query_agrees_with_the_library(spark, sf_dir, documents, plain):
    rows = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]
    got = QUERIES["op4_token_files"](spark, sf_dir).orderBy("start").collect()
    assert [tuple(r) for r in got] == list(expected(rows, plain))


def test_odd_rows(docs, no_docs, plain, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 2_000)
    keyed = docs.select("doc_id", "text", text_key().alias("key")).collect()
    rows = sorted(keyed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.key))
    frames = token_files.write_tokens(docs, TOKENIZER, END_ID)
    got = token_files.read_tokens(frames).orderBy("start").collect()
    assert [tuple(r) for r in got] == list(expected([(r.doc_id, r.text) for r in rows], plain))
    assert token_files.read_tokens(token_files.write_tokens(no_docs, TOKENIZER, END_ID)).count() == 0
