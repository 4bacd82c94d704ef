import hashlib
import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from absentia.llm import chat, queries
from absentia.llm.queries import ORACLES, QUERIES
from workload.check import compare, duck

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, None, None),
    (2, 1, "assistant", ""), (3, 0, "user", "same"), (3, 0, "assistant", "same"), (3, 0, "user", "same"),
    (None, 0, "user", "a"), (4, None, "assistant", "before"), (4, 0, "user", "\\<|turn|> \\\\ <|>"),
    (5, 0, "<|end|>\n", "x" * 50_000), (5, 1, "assistant", "é<<SYS>>\n\n" * 2_000),
]


def digest(rows, role=None):
    text = "".join(
        (t or "") if role else f"{r or ''}\n{t or ''}\n" for r, t in rows if not role or r == role
    )
    return len(text), hashlib.sha256(text.encode()).hexdigest()


def order(row):
    return (row[1] is not None, row[1] or 0, row[2] or "", row[3] or "")


@pytest.fixture(scope="module")
def turns(spark):
    frame = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    # Names used inside, and those of another layout.
    return frame.withColumns({c: F.lit(1) for c in ("piece", "head", "record", "prompt", "id")})


def test_read_back_gives_what_was_said(turns):
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.canonical_turns(turns))).collect()}
    groups = {}
    for row in sorted(TURNS, key=order):
        groups.setdefault(row[0], []).append((row[2], row[3]))
    assert set(got) == set(groups)
    for c, rows in groups.items():
        assert got[c].n_turns == len(rows)
        assert got[c].turns_sha256 == digest(rows)[1]
        assert (got[c].loss_chars, got[c].loss_sha256) == digest(rows, "assistant")


def test_no_control_string_is_left_inside(turns):
    for r in chat.format_turns(chat.canonical_turns(turns)).collect():
        head, body, end = chat.TURN, r.piece[len(chat.TURN) : -len(chat.END)], chat.END
        assert r.piece == head + body + end
        inside = body.split(chat.TEXT)
        assert len(inside) == 2
        assert not any(c in part for part in inside for c in chat.CONTROL_STRINGS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROL_STRINGS, "\\", "<", "|", ">", "a", "\n"]), max_size=12))
def test_escaping_is_reversible(parts):
    import re

    text = "".join(parts)
    # What the column expression does, on one text.
    escaped = re.sub(f"(?=(?:{chat._CONTROL}))(.)", r"\1\\", text.replace("\\", "\\\\"))
    assert chat._plain(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL_STRINGS)


def test_layouts_by_fingerprint(spark):
    prints = {chat.fingerprint(x.required) for x in chat.LAYOUTS}
    assert len(prints) == len(chat.LAYOUTS)
    want = [(7, 0, "user", "q"), (7, 1, "assistant", "a")]
    records = [
        {"id": 7, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 7},
        {"id": 7, "instruction": "q", "input": "", "output": "a"},
        {"completion": "a", "prompt": "q", "id": 7},
    ]
    texts = [json.dumps(r) for r in records]
    for text, layout in zip(texts, chat.LAYOUTS[1:]):
        frame = spark.read.schema(layout.ddl).json(spark.sparkContext.parallelize([text]))
        got = chat.canonical_turns(frame.withColumn("extra", F.lit(1)))
        assert sorted(tuple(r) for r in got.collect()) == want
    raw = spark.createDataFrame([(t,) for t in [*texts, '{"id": 1, "odd": 2}', "{", None]], "raw string")
    mixed = chat.canonical_turns_of_json(raw, "raw").collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in mixed if r.unknown is None) == sorted(want * 4)
    assert len([r for r in mixed if r.unknown]) == 3
    assert {r.record for r in mixed if r.unknown} == {'{"id": 1, "odd": 2}', "{", None}
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1))


def test_optional_fields_do_not_change_the_layout(spark):
    ask, say = (7, 0, "user", "q"), (7, 1, "assistant", "a")
    cases = [
        ({"id": 7, "messages": []}, []),
        ({"id": 7, "messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "MODEL", "content": "a"}]}, [ask, say]),
        ({"messages": [{"role": "user", "content": "q"}]}, [(None, *ask[1:])]),
        ({"id": 7, "messages": [{"role": "user", "content": None, "turn": 5}]}, [(7, 5, "user", None)]),
        ({"id": 7, "instruction": "q", "output": "a", "meta": {"prompt": "p"}}, [ask, say]),
        ({"id": 7, "system": "s", "prompt": "q", "completion": "a"}, [(7, -1, "system", "s"), ask, say]),
        ({"id": 7, "system": "s", "conversations": [{"from": "human", "value": "q"}]}, [(7, -1, "system", "s"), ask]),
        ({"turn": None, "role": None, "text": "t"}, [(None, None, None, "t")]),
        # Items of another layout, paths of two layouts, no object.
        ({"id": 7, "messages": [{"from": "human", "value": "q"}]}, None),
        ({"id": 7, "messages": ["q"]}, None),
        ({"id": 7, "prompt": "q", "completion": "a", "role": "user", "text": "t"}, None),
        ([1], None), ("role", None),
    ]
    for record, want in cases:
        raw = json.dumps(record)
        got = chat.canonical_turns_of_json(spark.createDataFrame([(raw,)], "raw string"), "raw").collect()
        if want is None:
            assert [(r.record, r.turn, r.text) for r in got] == [(raw, None, None)] and got[0].unknown, record
        else:
            assert [(r.conv_id, r.turn, r.role, r.text) for r in got] == want, record
            assert all(r.unknown is None and r.record is None for r in got)


def test_query_reads_every_layout(spark, turns, monkeypatch):
    """The rows of the table come back the same from all layouts, long ones from rows."""
    monkeypatch.setattr(queries, "_JSON_CHARS", 10_000)
    many = turns.unionByName(turns.where("conv_id = 1").drop("conv_id").crossJoin(
        spark.range(100, 140).withColumnRenamed("id", "conv_id")).select(*turns.columns))
    rows, records = queries.conversations_in_layouts(many)
    parts = [r.record.lstrip('{"').split('"')[0] + str('"messages"' in r.record) for r in records.collect()]
    assert len(set(parts)) >= 3 and rows.count() > 0
    found = chat.canonical_turns_of_json(records, "record")
    assert found.where("unknown is not null").count() == 0
    back = chat.canonical_turns(rows).unionByName(found.drop("unknown", "record"))
    columns = ("conv_id", "turn", "role", "text")
    assert sorted(map(repr, back.select(*columns).collect())) == sorted(map(repr, many.select(*columns).collect()))


def test_empty_table(spark, turns):
    assert chat.read_back(chat.format_turns(chat.canonical_turns(turns.where("false")))).count() == 0


def test_query_agrees_with_sql(spark, sf_dir):
    ok, note = compare(spark, duck(sf_dir), sf_dir, "op1", QUERIES["op1_chat"], ORACLES["op1_chat"])
    assert ok and "types" not in note, note


def test_equal_turns_follow_by_their_text(spark):
    """Control strings are escaped inside; that must not change the order."""
    texts = ["<a", "<|x", "</s>", "</s>b", "[INST]", "[a", "\\z", "a", "ab", "", chat.TURN, chat.END + "q"]
    rows = [(1, 0, "user", t) for t in texts]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.read_back(chat.format_turns(turns)).first()
    want = "".join(f"user\n{t}\n" for t in sorted(texts))
    assert found.turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
