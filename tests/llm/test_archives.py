import base64
import gzip
import hashlib
import re
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from absentia.llm import archives
from absentia.llm.queries import PAGE_FIELD, QUERIES, pages_as_arc

PAGES = [
    (1, "http://a.example/one two", "<p>same</p>"),
    (2, "http://a.example/2", "<p>same</p>"),
    (2, "http://a.example/2", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (3, "http://b.example/", None),
    (4, "http://b.example/4", ""),
    (None, "http://c.example/", "no id \r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\n\n"),
    (5, "", "line\nhttp://x 1.1.1.1 20200101000000 text/html 5\nab\r\n\r\n"),
    (-7, "http://d.example/", "x" * 300_000 + "é日本\U0001f600"),
    (6, "http://d.example/6", "HTTP/1.1 404 no\r\n\r\n\r\n\r\n"),
]


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(pages):
    """Rows of the query, but for which of equal page_ids is the response."""
    groups = {}
    for i, (page, _, html) in enumerate(pages):
        groups.setdefault((html or "").encode(), []).append((page is not None, page or 0, i))
    out = []
    for data, members in groups.items():
        keeper = max(members)
        for m in members:
            first = m == keeper
            page = m[1] if m[0] else None
            to = keeper[1] if keeper[0] else None
            out.append((page, len(data), sha(data), "response" if first else "revisit", None if first else to))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return df.withColumns({c: F.lit(1) for c in ("key", "file", "n", "keeper", "value", "group_key")})


def run(spark, tmp_path, pages, **options):
    arc, warc = str(tmp_path / "arc"), str(tmp_path / "warc")
    pages_as_arc(pages, arc)
    archives.convert(spark, arc, warc, key_field=PAGE_FIELD, **options)
    return arc, warc, archives.read_warc(spark, warc, key_field=PAGE_FIELD)


def rows_of(found):
    fields = ("key", "payload_bytes", "payload_digest", "record_type", "refers_to_key")
    return sorted((tuple(r[f] for f in fields) for r in found.collect()), key=str)


def test_odd_rows_against_brute_force(spark, tmp_path, pages):
    _, _, found = run(spark, tmp_path, pages)
    assert rows_of(found) == brute(PAGES)
    targets = {r["record_id"]: r for r in found.collect()}
    for r in targets.values():
        if r["refers_to"]:
            assert targets[r["refers_to"]]["payload_digest"] == r["payload_digest"]


def test_revisits_only_from_a_size_on(spark, tmp_path, pages):
    _, _, found = run(spark, tmp_path, pages, revisit_from=5)
    for _, size, _, kind, to in rows_of(found):
        assert size >= 5 or (kind == "response" and to is None)
    assert sum(r[3] == "revisit" for r in rows_of(found)) == 3


def test_shuffled_payloads_give_the_same(spark, tmp_path, pages, monkeypatch):
    """Heavy and light payloads take two ways; a bound of 0 makes all of them light."""
    from absentia.operators import skew

    monkeypatch.setattr(skew, "HEAVY", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        _, _, found = run(spark, tmp_path, pages)
        assert rows_of(found) == brute(PAGES)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_whole_table_against_brute_force(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    found = QUERIES["op11_warc"](spark, sf_dir)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(pages)


def test_files_are_warc(spark, tmp_path, pages):
    """Read without the library: fields, lengths, digests and record separators."""
    _, warc, _ = run(spark, tmp_path, pages)
    kinds = []
    for file in Path(warc).glob("*.gz"):
        data = gzip.open(file).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines)
            n = int(fields["Content-Length"])
            block, end, data = rest[:n], rest[n : n + 4], rest[n + 4 :]
            assert version == "WARC/1.1" and end == b"\r\n\r\n"
            uuid.UUID(fields["WARC-Record-ID"][10:-1])
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
            if not kinds or fields["WARC-Type"] == "warcinfo":
                assert fields["WARC-Type"] == "warcinfo"
            else:
                assert fields["WARC-Block-Digest"] == "sha1:" + sha(block)
            if fields["WARC-Type"] == "response":
                assert fields["WARC-Payload-Digest"] == "sha1:" + sha(block.partition(b"\r\n\r\n")[2])
            kinds.append(fields["WARC-Type"])
    assert kinds.count("response") + kinds.count("revisit") == len(PAGES)


def test_identifiers_are_the_same_in_a_second_run(spark, tmp_path, pages):
    arc, _, found = run(spark, tmp_path, pages)
    archives.convert(spark, arc, str(tmp_path / "again"), key_field=PAGE_FIELD)
    again = archives.read_warc(spark, str(tmp_path / "again"), PAGE_FIELD)
    assert sorted(map(str, found.collect())) == sorted(map(str, again.collect()))


def test_empty_table(spark, tmp_path, pages):
    _, _, found = run(spark, tmp_path, pages.limit(0))
    assert found.collect() == []


def arc_bytes(version, records):
    fields = archives.V1_FIELDS if version == 1 else archives.V2_FIELDS
    block = f"{version} 0 me\n{fields}\n\n"
    extra = "" if version == 1 else "200 - - 0 a.arc "
    out = f"filedesc://a.arc 0.0.0.0 20000101000000 text/plain {extra}{len(block)}\n{block}".encode()
    for line, content in records:
        out += line.encode() + b"\n" + content + b"\n"
    return out


@pytest.mark.parametrize("plain", [False, True])
def test_versions_types_and_dates(spark, tmp_path, plain):
    http = b"HTTP/1.0 200 OK\nServer: s\n\nbody\n"
    v1 = [
        ("dns:a.example 1.1.1.1 19990102030405 text/dns 4", b"1.2."),
        (f"http://a.example/x y 1.1.1.1 19990102030405 text/html; a=b {len(http)}", http),
        ("http://a.example/0 1.1.1.1 99999999999999 text/html 0", b""),
    ]
    v2 = [(f"http://b.example/ - 20010203 text/html 200 ABC - 77 a.arc {len(http)}", http)]
    folder = tmp_path / "arc"
    folder.mkdir()
    for name, data in (("a", arc_bytes(1, v1)), ("b", arc_bytes(2, v2))):
        if plain:
            (folder / f"{name}.arc").write_bytes(data)
        else:  # a member for each half, as archives often have
            cut = len(data) // 2
            (folder / f"{name}.arc.gz").write_bytes(gzip.compress(data[:cut]) + gzip.compress(data[cut:]))
    archives.convert(spark, str(folder), str(tmp_path / "warc"))
    got = sorted((r.uri, r.record_type, r.date, r.payload_bytes) for r in archives.read_warc(spark, str(tmp_path / "warc")).collect())
    kinds = sorted(k for _, k, _, _ in got)
    assert kinds == ["resource", "resource", "response", "revisit"]
    assert [(u, d, n) for u, _, d, n in got] == [
        ("dns:a.example", "1999-01-02T03:04:05Z", 4),
        ("http://a.example/0", "1970-01-01T00:00:00Z", 0),
        ("http://a.example/x y", "1999-01-02T03:04:05Z", 5),
        ("http://b.example/", "2001-02-03T00:00:00Z", 5),
    ]


def test_damaged_records(spark, tmp_path):
    good = ("http://a.example/ 1.1.1.1 19990102030405 text/html 3", b"abc")
    bad = ("http://b.example/ 1.1.1.1 text/html oops", b"some bytes\nof lines")
    cut = ("http://c.example/ 1.1.1.1 19990102030405 text/html 999", b"abc")
    folder = tmp_path / "arc"
    folder.mkdir()
    with gzip.open(folder / "a.arc.gz", "wb") as out:
        out.write(arc_bytes(1, [good, bad, good, cut]))
    with pytest.raises(Exception, match="no header line at byte"):
        archives.read_arc(spark, str(folder)).collect()
    found = archives.read_arc(spark, str(folder), skip_damaged=True).collect()
    assert [bytes(r.payload) for r in found] == [b"abc", b"abc"]
