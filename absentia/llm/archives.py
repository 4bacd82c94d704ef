"""ARC files into WARC files: header lines by version, declared lengths, revisits.

An ARC file starts with a version block, whose second line names the version; it
says which fields a record's header line has (version 1: address, IP, date, type,
length; version 2 adds result code, checksum, location, offset and file name before
the length). After a header line come exactly the declared bytes. From that a WARC
record is made: its type (the version block becomes `warcinfo`, an HTTP answer
`response` or `revisit`, anything else `resource`), an identifier derived from the
place in the archive, so that a repeated task writes the same one, the date in ISO
form and the SHA-1 digests of block and payload.

Of records with equal payloads (digest and length) of at least `revisit_from` bytes,
the one with the largest key stays a `response`; others keep their HTTP head and
point to it. The key is the number in an HTTP field the caller names; ties and
records without it go by place. Digests travel in a narrow table; payloads move only
if the table of repeated payloads is too large for Spark to send it to all.

Files are read and written by Spark's text source, which passes bytes through, so any
store will do. Files are gzipped as a whole; readers take members one after the other
as well. An archive is read by one task as a stream: a record and a batch of rows are
held, not a file. A file that is not compressed must fit one split
(`spark.sql.files.maxPartitionBytes`); it is an error if it does not.

Edge cases: an empty payload is a payload. Blank lines between records are passed
over. Spaces in an address are kept. A header line that cannot be read, or a record
cut short, is an error that names the place, or with `skip_damaged` is passed over up
to the next header line. An impossible date becomes 1970. No rows, no files: an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from absentia.llm.texts import map_batches
from absentia.operators.skew import attach
from absentia.sources.storage import settle

ARC_END = "\n"
WARC_END = "\r\n\r\n"
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = (
    "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
    "Archive-length"
)
# Addresses and types may hold spaces, so fields are taken from both ends.
_HEADER = {
    1: re.compile(rb"(?P<uri>.*) (?P<ip>\S+) (?P<date>\d{8,17}) (?P<mime>.*) (?P<length>\d+)"),
    2: re.compile(
        rb"(?P<uri>.*) (?P<ip>\S+) (?P<date>\d{8,17}) (?P<mime>.*) (?P<status>\S+) (?P<sum>\S+) "
        rb"(?P<location>\S+) (?P<offset>\S+) (?P<name>\S+) (?P<length>\d+)"
    ),
}
_STARTS = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]*:")
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "arc-to-warc")

_NARROW = (
    "file long, offset long, record_id string, uri string, date string, key long, "
    "kind string, payload_digest string, payload_bytes long, group_key string"
)
ARC_SCHEMA = _NARROW + ", ip string, mime string, head binary, payload binary"
WARC_SCHEMA = (
    "record_id string, record_type string, uri string, date string, key long, "
    "declared_digest string, refers_to string, payload_digest string, payload_bytes long"
)


class Damaged(ValueError):
    """A record that cannot be read."""


class _Tape:
    """The bytes of one file, from its pieces between separators."""

    def __init__(self, pieces: Iterator[bytes], separator: bytes) -> None:
        self.pieces, self.separator = pieces, separator
        self.buffer, self.at, self.gone = b"", 0, 0

    def _more(self, least: int) -> bool:
        """Have at least so many bytes more in the buffer, if there are."""
        got, size = [self.buffer[self.at :]], 0
        self.gone += self.at
        for piece in self.pieces:
            got += (piece, self.separator)
            size += len(piece) + len(self.separator)
            if size >= least:
                break
        self.buffer, self.at = b"".join(got), 0
        return size > 0

    @property
    def offset(self) -> int:
        return self.gone + self.at

    def until(self, mark: bytes) -> bytes | None:
        """All up to a mark, which is passed over; None at the end."""
        start = self.at
        while (end := self.buffer.find(mark, start)) < 0:
            kept = len(self.buffer) - self.at
            if not self._more(1 << 16):
                rest, self.at = self.buffer[self.at :], len(self.buffer)
                return rest or None
            start = max(0, kept - len(mark) + 1)
        out, self.at = self.buffer[self.at : end], end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        if len(self.buffer) - self.at < n:
            self._more(n - (len(self.buffer) - self.at))
        if len(self.buffer) - self.at < n:
            raise Damaged(f"cut short at byte {self.offset}")
        out, self.at = self.buffer[self.at : self.at + n], self.at + n
        return out


def _tapes(batches: Iterable[pa.RecordBatch], end: str) -> Iterator[tuple[int, _Tape]]:
    """The files a task reads, one after the other."""

    def rows() -> Iterator[tuple[int, bytes]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

    for file, pieces in groupby(rows(), key=lambda row: row[0]):
        tape = _Tape((p for _, p in pieces), end.encode())
        yield file, tape
        for _ in tape.pieces:  # the next file starts behind this one
            pass


def _pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    whole = F.when(
        F.col("_metadata.file_block_start") > 0,
        F.raise_error("an archive without compression is larger than a split"),
    ).otherwise(F.xxhash64("_metadata.file_name"))
    lines = spark.read.option("lineSep", end).text(path)
    return lines.select(whole.alias("file"), F.col("value").cast("binary").alias("piece"))


def digest(data: bytes) -> str:
    """SHA-1 in base 32, as WARC files give it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(digits: str) -> str:
    """yyyyMMdd[HHmmss[SSS]] as an ISO instant."""
    padded = digits.ljust(14, "0")
    try:
        when = datetime.strptime(padded[:14], "%Y%m%d%H%M%S").isoformat()
    except ValueError:
        return "1970-01-01T00:00:00Z"
    fraction = padded[14:]
    return f"{when}.{fraction}Z" if fraction else f"{when}Z"


def _split_head(block: bytes) -> tuple[bytes | None, bytes]:
    """HTTP head (None if there is none) and payload of a block."""
    if not block.startswith(b"HTTP/"):
        return None, block
    end = _HEAD_END.search(block)
    return (block, b"") if end is None else (block[: end.end()], block[end.end() :])


def _number(head: bytes | None, field: str) -> int | None:
    """The number in an HTTP field; only what fits a long counts."""
    if not head or not field:
        return None
    found = re.search(rb"(?mi)^" + re.escape(field.encode()) + rb":[ \t]*(-?\d{1,19})[ \t]*\r?$", head)
    n = int(found[1]) if found else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def arc_records(tape: _Tape, skip_damaged: bool = False) -> Iterator[dict]:
    """uri, ip, date, mime, offset and block of each record; the first is the version block."""
    version = None
    while True:
        offset = tape.offset
        line = tape.until(b"\n")
        if line is None:
            return
        line = line.rstrip(b"\r")
        if not line:
            continue
        found = _HEADER[version or 1].fullmatch(line) or (not version and _HEADER[2].fullmatch(line))
        try:
            if not found or (skip_damaged and not _STARTS.match(line)):
                raise Damaged(f"no header line at byte {offset}")
            block = tape.take(int(found["length"]))
            if version is None:
                if not line.startswith(b"filedesc:") or block[:1] not in (b"1", b"2"):
                    raise Damaged("no version block")
                version = int(block[:1])
        except Damaged:
            if not skip_damaged:
                raise
            continue
        yield {k: found[k].decode("utf-8", "replace") for k in ("uri", "ip", "date", "mime")} | {
            "offset": offset, "block": block, "first": line.startswith(b"filedesc:"),
        }


def read_arc(
    spark: SparkSession, path: str, key_field: str = "", payloads: bool = True, skip_damaged: bool = False
) -> DataFrame:
    """A row for each record of the ARC files under a path, version blocks left out.

    `group_key` is digest and length of the payload. Without `payloads` the rows are
    narrow.
    """
    names = [f.split()[0] for f in (ARC_SCHEMA if payloads else _NARROW).split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for file, tape in _tapes(batches, ARC_END):
            try:
                for r in arc_records(tape, skip_damaged):
                    if r["first"]:
                        continue
                    head, payload = _split_head(r["block"])
                    place = f"{file}/{r['offset']}/{r['uri']}/{r['date']}"
                    sha = digest(payload)
                    row = r | {
                        "file": file, "head": head, "payload": payload, "date": iso_date(r["date"]),
                        "record_id": f"urn:uuid:{uuid.uuid5(_SPACE, place)}",
                        "key": _number(head, key_field), "payload_digest": sha,
                        "payload_bytes": len(payload), "group_key": f"{sha}.{len(payload)}",
                        "kind": "resource" if head is None else "response",
                    }
                    rows.append({n: row[n] for n in names})
                    size += len(r["block"]) if payloads else 256
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _arrow(names))
                        rows, size = [], 0
            except Damaged as error:
                raise Damaged(f"file {file}: {error}") from None
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _arrow(names))

    return map_batches(_pieces(spark, path, ARC_END), run, ARC_SCHEMA if payloads else _NARROW)


def _arrow(names: list[str]) -> pa.Schema:
    kinds = {"file": pa.int64(), "offset": pa.int64(), "key": pa.int64(), "payload_bytes": pa.int64(),
             "head": pa.binary(), "payload": pa.binary()}
    return pa.schema([(n, kinds.get(n, pa.string())) for n in names])


def repeated_payloads(records: DataFrame, revisit_from: int = 0) -> DataFrame:
    """A row for each payload met more than once: how often, and the record that keeps it."""
    place = F.struct("key", "file", "offset", "record_id", "uri", "date")
    return (
        records.where((F.col("payload_bytes") >= revisit_from) & (F.col("kind") == "response"))
        .groupBy("group_key")
        .agg(F.count("*").alias("n"), F.max(place).alias("keeper"))
        .where("n > 1")
    )


def _warc(fields: Iterable[tuple[str, str]], block: bytes) -> bytes:
    # A field must not break its line.
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "replace") + block


def _record(row: dict) -> bytes:
    """The WARC record of a row of `read_arc` and the keeper it refers to, if any."""
    keeper, head = row["keeper"], row["head"]
    block = head if keeper else (head or b"") + row["payload"]
    fields = [
        ("WARC-Type", "revisit" if keeper else row["kind"]),
        ("WARC-Record-ID", f"<{row['record_id']}>"),
        ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["uri"]),
        ("WARC-IP-Address", row["ip"]),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
    ]
    if keeper:
        fields += [
            ("WARC-Profile", _REVISIT),
            ("WARC-Refers-To", f"<{keeper['record_id']}>"),
            ("WARC-Refers-To-Target-URI", keeper["uri"]),
            ("WARC-Refers-To-Date", keeper["date"]),
        ]
    http = head is not None
    fields.append(("Content-Type", "application/http; msgtype=response" if http else row["mime"]))
    return _warc(fields, block)


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of WARC files: one `warcinfo` record, then one for each row."""
    out, size, part = [], 0, TaskContext.get().partitionId()
    started = False
    for batch in batches:
        for row in batch.to_pylist():
            if not started:
                started = True
                info = f"part: {part}\r\nformat: WARC File Format 1.1\r\n".encode()
                fields = [
                    ("WARC-Type", "warcinfo"),
                    ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, f'{part}/' + row['record_id'])}>"),
                    ("WARC-Date", row["date"]),
                    ("Content-Type", "application/warc-fields"),
                ]
                out.append(_warc(fields, info))
            out.append(_record(row))
            size += len(out[-1])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_lines(values: DataFrame, path: str, end: str) -> None:
    """Bytes of the one column into gzipped files, each row followed by `end`."""
    lines = values.select(F.col(values.columns[0]).cast("string").alias("value"))
    # The fastest level: at the usual one compressing takes longer than all else.
    options = {"lineSep": end, "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    lines.write.options(**options).text(path)


def convert(
    spark: SparkSession, arc: str, warc: str, key_field: str = "", revisit_from: int = 0, skip_damaged: bool = False
) -> None:
    """Write the records of the ARC files under `arc` as WARC files to the new folder `warc`."""
    narrow = read_arc(spark, arc, key_field, payloads=False, skip_damaged=skip_damaged)
    groups = settle(repeated_payloads(narrow, revisit_from), "payloads")
    records = read_arc(spark, arc, key_field, skip_damaged=skip_damaged)
    place = F.xxhash64("file", "offset")
    met = attach(records, groups, "group_key", ["keeper"], place, "met")
    keeper = F.when(
        (F.col("kind") == "response") & (F.col("met.keeper.record_id") != F.col("record_id")),
        F.struct("met.keeper.record_id", "met.keeper.uri", "met.keeper.date"),
    )
    rows = met.select(
        "record_id", "uri", "ip", "date", "mime", "kind", "payload_digest", "head", "payload",
        keeper.alias("keeper"),
    )
    write_lines(map_batches(rows, _records, "value binary"), warc, WARC_END)


def warc_records(tape: _Tape) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record."""
    while True:
        offset = tape.offset
        head = tape.until(b"\r\n\r\n")
        if head is None:
            return
        head = head.lstrip(b"\r\n")
        if not head:
            continue
        version, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise Damaged(f"no record at byte {offset}")
        pairs = (line.partition(":") for line in lines)
        fields = {k.strip().lower(): v.strip() for k, _, v in pairs}
        yield fields, tape.take(int(fields["content-length"]))


def read_warc(spark: SparkSession, path: str, key_field: str = "") -> DataFrame:
    """A row for each record of the WARC files under a path, `warcinfo` left out.

    `payload_digest` and `payload_bytes` are measured on the payload as read; for a
    revisit they are those of the record it refers to, and `refers_to_key` is that
    record's key. A response whose declared digest differs is an error.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for file, tape in _tapes(batches, WARC_END):
            for f, block in warc_records(tape):
                if f["warc-type"] == "warcinfo":
                    continue
                revisit = f["warc-type"] == "revisit"
                head, payload = _split_head(block)
                sha, declared = digest(payload), f["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and sha != declared:
                    raise Damaged(f"file {file}: digest of {f['warc-record-id']} differs")
                rows.append({
                    "record_id": f["warc-record-id"], "record_type": f["warc-type"],
                    "uri": f.get("warc-target-uri"), "date": f["warc-date"],
                    "key": _number(head, key_field), "declared_digest": declared,
                    "refers_to": f.get("warc-refers-to"),
                    "payload_digest": None if revisit else sha,
                    "payload_bytes": None if revisit else len(payload),
                })
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, _arrow(list(rows[0])))
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _arrow(list(rows[0])))

    records = settle(map_batches(_pieces(spark, path, WARC_END), run, WARC_SCHEMA), "warc")
    revisits = records.where("record_type = 'revisit'")
    targets = revisits.groupBy("refers_to").agg(F.count("*").alias("n"))
    kept = records.where("record_type <> 'revisit'").select(
        F.col("record_id").alias("refers_to"), F.col("key").alias("to_key"),
        F.col("payload_digest").alias("to_digest"), F.col("payload_bytes").alias("to_bytes"),
    )
    known = settle(targets.join(kept, "refers_to"), "targets")
    values = ["to_key", "to_digest", "to_bytes"]
    met = attach(records, known, "refers_to", values, F.xxhash64("record_id"), "to")
    return met.select(
        "record_id", "record_type", "uri", "date", "key", "refers_to",
        F.col("to.to_key").alias("refers_to_key"),
        F.coalesce("payload_digest", "to.to_digest").alias("payload_digest"),
        F.coalesce("payload_bytes", "to.to_bytes").alias("payload_bytes"),
    )
