"""The operators over their whole tables, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from absentia.llm import (
    archives, chat, cotraining, decontamination, html_text, lexical, mixing, perplexity, simhash, substrings, token_files, toxicity,
    whitening,
)
from absentia.llm.texts import as_bytes, map_batches, slices, table, text_key
from absentia.sources.storage import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def _query(build):
    QUERIES[build.__name__] = build
    return build


# A JSON parser takes strings up to some size only; longer turns stay rows of a table.
_JSON_CHARS = 1 << 20


def conversations_in_layouts(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of a table as records of several layouts: rows as they are, and JSON
    records of a turn each, in three layouts that take turns by conversation."""
    kind = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    plain = F.coalesce(F.length("text"), F.lit(0)) + F.coalesce(F.length("role"), F.lit(0)) > _JSON_CHARS
    own = turns.select("conv_id", "turn", "role", "text", F.when(plain, 0).otherwise(kind).alias("kind"))
    # Layouts with lists have roles of their own names; others stay in turn rows.
    listed = F.coalesce(F.col("role").isin("user", "assistant", "system"), F.lit(False))
    other = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    message = F.struct(F.col("role"), F.col("text").alias("content"), F.col("turn"), F.lit("x").alias("name"))
    said = F.struct(other.alias("from"), F.col("text").alias("value"), F.col("turn"))
    keep = {"ignoreNullFields": "false"}
    as_messages = F.to_json(F.struct(F.col("conv_id").alias("id"), F.array(message).alias("messages")), keep)
    as_said = F.to_json(F.struct(F.array(said).alias("conversations"), F.col("conv_id").alias("id")), keep)
    as_row = F.to_json(F.struct("text", "role", "turn", "conv_id"), keep)
    record = F.when(listed & (F.col("kind") == 1), as_messages).when(listed & (F.col("kind") == 2), as_said)
    rows = own.where("kind = 0").drop("kind")
    return rows, own.where("kind > 0").select(record.otherwise(as_row).alias("record"))


@_query
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"),
    )
    rows, records = conversations_in_layouts(table(spark, sf_dir, "conversations"))
    turns = chat.canonical_turns(rows).unionByName(added)
    turns = turns.unionByName(chat.canonical_turns_of_json(records, "record").select(*turns.columns))
    return chat.read_back(chat.format_turns(turns))


def _control_starts(column: str) -> str:
    """Characters that escaping adds to a text, in SQL."""
    found = [f"length({column}) - length(replace({column}, '\\', ''))"]
    for c in chat.CONTROL_STRINGS:
        found.append(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}")
    return "(" + " + ".join(found) + ")"


_FRAME = len(chat.TURN + chat.TEXT + chat.END)
ORACLES["op1_chat"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
    AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, ''
    ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(role) + length(text) + {_control_starts('role')} + {_control_starts('text')}
    + {_FRAME}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@_query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select(
        "doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id"
    )


@_query
def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substrings.remove_repeats(table(spark, sf_dir, "documents"), 20, with_text=False)
    return cleaned.select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = token_files.write_tokens(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)
    return token_files.read_tokens(frames)


@_query
def op5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "log_perplexity", "low", "high",
    )


@_query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


@_query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contained(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "item_id", F.col("n_found").cast("long").alias("n_found"),
        F.col("n_shingles").cast("long").alias("n_shingles"), "containment",
    )


ORACLES["op7_decontamination"] = """
WITH split AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'),
    lambda x: x <> '') AS w FROM documents),
of_items AS (
  SELECT min(item_id) AS item_id, w FROM (
    SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'),
      lambda x: x <> '') AS w FROM benchmark) GROUP BY w HAVING len(w) > 0),
items AS (
  SELECT DISTINCT item_id, l, unnest(list_transform(range(1, len(w) - l + 2),
    lambda i: array_to_string(w[i:i + l - 1], ' '))) AS s
  FROM (SELECT *, least(len(w), 5) AS l FROM of_items)),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
lengths AS (SELECT DISTINCT l FROM items),
docs AS (
  SELECT DISTINCT id, l, unnest(list_transform(range(1, len(w) - l + 2),
    lambda i: array_to_string(w[i:i + l - 1], ' '))) AS s
  FROM split, lengths WHERE len(w) >= l)
SELECT id AS doc_id, item_id, count(*) AS n_found, any_value(n) AS n_shingles,
  count(*) / any_value(n) AS containment
FROM docs JOIN items USING (l, s) JOIN sizes USING (item_id)
GROUP BY id, item_id HAVING count(*) / any_value(n) >= 0.8"""


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("key")


@_query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The schedule needs texts only to tell rows of one id apart.
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", text_key().cast("string").alias("text")
    )
    return mixing.schedule(docs).select(
        "row.doc_id", "row.source", "block", "released", "due", "slot", "place"
    )


ORACLES["op9_mixing"] = f"""
WITH RECURSIVE src AS (
  SELECT coalesce('=' || source, '') AS src, CAST(floor(sqrt(count(*))) AS BIGINT) AS w,
    (count(*) + {mixing.BLOCK_DOCS - 1}) // {mixing.BLOCK_DOCS} AS blocks
  FROM documents GROUP BY ALL),
target AS (SELECT src, w, blocks, CAST(sum(w) OVER () AS BIGINT) AS h, row_number() OVER (ORDER BY src) AS i FROM src),
lists AS (SELECT list(w ORDER BY i) AS w, list(blocks ORDER BY i) AS blocks, max(h) AS h FROM target),
edf(t, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(w, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT) FROM lists
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, n: d + CASE WHEN n = p THEN 1 ELSE 0 END), p
  FROM (
    SELECT t, done, list_min(list_transform(
      list_filter(range(1, len(w) + 1), lambda i: blocks[i] > done[i] AND done[i] * h // w[i] <= t + 1),
      lambda i: {{'d': ((done[i] + 1) * h + w[i] - 1) // w[i], 'r': done[i] * h // w[i], 'i': i}})).i AS p
    FROM edf, lists WHERE list_sum(done) < list_sum(blocks))),
slots AS (SELECT src, w, h, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j
  FROM edf JOIN target ON pick = i),
docs AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS src, row_number() OVER (
    PARTITION BY source ORDER BY md5('0|' || doc_id), doc_id) - 1 AS n FROM documents)
SELECT doc_id, source, j + 1 AS block, CAST(j * h // w AS BIGINT) AS released,
  CAST(((j + 1) * h + w - 1) // w AS BIGINT) AS due, slot, n % {mixing.BLOCK_DOCS} AS place
FROM docs JOIN slots USING (src) WHERE j = n // {mixing.BLOCK_DOCS}"""


@_query
def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotraining.fit(docs, table(spark, sf_dir, "labels"))
    scored = cotraining.score(docs, model).drop("key")
    return scored.withColumn("kept", F.col("predicted") == 1)


PAGE_FIELD = "X-Page-Id"


def _arc_text(version: int):
    """The lines of an ARC file of a version that holds pages as HTTP answers."""
    fields = archives.V1_FIELDS if version == 1 else archives.V2_FIELDS
    middle = " " if version == 1 else " 200 - - 0 pages.arc "
    date = "20240229120000"

    def run(batches):
        started = False
        for batch in batches:
            for rows, texts in slices([batch], "html"):
                out = []
                if not started:
                    started = True
                    block = f"{version} 0 pages\n{fields}\n\n"
                    out.append(
                        f"filedesc://pages.arc 0.0.0.0 {date} text/plain{middle}{len(block)}\n{block}".encode()
                    )
                for page, url, html in zip(rows.column(0).to_pylist(), as_bytes(rows.column(1)), texts):
                    known = f"{PAGE_FIELD}: {page}\r\n" if page is not None else ""
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}\r\n"
                    block = head.encode() + html
                    place = b"%20".join(url.split()) or b"about:blank"
                    line = f" 192.0.2.1 {date} text/html{middle}{len(block)}\n".encode()
                    out.append(place + line + block)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def pages_as_arc(pages: DataFrame, folder: str) -> None:
    """Pages as ARC files, about half of them in each version."""
    for version in (1, 2):
        half = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(2)) == version - 1)
        lines = map_batches(half.select("page_id", "url", "html"), _arc_text(version), "value binary")
        archives.write_lines(lines, f"{folder}/version={version}", archives.ARC_END)


@_query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    pages_as_arc(table(spark, sf_dir, "pages"), arc)
    archives.convert(spark, arc, warc, key_field=PAGE_FIELD, revisit_from=0)
    return archives.read_warc(spark, warc, key_field=PAGE_FIELD).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_key").alias("refers_to"),
    )


# DuckDB has no SHA-1 in base 32 and none of bytes; tests compare with a brute-force version.


@_query
def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def _term_rows(name: str, key: str) -> str:
    """Terms of a table with their counts, in DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""SELECT row, {key}, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT row_number() OVER () AS row, * FROM {name})"""


ORACLES["op12_lexical"] = f"""
WITH d AS (
  SELECT row, doc_id, t, count(*) AS tf FROM ({_term_rows("documents", "doc_id")}) GROUP BY ALL),
i AS (SELECT DISTINCT row AS item, item_id, t FROM ({_term_rows("benchmark", "item_id")})),
sizes AS (SELECT row, sum(tf) AS n FROM d GROUP BY row),
whole AS (SELECT count(*) AS n_docs, sum(n) AS n_terms FROM sizes),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM d, whole GROUP BY t, n_docs),
scored AS (
  SELECT item, item_id, row, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT)
      AS score
  FROM i JOIN d USING (t) JOIN weights USING (t) JOIN sizes USING (row), whole
  GROUP BY item, item_id, row, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=32)


# SQL has no eigenvectors; tests compare with a brute-force version.
