"""From documents to mixed, clean token files, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept:

1. documents predicted toxic go (the model is fitted to the labels of sf_dir),
2. of each group of near duplicates the document with the smallest doc_id stays,
3. documents that contain a benchmark item go,
4. sources are interleaved to their target weights: all rows stay, the files hold
   them in the mixed order,
5. token files are written in that order and read back: doc_id, start, n_tokens,
   ids_crc32.

Stages 1 to 4 return the columns they were given. `run` writes each result to the
shared folder and reads it again, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from absentia.llm import decontamination, mixing, simhash, token_files, toxicity
from absentia.llm.queries import END_ID, TOKENIZER
from absentia.llm.texts import table
from absentia.sources.storage import settle


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_per_group(docs, shingle=3, distance=2)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def _as_written(docs: DataFrame) -> Column | None:
    """The order in which rows were written, if docs was read from files; else None,
    and the order is that of doc_id."""
    try:
        file = docs["_metadata.file_name"]
        # By number: as text part-100000 would come before part-99999.
        part = F.regexp_extract(file, r"^part-(\d+)", 1).try_cast("long")
        place = F.struct(part.alias("part"), file.alias("file"), docs["_metadata.row_index"].alias("row"))
        docs.select(place)
    except AnalysisException:
        return None
    return place


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    frames = token_files.write_tokens(docs, TOKENIZER, END_ID, order=_as_written(docs))
    return token_files.read_tokens(frames)


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

# Tokens can't be expressed in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
