"""From raw documents to packed sequences.

STAGES lists the steps in order. Each takes the documents that the one before it kept and
returns documents with the same columns; the last one returns the pieces of the packed
sequences. Tables are written between the steps, so each starts from files.

In every step a null text counts as empty, texts are taken whole however long they are,
further columns pass through all steps but the last, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import exact_dedup, near_dup, packing, suffix_dedup, toxicity
from footfall.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores below 0.7, by a lexicon learned from the
    labels that are not held out. An empty text is clean; rows of one id are scored each, and
    a row without an id is scored like any other, but learned from by no label."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return toxicity.without_toxic(docs, toxicity.learn(docs, labels.where(~held_out)), threshold=0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id. Empty texts are equal; rows that repeat
    that id with its text all stay; a row without an id stays only where no equal one has one."""
    return exact_dedup.without_copies(docs, keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 of five-word shingles, that
    with the smallest id. Texts without words are linked with nothing and stay."""
    return near_dup.without_near_copies(docs, shingle=5, percent=80)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes that a document with a smaller id has. Every document
    stays, with what is left of its text."""
    return suffix_dedup.without_repeats(docs, match=50)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens. Each row is packed, also one that repeats an id or
    has none; an empty text is its end token."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, path, size=4096, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("suffix dedup", drop_passages),
    ("packing", pack_sequences),
]

# The first step learns a model, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
