"""Five stages from raw documents to packed training sequences.

Defined cases, for every stage: null text counts as empty, and an empty document is
kept until the mix, which draws no document without words; a null id is an id of its
own, never preferred to another; repeated rows are one exact copy; very long texts are
read whole; ties go to the largest id among exact copies and to the smallest among near
copies; an empty table gives an empty result; extra columns are carried through
whatever their names (the last stage drops them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelode.llm import exact_dedup, mixing, packing, shingle_join, toxicity
from pagelode.llm.storage import discard, materialize, small_batches, with_read_order

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier does not reject."""
    small_batches(spark)
    return toxicity.ordinary_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles."""
    small_batches(spark)
    return shingle_join.one_of_each(docs, width=5, num=4, den=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix draws, whole, once for each pass that draws them, in training order."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, position, pass, sequence_id, offset.

    The mix is written in training order, so ``position`` (from 0) is a document's place in
    the curriculum. A document that is drawn twice has two places; ``pass`` (from 0) counts
    them by id, null where a document has none. Extra columns of the input with these names are left out.
    """
    small_batches(spark)
    placed = with_read_order(docs.select("doc_id", "text"), "position")
    packed = packing.packed_documents(placed, keep=("position",))
    # rows without an id are groups of their own
    draws = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("position"))).orderBy("position")
    nth = F.when(F.col("doc_id").isNotNull(), F.dense_rank().over(draws) - 1)
    return packed.withColumn("pass", nth).select("doc_id", "piece", "start", "length", "ids_crc32", "position", "pass", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: a trained classifier, components of a similarity join and a tokenizer are not expressible.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
