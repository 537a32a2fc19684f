"""Corpus-wide search: text searches read an index, vector searches read pivot shards.

A search without an index builds one for itself, which takes the only pass over the texts
(:mod:`.index`) or vectors (:mod:`.vectors`); blocks of questions, and all searches that
share the index, read its shards. Only the ``k`` best of each question and task travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .index import QUESTIONS, VOCABULARY, TextIndex


def search(queries: DataFrame, items: DataFrame, method: str, k: int, block: int = QUESTIONS, vocabulary: int = VOCABULARY, index: TextIndex | None = None) -> DataFrame:
    """query_id, scope, item, ord, score: at least the k best items of every question among those with a score.

    ``queries``: query_id, question (``vector`` for dense); ``items``: item, ord, score_text (``vector`` for dense).
    Items and queries without a vector are left out of dense search.
    """
    if method == "dense":
        found = vectors.search(queries, items, k, block)
    else:
        found = (index or TextIndex.build(items)).search(queries, method, k, block, vocabulary)
    names = items.schema["item"].dataType.simpleString()
    return found.select("query_id", F.lit("").alias("scope"), F.col("item").cast(names).alias("item"), "ord", "score")
