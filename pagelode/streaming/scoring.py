"""Questions that arrive as a stream, scored against a kept index of pages or nodes.

A question's hits depend on the index and the question alone, so micro-batches need no
state. Each micro-batch begins with the index as it then is: versions that items were
appended to or removed from in between are taken up without a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import retrieval as rt
from ..operators import scoring as sc
from ..operators.index import TextIndex


def bm25_index(items: DataFrame, path: str | None = None) -> TextIndex:
    """The index of items, below a folder of a shared file system."""
    return TextIndex.build(items, path)


def search(index: TextIndex, items: DataFrame, questions: DataFrame, k: int = 10, method: str = "bm25") -> DataFrame:
    """HITS of questions (query_id, question) from an index; ``items`` give the texts to show."""
    found = sc.corpus_top_k(questions.select("query_id", "question"), items, method, k, index=index)
    return rt.as_hits(found, items, method)


def score_stream(questions: DataFrame, index: TextIndex, items: DataFrame | Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, k: int = 10) -> StreamingQuery:
    """Start scoring a stream of questions (query_id, question); ``write`` gets each batch's hits and its number.

    ``items`` may be a function, called for each batch, where items change with the index.
    """

    def each(batch: DataFrame, number: int) -> None:
        write(search(index.latest(), items() if callable(items) else items, batch, k), number)

    return questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
