"""Exact vector search that leaves out what cannot be among the best.

A task gathers its vectors into shards of at most ``SHARD`` vectors. In a shard, pivots are
chosen one after another, each the vector that is farthest from all before; every vector
belongs to its nearest pivot, and a cell keeps its members in the order of their angle to
the pivot, with the least and greatest angle and norm. Shards are written once and serve
all blocks of questions.

Angles obey the triangle inequality: a question at angle t from a pivot is at least
``max(0, t - greatest, least - t)`` from every member of the cell, so no product of the
question with a member exceeds the cosine of that, times the norms. A question first visits
its best cell of a shard; every other cell, in the order of bounds, is visited by the
questions whose bound reaches their ``k``-th best product, and of its members only those
whose own angle allows as much are multiplied. Bounds are widened by more than rounding can
move them, so results are those of all products.

With vectors that lie in no clusters, angles between them are all alike and little can be
left out; nothing is lost then but the products with pivots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..store import materialize
from .index import QUESTIONS, SLACK, question_blocks

#: Vectors of a shard, its most pivots, and by how much angles are widened.
SHARD, PIVOTS, WIDER = 4096, 64, 1e-6
_SHARD = "item array<string>, ord array<long>, vector array<double>, angle array<double>, cell array<int>, pivot array<double>"
_FOUND = "question long, item string, ord long, score double, pairs long, products long"


def pivots_of(unit: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the pivots, each row's pivot (its place among them) and cosine to it."""
    zero = ~unit.any(axis=1)  # has no angle; its products are 0 whatever bound it has
    chosen, owner = [int(zero.argmin())], np.zeros(len(unit), int)
    best = np.where(zero, 1.0, unit @ unit[chosen[0]])
    while len(chosen) < most:
        far = int(best.argmin())
        if best[far] > 1 - 1e-9:
            break
        cosine = unit @ unit[far]
        nearer = cosine > best
        owner[nearer], best[nearer] = len(chosen), cosine[nearer]
        chosen.append(far)
    return np.array(chosen), owner, best


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return vectors / np.where(norm > 0, norm, 1)[:, None], norm


def _row(items: list[str], ords: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    """A shard as one row: members by cell and angle."""
    unit, _ = _unit(vectors)
    pivot, owner, cosine = pivots_of(unit, min(PIVOTS, max(1, int(np.sqrt(len(unit))))))
    angle = np.arccos(np.clip(cosine, -1, 1))
    order = np.lexsort((angle, owner))
    columns = (np.array(items, object)[order].tolist(), ords[order], vectors[order].ravel(), angle[order], np.bincount(owner, minlength=len(pivot)), unit[pivot].ravel())
    types = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.float64())
    arrays = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, t)) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["item", "ord", "vector", "angle", "cell", "pivot"])


def shards(items: DataFrame) -> DataFrame:
    """Items (item, ord, vector) as written shards; vectors of one length each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[list[str], np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, dim)
                for at in range(0, part.num_rows, SHARD):
                    few = part.slice(at, SHARD)
                    held.setdefault(dim, []).append((few.column(0).to_pylist(), few.column(1).to_numpy(), flat[at : at + SHARD]))
                    if sum(len(x) for x, _, _ in held[dim]) >= SHARD:
                        yield _joined(held.pop(dim))
        for parts in held.values():
            yield _joined(parts)

    rows = items.where("vector is not null").select(F.col("item").cast("string").alias("item"), F.col("ord").cast("long").alias("ord"), F.col("vector").cast("array<double>").alias("vector"))
    return materialize(rows.mapInArrow(run, _SHARD), "vectors")


def _joined(parts: list[tuple[list[str], np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return _row([i for x, _, _ in parts for i in x], np.concatenate([o for _, o, _ in parts]), np.concatenate([v for _, _, v in parts]))


class Nearest:
    """The k best (score rounded to nine digits, then ord) items of each question."""

    def __init__(self, questions: np.ndarray, k: int):
        self.k, self.questions = k, questions
        self.unit, self.norm = _unit(questions)
        self.least = np.full(len(questions), -np.inf)
        self.rows = [np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)]
        #: Pairs of questions and vectors, and products that were made, those with pivots included.
        self.pairs = self.products = 0

    def add(self, asked: np.ndarray, scores: np.ndarray, ords: np.ndarray, items: np.ndarray) -> None:
        """Scores (members, asked questions)."""
        i, q = np.nonzero(scores >= self.least[asked] - SLACK)
        if not len(i):
            return
        s = scores[i, q]
        q, r, o, x, s = (np.concatenate(p) for p in zip(self.rows, (asked[q], np.floor(s * 1e9 + 0.5), ords[i], items[i], s), strict=True))
        order = np.lexsort((o, -r, q))
        sorted_q = q[order]
        first = np.flatnonzero(np.r_[True, sorted_q[1:] != sorted_q[:-1]])
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        kept = order[rank < self.k]
        self.rows = [a[kept] for a in (q, r, o, x, s)]
        last = order[rank == self.k - 1]
        self.least[q[last]] = s[last]

    def visit(self, items: np.ndarray, ords: np.ndarray, vectors: np.ndarray, angle: np.ndarray, cell: np.ndarray, pivot: np.ndarray) -> None:
        """One shard."""
        end = np.cumsum(cell)
        begin = end - cell
        norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        low, high = np.minimum.reduceat(norm, begin), np.maximum.reduceat(norm, begin)
        turn = np.arccos(np.clip(self.unit @ pivot.T, -1, 1))
        self.pairs += len(self.questions) * len(vectors)
        self.products += turn.size
        gap = np.maximum(0, np.maximum(turn - angle[end - 1], angle[begin] - turn) - WIDER)
        cosine = np.cos(np.minimum(gap, np.pi))
        bound = self.norm[:, None] * cosine * np.where(cosine >= 0, high, low) + SLACK
        first, open_ = bound.argmax(axis=1), np.ones(bound.shape, bool)
        open_[np.arange(len(first)), first] = False
        for c in np.unique(first):
            self._multiply(np.flatnonzero(first == c), slice(begin[c], end[c]), items, ords, vectors)
        for c in np.argsort(-bound.max(axis=0), kind="stable"):
            asked = np.flatnonzero(open_[:, c] & (bound[:, c] >= self.least - SLACK))
            if len(asked):
                # members farther from the pivot than the question by more than its reach, or nearer, are out
                most = np.maximum(self.norm[asked] * high[c], 1e-300)
                reach = np.where(self.least[asked] > 0, np.arccos(np.clip((self.least[asked] - 2 * SLACK) / most, -1, 1)), np.pi) + WIDER
                own = angle[begin[c] : end[c]]
                a = np.searchsorted(own, (turn[asked, c] - reach).min(), "left")
                b = np.searchsorted(own, (turn[asked, c] + reach).max(), "right")
                self._multiply(asked, slice(begin[c] + a, begin[c] + b), items, ords, vectors)

    def _multiply(self, asked: np.ndarray, part: slice, items: np.ndarray, ords: np.ndarray, vectors: np.ndarray) -> None:
        self.products += len(asked) * (part.stop - part.start)
        self.add(asked, vectors[part] @ self.questions[asked].T, ords[part], items[part])

    def batch(self) -> pa.RecordBatch:
        q, _, o, x, s = self.rows
        counts = [pa.array([n] + [0] * (len(q) - 1) if len(q) else [], pa.int64()) for n in (self.pairs, self.products)]
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(x.tolist(), pa.string()), pa.array(o, pa.int64()), pa.array(s, pa.float64()), *counts], ["question", "item", "ord", "score", "pairs", "products"])


def _block(shards_: DataFrame, rows: list[Row], k: int) -> DataFrame:
    spark = shards_.sparkSession
    by_length: dict[int, list[int]] = {}
    for no, r in enumerate(rows):
        by_length.setdefault(len(r["vector"]), []).append(no)
    shared = spark.sparkContext.broadcast({d: (np.array(nos), np.array([rows[n]["vector"] for n in nos], float)) for d, nos in by_length.items() if d})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Nearest(v, k) for d, (_, v) in shared.value.items()}
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda n: batch.column(batch.schema.get_field_index(n))[row].values  # noqa: B023, E731
                items = np.array(get("item").to_pylist(), object)
                ords, flat, angle, cell, pivot = (get(n).to_numpy() for n in ("ord", "vector", "angle", "cell", "pivot"))
                if found := best.get(len(flat) // len(items)):
                    found.visit(items, ords, flat.reshape(len(items), -1), angle, cell, pivot.reshape(len(cell), -1))
        for d, found in best.items():
            batch = found.batch()
            yield batch.set_column(0, "question", pa.array(shared.value[d][0][batch.column(0).to_numpy()], pa.int64()))

    return shards_.mapInArrow(run, _FOUND)


def search(queries: DataFrame, items: DataFrame, k: int, block: int = QUESTIONS, written: DataFrame | None = None) -> DataFrame:
    """query_id, item, ord, score, pairs, products: the k items with the greatest products of every question.

    ``queries``: query_id, vector; ``items``: item, ord, vector (or ``written`` shards of them). Rows without a
    vector are left out, and vectors meet vectors of their own length. ``pairs`` and ``products`` are zero but
    for one row a task.
    """
    spark = items.sparkSession
    spark.conf.set("spark.sql.parquet.enableNestedColumnVectorizedReader", "false")  # rows are large
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    found = written if written is not None else shards(items)
    name, kind, out = items.schema["item"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString(), None
    for rows in question_blocks(queries.where("vector is not null").select("query_id", "vector"), block):
        ids = spark.createDataFrame([(no, r["query_id"]) for no, r in enumerate(rows)], f"question long, query_id {kind}")
        part = _block(found, rows, k).join(F.broadcast(ids), "question")
        part = materialize(part.select("query_id", F.col("item").cast(name).alias("item"), "ord", "score", "pairs", "products"), "best")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"query_id {kind}, item {name}, ord long, score double, pairs long, products long")
