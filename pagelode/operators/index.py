"""An inverted index that is written once, read by every search, and grows by versions.

The texts are read once: a task gathers its items into shards of at most ``SHARD_ITEMS``
items, up to the one that reaches ``SHARD_POSTINGS`` tokens, and writes one row a shard, with its items, their
sizes, the sorted hashes of its tokens and their postings in blocks of ``BLOCK``. A block
stores its highest frequency and its least size. BM25 grows with the one and falls with the
other, so the two bound a block's weight whatever the corpus statistics are, and a new
version leaves old shards as they are. Postings are never shuffled.

A version is a folder with the shards it adds (or the places of the items it removes) and
the changes of token frequencies and sizes that go with them; statistics are sums over
versions. A version counts once its marker file is there, which comes by one rename, so
readers see whole versions, and a search that runs keeps the version it began with.

``search`` takes questions in blocks. A task looks up a question's lists in a shard, adds
the bounds of their blocks over the items between block edges, scores the items with the
highest bounds first, and then only the blocks that hold an item whose bound reaches the
``k``-th best score of the question so far. What falls below is left out only if it is
below by more than ranking resolves, so results do not depend on shards.

TF-IDF needs the norm of every item, over all of its tokens: frequencies of the
``vocabulary`` most frequent tokens are broadcast; what they leave out is joined by token
and summed per item. Norms belong to a version and are written once for it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import files
from ..store import by_shuffle, folder, materialize, release_memory

K1, B = 1.5, 0.75
SHARD_ITEMS, SHARD_POSTINGS, BLOCK = 4096, 1_000_000, 64
#: Questions of a block, tokens in a broadcast vocabulary, removed items and asked documents in a broadcast.
QUESTIONS, VOCABULARY, BROADCAST = 1000, 1_000_000, 200_000
#: Ranking rounds to nine digits; bounds get this much more.
SLACK = 2e-9
_SHARD = "shard string, item array<string>, doc array<string>, ord array<long>, size array<int>, token array<long>, df array<int>, at array<int>, tf array<int>, block_tf array<int>, block_size array<int>"
_TOKENS = "token long, df long, size long"
_FOUND = "question long, item string, ord long, score double, blocks long, read long"


def hashed_tokens(text: Column) -> Column:
    return F.transform(tx.tokens(text), lambda t: F.xxhash64(t))


def ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges that begin at ``begin``, and the range of each."""
    which = np.repeat(np.arange(len(begin)), size)
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size), which


def places(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Each wanted value's place among sorted ones, -1 if it is not there."""
    if not len(sorted_values):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[at] == wanted, at, -1)


def inverse_frequency(n: float, df):
    """Smoothed, for TF-IDF."""
    return np.log((n + 1) / (df + 1)) + 1


class _Gathered:
    """Items that become a shard."""

    def __init__(self) -> None:
        self.batches: list[pa.RecordBatch] = []
        self.items = self.tokens = 0

    def take(self, batch: pa.RecordBatch, at: int, ends: np.ndarray) -> int:
        """Add items of the batch from place ``at`` on until there are enough; ``ends``: tokens up to each item's end. The place after them."""
        before = ends[at - 1] if at else 0
        fit = int(np.searchsorted(ends, before + SHARD_POSTINGS - self.tokens)) + 1
        end = min(batch.num_rows, at + SHARD_ITEMS - self.items, fit)
        self.batches.append(batch.slice(at, end - at))
        self.items += end - at
        self.tokens += int(ends[end - 1] - before)
        return end

    @property
    def full(self) -> bool:
        return self.items >= SHARD_ITEMS or self.tokens >= SHARD_POSTINGS

    def row(self, name: str) -> pa.RecordBatch:
        """One row (columns item, doc, ord, tokens of the batches), items in their order, postings by token and item."""
        table = pa.Table.from_batches(self.batches).sort_by("ord").combine_chunks()
        lists = table.column("tokens").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        token = lists.flatten().to_numpy(zero_copy_only=False)
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(size), dtype=np.int32), size)
        order = np.argsort(token, kind="stable")  # items are in order already
        token, at = token[order], at[order]
        first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (at[1:] != at[:-1])]) if len(token) else np.zeros(0, int)
        tf, token, at = np.diff(np.r_[first, len(token)]), token[first], at[first]
        tokens, df = np.unique(token, return_counts=True)
        edge = np.flatnonzero(_in_list(df) % BLOCK == 0)
        columns = [[name], table.column("item"), table.column("doc"), table.column("ord"), size, tokens, df, at, tf]
        columns += [np.maximum.reduceat(tf, edge), np.minimum.reduceat(size[at], edge)] if len(edge) else [tf, tf]
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 5)
        arrays = [pa.array([name])]
        for values, kind in zip(columns[1:], types[1:], strict=True):
            values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else pa.array(values, kind)
            values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind)))
        return pa.RecordBatch.from_arrays(arrays, ["shard", "item", "doc", "ord", "size", "token", "df", "at", "tf", "block_tf", "block_size"])


def _in_list(df: np.ndarray) -> np.ndarray:
    """The place of every posting in its list."""
    return np.arange(df.sum()) - np.repeat(np.cumsum(df) - df, df)


def _shards(items: DataFrame, version: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, no, part = _Gathered(), 0, TaskContext.get().partitionId()
        for batch in batches:
            ends, at = np.cumsum(batch.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), 0
            while at < batch.num_rows:
                at = held.take(batch, at, ends)
                if held.full:
                    yield held.row(f"{version}-{part}-{no}")
                    held, no = _Gathered(), no + 1
        if held.items:
            yield held.row(f"{version}-{part}-{no}")
        held.batches.clear()
        release_memory()

    doc = F.col("doc_id").cast("string") if "doc_id" in items.columns else F.lit(None).cast("string")
    rows = items.select(F.col("item").cast("string").alias("item"), doc.alias("doc"), F.col("ord").cast("long").alias("ord"), hashed_tokens(F.col("score_text")).alias("tokens"))
    return rows.mapInArrow(run, _SHARD)


class Shard:
    """A row as arrays."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        get = lambda n: batch.column(batch.schema.get_field_index(n))[row].values
        number = lambda n: get(n).to_numpy(zero_copy_only=False)
        names = batch.schema.names
        self.items = get("item") if "item" in names else None
        self.ord, self.size, self.token, self.df, self.at, self.tf = (number(n) for n in ("ord", "size", "token", "df", "at", "tf"))
        self.first = np.cumsum(self.df) - self.df
        self.blocks = -(-self.df // BLOCK)
        self.first_block = np.cumsum(self.blocks) - self.blocks
        self.block_tf, self.block_size = number("block_tf"), number("block_size")
        self.dead = np.zeros(0, np.int64)
        if "dead" in names and batch.column(batch.schema.get_field_index("dead"))[row].is_valid:
            self.dead = number("dead")

    def block_edges(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the lists' blocks: number, list (its place in ``lists``), first posting, postings."""
        block, which = ranges(self.first_block[lists], self.blocks[lists])
        own = lists[which]
        begin = self.first[own] + (block - self.first_block[own]) * BLOCK
        return block, which, begin, np.minimum(BLOCK, self.first[own] + self.df[own] - begin)


class Best:
    """The k best (score rounded to nine digits, then ord) items of every question."""

    def __init__(self, questions: int, k: int):
        self.k, self.rows = k, [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object))] * questions
        #: Blocks of asked lists, and those that were read.
        self.blocks = self.read = 0

    def full(self, question: int) -> bool:
        return len(self.rows[question][0]) >= self.k

    def threshold(self, question: int) -> float:
        return self.rows[question][0][-1] - SLACK if self.full(question) else 0.0

    def keep(self, question: int, score: np.ndarray, ords: np.ndarray, items: np.ndarray) -> None:
        held = self.rows[question]
        score, ords, items = np.r_[held[0], score], np.r_[held[1], ords], np.concatenate([held[2], items])
        order = np.lexsort((ords, -np.floor(score * 1e9 + 0.5)))[: self.k]
        self.rows[question] = score[order], ords[order], items[order]

    def visit(self, shard: Shard, question: int, lists: np.ndarray, weight: np.ndarray, value, bound) -> None:
        """``value`` and ``bound`` give what a unit of weight adds, of postings and of blocks."""
        block, which, begin, size = shard.block_edges(lists)
        high = bound(shard, block, begin, size) * weight[which]
        self.blocks += len(block)
        n = len(shard.ord)
        step = np.bincount(shard.at[begin], high, n + 1) - np.bincount(shard.at[begin + size - 1] + 1, high, n + 1)
        most = np.cumsum(step)[:n] + SLACK
        most[shard.dead] = 0
        if not self.full(question) and n > 4 * self.k:
            top = np.argpartition(-most, 4 * self.k)[: 4 * self.k]
            self._score(shard, question, begin, size, weight[which], value, np.isin(np.arange(n), top) & (most > SLACK))
            most[top] = 0
        self._score(shard, question, begin, size, weight[which], value, (most > SLACK) & (most >= self.threshold(question)))

    def _score(self, shard: Shard, question: int, begin: np.ndarray, size: np.ndarray, weight: np.ndarray, value, live: np.ndarray) -> None:
        live[shard.dead] = False
        passed = np.r_[0, np.cumsum(live)]
        touched = passed[shard.at[begin + size - 1] + 1] > passed[shard.at[begin]] if len(begin) else np.zeros(0, bool)
        self.read += int(touched.sum())
        if not touched.any():
            return
        posting, which = ranges(begin[touched], size[touched])
        inside = live[shard.at[posting]]
        posting, which = posting[inside], which[inside]
        score = np.bincount(shard.at[posting], value(shard, posting) * weight[touched][which], len(live))
        hit = np.flatnonzero((score > 0) & (score >= self.threshold(question)))
        if len(hit):
            items = np.array(shard.items.take(pa.array(hit)).to_pylist(), object)
            self.keep(question, score[hit], shard.ord[hit], items)

    def batches(self) -> Iterator[pa.RecordBatch]:
        rows = [(q, *r) for q, (score, ords, items) in enumerate(self.rows) for r in zip(items, ords.tolist(), score.tolist(), strict=True)]
        q, x, o, s = zip(*rows, strict=True) if rows else ((), (), (), ())
        counts = [pa.array([n] + [0] * (len(q) - 1), pa.int64()) if q else pa.array([], pa.int64()) for n in (self.blocks, self.read)]
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(x, pa.string()), pa.array(o, pa.int64()), pa.array(s, pa.float64()), *counts], ["question", "item", "ord", "score", "blocks", "read"])


def question_blocks(queries: DataFrame, size: int) -> Iterator[list[Row]]:
    """Questions in blocks of bounded size, in the order of their ids."""
    held: list[Row] = []
    for row in queries.orderBy("query_id").toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _terms(rows: list[Row]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(tokens, times) of every question."""
    return [np.unique(np.array(row["tokens"], np.int64), return_counts=True) for row in rows]


@dataclass
class TextIndex:
    """An index at a version; changes give another object and leave this one as it is."""

    spark: SparkSession
    path: str
    version: int

    @classmethod
    def build(cls, items: DataFrame, path: str | None = None) -> TextIndex:
        """Index items (item, ord, score_text; doc_id for searches inside a document) below a folder of a shared file system."""
        spark = items.sparkSession
        return cls(spark, path or folder(spark, "index"), -1).append(items)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TextIndex:
        """The last whole version below a folder."""
        found = [int(n.removesuffix(".json")) for n in files.names(spark, f"{path}/versions") if n.endswith(".json") and n[0] != "."]
        if not found:
            raise FileNotFoundError(f"no index version below {path}")
        return cls(spark, path, max(found))

    def latest(self) -> TextIndex:
        """This index as it is now; the same object if nothing came."""
        now = TextIndex.open(self.spark, self.path)
        return self if now.version == self.version else now

    def _folder(self, version: int, kind: str) -> str:
        return f"{self.path}/{version}/{kind}"

    def _commit(self, kind: str) -> TextIndex:
        version = self.version + 1
        files.write_text(self.spark, f"{self.path}/versions/{version}.json", json.dumps({"kind": kind}))
        return TextIndex(self.spark, self.path, version)

    def append(self, items: DataFrame) -> TextIndex:
        """The next version, with more items; their statistics come from the shards just written."""
        version = self.version + 1
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
        _shards(items, version).write.mode("overwrite").parquet(self._folder(version, "shards"))
        self._changes(self._read([version], "shards", _SHARD), version, 1)
        return self._commit("append")

    def remove(self, items: DataFrame) -> TextIndex:
        """The next version, without some items (column item); their statistics are taken back exactly."""
        version = self.version + 1
        gone = items.select(F.col("item").cast("string").alias("gone")).distinct()
        where = self.shards().select("shard", "dead", F.posexplode("item").alias("at", "item"))
        where = where.where(~F.coalesce(F.array_contains("dead", F.col("at")), F.lit(False))).join(gone, F.col("item") == F.col("gone"), "left_semi")
        where.groupBy("shard").agg(F.sort_array(F.collect_list("at")).alias("dead")).write.mode("overwrite").parquet(self._folder(version, "removed"))
        now = self._read([version], "removed", "shard string, dead array<int>").withColumnRenamed("dead", "only")
        self._changes(self._with_few(self._read(self._versions("append"), "shards", _SHARD), now, "only", "inner"), version, -1)
        return self._commit("remove")

    def _changes(self, shards: DataFrame, version: int, sign: int) -> None:
        """Write token frequencies and, under the null token, items and tokens of the shards (or of the places ``only``)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    shard = Shard(batch, row)
                    df, items, size = shard.df, len(shard.ord), int(shard.size.sum())
                    if "only" in batch.schema.names:
                        only = np.zeros(items, bool)
                        only[batch.column(batch.schema.get_field_index("only"))[row].values.to_numpy()] = True
                        df = np.bincount(np.repeat(np.arange(len(df)), df)[only[shard.at]], minlength=len(df))
                        items, size = int(only.sum()), int(shard.size[only].sum())
                    some = df > 0
                    token = pa.concat_arrays([pa.array(shard.token[some], pa.int64()), pa.nulls(1, pa.int64())])
                    counts = [pa.array(np.r_[x, y] * sign, pa.int64()) for x, y in ((df[some], items), (np.zeros(some.sum(), int), size))]
                    yield pa.RecordBatch.from_arrays([token, *counts], ["token", "df", "size"])

        sums = shards.drop("item", "doc").mapInArrow(run, _TOKENS).groupBy("token").agg(F.sum("df").alias("df"), F.sum("size").alias("size"))
        sums.write.mode("overwrite").parquet(self._folder(version, "tokens"))

    def _versions(self, kind: str) -> list[int]:
        return [v for v in range(self.version + 1) if self._kinds[v] == kind]

    @cached_property
    def _kinds(self) -> list[str]:
        return [json.loads(files.read_text(self.spark, f"{self.path}/versions/{v}.json"))["kind"] for v in range(self.version + 1)]

    def _read(self, versions: list[int], kind: str, schema: str) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], schema)
        # rows are large: they are read and sent to the workers one after another
        self.spark.conf.set("spark.sql.parquet.enableNestedColumnVectorizedReader", "false")
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
        return self.spark.read.schema(schema).parquet(*(self._folder(v, kind) for v in versions))

    def _with_few(self, shards: DataFrame, places_: DataFrame, name: str, how: str) -> DataFrame:
        """Shards with the places of some items; the places are broadcast while they are few."""
        places_ = places_.groupBy("shard").agg(F.flatten(F.collect_list(name)).alias(name))
        few = (places_.agg(F.sum(F.size(name))).first()[0] or 0) <= BROADCAST
        return shards.join(F.broadcast(places_) if few else places_, "shard", how)

    def shards(self) -> DataFrame:
        """All shards, with the places of removed items in ``dead``."""
        found, removed = self._read(self._versions("append"), "shards", _SHARD), self._versions("remove")
        if not removed:
            return found.withColumn("dead", F.lit(None).cast("array<int>"))
        return self._with_few(found, self._read(removed, "removed", "shard string, dead array<int>"), "dead", "left")

    def statistics(self) -> DataFrame:
        """(token, df, size): frequencies of all tokens, and under the null token the number of items and of their tokens."""
        changes = self._read(list(range(self.version + 1)), "tokens", _TOKENS)
        return changes.groupBy("token").agg(F.sum("df").alias("df"), F.sum("size").alias("size")).where("df > 0")

    @cached_property
    def total(self) -> tuple[int, float]:
        """Items, and their mean number of tokens."""
        row = self.statistics().where("token is null").first()
        return (row["df"], max(row["size"] / row["df"], 1e-9)) if row else (0, 1.0)

    def frequencies(self, tokens: list[int]) -> dict[int, int]:
        """Of asked tokens (those of a block of questions)."""
        asked = self.spark.createDataFrame([(t,) for t in tokens], "token long")
        return {r["token"]: r["df"] for r in self.statistics().join(F.broadcast(asked), "token").collect()}

    def alike(self, queries: DataFrame, method: str) -> DataFrame:
        """query_id, head: questions with the same known tokens have the same scores, so the one with the least id can be searched for all of them.

        For TF-IDF unknown tokens must be as many too, as they lengthen a question's vector. Questions without a known token find nothing and are left out.
        """
        asked = queries.select("query_id", F.explode(hashed_tokens(F.col("question"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
        known = self.statistics().select(F.col("token").alias("known")).where("known is not null")
        rows = by_shuffle(asked).join(by_shuffle(known), F.col("token") == F.col("known"), "left")
        rows = rows if method != "bm25" else rows.where("known is not null")
        terms = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("known", "times"))).alias("terms"))
        terms = materialize(terms.where(F.exists("terms", lambda t: t["known"].isNotNull())), "terms")
        heads = materialize(terms.groupBy("terms").agg(F.min("query_id").alias("head")), "heads")
        heads = F.broadcast(heads) if heads.limit(QUESTIONS + 1).count() <= QUESTIONS else by_shuffle(heads)
        return materialize(terms.join(heads, "terms").select("query_id", "head"), "alike")

    def search(self, queries: DataFrame, method: str, k: int, block: int = QUESTIONS, vocabulary: int = VOCABULARY) -> DataFrame:
        """query_id, item, ord, score, blocks, read: the k best items of every question (query_id, question) among those with a score.

        ``blocks`` and ``read`` are zero but for one row a task: blocks of asked lists and blocks that were read.
        """
        kind, out = queries.schema["query_id"].dataType.simpleString(), None
        asked = queries.select("query_id", hashed_tokens(F.col("question")).alias("tokens"))
        for rows in question_blocks(asked, block):
            found = self._bm25(rows, k) if method == "bm25" else self._tfidf(rows, k, vocabulary)
            ids = self.spark.createDataFrame([(no, r["query_id"]) for no, r in enumerate(rows)], f"question long, query_id {kind}")
            part = materialize(found.join(F.broadcast(ids), "question").drop("question"), "best")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], f"{_FOUND}, query_id {kind}").drop("question")

    def _bm25(self, rows: list[Row], k: int) -> DataFrame:
        terms = _terms(rows)
        df = self.frequencies(sorted({int(t) for tokens, _ in terms for t in tokens}))
        (n, mean), asked = self.total, []
        for tokens, times in terms:
            known = np.array([int(t) in df for t in tokens], bool)
            of = np.array([df[int(t)] for t in tokens[known]], float)
            asked.append((tokens[known], times[known] * np.log(1 + (n - of + 0.5) / (of + 0.5))))

        def weight(tf: np.ndarray, size: np.ndarray) -> np.ndarray:
            return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))

        def value(shard: Shard, posting: np.ndarray) -> np.ndarray:
            return weight(shard.tf[posting], shard.size[shard.at[posting]])

        def bound(shard: Shard, block: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
            return weight(shard.block_tf[block], shard.block_size[block])

        return self._scan(self.shards(), asked, k, lambda batch, row: (value, bound))

    def norms(self, vocabulary: int = VOCABULARY) -> DataFrame:
        """The shards with the norms of their items, written once for a version."""
        if vocabulary not in self._normed:
            self._normed[vocabulary] = materialize(self._norms(vocabulary), "norms")
        return self._normed[vocabulary]

    @cached_property
    def _normed(self) -> dict[int, DataFrame]:
        return {}

    def _norms(self, vocabulary: int) -> DataFrame:
        n, _ = self.total
        known = self.statistics().where("token is not null")
        whole = known.count() <= vocabulary
        arrow = (known if whole else known.orderBy(F.desc("df"), "token").limit(vocabulary)).select("token", "df").toArrow()
        token = arrow.column("token").to_numpy()
        order = np.argsort(token)
        shared = self.spark.sparkContext.broadcast((token[order], inverse_frequency(n, arrow.column("df").to_numpy()[order])))

        def parts(shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            tokens, idf = shared.value
            at = places(tokens, shard.token)
            each = np.where(at >= 0, idf[at], 0.0) if len(tokens) else np.zeros(len(at))
            share = shard.tf / shard.size[shard.at]
            w = share * np.repeat(each, shard.df)
            return np.bincount(shard.at, w * w, len(shard.ord)), np.flatnonzero(np.repeat(at < 0, shard.df)), share

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    shard = Shard(batch, row)
                    _, out, share = parts(shard)
                    name = pa.repeat(batch.column(batch.schema.get_field_index("shard"))[row], len(out))
                    token = np.repeat(shard.token, shard.df)[out]
                    yield pa.RecordBatch.from_arrays([name, pa.array(shard.at[out], pa.int32()), pa.array(token), pa.array(share[out])], ["shard", "at", "token", "share"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                norms = []
                for row in range(batch.num_rows):
                    squares, _, _ = parts(Shard(batch, row))
                    if batch.column(batch.schema.get_field_index("rare"))[row].is_valid:
                        for x in batch.column(batch.schema.get_field_index("rare"))[row].as_py():
                            squares[x["at"]] += x["square"]
                    norms.append(np.sqrt(squares))
                columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "rare"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(norms, pa.list_(pa.float64()))], [*(x for x in batch.schema.names if x != "rare"), "norm"])

        shards = self.shards()
        if whole:
            shards = shards.withColumn("rare", F.lit(None).cast("array<struct<at: int, square: double>>"))
        else:
            idf = F.ln((F.lit(n) + 1) / (F.col("df") + 1)) + 1
            found = shards.drop("item", "doc", "dead").mapInArrow(rare, "shard string, at int, token long, share double").join(known.select("token", "df"), "token")
            sums = found.withColumn("w", F.col("share") * idf).groupBy("shard", "at").agg(F.sum(F.col("w") * F.col("w")).alias("square"))
            shards = shards.join(sums.groupBy("shard").agg(F.collect_list(F.struct("at", "square")).alias("rare")), "shard", "left")
        names = [c for c in shards.columns if c != "rare"]
        schema = ", ".join(f"{c} {dict(shards.dtypes)[c]}" for c in names)
        return shards.select(*names, "rare").mapInArrow(add, f"{schema}, norm array<double>")

    def _tfidf(self, rows: list[Row], k: int, vocabulary: int) -> DataFrame:
        terms = _terms(rows)
        df, (n, _), asked = self.frequencies(sorted({int(t) for tokens, _ in terms for t in tokens})), self.total, []
        for tokens, times in terms:
            idf = inverse_frequency(n, np.array([df.get(int(t), 0) for t in tokens], float))
            vector = times / times.sum() * idf if len(tokens) else idf
            known = np.array([int(t) in df for t in tokens], bool)
            asked.append((tokens[known], (vector * idf / max(np.sqrt((vector * vector).sum()), 1e-300))[known] if len(tokens) else vector))

        def of(batch: pa.RecordBatch, row: int):
            norm = batch.column(batch.schema.get_field_index("norm"))[row].values.to_numpy()

            def value(shard: Shard, posting: np.ndarray) -> np.ndarray:
                at = shard.at[posting]
                return shard.tf[posting] / shard.size[at] / norm[at]

            def bound(shard: Shard, block: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
                posting, _ = ranges(begin, size)
                return np.maximum.reduceat(value(shard, posting), np.cumsum(size) - size) if len(begin) else np.zeros(0)

            return value, bound

        return self._scan(self.norms(vocabulary), asked, k, of)

    def _scan(self, shards: DataFrame, asked: list[tuple[np.ndarray, np.ndarray]], k: int, functions) -> DataFrame:
        """The best of every task."""
        shared = self.spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            questions = shared.value
            best = Best(len(questions), k)
            for batch in batches:
                for row in range(batch.num_rows):
                    shard = Shard(batch, row)
                    value, bound = functions(batch, row)
                    for question, (tokens, weight) in enumerate(questions):
                        lists = places(shard.token, tokens)
                        if (lists >= 0).any():
                            best.visit(shard, question, lists[lists >= 0], weight[lists >= 0], value, bound)
            yield from best.batches()
            release_memory()

        return shards.drop("doc").mapInArrow(run, _FOUND)

    def postings(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((scope, item, ord, size, token, tf), (scope, item, ord, size)) of the documents (doc_id) that are asked for."""
        asked = documents.select(F.col("doc_id").cast("string").alias("scope")).where("scope is not null").distinct()
        asked = materialize(asked, "asked_documents")
        few = asked.count() <= BROADCAST
        wanted = self.spark.sparkContext.broadcast(frozenset(r["scope"] for r in asked.collect()) if few else None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    shard = Shard(batch, row)
                    doc = np.array(batch.column(batch.schema.get_field_index("doc"))[row].as_py(), object)
                    live = np.array([d is not None and (wanted.value is None or d in wanted.value) for d in doc], bool)
                    live[shard.dead] = False
                    if not live.any():
                        continue
                    posting = np.flatnonzero(live[shard.at])
                    # an item without tokens has one row without a token
                    bare = np.flatnonzero(live & (shard.size == 0))
                    at = np.r_[shard.at[posting], bare]
                    token = pa.concat_arrays([pa.array(np.repeat(shard.token, shard.df)[posting]), pa.nulls(len(bare), pa.int64())])
                    tf = np.r_[shard.tf[posting], np.zeros(len(bare), int)]
                    index = pa.array(at)
                    columns = [pa.array(doc[at], pa.string()), shard.items.take(index), pa.array(shard.ord[at]), pa.array(shard.size[at], pa.int64()), token, pa.array(tf, pa.int64())]
                    yield from pa.Table.from_arrays(columns, names=["scope", "item", "ord", "size", "token", "tf"]).to_batches(max_chunksize=50_000)

        found = self.shards().mapInArrow(run, "scope string, item string, ord long, size long, token long, tf long")
        found = materialize(found if few else found.join(asked, "scope", "left_semi"), "postings")
        items = found.select("scope", "item", "ord", "size").distinct()
        return found.where("token is not null"), items
