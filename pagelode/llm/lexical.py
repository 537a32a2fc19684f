"""Ranked lexical search over shards with variable blocks and exact block skipping.

``write_index`` reads every text once, where it lies, and writes one row a shard (at most
``SHARD_DOCS`` documents or ``SHARD_POSTINGS`` postings): the documents, their sizes, all
terms and their postings. Postings are never shuffled. Sizes and frequencies of the whole
corpus are sums over shards, so they exist before any score does.

``search`` broadcasts a block of items (``ITEMS``, bounded) with the weights of their terms
and scans the shards once a block. In a shard the postings of an asked term are cut into
blocks by dynamic programming: a cut costs ``BLOCK_COST``, and a block costs the sum over
its postings of its highest value less the posting's own, which is what its bound overstates.
The least total is found for all lists of the shard side by side. An item then adds the
bounds of its terms' blocks over every stretch of documents between block edges. Stretches
are scored from the highest bound down until ``k`` documents give a threshold; of the rest
only stretches whose bound reaches it are read, and in those only documents for which the
bounds of the blocks that really hold them reach it. Thresholds live on from shard to shard
of a task. Bounds are kept by document, which are few in a shard, and all steps are numpy
over the item's blocks at once. A stretch is left out only if its bound is below the threshold, so ties are
complete and results do not depend on how the documents are dealt.

Values are 64-bit integers throughout; sums of bounds stay below 2^53.

Defined cases: a null text has no terms and counts nowhere; a null item or one without a
term that occurs finds nothing; repeated documents are ranked as documents of their own,
after smaller ids, a null id last; repeated items are answered each; texts of any length
are read whole, a long one as a batch of its own; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .storage import discard, materialize
from .text import LOWER_BYTES

SHARD_DOCS, SHARD_POSTINGS = 4096, 1_000_000
#: Items of a block, results of an item.
ITEMS, K = 1000, 50
#: What one more block costs, in the unit of a posting's value, and the longest block.
BLOCK_COST, LONGEST = 300_000, 64
#: Bytes that are no part of a term become blanks; A-Z become a-z.
_TERM_TABLE = np.array([LOWER_BYTES[b] if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_SHARD = "doc_id array<long>, n array<long>, terms array<string>, df array<int>, doc array<int>, tf array<int>"
_FOUND = "item long, doc_id long, score long"
#: Comes after every id.
_NO_ID = np.int64(2**63 - 1)


def terms_of(texts: pa.BinaryArray) -> tuple[np.ndarray, pa.Array]:
    """Of texts without nulls: the row of every term, and the terms."""
    texts = pa.concat_arrays([texts])  # without an offset
    _, offsets, data = texts.buffers()
    clean = pa.py_buffer(_TERM_TABLE[np.frombuffer(data, np.uint8)].tobytes()) if data else pa.py_buffer(b"")
    words = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), offsets, clean))
    row, word = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy()), words.flatten()
    filled = pc.not_equal(word, "")
    return row[filled.to_numpy(zero_copy_only=False)], word.filter(filled)


class _Numbers(dict):
    """Numbers for keys in the order of their first use."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class _Shard:
    """Postings of some documents, gathered one batch after another."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.n: list[np.ndarray] = []
        self.numbers = _Numbers()
        self.doc: list[np.ndarray] = []
        self.term: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []
        self.postings = 0

    def add(self, ids: list[int | None], texts: pa.BinaryArray) -> None:
        row, words = terms_of(texts)
        coded = words.dictionary_encode()
        numbers = np.fromiter(map(self.numbers.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        key = np.sort(row << 32 | numbers[coded.indices.to_numpy()]) if len(row) else np.zeros(0, np.int64)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        self.doc.append((key[begin] >> 32) + len(self.ids))
        self.term.append((key[begin] & (2**32 - 1)).astype(np.int32))
        self.tf.append(np.diff(np.concatenate([begin, [len(key)]])).astype(np.int32))
        self.n.append(np.bincount(row, minlength=len(ids)))
        self.ids += ids
        self.postings += len(begin)

    @property
    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def batch(self) -> pa.RecordBatch:
        """One row; postings by term, then by document, in the order of sizes, so that values of a list differ little from one to the next."""
        ids = np.array([_NO_ID if i is None else i for i in self.ids], np.int64)
        n = np.concatenate(self.n)
        order = np.lexsort((ids, n))
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        term, doc = np.concatenate(self.term), place[np.concatenate(self.doc)]
        by = np.lexsort((doc, term))
        df = np.bincount(term, minlength=len(self.numbers)).astype(np.int32)
        row = ([self.ids[i] for i in order], n[order], list(self.numbers), df, doc[by], np.concatenate(self.tf)[by])
        types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t)) for x, t in zip(row, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "df", "doc", "tf"])


def write_index(docs: DataFrame) -> DataFrame:
    """One row a shard, written: doc_id, n, terms and df (postings of each term), doc and tf of all postings."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Shard()
        for batch in batches:
            held.add(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()))
            if held.full:
                yield held.batch()
                held = _Shard()
        if held.ids:
            yield held.batch()

    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return materialize(rows.mapInArrow(shards, _SHARD), "lexical_shards")


def corpus_size(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    held = F.size(F.filter("n", lambda n: n > 0))
    row = index.agg(F.sum(held).alias("docs"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, n: a + n)).alias("terms")).first()
    return int(row["docs"] or 0), int(row["terms"] or 0)


def frequencies(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """Documents that hold each of the asked terms, summed over shards."""
    asked = index.sparkSession.sparkContext.broadcast(frozenset(terms))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for terms, df in zip(batch.column(0), batch.column(1), strict=True):
                wanted = asked.value
                total.update({t: n for t, n in zip(terms.as_py(), df.as_py(), strict=True) if t in wanted})
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["term", "df"])

    found = index.select("terms", "df").mapInArrow(sums, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in found.collect()}


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def posting_values(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a posting's weight is multiplied with."""
    if not len(tf):
        return np.zeros(0, np.int64)
    most = int(n.max()) * 50 * docs
    share = (n * (50 * docs)) // terms if most < 2**62 else np.array([int(x) * 50 * docs // terms for x in n], np.int64)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + share))


def block_ends(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cost: int = BLOCK_COST, longest: int = LONGEST) -> list[np.ndarray]:
    """For every list of ``values``, the ends of the blocks whose cost is least.

    The cost of blocks up to posting j is the least over the last block's size s of the cost
    up to j - s, ``cost`` and s times the block's highest value; the sum of all values is the
    same for every choice. All lists take the step to j together, the longest ones first.
    """
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    if not len(size) or not size[0]:
        return [np.zeros(0, np.int64)] * len(size)
    rows, s = len(size), np.arange(1, longest + 1)
    recent = np.full((rows, longest), np.iinfo(np.int64).max // 4)  # column t: least cost up to j - 1 - t
    recent[:, 0] = 0
    highest = np.zeros((rows, longest), np.int64)  # column t: highest of the last t + 1 values
    choice = np.zeros(int(size.sum()), np.int16)
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    for j in range(int(size[0])):
        m = active[j]
        v = values[begin[:m] + j]
        w = min(j + 1, longest)
        high = highest[:m]
        high[:, 1:w] = high[:, : w - 1]
        high[:, 0] = v
        np.maximum(high[:, :w], v[:, None], out=high[:, :w])
        total = recent[:m, :w] + s[:w] * high[:, :w]
        pick = total.argmin(axis=1)
        choice[at[:m] + j] = pick + 1
        recent[:m, 1:] = recent[:m, :-1]
        recent[:m, 0] = total[np.arange(m), pick] + cost
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * rows
    for no, (first, n) in enumerate(zip(at, size, strict=True)):
        ends, j = [], int(n)
        while j:
            ends.append(j)
            j -= int(choice[first + j - 1])
        out[order[no]] = np.array(ends[::-1], np.int64)
    return out


class Lists:
    """The asked lists of a shard: postings, and the blocks of every term."""

    def __init__(self, ids: np.ndarray, terms: list[int], doc: np.ndarray, value: np.ndarray, starts: np.ndarray, ends: list[np.ndarray]):
        self.ids, self.doc, self.value = ids, doc, value
        last = np.concatenate([a + e for a, e in zip(starts, ends, strict=True)]) if terms else np.zeros(0, np.int64)
        self.begin, self.end = np.concatenate([[0], last[:-1]]).astype(np.int64)[: len(last)], last
        self.high = np.maximum.reduceat(value, self.begin) if len(last) else value
        #: Documents of the shard that a block spans: from, to.
        self.from_, self.to = doc[self.begin], doc[self.end - 1] + 1
        counts = np.cumsum([0, *map(len, ends)])
        self.blocks = {t: (int(counts[i]), int(counts[i + 1])) for i, t in enumerate(terms)}


def shard_lists(row: dict, wanted: dict[str, int], docs: int, terms: int) -> Lists:
    """The asked lists of a shard, cut into blocks."""
    df = row["df"].astype(np.int64)
    first = np.cumsum(df) - df
    known = [(wanted[t], i) for i, t in enumerate(row["terms"]) if t in wanted]
    which = np.array([i for _, i in known], np.int64)
    lengths = df[which]
    starts = np.cumsum(lengths) - lengths
    take = np.arange(lengths.sum()) + np.repeat(first[which] - starts, lengths)
    doc = row["doc"][take]
    value = posting_values(row["tf"][take], row["n"][doc], docs, terms)
    return Lists(row["doc_id"], [t for t, _ in known], doc, value, starts, block_ends(value, starts, lengths))


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    sizes = end - begin
    which = np.repeat(np.arange(len(begin)), sizes)
    return np.arange(sizes.sum()) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes), which


class Search:
    """The best ``k`` of every item so far, over the shards that were visited."""

    def __init__(self, items: list[list[tuple[int, int]]], k: int = K):
        self.items, self.k = items, k
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        #: Postings of asked lists and those of blocks that were read; documents that hold a term, and those that were scored.
        self.postings = self.read = self.found = self.scored = 0

    def threshold(self, item: int) -> int:
        """Scores below are out."""
        scores = self.best[item][1]
        return max(1, int(scores[-1])) if len(scores) >= self.k else 1

    def _keep(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        held = self.best[item]
        ids, scores = np.concatenate([held[0], ids]), np.concatenate([held[1], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.best[item] = ids[order], scores[order]

    def visit(self, lists: Lists) -> None:
        for item, terms in enumerate(self.items):
            asked = [(*lists.blocks[t], w) for t, w in terms if w > 0 and t in lists.blocks]
            if asked:
                self._visit(item, lists, np.array(asked, np.int64))

    def _visit(self, item: int, lists: Lists, asked: np.ndarray) -> None:
        blocks, which = _ranges(asked[:, 0], asked[:, 1])
        weights = asked[which, 2]
        self.postings += int((lists.end[blocks] - lists.begin[blocks]).sum())
        high, n = lists.high[blocks] * weights, len(lists.ids)
        step = np.bincount(lists.from_[blocks], high, n + 1) - np.bincount(lists.to[blocks], high, n + 1)
        bound = np.cumsum(step)[:n]  # constant between block edges
        if len(self.best[item][1]) < self.k and n > 4 * self.k:
            first = np.argpartition(-bound, 4 * self.k)[: 4 * self.k]
            live = np.zeros(n, bool)
            live[first] = bound[first] > 0
            self._score(item, lists, blocks, weights, live)
            bound[first] = 0
        self._score(item, lists, blocks, weights, bound >= self.threshold(item))

    def _score(self, item: int, lists: Lists, blocks: np.ndarray, weights: np.ndarray, live: np.ndarray) -> None:
        passed = np.concatenate([[0], np.cumsum(live)])
        touched = passed[lists.to[blocks]] > passed[lists.from_[blocks]]
        blocks, weights = blocks[touched], weights[touched]
        if not len(blocks):
            return
        at, which = _ranges(lists.begin[blocks], lists.end[blocks])
        self.read += len(at)
        inside = live[lists.doc[at]]
        at, which = at[inside], which[inside]
        doc, n = lists.doc[at], len(live)
        most = np.bincount(doc, (lists.high[blocks] * weights)[which], n)
        passing = most >= self.threshold(item)
        self.found += int((most > 0).sum())
        self.scored += int(passing.sum())
        ok = passing[doc]
        score = np.bincount(doc[ok], lists.value[at[ok]] * weights[which[ok]], n).astype(np.int64)
        hit = np.flatnonzero(score >= self.threshold(item))
        self._keep(item, lists.ids[hit], score[hit])


def _row(batch: pa.RecordBatch, i: int) -> dict:
    held = {n: batch.column(batch.schema.get_field_index(n))[i].values for n in ("doc_id", "n", "terms", "df", "doc", "tf")}
    row = {n: held[n].to_numpy(zero_copy_only=False) for n in ("n", "df", "doc", "tf")}
    return row | {"terms": held["terms"].to_pylist(), "doc_id": held["doc_id"].fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False)}


def item_terms(text: str | None) -> list[str]:
    """The distinct terms of an item."""
    return list(dict.fromkeys(terms_of(pa.array([(text or "").encode()], pa.binary()))[1].to_pylist()))


def _search_block(index: DataFrame, rows: list[Row], size: tuple[int, int], k: int) -> DataFrame:
    spark = index.sparkSession
    docs, terms = size
    texts = [item_terms(r["text"]) for r in rows]
    wanted = {t: i for i, t in enumerate(dict.fromkeys(t for ts in texts for t in ts))}
    df = frequencies(index, list(wanted))
    items = [[(wanted[t], weight(docs, df[t])) for t in ts if t in df] for ts in texts]
    shared = spark.sparkContext.broadcast((wanted, items))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, items = shared.value
        search = Search(items, k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = _row(batch, i)
                search.visit(shard_lists(row, wanted, docs, terms))
        for item, (ids, scores) in enumerate(search.best):
            if len(ids):
                columns = [pa.array(np.full(len(ids), item)), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item long, item_id long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = index.mapInArrow(best, _FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(index: DataFrame, items: DataFrame, k: int = K, block: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item (item_id, text), the items in blocks."""
    # rows are shards: the JVM reads them one after another, not in batches
    index.sparkSession.conf.set("spark.sql.parquet.enableNestedColumnVectorizedReader", "false")
    size = corpus_size(index)
    found, held = [], []
    for row in items.select("item_id", "text").toLocalIterator():
        held.append(row)
        if len(held) == block:
            found.append(_search_block(index, held, size, k))
            held = []
    if held:
        found.append(_search_block(index, held, size, k))
    if not found:
        return index.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if len(found) == 1:
        return found[0]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def search_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Index and search in one go; the index is deleted when the results are written."""
    index = write_index(docs)
    found = materialize(search(index, items, k), "lexical_found")
    discard(index)
    return found


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), c AS (
  SELECT d, doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), s AS (
  SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY d
), g AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM s
), f AS (
  SELECT term, count(*) AS df FROM c GROUP BY term
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), r AS (
  SELECT q.item_id, c.d, c.doc_id,
    CAST(sum(CAST(floor(1000 * ln((2 * g.docs + 2) / (2 * f.df + 1))) AS BIGINT) * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (50 + (50 * s.n * g.docs) // g.terms)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN c USING (term) JOIN s USING (d), g
  GROUP BY q.item_id, c.d, c.doc_id
), o AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, d) AS rank, doc_id, score FROM r WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 50
"""
