"""Language-model scoring by prediction with partial matching (PPM).

Model: a trie of byte contexts up to ``order`` bytes with escape method C and symbol
exclusion, trained on all training documents. Counts of the deepest nodes are taken
per Arrow batch in numpy, summed by Spark, and all shallower nodes follow from them,
as tables of grams and of contexts, one pair per order; no node is pruned. The
``max_nodes`` most frequent deepest grams (bounded) are looked up in a broadcast table
of their probabilities; all others, and grams that training never saw, reach the
documents by joins with the tables, so the model may grow with the corpus. Texts score with A-Z lower-cased, from a boundary symbol to a boundary symbol
(a byte that UTF-8 never uses), in full; every step is vectorised over positions.

Because counts are taken at every position for every context length, the symbols
seen after a context are also seen after each of its suffixes. The exclusion sets are
therefore nested, and every denominator under exclusion is a property of one node
that is computed when the model is built.

Base: a smoothed unigram model over words. The ``frequent`` most frequent words
(bounded) are looked up in a broadcast dictionary; counts of all other words reach
the documents by a join, so the vocabulary may grow with the corpus.

Defined cases: null text is empty and consists of the end symbol; a null id belongs
to the training part; repeated rows are documents of their own; with nothing to
train on all symbols are equally likely; the grams of very long texts are made a part at a time; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import _groups
from .storage import materialize
from .text import LOWER_BYTES, word_parts

ORDER = 5
BOUNDARY = 0xFF
SYMBOLS = 256
MAX_NODES = 1_000_000
FREQUENT = 131_072
_EMPTY = np.uint64(2**64 - 1)

#: Characters of texts that are counted or scored at once.
_GROUP = 1_000_000
#: Distinct grams that a task holds before it sends them on.
_HELD = 1_000_000


def _mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << 8 * n_bytes) - 1)


def framed(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the last ``order`` + 1 symbols at every scored position, and the number of positions per text."""
    pad = bytes([BOUNDARY]) * order
    raw = np.frombuffer(b"".join(pad + t + pad[:1] for t in texts) if order else b"".join(t + bytes([BOUNDARY]) for t in texts), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    wide = raw.astype(np.uint64)
    n = len(raw)
    keys = np.zeros(n, np.uint64)
    for back in range(order, -1, -1):
        keys <<= np.uint64(8)
        keys[back:] |= wide[: n - back] if back else wide
    starts = np.concatenate([[0], np.cumsum(lengths + order)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    scored = np.ones(n, bool)
    for k in range(order):
        scored[starts + k] = False
    return keys[scored], lengths


def framed_parts(text: bytes, order: int, most: int) -> Iterator[np.ndarray]:
    """The keys of one long text, ``most`` positions at a time."""
    whole = bytes([BOUNDARY]) * order + text + bytes([BOUNDARY])
    for at in range(order, len(whole), most):
        wide = np.frombuffer(whole[at - order : at + most], np.uint8).astype(np.uint64)
        keys = np.zeros(len(wide) - order, np.uint64)
        for back in range(order, -1, -1):
            keys = (keys << np.uint64(8)) | wide[order - back : len(wide) - back]
        yield keys


class HashTable:
    """Open addressing over uint64 keys; ``find`` gives each key's row, or -1."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 1.5))))
        self.shift, self.size = np.uint64(64 - bits), 1 << bits
        self.keys = np.full(self.size, _EMPTY)
        self.rows = np.full(self.size, -1, np.int32)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slots] == _EMPTY
            taken, first = np.unique(slots[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[taken] = keys[left[placed]]
            self.rows[taken] = left[placed]
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, slots = left[rest], (slots[rest] + 1) & (self.size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.rows[slots], np.int32(-1))
        todo = np.flatnonzero((found != keys) & (found != _EMPTY))
        at = slots[todo]
        while len(todo):
            at = (at + 1) & (self.size - 1)
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.rows[at[hit]]
            more = ~hit & (found != _EMPTY)
            todo, at = todo[more], at[more]
        return out


@dataclass
class Level:
    """Nodes whose context has one length."""

    grams: HashTable
    count: np.ndarray
    contexts: HashTable
    total: np.ndarray
    distinct: np.ndarray
    #: over the next shorter context, without the symbols seen after this one: counts plus escapes, and escapes
    below: np.ndarray = field(default_factory=lambda: np.zeros(0))
    below_escape: np.ndarray = field(default_factory=lambda: np.zeros(0))


class Trie:
    """PPM model of ``order`` from the deepest grams and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order, self.levels = order, []
        previous: tuple | None = None
        for length in range(order + 1):
            grams, place = np.unique(keys & _mask(length + 1), return_inverse=True)
            count = np.bincount(place, counts, len(grams))
            contexts, owner = np.unique(grams >> np.uint64(8), return_inverse=True)
            level = Level(HashTable(grams), count, HashTable(contexts), np.bincount(owner, count, len(contexts)), np.bincount(owner, minlength=len(contexts)).astype(float))
            if previous is not None and len(grams):
                lower = self.levels[-1]
                seen = np.bincount(owner, lower.count[lower.grams.find(grams & _mask(length))], len(contexts))
                shorter = lower.contexts.find(contexts & _mask(length - 1) if length > 1 else np.zeros_like(contexts))
                level.below_escape = lower.distinct[shorter] - level.distinct
                level.below = lower.total[shorter] - seen + level.below_escape
            previous = (grams, count)
            self.levels.append(level)
        top = self.levels[-1]
        owner = top.contexts.find(previous[0] >> np.uint64(8)) if len(previous[0]) else np.zeros(0, int)
        self.direct = np.log10(top.count / (top.total[owner] + top.distinct[owner])) if len(owner) else np.zeros(0)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each key's last symbol after the symbols before it."""
        found = self.levels[-1].grams.find(keys)
        out = np.zeros(len(keys))
        hit = found >= 0
        out[hit] = self.direct[found[hit]]
        todo = np.flatnonzero(~hit)
        if len(todo):
            out[todo] = self._escaped(keys[todo])
        return out

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        longer = np.full(len(keys), -1)  # row of the context one byte longer, if it exists
        for length in range(self.order, -1, -1):
            level, k = self.levels[length], keys[todo]
            context = level.contexts.find((k >> np.uint64(8)) & _mask(length) if length else np.zeros_like(k)).astype(int)
            gram = level.grams.find(k & _mask(length + 1))
            exists, after = context >= 0, longer[todo] >= 0
            whole, escape = np.ones(len(k)), np.ones(len(k))
            first = exists & ~after
            whole[first] = level.total[context[first]] + level.distinct[context[first]]
            escape[first] = level.distinct[context[first]]
            if length < self.order:
                up, rows = self.levels[length + 1], longer[todo[after]]
                whole[after], escape[after] = up.below[rows], up.below_escape[rows]
            hit = gram >= 0
            out[todo[hit]] += np.log10(level.count[gram[hit]] / whole[hit])
            miss = ~hit & exists & (escape > 0)
            out[todo[miss]] += np.log10(escape[miss] / whole[miss])
            longer[todo] = context
            todo = todo[~hit]
        if len(todo):
            seen = self.levels[0].distinct[0] if len(self.levels[0].distinct) else 0
            out[todo] -= log10(max(1, SYMBOLS - seen))
        return out

    def score(self, texts: list[bytes], most: int = 1_000_000) -> list[float]:
        """log10 probability of each text."""
        out: list[float] = []
        part: list[bytes] = []
        size = 0
        for t in [*texts, None]:
            if part and (t is None or size + len(t) > most):
                keys, lengths = framed(part, self.order)
                values = np.concatenate([self.log10(keys[k : k + most]) for k in range(0, len(keys), most)])
                out.extend(np.add.reduceat(values, np.cumsum(lengths) - lengths).tolist())
                part, size = [], 0
            if t is not None:
                part.append(t)
                size += len(t)
        return out


_tables: dict[str, tuple[HashTable, np.ndarray]] = {}


def _table(key: str, grams: np.ndarray, logs: np.ndarray) -> tuple[HashTable, np.ndarray]:
    """The frequent grams and their log10 probabilities, hashed once in each Python worker."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = HashTable(grams), logs
    return _tables[key]


def look_up(table: HashTable, logs: np.ndarray, texts: list[bytes], order: int, most: int = 1_000_000) -> tuple[list[float], np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability of each text without the grams that ``table`` lacks, and those: number of the text, gram, count."""
    sums: list[float] = []
    lacking = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    part: list[bytes] = []
    size = 0

    def keyed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of keys and the places of those that the table lacks."""
        found = table.find(keys)
        hit = found >= 0
        values = np.zeros(len(keys))
        values[hit] = logs[found[hit]]
        return values, np.flatnonzero(~hit)

    for t in [*texts, None]:
        if part and (t is None or size + len(t) > most):
            keys, lengths = framed(part, order)
            done = [keyed(keys[k : k + most]) for k in range(0, len(keys), most)]
            values = np.concatenate([v for v, _ in done])
            at = np.concatenate([k * most + m for k, (_, m) in enumerate(done)])
            owner = np.searchsorted(np.cumsum(lengths), at, side="right")
            by = np.lexsort((keys[at], owner))
            owner, grams = owner[by], keys[at][by]
            first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])]) if len(by) else by
            lacking.append((owner[first] + len(sums), grams[first], np.diff(np.r_[first, len(by)])))
            sums.extend(np.add.reduceat(values, np.cumsum(lengths) - lengths).tolist())
            part, size = [], 0
        if t is None:
            break
        if len(t) > 4 * most:  # a long text goes through in parts
            total = 0.0
            for keys in framed_parts(t, order, most):
                values, at = keyed(keys)
                total += float(values.sum())
                grams, times = np.unique(keys[at], return_counts=True)
                lacking.append((np.full(len(grams), len(sums)), grams, times))
            sums.append(total)
            continue
        part.append(t)
        size += len(t)
    return sums, *(np.concatenate(x) for x in zip(*lacking, strict=True))


def is_held_out(doc_id: Column, remainder: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def _lowered(text: str) -> bytes:
    return text.encode("utf-8", "replace").translate(LOWER_BYTES)


def _added(grams: np.ndarray, counts: np.ndarray, more: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams and their counts, of two such tables."""
    both, n = np.concatenate([grams, more]), np.concatenate([counts, times])
    order = np.argsort(both, kind="stable")
    both, n = both[order], n[order]
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else order
    return both[first], np.add.reduceat(n, first) if len(first) else n


def counted(batches: Iterator[pa.RecordBatch], order: int, group: int = _GROUP, held: int = _HELD) -> Iterator[pa.RecordBatch]:
    """Batches (word, gram, n) of batches (doc_id, text); what is held of them stays within a few times ``group`` and ``held`` keys."""
    _tables.clear()  # of an earlier query in this worker
    words: Counter = Counter()
    grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = 0

    def emit(w: dict, g: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        none = len(w)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x.decode() for x in w] + [None] * len(g), pa.string()),
                pa.array(np.concatenate([np.zeros(none, np.int64), g.astype(np.int64)]), mask=np.arange(none + len(g)) < none),
                pa.array(np.concatenate([np.fromiter(w.values(), np.int64, none), c])),
            ],
            ["word", "gram", "n"],
        )

    for _, texts in _groups(batches, group):
        lowered = [_lowered(t) for t in texts]
        ends += len(lowered)
        for part in chain.from_iterable(map(word_parts, lowered)):
            words.update(part)
        short = [t for t in lowered if len(t) <= group]
        parts = (framed(x, order)[0] for x in [short] if x)
        for keys in chain(parts, *(framed_parts(t, order, group) for t in lowered if len(t) > group)):
            grams, counts = _added(grams, counts, *np.unique(keys, return_counts=True))
            if len(grams) > held:
                yield emit({}, grams, counts)
                grams, counts = grams[:0], counts[:0]
        if len(words) > 500_000:
            yield emit(words, grams[:0], counts[:0])
            words = Counter()
    if ends:
        yield emit(words, grams, counts)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([ends])], ["word", "gram", "n"])


def corpus_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(word, gram, n): counts of words and of deepest grams in the training documents.

    ``gram`` is null for words, both are null for the end token.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from counted(batches, order)

    found = docs.where(~is_held_out(F.col("doc_id"))).select("doc_id", "text").mapInArrow(count, "word string, gram long, n long")
    return found.groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows with the largest n, at most ``most``, by a threshold on n (levels of an eighth of a power of two)."""
    level = F.floor(F.log2("n") * 8).cast("int")
    rows = sorted((r["level"], r["rows"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect())
    least, kept = (rows[-1][0] + 1 if rows else 0), 0
    for at, n in reversed(rows):
        if kept + n > most:
            break
        least, kept = at, kept + n
    return counts.where(level >= least)


def _low(key: Column, n_bytes: int) -> Column:
    return key.bitwiseAND(F.lit((1 << 8 * n_bytes) - 1 if n_bytes < 8 else -1))


def node_tables(deepest: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For each context length (gram, n) and (context, total, distinct, below, below_escape), as in :class:`Level`."""
    grams = [deepest]
    for length in range(order - 1, -1, -1):
        lower = grams[0].groupBy(_low(F.col("gram"), length + 1).alias("gram")).agg(F.sum("n").alias("n"))
        grams.insert(0, materialize(lower, "grams"))
    levels: list[tuple[DataFrame, DataFrame]] = []
    for length, at in enumerate(grams):
        if not length:
            contexts = at.groupBy(F.lit(0).cast("long").alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))
            contexts = contexts.select("*", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("below_escape"))
        else:
            shorter, shorter_contexts = levels[-1]
            seen = at.withColumn("__low", _low(F.col("gram"), length)).join(shorter.select(F.col("gram").alias("__low"), F.col("n").alias("m")), "__low")
            own = seen.groupBy(F.shiftrightunsigned("gram", 8).alias("context")).agg(
                F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum("m").alias("seen")
            )
            lower = shorter_contexts.select(F.col("context").alias("__low"), F.col("total").alias("t"), F.col("distinct").alias("d"))
            if length <= 3:  # at most 65,536 contexts
                lower = F.broadcast(lower)
            escape = F.col("d") - F.col("distinct")
            contexts = own.withColumn("__low", _low(F.col("context"), length - 1)).join(lower, "__low").select(
                "context", "total", "distinct", (F.col("t") - F.col("seen") + escape).alias("below"), escape.alias("below_escape")
            )
        levels.append((at, materialize(contexts, "contexts")))
    return levels


def direct_logs(levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, n, log): log10 probabilities of the deepest grams seen in training."""
    grams, contexts = levels[-1]
    found = grams.withColumn("context", F.shiftrightunsigned("gram", 8)).join(contexts, "context")
    return found.select("gram", "n", F.log10(F.col("n") / (F.col("total") + F.col("distinct"))).alias("log"))


def escaped_logs(unseen: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, log) of distinct deepest grams that training never saw, as in :meth:`Trie.log10`."""
    state = unseen.select("gram", F.lit(0.0).alias("log"), F.lit(False).alias("done"), F.lit(None).cast("long").alias("up"), F.lit(None).cast("long").alias("up_escape"))
    for length in range(len(levels) - 1, -1, -1):
        grams, contexts = levels[length]
        # at most 65,536 rows each
        small_grams, small_contexts = (F.broadcast if length <= 1 else lambda x: x), (F.broadcast if length <= 2 else lambda x: x)
        state = state.withColumn("context", _low(F.shiftrightunsigned("gram", 8), length)).join(small_contexts(contexts), "context", "left")
        state = state.withColumn("__low", _low(F.col("gram"), length + 1)).join(small_grams(grams.select(F.col("gram").alias("__low"), "n")), "__low", "left")
        whole = F.coalesce("up", F.col("total") + F.col("distinct"))
        escape = F.coalesce("up_escape", "distinct")
        exists, hit = F.col("total").isNotNull(), F.col("n").isNotNull()
        step = F.when(hit, F.log10(F.col("n") / whole)).when(exists & (escape > 0), F.log10(escape / whole)).otherwise(0.0)
        state = state.select(
            "gram",
            F.when(F.col("done"), F.col("log")).otherwise(F.col("log") + step).alias("log"),
            (F.col("done") | hit).alias("done"),
            F.col("below").alias("up"),
            F.col("below_escape").alias("up_escape"),
            *(["distinct"] if not length else []),
        )
    last = F.log10(F.greatest(F.lit(1), SYMBOLS - F.coalesce("distinct", F.lit(0))))
    return state.select("gram", F.when(F.col("done"), F.col("log")).otherwise(F.col("log") - last).alias("log"))


def score_documents(docs: DataFrame, order: int = ORDER, max_nodes: int = MAX_NODES, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes."""
    spark = docs.sparkSession
    counts = materialize(corpus_counts(docs, order), "counts")
    words = counts.where("gram is null")
    totals = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.max(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("ends")
    ).first()
    norm = log10(totals["n"] + 0.5 * (totals["v"] + 1))
    words = words.where("word is not null").select("word", "n")
    levels = node_tables(counts.where("gram is not null").select("gram", "n"), order)
    direct = materialize(direct_logs(levels), "direct")
    grams = _most_frequent(direct, max_nodes).select("gram", "log").toArrow()
    frequent_grams = (uuid.uuid4().hex, grams["gram"].to_numpy().astype(np.uint64), grams["log"].to_numpy())
    model = spark.sparkContext.broadcast(frequent_grams)
    del grams, frequent_grams
    top = _most_frequent(words, frequent).toArrow()
    logs = spark.sparkContext.broadcast({w.encode(): log10(n + 0.5) for w, n in zip(*(top[c].to_pylist() for c in ("word", "n")), strict=True)})
    ends = totals["ends"]

    class Known(dict):
        """Frequent words' terms; others count 0 and are noted."""

        def __missing__(self, word: bytes) -> float:
            self.rare.append(word)
            return 0.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(logs.value)
        table = _table(*model.value)
        row = TaskContext.get().partitionId() << 33
        for ids, texts in _groups(batches, _GROUP):
            lowered = [_lowered(t) for t in texts]
            scores, owner, grams, times = look_up(*table, lowered, order)
            first_row = row
            rows, tokens, n_known, base = [], [], [], []
            rare_rows: list[int] = []
            rare_words: list[str] = []
            rare_n: list[int] = []
            for t in lowered:
                rare, total, n_words, n_rare = Counter(), 0.0, 0, 0
                for part in word_parts(t):
                    known.rare = []
                    total += sum(map(known.__getitem__, part))
                    n_words += len(part)
                    n_rare += len(known.rare)
                    rare.update(known.rare)
                base.append(total + log10(ends + 0.5))
                rows.append(row)
                tokens.append(n_words + 1)
                n_known.append(n_words - n_rare + (ends > 0))
                rare_rows.extend([row] * len(rare))
                rare_words.extend(w.decode() for w in rare)
                rare_n.extend(rare.values())
                row += 1
            k, m, g = len(rows), len(rare_rows), len(grams)
            none = [None] * (m + g)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.array(rows + rare_rows, np.int64), owner + first_row])),
                    pa.array(ids + none, pa.int64()),
                    pa.array(tokens + none, pa.int64()),
                    pa.array(np.concatenate([np.array(n_known + rare_n, np.int64), times])),
                    pa.array(base + none, pa.float64()),
                    pa.array(scores + none, pa.float64()),
                    pa.array([len(t) for t in lowered] + none, pa.int64()),
                    pa.array([None] * k + rare_words + [None] * g, pa.string()),
                    pa.array(np.concatenate([np.zeros(k + m, np.int64), grams.astype(np.int64)]), mask=np.arange(k + m + g) < k + m),
                ],
                ["row", "doc_id", "n_tokens", "n", "base", "score", "n_bytes", "word", "gram"],
            )

    scored = materialize(
        docs.select("doc_id", "text").mapInArrow(
            score, "row long, doc_id long, n_tokens long, n long, base double, score double, n_bytes long, word string, gram long"
        ),
        "scored",
    )
    rest = (
        scored.where("word is not null")
        .select("row", "word", "n")
        .join(words.withColumnRenamed("n", "c"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)).alias("more"),
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        )
    )
    rare = scored.where("gram is not null").select("row", "gram", "n")
    logs_of = materialize(rare.select("gram").distinct().join(direct.select("gram", "log"), "gram", "left"), "rare")
    logs_of = logs_of.where("log is not null").unionByName(escaped_logs(logs_of.where("log is null"), levels))
    escaped = rare.join(logs_of, "gram").groupBy("row").agg(F.sum(F.col("n") * F.col("log")).alias("more_score"))
    return (
        scored.where("n_tokens is not null")
        .join(rest, "row", "left")
        .join(escaped, "row", "left")
        .select(
            "doc_id",
            is_held_out(F.col("doc_id")).alias("held_out"),
            "n_tokens",
            (F.col("n") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(int(totals["n"])).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
            (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
            "n_bytes",
        )
    )
