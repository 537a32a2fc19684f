"""Best-fit packing of token pieces with Martello-Toth dominance reduction.

Texts are tokenized in Arrow batches, one call per distinct word (the tokenizer
never joins across white space), and cut into pieces of at most ``capacity`` ids.
What the driver packs is only the histogram of piece lengths (at most ``capacity``
numbers, whatever the corpus): the reduction fixes small sets that dominate every
other set with their largest item, best-fit decreasing places the rest, both for all
pieces of a length at once. The resulting patterns are broadcast; each piece finds
its sequence from its length and its rank among the pieces of that length, which is
counted in two levels (length and hash bucket), so no task holds a frequent length.

Defined cases: null or empty text is one piece with the end id alone; repeated rows
are packed as documents of their own; an empty table gives an empty result; ties
among equal lengths follow bucket, id and piece; a text of more than a slice of
characters is encoded slice by slice, cut at spaces; extra columns are ignored.
"""

from __future__ import annotations

import string
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..store import release_memory
from .storage import materialize

CAPACITY = 4096
END_ID = 1
_PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
#: White space about which string methods and the tokenizer may differ, and the beginning of special tokens.
_ODD_ASCII = ("\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "<|")
_ODD_OTHER = tuple("\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u2060\u3000\ufeff") + tuple(map(chr, range(0x2000, 0x2010)))
#: Words of at most so many letters are kept, at most twice so many of them; texts are cut at white space after so many characters.
_KEEP_LETTERS, _KEEP_WORDS, _SLICE = 32, 300_000, 500_000
#: Signs that the tokenizer cuts off from the letters before them, as one run.
_SIGNS = "".join(c for c in string.punctuation if c != "'")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in same else next(other)) for b in range(256)]


def slices(text: str, most: int = _SLICE) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut at spaces (a longer word stays whole)."""
    at = 0
    while len(text) - at > most:
        end = text.find(" ", at + most)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _odd(text: str) -> bool:
    return any(x in text for x in _ODD_ASCII) or (not text.isascii() and any(x in text for x in _ODD_OTHER))


class _Words(dict):
    """Ids of words, computed when they are first asked for, with a bounded store.

    The store has two generations: when the young one is full it becomes the old one,
    and words that occur again come back from there. Words of Latin letters, perhaps
    with a run of signs behind, go to the tokenizer's model right away; any other word
    goes through the whole tokenizer.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.encode, self.tokenize, self.letters = tokenizer.encode, tokenizer.model.tokenize, _byte_letters()
        self.four = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            if word.isascii() and word.isalpha():
                found = b"".join([self.four[t.id] for t in self.tokenize(word.lower())])
            else:
                found = self._marked(word)
        if len(word) <= _KEEP_LETTERS:
            if len(self) >= _KEEP_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found

    def _marked(self, word: str) -> bytes:
        bare = word.rstrip(_SIGNS)
        if not bare.isalpha():
            return self.whole(word)
        signs = word[len(bare) :]
        mark = self[signs] if signs else b""
        if signs and bare.isascii() and (found := self.get(bare) or self.old.get(bare)):
            return found + mark
        if not bare.isascii():
            bare = normalize("NFC", bare)
            if max(bare) >= "\u0250" or not (low := bare.lower()).isalpha():
                return self.whole(word)
            low = "".join([self.letters[x] for x in low.encode()])
        else:
            low = bare.lower()
        return b"".join([self.four[t.id] for t in self.tokenize(low)]) + mark


class _Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.words = _Words(Tokenizer.from_file(path))

    def ids(self, text: str) -> bytes:
        """The ids of a text; one of more than a slice is encoded slice by slice."""
        if len(text) <= _SLICE:
            return self.words.whole(text) if _odd(text) else b"".join(map(self.words.__getitem__, text.split()))
        return b"".join([self.ids(part) if len(part) <= _SLICE else self.words.whole(part) for part in slices(text, _SLICE // 2)])

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        return map(self.ids, texts)


def _groups(batches: Iterator[pa.RecordBatch], most_chars: int = 500_000) -> Iterator[tuple[list, list[str]]]:
    """Rows in groups of bounded text, however long each text is."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            ids.append(i)
            texts.append(text)
            held += len(text)
            if held >= most_chars:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts
    release_memory()


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: row (unique per document row), doc_id, piece, start, length, ids_crc32, if asked ids, and the columns ``keep``."""
    path = tokenizer or default_tokenizer()
    kept_types = [to_arrow_type(docs.schema[c].dataType) for c in keep]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = _Encoder(path), TaskContext.get().partitionId() << 33
        end = array("I", [END_ID]).tobytes()
        for heads, texts in _groups(batches):
            out: list[list] = [[] for _ in range(7)]
            owners: list[int] = []
            for k, (head, raw) in enumerate(zip(heads, encoder.batch(texts), strict=True)):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    values = (row, head["doc_id"], piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else b"")
                    owners.append(k)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=False)]
            if with_ids:
                names.append("ids")
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out[6]], pa.list_(pa.int32())))
            columns += [pa.array([heads[k][c] for k in owners], t) for c, t in zip(keep, kept_types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [*names, *keep])

    head = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *keep).alias("head")
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(head, "text").mapInArrow(cut, _PIECES + (", ids array<int>" if with_ids else "") + more)


def reduce_instance(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Fix dominating sets in place; ``counts[s]`` is the number of items of size s.

    For the item j and the largest k that fits beside it, {j, k} dominates every set
    with j if it fills the bin, if only one more item can fit, or if k is at least as
    large as any two others that fit together. {j, k, b} dominates if at most two more
    can fit and b is at least the second of any such two. If nothing fits, {j} is fixed.
    """
    fixed: list[tuple[int, tuple[int, ...]]] = []

    def take(*sizes: int) -> int:
        each = {s: sizes.count(s) for s in sizes}
        m = min(int(counts[s]) // c for s, c in each.items())
        for s, c in each.items():
            counts[s] -= m * c
        fixed.append((m, sizes))
        return m

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j]:
                counts[j] -= 1  # one j is spoken for
                left = np.flatnonzero(counts)
                room = capacity - j
                fits = left[left <= room]
                if not len(fits):
                    counts[j] += 1
                    take(j)
                    changed = True
                    break
                k = int(fits[-1])
                low = [int(s) for s in fits[:3] for _ in range(min(3, int(counts[s])))][:3]
                one_more = len(low) < 2 or low[0] + low[1] > room
                two_more = len(low) < 3 or sum(low) > room
                chosen: tuple[int, ...] = ()
                if j + k == capacity or one_more:
                    chosen = (j, k)
                else:
                    # the best second item for each first one
                    second = fits[np.clip(np.searchsorted(fits, room - fits, "right") - 1, 0, None)]
                    ok = (fits + second <= room) & ((fits != second) | (counts[fits] >= 2))
                    alone = ok | (fits != second)
                    pair = int((fits + second)[ok].max(initial=0))
                    if alone.all() and k >= pair:
                        chosen = (j, k)
                    elif two_more and k < room:
                        beside = fits[fits <= room - k]
                        beside = beside[(beside != k) | (counts[beside] >= 2)]
                        half = fits[fits <= room // 2]
                        if len(beside) and len(half) and beside[-1] >= half[-1]:
                            chosen = (j, k, int(beside[-1]))
                counts[j] += 1
                if not chosen or not take(*chosen):
                    if chosen:
                        fixed.pop()
                    break
                changed = True
    return fixed


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over a histogram: (number of bins, sizes in each)."""
    rooms: list[int] = []  # distinct, sorted
    bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(room: int, m: int, sizes: tuple[int, ...]) -> None:
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append((m, sizes))

    for s in range(capacity, 0, -1):
        n = int(counts[s])
        if not n:
            continue
        for room in rooms[bisect_left(rooms, s) :]:
            if not n:
                break
            each, keep, moved = room // s, [], []
            for m, sizes in bins[room]:
                full = min(m, n // each)
                n -= full * each
                if full:
                    moved.append((room - each * s, full, sizes + (s,) * each))
                m -= full
                if m and n:  # fewer are left than this bin holds
                    moved.append((room - n * s, 1, sizes + (s,) * n))
                    n, m = 0, m - 1
                if m:
                    keep.append((m, sizes))
            if keep:
                bins[room] = keep
            else:
                del bins[room]
                rooms.pop(bisect_left(rooms, room))
            for x in moved:
                put(*x)
        each = capacity // s
        if n >= each:
            put(capacity - each * s, n // each, (s,) * each)
        if n % each:
            put(capacity - n % each * s, 1, (s,) * (n % each))
    return [x for found in bins.values() for x in found]


def pack_histogram(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (number of bins, sizes in each) that hold every item once."""
    left = counts.astype(np.int64).copy()
    return reduce_instance(left, capacity) + best_fit_decreasing(left, capacity)


def _places(patterns: list[tuple[int, tuple[int, ...]]], capacity: int) -> dict[str, np.ndarray]:
    """Ranges of ranks: those of one size from ``first`` on lie in bins from ``bin`` on, ``each`` per bin, from ``at`` on."""
    used = np.zeros(capacity + 1, np.int64)
    rows, bin_no = [], 0
    for m, sizes in patterns:
        at = 0
        runs: list[list[int]] = []
        for s in sizes:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        for s, each in runs:
            rows.append((s, int(used[s]), bin_no, each, at))
            used[s] += m * each
            at += s * each
        bin_no += m
    rows.sort()
    names = ("size", "first", "bin", "each", "at")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows (row, doc_id, piece, length, ...), a written table."""
    spark = pieces.sparkSession
    buckets = max(8, -(-pieces.count() // 200_000))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)).cast("int"))
    sums = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for x in sums.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[x["length"]] = x["n"]
    places = spark.sparkContext.broadcast(_places(pack_histogram(counts, capacity), capacity))
    prior = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("length", "bucket", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("before"))
    inner = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "row")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(inner).cast("long"))
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("before") - 1)
    )
    columns = [c for c in pieces.columns if c != "bucket"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        key = p["size"] << 44 | p["first"]
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(key, size << 44 | rank, "right") - 1
            nth = rank - p["first"][i]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            added = [pa.array(p["bin"][i] + nth // p["each"][i]), pa.array(p["at"][i] + nth % p["each"][i] * size)]
            yield pa.RecordBatch.from_arrays(kept + added, [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.select(columns).dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, [ids,] the columns ``keep``, sequence_id, offset."""
    pieces = materialize(token_pieces(docs, tokenizer, capacity, with_ids, keep), "pieces")
    return pack(pieces, capacity).drop("row")
