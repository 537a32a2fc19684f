"""Jaccard self-join of documents over word n-grams with a prefix tree.

Exact, without pairs inside groups:

1. Every text becomes a sorted set of 64-bit shingle hashes; equal sets are one node.
2. Distribution by the pigeonhole principle. Two sets that may link differ in at most
   D members, D known from their sizes. The hash range is cut into D + 1 + 2 E
   segments (E spare ones); at least 2 E + 1 segments hold the same members in both.
   Each set signs all segments but its E emptiest, so a linked pair shares at least
   one signature. Sizes fall into windows; a set signs for each window that a
   possible partner may own.
   A member that no other set has lies outside every intersection, and a linked set
   has few such members; sets with more are settled before they sign. Counting them
   over a fixed part of the hash range, large enough for the threshold, is enough
   (one shuffle, combined on the map side). Sets that share common passages alone
   never get further.
   Below a threshold of 0.88 segments would hold so few members that common words match
   by chance: half as many segments are cut, of which one differs in one member at
   most, and a set also signs each segment without each of its members.
3. Signatures link sets to the least set that shares them: minima combine on the map
   side and a join follows, so a hot signature is split. Connected components of these
   edges are clusters that hold every link.
4. Inside a cluster, or a block of bounded size of a large one, the sets are put in
   one global order (rare members first) and stored in a prefix tree. A set walks
   only the subtrees below nodes that hold a member of both prefixes, with a running
   overlap that all sets below a node share; subtrees are pruned when the members
   that remain cannot reach the threshold, and when all of their sets are already
   connected with the walking one.
5. Blocks of one cluster meet through one set per connected part; where parts remain
   apart, all sets outside the largest part are joined with every block.

Unsettled sets, shared signatures and texts of clustered documents are found through a bitmap of fixed
size (false hits do no harm: they sign in vain, or the join behind
drops them).

Defined cases: null text and texts without words have the empty set, which links with
nothing; fewer words than the width are one shingle; repeated rows link with each
other; very long texts are split into words a part at a time; ties do not arise (links
are symmetric, the least id names a component); a null id never is a component's id unless all its ids are null; an empty table
gives an empty result; extra columns are ignored. Equal sets are recognised by a
64-bit digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .packing import _groups, release_memory
from .ppm import _lowered
from .storage import discard, materialize, settle, unused
from .text import word_parts

#: Bits of the bitmaps of unsettled sets and of clustered ids.
BITS = 1 << 26
#: Sets in one prefix tree have at most about this many members in all.
BLOCK_MEMBERS = 1_000_000
_GROWTH = 1.4
_KEEP_WORDS = 60_000
_GROUP_CHARS = 500_000


class WordHashes(dict):
    """Hashes of words with a store of bounded size; a task makes its own, so nothing outlives it."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= _KEEP_WORDS:
                self.clear()
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(lowered: bytes, hashes: WordHashes) -> np.ndarray:
    """Hashes of all words; long texts are split into words a part at a time."""
    parts = [np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)) for words in word_parts(lowered)]
    return np.concatenate(parts) if len(parts) != 1 else parts[0]


def shingle_set(lowered: bytes, width: int, hashes: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    if not lowered or lowered.isspace():
        return np.zeros(0, np.uint64)
    h = _word_hashes(lowered, WordHashes() if hashes is None else hashes)
    span = min(width, len(h))
    out = np.full(len(h) - span + 1, span, np.uint64)
    for k in range(span):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - span + 1 + k]
        out ^= out >> np.uint64(29)
    return np.unique(_mixed(out))


def node_of(members: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


class Windows:
    """Size windows of a threshold num/den, and the segments that each needs."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.bounds = num, den, [1, 2]

    def _window(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * _GROWTH)))
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def most_different(self, window: int) -> int:
        """The largest symmetric difference of a linked pair whose smaller set is in the window."""
        small = self.bounds[window + 1] - 1
        both = small + small * self.den // self.num
        return both - 2 * -(-self.num * both // (self.num + self.den))

    def signatures(self, members: np.ndarray) -> np.ndarray:
        n = len(members)
        out = []
        if n:
            loose = 100 * self.num < 88 * self.den
            weak = _mixed(members ^ np.uint64(0x5851F42D4C957F2D))
            last = self._window(n)
            for window in range(self._window(max(1, -(-self.num * n // self.den))), last + 1):
                most = self.most_different(window)
                if most <= 0:
                    continue  # only equal sets link
                spare = most // 14 if loose else min(4, most // 8)
                segments = (most // 2 if loose else most) + 1 + 2 * spare
                place = (((members >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)
                held = np.bincount(place, minlength=segments)
                sums = np.zeros(segments, np.uint64)
                full = np.flatnonzero(held)
                sums[full] = np.add.reduceat(weak, (np.cumsum(held) - held)[full])
                label = _mixed(np.arange(segments, dtype=np.uint64) + np.uint64(window << 40 | 1))
                kept = np.ones(segments, bool)
                if spare:
                    kept[np.argsort(held, kind="stable")[:spare]] = False
                out.append(_mixed(sums ^ label)[kept])
                if loose:
                    out.append(_mixed((sums[place] - weak) ^ label[place])[kept[place]])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def unsettled(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node) of the sets that may link: not too many of their members are theirs alone.

    At most (1 - t) n members of a set of size n lie outside a linked set. Members are
    counted in a part of the hash range twice as large as (1 - t).
    """
    share = min(1.0, 2.0 * (den - num) / den)
    most = np.uint64(int(share * (2**64 - 1)))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for _, texts in _groups(batches, _GROUP_CHARS):
            sets = [s for s in (shingle_set(_lowered(t), width, hashes) for t in texts) if len(s)]
            if not sets:
                continue
            parts = [s[: int(np.searchsorted(s, most, "right"))] for s in sets]
            offsets = pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([node_of(s) for s in sets]),
                    pa.array([len(s) for s in sets]),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts).view(np.int64))),
                ],
                ["node", "n", "members"],
            )

    found = docs.select("doc_id", "text").mapInArrow(members, "node long, n long, members array<long>")
    # a set without members in the part comes back through a row of its own
    rows = found.select("node", "n", F.explode_outer("members").alias("member"))
    own = rows.groupBy("member").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("member is not null and node = other")
    alone = own.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    settled = materialize(alone, "alone")
    sizes = found.groupBy("node").agg(F.max("n").alias("n"))
    return sizes.join(settled, "node", "left").where((F.coalesce("alone", F.lit(0)) * den) <= F.col("n") * (den - num)).select("node")


def set_features(docs: DataFrame, width: int, num: int, den: int, open_bits: np.ndarray | None = None) -> DataFrame:
    """row, doc_id, key, n, node (null for empty sets), signatures (of the sets that the bitmap holds).

    ``key`` (a digest of id and text) finds a text again, whether its id is null or repeated or not.
    """
    shared = docs.sparkSession.sparkContext.broadcast(open_bits)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, row = Windows(num, den), TaskContext.get().partitionId() << 33
        bits = shared.value
        none, hashes = np.zeros(0, np.uint64), WordHashes()
        for heads, texts in _groups(batches, _GROUP_CHARS):
            sets = [shingle_set(_lowered(t), width, hashes) for t in texts]
            nodes = [node_of(s) if len(s) else None for s in sets]
            signs = [windows.signatures(s) if x is not None and (bits is None or _held(bits, x)) else none for s, x in zip(sets, nodes, strict=True)]
            offsets = pa.array(np.cumsum([0, *map(len, signs)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + len(heads)), pa.int64()),
                    pa.array([h["doc_id"] for h in heads], pa.int64()),
                    pa.array([h["key"] for h in heads], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(signs).view(np.int64))),
                ],
                ["row", "doc_id", "key", "n", "node", "signatures"],
            )
            row += len(heads)

    head = F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"))
    return docs.select(head.alias("head"), "text").mapInArrow(features, "row long, doc_id long, key long, n long, node long, signatures array<long>")


def text_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _held(bits: np.ndarray, node: int) -> bool:
    place = node % BITS
    return bool(bits[place >> 3] >> (place & 7) & 1)


class _Node:
    __slots__ = ("begin", "children", "end", "item", "leaves", "longest", "parent", "part", "shortest")

    def __init__(self, item: int, begin: int, end: int):
        self.item, self.begin, self.end = item, begin, end
        self.children: list[_Node] = []
        self.leaves: list[int] = []


class PrefixTree:
    """Compressed prefix tree over sets in a global order, and the join on it."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int, parts: list | None = None):
        self.num, self.den = num, den
        members, counts = np.unique(np.concatenate(sets), return_counts=True)
        order = np.empty(len(members), np.int32)
        order[np.lexsort((members, counts))] = np.arange(len(members), dtype=np.int32)
        self.lone = int(np.count_nonzero(counts == 1))  # members of one set come first
        ranked = [np.sort(order[np.searchsorted(members, s)]) for s in sets]
        self.by_key = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">u4").tobytes())
        self.sets, self.marks = ranked, np.zeros(len(members), bool)
        self.parent = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []
        first: dict = {}
        for i, part in enumerate(parts or []):
            self._union(first.setdefault(part, i), i)
        self.root = self._build()

    def _find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _union(self, i: int, j: int) -> None:
        i, j = self._find(i), self._find(j)
        self.parent[max(i, j)] = min(i, j)

    def _build(self) -> _Node:
        root = _Node(self.by_key[0], 0, 0)
        path = [root]
        previous = None
        for i in self.by_key:
            s, shared = self.sets[i], 0
            if previous is not None:
                most = min(len(s), len(previous))
                differ = np.flatnonzero(s[:most] != previous[:most])
                shared = int(differ[0]) if len(differ) else most
            while path[-1].begin >= shared and len(path) > 1:
                path.pop()
            top = path[-1]
            if top.end > shared:  # split the edge
                lower = _Node(top.item, shared, top.end)
                lower.children, lower.leaves = top.children, top.leaves
                top.end, top.children, top.leaves = shared, [lower], []
            if len(s) > shared:
                leaf = _Node(i, shared, len(s))
                top.children.append(leaf)
                path.append(leaf)
                top = leaf
            top.leaves.append(i)
            previous = s
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.children)
        self.bottom_up = order[::-1]
        for node in self.bottom_up:
            lengths = [len(self.sets[i]) for i in node.leaves]
            node.shortest = min([*lengths, *(c.shortest for c in node.children)])
            node.longest = max([*lengths, *(c.longest for c in node.children)])
            for c in node.children:
                c.parent = node
        root.parent = None
        self.holders: dict[int, list[_Node]] = {}
        for node in order:  # members in the prefix of some set below
            edge = self.sets[node.item][node.begin : min(node.end, self._prefix(node.longest))]
            for member in edge[edge >= self.lone].tolist():
                self.holders.setdefault(member, []).append(node)
        self._mark_parts()
        return root

    def _mark_parts(self) -> None:
        """The connected part that all sets below a node belong to, or -1."""
        for node in self.bottom_up:
            found = {self._find(i) for i in node.leaves} | {c.part for c in node.children}
            node.part = found.pop() if len(found) == 1 else -1

    def _prefix(self, n: int) -> int:
        """Linked sets share a member among the first this many of each."""
        return n - -(-self.num * n // self.den) + 1

    def _linked(self, both: int, n: int, m: int) -> bool:
        return self.den * both >= self.num * (n + m - both)

    def _link(self, i: int, j: int) -> None:
        self.links.append((i, j))
        self._union(i, j)

    def clear(self) -> None:
        """Cut the nodes' cycles, so that their memory is free at once."""
        for node in self.bottom_up:
            node.parent, node.children = None, []
        self.holders.clear()

    def join(self) -> list[tuple[int, int]]:
        """Links that connect exactly what all links connect (beyond the given parts)."""
        for i, j in zip(self.by_key, self.by_key[1:], strict=False):
            if self._find(i) != self._find(j):
                self.marks[self.sets[i]] = True
                if self._linked(int(self.marks[self.sets[j]].sum()), len(self.sets[i]), len(self.sets[j])):
                    self._link(i, j)
                self.marks[self.sets[i]] = False
        self._mark_parts()
        fresh = len(self.links)
        for i in self.by_key:
            if self.root.part >= 0 and len(self.links) == fresh:
                break
            self.marks[self.sets[i]] = True
            self._walk(i)
            self.marks[self.sets[i]] = False
            if len(self.links) > fresh + len(self.sets) // 16:
                self._mark_parts()
                fresh = len(self.links)
        return self.links

    def stars(self, nodes: list[int]) -> list[tuple[int, int]]:
        """Links from every set to the smallest name of its connected part: they connect what the links found connect."""
        least: dict[int, int] = {}
        for i, node in enumerate(nodes):
            part = self._find(i)
            least[part] = min(node, least.get(part, node))
        return [(node, least[self._find(i)]) for i, node in enumerate(nodes) if node != least[self._find(i)]]

    def _walk(self, i: int) -> None:
        x = self.sets[i]
        n = len(x)
        least, most = -(-self.num * n // self.den), n * self.den // self.num
        overlaps: dict[int, int] = {}  # with the path down to a node, shared by all sets below it

        def overlap(node: _Node) -> int:
            path = []
            while node is not None and id(node) not in overlaps:
                path.append(node)
                node = node.parent
            total = overlaps[id(node)] if node is not None else 0
            for below in reversed(path):
                total += int(np.count_nonzero(self.marks[self.sets[below.item][below.begin : below.end]]))
                overlaps[id(below)] = total
            return total

        seen: set[int] = set()
        stack = [h for member in x[: self._prefix(n)].tolist() for h in self.holders.get(member, ())]
        while stack:
            node = stack.pop()
            if id(node) in seen:
                continue
            seen.add(id(node))
            low, high = max(node.shortest, least), min(node.longest, most)
            if low > high or (node.part >= 0 and self._find(node.part) == self._find(i)):
                continue
            both = overlap(node)
            left = n - int(np.searchsorted(x, self.sets[node.item][node.end - 1], "right")) if node.end else n
            if not self._linked(both + min(left, high - node.end), n, low):
                continue
            for j in node.leaves:
                if j != i and self._find(j) != self._find(i) and self._linked(both, n, len(self.sets[j])):
                    self._link(i, j)
            stack.extend(node.children)


def _tree_join(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b) links from rows (cluster, block, node, part, text), grouped by cluster and block."""

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[int, tuple]]:
        """The sets (node: members, part) of each block; texts become sets as they arrive."""
        key, held, hashes = None, {}, WordHashes()
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(5)), strict=True):
                cluster, block, node, part = (x.as_py() for x in row[:4])
                if (cluster, block) != key:
                    if held:
                        yield held
                    key, held = (cluster, block), {}
                if node not in held:
                    members = shingle_set(_lowered(row[4].as_py() or ""), width, hashes)
                    if node_of(members) == node:
                        held[node] = (members, part)
        if held:
            yield held

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for found in groups(batches):
            nodes = list(found)
            if len(nodes) > 1:
                tree = PrefixTree([found[x][0] for x in nodes], num, den, [found[x][1] for x in nodes])
                tree.join()
                out.extend(tree.stars(nodes))
                tree.clear()
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
        release_memory()

    rows = rows.select("cluster", "block", "node", "part", "text").repartition("cluster", "block")
    return rows.sortWithinPartitions("cluster", "block").mapInArrow(joined, "a long, b long")


def _place(key: Column) -> Column:
    return F.pmod(key, F.lit(BITS))


def _bitmap(places: DataFrame) -> np.ndarray:
    """Bitmap of column ``place`` (0 to BITS - 1), lowest bit first; Spark builds it in buckets of 32768 bits."""
    rows = places.groupBy(F.floor(F.col("place") / 32768).alias("bucket")).agg(F.expr("bitmap_construct_agg(place % 32768)").alias("bits"))
    out = np.zeros((BITS // 32768, 4096), np.uint8)
    for row in rows.collect():  # at most 2048 rows of 4096 bytes
        out[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _kept_by(spark: SparkSession, bits: np.ndarray):
    shared = spark.sparkContext.broadcast(bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            yield batch.filter(pa.array((held[at >> 3] >> (at & 7) & 1) > 0)).select([0, 1])

    return keep


def _signed_by(spark: SparkSession, bits: np.ndarray):
    shared = spark.sparkContext.broadcast(bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, signature) of the signatures that the bitmap holds."""
        held = shared.value
        for batch in batches:
            lists = batch.column(1)
            flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at = flat % BITS
            passed = (held[at >> 3] >> (at & 7) & 1) > 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[passed])), pa.array(flat[passed])], ["node", "signature"])

    return keep


def similarity_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """row, doc_id, n_shingles, component (a node, null for empty sets), component_id.

    Two documents link if the Jaccard similarity of their shingle sets is at least num / den.
    """
    spark = docs.sparkSession
    maybe = _bitmap(unsettled(docs, width, num, den).select(_place(F.col("node")).alias("place")))
    features = materialize(set_features(docs, width, num, den, maybe), "features")
    settle(spark)
    sets = features.where("node is not null")
    nodes = sets.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.max("n").alias("n"), F.min("key").alias("key"))
    entries = sets.select("node", F.explode("signatures").alias("signature"))
    shared = entries.groupBy("signature").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").drop("most")
    shared = materialize(shared, "shared")
    known = _bitmap(shared.select(_place(F.col("signature")).alias("place")))
    entries = sets.select("node", "signatures").mapInArrow(_signed_by(spark, known), "node long, signature long")
    edges = entries.join(shared.hint("merge"), "signature").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    edges = materialize(edges, "edges")
    clusters = connected_components(edges).select("node", F.col("component").alias("cluster"))
    sizes = clusters.join(nodes, "node")
    total = sizes.groupBy("cluster").agg(F.sum("n").alias("members"))
    blocks = F.ceil(F.col("members") / block_members).cast("int")
    active = materialize(
        sizes.join(total.select("cluster", blocks.alias("blocks")), "cluster").select(
            "node", "key", "n", "cluster", "blocks", F.pmod(F.hash("node"), "blocks").alias("block")
        ),
        "active",
    )
    discard(shared, edges)
    settle(spark)

    clustered = _bitmap(active.select(_place(F.col("key")).alias("place")))

    def with_text(rows: DataFrame) -> DataFrame:
        texts = docs.select(text_key().alias("text_key"), "text").select("*", _place(F.col("text_key")).alias("place"))
        texts = texts.mapInArrow(_kept_by(spark, clustered), "text_key long, text string")
        return rows.hint("merge").join(texts, F.col("key") == F.col("text_key"))

    single = F.col("block").cast("string")
    links = materialize(
        _tree_join(with_text(active.withColumns({"part": F.col("node"), "block": single})), width, num, den), "links"
    )
    if active.where("blocks > 1").limit(1).count():
        for last in (False, True):
            parts = connected_components(links.unionByName(active.select(F.col("node").alias("a"), F.col("node").alias("b"))))
            large = active.where("blocks > 1").join(parts.withColumnRenamed("component", "part"), "node")
            per = large.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("members"), F.min("node").alias("first"))
            main = per.groupBy("cluster").agg(F.max(F.struct("sets", "part")).alias("main"), F.count(F.lit(1)).alias("parts"))
            apart = per.join(main.where("parts > 1"), "cluster")
            if not apart.limit(1).count():
                break
            if not last:  # one set of each part
                few = active.join(apart.select(F.col("first").alias("node"), "part"), "node")
                many = few.groupBy("cluster").agg(F.ceil(F.sum("n") / block_members).cast("int").alias("k"))
                some = few.join(many, "cluster").withColumn("block", F.pmod(F.hash("node"), "k").cast("string"))
            else:  # every set with every set outside the largest part
                state = large.join(main.where("parts > 1"), "cluster").withColumn("stray", F.col("part") != F.col("main.part"))
                stray_members = F.sum(F.when(F.col("stray"), F.col("n")).otherwise(0))
                many = state.groupBy("cluster").agg(
                    F.ceil(stray_members / block_members).cast("int").alias("k"), F.ceil(F.sum("n") / block_members).cast("int").alias("all")
                )
                state = state.join(many, "cluster").withColumns({"own": F.pmod(F.hash("node"), "k"), "place": F.pmod(F.hash("node"), "all")})
                across = lambda to, column: state.where(to).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(column) - 1)))
                some = across(F.lit(True), "k").withColumn("block", F.concat_ws(",", "place", "other")).unionByName(
                    across(F.col("stray"), "all").withColumn("block", F.concat_ws(",", "other", "own"))
                )
            more = _tree_join(with_text(some.select("cluster", "block", "node", "part", "key")), width, num, den)
            before, links = links, materialize(links.unionByName(more), "links")
            discard(before)
    settle(spark)
    parts = connected_components(links)
    labelled = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    labels = labelled.join(least, "component").select("node", "component", "component_id")
    return features.select("row", "doc_id", "n", "node").join(labels, "node", "left").select(
        "row",
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "node",
    )


def one_of_each(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents with one of each component: the one with the smallest id (a null id only among null ids)."""
    found = materialize(similarity_components(docs, width, num, den), "components")
    own, own_node, node = unused(docs, "own", "own_node", "node")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keep = found.where((F.col("doc_id") == F.col("component_id")) | F.col("node").isNull() | F.col("component_id").isNull())
    repeated = found.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    if not repeated:  # the table that is hashed holds ids, texts are not sorted
        ids = keep.select(F.col("doc_id").alias(own))
        return docs.join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col(own), "left_semi").select(*columns)
    # rows of one id are told apart by their sets
    first = found.where("node is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "node")).alias("best"))
    best = first.select(F.col("best.doc_id").alias(own), F.col("best.node").alias(own_node))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            sets = [shingle_set(_lowered(t.as_py() or ""), width, hashes) for t in batch.column(at)]
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], [*batch.schema.names, node])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    tagged = docs.mapInArrow(tag, f"{schema}, `{node}` long")
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(node) == F.col(own_node))
    kept = tagged.join(best.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["doc_id", node])
    return kept.unionByName(tagged.where(F.col(node).isNull())).select(*columns)
