"""Merkle manifest of a table: one tree per group of rows, one tree over the groups.

Rows become digests in the JVM; only digests are sorted, by group and order, into
partitions of about ``PART_ROWS`` rows. A forest is a set of unresolved nodes keyed by
(tree, level, run); adding nodes is associative and commutative, and a run of siblings
whose number is known becomes its parent as soon as it is complete. What a part of the
sorted rows leaves unresolved is the two edges of its trees, so forests stay small:

* every part folds its rows into a forest and writes the open nodes;
* about the square root of all parts fold those, and ``treeReduce`` merges the results to
  the root. These forests also keep the nodes they have resolved, as proofs need them;
* every part receives the nodes outside of it on the way of its first and last row, and
  makes proofs for its rows with them.

The driver holds one small record a part and the merged forest (the square root of the
parts times the levels), never rows.

Defined cases: null is a value of its own (``-``) and a null group a group, first; rows
without an order key come first; rows with equal keys follow their digests, equal digests
are interchangeable; repeated rows are leaves of their own; texts of any length are
hashed whole; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

ARITY = 3
PART_ROWS = 50_000
#: Tree number of the tree over the groups' roots.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "part int, tree long, level int, place long, leaves long, digest string"
_PROOFS = "order_key {}, leaf string, subroot string, root string, proof string, folded_root string"

Node = tuple[int, int, int]


def digest_of(parts: Iterable[str]) -> str:
    """Lower-case hex SHA-256 of concatenated hex digests."""
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields one after another, each ``-`` if null, else its UTF-8 length, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def width(leaves: int, level: int, arity: int = ARITY) -> int:
    """Nodes of a tree at a level."""
    for _ in range(level):
        leaves = -(-leaves // arity)
    return leaves


@dataclass
class Forest:
    """Unresolved nodes of many trees; ``nodes`` holds every node that was ever seen, if it is kept."""

    groups: int
    arity: int = ARITY
    keep: bool = False
    leaves: dict[int, int] = field(default_factory=dict)
    open: dict[Node, dict[int, str]] = field(default_factory=dict)
    nodes: dict[Node, str] = field(default_factory=dict)
    root: str | None = None

    def add(self, tree: int, level: int, place: int, digest: str, leaves: int) -> None:
        """Put one node in; whole runs become their parents."""
        if tree != TOP:
            self.leaves[tree] = leaves
        while True:
            n = width(self.groups if tree == TOP else self.leaves[tree], level, self.arity)
            if n == 1 and tree != TOP:
                if self.keep:
                    self.nodes[tree, level, place] = digest
                self.leaves.pop(tree)
                tree, level, place = TOP, 0, tree
                continue
            if self.keep:
                self.nodes[tree, level, place] = digest
            if n == 1:
                self.root = digest
                return
            run = place // self.arity
            found = self.open.setdefault((tree, level, run), {})
            found[place] = digest
            if len(found) < min(self.arity, n - run * self.arity):
                return
            del self.open[tree, level, run]
            digest = digest_of(found[k] for k in sorted(found))
            level, place = level + 1, run

    def rows(self) -> Iterator[tuple[int, int, int, int, str]]:
        """The open nodes, the root included."""
        for (tree, level, _), found in self.open.items():
            for place, digest in found.items():
                yield tree, level, place, self.leaves.get(tree, self.groups), digest
        if self.root is not None:
            top = 0
            while width(self.groups, top, self.arity) > 1:
                top += 1
            yield TOP, top, 0, self.groups, self.root

    def merged(self, other: Forest) -> Forest:
        """This forest with all that another one holds."""
        self.nodes.update(other.nodes)
        for row in other.rows():
            tree, level, place, leaves, digest = row
            self.add(tree, level, place, digest, leaves)
        return self


@dataclass
class Part:
    """Where a part of the sorted rows lies: numbers of its first and last group, what comes before in the first, sizes of both."""

    first: int
    before: int
    first_leaves: int
    last: int
    last_end: int
    last_leaves: int


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add to a sorted part: which of its groups a row belongs to, its place there, and that group's rows in the part."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    key = table.column("group_key").combine_chunks().dictionary_encode()
    if isinstance(key, pa.ChunkedArray):
        key = key.combine_chunks()
    code = key.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(code)]]))
    group = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(code)) - np.repeat(starts, sizes)
    rest = table.select(["part", "order_key", "leaf", "claimed"])
    for name, values in (("group_no", group), ("place", place), ("in_part", np.repeat(sizes, sizes))):
        rest = rest.append_column(name, pa.array(values.astype(np.int64)))
    yield from rest.append_column("group_key", table.column("group_key")).to_batches(max_chunksize=10_000)


def _sorted_parts(leaves: DataFrame, part_rows: int) -> DataFrame:
    """The leaves in order, with their parts."""
    parts = max(1, -(-leaves.count() // part_rows))
    keys = ("group_key", "order_key", "leaf", "row")
    ranged = leaves.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = ranged.select(F.spark_partition_id().alias("part"), "group_key", "order_key", "leaf", "claimed")
    types = dict(ranged.dtypes)
    schema = f"part int, order_key {types['order_key']}, leaf string, claimed string, group_no long, place long, in_part long, group_key {types['group_key']}"
    return materialize(ranged.mapInArrow(_located, schema), "merkle_leaves")


def _plan(leaves: DataFrame) -> tuple[dict[int, Part], int]:
    """One record a part, from one row a part, and the number of groups."""
    runs = leaves.where("place = 0").select("part", "group_no", "group_key", "in_part")
    known = F.struct("group_no", F.struct(F.col("group_key").alias("key")).alias("group"), "in_part")
    rows = runs.groupBy("part").agg(F.min(known).alias("first"), F.max(known).alias("last"))
    found, groups, open_key, sizes = [], -1, None, []
    for r in sorted(rows.collect(), key=lambda r: r["part"]):
        first, last = r["first"], r["last"]
        if open_key is None or open_key != first["group"]:
            groups += 1
            sizes.append(0)
        begin, before = groups, sizes[-1]
        sizes[-1] += first["in_part"]
        if last["group_no"]:
            groups += last["group_no"]
            sizes.append(last["in_part"])
        open_key = last["group"]
        found.append((r["part"], begin, before, len(sizes) - (2 if last["group_no"] else 1), groups, len(sizes) - 1, sizes[-1]))
    plan = {p: Part(begin, before, sizes[at], last, end, sizes[to]) for p, begin, before, at, last, to, end in found}
    return plan, groups + 1


def _numbered(plan: dict[int, Part], part: int, group_no: int, place: int, in_part: int) -> tuple[int, int, int]:
    """(group, place in it, its leaves) over the whole table."""
    p = plan[part]
    if not group_no:
        return p.first, p.before + place, p.first_leaves
    group = p.first + group_no
    return group, place, p.last_leaves if group == p.last else in_part


def _needed(p: Part, groups: int, arity: int) -> Iterator[Node]:
    """Siblings on the way up from the first and the last row of a part."""

    def way(tree: int, place: int, leaves: int) -> Iterator[Node]:
        level = 0
        while leaves > 1:
            run = place // arity * arity
            yield from ((tree, level, k) for k in range(run, min(run + arity, leaves)) if k != place)
            level, place, leaves = level + 1, place // arity, -(-leaves // arity)

    yield from way(p.first, p.before, p.first_leaves)
    yield from way(p.last, p.last_end - 1, p.last_leaves)
    yield from way(TOP, p.first, groups)
    yield from way(TOP, p.last, groups)


class _Ways:
    """Siblings to the left and to the right of every node of consecutive nodes, level by level."""

    def __init__(self, tree: int, lo: int, digests: list[str], leaves: int, outside: dict[Node, str], arity: int):
        self.levels: list[tuple[int, list[tuple[str, str]]]] = []
        self.arity, level = arity, 0
        while leaves > 1:
            begin, hi = lo - lo % arity, lo + len(digests)
            end = min(leaves, -(-hi // arity) * arity)
            full = [outside[tree, level, k] for k in range(begin, lo)] + digests + [outside[tree, level, k] for k in range(hi, end)]
            beside, parents = [], []
            for at in range(0, len(full), arity):
                run = full[at : at + arity]
                beside += [("".join(run[:k]), "".join(run[k + 1 :])) for k in range(len(run))]
                parents.append(digest_of(run))
            self.levels.append((lo, beside[lo - begin : hi - begin]))
            digests, lo, leaves, level = parents, begin // arity, -(-leaves // arity), level + 1
        self.root = digests[0]

    def of(self, place: int) -> list[tuple[str, str]]:
        found = []
        for lo, beside in self.levels:
            found.append(beside[place - lo])
            place //= self.arity
        return found


def _prove(leaves: pa.Table, outside: pa.Table, plan: dict[int, Part], groups: int, arity: int) -> pa.Table:
    """The proofs of one part."""
    names = ("part", "group_no", "place", "in_part", "leaf", "claimed", "order_key")
    leaves = leaves.sort_by([("group_no", "ascending"), ("place", "ascending")])
    part, group_no, place, in_part, leaf, claimed, _ = (leaves.column(n).to_pylist() for n in names)
    known = {(t, lv, k): d for t, lv, k, d in zip(*(outside.column(n).to_pylist() for n in ("tree", "level", "place", "digest")), strict=True)}
    starts = [i for i in range(len(leaf)) if not i or group_no[i] != group_no[i - 1]]
    ends = [*starts[1:], len(leaf)]
    trees = []
    for i, j in zip(starts, ends, strict=True):
        group, at, n = _numbered(plan, part[i], group_no[i], place[i], in_part[i])
        trees.append((at, _Ways(group, at, leaf[i:j], n, known, arity)))
    first = plan[part[0]].first if part else 0
    top = _Ways(TOP, first, [t.root for _, t in trees], groups, known, arity)
    out: dict[str, list[str]] = {"subroot": [], "proof": [], "folded_root": []}
    for no, (i, j) in enumerate(zip(starts, ends, strict=True)):
        at, tree = trees[no]
        above = top.of(first + no)
        suffix = "".join(left + right for left, right in above)
        for k in range(i, j):
            way = tree.of(at + k - i)
            digest = claimed[k]
            for left, right in way:
                digest = sha256((left + digest + right).encode()).hexdigest()
            for left, right in above:
                digest = sha256((left + digest + right).encode()).hexdigest()
            out["subroot"].append(tree.root)
            out["proof"].append("".join(left + right for left, right in way) + suffix)
            out["folded_root"].append(digest)
    columns = [leaves.column("order_key"), leaves.column("leaf"), pa.array(out["subroot"], pa.string()), pa.array([top.root] * len(leaf), pa.string())]
    columns += [pa.array(out[n], pa.string()) for n in ("proof", "folded_root")]
    return pa.Table.from_arrays(columns, names=["order_key", "leaf", "subroot", "root", "proof", "folded_root"])


def _open_nodes(leaves: DataFrame, plan: dict[int, Part], groups: int, arity: int) -> DataFrame:
    """What every part leaves unresolved."""
    shared = leaves.sparkSession.sparkContext.broadcast(plan)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests: dict[int, Forest] = {}
        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("part", "group_no", "place", "in_part", "leaf"))
            for part, group_no, place, in_part, leaf in zip(*columns, strict=True):
                group, at, n = _numbered(shared.value, part, group_no, place, in_part)
                forests.setdefault(part, Forest(groups, arity)).add(group, 0, at, leaf, n)
        for part, forest in forests.items():
            rows = [(part, *r) for r in forest.rows()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                ["part", "tree", "level", "place", "leaves", "digest"],
            )

    return materialize(leaves.mapInArrow(fold, _NODES), "merkle_open")


def _reduced(nodes: DataFrame, groups: int, arity: int) -> Forest:
    """The root and the nodes between the folds, by a tree of merges."""

    def fold(rows: Iterator) -> Iterator[Forest]:
        inner = Forest(groups, arity)
        for r in rows:
            inner.add(r["tree"], r["level"], r["place"], r["digest"], r["leaves"])
        yield Forest(groups, arity, keep=True).merged(inner)

    return nodes.drop("part").rdd.mapPartitions(fold).treeReduce(Forest.merged)


def proofs(leaves: DataFrame, arity: int = ARITY, part_rows: int = PART_ROWS) -> DataFrame:
    """order_key, leaf, subroot, root, proof, folded_root of rows (group_key, order_key, leaf, claimed).

    ``proof`` is what stands beside the way from the leaf over its group's root to the root,
    concatenated; ``folded_root`` is the root that the digest ``claimed`` leads to with it.
    """
    spark = leaves.sparkSession
    leaves = _sorted_parts(materialize(leaves.select("group_key", "order_key", "leaf", "claimed"), "merkle_rows"), part_rows)
    plan, groups = _plan(leaves)
    schema = _PROOFS.format(dict(leaves.dtypes)["order_key"])
    if not plan:
        return spark.createDataFrame([], schema)
    folds = isqrt(len(plan) - 1) + 1
    nodes = _open_nodes(leaves, plan, groups, arity).repartitionByRange(folds, "part")
    top = spark.sparkContext.broadcast(_reduced(nodes, groups, arity).nodes)
    shared = spark.sparkContext.broadcast(plan)

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, parts = Forest(groups, arity, keep=True), set()
        for batch in batches:
            for r in batch.to_pylist():
                parts.add(r["part"])
                forest.add(r["tree"], r["level"], r["place"], r["digest"], r["leaves"])
        known = top.value | forest.nodes
        for part in sorted(parts):
            rows = [(part, *node, known[node]) for node in dict.fromkeys(_needed(shared.value[part], groups, arity)) if node in known]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)],
                    ["part", "tree", "level", "place", "digest"],
                )

    beside = nodes.mapInArrow(outside, "part int, tree long, level int, place long, digest string")

    def prove(rows: pa.Table, around: pa.Table) -> pa.Table:
        return _prove(rows, around, shared.value, groups, arity)

    return leaves.drop("group_key").groupBy("part").cogroup(beside.groupBy("part")).applyInArrow(prove, schema)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", changed: dict[str, Column] | None = None, arity: int = ARITY, part_rows: int = PART_ROWS) -> DataFrame:
    """Proofs of all rows; ``changed`` gives other values of fields, whose leaves are then folded instead."""
    changed = changed or {}
    leaf = leaf_digest(*(F.col(f) for f in fields))
    claimed = leaf_digest(*(changed.get(f, F.col(f)) for f in fields)) if changed else leaf
    rows = docs.select(F.col(group).alias("group_key"), F.col(order).alias("order_key"), leaf.alias("leaf"), claimed.alias("claimed"))
    return proofs(rows, arity, part_rows)


def group_roots(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", arity: int = ARITY) -> DataFrame:
    """A manifest to publish: (group, rows, subroot, root)."""
    keyed = docs.select(F.col(group).alias("group_key"), F.struct(F.col(group).alias("group"), F.col(order).alias("order")).alias("order_key"), leaf_digest(*(F.col(f) for f in fields)).alias("leaf"))
    found = proofs(keyed.withColumn("claimed", F.col("leaf")), arity)
    return found.groupBy(F.col("order_key.group").alias("group")).agg(F.count(F.lit(1)).alias("rows"), F.first("subroot").alias("subroot"), F.first("root").alias("root"))


def tampered_check(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; texts of ids with an even checksum are read without line feeds."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(docs, changed={"text": text}, part_rows=part_rows)
    return found.select(
        F.col("order_key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


#: The same by recursion over levels.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text,
    CASE WHEN (list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) & 1 = 1
      THEN replace(text, chr(10), '') ELSE text END AS read
  FROM documents
), l AS (
  SELECT doc_id, source,
    sha256(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END || f || CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END) AS leaf,
    sha256(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END || f || CASE WHEN read IS NULL THEN '-' ELSE concat(strlen(read), ':', read) END) AS claimed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i
  FROM (SELECT *,
    CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END ||
    CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END ||
    CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END AS f FROM d)
), n AS (
  SELECT 0 AS lv, source, i, leaf AS h, count(*) OVER (PARTITION BY source) AS w FROM l
  UNION ALL
  SELECT lv + 1, source, i // 3, sha256(string_agg(h, '' ORDER BY i)), (w + 2) // 3 FROM n WHERE w > 1 GROUP BY lv, source, i // 3, w
), t AS (
  SELECT 0 AS lv, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h, source, count(*) OVER () AS w FROM n WHERE w = 1
  UNION ALL
  SELECT lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), NULL, (w + 2) // 3 FROM t WHERE w > 1 GROUP BY lv, i // 3, w
), nodes AS (
  SELECT source, FALSE AS top, lv, i, h, w FROM n WHERE w > 1
  UNION ALL SELECT NULL, TRUE, lv, i, h, w FROM t WHERE w > 1
), s AS (
  SELECT a.source, a.top, a.lv, a.i,
    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lefts, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rights
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.top = b.top AND a.lv = b.lv AND a.i // 3 = b.i // 3
  GROUP BY a.source, a.top, a.lv, a.i
), g AS (
  SELECT t.source, t.i AS no, t.h AS subroot, (SELECT max(lv) FROM n WHERE n.source IS NOT DISTINCT FROM t.source) AS levels FROM t WHERE lv = 0
), steps AS (
  SELECT max(lv) AS above FROM t
), f AS (
  SELECT l.doc_id, l.leaf, g.source, g.no, g.subroot, g.levels, CAST(0 AS BIGINT) AS step, l.i AS place, l.claimed AS h, '' AS proof
  FROM l JOIN g ON l.source IS NOT DISTINCT FROM g.source
  UNION ALL
  SELECT f.doc_id, f.leaf, f.source, f.no, f.subroot, f.levels, f.step + 1,
    CASE WHEN f.step + 1 = f.levels THEN f.no ELSE f.place // 3 END, sha256(s.lefts || f.h || s.rights), f.proof || s.lefts || s.rights
  FROM (SELECT *, CASE WHEN step = 0 AND levels = 0 THEN no ELSE place END AS at FROM f) f
  JOIN s ON s.top = (f.step >= f.levels) AND s.lv = f.step - CASE WHEN f.step >= f.levels THEN f.levels ELSE 0 END
    AND s.i = f.at AND (s.top OR s.source IS NOT DISTINCT FROM f.source)
)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM f, steps, (SELECT h FROM t WHERE w = 1) r WHERE step = levels + above
"""
