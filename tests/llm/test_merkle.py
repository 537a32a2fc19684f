import random
import zlib
from hashlib import sha256

import duckdb
import pytest

from pagelode.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, part int"


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    return _h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*row[:4], text)))


def _levels(nodes):
    found = [nodes]
    while len(nodes) > 1:
        nodes = [_h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        found.append(nodes)
    return found


def _steps(levels, at):
    for nodes in levels[:-1]:
        run = at // 3 * 3
        yield nodes[run:at], nodes[at + 1 : run + 3]
        at //= 3


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(r)
    trees = []
    for key in sorted(groups):
        members = sorted(groups[key], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[4])))
        trees.append((members, _levels([_leaf(r, r[4]) for r in members])))
    top = _levels([t[1][-1][0] for t in trees])
    for no, (members, levels) in enumerate(trees):
        for i, r in enumerate(members):
            steps = [*_steps(levels, i), *_steps(top, no)]
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = _leaf(r, r[4].replace("\n", "") if even and r[4] is not None else r[4])
            for left, right in steps:
                h = _h(*left, h, *right)
            yield r[0], levels[0][i], levels[-1][0], top[-1][0], _h(*(x for s in steps for y in s for x in y)), h, h == top[-1][0]


@pytest.mark.parametrize("part_rows", [7, 64, 50_000])
def test_against_brute_force(spark, part_rows):
    random.seed(part_rows)
    rows = [(i, random.choice(["a", "a", "a", "b", None, "é", "Z"]), random.choice(["en", None]), random.choice([5, None]), random.choice(["one\ntwo", "plain", "", None]), "x", 1) for i in range(200)]
    rows += [(1000 + i, f"only{i}", None, None, "\n", "x", 1) for i in range(40)]
    rows += [(5, "a", None, 1, "twice\n", "x", 1)] * 3 + [(None, "a", None, None, None, "x", 1), (None, None, None, None, "\n", "x", 1), (7, "z", "en", 1, "long\n" * 50_000, "x", 1)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in merkle.tampered_check(df, part_rows).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_sizes(spark, n):
    rows = [(i, "s", "en", 1, f"t{i}\n", "x", 1) for i in range(n)]
    got = [tuple(r) for r in merkle.tampered_check(spark.createDataFrame(rows, SCHEMA), 4).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_empty(spark):
    assert merkle.tampered_check(spark.createDataFrame([], SCHEMA)).count() == 0


def test_forests_merge_in_any_order():
    digests = [_h(str(i)) for i in range(50)]
    want = _levels([_levels(digests[:37])[-1][0], _levels(digests[37:])[-1][0]])[-1][0]
    for seed in range(20):
        random.seed(seed)
        parts = [merkle.Forest(2, keep=bool(seed % 2)) for _ in range(6)]
        for i, d in enumerate(digests):
            tree, place, leaves = (0, i, 37) if i < 37 else (1, i - 37, 13)
            random.choice(parts).add(tree, 0, place, d, leaves)
        random.shuffle(parts)
        while len(parts) > 1:
            a = parts.pop(random.randrange(len(parts)))
            b = parts.pop(random.randrange(len(parts)))
            parts.append(a.merged(b))
        assert parts[0].root == want and not parts[0].open


def test_open_nodes_stay_few():
    forest = merkle.Forest(1)
    for i in range(1000, 9000):
        forest.add(0, 0, i, _h(str(i)), 10_000)
    assert sum(map(len, forest.open.values())) < 4 * 10


def test_published_roots(spark):
    rows = [(i, "ab"[i % 2], "en", 1, f"t{i}", "x", 1) for i in range(20)]
    got = {r["group"]: r for r in merkle.group_roots(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {("a" if r[0] % 2 == 0 else "b"): r for r in brute(rows)}
    assert {g: (r["rows"], r["subroot"], r["root"]) for g, r in got.items()} == {g: (10, r[2], r[3]) for g, r in want.items()}


def test_sql_says_the_same():
    rows = [(i, random.choice(["a", None]), None, 3, "x\ny") for i in range(30)]
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, source varchar, lang varchar, n_chars bigint, text varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    assert sorted(con.sql(merkle.ORACLE_SQL).fetchall()) == sorted(brute(rows))
