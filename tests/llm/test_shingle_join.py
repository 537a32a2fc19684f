import random

import numpy as np
import pytest

from pagelode.llm import shingle_join
from pagelode.llm.components import connected_components
from pagelode.llm.text import lower_bytes

SCHEMA = "doc_id long, text string, node string, n int"


def shingles(text, width):
    w = lower_bytes(text).split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, num, den):
    sets = [shingles(t, width) for _, t, *_ in rows]
    part = list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    part[find(i)] = find(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        least.setdefault(find(i), []).append(doc_id)
    return sorted((doc_id, len(sets[i]), min(least[find(i)])) for i, (doc_id, *_) in enumerate(rows))


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    common = " ".join(rng.choices(vocabulary, k=25))
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(words) + 1)
                words[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            texts.append(" ".join(words) or "A")
        elif kind < 0.75:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 6))))
        else:
            texts.append(" ".join([*rng.choices(vocabulary, k=rng.randint(3, 150)), common if rng.random() < 0.5 else ""]))
    return [(i, t, "x", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "width", "num", "den", "block"), [(1, 3, 90, 100, 10**6), (2, 5, 4, 5, 10**6), (3, 3, 90, 100, 300), (4, 5, 4, 5, 200)])
def test_equals_brute_force(spark, seed, width, num, den, block):
    rows = corpus(seed)
    rows += [(1000, None, "x", 1), (1001, "", None, None), (1002, " \t", "x", 1), (1003, "One Two", "x", 1), (1004, "one two", "x", 1), (5, rows[5][1], "x", 1)]
    got = shingle_join.similarity_components(spark.createDataFrame(rows, SCHEMA), width, num, den, block)
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got.collect()) == brute(rows, width, num, den)


@pytest.mark.parametrize("seed", range(30))
def test_tree(seed):
    rng = random.Random(seed)
    sets = []
    for _ in range(40):
        base = set(rng.choice(sets)) if sets and rng.random() < 0.7 else set(rng.sample(range(300), rng.randint(1, 60)))
        for _ in range(rng.randint(0, 3)):
            base ^= {rng.randrange(300)}
        sets.append(tuple(base or {1}))
    sets = sorted(set(map(frozenset, sets)), key=sorted)
    tree = shingle_join.PrefixTree([np.array(sorted(s), np.uint64) for s in sets], 4, 5)
    for i, j in tree.join():
        assert 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                assert tree._find(i) == tree._find(j)


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
def test_linked_sets_share_a_signature(num, den):
    rng = np.random.default_rng(5)
    windows = shingle_join.Windows(num, den)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        other = np.unique(np.concatenate([base[int(rng.integers(0, n // 6 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)]))
        base = np.unique(base)
        both = len(np.intersect1d(base, other))
        union = len(base) + len(other) - both
        if den * both >= num * union and both < union:
            assert len(np.intersect1d(windows.signatures(base), windows.signatures(other)))


def test_common_passages_do_not_cluster(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join([passage, *(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([20, 60, 200])))]), "x", 1) for i in range(80)]
    rows += [(100 + i, t + " more", "x", 1) for i, t, *_ in rows[:20]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = shingle_join.similarity_components(df, 3, 4, 5).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == brute(rows, 3, 4, 5)
    assert 40 <= shingle_join.unsettled(df, 3, 4, 5).count() < 90


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(4, text, "x", 1), (9, text + " end", "x", 1), (7, "other words here now then", "x", 1), (8, None, "x", 1), (6, "", "x", 1)]
    assert sorted(x["doc_id"] for x in shingle_join.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()) == [4, 6, 7, 8]
    rows += [(4, text, "x", 1), (7, "quite another text of words", "x", 1), (None, "nobody knows whose text this", "x", 1)]
    got = shingle_join.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(x["doc_id"] or -1 for x in got) == [-1, 4, 6, 7, 7, 8]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert shingle_join.unsettled(df, 3, 9, 10).count() == 0
    assert shingle_join.similarity_components(df).count() == 0 and shingle_join.one_of_each(df).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    seen = {x: x for e in edges for x in e}

    def find(x):
        while seen[x] != x:
            x = seen[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        seen[b] = a
    assert got == {x: find(x) for x in seen}
