"""Vector search with pivots against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelode.operators import scoring, vectors
from pagelode.operators.vectors import Nearest

ITEMS = "item long, ord long, vector array<double>"


def visited(data, asked, k, shard=512):
    best = Nearest(asked, k)
    for at in range(0, len(data), shard):
        part = data[at : at + shard]
        row = vectors._row([str(i) for i in range(at, at + len(part))], np.arange(at, at + len(part)), part)
        get = lambda n: row.column(row.schema.get_field_index(n))[0].values  # noqa: B023, E731
        cell = get("cell").to_numpy()
        best.visit(np.array(get("item").to_pylist(), object), get("ord").to_numpy(), get("vector").to_numpy().reshape(part.shape), get("angle").to_numpy(), cell, get("pivot").to_numpy().reshape(len(cell), -1))
    return best


def all_products(data, asked, k):
    out = []
    for q, scores in enumerate(asked @ data.T):
        order = np.lexsort((np.arange(len(data)), -np.floor(scores * 1e9 + 0.5)))[:k]
        out += [(q, int(i)) for i in order]
    return out


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("k", [1, 10])
def test_clusters_need_few_products(k):
    rng = np.random.default_rng(1)
    centres = unit(rng.normal(size=(40, 32)))
    data = unit(centres[rng.integers(40, size=4000)] + 0.04 * rng.normal(size=(4000, 32)))
    asked = unit(centres[rng.integers(40, size=60)] + 0.04 * rng.normal(size=(60, 32)))
    best = visited(data, asked, k)
    assert list(zip(best.rows[0].tolist(), best.rows[2].tolist(), strict=True)) == all_products(data, asked, k)
    assert best.products < 0.5 * best.pairs


@pytest.mark.parametrize("kind", ["normal", "lengths", "copies", "line", "zeros", "opposite"])
def test_equal_to_all_products(kind):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(1500, 8))
    if kind == "lengths":
        data *= rng.exponential(size=(1500, 1)) * 10
    elif kind == "copies":
        data = data[rng.integers(30, size=1500)]
    elif kind == "line":
        data = np.outer(rng.normal(size=1500), data[0])
    elif kind == "zeros":
        data[::3] = 0
    asked = -data[:40] if kind == "opposite" else np.r_[data[:30], rng.normal(size=(10, 8)), np.zeros((1, 8))]
    best = visited(data, asked, 7)
    assert list(zip(best.rows[0].tolist(), best.rows[2].tolist(), strict=True)) == all_products(data, asked, 7)


def test_rows(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 4))
    rows = [(i, i, v.tolist()) for i, v in enumerate(data)] + [(900, 900, None), (901, 901, [1.0, 2.0]), (902, 902, [])]
    items = spark.createDataFrame(rows, ITEMS).repartition(5)
    queries = items.where("item % 10 = 0").select(F.col("item").alias("query_id"), "vector")
    found = vectors.search(queries, items, 4, block=7)
    got = sorted((r["query_id"], r["rank"], r["item"]) for r in scoring.ranked(found, 4).collect())
    asked = data[::10]
    want = [(q * 10, n % 4 + 1, i) for n, (q, i) in enumerate(all_products(data, asked, 4))]
    assert got == want
    total = found.agg(F.sum("pairs"), F.sum("products")).first()
    assert total[0] == 30 * 300 and total[1] > 0
    assert vectors.search(queries, items.limit(0), 4).count() == vectors.search(queries.limit(0), items, 4).count() == 0
