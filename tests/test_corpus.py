"""Corpus search against plain scorers: blocks of questions, a vocabulary beyond its bound, ties, and questions without hits."""

import random

import pytest
from model import bm25, order, tfidf
from pyspark.sql import functions as F

from pagelode.operators import corpus, scoring
from pagelode.store import numbered

WORDS = [f"w{k}" for k in range(40)]


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, weights=[40 / (k + 1) for k in range(40)], k=rng.randint(1, 25))) for _ in range(n)]


@pytest.mark.parametrize(("method", "plain"), [("bm25", bm25), ("tfidf", tfidf)])
@pytest.mark.parametrize("most", [1_000_000, 7])
def test_blocks_and_rare_tokens(spark, method, plain, most):
    docs = [*texts(90, 1), "w1 w2", "w1 w2", "!?"]
    asked = [*texts(7, 2), "w1 w1 w2", "nothing known here", "!?"]
    items = spark.createDataFrame([(f"i{k}", k, t) for k, t in enumerate(docs)], "item string, ord long, score_text string").repartition(5)
    queries = spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(asked)], "query_id string, question string")
    found = corpus.search(queries, items, method, 6, block=4, vocabulary=most)
    got = {}
    for r in scoring.ranked(found, 6).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["ord"], r["score"])
    for k, q in enumerate(asked):
        scores = plain(docs, q)
        want = [i for i in order(scores, 6) if scores[i] > 0]
        mine = got.get(f"q{k}", {})
        assert [mine[r][0] for r in sorted(mine)] == want
        assert [mine[r][1] for r in sorted(mine)] == pytest.approx([scores[i] for i in want])


def test_missing_hits_are_filled_in_order(spark):
    items = spark.createDataFrame([(f"i{k}", k, f"w{k % 3}") for k in range(5)], "item string, ord long, score_text string")
    queries = spark.createDataFrame([("a", "w2"), ("b", "none"), ("c", "")], "query_id string, question string")
    got = sorted((r["query_id"], r["rank"], r["item"]) for r in scoring.corpus_top_k(queries, items, "bm25", 3).collect())
    assert got == [("a", 1, "i2"), ("a", 2, "i0"), ("a", 3, "i1"), *((q, r + 1, f"i{r}") for q in "bc" for r in range(3))]
    none = spark.createDataFrame([], "item string, ord long, score_text string")
    assert scoring.corpus_top_k(queries, none, "tfidf", 3).count() == 0
    assert scoring.corpus_top_k(queries.limit(0), items, "bm25", 3).count() == 0


def test_vectors(spark):
    rng = random.Random(3)
    rows = [(k, k, [rng.uniform(-1, 1) for _ in range(4)]) for k in range(50)] + [(60, 60, None)]
    items = spark.createDataFrame(rows, "item long, ord long, vector array<double>").repartition(4)
    queries = items.where("item % 10 = 0").select(F.col("item").alias("query_id"), "vector")
    got = {}
    for r in scoring.ranked(corpus.search(queries, items, "dense", 4, block=2), 4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["item"]
    vectors = {k: v for k, _, v in rows if v}
    for q in range(0, 50, 10):
        score = {k: sum(a * b for a, b in zip(v, vectors[q], strict=True)) for k, v in vectors.items()}
        assert [got[q][r] for r in range(1, 5)] == sorted(score, key=lambda k: -round(score[k], 9))[:4]
    assert 60 not in got


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(7)
    assert sorted((r["no"], r["x"]) for r in numbered(df, "no", "x").collect()) == [(k + 1, k) for k in range(1000)]
    assert numbered(df.limit(0), "no", "x").count() == 0


@pytest.mark.parametrize("method", ["bm25", "tfidf"])
def test_questions_that_an_index_cannot_tell_apart_are_searched_once(spark, method, monkeypatch):
    docs = texts(60, 8)
    kinds = [*texts(3, 9), "w1 w1 w2"]
    asked = {f"q{k:03}": f"{kinds[k % 4]} unknown{k}" + " unknown0 other" * (k % 8 == 3) for k in range(80)} | {"none": "nothing", "empty": ""}
    items = spark.createDataFrame([(f"i{k}", k, t) for k, t in enumerate(docs)], "item string, ord long, score_text string").repartition(3)
    queries = spark.createDataFrame(list(asked.items()), "query_id string, question string")
    shown = lambda: {(r["query_id"], r["rank"]): (r["item"], round(r["score"], 9)) for r in scoring.corpus_top_k(queries, items, method, 4).collect()}
    one_by_one, searched = shown(), []
    monkeypatch.setattr(scoring, "QUESTIONS", 10)
    search = scoring.corpus.search
    monkeypatch.setattr(scoring.corpus, "search", lambda q, *a, **b: searched.append(q.count()) or search(q, *a, **b))
    assert len(one_by_one) == 82 * 4 and shown() == one_by_one
    assert searched == [4 if method == "bm25" else 5]
