"""The kept index against plain scorers: versions, removals, shards, questions in blocks, skipped blocks, documents, a stream."""

import random

import pytest
from model import bm25, order, tfidf
from pyspark.sql import functions as F

from pagelode.operators import index as ix
from pagelode.operators import retrieval as rt
from pagelode.operators import scoring
from pagelode.operators.index import TextIndex
from pagelode.schemas import QUERIES
from pagelode.sources import files
from pagelode.streaming import scoring as st

WORDS = [f"w{k}" for k in range(60)]
ITEMS = "item string, doc_id string, ord long, score_text string"


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, weights=[60 / (k + 1) for k in range(60)], k=rng.randint(1, 30))) for _ in range(n)]


def items_of(spark, docs, first=0):
    return spark.createDataFrame([(f"i{k}", f"d{k % 7}", k, t) for k, t in enumerate(docs, first)], ITEMS).repartition(3)


def found(index, queries, method, k=6, **options):
    got = {}
    for r in scoring.ranked(index.search(queries, method, k, **options), k).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["ord"], r["score"])
    return {q: [rows[r] for r in sorted(rows)] for q, rows in got.items()}


def expected(docs, asked, plain, k=6):
    """``docs``: ord to text."""
    out, ords = {}, sorted(docs)
    for q, text in asked.items():
        scores = plain([docs[o] for o in ords], text)
        rows = [(ords[i], scores[i]) for i in order(scores, k) if scores[i] > 0]
        if rows:
            out[q] = rows
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q, rows in want.items():
        assert [o for o, _ in got[q]] == [o for o, _ in rows]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in rows])


@pytest.mark.parametrize(("method", "plain"), [("bm25", bm25), ("tfidf", tfidf)])
@pytest.mark.parametrize("vocabulary", [1_000_000, 9])
def test_versions_equal_a_full_recount(spark, method, plain, vocabulary, monkeypatch, tmp_path):
    monkeypatch.setattr(ix, "SHARD_ITEMS", 16)
    monkeypatch.setattr(ix, "BLOCK", 4)
    docs = dict(enumerate([*texts(60, 1), "w1 w2", "w1 w2", "!?", ""]))
    asked = {f"q{k}": t for k, t in enumerate([*texts(5, 2), "w1 w1 w2", "nothing known", ""])}
    queries = spark.createDataFrame(list(asked.items()), "query_id string, question string")
    first = TextIndex.build(items_of(spark, list(docs.values())), f"file://{tmp_path}/index")
    options = {"block": 3, "vocabulary": vocabulary}
    same(found(first, queries, method, **options), expected(docs, asked, plain))
    more = texts(40, 3)
    second = first.append(items_of(spark, more, 100))
    grown = docs | dict(enumerate(more, 100))
    same(found(second, queries, method, **options), expected(grown, asked, plain))
    gone = [0, 5, 61, 62, 63, 101, 120]
    third = second.remove(spark.createDataFrame([(f"i{k}",) for k in [*gone, 9999]], "item string"))
    left = {o: t for o, t in grown.items() if o not in gone}
    same(found(third, queries, method, **options), expected(left, asked, plain))
    fourth = third.remove(spark.createDataFrame([("i0",), ("i7",)], "item string"))
    del left[7]
    same(found(fourth, queries, method, **options), expected(left, asked, plain))
    same(found(first, queries, method, **options), expected(docs, asked, plain))
    # statistics are those of a fresh index
    fresh = TextIndex.build(spark.createDataFrame([(f"i{o}", "d", o, t) for o, t in left.items()], ITEMS))
    rows = lambda i: sorted(map(tuple, i.statistics().collect()), key=str)
    assert rows(fourth) == rows(fresh)
    assert TextIndex.open(spark, first.path).version == fourth.version == first.latest().version == 3


def test_texts_are_read_once(spark, tmp_path):
    """After it is built, the index answers any number of blocks without the texts."""
    path = str(tmp_path / "texts")
    items_of(spark, texts(50, 4)).write.parquet(path)
    index = TextIndex.build(spark.read.parquet(path))
    files.delete(spark, path)
    asked = {f"q{k}": t for k, t in enumerate(texts(30, 5))}
    queries = spark.createDataFrame(list(asked.items()), "query_id string, question string")
    assert len(found(index, queries, "bm25", block=4)) == 30
    plan = index.search(queries, "bm25", 3, block=10)._jdf.queryExecution().toString()
    assert path not in plan


def test_blocks_are_skipped(spark, monkeypatch):
    """Short items about the words come first; a long tail of items that barely mention them is not read."""
    docs = ["apple pear plum"] * 30 + ["apple " + f"x{k} " * 60 for k in range(4000)] + ["pear " + "filler words " * 50] * 2000
    items = items_of(spark, docs).coalesce(1).orderBy("ord")
    index = TextIndex.build(items)
    queries = spark.createDataFrame([("q", "apple pear plum")], "query_id string, question string")
    rows = index.search(queries, "bm25", 10)
    total = rows.agg(F.sum("blocks").alias("blocks"), F.sum("read").alias("read")).first()
    assert total["blocks"] > 90 and total["read"] < 0.2 * total["blocks"]
    assert sorted(r["ord"] for r in scoring.ranked(rows, 10).collect()) == list(range(10))


def test_documents_from_the_index(spark):
    docs = [*texts(60, 6), "!", ""]
    items = items_of(spark, docs).withColumnRenamed("item", "page_id").withColumnRenamed("score_text", "page_text").withColumn("ocr_text", F.lit("")).withColumn("page_index", F.lit(1))
    index = TextIndex.build(rt.page_items(items))
    queries = spark.createDataFrame([(f"q{k}", f"d{k % 9}", "", t, "", "", [], [], [], True, {}) for k, t in enumerate(texts(20, 7))], QUERIES)
    shown = lambda df: sorted((r["query_id"], r["rank"], r["page_id"], round(r["score"], 9)) for r in df.collect())
    for method in ("bm25", "tfidf"):
        with_index = rt.retrieve_pages(queries, items, method, 5, "document", index=index)
        assert shown(with_index) == shown(rt.retrieve_pages(queries, items, method, 5, "document"))


def test_empty(spark):
    none = TextIndex.build(spark.createDataFrame([], ITEMS))
    queries = spark.createDataFrame([("q", "w1")], "query_id string, question string")
    for method in ("bm25", "tfidf"):
        assert none.search(queries, method, 5).count() == 0
        assert TextIndex.build(items_of(spark, ["w1"])).search(queries.limit(0), method, 5).count() == 0
    grown = none.append(items_of(spark, ["w1 w2"]))
    assert [r["ord"] for r in grown.search(queries, "bm25", 5).collect()] == [0]
    with pytest.raises(FileNotFoundError):
        TextIndex.open(spark, "file:///tmp/no-such-index")


def test_stream_takes_new_versions(spark, tmp_path):
    docs = ["alpha beta", "beta", "gamma delta", "alpha"]
    pages = spark.createDataFrame([(f"d{k}", f"p{k}", 1, t, "", k) for k, t in enumerate([*docs, "alpha alpha"])], "doc_id string, page_id string, page_index int, page_text string, ocr_text string, ord long")
    old, new = pages.where("ord < 4"), pages.where("ord = 4")
    index = st.bm25_index(rt.page_items(old))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    ask = lambda name, q: spark.createDataFrame([(name, q)], "query_id string, question string").write.mode("append").parquet(source)
    ask("before", "alpha")
    stream = spark.readStream.schema("query_id string, question string").parquet(source)
    query = st.score_stream(stream, index, lambda: rt.page_items(pages), lambda df, n: df.drop("metadata").write.mode("append").parquet(out), str(tmp_path / "state"), 2)
    query.processAllAvailable()
    index.append(rt.page_items(new)).remove(spark.createDataFrame([("p3",)], "item string"))
    ask("after", "alpha")
    query.processAllAvailable()
    query.stop()
    got = {(r["query_id"], r["rank"]): r["page_id"] for r in spark.read.parquet(out).collect()}
    assert got == {("before", 1): "p3", ("before", 2): "p0", ("after", 1): "p4", ("after", 2): "p0"}


def test_long_items_make_shards_of_bounded_size(spark):
    """A shard ends with the item that reaches the bound, however many items a batch brings."""
    rows = [(f"i{k}", "d", k, "w1 w2 " * 200_000) for k in range(6)]
    index = TextIndex.build(spark.createDataFrame(rows, ITEMS).coalesce(1))
    sizes = [sum(r["size"]) for r in index.shards().select("size").collect()]
    assert sum(sizes) == 2_400_000 and max(sizes) < ix.SHARD_POSTINGS + 400_001
    assert index.total == (6, 400_000.0)
