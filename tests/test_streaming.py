from pagelode.operators import retrieval as rt
from pagelode.schemas import QUERIES
from pagelode.streaming import scoring as st


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.createDataFrame([(f"d{k}", f"p{k}", 1, t, "", k) for k, t in enumerate(["alpha beta", "beta", "gamma delta", "alpha"])], "doc_id string, page_id string, page_index int, page_text string, ocr_text string, ord long")
    items = rt.page_items(pages)
    index = st.bm25_index(items)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(f"q{k}", q) for k, q in enumerate(["alpha", "beta beta", "unknown", "gamma alpha"])]
    spark.createDataFrame(rows, "query_id string, question string").repartition(2).write.parquet(source)
    stream = spark.readStream.schema("query_id string, question string").option("maxFilesPerTrigger", 1).parquet(source)
    query = st.score_stream(stream, index, items, lambda df, n: df.drop("metadata").write.mode("append").parquet(out), str(tmp_path / "state"), 3)
    query.processAllAvailable()
    query.stop()
    queries = spark.createDataFrame([(i, "d", "", q, "", "", [], [], [], True, {}) for i, q in rows], QUERIES)
    shown = lambda df: sorted((r["query_id"], r["rank"], r["page_id"], round(r["score"], 9)) for r in df.collect())
    assert shown(spark.read.parquet(out)) == shown(rt.retrieve_pages(queries, pages, "bm25", 3))
