import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values())
    numbered = [n for n in queries if n.startswith("op")]
    assert not numbered or {n.split("_")[0] for n in numbered} >= {f"op{k}" for k in range(1, 11)}


def test_flagship(spark):
    first = entry.queries()["bm25_page_corpus"](spark, "/root/testdata/sf0.001")
    assert {"query_id", "rank", "score"} <= set(first.columns)
