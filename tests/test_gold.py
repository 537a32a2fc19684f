from pagelode.plans.queries import query_table


def test_gold_of_common_and_repeated_lines_against_brute_force(spark, tmp_path):
    common = "a line that very many documents share"
    lines = [f"own line number {i:03d} of a document" for i in range(30)]
    nodes = [(lines[i % 30] if k else common, f"d{i:02d}", f"d{i:02d}_p{k}", f"d{i:02d}_n{k}_{copy}") for i in range(60) for k in range(3) for copy in range(2)]
    nodes.append((None, "d00", "d00_p9", "d00_n9"))
    questions = [(1, f"{lines[7]}\n{lines[7]}\nshort"), (2, f"{common}\n{lines[29]}"), (3, "nothing here that any node holds"), (4, lines[29]), (5, None), (6, "")]
    spark.createDataFrame(questions, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = query_table(spark, str(tmp_path), spark.createDataFrame(nodes, "text string, doc_id string, page_id string, node_id string"))
    assert got.count() == len(questions)
    for row in got.collect():
        asked = {x for x in (dict(questions)[int(row["query_id"])] or "").split("\n") if len(x) >= 20}
        hits = [n for n in nodes if n[0] in asked]
        doc = min((n[1] for n in hits), default="")
        assert row["doc_id"] == doc and row["is_answerable"] == bool(hits)
        assert row["evidence_page_ids"] == sorted({n[2] for n in hits if n[1] == doc})
        assert row["evidence_node_ids"] == sorted({n[3] for n in hits if n[1] == doc})
