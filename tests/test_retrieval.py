import pytest

from pagelode.operators import evidence as ev
from pagelode.operators import metrics as mt
from pagelode.operators import retrieval as rt
from pagelode.operators import sufficiency as sf
from pagelode.schemas import HITS, NODES, PAGES, QUERIES

# Texts, questions, annotations and messages of the cases in this file.


def pages(spark, rows):
    return spark.createDataFrame([(d, p, 1, t, "", "", None, None, {}, k) for k, (d, p, t) in enumerate(rows)], PAGES)


def nodes(spark, rows):
    return spark.createDataFrame([(n, d, p, kind, None, t, "", None, k, "", None, {"page_index": str(idx)}, k) for k, (d, p, n, kind, t, idx) in enumerate(rows)], NODES)


def query(spark, doc="doc1", question="2025年营业收入是多少？", kind="numeric", gold=(), gold_nodes=(), answer="", **meta):
    return spark.createDataFrame([("q1", "d", doc, question, answer, kind, list(gold), list(gold_nodes), [], True, meta)], QUERIES)


TWO = [("doc1", "doc1_p1", "普通说明"), ("doc1", "doc1_p2", "营业收入 100 元")]
TWO_NODES = [("doc1", "doc1_p1", "doc1_p1_n1", "paragraph", "普通说明", 1), ("doc1", "doc1_p2", "doc1_p2_n1", "table_row", "营业收入 100 元", 2)]


def top(hits):
    return hits.orderBy("query_id", "rank").collect()


def test_scope_changes_statistics_and_keeps_zero_scores(spark):
    p = pages(spark, [("doc1", "doc1_p1", "本页是目标年报的普通说明"), ("doc2", "doc2_p1", "营业收入 999 元")])
    q = query(spark, question="营业收入？")
    assert top(rt.retrieve_pages(q, p, "bm25", 1))[0]["doc_id"] == "doc2"
    inside = top(rt.retrieve_pages(q, p, "bm25", 5, "document"))
    assert [(h["page_id"], h["score"]) for h in inside] == [("doc1_p1", 0.0)]


def test_retrievers(spark):
    p, n, q = pages(spark, TWO), nodes(spark, TWO_NODES), query(spark, gold=["doc1_p1"])
    run = lambda kind, **o: top(rt.retrieve(q, p, n, {"type": kind, **o}))
    found = run("global_region", method="bm25")
    assert (found[0]["node_id"], found[0]["retriever"]) == ("doc1_p2_n1", "global_region")
    found = run("hybrid_page", page_methods=["bm25", "tfidf"])
    assert (found[0]["page_id"], found[0]["retriever"]) == ("doc1_p2", "hybrid_page")
    found = run("hybrid_page_region", page_methods=["bm25", "tfidf"], region_method="bm25")
    assert (found[0]["node_id"], found[0]["retriever"]) == ("doc1_p2_n1", "hybrid_page_region")
    found = run("page_region", page_retriever="bm25", region_method="tfidf", region_top_k=1)
    assert [h["node_id"] for h in found] == ["doc1_p2_n1"]
    found = run("oracle_page_region", method="bm25")
    assert [(h["node_id"], h["retriever"]) for h in found] == [("doc1_p1_n1", "oracle_page_region")]
    assert {h["retriever"] for h in run("layout_node", node_types=["table_row"])} == {"dense:tfidf_fallback"}
    with pytest.raises(ValueError, match="Unsupported retriever"):
        run("other")
    with pytest.raises(ValueError, match="scope"):
        run("bm25_page", search_scope="nowhere")


def test_ocr_text_stands_in(spark):
    p = spark.createDataFrame([("d", "p1", 1, "", "", "scanned revenue", None, None, {}, 0), ("d", "p2", 2, "other", "", "", None, None, {}, 1)], PAGES)
    hit = top(rt.retrieve_pages(query(spark, doc="d", question="revenue"), p, "bm25", 1))[0]
    assert (hit["page_id"], hit["text"]) == ("p1", "scanned revenue")


def evidence(spark, rows, q=None, **options):
    n = nodes(spark, rows)
    p = pages(spark, sorted({(r[0], r[1], r[4]) for r in rows}))
    options = {"type": "evidence_set_region", "page_methods": ["bm25", "tfidf"], "region_method": "bm25", **options}
    return top(rt.retrieve(q or query(spark, answer_unit="元"), p, n, options))


def test_evidence_set(spark):
    weak, strong = ("doc1", "doc1_p1", "doc1_p1_n1", "paragraph", "营业收入相关说明", 1), ("doc1", "doc1_p2", "doc1_p2_n1", "table_row", "营业收入 2025 年 100 元", 2)
    other = ("doc2", "doc2_p1", "doc2_p1_n1", "table_row", "营业收入 2025 年 999 元", 1)
    found = evidence(spark, [weak, strong, other])
    assert [h["node_id"] for h in found] == ["doc1_p2_n1", "doc1_p1_n1"]
    m = found[0]["metadata"]
    assert "global_region" in m["candidate_sources"] and m["evidence_set_rank"] == 1
    assert {"metric:营业收入", "year:2025", "unit:元", "numeric_shape"} <= set(m["coverage_slots"])
    split = [("doc1", "doc1_p1", "a", "paragraph", "单位：元 项目 2025 年", 1), ("doc1", "doc1_p1", "b", "table_row", "营业收入 100", 1), ("doc1", "doc1_p1", "c", "paragraph", "无关", 1)]
    assert {h["node_id"] for h in evidence(spark, split)[:2]} == {"a", "b"}
    cover = query(spark, question="这份年度报告对应的报告年度是哪一年？", kind="fact")
    found = evidence(spark, [("doc1", "doc1_p2", "x", "paragraph", "其他内容", 2), ("doc1", "doc1_p1", "y", "paragraph", "2025 年年度报告 证券代码", 1)], cover)
    assert found[0]["node_id"] == "y" and "cover_anchor" in found[0]["metadata"]["candidate_sources"]


def test_structured_scan(spark):
    row, story = "营业收入 233,432,768,960.43 343,176,440,712.96 -31.98%", "营业收入为人民币 2,334 亿元，管理层确认收入时点存在审计风险"
    features = ev.question_features(query(spark, answer_unit="元"))
    alone = nodes(spark, [("doc1", "p1", "row", "table_row", row, 1), ("doc1", "p2", "story", "table_row", story, 1)])
    got = {r["node_id"]: r for r in ev.structured_candidates(features, alone).collect()}
    assert got["row"]["structured_rank"] == 1 and got["row"]["structured_score"] > got["story"]["structured_score"]
    header = nodes(spark, [("doc1", "p1", "head", "paragraph", "单位：元 项目 2025 年 2024 年 本年比上年增减 2023 年", 1), ("doc1", "p1", "row", "table_row", row, 1)])
    better = {r["node_id"]: r["structured_score"] for r in ev.structured_candidates(features, header).collect()}
    assert better["row"] > got["row"]["structured_score"]


def hits(spark, rows):
    return spark.createDataFrame([("q1", r, 1.0, "d", p, n, "paragraph" if n else None, t, "x", None) for r, p, n, t in rows], HITS)


def test_metrics(spark):
    q = query(spark, gold=["p1"], gold_nodes=["n1"])
    got = mt.evaluate(q, hits(spark, [(1, "p1", "n1", "")])).first()
    assert (got["page_recall@1"], got["region_hit@5"], got["mrr"], got["ndcg@5"]) == (1, 1, 1, 1)
    q = query(spark, gold=["p1"], gold_nodes=["n2"])
    got = mt.evaluate(q, hits(spark, [(1, "p1", "n1", ""), (2, "p1", "n2", "")])).first()
    assert got["ndcg@5"] == pytest.approx(0.6309, abs=1e-4) and got["mrr"] == 0.5
    got = mt.evaluate(q, hits(spark, [])).first()
    assert set(got) == {0.0}
    assert mt.error_rows(q, hits(spark, [])).count() == 1


@pytest.mark.parametrize(
    ("text", "node", "missing", "status"),
    [
        ("项目 2025 年 营业收入 100 元", "n1", [], "sufficient"),
        ("项目 2025 年 营业收入", "n1", ["unit", "value"], "partial"),
        ("项目 2025 年 营业收入 100 元", "wrong_n1", [], "citation_mismatch"),
        ("无关", "n1", ["metric", "year", "unit", "value"], "insufficient"),
    ],
)
def test_sufficiency(spark, text, node, missing, status):
    q = query(spark, gold_nodes=["n1"], answer="100 元", answer_unit="元", raw_answer_value="100")
    got = sf.cases(q, hits(spark, [(1, "p1", node, text)])).first()
    assert (got["missing_items"], got["status"]) == (missing, status)


def test_sufficiency_of_a_fact(spark):
    q = query(spark, question="这份年度报告对应的报告年度是哪一年？", kind="fact", answer="2025", gold_nodes=["n1"])
    assert sf.cases(q, hits(spark, [(1, "p1", "n1", "2025 年年度报告")])).first()["covered_items"] == ["value"]
    rates = sf.rates(sf.cases(q, hits(spark, []))).first()
    assert rates["queries"] == 1 and rates["status_insufficient"] == 1


def test_values_in_text(spark):
    from pyspark.sql import functions as F

    from pagelode.functions import text as tx

    rows = [("(98,812.49)", "经营活动产生的现金流量净额(98,812.49)万元"), ("-31.98%", "营业收入233,432,768,960.43同比-31.98%"), ("233,432,768,960.43", "营业收入233,432,768,960.43343,176,440,712.96"), ("5", "六")]
    got = spark.createDataFrame(rows, "v string, t string").select(tx.value_in_text(F.col("v"), F.col("t")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, True, True, False]
