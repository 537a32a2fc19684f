import json
import random

import model
from pyspark.sql import functions as F

from pagelode.functions import lexicon as lx
from pagelode.operators import evidence as ev
from pagelode.schemas import ANNOTATION_COLUMNS, HITS
from pagelode.sources import prepare as pp
from pagelode.sources import readers as rd
from pagelode.operators import metrics as mt
from pagelode.sources.demo import demo_tables

# Texts, questions, annotations and messages of the cases in this file.


def test_greedy_set_equals_plain_model(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for q in range(60):
        target = {f"s{i}" for i in range(rng.randint(0, 5))}
        cands = []
        for _ in range(rng.randint(1, 9)):
            slots = set(rng.sample(sorted(target), rng.randint(0, len(target))))
            cands.append((slots, len(slots) / max(1, len(target)), rng.choice([0.5, 1.0, 1.5, rng.random()])))
        names = sorted(target)
        bits = lambda s, names=names: sum(1 << names.index(x) for x in s)
        rows += [(f"q{q}", k, bits(s), bits(target), share, score) for k, (s, share, score) in enumerate(cands)]
        want[f"q{q}"] = model.greedy(cands, target, 3, 5)
    df = spark.createDataFrame(rows, "query_id string, ord long, mask long, full long, coverage_score double, combined_score double")
    got = {}
    for r in ev.minimal_set(df).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["ord"])
    assert got == want


def test_text_chunks_equal_plain_model(spark):
    rng = random.Random(5)
    line = lambda: rng.choice(["短行", "营业收入 100", "营业收入", "x" * 130, "　", "资产总额 (5)", "words " * 20])
    texts = ["\n".join(line() for _ in range(rng.randint(0, 12))) for _ in range(40)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(pp.text_chunks(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in got] == [model.chunks(t, lx.FINANCIAL, r"\(?-?\d[\d,]*(?:\.\d+)?\)?") for t in texts]


BLOCKS = "doc_id string, page_id string, page_index int, page_text string, source_pdf string, blocks array<struct<bbox:array<double>,text:string>>, ord long"


def test_node_split(spark):
    text = "单位：元\n营业收入 233,432 343,176 -31.98%\n研发投入 5,000"
    rows = [("d", "d_p1", 1, text, "f.pdf", [([1.0, 2.0, 3.0, 4.0], text)], 1), ("d", "d_p2", 2, "  ", "f.pdf", [], 2)]
    got = pp.split_nodes(spark.createDataFrame(rows, BLOCKS)).orderBy("ord").collect()
    assert got[0]["node_id"] == "d_p1_n001" and got[0]["bbox"] == [1.0, 2.0, 3.0, 4.0]
    assert any(n["node_type"] == "table_row" and "营业收入" in n["text"] for n in got)
    assert json.loads(got[0]["metadata"]["unit_candidates"]) == ["元"]
    assert [n["reading_order"] for n in got] == list(range(1, len(got) + 1))
    assert (got[-1]["node_id"], got[-1]["text"]) == ("d_p2_n001", "d_p2")


def test_annotations_and_gold(spark, tmp_path):
    texts = ["示例公司 2025 年年度报告", "单位：元\n项目 2025 年\n营业收入 233,432,768,960.43 343,176,440,712.96 -31.98%", "x"] + ["y"] * 4 + ["公司面临的风险因素包括市场变化"]
    pages = spark.createDataFrame([("示例公司：2025", f"p{k}", k, t) for k, t in enumerate(texts, 1)], "doc_id string, page_id string, page_index int, page_text string")
    rows = pp.annotation_rows(pages, 9).collect()
    revenue = next(r for r in rows if r["raw_answer_value"] and r["question_type"] == "numeric")
    assert revenue["answer"] == "233,432,768,960.43 元" and "单位：元" in revenue["unit_evidence_text"] and revenue["evidence_pages"] == "p2"
    assert [r["question_type"] for r in rows] == ["fact", "fact", "numeric", "comparison", "risk_text"]
    assert rows[0]["query_id"] == "cn_v2_q0001" and rows[0]["answer"] == "2025"
    (tmp_path / "qa_annotations_v2.csv").write_text(
        "﻿" + ",".join(ANNOTATION_COLUMNS) + "\nq1,doc,营业收入是多少？,100 元,doc_p1,营业收入 100,numeric,true,,元,100,,,,,,numeric,,\nq2,doc,无,无,doc_p1,,text,no,,,,,,,,,,,\n", encoding="utf-8"
    )
    df, name = rd.read_annotations(spark, str(tmp_path))
    nodes = pp.split_nodes(spark.createDataFrame([("doc", "doc_p1", 1, "单位：元\n营业收入 100\n其他普通说明文字若干若干若干", "", [], 1)], BLOCKS))
    got = {r["query_id"]: r for r in pp.match_annotations(df, nodes, "cn", name).collect()}
    assert got["q1"]["metadata"]["answer_unit"] == "元" and got["q1"]["metadata"]["annotation_file"] == name
    assert got["q1"]["metadata"]["node_match_status"] == "matched" and got["q1"]["evidence_node_ids"]
    assert got["q2"]["metadata"]["node_match_status"] == "fallback" and not got["q2"]["is_answerable"]


def test_runs(spark, tmp_path, monkeypatch):
    from pagelode.plans import runs

    for name, folder in (("MDR_DATA_ROOT", "data"), ("MDR_ARTIFACT_ROOT", "artifacts")):
        monkeypatch.setenv(name, str(tmp_path / folder))
    assert runs.prepare(spark, "demo").counts == {"documents": 2, "pages": 3, "nodes": 4, "queries": 3}
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"dataset": "demo", "output_dir": "${MDR_DATA_ROOT}/runs", "retriever": {"type": "page_region", "top_k": [1, 5, 10]}}))
    run = runs.run_retrieval(spark, runs.load_config(config))
    latest = run.parent / "latest"
    assert runs.resolve_run(latest) == run.resolve()
    assert runs.evaluate_run(spark, latest)["page_recall@1"] > 0
    assert runs.verify_run(spark, latest)["queries"] == 3
    for file in ("manifest.json", "predictions.parquet", "config.json", "run_info.json", "metrics.json", "errors.csv", "summary.md", "sufficiency_metrics.json", "sufficiency_summary.md"):
        assert (run / file).exists()
    assert "page_recall@1" in runs.export_table(latest).read_text()
    missing = runs.prepare(spark, "mmdocir")
    assert missing.counts == dict.fromkeys(("documents", "pages", "nodes", "queries"), 0) and "No files" in missing.message
    raw = tmp_path / "data/raw/mmdocir"
    raw.mkdir(parents=True)
    (raw / "a.jsonl").write_text('{"doc_id":"x","page":1,"text":"one","question":"what?","answer":"one"}\n{"doc_id":"y","page":"z","text":"two"}\n')
    (raw / "b.json").write_text('{"data":[{"doc_id":"x","page":2,"content":"three"}]}')
    assert runs.prepare(spark, "mmdocir").counts == {"documents": 2, "pages": 3, "nodes": 3, "queries": 1}
    assert runs.main(["evaluate", "--run", str(tmp_path / "none")]) == 1


def test_a_failed_run_leaves_nothing(spark, tmp_path, monkeypatch):
    """All folders by URIs; the run that fails is gone, ``latest`` still names the one before."""
    import pytest

    from pagelode.plans import runs

    for name in ("DATA", "RUNS", "ARTIFACT"):
        monkeypatch.setenv(f"MDR_{name}_ROOT", f"file://{tmp_path}/{name}")
    from pagelode import store

    written = dict(store._written)
    runs.prepare(spark, "demo")
    config = {"dataset": "demo", "output_dir": f"file://{tmp_path}/RUNS/x", "retriever": {"type": "bm25_page"}}
    with pytest.raises(ValueError, match="Unsupported"):
        runs.run_retrieval(spark, config | {"retriever": {"type": "none"}})
    assert runs.resolve(config["output_dir"]).names() == []
    with pytest.raises(FileNotFoundError):
        runs.resolve_run(config["output_dir"] + "/latest")
    first = runs.run_retrieval(spark, config)
    with pytest.raises(ValueError, match="Unsupported"):
        runs.run_retrieval(spark, config | {"retriever": {"type": "none"}})
    assert runs.resolve_run(config["output_dir"] + "/latest") == first
    second = runs.run_retrieval(spark, config)
    assert second != first and runs.resolve_run(first.parent / "latest") == second
    (first / "manifest.json").delete()
    with pytest.raises(FileNotFoundError, match="complete"):
        runs.evaluate_run(spark, first)
    # a link named latest, as older versions made
    (tmp_path / "RUNS/x/latest.txt").unlink()
    (tmp_path / "RUNS/x/latest").symlink_to(second.name, target_is_directory=True)
    assert runs.evaluate_run(spark, config["output_dir"] + "/latest")["page_recall@1"] > 0
    assert store._written == written  # nothing between the steps is left behind


def test_breakdowns(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", "x", 1), ("a", None, 2), (None, "x", 3), ("b", "x", 4)], "k string, s string, v int")
    got = {(r["k"], r["s"], r["level"]): (r["n"], r["share"], r["total"]) for r in mt.breakdowns(rows, mt.rollup_sets("k", "s"), total=F.sum("v")).collect()}
    assert got[(None, None, 3)] == (4, 1.0, 10) and got[("a", None, 1)] == (2, 0.5, 3) and got[(None, None, 1)] == (1, 0.25, 3)
    assert got[("a", None, 0)] == (1, 0.25, 2) and len(got) == 4 + 3 + 1
    assert {(r["s"], r["n"]) for r in mt.breakdown(rows, "s").collect()} == {("x", 3), (None, 1)}


def test_round_trips(spark, tmp_path):
    from pagelode.plans.runs import to_json_text

    t = demo_tables(spark, 1)
    assert {k: v.count() for k, v in t.items()} == {"documents": 1, "pages": 2, "nodes": 3, "queries": 2}
    to_json_text(t["queries"]).write.parquet(str(tmp_path / "q.parquet"))
    back = rd.read_table(spark, str(tmp_path / "q.parquet"), t["queries"].schema).orderBy("query_id").collect()
    assert back == t["queries"].orderBy("query_id").collect()
    empty = spark.createDataFrame([], HITS)
    empty.write.parquet(str(tmp_path / "h.parquet"))
    assert rd.read_hits(spark, str(tmp_path / "h.parquet")).schema.names == HITS.names
    try:
        rd.read_table(spark, str(tmp_path / "missing"), HITS)
        raise AssertionError
    except FileNotFoundError as e:
        assert "Missing required table" in str(e)


def test_pages_are_made_once_for_all_kinds_of_questions(spark):
    made = spark.sparkContext.accumulator(0)

    def text(k):
        made.add(1)
        return f"公司{k} 2025 年年度报告 单位：万元 营业收入 {k},000 研发投入 {k}00 资产总额 9{k} 风险因素"

    pages = spark.range(20).select(
        F.concat(F.lit("R"), F.col("id").cast("string")).alias("doc_id"),
        F.concat(F.lit("R"), F.col("id").cast("string"), F.lit("_p8")).alias("page_id"),
        F.lit(8).alias("page_index"),
        F.udf(text, "string")("id").alias("page_text"),
    )
    assert pp.annotation_rows(pages, 9).where("answer_unit = '万元'").count() == 60
    assert made.value == 20


def test_a_node_is_scored_from_forms_of_its_own(spark):
    row = {"raw_answer_value": "1,2 34", "answer": "1,234 万元", "question": "营业收入是多少", "value_evidence_text": "营业收入 1,234", "unit_evidence_text": None, "evidence_text": "", "answer_unit": "万元", "text": "营业收入  1,234 单位：万元"}
    df = spark.createDataFrame([row], "raw_answer_value string, answer string, question string, value_evidence_text string, unit_evidence_text string, evidence_text string, answer_unit string, text string")
    got = df.select("answer_unit", "text", *pp.annotation_forms(), *pp.node_forms()).select(pp.annotation_score().alias("s")).first()["s"]
    assert got == 5 + 3.5 + 3.5 + 4 + 2 + 1
