"""Files and optional libraries: reports through a stub parser, a stub encoder, annotations, sinks that must not lose data."""

import csv
import os
import sys

import pytest

import pagelode
from pagelode.operators import retrieval as rt
from pagelode.plans import runs
from pagelode.schemas import NODES
from pagelode.sources import readers as rd

FITZ = '''
class Page:
    def __init__(self, text):
        self.text = text
    def get_text(self, kind):
        if kind == "text":
            return self.text
        if "broken blocks" in self.text:
            raise RuntimeError("no blocks")
        return [(10, 20, 30, 40, line) for line in self.text.split("\\n")] if self.text.startswith("blocks") else []


class open:
    def __init__(self, stream, filetype):
        if b"bad file" in stream:
            raise RuntimeError("bad file")
        self.pages = [Page(t) for t in stream.decode().split("\\f")]
    def __enter__(self):
        return self.pages
    def __exit__(self, *_):
        return False
'''
ENCODER = '''
import math

LOADED = []


class SentenceTransformer:
    """Counts of a few letters, as unit vectors."""
    def __init__(self, name):
        LOADED.append(name)
    def encode(self, texts, batch_size=8, normalize_embeddings=True):
        import numpy as np
        out = []
        for t in texts:
            v = np.array([1.0 + t.count(c) * 9 for c in "abcd"])
            out.append(v / math.sqrt((v * v).sum()))
        return np.array(out)
'''
COVER = "公司甲：2025 年年度报告"
TABLE = "单位：元\n主要会计数据 项目 2025 年\n营业收入 233,432,768,960.43 343,176,440,712.96 -31.98%"


@pytest.fixture(scope="module")
def stubs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stubs")
    for name, text in (("fitz", FITZ), ("sentence_transformers", ENCODER)):
        (folder / f"{name}.py").write_text(text, encoding="utf-8")
        spark.sparkContext.addPyFile(str(folder / f"{name}.py"))
    return folder


@pytest.fixture
def roots(tmp_path, monkeypatch):
    for name in ("DATA", "RUNS"):
        monkeypatch.setenv(f"MDR_{name}_ROOT", str(tmp_path / name.lower()))
    monkeypatch.setenv("MDR_ARTIFACT_ROOT", str(tmp_path / "artifacts"))
    return tmp_path


def reports(roots, *files):
    raw = roots / "data" / "raw" / "cn_annual_reports" / "pdfs"
    raw.mkdir(parents=True)
    for name, text in files:
        (raw / name).write_text(text, encoding="utf-8")
    return raw.parent


def test_reports_are_read_annotated_and_prepared(spark, stubs, roots):
    raw = reports(roots, ("甲.pdf", f"{COVER}\f{TABLE}\fblocks of 营业收入 5 here\nand more text of a block"), ("乙.pdf", "x" * 30 + "\fbroken blocks but text"), ("丙.pdf", "bad file"))
    out = runs.build_annotations(spark, per_doc=8)
    rows = list(csv.DictReader(open(str(out), encoding="utf-8-sig")))
    assert [r["query_id"] for r in rows] == [f"cn_v2_q{k:04d}" for k in range(1, len(rows) + 1)]
    revenue = next(r for r in rows if r["answer_unit"])
    assert revenue["answer"] == "233,432,768,960.43 元" and "单位：元" in revenue["unit_evidence_text"]
    log = (raw / "qa_annotations_v2_generation_log.md").read_text(encoding="utf-8")
    assert "- PDFs: 2" in log and f"- Questions: {len(rows)}" in log and "甲: risk_text" in log and "乙: report_year" in log
    counts = runs.prepare(spark, "cn_annual_reports").counts
    assert counts["documents"] == 2 and counts["pages"] == 5 and counts["queries"] == len(rows)
    t = rd.read_dataset(spark, str(roots / "data" / "processed" / "cn_annual_reports"))
    nodes = {r["node_id"]: r for r in t["nodes"].collect()}
    assert nodes["甲_p3_n001"]["bbox"] == [10, 20, 30, 40] and nodes["甲_p2_n002"]["node_type"] == "table_row"
    assert any("broken blocks" in r["text"] for r in nodes.values())


def test_limited_reports_without_blocks(spark, stubs, roots):
    """Only ``pdfs`` is read, in the order of names; blocks are taken apart only if they are asked for."""
    raw = reports(roots, ("b 1%+.pdf", "blocks x\ny"), ("a.pdf", "text of a page"))
    (raw / "stray.pdf").write_text("not a report", encoding="utf-8")
    pages = runs._report_pages(spark, runs.Place(str(raw)), 1)
    assert [r["doc_id"] for r in pages.collect()] == ["a"]
    both = {r["doc_id"]: r for r in runs._report_pages(spark, runs.Place(str(raw)), None).collect()}
    assert sorted(both) == ["a", "b 1%+"] and len(both["b 1%+"]["blocks"]) == 2 and both["a"]["ord"] < both["b 1%+"]["ord"]
    bare = runs._report_pages(spark, runs.Place(str(raw)), None, blocks=False).collect()
    assert len(bare) == 2 and not any(r["blocks"] for r in bare)


def test_missing_reports_and_templates(spark, roots):
    assert set(runs.prepare(spark, "cn_annual_reports").counts.values()) == {0}
    template = roots / "data" / "raw" / "cn_annual_reports" / "qa_annotations_template.csv"
    assert template.read_text(encoding="utf-8").strip().split(",") == runs.TEMPLATE_COLUMNS and len(runs.TEMPLATE_COLUMNS) == 9
    template.write_text("filled in", encoding="utf-8")
    runs.prepare(spark, "cn_annual_reports")
    assert template.read_text(encoding="utf-8") == "filled in"
    assert (roots / "data" / "processed" / "cn_annual_reports" / "README.md").exists()
    with pytest.raises(FileNotFoundError):
        runs.build_annotations(spark)


def test_errors_have_a_row_where_there_are_none(spark, roots):
    import json

    runs.prepare(spark, "demo")
    config = {"dataset": "demo", "output_dir": str(roots / "runs" / "demo"), "retriever": {"type": "oracle_page_region", "method": "bm25", "top_k": [1, 5]}}
    run = runs.run_retrieval(spark, config)
    runs.evaluate_run(spark, run)
    rows = spark.read.csv(str(run / "errors.csv"), header=True).collect()
    assert len(rows) == 1 and rows[0]["query_id"] in ("", None) and rows[0]["page_ok"] == "true"
    assert json.loads((run / "run_info.json").read_text())["hits"] > 0
    assert "## demo_q1" in (run / "summary.md").read_text()


def test_annotations_from_a_workbook(spark, tmp_path, monkeypatch):
    import pandas as pd

    (tmp_path / "qa_annotations.xlsx").write_bytes(b"")
    monkeypatch.setattr(pd, "read_excel", lambda path, dtype: pd.DataFrame({"query_id": ["a", None], "question": ["q", "r"]}))
    df, name = rd.read_annotations(spark, str(tmp_path))
    assert name == "qa_annotations.xlsx" and [tuple(r) for r in df.collect()] == [("a", "q"), ("", "r")]


def test_undecodable_json_is_kept(spark):
    rows = [("n1", '{"page_index": "3"}', "[1.5, 2]"), ("n2", "not json", None), ("n3", None, "")]
    got = {r["node_id"]: r for r in rd.conform(spark.createDataFrame(rows, "node_id string, metadata string, bbox string"), NODES).collect()}
    assert got["n1"]["metadata"] == {"page_index": "3"} and got["n1"]["bbox"] == [1.5, 2.0]
    assert got["n2"]["metadata"] == {"_text": "not json"} and got["n3"]["metadata"] is None


def test_encoder_scores_dense_search(spark, stubs, monkeypatch):
    sys.modules.pop("sentence_transformers", None)
    monkeypatch.setenv("MDR_DISABLE_SENTENCE_TRANSFORMERS", "1")
    assert rd.sentence_encoder("m") is None
    monkeypatch.setenv("MDR_DISABLE_SENTENCE_TRANSFORMERS", "0")
    encode = rd.sentence_encoder("some/model", max_seq_length=64)
    assert encode.label == "dense:sentence_transformers:some/model:maxlen=64"
    pages = [("d1", "p1", 1, "aaaa", "", 1), ("d1", "p2", 2, "bbbb", "", 2), ("d2", "p3", 1, "abbbb", "", 3), ("d2", "p4", 2, "", "", 4)]
    pages = spark.createDataFrame(pages, "doc_id string, page_id string, page_index int, page_text string, ocr_text string, ord long")
    queries = spark.createDataFrame([("q1", "d1", "aaa"), ("q2", "d2", "bb")], "query_id string, doc_id string, question string")
    for scope, first in (("corpus", {"q1": "p1", "q2": "p2"}), ("document", {"q1": "p1", "q2": "p3"})):
        got = rt.retrieve_pages(queries, pages, "dense", 2, scope, encode, require_model=True).collect()
        assert {r["query_id"]: r["page_id"] for r in got if r["rank"] == 1} == first
        assert {r["retriever"] for r in got} == {encode.label} and len(got) == 4
    made = []
    for _ in range(2):
        rd.loaded_model(lambda name: made.append(name) or type("M", (), {})(), "one", 5)
    assert made == ["one"]


def test_package_offers_its_functions():
    assert pagelode.__version__ and all(callable(getattr(pagelode, n)) for n in pagelode.__all__ if n != "__version__")
    with pytest.raises(AttributeError):
        pagelode.nothing
    assert os.path.basename(os.path.dirname(pagelode.__file__)) == "pagelode"
