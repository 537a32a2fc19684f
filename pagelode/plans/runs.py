"""Configured runs and their files: predictions, metrics, summaries, tables.

All folders may lie on any file system that Spark reads; the driver's own disk is used only
where a path names it. Small files appear whole, by a rename. A run is valid from its
``manifest.json`` on, which is written last, and only then ``latest.txt`` names the run, so
a run that fails leaves neither. Intermediate tables of a step are deleted when it ends.
"""

from __future__ import annotations

import json
import os
import re
import sys
from dataclasses import asdict, dataclass
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators import retrieval as rt
from ..operators import sufficiency as sf
from ..schemas import ANNOTATION_COLUMNS, TABLES
from ..sources import files
from ..sources import prepare as pp
from ..sources import readers as rd
from ..sources.demo import demo_tables
from ..sources.files import Place
from ..store import materialize, numbered, scratch

# The names of environment variables, files and output keys in this module must match; columns of the annotation template.
TEMPLATE_COLUMNS = ANNOTATION_COLUMNS[:9]


@dataclass(frozen=True)
class PrepareResult:
    """What became of a data set: where it lies, the rows of its relations, and a note."""

    dataset: str
    processed_dir: str
    documents: int = 0
    pages: int = 0
    nodes: int = 0
    queries: int = 0
    message: str = ""

    @property
    def counts(self) -> dict[str, int]:
        return {name: getattr(self, name) for name in TABLES}


def project_root() -> str:
    """The nearest folder above the working directory with a ``pyproject.toml``, else the working directory."""
    here = Path.cwd()
    return str(next((p for p in (here, *here.parents) if (p / "pyproject.toml").exists()), here))


def _root(variable: str, default: str) -> Place:
    return Place(os.environ.get(variable) or f"{project_root()}/{default}")


def data_root() -> Place:
    return _root("MDR_DATA_ROOT", "data")


def runs_root() -> Place:
    return _root("MDR_RUNS_ROOT", "runs")


def artifacts_root() -> Place:
    return _root("MDR_ARTIFACT_ROOT", "artifacts")


def resolve(path: str | Path | Place) -> Place:
    """URIs and absolute paths as they are, others below the project's root."""
    text = str(path)
    return Place(text if text.startswith("/") or re.match(r"[A-Za-z][\w+.-]*:", text) else f"{project_root()}/{text}")


def expand(value: Any) -> Any:
    """``${NAME}`` in nested values: from the environment, else the three roots."""
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v) for v in value]
    if not isinstance(value, str):
        return value
    roots = {"MDR_DATA_ROOT": data_root, "MDR_RUNS_ROOT": runs_root, "MDR_ARTIFACT_ROOT": artifacts_root}

    def one(m: re.Match) -> str:
        name = m[1]
        return os.environ.get(name) or (str(roots[name]()) if name in roots else m[0])

    return re.sub(r"\$\{(\w+)\}", one, value)


def load_config(path: str | Path | Place) -> dict[str, Any]:
    """A YAML or JSON file; an empty one is ``{}``."""
    text = Place(str(path)).read_text()
    if str(path).endswith(".json"):
        return expand(json.loads(text or "{}"))
    import yaml

    return expand(yaml.safe_load(text) or {})


def write_dataset(tables: dict[str, DataFrame], folder: str | Place) -> dict[str, int]:
    """Write the relations, then a manifest with their rows; the rows of each."""
    place, spark = Place(str(folder)), next(iter(tables.values())).sparkSession
    (place / "manifest.json").delete()
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{place}/{name}.parquet")
    rows = {name: spark.read.parquet(f"{place}/{name}.parquet").count() for name in TABLES}
    (place / "manifest.json").write_text(json.dumps({"rows": rows}, indent=2))
    return rows


def to_json_text(df: DataFrame) -> DataFrame:
    """Nested columns as JSON texts, nulls kept, for exchange with tools that expect them."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    return df.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in nested})


@scratch()
def prepare(spark: SparkSession, dataset: str, limit_docs: int | None = None) -> PrepareResult:
    """Build a data set's relations below the data root."""
    raw, out = data_root() / "raw" / dataset, data_root() / "processed" / dataset
    if dataset == "demo":
        tables = demo_tables(spark, limit_docs)
    elif dataset == "mmdocir":
        rows = rd.read_tables(spark, str(raw))
        tables = None if rows is None else pp.from_tables(rows, dataset, limit_docs)
    elif dataset in ("cn_annual_reports", "cn_reports"):
        tables = _from_reports(spark, raw, dataset, limit_docs)
    else:
        raise ValueError(f"Unsupported dataset: {dataset}")
    if tables is None:
        note = f"No files of {dataset} found. Put them into {raw} and prepare again."
        (out / "README.md").write_text(note + "\n")
        template = raw / "qa_annotations_template.csv"
        if dataset.startswith("cn") and not template.exists():  # a filled-in one is never overwritten
            template.write_text(",".join(TEMPLATE_COLUMNS) + "\n")
        return PrepareResult(dataset, str(out), message=note)
    rows = write_dataset(tables, out)
    return PrepareResult(dataset, str(out), **rows, message=f"{dataset} prepared")


def _report_pages(spark: SparkSession, raw: Place, limit: int | None, blocks: bool = True) -> DataFrame | None:
    """Pages of the reports in ``pdfs``, in the order of their names."""
    folder = raw / "pdfs"
    listed = rd.visible_files(spark, str(folder), "*.pdf") if folder.exists() else None
    order = listed.orderBy("path").limit(limit) if listed is not None and limit is not None else listed
    if order is None or not order.limit(1).count():
        return None
    order = numbered(order.select("path"), "no", "path")
    name = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    pages = rd.read_pdf_pages(spark, str(folder), blocks).join(order.withColumn("doc_id", name), "path")
    pages = pages.withColumnRenamed("path", "source_pdf")
    return pages.withColumns({"page_id": F.concat("doc_id", F.lit("_p"), F.col("page_index").cast("string")), "ord": (F.col("no") - 1) * 100000 + F.col("page_index")})


def _from_reports(spark: SparkSession, raw: Place, dataset: str, limit: int | None) -> dict[str, DataFrame] | None:
    pages = _report_pages(spark, raw, limit)
    if pages is None:
        return None
    nodes = pp.split_nodes(pages.select("doc_id", "page_id", "page_index", "page_text", "source_pdf", "blocks", "ord"))
    found = rd.read_annotations(spark, str(raw))
    queries = pp.match_annotations(found[0], nodes, dataset, found[1]) if found else spark.createDataFrame([], TABLES["queries"])
    sizes = pages.groupBy("doc_id").agg(F.max("page_index").alias("num_pages"), F.first("source_pdf").alias("source_path"))
    shown = pages.select("doc_id", "page_id", "page_index", "page_text", "ord")
    return {"documents": rd.conform(sizes.withColumns({"dataset": F.lit(dataset), "title": F.col("doc_id"), "language": F.lit("zh")}), TABLES["documents"]), "pages": rd.conform(shown, TABLES["pages"]), "nodes": nodes, "queries": queries}


@scratch()
def build_annotations(spark: SparkSession, dataset: str = "cn_annual_reports", per_doc: int = 8, limit: int | None = None) -> Place:
    """Rule-made annotations of all reports as a CSV file with a byte-order mark, and a log."""
    import csv
    import io

    raw = data_root() / "raw" / dataset
    pages = _report_pages(spark, raw, limit, blocks=False)
    if pages is None:
        raise FileNotFoundError(f"No PDFs found under {raw}")
    pages = materialize(pages.select("doc_id", "page_id", "page_index", "page_text"), "pages")
    every = materialize(pp.annotation_kinds(pages), "kinds")
    out, n = raw / "qa_annotations_v2.csv", 0

    def line(values: list) -> str:
        text = io.StringIO()
        csv.writer(text).writerow(values)
        return text.getvalue()

    with files.text_writer(spark, str(out)) as write:
        write("\ufeff" + line(ANNOTATION_COLUMNS))
        for row in pp.annotations_of(every, per_doc).orderBy("query_id").toLocalIterator():
            write(line(list(row)))
            n += 1
    with files.text_writer(spark, f"{raw}/qa_annotations_v2_generation_log.md") as write:
        docs = pages.select("doc_id").distinct().count()
        write(f"# QA Annotations V2 Generation Log\n\n- PDFs: {docs}\n- Questions: {n}\n- Questions per doc target: {per_doc}\n\n## Skipped Items\n\n")
        skipped = 0
        for row in pp.skipped_items(pages, every).orderBy("doc_id", "kind_no").toLocalIterator():
            write(f"- {row['doc_id']}: {row['name']}\n")
            skipped += 1
        if not skipped:
            write("- None\n")
    return out


@scratch()
def run_retrieval(spark: SparkSession, config: dict[str, Any], encode=None) -> Place:
    """Retrieve as configured; the run's folder with predictions, configuration and facts."""
    dataset, options = str(config["dataset"]), dict(config.get("retriever") or {})
    kind = str(options.get("type", "bm25_page"))
    name = str(config.get("experiment_name", f"{dataset}_{kind}"))
    t = rd.read_dataset(spark, str(data_root() / "processed" / dataset))
    root = resolve(config.get("output_dir", f"runs/retrieval/{name}"))
    run = _new_run(root)
    try:
        rt.retrieve(t["queries"], t["pages"], t["nodes"], options, encode).write.parquet(str(run / "predictions.parquet"))
        facts = spark.read.parquet(str(run / "predictions.parquet")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("retriever")).alias("r")).first()
        info = {"experiment_name": name, "dataset": dataset, "retriever_type": kind, "hits": facts["n"], "actual_retrievers": facts["r"]}
        for file, value in (("config.json", config), ("run_info.json", info)):
            (run / file).write_text(json.dumps(value, ensure_ascii=False, indent=2))
        (run / "manifest.json").write_text(json.dumps({"files": run.names(), "hits": facts["n"]}, indent=2))
    except BaseException:
        run.delete()
        raise
    update_latest(root, run)
    return run


def _new_run(root: Place) -> Place:
    """A folder named by the time, with a number if the second has one."""
    stamp, no = datetime.now().strftime("%Y%m%d_%H%M%S"), 0
    while (run := root / (f"{stamp}_{no}" if no else stamp)).exists():
        no += 1
    run.mkdir()
    return run


def update_latest(root: Place, run: Place) -> None:
    """``latest.txt`` names the last whole run."""
    (root / "latest.txt").write_text(run.name)


def resolve_run(run: str | Path | Place) -> Place:
    """A run's folder; ``latest`` is the one that ``latest.txt`` names, or a link of an older version."""
    path = resolve(run)
    if path.name == "latest" and (path.parent / "latest.txt").exists():
        named = (path.parent / "latest.txt").read_text().strip()
        return (Place(named) if "/" in named else path.parent / named).resolve()
    if path.is_dir():
        return path.resolve()
    raise FileNotFoundError(f"Run does not exist: {run}")


def _run_tables(spark: SparkSession, run: Place) -> tuple[dict[str, Any], DataFrame, DataFrame]:
    if not (run / "manifest.json").exists():
        raise FileNotFoundError(f"Run is not complete: {run}")
    info = json.loads((run / "run_info.json").read_text())
    queries = rd.read_table(spark, str(data_root() / "processed" / info["dataset"] / "queries.parquet"), TABLES["queries"])
    return info, queries, rd.read_hits(spark, str(run / "predictions.parquet"))


@scratch()
def evaluate_run(spark: SparkSession, run: str | Path | Place) -> dict[str, float]:
    """metrics.json, errors.csv and summary.md of a run."""
    path = resolve_run(run)
    info, queries, hits = _run_tables(spark, path)
    found = mt.evaluate(queries, hits).first().asDict()
    (path / "metrics.json").write_text(json.dumps(found, indent=2))
    errors = materialize(mt.error_rows(queries, hits), "errors")
    if not errors.limit(1).count():  # one row says that there are none
        errors = spark.createDataFrame([("", "", "", "", "", "", True, True)], errors.schema)
    errors.write.mode("overwrite").csv(str(path / "errors.csv"), header=True)
    lines = [f"# {info['experiment_name']}", "", f"- dataset: {info['dataset']}", f"- retriever: {info['retriever_type']}", f"- hits: {info['hits']}", ""]
    lines += [f"- {k}: {v:.4f}" for k, v in found.items()] + [""]
    shown = queries.orderBy("query_id").limit(5).select("query_id", "question")
    top = hits.where("rank <= 3").join(shown.select("query_id"), "query_id", "left_semi").groupBy("query_id")
    top = top.agg(F.array_sort(F.collect_list(F.struct("rank", "page_id", "node_id", "score", F.substring("text", 1, 120).alias("text")))).alias("top"))
    for q in shown.join(top, "query_id", "left").orderBy("query_id").collect():  # five rows
        lines.append(f"## {q['query_id']}: {q['question']}")
        lines += [f"{h['rank']}. {h['page_id']} {h['node_id'] or ''} ({h['score']:.4f}) {h['text'] or ''}" for h in q["top"] or []]
        lines.append("")
    (path / "summary.md").write_text("\n".join(lines))
    return found


@scratch()
def verify_run(spark: SparkSession, run: str | Path | Place, top_k: int = 3) -> dict[str, Any]:
    """Sufficiency cases, rates and a summary of a run."""
    path = resolve_run(run)
    info, queries, hits = _run_tables(spark, path)
    cases = materialize(sf.cases(queries, hits, top_k), "cases")
    found = sf.rates(cases, top_k).first().asDict()
    found = {k: v for k, v in found.items() if not (k.startswith("status_") and not v)}
    lists = {c: F.array_join(c, ";") for c in ("covered_items", "missing_items", "evidence_node_ids", "evidence_pages")}
    flat = cases.withColumns(lists | {"evidence_text": F.substring("evidence_text", 1, 1200)}).drop("n_gold_nodes")
    flat.write.mode("overwrite").csv(str(path / "sufficiency_cases.csv"), header=True)
    (path / "sufficiency_metrics.json").write_text(json.dumps(found, indent=2))
    lines = [f"# Sufficiency of {info['experiment_name']}", ""] + [f"- {k}: {v}" for k, v in found.items()] + [""]
    for c in cases.where("status <> 'sufficient'").orderBy("query_id").limit(8).collect():
        lines.append(f"- {c['query_id']}: {c['status']}, missing {', '.join(c['missing_items'])}")
    (path / "sufficiency_summary.md").write_text("\n".join(lines))
    return found


def export_table(run: str | Path | Place) -> Place:
    """A Markdown table of a run's metrics below the artifact root."""
    path = resolve_run(run)
    if not (path / "metrics.json").exists():
        raise FileNotFoundError("metrics.json is missing; evaluate the run first")
    found = json.loads((path / "metrics.json").read_text())
    info = json.loads((path / "run_info.json").read_text())
    out = artifacts_root() / "figures" / "opening_experiment_table.md"
    head = ["experiment", *found]
    body = [info["experiment_name"], *(f"{v:.4f}" for v in found.values())]
    out.write_text("\n".join("| " + " | ".join(r) + " |" for r in (head, ["---"] * len(head), body)) + "\n")
    return out


def main(argv: list[str] | None = None) -> int:
    """prepare, build-cn-annotations, retrieve, evaluate, verify-evidence, export-demo."""
    import argparse

    parser = argparse.ArgumentParser(prog="pagelode")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("prepare")
    p.add_argument("--dataset", required=True)
    p.add_argument("--limit-docs", type=int)
    p = commands.add_parser("build-cn-annotations")
    p.add_argument("--questions-per-doc", type=int, default=8)
    p.add_argument("--limit-docs", type=int)
    commands.add_parser("retrieve").add_argument("--config", required=True)
    commands.add_parser("evaluate").add_argument("--run", required=True)
    p = commands.add_parser("verify-evidence")
    p.add_argument("--run", required=True)
    p.add_argument("--top-k", type=int, default=3)
    commands.add_parser("export-demo").add_argument("--run", required=True)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        if a.command == "export-demo":
            print(export_table(a.run))
        elif a.command == "prepare":
            print(json.dumps(asdict(prepare(spark, a.dataset, a.limit_docs)), ensure_ascii=False))
        elif a.command == "build-cn-annotations":
            print(build_annotations(spark, per_doc=a.questions_per_doc, limit=a.limit_docs))
        elif a.command == "retrieve":
            config = load_config(a.config)
            options = config.get("retriever") or {}
            more = rt.dense_options(options)
            encode = rd.sentence_encoder(str(options.get("encoder", "BAAI/bge-m3")), more["batch_size"], more["max_seq_length"])
            print(run_retrieval(spark, config, encode))
        elif a.command == "evaluate":
            print(evaluate_run(spark, a.run))
        else:
            print(verify_run(spark, a.run, a.top_k))
    except FileNotFoundError as e:
        print(f"{e}. Run `prepare` first.", file=sys.stderr)
        return 1
    return 0
