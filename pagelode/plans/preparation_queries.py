"""Queries that prepare relations, read and write them, and run configured runs, with their DuckDB SQL."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as lx
from ..operators import retrieval as rt
from ..schemas import ANNOTATION_COLUMNS, HITS, NODES, PAGES, QUERIES as QUERY_SCHEMA
from ..sources import prepare as pp
from ..sources import readers as rd
from ..store import folder, materialize
from . import runs
from .queries import _any_sql, _fixed, _query, _read
from .report_queries import _IN_DOCUMENT, _NODES, _REPORTS, DEMO, _bm25_sql, _top_sql, report_nodes, report_pages, report_queries

_PLAIN = lambda pattern: pattern.removeprefix("(?U)").replace("[\\s\\x1c-\\x1f]", "\\s")
_NUMBER, _PERCENT, _NOTE = _PLAIN(lx.NUMBER), _PLAIN(lx.PERCENT), _PLAIN(lx.UNIT_NOTE)


def _clean_sql(t: str) -> str:
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def _form_sql(t: str) -> str:
    """The form in which texts are compared."""
    return f"replace({_clean_sql(t)}, ' ', '')"


def _split_sql() -> str:
    """CTEs up to ``split_t`` from ``sheet`` (doc_id, page_id, page_text, ord): a walk over each page's lines that keeps what it holds."""
    own = f"({_any_sql('line', lx.FINANCIAL)} AND regexp_matches(line, '{_NUMBER}'))"
    joined = "CASE WHEN held = '' THEN line ELSE held || ' ' || line END"
    rows = ", ".join(f"CASE WHEN contains(chunk, '{k}') AND regexp_matches(substr(chunk, strpos(chunk, '{k}'), 360), '{_NUMBER}') THEN substr(chunk, strpos(chunk, '{k}'), 360) END" for k in lx.FINANCIAL)
    return f"""
lines AS (SELECT page_id, list_filter(list_transform(string_split(page_text, chr(10)), lambda x: {_clean_sql("x")}), lambda x: x <> '') AS all_lines FROM sheet),
walk AS (SELECT page_id, 0 AS i, '' AS held, []::VARCHAR[] AS made FROM lines
         UNION ALL
         SELECT page_id, i + 1, CASE WHEN {own} OR length({joined}) >= 260 THEN '' ELSE {joined} END,
                CASE WHEN {own} THEN CASE WHEN held = '' THEN [line] ELSE [held, line] END WHEN length({joined}) >= 260 THEN [{joined}] ELSE []::VARCHAR[] END
         FROM (SELECT page_id, i, held, all_lines[i + 1] AS line FROM walk JOIN lines USING (page_id) WHERE i < len(all_lines))),
chunks AS (SELECT page_id, i, unnest(made) AS chunk, generate_subscripts(made, 1) AS k FROM walk
           UNION ALL SELECT page_id, i + 1, held, 1 FROM walk JOIN lines USING (page_id) WHERE i = len(all_lines) AND held <> ''),
pieces AS (SELECT page_id, i, k, n, text, kind, key FROM (
    SELECT page_id, i, k, unnest(range(1, {len(lx.FINANCIAL) + 1})) AS n, unnest([{rows}]) AS text, 'table_row' AS kind, left({_form_sql("text")}, 180) AS key FROM chunks) WHERE text IS NOT NULL
    UNION ALL SELECT page_id, i, k, 99, left(chunk, 900), CASE WHEN len(regexp_extract_all(chunk, '{_NUMBER}')) >= 3 OR {_any_sql("chunk", lx.FINANCIAL)} THEN 'table_block' ELSE 'paragraph' END,
              left({_form_sql("chunk")}, 220) FROM chunks WHERE length(chunk) >= 12),
firsts AS (SELECT * FROM pieces QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY i, k, n) = 1 AND key <> ''),
kept AS (SELECT page_id, i, k, n, text, kind FROM firsts
         UNION ALL SELECT page_id, 0, 0, 0, CASE WHEN {_clean_sql("page_text")} = '' THEN page_id ELSE {_clean_sql("page_text")} END, 'paragraph' FROM sheet WHERE page_id NOT IN (SELECT page_id FROM pieces)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i, k, n) AS no FROM kept),
split_t AS (SELECT page_id || '_n' || CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END AS node_id, doc_id, page_id, kind AS node_type, text,
                   CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, no) AS INTEGER) AS reading_order,
                   to_json(list_distinct(regexp_extract_all({_clean_sql("page_text")}, '{_NOTE}', 1)))::VARCHAR AS unit_candidates FROM numbered JOIN sheet USING (page_id))"""


def _split_pages(pages: DataFrame) -> DataFrame:
    blocks = F.lit(None).cast("array<struct<bbox:array<double>,text:string>>")
    return pages.select("doc_id", "page_id", "page_index", "page_text", F.lit("").alias("source_pdf"), blocks.alias("blocks"), "ord")


@_query(
    f"""WITH RECURSIVE sheet AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS doc_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') || '_p1' AS page_id, coalesce(text, '') AS page_text, doc_id AS ord FROM documents),
{_split_sql()} SELECT node_id, doc_id, node_type, text, reading_order FROM split_t"""
)
def split_nodes(spark, sf_dir):
    """Every document as one page, split into nodes by lines."""
    doc = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    pages = _read(spark, sf_dir, "documents").select(
        doc.alias("doc_id"), F.concat(doc, F.lit("_p1")).alias("page_id"), F.lit(1).alias("page_index"), F.col("text").alias("page_text"), F.col("doc_id").cast("long").alias("ord")
    )
    return pp.split_nodes(_split_pages(pages)).select("node_id", "doc_id", "node_type", "text", "reading_order")


@_query(f"WITH RECURSIVE {_REPORTS}, sheet AS (SELECT doc_id, page_id, page_text, ord FROM page_t), {_split_sql()} SELECT node_id, doc_id, page_id, node_type, text, reading_order, unit_candidates FROM split_t")
def report_split_nodes(spark, sf_dir):
    """Report pages: metric rows, table blocks and paragraphs, with their units."""
    found = pp.split_nodes(_split_pages(report_pages(spark, sf_dir)))
    return found.select("node_id", "doc_id", "page_id", "node_type", "text", "reading_order", F.col("metadata.unit_candidates").alias("unit_candidates"))


# -- rule-made annotations --------------------------------------------------------------


def _clip_sql(t: str, needle: str, before: int, after: int) -> str:
    c = _clean_sql(t)
    at = f"strpos({c}, {needle})"
    return (
        f"trim(CASE WHEN {at} > 0 THEN substr({c}, greatest(0, {at} - 1 - {before}) + 1, least(length({c}), {at} - 1 + length({needle}) + {after}) - greatest(0, {at} - 1 - {before})) "
        f"ELSE substr({c}, 1, {before + after}) END)"
    )


def _metric_sql() -> str:
    """One row per page, metric question and keyword with a number behind it."""
    parts = []
    for no, (words, ending, section) in enumerate(pp.METRIC_QUESTIONS, 2):
        for k, w in enumerate(words):
            at = f"strpos(page_text, '{w}')"
            window = f"substr(page_text, greatest(1, {at} - 700), least({at} - 1, 700) + 120)"
            near, note = f"regexp_extract_all({window}, '{_NOTE}', 1)", f"regexp_extract_all({window}, '{_NOTE}')"
            parts.append(
                f"SELECT doc_id, page_index, page_id, {no} AS kind_no, {k} AS word_no, '{ending}' AS ending, '{section}' AS section, "
                f"CASE WHEN {at} > 0 THEN nullif(regexp_extract(substr(page_text, {at} + {len(w)}, 260), '{_NUMBER}'), '') END AS value, "
                f"CASE WHEN len({near}) > 0 THEN {near}[-1] ELSE recent_unit END AS unit, "
                f"CASE WHEN len({near}) > 0 THEN {_clip_sql(window, f'{note}[-1]', 80, 120)} ELSE recent_text END AS unit_text, {_clip_sql('page_text', repr(w), 120, 360)} AS evidence FROM looked"
            )
    return " UNION ALL ".join(parts)


def _risk_sql() -> str:
    return "CASE " + " ".join(f"WHEN contains(page_text, '{t}') THEN {_clip_sql('page_text', repr(t), 40, 320)}" for t in lx.RISK_TERMS) + " END"


_LAST = "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"
_BLANK = {c: "''" for c in ("answer_unit", "raw_answer_value", "normalized_answer", "value_evidence_text", "unit_evidence_text")}
_ROW = ("question", "answer", "evidence_pages", "evidence_text", "evidence_type", "question_type", "difficulty", "source_section", "notes", *_BLANK)


def _row_sql(source: str, no: str, **values: str) -> str:
    return f"SELECT doc_id, {no} AS kind_no, " + ", ".join(f"{(_BLANK | values)[c]} AS {c}" for c in _ROW) + f" FROM {source}"


_FACT = {"evidence_pages": "first_id", "evidence_text": _clip_sql("first_text", "'年度报告'", 80, 260), "evidence_type": "'text'", "question_type": "'fact'", "difficulty": "'easy'", "source_section": "'cover'", "notes": "'v2_rule_generated; verify_manually'"}
#: CTEs up to ``ann`` from ``page_t`` of the reports.
_ANNOTATIONS = rf"""
looked AS (SELECT *, coalesce(last_value(u[-1] IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_index {_LAST}), '') AS recent_unit,
                  coalesce(last_value(CASE WHEN len(u) > 0 THEN {_clip_sql("page_text", "notes[-1]", 80, 120)} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_index {_LAST}), '') AS recent_text
           FROM (SELECT *, regexp_extract_all(page_text, '{_NOTE}', 1) AS u, regexp_extract_all(page_text, '{_NOTE}') AS notes FROM page_t)),
cover0 AS (SELECT doc_id, split_part(doc_id, '：', 1) AS company, arg_min(page_text, page_index) AS first_text, arg_min(page_id, page_index) AS first_id FROM page_t GROUP BY doc_id),
cover1 AS (SELECT *, CASE WHEN regexp_extract(doc_id || ' ' || first_text, '(20\d{{2}})\s*年\s*年度报告', 1) <> '' THEN regexp_extract(doc_id || ' ' || first_text, '(20\d{{2}})\s*年\s*年度报告', 1)
                          ELSE regexp_extract(doc_id || ' ' || first_text, '(20\d{{2}})', 1) END AS year FROM cover0),
cover2 AS (SELECT *, CASE WHEN year <> '' AND contains(first_text, year || ' 年年度报告') THEN year || ' 年年度报告' WHEN year <> '' AND contains(first_text, year || ' 年度报告') THEN year || ' 年度报告'
                          WHEN regexp_extract(first_text, '(20\d{{2}})\s*年\s*年度报告', 1) <> '' THEN regexp_extract(first_text, '(20\d{{2}})\s*年\s*年度报告', 1) || ' 年年度报告' ELSE '' END AS title FROM cover1),
metric AS (SELECT m.*, company, year FROM ({_metric_sql()}) m JOIN cover2 USING (doc_id) WHERE value IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY doc_id, kind_no ORDER BY page_index, word_no) = 1),
growth AS (SELECT g.*, company, year FROM (SELECT doc_id, page_index, page_id, CASE WHEN strpos(page_text, '营业收入') > 0 THEN regexp_extract(substr(page_text, strpos(page_text, '营业收入'), 360), '{_PERCENT}') END AS value,
                  {_clip_sql("page_text", "'营业收入'", 120, 360)} AS evidence FROM page_t) g JOIN cover2 USING (doc_id) WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_index) = 1),
risk AS (SELECT r.*, company FROM (SELECT doc_id, page_index, page_id, {_risk_sql()} AS evidence FROM page_t WHERE page_index >= 8) r JOIN cover2 USING (doc_id) WHERE evidence IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_index) = 1),
every AS ({_row_sql("cover2 WHERE year <> ''", "0", question="company || '这份年度报告对应的报告年度是哪一年？'", answer="year", **_FACT)}
  UNION ALL {_row_sql("cover2 WHERE title <> ''", "1", question="company || '年度报告首页或标题处显示的报告标题是什么？'", answer="title", **_FACT)}
  UNION ALL {_row_sql("metric", "kind_no", question="company || year || '年年度报告披露的' || ending", answer="trim(value || ' ' || unit)", evidence_pages="page_id", evidence_text="evidence", evidence_type="'numeric'", question_type="'numeric'", difficulty="'medium'", source_section="section", notes="'v2_rule_generated; numeric_value_need_verify_manually'", answer_unit="unit", raw_answer_value="value", normalized_answer="trim(value || ' ' || unit)", value_evidence_text="evidence", unit_evidence_text="unit_text")}
  UNION ALL {_row_sql("growth", "7", question="company || year || '年年度报告中营业收入相比上年的增减幅度是多少？'", answer="value", evidence_pages="page_id", evidence_text="evidence", evidence_type="'numeric'", question_type="'comparison'", difficulty="'medium'", source_section="'main_accounting_data'", notes="'v2_rule_generated; percentage_need_verify_manually'", raw_answer_value="value", normalized_answer="value", value_evidence_text="evidence")}
  UNION ALL {_row_sql("risk", "8", question="company || '年度报告中披露的风险相关内容是什么？'", answer="left(evidence, 180)", evidence_pages="page_id", evidence_text="evidence", evidence_type="'text'", question_type="'risk_text'", difficulty="'medium'", source_section="'risk'", notes="'v2_rule_generated; verify_manually'", normalized_answer="left(evidence, 180)", value_evidence_text="evidence")}),
limited AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kind_no) <= 9),
ann AS (SELECT *, row_number() OVER (ORDER BY doc_id, kind_no) AS no, 'cn_v2_q' || CASE WHEN row_number() OVER (ORDER BY doc_id, kind_no) < 10000 THEN lpad(CAST(row_number() OVER (ORDER BY doc_id, kind_no) AS VARCHAR), 4, '0')
                       ELSE CAST(row_number() OVER (ORDER BY doc_id, kind_no) AS VARCHAR) END AS query_id, 'true' AS is_answerable,
               CASE WHEN value_evidence_text <> '' THEN evidence_pages ELSE '' END AS value_evidence_pages, CASE WHEN unit_evidence_text <> '' THEN evidence_pages ELSE '' END AS unit_evidence_pages FROM limited)"""


@_query(f"WITH {_REPORTS}, {_ANNOTATIONS} SELECT {', '.join(ANNOTATION_COLUMNS)} FROM ann")
def report_annotations(spark, sf_dir):
    """Questions and answers made by rule from every report, nine at most."""
    return pp.annotation_rows(report_pages(spark, sf_dir), 9)


@_fixed(f"WITH {DEMO.replace('page_t AS', 'every_page AS')}, page_t AS (SELECT * FROM every_page WHERE doc_id = 'demo_finance_2025'), {_ANNOTATIONS} SELECT {', '.join(ANNOTATION_COLUMNS)} FROM ann")
def annotation_rows_demo(spark, sf_dir):
    """Annotations of the demo's finance report."""
    from ..sources.demo import demo_tables

    return pp.annotation_rows(demo_tables(spark)["pages"].where("doc_id = 'demo_finance_2025'"), 9)


def _overlap_sql(s: str, t: str) -> str:
    mine, yours = f"list_distinct(string_split(left({s}, 160), ''))", f"list_distinct(string_split(left({t}, 260), ''))"
    return f"least(2.0::DOUBLE, len(list_filter({mine}, lambda x: list_contains({yours}, x)))::DOUBLE / len({mine}) * 2.0::DOUBLE)"


def _match_sql() -> str:
    """How well a node (``t`` its form, ``text``) matches an annotation."""
    digits = lambda v: rf"regexp_replace({v}, '[^0-9.\-()%]', '', 'g')"
    total = []
    for c in ("raw_answer_value", "answer"):
        v = _form_sql(c)
        total.append(f"CASE WHEN {v} <> '' AND contains(t, {v}) THEN 5.0::DOUBLE ELSE 0 END + CASE WHEN {digits(v)} <> '' AND contains({digits('t')}, {digits(v)}) THEN 3.5::DOUBLE ELSE 0 END")
    total += [f"CASE WHEN contains(question, '{k}') AND contains(text, '{k}') THEN 4.0::DOUBLE ELSE 0 END" for k in lx.FINANCIAL]
    for c in ("value_evidence_text", "unit_evidence_text", "evidence_text"):
        s = _form_sql(c)
        total.append(f"CASE WHEN length({s}) >= 16 AND contains(t, left({s}, 80)) THEN 3.0::DOUBLE WHEN {s} <> '' THEN {_overlap_sql(s, 't')} ELSE 0 END")
    return " + ".join([*total, "CASE WHEN answer_unit <> '' AND contains(text, answer_unit) THEN 1.0::DOUBLE ELSE 0 END"])


@_query(
    f"""WITH {_REPORTS}, {_ANNOTATIONS},
pair AS (SELECT a.*, n.node_id, n.text, n.reading_order, n.ord, {_form_sql("n.text")} AS t FROM ann a JOIN node_t n ON n.page_id = a.evidence_pages),
scored AS (SELECT *, {_match_sql()} AS match FROM pair),
best AS (SELECT query_id, node_id, match, row_number() OVER (PARTITION BY query_id ORDER BY round(match, 9) DESC, reading_order, ord) AS place FROM scored WHERE match > 0 QUALIFY place <= 3),
found AS (SELECT query_id, list(node_id ORDER BY place) AS nodes, round(sum(match), 6) AS total FROM best GROUP BY query_id),
fallback AS (SELECT query_id, arg_min(node_id, ord) AS node_id FROM pair GROUP BY query_id)
SELECT query_id, doc_id, question_type, array_to_string(coalesce(nodes, [f.node_id], []), ';') AS gold_nodes, evidence_pages AS gold_pages, answer_unit,
       CASE WHEN nodes IS NOT NULL THEN 'matched' WHEN f.node_id IS NOT NULL THEN 'fallback' ELSE 'missing' END AS status
FROM ann LEFT JOIN found USING (query_id) LEFT JOIN fallback f USING (query_id)"""
)
def report_annotation_match(spark, sf_dir):
    """Gold nodes of the rule-made annotations: the three nodes of the page that match best."""
    made = materialize(pp.annotation_rows(report_pages(spark, sf_dir), 9), "annotations")
    q = pp.match_annotations(made, report_nodes(spark, sf_dir), "reports", "qa_annotations_v2.csv")
    gold = [F.array_join(f"evidence_{c}_ids", ";").alias(f"gold_{c}s") for c in ("node", "page")]
    return q.select("query_id", "doc_id", "question_type", *gold, F.col("metadata.answer_unit").alias("answer_unit"), F.col("metadata.node_match_status").alias("status"))


# -- generic tables ------------------------------------------------------------------------

_TURNS = """b AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CASE WHEN turn = 0 THEN 1 ELSE CAST(turn AS INTEGER) END AS page_index, text, CASE WHEN role = 'user' THEN text ELSE '' END AS question,
                         conv_id * 10000 + turn AS ord FROM conversations),
p AS (SELECT *, doc_id || '_p' || page_index AS page_id, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY ord) AS no FROM b),
first_docs AS (SELECT doc_id FROM b GROUP BY doc_id QUALIFY row_number() OVER (ORDER BY min(ord)) <= 100)"""


def _turns(spark: SparkSession, sf_dir: str, limit_docs: int | None = None) -> dict[str, DataFrame]:
    rows = _read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("string").alias("page"), F.col("text").alias("content"),
        F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("question"), (F.col("conv_id") * 10000 + F.col("turn")).alias("ord"),
    )
    return pp.from_tables(rows, "conversations", limit_docs)


@_query(f"WITH {_TURNS} SELECT doc_id, page_id, page_index, text AS page_text FROM p WHERE no = 1")
def generic_pages(spark, sf_dir):
    return _turns(spark, sf_dir)["pages"].select("doc_id", "page_id", "page_index", "page_text")


@_query(f"WITH {_TURNS} SELECT 'conversations_q' || row_number() OVER (ORDER BY ord) AS query_id, doc_id, question, page_id AS gold_page, page_id || '_n' || no AS gold_node FROM p WHERE question <> ''")
def generic_queries(spark, sf_dir):
    """Questions of all conversations, numbered in their order."""
    q = _turns(spark, sf_dir)["queries"]
    return q.select("query_id", "doc_id", "question", F.col("evidence_page_ids")[0].alias("gold_page"), F.col("evidence_node_ids")[0].alias("gold_node"))


@_query(f"WITH {_TURNS} SELECT doc_id, doc_id AS title, CAST(count(*) AS INTEGER) AS num_pages FROM p WHERE no = 1 AND doc_id IN (SELECT doc_id FROM first_docs) GROUP BY doc_id")
def generic_documents(spark, sf_dir):
    """The first hundred documents (a limit that the adapter has) and their pages."""
    return _turns(spark, sf_dir, 100)["documents"].select("doc_id", "title", "num_pages")


# -- files ---------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return folder(spark, "files")


@_query(f"WITH {_REPORTS} SELECT n.node_id, n.text, CAST(n.page_index AS VARCHAR) AS page_index, p.page_text, count(q.query_id) AS questions FROM node_t n JOIN page_t p USING (doc_id, page_id) JOIN query_t q USING (doc_id) GROUP BY ALL")
def dataset_roundtrip(spark, sf_dir):
    """The four relations of the reports written as a data set and read again."""
    nodes, pages, queries = report_nodes(spark, sf_dir), report_pages(spark, sf_dir), report_queries(spark, sf_dir)
    docs = pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("num_pages")).withColumn("dataset", F.lit("reports"))
    tables = {"documents": docs, "pages": rd.conform(pages, PAGES), "nodes": rd.conform(nodes, NODES), "queries": rd.conform(queries, QUERY_SCHEMA)}
    place = _folder(spark)
    runs.write_dataset(tables, place)
    t = rd.read_dataset(spark, place)
    asked = t["queries"].join(t["documents"].select("doc_id"), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("questions"))
    joined = t["nodes"].join(t["pages"].select("page_id", "page_text"), "page_id").join(asked, "doc_id")
    return joined.select("node_id", "text", F.col("metadata.page_index").alias("page_index"), "page_text", "questions")


@_query(f"WITH {_REPORTS} SELECT node_id, text, CAST(page_index AS VARCHAR) AS page_index FROM node_t")
def json_text_roundtrip(spark, sf_dir):
    """Nested values as JSON texts and back."""
    path = f"{_folder(spark)}/nodes.parquet"
    runs.to_json_text(rd.conform(report_nodes(spark, sf_dir), NODES)).write.parquet(path)
    return rd.read_table(spark, path, NODES).select("node_id", "text", F.col("metadata.page_index").alias("page_index"))


_TOP_TWO = f"{_bm25_sql('eg_', _NODES, _IN_DOCUMENT)}, {_top_sql('eg_', 2)}"


@_query(f"WITH {_REPORTS}, {_TOP_TWO} SELECT query_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, item AS node_id, 'bm25' AS retriever FROM eg_top")
def hits_roundtrip(spark, sf_dir):
    """Hits written and read again."""
    path = f"{_folder(spark)}/predictions.parquet"
    rt.retrieve_nodes(report_queries(spark, sf_dir), report_nodes(spark, sf_dir), "bm25", 2, "document").write.parquet(path)
    found = rd.read_hits(spark, path)
    assert found.schema.names == HITS.names
    return found.select("query_id", "rank", F.round("score", 6).alias("score"), "node_id", "retriever")


@_query("SELECT kind, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation, (VALUES ('csv'), ('json'), ('jsonl'), ('parquet')) AS v(kind)")
def table_readers(spark, sf_dir):
    """The same table as CSV, JSON, JSON lines and Parquet through the generic reader; a JSON file for each region."""
    nation, place = _read(spark, sf_dir, "nation"), _folder(spark)
    nation.write.parquet(f"{place}/t.parquet")
    nation.write.csv(f"{place}/t.csv", header=True, escape='"')
    nation.write.json(f"{place}/t.jsonl")
    rows = F.to_json(F.struct(F.array_agg(F.struct(*nation.columns)).alias("data")))
    nation.groupBy(F.col("n_regionkey").alias("part")).agg(rows.alias("value")).write.partitionBy("part").text(f"{place}/t.json")
    out = None
    for kind in ("csv", "json", "jsonl", "parquet"):
        df = rd.read_any(spark, f"{place}/t.{kind}")
        df = df.select(F.lit(kind).alias("kind"), *(F.col(c).cast("string").alias(c) for c in nation.columns))
        out = df if out is None else out.unionByName(df)
    return out


_MIXED = """m AS (SELECT o_orderkey AS id, CASE o_orderkey % 5
  WHEN 0 THEN '{"priority": "' || o_orderpriority || '", "total": ' || CAST(round(o_totalprice * 100) AS BIGINT) || ', "by": {"clerk": "' || o_orderstatus || '", "tags": ["a", ' || o_custkey || ', null]}}'
  WHEN 1 THEN '[' || o_custkey || ', "' || o_orderstatus || '", {"deep": [' || o_orderkey || ']}]'
  WHEN 2 THEN 'note ' || o_custkey WHEN 3 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS text FROM orders)"""


@_query(
    f"""WITH {_MIXED} SELECT id, CASE id % 5 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'text' WHEN 3 THEN 'number' ELSE 'none' END AS kind,
CASE WHEN id % 5 = 0 THEN text::JSON->'by'->>'clerk' END AS clerk, CASE WHEN id % 5 = 0 THEN CAST(text::JSON->>'total' AS BIGINT) END AS total,
CASE WHEN id % 5 = 0 THEN CAST(text::JSON->'by'->'tags'->>1 AS BIGINT) WHEN id % 5 = 1 THEN CAST(text::JSON->2->'deep'->>0 AS BIGINT) WHEN id % 5 = 3 THEN CAST(text AS BIGINT) END AS number,
CASE WHEN id % 5 = 2 THEN text END AS note FROM m"""
)
def metadata_variants(spark, sf_dir):
    """Metadata of mixed kinds, read from texts as VARIANT, written as such and read again."""
    o, c = _read(spark, sf_dir, "orders"), lambda n: F.col(n).cast("string")
    kind = F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, F.format_string('{"priority": "%s", "total": %s, "by": {"clerk": "%s", "tags": ["a", %s, null]}}', "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), "o_orderstatus", c("o_custkey")))
        .when(kind == 1, F.format_string('[%s, "%s", {"deep": [%s]}]', c("o_custkey"), "o_orderstatus", c("o_orderkey")))
        .when(kind == 2, F.concat(F.lit("note "), c("o_custkey")))
        .when(kind == 3, c("o_custkey"))
        .otherwise("")
    )
    place = _folder(spark)
    o.select(F.col("o_orderkey").alias("id"), text.alias("metadata")).write.parquet(f"{place}/texts.parquet")
    schema = rd.with_variants(T.StructType([T.StructField("id", T.LongType()), T.StructField("metadata", T.StringType())]))
    rd.read_table(spark, f"{place}/texts.parquet", schema).write.parquet(f"{place}/variants.parquet")
    back, kinds = rd.read_table(spark, f"{place}/variants.parquet", schema), {"OBJECT": "object", "ARRAY": "array", "STRING": "text", "BIGINT": "number"}
    get = lambda path, t: F.try_variant_get("metadata", path, t)
    found = F.regexp_extract(F.schema_of_variant("metadata"), r"^[A-Z]+", 0)
    named = F.coalesce(*(F.when(found == k, v) for k, v in kinds.items()), F.lit("none"))
    number = F.coalesce(get("$.by.tags[1]", "bigint"), get("$[2].deep[0]", "bigint"), F.when(found == "BIGINT", get("$", "bigint")))
    note = F.when(found == "STRING", get("$", "string"))
    return back.select("id", named.alias("kind"), get("$.by.clerk", "string").alias("clerk"), get("$.total", "bigint").alias("total"), number.alias("number"), note.alias("note"))


@_query(
    f"""WITH l AS (SELECT doc_id AS no, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
blocks AS (SELECT no, i, {_clean_sql("line")} AS chunk FROM l WHERE {_clean_sql("line")} <> ''),
rows AS (SELECT no, i, chunk, unnest(range(1, {len(lx.FINANCIAL) + 1})) AS n, unnest([{", ".join(f"CASE WHEN contains(chunk, '{k}') AND regexp_matches(substr(chunk, strpos(chunk, '{k}'), 360), '{_NUMBER}') THEN substr(chunk, strpos(chunk, '{k}'), 360) END" for k in lx.FINANCIAL)}]) AS text FROM blocks),
pieces AS (SELECT no, i, n, text, 'table_row' AS node_type, left({_form_sql("text")}, 180) AS key FROM rows WHERE text IS NOT NULL
           UNION ALL SELECT no, i, 99, left(chunk, 900), CASE WHEN len(regexp_extract_all(chunk, '{_NUMBER}')) >= 3 OR {_any_sql("chunk", lx.FINANCIAL)} THEN 'table_block' ELSE 'paragraph' END, left({_form_sql("chunk")}, 220) FROM blocks WHERE length(chunk) >= 12),
firsts AS (SELECT * FROM pieces QUALIFY row_number() OVER (PARTITION BY no, key ORDER BY i, n) = 1 AND key <> ''),
kept AS (SELECT no, i, n, text, node_type, CAST(i AS DOUBLE) AS top FROM firsts
         UNION ALL SELECT doc_id, 0, 0, CASE WHEN {_clean_sql("coalesce(text, '')")} = '' THEN lpad(CAST(doc_id AS VARCHAR), 12, '0') || '_p1' ELSE {_clean_sql("text")} END, 'paragraph', NULL FROM documents WHERE doc_id NOT IN (SELECT no FROM pieces))
SELECT no AS doc, CAST(row_number() OVER (PARTITION BY no ORDER BY i, n) AS INTEGER) AS reading_order, node_type, text, top, CASE WHEN no IN (SELECT no FROM blocks) THEN 'pymupdf_block_metric_rows' ELSE 'text_fallback' END AS method FROM kept"""
)
def block_nodes(spark, sf_dir):
    """Every document as one page whose lines are blocks with boxes, split into nodes."""
    doc = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    box = lambda i: F.array(F.lit(0.0), (i + 1).cast("double"), F.lit(100.0), (i + 2).cast("double"))
    blocks = F.transform(lines, lambda x, i: F.struct(box(i).alias("bbox"), x.alias("text")))
    pages = _read(spark, sf_dir, "documents").select(
        doc.alias("doc_id"), F.concat(doc, F.lit("_p1")).alias("page_id"), F.lit(1).alias("page_index"), F.col("text").alias("page_text"), F.lit("").alias("source_pdf"), blocks.alias("blocks"), F.col("doc_id").cast("long").alias("ord")
    )
    found = pp.split_nodes(pages)
    return found.select(F.col("doc_id").cast("long").alias("doc"), "reading_order", "node_type", "text", F.col("bbox")[1].alias("top"), F.col("metadata.chunk_method").alias("method"))


_RUN_FILES = ("config.json", "errors.csv", "manifest.json", "metrics.json", "predictions.parquet", "run_info.json", "sufficiency_cases.csv", "sufficiency_metrics.json", "sufficiency_summary.md", "summary.md")
_PAGE_TOP = f"{_bm25_sql('b_', _pages := 'SELECT {q}{q} AS scope, page_id AS item, ord, page_text AS body FROM page_t'.format(q=chr(39)), 'SELECT query_id, {q}{q} AS scope, question FROM query_t'.format(q=chr(39)))}, {_top_sql('b_', 10)}"


@_query(
    f"""WITH {_REPORTS}, {_PAGE_TOP},
gold AS (SELECT query_id, max((list_contains(evidence_page_ids, item) AND rank <= 1)::INT) AS p1, max((list_contains(evidence_page_ids, item) AND rank <= 5)::INT) AS p5,
                max(CASE WHEN list_contains(evidence_page_ids, item) THEN 1.0 / rank ELSE 0 END) AS rr FROM query_t JOIN b_top USING (query_id) GROUP BY query_id)
SELECT 'metric' AS kind, 'page_recall@1' AS name, round(avg(p1), 6)::VARCHAR AS value FROM gold UNION ALL SELECT 'metric', 'page_recall@5', round(avg(p5), 6)::VARCHAR FROM gold
UNION ALL SELECT 'metric', 'mrr', round(avg(rr), 6)::VARCHAR FROM gold UNION ALL SELECT 'rows', table_name, n::VARCHAR FROM (SELECT 'hits' AS table_name, (SELECT count(*) FROM b_top) AS n UNION ALL SELECT 'nodes', (SELECT count(*) FROM node_t)
UNION ALL SELECT 'pages', (SELECT count(*) FROM page_t) UNION ALL SELECT 'queries', (SELECT count(*) FROM query_t)) UNION ALL SELECT 'file', f, '' FROM (VALUES {", ".join(f"('{f}')" for f in _RUN_FILES)}) AS v(f)"""
)
def report_run(spark, sf_dir):
    """The reports as a data set in the shared folder, retrieved, evaluated and verified as the command line does it: metrics, row counts and files."""
    root = _folder(spark)
    nodes, pages, queries = report_nodes(spark, sf_dir), report_pages(spark, sf_dir), report_queries(spark, sf_dir)
    docs = pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("num_pages")).withColumn("dataset", F.lit("reports"))
    tables = {"documents": docs, "pages": rd.conform(pages, PAGES), "nodes": rd.conform(nodes, NODES), "queries": rd.conform(queries, QUERY_SCHEMA)}
    kept = {k: os.environ.get(k) for k in ("MDR_DATA_ROOT", "MDR_RUNS_ROOT", "MDR_ARTIFACT_ROOT")}
    os.environ.update({k: f"{root}/{k[4:-5].lower()}" for k in kept})
    try:
        counts = runs.write_dataset(tables, runs.data_root() / "processed/reports")
        config = runs.data_root() / "reports.json"
        config.write_text(json.dumps({"dataset": "reports", "output_dir": "${MDR_RUNS_ROOT}/reports", "retriever": {"type": "bm25_page", "top_k": [1, 5, 10]}}))
        run = runs.run_retrieval(spark, runs.load_config(config))
        found = runs.evaluate_run(spark, run.parent / "latest")
        runs.verify_run(spark, run)
        runs.export_table(run)
        hits = rd.read_hits(spark, str(run / "predictions.parquet")).count()
        rows = [("metric", k, str(round(found[k], 6))) for k in ("page_recall@1", "page_recall@5", "mrr")]
        rows += [("rows", k, str(n)) for k, n in {**counts, "hits": hits}.items() if k != "documents"]
        rows += [("file", f, "") for f in run.names()]
    finally:
        for k, v in kept.items():
            os.environ.pop(k, None) if v is None else os.environ.update({k: v})
    return spark.createDataFrame(rows, "kind string, name string, value string")
