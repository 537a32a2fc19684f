"""Queries over reports that are derived from the driver's ``supplier`` table, and their DuckDB SQL.

Every supplier is a report of five pages whose lines are evidence nodes: a cover, a table
of figures, research and assets, a narrative, and risks on page 8. Figures come from the
account balance. Eight questions ask for each report; they have types, answers and units,
so that every rule of the evidence sets and of the sufficiency check runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import evidence as ev
from ..operators import metrics as mt
from ..operators import retrieval as rt
from ..operators import sufficiency as sf
from ..schemas import QUERIES as QUERY_SCHEMA
from ..sources import demo
from ..store import by_shuffle, join_rule, materialize
from .queries import _GOLD_NODES, _VIEWS, _any_sql, _bm25_sql, _fixed, _query, _read, _rounded, _slots_sql, _tfidf_sql, _top_sql, _values, node_table, page_table, query_table

# Lines of a report (page, line, type, text); <n> is the name, <a1> to <a7> amounts, <g> a rate, <k> a number.
LINES = [
    (1, 1, "paragraph", "<n>：2025 年年度报告"),
    (1, 2, "paragraph", "证券代码 <k> 证券简称 <n>"),
    (2, 1, "paragraph", "单位：元"),
    (2, 2, "table_block", "主要会计数据 项目 2025 年 2024 年 本年比上年增减"),
    (2, 3, "table_row", "营业收入 <a1> <a2> <g>%"),
    (2, 4, "table_row", "归属于上市公司股东的净利润 <a3> <a4> -<g>%"),
    (2, 5, "table_row", "经营活动产生的现金流量净额 (<a5>)"),
    (3, 1, "paragraph", "研发与资产 单位：万元"),
    (3, 2, "table_row", "研发投入 <a6> 研发人员 <k> 人 占比 3.5%"),
    (3, 3, "table_block", "资产总额 <a7> 2024 年 项目"),
    (4, 1, "paragraph", "营业收入为人民币 <a1> 元，管理层确认收入时点存在审计风险"),
    (4, 2, "paragraph", "可能面对的风险：市场波动 <n>"),
    (8, 1, "paragraph", "风险因素 行业竞争 <k> 2025 年度"),
]
# Questions of a report (number, question, type, unit, answer, raw value, gold page, gold line).
QUESTIONS = [
    (1, "2025年营业收入是多少？", "numeric", "元", "<a1> 元", "<a1>", 2, 3),
    (2, "<n>2025年归属于上市公司股东的净利润是多少亿元？", "numeric", "", "<a3> 亿元", "", 2, 4),
    (3, "营业收入相比上年的增减幅度是多少？", "comparison", "", "<g>%", "<g>%", 2, 3),
    (4, "这份年度报告对应的报告年度是哪一年？", "fact", "", "2025", "", 1, 1),
    (5, "2024年度研发投入或研发费用是多少万元？占比%是多少？", "numeric", "万元", "<a6> 万元", "<a6>", 3, 2),
    (6, "经营活动产生的现金流量净额是多少？", "numeric", "元", "(<a5>)", "", 2, 5),
    (7, "公司面临的风险因素是什么？", "risk_text", "", "", "", 8, 1),
    (8, "行业竞争 alpha beta <k>", "text", "", "", "", 8, 1),
]
#: Amounts: factors of the balance in cents.
FACTORS = (7919, 6007, 911, 1009, 313, 97, 10007)


# -- the derived relations ---------------------------------------------------------


def _amount(cents: Column) -> Column:
    whole, rest = F.floor(cents / 100).cast("long"), (cents % 100).cast("string")
    three = lambda c: F.lpad(c.cast("string"), 3, "0")
    million, thousand, one = F.floor(whole / 1_000_000).cast("long"), F.floor(whole / 1000).cast("long") % 1000, whole % 1000
    big = F.concat_ws(",", million.cast("string"), three(thousand), three(one))
    middle = F.concat_ws(",", F.floor(whole / 1000).cast("long").cast("string"), three(one))
    return F.concat(F.when(whole >= 1_000_000, big).when(whole >= 1000, middle).otherwise(whole.cast("string")), F.lit("."), F.lpad(rest, 2, "0"))


def _amount_sql(cents: str) -> str:
    whole = f"({cents} // 100)"
    three = lambda c: f"lpad(CAST({c} AS VARCHAR), 3, '0')"
    big = f"CAST({whole} // 1000000 AS VARCHAR) || ',' || {three(f'({whole} // 1000) % 1000')} || ',' || {three(f'{whole} % 1000')}"
    middle = f"CAST({whole} // 1000 AS VARCHAR) || ',' || {three(f'{whole} % 1000')}"
    return f"(CASE WHEN {whole} >= 1000000 THEN {big} WHEN {whole} >= 1000 THEN {middle} ELSE CAST({whole} AS VARCHAR) END || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, no and what fills the templates, per supplier."""
    cents = F.round(F.abs(F.col("s_acctbal")) * 100).cast("long")
    key = F.col("s_suppkey").cast("long")
    amounts = {f"a{i}": _amount(cents * f + key * 13) for i, f in enumerate(FACTORS, 1)}
    return _read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("R"), F.lpad(key.cast("string"), 8, "0")).alias("doc_id"),
        key.alias("no"),
        F.concat(F.lit("公司"), key.cast("string")).alias("n"),
        (key % 50).cast("string").alias("k"),
        F.concat((cents % 90).cast("string"), F.lit("."), F.lpad((key % 100).cast("string"), 2, "0")).alias("g"),
        *(v.alias(name) for name, v in amounts.items()),
    )


def _filled(template: Column) -> Column:
    for name in ("n", "k", "g", *(f"a{i}" for i in range(1, len(FACTORS) + 1))):
        template = F.replace(template, F.lit(f"<{name}>"), F.col(name))
    return template


def _filled_sql(template: str) -> str:
    for name in ("n", "k", "g", *(f"a{i}" for i in range(1, len(FACTORS) + 1))):
        template = f"replace({template}, '<{name}>', {name})"
    return template


def _templates(rows: list[tuple], names: tuple[str, ...]) -> Column:
    return F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows))).alias("t")


def report_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir).select("*", _templates(LINES, ("page", "line", "type", "text")))
    page_id = F.concat("doc_id", F.lit("_p"), F.col("t.page").cast("string"))
    return rows.select(
        F.concat(page_id, F.lit("_n"), F.col("t.line").cast("string")).alias("node_id"),
        "doc_id",
        page_id.alias("page_id"),
        F.col("t.type").alias("node_type"),
        _filled(F.col("t.text")).alias("text"),
        F.col("t.line").cast("int").alias("reading_order"),
        F.create_map(F.lit("page_index"), F.col("t.page").cast("string")).alias("metadata"),
        (F.col("no") * 1000 + F.col("t.page") * 100 + F.col("t.line")).cast("long").alias("ord"),
    )


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the reports: each template page is one text, so nothing is shuffled."""
    pages = sorted({(p, "\n".join(x for q, _, _, x in LINES if q == p)) for p, *_ in LINES})
    rows = _facts(spark, sf_dir).select("*", _templates(pages, ("page", "text")))
    return rows.select(
        "doc_id",
        F.concat("doc_id", F.lit("_p"), F.col("t.page").cast("string")).alias("page_id"),
        F.col("t.page").cast("int").alias("page_index"),
        _filled(F.col("t.text")).alias("page_text"),
        F.lit("").alias("ocr_text"),
        (F.col("no") * 1000 + F.col("t.page") * 100).cast("long").alias("ord"),
    )


def report_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir).select("*", _templates(QUESTIONS, ("q", "question", "type", "unit", "answer", "raw", "page", "line")))
    page = F.concat("doc_id", F.lit("_p"), F.col("t.page").cast("string"))
    out = rows.select(
        F.concat("doc_id", F.lit("_q"), F.col("t.q").cast("string")).alias("query_id"),
        F.lit("reports").alias("dataset"),
        "doc_id",
        _filled(F.col("t.question")).alias("question"),
        _filled(F.col("t.answer")).alias("answer"),
        F.col("t.type").alias("question_type"),
        F.array(page).alias("evidence_page_ids"),
        F.array(F.concat(page, F.lit("_n"), F.col("t.line").cast("string"))).alias("evidence_node_ids"),
        F.array().cast("array<array<double>>").alias("evidence_bboxes"),
        F.lit(True).alias("is_answerable"),
        F.create_map(F.lit("answer_unit"), F.col("t.unit"), F.lit("raw_answer_value"), _filled(F.col("t.raw"))).alias("metadata"),
    )
    assert out.columns == QUERY_SCHEMA.names
    return materialize(out, "report_queries")


_CENTS = "CAST(round(abs(s_acctbal) * 100) AS BIGINT)"
_REPORTS = f"""
fact AS (SELECT 'R' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS doc_id, s_suppkey AS no, '公司' || CAST(s_suppkey AS VARCHAR) AS n, CAST(s_suppkey % 50 AS VARCHAR) AS k,
                CAST({_CENTS} % 90 AS VARCHAR) || '.' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') AS g,
                {", ".join(f"{_amount_sql(f'({_CENTS} * {f} + s_suppkey * 13)')} AS a{i}" for i, f in enumerate(FACTORS, 1))} FROM supplier),
node_t AS (SELECT doc_id || '_p' || page || '_n' || line AS node_id, doc_id, doc_id || '_p' || page AS page_id, type AS node_type, {_filled_sql("txt")} AS text,
                  CAST(line AS INTEGER) AS reading_order, CAST(page AS INTEGER) AS page_index, CAST(no * 1000 + page * 100 + line AS BIGINT) AS ord
           FROM fact, {_values(LINES, "page, line, type, txt")}),
page_t AS (SELECT doc_id, page_id, any_value(page_index) AS page_index, string_agg(text, chr(10) ORDER BY ord) AS page_text, min(ord) // 100 * 100 AS ord FROM node_t GROUP BY ALL),
query_t AS (SELECT doc_id || '_q' || q AS query_id, doc_id, {_filled_sql("question")} AS question, {_filled_sql("answer")} AS answer, type AS question_type, unit, {_filled_sql("raw")} AS raw,
                   [doc_id || '_p' || page] AS evidence_page_ids, [doc_id || '_p' || page || '_n' || line] AS evidence_node_ids
            FROM fact, {_values(QUESTIONS, "q, question, type, unit, answer, raw, page, line")})
"""


@_query(f"WITH {_REPORTS} SELECT node_id, doc_id, page_id, node_type, text, reading_order, ord FROM node_t")
def report_nodes_view(spark, sf_dir):
    return report_nodes(spark, sf_dir).drop("metadata")


@_query(f"WITH {_REPORTS} SELECT doc_id, page_id, page_index, page_text, CAST(ord AS BIGINT) AS ord FROM page_t")
def report_pages_view(spark, sf_dir):
    return report_pages(spark, sf_dir).drop("ocr_text")


@_query(f"WITH {_REPORTS} SELECT query_id, array_to_string({_slots_sql('question', 'question_type', 'unit')}, '|') AS slots FROM query_t")
def report_slots(spark, sf_dir):
    """What evidence for each question should cover."""
    return ev.question_features(report_queries(spark, sf_dir)).select("query_id", F.array_join("target_slots", "|").alias("slots"))


# -- SQL of the evidence rules ------------------------------------------------------

_SHAPE = lx.NUMERIC_SHAPE.removeprefix("(?U)")
_LIKE = lx.NUMBER_LIKE.removeprefix("(?U)")
_COMPACT = lambda t: rf"regexp_replace({t}, '\s+', '', 'g')"
_COUNTED = lambda c, terms: "(" + " + ".join(f"contains({c}, '{x}')::INT" for x in terms) + ")"


def _unit_sql(c: str, unit: str) -> str:
    return f"CASE WHEN {unit} = '元' THEN regexp_matches({c}, '(^|[^万亿])元') ELSE contains({c}, {unit}) END"


def _asked_metric_sql(q: str, c: str) -> str:
    return "(" + " OR ".join(f"({_any_sql(q, a)} AND {_any_sql(c, a)})" for a in lx.METRICS.values()) + ")"


def _section_sql(q: str, c: str) -> str:
    return "(CASE " + " ".join(f"WHEN {_any_sql(q, asked)} THEN {_any_sql(c, words)}" for asked, words in lx.SECTIONS) + " ELSE false END)"


def _units_sql(q: str, unit: str) -> str:
    """The annotated unit, then units of the question that no chosen one contains."""
    named = []
    for u in lx.UNITS:
        longer = [v for v in lx.UNITS if v != u and u in v]
        named.append(f"CASE WHEN contains({q}, '{u}') AND NOT contains({unit}, '{u}')" + (f" AND NOT {_any_sql(q, longer)}" if longer else "") + f" THEN '{u}' END")
    return f"list_filter([CASE WHEN {unit} <> '' THEN {unit} END, {', '.join(named)}], lambda x: x IS NOT NULL)"


def _covered_sql(slots: str, c: str, number: str) -> str:
    """The slots that a compact text covers; ``number`` is the pattern of numeric_shape."""
    metric = "CASE " + " ".join(f"WHEN s[8:] = '{m}' THEN {_any_sql(c, a)}" for m, a in lx.METRICS.items()) + " ELSE false END"
    return (
        f"list_filter({slots}, lambda s: CASE WHEN s LIKE 'metric:%' THEN {metric} WHEN s LIKE 'unit:%' THEN {_unit_sql(c, 's[6:]')} "
        f"WHEN s = 'numeric_shape' THEN regexp_matches({c}, '{number}') WHEN s LIKE 'year:%' THEN contains({c}, s[6:]) ELSE contains({c}, s[9:]) END)"
    )


_FEATURES = rf"""
feat AS (SELECT query_id, doc_id, question, question_type, unit, {_COMPACT("question")} AS cq, {_slots_sql("question", "question_type", "unit")} AS slots,
                list_distinct(regexp_extract_all(question, '20\d{{2}}')) AS years, {_units_sql("question", "unit")} AS units,
                question_type IN ('numeric', 'comparison') AS numeric, {_any_sql(_COMPACT("question"), lx.COVER_QUESTION)} AS cover FROM query_t),
ctx AS (SELECT page_id, {_COMPACT("string_agg(text, ' ' ORDER BY reading_order, ord)")} AS c FROM node_t GROUP BY page_id),
scan AS (SELECT query_id, node_id, n.ord, {_COMPACT("text")} AS t, c, node_type, cq, years, units FROM feat JOIN node_t n USING (doc_id) JOIN ctx USING (page_id) WHERE numeric),
scan_score AS (SELECT query_id, node_id, ord, CASE WHEN t <> '' AND {_asked_metric_sql("cq", "t")} THEN
    1.0::DOUBLE + CASE WHEN len(list_filter(years, lambda y: contains(t, y) OR contains(c, y))) > 0 THEN 0.8::DOUBLE ELSE 0 END
    + CASE WHEN len(list_filter(units, lambda u: ({_unit_sql("t", "u")}) OR ({_unit_sql("c", "u")}))) > 0 THEN 0.8::DOUBLE ELSE 0 END
    + CASE WHEN regexp_matches(t, '{_SHAPE}') THEN 0.9::DOUBLE ELSE 0 END
    + CASE WHEN len(regexp_extract_all(t, '{_LIKE}')) >= 3 THEN 0.5::DOUBLE WHEN len(regexp_extract_all(t, '{_LIKE}')) >= 1 THEN 0.25::DOUBLE ELSE 0 END
    + CASE node_type WHEN 'table_row' THEN 0.7::DOUBLE WHEN 'table_block' THEN 0.4::DOUBLE ELSE 0 END
    + CASE WHEN {_COUNTED("t", lx.TABLE_TERMS)} >= 3 OR {_COUNTED("c", lx.TABLE_TERMS)} >= 3 THEN 0.7::DOUBLE ELSE 0 END
    + CASE WHEN {_section_sql("cq", "t")} OR {_section_sql("cq", "c")} THEN 0.5::DOUBLE ELSE 0 END
    - CASE WHEN {_COUNTED("t", lx.NARRATIVE_TERMS)} >= 2 THEN 0.8::DOUBLE ELSE 0 END ELSE 0 END AS structured_score FROM scan),
structured AS (SELECT query_id, node_id, structured_score, row_number() OVER (PARTITION BY query_id ORDER BY round(structured_score, 9) DESC, ord) AS r FROM scan_score WHERE structured_score > 0 QUALIFY r <= 20),
cover AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY reading_order, ord) AS r FROM feat JOIN node_t USING (doc_id) WHERE cover AND page_index = 1 QUALIFY r <= 8)
"""

_IN_DOCUMENT = "SELECT query_id, doc_id AS scope, question FROM query_t"
_PAGES = "SELECT doc_id AS scope, page_id AS item, ord, CASE WHEN page_text = '' THEN page_id ELSE page_text END AS body FROM page_t"
_NODES = "SELECT doc_id AS scope, node_id AS item, ord, CASE WHEN text = '' THEN node_id ELSE text END AS body FROM node_t"
_CANDIDATES = "SELECT query_id AS scope, node_id AS item, mention AS ord, CASE WHEN text = '' THEN node_id ELSE text END AS body FROM cand"


def _share(weight: float, rank: str) -> str:
    return f"CASE WHEN coalesce({rank}, 0) > 0 THEN {weight}::DOUBLE / {rank} ELSE 0 END"


def _round_sql(n: int) -> str:
    """One round of the greedy set: CTE pick{n} from pick{n - 1}."""
    new = "len(list_filter(cov, lambda s: NOT list_contains(covered, s)))"
    takes = f"place = 1 AND picked = 0 AND open{' AND new > 0' if n > 1 else ''}"
    return f"""
place{n} AS (SELECT *, {new} AS new, row_number() OVER (PARTITION BY query_id ORDER BY picked > 0, {new} DESC, coverage_score DESC, round(combined, 9) DESC, mention) AS place FROM pick{n - 1}),
take{n} AS (SELECT * REPLACE (CASE WHEN {takes} THEN {n} ELSE picked END AS picked) FROM place{n}),
gain{n} AS (SELECT *, any_value(cov) FILTER (WHERE picked = {n}) OVER (PARTITION BY query_id) AS gained FROM take{n}),
pick{n} AS (SELECT * EXCLUDE (new, place, gained) REPLACE (list_distinct(list_concat(covered, coalesce(gained, []))) AS covered,
            open AND gained IS NOT NULL AND len(list_distinct(list_concat(covered, coalesce(gained, [])))) < len(slots) AS open) FROM gain{n})"""


_SOURCES_SQL = "list_filter([" + ", ".join(f"CASE WHEN {r} IS NOT NULL THEN '{s}' END" for r, s in zip(("page_rank", "global_rank", "structured_rank", "cover_rank"), ev.SOURCES, strict=True)) + "], lambda x: x IS NOT NULL)"

#: Needs node_t, page_t and query_t (query_id, doc_id, question, question_type, unit); ends with ``merged``.
_MERGED = f"""{_FEATURES},
{_bm25_sql("eb_", _PAGES, _IN_DOCUMENT)}, {_top_sql("eb_", 20)}, {_tfidf_sql("et_", _PAGES, _IN_DOCUMENT)}, {_top_sql("et_", 20)},
page_fused AS (SELECT query_id, item, sum(1.0::DOUBLE / (60 + rank)) AS score, min(m * 1000 + rank) AS first
               FROM (SELECT 0 AS m, query_id, item, rank FROM eb_top UNION ALL SELECT 1, query_id, item, rank FROM et_top) GROUP BY ALL),
page_hit AS (SELECT query_id, item AS page_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS r FROM page_fused QUALIFY r <= 10),
{_bm25_sql("eg_", _NODES, _IN_DOCUMENT)}, {_top_sql("eg_", 20)},
mentions AS (SELECT query_id, node_id, 0 AS source, r, n.ord, n.doc_id, 0::DOUBLE AS structured_score FROM page_hit JOIN node_t n USING (page_id)
             UNION ALL SELECT query_id, item, 1, rank, n.ord, n.doc_id, 0 FROM eg_top JOIN node_t n ON n.node_id = item
             UNION ALL SELECT query_id, node_id, 2, r, n.ord, n.doc_id, structured_score FROM structured JOIN node_t n USING (node_id)
             UNION ALL SELECT query_id, node_id, 3, r, n.ord, n.doc_id, 0 FROM cover JOIN node_t n USING (node_id)),
merged0 AS (SELECT query_id, node_id, min(r) FILTER (WHERE source = 0) AS page_rank, min(r) FILTER (WHERE source = 1) AS global_rank, min(r) FILTER (WHERE source = 2) AS structured_rank,
                   min(r) FILTER (WHERE source = 3) AS cover_rank, max(structured_score) AS structured_score, min([source::BIGINT, r, ord]) AS said
            FROM mentions m JOIN query_t q USING (query_id) WHERE m.doc_id = q.doc_id GROUP BY query_id, node_id),
merged AS (SELECT * EXCLUDE said, row_number() OVER (PARTITION BY query_id ORDER BY said) AS mention FROM merged0)"""

EVIDENCE = f"""{_MERGED},
cand AS (SELECT m.*, n.doc_id AS node_doc, n.page_id, n.node_type, n.text, n.page_index FROM merged m JOIN node_t n USING (node_id)),
{_bm25_sql("es_", _CANDIDATES, "SELECT query_id, query_id AS scope, question FROM query_t")},
semantic AS (SELECT c.query_id, c.node_id, row_number() OVER (PARTITION BY c.query_id ORDER BY round(coalesce(score, 0), 9) DESC, mention) AS semantic_rank
             FROM cand c LEFT JOIN es_score s ON s.query_id = c.query_id AND s.item = c.node_id),
covering AS (SELECT *, {_COMPACT("text")} AS t, {_covered_sql("slots", _COMPACT("text"), _SHAPE)} AS cov
             FROM cand JOIN semantic USING (query_id, node_id) JOIN (SELECT * EXCLUDE doc_id FROM feat) USING (query_id)),
kinds AS (SELECT *, list_filter(cov, lambda s: s LIKE 'metric:%') <> [] AS m, list_contains(cov, 'numeric_shape') AS sh, list_filter(cov, lambda s: s LIKE 'year:%') <> [] AS y,
                 list_filter(cov, lambda s: s LIKE 'unit:%') <> [] AS u, len(cov)::DOUBLE / greatest(len(slots), 1) AS coverage_score FROM covering),
local AS (SELECT *, CASE
    WHEN numeric THEN CASE WHEN m AND sh THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN y AND u THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN {_COUNTED("t", lx.TABLE_TERMS)} >= 3 THEN 0.35::DOUBLE ELSE 0 END
         + CASE node_type WHEN 'table_row' THEN 0.35::DOUBLE WHEN 'table_block' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN {_section_sql("cq", "t")} THEN 0.25::DOUBLE ELSE 0 END
         - CASE WHEN {_COUNTED("t", lx.NARRATIVE_TERMS)} >= 2 THEN 0.35::DOUBLE ELSE 0 END
    WHEN cover THEN CASE WHEN page_index = 1 THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN {_any_sql("t", lx.COVER_TEXT)} THEN 0.3::DOUBLE ELSE 0 END ELSE 0 END AS loc FROM kinds),
scored AS (SELECT *, 1.0::DOUBLE / greatest(semantic_rank, 1) + {_share(0.25, "page_rank")} + {_share(0.25, "global_rank")} + {_share(0.4, "structured_rank")}
           + least(structured_score * 0.2::DOUBLE, 1.2::DOUBLE) + {_share(0.5, "cover_rank")} + coverage_score * 1.5::DOUBLE + len(cov) * 0.08::DOUBLE + loc
           + CASE WHEN numeric AND node_type = 'table_row' THEN 0.2::DOUBLE WHEN question_type IN ('risk_text', 'text') AND node_type = 'paragraph' THEN 0.15::DOUBLE ELSE 0 END AS combined FROM local),
pick0 AS (SELECT *, 0 AS picked, []::VARCHAR[] AS covered, len(slots) > 0 AS open FROM scored),
{_round_sql(1)}, {_round_sql(2)}, {_round_sql(3)},
chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN picked = 0 THEN 4 ELSE picked END, round(combined, 9) DESC, mention) AS rank FROM pick3 QUALIFY rank <= 5),
final AS (SELECT *, {_SOURCES_SQL} AS sources, rank <= least(3, count(*) OVER (PARTITION BY query_id)) AS in_set FROM chosen),
shown AS (SELECT *, list_sort(list_distinct(flatten(list(CASE WHEN in_set THEN cov ELSE [] END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)))) AS after FROM final)
SELECT query_id, rank, round(combined, 6) AS score, node_id, array_to_string(sources, '+') AS sources, array_to_string(cov, '|') AS slots, CAST(semantic_rank AS INTEGER) AS semantic_rank,
       CASE WHEN in_set THEN CAST(rank AS INTEGER) END AS evidence_set_rank, array_to_string(after, '|') AS covered,
       array_to_string(sources, '+') || '; coverage=' || len(cov) || '/' || len(slots) || '; slots=' || CASE WHEN len(cov) > 0 THEN array_to_string(list_sort(cov), ',') ELSE 'no_slot' END AS reason
FROM shown"""

OPTIONS = {"type": "evidence_set_region", "page_methods": ["bm25", "tfidf"], "page_top_k": 10, "region_method": "bm25", "global_region_top_k": 20, "search_scope": "document"}


def shown_evidence(hits: DataFrame) -> DataFrame:
    m = "metadata."
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "node_id",
        F.array_join(m + "candidate_sources", "+").alias("sources"), F.array_join(m + "coverage_slots", "|").alias("slots"),
        F.col(m + "semantic_rank").alias("semantic_rank"), F.col(m + "evidence_set_rank").alias("evidence_set_rank"),
        F.array_join(m + "covered_slots_after_selection", "|").alias("covered"), F.col(m + "selection_reason").alias("reason"),
    )


@_query(f"WITH {_REPORTS}, {_FEATURES} SELECT query_id, node_id, r AS structured_rank, round(structured_score, 6) AS structured_score FROM structured")
def report_structured_scan(spark, sf_dir):
    """Nodes of numeric questions by figures, units, years, sections and page context."""
    found = ev.structured_candidates(ev.question_features(report_queries(spark, sf_dir)), report_nodes(spark, sf_dir))
    return found.select("query_id", "node_id", F.col("structured_rank").cast("long").alias("structured_rank"), F.round("structured_score", 6).alias("structured_score"))


@_query(f"WITH {_REPORTS}, {_FEATURES} SELECT query_id, node_id, r AS cover_rank FROM cover")
def report_cover_anchors(spark, sf_dir):
    found = ev.cover_candidates(ev.question_features(report_queries(spark, sf_dir)), report_nodes(spark, sf_dir))
    return found.select("query_id", "node_id", F.col("cover_rank").cast("long").alias("cover_rank"))


@_query(f"WITH {_REPORTS}, {_MERGED} SELECT query_id, node_id, page_rank, global_rank, structured_rank, cover_rank, round(structured_score, 6) AS structured_score, mention FROM merged")
def report_candidates(spark, sf_dir):
    """Candidates from hit pages, document-wide nodes, the structured scan and covers, merged."""
    q, pages, nodes = report_queries(spark, sf_dir), report_pages(spark, sf_dir), report_nodes(spark, sf_dir)
    rule = join_rule(q, nodes)
    features, nodes = rule(ev.question_features(q)), rule(nodes)
    page_hits = rt.retrieve_hybrid_pages(q, pages, OPTIONS)
    global_hits = rt.retrieve_global_region(q, nodes, {**OPTIONS, "method": "bm25", "region_top_k": 20})
    merged = ev.merge_candidates(features, nodes, page_hits, global_hits, ev.structured_candidates(features, nodes), ev.cover_candidates(features, nodes))
    ranks = [F.col(c).cast("long").alias(c) for c in ("page_rank", "global_rank", "structured_rank", "cover_rank")]
    return merged.select("query_id", "node_id", *ranks, F.round("structured_score", 6).alias("structured_score"), F.col("ord").alias("mention"))


@_query(f"WITH {_REPORTS}, {EVIDENCE}")
def report_evidence_set(spark, sf_dir):
    return shown_evidence(rt.retrieve(report_queries(spark, sf_dir), report_pages(spark, sf_dir), report_nodes(spark, sf_dir), OPTIONS))


# -- sufficiency ----------------------------------------------------------------------


def _normal_sql(v: str) -> str:
    """Digits, point and sign of a number's text; parentheses mean a negative number."""
    bare = f"regexp_replace(regexp_replace(trim({v}), '^[()（）]+|[()（）]+$', '', 'g'), '[^0-9.-]', '', 'g')"
    negative = f"(trim({v}) LIKE '-%' OR trim({v}) LIKE '(%)' OR trim({v}) LIKE '（%）')"
    return f"CASE WHEN {negative} AND {bare} <> '' AND {bare} NOT LIKE '-%' THEN '-' || {bare} ELSE {bare} END"


_NUMBER, _HAS_UNIT, _UNIT = lx.ANSWER_NUMBER.removeprefix("(?U)"), lx.HAS_UNIT, lx.ANSWER_UNIT
_VALUE_OK = (
    f"(value <> '' AND len(list_filter([{_normal_sql('value')}, regexp_replace({_normal_sql('value')}, '^-', '')], lambda x: x <> '' AND (contains(regexp_replace(t, '[,\\s]', '', 'g'), x) "
    f"OR list_contains(list_transform(regexp_extract_all(t, '{_LIKE}'), lambda z: {_normal_sql('z')}), x)))) > 0)"
)
#: Needs query_t with answer, unit and raw, and ``top`` (query_id, rank, node_id, text, page_id).
_CHECKS = rf"""
ev AS (SELECT q.query_id, question, question_type, answer, unit AS given_unit, raw, evidence_node_ids AS gold, coalesce(list(node_id ORDER BY rank) FILTER (WHERE node_id IS NOT NULL), []) AS ids,
              coalesce(list(page_id ORDER BY rank) FILTER (WHERE page_id IS NOT NULL), []) AS pages, {_COMPACT("coalesce(string_agg(text, chr(10) ORDER BY rank), '')")} AS t
       FROM query_t q LEFT JOIN top USING (query_id) GROUP BY ALL),
asks AS (SELECT *, {_COMPACT("question")} AS cq, question_type IN ('numeric', 'comparison') AS numeric, CASE WHEN given_unit <> '' THEN given_unit ELSE regexp_extract(answer, '{_UNIT}') END AS unit,
                CASE WHEN raw <> '' THEN raw ELSE regexp_extract(answer, '{_NUMBER}') END AS value, list_distinct(regexp_extract_all(question, '20\d{{2}}')) AS years,
                {_slots_sql("question", "question_type", "given_unit")} AS slots FROM ev),
oks AS (SELECT *, {_asked_metric_sql("cq", "t")} AS metric_ok, len(list_filter(years, lambda y: contains(t, y))) > 0 AS year_ok, unit <> '' AND {_unit_sql("t", "unit")} AS unit_ok, {_VALUE_OK} AS value_ok,
               list_filter([CASE WHEN numeric AND {_any_sql("cq", [a for x in lx.METRICS.values() for a in x])} THEN 'metric' END, CASE WHEN numeric AND len(years) > 0 THEN 'year' END,
                            CASE WHEN numeric AND (given_unit <> '' OR regexp_matches(answer, '{_HAS_UNIT}')) THEN 'unit' END,
                            CASE WHEN raw <> '' OR regexp_matches(answer, '{_NUMBER}') THEN 'value' END], lambda x: x IS NOT NULL) AS required,
               {_covered_sql("slots", "t", _NUMBER)} AS by_slot, list_has_any(ids, gold) AS citation_ok FROM asks),
items AS (SELECT *, CASE WHEN len(required) > 0 THEN list_filter(required, lambda i: CASE i WHEN 'metric' THEN metric_ok WHEN 'year' THEN year_ok WHEN 'unit' THEN unit_ok ELSE value_ok END)
                         WHEN len(slots) = 0 AND len(ids) > 0 THEN ['evidence_present'] ELSE by_slot END AS covered,
                 CASE WHEN len(required) > 0 THEN list_filter(required, lambda i: NOT CASE i WHEN 'metric' THEN metric_ok WHEN 'year' THEN year_ok WHEN 'unit' THEN unit_ok ELSE value_ok END)
                      ELSE list_filter(slots, lambda s: NOT list_contains(by_slot, s)) END AS missing FROM oks),
ratios AS (SELECT *, CASE WHEN len(covered) + len(missing) > 0 THEN len(covered)::DOUBLE / (len(covered) + len(missing)) ELSE 0 END AS ratio FROM items),
verdict AS (SELECT *, CASE WHEN len(missing) = 0 AND citation_ok THEN 'sufficient' WHEN len(missing) = 0 THEN 'citation_mismatch' WHEN ratio >= 0.5 THEN 'partial' ELSE 'insufficient' END AS status FROM ratios)"""
_TOP_NODES = f"{_bm25_sql('eg_', _NODES, _IN_DOCUMENT)}, {_top_sql('eg_', 3)}, top AS (SELECT query_id, rank, n.node_id, n.text, n.page_id FROM eg_top JOIN node_t n ON n.node_id = item)"
_SHOWN_CASES = """SELECT query_id, status, array_to_string(covered, ';') AS covered_items, array_to_string(missing, ';') AS missing_items, metric_ok, year_ok, unit_ok, value_ok, citation_ok,
       round(ratio, 6) AS coverage_ratio, array_to_string(ids, ';') AS evidence_node_ids, array_to_string(pages, ';') AS evidence_pages FROM verdict"""


def _report_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = report_queries(spark, sf_dir)
    return sf.cases(q, rt.retrieve_nodes(q, report_nodes(spark, sf_dir), "bm25", 3, "document"), 3)


@_query(f"WITH {_REPORTS}, {_TOP_NODES}, {_CHECKS} {_SHOWN_CASES}")
def report_sufficiency(spark, sf_dir):
    """Metric, year, unit, value and citation of the first three nodes of every question."""
    found = _report_cases(spark, sf_dir)
    joined = [F.array_join(c, ";").alias(c) for c in ("covered_items", "missing_items", "evidence_node_ids", "evidence_pages")]
    return found.select("query_id", "status", *joined, "metric_ok", "year_ok", "unit_ok", "value_ok", "citation_ok", F.round("coverage_ratio", 6).alias("coverage_ratio"))


@_query(
    f"""WITH {_REPORTS}, {_TOP_NODES}, {_CHECKS} SELECT count(*) AS queries, round(avg((status = 'sufficient')::INT), 6) AS sufficiency_rate,
round(avg((status IN ('sufficient', 'partial'))::INT), 6) AS partial_or_sufficient_rate, round(avg((status = 'citation_mismatch')::INT), 6) AS citation_mismatch_rate,
round(avg(ratio), 4) AS avg_required_item_coverage, round(avg(citation_ok::INT), 6) AS "region_hit@3",
{", ".join(f"CAST(sum((status = '{s}')::INT) AS BIGINT) AS status_{s}" for s in sf.STATUSES)} FROM verdict"""
)
def report_sufficiency_rates(spark, sf_dir):
    """Mean coverage to four places: at six, shares of eighths end in a half that engines round differently."""
    found = sf.rates(_report_cases(spark, sf_dir), 3).drop("top_k")
    return _rounded(found.withColumn("avg_required_item_coverage", F.round("avg_required_item_coverage", 4)))


_LEVELS = [("question_type", "section", "status"), ("question_type", "section"), ("question_type", "status"), ("section",), ("status",), ()]
_SETS = ", ".join(f"({', '.join(x)})" for x in _LEVELS)


@_query(
    rf"""WITH {_REPORTS}, {_TOP_NODES}, {_CHECKS},
rows AS (SELECT question_type, regexp_extract(gold[1], '_p(\d+)_', 1) AS section, status, ratio FROM verdict),
sums AS (SELECT question_type, section, status, CAST(grouping(question_type, section, status) AS BIGINT) AS level, count(*) AS n, round(avg(ratio), 4) AS coverage
         FROM rows GROUP BY GROUPING SETS ({_SETS}))
SELECT question_type, section, status, level, n, round(n / sum(n) OVER (PARTITION BY level), 6) AS share, coverage FROM sums"""
)
def report_breakdowns(spark, sf_dir):
    """Questions by type, page of the report and verdict, in six sets of keys from one aggregation."""
    asked = report_queries(spark, sf_dir)
    gold = asked.select("query_id", "question_type", F.regexp_extract(F.col("evidence_node_ids")[0], r"_p(\d+)_", 1).alias("section"))
    rows = _report_cases(spark, sf_dir).select("query_id", "status", "coverage_ratio").join(by_shuffle(gold), "query_id")
    found = mt.breakdowns(rows, _LEVELS, coverage=F.round(F.avg("coverage_ratio"), 4))
    return found.withColumn("share", F.round("share", 6))


# -- the same rules over documents of the driver and over the demo -------------------------


@_query(f"WITH {_VIEWS}, {EVIDENCE}")
def evidence_set_region(spark, sf_dir):
    """Evidence sets of every benchmark question inside its gold document."""
    return shown_evidence(rt.retrieve(query_table(spark, sf_dir), page_table(spark, sf_dir), node_table(spark, sf_dir), OPTIONS))


_DEMO_NODES = [(f"{d}_p{p}_n{n}", d, f"{d}_p{p}", kind, text, n, p, k) for k, (d, p, n, kind, _, text) in enumerate(demo._NODES)]
_DEMO_PAGES = [(d, f"{d}_p{p}", p, text, k) for k, (d, p, text) in enumerate(demo._PAGES)]
_DEMO_QUERIES = [(q, d, question, answer, kind, ";".join(f"{d}_{p}" for p in pages), ";".join(f"{d}_{n}" for n in nodes)) for q, d, question, answer, kind, pages, nodes in demo._QUERIES]
DEMO = f"""
node_t AS (SELECT * FROM {_values(_DEMO_NODES, "node_id, doc_id, page_id, node_type, text, reading_order, page_index, ord")}),
page_t AS (SELECT * FROM {_values(_DEMO_PAGES, "doc_id, page_id, page_index, page_text, ord")}),
query_t AS (SELECT query_id, doc_id, question, answer, question_type, '' AS unit, '' AS raw, string_split(gp, ';') AS evidence_page_ids, string_split(gn, ';') AS evidence_node_ids
            FROM {_values(_DEMO_QUERIES, "query_id, doc_id, question, answer, question_type, gp, gn")})"""


@_fixed(f"WITH {DEMO}, {EVIDENCE}")
def evidence_set_demo(spark, sf_dir):
    t = demo.demo_tables(spark)
    return shown_evidence(rt.retrieve(t["queries"], t["pages"], t["nodes"], OPTIONS))


_GOLD_TOP = (
    f"{_bm25_sql('o_', _GOLD_NODES, 'SELECT query_id, query_id AS scope, question FROM query_t')}, {_top_sql('o_', 3)}, "
    "top AS (SELECT query_id, rank, n.node_id, n.text, n.page_id FROM o_top JOIN node_t n ON n.node_id = item)"
)


@_fixed(f"WITH {DEMO}, {_GOLD_TOP}, {_CHECKS} {_SHOWN_CASES}")
def sufficiency_demo(spark, sf_dir):
    t = demo.demo_tables(spark)
    found = sf.cases(t["queries"], rt.retrieve(t["queries"], t["pages"], t["nodes"], {"type": "oracle_page_region", "method": "bm25", "top_k": 3}), 3)
    joined = [F.array_join(c, ";").alias(c) for c in ("covered_items", "missing_items", "evidence_node_ids", "evidence_pages")]
    return found.select("query_id", "status", *joined, "metric_ok", "year_ok", "unit_ok", "value_ok", "citation_ok", F.round("coverage_ratio", 6).alias("coverage_ratio"))


@_fixed(f"WITH {DEMO} SELECT node_id, doc_id, page_id, node_type, text, CAST(reading_order AS INTEGER) AS reading_order, page_text, len(evidence_node_ids) AS gold_nodes FROM node_t JOIN page_t USING (doc_id, page_id, page_index) JOIN (SELECT evidence_node_ids, doc_id, unnest(evidence_page_ids) AS page_id FROM query_t) USING (doc_id, page_id)")
def demo_dataset(spark, sf_dir):
    """Nodes of the demo with their page and the number of gold nodes of the question about the page."""
    t = demo.demo_tables(spark)
    asked = t["queries"].select("doc_id", F.explode("evidence_page_ids").alias("page_id"), F.size("evidence_node_ids").cast("long").alias("gold_nodes"))
    pages = t["pages"].select("doc_id", "page_id", "page_text")
    return t["nodes"].join(pages, ["doc_id", "page_id"]).join(asked, ["doc_id", "page_id"]).select("node_id", "doc_id", "page_id", "node_type", "text", "reading_order", "page_text", "gold_nodes")
