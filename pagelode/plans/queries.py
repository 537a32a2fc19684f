"""Queries over the driver's tables, one per operator, and their DuckDB SQL.

Derived relations: a line of ``documents`` is an evidence node, five lines are a page,
an item of ``benchmark`` is a question whose gold nodes are the lines that equal one of
its own (20 characters or more) in the first document that has any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import corpus
from ..operators import metrics as mt
from ..operators import retrieval as rt
from ..operators import scoring as sc
from ..operators import sufficiency as sf
from ..operators.index import TextIndex
from ..schemas import QUERIES as QUERY_SCHEMA
from ..sources import prepare as pp
from ..store import materialize

LINES_PER_PAGE = 5


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- derived relations -----------------------------------------------------------


def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NODES of all lines of documents."""
    doc = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    lines = _read(spark, sf_dir, "documents").select(doc.alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"), F.col("doc_id").alias("no"))
    page = F.floor(F.col("pos") / LINES_PER_PAGE).cast("int") + 1
    page_id = F.concat("doc_id", F.lit("_p"), F.lpad(page.cast("string"), 8, "0"))
    return lines.select(
        F.concat(page_id, F.lit("_n"), F.lpad((F.col("pos") + 1).cast("string"), 8, "0")).alias("node_id"),
        "doc_id",
        page_id.alias("page_id"),
        F.when(tx.is_table_block(F.col("text")), "table_block").otherwise("paragraph").alias("node_type"),
        "text",
        (F.col("pos") + 1).alias("reading_order"),
        F.create_map(F.lit("page_index"), page.cast("string")).alias("metadata"),
        (F.col("no") * 100_000_000 + F.col("pos") + 1).cast("long").alias("ord"),
    )


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAGES of five lines; slices of each document's lines, so nothing is shuffled."""
    doc = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    lines = F.split("text", "\n")
    starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(LINES_PER_PAGE))
    cut = _read(spark, sf_dir, "documents").select(doc.alias("doc_id"), F.col("doc_id").alias("no"), lines.alias("lines"), F.posexplode(starts).alias("k", "at"))
    page_id = F.concat("doc_id", F.lit("_p"), F.lpad((F.col("k") + 1).cast("string"), 8, "0"))
    return cut.select(
        "doc_id",
        page_id.alias("page_id"),
        (F.col("k") + 1).alias("page_index"),
        F.array_join(F.slice("lines", F.col("at") + 1, F.lit(LINES_PER_PAGE)), "\n").alias("page_text"),
        F.lit("").alias("ocr_text"),
        (F.col("no") * 100_000_000 + F.col("k") + 1).cast("long").alias("ord"),
    )


def query_table(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None) -> DataFrame:
    """QUERIES of all benchmark items, written once (a query reads them several times)."""
    nodes = node_table(spark, sf_dir) if nodes is None else nodes
    items = _read(spark, sf_dir, "benchmark").select(F.lpad(F.col("item_id").cast("string"), 12, "0").alias("query_id"), F.col("text").alias("question"))
    lines = items.select("query_id", F.explode(F.array_distinct(F.split("question", "\n"))).alias("text")).where(F.length("text") >= 20)
    # a line's first document comes before its matches, so copies of a common line are never joined with all its questions
    places = nodes.select("text", "doc_id", "page_id", "node_id")
    holders = places.join(lines.select("text").distinct(), "text", "left_semi").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    first = materialize(lines.join(holders, "text").groupBy("query_id").agg(F.min("doc_id").alias("doc_id")), "first")
    gold = lines.join(first, "query_id").join(places, ["text", "doc_id"]).groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_set("page_id")).alias("p"), F.sort_array(F.collect_set("node_id")).alias("n"))
    none = F.array().cast("array<string>")
    out = items.join(gold, "query_id", "left").select(
        "query_id",
        F.lit("benchmark").alias("dataset"),
        F.coalesce("doc_id", F.lit("")).alias("doc_id"),
        "question",
        F.lit("").alias("answer"),
        F.lit("text").alias("question_type"),
        F.coalesce("p", none).alias("evidence_page_ids"),
        F.coalesce("n", none).alias("evidence_node_ids"),
        F.array().cast("array<array<double>>").alias("evidence_bboxes"),
        F.col("n").isNotNull().alias("is_answerable"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
    assert out.columns == QUERY_SCHEMA.names
    return materialize(out, "queries")


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "doc_id", "page_id", "node_id", "retriever")


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: The same over fixed rows: what tests hold against DuckDB, beside queries over given tables.
FIXED: dict[str, tuple[Query, str]] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _fixed(sql: str):
    def add(f: Query) -> Query:
        FIXED[f.__name__] = (f, sql)
        return f

    return add


def _tokens(t: str) -> str:
    """DuckDB expression of the tokenizer on a column."""
    found = rf"regexp_extract_all(lower({t}), '([a-z0-9_]+|[\x{{4e00}}-\x{{9fff}}])', 1)"
    bare = rf"trim({t}, E' \n\r\t\v\f')"
    return f"CASE WHEN {bare} = '' THEN [] WHEN len({found}) = 0 THEN [lower({bare})] ELSE {found} END"


_VIEWS = rf"""
raw_lines AS (SELECT doc_id AS no, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS doc_id, unnest(string_split(text, chr(10))) AS text,
                     generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
node_t AS (SELECT doc_id || '_p' || lpad(CAST((line - 1) // 5 + 1 AS VARCHAR), 8, '0') || '_n' || lpad(CAST(line AS VARCHAR), 8, '0') AS node_id, doc_id,
                  doc_id || '_p' || lpad(CAST((line - 1) // 5 + 1 AS VARCHAR), 8, '0') AS page_id,
                  CASE WHEN len(regexp_extract_all(text, '\(?-?\d[\d,]*(?:\.\d+)?\)?')) >= 3 OR regexp_matches(text, '{"|".join(lx.FINANCIAL)}') THEN 'table_block' ELSE 'paragraph' END AS node_type,
                  text, CAST(line AS INTEGER) AS reading_order, CAST((line - 1) // 5 + 1 AS INTEGER) AS page_index, CAST(no * 100000000 + line AS BIGINT) AS ord FROM raw_lines),
page_t AS (SELECT doc_id, page_id, any_value(page_index) AS page_index, string_agg(text, chr(10) ORDER BY ord) AS page_text,
                  CAST(any_value(CAST(doc_id AS BIGINT)) * 100000000 + any_value(page_index) AS BIGINT) AS ord FROM node_t GROUP BY doc_id, page_id),
item_t AS (SELECT lpad(CAST(item_id AS VARCHAR), 12, '0') AS query_id, text AS question FROM benchmark),
item_line AS (SELECT DISTINCT query_id, unnest(string_split(question, chr(10))) AS text FROM item_t),
gold_hit AS (SELECT query_id, doc_id, page_id, node_id FROM item_line JOIN node_t USING (text) WHERE length(text) >= 20),
gold AS (SELECT query_id, doc_id, list_sort(list_distinct(list(page_id))) AS p, list_sort(list_distinct(list(node_id))) AS n FROM gold_hit
         WHERE (query_id, doc_id) IN (SELECT query_id, min(doc_id) FROM gold_hit GROUP BY query_id) GROUP BY query_id, doc_id),
query_t AS (SELECT query_id, coalesce(doc_id, '') AS doc_id, question, 'text' AS question_type, '' AS unit, '' AS answer, '' AS raw, coalesce(p, []) AS evidence_page_ids, coalesce(n, []) AS evidence_node_ids FROM item_t LEFT JOIN gold USING (query_id))
"""
_PAGE_ITEMS = "SELECT {scope} AS scope, page_id AS item, ord, doc_id, page_id, CAST(NULL AS VARCHAR) AS node_id, CASE WHEN page_text = '' THEN page_id ELSE page_text END AS body FROM page_t"
_NODE_ITEMS = "SELECT {scope} AS scope, node_id AS item, ord, doc_id, page_id, node_id, CASE WHEN text = '' THEN node_id ELSE text END AS body FROM node_t"
_ASKED = "SELECT query_id, {scope} AS scope, question FROM query_t"


def _bm25_sql(p: str, items: str, asked: str) -> str:
    """CTEs {p}score (query_id, item, ord, score > 0) by BM25 over items (scope, item, ord, body)."""
    return f"""
{p}i AS ({items}), {p}q AS ({asked}),
{p}tok AS (SELECT scope, item, ord, {_tokens("body")} AS toks FROM {p}i),
{p}stat AS (SELECT scope, count(*) AS n, sum(len(toks)) / count(*) AS mean FROM {p}tok GROUP BY scope),
{p}tf AS (SELECT scope, item, ord, size, tok, count(*) AS tf FROM (SELECT scope, item, ord, len(toks) AS size, unnest(toks) AS tok FROM {p}tok) GROUP BY ALL),
{p}df AS (SELECT scope, tok, count(*) AS df FROM {p}tf GROUP BY ALL),
{p}qt AS (SELECT query_id, scope, tok, count(*) AS qtf FROM (SELECT query_id, scope, unnest({_tokens("question")}) AS tok FROM {p}q) GROUP BY ALL),
{p}score AS (SELECT query_id, item, ord, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE
                    / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / greatest(mean, 1e-9::DOUBLE)))) AS score
             FROM {p}qt JOIN {p}tf USING (scope, tok) JOIN {p}df USING (scope, tok) JOIN {p}stat USING (scope) GROUP BY ALL)"""


def _tfidf_sql(p: str, items: str, asked: str) -> str:
    return f"""
{p}i AS ({items}), {p}q AS ({asked}),
{p}tok AS (SELECT scope, item, ord, {_tokens("body")} AS toks FROM {p}i),
{p}stat AS (SELECT scope, count(*) AS n FROM {p}tok GROUP BY scope),
{p}tf AS (SELECT scope, item, ord, size, tok, count(*) AS tf FROM (SELECT scope, item, ord, len(toks) AS size, unnest(toks) AS tok FROM {p}tok) GROUP BY ALL),
{p}df AS (SELECT scope, tok, count(*) AS df FROM {p}tf GROUP BY ALL),
{p}v AS (SELECT scope, item, ord, tok, tf / size * (ln((n + 1)::DOUBLE / (df + 1)) + 1) AS w FROM {p}tf JOIN {p}df USING (scope, tok) JOIN {p}stat USING (scope)),
{p}qt AS (SELECT query_id, scope, tok, count(*) AS qtf FROM (SELECT query_id, scope, unnest({_tokens("question")}) AS tok FROM {p}q) GROUP BY ALL),
{p}qv AS (SELECT query_id, scope, tok, qtf / sum(qtf) OVER (PARTITION BY query_id, scope) * (ln((n + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1) AS qw
          FROM {p}qt JOIN {p}stat USING (scope) LEFT JOIN {p}df USING (scope, tok)),
{p}norm AS (SELECT scope, item, sqrt(sum(w * w)) AS norm FROM {p}v GROUP BY ALL), {p}qnorm AS (SELECT query_id, scope, sqrt(sum(qw * qw)) AS qnorm FROM {p}qv GROUP BY ALL),
{p}score AS (SELECT query_id, item, ord, dot / (norm * qnorm) AS score FROM
             (SELECT query_id, scope, item, ord, sum(w * qw) AS dot FROM {p}v JOIN {p}qv USING (scope, tok) GROUP BY ALL) JOIN {p}norm USING (scope, item) JOIN {p}qnorm USING (query_id, scope))"""


def _top_sql(p: str, k: int) -> str:
    """CTE {p}top (query_id, item, score, rank): the best k with zeros filled in."""
    return f"""
{p}first AS (SELECT scope, item, ord FROM {p}i QUALIFY row_number() OVER (PARTITION BY scope ORDER BY ord) <= {k}),
{p}all AS (SELECT query_id, item, ord, score FROM {p}score UNION ALL
           SELECT query_id, item, ord, 0.0::DOUBLE FROM {p}q JOIN {p}first USING (scope) WHERE (query_id, item) NOT IN (SELECT (query_id, item) FROM {p}score)),
{p}top AS (SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM {p}all QUALIFY rank <= {k})"""


def _hits_sql(p: str, label: str, top: str | None = None) -> str:
    return (
        f"SELECT query_id, rank, round(score, 6) AS score, s.doc_id, s.page_id, s.node_id, '{label}' AS retriever FROM {top or p + 'top'} "
        f"JOIN (SELECT DISTINCT item, doc_id, page_id, node_id FROM {p}i) s USING (item)"
    )


_CORPUS_PAGES = (_PAGE_ITEMS.format(scope="''"), _ASKED.format(scope="''"))
_DOCUMENT_PAGES = (_PAGE_ITEMS.format(scope="doc_id"), _ASKED.format(scope="doc_id"))
_CORPUS_NODES = (_NODE_ITEMS.format(scope="''"), _ASKED.format(scope="''"))


@_query(f"WITH {_VIEWS} SELECT node_id, doc_id, page_id, node_type, text, reading_order, ord FROM node_t")
def nodes_view(spark, sf_dir):
    return node_table(spark, sf_dir).select("node_id", "doc_id", "page_id", "node_type", "text", "reading_order", "ord")


@_query(f"WITH {_VIEWS} SELECT doc_id, page_id, page_index, page_text, ord FROM page_t")
def pages_view(spark, sf_dir):
    return page_table(spark, sf_dir).select("doc_id", "page_id", "page_index", "page_text", "ord")


@_query(f"WITH {_VIEWS} SELECT query_id, doc_id, question, array_to_string(evidence_page_ids, ';') AS gold_pages, array_to_string(evidence_node_ids, ';') AS gold_nodes FROM query_t")
def queries_view(spark, sf_dir):
    return query_table(spark, sf_dir).select("query_id", "doc_id", "question", F.array_join("evidence_page_ids", ";").alias("gold_pages"), F.array_join("evidence_node_ids", ";").alias("gold_nodes"))


def _corpus_pages(spark, sf_dir):
    return rt.page_items(page_table(spark, sf_dir)).withColumn("scope", F.lit(""))


@_query(f"WITH {_VIEWS}, {_bm25_sql('b_', *_CORPUS_PAGES)} SELECT item AS page_id, tok AS token, tf, CAST(size AS INTEGER) AS size FROM b_tf")
def tokenize_tf(spark, sf_dir):
    return sc.row_counts(sc.tokenized(_corpus_pages(spark, sf_dir))).select(F.col("item").alias("page_id"), "token", "tf", "size")


@_query(f"WITH {_VIEWS}, {_bm25_sql('b_', *_CORPUS_PAGES)} SELECT tok AS token, df FROM b_df")
def doc_freq(spark, sf_dir):
    return sc.document_frequency(sc.tokenized(_corpus_pages(spark, sf_dir)))


@_query(f"WITH {_VIEWS}, {_bm25_sql('b_', *_CORPUS_PAGES)}, {_top_sql('b_', 10)} {_hits_sql('b_', 'bm25')}")
def bm25_page_corpus(spark, sf_dir):
    return _shown(rt.retrieve_pages(query_table(spark, sf_dir), page_table(spark, sf_dir), "bm25", 10))


@_query(f"WITH {_VIEWS}, {_bm25_sql('b_', *_DOCUMENT_PAGES)}, {_top_sql('b_', 10)} {_hits_sql('b_', 'bm25')}")
def bm25_page_document(spark, sf_dir):
    return _shown(rt.retrieve_pages(query_table(spark, sf_dir), page_table(spark, sf_dir), "bm25", 10, "document"))


@_query(f"WITH {_VIEWS}, {_tfidf_sql('t_', *_CORPUS_PAGES)}, {_top_sql('t_', 10)} {_hits_sql('t_', 'tfidf')}")
def tfidf_page(spark, sf_dir):
    return _shown(rt.retrieve_pages(query_table(spark, sf_dir), page_table(spark, sf_dir), "tfidf", 10))


@_query(f"WITH {_VIEWS}, {_tfidf_sql('t_', *_DOCUMENT_PAGES)}, {_top_sql('t_', 5)} {_hits_sql('t_', 'dense:tfidf_fallback')}")
def dense_page_fallback(spark, sf_dir):
    return _shown(rt.retrieve(query_table(spark, sf_dir), page_table(spark, sf_dir), node_table(spark, sf_dir), {"type": "dense_page", "top_k": [1, 5], "search_scope": "doc"}))


_HYBRID = f"""{_bm25_sql('b_', *_CORPUS_PAGES)}, {_top_sql('b_', 20)}, {_tfidf_sql('t_', *_CORPUS_PAGES)}, {_top_sql('t_', 20)},
fused AS (SELECT query_id, item, sum(1.0::DOUBLE / (60 + rank)) AS score, min(m * 1000 + rank) AS first
          FROM (SELECT 0 AS m, query_id, item, rank FROM b_top UNION ALL SELECT 1, query_id, item, rank FROM t_top) GROUP BY ALL),
h_top AS (SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS rank FROM fused QUALIFY rank <= 10)"""


@_query(f"WITH {_VIEWS}, {_HYBRID} SELECT query_id, item, round(score, 6) AS score, first FROM fused")
def rrf_fusion(spark, sf_dir):
    q, items = query_table(spark, sf_dir), rt.page_items(page_table(spark, sf_dir))
    index = TextIndex.build(items)
    both = sc.fused([rt.search(q, items, m, 20, index=index)[0] for m in ("bm25", "tfidf")])
    return both.select("query_id", "item", F.round("score", 6).alias("score"), (F.col("first.method") * 1000 + F.col("first.rank")).cast("long").alias("first"))


@_query(f"WITH {_VIEWS}, {_HYBRID} {_hits_sql('b_', 'hybrid_page', 'h_top')}")
def hybrid_page(spark, sf_dir):
    return _shown(rt.retrieve(query_table(spark, sf_dir), page_table(spark, sf_dir), node_table(spark, sf_dir), {"type": "hybrid_page", "page_methods": ["bm25", "tfidf"], "page_top_k": 10}))


@_query(f"WITH {_VIEWS}, {_tfidf_sql('t_', *_CORPUS_NODES)}, {_top_sql('t_', 10)} {_hits_sql('t_', 'dense:tfidf_fallback')}")
def layout_node(spark, sf_dir):
    return _shown(rt.retrieve(query_table(spark, sf_dir), page_table(spark, sf_dir), node_table(spark, sf_dir), {"type": "layout_node", "top_k": 10, "node_types": ["paragraph", "table_block"]}))


@_query(f"WITH {_VIEWS}, {_bm25_sql('b_', *_CORPUS_NODES)}, {_top_sql('b_', 5)} {_hits_sql('b_', 'global_region')}")
def global_region(spark, sf_dir):
    return _shown(rt.retrieve(query_table(spark, sf_dir), page_table(spark, sf_dir), node_table(spark, sf_dir), {"type": "global_region", "method": "bm25", "region_top_k": 5}))


def _region_sql(pages: str, label: str) -> str:
    """Candidate nodes of page hits {pages} (query_id, page_id, rank), ranked in their own set and fused."""
    candidates = f"SELECT query_id AS scope, node_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY rank, n.ord) AS ord, n.doc_id, n.page_id, n.node_id, CASE WHEN text = '' THEN node_id ELSE text END AS body, rank AS page_rank FROM {pages} JOIN node_t n USING (page_id)"
    return f"""{_bm25_sql('r_', candidates, _ASKED.format(scope="query_id"))},
r_rank AS (SELECT scope AS query_id, r_i.item, page_rank, row_number() OVER (PARTITION BY scope ORDER BY round(coalesce(score, 0), 9) DESC, r_i.ord) AS node_rank
           FROM r_i LEFT JOIN r_score ON r_score.query_id = r_i.scope AND r_score.item = r_i.item),
r_top AS (SELECT query_id, item, 1.0::DOUBLE / (60 + node_rank) + 1.0::DOUBLE / (60 + page_rank) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0::DOUBLE / (60 + node_rank) + 1.0::DOUBLE / (60 + page_rank), 12) DESC, node_rank) AS rank
          FROM r_rank QUALIFY rank <= 5)
{_hits_sql('r_', label)}"""


@_query(f"WITH {_VIEWS}, {_bm25_sql('b_', *_CORPUS_PAGES)}, {_top_sql('b_', 10)}, pg AS (SELECT query_id, item AS page_id, rank FROM b_top), {_region_sql('pg', 'page_region')}")
def page_region(spark, sf_dir):
    return _shown(rt.retrieve(query_table(spark, sf_dir), page_table(spark, sf_dir), node_table(spark, sf_dir), {"type": "page_region", "page_retriever": "bm25_page", "region_method": "bm25_node"}))


@_query(f"WITH {_VIEWS}, {_HYBRID}, pg AS (SELECT query_id, item AS page_id, rank FROM h_top), {_region_sql('pg', 'hybrid_page_region')}")
def hybrid_page_region(spark, sf_dir):
    options = {"type": "hybrid_page_region", "page_methods": ["bm25", "tfidf"], "page_top_k": 10, "region_method": "bm25"}
    return _shown(rt.retrieve(query_table(spark, sf_dir), page_table(spark, sf_dir), node_table(spark, sf_dir), options))


_GOLD_NODES = "SELECT query_id AS scope, node_id AS item, n.ord, n.doc_id, n.page_id, n.node_id, CASE WHEN text = '' THEN node_id ELSE text END AS body FROM (SELECT query_id, unnest(evidence_page_ids) AS page_id FROM query_t) JOIN node_t n USING (page_id)"


@_query(f"WITH {_VIEWS}, {_bm25_sql('o_', _GOLD_NODES, _ASKED.format(scope='query_id'))}, {_top_sql('o_', 5)} {_hits_sql('o_', 'oracle_page_region')}")
def oracle_page_region(spark, sf_dir):
    return _shown(rt.retrieve(query_table(spark, sf_dir), page_table(spark, sf_dir), node_table(spark, sf_dir), {"type": "oracle_page_region", "method": "bm25", "region_top_k": 5}))


def _metrics_sql(top: str) -> str:
    """One row of the seven metrics of hits {top} (query_id, rank, page_id, node_id)."""
    ideal = lambda n, k: " + ".join(f"CASE WHEN {n} >= {i} THEN 1 / log2({i + 1}) ELSE 0 END" for i in range(1, k + 1))
    size = lambda k: f"(CASE WHEN nodes{k} AND nn > 0 THEN nn ELSE np END)"
    ndcg = lambda k: f"CASE WHEN ({ideal(size(k), k)}) > 0 THEN dcg{k} / ({ideal(size(k), k)}) ELSE 0 END"
    return f"""
hit AS (SELECT q.query_id, len(evidence_page_ids) AS np, len(evidence_node_ids) AS nn, rank, node_id,
               coalesce(list_contains(evidence_page_ids, page_id), false) AS pm, coalesce(list_contains(evidence_node_ids, node_id), false) AS nm FROM query_t q LEFT JOIN {top} h USING (query_id)),
mark AS (SELECT *, CASE WHEN node_id IS NOT NULL AND nn > 0 THEN nm ELSE pm END AS m FROM hit),
per AS (SELECT query_id, any_value(np) AS np, any_value(nn) AS nn, max((pm AND rank <= 1)::INT) AS p1, max((pm AND rank <= 5)::INT) AS p5, max((pm AND rank <= 10)::INT) AS p10,
               min(rank) FILTER (WHERE m) AS f, coalesce(max((nm AND rank <= 5)::INT), 0) AS r5, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE m AND rank <= 5), 0) AS dcg5,
               coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE m AND rank <= 10), 0) AS dcg10, coalesce(bool_or(node_id IS NOT NULL AND rank <= 5), false) AS nodes5,
               coalesce(bool_or(node_id IS NOT NULL AND rank <= 10), false) AS nodes10 FROM mark GROUP BY query_id)
SELECT round(coalesce(avg(coalesce(p1, 0)) FILTER (WHERE np > 0), 0)::DOUBLE, 6) AS "page_recall@1", round(coalesce(avg(coalesce(p5, 0)) FILTER (WHERE np > 0), 0)::DOUBLE, 6) AS "page_recall@5",
       round(coalesce(avg(coalesce(p10, 0)) FILTER (WHERE np > 0), 0)::DOUBLE, 6) AS "page_recall@10", round(coalesce(avg(coalesce(1 / f, 0)) FILTER (WHERE np > 0 OR nn > 0), 0)::DOUBLE, 6) AS mrr,
       round(coalesce(avg({ndcg(5)}) FILTER (WHERE np > 0 OR nn > 0), 0)::DOUBLE, 6) AS "ndcg@5", round(coalesce(avg({ndcg(10)}) FILTER (WHERE np > 0 OR nn > 0), 0)::DOUBLE, 6) AS "ndcg@10",
       round(coalesce(avg(r5) FILTER (WHERE nn > 0), 0)::DOUBLE, 6) AS "region_hit@5" FROM per"""


_NODE_TOP = f"{_bm25_sql('b_', *_CORPUS_NODES)}, {_top_sql('b_', 10)}, top AS (SELECT query_id, rank, page_id, node_id FROM b_top JOIN b_i USING (item))"
_PAGE_TOP = f"{_bm25_sql('b_', *_CORPUS_PAGES)}, {_top_sql('b_', 10)}, top AS (SELECT query_id, rank, page_id, node_id FROM b_top JOIN b_i USING (item))"


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places: sums may differ in their last digits with the order of their terms."""
    return df.select(*(F.round(f"`{c}`", 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


@_query(f"WITH {_VIEWS}, {_PAGE_TOP}, {_metrics_sql('top')}")
def metrics_pages(spark, sf_dir):
    q = query_table(spark, sf_dir)
    return _rounded(mt.evaluate(q, rt.retrieve_pages(q, page_table(spark, sf_dir), "bm25", 10)))


@_query(f"WITH {_VIEWS}, {_NODE_TOP}, {_metrics_sql('top')}")
def metrics_nodes(spark, sf_dir):
    q = query_table(spark, sf_dir)
    return _rounded(mt.evaluate(q, rt.retrieve_nodes(q, node_table(spark, sf_dir), "bm25", 10)))


_ERRORS = """
e AS (SELECT query_id, question, evidence_page_ids AS gp, evidence_node_ids AS gn, coalesce(list(page_id ORDER BY rank) FILTER (WHERE rank <= 5), []) AS pp,
             coalesce(list(node_id ORDER BY rank) FILTER (WHERE rank <= 5 AND node_id IS NOT NULL), []) AS pn FROM query_t LEFT JOIN top USING (query_id) GROUP BY ALL),
errors AS (SELECT query_id, question, coalesce(array_to_string(gp, ';'), '') AS gold_pages, coalesce(array_to_string(pp, ';'), '') AS pred_pages_top5,
                  coalesce(array_to_string(gn, ';'), '') AS gold_nodes, coalesce(array_to_string(pn, ';'), '') AS pred_nodes_top5,
                  list_has_any(gp, pp) AS page_ok, len(gn) = 0 OR list_has_any(gn, pn) AS region_ok FROM e)"""


@_query(f"WITH {_VIEWS}, {_NODE_TOP}, {_ERRORS} SELECT * FROM errors WHERE NOT (page_ok AND region_ok)")
def errors_top5(spark, sf_dir):
    q = query_table(spark, sf_dir)
    return mt.error_rows(q, rt.retrieve_nodes(q, node_table(spark, sf_dir), "bm25", 10))


@_query(f"WITH {_VIEWS}, {_NODE_TOP}, {_ERRORS} SELECT page_ok, region_ok, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM errors WHERE NOT (page_ok AND region_ok) GROUP BY ALL")
def error_breakdown(spark, sf_dir):
    return mt.breakdown(errors_top5(spark, sf_dir), "page_ok", "region_ok")


@_query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0)
SELECT query_id, vec_id, round(list_sum(list_transform(range(1, len(qv) + 1), lambda i: qv[i]::DOUBLE * embedding[i]::DOUBLE)), 6) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY round(list_sum(list_transform(range(1, len(qv) + 1), lambda i: qv[i]::DOUBLE * embedding[i]::DOUBLE)), 9) DESC, vec_id) AS rank
FROM q, embeddings QUALIFY rank <= 10""")
def dense_cosine_topk(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all vectors."""
    vectors = _read(spark, sf_dir, "embeddings")
    items = vectors.select(F.lit("").alias("scope"), F.col("vec_id").alias("item"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    asked = vectors.where("vec_id % 20 = 0").select(F.lit("").alias("scope"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    best = sc.ranked(corpus.search(asked, items, "dense", 10), 10)
    return best.select("query_id", F.col("item").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# -- text rules over fixed texts ---------------------------------------------------

# Questions (id, question, type, annotated unit).
_QUESTIONS = [
    ("a", "示例科技2025年营业收入是多少？", "numeric", "亿元"),
    ("b", "2025年营业收入是多少？", "numeric", "元"),
    ("c", "这份年度报告对应的报告年度是哪一年？", "fact", ""),
    ("d", "2024年度研发投入或研发费用是多少万元？占比%是多少？", "comparison", ""),
    ("e", "合同服务期限是什么？", "fact", ""),
    ("f", "公司2023年和2024年总资产 Alpha Beta growth 比较", "text", ""),
    ("g", "", "text", ""),
]
# Texts of tables, narratives, numbers and plain words.
_TEXTS = [
    (1, "营业收入 233,432,768,960.43 343,176,440,712.96 -31.98%"),
    (2, "营业收入为人民币 2,334 亿元，管理层确认收入时点存在审计风险"),
    (3, "单位：元 项目 2025 年 2024 年 本年比上年增减 2023 年"),
    (4, "单位：元 营业收入 100"),
    (5, "营业收入 100 亿元"),
    (6, "经营活动产生的现金流量净额(98,812.49)万元"),
    (7, "plain words without numbers"),
    (8, ""),
    (9, "研发投入 2.1 亿元；研发人员 12 人"),
]
_NUMBERS = ["(98,812.49)", "（12.5）", "-31.98%", "233,432,768,960.43", "12.8亿元", " 7 ", "", "--5", "+3.0", "（-4）"]


def _values(rows, names: str) -> str:
    cell = lambda v: str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS v({names})"


def _any_sql(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


def _slots_sql(q: str, kind: str, unit: str) -> str:
    """List of target slots in code-point order."""
    metrics = ", ".join(f"CASE WHEN {_any_sql(q, a)} THEN 'metric:{m}' END" for m, a in lx.METRICS.items())
    names = ", ".join(f"CASE WHEN {_any_sql(q, a)} THEN '{m}' END" for m, a in lx.METRICS.items())
    units = []
    for u in lx.UNITS:
        longer = [v for v in lx.UNITS if v != u and u in v]
        units.append(f"CASE WHEN contains({q}, '{u}') AND NOT contains({unit}, '{u}')" + (f" AND NOT {_any_sql(q, longer)}" if longer else "") + f" THEN 'unit:{u}' END")
    stop = ", ".join(f"'{w}'" for w in lx.STOP_WORDS)
    runs = rf"regexp_extract_all(regexp_replace({q}, '20\d{{2}}\s*年?度?', ' ', 'g'), '[\x{{4e00}}-\x{{9fff}}A-Za-z%]{{2,}}')"
    kept = f"list_filter({runs}, lambda r: r NOT IN ({stop}) AND NOT {_any_sql('r', lx.STOP_PARTS)} AND length(r) <= 12)"
    words = f"list_sort(list_distinct(list_concat(list_filter([{names}], lambda x: x IS NOT NULL), {kept})))[1:6]"
    parts = [
        f"list_filter([{metrics}, {', '.join(units)}, CASE WHEN {unit} <> '' THEN 'unit:' || {unit} END, CASE WHEN {kind} IN ('numeric', 'comparison') OR {_any_sql(q, lx.NUMERIC_CLUES)} THEN 'numeric_shape' END], lambda x: x IS NOT NULL)",
        rf"list_transform(regexp_extract_all({q}, '20\d{{2}}'), lambda y: 'year:' || y)",
        f"list_transform({words}, lambda w: 'keyword:' || w)",
    ]
    return f"list_sort(list_distinct(list_concat({parts[0]}, list_concat({parts[1]}, {parts[2]}))))"


@_fixed(f"SELECT id, array_to_string({_slots_sql('q', 'kind', 'unit')}, '|') AS slots FROM {_values(_QUESTIONS, 'id, q, kind, unit')}")
def question_slots(spark, sf_dir):
    df = spark.createDataFrame(_QUESTIONS, "id string, q string, kind string, unit string")
    return df.select("id", F.array_join(tx.target_slots(F.col("q"), F.col("kind"), F.col("unit")), "|").alias("slots"))


_SHAPE = r"[(（]\s*[-+]?\d[\d,]*(?:\.\d+)?\s*[)）]|[-+]?\d[\d,]*(?:\.\d+)?\s*%|[-+]?\d[\d,]*(?:\.\d+)?\s*(?:元|万元|亿元|百分点)|\d{1,3}(?:,\d{3})+(?:\.\d+)?|[-+]?\d+\.\d+"
_COUNT = lambda terms: "(" + " + ".join(f"contains(t, '{x}')::INT" for x in terms) + ")"


@_fixed(
    rf"""WITH c AS (SELECT id, regexp_replace(txt, '\s+', '', 'g') AS t, txt FROM {_values(_TEXTS, 'id, txt')})
SELECT id, t AS compact, regexp_matches(t, '(^|[^万亿])元') AS has_yuan, contains(t, '亿元') AS has_yi, regexp_matches(t, '{_SHAPE}') AS numeric_shape,
       CAST(len(regexp_extract_all(t, '[-+]?[(（]?\d[\d,]*(?:\.\d+)?[)）]?%?')) AS INTEGER) AS numbers, {_COUNT(lx.TABLE_TERMS)} >= 3 AS table_context,
       {_COUNT(lx.NARRATIVE_TERMS)} >= 2 AS narrative, len(regexp_extract_all(txt, '\(?-?\d[\d,]*(?:\.\d+)?\)?')) >= 3 OR {_any_sql('txt', lx.FINANCIAL)} AS table_block FROM c"""
)
def rule_flags(spark, sf_dir):
    df = spark.createDataFrame(_TEXTS, "id int, txt string").withColumn("t", tx.compact(F.col("txt")))
    t = F.col("t")
    return df.select(
        "id",
        t.alias("compact"),
        tx.has_unit(t, F.lit("元")).alias("has_yuan"),
        tx.has_unit(t, F.lit("亿元")).alias("has_yi"),
        tx.has_numeric_shape(t).alias("numeric_shape"),
        F.size(tx.number_tokens(t)).alias("numbers"),
        tx.has_table_context(t).alias("table_context"),
        tx.is_narrative(t).alias("narrative"),
        tx.is_table_block(F.col("txt")).alias("table_block"),
    )


@_fixed(
    rf"""WITH v0 AS (SELECT x, trim(x) AS s FROM {_values([(n,) for n in _NUMBERS], 'x')}),
v1 AS (SELECT x, s LIKE '-%' OR s LIKE '(%)' OR s LIKE '（%）' AS neg, regexp_replace(regexp_replace(s, '^[()（）]+|[()（）]+$', '', 'g'), '[^0-9.-]', '', 'g') AS b FROM v0)
SELECT x AS value, CASE WHEN neg AND b <> '' AND b NOT LIKE '-%' THEN '-' || b ELSE b END AS normal FROM v1"""
)
def number_normalize(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in _NUMBERS], "value string").select("value", tx.normal_number(F.col("value")).alias("normal"))


# -- evidence and sufficiency over the driver's tables -------------------------------


def _node_hits(spark, sf_dir, k):
    q = query_table(spark, sf_dir)
    return q, rt.retrieve_nodes(q, node_table(spark, sf_dir), "bm25", k)


_CASES = f"""{_bm25_sql('b_', *_CORPUS_NODES)}, {_top_sql('b_', 3)},
ev AS (SELECT q.query_id, question, evidence_node_ids AS gold, coalesce(list(item ORDER BY rank) FILTER (WHERE item IS NOT NULL), []) AS ids,
              regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY rank), ''), '\\s+', '', 'g') AS t FROM query_t q LEFT JOIN (SELECT * FROM b_top JOIN b_i USING (item)) h USING (query_id) GROUP BY ALL),
sl AS (SELECT *, {_slots_sql("question", "'text'", "''")} AS slots FROM ev),
cv AS (SELECT *, list_filter(slots, lambda s: CASE WHEN s LIKE 'keyword:%' THEN contains(t, s[9:]) WHEN s LIKE 'year:%' THEN contains(t, s[6:]) WHEN s LIKE 'unit:%' THEN contains(t, s[6:]) WHEN s = 'numeric_shape' THEN regexp_matches(t, '\\d') ELSE false END) AS cov FROM sl),
cs AS (SELECT query_id, len(slots) AS n, len(cov) AS c, ids, list_has_any(ids, gold) AS citation_ok, len(gold) AS n_gold, cov, slots FROM cv),
st AS (SELECT *, CASE WHEN n = 0 AND len(ids) > 0 THEN 1.0 WHEN n = 0 THEN 0.0 ELSE c::DOUBLE / n END::DOUBLE AS coverage_ratio FROM cs),
fin AS (SELECT *, CASE WHEN c = n AND citation_ok THEN 'sufficient' WHEN c = n THEN 'citation_mismatch' WHEN coverage_ratio >= 0.5 THEN 'partial' ELSE 'insufficient' END AS status FROM st)"""


@_query(f"WITH {_VIEWS}, {_CASES} SELECT query_id, status, array_to_string(CASE WHEN n = 0 AND len(ids) > 0 THEN ['evidence_present'] ELSE cov END, ';') AS covered_items, coverage_ratio, citation_ok, array_to_string(ids, ';') AS evidence_node_ids FROM fin")
def sufficiency_cases(spark, sf_dir):
    found = sf.cases(*_node_hits(spark, sf_dir, 3), 3)
    return found.select("query_id", "status", F.array_join("covered_items", ";").alias("covered_items"), "coverage_ratio", "citation_ok", F.array_join("evidence_node_ids", ";").alias("evidence_node_ids"))


@_query(
    f"""WITH {_VIEWS}, {_CASES} SELECT count(*) AS queries, round(avg((status = 'sufficient')::INT)::DOUBLE, 6) AS sufficiency_rate, round(avg((status IN ('sufficient', 'partial'))::INT)::DOUBLE, 6) AS partial_or_sufficient_rate,
round(avg((status = 'citation_mismatch')::INT)::DOUBLE, 6) AS citation_mismatch_rate, round(avg(coverage_ratio), 6) AS avg_required_item_coverage, round(coalesce(avg(citation_ok::INT) FILTER (WHERE n_gold > 0), 0)::DOUBLE, 6) AS "region_hit@3" FROM fin"""
)
def sufficiency_metrics(spark, sf_dir):
    found = sf.rates(sf.cases(*_node_hits(spark, sf_dir, 3), 3), 3)
    return _rounded(found).select("queries", "sufficiency_rate", "partial_or_sufficient_rate", "citation_mismatch_rate", "avg_required_item_coverage", "`region_hit@3`")


# -- preparation ---------------------------------------------------------------------


@_query(f"WITH {_VIEWS} SELECT page_id, min(ord) AS ord, left(replace(regexp_replace(text, '\\s+', ' ', 'g'), ' ', ''), 220) AS fingerprint, count(*) AS copies FROM node_t GROUP BY ALL")
def dedup_fingerprint(spark, sf_dir):
    """First node per fingerprint inside a page."""
    key = F.substring(tx.match_form(F.col("text")), 1, 220)
    return node_table(spark, sf_dir).groupBy("page_id", key.alias("fingerprint")).agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("copies"))


_UNIT_PAGES = [("r", 1, "单位：元 a"), ("r", 2, "b"), ("r", 3, "c"), ("r", 4, "d"), ("r", 5, "单位：万元 e 单位：亿元"), ("r", 6, "f"), ("s", 1, "g"), ("s", 2, "单位: 千元")]


@_fixed(
    rf"""WITH v AS (SELECT *, regexp_extract_all(page_text, '单位[：:]\s*([人民币元万元亿元百万元千元]+)', 1) AS u FROM {_values(_UNIT_PAGES, 'doc_id, page_index, page_text')})
SELECT doc_id, page_index, coalesce(last_value(u[len(u)] IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), '') AS recent_unit FROM v"""
)
def unit_lookback(spark, sf_dir):
    df = spark.createDataFrame(_UNIT_PAGES, "doc_id string, page_index int, page_text string")
    return pp.unit_lookback(df).select("doc_id", "page_index", "recent_unit")


@_query(
    """WITH b AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn, text, conv_id * 10000 + turn AS ord, CASE WHEN turn = 0 THEN 1 ELSE CAST(turn AS INTEGER) END AS page_index FROM conversations)
SELECT doc_id, doc_id || '_p' || page_index AS page_id, page_index, doc_id || '_p' || page_index || '_n' || row_number() OVER (PARTITION BY doc_id, page_index ORDER BY ord) AS node_id, text FROM b"""
)
def generic_prepare(spark, sf_dir):
    """Turns of conversations through the generic table adapter."""
    rows = _read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("string").alias("page"), F.col("text").alias("content"), (F.col("conv_id") * 10000 + F.col("turn")).alias("ord")
    )
    t = pp.from_tables(rows, "conversations")
    return t["nodes"].select("doc_id", "page_id", F.col("metadata.page_index").cast("int").alias("page_index"), "node_id", "text")
