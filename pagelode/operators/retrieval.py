"""Retrievers over pages and evidence nodes; all return the HITS relation.

Pages, nodes and queries are the relations of :mod:`pagelode.schemas`; ``ord`` carries
their order, in which ties are resolved.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import text as tx
from ..schemas import HITS
from ..store import by_shuffle, join_rule, materialize, settle
from . import scoring
from .index import TextIndex

ALIASES = {"bm25_page": "bm25", "dense_page": "dense", "tfidf_page": "tfidf", "layout_node": "dense", "dense_node": "dense", "bm25_node": "bm25", "tfidf_node": "tfidf"}
SCOPES = {"doc": "document", "same_doc": "document", "in_document": "document", "document": "document", "all": "corpus", "global": "corpus", "corpus": "corpus"}


def top_k_of(value: Any, default: int = 10) -> int:
    if value is None:
        return default
    return max(map(int, value)) if isinstance(value, list | tuple) else int(value)


def scope_of(options: dict[str, Any]) -> str:
    value = str(options.get("search_scope", options.get("scope", "corpus"))).strip().lower()
    if value not in SCOPES:
        raise ValueError(f"Unsupported search scope: {value}")
    return SCOPES[value]


def method_of(*values: Any, default: str = "dense") -> str:
    found = next((v for v in values if v is not None), default)
    return ALIASES.get(str(found).lower(), str(found).lower())


def page_methods(options: dict[str, Any]) -> list[str]:
    value = options.get("page_methods", options.get("methods", ["bm25", "dense"]))
    return [method_of(x) for x in ([value] if isinstance(value, str) else value)]


def dense_options(options: dict[str, Any]) -> dict[str, Any]:
    size = options.get("dense_batch_size", os.environ.get("MDR_DENSE_BATCH_SIZE", 8))
    length = options.get("dense_max_seq_length", os.environ.get("MDR_DENSE_MAX_SEQ_LENGTH"))
    return {
        "require_model": bool(options.get("require_model", options.get("require_dense_model", False))),
        "batch_size": int(size),
        "max_seq_length": int(length) if length else None,
    }


def page_items(pages: DataFrame) -> DataFrame:
    body = tx.first_filled(F.col("page_text"), tx.text_of(F.col("ocr_text")))
    return pages.select(F.col("page_id").alias("item"), "ord", "doc_id", "page_id", F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("string").alias("node_type"), body.alias("text"), tx.first_filled(body, F.col("page_id")).alias("score_text"))


def node_items(nodes: DataFrame) -> DataFrame:
    body = tx.text_of(F.col("text"))
    return nodes.select(F.col("node_id").alias("item"), "ord", "doc_id", "page_id", "node_id", "node_type", body.alias("text"), tx.first_filled(body, F.col("node_id")).alias("score_text"))


def with_scope(queries: DataFrame, items: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("doc_id") if scope == "document" else F.lit("")
    return queries.withColumn("scope", key), items.withColumn("scope", key)


#: So many hits are broadcast to the items at most.
BROADCAST_HITS = 200_000


def as_hits(found: DataFrame, items: DataFrame, retriever: str) -> DataFrame:
    """Hits of (query_id, item, score, rank) with the items' columns; hits go to the items, not the items' texts to the hits."""
    few = materialize(found.select("query_id", "item", "score", "rank"), "hits")
    few = F.broadcast(few) if few.count() <= BROADCAST_HITS else by_shuffle(few)
    shown = items.select("item", "doc_id", "page_id", "node_id", "node_type", "text")
    out = shown.join(few, "item").dropDuplicates(["query_id", "item"])
    meta = F.lit(None).cast(HITS["metadata"].dataType)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "score", "doc_id", "page_id", "node_id", "node_type", "text", F.lit(retriever).alias("retriever"), meta.alias("metadata"))


def of_asked_documents(queries: DataFrame, items: DataFrame) -> DataFrame:
    """The items of documents that some question is about, written once."""
    asked = materialize(queries.select("doc_id").distinct(), "asked_documents")
    asked = F.broadcast(asked) if asked.count() <= store.BROADCAST_ROWS else by_shuffle(asked)
    return materialize(items.join(asked, "doc_id", "left_semi"), "asked")


def search(queries: DataFrame, items: DataFrame, method: str, k: int, scope: str = "corpus", encode: Callable | None = None, require_model: bool = False, index: TextIndex | None = None, asked: bool = False) -> tuple[DataFrame, str, DataFrame]:
    """(the k best, label of what ran, the items that were searched); ``index`` is one of just these items, ``asked`` says that they are of asked documents alone and written."""
    kind, label = scoring.kind_of(method, encode, require_model)
    if scope == "corpus":
        return scoring.corpus_top_k(queries, items, kind, k, encode, index), label, items
    if index is not None and kind != "dense":
        scores, few = scoring.of_index(queries, index, kind)
        rule = join_rule(queries, few)
        q = rule(queries.withColumn("scope", F.col("doc_id").cast("string")))
        return scoring.top_k(q, rule(few), scores, k), label, items
    q, i = with_scope(queries, items if asked else of_asked_documents(queries, items), scope)
    rule = join_rule(q, i)
    q, i = rule(q), rule(i)
    scores, label = scoring.score(q, i, method, encode, require_model)
    return scoring.top_k(q, i, scores, k), label, i


def retrieve_pages(queries, pages, method="bm25", k=10, scope="corpus", encode=None, require_model=False, index=None) -> DataFrame:
    found, label, items = search(queries, page_items(pages), method, k, scope, encode, require_model, index)
    return as_hits(found, items, label)


def retrieve_nodes(queries, nodes, method="dense", k=10, scope="corpus", encode=None, require_model=False, index=None) -> DataFrame:
    found, label, items = search(queries, node_items(nodes), method, k, scope, encode, require_model, index)
    return as_hits(found, items, label)


def filter_nodes(nodes: DataFrame, types: list[str] | None) -> DataFrame:
    return nodes.where(F.col("node_type").isin(list(types))) if types else nodes


def hybrid_best(queries, items, options: dict[str, Any], encode=None, index=None) -> DataFrame:
    """query_id, item, score, rank of pages: reciprocal-rank fusion of the page methods, which share an index; ties in order of first appearance."""
    k = top_k_of(options.get("page_top_k", options.get("top_k")))
    wide = int(options.get("candidate_top_k", max(k, 20)))
    scope, required = scope_of(options), dense_options(options)["require_model"]
    methods = page_methods(options)
    if index is None and scope == "corpus" and sum(scoring.kind_of(m, encode, required)[0] != "dense" for m in methods) > 1:
        index = TextIndex.build(items)
    asked = index is None and scope == "document"
    if asked:
        items = of_asked_documents(queries, items)
    lists = []
    for m in methods:
        lists.append(search(queries, items, m, wide, scope, encode, required, index, asked)[0].select("query_id", "item", "rank"))
        if asked:
            settle(queries.sparkSession)  # the best of a list are written
    both = scoring.fused(lists)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "item", "score", "rank")


def retrieve_hybrid_pages(queries, pages, options: dict[str, Any], encode=None, index=None) -> DataFrame:
    items = page_items(pages)
    return as_hits(hybrid_best(queries, items, options, encode, index), items, "hybrid_page")


def candidates_of(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Nodes on each query's pages (query_id, page_id, page_rank), in the pages' and then the nodes' order, written once."""
    order = Window.partitionBy("query_id").orderBy("page_rank", "node_ord")
    few = materialize(pages.select("query_id", "page_id", "page_rank"), "pages")
    few = F.broadcast(few) if few.count() <= BROADCAST_HITS else by_shuffle(few)
    rows = items.withColumnRenamed("ord", "node_ord").join(few, "page_id")
    return materialize(rows.withColumn("ord", F.row_number().over(order).cast("long")).withColumn("scope", F.col("query_id")), "candidates")


def regions_of_pages(queries, nodes, page_hits, method: str, k: int, label: str, encode=None, require_model=False) -> DataFrame:
    """Nodes of the hit pages, ranked with the statistics of that candidate set and fused with the pages' ranks."""
    candidates = candidates_of(page_hits.select("query_id", "page_id", F.col("rank").alias("page_rank")), node_items(nodes))
    rule = join_rule(candidates)
    candidates, q = rule(candidates), rule(queries.withColumn("scope", F.col("query_id")))
    scores, _ = scoring.score(q, candidates, method, encode, require_model)
    inner = scoring.every_item(q, candidates, scores).select("query_id", "item", "ord", F.col("rank").alias("node_rank"))
    total = 1.0 / (60.0 + F.col("node_rank")) + 1.0 / (60.0 + F.col("page_rank"))
    joined = inner.join(candidates.select("query_id", "item", "page_rank"), ["query_id", "item"])
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "node_rank")
    best = joined.withColumn("score", total).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return as_hits(best, candidates.dropDuplicates(["item"]), label)


def _region_options(options: dict[str, Any]) -> dict[str, Any]:
    return {"k": int(options.get("region_top_k", 5)), "require_model": dense_options(options)["require_model"]}


def retrieve_page_region(queries, pages, nodes, options: dict[str, Any], encode=None, index=None) -> DataFrame:
    method = method_of(options.get("region_method"), options.get("region_retriever"), options.get("method"))
    page_method = method_of(options.get("page_retriever"))
    hits = retrieve_pages(queries, pages, page_method, int(options.get("page_top_k", 10)), scope_of(options), encode, dense_options(options)["require_model"], index)
    return regions_of_pages(queries, filter_nodes(nodes, options.get("node_types")), hits, method, label="page_region", encode=encode, **_region_options(options))


def retrieve_hybrid_page_region(queries, pages, nodes, options: dict[str, Any], encode=None, index=None) -> DataFrame:
    method = method_of(options.get("region_method"), options.get("region_retriever"), options.get("method"))
    hits = retrieve_hybrid_pages(queries, pages, options, encode, index)
    return regions_of_pages(queries, filter_nodes(nodes, options.get("node_types")), hits, method, label="hybrid_page_region", encode=encode, **_region_options(options))


def retrieve_global_region(queries, nodes, options: dict[str, Any], encode=None, index=None) -> DataFrame:
    method = method_of(options.get("method"), options.get("region_method"), options.get("region_retriever"))
    k = int(options.get("region_top_k", top_k_of(options.get("top_k"))))
    hits = retrieve_nodes(queries, filter_nodes(nodes, options.get("node_types")), method, k, scope_of(options), encode, dense_options(options)["require_model"], index)
    return hits.withColumn("retriever", F.lit("global_region"))


def retrieve_oracle_page_region(queries, nodes, options: dict[str, Any], encode=None) -> DataFrame:
    """Upper bound: candidates are the nodes of the gold pages."""
    method = method_of(options.get("method"), options.get("region_method"), options.get("region_retriever"))
    items = node_items(filter_nodes(nodes, options.get("node_types")))
    gold = queries.select("query_id", F.posexplode("evidence_page_ids").alias("page_rank", "page_id"))
    candidates = candidates_of(gold, items)
    rule = join_rule(candidates)
    candidates, q = rule(candidates), rule(queries.withColumn("scope", F.col("query_id")))
    o = _region_options(options)
    scores, _ = scoring.score(q, candidates, method, encode, o["require_model"])
    k = int(options.get("region_top_k", top_k_of(options.get("top_k"))))
    return as_hits(scoring.top_k(q, candidates, scores, k), candidates.dropDuplicates(["item"]), "oracle_page_region")


def retrieve(queries: DataFrame, pages: DataFrame, nodes: DataFrame, options: dict[str, Any], encode=None, page_index: TextIndex | None = None, node_index: TextIndex | None = None) -> DataFrame:
    """Run the retriever that ``options['type']`` names; kept indexes are of these pages, and of the nodes of the types that the options ask for."""
    from .evidence import retrieve_evidence_set

    kind = str(options.get("type", "bm25_page"))
    k, scope, need = top_k_of(options.get("top_k")), scope_of(options), dense_options(options)["require_model"]
    runs: dict[str, Callable[[], DataFrame]] = {
        "bm25_page": lambda: retrieve_pages(queries, pages, "bm25", k, scope, encode, need, page_index),
        "dense_page": lambda: retrieve_pages(queries, pages, "dense", k, scope, encode, need, page_index),
        "hybrid_page": lambda: retrieve_hybrid_pages(queries, pages, options, encode, page_index),
        "layout_node": lambda: retrieve_nodes(queries, filter_nodes(nodes, options.get("node_types")), method_of(options.get("method")), k, scope, encode, need, node_index),
        "page_region": lambda: retrieve_page_region(queries, pages, nodes, options, encode, page_index),
        "hybrid_page_region": lambda: retrieve_hybrid_page_region(queries, pages, nodes, options, encode, page_index),
        "global_region": lambda: retrieve_global_region(queries, nodes, options, encode, node_index),
        "oracle_page_region": lambda: retrieve_oracle_page_region(queries, nodes, options, encode),
        "evidence_set_region": lambda: retrieve_evidence_set(queries, pages, nodes, options, encode),
    }
    if kind not in runs:
        raise ValueError(f"Unsupported retriever type: {kind}")
    return runs[kind]()
