"""Retrieval metrics over queries and hits in one pass, error rows and breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import by_shuffle

METRICS = ("page_recall@1", "page_recall@5", "page_recall@10", "mrr", "ndcg@5", "ndcg@10", "region_hit@5")


def judged(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries left-joined with their hits: page_match, node_match, match, place (order by rank within the query)."""
    gold = queries.select("query_id", "evidence_page_ids", "evidence_node_ids")
    rows = by_shuffle(gold).join(hits.select("query_id", "rank", "page_id", "node_id"), "query_id", "left")
    in_list = lambda ids, c: F.coalesce(F.array_contains(F.col(ids), F.col(c)), F.lit(False))
    rows = rows.withColumns({"page_match": in_list("evidence_page_ids", "page_id"), "node_match": in_list("evidence_node_ids", "node_id")})
    by_node = F.col("node_id").isNotNull() & (F.col("node_id") != "") & (F.size("evidence_node_ids") > 0)
    return rows.withColumn("match", F.when(by_node, F.col("node_match")).otherwise(F.col("page_match")))


def _hit(match: str, k: int) -> Column:
    return F.max(F.when(F.col(match) & (F.col("rank") <= k), 1.0).otherwise(0.0))


def _ideal(n: Column, k: int) -> Column:
    gain = [F.when(n >= i, 1.0 / F.log2(F.lit(i + 1.0))).otherwise(0.0) for i in range(1, k + 1)]
    return sum(gain, F.lit(0.0))


def per_query(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per query with every metric (null where the query is not counted).

    Ranks are dense from 1, so the first k rows are those with rank up to k.
    """
    rows = judged(queries, hits)
    has_node = F.col("node_id").isNotNull() & (F.col("node_id") != "")
    gains = lambda k: F.sum(F.when(F.col("match") & (F.col("rank") <= k), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    named = {f"page_recall@{k}": _hit("page_match", k) for k in (1, 5, 10)}
    named |= {"first": F.min(F.when(F.col("match"), F.col("rank"))), "region_hit@5": _hit("node_match", 5)}
    named |= {f"dcg{k}": gains(k) for k in (5, 10)} | {f"nodes{k}": F.max((has_node & (F.col("rank") <= k)).cast("int")) for k in (5, 10)}
    out = rows.groupBy("query_id").agg(
        F.any_value(F.size("evidence_page_ids")).alias("n_pages"),
        F.any_value(F.size("evidence_node_ids")).alias("n_nodes"),
        *(v.alias(k) for k, v in named.items()),
    )
    pages, nodes = F.col("n_pages") > 0, F.col("n_nodes") > 0
    cols = {f"page_recall@{k}": F.when(pages, F.col(f"`page_recall@{k}`")) for k in (1, 5, 10)}
    cols["mrr"] = F.when(pages | nodes, F.coalesce(1.0 / F.col("first"), F.lit(0.0)))
    for k in (5, 10):
        size = F.when((F.col(f"nodes{k}") == 1) & nodes, F.col("n_nodes")).otherwise(F.col("n_pages"))
        ideal = _ideal(size, k)
        cols[f"ndcg@{k}"] = F.when(pages | nodes, F.when(ideal > 0, F.col(f"dcg{k}") / ideal).otherwise(0.0))
    cols["region_hit@5"] = F.when(nodes, F.col("`region_hit@5`"))
    return out.select("query_id", *(cols[m].alias(m) for m in METRICS))


def evaluate(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row with the seven metrics; 0 where no query is counted."""
    return per_query(queries, hits).agg(*(F.coalesce(F.avg(f"`{m}`"), F.lit(0.0)).alias(m) for m in METRICS))


def error_rows(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries whose first five hits miss the gold pages, or the gold nodes if there are any."""
    top = hits.where("rank <= 5").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "page_id", "node_id"))).alias("top"))
    rows = by_shuffle(queries).join(top, "query_id", "left").withColumn("top", F.coalesce("top", F.array().cast("array<struct<rank:int,page_id:string,node_id:string>>")))
    pages = F.transform("top", lambda x: x["page_id"])
    nodes = F.filter(F.transform("top", lambda x: x["node_id"]), lambda x: x.isNotNull() & (x != ""))
    out = rows.select(
        "query_id",
        "question",
        F.array_join("evidence_page_ids", ";").alias("gold_pages"),
        F.array_join(pages, ";").alias("pred_pages_top5"),
        F.array_join("evidence_node_ids", ";").alias("gold_nodes"),
        F.array_join(nodes, ";").alias("pred_nodes_top5"),
        F.arrays_overlap("evidence_page_ids", pages).alias("page_ok"),
        ((F.size("evidence_node_ids") == 0) | F.arrays_overlap("evidence_node_ids", nodes)).alias("region_ok"),
    )
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("page_ok", "region_ok")}).where(~(F.col("page_ok") & F.col("region_ok")))


def breakdown(rows: DataFrame, *keys: str) -> DataFrame:
    """Count and share of rows per key."""
    return breakdowns(rows, [keys]).select(*keys, "n", "share")


def breakdowns(rows: DataFrame, sets: Sequence[Sequence[str]], **measures: Column) -> DataFrame:
    """Counts over several sets of keys in one aggregation: the keys, level, n, share, measures.

    ``level`` tells the sets apart (a bit for every key that is summed over, the last key
    lowest), as a null key may also be a value; ``share`` is of all rows of the set. The
    window for it sees aggregated rows alone.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    grouped = rows.groupingSets([[F.col(k) for k in s] for s in sets], *(F.col(k) for k in keys)) if keys else rows.groupBy()
    level = F.grouping_id().cast("long") if keys else F.lit(0).cast("long")
    counts = grouped.agg(level.alias("level"), F.count(F.lit(1)).alias("n"), *(c.alias(name) for name, c in measures.items()))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("level"))
    return counts.select(*keys, "level", "n", share.alias("share"), *measures)


def rollup_sets(*keys: str) -> list[tuple[str, ...]]:
    """All keys, all but the last, ... and none."""
    return [keys[:k] for k in range(len(keys), -1, -1)]
