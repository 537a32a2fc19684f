"""Rule check whether retrieved evidence suffices: metric, year, unit, value and citation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..store import by_shuffle

STATUSES = ("sufficient", "partial", "citation_mismatch", "insufficient")


def _meta(key: str) -> Column:
    return F.coalesce(F.element_at(F.col("metadata"), key), F.lit(""))


def required_items() -> Column:
    """Items a query's evidence must show, in fixed order."""
    numeric = tx.is_numeric(F.col("question_type"))
    metric = F.lit(False)
    for aliases in lx.METRICS.values():
        metric = metric | tx.contains_any(tx.compact(F.col("question")), aliases)
    answer = tx.text_of(F.col("answer"))
    return tx.some(
        [
            F.when(numeric & metric, F.lit("metric")),
            F.when(numeric & (F.size(tx.years(F.col("question"))) > 0), F.lit("year")),
            F.when(numeric & ((_meta("answer_unit") != "") | answer.rlike(lx.HAS_UNIT)), F.lit("unit")),
            F.when((_meta("raw_answer_value") != "") | answer.rlike(lx.ANSWER_NUMBER), F.lit("value")),
        ]
    )


def check(rows: DataFrame) -> DataFrame:
    """Add the four checks, covered and missing items and the ratio to rows with query columns and ``evidence_text``, ``evidence_node_ids_found``."""
    t = F.col("compact")
    unit = tx.first_filled(_meta("answer_unit"), tx.answer_unit_of(F.col("answer")))
    value = tx.first_filled(_meta("raw_answer_value"), tx.answer_number(F.col("answer")))
    out = rows.withColumn("compact", tx.compact(F.col("evidence_text"))).withColumns(
        {
            "metric_ok": tx.names_asked_metric(F.col("question"), t),
            "year_ok": F.exists(tx.years(F.col("question")), lambda y: F.contains(t, y)),
            "unit_ok": (unit != "") & tx.has_unit(t, unit),
            "value_ok": (value != "") & tx.value_in_text(value, t),
            "required": required_items(),
            "slots": tx.target_slots(F.col("question"), F.col("question_type"), F.element_at("metadata", "answer_unit")),
        }
    )
    ok = lambda i: F.when(i == "metric", F.col("metric_ok")).when(i == "year", F.col("year_ok")).when(i == "unit", F.col("unit_ok")).otherwise(F.col("value_ok"))
    by_slot = tx.covered_slots(F.col("slots"), t, strict_numbers=False)
    present = F.array(F.lit("evidence_present"))
    covered = (
        F.when(F.size("required") > 0, F.filter("required", ok))
        .when((F.size("slots") == 0) & (F.size("evidence_node_ids_found") > 0), present)
        .otherwise(by_slot)
    )
    missing = F.when(F.size("required") > 0, F.filter("required", lambda i: ~ok(i))).otherwise(F.array_except("slots", by_slot))
    out = out.withColumns({"covered_items": covered, "missing_items": missing})
    n = F.size("covered_items") + F.size("missing_items")
    return out.withColumn("coverage_ratio", F.when(n > 0, F.size("covered_items") / n).otherwise(0.0)).drop("compact", "required", "slots")


def status(missing: Column, ratio: Column, citation_ok: Column) -> Column:
    done = F.size(missing) == 0
    return (
        F.when(done & citation_ok, "sufficient").when(done, "citation_mismatch").when(ratio >= 0.5, "partial").otherwise("insufficient")
    )


def cases(queries: DataFrame, hits: DataFrame, top_k: int = 3) -> DataFrame:
    """One row per query with its first ``top_k`` hits' evidence and the verdict."""
    top = (
        hits.where(F.col("rank") <= top_k)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "text", "node_id", "page_id"))).alias("top"))
    )
    filled = lambda name: F.filter(F.transform("top", lambda x: x[name]), lambda x: x.isNotNull() & (x != ""))
    empty = F.array().cast("array<string>")
    rows = by_shuffle(queries).join(top, "query_id", "left").withColumns(
        {
            "evidence_text": F.coalesce(F.array_join(F.transform("top", lambda x: F.coalesce(x["text"], F.lit(""))), "\n"), F.lit("")),
            "evidence_node_ids_found": F.coalesce(filled("node_id"), empty),
            "evidence_pages": F.coalesce(filled("page_id"), empty),
        }
    )
    out = check(rows).withColumn("citation_ok", F.coalesce(F.arrays_overlap("evidence_node_ids_found", "evidence_node_ids"), F.lit(False)))
    return out.select(
        "query_id",
        status(F.col("missing_items"), F.col("coverage_ratio"), F.col("citation_ok")).alias("status"),
        "covered_items",
        "missing_items",
        "metric_ok",
        "year_ok",
        "unit_ok",
        "value_ok",
        "citation_ok",
        "coverage_ratio",
        F.col("evidence_node_ids_found").alias("evidence_node_ids"),
        "evidence_pages",
        "evidence_text",
        F.size("evidence_node_ids").alias("n_gold_nodes"),
    )


def rates(found: DataFrame, top_k: int = 3) -> DataFrame:
    """One row: queries, rates, mean coverage, region hit and a count per status."""
    is_ = lambda *s: F.coalesce(F.avg(F.col("status").isin(*s).cast("double")), F.lit(0.0))
    gold = F.when(F.col("n_gold_nodes") > 0, F.col("citation_ok").cast("double"))
    return found.agg(
        F.lit(top_k).alias("top_k"),
        F.count(F.lit(1)).alias("queries"),
        is_("sufficient").alias("sufficiency_rate"),
        is_("partial", "sufficient").alias("partial_or_sufficient_rate"),
        is_("citation_mismatch").alias("citation_mismatch_rate"),
        F.coalesce(F.avg("coverage_ratio"), F.lit(0.0)).alias("avg_required_item_coverage"),
        F.coalesce(F.avg(gold), F.lit(0.0)).alias(f"region_hit@{top_k}"),
        *(F.sum((F.col("status") == s).cast("long")).alias(f"status_{s}") for s in STATUSES),
    )
