"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary (the built-in frequent-items sketch) finds digests that may
be frequent, in one pass and bounded memory. Their exact winners are aggregated
with map-side combining and broadcast (at most ``heavy`` rows); all other digests,
each on at most about ``rows / tracked`` rows, take one ordinary shuffle.

Defined cases: null text counts as empty; null ``doc_id`` never beats another id; of
rows that share text and ``doc_id`` exactly one stays; an empty table gives an
empty result; other columns are ignored, whatever their names; texts of any length
are hashed whole, and only ids and digests are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, unused
from .text import ascii_lower


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normalised text."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def frequent_digests(digests: DataFrame, heavy: int = 256, tracked: int = 4096) -> list[str]:
    """At most ``heavy`` digests that the summary reports, most frequent first."""
    row = digests.agg(F.expr(f"approx_top_k(text_sha256, {int(heavy)}, {int(tracked)})").alias("top")).first()
    return [x["item"] for x in (row["top"] or []) if x["count"] > 1]


def duplicate_groups(docs: DataFrame, heavy: int = 256, tracked: int = 4096) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = materialize(
        docs.select(
            "doc_id", text_digest(F.col("text")).alias("text_sha256"), F.monotonically_increasing_id().alias("row")
        ),
        "digests",
    )
    top = frequent_digests(digests, heavy, tracked)
    winner = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.col("row"))
    is_heavy = F.col("text_sha256").isin(top) if top else F.lit(False)
    best = (
        digests.where(is_heavy)
        .groupBy("text_sha256")
        .agg(F.max(winner).alias("best"), F.count(F.lit(1)).alias("group_size"))
    )
    hot = digests.where(is_heavy).join(F.broadcast(best), "text_sha256")
    w = Window.partitionBy("text_sha256")
    rest = digests.where(~is_heavy).select(
        "text_sha256", "doc_id", "row", F.max(winner).over(w).alias("best"), F.count(F.lit(1)).over(w).alias("group_size")
    )
    return hot.select(rest.columns).unionByName(rest).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, heavy: int = 256, tracked: int = 4096) -> DataFrame:
    """The documents that stay, with all their columns.

    Losers of frequent digests go on the map side; all other texts meet the winners in
    a hash join whose table is built of ids and digests, so texts are never sorted.
    """
    digest, best_id, best_digest, hot, hot_best = unused(docs, "digest", "best_id", "best_digest", "hot", "hot_best")
    groups = materialize(duplicate_groups(docs, heavy, tracked), "groups")
    kept = groups.where("kept").select(F.col("doc_id").alias(best_id), F.col("text_sha256").alias(best_digest), "group_size")
    winners = kept.drop("group_size")
    largest = kept.where("group_size > 1").orderBy(F.desc("group_size"), best_digest).limit(heavy)
    largest = largest.select(F.col(best_digest).alias(hot), F.struct(F.col(best_id).alias("id")).alias(hot_best))
    marked = docs.withColumn(digest, text_digest(F.col("text"))).join(F.broadcast(largest), F.col(digest) == F.col(hot), "left")
    marked = marked.where(F.col(hot).isNull() | F.col("doc_id").eqNullSafe(F.col(f"{hot_best}.id"))).drop(hot, hot_best)
    same = F.col("doc_id").eqNullSafe(F.col(best_id)) & (F.col(digest) == F.col(best_digest))
    out = marked.join(winners.hint("shuffle_hash"), same, "left_semi")
    repeated = groups.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count()
    if repeated:
        out = out.dropDuplicates(["doc_id", digest])
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
