"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) get cyclic weights and share
``rate`` times all words; no target exceeds ``cap`` times its source, and the excess
goes to the others by weight (water-filling in closed form over the source table).

Curriculum: over training time t in [0, 1] a source draws words at the rate
``target * (1 - k + 2 k t)``, k its schedule slope. The integral
``target * ((1 - k) t + k t^2)`` is inverted in closed form at each document's place
in its source's demand, which yields its training position; documents are then
range-sorted by position.

Inside a source documents follow the MD5 of their id. Running sums are two-level
(per source and hash bucket, then inside the bucket), so no task holds a source.

Defined cases: null text has size 0; null source is a source of its own, last in
order; repeated rows are documents of their own; an empty table gives an empty
result; ties in the order key fall to id, then size (equal rows are
interchangeable); extra columns are ignored, whatever their names; texts of any length
are counted whole, and only their sizes are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, unused
from .text import WORD_PATTERN

WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (-0.5, 0.0, 0.5)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, rate: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, weight, no, target) from rows (source, size).

    The windows run over the source table only (one row per distinct source).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(cap))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("weight"), "no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn(
        "level",
        (F.lit(rate) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / F.sum("weight").over(after),
    )
    ratio = F.col("most") / F.col("weight")
    first_free = F.min(F.when(F.col("level") < ratio, F.struct(ratio.alias("ratio"), "no", "level"))).over(everything)
    per = per.withColumn("level", first_free["level"])
    return per.select(
        "source",
        "source_size",
        "weight",
        "no",
        F.when(F.col("most") <= F.coalesce(F.col("level") * F.col("weight"), F.col("most")), F.col("most"))
        .otherwise(F.col("level") * F.col("weight"))
        .alias("target"),
    )


def curriculum_time(share: Column, slope: Column) -> Column:
    """The t at which ``(1 - k) t + k t^2`` equals ``share`` of a source's demand."""
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - slope) * (1 - slope) + 4 * slope * share))
    return F.when(slope == 0, share).otherwise((root - (1 - slope)) / (2 * slope))


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and key (the order inside a source), written once."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key")
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key), "sizes")


def mix_plan(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, rate: float = 1.5, cap: float = 2.0, sized: DataFrame | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, start (place in its source), taken, position; ``sized``: :func:`sizes_of` if written already.

    ``taken`` counts words with repeats: the part of the document's place, laid end
    to end once per pass, that falls below the target. Buckets of a source hold about
    2,000 documents of a table with one source, so a hot source is many small groups.
    """
    sized = sizes_of(docs) if sized is None else sized
    n = sized.count()
    buckets = 64
    while buckets < 65536 and buckets * 2000 < n:
        buckets *= 4
    digits = {64: 2, 256: 2, 1024: 3, 4096: 3, 16384: 4, 65536: 4}[buckets]
    number = F.conv(F.substring("key", 1, digits), 16, 10).cast("int")
    sized = sized.withColumn("bucket", F.floor(number / (16**digits // buckets)).cast("int"))
    targets = source_targets(sized, weights, rate, cap)
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    prior = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("part").over(prior), F.lit(0))).drop("part")
    facts = (
        sums.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
        .drop("t_source")
        .withColumnsRenamed({"source": "f_source", "bucket": "f_bucket"})
    )
    inner = (
        Window.partitionBy("source", "bucket")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = sized.withColumn("upto", F.sum("size").over(inner)).join(
        facts, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("bucket") == F.col("f_bucket"))
    )
    start = F.col("before") + F.col("upto") - F.col("size")
    want = F.floor(F.col("target") + 0.5)
    clip = lambda x: F.greatest(F.lit(0), F.least(F.col("size"), x))
    passes = int(-(-cap // 1))
    taken = sum((clip(want - start - F.col("source_size") * e) for e in range(passes)), F.lit(0))
    slope = F.element_at(F.array(*map(F.lit, slopes)), (F.col("no") % len(slopes) + 1).cast("int"))
    return placed.withColumn("start", start).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "start",
        taken.cast("long").alias("taken"),
        F.when(
            (F.col("target") > 0) & (want > F.col("start")),
            curriculum_time(F.least(F.lit(1.0), F.col("start") / F.col("target")), slope),
        ).alias("position"),
        slope.alias("slope"),
    )


def in_training_order(plan: DataFrame) -> DataFrame:
    """Range-sort by position; documents that are not drawn come last."""
    return plan.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, rate: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The documents of the mix in training order, whole, once for each pass that draws them.

    A pass draws a document if at least half of its words lie below the target, so a
    source's total differs from its target by at most half a document.
    """
    sized = sizes_of(docs)
    plan = mix_plan(docs, weights, slopes, rate, cap, sized)
    own, of_source, of_size, places, place, words, row, rows = unused(docs, "own", "of_source", "of_size", "places", "place", "words", "row", "rows")
    passes = int(-(-cap // 1))
    drawn = (
        plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
        .withColumn("at", F.col("start") + F.col("pass") * F.col("source_size"))
        .where((F.col("at") + F.col("size") / 2 <= F.col("target")) & (F.col("size") > 0))
        .select(
            F.col("doc_id").alias(own),
            F.col("source").alias(of_source),
            F.col("size").alias(of_size),
            curriculum_time(F.least(F.lit(1.0), F.col("at") / F.col("target")), F.col("slope")).alias(place),
        )
    )
    # rows that share id, source and size stand for each other: they are drawn as one set of copies
    drawn = drawn.groupBy(own, of_source, of_size).agg(F.collect_list(place).alias(places))
    same = F.col("doc_id").eqNullSafe(F.col(own)) & F.col("source").eqNullSafe(F.col(of_source))
    repeated = sized.groupBy("doc_id", "source").count().where("count > 1").limit(1).count()
    if not repeated:  # the table that is hashed holds ids and places, texts are not sorted before their final order
        joined = docs.join(drawn.hint("shuffle_hash"), same)
    else:
        joined = docs.withColumn(words, word_count(F.col("text"))).join(drawn.hint("shuffle_hash"), same & (F.col(words) == F.col(of_size)))
        alike = Window.partitionBy(own, of_source, of_size)
        joined = joined.withColumn(rows, F.count(F.lit(1)).over(alike)).withColumn(row, F.row_number().over(alike.orderBy("text")) - 1)
        mine = f"filter(transform(array_sort(`{places}`), (p, i) -> if(i % `{rows}` = `{row}`, p, null)), p -> p is not null)"
        joined = joined.withColumn(places, F.expr(mine))
    out = joined.withColumn(place, F.explode(places))
    return out.orderBy(place, "doc_id").select(*(F.col(f"`{c}`") for c in docs.columns))
