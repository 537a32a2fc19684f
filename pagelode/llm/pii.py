"""Personal data by patterns and by bootstrapped contextual extraction.

Base kinds come from fixed patterns (Java regular expressions without backtracking
that could grow with the text; places follow from the pieces between matches). They
are the seeds, together with values behind a few key words such as ``password``.
Every base span and every other identifier-like value with a digit, and the lexical
patterns on its left (one word, or two, and the separator), form a bipartite graph over
the corpus. A pattern's confidence is its precision: the mean confidence of its distinct
values, times the share of all its occurrences in the corpus that such a value follows,
so the ordinary uses of a word count against it (key words are trusted without). Values
take the confidence of their best pattern, round by round, until the set of passing
patterns no longer changes; they label all values they stand before as kind ``id``. A
value without a digit enters the graph behind the key words alone, and is labelled behind
every passing pattern with ``:`` or ``=``. Rounds without the share come first: what they
pass bounds what can pass at all, and only the occurrences of these patterns are counted.
Everything is DataFrame operations; graph tables are aggregated before they are shuffled
and written once per round.

Defined cases: null text is empty and has no spans; repeated rows are documents of
their own; found values that overlap a base span are part of that span in the graph and
are not reported again; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

KINDS = ("email", "ip", "card", "phone")
#: Equal to the plain patterns; possessive, and a match starts where its first run starts or the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Word, separator and (ahead, so that it may be the next word) a value of six or more characters, with a digit after blanks alone.
CONTEXT = r"(?<![A-Za-z0-9_])[A-Za-z_]{2,}+(?:\s*+[:=]\s*+[\"']?|\s++(?=[A-Za-z_+/-]*+[0-9]))(?=([A-Za-z0-9_+/-]{6,}+))"
#: Word (or two) and separator at the end of the text before a base span, the word before at the end of the text before a value's word.
LEFT = r"(?<![A-Za-z0-9_])([A-Za-z_]{2,}+(?:\s*+[:=]\s*+[\"']?|\s++))\z"
LEFT_TWO = r"(?<![A-Za-z0-9_])([A-Za-z_]{2,}+\s++[A-Za-z_]{2,}+(?:\s*+[:=]\s*+[\"']?|\s++))\z"
WORD_BEFORE = r"(?<![A-Za-z0-9_])([A-Za-z_]{2,}+\s++)\z"
#: A run of words with blanks between them, each an occurrence of a pattern whatever follows, up to one with a separator.
CHAIN = r"(?<![A-Za-z0-9_])(?:(?:[A-Za-z_]{2,}+\s++(?![:=]))++(?:[A-Za-z_]{2,}+\s*+[:=])?+|[A-Za-z_]{2,}+\s*+[:=])"
#: Key words whose values are seeds.
SEED_KEYS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "ssn", "passport", "iban")


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(F.when(F.length(part(x)) <= 3, part(x)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        fits = (n >= 12) & (n <= 19)
        summed = F.aggregate(
            F.transform(F.split(F.reverse(F.when(fits, digits).otherwise("0")), ""), lambda d, i: d.try_cast("int") * (1 + i % 2)),
            F.lit(0),
            lambda s, v: s + F.when(v > 9, v - 9).otherwise(F.coalesce(v, F.lit(0))),
        )
        return fits & (summed % 10 == 0)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _pattern(found: Column) -> Column:
    """Words in lower case with one blank between them, and ``:``, ``=`` or nothing."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(F.lower(found), r"\s*+([:=])[\s\"']*+", "$1"), r"\s++", " "))


def _found(text: Column, pattern: str, worth: Column, groups: int = 0) -> Column:
    """Array of (gap before the match, size, the match or its groups, the patterns of one and two words on the left)."""
    none = F.array().cast("array<string>")
    pieces = F.when(worth, F.split(text, pattern, -1)).otherwise(none)
    matches = [F.when(worth, F.regexp_extract_all(text, F.lit(pattern), F.lit(g))).otherwise(none) for g in range(groups + 1)]
    names = ["gap", *(f"g{g}" for g in range(groups + 1))]
    zipped = F.arrays_zip(*(x.alias(n) for x, n in zip([pieces, *matches], names, strict=True)))

    def patterns(z: Column) -> tuple[Column, Column]:
        if not groups:  # a base span: its words end the gap
            return _pattern(F.regexp_extract(z["gap"], LEFT, 1)), _pattern(F.regexp_extract(z["gap"], LEFT_TWO, 1))
        before = F.regexp_extract(z["gap"], WORD_BEFORE, 1)
        return _pattern(z["g0"]), F.when(before != "", _pattern(F.concat(before, z["g0"]))).otherwise("")

    def entry(z: Column) -> Column:
        one, two = patterns(z)
        kept = z[f"g{groups}"].alias("value")
        return F.struct(F.length(z["gap"]).alias("gap"), F.length(z["g0"]).alias("size"), kept, one.alias("pattern"), two.alias("wide"))

    return F.transform(F.filter(zipped, lambda z: z["g0"].isNotNull()), entry)


def _raw(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    digit = text.rlike("[0-9]")
    worth = {k: (F.contains(text, F.lit(v)) if v else F.lit(True)) & (digit if k != "email" else F.lit(True)) for k, v in NEEDS.items()}
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        *(_found(text, PATTERNS[k], worth[k]).alias(k) for k in KINDS),
        _found(text, CONTEXT, text.rlike("[0-9:=]"), 1).alias("context"),
    )


def _placed(raw: DataFrame, column: str) -> DataFrame:
    """Matches of one column as rows with their start: sizes and gaps before them are summed per document."""
    rows = raw.where(F.size(column) > 0).select("row", F.posexplode(column).alias("no", "m")).select("row", "no", "m.*")
    w = Window.partitionBy("row").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("start", F.sum(F.col("gap") + F.col("size")).over(w) - F.col("size"))


def base_spans(raw: DataFrame) -> DataFrame:
    """row, kind_no, kind, start, end, value, pattern, wide (empty if no word, no two words stand before)."""
    out = None
    for no, kind in enumerate(KINDS):
        spans = (
            _placed(raw, kind)
            .where(_valid(kind, F.col("value")))
            .select("row", F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), "start", (F.col("start") + F.col("size")).alias("end"), "value", "pattern", "wide")
        )
        out = spans if out is None else out.unionByName(spans)
    return out


def contexts(raw: DataFrame) -> DataFrame:
    """row, kind_no, kind, start, end, value, pattern, wide of identifier-like values."""
    start = F.col("start") + F.col("size")
    return _placed(raw, "context").select(
        "row", F.lit(len(KINDS)).alias("kind_no"), F.lit("id").alias("kind"), start.alias("start"), (start + F.length("value")).alias("end"), "value", "pattern", "wide"
    )


def _keyed() -> Column:
    return F.regexp_replace("pattern", "[:=]$", "").isin(*SEED_KEYS) & F.col("pattern").rlike("[:=]$")


def _words(text: Column) -> Column:
    """The words of each run in a text, in the form of patterns; forms are made once for a text, not for each word and pair."""
    runs = F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CHAIN), F.lit(0)), ";")
    plain = F.regexp_replace(F.lower(runs), r"\s{2,}+|[\t\n\x0B\f\r]", " ")
    plain = F.replace(F.replace(F.replace(plain, F.lit(" :"), F.lit(":")), F.lit(" ="), F.lit("=")), F.lit(" ;"), F.lit(";"))
    return F.transform(F.split(F.rtrim(plain), ";"), lambda run: F.split(run, " "))


def occurrences(docs: DataFrame, patterns: DataFrame, most: int = 200_000) -> DataFrame:
    """(pattern, occurrences) in all texts, whatever follows; up to ``most`` patterns go to the texts, more are joined with the counts."""
    rows = docs.select(F.explode(_words(F.col("text"))).alias("words")).select(F.inline(F.arrays_zip(F.col("words").alias("one"), F.slice("words", 2, F.size("words")).alias("next"))))
    rows = rows.select(F.explode(F.array("one", F.concat("one", F.lit(" "), "next"))).alias("pattern")).where("pattern is not null")
    asked = patterns.select("pattern")
    if asked.count() <= most:
        rows = rows.join(F.broadcast(asked), "pattern", "left_semi")
        return rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("occurrences"))
    return rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("occurrences")).join(asked, "pattern", "left_semi")


def pattern_confidence(found: DataFrame, seeds: DataFrame, least: int = 3, sure: float = 0.7, shares: DataFrame | None = None) -> DataFrame:
    """(pattern, confidence, support) of the patterns that pass when no round adds one.

    ``found``: (pattern, value); ``seeds``: (value); ``shares``: (pattern, share), 1
    where it is not given. A pattern's confidence is the mean over its distinct values,
    shrunk by half a value, times its share; a value's is 1 for seeds and else that of its
    best passing pattern. Both only grow, and so does the set of passing patterns, which
    ends the rounds.
    """
    graph = materialize(found.groupBy("pattern", "value").count().drop("count"), "graph")
    known = graph.where(_keyed()).select("value").unionByName(seeds.select("value")).distinct().withColumn("seed", F.lit(1.0))
    scored = graph.join(known, "value", "left").select("pattern", "value", F.coalesce("seed", F.lit(0.0)).alias("seed"), F.coalesce("seed", F.lit(0.0)).alias("belief"))
    share = F.lit(1.0)
    if shares is not None:
        scored, share = scored.join(shares, "pattern", "left"), F.coalesce(F.first("share"), F.lit(1.0))
    kept = [c for c in ("share",) if c in scored.columns]
    n_passing = 0
    while True:
        passing = (
            scored.groupBy("pattern")
            .agg(F.sum("belief").alias("sum"), F.count(F.lit(1)).alias("support"), share.alias("share"))
            .select("pattern", (F.col("sum") / (F.col("support") + 0.5) * F.col("share")).alias("confidence"), "support")
            .where((F.col("support") >= least) & (F.col("confidence") >= sure))
        )
        passing = materialize(passing, "patterns")
        before, n_passing = n_passing, passing.count()
        if n_passing == before:
            return passing
        best = scored.join(passing, "pattern").groupBy("value").agg(F.max("confidence").alias("best"))
        scored = materialize(
            scored.join(best, "value", "left").select("pattern", "value", "seed", *kept, F.greatest("seed", F.coalesce("best", F.lit(0.0))).alias("belief")), "scored"
        )


def all_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The document rows (row, doc_id) and the spans (row, kind_no, kind, start, end, value) of base kinds and ``id``."""
    raw = materialize(_raw(docs), "matches")
    base = base_spans(raw)
    found = contexts(raw)
    # a running maximum of base ends finds overlaps: no base span may reach into a found one
    both = base.unionByName(found)
    w = Window.partitionBy("row").orderBy("start", "kind_no")
    is_base = F.col("kind_no") < len(KINDS)
    both = both.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    both = both.withColumn("next", F.min(F.when(is_base, F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    clear = is_base | ((F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end"))))
    both = materialize(both.where(clear).drop("reach", "next"), "spans")
    passing = passing_patterns(docs, both.where(is_base | F.col("value").rlike("[0-9]") | _keyed()), both.where(is_base))
    base, found = both.where(is_base), both.where(~is_base)
    labelled = _by_pattern(found).join(passing.select("pattern"), "pattern", "left_semi").drop("pattern").distinct()
    return raw.select("row", "doc_id"), base.drop("pattern", "wide").unionByName(labelled)


def _by_pattern(spans: DataFrame) -> DataFrame:
    """A row for each of the two patterns of a span."""
    return spans.withColumn("pattern", F.explode(F.array_distinct(F.array("pattern", "wide")))).where("pattern != ''").drop("wide")


def passing_patterns(docs: DataFrame, spans: DataFrame, seeds: DataFrame) -> DataFrame:
    """(pattern, confidence, support) of the graph over ``spans``; see the module."""
    graph = _by_pattern(spans).select("pattern", "value")
    possible = pattern_confidence(graph, seeds).select("pattern")
    graph = graph.join(possible, "pattern", "left_semi")
    followed = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("followed"))
    share = F.when(_keyed(), 1.0).otherwise(F.least(F.lit(1.0), F.col("followed") / F.col("occurrences")))
    shares = followed.join(occurrences(docs, possible), "pattern").select("pattern", share.alias("share"))
    return pattern_confidence(graph, seeds, shares=materialize(shares, "shares"))


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id."""
    rows, spans = all_spans(docs)
    item = F.struct("start", "kind_no", "end", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("text"))
    joined = lambda base: F.array_join(
        F.transform(F.filter(F.col("items"), lambda x: x["kind_no"] < len(KINDS)) if base else F.col("items"), lambda x: x["text"]), ","
    )
    per = spans.groupBy("row").agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        *(F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in (*KINDS, "id")),
    )
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.join(per, "row", "left").select(
        "doc_id",
        *counts,
        F.sha2(F.coalesce(joined(True), F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(joined(False), F.lit("")).alias("spans"),
        F.coalesce("n_id", F.lit(0)).cast("long").alias("n_id"),
    )
