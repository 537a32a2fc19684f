"""From raw pages and tables to the four relations, and rule-made annotations.

Deviations that are ours: native arrays and maps, explicit schemas for empty tables,
a fixed order of metric rows, guarded casts of page numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..schemas import ANNOTATION_COLUMNS, NODES, PAGES
from ..store import materialize, numbered


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: A chunk is full at 260 characters; places count a character more for the blank or the end.
_FULL = 261


def text_chunks(page_text: Column) -> Column:
    """Chunks of a page without blocks: a financial line alone, other lines gathered to 260 characters.

    Lines have places: running lengths, with a gap of a full chunk before a financial line.
    So the next chunk after a line begins at the first place at least ``_FULL`` further, which
    a binary search finds, and the chunks of the page are the way from the first line along
    these beginnings, which doubles its length in every step. Work grows with the number of
    lines times its logarithm.
    """
    lines = F.filter(F.transform(F.split(tx.text_of(page_text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), tx.clean), lambda x: x != "")
    alone = lambda x: F.transform(x, lambda line: tx.is_financial(line) & line.rlike(lx.NUMBER))
    return _let(lines, lambda x: _let(alone(x), lambda own: _let(_places(x, own), lambda at: _let(_beginnings(at, own), lambda begin: _joined(x, begin)))))


def _steps(lines: Column) -> Column:
    """0, 1, ... for as many doublings as cover the lines."""
    return F.sequence(F.lit(0), F.length(F.bin(F.size(lines))))


def _places(lines: Column, own: Column) -> Column:
    """Running sums of what lies before each line, by doubling."""
    before = F.transform(
        lines, lambda x, i: F.when(i > 0, F.length(F.get(lines, i - 1)) + 1).otherwise(0).cast("long") + F.when(F.get(own, i), F.lit(_FULL)).otherwise(0)
    )

    def add(sums: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: x + F.when(i >= back, F.get(sums, i - back)).otherwise(F.lit(0)))

    return F.aggregate(_steps(lines), before, add)


def _beginnings(at: Column, own: Column) -> Column:
    """The lines that chunks begin with, in order."""
    n = F.size(at)

    def search(i: Column) -> Column:
        least = F.get(at, i) + _FULL
        ends = F.struct((i + 1).alias("lo"), n.alias("hi"))

        def halve(s: Column, _: Column) -> Column:
            mid = F.shiftright(s["lo"] + s["hi"], 1)
            found = F.get(at, mid) >= least
            open_ = s["lo"] < s["hi"]
            return F.struct(F.when(open_ & ~found, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & found, mid).otherwise(s["hi"]).alias("hi"))

        return F.aggregate(_steps(at), ends, halve, lambda s: s["lo"])

    # one place more, the end, which leads to itself
    following = F.concat(F.transform(at, lambda _, i: F.when(F.get(own, i), i + 1).otherwise(search(i))), F.array(n))

    def double(s: Column, _: Column) -> Column:
        further = F.concat(s["way"], F.transform(s["way"], lambda x: F.get(s["jump"], x)))
        return F.struct(F.filter(further, lambda x: x < n).alias("way"), F.transform(s["jump"], lambda x: F.get(s["jump"], x)).alias("jump"))

    return F.aggregate(_steps(at), F.struct(F.array(F.lit(0)).alias("way"), following.alias("jump")), double, lambda s: s["way"])


def _joined(lines: Column, begin: Column) -> Column:
    end = lambda i: F.coalesce(F.get(begin, i + 1), F.size(lines))
    return F.transform(begin, lambda s, i: F.array_join(F.slice(lines, s + 1, end(i) - s), " "))


def metric_rows(chunk: Column) -> Column:
    """Windows of 360 characters from each financial keyword's first place that hold a number."""
    def row(keyword: str) -> Column:
        at = F.position(F.lit(keyword), chunk)
        window = F.substring(chunk, at, F.lit(360))
        return F.when((at > 0) & window.rlike(lx.NUMBER), window)

    return tx.some([row(k) for k in lx.FINANCIAL])


def split_nodes(pages: DataFrame) -> DataFrame:
    """NODES of pages (doc_id, page_id, page_index, page_text, source_pdf, blocks array<struct<bbox, text>>, ord).

    Every chunk gives its metric rows and then itself; what repeats on the page by its
    fingerprint is left out; a page without chunks keeps one node.
    """
    blocks = F.filter(F.coalesce("blocks", F.array().cast("array<struct<bbox:array<double>,text:string>>")), lambda b: tx.clean(b["text"]) != "")
    piece = lambda text, bbox: F.struct(bbox.alias("bbox"), text.alias("text"))
    none = F.lit(None).cast("array<double>")
    chunks = F.when(F.size(blocks) > 0, F.transform(blocks, lambda b: piece(tx.clean(b["text"]), b["bbox"]))).otherwise(
        F.transform(text_chunks(F.col("page_text")), lambda t: piece(tx.clean(t), none))
    )

    def parts(chunk: Column) -> Column:
        made = lambda text, kind, key, chunk=chunk: F.struct(chunk["bbox"].alias("bbox"), text.alias("text"), kind.alias("node_type"), key.alias("key"))
        rows = F.transform(metric_rows(chunk["text"]), lambda w: made(w, F.lit("table_row"), F.substring(tx.match_form(w), 1, 180)))
        kind = F.when(tx.is_table_block(chunk["text"]), "table_block").otherwise("paragraph")
        own = made(F.substring(chunk["text"], 1, 900), kind, F.substring(tx.match_form(chunk["text"]), 1, 220))
        return F.concat(rows, F.filter(F.array(own), lambda _: F.length(chunk["text"]) >= 12))

    listed = pages.select(
        "doc_id",
        "page_id",
        "page_index",
        "ord",
        F.flatten(F.transform(chunks, parts)).alias("parts"),
        F.when(F.size(blocks) > 0, "pymupdf_block_metric_rows").otherwise("text_fallback").alias("method"),
        F.to_json(tx.page_units(tx.clean(F.col("page_text")))).alias("unit_candidates"),
        F.coalesce("source_pdf", F.lit("")).alias("source_pdf"),
        "page_text",
    )
    # one shuffle by document serves all three windows, and only a page without parts carries its text through it
    default = F.when(F.size("parts") == 0, tx.first_filled(tx.clean(F.col("page_text")), F.col("page_id")))
    exploded = listed.withColumn("default", default).drop("page_text").select("*", F.posexplode_outer("parts").alias("no", "part")).drop("parts").repartition("doc_id")
    first = Window.partitionBy("doc_id", "page_id", "part.key").orderBy("no")
    kept = exploded.withColumn("seen", F.row_number().over(first)).where("part is null or (seen = 1 and part.key <> '')")
    index = F.row_number().over(Window.partitionBy("doc_id", "page_id").orderBy("no"))
    order = Window.partitionBy("doc_id").orderBy("ord", "no")
    base = kept.withColumn("index", index).withColumn("before", F.row_number().over(order))
    facts = {"chunk_method": F.col("method"), "page_index": F.col("page_index").cast("string"), "unit_candidates": F.col("unit_candidates"), "source_pdf": F.col("source_pdf")}
    meta = F.create_map(*(x for k, v in facts.items() for x in (F.lit(k), v)))
    out = base.select(
        F.concat("page_id", F.lit("_n"), F.lpad(F.col("index").cast("string"), F.greatest(F.lit(3), F.length(F.col("index").cast("string"))), F.lit("0"))).alias("node_id"),
        "doc_id",
        "page_id",
        F.coalesce("part.node_type", F.lit("paragraph")).alias("node_type"),
        F.col("part.bbox").alias("bbox"),
        F.coalesce("part.text", "default").alias("text"),
        F.lit("").alias("image_path"),
        F.lit(None).cast("string").alias("parent_id"),
        F.col("before").cast("int").alias("reading_order"),
        F.lit("pymupdf_blocks").alias("source"),
        F.lit(1.0).alias("confidence"),
        meta.alias("metadata"),
        (F.col("ord") * 100000 + F.col("index")).alias("ord"),
    )
    return out.select(*(F.col(f.name).cast(f.dataType) for f in NODES.fields))


SNIPPETS, ANSWERS = ("value_evidence_text", "unit_evidence_text", "evidence_text"), ("raw_answer_value", "answer")


def annotation_forms() -> list[Column]:
    """What :func:`annotation_score` compares of an annotation, made once for it and not for every node."""
    forms = [tx.match_form(F.col(c)).alias(f"{c} form") for c in ANSWERS + SNIPPETS]
    numbers = [tx.compact_number(tx.match_form(F.col(c))).alias(f"{c} number") for c in ANSWERS]
    chars = [tx.distinct_chars(tx.match_form(F.col(c)), 160).alias(f"{c} chars") for c in SNIPPETS]
    asked = F.filter(F.array(*map(F.lit, lx.FINANCIAL)), lambda k: F.contains(tx.text_of(F.col("question")), k)).alias("asked")
    return [*forms, *numbers, *chars, asked]


def node_forms() -> list[Column]:
    """What :func:`annotation_score` compares of a node (``text``), made once for it."""
    t = tx.match_form(F.col("text"))
    return [t.alias("node form"), tx.compact_number(t).alias("node number"), tx.distinct_chars(t, 260).alias("node chars")]


def annotation_score() -> Column:
    """How well a node (``text``) matches an annotation's value, keywords, snippets and unit; needs the forms of both."""
    t = F.col("node form")
    total = F.lit(0.0)
    for c in ANSWERS:
        v, n = F.col(f"{c} form"), F.col(f"{c} number")
        total = total + F.when((v != "") & F.contains(t, v), 5.0).otherwise(0.0)
        total = total + F.when((n != "") & F.contains(F.col("node number"), n), 3.5).otherwise(0.0)
    for k in lx.FINANCIAL:
        total = total + F.when(F.array_contains("asked", k) & F.contains(F.col("text"), F.lit(k)), 4.0).otherwise(0.0)
    for c in SNIPPETS:
        s = F.col(f"{c} form")
        total = total + F.when((F.length(s) >= 16) & F.contains(t, F.substring(s, 1, 80)), 3.0).when(s != "", tx.shared_chars(F.col(f"{c} chars"), F.col("node chars"))).otherwise(0.0)
    unit = tx.text_of(F.col("answer_unit"))
    return total + F.when((unit != "") & F.contains(F.col("text"), unit), 1.0).otherwise(0.0)


def match_annotations(annotations: DataFrame, nodes: DataFrame, dataset: str, file_name: str) -> DataFrame:
    """QUERIES of annotation rows: gold nodes are the three best of the evidence pages, else each page's first."""
    rows = numbered(annotations.withColumn("place", F.monotonically_increasing_id()), "no", "place").drop("place")
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ANNOTATION_COLUMNS if c not in annotations.columns})
    pages = F.filter(F.transform(F.split(tx.text_of(F.col("evidence_pages")), ";"), tx.stripped), lambda x: x != "")
    rows = rows.withColumn("pages", pages)
    # only what the score compares goes to the nodes, formed on either side before they meet, and only scores come back
    asked = rows.select("no", "question", "answer_unit", "pages", *annotation_forms()).select("*", F.posexplode("pages").alias("page_no", "page_id")).drop("pages", "question")
    pairs = asked.join(nodes.select("page_id", "node_id", "text", "reading_order", "ord", *node_forms()), "page_id")
    scored = materialize(pairs.select("no", "page_no", "node_id", "reading_order", "ord", annotation_score().alias("match")), "scored")
    best = Window.partitionBy("no").orderBy(F.desc(F.round("match", 9)), "reading_order", "page_no", "ord")
    top = scored.where("match > 0").withColumn("place", F.row_number().over(best)).where("place <= 3")
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(c, "node_id"))), lambda x: x["node_id"]))
    matched = top.groupBy("no").agg(ordered("place").alias("matched"))
    first = scored.groupBy("no", "page_no").agg(F.min_by("node_id", "ord").alias("node_id")).groupBy("no").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "node_id"))), lambda x: x["node_id"]).alias("fallback"))
    out = rows.join(matched, "no", "left").join(first, "no", "left")
    empty = F.array().cast("array<string>")
    state = F.when(F.col("matched").isNotNull(), "matched").when(F.col("fallback").isNotNull(), "fallback").otherwise("missing")
    kept = [c for c in annotations.columns if c not in ("query_id", "doc_id", "question", "answer", "evidence_pages", "is_answerable")]
    meta = F.map_from_arrays(
        F.array(*map(F.lit, [*kept, "annotation_file", "node_match_status"])), F.array(*(F.col(c).cast("string") for c in kept), F.lit(file_name), state)
    )
    return out.select(
        tx.first_filled(F.col("query_id"), F.concat(F.lit("cn_q"), F.col("no").cast("string"))).alias("query_id"),
        F.lit(dataset).alias("dataset"),
        tx.text_of(F.col("doc_id")).alias("doc_id"),
        tx.text_of(F.col("question")).alias("question"),
        tx.text_of(F.col("answer")).alias("answer"),
        tx.first_filled(F.col("question_type"), tx.text_of(F.col("evidence_type"))).alias("question_type"),
        F.col("pages").alias("evidence_page_ids"),
        F.coalesce("matched", "fallback", empty).alias("evidence_node_ids"),
        F.array().cast("array<array<double>>").alias("evidence_bboxes"),
        (~F.lower(F.coalesce("is_answerable", F.lit("true"))).isin("false", "0", "no")).alias("is_answerable"),
        meta.alias("metadata"),
    )


def _number_after(text: Column, keyword: str, span: int) -> Column:
    at = F.position(F.lit(keyword), text)
    return F.when(at > 0, F.nullif(F.regexp_extract(F.substring(text, at + len(keyword), F.lit(span)), lx.NUMBER, 0), F.lit("")))


def unit_lookback(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_index, page_text) with recent_unit: the last unit note of this or the two pages before."""
    w = Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(-2, 0)
    text = tx.text_of(F.col("page_text"))
    found = F.regexp_extract_all(text, F.lit(lx.UNIT_NOTE), F.lit(1))
    notes = F.regexp_extract_all(text, F.lit(lx.UNIT_NOTE), F.lit(0))
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1))
    clip = F.when(F.size(notes) > 0, tx.clip(text, F.coalesce(last(notes), F.lit("")), 80, 120))
    return pages.withColumns(
        {
            "recent_unit": F.coalesce(F.last(last(found), ignorenulls=True).over(w), F.lit("")),
            "recent_unit_text": F.coalesce(F.last(clip, ignorenulls=True).over(w), F.lit("")),
        }
    )


# Metric questions (keywords, question ending, section); the sentences, notes and section names below are fixed as well.
METRIC_QUESTIONS = (
    (("营业收入",), "营业收入是多少？", "main_accounting_data"),
    (("归属于上市公司股东的净利润",), "归属于上市公司股东的净利润是多少？", "main_accounting_data"),
    (("经营活动产生的现金流量净额",), "经营活动产生的现金流量净额是多少？", "cash_flow"),
    (("研发投入", "研发费用"), "研发投入或研发费用是多少？", "r_and_d"),
    (("资产总额", "资产总计"), "资产总额是多少？", "balance_sheet"),
)


# Names of the question kinds in order, for the list of what a report does not answer.
KIND_NAMES = ("report_year", "report_title", "营业收入", "归属于上市公司股东的净利润", "经营活动产生的现金流量净额", "研发投入", "资产总额", "revenue_growth", "risk_text")


def skipped_items(pages: DataFrame, every: DataFrame) -> DataFrame:
    """(doc_id, kind_no, name) of questions that a report gives no answer to; ``every``: its :func:`annotation_kinds`."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind_no"), F.lit(n).alias("name")) for k, n in enumerate(KIND_NAMES)))).alias("kind")
    return pages.select("doc_id").distinct().select("doc_id", kinds).select("doc_id", "kind.*").join(every.select("doc_id", "kind_no"), ["doc_id", "kind_no"], "left_anti")


def annotation_kinds(pages: DataFrame) -> DataFrame:
    """One row per document and question kind (``kind_no``, see KIND_NAMES) that the pages answer."""
    text = tx.text_of(F.col("page_text"))
    lit = F.lit
    # every kind of question reads the pages, so they are made, and their units looked up, once
    pages = back = materialize(unit_lookback(pages), "pages")
    first = pages.groupBy("doc_id").agg(F.min_by(F.struct("page_text", "page_id"), "page_index").alias("p"))
    doc = first.select(
        "doc_id",
        tx.company(F.col("doc_id")).alias("company"),
        tx.report_year(F.col("doc_id"), F.col("p.page_text")).alias("year"),
        tx.text_of(F.col("p.page_text")).alias("first_text"),
        F.col("p.page_id").alias("first_id"),
    ).withColumn("title", tx.report_title(F.col("first_text"), F.col("year")))
    shape = ["doc_id", "kind_no", "question", "answer", "evidence_pages", "evidence_text", "evidence_type", "question_type", "difficulty", "source_section", "notes", "answer_unit", "raw_answer_value", "normalized_answer", "value_evidence_text", "unit_evidence_text"]
    blank = {c: lit("") for c in shape[11:]}

    def row(df: DataFrame, no: int, **values: Column) -> DataFrame:
        return df.select("doc_id", lit(no).alias("kind_no"), *((blank | values)[c].alias(c) for c in shape[2:]))

    fact = {"evidence_type": lit("text"), "question_type": lit("fact"), "difficulty": lit("easy"), "source_section": lit("cover"), "notes": lit("v2_rule_generated; verify_manually")}
    cover = {"evidence_pages": F.col("first_id"), "evidence_text": tx.clip(F.col("first_text"), lit("年度报告"))}
    parts = [
        row(doc.where("year <> ''"), 0, question=F.concat("company", lit("这份年度报告对应的报告年度是哪一年？")), answer=F.col("year"), **cover, **fact),
        row(doc.where("title <> ''"), 1, question=F.concat("company", lit("年度报告首页或标题处显示的报告标题是什么？")), answer=F.col("title"), **cover, **fact),
    ]
    asked = doc.select("doc_id", "company", "year")
    best = lambda rows, *order: rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where("place = 1").join(asked, "doc_id")
    for no, (words, ending, section) in enumerate(METRIC_QUESTIONS, 2):
        found = None
        for k, word in enumerate(words):
            at = F.position(lit(word), text)
            window = F.substring(text, F.greatest(lit(1), at - 700), F.least(at - 1, lit(700)) + 120)
            near, note = F.regexp_extract_all(window, lit(lx.UNIT_NOTE), lit(1)), F.regexp_extract_all(window, lit(lx.UNIT_NOTE), lit(0))
            has = F.size(near) > 0
            one = back.select(
                "doc_id",
                "page_index",
                "page_id",
                lit(k).alias("word_no"),
                _number_after(text, word, 260).alias("value"),
                F.when(has, F.element_at(near, -1)).otherwise(F.col("recent_unit")).alias("unit"),
                F.when(has, tx.clip(window, F.coalesce(F.when(has, F.element_at(note, -1)), lit("")), 80, 120)).otherwise(F.col("recent_unit_text")).alias("unit_text"),
                tx.clip(text, lit(word), 120, 360).alias("evidence"),
            ).where("value is not null")
            found = one if found is None else found.unionByName(one)
        answer = F.trim(F.concat_ws(" ", "value", "unit"))
        parts.append(
            row(
                best(found, "page_index", "word_no"), no,
                question=F.concat("company", "year", lit("年年度报告披露的" + ending)), answer=answer, evidence_pages=F.col("page_id"), evidence_text=F.col("evidence"),
                evidence_type=lit("numeric"), question_type=lit("numeric"), difficulty=lit("medium"), source_section=lit(section),
                notes=lit("v2_rule_generated; numeric_value_need_verify_manually"), answer_unit=F.col("unit"), raw_answer_value=F.col("value"), normalized_answer=answer,
                value_evidence_text=F.col("evidence"), unit_evidence_text=F.col("unit_text"),
            )
        )
    at = F.position(lit("营业收入"), text)
    growth = pages.select("doc_id", "page_index", "page_id", F.when(at > 0, F.regexp_extract(F.substring(text, at, lit(360)), lx.PERCENT, 0)).alias("value"), tx.clip(text, lit("营业收入"), 120, 360).alias("evidence")).where("value <> ''")
    parts.append(
        row(
            best(growth, "page_index"), 7,
            question=F.concat("company", "year", lit("年年度报告中营业收入相比上年的增减幅度是多少？")), answer=F.col("value"), evidence_pages=F.col("page_id"), evidence_text=F.col("evidence"),
            evidence_type=lit("numeric"), question_type=lit("comparison"), difficulty=lit("medium"), source_section=lit("main_accounting_data"),
            notes=lit("v2_rule_generated; percentage_need_verify_manually"), raw_answer_value=F.col("value"), normalized_answer=F.col("value"), value_evidence_text=F.col("evidence"),
        )
    )
    clip = F.lit(None).cast("string")
    for term in reversed(lx.RISK_TERMS):
        clip = F.when(F.contains(text, lit(term)), tx.clip(text, lit(term), 40, 320)).otherwise(clip)
    risk = pages.where("page_index >= 8").select("doc_id", "page_index", "page_id", clip.alias("evidence")).where("evidence is not null")
    short = F.substring("evidence", 1, 180)
    parts.append(
        row(
            best(risk, "page_index"), 8,
            question=F.concat("company", lit("年度报告中披露的风险相关内容是什么？")), answer=short, evidence_pages=F.col("page_id"), evidence_text=F.col("evidence"),
            evidence_type=lit("text"), question_type=lit("risk_text"), difficulty=lit("medium"), source_section=lit("risk"),
            notes=lit("v2_rule_generated; verify_manually"), normalized_answer=short, value_evidence_text=F.col("evidence"),
        )
    )
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def annotation_rows(pages: DataFrame, per_doc: int = 8) -> DataFrame:
    """ANNOTATIONS made by rule from report pages (doc_id, page_id, page_index, page_text), at most ``per_doc`` a document.

    One row per document and question kind, in fixed order: year, title, five metrics,
    growth, risk. Ids number all rows in document order.
    """
    return annotations_of(annotation_kinds(pages), per_doc)


def annotations_of(every: DataFrame, per_doc: int = 8) -> DataFrame:
    """ANNOTATIONS of rows of :func:`annotation_kinds`."""
    lit = F.lit
    per = every.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("kind_no"))).where(F.col("place") <= per_doc)
    out = numbered(per, "no", "doc_id", "kind_no")
    more = {"query_id": F.format_string("cn_v2_q%04d", "no"), "is_answerable": lit("true"), "value_evidence_pages": F.when(F.col("value_evidence_text") != "", F.col("evidence_pages")).otherwise(""), "unit_evidence_pages": F.when(F.col("unit_evidence_text") != "", F.col("evidence_pages")).otherwise("")}
    return out.select(*((more[c] if c in more else F.col(c)).alias(c) for c in ANNOTATION_COLUMNS))


def from_tables(rows: DataFrame, dataset: str, limit_docs: int | None = None) -> dict[str, DataFrame]:
    """The four relations from one generic table: a page and node per row, a query where there is one.

    ``ord`` gives the rows' order; fields are columns, or those of a VARIANT column ``row``.
    """
    have, fields = set(rows.columns), dict(rows.dtypes).get("row") == "variant"
    field = lambda n: F.try_variant_get("row", f"$.{n}", "string") if fields else F.col(n).cast("string")
    pick = lambda *names, default: tx.first_filled(*(field(n) for n in names if fields or n in have), F.lit(default)) if fields or have & set(names) else F.lit(default)
    base = rows.select(
        pick("doc_id", "document_id", "pdf_id", "file_name", default="doc_001").alias("doc_id"),
        F.coalesce(F.nullif(pick("page_index", "page", "page_id", default="1").try_cast("int"), F.lit(0)), F.lit(1)).alias("page_index"),
        pick("text", "page_text", "content", "answer", default="").alias("text"),
        pick("question", "query", default="").alias("question"),
        pick("answer", default="").alias("answer"),
        pick("question_type", default="").alias("question_type"),
        "ord",
    )
    docs = base.groupBy("doc_id").agg(F.min("ord").alias("ord"))
    if limit_docs is not None:
        docs = docs.orderBy("ord").limit(limit_docs)
        base = base.join(docs.select("doc_id"), "doc_id", "left_semi")
    base = base.withColumn("page_id", F.concat("doc_id", F.lit("_p"), F.col("page_index").cast("string")))
    base = base.withColumn("no", F.row_number().over(Window.partitionBy("page_id").orderBy("ord")))
    base = base.withColumn("node_id", F.concat("page_id", F.lit("_n"), F.col("no").cast("string")))
    meta = F.create_map().cast("map<string,string>")
    null = lambda t: F.lit(None).cast(t)
    first = base.where("no = 1")
    pages = first.select("doc_id", "page_id", "page_index", F.col("text").alias("page_text"), F.lit("").alias("page_image_path"), F.lit("").alias("ocr_text"), null("double").alias("width"), null("double").alias("height"), meta.alias("metadata"), "ord")
    nodes = base.select("node_id", "doc_id", "page_id", F.lit("paragraph").alias("node_type"), null("array<double>").alias("bbox"), "text", F.lit("").alias("image_path"), null("string").alias("parent_id"), F.col("no").cast("int").alias("reading_order"), F.lit("table").alias("source"), null("double").alias("confidence"), F.create_map(F.lit("page_index"), F.col("page_index").cast("string")).alias("metadata"), "ord")
    asked = numbered(base.where("question <> ''"), "q", "ord")
    queries = asked.select(F.concat(F.lit(f"{dataset}_q"), F.col("q").cast("string")).alias("query_id"), F.lit(dataset).alias("dataset"), "doc_id", "question", "answer", "question_type", F.array("page_id").alias("evidence_page_ids"), F.array("node_id").alias("evidence_node_ids"), F.array().cast("array<array<double>>").alias("evidence_bboxes"), F.lit(True).alias("is_answerable"), meta.alias("metadata"))
    sizes = pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("num_pages"))
    documents = docs.join(sizes, "doc_id").select("doc_id", F.lit(dataset).alias("dataset"), F.col("doc_id").alias("title"), F.lit("").alias("source_path"), F.lit("").alias("domain"), F.lit("").alias("language"), "num_pages", meta.alias("metadata"))
    assert [f.name for f in PAGES.fields] == pages.columns
    return {"documents": documents, "pages": pages, "nodes": nodes, "queries": queries}
