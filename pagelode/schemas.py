"""Relations of the engine; empty outputs keep these types."""

from __future__ import annotations

import re

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _type(name: str) -> T.DataType:
    if name.startswith("array<"):
        return T.ArrayType(_type(name[6:-1]))
    return T.MapType(T.StringType(), T.StringType()) if name.startswith("map<") else _TYPES[name]


def _schema(text: str) -> T.StructType:
    """From ``name type, ...`` without a session."""
    return T.StructType([T.StructField(*(p if k == 0 else _type(p) for k, p in enumerate(c.strip().split(" ", 1)))) for c in re.split(r",(?![^<]*>)", text)])


_META = "metadata map<string,string>"
DOCUMENTS = _schema(f"doc_id string, dataset string, title string, source_path string, domain string, language string, num_pages int, {_META}")
PAGES = _schema(f"doc_id string, page_id string, page_index int, page_text string, page_image_path string, ocr_text string, width double, height double, {_META}, ord bigint")
NODES = _schema(
    "node_id string, doc_id string, page_id string, node_type string, bbox array<double>, text string, image_path string, parent_id string,"
    f" reading_order int, source string, confidence double, {_META}, ord bigint"
)
QUERIES = _schema(
    "query_id string, dataset string, doc_id string, question string, answer string, question_type string, evidence_page_ids array<string>,"
    f" evidence_node_ids array<string>, evidence_bboxes array<array<double>>, is_answerable boolean, {_META}"
)
EVIDENCE_METADATA = _schema(
    "candidate_sources array<string>, coverage_slots array<string>, coverage_score double, semantic_score double, semantic_rank int, page_rank int,"
    " global_rank int, structured_rank int, structured_score double, cover_rank int, localization_score double, selection_reason string,"
    " evidence_set_rank int, covered_slots_after_selection array<string>, target_slots array<string>"
)
HITS = _schema("query_id string, rank int, score double, doc_id string, page_id string, node_id string, node_type string, text string, retriever string").add(
    "metadata", EVIDENCE_METADATA
)
ANNOTATION_COLUMNS = (
    "query_id doc_id question answer evidence_pages evidence_text evidence_type is_answerable notes answer_unit raw_answer_value normalized_answer"
    " value_evidence_text unit_evidence_text value_evidence_pages unit_evidence_pages question_type difficulty source_section"
).split()
ANNOTATIONS = T.StructType([T.StructField(c, T.StringType()) for c in ANNOTATION_COLUMNS])
TABLES = {"documents": DOCUMENTS, "pages": PAGES, "nodes": NODES, "queries": QUERIES}
