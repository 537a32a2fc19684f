"""The built-in demo data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES

# Two documents, three pages, four nodes, three questions.
_DOCUMENTS = [("demo_finance_2025", "2025 Annual Report Demo", "annual_report", 2), ("demo_contract_001", "Contract Review Demo", "contract", 1)]
_PAGES = [
    ("demo_finance_2025", 1, "示例科技2025年营业收入为12.8亿元，同比增长18%。研发投入为2.1亿元。"),
    ("demo_finance_2025", 2, "现金流量表显示，经营活动产生的现金流量净额为3.4亿元。"),
    ("demo_contract_001", 1, "本合同服务期限为2025年1月1日至2025年12月31日。付款方式为按季度支付。"),
]
_NODES = [
    ("demo_finance_2025", 1, 1, "paragraph", None, "示例科技2025年营业收入为12.8亿元，同比增长18%。"),
    ("demo_finance_2025", 1, 2, "table", [80.0, 120.0, 520.0, 360.0], "主要财务指标：营业收入12.8亿元；研发投入2.1亿元。"),
    ("demo_finance_2025", 2, 1, "paragraph", None, "经营活动产生的现金流量净额为3.4亿元。"),
    ("demo_contract_001", 1, 1, "paragraph", None, "本合同服务期限为2025年1月1日至2025年12月31日。"),
]
_QUERIES = [
    ("demo_q1", "demo_finance_2025", "示例科技2025年营业收入是多少？", "12.8亿元", "numeric", ["p1"], ["p1_n1", "p1_n2"]),
    ("demo_q2", "demo_finance_2025", "经营活动产生的现金流量净额是多少？", "3.4亿元", "numeric", ["p2"], ["p2_n1"]),
    ("demo_q3", "demo_contract_001", "合同服务期限是什么？", "2025年1月1日至2025年12月31日", "fact", ["p1"], ["p1_n1"]),
]


def demo_tables(spark: SparkSession, limit_docs: int | None = None) -> dict[str, DataFrame]:
    """The demo's relations, of the first ``limit_docs`` documents if given."""
    docs = _DOCUMENTS[:limit_docs]
    kept = {d[0] for d in docs}
    rows = {
        "documents": [(i, "demo", title, "", domain, "zh", n, {}) for i, title, domain, n in docs],
        "pages": [(d, f"{d}_p{p}", p, text, "", "", None, None, {}, k) for k, (d, p, text) in enumerate(_PAGES) if d in kept],
        "nodes": [
            (f"{d}_p{p}_n{n}", d, f"{d}_p{p}", kind, box, text, "", None, n, "demo", 1.0, {"page_index": str(p)}, k)
            for k, (d, p, n, kind, box, text) in enumerate(_NODES)
            if d in kept
        ],
        "queries": [
            (q, "demo", d, question, answer, kind, [f"{d}_{p}" for p in pages], [f"{d}_{n}" for n in nodes], [], True, {})
            for q, d, question, answer, kind, pages, nodes in _QUERIES
            if d in kept
        ],
    }
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in TABLES.items()}


def with_order(df: DataFrame) -> DataFrame:
    """Add ``ord`` where a table lacks it, from the order of its files and rows."""
    return df if "ord" in df.columns else df.withColumn("ord", F.monotonically_increasing_id())
