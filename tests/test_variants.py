"""VARIANT values, one scan a format, files on any file system."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.functions import variants as va
from pagelode.schemas import NODES
from pagelode.sources import files
from pagelode.sources import prepare as pp
from pagelode.sources import readers as rd
from pagelode.sources.files import Place


def test_mixed_values_survive(spark, tmp_path):
    texts = ['{"a": {"b": [1, 2.5, null, "x"]}, "c": true}', "[1, {\"d\": 2}]", "plain {text", "7", "null", '"quoted"', "", None]
    schema = T.StructType([T.StructField("no", T.LongType()), T.StructField("metadata", T.StringType())])
    df = spark.createDataFrame(list(enumerate(texts)), schema)
    df.write.parquet(str(tmp_path / "texts"))
    kinds = rd.with_variants(schema)
    rd.read_table(spark, str(tmp_path / "texts"), kinds).write.parquet(str(tmp_path / "variants"))
    back = rd.read_table(spark, str(tmp_path / "variants"), kinds)
    got = {r["no"]: r["t"] for r in back.select("no", va.text_of(F.col("metadata")).alias("t")).collect()}
    for no in (0, 1):
        assert json.loads(got[no]) == json.loads(texts[no])
    assert [got[k] for k in range(2, 8)] == ["plain {text", "7", "null", "quoted", None, None]
    deep = back.select(F.try_variant_get("metadata", "$.a.b[3]", "string").alias("x")).where("x is not null").collect()
    assert [r["x"] for r in deep] == ["x"]


def test_native_columns_become_variants(spark):
    df = spark.createDataFrame([("n1", {"page_index": "3"})], "node_id string, metadata map<string,string>")
    out = rd.conform(df, rd.with_variants(NODES))
    assert out.select(F.try_variant_get("metadata", "$.page_index", "int").alias("p")).first()["p"] == 3


def test_top_fields():
    assert va.top_fields("OBJECT<a: BIGINT, `b, c`: OBJECT<x: STRING, y: ARRAY<VOID>>, d: DECIMAL(3,1)>") == ["a", "b, c", "d"]
    assert va.top_fields("ARRAY<STRING>") == va.top_fields("VOID") == []


def test_many_files_one_scan_a_format(spark, tmp_path):
    raw = tmp_path / "raw"
    for k in range(10):
        os.makedirs(raw / f"d{k}")
    for k in range(1500):
        (raw / f"d{k % 10}" / f"f{k:04}.jsonl").write_text(f'{{"doc_id": "j{k}", "page": 1, "text": "one"}}\nbroken\n{{"doc_id": "j{k}", "page": 2.0, "text": {{"deep": [{k}]}}}}\n')
    for k in range(200):
        (raw / f"d{k % 10}" / f"g{k:04}.json").write_text(json.dumps([{"doc_id": f"a{k}", "question": "q?"}] if k % 2 else {"data": [{"doc_id": f"a{k}"}, {"doc_id": f"a{k}", "text": None}]}))
    for k in range(60):
        (raw / f"d{k % 10}" / f"h {k:04}%+.csv").write_text('doc_id,text\nc,"two\nlines, ""quoted"""\n' if k % 2 else "﻿doc_id,content,page\nx,y,3\n")
    (raw / "bad.json").write_text("{")
    (raw / "note.txt").write_text("nothing")
    spark.createDataFrame([("p", 4)], "doc_id string, page int").write.parquet(str(raw / "t"))
    rows = rd.read_tables(spark, str(raw))
    counted = {r["k"]: r["n"] for r in rows.groupBy(F.regexp_extract("_source_file", r"\.([a-z]+)$", 1).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counted == {"jsonl": 3000, "json": 300, "csv": 60, "parquet": 1}
    t = pp.from_tables(rows, "set")
    pages = {(r["doc_id"], r["page_index"]): r["page_text"] for r in t["pages"].collect()}
    assert pages["j7", 1] == "one" and json.loads(pages["j7", 2]) == {"deep": [7]}
    assert pages["c", 1] == 'two\nlines, "quoted"' and pages["x", 3] == "y" and pages["p", 4] == ""
    assert t["queries"].count() == 100
    # rows of a file keep their order, files that of their paths
    order = [r["_source_file"] for r in rows.orderBy("ord").collect()]
    assert order == sorted(order)
    # a scan a format: the plan does not grow with the files
    plan = rd._json_lines(spark, str(raw))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and len(rd._csv_files(spark, str(raw))) == 2


def test_no_tables(spark, tmp_path):
    assert rd.read_tables(spark, str(tmp_path / "none")) is None
    (tmp_path / "a.txt").write_text("x")
    assert rd.read_tables(spark, str(tmp_path)) is None
    assert rd.read_any(spark, str(tmp_path / "a.txt")) is None and rd.read_any(spark, str(tmp_path / "no.csv")) is None


def test_places(spark, tmp_path):
    root = Place(f"file://{tmp_path}/x", spark)
    (root / "a.txt").write_text("one é\n")
    (root / "a.txt").write_text("two")
    assert (root / "a.txt").read_text() == "two" and root.names() == ["a.txt"] and root.is_dir()
    with pytest.raises(RuntimeError), files.text_writer(spark, str(root / "b.txt")) as write:
        write("lost")
        raise RuntimeError
    assert root.names() == ["a.txt"]
    with files.text_writer(spark, str(root / "c.txt"), most=3) as write:
        for k in range(5):
            write(f"{k}\n")
    assert files.read_bytes(spark, str(root / "c.txt")) == b"0\n1\n2\n3\n4\n"
    assert (root / "c.txt").parent == root == Place(f"{tmp_path}/x", spark) and not Place(f"{tmp_path}/y", spark).exists()
    root.delete()
    assert not root.exists() and root.names() == []
