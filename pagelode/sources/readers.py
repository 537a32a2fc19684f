"""Scans: relations, hits, table-like files, PDFs, annotations."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.variants import fields_of, variant_of
from ..schemas import HITS, TABLES
from ..store import numbered
from . import files
from .files import exists

#: Annotation files, the first that exists is read.
ANNOTATION_FILES = ("qa_annotations_v2_reviewed.csv", "qa_annotations_v2_reviewed.xlsx", "qa_annotations_v2.csv", "qa_annotations_v2.xlsx", "qa_annotations.csv", "qa_annotations.xlsx")


def decode_json(c: Column, kind: T.DataType) -> Column:
    """A JSON text as ``kind``. What cannot be decoded is kept as it is where the type can hold it: in a map under ``_text``, in an array of strings as one value."""
    if not isinstance(kind, T.StructType | T.ArrayType | T.MapType):
        return F.from_json(c, T.StructType([]))
    found = F.from_json(c, kind)
    kept = None
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
        kept = F.create_map(F.lit("_text"), c)
        found = F.when(F.trim(c).startswith("{"), found)  # a text that is no object must not become an empty map
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        kept = F.array(c)
        found = F.when(F.trim(c).startswith("["), found)
    return found if kept is None else F.when(c.isNotNull() & (c != ""), F.coalesce(found, kept))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``: missing ones null, JSON texts decoded where the schema nests."""
    types = dict(df.dtypes)
    out = []
    for f in schema.fields:
        if f.name not in types:
            c = F.lit(None).cast(f.dataType)
        elif types[f.name] == "string" and isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType):
            c = decode_json(F.col(f.name), f.dataType)
        elif types[f.name] != "variant" and isinstance(f.dataType, T.VariantType):
            c = variant_of(F.col(f.name), types[f.name])
        else:
            c = F.col(f.name).cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"Missing required table: {path}")
    return conform(spark.read.parquet(path), schema)


def read_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four relations of a processed data set, lazily."""
    return {name: read_table(spark, f"{folder}/{name}.parquet", schema) for name, schema in TABLES.items()}


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, HITS)


def with_variants(schema: T.StructType, *names: str) -> T.StructType:
    """The schema with some columns (``metadata`` if none is named) as VARIANT, which keeps nested and mixed values as they are."""
    chosen = set(names or ("metadata",))
    return T.StructType([T.StructField(f.name, T.VariantType() if f.name in chosen else f.dataType) for f in schema.fields])


def visible_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length) of the files below a folder, but for those that Spark hides; large folders are listed by tasks."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return found.select("path", "length")


def read_tables(spark: SparkSession, folder: str) -> DataFrame | None:
    """(row VARIANT, _source_file, ord) of all rows of the table files below a folder, None without such files.

    Every format is one scan, however many files there are: ``.jsonl`` (an object a line),
    ``.json`` (an array, an object with an array ``data``, or an object), ``.csv`` (a scan for
    each set of column names) and ``.parquet`` (schemas merged). Lines and files that hold no
    JSON are left out, as the data sets mix formats. ``ord`` follows the files' paths and the rows in them.
    """
    if not exists(spark, folder):
        return None
    parts = [p for p in (_json_lines(spark, folder), _json_files(spark, folder), *_csv_files(spark, folder), _parquet_files(spark, folder)) if p is not None]
    if not parts:
        return None
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return numbered(rows.where("row is not null"), "ord", "_source_file", "at").select("row", "_source_file", "ord")


def _has(spark: SparkSession, folder: str, glob: str) -> bool:
    return visible_files(spark, folder, glob).limit(1).count() > 0


def _texts(spark: SparkSession, folder: str, glob: str, whole: bool) -> DataFrame:
    """value, _source_file, at (begin of the block, then the row's place in the scan)."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=whole)
    return found.select("value", F.col("_metadata.file_path").alias("_source_file"), _at(F.col("_metadata.file_block_start")))


def _at(block: Column, inner: Column | None = None) -> Column:
    return F.struct(block.alias("block"), F.monotonically_increasing_id().alias("row"), (F.lit(0) if inner is None else inner).alias("inner")).alias("at")


def _json_lines(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame | None:
    if not _has(spark, folder, glob):
        return None
    rows = _texts(spark, folder, glob, False)
    return rows.select(F.try_parse_json("value").alias("row"), "_source_file", "at").where(F.schema_of_variant("row").startswith("OBJECT"))


def _json_files(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame | None:
    if not _has(spark, folder, glob):
        return None
    whole = _texts(spark, folder, glob, True).select(F.try_parse_json("value").alias("v"), "_source_file", "at")
    listed = F.coalesce(F.expr("try_variant_get(v, '$', 'array<variant>')"), F.expr("try_variant_get(v, '$.data', 'array<variant>')"), F.array("v"))
    rows = whole.where("v is not null").select(F.posexplode(listed).alias("inner", "row"), "_source_file", "at")
    return rows.where(F.schema_of_variant("row").startswith("OBJECT")).select("row", "_source_file", F.col("at").withField("inner", F.col("inner")).alias("at"))


def _csv_files(spark: SparkSession, folder: str, glob: str = "*.csv") -> list[DataFrame]:
    """One scan for each header (the first line of a file)."""
    if not _has(spark, folder, glob):
        return []
    lines = _texts(spark, folder, glob, False)
    heads = lines.groupBy("_source_file").agg(F.min_by("value", "at").alias("head")).groupBy("head").agg(F.collect_list("_source_file").alias("files"))
    out = []
    for r in heads.orderBy("head").collect():  # a row for each set of columns
        df = spark.read.csv(sorted(map(unquote, r["files"])), header=True, multiLine=True, escape='"')
        row = F.to_variant_object(F.struct(*(F.col(f"`{c}`").alias(c.lstrip("\ufeff")) for c in df.columns)))
        out.append(df.select(row.alias("row"), F.col("_metadata.file_path").alias("_source_file"), _at(F.lit(0).cast("long"))))
    return out


def _parquet_files(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame | None:
    if not _has(spark, folder, glob):
        return None
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("mergeSchema", True).parquet(folder)
    row = F.to_variant_object(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    return df.select(row.alias("row"), F.col("_metadata.file_path").alias("_source_file"), F.struct(F.lit(0).cast("long").alias("block"), F.col("_metadata.row_index").alias("row"), F.lit(0).alias("inner")).alias("at"))


def read_any(spark: SparkSession, path: str) -> DataFrame | None:
    """One file or folder of a kind that :func:`read_tables` knows, with columns for the fields that occur; None if it cannot be read."""
    readers = {".jsonl": _json_lines, ".json": _json_files, ".csv": _csv_files, ".parquet": _parquet_files}
    kind = os.path.splitext(path)[1].lower()
    if kind not in readers or not exists(spark, path):
        return None
    try:
        found = readers[kind](spark, path, "*")
        found = (found[0] if found else None) if isinstance(found, list) else found
        if found is None:
            return None
        names = fields_of(found, "row")
    except Exception:  # unreadable files are skipped, as the data sets mix formats
        return None
    return found.select(*(F.try_variant_get("row", f"$['{n}']", "string").alias(n) for n in names), "_source_file")


def read_pdf_pages(spark: SparkSession, folder: str, blocks: bool = True) -> DataFrame:
    """path, page_index, page_text, blocks of the PDFs below a folder; needs PyMuPDF on the workers.

    Files are dealt to tasks by their sizes and come as bytes, so they may lie anywhere
    Spark reads. Without ``blocks`` pages are not taken apart. A page whose blocks cannot be
    read keeps its text; a file that cannot be read gives no rows.
    """
    schema = "path string, page_index int, page_text string, blocks array<struct<bbox:array<double>,text:string>>"

    def parse(batches: Iterator) -> Iterator:
        import fitz
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with fitz.open(stream=bytes(content), filetype="pdf") as pdf:
                        for no, page in enumerate(pdf, 1):
                            found = []
                            try:
                                for b in page.get_text("blocks") if blocks else ():
                                    if len(b) >= 5 and str(b[4]).strip():
                                        found.append({"bbox": [float(x) for x in b[:4]], "text": str(b[4])})
                            except Exception:
                                found = []
                            rows.append((path, no, page.get_text("text"), found))
                except Exception:
                    continue
            yield pd.DataFrame(rows, columns=["path", "page_index", "page_text", "blocks"])

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")  # files are large
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(folder)
    return found.select("path", "content").mapInPandas(parse, schema)


def read_annotations(spark: SparkSession, folder: str) -> tuple[DataFrame, str] | None:
    """The first annotation file of a folder, and its name."""
    for name in ANNOTATION_FILES:
        path = f"{folder}/{name}"
        if not exists(spark, path):
            continue
        if name.endswith(".csv"):
            df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
            return df.toDF(*(c.lstrip("\ufeff") for c in df.columns)), name
        import pandas as pd

        sheet = pd.read_excel(io.BytesIO(files.read_bytes(spark, path)), dtype=str).fillna("")
        return spark.createDataFrame(sheet), name
    return None


_models: dict[tuple, object] = {}


def loaded_model(make, model: str, max_seq_length: int | None):
    """The model, loaded once per Python worker: workers outlive tasks."""
    key = (model, max_seq_length)
    if key not in _models:
        net = make(model)
        if max_seq_length:
            net.max_seq_length = max_seq_length
        _models[key] = net
    return _models[key]


def sentence_encoder(model: str, batch_size: int = 8, max_seq_length: int | None = None):
    """A function (df, text column) -> df with unit vectors in ``vector``, or None without the library.

    The model is loaded once per Python worker; MDR_DISABLE_SENTENCE_TRANSFORMERS=1 turns it off,
    and models are taken from the local cache unless MDR_ALLOW_MODEL_DOWNLOAD=1.
    """
    if os.environ.get("MDR_DISABLE_SENTENCE_TRANSFORMERS") == "1":
        return None
    try:
        import sentence_transformers  # noqa: F401
    except ImportError:
        return None

    def encode(df: DataFrame, column: str) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

        def run(batches):
            if os.environ.get("MDR_ALLOW_MODEL_DOWNLOAD") != "1":
                os.environ["HF_HUB_OFFLINE"] = "1"
            from sentence_transformers import SentenceTransformer

            net = loaded_model(SentenceTransformer, model, max_seq_length)
            for pdf in batches:
                vectors = net.encode(pdf[column].fillna("").tolist(), batch_size=batch_size, normalize_embeddings=True)
                yield pdf.assign(vector=[v.tolist() for v in vectors])

        return df.mapInPandas(run, schema)

    encode.label = f"dense:sentence_transformers:{model}" + (f":maxlen={max_seq_length}" if max_seq_length else "")
    return encode
