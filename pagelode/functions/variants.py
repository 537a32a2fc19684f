"""Values of mixed types as VARIANT: what a JSON text holds, or the text itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant_of(c: Column, kind: str = "string") -> Column:
    """A JSON text as its value, any other text as a string, other columns as they are; null and the empty text are null."""
    if kind != "string":
        return F.to_variant_object(c) if kind.startswith(("array", "map", "struct")) else c.cast("variant")
    return F.coalesce(F.try_parse_json(F.nullif(c, F.lit(""))), F.nullif(c, F.lit("")).cast("variant"))


def text_of(v: Column) -> Column:
    """A string as it is, every other value as JSON."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def fields_of(df: DataFrame, column: str) -> list[str]:
    """Names of the fields of the objects in a column, from one aggregation of their schemas."""
    found = df.agg(F.schema_of_variant_agg(column).alias("s")).first()["s"]
    return top_fields(found) if found else []


def top_fields(schema: str) -> list[str]:
    """Names in ``OBJECT<a: KIND, `b c`: KIND, ...>``, those of the outermost object."""
    if not schema.startswith("OBJECT<"):
        return []
    names, depth, name, quoted, reading = [], 0, "", False, True
    for ch in schema[7:-1]:
        if ch == "`":
            quoted = not quoted
        elif quoted:
            name += ch if reading else ""
        elif ch in "<>":
            depth += 1 if ch == "<" else -1
        elif depth == 0 and ch == ":" and reading:
            names.append(name)
            name, reading = "", False
        elif depth == 0 and ch == ",":
            reading = True
        elif reading and ch != " ":
            name += ch
    return names
