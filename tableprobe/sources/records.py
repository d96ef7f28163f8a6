"""Records inside JSON documents: path lookup, extraction and flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.sql import quote
from tableprobe.functions.wordlists import RECORD_PATHS


def type_at(schema: T.DataType, path: str) -> T.DataType | None:
    """Type found at a dotted path, or None where the path leaves the objects."""
    current: T.DataType | None = schema
    for part in path.split("."):
        if not isinstance(current, T.StructType) or part not in current.fieldNames():
            return None
        current = current[part].dataType
    return current


def at_path(schema: T.DataType, path: str) -> str:
    """Expression for the value at a dotted path; null where there is none."""
    if type_at(schema, path) is None:
        return "cast(null AS string)"
    return ".".join(quote(p) for p in path.split("."))


def _is_object_list(data_type: T.DataType | None) -> bool:
    return isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.StructType)


def record_path(document: DataFrame, data_path: str | None = None) -> tuple[str | None, bool]:
    """Where the records are, and whether that is a list without any item.

    It is the given path, else the first default path that holds a list of objects, else whatever
    the last default path holds, else None for the document itself. A list that is empty or all
    null counts as a list of objects; the schema cannot tell it, so one pass looks at the values.
    """
    schema = document.schema
    paths = [p for p in dict.fromkeys((data_path, *RECORD_PATHS)) if p and type_at(schema, p)]
    if not paths:
        return None, False
    tests = []
    for i, path in enumerate(paths):
        value = at_path(schema, path)
        tests.append(f"bool_or({value} IS NOT NULL) AS there{i}")
        has_item = (f"exists({value}, x -> x IS NOT NULL)"
                    if isinstance(type_at(schema, path), T.ArrayType) else "true")
        tests.append(f"coalesce(bool_or({has_item}), false) AS item{i}")
    seen = document.agg(*[F.expr(t) for t in tests]).first()
    there = {path: bool(seen[f"there{i}"]) for i, path in enumerate(paths)}
    hollow = {
        path: isinstance(type_at(schema, path), T.ArrayType) and not seen[f"item{i}"]
        for i, path in enumerate(paths)
    }
    if data_path and there.get(data_path):
        return data_path, hollow[data_path]
    for path in RECORD_PATHS:
        if there.get(path) and (hollow[path] or _is_object_list(type_at(schema, path))):
            return path, hollow[path]
    last = RECORD_PATHS[-1]
    return (last, False) if there.get(last) else (None, False)


def extract_records(document: DataFrame, data_path: str | None = None) -> DataFrame:
    """One row per record. Objects become rows, scalars rows with the column `value`."""
    path, hollow = record_path(document, data_path)
    if path is None:
        return document
    if hollow:
        return document.sparkSession.createDataFrame([], T.StructType([]))
    found = type_at(document.schema, path)
    value = at_path(document.schema, path)
    if isinstance(found, T.StructType):
        return document.selectExpr(f"{value} AS r").where("r IS NOT NULL").select("r.*")
    if _is_object_list(found):
        return document.selectExpr(f"explode({value}) AS r").where("r IS NOT NULL").select("r.*")
    if isinstance(found, T.ArrayType):
        return document.selectExpr(f"explode({value}) AS value")
    return document.selectExpr(f"{value} AS value")


def flatten(records: DataFrame) -> DataFrame:
    """Nested objects as columns with dotted names; lists stay, empty objects vanish."""
    columns: list[str] = []

    def walk(struct: T.StructType, access: list[str]) -> None:
        for f in struct.fields:
            path = [*access, f.name]
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, path)
            else:
                source = ".".join(quote(p) for p in path)
                columns.append(f"{source} AS {quote('.'.join(path))}")

    walk(records.schema, [])
    return records.selectExpr(*columns)


def parse_json_column(df: DataFrame, column: str, schema: str | T.StructType) -> DataFrame:
    """Rows of a column of JSON texts, read with a known schema and flattened."""
    parsed = df.select(F.from_json(F.col(quote(column)), schema).alias("r"))
    return flatten(parsed.where("r IS NOT NULL").select("r.*"))
