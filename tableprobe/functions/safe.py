"""Rows as JSON that any reader takes: NaN and infinities become null at any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tableprobe.functions.sql import finite, literal, quote


def has_reals(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.StructType):
        return any(has_reals(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return has_reals(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return has_reals(data_type.valueType)
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def safe(value: str, data_type: T.DataType, depth: int = 0) -> str:
    """Expression of the value in which each real is finite or null; parts without reals stay as they are."""
    if not has_reals(data_type):
        return value
    inner = f"x{depth}"
    if isinstance(data_type, T.StructType):
        fields = ", ".join(f"{literal(f.name)}, {safe(f'{value}.{quote(f.name)}', f.dataType, depth)}" for f in data_type.fields)
        return f"CASE WHEN {value} IS NOT NULL THEN named_struct({fields}) END"
    if isinstance(data_type, T.ArrayType):
        return f"transform({value}, {inner} -> {safe(inner, data_type.elementType, depth + 1)})"
    if isinstance(data_type, T.MapType):
        return f"transform_values({value}, (k{depth}, {inner}) -> {safe(inner, data_type.valueType, depth + 1)})"
    return finite(value)


def json_row(schema: T.StructType) -> str:
    """Expression of a whole row as a JSON text, with its nulls."""
    fields = ", ".join(f"{literal(f.name)}, {safe(quote(f.name), f.dataType)}" for f in schema.fields)
    return f"to_json(named_struct({fields}), map('ignoreNullFields', 'false'))"


def json_rows(df: DataFrame) -> DataFrame:
    """record: each row as a JSON text."""
    return df.selectExpr(f"{json_row(df.schema)} AS record")
