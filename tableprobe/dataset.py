"""Input tables and the small column dimension that every report section is keyed by."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tableprobe.functions.sql import quote

# Kinds of column. WHOLE and REAL are the numeric ones.
WHOLE, REAL, DATE, BOOLEAN, TEXT, OTHER = "whole", "real", "date", "boolean", "text", "other"


@dataclass(frozen=True)
class Dataset:
    """A named table with the record of where it came from."""

    name: str
    df: DataFrame
    source: dict[str, Any] = field(default_factory=lambda: {"type": "file"})
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class ColumnRef:
    """One column of one dataset; `cid` numbers the columns of a whole profile."""

    cid: int
    dataset_no: int
    dataset: str
    ordinal: int
    name: str
    dtype: str
    kind: str
    data_type: T.DataType

    @property
    def sql(self) -> str:
        return quote(self.name)

    @property
    def numeric(self) -> bool:
        return self.kind in (WHOLE, REAL)


def kind_of(data_type: T.DataType, decimal_as_categorical: bool = False) -> str:
    if isinstance(data_type, T.IntegralType):
        return WHOLE
    if isinstance(data_type, T.FractionalType):
        if isinstance(data_type, T.DecimalType) and decimal_as_categorical:
            return OTHER
        return REAL
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    if type(data_type).__name__ == "TimeType":
        return DATE
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return TEXT
    return OTHER


def text_form(ref: ColumnRef) -> str:
    """The value as text; nested values as JSON, bytes as hexadecimal digits."""
    if isinstance(ref.data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return f"to_json({ref.sql})"
    if isinstance(ref.data_type, T.BinaryType):
        return f"hex({ref.sql})"
    return f"cast({ref.sql} AS string)"


def column_refs(datasets: list[Dataset], decimal_as_categorical: bool = False) -> list[ColumnRef]:
    refs: list[ColumnRef] = []
    for number, dataset in enumerate(datasets):
        for ordinal, f in enumerate(dataset.df.schema.fields):
            refs.append(
                ColumnRef(
                    cid=len(refs), dataset_no=number, dataset=dataset.name, ordinal=ordinal,
                    name=f.name, dtype=f.dataType.simpleString(),
                    kind=kind_of(f.dataType, decimal_as_categorical), data_type=f.dataType,
                )
            )
    return refs


def unique_names(names: list[str]) -> list[str]:
    """Number the repeats of a name: a, a_2, a_3."""
    seen: Counter[str] = Counter()
    result = []
    for name in names:
        seen[name] += 1
        result.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return result
