"""Masking of values, redaction of texts, addresses and connection strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tableprobe.functions.sql import contains_any, quote
from tableprobe.functions.wordlists import SECRET_KEY_PARTS

STARS = "***"

# What is redacted in running text, in this order; the first group stays.
REDACTIONS = (
    r"(?i)(authorization:\s*bearer\s+)[^\s,;]+",
    r"""(?i)(api[_-]?key['"]?\s*[:=]\s*['"]?)[^'"\s,;]+""",
    r"""(?i)(password['"]?\s*[:=]\s*['"]?)[^'"\s,;]+""",
    r"""(?i)(token['"]?\s*[:=]\s*['"]?)[^'"\s,;]+""",
)
URL_CREDENTIALS = r"://([^:/@\s]+):([^@\s]+)@"


def _pattern(regex: str) -> str:
    return "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"


def mask_value(c: str) -> str:
    """Stars for null and up to eight characters, else the first and last two around stars."""
    return (
        f"CASE WHEN {c} IS NULL OR char_length({c}) <= 8 THEN '{STARS}' "
        f"ELSE concat(substring({c}, 1, 2), '{STARS}', right({c}, 2)) END"
    )


def is_secret_key(key: str) -> str:
    return contains_any(f"replace(lower({key}), '-', '_')", SECRET_KEY_PARTS)


def is_secret_name(name: str) -> bool:
    return any(part in name.lower().replace("-", "_") for part in SECRET_KEY_PARTS)


def mask_map(c: str) -> str:
    """A map of texts with the values of secret keys masked."""
    return f"transform_values({c}, (k, v) -> CASE WHEN {is_secret_key('k')} THEN {mask_value('v')} ELSE v END)"


def redact_text(c: str) -> str:
    """A text without tokens, keys, passwords and credentials in addresses."""
    for regex in REDACTIONS:
        c = f"regexp_replace({c}, {_pattern(regex)}, '$1{STARS}')"
    return f"regexp_replace({c}, {_pattern(URL_CREDENTIALS)}, '://$1:{STARS}@')"


def redact_url(c: str) -> str:
    """An address with the values of secret query keys masked; other parts stay as they are."""
    query = rf"regexp_extract({c}, r'^[^?#]*\?([^#]*)', 1)"
    value = "substring(p, locate('=', p) + 1)"
    key = "substring_index(p, '=', 1)"
    masked = (
        f"array_join(transform(split({query}, '&'), p -> CASE WHEN contains(p, '=') "
        f"AND {is_secret_key(key)} THEN concat({key}, '=', {mask_value(value)}) ELSE p END), '&')"
    )
    head = rf"regexp_extract({c}, r'^([^?#]*)', 1)"
    tail = rf"regexp_extract({c}, r'(#.*)$', 1)"
    return (
        f"CASE WHEN {query} = '' THEN {c} "
        f"ELSE concat({head}, '?', {masked}, {tail}) END"
    )


def redact_connection(c: str) -> str:
    """A connection address without its password; user and host stay."""
    return rf"regexp_replace({c}, r'^([^:/?#]+://[^:/?#@]*):[^/?#]*@', '$1:{STARS}@')"


def mask_expression(name_sql: str, data_type: T.DataType, secret: bool = False) -> str:
    """Expression that masks secret keys at any depth of a column."""
    if secret:
        if isinstance(data_type, T.StringType):
            return mask_value(name_sql)
        if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
            return mask_value(f"to_json({name_sql})")
        return mask_value(f"string({name_sql})")
    if isinstance(data_type, T.StructType):
        fields = ", ".join(
            f"{mask_expression(f'{name_sql}.{quote(f.name)}', f.dataType, is_secret_name(f.name))} "
            f"AS {quote(f.name)}" for f in data_type.fields
        )
        return f"CASE WHEN {name_sql} IS NOT NULL THEN struct({fields}) END"
    if isinstance(data_type, T.ArrayType) and _nested(data_type.elementType):
        inner = mask_expression("item", data_type.elementType)
        return f"transform({name_sql}, item -> {inner})"
    if isinstance(data_type, T.MapType) and isinstance(data_type.keyType, T.StringType):
        if isinstance(data_type.valueType, T.StringType):
            return mask_map(name_sql)
        return _masked_map(name_sql, data_type.valueType)
    return name_sql


def _masked_map(c: str, value_type: T.DataType) -> str:
    """A map of any values: those of secret keys become null, the others are masked inside.

    The masked form of a secret is a text, which the map's values are not, so none is shown.
    """
    inner = mask_expression("v", value_type)
    if isinstance(value_type, T.StructType):
        inner = f"CAST({inner} AS {_all_texts(value_type).simpleString()})"
    return f"transform_values({c}, (k, v) -> CASE WHEN {is_secret_key('k')} THEN NULL ELSE {inner} END)"


def _all_texts(data_type: T.DataType) -> T.DataType:
    """The type of a masked value: secret fields are texts."""
    if isinstance(data_type, T.StructType):
        return T.StructType([
            T.StructField(f.name, T.StringType() if is_secret_name(f.name) else _all_texts(f.dataType))
            for f in data_type.fields])
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(_all_texts(data_type.elementType))
    if isinstance(data_type, T.MapType):
        return T.MapType(data_type.keyType, _all_texts(data_type.valueType))
    return data_type


def _nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StructType, T.ArrayType, T.MapType))


def mask_columns(df: DataFrame) -> DataFrame:
    """A table with the values of secret-named columns, fields and map keys masked."""
    return df.selectExpr(*[
        f"{mask_expression(quote(f.name), f.dataType, is_secret_name(f.name))} AS {quote(f.name)}"
        for f in df.schema.fields
    ])
