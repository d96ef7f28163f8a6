"""JSON files as documents, and the records inside them, chosen for each document by itself.

Documents are VARIANT values, so they need no common schema. A file holds either whole values in each of its
lines, one or several, or one document that may take many lines; anything else is an error. The records of
all documents are written as lines of JSON, from which Spark reads one schema.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.sql import literal
from tableprobe.functions.wordlists import RECORD_PATHS
from tableprobe.sources.records import flatten
from tableprobe.staging import Stage

#: So many files are named in an error.
NAMED = 5


def _raw(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: A string of JSON, as a pattern without a step back.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def bare(text: str) -> str:
    """The JSON text with its strings emptied."""
    return f"regexp_replace({text}, {_raw(STRING)}, '\"\"')"


def brackets(text: str) -> str:
    """How often a JSON text opens or closes an object or a list, strings aside."""
    return f"length(regexp_replace({text}, {_raw(STRING + r'|[^"{}\[\]]++')}, ''))"


def is_one_value(text: str, value: str) -> str:
    """Whether a text is one JSON value and nothing else, `value` being what `try_parse_json` gives for it.

    The parser stops behind the first value. If that one is an object or a list, it has all brackets of the
    text, which ends with one; else the text is a single word.
    """
    nested = f"""({brackets(text)} = {brackets(f"to_json({value})")} AND {text} RLIKE {_raw(r'[}\]]\s*\z')})"""
    word = f"({bare(text)} RLIKE {_raw(r'^\s*(?:""|[^\s"{}\[\],:]+)\s*\z')})"
    return f"coalesce({value} IS NOT NULL AND CASE WHEN {text} RLIKE {_raw(r'^\s*[{\[]')} THEN {nested} ELSE {word} END, false)"


def parsed(texts: DataFrame) -> DataFrame:
    """The texts (column `value`) with `doc`, their first JSON value or null. As a column it is made once a
    text, however many tests look at it."""
    return texts.selectExpr("*", "try_parse_json(value) AS doc")


def is_object(value: str) -> str:
    return f"(try_variant_get({value}, '$', 'struct<>') IS NOT NULL)"


def is_filled(value: str) -> str:
    return f"({value} IS NOT NULL AND NOT is_variant_null({value}))"


def at(value: str, path: str) -> str:
    """The value at a dotted path, null where the path leaves the objects."""
    keys = "".join('["' + key.replace('"', '\\"') + '"]' for key in path.split("."))
    return f"try_variant_get({value}, {literal('$' + keys)}, 'variant')"


def items(value: str) -> str:
    return f"try_variant_get({value}, '$', 'array<variant>')"


def lists_objects(value: str) -> str:
    """Whether a value is a list whose first item that is not null is an object; or that has no such item.
    The lists of one item name what several tests look at, so that it is made once."""
    first = f"get(filter(i, x -> {is_filled('x')}), 0)"
    return f"exists(array({items(value)}), i -> i IS NOT NULL AND exists(array({first}), f -> f IS NULL OR {is_object('f')}))"


def chosen(value: str, data_path: str | None) -> str:
    """Where the records of a document are: at the given path; else at the first default path that holds a
    list of objects; else whatever the last default path holds; else the document."""
    given = f"CASE WHEN {is_filled(at(value, data_path))} THEN {at(value, data_path)} END" if data_path else "CAST(NULL AS variant)"
    tests = " ".join(f"WHEN {lists_objects(at(value, p))} THEN {at(value, p)}" for p in RECORD_PATHS)
    last = at(value, RECORD_PATHS[-1])
    return f"coalesce({given}, CASE {tests} WHEN {is_filled(last)} THEN {last} END, {value})"


def record_texts(value: str) -> str:
    """The records in a chosen value as JSON texts: an object is one, a list of objects gives its objects, any
    other value or item becomes the field `value`. Only the JSON text of an object starts with a brace."""
    wrapped = lambda v: f"concat('{{\"value\":', coalesce(to_json({v}), 'null'), '}}')"
    return f"""CASE WHEN {is_object(value)} THEN array(to_json({value}))
        WHEN {lists_objects(value)} THEN filter(transform({items(value)}, x -> to_json(x)), t -> startswith(t, '{{'))
        WHEN {items(value)} IS NOT NULL THEN transform({items(value)}, x -> {wrapped('x')})
        ELSE array({wrapped(value)}) END"""


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of lines that hold several; `broken` where a line is not a row of values."""
    scan = json.JSONDecoder().raw_decode
    for batch in batches:
        out: list[tuple[str, str, bool]] = []
        for file, line in zip(batch["file"].to_pylist(), batch["value"].to_pylist(), strict=True):
            place, found = 0, []
            try:
                while True:
                    while place < len(line) and line[place] in " \t\r\n":
                        place += 1
                    if place == len(line):
                        break
                    _, stop = scan(line, place)
                    found.append((file, line[place:stop], False))
                    place = stop
            except ValueError:
                found = [(file, line, True)]
            out += found
        files, values, broken = zip(*out, strict=True) if out else ((), (), ())
        yield pa.record_batch([pa.array(files, pa.string()), pa.array(values, pa.string()), pa.array(broken, pa.bool_())],
                              ["file", "value", "broken"])


def _filled_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).selectExpr("_metadata.file_path AS file", "value").where(r"value RLIKE '\\S'")


def documents(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """value: the JSON texts of all documents, and whether each is a line of a file and an object without any
    of the default record paths, so that Spark's own reader gives the same."""
    first_keys = sorted({p.split(".")[0] for p in RECORD_PATHS})
    plain = f"(doc IS NOT NULL AND value RLIKE {_raw(r'^\s*[{]')} AND " + " AND ".join(f"{at('doc', k)} IS NULL" for k in first_keys) + ")"
    judged = parsed(_filled_lines(spark, path)).selectExpr("file", f"{is_one_value('value', 'doc')} AS one", f"{plain} AS plain")
    judged = judged.groupBy("file").agg(F.expr("count_if(NOT one) AS bad"), F.expr("bool_and(plain) AS plain"))
    # One row a file, of which Spark's listing holds a row in the driver as well.
    files = judged.collect()
    names = lambda rows: [unquote(r.file) for r in rows]
    by_line, others = names(r for r in files if not r.bad), names(r for r in files if r.bad)
    if not others:
        return _filled_lines(spark, path).select("value"), all(r.plain for r in files)
    whole = spark.read.text(others, wholetext=True).selectExpr("_metadata.file_path AS file", "value")
    whole = Stage(spark).table("whole", lambda: parsed(whole).selectExpr("file", "value", f"{is_one_value('value', 'doc')} AS one"))
    parts = [whole.where("one").select("value")]
    if by_line:
        parts.append(_filled_lines(spark, by_line).select("value"))
    several = names(whole.where("NOT one").select("file").collect())
    if several:
        split = _filled_lines(spark, several).mapInArrow(_split, "file string, value string, broken boolean")
        split = Stage(spark).table("split", lambda: parsed(split).selectExpr(
            "file", "value", f"broken OR NOT {is_one_value('value', 'doc')} AS broken"))
        broken = names(split.where("broken").select("file").distinct().limit(NAMED).collect())
        if broken:
            raise ValueError(f"neither one JSON document nor JSON values in each line: {', '.join(sorted(broken))}")
        parts.append(split.select("value"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union, False


def tabular(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """Records of JSON texts (column `value`) under one schema, nested objects as dotted columns."""
    path = f"{Stage(spark).path}/records"
    texts.select("value").write.text(path)
    found = spark.read.json(path)
    return flatten(found) if found.columns else spark.createDataFrame([], T.StructType([]))


def read_json(spark: SparkSession, path: str, data_path: str | None = None) -> DataFrame:
    """Records of JSON files, flattened.

    Each file holds JSON values in its lines, one or several in each, or is one document, which one task
    reads; any other file is an error. Each document has its records where it has them, whatever other
    documents look like. A document of more than 128 MB, the most a VARIANT holds, is an error.
    """
    texts, plain = documents(spark, path)
    if plain and not data_path:
        found = spark.read.json(path)
        return flatten(found) if found.columns else spark.createDataFrame([], T.StructType([]))
    value = texts.selectExpr("parse_json(value) AS doc").selectExpr(f"{chosen('doc', data_path)} AS found")
    return tabular(spark, value.selectExpr(f"explode({record_texts('found')}) AS value"))
