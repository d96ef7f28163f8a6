"""Quality section: the checks of every column, and the table of problems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions import text
from tableprobe.functions.sql import listed, percent, plain, share
from tableprobe.operators.schema import DAYS, EXACT_UNIQUE_RATE, FILLED, codes

WARNINGS = ("missing_values", "mixed_types", "invalid_dates", "possible_encoding_issue")

MIXED_CLASSES = {
    "numeric_like": codes(text.TRUTH_NUMBER, text.NUMBER, text.DAY_NUMBER),
    "boolean_like": codes(text.TRUTH_WORD),
    "date_like": codes(text.DAY),
    "text_like": codes(text.TRUTH_LETTER, text.WORDS),
}


def key_flags(facts: DataFrame) -> DataFrame:
    """Facts with possible_id and possible_primary_key."""
    # A name ending in _id also ends in id.
    id_name = "(lower(column) LIKE '%id' OR lower(column) LIKE '%codigo%' OR lower(column) LIKE '%uuid%')"
    return facts.selectExpr(
        "*",
        f"null_count = 0 AND {EXACT_UNIQUE_RATE} > 0.9 AND ({id_name} "
        "OR semantic_type IN ('numeric', 'text', 'categorical')) AS possible_id",
        "row_count > 0 AND null_count = 0 AND unique_count = row_count AS possible_primary_key",
    )


def quality_checks(
    facts: DataFrame, normalised: DataFrame, outliers: DataFrame
) -> DataFrame:
    """One row per column with every check; the figures of a check that found nothing are null."""
    invalid = f"({FILLED} - {DAYS})"
    kept = {
        label: f"CASE WHEN {share(count, FILLED)} >= 0.1 THEN {count} ELSE 0L END"
        for label, count in MIXED_CLASSES.items()
    }
    joined = key_flags(facts).join(normalised, "cid", "left").join(outliers, "cid", "left")
    judged = joined.selectExpr(
        "*",
        f"named_date AND kind != 'date' AND {FILLED} > 0 "
        f"AND {share(invalid, FILLED)} >= 0.05 AS bad_dates",
        "kind = 'text' AND non_null >= 5 AND distinct_values > distinct_normalised AS inconsistent",
        f"kind = 'text' AND {FILLED} >= 10 AND "
        + " + ".join(f"int({c} > 0)" for c in kept.values()) + " > 1 AS mixed",
    )
    return judged.selectExpr(
        "*",
        f"CASE WHEN kind = 'text' THEN code{text.EMPTY} + null_count ELSE 0L END AS empty_strings",
        f"CASE WHEN kind = 'text' THEN code{text.BLANK} ELSE 0L END AS whitespace_strings",
        "row_count > 0 AND unique_count <= 1 AS is_constant",
        f"row_count > 0 AND unique_count > 1 AND {share('top_count', 'non_null')} >= 0.95 "
        "AS near_constant",
        f"row_count > 10 AND {EXACT_UNIQUE_RATE} >= 0.75 "
        "AND semantic_type NOT IN ('numeric', 'date') AS high_cardinality",
        f"CASE WHEN bad_dates THEN {invalid} END AS invalid_dates",
        f"CASE WHEN bad_dates THEN {FILLED} END AS dates_checked",
        f"CASE WHEN bad_dates THEN {percent(invalid, FILLED)} END AS invalid_pct",
        "CASE WHEN inconsistent THEN distinct_values END AS raw_unique",
        "CASE WHEN inconsistent THEN distinct_normalised END AS normalised_unique",
        "CASE WHEN outlier_count IS NOT NULL THEN "
        f"{percent('outlier_count', 'non_null')} END AS outlier_pct",
        *[f"CASE WHEN mixed THEN {c} END AS {label}" for label, c in kept.items()],
        f"CASE WHEN mixed THEN {FILLED} END AS values_classed",
        "bad_character AS encoding_issue_hint",
    )


def _json(**fields: str) -> str:
    parts = ", ',', ".join(f"""'"{name}":', {value}""" for name, value in fields.items())
    return "concat('{', " + parts + ", '}')"


_MIXED_DETAILS = (
    """concat('{"counts":{', concat_ws(',', """
    + ", ".join(
        f"""CASE WHEN {label} > 0 THEN concat('"{label}":', {label}) END"""
        for label in MIXED_CLASSES)
    + """), '},"values":', values_classed, '}')"""
)

# Type, condition and details of each problem, in their fixed order.
CHECKS = (
    ("missing_values", "null_count > 0", "string(null_count)"),
    ("empty_strings", "empty_strings > 0", "string(empty_strings)"),
    ("whitespace_only_strings", "whitespace_strings > 0", "string(whitespace_strings)"),
    ("constant_column", "is_constant", "'true'"),
    ("near_constant_column", "near_constant", "'true'"),
    ("high_cardinality", "high_cardinality", "'true'"),
    ("possible_id", "possible_id", "'true'"),
    ("possible_primary_key", "possible_primary_key", "'true'"),
    ("invalid_dates", "invalid_dates IS NOT NULL",
     _json(invalid="invalid_dates", checked="dates_checked", pct=plain("invalid_pct", 2))),
    ("inconsistent_values", "raw_unique IS NOT NULL",
     _json(raw="raw_unique", normalised="normalised_unique")),
    ("numeric_outliers", "outlier_count IS NOT NULL",
     _json(count="outlier_count", pct=plain("outlier_pct", 2),
           lower=plain("lower_bound", 4), upper=plain("upper_bound", 4))),
    ("mixed_types", "values_classed IS NOT NULL", _MIXED_DETAILS),
    ("possible_encoding_issue", "encoding_issue_hint", "'true'"),
)


def problems(quality: DataFrame) -> DataFrame:
    """dataset_no, dataset, ordinal, column, position, type, details, severity."""
    found = ", ".join(
        f"CASE WHEN {condition} THEN named_struct('position', {position}, 'type', '{name}', "
        f"'details', {details}) END"
        for position, (name, condition, details) in enumerate(CHECKS)
    )
    return quality.selectExpr(
        "dataset_no", "dataset", "ordinal", "column", f"inline(array_compact(array({found})))"
    ).selectExpr(
        "*", f"CASE WHEN type IN ({listed(WARNINGS)}) THEN 'warning' ELSE 'info' END AS severity")


def explained(found: DataFrame, issue_catalog: DataFrame) -> DataFrame:
    """Problems with the catalog's title, meaning and so on; unknown types pass through."""
    return found.join(F.broadcast(issue_catalog), "type", "left")


def legend(found: DataFrame, issue_catalog: DataFrame) -> DataFrame:
    """The catalog entries of the types that occur."""
    return issue_catalog.join(found.select("type").distinct(), "type", "left_semi")
