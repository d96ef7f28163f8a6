"""The workload's questions as plain SQL for DuckDB, written apart from the engine.

Catalog texts are taken over as VALUES, since they are data; all rules are stated again in SQL.
"""

from __future__ import annotations

import re

from tableprobe.functions import wordlists as words
from tableprobe.functions.text import WHITESPACE_CODES
from tableprobe.plans import catalogs
from workload.inputs import ALL, INPUTS, columns_of

WS = " || ".join(f"chr({c})" for c in WHITESPACE_CODES)
WS_RUN = "'[" + "".join(f"\\x{{{c:x}}}" for c in WHITESPACE_CODES) + "]+'"
EMAIL = r"'[\p{L}\p{N}_.\-+]+@[\p{L}\p{N}_.\-]+\.[\p{L}\p{N}_]+'"
TAXPAYER = r"'\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b'"
MOMENT = (r"'\d{4}-\d{2}-\d{2}[T ]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?"
          r"(Z|[+-](0\d|1[0-7]):[0-5]\d|[+-]18:00)?'")
NUMBERS, TEXTS = ("int", "bigint", "double"), ("string",)


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def text_list(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def any_of(expression: str, parts) -> str:
    return "(" + " OR ".join(f"contains({expression}, {text(p)})" for p in parts) + ")"


def strip(c: str) -> str:
    return f"trim({c}, {WS})"


def norm(c: str) -> str:
    return f"regexp_replace(lower({strip(c)}), {WS_RUN}, ' ', 'g')"


IS_NUMBER = (r"(regexp_full_match(s, '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?') "
             "AND isfinite(try_cast(s AS DOUBLE)))")
IS_DAY = rf"""(coalesce(
    (regexp_full_match(s, '\d{{4}}-\d{{1,2}}-\d{{1,2}}') AND try_strptime(s, '%Y-%m-%d') IS NOT NULL)
    OR (regexp_full_match(s, '\d{{4}}/\d{{2}}/\d{{2}}') AND try_strptime(s, '%Y/%m/%d') IS NOT NULL)
    OR (regexp_full_match(s, '\d{{1,2}}/\d{{1,2}}/\d{{4}}')
        AND coalesce(try_strptime(s, '%d/%m/%Y'), try_strptime(s, '%m/%d/%Y')) IS NOT NULL)
    OR (regexp_full_match(s, '\d{{8}}') AND try_strptime(s, '%Y%m%d') IS NOT NULL)
    OR (regexp_full_match(s, {MOMENT}) AND try_strptime(left(s, 10), '%Y-%m-%d') IS NOT NULL),
    false))"""
TRUTH = text_list(words.TRUTH_TOKENS)
TRUTH_ALL = text_list(words.TRUTH_TOKENS + words.TRUTH_LETTERS)


def nearest(q: str) -> str:
    return f"list_sort(list(c))[CAST(floor((count(c) - 1) * {q} + 0.5) AS BIGINT) + 1]"


def column_sql(number: int, name: str, ordinal: int, column: str, kind: str) -> str:
    """One row with all figures of one column."""
    group = "number" if kind in NUMBERS else "text" if kind in TEXTS else (
        "date" if kind.startswith("timestamp") else "other")
    none = "NULL::DOUBLE"
    figures = {f: "0" for f in ("n_empty", "n_blank", "n_filled", "n_truth", "n_day", "m_number",
                                "m_truth", "m_day", "m_text", "len_all", "len_filled", "n_norm")}
    figures |= {"bad_character": "false", "personal": "false"}
    figures |= dict.fromkeys(("mean", "median", "min", "max", "std", "q1", "q3", "skew"), none)
    if group == "text":
        figures |= {
            "n_empty": "count_if(c = '')", "n_blank": "count_if(c <> '' AND s = '')",
            "n_filled": "count_if(s <> '')", "n_truth": f"count_if(lower(s) IN {TRUTH_ALL})",
            "n_day": f"count_if({IS_DAY})", "m_number": f"count_if({IS_NUMBER})",
            "m_truth": f"count_if(NOT {IS_NUMBER} AND lower(s) IN {TRUTH})",
            "m_day": f"count_if(NOT {IS_NUMBER} AND {IS_DAY})",
            "m_text": f"count_if(s <> '' AND NOT {IS_NUMBER} AND lower(s) NOT IN {TRUTH} AND NOT {IS_DAY})",
            "len_all": "coalesce(sum(length(c)), 0)",
            "len_filled": "coalesce(sum(length(c)) FILTER (s <> ''), 0)",
            "n_norm": f"count(DISTINCT {norm('c')})",
            "bad_character": "coalesce(bool_or(contains(c, chr(65533))), false)",
            "personal": "coalesce(bool_or((contains(c, '@') AND "
                        f"regexp_matches(c, {EMAIL})) OR regexp_matches(c, {TAXPAYER})), false)",
        }
    if group == "number":
        figures |= {
            "mean": "avg(c::DOUBLE)", "std": "stddev_samp(c::DOUBLE)",
            "median": "median(c::DOUBLE)", "min": "min(c)::DOUBLE", "max": "max(c)::DOUBLE",
            "q1": f"({nearest('0.25')})::DOUBLE", "q3": f"({nearest('0.75')})::DOUBLE",
            "skew": "CASE WHEN var_pop(c::DOUBLE) > 0 THEN (avg(c::DOUBLE ** 3) - 3 * avg(c::DOUBLE) "
                    "* avg(c::DOUBLE ** 2) + 2 * avg(c::DOUBLE) ** 3) / var_pop(c::DOUBLE) ** 1.5 END",
            "personal": "coalesce(bool_or(abs(c) >= 10000000000 AND abs(c) < 100000000000), false)"
            if kind != "double" else
            "coalesce(bool_or((abs(c) >= 1e10 AND abs(c) < 1e11) OR (abs(c) < 1e7 "
            f"AND regexp_matches(c::VARCHAR, {TAXPAYER}))), false)",
        }
    if any(p in column.lower() for p in words.SENSITIVE_NAME_PARTS):
        figures["personal"] = "true"
    stripped = strip(f'"{column}"') if group == "text" else "NULL"
    named_date = any(p in column.lower() for p in words.DATE_NAME_PARTS)
    listed = ", ".join(f"{expr} AS {f}" for f, expr in figures.items())
    return (
        f"SELECT {number} AS dataset_no, '{name}' AS dataset, {ordinal} AS ordinal, "
        f"'{column}' AS \"column\", '{kind}' AS dtype, '{group}' AS grp, {named_date} AS named_date, "
        "count(*) AS row_count, count(c) AS non_null, count(DISTINCT c) AS n_distinct, "
        f"(SELECT max(n) FROM (SELECT count(*) AS n FROM src_{name} WHERE \"{column}\" IS NOT NULL "
        f"GROUP BY \"{column}\")) AS top_count, {listed} "
        f"FROM (SELECT \"{column}\" AS c, {stripped} AS s FROM src_{name})"
    )


SENTINEL = "all tables"

PROFILE = """
SELECT *, named_or_personal AS possible_sensitive, row_count - non_null AS null_count,
  CASE WHEN row_count > 0 THEN round(((row_count - non_null))::DOUBLE / (row_count) * 100, 2) ELSE 0 END AS null_pct,
  round(rate, 4) AS unique_rate,
  CASE WHEN grp = 'date' THEN 'date' WHEN grp = 'number' THEN 'numeric'
    WHEN grp = 'other' THEN 'categorical'
    WHEN n_truth >= 0.95 * greatest(non_null, 1) THEN 'boolean'
    WHEN n_day >= 0.8 * greatest(non_null, 1) THEN 'date'
    WHEN n_filled > 0 AND len_filled / n_filled > 60 THEN 'long_text'
    WHEN (n_filled > 0 AND len_filled / n_filled > 24) OR rate > 0.5 THEN 'text'
    ELSE 'categorical' END AS semantic_type
FROM (SELECT *, personal AS named_or_personal,
        n_distinct + CASE WHEN non_null < row_count THEN 1 ELSE 0 END AS unique_count,
        CASE WHEN row_count > 0 THEN (n_distinct + CASE WHEN non_null < row_count THEN 1 ELSE 0 END)
          / row_count::DOUBLE ELSE 0 END AS rate
      FROM figures)
"""

KEYS = """
SELECT *,
  null_count = 0 AND rate > 0.9 AND (lower("column") LIKE '%id' OR contains(lower("column"), 'codigo')
    OR contains(lower("column"), 'uuid') OR semantic_type IN ('numeric', 'text', 'categorical')) AS possible_id,
  row_count > 0 AND null_count = 0 AND unique_count = row_count AS possible_primary_key
FROM profile
"""

# Rows outside the bounds are counted on the data itself, one statement per numeric column.
def outlier_sql(names) -> str:
    parts = []
    for number, name in enumerate(names):
        for ordinal, (column, kind) in enumerate(columns_of(INPUTS[name][1])):
            if kind in NUMBERS:
                parts.append(
                    f"SELECT {number} AS dataset_no, {ordinal} AS ordinal, lo, hi, "
                    f'count_if("{column}" < lo OR "{column}" > hi) AS n_out '
                    f"FROM src_{name}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi "
                    f"FROM figures WHERE dataset_no = {number} AND ordinal = {ordinal} "
                    "AND q3 <> q1 AND non_null >= 8) GROUP BY lo, hi"
                )
    return " UNION ALL ".join(parts) or (
        "SELECT 0 AS dataset_no, 0 AS ordinal, 0.0 AS lo, 0.0 AS hi, 0 AS n_out WHERE false")


QUALITY = """
SELECT k.*, o.lo AS lower_bound, o.hi AS upper_bound, CASE WHEN o.n_out > 0 THEN o.n_out END AS outlier_count,
  CASE WHEN o.n_out > 0 THEN round((o.n_out)::DOUBLE / (k.non_null) * 100, 2) END AS outlier_pct,
  CASE WHEN grp = 'text' THEN n_empty + null_count ELSE 0 END AS empty_strings, n_blank AS whitespace_strings,
  k.row_count > 0 AND unique_count <= 1 AS is_constant,
  unique_count > 1 AND top_count >= 0.95 * non_null AS near_constant,
  k.row_count > 10 AND rate >= 0.75 AND semantic_type NOT IN ('numeric', 'date') AS high_cardinality,
  grp = 'text' AND named_date AND n_filled > 0 AND (n_filled - n_day) >= 0.05 * n_filled AS bad_dates,
  grp = 'text' AND non_null >= 5 AND n_distinct > n_norm AS inconsistent,
  grp = 'text' AND n_filled >= 10 AND (CASE WHEN m_number >= 0.1 * n_filled THEN 1 ELSE 0 END
    + CASE WHEN m_truth >= 0.1 * n_filled THEN 1 ELSE 0 END + CASE WHEN m_day >= 0.1 * n_filled THEN 1 ELSE 0 END
    + CASE WHEN m_text >= 0.1 * n_filled THEN 1 ELSE 0 END) > 1 AS mixed
FROM keys k LEFT JOIN outs o ON o.dataset_no = k.dataset_no AND o.ordinal = k.ordinal
"""


def _dec(e: str, places: int) -> str:
    return f"CAST(CAST(round({e}, {places}) AS DECIMAL(38, {places})) AS VARCHAR)"


PROBLEM_CASES = (
    ("missing_values", "null_count > 0", "null_count::VARCHAR"),
    ("empty_strings", "empty_strings > 0", "empty_strings::VARCHAR"),
    ("whitespace_only_strings", "whitespace_strings > 0", "whitespace_strings::VARCHAR"),
    ("constant_column", "is_constant", "'true'"),
    ("near_constant_column", "near_constant", "'true'"),
    ("high_cardinality", "high_cardinality", "'true'"),
    ("possible_id", "possible_id", "'true'"),
    ("possible_primary_key", "possible_primary_key", "'true'"),
    ("invalid_dates", "bad_dates",
     "'{\"invalid\":' || (n_filled - n_day) || ',\"checked\":' || n_filled || ',\"pct\":' || "
     + _dec("(n_filled - n_day) * 100.0::DOUBLE / n_filled", 2) + " || '}'"),
    ("inconsistent_values", "inconsistent",
     "'{\"raw\":' || n_distinct || ',\"normalised\":' || n_norm || '}'"),
    ("numeric_outliers", "outlier_count IS NOT NULL",
     "'{\"count\":' || outlier_count || ',\"pct\":' || " + _dec("outlier_pct", 2)
     + " || ',\"lower\":' || " + _dec("lower_bound", 4) + " || ',\"upper\":' || "
     + _dec("upper_bound", 4) + " || '}'"),
    ("mixed_types", "mixed",
     "'{\"counts\":{' || concat_ws(',', " + ", ".join(
         f"CASE WHEN {f} >= 0.1 * n_filled AND {f} > 0 THEN '\"{label}\":' || {f} END"
         for f, label in (("m_number", "numeric_like"), ("m_truth", "boolean_like"),
                          ("m_day", "date_like"), ("m_text", "text_like")))
     + ") || '},\"values\":' || n_filled || '}'"),
    ("possible_encoding_issue", "bad_character", "'true'"),
)
PROBLEMS = " UNION ALL ".join(
    f"SELECT dataset_no, dataset, ordinal, \"column\", {n} AS position, '{label}' AS type, "
    + ("'warning'" if label in ("missing_values", "mixed_types", "invalid_dates",
                                "possible_encoding_issue") else "'info'")
    + f" AS severity, {details} AS details FROM quality WHERE {test}"
    for n, (label, test, details) in enumerate(PROBLEM_CASES)
)

SCORED_COLUMNS = f"""
SELECT *, row_number() OVER (PARTITION BY dataset_no ORDER BY score DESC, ordinal) AS rank
FROM (SELECT *,
  CASE WHEN lower("column") IN {text_list(words.STRONG_TARGET_NAMES)} THEN 9.0::DOUBLE
       WHEN lower("column") = 'status' THEN 5
       WHEN {any_of('lower("column")', words.TARGET_HINTS)} THEN 4 ELSE 0 END
  + CASE WHEN semantic_type IN ('boolean', 'categorical') AND unique_count >= 2 AND unique_count <= 20 THEN 2 ELSE 0 END
  + CASE WHEN semantic_type = 'numeric' AND unique_count <= 20 AND unique_rate < 0.5 THEN 1.5::DOUBLE ELSE 0 END
  + CASE WHEN ordinal = max(ordinal) OVER (PARTITION BY dataset_no) THEN 0.5::DOUBLE ELSE 0 END
  - CASE WHEN possible_sensitive THEN 1 ELSE 0 END
  - CASE WHEN unique_rate > 0.8 THEN 3 ELSE 0 END
  - CASE WHEN unique_count <= 1 THEN 2 ELSE 0 END AS score
  FROM profile)
"""


def class_sql(names) -> str:
    """Counts of every value of every column that may be a target."""
    parts = []
    for number, name in enumerate(names):
        for ordinal, (column, kind) in enumerate(columns_of(INPUTS[name][1])):
            if kind.startswith(("array", "timestamp")):
                continue
            parts.append(
                f"SELECT {number} AS dataset_no, {ordinal} AS ordinal, c.\"{column}\"::VARCHAR AS value, "
                f"count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, c.\"{column}\") AS rank "
                f"FROM src_{name} c WHERE (SELECT count(*) FROM picked p WHERE p.dataset_no = {number} "
                f"AND p.ordinal = {ordinal}) > 0 "
                f"AND c.\"{column}\" IS NOT NULL GROUP BY c.\"{column}\""
            )
    return " UNION ALL ".join(parts)


TARGETS = """
SELECT d.dataset_no, d.dataset, p."column" IS NOT NULL AS detected, p."column" AS "column", p.score,
  p.problem_type, p.majority_class_pct, p.minority_class_pct,
  coalesce(p.problem_type IN ('binary_classification', 'multiclass_classification')
    AND p.majority_class_pct >= 75, false) AS imbalanced
FROM (SELECT DISTINCT dataset_no, dataset FROM profile) d LEFT JOIN (
  SELECT p.dataset_no, p."column", p.score,
    CASE WHEN semantic_type IN ('text', 'long_text') THEN
           CASE WHEN len_all > 60 * non_null THEN 'text' ELSE 'classification' END
         WHEN grp = 'number' AND unique_count > 20 AND unique_count > 0.05 * row_count THEN 'regression'
         WHEN unique_count = 2 THEN 'binary_classification'
         WHEN unique_count > 2 THEN 'multiclass_classification' ELSE 'unknown' END AS problem_type,
    round(((SELECT max(cnt) FROM classes c WHERE c.dataset_no = p.dataset_no))::DOUBLE / (non_null) * 100, 2) AS majority_class_pct,
    round(((SELECT min(cnt) FROM classes c WHERE c.dataset_no = p.dataset_no))::DOUBLE / (non_null) * 100, 2) AS minority_class_pct
  FROM picked p) p ON p.dataset_no = d.dataset_no
"""


def row_sql(names) -> str:
    """Duplicate and empty rows per dataset."""
    parts = []
    for number, name in enumerate(names):
        blank = " AND ".join(
            f"(\"{c}\" IS NULL OR {strip(chr(34) + c + chr(34))} = '')" if k in TEXTS
            else f'"{c}" IS NULL' for c, k in columns_of(INPUTS[name][1]))
        parts.append(
            f"SELECT {number} AS dataset_no, (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n "
            f"FROM src_{name} GROUP BY ALL_COLUMNS_{name} HAVING count(*) > 1)) AS duplicate_rows, "
            f"(SELECT count(*) FROM src_{name} WHERE {blank}) AS rows_fully_empty".replace(
                f"ALL_COLUMNS_{name}",
                ", ".join(f'"{c}"' for c, _ in columns_of(INPUTS[name][1]))))
    return " UNION ALL ".join(parts)


COUNTED_TYPES = ", ".join(
    f"count_if(semantic_type = '{t}') AS {t}_columns"
    for t in ("numeric", "date", "boolean", "categorical", "text", "long_text"))
SUMMARY = f"""
SELECT s.*, r.duplicate_rows, r.rows_fully_empty,
  CASE WHEN total_cells > 0 THEN round((null_cells)::DOUBLE / (total_cells) * 100, 2) ELSE 0 END AS null_pct,
  CASE WHEN row_count > 0 THEN round((r.duplicate_rows)::DOUBLE / (row_count) * 100, 2) ELSE 0 END AS duplicate_pct
FROM (SELECT dataset_no, dataset, max(row_count) AS row_count, count(*) AS column_count,
        sum(row_count)::BIGINT AS total_cells, sum(null_count)::BIGINT AS null_cells,
        max(null_pct) AS max_null_pct, count_if(possible_sensitive) AS sensitive_columns, {COUNTED_TYPES}
      FROM profile GROUP BY dataset_no, dataset) s JOIN row_facts r ON r.dataset_no = s.dataset_no
"""

PROBLEM_COUNTS = """
SELECT dataset_no, count(*) AS problem_count, count_if(severity = 'warning') AS warning_count,
  count_if(type = 'high_cardinality') AS cardinality_problems,
  count_if(type IN ('mixed_types', 'invalid_dates')) AS type_problems
FROM problems GROUP BY dataset_no
"""
DRIVERS = """
SELECT s.*, coalesce(c.problem_count, 0) AS problem_count, coalesce(c.warning_count, 0) AS warning_count,
  coalesce(c.cardinality_problems, 0) AS cardinality_problems, coalesce(c.type_problems, 0) AS type_problems,
  t.detected AS has_target, t.imbalanced AS target_imbalanced, t."column" AS target,
  1 AS dataset_count, 0 AS common_column_count, 0 AS possible_join_count, 0 AS compatible_group_count
FROM summary s JOIN targets t ON t.dataset_no = s.dataset_no
LEFT JOIN problem_counts c ON c.dataset_no = s.dataset_no
"""


def scores_sql(drivers: str) -> str:
    return f"""
SELECT *, greatest(0, least(100, data_quality_score + target_impact - imbalance_penalty - cardinality_penalty))::INT AS modelling_score
FROM (SELECT *, greatest(0, CAST(round_even(100 - null_penalty - duplicate_penalty - problem_penalty - sensitive_penalty, 0) AS INT)) AS data_quality_score
  FROM (SELECT *, least(null_pct * 1.2::DOUBLE, 30.0::DOUBLE) AS null_penalty,
      least(duplicate_pct * 1.5::DOUBLE, 20.0::DOUBLE) AS duplicate_penalty,
      least(warning_count * 3 + (problem_count - warning_count) * 1.2::DOUBLE, 30.0::DOUBLE) AS problem_penalty,
      least(sensitive_columns * 4, 16)::DOUBLE AS sensitive_penalty,
      least(cardinality_problems * 2, 10)::DOUBLE AS cardinality_penalty,
      CASE WHEN has_target THEN 12 ELSE -25 END AS target_impact,
      CASE WHEN target_imbalanced THEN 10 ELSE 0 END AS imbalance_penalty,
      35 + CASE WHEN common_column_count > 0 THEN 25 ELSE 0 END + CASE WHEN possible_join_count > 0 THEN 25 ELSE 0 END
        + CASE WHEN compatible_group_count > 0 THEN 10 ELSE 0 END AS join_score
    FROM {drivers}))"""


def parts_sql(scores: str, joined: bool) -> str:
    rows = [
        ("data_quality", "base", "100"), ("data_quality", "nulls", "-round(null_penalty, 1)"),
        ("data_quality", "duplicates", "-round(duplicate_penalty, 1)"),
        ("data_quality", "problems", "-round(problem_penalty, 1)"),
        ("data_quality", "sensitive_columns", "-round(sensitive_penalty, 1)"),
        ("modelling", "data_quality", "data_quality_score"), ("modelling", "target", "target_impact"),
        ("modelling", "imbalance", "-imbalance_penalty"),
        ("modelling", "high_cardinality", "-cardinality_penalty"),
    ]
    if joined:
        rows += [
            ("join", "base", "35"),
            ("join", "common_columns", "CASE WHEN common_column_count > 0 THEN 25 ELSE 0 END"),
            ("join", "join_candidates", "CASE WHEN possible_join_count > 0 THEN 25 ELSE 0 END"),
            ("join", "compatible_schemas", "CASE WHEN compatible_group_count > 0 THEN 10 END"),
        ]
    return " UNION ALL ".join(
        f"SELECT dataset, '{s}' AS score, {n} AS position, '{p}' AS part, (({e}) + 0)::DOUBLE AS impact "
        f"FROM {scores} WHERE ({e}) IS NOT NULL" for n, (s, p, e) in enumerate(rows))


READY = ("CASE WHEN {0} >= 80 THEN 'ready' WHEN {0} >= 55 THEN 'needs_review' ELSE 'not_ready' END").format

SIGNAL_TESTS = (
    ("multi_dataset", "dataset_count > 1"),
    ("has_relationship_candidates", "possible_join_count > 0"),
    ("tabular", "numeric_columns + categorical_columns + boolean_columns >= greatest(1, column_count // 2)"),
    ("small_dataset", "row_count <= 100000"), ("large_dataset", "row_count > 100000"),
    ("clean", "max_null_pct < 10 AND duplicate_pct < 5 AND problem_count <= greatest(3, column_count)"),
    ("many_nulls_or_inconsistencies", "max_null_pct >= 20 OR null_pct >= 10 OR type_problems > 0"),
    ("has_target", "has_target"), ("no_target", "NOT has_target"),
    ("target_imbalanced", "target_imbalanced"),
    ("many_categorical", "categorical_columns + boolean_columns >= 0.35 * column_count"),
    ("short_text", "text_columns > 0"), ("long_text", "long_text_columns > 0"),
    ("sensitive_data", "sensitive_columns > 0"),
)


def signals_sql(drivers: str) -> str:
    return " UNION ALL ".join(
        f"SELECT dataset, '{name}' AS signal FROM {drivers} WHERE {test}" for name, test in SIGNAL_TESTS)


RULES = "SELECT * FROM (VALUES " + ", ".join(
    f"({text(r['rule_id'])}, {r['priority']}, {text(r['confidence'])}, {r['must']!r}::VARCHAR[], "
    f"{r['must_not']!r}::VARCHAR[])" for r in catalogs.rule_rows()
) + ") v(rule_id, priority, confidence, must, must_not)"
ADVICE = "SELECT * FROM (VALUES " + ", ".join(
    f"({text(r['rule_id'])}, {text(r['field'])}, {r['position']}, {text(r['item'])})"
    for r in catalogs.advice_rows()
) + ") v(rule_id, field, place, item)"


def matches_sql(signals: str, drivers: str) -> str:
    return f"""
SELECT dataset, rule_id, priority, confidence,
  row_number() OVER (PARTITION BY dataset ORDER BY priority DESC) AS rank
FROM (SELECT d.dataset, r.*, count(*) OVER (PARTITION BY d.dataset) AS fitting
  FROM (SELECT DISTINCT dataset FROM {drivers}) d, rules r
  WHERE NOT EXISTS (SELECT 1 FROM unnest(r.must) u(m)
                    WHERE u.m NOT IN (SELECT signal FROM {signals} s WHERE s.dataset = d.dataset))
    AND NOT EXISTS (SELECT 1 FROM unnest(r.must_not) u(m)
                    WHERE u.m IN (SELECT signal FROM {signals} s WHERE s.dataset = d.dataset)))
WHERE rule_id <> 'default_exploratory' OR fitting = 1"""


def recommendation_sql(matches: str, signals: str) -> str:
    extra = " UNION ALL ".join(
        f"SELECT dataset, {text(f)}, 5, 1, {text(i)} FROM {signals} WHERE signal = 'sensitive_data'"
        for f, i in catalogs.SENSITIVE_EXTRA)
    return f"""
SELECT dataset, field, row_number() OVER (PARTITION BY dataset, field ORDER BY first_at) AS position, item
FROM (SELECT dataset, field, item, min(rank * 1000 + place) AS first_at FROM (
    SELECT m.dataset, a.field, m.rank, a.place, a.item FROM {matches} m JOIN advice a ON a.rule_id = m.rule_id
    WHERE m.rank <= 4 AND (a.field <> 'approach' OR m.rank = 1)
    UNION ALL SELECT dataset, 'confidence', 1, 1, confidence FROM {matches} WHERE rank = 1
    UNION ALL {extra}) GROUP BY dataset, field, item)"""


def decisions_sql(scores: str, recommendation: str, problems: str) -> str:
    return f"""
SELECT s.dataset,
  CASE WHEN modelling_score >= 80 THEN 'ready_for_baseline' WHEN modelling_score >= 55 THEN 'needs_validation'
    ELSE 'blocked' END AS status,
  CASE WHEN NOT has_target THEN 'confirm_target' WHEN problem_count > 0 THEN 'treat_problems'
    ELSE coalesce((SELECT item FROM {recommendation} r WHERE r.dataset = s.dataset AND field = 'next_steps' AND position = 1),
      'review_summary') END AS primary_action,
  coalesce((SELECT item FROM {recommendation} r WHERE r.dataset = s.dataset AND field = 'risks' AND position = 1),
    'none_found') AS main_risk,
  target,
  coalesce((SELECT string_agg(type, ',' ORDER BY n DESC, type) FROM (
      SELECT type, count(*) AS n FROM {problems} p WHERE p.dataset = s.dataset GROUP BY type
      ORDER BY n DESC, type LIMIT 3)), '') AS top_problem_types,
  (SELECT item FROM {recommendation} r WHERE r.dataset = s.dataset AND field = 'approach') AS approach
FROM {scores} s"""


IS_KEY = "(possible_primary_key OR possible_id)"


def actions_sql(marked: str) -> str:
    return f"""
SELECT dataset_no, dataset, ordinal, "column", semantic_type,
  CASE WHEN is_target THEN 'validate_target' WHEN {IS_KEY} THEN 'use_as_key'
    WHEN is_constant THEN 'drop_from_modeling' WHEN possible_sensitive THEN 'mask_or_exclude'
    WHEN null_count > 0 THEN 'treat_missing_values' WHEN high_cardinality THEN 'validate_cardinality'
    WHEN mixed THEN 'fix_type_consistency' WHEN bad_dates THEN 'fix_dates' ELSE 'keep' END AS recommended_action,
  CASE WHEN is_target THEN 'target_candidate' WHEN {IS_KEY} THEN 'join_or_identifier'
    WHEN is_constant THEN 'feature_candidate' WHEN possible_sensitive THEN 'sensitive_candidate'
    ELSE 'feature_candidate' END AS role,
  concat_ws(',', CASE WHEN is_target THEN 'target' WHEN {IS_KEY} THEN 'key' WHEN is_constant THEN 'constant'
      WHEN possible_sensitive THEN 'sensitive' END,
    CASE WHEN null_count > 0 THEN 'missing_values' END, CASE WHEN high_cardinality THEN 'high_cardinality' END,
    CASE WHEN outlier_count IS NOT NULL THEN 'outliers' END, CASE WHEN mixed THEN 'mixed_types' END,
    CASE WHEN bad_dates THEN 'invalid_dates' END) AS reasons
FROM {marked}"""


MARKED = """
SELECT q.*, coalesce(t."column" = q."column", false) AS is_target
FROM quality q JOIN targets t ON t.dataset_no = q.dataset_no
"""
FLAGS = """concat_ws(',', CASE WHEN null_count > 0 THEN 'missing_values' END,
    CASE WHEN row_count > 0 AND unique_count <= 1 THEN 'constant' END,
    CASE WHEN row_count > 5 AND rate > 0.9 THEN 'high_cardinality' END,
    CASE WHEN possible_sensitive THEN 'possible_sensitive_field' END)"""

NAMED = f"""SELECT *, lower({strip('"column"')}) AS name, {IS_KEY} AS is_key FROM keys"""
COMMON = """SELECT name, count(*) AS refs, bool_or(is_key) AS has_key,
  string_agg(dataset || '.' || "column", ',' ORDER BY dataset_no, ordinal) AS members
  FROM named GROUP BY name HAVING count(*) > 1"""
OVERLAP = """
SELECT a.dataset_no AS left_no, b.dataset_no AS right_no, a.dataset AS "left", b.dataset AS "right",
  len(list_intersect(a.names, b.names)) AS shared,
  list_sort(list_intersect(a.names, b.names)) AS shared_columns,
  round((len(list_intersect(a.names, b.names)))::DOUBLE / (len(list_distinct(list_concat(a.names, b.names)))) * 100, 2) AS overlap_pct
FROM (SELECT dataset_no, dataset, list(DISTINCT name) AS names FROM named GROUP BY ALL) a
JOIN (SELECT dataset_no, dataset, list(DISTINCT name) AS names FROM named GROUP BY ALL) b
  ON a.dataset_no < b.dataset_no"""
GROUPS = """
SELECT count(*) AS tables, string_agg(dataset, ',' ORDER BY dataset) AS datasets, max(n) AS column_count
FROM (SELECT dataset_no, dataset, string_agg(name, '|' ORDER BY name) AS signature, count(*) AS n
      FROM named GROUP BY dataset_no, dataset) GROUP BY signature HAVING count(*) > 1"""
COMBINED_DRIVERS = f"""
SELECT 0 AS dataset_no, '{SENTINEL}' AS dataset, s.*, p.*,
  CASE WHEN total_cells > 0 THEN round((null_cells)::DOUBLE / (total_cells) * 100, 2) ELSE 0 END AS null_pct,
  round((duplicate_rows)::DOUBLE / (row_count) * 100, 2) AS duplicate_pct,
  t.target IS NOT NULL AS has_target, t.target, false AS target_imbalanced,
  (SELECT count(*) FROM common) AS common_column_count,
  (SELECT count(*) FROM common WHERE has_key) AS possible_join_count,
  (SELECT count(*) FROM groups) AS compatible_group_count
FROM (SELECT count(*) AS dataset_count, max(max_null_pct) AS max_null_pct, {{sums}} FROM summary) s,
  (SELECT count(*) AS problem_count, count_if(severity = 'warning') AS warning_count,
     count_if(type = 'high_cardinality') AS cardinality_problems,
     count_if(type IN ('mixed_types', 'invalid_dates')) AS type_problems FROM problems) p,
  (SELECT min_by(dataset || '.' || "column", dataset_no) AS target FROM targets WHERE detected) t
""".format(sums=", ".join(
    f"sum({c})::BIGINT AS {c}" for c in (
        "row_count", "column_count", "total_cells", "null_cells", "duplicate_rows", "rows_fully_empty",
        "sensitive_columns", "numeric_columns", "date_columns", "boolean_columns", "categorical_columns",
        "text_columns", "long_text_columns")))
ALL_PROBLEMS = f"SELECT '{SENTINEL}' AS dataset, type FROM problems"
ROLES = """
SELECT t.dataset_no, t.dataset, CASE WHEN place = 1 THEN 'primary_candidate'
    WHEN candidate_keys > 0 AND row_count <= max(CASE WHEN place = 1 THEN row_count END) OVER ()
      THEN 'dimension_candidate' ELSE 'fact_or_event_candidate' END AS role,
  row_count, column_count, has_target, candidate_keys
FROM (SELECT d.*, (SELECT count(*) FROM keys k WHERE k.dataset_no = d.dataset_no
        AND (possible_id OR possible_primary_key)) AS candidate_keys,
        row_number() OVER (ORDER BY has_target DESC, row_count DESC, dataset_no) AS place FROM drivers d) t"""
PAIR_KEYS = """SELECT o.*, list_sort(list_intersect(shared_columns, coalesce(join_names, []))) AS candidate_keys
FROM overlap o, (SELECT list(name) AS join_names FROM common WHERE has_key) j"""


def ctes(names) -> dict[str, str]:
    """Every named step over the given inputs, in an order that respects dependencies."""
    steps = {f"src_{n}": INPUTS[n][0] for n in names}
    steps["figures"] = " UNION ALL ".join(
        column_sql(number, name, ordinal, column, kind)
        for number, name in enumerate(names)
        for ordinal, (column, kind) in enumerate(columns_of(INPUTS[name][1])))
    return steps | {
        "profile": PROFILE, "keys": KEYS, "outs": outlier_sql(names), "quality": QUALITY,
        "problems": PROBLEMS, "scored_columns": SCORED_COLUMNS,
        "picked": "SELECT * FROM scored_columns WHERE rank = 1 AND score >= 2.5",
        "classes": class_sql(names), "targets": TARGETS, "row_facts": row_sql(names),
        "summary": SUMMARY, "problem_counts": PROBLEM_COUNTS, "drivers": DRIVERS,
        "scores": scores_sql("drivers"), "score_parts": parts_sql("scores", False),
        "signals": signals_sql("drivers"), "rules": RULES, "advice": ADVICE,
        "matches": matches_sql("signals", "drivers"),
        "recommendation": recommendation_sql("matches", "signals"),
        "decisions": decisions_sql("scores", "recommendation", "problems"),
        "marked": MARKED, "actions": actions_sql("marked"),
        "named": NAMED, "common": COMMON, "overlap": OVERLAP, "groups": GROUPS,
        "pair_keys": PAIR_KEYS, "roles": ROLES,
        "combined_drivers": COMBINED_DRIVERS, "combined_scores": scores_sql("combined_drivers"),
        "combined_parts": parts_sql("combined_scores", True),
        "combined_signals": signals_sql("combined_drivers"),
        "combined_matches": matches_sql("combined_signals", "combined_drivers"),
        "combined_recommendation": recommendation_sql("combined_matches", "combined_signals"),
        "all_problems": ALL_PROBLEMS,
        "combined_decisions": decisions_sql("combined_scores", "combined_recommendation", "all_problems"),
        "combined_marked": f"""SELECT q.*, coalesce(c.target = q.dataset || '.' || q."column", false) AS is_target
          FROM quality q, combined_drivers c""",
        "combined_actions": actions_sql("combined_marked"),
    }


def over(names, final: str) -> str:
    """The final SELECT with just the steps it needs."""
    steps = ctes(names)
    needed: set[str] = set()

    def need(sql: str) -> None:
        for word in set(re.findall(r"[A-Za-z_]\w*", sql)):
            if word in steps and word not in needed:
                needed.add(word)
                need(steps[word])

    need(final)
    body = ",\n".join(
        f"{name} AS MATERIALIZED ({steps[name]})" for name in steps if name in needed)
    return f"WITH {body}\n{final}" if needed else final
