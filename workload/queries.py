"""The registered queries: each a Spark callable, most with a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe import Dataset, Profile
from tableprobe.dataset import TEXT, WHOLE, column_refs
from tableprobe.functions import masking, text
from tableprobe.functions.safe import json_row
from tableprobe.operators import actions, readiness, rows
from tableprobe.sources import files, paged, records, sql
from tableprobe.sources.store import ReportStore
from tableprobe.staging import Stage
from workload import oracle
from workload.inputs import ALL, INPUTS, columns_of, dataset, read

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EVERYTHING = (*ALL, "dirty", "dirty_dup", "dirty_empty")
SOME = ("customer", "lineitem", "events", "documents", "labels", "dirty", "dirty_empty")
SCORED = ("customer", "part", "events", "documents", "labels", "dirty", "dirty_dup")


def profile_query(name: str, inputs: tuple[str, ...], twin: str | None):
    """Register a query over a profile of the given inputs."""
    def register(build: Callable[[Profile], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(
            Profile([dataset(spark, folder, i) for i in inputs]))
        if twin:
            ORACLES[name] = oracle.over(inputs, twin)
        return build
    return register


def table_query(name: str, twin: str | None):
    """Register a query over the tables themselves."""
    def register(build: Query):
        QUERIES[name] = build
        if twin:
            ORACLES[name] = twin
        return build
    return register


def joined(column: str) -> str:
    return f"array_join({column}, ',') AS {column}"


# Schema.

COLUMN_PROFILE = """SELECT dataset, ordinal, "column", dtype, semantic_type, row_count, null_count, null_pct,
  non_null AS non_null_count, unique_count, unique_rate, possible_sensitive FROM profile"""


@profile_query("column_profile", ("lineitem",), COLUMN_PROFILE)
def _(p):
    return p.column_profile


@profile_query("column_profile_all", EVERYTHING, COLUMN_PROFILE)
def _(p):
    return p.column_profile


@profile_query("type_counts", SOME, """
SELECT dataset, semantic_type, count(*) AS columns,
  round((count(*))::DOUBLE / (sum(count(*)) OVER (PARTITION BY dataset)) * 100, 2) AS pct
FROM profile GROUP BY dataset, semantic_type""")
def _(p):
    return p.type_counts


@profile_query("column_flags", SOME, f"""
SELECT dataset, "column", flag FROM (SELECT dataset, "column",
  unnest(string_split({oracle.FLAGS}, ',')) AS flag FROM profile) WHERE flag <> ''""")
def _(p):
    return p.column_flags


def ranked_twin(inputs, limit: int, by_count: bool) -> str:
    """Ranked values of text and whole-number columns."""
    parts = []
    for name in inputs:
        for ordinal, (column, kind) in enumerate(columns_of(INPUTS[name][1])):
            if kind not in ("string", "int", "bigint"):
                continue
            c = f'"{column}"'
            rank = f"row_number() OVER (ORDER BY {'count(*) DESC, ' if by_count else ''}{c})"
            parts.append(
                f"SELECT '{name}' AS dataset, {ordinal} AS ordinal, '{column}' AS \"column\", "
                f"{rank} AS rank, {c}::VARCHAR AS value, count(*) AS cnt FROM ({INPUTS[name][0]}) "
                f"WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY rank <= {limit}")
    return " UNION ALL ".join(parts)


RANKED = ("dirty", "customer", "orders", "documents", "conversations")


def of_exact_text(p: Profile, df: DataFrame) -> DataFrame:
    """Rows of the columns whose text form is the same in every engine."""
    names = [f"{r.dataset}.{r.name}" for r in p.refs if r.kind in (WHOLE, TEXT)]
    return df.where(F.concat_ws(".", "dataset", "column").isin(names))


@table_query("top_values", ranked_twin(RANKED, 5, True))
def _(spark, folder):
    p = Profile([dataset(spark, folder, i) for i in RANKED])
    return of_exact_text(p, p.top_values(5))


@table_query("sample_values", ranked_twin(RANKED, 5, False))
def _(spark, folder):
    p = Profile([dataset(spark, folder, i) for i in RANKED])
    return of_exact_text(p, p.sample_values(5))


CATEGORICAL = ("dirty", "customer", "documents", "conversations")
CATEGORICAL_TWIN = oracle.over(CATEGORICAL, f"""
SELECT v.dataset, v.ordinal, v."column", p.unique_count, p.unique_rate, v.part, v.rank, v.value, v.cnt
FROM (SELECT *, 'top' AS part FROM ({ranked_twin(CATEGORICAL, 10, True)})
      UNION ALL SELECT *, 'sample' AS part FROM ({ranked_twin(CATEGORICAL, 5, False)})) v
JOIN profile p ON p.dataset = v.dataset AND p.ordinal = v.ordinal
WHERE p.grp = 'text' AND p.semantic_type IN ('categorical', 'boolean', 'text', 'long_text')""")


@table_query("categorical_stats", CATEGORICAL_TWIN)
def _(spark, folder):
    return Profile([dataset(spark, folder, i) for i in CATEGORICAL]).categorical_stats


SUMMARY_COLUMNS = """dataset, row_count, column_count, total_cells, null_cells, null_pct, max_null_pct,
  duplicate_rows, duplicate_pct, rows_fully_empty, sensitive_columns, numeric_columns, date_columns,
  boolean_columns, categorical_columns, text_columns, long_text_columns"""


@profile_query("dataset_summary", EVERYTHING, f"SELECT {SUMMARY_COLUMNS} FROM summary")
def _(p):
    return p.summary.selectExpr(*SUMMARY_COLUMNS.split(","))


@profile_query("data_dictionary", ("dirty",), f"""
SELECT m.dataset, m.ordinal, m."column", dtype, m.semantic_type,
  CASE WHEN is_target THEN 'target_candidate' WHEN {oracle.IS_KEY} THEN 'join_or_identifier'
    WHEN possible_sensitive THEN 'sensitive_candidate' ELSE a.role END AS role,
  recommended_action, null_pct, unique_count, unique_rate, possible_sensitive, {oracle.FLAGS} AS flags,
  CASE WHEN grp = 'number' AND dtype = 'double' THEN '' ELSE coalesce((
    SELECT string_agg(value, ',' ORDER BY rank) FROM ({ranked_twin(("dirty",), 5, False)}) v
    WHERE v.ordinal = m.ordinal AND {oracle.strip('value')} <> ''), '') END AS examples,
  array_to_string(string_split(reasons, ',')[1:2], ',') AS notes
FROM marked m JOIN actions a ON a.ordinal = m.ordinal""")
def _(p):
    # Reals are written differently by the engines, so their examples are left out here.
    return p.data_dictionary.selectExpr(
        "* EXCEPT (examples, notes)", joined("notes"),
        "CASE WHEN dtype = 'double' THEN '' ELSE array_join(examples, ',') END AS examples")


# Quality.

@profile_query("blank_counts", SOME, """
SELECT dataset, "column", null_count, null_pct, empty_strings, whitespace_strings FROM quality""")
def _(p):
    return p.quality.select(
        "dataset", "column", "null_count", "null_pct", "empty_strings", "whitespace_strings")


@profile_query("constant_columns", SOME, """
SELECT dataset, "column", is_constant, near_constant, high_cardinality FROM quality""")
def _(p):
    return p.quality.select(
        "dataset", "column", "is_constant", "near_constant", "high_cardinality")


@profile_query("key_candidates", SOME, """
SELECT dataset, "column", possible_id, possible_primary_key FROM keys
WHERE possible_id OR possible_primary_key""")
def _(p):
    return p.key_flags.where("possible_id OR possible_primary_key").select(
        "dataset", "column", "possible_id", "possible_primary_key")


@profile_query("invalid_dates", ("dirty", "documents"), """
SELECT dataset, "column", n_filled - n_day AS invalid_dates, n_filled AS dates_checked,
  round(((n_filled - n_day))::DOUBLE / (n_filled) * 100, 2) AS invalid_pct FROM quality WHERE bad_dates""")
def _(p):
    return p.quality.where("invalid_dates IS NOT NULL").select(
        "dataset", "column", "invalid_dates", "dates_checked", "invalid_pct")


@profile_query("inconsistent_values", ("dirty", "documents", "conversations"), """
SELECT dataset, "column", n_distinct AS raw_unique, n_norm AS normalised_unique FROM quality
WHERE inconsistent""")
def _(p):
    return p.quality.where("raw_unique IS NOT NULL").select(
        "dataset", "column", "raw_unique", "normalised_unique")


@profile_query("mixed_types", ("dirty", "documents", "events"), """
SELECT dataset, "column", n_filled AS values_classed,
  CASE WHEN m_number >= 0.1 * n_filled THEN m_number ELSE 0 END AS numeric_like,
  CASE WHEN m_truth >= 0.1 * n_filled THEN m_truth ELSE 0 END AS boolean_like,
  CASE WHEN m_day >= 0.1 * n_filled THEN m_day ELSE 0 END AS date_like,
  CASE WHEN m_text >= 0.1 * n_filled THEN m_text ELSE 0 END AS text_like
FROM quality WHERE mixed""")
def _(p):
    return p.quality.where("values_classed IS NOT NULL").select(
        "dataset", "column", "values_classed", "numeric_like", "boolean_like", "date_like",
        "text_like")


@profile_query("encoding_hint", SOME, """
SELECT dataset, "column", bad_character AS encoding_issue_hint, possible_sensitive FROM quality""")
def _(p):
    return p.quality.select("dataset", "column", "encoding_issue_hint", "possible_sensitive")


@profile_query("outliers", SOME, """
SELECT dataset, "column", outlier_count, outlier_pct, round(lower_bound, 4) AS lower_bound,
  round(upper_bound, 4) AS upper_bound FROM quality WHERE outlier_count IS NOT NULL""")
def _(p):
    return p.quality.where("outlier_count IS NOT NULL").selectExpr(
        "dataset", "column", "outlier_count", "outlier_pct",
        "round(lower_bound, 4) AS lower_bound", "round(upper_bound, 4) AS upper_bound")


def examples_twin() -> str:
    parts = []
    for ordinal, (column, kind) in enumerate(columns_of(INPUTS["dirty"][1])):
        c = f'"{column}"'
        tests = [("missing_values", f"{c} IS NULL", "NULL")]
        if kind == "string":
            tests.append(("blank_strings", f"{oracle.strip(c)} = ''", c))
        else:
            bounds = (f"(SELECT {{}} FROM quality WHERE ordinal = {ordinal} "
                      "AND outlier_count IS NOT NULL)").format
            tests.append(("numeric_outliers", f"{c} < {bounds('lower_bound')} OR "
                          f"{c} > {bounds('upper_bound')}", f"round({c}, 2)::DECIMAL(38, 2)::VARCHAR"))
        for kind_of, test, value in tests:
            parts.append(
                f"SELECT 'dirty' AS dataset, '{column}' AS \"column\", '{kind_of}' AS type, "
                "row_number() OVER (ORDER BY o_orderkey) AS rank, o_orderkey AS row_key, "
                f"{value}::VARCHAR AS value FROM src_dirty WHERE {test} QUALIFY rank <= 5")
    return " UNION ALL ".join(parts)


@profile_query("issue_examples", ("dirty",), examples_twin())
def _(p):
    return p.issue_examples("dirty", "o_orderkey").selectExpr(
        "* EXCEPT (value)", "CASE WHEN type = 'numeric_outliers' "
        "THEN string(cast(round(double(value), 2) AS decimal(38, 2))) ELSE value END AS value")


@profile_query("duplicate_rows", EVERYTHING, "SELECT dataset_no, duplicate_rows FROM row_facts")
def _(p):
    return p.duplicates


@profile_query("empty_rows", EVERYTHING, "SELECT dataset_no, rows_fully_empty FROM row_facts")
def _(p):
    return p.empty_rows


@profile_query("problems", EVERYTHING, "SELECT * FROM problems")
def _(p):
    return p.problems


ISSUES = "(VALUES " + ", ".join(
    "(" + ", ".join(oracle.text(v) for v in row.values()) + ")"
    for row in oracle.catalogs.issue_rows()) + ") i(type, title, meaning, why_it_matters, cautions, strategies)"


@profile_query("problems_explained", ("dirty",), f"""
SELECT p.*, i.title, i.meaning, i.why_it_matters, i.cautions, i.strategies
FROM problems p LEFT JOIN {ISSUES} ON i.type = p.type""")
def _(p):
    return p.problems_explained


@profile_query("problem_legend", ("dirty",), f"""
SELECT * FROM {ISSUES} WHERE type IN (SELECT type FROM problems)""")
def _(p):
    return p.problem_legend


def head_twin() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", row_number() OVER (ORDER BY c_custkey) AS rank, {c}::VARCHAR AS value
        FROM customer WHERE {c} IS NOT NULL QUALIFY rank <= 100"""
        for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@table_query("head_values", head_twin())
def _(spark, folder):
    columns = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    d = Dataset("customer", read(spark, folder, "customer").select(*columns))
    return rows.head_values(d, column_refs([d]), "c_custkey", 100)


@table_query("preview_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 8")
def _(spark, folder):
    return rows.sample_rows(Dataset("orders", read(spark, folder, "orders")), ["o_orderkey"])


# Statistics and chart tables.

STATS = ("mean", "median", "min", "max", "std", "q1", "q3", "skew")


@profile_query("numeric_stats", ALL, f"""
SELECT dataset, ordinal, "column", non_null AS count, {', '.join(f'round({c}, 4) AS {c}' for c in STATS)}
FROM profile WHERE grp = 'number'""")
def _(p):
    return p.numeric_stats.selectExpr(
        "dataset", "ordinal", "column", "count", *[f"round({c}, 4) AS {c}" for c in STATS])


CORRELATED = ("lineitem", "events", "part")


def correlation_twin() -> str:
    parts = []
    for name in CORRELATED:
        numbers = [(o, c) for o, (c, k) in enumerate(columns_of(INPUTS[name][1])) if k in oracle.NUMBERS]
        parts += [
            f"SELECT '{name}' AS dataset, {xo} AS x_ordinal, '{x}' AS x, {yo} AS y_ordinal, '{y}' AS y, "
            f"round(coalesce(CASE WHEN isnan(corr({x}, {y})) THEN 0 ELSE corr({x}, {y}) END, 0), 4) + 0 AS r "
            f"FROM ({INPUTS[name][0]})" for xo, x in numbers for yo, y in numbers]
    return " UNION ALL ".join(parts)


@profile_query("correlation", CORRELATED, correlation_twin())
def _(p):
    return p.correlations().withColumn("r", F.expr("r + 0D"))


BINNED = ("lineitem", "events", "customer")


def histogram_twin() -> str:
    parts = []
    for name in BINNED:
        numbers = [(o, c) for o, (c, k) in enumerate(columns_of(INPUTS[name][1])) if k in oracle.NUMBERS]
        for ordinal, c in numbers:
            parts.append(f"""
SELECT '{name}' AS dataset, {ordinal} AS ordinal, '{c}' AS "column", b.bin::INT AS bin,
  round(lo + bin * step, 4) AS bin_start, round(lo + (bin + 1) * step, 4) AS bin_end,
  (SELECT count(*) FROM ({INPUTS[name][0]}) WHERE least(floor(({c} - lo) / step), 11) = b.bin) AS cnt
FROM (SELECT min({c})::DOUBLE AS lo, (max({c})::DOUBLE - min({c})::DOUBLE) / 12 AS step FROM ({INPUTS[name][0]})),
  range(12) b(bin)""")
    return " UNION ALL ".join(parts)


@profile_query("histogram", BINNED, histogram_twin())
def _(p):
    return p.histograms().selectExpr(
        "dataset", "ordinal", "column", "bin", "round(bin_start, 4) AS bin_start",
        "round(bin_end, 4) AS bin_end", "cnt")


@profile_query("chart_nulls", SOME, """
SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY null_pct DESC, ordinal) AS rank,
  "column", null_pct FROM profile""")
def _(p):
    return p.chart_nulls()


@profile_query("chart_problems", SOME, """
SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, ordinal) AS rank,
  "column", count(*) AS problems FROM problems GROUP BY dataset, ordinal, "column" """)
def _(p):
    return p.chart_problems()


@profile_query("chart_target", ("dirty", "labels", "events"), """
SELECT p.dataset, p."column", c.rank, c.value, c.cnt FROM classes c
JOIN picked p ON p.dataset_no = c.dataset_no""")
def _(p):
    return p.target_distribution


@profile_query("chart_categories", ("dirty", "customer", "documents"), f"""
SELECT v.dataset, v.ordinal, v."column", v.rank, v.value, v.cnt
FROM ({ranked_twin(("dirty", "customer", "documents"), 10, True)}) v
JOIN (SELECT dataset, ordinal FROM profile WHERE grp = 'text'
      AND semantic_type IN ('categorical', 'boolean', 'text', 'long_text')) p
  ON p.dataset = v.dataset AND p.ordinal = v.ordinal""")
def _(p):
    return p.chart_categories()


@profile_query("chart_outliers", ("dirty", "part", "orders"), """
SELECT dataset, ordinal, "column", outlier_count FROM quality WHERE outlier_count IS NOT NULL""")
def _(p):
    return p.chart_outliers()


@profile_query("chart_datasets", SCORED, """
SELECT s.dataset, row_count, null_pct, coalesce(problem_count, 0) AS problems
FROM summary s LEFT JOIN problem_counts c ON c.dataset_no = s.dataset_no""")
def _(p):
    return p.chart_datasets()


@profile_query("chart_shared", ALL, "SELECT name, refs FROM common")
def _(p):
    return p.chart_shared()


# Target, scores, actions.

@profile_query("target_candidates", SOME, """
SELECT dataset, rank, "column", score FROM scored_columns WHERE rank <= 5""")
def _(p):
    return p.target_candidates


@profile_query("target", EVERYTHING, "SELECT * FROM targets")
def _(p):
    return p.targets


SCORE_COLUMNS = f"""dataset, data_quality_score, {oracle.READY('data_quality_score')} AS data_quality_label,
  modelling_score, {oracle.READY('modelling_score')} AS modelling_label"""


@profile_query("readiness", SCORED, f"""
SELECT {SCORE_COLUMNS}, NULL::INT AS join_score, NULL::VARCHAR AS join_label FROM scores""")
def _(p):
    return p.readiness


@profile_query("score_parts", SCORED, "SELECT * FROM score_parts")
def _(p):
    return p.score_parts


@profile_query("top_problem_types", SCORED, """
SELECT dataset_no, dataset, type, count(*) AS cnt,
  row_number() OVER (PARTITION BY dataset_no ORDER BY count(*) DESC, type) AS rank
FROM problems GROUP BY dataset_no, dataset, type QUALIFY rank <= 3""")
def _(p):
    return p.top_problem_types


@profile_query("decision", SCORED, "SELECT * FROM decisions")
def _(p):
    return p.decision


@profile_query("column_actions", SCORED, """
SELECT dataset, ordinal, "column", semantic_type, recommended_action, role, reasons,
  CASE WHEN recommended_action = 'keep' THEN 'normal' ELSE 'high' END AS priority FROM actions""")
def _(p):
    return p.column_actions.selectExpr(
        "dataset", "ordinal", "column", "semantic_type", "recommended_action", "role",
        "array_join(reason_codes, ',') AS reasons", "priority")


CHECKLIST = " UNION ALL ".join(
    [f"SELECT DISTINCT dataset, {n} AS position, '{item}' AS item, NULL::BIGINT AS columns FROM actions"
     for n, item in enumerate(actions.FIXED_CHECKLIST)]
    + [f"SELECT dataset, {n}, '{item}', count(*) FROM actions WHERE recommended_action = '{action}' GROUP BY dataset"
       for n, (item, action) in enumerate(actions.COUNTED_CHECKLIST, start=3)])


@profile_query("cleaning_checklist", SCORED, CHECKLIST)
def _(p):
    return p.cleaning_checklist


def _blank_to_null(c: str) -> str:
    return f"CASE WHEN {oracle.strip(c)} <> '' THEN {c} END"


CLEANED_TEXTS = ("priority_txt", "mixed_txt", "created_txt", "near_constant_col", "city", "churn")


@profile_query("cleaned_rows", ("dirty",), f"""
SELECT o_orderkey, customer_id, amount, amount_outlier,
  {', '.join(f'{_blank_to_null(c)} AS {c}' for c in CLEANED_TEXTS)},
  amount IS NULL AS amount__is_null, {_blank_to_null('priority_txt')} IS NULL AS priority_txt__is_null
FROM src_dirty""")
def _(p):
    return p.cleaned("dirty")


# Advice.

@profile_query("signals", SCORED, "SELECT dataset, signal FROM signals")
def _(p):
    return p.signals.selectExpr("dataset", "explode(signals) AS signal")


@profile_query("rule_matches", SCORED, "SELECT dataset, rule_id, rank, priority, confidence FROM matches")
def _(p):
    return p.rule_matches


@profile_query("recommendation", SCORED, "SELECT * FROM recommendation")
def _(p):
    return p.recommendation


OBJECTIVE_TESTS = ", ".join(
    f"{oracle.any_of('lower(text)', parts)} AS {name}" for name, parts in (
        ("mentions_natural_language", oracle.words.OBJECTIVE_LANGUAGE),
        ("mentions_prediction", oracle.words.OBJECTIVE_PREDICTION),
        ("mentions_risk", oracle.words.OBJECTIVE_RISK)))


@table_query("objective_signals", f"SELECT conv_id, turn, {OBJECTIVE_TESTS} FROM conversations")
def _(spark, folder):
    given = read(spark, folder, "conversations").selectExpr("conv_id", "turn", "text AS objective")
    return readiness.objective_signals(given).drop("objective")


# Several tables.

@profile_query("common_columns", ALL, "SELECT name, refs, has_key, members FROM common")
def _(p):
    return p.common_columns.selectExpr(
        "name", "refs", "has_key",
        "array_join(transform(columns, c -> concat(c.dataset, '.', c.column)), ',') AS members")


@profile_query("possible_joins", ALL, "SELECT name, refs FROM common WHERE has_key")
def _(p):
    return p.possible_joins.select("name", "refs")


@profile_query("schema_overlap", ALL, """
SELECT "left", "right", shared, array_to_string(shared_columns, ',') AS shared_columns, overlap_pct FROM overlap""")
def _(p):
    return p.schema_overlap.selectExpr(
        "left", "right", "shared", joined("shared_columns"), "overlap_pct")


@profile_query("compatible_groups", EVERYTHING, "SELECT * FROM groups")
def _(p):
    return p.compatible_groups.selectExpr("tables", joined("datasets"), "column_count")


COMBINED_COLUMNS = """dataset_count, row_count, column_count, total_cells, null_cells, null_pct, duplicate_rows,
  duplicate_pct, rows_fully_empty, common_column_count, possible_join_count, compatible_group_count"""


@profile_query("combined_summary", SCORED, f"SELECT {COMBINED_COLUMNS} FROM combined_drivers")
def _(p):
    return p.combined_summary.selectExpr(*COMBINED_COLUMNS.split(","))


@profile_query("combined_schema", ALL, """
SELECT dataset || '.' || "column" AS "column", "column" AS original_column, semantic_type, unique_count, null_pct
FROM profile""")
def _(p):
    return p.combined_columns.select(
        "column", "original_column", "semantic_type", "unique_count", "null_pct")


@profile_query("combined_problems", SCORED, """
SELECT dataset || '.' || "column" AS "column", type, severity FROM problems""")
def _(p):
    return p.combined_problems.select("column", "type", "severity")


@profile_query("combined_target", SCORED, "SELECT has_target AS detected, target AS \"column\" FROM combined_drivers")
def _(p):
    return p.combined_target.select("detected", "column")


@profile_query("dataset_roles", ALL, "SELECT * FROM roles")
def _(p):
    return p.dataset_roles


@profile_query("join_plan", ALL, """
SELECT "left", "right", array_to_string(shared_columns, ',') AS shared_columns,
  array_to_string(candidate_keys, ',') AS candidate_keys, overlap_pct,
  CASE WHEN len(candidate_keys) > 0 THEN 'medium' WHEN shared > 0 THEN 'high' ELSE 'low' END AS risk
FROM pair_keys""")
def _(p):
    return p.join_plan.selectExpr(
        "left", "right", joined("shared_columns"), joined("candidate_keys"), "overlap_pct", "risk")


@profile_query("plan_warnings", ("region", "events", "labels"), """
SELECT 'no_reliable_shared_key' AS warning WHERE NOT EXISTS (SELECT 1 FROM common WHERE has_key)
UNION ALL SELECT 'no_shared_column_names' WHERE NOT EXISTS (SELECT 1 FROM common)""")
def _(p):
    return p.plan_warnings


@profile_query("table_map_nodes", ALL, "SELECT dataset, row_count, column_count, target FROM drivers")
def _(p):
    return p.map_nodes.drop("dataset_no")


@profile_query("table_map_edges", ALL, """
SELECT "left", "right", array_to_string(shared_columns, ',') AS shared_columns, overlap_pct,
  CASE WHEN len(candidate_keys) > 0 THEN 'possible_join' ELSE 'shared_schema' END AS hint
FROM pair_keys WHERE shared > 0""")
def _(p):
    return p.map_edges.selectExpr(
        "left", "right", joined("shared_columns"), "overlap_pct", "hint")


@profile_query("combined_readiness", SCORED, f"""
SELECT {SCORE_COLUMNS}, join_score, {oracle.READY('join_score')} AS join_label FROM combined_scores""")
def _(p):
    return p.combined_readiness


@profile_query("combined_score_parts", SCORED, "SELECT * FROM combined_parts")
def _(p):
    return p.combined_score_parts


@profile_query("combined_rules", SCORED, "SELECT dataset, rule_id, rank FROM combined_matches")
def _(p):
    return p.combined_rule_matches.select("dataset", "rule_id", "rank")


@profile_query("combined_recommendation", SCORED, "SELECT * FROM combined_recommendation")
def _(p):
    return p.combined_recommendation


@profile_query("combined_decision", SCORED, "SELECT * FROM combined_decisions")
def _(p):
    return p.combined_decision


@profile_query("combined_actions", SCORED, """
SELECT dataset || '.' || "column" AS "column", recommended_action, role, reasons FROM combined_actions""")
def _(p):
    return p.combined_actions.selectExpr(
        "column", "recommended_action", "role", "array_join(reason_codes, ',') AS reasons")


# Masking.

def mask_twin(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR length({c}) <= 8 THEN '***' "
            f"ELSE left({c}, 2) || '***' || right({c}, 2) END")


@table_query("masked_values", f"SELECT c_custkey, {mask_twin('c_name')} AS name, "
             f"{mask_twin('c_mktsegment')} AS segment FROM customer")
def _(spark, folder):
    return read(spark, folder, "customer").selectExpr(
        "c_custkey", f"{masking.mask_value('c_name')} AS name",
        f"{masking.mask_value('c_mktsegment')} AS segment")


def redact_twin(c: str) -> str:
    for regex in masking.REDACTIONS:
        c = f"regexp_replace({c}, '{regex.replace(chr(39), chr(39) * 2)}', '\\1***', 'g')"
    return f"regexp_replace({c}, '{masking.URL_CREDENTIALS}', '://\\1:***@', 'g')"


@table_query("redacted_text", f"SELECT doc_id, {redact_twin('text')} AS text FROM documents")
def _(spark, folder):
    return read(spark, folder, "documents").selectExpr(
        "doc_id", f"{masking.redact_text('text')} AS text")


# The addresses of the pages, given a secret parameter so that there is one to mask.
KEYED_URL = ("concat(regexp_replace(url, '#.*$', ''), CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, "
             "'api-key=', 'k', page_id, 'abcdefgh')")


@table_query("masked_url", """
SELECT page_id, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END
  || 'api-key=' || left('k' || page_id, 2) || '***gh' AS url FROM pages""")
def _(spark, folder):
    return read(spark, folder, "pages").selectExpr(
        "page_id", f"{KEYED_URL} AS url").selectExpr(
        "page_id", f"{masking.redact_url('url')} AS url")


@table_query("masked_connection", """
SELECT c_custkey, 'postgresql://' || replace(c_name, '#', '_') || ':***@db.example.com:5432/' || c_mktsegment AS address
FROM customer""")
def _(spark, folder):
    return read(spark, folder, "customer").selectExpr(
        "c_custkey", "concat('postgresql://', replace(c_name, '#', '_'), ':pw', c_custkey, '@db.example.com:5432/', "
        "c_mktsegment) AS address").selectExpr(
        "c_custkey", f"{masking.redact_connection('address')} AS address")


@table_query("masked_map", f"""
SELECT o_orderkey, {mask_twin("'tok' || o_custkey || o_orderpriority")} AS token, o_orderstatus AS status
FROM orders""")
def _(spark, folder):
    return read(spark, folder, "orders").selectExpr(
        "o_orderkey", "map('Access-Token', concat('tok', o_custkey, o_orderpriority), "
        "'status', o_orderstatus) AS m").selectExpr(
        "o_orderkey", f"{masking.mask_map('m')} AS m").selectExpr(
        "o_orderkey", "m['Access-Token'] AS token", "m['status'] AS status")


@table_query("masked_columns", f"""
SELECT c_custkey, {mask_twin('c_name')} AS auth_user, c_mktsegment AS segment,
  {mask_twin("'pw-' || c_name")} AS password FROM customer""")
def _(spark, folder):
    nested = read(spark, folder, "customer").selectExpr(
        "c_custkey", "c_name AS auth_user",
        "struct(c_mktsegment AS segment, concat('pw-', c_name) AS password) AS login")
    return masking.mask_columns(nested).selectExpr(
        "c_custkey", "auth_user", "login.segment", "login.password")


# Values and sources.

@table_query("parsed_values", f"""
SELECT o_orderkey, CASE WHEN {oracle.IS_NUMBER} THEN try_cast(s AS DOUBLE) END AS number,
  {oracle.IS_DAY} AS is_day, lower(s) IN {oracle.TRUTH_ALL} AS is_truth,
  regexp_replace(lower(s), {oracle.WS_RUN}, ' ', 'g') AS normalised
FROM (SELECT o_orderkey, {oracle.strip('mixed_txt')} AS s FROM ({INPUTS['dirty'][0]}))""")
def _(spark, folder):
    return dataset(spark, folder, "dirty").df.selectExpr(
        "o_orderkey", f"{text.parse_number('mixed_txt')} AS number",
        f"{text.parse_day('mixed_txt')} IS NOT NULL AS is_day",
        f"{text.is_truth_token('mixed_txt')} AS is_truth",
        f"{text.normalise('mixed_txt')} AS normalised")


@table_query("json_records", """
SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1""")
def _(spark, folder):
    parsed = records.parse_json_column(read(spark, folder, "events"), "props", "k bigint")
    return parsed.groupBy("k").agg(F.expr("count(1) AS n"))


NESTED = ("struct(o_orderkey AS id, struct(o_custkey AS key, struct(o_orderpriority AS priority) AS has) "
          "AS customer, o_totalprice AS price, o_orderstatus AS status, cast(o_orderdate AS date) AS day)")


@table_query("json_source", """
SELECT o_custkey AS "customer.key", o_orderpriority AS "customer.has.priority", o_orderkey AS id,
  o_totalprice AS price, o_orderstatus AS status, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders""")
def _(spark, folder):
    # Documents of four shapes: records below three of the default paths, or the record itself.
    path = f"{Stage(spark).path}/orders.json"
    shape = lambda k, value: f"CASE WHEN o_orderkey % 4 = {k} THEN {value} END"
    (read(spark, folder, "orders").selectExpr("o_orderkey", f"{NESTED} AS r").selectExpr(
        f"{shape(0, 'array(r)')} AS data", f"{shape(1, 'array(null, r)')} AS items",
        f"{shape(2, 'struct(array(r) AS items)')} AS response",
        *[f"{shape(3, f'r.{c}')} AS {c}" for c in ("id", "customer", "price", "status", "day")])
     .write.json(path))
    return files.load_file(spark, path).df


def written_csv(df: DataFrame, spark: SparkSession, name: str, separator: str) -> str:
    """Folder of the table as delimited text, blanks and line breaks as they are."""
    path = f"{Stage(spark).path}/{name}.csv"
    (df.write.option("header", True).option("sep", separator).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


@table_query("csv_source", """
SELECT o_orderkey::INT AS o_orderkey, o_custkey::INT AS o_custkey, o_orderstatus, o_totalprice,
  o_orderdate::DATE AS o_orderdate, o_orderpriority FROM orders""")
def _(spark, folder):
    orders = read(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "cast(o_orderdate AS date) AS o_orderdate", "o_orderpriority")
    return files.load_file(spark, written_csv(orders, spark, "orders", ";")).df


@table_query("csv_documents", """
SELECT doc_id::INT AS doc_id, text, lang, source, n_chars::INT AS n_chars FROM documents""")
def _(spark, folder):
    # Texts hold quotes, separators and line breaks, so records span lines and ranges of files.
    documents = read(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return files.load_file(spark, written_csv(documents, spark, "documents", ",")).df


PAGE = 40


def served(address: str, parameters: dict) -> dict:
    """A page of the folder that `paged_source` writes: `page` counts from 1; beyond the last it is empty."""
    import json

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(address)
    found = store.get_file_info(fs.FileSelector(f"{path}/page={parameters['page'] - 1}", allow_not_found=True))
    bodies = [store.open_input_stream(f.path).read().decode() for f in found if f.base_name.startswith("part-")]
    return {"results": [json.loads(line) for body in bodies for line in body.splitlines()]}


@table_query("paged_source", "SELECT conv_id, turn, role, text AS \"message.text\" FROM conversations")
def _(spark, folder):
    # Rows are numbered over sorted partitions: the place in the partition behind the totals of those before.
    stage = Stage(spark)
    dealt = stage.table("dealt", lambda: read(spark, folder, "conversations").repartitionByRange("conv_id", "turn")
                        .selectExpr("*", "spark_partition_id() AS part", "monotonically_increasing_id() AS at"))
    totals = dealt.groupBy("part").agg(F.expr("count(1) AS n"), F.expr("min(at) AS first")).selectExpr(
        "part", "first", "sum(n) OVER (ORDER BY part) - n AS before")
    numbered = dealt.join(F.broadcast(totals), "part").selectExpr(
        "conv_id", "turn", "role", "struct(text) AS message", f"(before + at - first) div {PAGE} AS page")
    pages = f"{stage.path}/pages"
    numbered.repartition("page").write.partitionBy("page").option("ignoreNullFields", False).json(pages)
    address = pages if "://" in pages or pages.startswith("file:") else f"file://{pages}"
    address = address.replace("file:/", "file:///", 1) if address.startswith("file:/") and not address.startswith("file://") else address
    return paged.load_pages(spark, address, served, paged.Paging(mode="page_limit", limit=PAGE)).df


# Order days as texts, in Spark and in DuckDB: mostly in one format, some in another.
DAY_TEXTS = {
    "mostly_iso": ("CASE WHEN o_orderkey % 9 = 0 THEN date_format(d, 'dd/MM/yyyy') ELSE date_format(d, 'yyyy-MM-dd') END",
                   "CASE WHEN o_orderkey % 9 = 0 THEN strftime(d, '%d/%m/%Y') ELSE strftime(d, '%Y-%m-%d') END"),
    "day_first": ("CASE WHEN o_orderkey % 3 = 0 THEN date_format(d, ' M/d/yyyy') ELSE date_format(d, 'd/M/yyyy ') END",
                  "CASE WHEN o_orderkey % 3 = 0 THEN strftime(d, ' %-m/%-d/%Y') ELSE strftime(d, '%-d/%-m/%Y ') END"),
    "compact": ("CASE WHEN o_orderkey % 4 = 0 THEN date_format(d, 'yyyy/MM/dd') ELSE date_format(d, 'yyyyMMdd') END",
                "CASE WHEN o_orderkey % 4 = 0 THEN strftime(d, '%Y/%m/%d') ELSE strftime(d, '%Y%m%d') END"),
    "moments": ("CASE WHEN o_orderkey % 50 = 0 THEN 'unknown' ELSE date_format(d, \"yyyy-MM-dd'T'HH:mm:ss\") END",
                "CASE WHEN o_orderkey % 50 = 0 THEN 'unknown' ELSE strftime(d, '%Y-%m-%dT%H:%M:%S') END"),
    "no_days": ("o_orderstatus", "o_orderstatus"),
}
DAY_HITS = {
    "year-month-day": (r"\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"), "day/month/year": (r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y"),
    "month/day/year": (r"\d{1,2}/\d{1,2}/\d{4}", "%m/%d/%Y"), "moment": (oracle.MOMENT[1:-1], "%Y-%m-%d"),
    "year/month/day": (r"\d{4}/\d{2}/\d{2}", "%Y/%m/%d"), "compact": (r"\d{8}", "%Y%m%d"),
}


def day_formats_twin() -> str:
    values = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", trim({duck}) AS s FROM days" for c, (_, duck) in DAY_TEXTS.items())
    hit = {f: f"(regexp_full_match(s, '{shape}') AND try_strptime(CASE WHEN '{f}' = 'moment' THEN left(s, 10) ELSE s END, "
              f"'{pattern}') IS NOT NULL)" for f, (shape, pattern) in DAY_HITS.items()}
    hits = " UNION ALL ".join(f"SELECT \"column\", {k} AS place, '{f}' AS date_format, count_if({test}) AS dates "
                              f"FROM v GROUP BY \"column\"" for k, (f, test) in enumerate(hit.items()))
    return f"""WITH days AS (SELECT *, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders), v AS ({values}), h AS ({hits}),
      n AS (SELECT "column", count_if({" OR ".join(hit.values())}) AS every, count(s) AS filled FROM v GROUP BY "column")
    SELECT 'days' AS dataset, "column", date_format, dates, every - dates AS other_dates, dates >= 0.8 * filled AS is_date
    FROM h JOIN n USING ("column") WHERE dates > 0
    QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY dates DESC, place) = 1"""


@table_query("date_formats", day_formats_twin())
def _(spark, folder):
    days = read(spark, folder, "orders").selectExpr("*", "o_orderdate AS d").selectExpr(
        *[f"{own} AS {c}" for c, (own, _) in DAY_TEXTS.items()])
    p = Profile([Dataset("days", days)], dominant_format=True)
    types = p.column_profile.selectExpr("dataset", "column", "semantic_type = 'date' AS is_date")
    return p.date_formats.join(types, ["dataset", "column"])


@profile_query("stored_report", ("customer", "dirty"), COLUMN_PROFILE)
def _(p):
    store = ReportStore(p.spark, f"{p.stage.path}/reports")
    return store.read(store.save(p), "columns")


@table_query("json_rows", """
SELECT o_orderkey, to_json(struct_pack(k := o_orderkey, s := struct_pack(status := o_orderstatus,
  v := [CASE WHEN o_orderkey % 3 > 1 THEN o_totalprice END, NULL, 1.5::DOUBLE]))) AS record FROM orders""")
def _(spark, folder):
    odd = "CASE o_orderkey % 3 WHEN 0 THEN double('NaN') WHEN 1 THEN double('-Infinity') ELSE o_totalprice END"
    nested = read(spark, folder, "orders").selectExpr(
        "o_orderkey AS k", f"struct(o_orderstatus AS status, array({odd}, null, 1.5D) AS v) AS s")
    return nested.selectExpr("k AS o_orderkey", f"{json_row(nested.schema)} AS record")


@table_query("read_only_queries", r"""
SELECT conv_id, turn, regexp_matches(q, '(?i)^\s*(select|with)\b') AND NOT regexp_matches(q,
  '(?i)\b(insert|update|delete|drop|alter|create|truncate|merge|grant|revoke|call|execute|attach|detach|pragma)\b')
  AS read_only
FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'select ' ELSE '' END || text AS q FROM conversations)""")
def _(spark, folder):
    return read(spark, folder, "conversations").selectExpr(
        "conv_id", "turn", "concat(CASE WHEN turn % 2 = 0 THEN 'select ' ELSE '' END, text) AS q"
    ).selectExpr("conv_id", "turn", f"{sql.is_read_only('q')} AS read_only")
