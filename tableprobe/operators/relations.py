"""How several tables relate, judged by their column names and key flags.

Inputs have one row per column or table, so everything here grows with the schemas only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.sql import literal, percent, present
from tableprobe.functions.text import strip

NO_NAMES = "cast(array() AS array<string>)"


def named_columns(flagged: DataFrame) -> DataFrame:
    """One row per column with its normalised name."""
    return flagged.selectExpr(
        "dataset_no", "dataset", "ordinal", "column", f"lower({strip('column')}) AS name",
        "semantic_type", "unique_rate", "possible_id", "possible_primary_key",
        "possible_id OR possible_primary_key AS is_key",
    )


def normalised_names(columns: DataFrame) -> DataFrame:
    """dataset_no, dataset, name of columns."""
    return columns.selectExpr("dataset_no", "dataset", f"lower({strip('column')}) AS name")


def common_columns(named: DataFrame) -> DataFrame:
    """name, refs, has_key and the columns themselves, for names that occur more than once."""
    ref = ("struct(dataset_no, ordinal, dataset, column, semantic_type, unique_rate, "
           "possible_id, possible_primary_key)")
    return named.groupBy("name").agg(
        F.expr("count(1) AS refs"), F.expr("bool_or(is_key) AS has_key"),
        F.expr(f"sort_array(collect_list({ref})) AS columns"),
    ).where("refs > 1")


def possible_joins(common: DataFrame) -> DataFrame:
    return common.where("has_key")


def schema_overlap(named: DataFrame) -> DataFrame:
    """left, right, shared, shared_columns, overlap_pct for every pair of tables."""
    names = named.select("dataset_no", "dataset", "name").distinct()
    sizes = names.groupBy("dataset_no", "dataset").agg(F.expr("count(1) AS n"))
    pairs = sizes.selectExpr("dataset_no AS left_no", "dataset AS left", "n AS left_n").join(
        F.broadcast(sizes.selectExpr("dataset_no AS right_no", "dataset AS right", "n AS right_n")),
        F.expr("left_no < right_no"))
    shared = (
        names.selectExpr("dataset_no AS left_no", "name")
        .join(names.selectExpr("dataset_no AS right_no", "name"), "name")
        .where("left_no < right_no").groupBy("left_no", "right_no")
        .agg(F.expr("count(1) AS n"), F.expr("sort_array(collect_list(name)) AS names"))
    )
    return pairs.join(shared, ["left_no", "right_no"], "left").selectExpr(
        "left_no", "right_no", "left", "right", "coalesce(n, 0L) AS shared",
        f"coalesce(names, {NO_NAMES}) AS shared_columns",
        f"{percent('coalesce(n, 0L)', '(left_n + right_n - coalesce(n, 0L))')} AS overlap_pct",
    )


def compatible_groups(named: DataFrame) -> DataFrame:
    """signature, tables, datasets, column_count for tables with the same names of columns."""
    signatures = named.groupBy("dataset_no", "dataset").agg(
        F.expr("array_join(sort_array(collect_list(name)), '|') AS signature"),
        F.expr("count(1) AS column_count"),
    )
    return signatures.groupBy("signature").agg(
        F.expr("count(1) AS tables"), F.expr("sort_array(collect_list(dataset)) AS datasets"),
        F.expr("max(column_count) AS column_count"),
    ).where("tables > 1")


def relation_counts(common: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: how many common columns, join candidates and compatible groups there are."""
    found = common.agg(F.expr("count(1) AS common_column_count"),
                       F.expr("count_if(has_key) AS possible_join_count"))
    return found.join(F.broadcast(groups.agg(F.expr("count(1) AS compatible_group_count"))))


def qualified(section: DataFrame) -> DataFrame:
    """A section with columns named `dataset.column`, as in the combined report."""
    return section.withColumnRenamed("column", "original_column").selectExpr(
        "*", "concat_ws('.', dataset, original_column) AS column")


def combined_summary(summary: DataFrame, counts: DataFrame, label: str) -> DataFrame:
    """The summaries of all tables as one, with recomputed shares."""
    sums = ("row_count", "column_count", "total_cells", "null_cells", "duplicate_rows",
            "rows_fully_empty", "sensitive_columns", "numeric_columns", "date_columns",
            "boolean_columns", "categorical_columns", "text_columns", "long_text_columns", "bytes")
    total = summary.agg(*[F.expr(e) for e in (
        "count(1) AS dataset_count", "max(max_null_pct) AS max_null_pct",
        *[f"sum({c}) AS {c}" for c in sums],
    )])
    return total.join(F.broadcast(counts)).selectExpr(
        "0 AS dataset_no", f"{literal(label)} AS dataset", "*",
        f"{percent('null_cells', 'total_cells')} AS null_pct",
        f"{percent('duplicate_rows', 'row_count')} AS duplicate_pct",
        "round(bytes / 1048576D, 2) AS megabytes",
    )


def combined_target(targets: DataFrame, label: str) -> DataFrame:
    """The first table's target under its qualified name. Balance is not carried over."""
    return targets.where("detected").agg(
        F.expr("min_by(named_struct('d', dataset, 'c', column), dataset_no) AS t")
    ).selectExpr(
        "0 AS dataset_no", f"{literal(label)} AS dataset", "t IS NOT NULL AS detected",
        "concat_ws('.', t.d, t.c) AS column", "t.d AS target_dataset", "t.c AS target_column",
        "false AS imbalanced",
    ).selectExpr("* EXCEPT (column)", "CASE WHEN detected THEN column END AS column")


def dataset_roles(summary: DataFrame, targets: DataFrame, flagged: DataFrame) -> DataFrame:
    """Primary, dimension or fact candidate per table, with its number of candidate keys."""
    keys = flagged.groupBy("dataset_no").agg(
        F.expr("count_if(possible_primary_key OR possible_id) AS candidate_keys"))
    tables = (
        summary.select("dataset_no", "dataset", "row_count", "column_count")
        .join(targets.selectExpr("dataset_no", "detected AS has_target"), "dataset_no")
        .join(keys, "dataset_no")
    )
    # One row per table, so a window over all of them stays small.
    order = "ORDER BY has_target DESC, row_count DESC, dataset_no"
    return tables.selectExpr(
        "*", f"row_number() OVER ({order}) AS place",
        f"first(row_count) OVER ({order}) AS primary_rows",
    ).selectExpr(
        "dataset_no", "dataset",
        "CASE WHEN place = 1 THEN 'primary_candidate' WHEN candidate_keys > 0 "
        "AND row_count <= primary_rows THEN 'dimension_candidate' "
        "ELSE 'fact_or_event_candidate' END AS role",
        "row_count", "column_count", "has_target", "candidate_keys",
    )


def _with_keys(overlap: DataFrame, joins: DataFrame) -> DataFrame:
    """Pairs with the shared columns that are candidate keys."""
    names = joins.agg(F.expr("collect_list(name) AS join_names"))
    return overlap.join(F.broadcast(names)).selectExpr(
        "* EXCEPT (join_names)", "array_intersect(shared_columns, join_names) AS candidate_keys")


def join_plan(overlap: DataFrame, joins: DataFrame, limit: int | None = None) -> DataFrame:
    """The pairs of tables, the first `limit` by overlap if given, their candidate keys, and the risk
    of joining on them."""
    leading = overlap
    if limit is not None:
        leading = overlap.orderBy(F.desc("overlap_pct"), "left_no", "right_no").limit(limit)
    return _with_keys(leading, joins).selectExpr(
        "left_no", "right_no", "left", "right", "shared_columns", "candidate_keys", "overlap_pct",
        "CASE WHEN size(candidate_keys) > 0 THEN 'medium' WHEN shared > 0 THEN 'high' "
        "ELSE 'low' END AS risk",
    )


def plan_warnings(counts: DataFrame) -> DataFrame:
    """warning: no_reliable_shared_key, no_shared_column_names, as they apply."""
    found = present((
        "CASE WHEN possible_join_count = 0 THEN 'no_reliable_shared_key' END",
        "CASE WHEN common_column_count = 0 THEN 'no_shared_column_names' END",
    ))
    return counts.selectExpr(f"explode({found}) AS warning")


def map_nodes(summary: DataFrame, targets: DataFrame) -> DataFrame:
    return summary.select("dataset_no", "dataset", "row_count", "column_count").join(
        targets.selectExpr("dataset_no", "column AS target"), "dataset_no", "left")


def map_edges(overlap: DataFrame, joins: DataFrame) -> DataFrame:
    """Pairs that share columns, hinting whether a shared one is a candidate key."""
    return _with_keys(overlap.where("shared > 0"), joins).selectExpr(
        "left", "right", "shared_columns", "overlap_pct",
        "CASE WHEN size(candidate_keys) > 0 THEN 'possible_join' ELSE 'shared_schema' END AS hint",
    )
