"""Per-column actions, the cleaning checklist and transform, and the data dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.dataset import TEXT, Dataset, column_refs
from tableprobe.functions import text
from tableprobe.functions.sql import literal, present, quote
from tableprobe.operators.frequency import DISPLAY
from tableprobe.operators.schema import FLAGS

FIXED_CHECKLIST = ("keep_original_copy", "blank_strings_to_null", "confirm_target_and_drop_keys")
COUNTED_CHECKLIST = (
    ("decide_missing_values", "treat_missing_values"), ("drop_constants", "drop_from_modeling"),
    ("protect_sensitive", "mask_or_exclude"), ("separate_keys", "use_as_key"),
)

IS_KEY = "(possible_primary_key OR possible_id)"

REASONS = present((
    f"CASE WHEN is_target THEN 'target' WHEN {IS_KEY} THEN 'key' "
    "WHEN is_constant THEN 'constant' WHEN possible_sensitive THEN 'sensitive' END",
    "CASE WHEN null_count > 0 THEN 'missing_values' END",
    "CASE WHEN high_cardinality THEN 'high_cardinality' END",
    "CASE WHEN outlier_count IS NOT NULL THEN 'outliers' END",
    "CASE WHEN values_classed IS NOT NULL THEN 'mixed_types' END",
    "CASE WHEN invalid_dates IS NOT NULL THEN 'invalid_dates' END",
))

#: Reasons that a column of the dictionary shows unless asked for more.
NOTES = 2


def with_target(quality: DataFrame, targets: DataFrame) -> DataFrame:
    """Quality rows marked with whether the column is the target of its dataset."""
    picked = targets.where("detected").selectExpr("dataset_no", "column", "true AS picked")
    return quality.join(F.broadcast(picked), ["dataset_no", "column"], "left").selectExpr(
        "*", "coalesce(picked, false) AS is_target").drop("picked")


def column_actions(marked: DataFrame) -> DataFrame:
    """What to do with each column, why, and how urgently, from marked quality rows."""
    return marked.selectExpr(
        "dataset_no", "dataset", "ordinal", "column", "semantic_type",
        f"""CASE WHEN is_target THEN 'validate_target'
                 WHEN {IS_KEY} THEN 'use_as_key'
                 WHEN is_constant THEN 'drop_from_modeling'
                 WHEN possible_sensitive THEN 'mask_or_exclude'
                 WHEN null_count > 0 THEN 'treat_missing_values'
                 WHEN high_cardinality THEN 'validate_cardinality'
                 WHEN values_classed IS NOT NULL THEN 'fix_type_consistency'
                 WHEN invalid_dates IS NOT NULL THEN 'fix_dates'
                 ELSE 'keep' END AS recommended_action""",
        f"""CASE WHEN is_target THEN 'target_candidate'
                 WHEN {IS_KEY} THEN 'join_or_identifier'
                 WHEN possible_sensitive AND NOT is_constant THEN 'sensitive_candidate'
                 ELSE 'feature_candidate' END AS role""",
        f"{REASONS} AS reason_codes",
    ).selectExpr(
        "*", "CASE WHEN recommended_action = 'keep' THEN 'normal' ELSE 'high' END AS priority")


def ordered_actions(actions: DataFrame) -> DataFrame:
    """High priority first, then table order."""
    return actions.orderBy("dataset_no", F.expr("priority != 'high'"), "ordinal")


def cleaning_checklist(actions: DataFrame) -> DataFrame:
    """dataset, position, item, columns: three fixed items, then one per kind of work found."""
    counted = actions.groupBy("dataset_no", "dataset").agg(*[
        F.expr(f"nullif(count_if(recommended_action = '{action}'), 0) AS {item}")
        for item, action in COUNTED_CHECKLIST
    ])
    items = [f"named_struct('position', {n}, 'item', '{item}', 'columns', cast(null AS bigint))"
             for n, item in enumerate(FIXED_CHECKLIST)]
    items += [
        f"CASE WHEN {item} IS NOT NULL THEN "
        f"named_struct('position', {n}, 'item', '{item}', 'columns', {item}) END"
        for n, (item, _) in enumerate(COUNTED_CHECKLIST, start=len(FIXED_CHECKLIST))
    ]
    return counted.selectExpr("dataset", f"inline({present(items)})")


def apply_cleaning_plan(
    dataset: Dataset, actions: DataFrame, keep_sensitive: bool = False
) -> DataFrame:
    """The cleaned table as one projection.

    Blank texts become null, constant and sensitive columns go, and columns whose missing values
    need treatment get a flag column. The plan, one row per column, decides on the output schema.
    """
    plan = {
        r["column"]: r["recommended_action"]
        for r in actions.where(f"dataset = {literal(dataset.name)}")
        .select("column", "recommended_action").collect()
    }
    dropped = {"drop_from_modeling"} | (set() if keep_sensitive else {"mask_or_exclude"})
    columns, flags = [], []
    for ref in column_refs([dataset]):
        if plan.get(ref.name) in dropped:
            continue
        value = ref.sql
        if ref.kind == TEXT:
            value = f"CASE WHEN NOT {text.is_blank(ref.sql)} THEN {ref.sql} END"
        columns.append(f"{value} AS {ref.sql}")
        if plan.get(ref.name) == "treat_missing_values":
            flags.append(f"({value}) IS NULL AS {quote(ref.name + '__is_null')}")
    return dataset.df.selectExpr(*columns, *flags)


def data_dictionary(
    marked: DataFrame, actions: DataFrame, samples: DataFrame, notes: int | None = NOTES,
) -> DataFrame:
    """One row per column with its role, action, figures, the non-blank ones of the samples, and its first
    reasons as notes, all for None."""
    noted = "reason_codes" if notes is None else f"slice(reason_codes, 1, {notes})"
    shown = samples.selectExpr("cid", "rank", f"{DISPLAY} AS value").where(
        f"NOT {text.is_blank('value')}")
    examples = shown.groupBy("cid").agg(F.expr(
        "transform(sort_array(collect_list(named_struct('rank', rank, 'value', value))), "
        "e -> e.value) AS examples"))
    own = actions.selectExpr(
        "dataset_no", "column", "recommended_action", "role AS action_role", "reason_codes")
    return marked.join(own, ["dataset_no", "column"]).join(examples, "cid", "left").selectExpr(
        "dataset", "ordinal", "column", "dtype", "semantic_type",
        f"CASE WHEN is_target THEN 'target_candidate' WHEN {IS_KEY} THEN 'join_or_identifier' "
        "WHEN possible_sensitive THEN 'sensitive_candidate' ELSE action_role END AS role",
        "recommended_action", "null_pct", "unique_count", "unique_rate", "possible_sensitive",
        f"array_join({FLAGS}, ',') AS flags",
        "coalesce(examples, cast(array() AS array<string>)) AS examples",
        f"{noted} AS notes",
    )
