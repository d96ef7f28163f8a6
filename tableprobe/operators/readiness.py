"""Readiness scores with their breakdown, and the decision drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.sql import contains_any, records
from tableprobe.functions.wordlists import (
    OBJECTIVE_LANGUAGE, OBJECTIVE_PREDICTION, OBJECTIVE_RISK,
)


def label(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 80 THEN 'ready' WHEN {score} >= 55 THEN 'needs_review' "
        f"WHEN {score} IS NOT NULL THEN 'not_ready' END"
    )


def drivers(summary: DataFrame, problems: DataFrame, targets: DataFrame) -> DataFrame:
    """The figures that the scores are made of, per dataset."""
    counted = problems.groupBy("dataset_no").agg(*[F.expr(e) for e in (
        "count(1) AS problem_count",
        "count_if(severity = 'warning') AS warning_count",
        "count_if(type = 'high_cardinality') AS cardinality_problems",
        "count_if(type IN ('mixed_types', 'invalid_dates')) AS type_problems",
    )])
    picked = targets.select("dataset_no", "detected", "imbalanced")
    return summary.join(counted, "dataset_no", "left").join(picked, "dataset_no", "left").selectExpr(
        *summary.columns,
        *[f"coalesce({c}, 0L) AS {c}" for c in
          ("problem_count", "warning_count", "cardinality_problems", "type_problems")],
        "coalesce(detected, false) AS has_target",
        "coalesce(imbalanced, false) AS target_imbalanced",
    )


def scored(driven: DataFrame) -> DataFrame:
    """Penalties and scores. The join score needs the counts of relations, else it is null."""
    joins = "cast(null AS int)"
    if "common_column_count" in driven.columns:
        joins = """least(100, 35 + CASE WHEN common_column_count > 0 THEN 25 ELSE 0 END
            + CASE WHEN possible_join_count > 0 THEN 25 ELSE 0 END
            + CASE WHEN compatible_group_count > 0 THEN 10 ELSE 0 END)"""
    return driven.selectExpr(
        "*",
        "least(null_pct * 1.2D, 30D) AS null_penalty",
        "least(duplicate_pct * 1.5D, 20D) AS duplicate_penalty",
        "least(warning_count * 3 + (problem_count - warning_count) * 1.2D, 30D) AS problem_penalty",
        "least(double(sensitive_columns * 4), 16D) AS sensitive_penalty",
        "least(double(cardinality_problems * 2), 10D) AS cardinality_penalty",
        "CASE WHEN has_target THEN 12 ELSE -25 END AS target_impact",
        "CASE WHEN target_imbalanced THEN 10 ELSE 0 END AS imbalance_penalty",
        f"{joins} AS join_score",
    ).selectExpr(
        "*",
        "int(greatest(0D, bround(100 - null_penalty - duplicate_penalty - problem_penalty "
        "- sensitive_penalty, 0))) AS data_quality_score",
    ).selectExpr(
        "*",
        "int(greatest(0D, least(100D, bround(data_quality_score + target_impact "
        "- imbalance_penalty - cardinality_penalty, 0)))) AS modelling_score",
    )


def readiness(scores: DataFrame) -> DataFrame:
    return scores.selectExpr("dataset", *[
        e for name in ("data_quality", "modelling", "join")
        for e in (f"{name}_score", f"{label(name + '_score')} AS {name}_label")
    ])


def score_parts(scores: DataFrame) -> DataFrame:
    """dataset, score, position, part, impact: how each score came about."""
    parts = [
        ("data_quality", "base", "100D"),
        ("data_quality", "nulls", "-round(null_penalty, 1)"),
        ("data_quality", "duplicates", "-round(duplicate_penalty, 1)"),
        ("data_quality", "problems", "-round(problem_penalty, 1)"),
        ("data_quality", "sensitive_columns", "-round(sensitive_penalty, 1)"),
        ("modelling", "data_quality", "double(data_quality_score)"),
        ("modelling", "target", "double(target_impact)"),
        ("modelling", "imbalance", "-double(imbalance_penalty)"),
        ("modelling", "high_cardinality", "-cardinality_penalty"),
    ]
    if "common_column_count" in scores.columns:
        bonus = "CASE WHEN {} > 0 THEN {}D ELSE 0D END".format
        parts += [
            ("join", "base", "35D"),
            ("join", "common_columns", bonus("common_column_count", 25)),
            ("join", "join_candidates", bonus("possible_join_count", 25)),
            ("join", "compatible_schemas",
             "CASE WHEN compatible_group_count > 0 THEN 10D END"),
        ]
    rows = records(
        {"score": f"'{score}'", "position": str(n), "part": f"'{part}'", "impact": f"{impact} + 0D"}
        for n, (score, part, impact) in enumerate(parts)
    )
    return scores.selectExpr("dataset", f"inline({rows})").where("impact IS NOT NULL")


def top_problem_types(problems: DataFrame, limit: int = 3) -> DataFrame:
    """The most frequent problem types per dataset; ties by name."""
    counted = problems.groupBy("dataset_no", "dataset", "type").agg(F.expr("count(1) AS cnt"))
    return counted.selectExpr(
        "*", "row_number() OVER (PARTITION BY dataset_no ORDER BY cnt DESC, type) AS rank"
    ).where(f"rank <= {limit}")


def objective_signals(objectives: DataFrame) -> DataFrame:
    """Flags for what a stated objective mentions. Input has the column `objective`."""
    text = "lower(coalesce(objective, ''))"
    return objectives.selectExpr(
        "*",
        f"{contains_any(text, OBJECTIVE_LANGUAGE)} AS mentions_natural_language",
        f"{contains_any(text, OBJECTIVE_PREDICTION)} AS mentions_prediction",
        f"{contains_any(text, OBJECTIVE_RISK)} AS mentions_risk",
    )


def decisions(
    scores: DataFrame, targets: DataFrame, top_types: DataFrame, recommendation: DataFrame
) -> DataFrame:
    """One row of codes per dataset: may it be modelled, what to do first, the main risk."""
    types = top_types.groupBy("dataset_no").agg(F.expr(
        "array_join(transform(sort_array(collect_list(named_struct('rank', rank, 'type', type))), "
        "t -> t.type), ',') AS types"))
    first = "max(CASE WHEN field = '{}' THEN item END)".format
    advice = recommendation.where("position = 1").groupBy("dataset").agg(
        F.expr(f"{first('risks')} AS risk"), F.expr(f"{first('next_steps')} AS step"),
        F.expr(f"{first('approach')} AS approach"),
    )
    joined = scores.join(types, "dataset_no", "left").join(advice, "dataset", "left").join(
        targets.selectExpr("dataset_no", "column AS target"), "dataset_no", "left")
    return joined.selectExpr(
        "dataset",
        "CASE WHEN modelling_score < 55 THEN 'blocked' WHEN modelling_score < 80 "
        "THEN 'needs_validation' ELSE 'ready_for_baseline' END AS status",
        "CASE WHEN NOT has_target THEN 'confirm_target' WHEN problem_count > 0 "
        "THEN 'treat_problems' ELSE coalesce(step, 'review_summary') END AS primary_action",
        "coalesce(risk, 'none_found') AS main_risk", "target",
        "coalesce(types, '') AS top_problem_types", "approach",
    )
