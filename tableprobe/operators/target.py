"""Which column looks like the modelling target, and how its classes are balanced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.sql import contains_any, one_of, percent, share
from tableprobe.functions.wordlists import STRONG_TARGET_NAMES, TARGET_HINTS
from tableprobe.operators.frequency import DISPLAY

THRESHOLD = 2.5
CANDIDATES = 5

CANDIDATE_SCORE = f"""
    CASE WHEN {one_of('lower(column)', STRONG_TARGET_NAMES)} THEN 9D
         WHEN {one_of('lower(column)', TARGET_HINTS)} THEN 5D
         WHEN {contains_any('lower(column)', TARGET_HINTS)} THEN 4D ELSE 0D END
    + CASE WHEN semantic_type IN ('boolean', 'categorical') AND unique_count BETWEEN 2 AND 20
           THEN 2D ELSE 0D END
    + CASE WHEN semantic_type = 'numeric' AND unique_count <= 20 AND unique_rate < 0.5
           THEN 1.5D ELSE 0D END
    + CASE WHEN ordinal = max(ordinal) OVER (PARTITION BY dataset_no) THEN 0.5D ELSE 0D END
    - CASE WHEN possible_sensitive THEN 1D ELSE 0D END
    - CASE WHEN unique_rate > 0.8 THEN 3D ELSE 0D END
    - CASE WHEN unique_count <= 1 THEN 2D ELSE 0D END"""

PROBLEM_TYPE = f"""
    CASE WHEN semantic_type IN ('text', 'long_text')
              THEN CASE WHEN {share('length_all', 'non_null')} > 60 THEN 'text'
                        ELSE 'classification' END
         WHEN kind IN ('whole', 'real') AND unique_count > greatest(20D, row_count * 0.05D)
              THEN 'regression'
         WHEN unique_count = 2 THEN 'binary_classification'
         WHEN unique_count > 2 THEN 'multiclass_classification'
         ELSE 'unknown' END"""


def target_candidates(facts: DataFrame) -> DataFrame:
    """Every column with its score and rank; ties go to the earlier column."""
    scored = facts.selectExpr("*", f"round({CANDIDATE_SCORE}, 2) AS score")
    return scored.selectExpr(
        "*", "row_number() OVER (PARTITION BY dataset_no ORDER BY score DESC, ordinal) AS rank")


def top_candidates(facts: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    return target_candidates(facts).where(f"rank <= {limit}").select(
        "dataset", "rank", "column", "score")


def chosen_columns(facts: DataFrame) -> DataFrame:
    """The best column of each dataset, where it is good enough."""
    return target_candidates(facts).where(f"rank = 1 AND score >= {THRESHOLD}")


def class_counts(chosen: DataFrame, frequencies: DataFrame) -> DataFrame:
    """cid, cnt of every class of the target columns; one target per dataset at most."""
    return frequencies.join(F.broadcast(chosen.select("cid")), "cid", "left_semi")


def class_balance(classes: DataFrame) -> DataFrame:
    """cid, and the counts of its most and least frequent class."""
    return classes.groupBy("cid").agg(F.expr("max(cnt) AS most"), F.expr("min(cnt) AS least"))


def targets(facts: DataFrame, chosen: DataFrame, balance: DataFrame) -> DataFrame:
    """One row per dataset: the target, its problem type and the balance of its classes."""
    described = chosen.join(balance, "cid", "left").selectExpr(
        "dataset_no", "column", "score", f"{PROBLEM_TYPE} AS problem_type",
        f"{percent('coalesce(most, 0)', 'greatest(non_null, 1)')} AS majority_class_pct",
        f"{percent('coalesce(least, 0)', 'greatest(non_null, 1)')} AS minority_class_pct",
    )
    return facts.select("dataset_no", "dataset").distinct().join(
        described, "dataset_no", "left"
    ).selectExpr(
        "dataset_no", "dataset", "column IS NOT NULL AS detected", "column", "score",
        "problem_type", "majority_class_pct", "minority_class_pct",
        "coalesce(problem_type IN ('binary_classification', 'multiclass_classification') "
        "AND majority_class_pct >= 75, false) AS imbalanced",
    )


def class_distribution(ranked: DataFrame, facts: DataFrame) -> DataFrame:
    names = F.broadcast(facts.select("cid", "dataset", "column"))
    return ranked.join(names, "cid").selectExpr(
        "dataset", "column", "rank", f"{DISPLAY} AS value", "cnt")
