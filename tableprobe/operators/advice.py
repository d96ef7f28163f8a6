"""Signals of a profile, the rules they satisfy, and the merged recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.sql import literal, present, records, share
from tableprobe.plans.catalogs import DEFAULT_RULE, SENSITIVE_EXTRA

#: Rules whose advice is merged unless asked for more, and the place of warnings behind all rules.
MERGED_RULES, BEHIND = 4, 1_000_000

_CATEGORICAL = "(categorical_columns + boolean_columns)"
_TEXTS = "(text_columns + long_text_columns)"

# Condition of each signal over the drivers of a dataset, in their fixed order.
SIGNALS = {
    "multi_dataset": "dataset_count > 1",
    "has_relationship_candidates": "possible_join_count > 0",
    "tabular": "column_count > 0 AND "
               f"numeric_columns + {_CATEGORICAL} >= greatest(1, floor(column_count / 2))",
    "small_dataset": "row_count <= 100000",
    "large_dataset": "row_count > 100000",
    "clean": "max_null_pct < 10 AND duplicate_pct < 5 "
             "AND problem_count <= greatest(3, column_count)",
    "many_nulls_or_inconsistencies": "max_null_pct >= 20 OR null_pct >= 10 OR type_problems > 0",
    "has_target": "has_target",
    "no_target": "NOT has_target",
    "target_imbalanced": "target_imbalanced",
    "many_categorical": f"column_count > 0 AND {share(_CATEGORICAL, 'column_count')} >= 0.35",
    "short_text": "text_columns > 0",
    "long_text": "long_text_columns > 0",
    "api_source": "source_type = 'api'",
    "sql_source": "source_type = 'sql'",
    "large_sql": "source_type = 'sql' AND row_count >= 50000",
    "json_or_documental": f"source_type = 'api' AND {_TEXTS} > 0",
    "sensitive_data": "sensitive_columns > 0",
    "natural_language_questions": "mentions_natural_language",
}


def signals(drivers: DataFrame) -> DataFrame:
    """dataset, signals: the names of the signals that hold.

    Drivers of a single table may lack dataset_count and possible_join_count.
    """
    given = ["*"]
    given += [f"{default} AS {name}"
              for name, default in (("dataset_count", 1), ("possible_join_count", 0))
              if name not in drivers.columns]
    held = present(f"CASE WHEN {test} THEN '{name}' END" for name, test in SIGNALS.items())
    return drivers.selectExpr(*given).selectExpr("dataset", f"{held} AS signals")


def rule_matches(signalled: DataFrame, rules: DataFrame) -> DataFrame:
    """dataset, rule_id, rank: rules whose signals all hold; the default where none does."""
    fits = F.expr(
        "size(array_except(must, signals)) = 0 AND NOT arrays_overlap(must_not, signals)")
    # The default has the lowest priority and always fits: it counts only when it comes first.
    return signalled.join(F.broadcast(rules), fits).selectExpr(
        "dataset", "rule_id", "priority", "confidence",
        "row_number() OVER (PARTITION BY dataset ORDER BY priority DESC, rule_id) AS rank",
    ).where(f"rule_id != '{DEFAULT_RULE}' OR rank = 1")


def recommendation(
    matches: DataFrame, signalled: DataFrame, advice: DataFrame, rules: int | None = MERGED_RULES,
) -> DataFrame:
    """dataset, field, position, item: advice of the leading rules, of all for None, repeats dropped."""
    leading = matches if rules is None else matches.where(f"rank <= {rules}")
    items = leading.join(F.broadcast(advice), "rule_id").where(
        "field != 'approach' OR rank = 1"
    ).selectExpr("dataset", "field", "rank", "position AS place", "item")
    confidence = matches.where("rank = 1").selectExpr(
        "dataset", "'confidence' AS field", "rank", "1 AS place", "confidence AS item")
    extra = records(
        {"field": literal(field), "rank": str(BEHIND), "place": "1", "item": literal(item)}
        for field, item in SENSITIVE_EXTRA
    )
    warned = signalled.where("array_contains(signals, 'sensitive_data')").selectExpr(
        "dataset", f"inline({extra})")
    first = items.union(confidence).union(warned).groupBy("dataset", "field", "item").agg(
        F.expr("min(named_struct('rank', rank, 'place', place)) AS first_at"))
    return first.selectExpr(
        "dataset", "field",
        "row_number() OVER (PARTITION BY dataset, field ORDER BY first_at) AS position", "item",
    )
