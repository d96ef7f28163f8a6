"""Whole profiles of small tables against values derived by hand."""

import pytest

from tableprobe import Dataset, Profile
from tableprobe.plans.profile import COMBINED


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


@pytest.fixture(scope="module")
def orders_like(spark):
    df = spark.createDataFrame(
        [(1, "ok", "yes", 10.0), (2, "ok", "no", None), (3, "fail", "no", 30.0),
         (3, "fail", "no", 30.0)],
        "id bigint, status string, target string, value double")
    return Profile([Dataset("t", df)])


def test_summary(orders_like):
    s = orders_like.summary.first()
    assert (s.row_count, s.total_cells, s.null_cells, s.null_pct) == (4, 16, 1, 6.25)
    assert (s.duplicate_rows, s.duplicate_pct, s.rows_fully_empty) == (2, 50.0, 0)


def test_types_and_unique_counts(orders_like):
    got = rows(orders_like.column_profile.orderBy("ordinal"), "column", "semantic_type", "unique_count")
    assert got == [("id", "numeric", 3), ("status", "categorical", 2), ("target", "boolean", 2),
                   ("value", "numeric", 3)]


def test_problems(orders_like):
    assert rows(orders_like.problems, "column", "type", "severity", "details") == [
        ("value", "missing_values", "warning", "1")]


def test_target(orders_like):
    assert rows(orders_like.target_candidates.orderBy("rank"), "column", "score") == [
        ("target", 11.0), ("status", 7.0), ("value", 0.5), ("id", 0.0)]
    t = orders_like.targets.first()
    assert (t.column, t.problem_type, t.majority_class_pct, t.minority_class_pct, t.imbalanced) == (
        "target", "binary_classification", 75.0, 25.0, True)


def test_scores(orders_like):
    r = orders_like.readiness.first()
    assert (r.data_quality_score, r.data_quality_label) == (70, "needs_review")
    assert (r.modelling_score, r.modelling_label) == (72, "needs_review")
    assert r.join_score is None and r.join_label is None
    parts = dict(rows(orders_like.score_parts.where("score = 'data_quality'"), "part", "impact"))
    assert parts == {"base": 100.0, "nulls": -7.5, "duplicates": -20.0, "problems": -3.0,
                     "sensitive_columns": 0.0}


def test_rules(orders_like):
    assert rows(orders_like.rule_matches.orderBy("rank"), "rule_id") == [
        ("dirty_tabular_data",), ("imbalanced_target",), ("many_categorical_columns",)]


def test_actions(orders_like):
    from tableprobe.operators.actions import ordered_actions
    assert rows(ordered_actions(orders_like.column_actions), "column", "recommended_action") == [
        ("target", "validate_target"), ("value", "treat_missing_values"), ("id", "keep"),
        ("status", "keep")]


def test_decision(orders_like):
    d = orders_like.decision.first()
    assert (d.status, d.primary_action, d.target) == ("needs_validation", "treat_problems", "target")


def test_two_tables(spark):
    customers = spark.createDataFrame(
        [(1, "Ana", "no"), (2, "Bruno", "no"), (3, "Carla", "yes")],
        "customer_id bigint, name string, churn string")
    orders = spark.createDataFrame(
        [(10, 1, 100.0), (11, 1, 50.0), (12, 2, 75.0)],
        "order_id bigint, customer_id bigint, amount double")
    p = Profile([Dataset("customers", customers), Dataset("orders", orders)])
    problems = rows(p.problems.orderBy("dataset", "ordinal", "position"),
                    "dataset", "column", "type", "severity")
    columns = [("customers", "customer_id"), ("customers", "name"), ("orders", "order_id"),
               ("orders", "amount")]
    assert problems == [(d, c, t, "info") for d, c in columns
                        for t in ("possible_id", "possible_primary_key")]
    assert rows(p.column_profile.where("possible_sensitive"), "dataset", "column") == [
        ("customers", "name")]
    assert rows(p.common_columns, "name", "refs", "has_key") == [("customer_id", 2, True)]
    assert rows(p.schema_overlap, "left", "right", "shared_columns", "overlap_pct") == [
        ("customers", "orders", ["customer_id"], 20.0)]
    assert p.compatible_groups.count() == 0
    assert p.combined_target.first().column == "customers.churn"
    r = p.combined_readiness.first()
    assert (r.data_quality_score, r.modelling_score, r.join_score) == (86, 98, 85)
    assert rows(p.dataset_roles.orderBy("dataset_no"), "dataset", "role", "candidate_keys") == [
        ("customers", "primary_candidate", 2), ("orders", "dimension_candidate", 2)]
    assert rows(p.join_plan, "candidate_keys", "risk") == [(["customer_id"], "medium")]
    assert rows(p.map_edges, "left", "right", "hint") == [("customers", "orders", "possible_join")]
    assert p.map_nodes.count() == 2 and p.plan_warnings.count() == 0
    assert rows(p.combined_rule_matches.orderBy("rank"), "rule_id") == [
        ("multi_dataset_relationship_analysis",), ("sensitive_data",), ("short_text_data",)]
    assert p.combined_decision.first().dataset == COMBINED
    assert {r.column: r.recommended_action for r in p.combined_actions.collect()}[
        "customers.churn"] == "validate_target"


def test_duplicates_over_two_tables(spark):
    first = spark.createDataFrame([(1, "yes"), (1, "yes")], "id bigint, target string")
    second = spark.createDataFrame([(2, 10), (3, 20)], "id bigint, value bigint")
    p = Profile([Dataset("first", first), Dataset("second", second)])
    s = p.combined_summary.first()
    assert (s.duplicate_rows, s.duplicate_pct) == (2, 50.0)
    t = p.targets.where("dataset = 'first'").first()
    assert (t.detected, t.score, t.problem_type) == (True, 7.5, "unknown")


def test_dates_and_spelling(spark):
    df = spark.createDataFrame(
        [("bad",), ("Bad ",), ("2024-01-01",), ("bad",), ("Bad ",), ("bad",)], "event_date string")
    p = Profile([Dataset("t", df)])
    assert p.column_profile.first().semantic_type == "categorical"
    got = {r.type: (r.severity, r.details) for r in p.problems.collect()}
    assert got["invalid_dates"] == ("warning", '{"invalid":5,"checked":6,"pct":83.33}')
    assert got["inconsistent_values"] == ("info", '{"raw":3,"normalised":2}')


def test_named_target(spark):
    df = spark.createDataFrame([(20, "no"), (30, "no"), (40, "no"), (50, "yes")], "age bigint, churn string")
    p = Profile([Dataset("t", df)])
    t = p.targets.first()
    assert (t.column, t.score, t.problem_type, t.imbalanced) == (
        "churn", 11.5, "binary_classification", True)
    assert rows(p.target_candidates.orderBy("rank"), "column", "score")[1] == ("age", -3.0)


def test_no_target_and_objective(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 5)) for i in range(45)], "a double, b double")
    plain = Profile([Dataset("t", df)])
    asked = Profile([Dataset("t", df)], objective="Quero um Dashboard com perguntas")
    assert not plain.targets.first().detected
    ids = [r[0] for r in rows(asked.rule_matches.orderBy("rank"), "rule_id")]
    assert ids == [r[0] for r in rows(plain.rule_matches.orderBy("rank"), "rule_id")] + [
        "natural_language_layer"]
    assert ids[0] == "no_target"


def test_repeated_names_are_numbered(spark):
    df = spark.range(2)
    p = Profile([Dataset("a", df), Dataset("a", df), Dataset("b", df)])
    assert [d.name for d in p.datasets] == ["a", "a_2", "b"]
    assert rows(p.compatible_groups, "datasets", "column_count") == [(["a", "a_2", "b"], 1)]
