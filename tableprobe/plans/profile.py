"""A profile of one or many tables: staged intermediates and lazily derived report sections."""

from __future__ import annotations

from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.dataset import TEXT, Dataset, column_refs, unique_names
from tableprobe.operators import (
    actions, advice, chartdata, frequency, metrics, quality, ranks, readiness, relations, rows,
    schema, sketches, statistics, target,
)
from tableprobe.plans import catalogs
from tableprobe.staging import Stage

COMBINED = "all tables"


class Profile:
    """Sections of the report over the given tables, each a DataFrame keyed by `dataset`.

    Data is read for a few intermediates only: column metrics, value frequencies, range-partitioned
    numbers, and duplicate counts. All sections are joins and expressions over these, built on
    first use. With `approximate`, sketches stand in for the frequencies wherever a section does
    not show values, so that no value is shuffled.
    """

    def __init__(
        self, datasets: list[Dataset], objective: str | None = None,
        decimal_as_categorical: bool = False, approximate: bool = False,
        merged_rules: int | None = advice.MERGED_RULES, notes: int | None = actions.NOTES,
        examples: int | None = 5, dominant_format: bool = False,
    ):
        if not datasets:
            raise ValueError("nothing to profile")
        names = unique_names([d.name for d in datasets])
        self.datasets = [
            Dataset(n, d.df, d.source, d.metadata) for n, d in zip(names, datasets)
        ]
        self.objective = objective
        self.approximate = approximate
        # Whether only the most frequent date format of a column counts as dates.
        self.dominant_format = dominant_format
        # Widths of the advice and the dictionary, None for all.
        self.merged_rules, self.notes, self.examples = merged_rules, notes, examples
        self.spark: SparkSession = datasets[0].df.sparkSession
        self.refs = column_refs(self.datasets, decimal_as_categorical)
        if not self.refs:
            raise ValueError("the tables have no columns")
        self.stage = Stage(self.spark)

    # Intermediates. Those that grow with the data are staged on shared storage; those with a
    # row per column or dataset become local relations.

    @property
    def metrics(self) -> DataFrame:
        return self.stage.small("metrics", lambda: metrics.column_metrics(
            self.datasets, self.refs, self.dominant_format, None if self.approximate else self.other_freq))

    @property
    def date_formats(self) -> DataFrame:
        """Columns with dates in texts: their most frequent format, its dates, and those in others."""
        if not self.dominant_format:
            raise ValueError("date formats are counted with dominant_format=True only")
        if "date_format" not in self.metrics.columns:  # no texts at all
            none = ("string(null) AS date_format", "bigint(null) AS dates", "bigint(null) AS other_dates")
            return self.metrics.where("false").selectExpr("dataset", "column", *none)
        return self.metrics.where("date_format IS NOT NULL").selectExpr(
            "dataset", "column", "date_format", "format_dates AS dates", "other_dates")

    def _frequencies(self, name: str, refs) -> DataFrame:
        return self.stage.table(name, lambda: frequency.value_frequencies(self.datasets, refs))

    @property
    def number_freq(self) -> DataFrame:
        return self._frequencies("number_frequencies", [r for r in self.refs if r.numeric])

    @property
    def other_freq(self) -> DataFrame:
        return self._frequencies("other_frequencies", [r for r in self.refs if not r.numeric])

    @property
    def value_freq(self) -> DataFrame:
        """cid, num, whole, txt, cnt for every distinct non-null value.

        Numbers are staged apart from texts, so that sections of numbers do not wait for texts.
        """
        self.stage.together(lambda: self.number_freq, lambda: self.other_freq)
        return self.number_freq.union(self.other_freq)

    @property
    def numbers(self) -> DataFrame:
        return self.stage.table("numbers", lambda: ranks.ranged_numbers(self.number_freq))

    @property
    def duplicates(self) -> DataFrame:
        prints = self.stage.table("prints", lambda: rows.repeated_prints(self.datasets))
        return self.stage.small("duplicates", lambda: rows.duplicate_counts(self.datasets, prints))

    @property
    def empty_rows(self) -> DataFrame:
        return self.stage.small(
            "empty_rows", lambda: rows.empty_rows(self.datasets, self.refs, self.metrics))

    def prepare(self, duplicates: bool = False, ranks: bool = False) -> "Profile":
        """Run the jobs that read the data concurrently."""
        values = (
            (lambda: self.sketches if ranks else self._distinct) if self.approximate
            else (lambda: self.number_freq)
        )
        more = [] if self.approximate else [lambda: self.other_freq]
        more += [lambda: self.numbers] if ranks and not self.approximate else []
        more += [lambda: self.duplicates] if duplicates else []
        self.stage.together(lambda: self.metrics, values, *more)
        return self

    @property
    def sketches(self) -> DataFrame:
        return self.stage.small(
            "sketches", lambda: sketches.value_sketches(self.datasets, self.refs))

    @property
    def _distinct(self) -> DataFrame:
        if self.approximate:
            return self.stage.small(
                "distinct", lambda: sketches.distinct_counts(self.datasets, self.refs))
        return frequency.distinct_counts(self.value_freq)

    @property
    def facts(self) -> DataFrame:
        """Everything known per column before the quality checks."""
        def build():
            self.prepare()
            return schema.column_facts(self.metrics, self._distinct)
        return self.stage.small("facts", build)

    @property
    def quarters(self) -> DataFrame:
        def build():
            if self.approximate:
                return self.sketches.where("q1 IS NOT NULL").select("cid", "q1", "median", "q3")
            totals = self.stage.small("slices", lambda: ranks.slice_totals(self.numbers))
            return ranks.quartiles(self.numbers, totals)
        return self.stage.small("quarters", build)

    @property
    def quality(self) -> DataFrame:
        def build():
            self.prepare(ranks=True)
            self.stage.together(lambda: self.facts, lambda: self.quarters)
            if self.approximate:
                normalised = self.sketches.select("cid", "top_count", "distinct_normalised")
                outside = sketches.outliers(self.datasets, self.refs, self.quarters)
            else:
                texts = [r.cid for r in self.refs if r.kind == TEXT]
                normalised = frequency.normalised_counts(self.value_freq, texts)
                outside = ranks.outliers(self.numbers, self.quarters)
            return quality.quality_checks(self.facts, normalised, outside)
        return self.stage.small("quality", build)

    # Schema and statistics.

    @cached_property
    def column_profile(self) -> DataFrame:
        return schema.column_profile(self.facts)

    @cached_property
    def column_flags(self) -> DataFrame:
        return schema.column_flags(self.facts)

    @cached_property
    def type_counts(self) -> DataFrame:
        return schema.type_counts(self.facts)

    @property
    def summary(self) -> DataFrame:
        def build():
            self.prepare(duplicates=True)
            found = schema.dataset_summary(self.facts, self.duplicates, self.empty_rows)
            return found.join(F.broadcast(schema.file_sizes(self.datasets)), "dataset_no", "left")
        return self.stage.small("summary", build)

    @cached_property
    def _texts(self) -> frequency.Texts:
        return frequency.Texts(self.datasets, self.refs)

    def top_values(self, limit: int | None = 5) -> DataFrame:
        """Most frequent values per column, all for None."""
        return statistics.described(
            frequency.ranked_values(self.value_freq, self._texts, limit), self.metrics)

    def sample_values(self, limit: int | None = 5) -> DataFrame:
        """The first distinct values in value order, all for None."""
        return statistics.described(
            frequency.ranked_values(self.value_freq, self._texts, limit, by_count=False), self.metrics)

    @cached_property
    def numeric_stats(self) -> DataFrame:
        self.stage.together(lambda: self.metrics, lambda: self.quarters)
        return statistics.numeric_stats(self.metrics, self.quarters)

    @cached_property
    def categorical_stats(self) -> DataFrame:
        return statistics.categorical_stats(self.facts, self.value_freq, self._texts)

    def correlations(self, limit: int | None = None) -> DataFrame:
        means = {r["cid"]: r["mean"] for r in self.metrics.select("cid", "mean").collect()}
        return statistics.correlations(self.datasets, self.refs, limit, means)

    def histograms(self, limit: int | None = None) -> DataFrame:
        return statistics.histograms(self.metrics, self.numbers, limit)

    def preview(self, limit: int = 8) -> DataFrame:
        return rows.preview(self.datasets, limit)

    # Problems.

    @cached_property
    def problems(self) -> DataFrame:
        return quality.problems(self.quality)

    @cached_property
    def problems_explained(self) -> DataFrame:
        return quality.explained(self.problems, catalogs.issue_catalog(self.spark))

    @cached_property
    def problem_legend(self) -> DataFrame:
        return quality.legend(self.problems, catalogs.issue_catalog(self.spark))

    def issue_examples(self, dataset: str, key: str, limit: int = rows.ISSUE_EXAMPLES) -> DataFrame:
        number = [d.name for d in self.datasets].index(dataset)
        return rows.issue_examples(
            self.datasets[number], [r for r in self.refs if r.dataset_no == number],
            self.quality.where("outlier_count IS NOT NULL"), key, limit)

    # Target, scores, actions.

    @cached_property
    def target_candidates(self) -> DataFrame:
        return target.top_candidates(self.facts)

    @property
    def _class_counts(self) -> DataFrame:
        """Frequencies of the target columns; in approximate mode these alone are counted exactly."""
        chosen = target.chosen_columns(self.facts)
        if not self.approximate:
            return target.class_counts(chosen, self.value_freq)
        wanted = {r["cid"] for r in chosen.select("cid").collect()}
        return self._frequencies("target_classes", [r for r in self.refs if r.cid in wanted])

    @property
    def _target_balance(self) -> DataFrame:
        return self.stage.small("balance", lambda: target.class_balance(self._class_counts))

    @property
    def targets(self) -> DataFrame:
        return self.stage.small("targets", lambda: target.targets(
            self.facts, target.chosen_columns(self.facts), self._target_balance))

    @cached_property
    def target_distribution(self) -> DataFrame:
        return target.class_distribution(
            frequency.ranked_values(self._class_counts, self._texts, None), self.facts)

    def _gather(self) -> None:
        """Run what the scores need, with independent jobs side by side."""
        self.prepare(duplicates=True, ranks=True)
        self.stage.together(lambda: self.facts, lambda: self.quarters)
        self.stage.together(lambda: self.summary, lambda: self.quality, lambda: self.targets)

    @property
    def drivers(self) -> DataFrame:
        def build():
            self._gather()
            known = readiness.drivers(self.summary, self.problems, self.targets)
            return known.join(F.broadcast(self._context()), "dataset_no")
        return self.stage.small("drivers", build)

    def _context(self) -> DataFrame:
        """Source type and stated objective of every table."""
        given = pa.table({
            "dataset_no": pa.array(range(len(self.datasets)), pa.int32()),
            "source_type": pa.array([d.source.get("type") for d in self.datasets], pa.string()),
            "objective": pa.array([self.objective] * len(self.datasets), pa.string()),
        })
        return readiness.objective_signals(self.spark.createDataFrame(given))

    @cached_property
    def scores(self) -> DataFrame:
        return readiness.scored(self.drivers)

    @cached_property
    def readiness(self) -> DataFrame:
        return readiness.readiness(self.scores)

    @cached_property
    def score_parts(self) -> DataFrame:
        return readiness.score_parts(self.scores)

    @cached_property
    def top_problem_types(self) -> DataFrame:
        return readiness.top_problem_types(self.problems)

    @cached_property
    def marked(self) -> DataFrame:
        return actions.with_target(self.quality, self.targets)

    @cached_property
    def column_actions(self) -> DataFrame:
        return actions.column_actions(self.marked)

    @cached_property
    def cleaning_checklist(self) -> DataFrame:
        return actions.cleaning_checklist(self.column_actions)

    def cleaned(self, dataset: str, keep_sensitive: bool = False) -> DataFrame:
        chosen = next(d for d in self.datasets if d.name == dataset)
        return actions.apply_cleaning_plan(chosen, self.column_actions, keep_sensitive)

    @cached_property
    def data_dictionary(self) -> DataFrame:
        samples = frequency.ranked_values(self.value_freq, self._texts, self.examples, by_count=False)
        return actions.data_dictionary(self.marked, self.column_actions, samples, self.notes)

    # Advice.

    @cached_property
    def signals(self) -> DataFrame:
        return advice.signals(self.drivers)

    @cached_property
    def rule_matches(self) -> DataFrame:
        return advice.rule_matches(self.signals, catalogs.rule_catalog(self.spark))

    @cached_property
    def recommendation(self) -> DataFrame:
        return advice.recommendation(
            self.rule_matches, self.signals, catalogs.advice_catalog(self.spark), self.merged_rules)

    @cached_property
    def decision(self) -> DataFrame:
        return readiness.decisions(
            self.scores, self.targets, self.top_problem_types, self.recommendation)

    # Chart tables.

    def chart_nulls(self, limit: int | None = None) -> DataFrame:
        return chartdata.nulls_by_column(self.facts, limit)

    def chart_problems(self, limit: int | None = None) -> DataFrame:
        return chartdata.problems_by_column(self.problems, limit)

    def chart_outliers(self) -> DataFrame:
        return chartdata.outliers_by_column(self.quality)

    def chart_categories(self, columns: int | None = None, top: int | None = 10) -> DataFrame:
        return chartdata.categories(self.facts, self.value_freq, self._texts, columns, top)

    def chart_datasets(self) -> DataFrame:
        return chartdata.datasets(self.summary, self.problems)

    def chart_shared(self, limit: int | None = None) -> DataFrame:
        return chartdata.shared_columns(self.common_columns, limit)

    # Several tables.

    @property
    def column_names(self) -> DataFrame:
        """Normalised names as the schemas hold them; no table is read for them."""
        return self.stage.small("column_names", lambda: relations.normalised_names(
            self.spark.createDataFrame(
                [(r.dataset_no, r.dataset, r.name) for r in self.refs],
                "dataset_no int, dataset string, column string")))

    @property
    def named(self) -> DataFrame:
        return self.stage.small("named", lambda: relations.named_columns(self.key_flags))

    @property
    def key_flags(self) -> DataFrame:
        """Key flags need the facts only, so relations do not wait for the other checks."""
        return quality.key_flags(self.facts)

    @cached_property
    def common_columns(self) -> DataFrame:
        return relations.common_columns(self.named)

    @cached_property
    def possible_joins(self) -> DataFrame:
        return relations.possible_joins(self.common_columns)

    @cached_property
    def schema_overlap(self) -> DataFrame:
        return relations.schema_overlap(self.column_names)

    @cached_property
    def compatible_groups(self) -> DataFrame:
        return relations.compatible_groups(self.column_names)

    @cached_property
    def relation_counts(self) -> DataFrame:
        return relations.relation_counts(self.common_columns, self.compatible_groups)

    @cached_property
    def combined_columns(self) -> DataFrame:
        return relations.qualified(self.column_profile)

    @cached_property
    def combined_problems(self) -> DataFrame:
        return relations.qualified(self.problems)

    @cached_property
    def combined_dictionary(self) -> DataFrame:
        return relations.qualified(self.data_dictionary)

    @cached_property
    def combined_summary(self) -> DataFrame:
        return relations.combined_summary(self.summary, self.relation_counts, COMBINED)

    @cached_property
    def combined_target(self) -> DataFrame:
        return relations.combined_target(self.targets, COMBINED)

    @cached_property
    def dataset_roles(self) -> DataFrame:
        return relations.dataset_roles(self.summary, self.targets, self.key_flags)

    @cached_property
    def join_plan(self) -> DataFrame:
        return relations.join_plan(self.schema_overlap, self.possible_joins)

    @cached_property
    def plan_warnings(self) -> DataFrame:
        return relations.plan_warnings(self.relation_counts)

    @cached_property
    def map_nodes(self) -> DataFrame:
        return relations.map_nodes(self.summary, self.targets)

    @cached_property
    def map_edges(self) -> DataFrame:
        return relations.map_edges(self.schema_overlap, self.possible_joins)

    @property
    def combined_drivers(self) -> DataFrame:
        def build():
            self._gather()
            one = self._context().limit(1).withColumn("source_type", F.lit("multi_file"))
            found = self.problems.withColumn("dataset_no", F.lit(0))
            known = readiness.drivers(self.combined_summary, found, self.combined_target)
            return known.join(F.broadcast(one.drop("dataset_no")))
        return self.stage.small("combined_drivers", build)

    @cached_property
    def combined_scores(self) -> DataFrame:
        return readiness.scored(self.combined_drivers)

    @cached_property
    def combined_readiness(self) -> DataFrame:
        return readiness.readiness(self.combined_scores)

    @cached_property
    def combined_score_parts(self) -> DataFrame:
        return readiness.score_parts(self.combined_scores)

    @cached_property
    def combined_signals(self) -> DataFrame:
        return advice.signals(self.combined_drivers)

    @cached_property
    def combined_rule_matches(self) -> DataFrame:
        return advice.rule_matches(self.combined_signals, catalogs.rule_catalog(self.spark))

    @cached_property
    def combined_recommendation(self) -> DataFrame:
        return advice.recommendation(
            self.combined_rule_matches, self.combined_signals,
            catalogs.advice_catalog(self.spark), self.merged_rules)

    @cached_property
    def combined_decision(self) -> DataFrame:
        found = self.problems.select(
            F.lit(0).alias("dataset_no"), F.lit(COMBINED).alias("dataset"), "type")
        return readiness.decisions(
            self.combined_scores, self.combined_target,
            readiness.top_problem_types(found), self.combined_recommendation)

    @cached_property
    def combined_actions(self) -> DataFrame:
        """Actions of the combined report: only the combined target counts as a target."""
        numbers = self.summary.selectExpr("dataset_no", "dataset AS target_dataset")
        picked = self.combined_target.drop("dataset_no").join(numbers, "target_dataset").selectExpr(
            "dataset_no", "target_column AS column", "detected")
        return relations.qualified(
            actions.column_actions(actions.with_target(self.quality, picked)))


def profile_tables(tables: dict[str, DataFrame], **options) -> Profile:
    """Profile DataFrames by name."""
    return Profile([Dataset(name, df) for name, df in tables.items()], **options)
