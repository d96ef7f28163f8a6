"""Reports on storage: Parquet sections in a hidden folder, made visible by one manifest.

A report's sections are written below `_sections`, which Spark's readers and the history skip. Its manifest,
one row that names them, is written last, as one file that appears whole or not at all. What has no manifest
does not exist for readers, so a run that breaks leaves nothing visible.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

REPORT_ID = r"^[a-f0-9]{12}$"

# Sections of a stored report and the profile attribute that holds each.
SECTIONS = {
    "summary": "summary", "columns": "column_profile", "problems": "problems",
    "numeric_stats": "numeric_stats", "targets": "targets", "readiness": "readiness",
    "score_parts": "score_parts", "column_actions": "column_actions",
    "cleaning_checklist": "cleaning_checklist", "data_dictionary": "data_dictionary",
    "signals": "signals", "recommendation": "recommendation", "decision": "decision",
    "type_counts": "type_counts", "categorical_stats": "categorical_stats",
    "target_candidates": "target_candidates", "target_distribution": "target_distribution",
    "preview": "preview", "problem_legend": "problem_legend", "correlations": "correlations",
    "histograms": "histograms", "chart_nulls": "chart_nulls", "chart_problems": "chart_problems",
    "chart_outliers": "chart_outliers", "chart_categories": "chart_categories",
    "chart_datasets": "chart_datasets",
}
MULTI_SECTIONS = {
    "common_columns": "common_columns", "schema_overlap": "schema_overlap",
    "compatible_groups": "compatible_groups", "dataset_roles": "dataset_roles",
    "join_plan": "join_plan", "map_nodes": "map_nodes", "map_edges": "map_edges",
    "combined_summary": "combined_summary", "combined_readiness": "combined_readiness",
    "combined_recommendation": "combined_recommendation",
    "possible_joins": "possible_joins", "plan_warnings": "plan_warnings",
    "chart_shared": "chart_shared", "combined_columns": "combined_columns",
    "combined_problems": "combined_problems", "combined_dictionary": "combined_dictionary",
    "combined_target": "combined_target", "combined_score_parts": "combined_score_parts",
    "combined_signals": "combined_signals", "combined_decision": "combined_decision",
    "combined_actions": "combined_actions",
}


class ReportStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def save(self, profile) -> str:
        """Write every section of a profile and return the id of the report."""
        report_id = uuid.uuid4().hex[:12]
        sections = SECTIONS | (MULTI_SECTIONS if len(profile.datasets) > 1 else {})
        for section, attribute in sections.items():
            found = getattr(profile, attribute)
            self._write(found() if callable(found) else found, self._path(section, report_id))
        manifest = profile.summary.agg(
            F.expr("count(1) AS dataset_count"), F.expr("sum(row_count) AS row_count"),
            F.expr("array_join(sort_array(collect_list(dataset)), ',') AS datasets"),
        ).withColumns({
            "id": F.lit(report_id), "created_at": F.lit(datetime.now(timezone.utc)),
            "sections": F.lit(list(sections)),
        })
        self._write(manifest.coalesce(1), f"{self.root}/history/report_id={report_id}")
        return report_id

    def _path(self, section: str, report_id: str) -> str:
        return f"{self.root}/_sections/{report_id}/{section}"

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.mode("error").parquet(path)

    def _open(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.option("ignoreCorruptFiles", True).parquet(path)
        except AnalysisException:
            return None

    def sections(self, report_id: str) -> list[str]:
        """Names of the sections that the manifest of a report lists; none if it has no manifest."""
        if not re.match(REPORT_ID, report_id):
            return []
        manifest = self._open(f"{self.root}/history/report_id={report_id}")
        row = manifest.select("sections").first() if manifest is not None else None
        return list(row["sections"]) if row else []

    def read(self, report_id: str, section: str) -> DataFrame | None:
        """A section of a report, or None for an id or section that is not there."""
        return self.spark.read.parquet(self._path(section, report_id)) if section in self.sections(report_id) else None

    def report(self, report_id: str) -> dict[str, DataFrame] | None:
        """All sections of a report."""
        return {s: self.spark.read.parquet(self._path(s, report_id)) for s in self.sections(report_id)} or None

    def history(self) -> DataFrame | None:
        """Stored reports, newest first; unreadable ones are skipped."""
        found = self._open(f"{self.root}/history")
        return None if found is None else found.drop("report_id", "sections").orderBy(F.desc("created_at"), "id")
