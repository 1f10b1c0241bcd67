"""The pipeline: ingest, validate, transform, report - each stage logged.

Every stage writes its result below one folder and the next stage reads it from there,
so stages can also be run one by one. An exception ends the run; later stages neither
run nor log.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from orderflow.fixed_values import (
    STAGE_INGEST,
    STAGE_REPORTS,
    STAGE_TRANSFORM,
    STAGE_VALIDATE,
    SYNTHETIC_ROWS,
    VALID_CATEGORIES,
)
from orderflow.operators.generate import generate_orders
from orderflow.operators.profile import at_hand, null_report, row_profile, score_summary
from orderflow.operators.rules import order_rules
from orderflow.operators.schema import (
    cell_findings,
    found_types,
    fractional_columns,
    nan_to_null,
    require_columns,
    require_numbers,
    standardize_columns,
    text_ids,
    with_order_types,
)
from orderflow.operators.validation import profile_and_clean
from orderflow.plans.governance import column_catalog, read_dictionary
from orderflow.plans.lineage import StageRun, new_run_id
from orderflow.plans.reports import REPORTS, export_reports
from orderflow.plans.warehouse import (
    TABLES,
    build_warehouse,
    object_names,
    read_warehouse,
    register_warehouse,
)
from orderflow.sources import versions
from orderflow.sources.csv_files import read_csv, write_csv
from orderflow.sources.lineage_log import flatten_log, read_log

RAW = "raw/raw_orders"
STAGING = "staging/staging_orders"
VALIDATED = "staging/validated_orders"
WAREHOUSE = "warehouse"
REPORTS_FOLDER = "reports"
LINEAGE_LOG = "metadata/lineage_log"
DICTIONARY = "metadata/data_dictionary"


@dataclass
class Pipeline:
    """One run over one output folder."""

    spark: SparkSession
    folder: str
    run_id: str = field(default_factory=new_run_id)
    column_map: Mapping[str, str] = field(default_factory=dict)
    valid_categories: Iterable[str] = VALID_CATEGORIES
    email_mode: str = "literal"
    multi_line: bool | None = None  # whether CSV fields may hold newlines; None finds out by a scan

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str) -> DataFrame:
        """The current version of a table of the run."""
        return versions.current(self.spark, self.path(name))

    def lineage(self) -> DataFrame:
        return read_log(self.spark, self.path(LINEAGE_LOG))

    def _log(self, stage_name: str, source: str, target: str, rows_in: int, rows_out: int, **more):
        done = StageRun(self.run_id, stage_name, source, target, rows_in, rows_out, **more)
        done.log(self.spark, self.path(LINEAGE_LOG))

    def _has_raw(self) -> bool:
        try:
            self.spark.read.text(self.path(RAW))
        except AnalysisException:
            return False
        return True

    def generate(self, rows: int = SYNTHETIC_ROWS) -> None:
        """Write synthetic raw orders as CSV unless raw orders are there already."""
        if not self._has_raw():
            write_csv(generate_orders(self.spark, rows), self.path(RAW))

    def ingest(self, source: DataFrame | str | None = None, source_name: str = RAW) -> None:
        """Standardise headers and missing values; nothing else is changed.

        What validation needs to know of the cells is noted by the same write.
        """
        if source is None:
            source = self.path(RAW)
        elif isinstance(source, str):
            source_name = source
        raw = read_csv(self.spark, source, self.multi_line) if isinstance(source, str) else nan_to_null(source)
        orders = standardize_columns(raw, self.column_map)
        rows = versions.publish(orders, self.path(STAGING), cell_findings(orders))
        self._log(
            STAGE_INGEST,
            source_name,
            STAGING,
            rows,
            rows,
            columns=orders.columns,
            transformation="Read raw orders and standardized the column names.",
        )

    def validate(self) -> None:
        """Check the schema, profile, clean, profile again, report."""
        staged = self.read(STAGING)
        require_columns(staged)
        found = versions.notes(self.spark, self.path(STAGING))
        mismatches = [r.asDict() for r in found_types(self.spark, found).collect()]
        require_numbers(found)
        typed = with_order_types(staged, fractional_columns(found, mismatches), text_ids(mismatches))
        orders = nan_to_null(typed)
        rules = order_rules(self.valid_categories)
        before = profile_and_clean(orders, rules, self.path(VALIDATED), self.email_mode)
        after = at_hand(row_profile(self.read(VALIDATED), rules))
        summary = at_hand(score_summary(before, after))
        write_csv(at_hand(null_report(before, after)).coalesce(1), self.path(f"{REPORTS_FOLDER}/data_quality_report"))
        write_csv(summary.coalesce(1), self.path(f"{REPORTS_FOLDER}/quality_score_summary"))
        metrics = {r.metric: r.value for r in summary.collect()}
        self._log(
            STAGE_VALIDATE,
            STAGING,
            VALIDATED,
            int(metrics["rows_before"]),
            int(metrics["rows_after"]),
            columns=orders.columns,
            transformation=(
                "Checked the schema; filled or dropped missing values; removed copies; "
                "kept positive quantities and prices; unified categories; recomputed amounts."
            ),
            extra={
                "quality_score_before": metrics["quality_score_before"],
                "quality_score_after": metrics["quality_score_after"],
                "improvement_points": metrics["improvement_points"],
                "duplicates_removed": int(metrics["duplicate_rows_removed"]),
                "schema_type_mismatches": mismatches,
            },
        )

    def transform(self) -> None:
        """Build the star schema and register tables and views."""
        orders = self.read(VALIDATED)
        rows = build_warehouse(orders, self.path(WAREHOUSE))
        register_warehouse(orders, self.tables())
        write_csv(column_catalog(self.spark, self._held(orders)), self.path(DICTIONARY))
        self._log(
            STAGE_TRANSFORM,
            VALIDATED,
            WAREHOUSE,
            versions.notes(self.spark, self.path(VALIDATED))["rows"],
            rows["fact_orders"],
            columns=orders.columns,
            transformation=f"Built the star schema ({', '.join(TABLES)}) and the reporting views.",
            extra={"objects_created": object_names()},
        )

    def _held(self, orders: DataFrame) -> dict[str, dict[str, DataFrame]]:
        """Every table and view of the run by the stage that makes it."""
        star = self.tables()
        return {
            STAGE_INGEST: {"raw_orders": self.read(STAGING)},
            STAGE_VALIDATE: {"validated_orders": orders},
            STAGE_TRANSFORM: star,
            STAGE_REPORTS: {f"vw_{name}": build(star) for name, build in REPORTS.items()},
        }

    def tables(self) -> dict[str, DataFrame]:
        return read_warehouse(self.spark, self.path(WAREHOUSE))

    def dictionary(self) -> DataFrame:
        return read_dictionary(self.spark, self.path(DICTIONARY))

    def report(self) -> dict[str, int]:
        """Export every report, log, then export the log itself. Rows per report."""
        rows = export_reports(self.tables(), self.path(REPORTS_FOLDER))
        total = sum(rows.values())
        files = [f"{REPORTS_FOLDER}/{name}" for name in [*rows, "lineage_log_flat"]]
        self._log(
            STAGE_REPORTS,
            WAREHOUSE,
            REPORTS_FOLDER,
            total,
            total,
            transformation="Exported the reporting views and the lineage log as CSV.",
            extra={"files_exported": files},
        )
        write_csv(flatten_log(self.lineage()), self.path(f"{REPORTS_FOLDER}/lineage_log_flat"))
        return rows

    def run(
        self, source: DataFrame | str | None = None, source_name: str = RAW
    ) -> dict[str, int]:
        """All stages. Without a source, raw orders are generated if there are none."""
        if source is None:
            self.generate()
        self.ingest(source, source_name)
        self.validate()
        self.transform()
        return self.report()
