"""Reading run reports, also older ones that lack fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetide.schemas import REPORT


def with_report_defaults(report: DataFrame, keep: list[str] | None = None) -> DataFrame:
    empty = F.array().cast("array<string>")
    return report.select(
        *(keep or []),
        "status",
        F.coalesce("failed_sources", empty).alias("failed_sources"),
        F.coalesce("anomalies", empty).alias("anomalies"),
        F.coalesce("failure_class_counts", F.create_map().cast("map<string,bigint>")).alias("failure_class_counts"),
        "source_health",
        "quality",
        F.coalesce("relevance_policy", F.create_map().cast("map<string,string>")).alias("relevance_policy"),
        F.coalesce("output_file", F.lit("")).alias("output_file"),
        F.coalesce("report_file", F.lit("")).alias("report_file"),
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return with_report_defaults(spark.read.schema(REPORT).json(path, multiLine=True))


def parse_reports(text: Column) -> Column:
    """Report struct from JSON text."""
    return F.from_json(text, REPORT)
