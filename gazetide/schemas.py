"""Row shapes. Text columns are never NULL: the empty string means "missing"."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM_TEXT = ["source", "date", "department", "title", "link", "category", "summary", "date_source"]

# ``ord`` is the reading order of an item (publisher, route, place on the page): unique,
# not negative and below 2**60.
ITEM = T.StructType(
    [T.StructField("ord", T.LongType(), False)] + [T.StructField(c, T.StringType(), False) for c in ITEM_TEXT]
)

ROUTE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("parser", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("official", T.BooleanType()),
        T.StructField("coverage_reduced", T.BooleanType()),
    ]
)

CATALOG = T.StructType(
    [
        T.StructField("src_order", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("urls", T.ArrayType(T.StringType())),
        T.StructField("aggregate_routes", T.BooleanType()),
        T.StructField("routes", T.ArrayType(ROUTE)),
    ]
)

CAPTURE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("route_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("parser", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("transport_error", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("elapsed_seconds", T.DoubleType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)

POLICY = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField(
            "initiatives",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("lead_source", T.StringType()),
                        T.StructField("strong_keywords", T.ArrayType(T.StringType())),
                        T.StructField("context_keywords", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
        T.StructField("general_keywords", T.ArrayType(T.StringType())),
        T.StructField("negative_keywords", T.ArrayType(T.StringType())),
        T.StructField(
            "thresholds",
            T.StructType(
                [
                    T.StructField("high", T.IntegerType()),
                    T.StructField("possible", T.IntegerType()),
                    T.StructField("negative_penalty", T.IntegerType()),
                ]
            ),
        ),
    ]
)

REPORT = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("failed_sources", T.ArrayType(T.StringType())),
        T.StructField("anomalies", T.ArrayType(T.StringType())),
        T.StructField("failure_class_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField(
            "source_health",
            T.StructType(
                [
                    T.StructField(c, T.LongType())
                    for c in ("healthy_count", "unstable_count", "failed_count", "fallback_source_count")
                ]
            ),
        ),
        T.StructField(
            "quality",
            T.StructType(
                [
                    T.StructField("alert_reasons", T.ArrayType(T.StringType())),
                    T.StructField("input_count", T.LongType()),
                    T.StructField("output_count", T.LongType()),
                    T.StructField("duplicate_count", T.LongType()),
                ]
            ),
        ),
        T.StructField("relevance_policy", T.MapType(T.StringType(), T.StringType())),
        T.StructField("output_file", T.StringType()),
        T.StructField("report_file", T.StringType()),
    ]
)


def as_items(df: DataFrame) -> DataFrame:
    """Bring rows to the item shape: absent columns and NULLs become their defaults."""
    defaults = {"date_source": "published"}
    columns = [F.col("ord").cast("long")]
    for name in ITEM_TEXT:
        default = F.lit(defaults.get(name, ""))
        columns.append((F.coalesce(F.col(name), default) if name in df.columns else default).alias(name))
    return df.select(*columns)
