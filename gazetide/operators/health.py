"""Route attempts: which happened, which route won, how healthy each publisher is.

Attempt rows have: source, attempt_no (order of the routes of a source), route_id, url,
url_host, route_kind, parser, priority, coverage_reduced, aggregate_routes, status
(success/failed), elapsed_seconds, item_count, failure_class, error_category, message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetide.functions.outcomes import error_category
from gazetide.operators.lookup import salted_lookup


def _ok() -> Column:
    return F.col("status") == "success"


def _failed() -> Column:
    return F.col("status") == "failed"


def made_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts up to the first success of a source; all of them for sources whose routes
    are read together."""
    first = attempts.groupBy("source").agg(
        F.min(F.when(_ok(), F.col("attempt_no"))).alias("_first"), F.count("*").alias("_rows")
    )
    return (
        salted_lookup(attempts, first, ["source"], F.col("attempt_no"), "_rows")
        .where(F.col("aggregate_routes") | F.col("_first").isNull() | (F.col("attempt_no") <= F.col("_first")))
        .drop("_first")
    )


def source_results(made: DataFrame) -> DataFrame:
    """One row per source from the attempts that were made. Only numbers and one struct per
    source leave a task: partial aggregates, however many attempts a source has."""
    failure = F.struct("failure_class", "error_category", "url_host", "message")
    route = F.struct("route_id", "url", "url_host", "priority", "coverage_reduced")
    at = F.col("attempt_no")
    per_source = made.groupBy("source").agg(
        F.count("*").alias("attempt_count"),
        F.count_if(_failed()).alias("failed_attempts"),
        F.count_if(_ok()).alias("successful_routes"),
        F.sum("elapsed_seconds").alias("elapsed_seconds"),
        F.max("aggregate_routes").alias("aggregated"),
        F.max_by(failure, F.when(_failed(), at)).alias("last_failure"),
        F.min_by(route, F.when(_ok(), at)).alias("first_success"),
        F.max_by(route, F.when(_ok(), at)).alias("last_success"),
    )
    won = F.col("successful_routes") > 0
    final = F.when(F.col("aggregated"), F.col("last_success")).otherwise(F.col("first_success"))
    return per_source.select(
        "source",
        F.when(won, F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        (won & (F.col("failed_attempts") > 0)).alias("unstable"),
        "attempt_count",
        "failed_attempts",
        F.round("elapsed_seconds", 3).alias("elapsed_seconds"),
        F.when(won, F.lit("")).otherwise(F.col("last_failure.failure_class")).alias("failure_class"),
        F.when(won, F.lit("")).otherwise(F.col("last_failure.error_category")).alias("error_category"),
        F.coalesce("last_failure.failure_class", F.lit("")).alias("last_failure_class"),
        F.coalesce("last_failure.url_host", F.lit("")).alias("evidence_host"),
        F.coalesce("last_failure.message", F.lit("")).alias("evidence_message"),
        F.coalesce(final["route_id"], F.lit("")).alias("final_route_id"),
        F.coalesce(final["url"], F.lit("")).alias("final_url"),
        F.coalesce(final["url_host"], F.lit("")).alias("final_url_host"),
        F.coalesce(~F.col("aggregated") & (final["priority"] > 1), F.lit(False)).alias("used_fallback"),
        F.coalesce(final["coverage_reduced"], F.lit(False)).alias("coverage_reduced"),
        F.col("aggregated"),
    )


def with_unknown_sources(results: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected sources without any attempt count as failed. A source of the catalog
    without routes is an outage; one outside the catalog is unknown. ``selected`` has the
    columns source and known."""
    silent = selected.join(results, "source", "left_anti")
    failure = F.when(F.col("known"), F.lit("source_outage")).otherwise(F.lit("unknown"))
    rows = silent.select(
        "source",
        F.lit("failed").alias("status"),
        F.lit(False).alias("unstable"),
        F.lit(0).cast("long").alias("attempt_count"),
        F.lit(0).cast("long").alias("failed_attempts"),
        F.lit(0.0).alias("elapsed_seconds"),
        failure.alias("failure_class"),
        error_category(failure).alias("error_category"),
        *[F.lit("").alias(c) for c in (
            "last_failure_class", "evidence_host", "evidence_message", "final_route_id", "final_url", "final_url_host",
        )],
        F.lit(False).alias("used_fallback"),
        F.lit(False).alias("coverage_reduced"),
        F.lit(False).alias("aggregated"),
    )
    return results.unionByName(rows)


def winning_routes(made: DataFrame, results: DataFrame) -> DataFrame:
    """(source, route_id) whose items count: the first success, or every success of a
    source whose routes are read together."""
    together = made.where(_ok() & F.col("aggregate_routes")).select("source", "route_id")
    single = results.where((F.col("status") == "success") & ~F.col("aggregated")).select(
        "source", F.col("final_route_id").alias("route_id")
    )
    return together.unionByName(single)


def failure_trail(made: DataFrame) -> DataFrame:
    """Failed attempts of every source in their order."""
    return made.where(_failed()).select("source", "attempt_no", "failure_class")


def failure_class_counts(results: DataFrame) -> DataFrame:
    return results.where(_failed()).groupBy("failure_class").agg(F.count("*").alias("source_count"))


def error_category_counts(made: DataFrame) -> DataFrame:
    return made.where(F.col("error_category") != "").groupBy("error_category").agg(F.count("*").alias("attempt_count"))


def health_rollup(results: DataFrame) -> DataFrame:
    """One row of health counters. ``coverage_reduced_count`` is counted from the winning
    routes."""
    return results.agg(
        F.count_if(_ok() & ~F.col("unstable")).alias("healthy_count"),
        F.count_if("unstable").alias("unstable_count"),
        F.count_if(_failed()).alias("failed_count"),
        F.count_if("used_fallback").alias("fallback_source_count"),
        F.count_if("coverage_reduced").alias("coverage_reduced_count"),
        F.lit(0).cast("long").alias("ssl_fallback_host_count"),
    )
