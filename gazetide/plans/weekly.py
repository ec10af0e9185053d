"""A whole run: captures of one week to digest, diagnostics and report."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetide.functions.exprs import text_array
from gazetide.functions.dates import DateRange, resolve_range
from gazetide.operators import affiliation as A
from gazetide.operators import digest as D
from gazetide.operators import health as H
from gazetide.operators import policy as P
from gazetide.operators import quality as Q
from gazetide.session import cut_lineage
from gazetide.sources import catalog as C
from gazetide.sources import archive, details, extract

REPORT_VERSION = 4


@dataclass(frozen=True)
class RunOptions:
    """Parameters of a run; dates follow ``resolve_range``."""

    sources: list[str] = field(default_factory=list)
    output_dir: str | None = None
    report_dir: str | None = None
    date: str | None = None
    start_date: str | None = None
    end_date: str | None = None
    dedupe_affiliated: bool = False
    fail_on_source_error: bool = False
    fetched_from: str | None = None
    fetched_to: str | None = None


@dataclass(frozen=True)
class WeeklyRun:
    days: DateRange
    selected: DataFrame
    made: DataFrame
    results: DataFrame
    items: DataFrame
    processed: DataFrame
    rows: DataFrame
    sheets: DataFrame
    policy: P.Policy
    started_at: dt.datetime


def run_week(
    captures: DataFrame,
    catalog: DataFrame,
    profiles: DataFrame,
    affiliation: DataFrame,
    policy: P.Policy,
    options: RunOptions,
    detail_pages: DataFrame | None = None,
    today: dt.date | None = None,
) -> WeeklyRun:
    """Build the run. Parsed captures, judged items and scored rows are each needed by
    several outputs and are therefore written once to the checkpoint folder. ``captures`` read
    from an archive are limited to the days ``fetched_from`` to ``fetched_to`` of the options."""
    started = dt.datetime.now(dt.timezone.utc)
    days = resolve_range(options.date, options.start_date, options.end_date, today)
    selected = C.select_sources(catalog, options.sources)
    routes = C.expand_routes(catalog).join(selected.select("source"), "source", "left_semi")
    of_route = ["src_order", "attempt_no", "aggregate_routes", "coverage_reduced", "url", "kind", "parser", "priority"]
    # Only captures of selected routes are looked at.
    archived = set(archive.OWN) <= set(captures.columns)
    ends = [e and dt.date.fromisoformat(e) for e in (options.fetched_from, options.fetched_to)]
    if any(ends):
        if not archived:
            raise ValueError("an interval of fetching needs captures of an archive")
        captures = archive.captures_between(captures, *ends)
    asked = captures.join(routes.select("source", "route_id"), ["source", "route_id"], "left_semi")
    newest = archive.newest_captures(asked) if archived else C.latest_captures(asked)
    fetched = newest.drop("url", "kind", "parser", "priority").join(
        routes.select("source", "route_id", *of_route), ["source", "route_id"]
    )
    parsed = cut_lineage(extract.parse_captures(fetched, profiles))
    made = H.made_attempts(extract.attempts_of(parsed))
    results = H.with_unknown_sources(H.source_results(made), selected)
    winners = H.winning_routes(made, results)
    items = Q.in_range(
        extract.items_of(parsed).join(winners, ["source", "route_id"], "left_semi").drop("route_id"), days
    )
    if detail_pages is not None:
        items = details.enrich(items, detail_pages)
    items = cut_lineage(items)
    unique = A.dedupe_affiliated(items, affiliation) if options.dedupe_affiliated else items
    processed = cut_lineage(Q.process(unique))
    rows = cut_lineage(D.digest_rows(Q.kept_items(processed), policy, affiliation))
    return WeeklyRun(days, selected, made, results, items, processed, rows, D.sheets(rows, catalog), policy, started)


def source_diagnostics(run: WeeklyRun) -> DataFrame:
    """Per selected source: outcome, attempts, the items that fell into the week, and the
    classes of its failed attempts in their order (at most one per route of the source)."""
    per_source = run.items.groupBy("source").agg(F.count("*").alias("item_count"))
    trail = (
        H.failure_trail(run.made)
        .groupBy("source")
        .agg(F.array_sort(F.collect_list(F.struct("attempt_no", "failure_class"))).alias("_trail"))
        .select("source", F.transform("_trail", lambda t: t["failure_class"]).alias("route_failure_classes"))
    )
    none = F.array().cast("array<string>")
    return (
        run.results.join(per_source, "source", "left")
        .join(trail, "source", "left")
        .withColumn("item_count", F.coalesce("item_count", F.lit(0)))
        .withColumn("route_failure_classes", F.coalesce("route_failure_classes", none))
    )


def _status(run: WeeklyRun, failed: int, alerts: list[str]) -> str:
    row = run.sheets.sparkSession.range(1).select(Q.run_status(F.lit(failed), text_array(alerts)).alias("status"))
    return row.first().status


def report(run: WeeklyRun, output_file: str = "") -> dict:
    """The run report. Its parts are bounded by the catalog (a row per selected source or
    route) or are single rows; the rows of the issues stay in a table of their own."""
    counted = Q.with_alerts(Q.counters(run.processed)).first().asDict()
    kept = Q.kept_items(run.processed)
    diagnostics = [r.asDict() for r in source_diagnostics(run).collect()]
    attempts = [r.asDict() for r in run.made.orderBy("source", "attempt_no").collect()]
    failed = sorted(d["source"] for d in diagnostics if d["status"] == "failed")
    alerts = counted.pop("alert_reasons")
    status = _status(run, len(failed), alerts)
    pairs = lambda df: {r[0]: r[1] for r in df.collect()}
    summary = P.policy_summary(run.policy)
    finished = dt.datetime.now(dt.timezone.utc)
    selected = [r.source for r in run.selected.orderBy("pos").collect()]
    return {
        "report_schema_version": REPORT_VERSION,
        "status": status,
        "started_at": run.started_at.isoformat(),
        "finished_at": finished.isoformat(),
        "duration_seconds": round((finished - run.started_at).total_seconds(), 3),
        "week_start": run.days.start.isoformat(),
        "week_end": run.days.end.isoformat(),
        "selected_source_count": len(selected),
        "selected_sources": selected,
        "news_count": counted["output_count"],
        "failed_sources": failed,
        "anomalies": [],
        "failure_class_counts": pairs(H.failure_class_counts(run.results)),
        "error_counts": pairs(H.error_category_counts(run.made)),
        "source_health": H.health_rollup(run.results).first().asDict(),
        "quality": {
            **counted,
            "source_counts": pairs(Q.counts_by_source(kept, run.selected)),
            "date_source_counts": pairs(Q.counts_by_date_source(kept)),
            "description_fallback_count": 0,
            "alert_reasons": alerts,
        },
        "relevance_policy": summary,
        "ai_policy": {"version": summary["template_version"], "ruleset_hash": summary["ruleset_hash"]},
        "source_attempts": attempts,
        "route_attempts": attempts,
        "source_diagnostics": diagnostics,
        "parser_warnings": [],
        "scheduling_plan": [],
        "alerts": [],
        "insecure_ssl_hosts": [],
        "output_file": output_file,
    }


class SourceFailure(RuntimeError):
    """Raised by a strict run when a source failed; outputs are complete at that point."""


def write_run(run: WeeklyRun, options: RunOptions) -> dict:
    """Write digest, issues, policy sheets and report. Everything is computed by jobs whose
    commit is all or nothing; the report comes last."""
    if options.output_dir is None:
        raise ValueError("output_dir is needed to write a run")
    spark = run.sheets.sparkSession
    base = options.output_dir.rstrip("/")
    report_dir = (options.report_dir or f"{base}/執行紀錄").rstrip("/")
    book = f"{base}/本週新聞整理（{run.days.roc_label()}）"
    # The week of the run is replaced even if nothing is left to write for it.
    run.sheets.write.mode("overwrite").partitionBy("sheet").parquet(f"{base}/digest/week_start={run.days.start}")
    issues = Q.issues(run.processed)
    issues.write.mode("overwrite").partitionBy("issue").parquet(f"{base}/issues/week_start={run.days.start}")
    topics = P.policy_topics(spark, run.policy)
    tables = {
        D.SHEET_REFERENCE: P.reference_rows(topics, run.policy.general, run.policy.negative),
        D.SHEET_RULES: P.rule_rows(topics, run.policy.general, run.policy.negative),
        D.SHEET_VERSION: P.version_rows(spark, run.policy, dt.datetime.now(dt.timezone.utc).isoformat()),
    }
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").parquet(f"{book}/{name}")
    D.date_choices(run.rows).write.mode("overwrite").parquet(f"{book}/dates")
    document = report(run, book)
    stamp = run.started_at.strftime("%Y%m%d_%H%M%S_%f")
    line = spark.createDataFrame([(json.dumps(document, ensure_ascii=False, default=str),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{report_dir}/run_{stamp}.json")
    if options.fail_on_source_error and document["failed_sources"]:
        raise SourceFailure(", ".join(document["failed_sources"]))
    return document


def _by_week(df: DataFrame, path: str, column: str) -> None:
    """Replace the folder of every week in ``df`` as a whole, so that nothing of an earlier
    run of that week stays; below it, a folder per value of ``column``. Weeks are few."""
    for (week,) in df.select("week_start").distinct().collect():
        own = df.where(F.col("week_start").eqNullSafe(F.lit(week))).drop("week_start")
        name = "__HIVE_DEFAULT_PARTITION__" if week is None else week
        own.write.mode("overwrite").partitionBy(column).parquet(f"{path}/week_start={name}")


def write_sheets(sheets: DataFrame, path: str) -> None:
    """Digest table by week and sheet; the weeks of this run are replaced."""
    _by_week(sheets, path, "sheet")


def export_csv(spark: SparkSession, path: str, sheet: str, target: str) -> None:
    """One sheet as CSV under its published headings, in the order of its rows."""
    rows = spark.read.parquet(path).where(F.col("sheet") == sheet)
    ordered = rows.orderBy("row_no").select(*D.DIGEST_COLUMNS)
    D.rename_to_headings(ordered).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(target)
