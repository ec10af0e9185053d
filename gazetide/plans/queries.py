"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetide.functions import dates, outcomes, text, urls
from gazetide.functions.exprs import let
from gazetide.operators import affiliation as A
from gazetide.operators import digest as D
from gazetide.operators import health as H
from gazetide.operators import policy as P
from gazetide.operators import quality as Q
from gazetide.operators import relevance as R
from gazetide.operators import scoring
from gazetide.plans import tables as T
from gazetide.plans import weekly as W
from gazetide.plans.weekly import RunOptions, run_week, write_sheets
from gazetide.operators.numbering import number_rows
from gazetide.session import cut_lineage, shared_folder
from gazetide.sources import catalog as C
from gazetide.sources import archive, details, extract, profiles, reports
from gazetide.streaming.progress import follow, follow_resent, latest, merged, run_progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ITEM_COLUMNS = ["source", "date", "department", "title", "link", "category", "summary", "date_source"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _iso(c):
    return F.date_format(c, "yyyy-MM-dd")


# --- scalar functions ----------------------------------------------------------------


@query
def date_formats(spark, sf):
    """SCA-1, SCA-2, SCA-15 on every order date, written in several ways."""
    orders = T.table(spark, sf, "orders")
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    roc_year = (F.year(day) - 1911).cast("string")
    listed = (
        F.when(key % 4 == 0, F.concat(roc_year, F.date_format(day, "-MM-dd")))
        .when(key % 4 == 1, F.concat(F.lit("公告 "), roc_year, F.date_format(day, ".M.d"), F.lit(" 起")))
        .when(key % 4 == 2, F.concat(F.date_format(day, "yyyy年M月d日")))
        .otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T23:00:00Z")))
    )
    return orders.select(
        "o_orderkey",
        _iso(dates.parse_date(T.dated_text(day, key % 7))).alias("parsed"),
        _iso(dates.parse_list_date(listed)).alias("listed"),
        dates.roc_date(day).alias("roc_date"),
        dates.roc_compact(day).alias("roc_compact"),
    )


@query
def text_keys(spark, sf):
    """SCA-3, SCA-6, SCA-11 on whole texts."""
    t = F.col("text")
    return T.table(spark, sf, "documents").select(
        "doc_id", text.clean_text(t).alias("clean"), text.title_key(t).alias("key"), text.match_text(t).alias("matching")
    )


@query
def text_limits(spark, sf):
    """SORT-5, SCA-18, SCA-24 on whole texts."""
    t = F.col("text")
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(t, F.lit("字"))).otherwise(t)
    return T.table(spark, sf, "documents").select(
        "doc_id",
        text.cut(t, text.CELL_LIMIT).alias("cell"),
        text.text_class(marked).alias("text_class"),
        text.collapsed_summary(t, 200).alias("summary"),
    )


@query
def department_names(spark, sf):
    """SCA-7, SCA-8 on labelled department texts."""
    i, lang, source = F.col("doc_id"), F.col("lang"), F.col("source")
    raw = (
        F.when(i % 7 == 0, F.concat(F.lit("版權所有： 發布單位:"), lang))
        .when(i % 7 == 1, F.concat(F.lit("1.2.3."), i.cast("string")))
        .when(i % 7 == 2, F.concat(F.lit("https://"), source, F.lit(".test")))
        .when(i % 7 == 3, F.concat(source, F.lit(" > "), lang))
        .when(i % 7 == 4, F.concat(F.lit("Dept "), source))
        .when(i % 7 == 5, source)
        .otherwise(F.concat(lang, F.lit("  office of "), source))
    )
    name = text.department_name(raw)
    return T.table(spark, sf, "documents").select(
        "doc_id", name.alias("department"), text.is_department_alias(source, name).alias("is_alias")
    )


@query
def labelled_values(spark, sf):
    """SCA-9, SCA-10 on texts with labels somewhere inside."""
    i = F.col("doc_id")
    day = T.day_of(i)
    roc = F.concat((F.year(day) - 1911).cast("string"), F.date_format(day, "/MM/dd"))
    whole = F.when(i % 5 == 0, F.col("text")).otherwise(
        F.concat(F.col("text"), F.lit(" 發布單位： "), F.col("lang"), F.lit(" 發布日期"), roc, F.lit(" 完"))
    )
    return T.table(spark, sf, "documents").select(
        "doc_id",
        text.labelled_value(whole, "發布單位").alias("unit"),
        _iso(dates.labelled_date(whole, "發布日期")).alias("published"),
    )


@query
def url_normalize(spark, sf):
    """SCA-5, SCA-23 on page addresses, bare and with more tracking."""
    u = F.col("url")
    noisy = F.concat(
        F.replace(F.split_part(u, F.lit("#"), F.lit(1)), F.lit(".example."), F.lit(".EXAMPLE.")),
        F.when(u.contains("?"), F.lit("&")).otherwise(F.lit("?")),
        F.lit("GCLID=1&b=c+d&e"),
    )
    return T.table(spark, sf, "pages").select(
        "page_id",
        urls.normalize_url(u).alias("norm"),
        urls.normalize_url(noisy).alias("noisy_norm"),
        urls.url_host(u).alias("host"),
    )


@query
def link_labels(spark, sf):
    """SCA-19, SCA-25."""
    base = T.items(spark, sf)
    shown = text.site_link(F.col("source"), F.col("link"))
    return base.select("ord", shown.alias("link_text"), text.first_web_url(shown).alias("link_url"))


@query
def http_outcomes(spark, sf):
    """SCA-20, SCA-21, SCA-22 on fetch outcomes made from events."""
    k = F.get_json_object("props", "$.k").cast("int")
    codes = F.array(*[F.lit(c) for c in (200, 204, 301, 401, 403, 404, 429, 500, 503)])
    errors = F.array(*[F.lit(e) for e in (None, None, None, None, "timeout", "connect", "request", "body", "tls", "odd")])
    kind = F.when(F.col("event_type") == "view", F.lit("browser")).otherwise(F.lit("html"))
    body = F.when(k % 7 == 0, F.lit("<p>Request unsuccessful</p>")).otherwise(F.lit("<p>fine</p>"))
    failure = outcomes.capture_failure(kind, F.get(codes, k % 9), F.get(errors, k % 10), body)
    return (
        T.table(spark, sf, "events")
        .select("event_id", failure.alias("failure_class"))
        .select(
            "event_id", "failure_class",
            outcomes.error_category(F.col("failure_class")).alias("error_category"),
            outcomes.retryable(F.col("failure_class")).alias("retryable"),
        )
    )


@query
def weekly_counts(spark, sf):
    """SCA-14: items per Monday week and source."""
    week = F.date_trunc("week", F.to_date("date", "yyyy-MM-dd")).cast("date")
    return (
        T.items(spark, sf).groupBy(_iso(week).alias("week_start"), "source").agg(F.count("*").alias("item_count"))
    )


# --- filters and de-duplication ------------------------------------------------------


@query
def week_filter(spark, sf):
    """FIL-1."""
    return Q.in_range(T.raw_items(spark, sf), T.WEEK).select("ord", "source", "date", "title")


@query
def validate_items(spark, sf):
    """FIL-2, FIL-3."""
    judged = Q.validate(T.raw_items(spark, sf))
    return judged.select(
        "ord", F.coalesce("verdict", F.lit("")).alias("verdict"), F.coalesce("reason", F.lit("")).alias("reason"), "title"
    )


@query
def exact_dedupe(spark, sf):
    """WIN-2, with the link's number left out so that copies exist."""
    same = T.items(spark, sf).withColumn("link", F.concat(F.lit("https://x.test/"), "department"))
    return Q.exact_dedupe(same).select("ord", "source", "date", "title", "link")


@query
def greedy_dedupe(spark, sf):
    """WIN-3: verdict, reason and final link of every item."""
    return Q.process(T.items(spark, sf)).select("ord", "verdict", "reason", "title", "link")


@query
def quality_issues(spark, sf):
    """SNK-5."""
    return Q.issues(Q.process(T.items(spark, sf))).select("ord", "issue", "reason", *ITEM_COLUMNS)


@query
def affiliated_dedupe(spark, sf):
    """WIN-4, SET-4, with the place of every surviving row."""
    return A.dedupe_affiliated(T.items(spark, sf), T.affiliation(spark)).select("ord", "source", "date", "title", "link")


@query
def affiliated_then_greedy(spark, sf):
    """WIN-4 before WIN-3, as a run with affiliated de-duplication does it."""
    unique = A.dedupe_affiliated(T.items(spark, sf), T.affiliation(spark))
    return Q.process(unique).groupBy("source", "verdict").agg(F.count("*").alias("item_count"))


@query
def agency_path(spark, sf):
    """JOIN-1, PRJ-2."""
    department = F.concat("source", F.lit("／"), "department", F.lit(" / "), F.col("date_source"), F.lit("／ "))
    items = T.items(spark, sf).withColumn("department", department)
    path = A.agency_path(F.col("source"), F.col("path"), F.col("department"))
    return (
        A.with_affiliation(items, T.affiliation(spark))
        .withColumn("p", path)
        .select("ord", F.col("p.parent").alias("parent"), F.col("p.department_path").alias("department_path"),
                F.coalesce("grp", F.lit("")).alias("grp"))
    )


# --- relevance and digest ------------------------------------------------------------


@query
def keyword_hits(spark, sf):
    """JOIN-4, SCA-12 on whole texts."""
    words = ["AI", "of", "the", "Ingre", "nt er", "ü", "çon", "des", "GPU", "que los"]
    hits = let(text.match_text(F.col("text")), lambda t: R.keyword_hits(t, words))
    return T.table(spark, sf, "documents").select("doc_id", F.array_join(hits, "|").alias("hits"))


@query
def keyword_hits_table(spark, sf):
    """JOIN-4 with a table of keywords: all long words of all documents, sought in every document."""
    docs = T.table(spark, sf, "documents")
    words = docs.select(F.explode(F.split("text", " ")).alias("keyword")).where("char_length(keyword) > 7")
    return R.keyword_matches(docs.select(F.col("doc_id").alias("id"), "text"), words)


@query
def relevance_score(spark, sf):
    """SCA-13, JOIN-5, AGG-11: classification of every item."""
    scored = R.score_items(T.items(spark, sf), T.TEST_POLICY)
    join = lambda f, sep="、": F.array_join(F.col(f"rel.{f}"), sep).alias(f)
    return scored.select(
        "ord", F.col("rel.relevance").alias("relevance"), F.col("rel.score").alias("score"), join("topics"),
        join("priority_sources"), join("matched_keywords"), join("excluded_keywords"), join("reasons", "；"),
    )


def _by_table(spark, sf):
    items = T.table(spark, sf, "documents").select(
        F.col("doc_id").alias("ord"), T.first_line(F.col("text")).alias("title"), "source", F.col("text").alias("summary")
    )
    words = scoring.word_table
    return scoring.score_by_table(
        items, scoring.PolicyTable(T.word_topics(spark, sf), words(spark, ["of the", "des"]), words(spark, ["hat"]))
    )


@query
def policy_table_scores(spark, sf):
    """SCA-13, JOIN-5, AGG-11 with a policy table of a topic per document: one row per item."""
    return _by_table(spark, sf).rows


@query
def policy_table_matches(spark, sf):
    """SCA-13 with the same policy: one row per item and candidate topic."""
    return _by_table(spark, sf).matches.select(
        "ord", "topic_no", "name", "relevance", "score", F.size("matched_keywords").alias("keyword_count"),
        F.array_join("reasons", "；").alias("reasons"),
    )


@query
def conversation_relevance(spark, sf):
    """SCA-13 on chat turns: the role is the source, the text title and summary at once."""
    turns = T.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("role").alias("source"), T.first_line(F.col("text")).alias("title"),
        F.col("text").alias("summary"),
    )
    scored = R.score_items(turns, T.TEST_POLICY)
    return scored.select(
        "conv_id", "turn", F.col("rel.relevance").alias("relevance"), F.col("rel.score").alias("score")
    )


@query
def relevance_topics(spark, sf):
    """SCA-13: one row per item and candidate topic."""
    scored = R.score_items(T.items(spark, sf), T.TEST_POLICY)
    return scored.select("ord", F.explode("rel.topic_matches").alias("m")).select(
        "ord", F.col("m")["name"].alias("topic"), F.col("m.relevance").alias("relevance"), F.col("m.score").alias("score"),
        F.array_join("m.reasons", "；").alias("reasons"), F.array_join("m.matched_keywords", "、").alias("keywords"),
    )


@query
def digest_rows(spark, sf):
    """PRJ-1."""
    return D.digest_rows(T.items(spark, sf), T.TEST_POLICY, T.affiliation(spark))


@query
def digest_order(spark, sf):
    """SORT-1, JOIN-2: rows in digest order with their catalog position."""
    rows = D.digest_rows(T.items(spark, sf), T.TEST_POLICY, T.affiliation(spark))
    placed = D.with_source_order(rows, T.catalog(spark, sf))
    return placed.orderBy(*D.digest_order()).select("ord", "agency", "src_order", "date", "department_path", "title")


@query
def selected_digest(spark, sf):
    """The flagship: week filter, validation, two-key de-duplication, scoring, projection
    and selected order (FIL-1..4, WIN-3, SCA-13, PRJ-1, SORT-2)."""
    week = Q.in_range(T.raw_items(spark, sf), T.WEEK)
    kept = Q.kept_items(Q.process(week))
    rows = D.digest_rows(kept, T.TEST_POLICY, T.affiliation(spark))
    placed = D.with_source_order(D.selected_rows(rows), T.catalog(spark, sf))
    return placed.orderBy(*D.selected_order()).select("ord", *D.DIGEST_COLUMNS)


@query
def digest_sheets(spark, sf):
    """FIL-5, WIN-5, SORT-1, SORT-2, SCA-25: every sheet with row numbers and styles."""
    rows = cut_lineage(D.digest_rows(T.items(spark, sf), T.TEST_POLICY, T.affiliation(spark)))
    return D.sheets(rows, T.catalog(spark, sf), T.AGENCY_SHEETS).select(
        "sheet", "row_no", "agency", "date", "title", "score", "row_style", "topic_highlight", "title_class",
        F.coalesce("link_url", F.lit("")).alias("link_url"),
    )


@query
def digest_table(spark, sf):
    """SNK-1: the sheets written as a table by week and sheet, read back."""
    rows = cut_lineage(D.digest_rows(T.items(spark, sf), T.TEST_POLICY, T.affiliation(spark)))
    sheets = D.sheets(rows, T.catalog(spark, sf), T.AGENCY_SHEETS)
    path = f"{shared_folder(spark)}/digest-{uuid.uuid4()}"
    dated = cut_lineage(sheets.withColumn("week_start", F.date_trunc("week", F.to_date("date")).cast("date")))
    # A week written twice holds the second run alone.
    write_sheets(dated.withColumn("sheet", F.concat("sheet", F.lit("-old"))).where("row_no <= 3"), path)
    write_sheets(dated, path)
    return spark.read.parquet(path).select(
        F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), "sheet", "row_no", *D.DIGEST_COLUMNS
    )


@query
def date_choices(spark, sf):
    """AGG-13: the dates of the digest in both calendars."""
    return D.date_choices(T.items(spark, sf))


@query
def policy_rules(spark, sf):
    """PRJ-4, SCA-16: rule sheet of a policy with a topic per document."""
    return P.rule_rows(T.topics(spark, sf), ["AI", "of the"], ["hat"])


@query
def policy_reference(spark, sf):
    """PRJ-3: topic sheet of the same policy."""
    return P.reference_rows(T.topics(spark, sf), ["AI", "of the"], ["hat"])


# --- counters ------------------------------------------------------------------------


@query
def source_counts_zero_filled(spark, sf):
    """AGG-6, JOIN-7: kept items per publisher of the catalog."""
    selected = C.select_sources(T.catalog(spark, sf), [])
    return Q.counts_by_source(Q.kept_items(Q.process(T.items(spark, sf))), selected)


@query
def date_source_counts(spark, sf):
    """AGG-6."""
    return Q.counts_by_date_source(T.items(spark, sf))


@query
def quality_counters(spark, sf):
    """AGG-5, AGG-7."""
    return Q.counters(Q.process(T.items(spark, sf)))


@query
def alerts_status(spark, sf):
    """AGG-8, AGG-9: counters by source with their alerts and status."""
    judged = Q.process(T.items(spark, sf))
    per_source = judged.groupBy("source").agg(
        F.count("*").alias("input_count"),
        *[F.count_if(F.col("verdict") == v).alias(c) for v, c in (
            (Q.DUPLICATE, "duplicate_count"), (Q.INVALID, "invalid_count"), (Q.EXCLUDED, "excluded_non_news_count"),
        )],
    )
    alerted = Q.with_alerts(per_source)
    return alerted.select(
        "source", F.array_join("alert_reasons", ",").alias("alerts"),
        Q.run_status(F.lit(0), F.col("alert_reasons")).alias("status"),
    )


# --- health --------------------------------------------------------------------------


def _made(spark, sf):
    return H.made_attempts(T.attempts(spark, sf))


@query
def route_fallback(spark, sf):
    """AGG-12, WIN-1: winning route and error of every source."""
    return H.source_results(_made(spark, sf)).select(
        "source", "status", "final_route_id", "final_url", "used_fallback", "coverage_reduced", "failure_class",
        "error_category",
    )


@query
def source_diagnostics(spark, sf):
    """AGG-3."""
    return H.source_results(_made(spark, sf)).select(
        "source", "status", "unstable", "attempt_count", "failed_attempts", "elapsed_seconds", "last_failure_class",
        "evidence_host", "evidence_message",
    )


@query
def failure_trail(spark, sf):
    """FIL-6: failed attempts in order."""
    return H.failure_trail(_made(spark, sf))


@query
def winning_routes(spark, sf):
    """SET-1: the routes whose items count."""
    made = _made(spark, sf)
    return H.winning_routes(made, H.source_results(made))


@query
def failure_counts(spark, sf):
    """AGG-1, where every attempt of some sources fails."""
    dead = F.col("source").rlike("[147]$")
    attempts = (
        T.attempts(spark, sf)
        .withColumn("failure_class", F.when(dead & (F.col("status") != "failed"), "unknown").otherwise(F.col("failure_class")))
        .withColumn("status", F.when(dead, "failed").otherwise(F.col("status")))
    )
    return H.failure_class_counts(H.source_results(H.made_attempts(attempts)))


@query
def error_category_counts(spark, sf):
    """AGG-2, over every attempt."""
    return H.error_category_counts(T.attempts(spark, sf))


@query
def health_rollup(spark, sf):
    """AGG-4."""
    return H.health_rollup(H.source_results(_made(spark, sf)))


@query
def unknown_sources(spark, sf):
    """SRC-3, JOIN-8: selected sources without attempts."""
    selected = T.catalog(spark, sf).select(
        F.replace("name", F.lit("src"), F.lit("u")).alias("source"), (F.col("src_order") % 2 == 0).alias("known")
    )
    results = H.with_unknown_sources(H.source_results(_made(spark, sf)), selected)
    return results.select("source", "status", "failure_class", "error_category", "attempt_count")


# --- catalog and captures ------------------------------------------------------------


@query
def catalog_routes(spark, sf):
    """SRC-1, SRC-2, SORT-3."""
    return C.expand_routes(T.catalog(spark, sf)).drop("official")


@query
def source_selection(spark, sf):
    """SRC-3, SRC-4: a selection with a repeat and unknown names against the catalog."""
    return C.select_sources(T.catalog(spark, sf), ["src3", "nobody", "src1", "src3", "src7"])


@query
def worklist(spark, sf):
    """SORT-4: jobs by priority."""
    jobs = T.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source"),
        (F.col("c_custkey") % 10).alias("priority"),
    )
    return C.worklist(jobs)


@query
def worklist_places(spark, sf):
    """SORT-4 with the place of every job."""
    jobs = T.table(spark, sf, "customer").select(
        F.lit(0).alias("all"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source"),
        (F.col("c_custkey") % 10).alias("priority"),
    )
    return number_rows(jobs, "all", C.work_order(), "place").select("place", "source", "priority")


@query
def source_list(spark, sf):
    """SRC-4."""
    return C.source_names(T.catalog(spark, sf))


@query
def latest_captures(spark, sf):
    """SRC-5: of three captures of every page the newest."""
    pages = T.page_captures(spark, sf)
    page = F.substring("route_id", 2, 20).cast("long")
    at = lambda n: F.timestamp_seconds(page * (31 * n + 93) % 101)
    captures = reduce(
        DataFrame.unionByName, [pages.withColumn("fetched_at", at(n)).withColumn("status_code", F.lit(200 + n)) for n in range(3)]
    )
    return C.latest_captures(captures).select("route_id", "status_code", F.md5("body").alias("body_md5"))


@query
def archived_captures(spark, sf):
    """SRC-5 over an archive by day: the newest captures of an interval of days."""
    pages = T.page_captures(spark, sf)
    page = F.substring("route_id", 2, 20).cast("long")
    at = lambda n: F.timestamp_seconds(86_400 * (page * (31 * n + 93) % 101))
    fetched = [pages.withColumn("fetched_at", at(n)).withColumn("status_code", F.lit(200 + n)) for n in range(3)]
    path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    archive.add_captures(reduce(DataFrame.unionByName, fetched), path)
    days = archive.captures_between(spark.read.parquet(path), dt.date(1970, 1, 21), dt.date(1970, 3, 12))
    return archive.newest_captures(days).select("route_id", "status_code", F.md5("body").alias("body_md5"))


@query
def capture_gaps(spark, sf):
    """JOIN-3: captures without a route, and routes without a capture."""
    routes = C.expand_routes(T.catalog(spark, sf))
    k = F.col("c_custkey")
    captures = T.table(spark, sf, "customer").select(
        F.concat(F.lit("src"), k.cast("string")).alias("source"),
        F.when(k % 3 == 0, F.lit("alternate-1")).otherwise(F.lit("primary")).alias("route_id"),
    )
    return C.capture_gaps(captures, routes)


@query
def numbered_items(spark, sf):
    """SET-2: items of all feed captures as one numbered table."""
    parsed = _parsed(spark, sf, ["feed"]).withColumn("attempt_no", F.lit(1))
    placed = parsed.withColumn("src_order", F.substring("route_id", 2, 20).cast("long"))
    return extract.items_of(placed).select("ord", "route_id", "title", "link")


@query
def feed_sniff(spark, sf):
    """SRC-6, SRC-7: reader chosen for every page."""
    i = F.col("page_id")
    body = (
        F.when(i % 6 == 0, F.concat(F.lit("﻿ \n<?XML version='1.0'?>"), "html"))
        .when(i % 6 == 1, F.concat(F.lit("  <Feed>"), "html"))
        .when(i % 6 == 2, F.concat(F.lit("x <rss>"), "html"))
        .otherwise(F.col("html"))
    )
    source = F.when(i % 11 == 0, F.lit("國家公園署")).when(i % 11 == 1, F.lit("外交部")).otherwise(F.lit("web"))
    parser = F.when(i % 5 == 0, F.lit("mystery")).otherwise(F.lit("standard"))
    layout = F.when(i % 11 == 1, F.lit("row_text")).when(i % 11 == 2, F.lit("dated"))
    return T.table(spark, sf, "pages").select(
        "page_id",
        extract.looks_like_feed(F.col("url"), body).alias("is_feed"),
        extract.dispatch(source, layout, F.lit("html"), parser, F.col("url"), body).alias("reader"),
    )


def _parsed(spark, sf, layouts, failing=False):
    return extract.parse_captures(T.captures(spark, sf, layouts, failing), profiles.default_profiles(spark))


def _items_of_layout(layout: str) -> Query:
    def run(spark, sf):
        return _parsed(spark, sf, [layout]).select("route_id", F.explode("items").alias("i")).select(
            "route_id", F.col("i.pos").alias("pos"), *[F.col(f"i.{c}").alias(c) for c in ITEM_COLUMNS[1:]]
        )

    return run


# SRC-8..SRC-22: one query per reader, over pages rendered from all documents.
EXTRACTION = {f"{layout}_items": layout for layout in T.PAGE_TEMPLATES}
for _name, _layout in EXTRACTION.items():
    QUERIES[_name] = _items_of_layout(_layout)

ALL_LAYOUTS = list(T.PAGE_TEMPLATES)


@query
def capture_attempts(spark, sf):
    """SRC-5, SRC-7, JOIN-3: attempts of captures of every kind in one pass."""
    parsed = _parsed(spark, sf, ALL_LAYOUTS, failing=True)
    routed = (
        parsed.withColumn("attempt_no", F.lit(1)).withColumn("coverage_reduced", F.lit(False))
        .withColumn("aggregate_routes", F.lit(True))
    )
    return extract.attempts_of(routed).select(
        "source", "route_id", "url_host", "route_kind", "parser", "status", "item_count", "failure_class",
        "error_category", "undated_dropped",
    )


@query
def nav_links(spark, sf):
    """SRC-11, SCA-23 on the driver's pages."""
    parsed = extract.parse_captures(T.page_captures(spark, sf), profiles.default_profiles(spark))
    return parsed.select("route_id", F.explode("items").alias("i")).select(
        "route_id", F.col("i.pos").alias("pos"), F.col("i.title").alias("title"), F.col("i.link").alias("link"),
        F.col("i.date").alias("date"),
    )


_ARTICLE = {"web": [".cpArticle", "article"]}


@query
def detail_summary(spark, sf):
    """SRC-23, SCA-4 on the driver's pages."""
    return T.table(spark, sf, "pages").select(
        "page_id", details.detail_summary(F.lit("web"), F.col("html"), _ARTICLE).alias("summary")
    )


@query
def detail_enrichment(spark, sf):
    """JOIN-6, FIL-7: items without summary get the text of their page."""
    # Four items ask for every page, one of them with a reader and without a summary.
    address = lambda n: F.concat(F.lit("https://d.test/"), n.cast("string"))
    pages = T.table(spark, sf, "pages").select(address(F.col("page_id")).alias("url"), F.col("html").alias("body"))
    items = T.items(spark, sf).select(
        "ord",
        F.when(F.col("ord") % 4 < 2, F.lit("web")).otherwise(F.col("source")).alias("source"),
        address(F.floor(F.col("ord") / 4)).alias("link"),
        F.when(F.col("ord") % 2 == 0, F.lit("")).otherwise(F.col("summary")).alias("summary"),
    )
    return details.enrich(items, pages, _ARTICLE)


@query
def legacy_reports(spark, sf):
    """SRC-25: reports with fields missing, made from events."""
    k = F.get_json_object("props", "$.k").cast("int")
    full = F.to_json(
        F.struct(
            F.col("event_type").alias("status"),
            F.array(F.concat(F.lit("s"), k.cast("string"))).alias("failed_sources"),
            F.struct(k.cast("long").alias("input_count"), F.array(F.lit("invalid_items")).alias("alert_reasons")).alias("quality"),
            F.lit("a.xlsx").alias("output_file"),
        )
    )
    bare = F.to_json(F.struct(F.col("event_type").alias("status")))
    raw = T.table(spark, sf, "events").select(
        "event_id", reports.parse_reports(F.when(k % 2 == 0, full).otherwise(bare)).alias("r")
    )
    filled = reports.with_report_defaults(raw.select("event_id", "r.*"), keep=["event_id"])
    return filled.select(
        "event_id", "status", F.array_join("failed_sources", ",").alias("failed_sources"),
        F.coalesce(F.col("quality.input_count"), F.lit(0)).alias("input_count"),
        F.coalesce(F.array_join("quality.alert_reasons", ","), F.lit("")).alias("alert_reasons"),
        "output_file", "report_file",
    )


# --- progress ------------------------------------------------------------------------


@query
def progress_of_runs(spark, sf):
    """ST-1."""
    return run_progress(T.run_events(spark, sf))


@query
def progress_stream(spark, sf):
    """ST-1 as a stream over the event files, read back from its sink."""
    schema = T.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    base = f"{shared_folder(spark)}/progress-{uuid.uuid4()}"
    follow(T.run_events_from(events), f"{base}/out", f"{base}/log").awaitTermination()
    return latest(spark.read.parquet(f"{base}/out"))


@query
def progress_resent(spark, sf):
    """ST-1 over events that come in several sendings, many of them twice and some far too late."""
    events, span = T.resent_events(spark, sf)
    base = f"{shared_folder(spark)}/progress-{uuid.uuid4()}"
    schema = events.drop("sending").schema
    for sending in range(T.SENDINGS):
        events.where(F.col("sending") == sending).drop("sending").write.mode("append").parquet(f"{base}/in")
        sent = spark.readStream.schema(schema).parquet(f"{base}/in")
        follow_resent(sent, f"{base}/out", f"{base}/log", f"{span} seconds").awaitTermination()
    return merged(spark.read.parquet(f"{base}/out"))


def _weekly(spark, sf):
    captures, catalog = T.weekly_inputs(spark, sf)
    options = RunOptions(date="2026-08-05", dedupe_affiliated=True)
    return run_week(captures, catalog, profiles.default_profiles(spark), T.affiliation(spark), T.TEST_POLICY, options)


@query
def weekly_run(spark, sf):
    """The run from captures to digest rows: SRC-5, JOIN-3, SET-1, SET-2, FIL-1, WIN-4, WIN-3, PRJ-1."""
    return _weekly(spark, sf).rows.select(*D.DIGEST_COLUMNS)


@query
def weekly_attempts(spark, sf):
    """JOIN-3, AGG-12: the attempts that the run made."""
    return _weekly(spark, sf).made.select("source", "attempt_no", "route_id", "status", "item_count", "failure_class", "error_category")


@query
def weekly_diagnostics(spark, sf):
    """AGG-3: outcome, attempts, items of the week and failure classes in order, per source."""
    return W.source_diagnostics(_weekly(spark, sf)).select(
        "source", "status", "unstable", "attempt_count", "failed_attempts", "final_route_id", "item_count",
        F.array_join("route_failure_classes", ",").alias("route_failure_classes"),
    )


@query
def weekly_status(spark, sf):
    """AGG-9: every user's run judged by its failed sources and its alerts."""
    events = T.table(spark, sf, "events")
    per_run = events.groupBy((F.col("user_id") % 50).alias("run")).agg(
        F.count_if((F.col("event_type") == "error") & (F.col("user_id") < 100)).alias("failed_sources"),
        F.count_if(F.col("event_type") == "click").alias("duplicate_count"),
        F.lit(0).cast("long").alias("invalid_count"), F.lit(0).cast("long").alias("excluded_non_news_count"),
        F.count("*").alias("input_count"),
    )
    return Q.with_alerts(per_run).select(
        "run", Q.run_status(F.col("failed_sources"), F.col("alert_reasons")).alias("status"),
        F.array_join("alert_reasons", ",").alias("alerts"),
    )
