"""Validation, exact de-duplication and the two-key "first come" de-duplication."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetide.functions.dates import DateRange, iso_day, parse_date
from gazetide.functions.exprs import key128, let, text_array, with_once
from gazetide.functions.text import clean_text, is_blank, strip_space, title_key
from gazetide.functions.urls import normalize_url
from gazetide.session import cut_lineage, materialised, shared_folder

# A title with one of these is a notice and no news.
NON_NEWS_PHRASES = ["事求人機關徵才系統"]
REQUIRED = ["source", "date", "title", "link"]

KEPT, INVALID, EXCLUDED, DUPLICATE = "kept", "invalid_item", "excluded_non_news", "duplicate"


def in_range(items: DataFrame, days: DateRange) -> DataFrame:
    """Items whose date falls into ``days``; the date is rewritten as ISO text. Dates are
    read once per row: rows outside give an empty array, which explodes to nothing."""
    inside = F.filter(F.transform(F.array("date"), parse_date), days.column)
    columns = [F.col("_iso").alias(c) if c == "date" else F.col(c) for c in items.columns]
    return items.select("*", F.explode(F.transform(inside, lambda d: F.date_format(d, "yyyy-MM-dd"))).alias("_iso")).select(
        *columns
    )


def _missing() -> Column:
    return F.concat_ws(",", *[F.when(is_blank(F.col(c)), F.lit(c)) for c in REQUIRED])


def _judge(v: Column, phrases: list[str]) -> Column:
    bad = (
        F.when(v["missing"] != "", F.concat(F.lit("missing_fields:"), v["missing"]))
        .when(v["day"].isNull(), F.lit("invalid_date"))
        .when(v["url"].isNull(), F.lit("invalid_url"))
    )

    def verdict(b: Column) -> Column:
        excluded = b.isNull() & F.exists(text_array(phrases), lambda p: v["title"].contains(p))
        return F.struct(
            F.when(b.isNotNull(), INVALID).when(excluded, EXCLUDED).alias("verdict"),
            F.when(b.isNotNull(), b).when(excluded, F.lit("title_keyword")).alias("reason"),
            F.when(b.isNull(), v["title"]).alias("clean_title"),
            v["url"].alias("norm_url"),
        )

    return let(bad, verdict)


def validate(items: DataFrame, non_news: list[str] | None = None) -> DataFrame:
    """Add ``verdict`` (NULL while undecided), ``reason`` (NULL likewise) and ``norm_url``;
    titles of readable rows are cleaned. A row is unusable for the first of: missing
    fields, a date that is no ISO day, a link that is no web address. Narrow, and each row
    is judged once."""
    phrases = NON_NEWS_PHRASES if non_news is None else non_news
    values = F.struct(
        _missing().alias("missing"),
        iso_day(strip_space(F.col("date"))).alias("day"),
        normalize_url(F.col("link")).alias("url"),
        clean_text(F.col("title")).alias("title"),
    )
    judged = with_once(items, let(values, lambda v: _judge(v, phrases)).alias("_j"))
    title = F.coalesce(F.col("_j.clean_title"), F.col("title")).alias("title")
    columns = [title if c == "title" else F.col(c) for c in items.columns]
    return judged.select(
        *columns, *[F.col(f"_j.{c}").alias(c) for c in ("verdict", "reason", "norm_url")]
    )


def exact_dedupe(items: DataFrame) -> DataFrame:
    """First row per (source, date, title, link).

    The smallest ``ord`` per key is found with a partial aggregate, so a key that holds a
    large share of all rows shrinks before the shuffle; the way back is by ``ord``, which
    is unique.
    """
    key = key128(*[F.col(c) for c in ("source", "date", "title", "link")])
    first = items.groupBy(key.alias("_key")).agg(F.min("ord").alias("ord")).select("ord")
    return items.join(first, "ord", "left_semi")


# --- first come, first kept, over two keys ------------------------------------------
#
# A row is dropped when either key belongs to an earlier *kept* row. Seen as a graph, the
# two keys are nodes and a row is an edge; the result is the matching that a walk over the
# edges in reading order would pick.
#
# An edge that comes first at both of its nodes is kept. An edge that only one earlier edge
# touches is kept exactly if that one is not, so along a chain of such edges the answer
# follows from its start and the distance to it, which doubling pointers finds in a logarithmic
# number of joins. What touches a kept edge goes; a round later the rest has fewer neighbours.


def _chained(edges: DataFrame) -> DataFrame:
    """``ord``, ``start``, ``odd`` of the edges with one earlier neighbour: the edge at which
    their chain starts, and whether their distance to it is odd. ``edges``: ord, earlier."""
    step = cut_lineage(edges.select("ord", F.col("earlier").alias("start"), F.lit(True).alias("odd")))
    while True:
        on = step.select(F.col("ord").alias("start"), F.col("start").alias("_next"), F.col("odd").alias("_odd"))
        if step.join(on, "start", "left_semi").isEmpty():
            return step
        step = cut_lineage(
            step.join(on, "start", "left").select(
                "ord",
                F.coalesce("_next", "start").alias("start"),
                F.when(F.col("_odd").isNull(), F.col("odd")).otherwise(F.col("odd") != F.col("_odd")).alias("odd"),
            )
        )


def _placed(edges: DataFrame, key: str, name: str) -> DataFrame:
    """With the first ``ord`` at the node of ``key``, and the edge's place there: 0 first, 1 second, 2
    later. Both come from partial aggregates of numbers."""
    first, second, place = f"{name}_first", f"{name}_second", f"{name}_place"
    with_first = edges.join(edges.groupBy(key).agg(F.min("ord").alias(first)), key)
    seconds = (
        with_first.where(F.col("ord") > F.col(first)).groupBy(F.col(key).alias("_key")).agg(F.min("ord").alias(second))
    )
    at = F.when(F.col("ord") == F.col(first), 0).when(F.col("ord") == F.col(second), 1).otherwise(2)
    return with_first.join(seconds, F.col(key) == F.col("_key"), "left").withColumn(place, at).drop("_key", second)


def first_come(edges: DataFrame) -> DataFrame:
    """``ord`` of the rows a reader would keep, from columns ord, tkey, ukey.

    Copies of the same pair of keys are folded first (map-side), as only the earliest can
    ever be kept. A path of any length takes two rounds, whatever later rows hang on its nodes;
    further rounds are for rows with several earlier neighbours.
    Nodes with very many rows are folded map-side, and their side of a join can be split.
    """
    left = cut_lineage(edges.groupBy("tkey", "ukey").agg(F.min("ord").alias("ord")))
    folder = f"{shared_folder(edges.sparkSession)}/first-come-{uuid.uuid4().hex}"
    edges.select(F.col("ord").cast("long")).limit(0).write.parquet(folder)
    while not left.isEmpty():
        seen = _placed(_placed(left, "tkey", "t"), "ukey", "u")
        # Exactly one earlier neighbour: first at one node and second at the other.
        seen = cut_lineage(
            seen.select(
                "ord", "tkey", "ukey",
                F.when(F.expr("t_place = 0 and u_place = 0"), 0)
                .when(F.expr("t_place + u_place = 1"), 1)
                .otherwise(2).alias("n_earlier"),
                F.when(F.col("t_place") == 0, F.col("u_first")).otherwise(F.col("t_first")).alias("earlier"),
            )
        )
        starts = seen.where("n_earlier = 0").select("ord")
        chained = _chained(seen.where("n_earlier = 1"))
        settled = chained.join(starts.withColumnRenamed("ord", "start"), "start", "left_semi")
        kept = cut_lineage(
            starts.union(settled.where("not odd").select("ord")).join(seen.select("ord", "tkey", "ukey"), "ord")
        )
        kept.select(F.col("ord").cast("long")).write.mode("append").parquet(folder)
        left = cut_lineage(
            seen.join(kept.select("tkey"), "tkey", "left_anti")
            .join(kept.select("ukey"), "ukey", "left_anti")
            .select("tkey", "ukey", "ord")
        )
    return edges.sparkSession.read.schema("ord long").parquet(folder)


def process(items: DataFrame, non_news: list[str] | None = None) -> DataFrame:
    """Judge every row: ``verdict`` is kept, invalid_item, excluded_non_news or duplicate.
    Kept rows carry the cleaned title and the normalised link. Rows are judged once and
    written to the shared folder."""
    judged = materialised(validate(items, non_news), "judged")
    source = clean_text(F.col("source"))
    edges = judged.where(F.col("verdict").isNull()).select(
        "ord",
        key128(source, clean_text(F.col("date")), title_key(F.col("title"))).alias("tkey"),
        key128(source, F.col("norm_url")).alias("ukey"),
    )
    kept = first_come(edges).withColumn("_kept", F.lit(True))
    return (
        judged.join(kept, "ord", "left")
        .withColumn(
            "reason",
            F.when(
                F.col("verdict").isNull() & F.col("_kept").isNull(), F.lit("same_source_title_or_url")
            ).otherwise(F.coalesce(F.col("reason"), F.lit(""))),
        )
        .withColumn(
            "verdict",
            F.coalesce(F.col("verdict"), F.when(F.col("_kept"), F.lit(KEPT)).otherwise(F.lit(DUPLICATE))),
        )
        .withColumn("link", F.when(F.col("verdict") == KEPT, F.col("norm_url")).otherwise(F.col("link")))
        .drop("_kept", "norm_url")
    )


def kept_items(processed: DataFrame) -> DataFrame:
    return processed.where(F.col("verdict") == KEPT).drop("verdict", "reason")


def issues(processed: DataFrame) -> DataFrame:
    """Rows that were not kept, with category and reason."""
    return processed.where(F.col("verdict") != KEPT).withColumnRenamed("verdict", "issue")


# --- counters ------------------------------------------------------------------------


def counters(processed: DataFrame) -> DataFrame:
    """One row of quality counters."""
    n = lambda verdict: F.count_if(F.col("verdict") == verdict)
    kept = F.col("verdict") == KEPT
    counted = processed.agg(
        F.count("*").alias("input_count"),
        n(KEPT).alias("output_count"),
        n(DUPLICATE).alias("duplicate_count"),
        n(INVALID).alias("invalid_count"),
        n(EXCLUDED).alias("excluded_non_news_count"),
        F.count_if(kept & (F.col("summary") != "")).alias("summary_count"),
    )
    return counted.withColumn(
        "summary_coverage_rate",
        F.when(F.col("output_count") == 0, F.lit(0.0)).otherwise(
            F.round(F.try_divide(F.col("summary_count"), F.col("output_count")), 4)
        ),
    )


def with_alerts(counted: DataFrame) -> DataFrame:
    """Add ``alert_reasons`` to a row of counters."""
    base = F.greatest(F.col("input_count"), F.lit(1))
    duplicates, excluded = F.col("duplicate_count"), F.col("excluded_non_news_count")
    return counted.withColumn(
        "alert_reasons",
        F.array_compact(
            F.array(
                F.when(F.col("invalid_count") >= 1, F.lit("invalid_items")),
                F.when((duplicates >= 5) & (duplicates / base >= 0.20), F.lit("duplicate_spike")),
                F.when((excluded >= 3) & (excluded / base >= 0.25), F.lit("non_news_spike")),
            )
        ),
    )


def run_status(failed_sources: Column, alert_reasons: Column) -> Column:
    """Status of a run from its number of failed sources and its alerts."""
    return (
        F.when(failed_sources > 0, F.lit("partial_failure"))
        .when(F.size(alert_reasons) > 0, F.lit("attention"))
        .otherwise(F.lit("success"))
    )


def counts_by_source(items: DataFrame, selected: DataFrame) -> DataFrame:
    """Items per selected source, zero included, plus any other source that has items."""
    counts = items.groupBy("source").agg(F.count("*").alias("n"))
    return selected.select("source").distinct().join(counts, "source", "full").select(
        "source", F.coalesce(F.col("n"), F.lit(0)).alias("item_count")
    )


def counts_by_date_source(items: DataFrame) -> DataFrame:
    return items.groupBy("date_source").agg(F.count("*").alias("item_count"))
