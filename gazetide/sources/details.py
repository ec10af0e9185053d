"""Summaries from detail pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetide.functions.exprs import text_array, with_once
from gazetide.functions.text import DETAIL_SUMMARY_LIMIT, cut_trim
from gazetide.sources.extract import read_detail
from gazetide.sources.profiles import DETAIL_SELECTORS


def detail_selectors(source: Column, selectors: dict[str, list[str]] | None = None) -> Column:
    """Selectors to try for a publisher, NULL for publishers without detail pages."""
    out = F.lit(None).cast("array<string>")
    for name, css in (DETAIL_SELECTORS if selectors is None else selectors).items():
        out = F.when(source == name, text_array(css)).otherwise(out)
    return out


def detail_summary(source: Column, body: Column, selectors: dict[str, list[str]] | None = None) -> Column:
    """Text of a detail page, at most 1,200 characters, ``''`` when there is none."""
    return cut_trim(read_detail(body, detail_selectors(source, selectors)), DETAIL_SUMMARY_LIMIT)


def needs_detail(selectors: dict[str, list[str]] | None = None) -> Column:
    names = list(DETAIL_SELECTORS if selectors is None else selectors)
    return F.col("source").isin(names) & (F.col("summary") == "") & (F.col("link") != "")


def enrich(items: DataFrame, pages: DataFrame, selectors: dict[str, list[str]] | None = None) -> DataFrame:
    """Fill empty summaries from detail pages (url, body, and fetched_at where there is one);
    items whose page is absent or unreadable stay as they are. Of several captures of a page
    the newest that can be read counts, then the greater body. Pages nobody asks for are
    dropped before they are parsed, and items that need no page take no part in the join,
    whose side of the items can be split."""
    wanting = items.where(needs_detail(selectors))
    wanted = wanting.select(F.col("link").alias("url"), "source").distinct()
    fetched = F.col("fetched_at") if "fetched_at" in pages.columns else F.lit(None).cast("timestamp")
    asked = pages.where(F.col("body").isNotNull()).join(wanted, "url")
    # Once: the filter below would have every page read a second time.
    found = (
        with_once(asked, detail_summary(F.col("source"), F.col("body"), selectors).alias("_text"))
        .select(
            F.col("url").alias("link"), "source",
            F.struct(fetched.alias("at"), F.xxhash64("body").alias("body")).alias("_recency"),
            "_text",
        )
        .where(F.col("_text") != "")
        .groupBy("link", "source")
        .agg(F.max_by("_text", "_recency").alias("_text"))
    )
    filled = (
        wanting.join(found, ["source", "link"], "left")
        .withColumn("summary", F.coalesce("_text", F.lit("")))
        .select(*items.columns)
    )
    return items.where(~needs_detail(selectors)).unionByName(filled)
