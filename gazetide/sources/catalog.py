"""The publisher catalog and what is derived from it: routes, selection, worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetide.functions.urls import url_host
from gazetide.schemas import CATALOG
from gazetide.session import small_table
from gazetide.sources.catalog_values import PUBLISHERS


def default_catalog(spark: SparkSession) -> DataFrame:
    rows = [
        (n, p["name"], p["urls"], p["aggregate_routes"], [{**r, "official": True} for r in p["routes"]])
        for n, p in enumerate(PUBLISHERS)
    ]
    return small_table(spark, rows, CATALOG)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog from JSON with the columns of ``CATALOG``; absent route fields get defaults.
    The order of publishers is data (``src_order``), not the order of reading."""
    raw = spark.read.schema(CATALOG).json(path, multiLine=True)
    return raw.select(
        "src_order",
        "name",
        F.coalesce("urls", F.array().cast("array<string>")).alias("urls"),
        F.coalesce("aggregate_routes", F.lit(False)).alias("aggregate_routes"),
        F.transform(
            F.coalesce("routes", F.array().cast(CATALOG["routes"].dataType)),
            lambda r: F.struct(
                r["id"].alias("id"),
                r["url"].alias("url"),
                F.coalesce(r["kind"], F.lit("html")).alias("kind"),
                F.coalesce(r["parser"], F.lit("primary")).alias("parser"),
                F.coalesce(r["priority"], F.lit(1)).alias("priority"),
                F.coalesce(r["official"], F.lit(True)).alias("official"),
                F.coalesce(r["coverage_reduced"], F.lit(False)).alias("coverage_reduced"),
            ),
        ).alias("routes"),
    )


def source_names(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("src_order").select("name")


def expand_routes(catalog: DataFrame) -> DataFrame:
    """One row per route: named routes by priority, else one per address. ``attempt_no``
    is the place of the route in its publisher's order, from 1."""
    plain = F.transform(
        "urls",
        lambda u, i: F.struct(
            F.when(i == 0, F.lit("primary")).otherwise(F.concat(F.lit("alternate-"), i.cast("string"))).alias("id"),
            u.alias("url"),
            F.when(F.lower(u).rlike(r"rss|feed|\.xml$"), F.lit("rss")).otherwise(F.lit("html")).alias("kind"),
            F.lit("standard").alias("parser"),
            (i + 1).alias("priority"),
            F.lit(True).alias("official"),
            F.lit(False).alias("coverage_reduced"),
        ),
    )
    # Ordering happens inside the row: (priority, place, route) sorts by priority and keeps
    # the listed order within one priority.
    ranked = F.array_sort(
        F.transform("routes", lambda r, i: F.struct(r["priority"].alias("p"), i.alias("i"), r.alias("r")))
    )
    chosen = F.when(F.size("routes") > 0, F.transform(ranked, lambda x: x["r"])).otherwise(plain)
    return catalog.select(
        "src_order", F.col("name").alias("source"), "aggregate_routes", F.posexplode(chosen).alias("_at", "_route")
    ).select(
        "src_order",
        "source",
        "aggregate_routes",
        (F.col("_at") + 1).alias("attempt_no"),
        F.col("_route.id").alias("route_id"),
        F.col("_route.url").alias("url"),
        url_host(F.col("_route.url")).alias("url_host"),
        F.col("_route.kind").alias("kind"),
        F.col("_route.parser").alias("parser"),
        F.col("_route.priority").alias("priority"),
        F.col("_route.official").alias("official"),
        F.col("_route.coverage_reduced").alias("coverage_reduced"),
    )


def select_sources(catalog: DataFrame, names: list[str]) -> DataFrame:
    """(pos, source, known): the wanted publishers, all when none is named. Repeats count
    once; names outside the catalog stay, marked as not known."""
    if not names:
        return catalog.select(F.col("src_order").alias("pos"), F.col("name").alias("source"), F.lit(True).alias("known"))
    wanted = small_table(catalog.sparkSession, list(enumerate(dict.fromkeys(names))), "pos int, source string")
    known = catalog.select(F.col("name").alias("source"), F.lit(True).alias("known"))
    return wanted.join(known, "source", "left").select(
        "pos", "source", F.coalesce("known", F.lit(False)).alias("known")
    )


def work_order() -> list[Column]:
    """Falling priority, then name."""
    return [F.desc("priority"), F.asc("source")]


def worklist(jobs: DataFrame) -> DataFrame:
    """Jobs in the order of work."""
    return jobs.orderBy(*work_order())


def latest_captures(captures: DataFrame) -> DataFrame:
    """The newest capture of every (source, route); ties go to the greater address, outcome
    and body so that the choice is repeatable. The choice is made on narrow rows, of which
    each task sends at most one per route; bodies are only joined to it. Captures that
    agree in all of that are one."""
    recency = F.struct("fetched_at", "url", "status_code", F.xxhash64("body").alias("body"))
    marked = captures.withColumn("_recency", recency)
    newest = marked.groupBy("source", "route_id").agg(F.max("_recency").alias("_newest"))
    same = marked["_recency"].eqNullSafe(newest["_newest"])
    chosen = marked.join(newest, ["source", "route_id"]).where(same)
    return chosen.dropDuplicates(["source", "route_id"]).select(captures.columns)


def capture_gaps(captures: DataFrame, routes: DataFrame) -> DataFrame:
    """(source, route_id, gap): routes that nobody captured (``no_capture``) and captures of
    routes that the catalog does not have (``no_route``)."""
    have, asked = (df.select("source", "route_id").distinct() for df in (captures, routes))
    by = ["source", "route_id"]
    return (
        asked.join(have, by, "left_anti").withColumn("gap", F.lit("no_capture"))
        .unionByName(have.join(asked, by, "left_anti").withColumn("gap", F.lit("no_route")))
    )
