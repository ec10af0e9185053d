"""The weekly digest: projection, sheets and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetide.functions.dates import parse_date, roc_date
from gazetide.functions.text import CELL_LIMIT, cut, first_web_url, site_link, text_class
from gazetide.operators.affiliation import agency_path, with_affiliation
from gazetide.operators.numbering import number_rows
from gazetide.operators.policy import Policy
from gazetide.operators.relevance import HIGH, POSSIBLE, is_selected, score_items

# Sheet names, and the organisations with a sheet of their own.
SHEET_ALL, SHEET_SELECTED = "全部新聞", "已初步篩選工作表"
SHEET_REFERENCE, SHEET_RULES, SHEET_VERSION = "主題規則對照", "關聯性規則", "規則版本"
AGENCY_SHEETS = {
    "財政部": "財政部", "國發會": "國發會", "國科會": "國科會", "數位發展部": "數發部", "經濟部": "經濟部",
}

DIGEST_COLUMNS = [
    "agency", "date", "department_path", "title", "link_text", "summary", "date_source", "topics",
    "priority_sources", "relevance", "score", "reasons", "keywords", "exclusions", "topic_scores",
]

# Headings of the digest columns, in the same order.
HEADINGS = [
    "部會", "新聞日期", "單位分類", "新聞標題", "新聞連結", "新聞摘要", "日期來源", "關聯主題", "優先關聯機關",
    "關聯性", "關聯分數", "判定理由", "命中關鍵字", "排除關鍵字", "各主題評分",
]

UNLISTED = 2_147_483_647


def digest_rows(items: DataFrame, policy: Policy, affiliation: DataFrame) -> DataFrame:
    """The 15 digest columns per item, plus ``ord``."""
    scored = with_affiliation(score_items(items, policy), affiliation)
    listed = lambda field: F.array_join(F.col(f"rel.{field}"), "、")
    topic_scores = F.array_join(
        F.transform(
            "rel.topic_matches",
            lambda m: F.concat(m["name"], F.lit("（"), m["score"].cast("string"), F.lit("分，"), m["relevance"], F.lit("）")),
        ),
        "；",
    )
    return scored.withColumn("_agency", agency_path(F.col("source"), F.col("path"), F.col("department"))).select(
        "ord",
        F.col("_agency.parent").alias("agency"),
        "date",
        F.col("_agency.department_path").alias("department_path"),
        "title",
        site_link(F.col("source"), F.col("link")).alias("link_text"),
        "summary",
        "date_source",
        listed("topics").alias("topics"),
        listed("priority_sources").alias("priority_sources"),
        F.col("rel.relevance").alias("relevance"),
        F.col("rel.score").alias("score"),
        F.array_join("rel.reasons", "；").alias("reasons"),
        listed("matched_keywords").alias("keywords"),
        listed("excluded_keywords").alias("exclusions"),
        topic_scores.alias("topic_scores"),
    )


def with_source_order(rows: DataFrame, catalog: DataFrame, column: str = "agency") -> DataFrame:
    """Add the catalog position of ``column``; names outside the catalog come last."""
    places = catalog.select(F.col("name").alias("_name"), F.col("src_order").alias("_place"))
    return (
        rows.join(places, F.col(column) == F.col("_name"), "left")
        .withColumn("src_order", F.coalesce("_place", F.lit(UNLISTED)))
        .drop("_name", "_place")
    )


def digest_order() -> list[Column]:
    return [F.col(c).asc() for c in ("src_order", "date", "department_path", "title", "ord")]


def selected_order() -> list[Column]:
    rank = F.when(F.col("relevance") == HIGH, 0).otherwise(1)
    return [rank.asc(), F.col("score").desc(), F.col("topics").asc(), *digest_order()]


def selected_rows(rows: DataFrame) -> DataFrame:
    return rows.where(is_selected(F.col("relevance")))


def row_style(relevance: Column) -> Column:
    return F.when(relevance == HIGH, F.lit("high")).when(relevance == POSSIBLE, F.lit("possible")).otherwise(F.lit("base"))


def sheets(rows: DataFrame, catalog: DataFrame, agencies: dict[str, str] | None = None) -> DataFrame:
    """All news sheets as one table: a row appears in "all", in "selected" when relevant,
    and in the sheet of its organisation. ``row_no`` numbers the rows of each sheet."""
    agencies = AGENCY_SHEETS if agencies is None else agencies
    own_sheet = F.lit(None).cast("string")
    for agency, sheet in agencies.items():
        own_sheet = F.when(F.col("agency") == agency, F.lit(sheet)).otherwise(own_sheet)
    member_of = F.array_compact(
        F.array(F.lit(SHEET_ALL), F.when(is_selected(F.col("relevance")), F.lit(SHEET_SELECTED)), own_sheet)
    )
    placed = with_source_order(rows, catalog).withColumn("sheet", F.explode(member_of))
    in_selected = F.col("sheet") == SHEET_SELECTED
    ranked = (
        placed.withColumn("_rank", F.when(in_selected & (F.col("relevance") != HIGH), 1).otherwise(0))
        .withColumn("_points", F.when(in_selected, -F.col("score")).otherwise(0))
        .withColumn("_topics", F.when(in_selected, F.col("topics")).otherwise(F.lit("")))
    )
    order = [F.col("_rank").asc(), F.col("_points").asc(), F.col("_topics").asc(), *digest_order()]
    numbered = number_rows(ranked, "sheet", order).drop("_rank", "_points", "_topics", "src_order")
    cells = [cut(F.col(c), CELL_LIMIT).alias(c) if c != "score" else F.col(c) for c in DIGEST_COLUMNS]
    return numbered.select(
        "sheet",
        "row_no",
        *cells,
        first_web_url(F.col("link_text")).alias("link_url"),
        row_style(F.col("relevance")).alias("row_style"),
        (F.col("topics") != "").alias("topic_highlight"),
        text_class(F.col("title")).alias("title_class"),
    )


def date_choices(rows: DataFrame) -> DataFrame:
    """Every date of the digest with its ROC reading and the number of its rows."""
    day = parse_date(F.col("date"))
    return (
        rows.groupBy("date").agg(F.count("*").alias("row_count"))
        .withColumn("roc_date", roc_date(day))
        .where(F.col("roc_date").isNotNull())
    )


def rename_to_headings(rows: DataFrame) -> DataFrame:
    """Digest columns under their published headings."""
    return rows.select(*[F.col(c).alias(h) for c, h in zip(DIGEST_COLUMNS, HEADINGS)])


