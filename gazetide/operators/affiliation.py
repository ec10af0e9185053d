"""Publishers that belong together, and picking one row where they repeat each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetide.functions.exprs import key128, let
from gazetide.functions.text import clean_text, strip_space, title_key
from gazetide.session import small_table

# Publisher, and the path from its parent organisation down to it.
AFFILIATIONS = [
    ("內政部", []),
    ("國防部", []),
    ("教育部", []),
    ("法務部", []),
    ("交通部", []),
    ("農業部", []),
    ("衛生福利部", []),
    ("勞動部", []),
    ("數位發展部", []),
    ("國科會", []),
    ("海委會", []),
    ("退輔會", []),
    ("國土管理署", ["內政部", "國土管理署"]),
    ("國家公園署", ["內政部", "國家公園署"]),
    ("國土測繪中心", ["內政部", "國土測繪中心"]),
    ("警政署", ["內政部", "警政署"]),
    ("消防署", ["內政部", "消防署"]),
    ("中科院", ["國防部", "中科院"]),
    ("國防院", ["國防部", "國防院"]),
    ("國教院", ["教育部", "國教院"]),
    ("矯正署", ["法務部", "矯正署"]),
    ("最高檢察署", ["法務部", "最高檢察署"]),
    ("觀光署", ["交通部", "觀光署"]),
    ("公路局", ["交通部", "公路局"]),
    ("高速公路局", ["交通部", "高速公路局"]),
    ("航港局", ["交通部", "航港局"]),
    ("中央氣象署", ["交通部", "中央氣象署"]),
    ("農業金融署", ["農業部", "農業金融署"]),
    ("農糧署", ["農業部", "農糧署"]),
    ("漁業署", ["農業部", "漁業署"]),
    ("農村發展及水土保持署", ["農業部", "農村發展及水土保持署"]),
    ("防檢署", ["農業部", "防檢署"]),
    ("農科園區", ["農業部", "農科園區"]),
    ("食藥署", ["衛生福利部", "食藥署"]),
    ("疾管署", ["衛生福利部", "疾管署"]),
    ("國健署", ["衛生福利部", "國健署"]),
    ("社家署", ["衛生福利部", "社家署"]),
    ("勞動力發展署", ["勞動部", "勞動力發展署"]),
    ("職業安全衛生署", ["勞動部", "職業安全衛生署"]),
    ("勞動基金運用局", ["勞動部", "勞動基金運用局"]),
    ("數位產業署", ["數位發展部", "數位產業署"]),
    ("資通安全署", ["數位發展部", "資通安全署"]),
    ("國家資通安全研究院", ["數位發展部", "國家資通安全研究院"]),
    ("國家實驗研究院", ["國科會", "國家實驗研究院"]),
    ("國家太空中心", ["國科會", "國家太空中心"]),
    ("海巡署", ["海委會", "海巡署"]),
    ("艦隊分署", ["海委會", "海巡署", "艦隊分署"]),
    ("偵防分署", ["海委會", "海巡署", "偵防分署"]),
    ("榮總", ["退輔會", "榮總"]),
]


def default_affiliation(spark: SparkSession) -> DataFrame:
    """(source, path): full path for children, an empty path for parents."""
    return small_table(spark, AFFILIATIONS, "source string, path array<string>")


def with_affiliation(items: DataFrame, affiliation: DataFrame, source: Column | None = None) -> DataFrame:
    """Add ``path`` (empty when none) and ``grp`` (NULL when the publisher stands alone).

    A plain left join: the default table has 49 rows and its size is known to the planner,
    so it is broadcast; a table too large for that is joined by shuffle.
    """
    looked_up = affiliation.select(F.col("source").alias("_name"), F.col("path").alias("_path"))
    joined = items.join(looked_up, (F.col("source") if source is None else source) == F.col("_name"), "left")
    grp = F.when(F.size("_path") > 0, F.get("_path", F.lit(0))).when(F.col("_name").isNotNull(), F.col("_name"))
    return (
        joined.withColumn("grp", grp)
        .withColumn("path", F.coalesce(F.col("_path"), F.array().cast("array<string>")))
        .drop("_name", "_path")
    )


def dedupe_affiliated(items: DataFrame, affiliation: DataFrame) -> DataFrame:
    """One row per (group, date, title): children before parents, rows with a department
    of their own first, then rows with a link, then reading order. Rows without group or
    date pass. The new ``ord`` puts passing rows first and each winner at the place of its
    group's first row.

    The preference and ``ord`` are packed into one number, so that picking a winner is a
    partial aggregate of numbers; the way back to the full row is by unique ``ord``. A row whose
    ``ord`` does not fit (as after a first pass of this operator) stops the job.
    """
    day = clean_text(F.col("date"))
    department = clean_text(F.col("department"))
    rank = (
        F.when(F.size("path") == 0, 4).otherwise(0)
        + F.when((department == "") | (department == clean_text(F.col("source"))), 2).otherwise(0)
        + F.when(clean_text(F.col("link")) == "", 1).otherwise(0)
    ).cast("long")
    grouped = with_affiliation(items, affiliation, clean_text(F.col("source"))).withColumn("_member", F.col("grp").isNotNull() & (day != ""))
    fits = (F.col("ord") >= 0) & (F.col("ord") < 1 << 60)
    grouped = grouped.withColumn("ord", F.when(fits, F.col("ord")).otherwise(F.raise_error(F.lit("ord is not within 0 to 2**60 - 1"))))
    packed = F.shiftleft(rank, 60).bitwiseOR(F.col("ord"))
    winners = (
        grouped.where("_member")
        .groupBy(key128(F.col("grp"), day, title_key(F.col("title"))).alias("_key"))
        .agg(F.min(packed).alias("_best"), F.min("ord").alias("_place"))
        .select(F.col("_best").bitwiseAND(F.lit((1 << 60) - 1)).alias("ord"), "_place")
    )
    return (
        grouped.join(winners, "ord", "left")
        .where(~F.col("_member") | F.col("_place").isNotNull())
        .withColumn("ord", F.coalesce(F.col("_place") + F.lit(1 << 60), F.col("ord")))
        .drop("_place", "_member", "grp", "path")
    )


def agency_path(source: Column, path: Column, department: Column) -> Column:
    """struct(parent, department_path): affiliation path first, then the department's own
    steps that are not in it yet."""
    base = F.when(F.size(path) > 0, path).otherwise(F.array(source))
    steps = F.filter(F.transform(F.split(department, "／| / "), strip_space), lambda x: x != "")
    whole = F.array_distinct(F.concat(base, steps))
    return let(
        whole,
        lambda w: F.struct(
            F.get(w, F.lit(0)).alias("parent"),
            F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), " / ").alias("department_path"),
        ),
    )
