"""Adding one row per key to rows of which one key may hold a large share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64
# A key is hot from so many rows on, if these are also more than one in so many of all rows.
HOT_ROWS, HOT_SHARE = 1_000_000, 1_000


def salted_lookup(rows: DataFrame, facts: DataFrame, keys: list[str], spread_by: Column, weight: str) -> DataFrame:
    """Join ``facts`` (one row per key, ``weight`` the number of its rows) to ``rows``. Only the
    rows of hot keys are spread over ``SALTS`` groups and only their facts are repeated, so a hot
    key never meets in one task; this also holds where an aggregate by the same key follows,
    which keeps the planner from splitting skewed partitions itself. There are at most
    ``HOT_SHARE`` hot keys, which bounds what is broadcast to mark their rows."""
    total = facts.agg(F.coalesce(F.sum(weight), F.lit(0))).scalar()
    heavy = (F.col(weight) >= HOT_ROWS) & (F.col(weight) * HOT_SHARE >= total)
    hot = facts.where(heavy).select(*keys, F.lit(True).alias("_hot"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.hash(spread_by), F.lit(SALTS))).otherwise(0)
    )
    copies = F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = facts.withColumn("_salt", F.explode(copies)).drop(weight)
    return salted.join(repeated, [*keys, "_salt"]).drop("_salt", "_hot")
