"""The archive of captures: a table by day of fetching, of which a run reads an interval."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetide.session import materialised

OWN = ["capture_id", "body_hash", "fetch_day"]


def add_captures(captures: DataFrame, path: str) -> None:
    """Append ``captures`` (``CAPTURE``) to the archive. Every row gets an id of its own and the
    hash of its body, once and for all, so that choosing among captures reads no body."""
    captures.withColumns(
        {"capture_id": F.expr("uuid()"), "body_hash": F.xxhash64("body"), "fetch_day": F.to_date("fetched_at")}
    ).write.mode("append").partitionBy("fetch_day").parquet(path)


def captures_between(archive: DataFrame, first: dt.date | None, last: dt.date | None) -> DataFrame:
    """Captures fetched on the days ``first`` to ``last``: a partition filter. None leaves an end
    open; captures without a time of fetching belong to no interval with an end."""
    if first is not None:
        archive = archive.where(F.col("fetch_day") >= F.lit(first))
    return archive if last is None else archive.where(F.col("fetch_day") <= F.lit(last))


def newest_captures(archive: DataFrame) -> DataFrame:
    """The newest capture of every (source, route), columns as in ``CAPTURE``; ties go to the
    greater address, outcome, body hash and id. The choice is a narrow table of known size; the
    archive is read again for it with its days as a join key, so that other days are pruned, and
    bodies are shuffled only where the choice is too large to broadcast."""
    order = F.struct("fetched_at", "url", "status_code", "body_hash", "capture_id", "fetch_day")
    chosen = archive.groupBy("source", "route_id").agg(F.max(order).alias("best"))
    narrow = materialised(chosen.select("best.capture_id", "best.fetch_day"), "newest")
    by = (archive["capture_id"] == narrow["capture_id"]) & archive["fetch_day"].eqNullSafe(narrow["fetch_day"])
    return archive.join(narrow, by, "left_semi").drop(*OWN)
