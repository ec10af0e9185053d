"""Progress of runs from their event log, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DONE_KINDS = ["source_finished", "source_failed"]


def percent(kind: Column, completed: Column, total: Column) -> Column:
    """Percentage shown after an event of ``kind``."""
    share = F.round(F.lit(5) + F.try_divide(completed, total) * 90).cast("int")
    counted = F.when(completed > 0, F.greatest(F.lit(5), share)).otherwise(F.lit(5))
    return (
        F.when(kind.isNull(), F.lit(0))
        .when(kind == "completed", F.lit(100))
        .when(kind == "writing_outputs", F.lit(95))
        .when(kind.isin("started", "source_started"), F.when(total > 0, counted).otherwise(F.lit(5)))
        .when(total > 0, F.least(F.lit(95), F.greatest(F.lit(5), share)))
        .otherwise(F.lit(5))
    )


def run_progress(events: DataFrame) -> DataFrame:
    """Per run: finished and failed sources, total, last event and percentage. Events have
    run_id, seq, kind and total. The same plan serves a batch and a stream in update mode;
    a run's state is a few numbers, however many events it has."""
    per_run = events.groupBy("run_id").agg(
        F.count_if(F.col("kind").isin(DONE_KINDS)).alias("completed"),
        F.count_if(F.col("kind") == "source_failed").alias("failed"),
        F.max("total").alias("total"),
        F.max_by("kind", "seq").alias("last_kind"),
    )
    return per_run.withColumn("percent", percent(F.col("last_kind"), F.col("completed"), F.col("total")))


def follow(events: DataFrame, out: str, checkpoint: str):
    """Start a stream that keeps the progress of runs under ``out``. Every micro-batch
    writes the runs it changed into a folder of its own, which a repeated batch replaces."""

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return (
        run_progress(events)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
        .trigger(availableNow=True)
        .start()
    )


def partial_progress(events: DataFrame) -> DataFrame:
    """What some events add to the progress of their runs."""
    return events.groupBy("run_id").agg(
        F.count_if(F.col("kind").isin(DONE_KINDS)).alias("completed"),
        F.count_if(F.col("kind") == "source_failed").alias("failed"),
        F.max("total").alias("total"),
        F.max(F.struct("seq", "kind")).alias("last"),
    )


def follow_resent(events: DataFrame, out: str, checkpoint: str, delay: str):
    """Start a stream over events (run_id, seq, kind, total, at) that senders may repeat. An event
    sent again within ``delay`` meets its first copy in the state; one sent later than that is behind
    the watermark and goes. The state therefore holds the events of one ``delay``, not all runs:
    every micro-batch stores what its new events add, and ``merged`` sums that up. A repeated
    micro-batch replaces its folder. An event that comes for the first time behind the watermark
    goes too, so ``delay`` is the longest that a sender may hold one back."""

    def store(batch: DataFrame, epoch: int) -> None:
        partial_progress(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return (
        events.withWatermark("at", delay)
        .dropDuplicatesWithinWatermark(["run_id", "seq"])
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
        .trigger(availableNow=True)
        .start()
    )


def merged(stored: DataFrame) -> DataFrame:
    """Progress per run from what ``follow_resent`` stored, as ``run_progress`` gives it."""
    per_run = stored.groupBy("run_id").agg(
        F.sum("completed").alias("completed"), F.sum("failed").alias("failed"), F.max("total").alias("total"),
        F.max("last")["kind"].alias("last_kind"),
    )
    return per_run.withColumn("percent", percent(F.col("last_kind"), F.col("completed"), F.col("total")))


def latest(stored: DataFrame) -> DataFrame:
    """Newest progress per run from what ``follow`` stored."""
    columns = [c for c in stored.columns if c not in ("run_id", "epoch")]
    newest = stored.groupBy("run_id").agg(F.max_by(F.struct(*columns), "epoch").alias("_s"))
    return newest.select("run_id", *[F.col(f"_s.{c}").alias(c) for c in columns])
