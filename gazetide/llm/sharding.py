"""Sharding by fixed virtual slots, in DataFrame operations only.

A hash puts every record into one of thousands of virtual slots, for good. Bytes are summed per
slot, and a small versioned table maps slots to shards: version 0 places the heaviest slots
first, each on the shard with the fewest bytes; a later version is the edit of the one before
that moves slots, and only those, when shards are added. Records never move between slots, so
a rebalancing touches the map and the records of the moved slots.

Numbers inside a shard come without a window over a shard: slots are split into cells of bounded
size, cells are numbered by running sums over the small cell table, records within their cell.

Defined results: a null text has no bytes and counts as size 1. A record's slot comes from id and
text, so null and repeated ids spread; repeated rows are numbered each. An empty table gives an
empty result and a map without bytes. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gazetide.session import cut_lineage, shared_folder


def records(docs: DataFrame, slots: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, vslot, and a second hash for cells."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64("doc_id", text)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(key, F.lit(slots)).cast("int").alias("vslot"),
        F.xxhash64(key, F.lit(1)).alias("fine"),
    )


def slot_bytes(rows: DataFrame, slots: int = 4096) -> DataFrame:
    """vslot, bytes for every slot, empty ones too."""
    have = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(have, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"))


def first_map(slot_sizes: DataFrame, shards: int) -> DataFrame:
    """version, vslot, shard: heaviest slot first, to the shard with the fewest bytes. The
    table has one row per slot, a fixed number."""
    ordered = slot_sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "vslot"))).alias("s"))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("load"),
        F.array().cast("array<struct<vslot:int,shard:int>>").alias("placed"),
    )

    def place(have, slot):
        lightest = (F.array_position(have["load"], F.array_min(have["load"])) - 1).cast("int")
        return F.struct(
            F.transform(have["load"], lambda x, i: x + F.when(i == lightest, -slot["minus"]).otherwise(0)).alias("load"),
            F.concat(have["placed"], F.array(F.struct(slot["vslot"].alias("vslot"), lightest.alias("shard")))).alias("placed"),
        )

    placed = ordered.select(F.explode(F.aggregate("s", start, place, lambda have: have["placed"])).alias("p"))
    return placed.select(F.lit(0).alias("version"), "p.vslot", "p.shard")


def grown_map(shard_map: DataFrame, slot_sizes: DataFrame, shards: int) -> DataFrame:
    """``shard_map`` with one more version, for one more shard: of every shard, slots up to its
    surplus over the new even share go to the new one, all other slots stay."""
    last = shard_map.where(F.col("version") == shard_map.agg(F.max("version")).first()[0])
    sized = last.join(slot_sizes, "vslot")
    in_shard = Window.partitionBy("shard")
    running = F.sum("bytes").over(in_shard.orderBy(F.col("bytes"), "vslot"))
    surplus = F.sum("bytes").over(in_shard) / (shards + 1)
    edited = sized.select(
        (F.col("version") + 1).alias("version"),
        "vslot",
        F.when((running <= surplus) & (F.col("bytes") > 0), F.lit(shards)).otherwise(F.col("shard")).alias("shard"),
    )
    return shard_map.unionByName(edited)


def write_map(versions: DataFrame, path: str) -> None:
    """Add versions (version, vslot, shard) to the stored map; earlier ones are never changed."""
    versions.write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the newest when none is named."""
    stored = spark.read.schema("vslot int, shard int, version int").parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def rebalance(docs: DataFrame, path: str) -> None:
    """Store one more version for one more shard, by the bytes that ``docs`` have per slot now."""
    last = cut_lineage(read_map(docs.sparkSession, path))
    number, shards, slots = last.agg(F.max("version"), F.max("shard") + 1, F.count("*")).first()
    edited = grown_map(last, slot_bytes(records(docs, slots), slots), shards)
    write_map(edited.where(F.col("version") == number + 1), path)


def assigned(
    docs: DataFrame, shards: int = 8, slots: int = 4096, cell_rows: int = 50_000, path: str | None = None, version: int | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, and ``slot``: the record's number in its shard,
    from 0 without gaps. Records go by the map stored at ``path`` in ``version`` (the newest when
    None), whose shards and slots then count; without ``path`` a first map is stored and read."""
    spark = docs.sparkSession
    if path is None:
        rows = cut_lineage(records(docs, slots))
        path = f"{shared_folder(spark)}/shard-map-{uuid.uuid4().hex}"
        write_map(first_map(slot_bytes(rows, slots), shards), path)
    else:
        slots = read_map(spark, path, version).count()
        rows = cut_lineage(records(docs, slots))
    shard_map = read_map(spark, path, version).select("vslot", "shard")
    # Cells of a slot: so many that each has a bounded number of rows, by the table's size.
    fine = max(1, -(-rows.count() // (slots * cell_rows)))
    celled = rows.withColumn("cell", F.pmod("fine", F.lit(fine)).cast("int"))
    cells = celled.groupBy("vslot", "cell").agg(F.count("*").alias("n"))
    in_slot = Window.partitionBy("vslot").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    in_shard = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    slot_base = (
        cells.groupBy("vslot").agg(F.sum("n").alias("n"))
        .join(shard_map, "vslot")
        .select("vslot", "shard", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("before"))
    )
    bases = cells.select("vslot", "cell", F.coalesce(F.sum("n").over(in_slot), F.lit(0)).alias("inside")).join(
        slot_base, "vslot"
    ).select("vslot", "cell", "shard", (F.col("before") + F.col("inside")).alias("base"))
    number = F.row_number().over(Window.partitionBy("vslot", "cell").orderBy("doc_id", "text_crc32", "size"))
    return (
        celled.withColumn("number", number)
        .join(bases, ["vslot", "cell"])
        .select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("base") + F.col("number") - 1).cast("long").alias("slot"))
    )


def digest(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
