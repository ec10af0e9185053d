"""Mixing sources to target weights by systematic sampling.

A source's target is its share of all words by weight, at most ``most`` times its own size; what
a capped source leaves is shared by the others again until none is above its cap. Within a
source every document expects the same number of copies, target / size. Documents lie in a line
by size; a prefix sum of expected copies gives each one an interval of that line, one random
offset per source shifts it, and a document is taken once per integer inside its interval. So a
document is taken the whole part of its expectation or one time more, never above ``most``; and
because neighbours on the line have like sizes, a source's words differ from its target by less
than its largest document.

Places on the line come from range partitions and a table of offsets, so a hot source spans many
tasks. Expectations are fixed-point integers: results do not depend on partitions or on rounding.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, a null text has none. A null source is a
source of its own, last in the order that deals out weights. Sources without words have target 0
and their documents are not taken. Ties in size are ordered by id, then by text; rows equal in
all of these are taken as often together as their intervals say. An empty table gives an empty
result. Extra columns are ignored by the decisions and kept by ``emitted``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetide.llm.common import unused
from gazetide.operators.numbering import number_rows
from gazetide.session import cut_lineage

ONE = 1 << 32  # one expected copy


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and a hash of the text that tells rows with one id apart."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("text_key"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """source, source_size, target, step (expected copies of each of its documents times 2**32)
    and offset, for every source of ``sizes``."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("every", F.lit(0))
    placed = number_rows(per_source, "every", [F.col("source").asc_nulls_last()], "place")
    dealt = F.get(F.lit(list(weights)), ((F.col("place") - 1) % len(weights)).cast("int"))
    sources = cut_lineage(placed.select("source", "source_size", dealt.cast("long").alias("weight")))

    def exact(column):
        return column.cast("decimal(20,0)")

    words, share = sources.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))
    ).first()
    open_words, open_weight = words, share
    cap = exact(F.col("source_size") * most)
    while True:  # two numbers a round; rounds end when no further source is above its cap
        above = cap * F.lit(Decimal(open_weight)) < exact(F.col("weight")) * F.lit(Decimal(open_words))
        capped, weight = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("source_size") * most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        if (words - capped, weight) == (open_words, open_weight):
            break
        open_words, open_weight = words - capped, weight
    fair = F.col("weight").cast("double") * F.lit(float(open_words)) / F.lit(float(open_weight or 1))
    fixed = F.expr(
        f"(cast(weight as decimal(10,0)) * {open_words}BD * {ONE}BD) div (source_size * {max(open_weight, 1)}BD)"
    )
    salt = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce("source", F.lit(""))).cast("binary"))
    return sources.select(
        "source",
        "source_size",
        F.when(above, cap.cast("double")).otherwise(fair).alias("target"),
        F.when(F.col("source_size") == 0, 0).when(above, most * ONE).otherwise(fixed).cast("long").alias("step"),
        F.conv(F.substring(salt, 1, 8), 16, 10).cast("long").alias("offset"),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, text_key, source_size, target and ``copies`` of every row."""
    sizes = cut_lineage(sized(docs))
    line = number_rows(sizes, "source", [F.col("size"), F.col("doc_id"), F.col("text_key")], "place")
    goals = targets(sizes, weights, most, seed).withColumnRenamed("source", "of")

    def crossed(place):
        return F.expr(f"(cast({place} as decimal(20,0)) * cast(step as decimal(11,0)) + offset) div {ONE}BD")

    return line.join(goals, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "text_key", "source_size", "target",
        (crossed("place") - crossed("(place - 1)")).cast("int").alias("copies"),
    )


def emitted(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``decisions`` take them, with the number of the copy in
    ``copy`` (which replaces a column of that name). Equal rows count as one document that is
    taken as often as all of them together."""
    key, copies, n = (unused(docs, f"__{x}") for x in ("key", "copies", "rows"))
    wanted = (
        decisions.groupBy(F.struct("doc_id", "source", "text_key").alias(key))
        .agg(F.sum("copies").cast("int").alias(copies), F.count("*").alias(n))
        .where(F.col(copies) > 0)
    )
    of_row = F.struct(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(F.col("text").cast("string")).alias("text_key"),
    )
    rows = docs.withColumn(key, of_row).join(wanted, key)
    # Only rows that are there several times have to meet.
    alone, together = rows.where(F.col(n) == 1), rows.where(F.col(n) > 1).dropDuplicates([key])
    return (
        alone.unionByName(together)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(copies))))
        .drop(key, copies, n)
    )


def digest(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )
