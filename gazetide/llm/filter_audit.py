"""Interaction of filters, kept up incrementally with retractions.

Which filters a document fails is a mask of bits. Four filters look at the text alone; the fifth
fails a document whose text occurs under a smaller id anywhere in the table, so its bit can
change when a later file brings that smaller id. All files are processed as available-now
micro-batches. Keyed by text, the state holds the rows with the smallest id seen so far. A
micro-batch counts its documents by part, mask and labels as copies, takes back the ones that now
hold their text, and where a smaller id has come for a text of an earlier batch, retracts what
was counted for the former holder and counts it as a copy. Counters are sums of these signed
numbers; every order of the filters is read off them.

The state is a table in the shared folder, one folder per micro-batch that a repeated batch
replaces, with rows only added: the holder of a text is its row with the smallest id. Copies
are folded before they are shuffled by text, and rows meet their text's smallest id by (text,
id), so that a text with very many copies does not land in one task.

Defined results: a null text is empty; words are ``[^\\x20\\x09-\\x0D]+``. A null part is the empty
string. Texts are compared as whole, by 128 bits of SHA-256. Rows that repeat an id and its text
are no copies of each other, and are counted each. A document without id is never a copy and
makes none. Of several labels of one id any 1 counts; ids without labels have none. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetide.llm.common import written
from gazetide.session import shared_folder

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
COUNTED = ["part", "mask", "good", "toxic"]
WHO = "key binary, doc_id long, part string, mask int, good int, toxic int, n long"


def judged(docs: DataFrame, part: Column) -> DataFrame:
    """doc_id, part, key (of the text) and mask (of the filters that look at the text alone)."""
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # A generator's output is evaluated once, however many filters use it.
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))
    rows = rows.select("*", F.inline(counts))
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failures = [
        F.col("all") < 100,
        F.col("distinct").cast("long") * 100 < F.col("all").cast("long") * 80,
        capitals.cast("long") * 100 > F.length("text").cast("long") * 10,
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    mask = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(failures)), F.lit(0))
    key = F.substring(F.unhex(F.sha2("text", 256)), 1, 16)
    return rows.select("doc_id", "part", key.alias("key"), mask.cast("int").alias("mask"))


class Counters:
    """What the micro-batches leave in ``folder``: the batch's rows, the state's additions and
    the signed counts, each in a folder per batch."""

    def __init__(self, spark: SparkSession, labels: DataFrame, folder: str):
        self.spark, self.labels, self.folder = spark, labels, folder
        self.epochs: list[int] = []

    def _read(self, kind: str, epochs: list[int], schema: str) -> DataFrame:
        if not epochs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{kind}/epoch={e}" for e in epochs])

    def counts(self) -> DataFrame:
        """part, mask, good, toxic, n over all batches."""
        schema = "part string, mask int, good int, toxic int, n long"
        return self._read("counts", self.epochs, schema).groupBy(*COUNTED).agg(F.sum("n").alias("n")).where("n <> 0")

    def add(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch of ``judged`` rows."""
        before = [e for e in self.epochs if e < epoch]
        # The stream's own session plans without adaptive execution; the work goes on in ours.
        batch.write.mode("overwrite").parquet(f"{self.folder}/rows/epoch={epoch}")
        came = self._read("rows", [epoch], "doc_id long, part string, key binary, mask int")
        rows = written(
            came.groupBy("key", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
            .join(self.labels, "doc_id", "left")
            .select("key", "doc_id", "part", "mask",
                    F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n"),
            "audit-rows",
        )
        held = self._read("state", before, WHO)
        smallest = (
            rows.select("key", "doc_id", F.lit(None).cast("long").alias("held_id"))
            .unionByName(held.select("key", F.lit(None).cast("long").alias("doc_id"), F.col("doc_id").alias("held_id")))
            .groupBy("key")
            .agg(F.min("doc_id").alias("came"), F.min("held_id").alias("was"))
            .where("came is not null")
        )
        smallest = written(smallest, "audit-smallest")
        first = smallest.where("was is null or came <= was").select("key", F.col("came").alias("doc_id"))
        holders = rows.join(first, ["key", "doc_id"])
        holders.select(*[c.split()[0] for c in WHO.split(", ")]).write.mode("overwrite").parquet(
            f"{self.folder}/state/epoch={epoch}"
        )
        holders = self._read("state", [epoch], WHO)
        former = held.join(
            smallest.where("came < was").select("key", F.col("was").alias("doc_id")), ["key", "doc_id"]
        )
        copy = F.when(F.col("doc_id").isNull(), F.col("mask")).otherwise(F.col("mask").bitwiseOR(COPY))

        def signed(df: DataFrame, mask: Column, sign: int) -> DataFrame:
            return df.select("part", mask.alias("mask"), "good", "toxic", (F.col("n") * sign).alias("n"))

        changes = [
            signed(rows, copy, 1),
            signed(holders, copy, -1),
            signed(holders, F.col("mask"), 1),
            signed(former, F.col("mask"), -1),
            signed(former, copy, 1),
        ]
        total = changes[0]
        for change in changes[1:]:
            total = total.unionByName(change)
        total.groupBy(*COUNTED).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(
            f"{self.folder}/counts/epoch={epoch}"
        )
        if epoch not in self.epochs:
            self.epochs.append(epoch)


def label_flags(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic for the ids that have one of them."""
    return written(
        labels.where("doc_id is not null and (quality = 1 or toxic = 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
            F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
        ),
        "audit-labels",
    )


def followed(spark: SparkSession, path: str, labels: DataFrame, part: str = "lang", batches: int = 4) -> Counters:
    """Counters over all files under ``path``, taken in as ``batches`` available-now
    micro-batches of about equal numbers of files."""
    docs = spark.read.parquet(path)
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    counters = Counters(spark, label_flags(labels), folder)
    files = docs.inputFiles()
    at_once = max(1, -(-len(files) // batches))
    path = path.rstrip("/")
    if [f.rsplit("/", 1)[1] for f in files] == [path.rsplit("/", 1)[1]]:
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only as a pattern
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", at_once).parquet(path)
    query = (
        judged(stream, F.col(part))
        .writeStream.foreachBatch(counters.add)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return counters


def report(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of every step of every order of the filters."""
    orders = ["".join(order) for order in itertools.permutations(FILTERS)]
    steps = counts.select(
        "*", F.explode(F.lit(orders)).alias("filter_order")
    ).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))

    def bit(letter: Column) -> Column:
        return F.element_at(F.lit([1 << i for i in range(len(FILTERS))]), F.ascii(letter) - ord("A") + 1)

    earlier = F.aggregate(
        F.filter(F.split(F.expr("substring(filter_order, 1, at)"), ""), lambda x: x != ""),
        F.lit(0),
        lambda have, letter: have.bitwiseOR(bit(letter)),
    )
    steps = steps.select("part", "mask", "good", "toxic", "n", "filter_order", (F.col("at") + 1).alias("step"),
                         bit(F.col("letter")).alias("own"), earlier.alias("earlier"))
    here = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) != 0

    def total(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long")

    per_step = steps.groupBy("part", "filter_order", "step", "own").agg(
        total(~here & ~gone).alias("kept"),
        total(here & ~gone).alias("removed"),
        total(here & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(here & ~gone & (F.col("good") == 1)).alias("good_lost"),
        total(here & ~gone & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    shapley = per_step.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return per_step.join(shapley, ["part", "own"]).drop("own")
