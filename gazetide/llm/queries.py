"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetide.llm import (
    alignment, chat, decontamination, filter_audit, licenses, lm, mixing, neardup, neighbours, packing, pii, sharding, sql, toxicity,
)
from gazetide.llm.common import table
from gazetide.session import cut_lineage


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.digest(pieces)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.scored(docs, toxicity.learn(docs, labels))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.assigned(table(spark, sf_dir, "documents")))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = cut_lineage(pii.candidates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "__spans"))
    return pii.digest(pii.decided(spans, pii.learned(spans)))


#: A conversation whose texts hold control strings.
CONTROL_STRINGS = """SELECT * FROM VALUES
    (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')
    AS t(conv_id, turn, role, text)"""


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    records = chat.conversations_as_records(rows.unionByName(spark.sql(CONTROL_STRINGS)))
    return chat.digest(chat.read_back(chat.formatted(chat.canonical(records, strict=True))))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.aligned(table(spark, sf_dir, "documents"), a, b).documents


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = filter_audit.followed(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))
    return filter_audit.report(counters.counts())


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mixed(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_neighbours": op2_neighbours,
    "op3_toxicity": op3_toxicity,
    "op4_sharding": op4_sharding,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_licenses": op6_licenses,
    "op7_decontamination": op7_decontamination,
    "op8_language_model": op8_language_model,
    "op9_pii": op9_pii,
    "op10_chat": op10_chat,
    "op11_alignment": op11_alignment,
    "op12_filter_audit": op12_filter_audit,
    "op13_mixing": op13_mixing,
}
SQL: dict[str, str] = {
    "op2_neighbours": sql.OP2,
    "op5_near_duplicates": sql.OP5,
    "op7_decontamination": sql.OP7,
    "op10_chat": sql.OP10,
    "op12_filter_audit": sql.OP12,
    "op13_mixing": sql.OP13,
}
