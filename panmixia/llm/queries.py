"""The operators' queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panmixia.llm import ann, maxent, mixing, neardup, packing, pii, quality, secrets, toxicity, warc
from panmixia.llm.common import fold_of, table
from panmixia.llm.oracles import ORACLE


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.host_quality(table(spark, sf_dir, "documents"))
    return judged.drop(*[c for c in judged.columns if c.startswith("rate_")])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), F.col("score"), F.col("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_multi_index, op2_secret_scan, op3_maxent, op4_host_quality, op5_pii, op6_jaccard_join, op7_toxicity, op8_packing, op9_warc, op10_source_mix)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
