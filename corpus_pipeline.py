"""A corpus pipeline: each stage's rows are written as Parquet and read again by the next one.

1. toxicity: documents that the lexicon model rejects go.
2. near_duplicates: one document of each group with a 5-word Jaccard similarity of 0.8 or more stays.
3. secrets: every span that the scan finds is replaced in the text; all documents stay.
4. mix: documents are taken as often as the mix takes most of their words (never to three times), so
   sources have their target shares; a document of which less than half is due is left out.
5. pack: the rest is tokenized and packed into sequences of at most 2048 tokens.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and extra
columns of any name: names that a stage needs besides are chosen free of the table's own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from panmixia.llm import mixing, neardup, packing, secrets, toxicity
from panmixia.llm.common import shared_dir, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have no match and stay; repeated rows share their fate; without labels, all stay."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words are alike to nothing and stay; of rows that repeat id and text, one stays."""
    return neardup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per input row; null texts stay null, and ``n_chars`` follows the text."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words stay once; repeated ids are taken by their rows' words together."""
    return mixing.resample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are an end token alone; each copy of a repeated row is packed."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: No stage but the mix can be said in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{base}/{i}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
