"""How the data model is laid over the test tables.

embeddings: a haplotype per vector, an allele per sign of a component, sites 1000 bp apart; its label is
the population, half of it the superpopulation. nation and region: overlapping genes and mask
intervals. lineitem: per-pair times (price) of genes (part) and populations (supplier), and statistics
(quantity) of sites by frequency (discount). All tables are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_SITES, SPACING = 64, 1000.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hap_id, pop, superpop, alleles: one row per haplotype."""
    alleles = F.transform("embedding", lambda v: F.when(v > 0, 1).otherwise(0).cast("tinyint"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("hap_id"), F.col("label").alias("pop"), F.floor(F.col("label") / 2).cast("int").alias("superpop"), alleles.alias("alleles"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hap_id, pop, superpop, site_idx (from 0), pos, allele: one row per haplotype and site."""
    rows = wide(spark, sf_dir).select("hap_id", "pop", "superpop", F.posexplode("alleles").alias("site_idx", "allele"))
    return rows.select("hap_id", "pop", "superpop", "site_idx", position(F.col("site_idx")).alias("pos"), F.col("allele").cast("int").alias("allele"))


def position(site_idx):
    return (site_idx + 1) * F.lit(SPACING)


def positions() -> list[float]:
    return [SPACING * (i + 1) for i in range(N_SITES)]


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("double")
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("gene_id"), F.col("n_name").alias("gene_name"), (2500 * n + 500).alias("start"), (2500 * n + 4500).alias("end"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("r_regionkey").cast("double")
    return read(spark, sf_dir, "region").select((12000 * r + 3000).alias("start"), (12000 * r + 6500).alias("end"), F.col("r_name").alias("mask_name"))


def pair_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene, pop, value: per-pair times of genes."""
    return read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).alias("gene"), (F.col("l_suppkey") % 10).alias("pop"), F.col("l_extendedprice").alias("value"))


def site_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene, freq, stat: a raw statistic of sites of known frequency."""
    return read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).alias("gene"), F.round(F.col("l_discount") * 10, 4).alias("freq"), F.col("l_quantity").alias("stat"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site"))


#: The same in DuckDB's SQL, as a prefix of oracle queries.
PANEL_SQL = """WITH panel AS (
  SELECT vec_id AS hap_id, label AS pop, label // 2 AS superpop, (u.i - 1)::INT AS site_idx, 1000.0::DOUBLE * u.i AS pos,
         (CASE WHEN embedding[u.i] > 0 THEN 1 ELSE 0 END)::INT AS allele
  FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) u)"""
PAIRS_SQL = PANEL_SQL + """, pairs AS (
  SELECT a.vec_id AS i, b.vec_id AS j, a.label AS pop FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id > b.vec_id),
diffs AS (
  SELECT p.i, p.j, p.pop, x.site_idx, x.pos, (x.allele <> y.allele)::INT AS d
  FROM pairs p JOIN panel x ON x.hap_id = p.i JOIN panel y ON y.hap_id = p.j AND y.site_idx = x.site_idx)"""
PHASES_SQL = PANEL_SQL + """, diffs AS (
  SELECT y.hap_id AS i, x.hap_id AS j, x.pop, x.site_idx, x.pos, (x.allele <> y.allele)::INT AS d
  FROM panel x JOIN panel y ON y.hap_id = x.hap_id + 1 AND x.hap_id % 2 = 0 AND y.site_idx = x.site_idx)"""
GENES_SQL = "genes AS (SELECT n_nationkey::BIGINT AS gene_id, n_name AS gene_name, (2500.0 * n_nationkey + 500)::DOUBLE AS \"start\", (2500.0 * n_nationkey + 4500)::DOUBLE AS \"end\" FROM nation)"
MASKS_SQL = "masks AS (SELECT (12000.0 * r_regionkey + 3000)::DOUBLE AS \"start\", (12000.0 * r_regionkey + 6500)::DOUBLE AS \"end\", r_name AS mask_name FROM region)"
VALUES_SQL = "vals AS (SELECT l_partkey % 200 AS gene, l_suppkey % 10 AS pop, l_extendedprice AS value FROM lineitem)"
STATS_SQL = "stats AS (SELECT l_partkey % 200 AS gene, round(l_discount * 10, 4) AS freq, l_quantity AS stat, l_orderkey * 10 + l_linenumber AS site FROM lineitem)"
