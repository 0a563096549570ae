"""Metadata tables and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_chromosome(spark: SparkSession, path: str, chrom: int | str | None = None, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """A long panel partitioned by chromosome: the chromosome prunes files and the region is pushed to the scan."""
    df = spark.read.parquet(path)
    if chrom is not None:
        df = df.where(F.col("chrom") == chrom)
    return df if lo is None else df.where(F.col("pos").between(lo, hi))


def write_chromosome(panel: DataFrame, path: str) -> None:
    panel.write.mode("overwrite").partitionBy("chrom").parquet(path)


def parse_samples(lines: DataFrame) -> DataFrame:
    """sample_id, pop, superpop from white-space columns 2, 6 and 7; shorter lines and the header are left out."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.select(f.alias("f")).where((F.size("f") >= 7) & (F.get("f", F.lit(0)) != "FamilyID"))
    return rows.select(F.get("f", F.lit(1)).alias("sample_id"), F.get("f", F.lit(5)).alias("pop"), F.get("f", F.lit(6)).alias("superpop"))


def parse_genes(lines: DataFrame) -> DataFrame:
    """gene_id, gene_name, start, end from tab-separated lines with a header."""
    f = F.split("value", "\t")
    rows = lines.select(f.alias("f")).where(F.get("f", F.lit(0)) != "gene_id")
    return rows.select(F.get("f", F.lit(0)).alias("gene_id"), F.get("f", F.lit(1)).alias("gene_name"), F.get("f", F.lit(2)).cast("long").alias("start"), F.get("f", F.lit(3)).cast("long").alias("end"))


def parse_mask(lines: DataFrame) -> DataFrame:
    """chrom, start, end from columns 2 to 4 of a segmental-duplication table; only numbered chromosomes count."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(f.alias("f")).where(F.get("f", F.lit(1)).rlike("^chr[0-9]+$"))
    return rows.select(F.regexp_extract(F.get("f", F.lit(1)), "[0-9]+", 0).cast("int").alias("chrom"), F.get("f", F.lit(2)).cast("long").alias("start"), F.get("f", F.lit(3)).cast("long").alias("end"))


def parse_leads(lines: DataFrame, chrom: str | None = None) -> DataFrame:
    """chrom, pos, rsid, x, s, posterior; a missing id becomes chromosome and position."""
    f = F.split("value", "\t", -1)
    rows = lines.select(f.alias("f")).where(F.get("f", F.lit(0)) != "CHROM")
    text = [F.get("f", F.lit(i)) for i in range(6)]
    rsid = F.when(text[2].isin("", ".", "NA") | text[2].isNull(), F.concat_ws("_", text[0], text[1])).otherwise(text[2])
    out = rows.select(text[0].alias("chrom"), text[1].cast("long").alias("pos"), rsid.alias("rsid"), *[t.try_cast("double").alias(n) for t, n in zip(text[3:], ("x", "s", "posterior"), strict=True)])
    return out if chrom is None else out.where(F.col("chrom") == chrom)


def parse_selscan(lines: DataFrame) -> DataFrame:
    """pos, freq, stat, abs_stat from white-space columns: the second, the third and the last; a header is left out."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.select(f.alias("f")).where(F.get("f", F.lit(1)).rlike("^[0-9]+$"))
    stat = F.element_at("f", -1).try_cast("double")
    return rows.select(F.get("f", F.lit(1)).cast("long").alias("pos"), F.get("f", F.lit(2)).try_cast("double").alias("freq"), stat.alias("stat"), F.abs(stat).alias("abs_stat"))


def gene_csv(accumulators: DataFrame) -> DataFrame:
    """Values with two decimals; empty where there is none."""
    value = lambda c: F.when(c.isNull() | F.isnan(c), "").otherwise(F.regexp_replace(F.format_number(c, 2), ",", ""))
    n = F.col("count")
    return accumulators.select("gene", "pop", value(F.exp(F.col("log_sum") / n)).alias("geom_mean_tmrca"), value(F.col("lin_sum") / n).alias("arith_mean_tmrca"), value(F.col("min_lin")).alias("min_tmrca"), F.col("count").alias("n_pairs"))


def write_accumulators(accumulators: DataFrame, path: str, *by: str) -> None:
    accumulators.write.mode("overwrite").partitionBy(*by).parquet(path)


def hap_lines(wide: DataFrame) -> DataFrame:
    """hap_id, value: alleles with spaces between them, a haplotype per line."""
    return wide.select("hap_id", F.array_join(F.transform("alleles", lambda a: a.cast("string")), " ").alias("value"))


def map_lines(sites: DataFrame, chrom: str = "1") -> DataFrame:
    """pos, value: chromosome, id, centimorgans at 1 per million bases, position."""
    bp = F.col("pos").cast("long")
    return sites.select("pos", F.concat_ws(" ", F.lit(chrom), F.concat_ws(":", F.lit(chrom), bp.cast("string")), F.format_string("%.8f", F.col("pos") * 1e-6), bp.cast("string")).alias("value"))


def asmc_lines(panel: DataFrame, chrom: str = "1") -> DataFrame:
    """pos, value: chromosome, id, position, both alleles, then a column per haplotype."""
    cells = F.sort_array(F.collect_list(F.struct("hap_id", "allele")))
    g = panel.groupBy("pos").agg(F.array_join(F.transform(cells, lambda c: c["allele"].cast("string")), " ").alias("gt"))
    bp = F.col("pos").cast("long").cast("string")
    return g.select("pos", F.concat_ws(" ", F.lit(chrom), F.concat_ws(":", F.lit(chrom), bp), bp, F.lit("A"), F.lit("T"), F.col("gt")).alias("value"))


def asmc_samples(samples: DataFrame) -> DataFrame:
    """ord, value: two header lines, then one per sample."""
    head = samples.sparkSession.createDataFrame([(-2, "ID_1 ID_2 missing"), (-1, "0 0 0")], "ord long, value string")
    return head.unionByName(samples.select(F.col("sample_no").cast("long").alias("ord"), F.concat_ws(" ", F.col("sample_id"), F.col("sample_id"), F.lit("0")).alias("value")))


def write_lines(lines: DataFrame, path: str, order: str, compression: str | None = None) -> None:
    """Text files whose names sort in the order of the lines."""
    writer = lines.orderBy(order).select("value").write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


def json_summary(df: DataFrame, *keys: str) -> DataFrame:
    """One JSON object per row beside its keys."""
    return df.select(*keys, F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("json"))


def load_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Benchmark results, one JSON document per file, by species and model."""
    return spark.read.schema(schema).option("multiLine", True).json(path).orderBy("species", "model_id")
