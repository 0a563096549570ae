"""Phased VCF text, read and written as lines through Spark, so that files split and any file system will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIXED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


def _records(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t", -1)
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(f.alias("f"))
    return rows.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).cast("long").alias("pos"), F.get("f", F.lit(2)).alias("id"), F.get("f", F.lit(3)).alias("ref"), F.get("f", F.lit(4)).alias("alt"), F.slice("f", F.lit(10), F.greatest(F.size("f") - 9, F.lit(0))).alias("gt"))


def _alleles(gt: Column) -> Column:
    """Two alleles per sample; "|" or "/" between them, "." or anything else is -1."""
    both = F.transform(gt, lambda g: F.split(F.split(g, ":").getItem(0), r"[|/]"))
    return F.flatten(F.transform(both, lambda p: F.transform(F.array(F.get(p, F.lit(0)), F.get(p, F.lit(1))), lambda a: F.when(a.isin("0", "1"), a.cast("int")).otherwise(-1))))


def sample_names(lines: DataFrame) -> DataFrame:
    """sample_no, sample_id, in the order of the columns."""
    header = lines.where(F.col("value").startswith("#CHROM")).limit(1)
    return header.select(F.posexplode(F.slice(F.split("value", "\t"), F.lit(10), F.lit(1 << 30))).alias("sample_no", "sample_id"))


def read_haplotypes(lines: DataFrame, samples: DataFrame | None = None, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """hap_id, chrom, pos, allele (-1 where missing), in a region and of some samples (sample_no) if given.

    Haplotypes 2i and 2i + 1 are sample i's. Positions are filtered before genotypes are split.
    """
    rows = _records(lines)
    if lo is not None:
        rows = rows.where(F.col("pos") >= lo)
    if hi is not None:
        rows = rows.where(F.col("pos") <= hi)
    long = rows.select("chrom", "pos", F.posexplode(_alleles(F.col("gt"))).alias("hap_id", "allele")).withColumn("hap_id", F.col("hap_id").cast("long"))
    if samples is not None:
        long = long.join(F.broadcast(samples.select(F.col("sample_no").alias("__s"))), F.floor(F.col("hap_id") / 2) == F.col("__s"), "left_semi")
    return long.select("hap_id", "chrom", "pos", "allele")


def read_region(lines: DataFrame, lo: int, hi: int) -> DataFrame:
    return read_haplotypes(lines, None, lo, hi)


def read_biallelic(lines: DataFrame) -> DataFrame:
    """Haplotypes of single-base records with one alternative and no missing allele."""
    ok = normalise(lines).where((F.length("ref") == 1) & (F.length("alt") == 1) & ~F.col("missing"))
    return ok.select("chrom", "pos", F.posexplode("alleles").alias("hap_id", "allele")).select(F.col("hap_id").cast("long").alias("hap_id"), "chrom", "pos", "allele")


def normalise(lines: DataFrame) -> DataFrame:
    """Each record with its alleles and the first reason to drop it, or none: non_snp, missing, non_binary, nonseg.

    pos0 is the position less one. A sample's first missing or non-binary field decides, in their order.
    """
    r = _records(lines)
    alts = F.split("alt", ",")
    snp = (F.length("ref") == 1) & F.forall(alts, lambda a: (F.length(a) == 1) & (a != "."))
    fields = F.transform("gt", lambda g: F.split(g, ":").getItem(0))
    gone = lambda g: ~g.rlike(r"^[0-9]+[|/][0-9]+$")
    odd = lambda g: ~g.rlike(r"^[01][|/][01]$")
    first = F.get(F.filter(fields, lambda g: gone(g) | odd(g)), F.lit(0))
    has_alt = F.exists(fields, lambda g: g.contains("1"))
    reason = F.when(~snp, "non_snp").when(first.isNotNull() & gone(first), "missing").when(first.isNotNull(), "non_binary").when(~has_alt, "nonseg")
    alleles = _alleles(F.col("gt"))
    return r.select("chrom", "pos", (F.col("pos") - 1).cast("double").alias("pos0"), "id", "ref", "alt", alleles.alias("alleles"), F.exists(alleles, lambda a: a < 0).alias("missing"), reason.alias("reason"))


def drop_counts(lines: DataFrame) -> DataFrame:
    """How many records are kept, and how many go for each reason."""
    return normalise(lines).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def to_lines(panel: DataFrame, chrom: str = "chr1") -> DataFrame:
    """Record lines (pos, value) of a long panel, haplotypes 2i and 2i + 1 as one sample."""
    cells = F.sort_array(F.collect_list(F.struct("hap_id", "allele")))
    g = panel.groupBy("pos").agg(cells.alias("c"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int") - 1), lambda k: F.concat_ws("|", F.get("c", 2 * k)["allele"].cast("string"), F.get("c", 2 * k + 1)["allele"].cast("string")))
    fixed = [F.lit(chrom), F.col("pos").cast("long").cast("string"), F.lit("."), F.lit("A"), F.lit("T"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT")]
    return g.select(F.col("pos"), F.concat_ws("\t", *fixed, F.array_join(pairs, "\t")).alias("value"))


def write_vcf(panel: DataFrame, path: str, chrom: str = "chr1") -> None:
    """Header and records in the order of positions, as text files whose names sort in that order."""
    n = panel.agg(F.countDistinct("hap_id")).first()[0] // 2
    header = ["##fileformat=VCFv4.2", f"##contig=<ID={chrom}>", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "#" + "\t".join([*FIXED, *(f"S{i}" for i in range(n))])]
    spark = panel.sparkSession
    head = spark.createDataFrame([(float(i - len(header)), line) for i, line in enumerate(header)], "pos double, value string")
    head.unionByName(to_lines(panel, chrom)).orderBy("pos").select("value").write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain or gzipped text."""
    return spark.read.text(path)
