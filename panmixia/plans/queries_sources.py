"""Queries of sources and sinks: texts made from the tables and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from panmixia.operators import genes as g
from panmixia.plans import bindings as b
from panmixia.plans.registry import query
from panmixia.sources import tables, vcf
from panmixia.streaming import accumulators


def _scratch(spark) -> str:
    """A new folder next to the checkpoints that the cluster names, or a temporary one in a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp()
    return f"{base}/{uuid.uuid4().hex}"


@query(b.PANEL_SQL + " SELECT hap_id, 'chr1' AS chrom, pos::BIGINT AS pos, allele FROM panel")
def vcf_round_trip(spark, sf_dir):
    path = _scratch(spark)
    vcf.write_vcf(b.panel(spark, sf_dir), path)
    return vcf.read_haplotypes(vcf.read_lines(spark, path))


@query(b.PANEL_SQL + " SELECT hap_id, 'chr1' AS chrom, pos::BIGINT AS pos, allele FROM panel WHERE pos BETWEEN 5000 AND 12000")
def read_vcf_region(spark, sf_dir):
    return vcf.read_region(vcf.to_lines(b.panel(spark, sf_dir)).select("value"), 5000, 12000)


@query(b.PANEL_SQL + " SELECT hap_id, 'chr1' AS chrom, pos::BIGINT AS pos, allele FROM panel WHERE (hap_id // 2) % 7 = 3")
def read_vcf_haps(spark, sf_dir):
    """Haplotypes of chosen samples."""
    lines = vcf.to_lines(b.panel(spark, sf_dir)).select("value")
    samples = b.wide(spark, sf_dir).select(F.floor(F.col("hap_id") / 2).alias("sample_no")).distinct().where("sample_no % 7 = 3")
    return vcf.read_haplotypes(lines, samples)


def _orders_as_records(spark, sf_dir):
    """Orders as records of two samples, with every kind of fault among them."""
    k = F.col("o_orderkey")
    ref = F.when(k % 11 == 0, "AT").otherwise("A")
    alt = F.when(k % 13 == 0, "T,.").when(k % 17 == 0, "T,G").otherwise("T")
    one = F.when(k % 5 == 0, "0|0").when(k % 7 == 0, ".|1").when(k % 3 == 0, "2|0").otherwise("1|0:33")
    two = F.when(k % 4 == 0, "0/1").when(k % 19 == 0, ".").otherwise("0|0")
    return b.read(spark, sf_dir, "orders").select(F.concat_ws("\t", F.lit("chr1"), k.cast("string"), F.lit("."), ref, alt, F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), one, two).alias("value"))


_RECORDS = """WITH o AS (SELECT o_orderkey AS k FROM orders), r AS (SELECT k, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN 'non_snp' WHEN k % 5 <> 0 AND k % 7 = 0 THEN 'missing' WHEN k % 5 <> 0 AND k % 3 = 0 THEN 'non_binary'
  WHEN k % 4 <> 0 AND k % 19 = 0 THEN 'missing' WHEN k % 5 = 0 AND k % 4 <> 0 THEN 'nonseg' END AS reason FROM o)"""


@query(_RECORDS + " SELECT k AS pos, (k - 1)::DOUBLE AS pos0, reason FROM r")
def normalize_binary_snp_vcf(spark, sf_dir):
    return vcf.normalise(_orders_as_records(spark, sf_dir)).select("pos", "pos0", "reason")


@query(_RECORDS + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1")
def vcf_drop_counts(spark, sf_dir):
    return vcf.drop_counts(_orders_as_records(spark, sf_dir))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0),
  a AS (SELECT k, CASE WHEN k % 5 = 0 THEN [0, 0] WHEN k % 7 = 0 THEN [-1, 1] WHEN k % 3 = 0 THEN [-1, 0] ELSE [1, 0] END || CASE WHEN k % 4 = 0 THEN [0, 1] WHEN k % 19 = 0 THEN [-1, -1] ELSE [0, 0] END AS l FROM o)
  SELECT (i - 1)::BIGINT AS hap_id, 'chr1' AS chrom, k AS pos, l[i]::INT AS allele FROM a, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE NOT list_contains(l, -1)""")
def read_vcf_biallelic(spark, sf_dir):
    return vcf.read_biallelic(_orders_as_records(spark, sf_dir))


@query("SELECT 'S' || c_custkey AS sample_id, 'P' || c_nationkey AS pop, 'SP' || (c_nationkey // 5) AS superpop FROM customer")
def read_samples(spark, sf_dir):
    c = b.read(spark, sf_dir, "customer")
    lines = c.select(F.concat(F.lit("F1  S"), F.col("c_custkey").cast("string"), F.lit("\t0 0  1 P"), F.col("c_nationkey").cast("string"), F.lit(" SP"), F.floor(F.col("c_nationkey") / 5).cast("string")).alias("value"))
    other = spark.createDataFrame([("FamilyID SampleID FatherID MotherID Sex Population Superpopulation",), ("too short",)], "value string")
    return tables.parse_samples(lines.unionByName(other))


@query("SELECT 'G' || n_nationkey AS gene_id, n_name AS gene_name, (2500 * n_nationkey + 500)::BIGINT AS \"start\", (2500 * n_nationkey + 4500)::BIGINT AS \"end\" FROM nation")
def read_genes(spark, sf_dir):
    n = F.col("n_nationkey")
    lines = b.read(spark, sf_dir, "nation").select(F.concat_ws("\t", F.concat(F.lit("G"), n.cast("string")), F.col("n_name"), (2500 * n + 500).cast("string"), (2500 * n + 4500).cast("string")).alias("value"))
    return tables.parse_genes(lines.unionByName(spark.createDataFrame([("gene_id\tgene_name\tstart\tend",)], "value string")))


@query("SELECT (s_suppkey % 22 + 1)::INT AS chrom, s_suppkey * 10 AS \"start\", s_suppkey * 10 + 99 AS \"end\" FROM supplier WHERE s_suppkey % 9 <> 0")
def read_sd_intervals(spark, sf_dir):
    k = F.col("s_suppkey")
    chrom = F.when(k % 9 == 0, "chrX").otherwise(F.concat(F.lit("chr"), (k % 22 + 1).cast("string")))
    return tables.parse_mask(b.read(spark, sf_dir, "supplier").select(F.concat_ws("\t", F.lit("585"), chrom, (k * 10).cast("string"), (k * 10 + 99).cast("string")).alias("value")))


@query("SELECT '7' AS chrom, p_partkey * 3 AS pos, CASE WHEN p_partkey % 4 = 0 THEN '7_' || (p_partkey * 3) ELSE 'rs' || p_partkey END AS rsid, p_retailprice AS x, CASE WHEN p_partkey % 6 <> 0 THEN 0.5 END::DOUBLE AS s, 1.0::DOUBLE AS posterior FROM part WHERE p_partkey % 3 = 0")
def read_leads(spark, sf_dir):
    k = F.col("p_partkey")
    line = F.concat_ws("\t", F.when(k % 3 == 0, "7").otherwise("8"), (k * 3).cast("string"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("rs"), k.cast("string"))), F.col("p_retailprice").cast("string"), F.when(k % 6 == 0, "NA").otherwise("0.5"), F.lit("1.0"))
    lines = b.read(spark, sf_dir, "part").select(line.alias("value"))
    return tables.parse_leads(lines.unionByName(spark.createDataFrame([("CHROM\tPOS\tRSID\tX\tS\tPOSTERIOR",)], "value string")), "7")


@query("SELECT l_orderkey AS pos, l_discount AS freq, l_quantity - 25 AS stat, abs(l_quantity - 25) AS abs_stat, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4")
def read_selscan_table(spark, sf_dir):
    line = F.concat_ws("\t", F.lit("."), F.col("l_orderkey").cast("string"), F.col("l_discount").cast("string"), F.lit("9"), (F.col("l_quantity") - 25).cast("string"))
    lines = b.read(spark, sf_dir, "lineitem").select(line.alias("value")).unionByName(spark.createDataFrame([("id pos freq ihh norm",)], "value string"))
    return tables.parse_selscan(lines).groupBy("pos", "freq", "stat", "abs_stat").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + b.VALUES_SQL + " SELECT gene, pop, count(*)::INT AS n_pairs, min(value) AS min_tmrca, true AS geom_close, true AS arith_close FROM vals GROUP BY 1, 2")
def write_gene_csv(spark, sf_dir):
    """Written as CSV and read back; means must be those of the values to the two decimals that are written."""
    path = _scratch(spark)
    tables.gene_csv(g.accumulate(g.from_values(b.pair_values(spark, sf_dir)), "gene", "pop")).write.option("header", True).csv(path)
    schema = "gene long, pop long, geom_mean_tmrca double, arith_mean_tmrca double, min_tmrca double, n_pairs int"
    exact = b.pair_values(spark, sf_dir).groupBy("gene", "pop").agg(F.exp(F.avg(F.ln(F.greatest("value", F.lit(1.0))))).alias("geom"), F.avg("value").alias("arith"))
    back = spark.read.schema(schema).option("header", True).csv(path).join(exact, ["gene", "pop"])
    close = [(F.abs(F.col(f"{m}_mean_tmrca") - F.col(m)) < 0.00501).alias(f"{m}_close") for m in ("geom", "arith")]
    return back.select("gene", "pop", "n_pairs", "min_tmrca", *close)


@query("WITH " + b.VALUES_SQL + " SELECT gene, pop::INT AS pop, count(*) AS count, round(sum(value), 4) AS lin_sum FROM vals WHERE pop = 4 GROUP BY 1, 2")
def write_gene_accumulators(spark, sf_dir):
    """Partitioned by population; one population's files are read."""
    path = _scratch(spark)
    tables.write_accumulators(g.accumulate(g.from_values(b.pair_values(spark, sf_dir)), "gene", "pop"), path, "pop")
    return spark.read.parquet(path).where("pop = 4").select("gene", "pop", "count", F.round("lin_sum", 4).alias("lin_sum"))


@query(b.PANEL_SQL + " SELECT hap_id, string_agg(allele::VARCHAR, ' ' ORDER BY site_idx) AS value FROM panel GROUP BY 1")
def write_hap(spark, sf_dir):
    return tables.hap_lines(b.wide(spark, sf_dir))


@query(b.PANEL_SQL + " SELECT DISTINCT pos, '1 1:' || pos::BIGINT || ' ' || printf('%.8f', pos * 1e-6) || ' ' || pos::BIGINT AS value FROM panel")
def write_map(spark, sf_dir):
    return tables.map_lines(b.panel(spark, sf_dir).select("pos").distinct())


@query(b.PANEL_SQL + " SELECT pos, '1 1:' || pos::BIGINT || ' ' || pos::BIGINT || ' A T ' || string_agg(allele::VARCHAR, ' ' ORDER BY hap_id) AS value FROM panel GROUP BY pos")
def write_asmc_input(spark, sf_dir):
    return tables.asmc_lines(b.panel(spark, sf_dir))


@query(b.PANEL_SQL + " SELECT superpop, pop, '{\"superpop\":' || superpop || ',\"pop\":' || pop || ',\"n\":' || count(*) || ',\"derived\":' || sum(allele)::BIGINT || '}' AS json FROM panel GROUP BY 1, 2")
def write_json_summary(spark, sf_dir):
    r = b.panel(spark, sf_dir).groupBy("superpop", "pop").agg(F.count(F.lit(1)).alias("n"), F.sum("allele").alias("derived"))
    return tables.json_summary(r, "superpop", "pop")


@query(b.PANEL_SQL + " SELECT hap_id, site_idx, pos, allele FROM panel WHERE pop = 6 AND pos BETWEEN 7000 AND 9000")
def read_npz_chrom(spark, sf_dir):
    """A panel partitioned (here by population, as by chromosome), and a slice read back."""
    path = _scratch(spark)
    tables.write_chromosome(b.panel(spark, sf_dir).withColumnRenamed("pop", "chrom"), path)
    return tables.read_chromosome(spark, path, 6, 7000, 9000).select("hap_id", "site_idx", "pos", "allele")


@query(b.PANEL_SQL + " SELECT hap_id, string_agg(allele::VARCHAR, '' ORDER BY site_idx) AS haplotype FROM panel GROUP BY 1")
def read_matrix(spark, sf_dir):
    """Long panel to one row per haplotype."""
    from panmixia.operators import panel

    return panel.to_wide(b.panel(spark, sf_dir)).select("hap_id", F.array_join(F.transform("alleles", lambda a: a.cast("string")), "").alias("haplotype"))


@query("WITH " + b.VALUES_SQL + " SELECT gene, pop, count(*) AS count, round(sum(value), 4) AS lin_sum, min(value) AS min_lin FROM vals GROUP BY 1, 2")
def streaming_accumulators(spark, sf_dir):
    """The accumulators by Structured Streaming over everything that has arrived, then read."""
    source = b.read(spark, sf_dir, "lineitem")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/lineitem.parquet*")
    rows = stream.select((F.col("l_partkey") % 200).alias("gene"), (F.col("l_suppkey") % 10).alias("pop"), F.col("l_extendedprice").alias("value"))
    path = _scratch(spark)
    accumulators.run_available(rows, f"{path}/out", f"{path}/checkpoint", "gene", "pop").awaitTermination()
    return accumulators.latest(spark, f"{path}/out").select("gene", "pop", "count", F.round("lin_sum", 4).alias("lin_sum"), "min_lin")


@query("SELECT r::INT AS r, c::INT AS c, (r - 25) * 0.125::DOUBLE AS u, (c * r - 7) * 0.0625::DOUBLE AS v FROM (SELECT unnest(range(51)) AS r), (SELECT unnest(range(50)) AS c)")
def flow_field_text(spark, sf_dir):
    """A field of the published grid written as text and read back."""
    import numpy as np

    from panmixia.operators.flow import C_N, M_N, FlowField
    from panmixia.sources import flow_text

    row, column = np.indices((M_N, C_N))
    path = _scratch(spark)
    flow_text.write_flow_field(spark, path, FlowField((row - 25) * 0.125, (column * row - 7) * 0.0625))
    f = flow_text.read_flow_field(spark, path)
    return spark.createDataFrame([(r, c, float(f.u[r, c]), float(f.v[r, c])) for r in range(M_N) for c in range(C_N)], "r int, c int, u double, v double")


@query("SELECT 'species' || (r_regionkey % 2) AS species, r_name AS model_id, r_regionkey * 0.25::DOUBLE AS r FROM region")
def load_results(spark, sf_dir):
    """Benchmark results, a JSON document per file, written and loaded."""
    path = _scratch(spark)
    r = F.col("r_regionkey")
    rows = b.read(spark, sf_dir, "region").select(F.concat(F.lit("species"), r % 2).alias("species"), F.col("r_name").alias("model_id"), (r * 0.25).alias("r"))
    rows.repartitionByRange(8, "model_id").write.mode("overwrite").json(path)
    return tables.load_results(spark, path, "species string, model_id string, r double")
