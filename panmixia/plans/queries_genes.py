"""Queries of interval joins, gene accumulators, ranks and tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panmixia.functions.columns import binomial_tail, rank_pct
from panmixia.operators import genes as g
from panmixia.operators import intervals, testing
from panmixia.plans import bindings as b
from panmixia.plans.registry import query

POPS = list(range(10))
_ACC = "WITH " + b.VALUES_SQL + """, v AS (SELECT gene, pop, value AS lin, ln(greatest(value, 1.0)) AS log FROM vals),
acc AS (SELECT gene, pop, count(*) AS n, sum(lin) AS lin_sum, sum(log) AS log_sum, sum(log * log) AS log_sq_sum, min(lin) AS min_lin, min(log) AS min_log FROM v GROUP BY 1, 2),
hist AS (SELECT gene, pop, least(greatest(floor((log - ln(10.0)) / ((ln(1e6) - ln(10.0)) / 50)), 0), 49)::INT AS bin, count(*) AS n FROM v GROUP BY 1, 2, 3)"""
_RANKS = _ACC + """, stat AS (SELECT gene, pop, round(exp(log_sum / n), 6) AS stat FROM acc),
ranks AS (SELECT gene, pop, stat, (rank() OVER (PARTITION BY pop ORDER BY stat) + (count(*) OVER (PARTITION BY pop, stat) - 1) / 2.0) / count(*) OVER (PARTITION BY pop) AS rank FROM stat)"""


def accumulators(spark, sf_dir):
    return g.accumulate(g.from_values(b.pair_values(spark, sf_dir)), "gene", "pop")


def ranks(spark, sf_dir):
    rows = accumulators(spark, sf_dir).select("gene", "pop", F.round(g.statistic("geom_mean"), 6).alias("stat"))
    return rows.withColumn("rank", rank_pct("stat", "pop"))


@query(_ACC + " SELECT gene, pop, n AS count, round(lin_sum, 4) AS lin_sum, round(log_sum, 6) AS log_sum, round(log_sq_sum, 5) AS log_sq_sum, min_lin, round(min_log, 9) AS min_log FROM acc")
def gene_accumulate(spark, sf_dir):
    r = accumulators(spark, sf_dir)
    return r.select("gene", "pop", "count", F.round("lin_sum", 4).alias("lin_sum"), F.round("log_sum", 6).alias("log_sum"), F.round("log_sq_sum", 5).alias("log_sq_sum"), "min_lin", F.round("min_log", 9).alias("min_log"))


@query(_ACC + " SELECT gene, pop, bin, n AS n_pairs FROM hist")
def histogram_digitize(spark, sf_dir):
    rows = accumulators(spark, sf_dir).select("gene", "pop", F.posexplode("hist").alias("bin", "n_pairs"))
    return rows.where("n_pairs > 0")


@query(_ACC + " SELECT gene, pop, n AS count, round(lin_sum, 4) AS lin_sum, min_lin FROM acc")
def merge_accumulators(spark, sf_dir):
    """Chunks of pairs, here by the value's parity, accumulated apart and merged."""
    rows = g.from_values(b.pair_values(spark, sf_dir)).withColumn("chunk", F.floor("value") % 2)
    return g.merge(g.accumulate(rows, "gene", "pop", "chunk"), "gene", "pop").select("gene", "pop", "count", F.round("lin_sum", 4).alias("lin_sum"), "min_lin")


@query(_ACC + " SELECT gene, pop, round(exp(log_sum / n), 4) AS geom_mean, round(lin_sum / n, 7) AS arith_mean, round(log_sq_sum / n - (log_sum / n) * (log_sum / n), 7) AS log_variance, min_lin, round(exp(min_log), 4) AS min_log FROM acc")
def gene_statistics(spark, sf_dir):
    r = accumulators(spark, sf_dir)
    return r.select("gene", "pop", F.round(g.statistic("geom_mean"), 4).alias("geom_mean"), F.round(g.statistic("arith_mean"), 7).alias("arith_mean"), F.round(g.statistic("log_variance"), 7).alias("log_variance"), "min_lin", F.round(g.statistic("min_log"), 4).alias("min_log"))


@query(_ACC + """, q AS (SELECT unnest([1, 5, 25, 50, 75, 95, 99]) AS p), cum AS (SELECT gene, pop, bin, sum(n) OVER (PARTITION BY gene, pop ORDER BY bin) AS c, sum(n) OVER (PARTITION BY gene, pop) AS t FROM hist)
  SELECT gene, pop, p::INT AS percent, round(exp(ln(10.0) + (min(bin) + 0.5) * ((ln(1e6) - ln(10.0)) / 50)), 4) AS value FROM cum, q WHERE c >= p / 100.0::DOUBLE * t GROUP BY 1, 2, 3""")
def percentile_from_histogram(spark, sf_dir):
    ps = [1, 5, 25, 50, 75, 95, 99]
    r = accumulators(spark, sf_dir).select("gene", "pop", F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.round(g.percentile(p / 100), 4).alias("value")) for p in ps])).alias("s"))
    return r.select("gene", "pop", "s.*")


@query(_ACC + """, e AS (SELECT (ln(t) - ln(10.0)) / ((ln(1e6) - ln(10.0)) / 50) AS cutbin, t FROM (SELECT unnest([20000.0, 50000.0])::DOUBLE AS t))
  SELECT gene, pop, t::INT AS threshold, round(sum(CASE WHEN bin < floor(cutbin) THEN n WHEN bin = floor(cutbin) THEN n * (cutbin - floor(cutbin)) ELSE 0 END) / sum(n), 8) AS frac FROM hist, e GROUP BY 1, 2, 3""")
def frac_below(spark, sf_dir):
    r = accumulators(spark, sf_dir).select("gene", "pop", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.round(g.statistic(f"frac_below_{t}"), 8).alias("frac")) for t in (20000, 50000)])).alias("s"))
    return r.select("gene", "pop", "s.*")


@query(_RANKS + " SELECT gene, pop, stat, round(rank, 9) AS rank FROM ranks")
def rank_pct_within_population(spark, sf_dir):
    return ranks(spark, sf_dir).withColumn("rank", F.round("rank", 9))


@query(_RANKS + " SELECT gene, round(min(rank), 9) AS min_rank, arg_min(pop, rank * 1000 + pop / 1e6) AS min_pop, round(max(rank), 9) AS max_rank, round(max(rank) - min(rank), 9) AS rank_range FROM ranks GROUP BY 1")
def rank_summary(spark, sf_dir):
    r = g.rank_summary(ranks(spark, sf_dir))
    return r.select("gene", F.round("min_rank", 9).alias("min_rank"), "min_pop", F.round("max_rank", 9).alias("max_rank"), F.round("rank_range", 9).alias("rank_range"))


@query(_RANKS + " SELECT gene, " + ", ".join(f"max(CASE WHEN pop = {p} THEN stat END) AS \"{p}\"" for p in POPS) + " FROM ranks GROUP BY 1")
def gene_pop_pivot(spark, sf_dir):
    return g.pivot(ranks(spark, sf_dir), "stat", POPS)


@query(_RANKS + " SELECT gene, round(min(rank), 9) AS min_rank FROM ranks GROUP BY 1 ORDER BY min_rank, gene LIMIT 50")
def top_by_min_rank(spark, sf_dir):
    """The 50 genes of the smallest ranks."""
    r = g.rank_summary(ranks(spark, sf_dir)).select("gene", F.round("min_rank", 9).alias("min_rank"))
    return g.top_k(r, 50, F.col("min_rank"), F.col("gene"))


@query(_RANKS + " SELECT gene, pop // 2 AS superpop, round(avg(rank), 9) AS mean_rank FROM ranks GROUP BY 1, 2")
def superpop_mean_rank(spark, sf_dir):
    return ranks(spark, sf_dir).groupBy("gene", F.floor(F.col("pop") / 2).alias("superpop")).agg(F.round(F.avg("rank"), 9).alias("mean_rank"))


@query(_RANKS + ", m AS (SELECT gene, pop // 2 AS superpop, round(avg(rank), 9) AS r FROM ranks GROUP BY 1, 2) SELECT gene, arg_min(superpop, r + superpop / 1e12) AS focal FROM m GROUP BY 1")
def focal_superpop_per_row(spark, sf_dir):
    m = superpop_mean_rank(spark, sf_dir)
    return m.groupBy("gene").agg(F.min_by("superpop", F.struct("mean_rank", "superpop")).alias("focal"))


@query(_RANKS + " SELECT gene, pop // 2 AS superpop, arg_min(pop, rank * 1000 + pop / 1e6) AS best_pop, round(min(rank), 9) AS best_rank FROM ranks GROUP BY 1, 2")
def best_pop_per_superpop(spark, sf_dir):
    return ranks(spark, sf_dir).groupBy("gene", F.floor(F.col("pop") / 2).alias("superpop")).agg(F.min_by("pop", F.struct("rank", "pop")).alias("best_pop"), F.round(F.min("rank"), 9).alias("best_rank"))


@query(_RANKS + " SELECT gene, pop, round(rank, 9) AS rank, rank < 0.05 AS low FROM ranks QUALIFY row_number() OVER (PARTITION BY gene ORDER BY rank, pop) <= 3")
def top3_pops_per_gene(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("gene").orderBy("rank", "pop"))
    return ranks(spark, sf_dir).withColumn("n", n).where("n <= 3").select("gene", "pop", F.round("rank", 9).alias("rank"), (F.col("rank") < 0.05).alias("low"))


@query("WITH " + b.GENES_SQL + ", " + b.MASKS_SQL + """, o AS (SELECT g.gene_id, sum(least(g."end", m."end") - greatest(g."start", m."start")) / 4000 AS f FROM genes g JOIN masks m ON g."start" <= m."end" AND m."start" <= g."end" GROUP BY 1)
  SELECT g.gene_id, g.gene_name, round(coalesce(f, 0.0), 9) AS fraction, coalesce(f, 0.0) >= 0.5 AS masked FROM genes g LEFT JOIN o ON o.gene_id = g.gene_id""")
def sd_mask(spark, sf_dir):
    masks = b.masks(spark, sf_dir).select(F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    return intervals.mask_flags(b.genes(spark, sf_dir), masks).select("gene_id", "gene_name", F.round("fraction", 9).alias("fraction"), "masked")


_MASKED = ", " + b.GENES_SQL + ", " + b.MASKS_SQL + """, bad AS (SELECT g.gene_id FROM genes g JOIN masks m ON g."start" <= m."end" AND m."start" <= g."end" GROUP BY 1 HAVING sum(least(g."end", m."end") - greatest(g."start", m."start")) / 4000 >= 0.5)"""


_FIVE = _ACC + """, cum AS (SELECT gene, pop, bin, sum(n) OVER (PARTITION BY gene, pop ORDER BY bin) AS c, sum(n) OVER (PARTITION BY gene, pop) AS t FROM hist),
  cutoff AS (SELECT (ln(20000.0::DOUBLE) - ln(10.0)) / ((ln(1e6) - ln(10.0)) / 50) AS x),
  s AS (SELECT gene, pop, 'geom_mean' AS stat, round(exp(log_sum / n), 6) AS v FROM acc UNION ALL SELECT gene, pop, 'min', min_lin FROM acc
  UNION ALL SELECT gene, pop, 'p' || p, round(exp(ln(10.0) + (min(bin) + 0.5) * ((ln(1e6) - ln(10.0)) / 50)), 6) FROM cum, (SELECT unnest([5, 10]) AS p) WHERE c >= p / 100.0::DOUBLE * t GROUP BY gene, pop, p
  UNION ALL SELECT gene, pop, 'frac_below_20000', round(-sum(CASE WHEN bin < floor(x) THEN n WHEN bin = floor(x) THEN n * (x - floor(x)) ELSE 0 END) / sum(n), 6) FROM hist, cutoff GROUP BY gene, pop),
  r AS (SELECT gene, stat, (rank() OVER (PARTITION BY stat, pop ORDER BY v) + (count(*) OVER (PARTITION BY stat, pop, v) - 1) / 2.0) / count(*) OVER (PARTITION BY stat, pop) AS rank FROM s),
  m AS (SELECT gene, stat, min(rank) AS m FROM r GROUP BY 1, 2)"""


def five_lows(spark, sf_dir):
    """gene, stat, min_rank of the five statistics that are compared; many young pairs rank as a small time does."""
    acc = accumulators(spark, sf_dir)
    values = {"geom_mean": g.statistic("geom_mean"), "p5": g.statistic("p5"), "p10": g.statistic("p10"), "min": g.statistic("min"), "frac_below_20000": -g.statistic("frac_below_20000")}
    each = F.array(*[F.struct(F.lit(n).alias("stat"), F.round(v, 6).alias("v")) for n, v in values.items()])
    rows = acc.select("gene", "pop", F.inline(each)).withColumn("rank", rank_pct("v", "stat", "pop"))
    return rows.groupBy("gene", "stat").agg(F.min("rank").alias("min_rank"))


@query(_FIVE + _MASKED + " SELECT stat, gene, round(m, 9) AS min_rank FROM m WHERE gene % 25 NOT IN (SELECT gene_id FROM bad) QUALIFY row_number() OVER (PARTITION BY stat ORDER BY round(m, 9), gene) <= 50")
def sd_filtered_top50(spark, sf_dir):
    """For each statistic the 50 smallest ranks without genes that the mask covers (genes are laid over the intervals in turn)."""
    masks = b.masks(spark, sf_dir).select(F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    bad = intervals.mask_flags(b.genes(spark, sf_dir), masks).where("masked").select(F.col("gene_id").alias("bad"))
    rows = five_lows(spark, sf_dir).withColumn("min_rank", F.round("min_rank", 9)).join(bad, F.col("gene") % 25 == F.col("bad"), "left_anti")
    place = F.row_number().over(Window.partitionBy("stat").orderBy("min_rank", "gene"))
    return rows.withColumn("place", place).where("place <= 50").select("stat", "gene", "min_rank")


@query(_FIVE + " SELECT stat, count(*) FILTER (m < 0.10) AS below_10, count(*) FILTER (m < 0.05) AS below_5, count(*) FILTER (m < 0.01) AS below_1 FROM m WHERE gene IN (SELECT n_nationkey FROM nation) GROUP BY 1")
def stat_comparison(spark, sf_dir):
    return g.control_counts(five_lows(spark, sf_dir), b.genes(spark, sf_dir).select(F.col("gene_id").alias("gene")))


@query(_ACC + ", y AS (SELECT gene, pop, sum(CASE WHEN bin < 5 THEN n ELSE 0 END) AS young FROM hist GROUP BY 1, 2) SELECT a.gene, a.pop, round(young / n, 9) AS young_share, round(lin_sum / n, 7) AS arith, min_lin AS least FROM acc a JOIN y ON a.gene = y.gene AND a.pop = y.pop")
def missed_sweep_summary(spark, sf_dir):
    return g.missed_sweeps(accumulators(spark, sf_dir)).select("gene", "pop", F.round("young_share", 9).alias("young_share"), F.round("arith", 7).alias("arith"), "least")


@query(_RANKS + ", " + b.GENES_SQL + """, chroms AS (SELECT r_regionkey::BIGINT AS chrom, 100000.0::DOUBLE * (r_regionkey + 1) AS length FROM region), o AS (SELECT chrom, coalesce(sum(length) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM chroms),
  m AS (SELECT gene, min(rank) AS m FROM ranks GROUP BY 1) SELECT gene_id, off + ("start" + "end") / 2 AS x, round(-log10(greatest(least(m, 1.0), 1e-6)), 8) AS y FROM genes JOIN m ON gene = gene_id JOIN o ON chrom = gene_id % 5""")
def manhattan_coords(spark, sf_dir):
    chroms = b.read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("chrom"), (100000.0 * (F.col("r_regionkey") + 1)).alias("length"))
    rows = b.genes(spark, sf_dir).join(g.rank_summary(ranks(spark, sf_dir)).select("gene", "min_rank"), F.col("gene") == F.col("gene_id")).withColumn("chrom", F.col("gene_id") % 5)
    return g.manhattan(rows, chroms).select("gene_id", "x", F.round("y", 8).alias("y"))


@query(_ACC + """, c AS (SELECT gene, pop, CASE WHEN n >= 20 THEN lin_sum / n * 29.0 / 1000 END AS kya FROM acc), w AS (SELECT *, min(kya) OVER (PARTITION BY gene) AS row_min, count(kya) OVER (PARTITION BY gene) AS valid FROM c)
  SELECT gene, pop, round(kya, 9) AS kya, round(log10(greatest(kya, 0.1)), 8) AS colour, round(row_min, 9) AS row_min FROM w WHERE valid * 2 >= 10""")
def heatmap_matrix(spark, sf_dir):
    rows = accumulators(spark, sf_dir).select("gene", "pop", F.col("count").alias("n_sites"), g.statistic("arith_mean").alias("value"))
    h = g.heatmap(rows, len(POPS))
    return h.select("gene", "pop", F.round("kya", 9).alias("kya"), F.round("colour", 8).alias("colour"), F.round("row_min", 9).alias("row_min"))


@query(b.PANEL_SQL + ", " + b.GENES_SQL + ' SELECT gene_id, pop, count(*) AS n_cells, sum(allele)::BIGINT AS derived FROM panel JOIN genes ON pos BETWEEN "start" AND "end" GROUP BY 1, 2')
def site_gene_join(spark, sf_dir):
    sites = b.panel(spark, sf_dir).groupBy("pop", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("allele").alias("a"))
    rows = intervals.point_join(sites, b.genes(spark, sf_dir))
    return rows.groupBy("gene_id", "pop").agg(F.sum("n").alias("n_cells"), F.sum("a").alias("derived"))


@query("WITH " + b.GENES_SQL + """, pts AS (SELECT c_custkey AS point_id, (c_custkey * 37 % 90000)::DOUBLE AS pos FROM customer), m AS (SELECT point_id, gene_name, NOT (pos BETWEEN "start" AND "end") AS off, CASE WHEN pos BETWEEN "start" AND "end" THEN 0 ELSE abs(pos - ("start" + "end") / 2) END AS d, gene_id
  FROM pts JOIN genes ON pos BETWEEN "start" AND "end" OR abs(pos - ("start" + "end") / 2) <= 10000)
  SELECT p.point_id, p.pos, coalesce(m.gene_name, '') AS gene_name FROM pts p LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY off, d, gene_id) = 1) m ON m.point_id = p.point_id""")
def nearest_gene(spark, sf_dir):
    points = b.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") * 37 % 90000).cast("double").alias("pos"))
    return intervals.nearest_gene(points, b.genes(spark, sf_dir), within=10_000.0)


@query("WITH " + b.MASKS_SQL + """, pts AS (SELECT c_custkey AS point_id, (c_custkey * 37 % 90000)::DOUBLE AS pos FROM customer)
  SELECT p.point_id, p.pos, (SELECT arg_min(mask_name, "start") FROM masks WHERE p.pos BETWEEN "start" AND "end") AS label FROM pts p""")
def known_sweep_label(spark, sf_dir):
    points = b.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") * 37 % 90000).cast("double").alias("pos"))
    return intervals.first_label(points, b.masks(spark, sf_dir).withColumnsRenamed({"mask_name": "name"}).withColumn("ord", F.col("start"))).select("point_id", "pos", "label")


_LEADS = """leads AS (SELECT p_partkey AS rsid, (p_partkey * 101 % 64000)::DOUBLE AS centre FROM part)"""


@query(b.PANEL_SQL + ", " + _LEADS + """, s AS (SELECT site_idx, pos, 2 * avg(allele) * (1 - avg(allele)) AS h FROM panel GROUP BY 1, 2)
  SELECT rsid, centre, count(*) AS n_sites, round(avg(h), 9) AS arith, round(exp(avg(ln(greatest(h, 1e-9)))), 9) AS geom, round(min(h), 9) AS least FROM leads JOIN s ON pos BETWEEN centre - 2500 AND centre + 2500 GROUP BY 1, 2 HAVING count(*) >= 2""")
def lead_window_accumulate(spark, sf_dir):
    """Accumulators over the sites around every lead position, both ends included, of 2 sites at least."""
    leads = b.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("rsid"), (F.col("p_partkey") * 101 % 64000).cast("double").alias("centre"))
    sites = b.panel(spark, sf_dir).groupBy("site_idx", "pos").agg(F.avg("allele").alias("f")).select("pos", (2 * F.col("f") * (1 - F.col("f"))).alias("h"))
    rows = intervals.band_join(sites, leads, 2500)
    out = rows.groupBy("rsid", "centre").agg(F.count(F.lit(1)).alias("n_sites"), F.round(F.avg("h"), 9).alias("arith"), F.round(F.exp(F.avg(F.ln(F.greatest("h", F.lit(1e-9))))), 9).alias("geom"), F.round(F.min("h"), 9).alias("least"))
    return out.where("n_sites >= 2")


@query(b.PANEL_SQL + """, src AS (SELECT pos, avg(allele) AS value FROM panel WHERE site_idx % 3 = 0 GROUP BY 1), grid AS (SELECT DISTINCT pos + 250 AS pos FROM panel),
  n AS (SELECT g.pos, (SELECT max(pos) FROM src s WHERE s.pos <= g.pos) AS lp, (SELECT min(pos) FROM src s WHERE s.pos >= g.pos) AS rp FROM grid g)
  SELECT n.pos, round(CASE WHEN l.pos IS NULL THEN r.value WHEN r.pos IS NULL OR l.pos = n.pos THEN l.value ELSE l.value + (n.pos - l.pos) / (r.pos - l.pos) * (r.value - l.value) END, 9) AS value
  FROM n LEFT JOIN src l ON l.pos = n.lp LEFT JOIN src r ON r.pos = n.rp""")
def interpolate_onto_grid(spark, sf_dir):
    sites = b.panel(spark, sf_dir)
    source = sites.where("site_idx % 3 = 0").groupBy("pos").agg(F.avg("allele").alias("value"))
    grid = sites.select((F.col("pos") + 250).alias("pos")).distinct()
    return intervals.interpolate(grid, source, chunk=10_000.0).withColumn("value", F.round("value", 9))


@query(b.PANEL_SQL + """, iv AS (SELECT r_regionkey AS tree, r_regionkey * 13000.0::DOUBLE AS l, (r_regionkey + 1) * 13000.0::DOUBLE AS r FROM region) SELECT DISTINCT site_idx, tree FROM panel JOIN iv ON pos >= l AND pos < r""")
def truth_per_site(spark, sf_dir):
    """Each site's genealogy, from half-open intervals."""
    trees = b.read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("tree"), (F.col("r_regionkey") * 13000.0).alias("start"), ((F.col("r_regionkey") + 1) * 13000.0).alias("end"))
    return intervals.point_join(b.panel(spark, sf_dir).select("site_idx", "pos").distinct(), trees, half_open=True).select("site_idx", "tree")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 1000 < 500 OR p_partkey % 2 = 1) GROUP BY 1, 2")
def positions_intersection(spark, sf_dir):
    window = b.read(spark, sf_dir, "part").where("p_partkey % 1000 < 500 or p_partkey % 2 = 1").select(F.col("p_partkey").alias("l_partkey"))
    return b.read(spark, sf_dir, "lineitem").join(window, "l_partkey", "left_semi").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH chain AS (SELECT r_regionkey * 20000.0::DOUBLE AS s, r_regionkey * 20000.0 + 15000 AS e, CASE WHEN r_regionkey = 3 THEN 'chr2' ELSE 'chr1' END AS tc, (r_regionkey * 111 - 200)::DOUBLE AS off FROM region), p AS (SELECT c_custkey AS id, 'chr1' AS chrom, (c_custkey * 37 % 90000)::DOUBLE AS old_pos FROM customer)
  SELECT id, chrom, old_pos, old_pos + off AS pos FROM p JOIN chain ON old_pos >= s AND old_pos < e WHERE chrom = tc""")
def liftover(spark, sf_dir):
    r = F.col("r_regionkey")
    chain = b.read(spark, sf_dir, "region").select((r * 20000.0).alias("start"), (r * 20000.0 + 15000).alias("end"), F.when(r == 3, "chr2").otherwise("chr1").alias("to_chrom"), (r * 111 - 200).cast("double").alias("offset"))
    points = b.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("chr1").alias("chrom"), (F.col("c_custkey") * 37 % 90000).cast("double").alias("pos"))
    return intervals.liftover(points, chain)


_LOWS = _RANKS + ", low AS (SELECT gene, min(rank) AS low FROM ranks GROUP BY 1)"
_BH = """(SELECT *, least(1.0, min(p * n / r) OVER (PARTITION BY grp ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM
  (SELECT *, count(p) OVER (PARTITION BY grp) AS n, rank() OVER (PARTITION BY grp ORDER BY p) + count(*) OVER (PARTITION BY grp, p) - 1 AS r FROM {})) """


@query(_RANKS + ", t AS (SELECT gene, pop // 2 AS grp, min(rank) AS p FROM ranks GROUP BY 1, 2) SELECT gene, grp AS superpop, round(p, 9) AS p, round(q, 9) AS q FROM " + _BH.format("t"))
def bh_fdr(spark, sf_dir):
    rows = ranks(spark, sf_dir).groupBy("gene", F.floor(F.col("pop") / 2).alias("superpop")).agg(F.min("rank").alias("p"))
    return testing.bh_fdr(rows, "p", "superpop").select("gene", "superpop", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


_BINOM = "(SELECT sum(exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) + k * ln({p}) + (n - k) * ln(1 - {p}))) FROM (SELECT unnest(generate_series({b}, {n})) AS k, {n} AS n))"


@query(_LOWS + """, members AS (SELECT DISTINCT l_suppkey % 40 AS pathway, l_partkey % 200 AS gene FROM lineitem), gw AS (SELECT avg(CASE WHEN low < 0.05 THEN 1.0 ELSE 0 END) AS f FROM low),
  s AS (SELECT pathway, count(*) AS n_genes, count(*) FILTER (low < 0.05) AS n_below FROM members JOIN low USING (gene) GROUP BY 1 HAVING count(*) BETWEEN 5 AND 500)
  SELECT pathway, n_genes, n_below, round(n_genes * f, 8) AS expected, round(n_below / greatest(n_genes * f, 0.01), 8) AS fold FROM s, gw""")
def pathway_enrichment(spark, sf_dir):
    members = b.read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("pathway"), (F.col("l_partkey") % 200).alias("gene")).distinct()
    lows = ranks(spark, sf_dir).groupBy("gene").agg(F.min("rank").alias("min_rank"))
    r = testing.pathway_enrichment(members, lows, cut=0.05)
    return r.select("pathway", "n_genes", "n_below", F.round("expected", 8).alias("expected"), F.round("fold", 8).alias("fold"))


@query("SELECT k::INT AS k, round((SELECT sum(exp(lgamma(21.0) - lgamma(j + 1.0) - lgamma(21.0 - j) + j * ln(0.05) + (20 - j) * ln(0.95))) FROM (SELECT unnest(generate_series(k, 20))::DOUBLE AS j)), 10) AS p FROM (SELECT n_nationkey % 21 AS k FROM nation)")
def binom_tail(spark, sf_dir):
    k = (F.col("n_nationkey") % 21).cast("int")
    return b.read(spark, sf_dir, "nation").select(k.alias("k"), F.round(binomial_tail(k, F.lit(20), 0.05), 10).alias("p"))


@query(_LOWS + " SELECT gene, round(pow(low, 4.5), 10) AS p FROM low")
def beta_pvalue(spark, sf_dir):
    rows = ranks(spark, sf_dir).groupBy("gene").agg(F.min("rank").alias("low"))
    return rows.select("gene", F.round(testing.beta_pvalue(F.col("low"), F.lit(4.5)), 10).alias("p"))


@query("SELECT p_partkey, p_name ILIKE '%a1%' OR p_name ILIKE '%NAVY%' OR p_name ILIKE '%+%' AS flag FROM part")
def pathway_keyword_flag(spark, sf_dir):
    return b.read(spark, sf_dir, "part").select("p_partkey", testing.keyword_flag(F.col("p_name"), ["A1", "navy", "+"]).alias("flag"))


@query(_LOWS + ", c AS (SELECT unnest([0.01, 0.05, 0.1])::DOUBLE AS cut) SELECT cut, count(*) FILTER (low < cut) AS observed, round(count(*) * (1 - pow(1 - cut, 10.0)), 8) AS expected FROM low, c GROUP BY 1")
def threshold_counts(spark, sf_dir):
    return testing.threshold_counts(ranks(spark, sf_dir), [0.01, 0.05, 0.1], 10).withColumn("expected", F.round("expected", 8))


_SPEAR = _RANKS + """, whole AS (SELECT gene, pop, pop // 2 AS superpop, stat FROM ranks QUALIFY count(*) OVER (PARTITION BY gene, pop // 2) = 2),
r2 AS (SELECT *, rank() OVER (PARTITION BY pop ORDER BY stat) + (count(*) OVER (PARTITION BY pop, stat) - 1) / 2.0 AS r FROM whole),
s AS (SELECT a.superpop, a.pop AS pop_a, b.pop AS pop_b, round(corr(a.r, b.r), 8) AS rho FROM r2 a JOIN r2 b ON a.gene = b.gene AND a.superpop = b.superpop AND a.pop < b.pop GROUP BY 1, 2, 3)"""


@query(_SPEAR + " SELECT superpop, pop_a, pop_b, rho FROM s")
def spearman_matrix(spark, sf_dir):
    rows = ranks(spark, sf_dir).select("gene", "pop", F.floor(F.col("pop") / 2).alias("superpop"), F.col("stat").alias("value"))
    return testing.spearman_pairs(rows).withColumn("rho", F.round("rho", 8))


@query(_SPEAR + " SELECT superpop, round(2 / (1 + rho), 6) AS simple_neff, round(pow(sqrt(1 + rho) + sqrt(1 - rho), 2) / 2, 6) AS galwey_neff FROM s")
def effective_numbers(spark, sf_dir):
    """Of two populations the eigenvalues are 1 + r and 1 - r, which the SQL uses."""
    found = testing.effective_numbers(spearman_matrix(spark, sf_dir))
    return spark.createDataFrame([(int(s), round(simple, 6), round(galwey, 6)) for s, _, _, galwey, simple in found], "superpop long, simple_neff double, galwey_neff double")


@query(_RANKS + " SELECT gene, pop // 2 AS superpop, count(rank) AS n, count(*) FILTER (rank < 0.01) AS b1, count(*) FILTER (rank < 0.05) AS b5, count(*) FILTER (rank < 0.1) AS b10, round(CASE count(*) FILTER (rank < 0.05) WHEN 0 THEN 1 WHEN 1 THEN 1 - pow(0.95, count(rank)) ELSE 0.0025 END, 9)::DOUBLE AS p5, round(count(rank) * 0.1::DOUBLE, 9) AS expected10 FROM ranks GROUP BY 1, 2")
def candidate_replication(spark, sf_dir):
    rows = ranks(spark, sf_dir).withColumn("superpop", F.floor(F.col("pop") / 2))
    return testing.candidate_replication(rows).select("gene", "superpop", "n", "b1", "b5", "b10", F.round("p5", 9).alias("p5"), F.round("expected10", 9).alias("expected10"))


@query(_RANKS + ", c AS (SELECT gene, count(*) FILTER (rank < 0.05) AS b5 FROM ranks GROUP BY 1) SELECT gene, b5, round(CASE WHEN b5 = 0 THEN 1.0 ELSE (SELECT sum(exp(lgamma(7.0) - lgamma(j + 1.0) - lgamma(7.0 - j) + j * ln(0.05) + (6 - j) * ln(0.95))) FROM (SELECT unnest(generate_series(ceil(b5 * 6.2 / 10)::INT, 6))::DOUBLE AS j)) END, 9) AS p FROM c")
def adjusted_replication_p(spark, sf_dir):
    rows = ranks(spark, sf_dir).groupBy("gene").agg(F.count_if(F.col("rank") < 0.05).alias("b5"))
    return rows.select("gene", "b5", F.round(testing.adjusted_replication(F.col("b5"), F.lit(10), F.lit(6.2)), 9).alias("p"))


@query(_RANKS + ", t AS (SELECT gene, pop // 2 AS grp, 1 - pow(1 - min(rank), 1.8) AS p FROM ranks GROUP BY 1, 2), s1 AS (SELECT gene, min(q) AS p, 0 AS grp FROM " + _BH.format("t") + " GROUP BY 1) SELECT gene, round(p, 8) AS q_family, round(q, 8) AS q_hier FROM " + _BH.format("s1"))
def hierarchical_fdr(spark, sf_dir):
    rows = ranks(spark, sf_dir).withColumn("superpop", F.floor(F.col("pop") / 2))
    neff = rows.select("superpop", F.lit(1.8).alias("neff")).distinct()
    return testing.hierarchical_fdr(rows, neff).select("gene", F.round("q_family", 8).alias("q_family"), F.round("q_hier", 8).alias("q_hier"))


@query(_RANKS + ", t AS (SELECT gene, pop // 2 AS grp, 1 - pow(1 - min(rank), 1.8) AS p FROM ranks GROUP BY 1, 2), s1 AS (SELECT gene, min(q) AS p, 0 AS grp FROM " + _BH.format("t") + " GROUP BY 1), h AS (SELECT gene, q FROM " + _BH.format("s1") + """),
  b AS (SELECT gene, min(rank) AS low, count(*) FILTER (rank < 0.05) AS b5 FROM ranks GROUP BY 1), x AS (SELECT *, TRUE AS c0, low < 0.1 AS c1, q < 0.9 AS c2, b5 >= 2 AS c3 FROM b LEFT JOIN h USING (gene))
  SELECT step::INT AS step, name, n_genes FROM (SELECT 0 AS step, 'all' AS name, count(*) FILTER (c0) AS n_genes FROM x UNION ALL SELECT 1, 'tenth', count(*) FILTER (c0 AND c1) FROM x
  UNION ALL SELECT 2, 'hierarchical', count(*) FILTER (c0 AND c1 AND c2) FROM x UNION ALL SELECT 3, 'replicated', count(*) FILTER (c0 AND c1 AND c2 AND c3) FROM x)""")
def candidate_cascade(spark, sf_dir):
    """Genes left by rank, by the hierarchical q, and by replication in two populations."""
    rows = ranks(spark, sf_dir).withColumn("superpop", F.floor(F.col("pop") / 2))
    q = testing.hierarchical_fdr(rows, rows.select("superpop", F.lit(1.8).alias("neff")).distinct()).select("gene", "q_hier")
    table = rows.groupBy("gene").agg(F.min("rank").alias("low"), F.count_if(F.col("rank") < 0.05).alias("b5")).join(q, "gene", "left")
    return testing.candidate_cascade(table, [("all", F.lit(True)), ("tenth", F.col("low") < 0.1), ("hierarchical", F.col("q_hier") < 0.9), ("replicated", F.col("b5") >= 2)])


_RUNS = """WITH a AS (SELECT l_partkey AS gene, avg(l_extendedprice) AS a FROM lineitem GROUP BY 1), b AS (SELECT l_partkey AS gene, avg(l_extendedprice) * (1 + (l_partkey % 7) / 1000.0::DOUBLE) AS b FROM lineitem GROUP BY 1),
 m AS (SELECT gene, round(a, 6) AS a, round(b, 6) AS b FROM a JOIN b USING (gene))"""


@query(_RUNS + ", r AS (SELECT *, rank() OVER (ORDER BY a) AS ra, rank() OVER (ORDER BY b) AS rb, abs(a - b) / abs(b) AS rel FROM m) SELECT count(*) AS n, round(corr(a, b), 8) AS pearson, round(corr(ra, rb), 8) AS rank_r, round(max(rel), 8) AS max_rel, round(quantile_cont(rel, 0.5), 8) AS median_rel, round(avg((a = b)::INT), 8) AS equal, count(*) FILTER (ra <= 20 AND rb <= 20) AS top_shared FROM r")
def repro_compare(spark, sf_dir):
    base = b.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.avg("l_extendedprice").alias("v"))
    a = base.select("gene", F.round("v", 6).alias("value"))
    other = base.select("gene", F.round(F.col("v") * (1 + (F.col("gene") % 7) / 1000), 6).alias("value"))
    r = testing.compare_runs(a, other)
    return r.select("n", *[F.round(c, 8).alias(c) for c in ("pearson", "rank_r", "max_rel", "median_rel", "equal")], "top_shared")


@query(_RUNS + " SELECT gene % 5 AS series, round(quantile_cont(abs(a - b) / abs(b), 0.5), 8) AS median, round(quantile_cont(abs(a - b) / abs(b), 0.95), 8) AS p95, round(max(abs(a - b) / abs(b)), 8) AS max, round(corr(ln(a), ln(b)), 7) AS log_r FROM m GROUP BY 1")
def rel_err_summary(spark, sf_dir):
    base = b.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.avg("l_extendedprice").alias("v"))
    rows = base.select((F.col("gene") % 5).alias("series"), F.round("v", 6).alias("a"), F.round(F.col("v") * (1 + (F.col("gene") % 7) / 1000), 6).alias("b"))
    r = testing.rel_err_summary(rows, "a", "b", "series")
    return r.select("series", *[F.round(c, 8).alias(c) for c in ("median", "p95", "max")], F.round("log_r", 7).alias("log_r"))


@query("WITH m AS (SELECT l_suppkey % 10 AS series, ln(greatest(l_extendedprice, 1e-10)) AS e, ln(greatest(l_extendedprice * (1 + l_discount), 1e-10)) AS t FROM lineitem) SELECT series, round(corr(e, t), 7) AS r, round(sqrt(avg((e - t) * (e - t))), 8) AS rmse FROM m GROUP BY 1")
def accuracy_metrics(spark, sf_dir):
    rows = b.read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("series"), F.col("l_extendedprice").alias("e"), (F.col("l_extendedprice") * (1 + F.col("l_discount"))).alias("t"))
    return testing.accuracy(rows, "e", "t", "series").select("series", F.round("r", 7).alias("r"), F.round("rmse", 8).alias("rmse"))


@query("WITH m AS (SELECT l_orderkey AS series, l_linenumber AS site_idx, l_partkey::DOUBLE AS pos, l_extendedprice AS a, l_extendedprice * (1 + l_tax * l_discount) AS b FROM lineitem) SELECT series, site_idx, round(abs(a - b) / abs(b), 9) AS rel_err, pos - lag(pos) OVER (PARTITION BY series ORDER BY site_idx, pos) AS gap FROM m ORDER BY round(abs(a - b) / abs(b), 9) DESC, series, site_idx, pos LIMIT 25")
def top_k_discrepant_sites(spark, sf_dir):
    li = b.read(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("site_idx"), F.col("l_partkey").cast("double").alias("pos"), F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 + F.col("l_tax") * F.col("l_discount"))).alias("b"))
    return testing.top_discrepant(rows, "a", "b", 25).select("series", "site_idx", F.round("rel_err", 9).alias("rel_err"), "gap")


@query(_RUNS + " SELECT round(max(abs(a - b)), 5) AS max_delta FROM m")
def check_convergence(spark, sf_dir):
    base = b.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.avg("l_extendedprice").alias("v"))
    a = base.select("gene", F.round("v", 6).alias("value"))
    other = base.select("gene", F.round(F.col("v") * (1 + (F.col("gene") % 7) / 1000), 6).alias("value"))
    return testing.max_delta(a, other, ["gene"], "value").select(F.round("max_delta", 5).alias("max_delta"))


@query(_LOWS + _MASKED + """, g AS (SELECT gene, gene // 20 AS chrom, gene % 5 AS superpop, low, abs(low - 0.5) AS d FROM low WHERE gene % 25 NOT IN (SELECT gene_id FROM bad))
  SELECT superpop, count(*) AS candidates, round(min(d), 9) AS nearest FROM g GROUP BY 1""")
def neutral_control_candidates(spark, sf_dir):
    """Unmasked genes per superpopulation and how near the best one's smallest rank is to a half."""
    masks = b.masks(spark, sf_dir).select(F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    bad = intervals.mask_flags(b.genes(spark, sf_dir), masks).where("masked").select(F.col("gene_id").alias("bad"))
    rows = ranks(spark, sf_dir).groupBy("gene").agg(F.min("rank").alias("low")).join(bad, F.col("gene") % 25 == F.col("bad"), "left_anti")
    return rows.groupBy((F.col("gene") % 5).alias("superpop")).agg(F.count(F.lit(1)).alias("candidates"), F.round(F.min(F.abs(F.col("low") - 0.5)), 9).alias("nearest"))


_CONTROLS = _LOWS.replace("WITH ", "WITH RECURSIVE ", 1) + """, g AS (SELECT gene % 5 AS sp, gene // 20 AS chrom, 'G' || gene AS gene_name, abs(low - 0.5) AS d FROM low),
pick AS (SELECT -1 AS sp, ''::VARCHAR AS gene_name, -1::BIGINT AS chrom, []::BIGINT[] AS used
  UNION ALL SELECT p.sp + 1, coalesce(c.gene_name, ''), coalesce(c.chrom, -1), list_append(p.used, coalesce(c.chrom, -1)) FROM pick p LEFT JOIN (
    SELECT q.sp AS of, arg_min(g.gene_name, (g.d, g.gene_name)) AS gene_name, arg_min(g.chrom, (g.d, g.gene_name)) AS chrom FROM pick q JOIN g ON g.sp = q.sp + 1 AND NOT list_contains(q.used, g.chrom) GROUP BY q.sp) c ON c.of = p.sp WHERE p.sp < 4)
SELECT sp::BIGINT AS superpop, gene_name, chrom FROM pick WHERE gene_name <> ''"""


@query(_CONTROLS)
def neutral_controls(spark, sf_dir):
    """One control per superpopulation, each on a chromosome of its own."""
    rows = ranks(spark, sf_dir).groupBy("gene").agg(F.min("rank").alias("min_rank"))
    rows = rows.select((F.col("gene") % 5).alias("superpop"), F.floor(F.col("gene") / 20).alias("chrom"), F.concat(F.lit("G"), "gene").alias("gene_name"), "min_rank", F.lit(False).alias("masked"))
    return spark.createDataFrame(g.neutral_controls(rows, list(range(5))), "superpop long, gene_name string, chrom long")
