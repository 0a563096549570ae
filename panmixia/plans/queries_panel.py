"""Queries of panel primitives and tier-1 statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panmixia.functions.columns import pair_index, pair_members
from panmixia.operators import diversity, panel
from panmixia.plans import bindings as b
from panmixia.plans.decoder_sql import SAMPLE_SQL
from panmixia.plans.registry import query

MU, RHO, NE = 1.25e-8, 1e-8, 10_000.0


def packed(spark, sf_dir):
    return panel.packed_wide(b.wide(spark, sf_dir)).drop("alleles")


def within_pop(spark, sf_dir):
    """Packed differences of all pairs within populations."""
    return panel.pair_words(packed(spark, sf_dir), "pop")


@query(b.PANEL_SQL + """ SELECT hap_id, site_idx, pos, allele FROM panel WHERE site_idx IN
  (SELECT site_idx FROM panel GROUP BY 1 HAVING sum(allele) > 0 AND sum(allele) < count(*))""")
def filter_segregating(spark, sf_dir):
    return panel.filter_segregating(b.panel(spark, sf_dir)).select("hap_id", "site_idx", "pos", "allele")


@query(b.PANEL_SQL + " SELECT hap_id, site_idx, allele FROM panel WHERE (hap_id // 2) IN (SELECT l.vec_id // 2 FROM embeddings l WHERE l.vec_id % 2 = 0 AND l.label = 3)")
def subset_population(spark, sf_dir):
    samples = b.wide(spark, sf_dir).where("hap_id % 2 = 0").select(F.floor(F.col("hap_id") / 2).alias("sample_no"), F.col("pop").cast("string").alias("pop"))
    return panel.subset_population(b.panel(spark, sf_dir), samples, "pop", "3").select("hap_id", "site_idx", "allele")


@query(b.PANEL_SQL + " SELECT hap_id, site_idx, allele FROM panel WHERE (hap_id // 2) NOT IN (SELECT l.vec_id // 2 FROM embeddings l WHERE l.vec_id % 2 = 0 AND l.label // 2 = 1)")
def subset_superpopulation_complement(spark, sf_dir):
    samples = b.wide(spark, sf_dir).where("hap_id % 2 = 0").select(F.floor(F.col("hap_id") / 2).alias("sample_no"), F.col("superpop").cast("string").alias("superpop"))
    return panel.subset_population(b.panel(spark, sf_dir), samples, "superpop", "1", complement=True).select("hap_id", "site_idx", "allele")


@query(b.PANEL_SQL + " SELECT hap_id, site_idx, pos, allele FROM panel WHERE pos BETWEEN 12000 AND 20000.5")
def slice_region(spark, sf_dir):
    return panel.slice_region(b.panel(spark, sf_dir), 12000, 20000.5).select("hap_id", "site_idx", "pos", "allele")


@query(b.PANEL_SQL + " SELECT pop, site_idx FROM panel GROUP BY 1, 2 HAVING least(avg(allele), 1 - avg(allele)) >= 0.45")
def maf_filter(spark, sf_dir):
    rows = b.panel(spark, sf_dir)
    p = rows.groupBy("pop", "site_idx").agg(F.avg("allele").alias("p"))
    return p.where(F.least("p", 1 - F.col("p")) >= 0.45).select("pop", "site_idx")


@query(b.PANEL_SQL + """, w AS (SELECT hap_id, (site_idx // 64)::INT AS word_idx, bit_or(allele::UBIGINT << (site_idx % 64)::UBIGINT) AS w FROM panel GROUP BY 1, 2)
  SELECT hap_id, word_idx, (CASE WHEN w >= 9223372036854775808 THEN w::HUGEINT - 18446744073709551616 ELSE w::HUGEINT END)::BIGINT AS word FROM w""")
def bitpack(spark, sf_dir):
    return panel.bitpack(b.panel(spark, sf_dir))


@query(b.PANEL_SQL + " SELECT hap_id, site_idx, allele FROM panel")
def unpack(spark, sf_dir):
    return panel.unpack(panel.bitpack(b.panel(spark, sf_dir)), b.N_SITES)


@query(b.PAIRS_SQL + """, w AS (SELECT i, j, bit_or(d::UBIGINT << site_idx::UBIGINT) AS w FROM diffs GROUP BY 1, 2)
  SELECT i, j, (CASE WHEN w >= 9223372036854775808 THEN w::HUGEINT - 18446744073709551616 ELSE w::HUGEINT END)::BIGINT AS xor_word FROM w""")
def precompute_xor(spark, sf_dir):
    return within_pop(spark, sf_dir).select("i", "j", F.explode("xor").alias("xor_word"))


@query(b.PAIRS_SQL + " SELECT site_idx, pop, sum(d)::BIGINT AS n_het, count(*) AS n_pairs FROM diffs GROUP BY 1, 2")
def get_xor_bit(spark, sf_dir):
    rows = within_pop(spark, sf_dir).withColumn("site_idx", F.explode(F.sequence(F.lit(0), F.col("n_sites") - 1)))
    return rows.groupBy("site_idx", "pop").agg(F.sum(panel.xor_bit(F.col("xor"), F.col("site_idx"))).alias("n_het"), F.count(F.lit(1)).alias("n_pairs"))


@query(b.PAIRS_SQL + " SELECT i, j, sum(d)::BIGINT AS hamming FROM diffs GROUP BY 1, 2")
def hamming_distance(spark, sf_dir):
    return within_pop(spark, sf_dir).select("i", "j", panel.hamming(F.col("xor")).alias("hamming"))


@query("""SELECT a.vec_id AS i, b.vec_id AS j, a.vec_id * (a.vec_id - 1) // 2 + b.vec_id AS pair_id, a.vec_id AS back_i, b.vec_id AS back_j
  FROM embeddings a JOIN embeddings b ON a.vec_id > b.vec_id""")
def pair_to_ij(spark, sf_dir):
    rows = panel.pairs(b.wide(spark, sf_dir).select("hap_id")).withColumn("pair_id", pair_index(F.col("i"), F.col("j")))
    i, j = pair_members(F.col("pair_id"))
    return rows.select("i", "j", "pair_id", i.alias("back_i"), j.alias("back_j"))


@query("SELECT b.vec_id AS i, a.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id > b.vec_id AND a.label = b.label")
def pairs_mirrored(spark, sf_dir):
    return panel.pairs(b.wide(spark, sf_dir), "pop", ordered="i<j").select("i", "j")


@query("SELECT a.vec_id AS i, b.vec_id AS j, (a.vec_id * (a.vec_id - 1) // 2 + b.vec_id) // 1000 AS chunk FROM embeddings a JOIN embeddings b ON a.vec_id > b.vec_id AND a.label = b.label")
def split_pairs(spark, sf_dir):
    return panel.split_pairs(panel.pairs(b.wide(spark, sf_dir), "pop").select("i", "j"), 1000)


@query(SAMPLE_SQL + " SELECT i, j FROM pairs")
def default_pairs(spark, sf_dir):
    return panel.draw_pairs(b.wide(spark, sf_dir), 100)


@query("""SELECT pop, i, j FROM (SELECT a.label AS pop, a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id > b.vec_id AND a.label = b.label)
  QUALIFY row_number() OVER (PARTITION BY pop ORDER BY md5(i || ':' || j || ':7'), i, j) <= 20""")
def pair_cap_sample(spark, sf_dir):
    return panel.sample_pairs(panel.pairs(b.wide(spark, sf_dir), "pop"), 20, "pop", seed=7).select("pop", "i", "j")


@query(b.PAIRS_SQL + " SELECT i, j, site_idx, (sum(d) OVER (PARTITION BY i, j ORDER BY site_idx))::BIGINT AS n_diff FROM diffs")
def pairwise_prefix_scan(spark, sf_dir):
    return panel.prefix_scan(within_pop(spark, sf_dir))


@query(b.PANEL_SQL + """, acs AS (SELECT site_idx, sum(allele)::BIGINT AS ac FROM panel GROUP BY 1), bins AS (SELECT unnest(generate_series(0, (SELECT count(*) FROM embeddings)))::BIGINT AS ac)
  SELECT b.ac, count(a.site_idx) AS n_sites FROM bins b LEFT JOIN acs a ON a.ac = b.ac GROUP BY 1""")
def compute_sfs(spark, sf_dir):
    return diversity.compute_sfs(b.panel(spark, sf_dir))


@query(b.PANEL_SQL + " SELECT site_idx, round(2 * avg(allele) * (1 - avg(allele)) * count(*) / (count(*) - 1), 9) AS pi FROM panel GROUP BY 1")
def site_pi_exact(spark, sf_dir):
    return diversity.site_pi(b.panel(spark, sf_dir)).select("site_idx", F.round("pi", 9).alias("pi"))


@query(b.PANEL_SQL + """, firsts AS (SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id > b.vec_id ORDER BY a.vec_id * (a.vec_id - 1) // 2 + b.vec_id LIMIT 1000)
  SELECT x.site_idx, round(avg((x.allele <> y.allele)::INT), 9) AS pi FROM firsts p JOIN panel x ON x.hap_id = p.i JOIN panel y ON y.hap_id = p.j AND y.site_idx = x.site_idx GROUP BY 1""")
def site_pi_sampled(spark, sf_dir):
    haps = packed(spark, sf_dir)
    return diversity.sampled_site_pi(panel.explicit_pairs(panel.numbered_pairs(haps, list(range(1000))), haps)).select("site_idx", F.round("pi", 9).alias("pi"))


@query(b.PAIRS_SQL + " SELECT i, j, site_idx, (sum(d) OVER (PARTITION BY i, j ORDER BY site_idx ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING))::BIGINT AS n_diff FROM diffs")
def windowed_divergence(spark, sf_dir):
    return diversity.windowed_divergence(within_pop(spark, sf_dir), 5, b.N_SITES)


@query(b.PHASES_SQL + """ SELECT i, j, w::INT AS "window", site_idx, round(n / w, 9) AS divergence FROM (
  SELECT i, j, 4 AS w, site_idx, sum(d) OVER (PARTITION BY i, j ORDER BY site_idx ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING) AS n FROM diffs UNION ALL
  SELECT i, j, 10 AS w, site_idx, sum(d) OVER (PARTITION BY i, j ORDER BY site_idx ROWS BETWEEN 9 PRECEDING AND 10 FOLLOWING) AS n FROM diffs)""")
def pairwise_divergence(spark, sf_dir):
    rows = diversity.pairwise_divergence(panel.phase_pairs(packed(spark, sf_dir)), [4, 10], b.N_SITES)
    return rows.withColumn("divergence", F.round("divergence", 9))


@query(b.PHASES_SQL + """, p AS (SELECT i, j, site_idx, sum(d) OVER (PARTITION BY i, j ORDER BY site_idx) AS n FROM diffs), w AS (SELECT unnest([3, 8]) AS w)
  SELECT a.i, a.j, w.w::INT AS "window", a.site_idx,
    round((r.n - CASE WHEN a.site_idx - w.w > 0 THEN l.n ELSE 0 END) / (2 * 1.25e-8::DOUBLE * 1000.0 * (r.site_idx - l.site_idx)), 3) AS tmrca
  FROM p a CROSS JOIN w JOIN p r ON r.i = a.i AND r.j = a.j AND r.site_idx = least(a.site_idx + w.w, 63) JOIN p l ON l.i = a.i AND l.j = a.j AND l.site_idx = greatest(a.site_idx - w.w, 0)""")
def multiscale_divergence(spark, sf_dir):
    rows = diversity.multiscale_divergence(panel.phase_pairs(packed(spark, sf_dir)), b.positions(), [3, 8], MU)
    return rows.withColumn("tmrca", F.round("tmrca", 3))


@query(b.PAIRS_SQL + """, c AS (SELECT site_idx, sum(d) OVER (PARTITION BY i, j ORDER BY site_idx ROWS BETWEEN 9 PRECEDING AND 10 FOLLOWING) AS n FROM diffs)
  SELECT site_idx, round(avg(n) / (10 * 1000.0 * 2 * 1.25e-8::DOUBLE), 3) AS tmrca FROM c GROUP BY 1""")
def tmrca_landscape(spark, sf_dir):
    return diversity.tmrca_landscape(within_pop(spark, sf_dir), b.positions(), MU).select("site_idx", F.round("tmrca", 3).alias("tmrca"))


_THETA = """, per AS (SELECT i, sum(d) AS h FROM diffs GROUP BY 1), pi AS (SELECT avg(h) / 64001.0 AS pi FROM per)
  SELECT round(pi / 40000.0 * 1e9, 6) AS mu_eff, round(pi * (1e-8::DOUBLE / 1.25e-8::DOUBLE) / 40000.0 * 1e9, 6) AS rho_eff FROM pi"""


@query(b.PHASES_SQL + _THETA)
def estimate_theta(spark, sf_dir):
    t = diversity.estimate_theta(b.panel(spark, sf_dir), MU, RHO, NE)
    return t.select(F.round(F.col("mu_eff") * 1e9, 6).alias("mu_eff"), F.round(F.col("rho_eff") * 1e9, 6).alias("rho_eff"))


@query(b.PHASES_SQL + """, per AS (SELECT pop, i, sum(d) AS h FROM diffs GROUP BY 1, 2)
  SELECT pop, round(avg(h) / 64001.0 / 40000.0 * 1e9, 6) AS mu_eff FROM per GROUP BY 1""")
def chromosome_scaled_params(spark, sf_dir):
    """Rates frozen over the whole chromosome, per population of the first haplotype."""
    rows = panel.phase_pairs(packed(spark, sf_dir)).withColumnRenamed("j", "hap_id").join(b.wide(spark, sf_dir).select("hap_id", "pop"), "hap_id")
    het = F.avg(panel.hamming(F.col("xor"))) / (b.positions()[-1] + 1)
    return rows.groupBy("pop").agg(F.round(het / (4 * NE) * 1e9, 6).alias("mu_eff"))


@query(b.PANEL_SQL + """, s AS (SELECT site_idx, pos, sum(allele) AS ac, count(*) AS n FROM panel GROUP BY 1, 2),
  g AS (SELECT count(*) FILTER (ac > 0 AND ac < n) AS s, max(n) AS n, max(pos) - min(pos) AS len FROM s)
  SELECT s, round(greatest(s / (SELECT sum(1.0::DOUBLE / k) FROM (SELECT unnest(generate_series(1, (SELECT n FROM g) - 1)) AS k)) / (4 * 1.25e-8::DOUBLE * len), 100.0), 4) AS ne FROM g""")
def watterson_ne(spark, sf_dir):
    return diversity.watterson_ne(b.panel(spark, sf_dir), MU).select("s", F.round("ne", 4).alias("ne"))


@query(b.PANEL_SQL + """, s AS (SELECT site_idx, pos, sum(allele) AS ac, count(*) AS n FROM panel GROUP BY 1, 2)
  SELECT round(sum(2.0 * ac * (n - ac) / (n * (n - 1))) / (max(pos) + 1) * 1e6, 6) AS pi FROM s""")
def tajima_pi(spark, sf_dir):
    return diversity.tajima_pi(b.panel(spark, sf_dir)).select(F.round(F.col("pi") * 1e6, 6).alias("pi"))


@query("SELECT DISTINCT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id > b.vec_id WHERE a.label IN (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) >= 4)")
def sorted_unique_pairs(spark, sf_dir):
    haps = b.wide(spark, sf_dir).select("hap_id", "pop")
    return panel.sorted_pairs(haps.unionByName(haps), "pop", least=8)  # every row twice, so four haplotypes are eight
