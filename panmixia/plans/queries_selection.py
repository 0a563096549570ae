"""Queries of frequency, linkage and haplotype statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panmixia.functions.columns import rank_pct
from panmixia.operators import selection as s
from panmixia.plans import bindings as b
from panmixia.plans.registry import query

_FREQ = b.PANEL_SQL + ", f AS (SELECT site_idx, pos, pop, avg(allele) AS p, count(*) AS n FROM panel GROUP BY 1, 2, 3)"
_REST = b.PANEL_SQL + """, o AS (SELECT site_idx, pos, superpop, sum(allele) AS a, count(*) AS n FROM panel GROUP BY 1, 2, 3),
t AS (SELECT *, sum(a) OVER (PARTITION BY site_idx) AS ta, sum(n) OVER (PARTITION BY site_idx) AS tn FROM o),
f AS (SELECT site_idx, pos, superpop, a / n AS p1, n AS n1, (ta - a) / (tn - n) AS p2, tn - n AS n2 FROM t),
x AS (SELECT *, CASE WHEN p1 * (1 - p2) + p2 * (1 - p1) > 0 THEN ((p1 - p2) * (p1 - p2) - p1 * (1 - p1) / (n1 - 1) - p2 * (1 - p2) / (n2 - 1)) / (p1 * (1 - p2) + p2 * (1 - p1)) END AS fst FROM f)"""


@query(_FREQ + " SELECT site_idx, pop, round(p, 9) AS p, n FROM f")
def allele_frequency(spark, sf_dir):
    return s.allele_frequency(b.panel(spark, sf_dir)).select("site_idx", "pop", F.round("p", 9).alias("p"), "n")


@query(_REST + " SELECT site_idx, superpop, round(fst, 9) AS fst FROM x WHERE NOT (p1 = 0 AND p2 = 0) AND NOT (p1 = 1 AND p2 = 1)")
def hudson_fst(spark, sf_dir):
    rows = s.fst(s.drop_fixed_in_both(s.focal_and_rest(b.panel(spark, sf_dir))))
    return rows.select("site_idx", "superpop", F.round("fst", 9).alias("fst"))


@query(_REST + ", " + b.GENES_SQL + """, m AS (SELECT g.gene_id, x.*, p1 - p2 AS diff FROM genes g JOIN x ON pos BETWEEN floor((g."start" + g."end") / 2) - 8000 AND floor((g."start" + g."end") / 2) + 8000)
  SELECT gene_id, superpop, count(*) AS n_variants, count(*) FILTER (diff > 0) AS n_enriched, count(*) FILTER (diff < 0) AS n_depleted, round(max(fst), 9) AS max_fst, round(max(abs(diff)), 9) AS max_diff,
    CASE WHEN count(fst) >= 10 THEN round((SELECT avg(v) FROM (SELECT unnest(list_slice(list_reverse_sort(list(fst)), 1, 10)) AS v)), 8) END AS mean_top10_fst FROM m GROUP BY 1, 2""")
def variant_evidence(spark, sf_dir):
    r = s.variant_evidence(s.focal_and_rest(b.panel(spark, sf_dir)), b.genes(spark, sf_dir), half=8000.0)
    return r.select("gene_id", "superpop", "n_variants", "n_enriched", "n_depleted", F.round("max_fst", 9).alias("max_fst"), F.round("max_diff", 9).alias("max_diff"), F.round("mean_top10_fst", 8).alias("mean_top10_fst"))


@query(_FREQ + """, g AS (SELECT site_idx, max(p) FILTER (pop = 2) AS focal, avg(p) FILTER (pop IN (3, 4)) AS near, avg(p) FILTER (pop IN (0, 1)) AS far FROM f GROUP BY 1)
  SELECT site_idx, round(focal - near, 9) AS d_near, round(focal - far, 9) AS d_far FROM g WHERE least(focal, 1 - focal) >= 0.05 ORDER BY round(abs(focal - near), 9) DESC, site_idx LIMIT 15""")
def delta_af(spark, sf_dir):
    freqs = s.allele_frequency(b.panel(spark, sf_dir))
    return s.delta_af(freqs, 2, [3, 4], [0, 1]).select("site_idx", F.round("d_near", 9).alias("d_near"), F.round("d_far", 9).alias("d_far"))


_LD = b.PANEL_SQL + """, g AS (SELECT a.site_idx AS anchor, p.site_idx, avg(a.allele) AS pa, avg(p.allele) AS pb, avg(a.allele * p.allele) AS pab FROM panel a JOIN panel p ON a.hap_id = p.hap_id WHERE a.site_idx IN (10, 40) GROUP BY 1, 2),
r AS (SELECT anchor, site_idx, pa, pb, pab - pa * pb AS d FROM g), l AS (SELECT anchor, site_idx, round(d * d / (pa * (1 - pa) * pb * (1 - pb)), 9) AS r2, round(d / CASE WHEN d >= 0 THEN least(pa * (1 - pb), (1 - pa) * pb) ELSE least(pa * pb, (1 - pa) * (1 - pb)) END, 8) AS d_prime FROM r)"""


def _ld(spark, sf_dir):
    anchors = spark.createDataFrame([(10,), (40,)], "site_idx int")
    r = s.ld(b.panel(spark, sf_dir), anchors)
    return r.select("anchor", "site_idx", F.round("r2", 9).alias("r2"), F.round("d_prime", 8).alias("d_prime"))


@query(_LD + " SELECT anchor, site_idx, r2, d_prime FROM l")
def ld_r2_dprime(spark, sf_dir):
    return _ld(spark, sf_dir)


@query(_LD + " SELECT site_idx, max(r2) AS r2 FROM l GROUP BY 1 ORDER BY r2 DESC, site_idx LIMIT 20")
def ld_scan_region(spark, sf_dir):
    return s.ld_scan(_ld(spark, sf_dir))[0]


@query(_LD + " SELECT anchor, count(*) FILTER (r2 >= 0.01) AS n_strong FROM l GROUP BY 1")
def ld_strong_counts(spark, sf_dir):
    return s.ld_scan(_ld(spark, sf_dir), strong=0.01)[1]


_WINS = b.PANEL_SQL + """, seg AS (SELECT pop, site_idx, row_number() OVER (PARTITION BY pop ORDER BY site_idx) - 1 AS no FROM (SELECT pop, site_idx FROM panel GROUP BY 1, 2 HAVING sum(allele) > 0 AND sum(allele) < count(*))),
w AS (SELECT DISTINCT pop, no // 4 AS win FROM seg WHERE no % 4 = 0 AND no + 7 <= (SELECT max(no) FROM seg z WHERE z.pop = seg.pop)),
h AS (SELECT p.pop, w.win, p.hap_id, string_agg(p.allele::VARCHAR, '' ORDER BY s.no) AS hap, max(p.pos) FILTER (s.no = w.win * 4 + 4) AS mid FROM panel p JOIN seg s ON s.pop = p.pop AND s.site_idx = p.site_idx JOIN w ON w.pop = p.pop AND s.no BETWEEN w.win * 4 AND w.win * 4 + 7 GROUP BY 1, 2, 3),
c AS (SELECT pop, win, any_value(mid) AS mid, hap, count(*) AS n FROM h GROUP BY pop, win, hap), q AS (SELECT pop, win, mid, n / sum(n) OVER (PARTITION BY pop, win) AS p, row_number() OVER (PARTITION BY pop, win ORDER BY n DESC) AS r FROM c),
hs AS (SELECT pop, win, any_value(mid) AS mid, round(sum(p * p), 9) AS h1, round(pow(coalesce(max(p) FILTER (r = 1), 0) + coalesce(max(p) FILTER (r = 2), 0), 2) + coalesce(sum(p * p) FILTER (r > 2), 0), 9) AS h12, round((sum(p * p) - pow(max(p) FILTER (r = 1), 2)) / sum(p * p), 8) AS h2h1, count(*) AS n_haps FROM q GROUP BY 1, 2)"""


def _windows(spark, sf_dir, midpoint="centre", drop=True):
    rows = s.number_sites(b.panel(spark, sf_dir), drop_monomorphic=drop)
    r = s.h_statistics(s.haplotype_windows(rows, 8, 4, midpoint=midpoint))
    return r.select("pop", "win", "mid", F.round("h1", 9).alias("h1"), F.round("h12", 9).alias("h12"), F.round("h2h1", 8).alias("h2h1"), "n_haps")


@query(_WINS + " SELECT pop, win, mid, h12, n_haps FROM hs")
def slide_h12(spark, sf_dir):
    return _windows(spark, sf_dir).select("pop", "win", "mid", "h12", "n_haps")


@query(_WINS + " SELECT pop, win, h1, h12, h2h1 FROM hs")
def h12_h2h1(spark, sf_dir):
    return _windows(spark, sf_dir, drop=False).select("pop", "win", "h1", "h12", "h2h1")


@query(_WINS + ", " + b.GENES_SQL + ' SELECT gene_id, pop, max(h12) AS max_h12, arg_max(h2h1, h12 * 1e6 - win) AS h2h1_at_max, count(*) AS n_windows FROM hs JOIN genes ON mid BETWEEN "start" AND "end" GROUP BY 1, 2')
def gene_max_h12(spark, sf_dir):
    return s.gene_max(_windows(spark, sf_dir), b.genes(spark, sf_dir)).select("gene_id", "pop", "max_h12", "h2h1_at_max", "n_windows")


@query(_WINS + " SELECT pop, max(h12) AS peak, arg_min(h12, abs(mid - 500 - 30000) * 1000 + win) AS at_focal FROM hs GROUP BY 1")
def h12_track(spark, sf_dir):
    """Peak, and the value at the window nearest a focal position, midpoints being the mean of a window's ends."""
    w = _windows(spark, sf_dir, midpoint="ends")
    return w.groupBy("pop").agg(F.max("h12").alias("peak"), F.min_by("h12", F.struct(F.abs(F.col("mid") - 30000), F.col("win"))).alias("at_focal"))


_Z = "WITH " + b.STATS_SQL + """, bins AS (SELECT *, least({bin}, 19)::INT AS bin FROM stats), zs AS (SELECT *, CASE WHEN count(stat) OVER w >= 50 AND stddev_pop(stat) OVER w > 0 THEN (stat - avg(stat) OVER w) / stddev_pop(stat) OVER w END AS z FROM bins WINDOW w AS (PARTITION BY bin))"""
_RIGHT, _LEFT = "greatest(ceil(round(freq / 0.05::DOUBLE, 9)) - 1, 0)", "floor(round(freq / 0.05::DOUBLE, 9))"


def _z(spark, sf_dir, closed):
    rows = b.site_stats(spark, sf_dir).withColumn("bin", s.frequency_bins(F.col("freq"), closed=closed))
    return s.normalise_in_bins(rows)


@query(_Z.format(bin=_RIGHT) + " SELECT bin, stat, round(z, 8) AS z, count(*) AS n FROM zs GROUP BY 1, 2, 3")
def normalize_within_daf_bins(spark, sf_dir):
    return _z(spark, sf_dir, "right").groupBy("bin", "stat", F.round("z", 8).alias("z")).agg(F.count(F.lit(1)).alias("n"))


@query(_Z.format(bin=_LEFT) + " SELECT bin, stat, round(z, 8) AS z, count(*) AS n FROM zs GROUP BY 1, 2, 3")
def daf_bins_left_closed(spark, sf_dir):
    return _z(spark, sf_dir, "left").groupBy("bin", "stat", F.round("z", 8).alias("z")).agg(F.count(F.lit(1)).alias("n"))


_GENE = _Z.format(bin=_RIGHT) + ", g AS (SELECT gene, count(*) AS n_sites, round(max(abs(z)), 8) AS max_abs, round(avg((abs(z) > 1.5)::INT), 9) AS frac_extreme FROM zs WHERE z IS NOT NULL GROUP BY 1)"


def _gene_z(spark, sf_dir):
    r = s.gene_extremes(_z(spark, sf_dir, "right"), cut=1.5)
    return r.select("gene", "n_sites", F.round("max_abs", 8).alias("max_abs"), F.round("frac_extreme", 9).alias("frac_extreme"))


@query(_GENE + " SELECT gene, n_sites, max_abs, frac_extreme FROM g")
def gene_selscan(spark, sf_dir):
    return _gene_z(spark, sf_dir)


@query(_GENE + ", v AS (SELECT gene, CASE WHEN gene % 10 = 0 THEN NULL ELSE frac_extreme END AS v FROM g) SELECT gene, round((rank() OVER (ORDER BY v DESC NULLS LAST) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / count(*) OVER (), 9)::DOUBLE AS rank FROM v")
def selscan_rank(spark, sf_dir):
    """Descending ranks with missing values at the bottom."""
    rows = _gene_z(spark, sf_dir).select("gene", F.when(F.col("gene") % 10 != 0, F.col("frac_extreme")).alias("v"))
    return rows.select("gene", F.round(rank_pct("v", ascending=False, nulls_bottom=True), 9).alias("rank"))


@query(_GENE + ", t AS (SELECT n_nationkey::BIGINT AS gene, n_regionkey FROM nation) SELECT t.gene, t.n_regionkey, g.max_abs, g.n_sites FROM t LEFT JOIN g USING (gene)")
def tmrca_selscan_join(spark, sf_dir):
    left = b.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("gene"), "n_regionkey")
    return left.join(_gene_z(spark, sf_dir).select("gene", "max_abs", "n_sites"), "gene", "left")


_IHH = b.PAIRS_SQL + """, n AS (SELECT pop, i, j, site_idx AS s, coalesce(min(CASE WHEN d = 1 THEN site_idx END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 64) AS nxt,
  coalesce(max(CASE WHEN d = 1 THEN site_idx END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS prv FROM diffs WINDOW w AS (PARTITION BY pop, i, j ORDER BY site_idx)),
e AS (SELECT pop, n.s, k.o, avg((nxt > k.o)::INT) AS h FROM n JOIN (SELECT unnest(range(64)) AS o) k ON k.o >= n.s GROUP BY 1, 2, 3
  UNION ALL SELECT pop, n.s, k.o, avg((prv < k.o)::INT) AS h FROM n JOIN (SELECT unnest(range(64)) AS o) k ON k.o < n.s GROUP BY 1, 2, 3),
t AS (SELECT a.pop, a.s, a.o, (a.h + z.h) / 2 * 1000 AS area, z.h AS before FROM e a JOIN e z ON z.pop = a.pop AND z.s = a.s AND z.o = CASE WHEN a.o > a.s THEN a.o - 1 ELSE a.o + 1 END WHERE a.o <> a.s),
ihh AS (SELECT pop, s, coalesce(sum(area) FILTER (before >= 0.05), 0) AS ihh FROM t GROUP BY 1, 2),
x AS (SELECT a.pop AS a, z.pop AS b, a.s AS site_idx, 1000.0::DOUBLE * (a.s + 1) AS pos, a.ihh AS ihh_a, z.ihh AS ihh_b, CASE WHEN a.ihh > 0 AND z.ihh > 0 THEN ln(a.ihh / z.ihh) END AS xpehh FROM ihh a JOIN ihh z ON a.s = z.s AND a.pop < z.pop)"""


def _xpehh(spark, sf_dir):
    return s.xpehh(s.integrated_homozygosity(b.wide(spark, sf_dir), b.positions(), core_sites=24, flank_sites=40))


@query(_IHH + " SELECT a, b, site_idx, round(ihh_a, 4) AS ihh_a, round(ihh_b, 4) AS ihh_b, round(xpehh, 6) + 0.0 AS xpehh FROM x")
def xpehh(spark, sf_dir):
    """All pairs of populations."""
    r = _xpehh(spark, sf_dir)
    return r.select("a", "b", "site_idx", F.round("ihh_a", 4).alias("ihh_a"), F.round("ihh_b", 4).alias("ihh_b"), (F.round("xpehh", 6) + 0.0).alias("xpehh"))


@query(_IHH + ", " + b.GENES_SQL + ' SELECT gene_id, a, b, round(max(xpehh), 6) + 0.0 AS max_xpehh, round(avg(xpehh), 6) + 0.0 AS mean_xpehh, count(*) AS n_sites FROM x JOIN genes ON pos BETWEEN "start" - 5000 AND "end" + 5000 WHERE xpehh IS NOT NULL GROUP BY 1, 2, 3')
def gene_xpehh(spark, sf_dir):
    r = s.gene_xpehh(_xpehh(spark, sf_dir), b.genes(spark, sf_dir), 5000.0)
    return r.select("gene_id", "a", "b", (F.round("max_xpehh", 6) + 0.0).alias("max_xpehh"), (F.round("mean_xpehh", 6) + 0.0).alias("mean_xpehh"), "n_sites")


_IHS = b.PAIRS_SQL + """, n AS (SELECT pop, i, j, site_idx AS s, d, coalesce(min(CASE WHEN d = 1 THEN site_idx END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 64) AS nxt,
  coalesce(max(CASE WHEN d = 1 THEN site_idx END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS prv FROM diffs WINDOW w AS (PARTITION BY pop, i, j ORDER BY site_idx)),
c AS MATERIALIZED (SELECT n.pop, n.s, p.allele, nxt, prv FROM n JOIN panel p ON p.hap_id = n.i AND p.site_idx = n.s WHERE n.d = 0),
e AS (SELECT pop, allele, s, o, avg((CASE WHEN o >= s THEN nxt > o ELSE prv < o END)::INT) AS h FROM c, (SELECT unnest(range(64)) AS o) GROUP BY 1, 2, 3, 4),
t AS (SELECT a.pop, a.allele, a.s, a.o, (a.h + z.h) / 2 * 1000 AS area, z.h AS before FROM e a JOIN e z ON z.pop = a.pop AND z.allele = a.allele AND z.s = a.s AND z.o = CASE WHEN a.o > a.s THEN a.o - 1 ELSE a.o + 1 END WHERE a.o <> a.s),
h AS (SELECT pop, allele, s, coalesce(sum(area) FILTER (before >= 0.05), 0) AS ihh FROM t GROUP BY 1, 2, 3),
g AS (SELECT pop, site_idx AS s, pos FROM panel GROUP BY 1, 2, 3),
r AS (SELECT g.pop, g.s, g.pos, coalesce(x.ihh, 0) AS x, coalesce(y.ihh, 0) AS y FROM g LEFT JOIN h x ON x.pop = g.pop AND x.s = g.s AND x.allele = 0 LEFT JOIN h y ON y.pop = g.pop AND y.s = g.s AND y.allele = 1)
SELECT pop, s AS site_idx, pos, round(x, 4) AS ihh_0, round(y, 4) AS ihh_1, round(CASE WHEN x > 0 AND y > 0 THEN ln(x / y) END, 6) + 0.0 AS ihs FROM r"""


@query(_IHS)
def ihs(spark, sf_dir):
    r = s.ihs(b.wide(spark, sf_dir), b.positions(), core_sites=24, flank_sites=40)
    return r.select("pop", "site_idx", "pos", *[F.round(c, 4).alias(c) for c in ("ihh_0", "ihh_1")], (F.round("ihs", 6) + 0.0).alias("ihs"))


@query(b.PANEL_SQL + """, c AS (SELECT pop, site_idx, sum(allele)::DOUBLE AS c, count(*)::DOUBLE AS n FROM panel GROUP BY 1, 2),
d AS (SELECT x.pop AS a, y.pop AS b, x.site_idx AS s, CASE WHEN x.pop = y.pop THEN 2 * x.c * (x.n - x.c) / (x.n * (x.n - 1)) ELSE (x.c * (y.n - y.c) + y.c * (x.n - x.c)) / (x.n * y.n) END AS d FROM c x JOIN c y ON x.site_idx = y.site_idx AND x.pop <= y.pop),
w AS (SELECT r, ('0x' || substr(md5('42:' || r || ':' || k), 1, 15))::BIGINT % 64 AS s, count(*) AS times FROM (SELECT unnest(range(100)) AS r), (SELECT unnest(range(64)) AS k) GROUP BY 1, 2),
m AS (SELECT a, b, r, sum(d * times) / sum(times) AS m FROM d JOIN w USING (s) GROUP BY 1, 2, 3), l AS (SELECT a, b, quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper FROM m GROUP BY 1, 2)
SELECT a, b, round(avg(d), 8) AS mean, round(any_value(lower), 8) AS lower, round(any_value(upper), 8) AS upper FROM d JOIN l USING (a, b) GROUP BY 1, 2""")
def group_distances(spark, sf_dir):
    """Within and between populations, with bootstrap limits."""
    r = s.group_distances(b.panel(spark, sf_dir))
    return r.select("a", "b", *[F.round(c, 8).alias(c) for c in ("mean", "lower", "upper")])
