"""Queries of the sequential decoders. Phase pairs are the two haplotypes of each individual."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panmixia import api
from panmixia.functions.columns import round_half_away
from panmixia.operators import flow, gamma_filter, genes, hmm, panel, segments, ultrametric
from panmixia.plans import bindings as b
from panmixia.plans import decoder_sql as sql
from panmixia.plans.registry import query

MU, RHO, NE = 1.25e-8, 1e-8, 10_000.0
_P = repr(-math.expm1(-RHO * b.SPACING))
_STEP = f"""SELECT i, j, s, {{a}} AS a, {{b}} AS b{{more}} FROM (SELECT *, m1 * m1 / v AS a2, m1 / v AS b2 FROM (SELECT *, (1 - {_P}) * a * (a + 1) / (b * b) + {_P} * 2 * 20000.0 * 20000.0 - m1 * m1 AS v
  FROM (SELECT *, (1 - {_P}) * a / b + {_P} * 20000.0 AS m1 FROM ({{src}}))))"""
_FWD = b.PHASES_SQL.replace("WITH panel", "WITH RECURSIVE panel", 1) + """, dd AS MATERIALIZED (SELECT i, j, site_idx AS s, d FROM diffs), f AS (
  SELECT i, j, s, 1.0::DOUBLE + d AS a, 1 / 20000.0::DOUBLE AS b FROM dd WHERE s = 0 UNION ALL
  """ + _STEP.format(a="a2 + d", b="b2 + 2 * 1.25e-8::DOUBLE * 1000.0", more="", src="SELECT f.i, f.j, dd.s, dd.d, f.a, f.b FROM f JOIN dd ON dd.i = f.i AND dd.j = f.j AND dd.s = f.s + 1") + ")"  # fmt: skip
_BWD = """, r AS (SELECT i, j, s, 1.0::DOUBLE AS a, 1 / 20000.0::DOUBLE AS b FROM dd WHERE s = 63 UNION ALL
  """ + _STEP.format(a="a2", b="b2", more="", src="SELECT r.i, r.j, dd.s - 1 AS s, r.a + dd.d AS a, r.b + 2 * 1.25e-8::DOUBLE * 1000.0 AS b FROM r JOIN dd ON dd.i = r.i AND dd.j = r.j AND dd.s = r.s WHERE dd.s > 0") + ")"  # fmt: skip
_SUMMARIES = " SELECT i, j, s AS site_idx, 1000.0::DOUBLE * (s + 1) AS pos, round(mean, 2) AS mean, round(lower, 2) AS lower, round(upper, 2) AS upper FROM told"
_POS = "1000.0::DOUBLE * (s + 1) AS pos"
_LIMITS = "round(greatest(mean * pow(greatest(1 - w - 1.96 * sqrt(w), 0), 3), 0), 2) AS lower, round(mean * pow(1 - w + 1.96 * sqrt(w), 3), 2) AS upper"
_THETA = """rates AS (SELECT 40000.0::DOUBLE * (pi / 40000.0) AS mu, 40000.0::DOUBLE * (pi * (1e-8::DOUBLE / 1.25e-8::DOUBLE) / 40000.0) AS rho FROM (SELECT avg(h) / 64001.0 AS pi FROM (
  SELECT ind, sum(het) AS h FROM (SELECT hap_id // 2 AS ind, site_idx, (max(allele) <> min(allele))::INT AS het FROM panel GROUP BY 1, 2) GROUP BY 1)))"""
_CI = "round(m * pow(greatest(1 - 1 / (9 * a) - 1.96 * sqrt(1 / (9 * a)), 0), 3), 2) AS lower, round(m * pow(1 - 1 / (9 * a) + 1.96 * sqrt(1 / (9 * a)), 3), 2) AS upper"


def phases(spark, sf_dir):
    return panel.phase_pairs(panel.packed_wide(b.wide(spark, sf_dir)).drop("alleles"))


def within_pop(spark, sf_dir):
    return panel.pair_words(panel.packed_wide(b.wide(spark, sf_dir)).drop("alleles"), "pop")


def _rounded(df, *columns, digits=2):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("""WITH e AS (SELECT k, 100000.0::DOUBLE * (k / 32.0) * (k / 32.0) AS lo, 100000.0::DOUBLE * ((k + 1) / 32.0) * ((k + 1) / 32.0) AS hi FROM (SELECT unnest(range(32)) AS k))
  SELECT k::INT AS k, round(lo, 6) AS t_lo, round(hi, 6) AS t_hi, round((lo + hi) / 2, 6) AS t_mid, round((exp(-lo / 20000) - exp(-hi / 20000)) / (1 - exp(-5.0)), 12) AS q FROM e""")
def coalescent_prior(spark, sf_dir):
    return hmm.time_grid(spark).select("k", *[F.round(c, 6).alias(c) for c in ("t_lo", "t_hi", "t_mid")], F.round("q", 12).alias("q"))


@query(_FWD + f" SELECT i, j, s AS site_idx, round(m, 2) AS mean, {_CI} FROM (SELECT *, a / b AS m FROM f)")
def gamma_filter_forward(spark, sf_dir):
    r = gamma_filter.gamma_filter_forward(phases(spark, sf_dir), b.positions(), NE, MU, RHO)
    return _rounded(r.drop("pos"), "mean", "lower", "upper")


@query(_FWD + " SELECT i, j, s AS site_idx, round(a / b, 2) AS mean FROM f WHERE s % 5 = 0")
def gamma_filter_forward_stride(spark, sf_dir):
    r = gamma_filter.gamma_filter_forward(phases(spark, sf_dir), b.positions(), NE, MU, RHO, stride=5, mean_only=True)
    return _rounded(r.drop("pos"), "mean")


@query(_FWD + " SELECT i, j, s AS site_idx, least(greatest(floor(ln(greatest(a / b, 1.0)) / ln(200000.0) * 255 + 0.5), 0), 255)::INT AS q FROM f")
def gamma_filter_forward_quantized(spark, sf_dir):
    return gamma_filter.gamma_filter_forward_quantized(phases(spark, sf_dir), b.positions(), NE, MU, RHO)


@query(_FWD + ", n AS (SELECT i, j, s, least(greatest(floor(ln(greatest(a / b, 1.0)) / ln(200000.0) * 15 + 0.5), 0), 15)::INT AS q FROM f) SELECT i, j, (s // 2)::INT AS byte_idx, sum(CASE WHEN s % 2 = 0 THEN q ELSE 16 * q END)::INT AS q FROM n GROUP BY 1, 2, 3")
def gamma_filter_forward_quantized4(spark, sf_dir):
    return gamma_filter.gamma_filter_forward_quantized(phases(spark, sf_dir), b.positions(), NE, MU, RHO, bits=4)


@query(_FWD + " SELECT s AS site_idx, round(avg(a / b), 2) AS site_mean, round(min(a / b), 2) AS site_min, round(max(a / b), 2) AS site_max, count(*) AS n_pairs FROM f GROUP BY 1")
def gamma_filter_site_summary(spark, sf_dir):
    return _rounded(gamma_filter.gamma_filter_site_summary(phases(spark, sf_dir), b.positions(), NE, MU, RHO), "site_mean", "site_min", "site_max")


@query(_FWD + _BWD + f""", c AS (SELECT f.i, f.j, f.s, greatest(f.a + r.a - 1, 1) AS a, greatest(f.b + r.b - 1 / 20000.0::DOUBLE, 1e-30) AS b FROM f JOIN r ON f.i = r.i AND f.j = r.j AND f.s = r.s)
  SELECT i, j, s AS site_idx, round(m, 2) AS mean, {_CI} FROM (SELECT *, a / b AS m FROM c)""")
def gamma_filter_forward_backward(spark, sf_dir):
    r = gamma_filter.gamma_filter_forward_backward(phases(spark, sf_dir), b.positions(), NE, MU, RHO)
    return _rounded(r.drop("pos", "alpha", "beta"), "mean", "lower", "upper")


_GAMMA_POP = (b.PAIRS_SQL.replace("WITH panel", "WITH RECURSIVE panel", 1) + _FWD[len(b.PHASES_SQL.replace("WITH panel", "WITH RECURSIVE panel", 1)):])


@query(_GAMMA_POP + " SELECT s AS site_idx, round(avg(a / b), 2) AS site_mean, round(min(a / b), 2) AS site_min, round(max(a / b), 2) AS site_max, count(*) AS n_pairs FROM f GROUP BY 1")
def within_population_landscape(spark, sf_dir):
    """The filter over all pairs within populations, reduced to sites inside the fold."""
    return _rounded(gamma_filter.gamma_filter_site_summary(within_pop(spark, sf_dir), b.positions(), NE, MU, RHO), "site_mean", "site_min", "site_max")


_LEAD_TIMES = _GAMMA_POP + """, t AS (SELECT n_nationkey::BIGINT AS lead, l.label AS pop, f.i, f.j, avg(a / b) AS lin, avg(ln(greatest(a / b, 1.0))) AS lg FROM f JOIN nation ON abs(1000.0 * (s + 1) - (2500.0 * n_nationkey + 2500)) <= 8000
  JOIN embeddings l ON l.vec_id = f.i GROUP BY 1, 2, 3, 4 HAVING count(*) >= 12)
  SELECT lead, pop, count(*) AS count, round(sum(lin) / count(*), 2) AS arith, round(exp(sum(lg) / count(*)), 2) AS geom, round(min(lin), 2) AS least FROM t GROUP BY 1, 2"""


@query(_LEAD_TIMES)
def lead_window_times(spark, sf_dir):
    """Accumulators of pairs' mean times in windows around leads, of 12 sites at least (200 on a chromosome), by population."""
    leads = [(k, 2500.0 * k + 2500) for k in range(25)]
    means = gamma_filter.Filter(MU, RHO, NE).forward_means
    acc = genes.lead_pair_accumulators(within_pop(spark, sf_dir), b.positions(), leads, 8000.0, means, 12, "pop")
    return acc.select("lead", "pop", "count", F.round(F.col("lin_sum") / F.col("count"), 2).alias("arith"), F.round(F.exp(F.col("log_sum") / F.col("count")), 2).alias("geom"), F.round("min_lin", 2).alias("least"))


_HMM = sql.hmm(b.PHASES_SQL)


@query(_HMM + " SELECT i, j, round(ll, 6) AS loglik FROM h WHERE s = 63")
def hmm_log_likelihood(spark, sf_dir):
    return _rounded(hmm.hmm_log_likelihood(phases(spark, sf_dir), b.positions()), "loglik", digits=6)


@query(_HMM + " SELECT i, j, s AS site_idx, (u.k - 1)::INT AS k, round(p[u.k], 6) AS p FROM post, (SELECT unnest(range(1, 33)) AS k) u")
def hmm_posterior(spark, sf_dir):
    return _rounded(hmm.hmm_posterior(phases(spark, sf_dir), b.positions()), "p", digits=6)


@query(_HMM + _SUMMARIES)
def hmm_posterior_batched(spark, sf_dir):
    return _rounded(hmm.hmm_posterior_batched(phases(spark, sf_dir), b.positions()), "mean", "lower", "upper", digits=2)


@query(sql.hmm(b.PHASES_SQL, 64) + _SUMMARIES)
def hmm_posterior_batched_64(spark, sf_dir):
    return _rounded(hmm.hmm_posterior_batched(phases(spark, sf_dir), b.positions(), k=64), "mean", "lower", "upper", digits=2)


@query(sql.hmm(b.PHASES_SQL, 128) + _SUMMARIES)
def hmm_posterior_batched_128(spark, sf_dir):
    return _rounded(hmm.hmm_posterior_batched(phases(spark, sf_dir), b.positions(), k=128), "mean", "lower", "upper")


@query(sql.hmm(sql.SAMPLE_SQL) + " SELECT told.i, told.j, told.s AS site_idx, 1000.0::DOUBLE * (told.s + 1) AS pos, round(mean, 2) AS mean, round(lower, 2) AS lower, round(upper, 2) AS upper, round(e.ll, 2) AS loglik FROM told JOIN (SELECT i, j, ll FROM h WHERE s = 63) e ON e.i = told.i AND e.j = told.j")
def infer_tmrca(spark, sf_dir):
    """The estimator's default: a hundred sampled pairs of the panel."""
    r = api.CoalescenceEstimator(b.panel(spark, sf_dir)).infer_tmrca()
    return _rounded(r, "mean", "lower", "upper", "loglik", digits=2)


@query(sql.reestimated(b.PHASES_SQL))
def adaptive_prior_infer(spark, sf_dir):
    summary, prior, history, converged = hmm.adaptive_prior_infer(phases(spark, sf_dir), b.positions())
    return spark.createDataFrame([(k, round(float(q), 7), len(history), bool(converged)) for k, q in enumerate(prior)], "k int, q double, n_iterations int, converged boolean")


@query(sql.pelt(b.PAIRS_SQL))
def pelt_changepoint(spark, sf_dir):
    return segments.pelt_changepoint(within_pop(spark, sf_dir), b.positions(), MU).withColumn("tmrca", round_half_away(F.col("tmrca"), 4))


def _sets(spark, sf_dir, size=8):
    return b.wide(spark, sf_dir).select(F.floor(F.col("hap_id") / size).alias("set_id"), "hap_id", "alleles")


@query(sql.trees())
def ultrametric_project(spark, sf_dir):
    """Trees of the posteriors of every four haplotypes."""
    quads = panel.pair_words(panel.packed_wide(b.wide(spark, sf_dir).withColumn("set_id", F.floor(F.col("hap_id") / 4))).drop("alleles"), "set_id")
    return ultrametric.ultrametric_project(quads, b.positions())


@query()
def ep_infer(spark, sf_dir):
    return _rounded(ultrametric.ep_infer(_sets(spark, sf_dir), b.positions()), "mean", "lower", "upper", "loglik", digits=4)


def _context(spark):
    return flow.FlowContext(b.positions(), api.default_flow_field(spark), NE, MU, RHO)


@query()
def generate_flow_field(spark, sf_dir):
    f = api.default_flow_field(spark)
    return spark.createDataFrame([(r, c, round(float(f.u[r, c]), 8), round(float(f.v[r, c]), 8)) for r in range(flow.M_N) for c in range(flow.C_N)], "r int, c int, u double, v double")


@query(lambda: sql.cached(b.PHASES_SQL) + f" SELECT i, j, s AS site_idx, {_POS}, round(mean, 2) AS mean, {_LIMITS}, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM z")
def flow_cached_fb(spark, sf_dir):
    return _rounded(_context(spark).run_fb(phases(spark, sf_dir), mean_only=False, return_posterior=True), "mean", "lower", "upper").withColumns({c: F.round(c, 6) for c in ("alpha", "beta")})


@query(lambda: sql.iterative(b.PHASES_SQL) + f" SELECT i, j, s AS site_idx, {_POS}, round(mean, 2) AS mean, {_LIMITS} FROM z")
def flow_iterative_fb(spark, sf_dir):
    return _rounded(_context(spark).run_fb_iterative(phases(spark, sf_dir)), "mean", "lower", "upper", digits=2)


@query(lambda: sql.cached(b.PHASES_SQL, False) + f" SELECT i, j, s AS site_idx, {_POS}, round(pow(10.0::DOUBLE, m) * 20000.0, 2) AS mean FROM f")
def flow_cached_fwd(spark, sf_dir):
    return _rounded(_context(spark).run_fwd(phases(spark, sf_dir)), "mean", digits=2)


@query(lambda: sql.cached(b.PHASES_SQL, False) + f" SELECT i, j, s AS site_idx, {_POS}, round(m, 6) AS mean_log10, round(c, 6) AS cv_log10 FROM f")
def flow_fwd_states(spark, sf_dir):
    return _rounded(_context(spark).run_fwd_states(phases(spark, sf_dir)), "mean_log10", "cv_log10", digits=6)


@query(lambda: sql.cached(b.PAIRS_SQL) + " SELECT s AS site_idx, round(avg(mean), 2) AS site_mean, round(min(mean), 2) AS site_min, round(max(mean), 2) AS site_max, count(*) AS n_pairs FROM z GROUP BY 1")
def flow_fb_summary(spark, sf_dir):
    return _rounded(_context(spark).run_fb_summary(within_pop(spark, sf_dir)), "site_mean", "site_min", "site_max", digits=2)


@query(lambda: sql.cached(b.PAIRS_SQL) + " SELECT s AS site_idx, round(avg(mean), 2) AS site_mean, round(min(mean), 2) AS site_min, round(max(mean), 2) AS site_max, count(*) AS n_pairs FROM z GROUP BY 1")
def flow_fb_summary_merged(spark, sf_dir):
    """Summaries of four disjoint sets of pairs, each by a context of its own, as one."""
    pairs = within_pop(spark, sf_dir)
    parts = [_context(spark).run_fb_summary(pairs.where(F.pmod("i", F.lit(4)) == k)) for k in range(4)]
    return _rounded(flow.merge_summaries(functools.reduce(DataFrame.unionByName, parts)), "site_mean", "site_min", "site_max")


@query("""WITH g AS (SELECT n_sites, n_pairs, free, mean_only FROM (SELECT unnest([1000, 100000, 1000000]) AS n_sites), (SELECT unnest([0, 100, 10000, 1000000]) AS n_pairs), (SELECT unnest([1073741824, 17179869184]) AS free), (SELECT unnest([true, false]) AS mean_only)),
c AS (SELECT *, CASE WHEN n_pairs > 0 THEN greatest(free - greatest(536870912, free // 5), 0) // (4 * (CASE WHEN mean_only THEN 3 ELSE 5 END) * n_pairs) - 4096 END AS core FROM g)
SELECT n_sites, n_pairs, free, mean_only, CASE WHEN n_pairs = 0 THEN least(n_sites, 32768) WHEN core <= 0 THEN least(n_sites, 1024) WHEN core >= n_sites THEN n_sites
  ELSE greatest(1024, least(pow(2, floor(log2(core)))::BIGINT, 32768, n_sites)) END::BIGINT AS core_block FROM c""")
def recommended_core_blocks(spark, sf_dir):
    """Block sizes for panels, numbers of pairs and memory from small to large."""
    rows = [(n, p, m, o, flow.recommend_core_block_size(n, p, m, o)) for n in (1000, 100_000, 1_000_000) for p in (0, 100, 10_000, 1_000_000) for m in (1 << 30, 1 << 34) for o in (True, False)]
    return spark.createDataFrame(rows, "n_sites int, n_pairs int, free long, mean_only boolean, core_block long")


@query(lambda: sql.blockwise(b.PHASES_SQL, 24, 16) + f" SELECT i, j, n::INT AS block_id, s AS site_idx, {_POS}, round(mean, 2) AS mean FROM z")
def flow_fb_blockwise(spark, sf_dir):
    return _rounded(_context(spark).run_fb_blockwise(phases(spark, sf_dir), core_block_sites=24, flank_sites=16), "mean", digits=2)


@query(lambda: sql.cached(b.PAIRS_SQL, rates=_THETA) + f" SELECT i, j, s AS site_idx, {_POS}, round(mean, 2) AS mean FROM z")
def infer(spark, sf_dir):
    """Segregating sites, rates from the panel, all pairs within populations."""
    return api.infer(b.panel(spark, sf_dir), within=("pop",)).withColumn("mean", round_half_away(F.col("mean"), 2))


@query(lambda: sql.blockwise(b.PHASES_SQL, 32, 16, rates=_THETA) + f" SELECT i, j, n::INT AS block_id, s AS site_idx, {_POS}, round(mean, 2) AS mean FROM z")
def infer_blockwise(spark, sf_dir):
    pairs = phases(spark, sf_dir).select("i", "j")
    return _rounded(api.infer_blockwise(b.panel(spark, sf_dir), pairs, core_block_sites=32, flank_sites=16), "mean", digits=2)


@query("""WITH v AS (SELECT l_extendedprice AS x FROM lineitem), e AS (SELECT k, 100000.0::DOUBLE * (k / 20.0::DOUBLE) * (k / 20.0::DOUBLE) AS lo, 100000.0::DOUBLE * ((k + 1) / 20.0::DOUBLE) * ((k + 1) / 20.0::DOUBLE) AS hi FROM (SELECT unnest(range(20)) AS k)),
  c AS (SELECT k, lo, hi, (SELECT count(*) FROM v WHERE x >= lo AND x < hi) AS n, (SELECT count(*) FROM v WHERE x >= lo) AS s, (SELECT count(*) FROM v) AS t FROM e)
  SELECT k::INT AS epoch, round(lo, 6) AS t_lo, round(hi, 6) AS t_hi, round(CASE WHEN n >= 10 AND s / t > 0.01 THEN greatest(100.0, 1 / (2 * (n / (t * (hi - lo))) / (s / t))) ELSE 10000.0 END, 4) AS ne FROM c""")
def estimate_demography(spark, sf_dir):
    r = flow.estimate_demography(b.read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("mean")), NE)
    return r.select("epoch", F.round("t_lo", 6).alias("t_lo"), F.round("t_hi", 6).alias("t_hi"), F.round("ne", 4).alias("ne"))


@query()
def demographic_flow(spark, sf_dir):
    context = flow.DemographicFlowContext(phases(spark, sf_dir), b.positions(), api.default_flow_field(spark), NE, MU, RHO)
    return _rounded(context.run_fb(phases(spark, sf_dir)), "mean", digits=4)
