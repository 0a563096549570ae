"""Front ends: one-shot inference and the tiered estimator, on DataFrames.

A panel is a long table (hap_id, site_idx, pos, allele); pairs are given as a table (i, j), or all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panmixia.operators import diversity, hmm
from panmixia.operators import panel as p
from panmixia.operators.flow import FlowContext, FlowField, generate_flow_field, recommend_core_block_size

_FIELDS: dict[tuple[str, int], FlowField] = {}
MU, RHO, NE = 1.25e-8, 1e-8, 10_000.0


def default_flow_field(spark: SparkSession, n_steps: int = 500) -> FlowField:
    """The field of a constant size, made once per application."""
    key = (spark.sparkContext.applicationId, n_steps)
    if key not in _FIELDS:
        _FIELDS[key] = generate_flow_field(spark, n_steps=n_steps)
    return _FIELDS[key]


def _sites(panel: DataFrame) -> list[float]:
    """Positions in order; they are the folds' time axis, a few MB for the largest chromosome."""
    rows = panel.groupBy("site_idx").agg(F.min("pos").alias("pos"), F.max("pos").alias("other")).orderBy("site_idx").collect()
    pos = [r["pos"] for r in rows]
    if any(r["pos"] != r["other"] for r in rows) or any(a > b for a, b in zip(pos, pos[1:], strict=False)):
        raise ValueError("every site needs one position, and positions must not fall")
    return pos


def _prepared(panel: DataFrame, pairs: DataFrame | None, within: tuple[str, ...]) -> tuple[DataFrame, list[float]]:
    """Pairs' packed differences over segregating sites, and those sites' positions."""
    kept = p.filter_segregating(panel)
    pos = _sites(kept)
    packed = p.packed_wide(p.to_wide(kept, *within)).drop("alleles").where(F.col("n_sites") == len(pos))
    return (p.pair_words(packed, *within) if pairs is None else p.explicit_pairs(pairs, packed)), pos


def _rates(panel: DataFrame, mu: float, rho: float, ne: float, auto: bool) -> tuple[float, float]:
    if not auto:
        return mu, rho
    r = diversity.estimate_theta(p.filter_segregating(panel), mu, rho, ne).first()
    return (r["mu_eff"], r["rho_eff"]) if r and r["mu_eff"] is not None else (mu, rho)


def infer(panel: DataFrame, pairs: DataFrame | None = None, mu: float = MU, rho: float = RHO, ne: float = NE, flow: FlowField | None = None, mean_only: bool = True, return_posterior: bool = False, auto_estimate_theta: bool = True, within: tuple[str, ...] = ()) -> DataFrame:
    """i, j, site_idx (among segregating sites), pos, mean and, if asked, lower, upper, alpha, beta."""
    rows, pos = _prepared(panel, pairs, within)
    mu, rho = _rates(panel, mu, rho, ne, auto_estimate_theta)
    context = FlowContext(pos, flow or default_flow_field(panel.sparkSession), ne, mu, rho)
    return context.run_fb(rows, mean_only, return_posterior)


def infer_blockwise(panel: DataFrame, pairs: DataFrame, mu: float = MU, rho: float = RHO, ne: float = NE, flow: FlowField | None = None, mean_only: bool = True, core_block_sites: int | str = "auto", flank_sites: int = 2048, free_bytes: int = 1 << 30, batch_pairs: int = 1000, return_posterior: bool = False, auto_estimate_theta: bool = True) -> DataFrame:
    """The same in blocks of sites; "auto" fits a block of ``batch_pairs`` pairs into ``free_bytes`` of a task."""
    rows, pos = _prepared(panel, pairs, ())
    mu, rho = _rates(panel, mu, rho, ne, auto_estimate_theta)
    core = recommend_core_block_size(len(pos), batch_pairs, free_bytes, mean_only, flank_sites) if core_block_sites == "auto" else core_block_sites
    if core <= 0 or flank_sites < 0:
        raise ValueError("blocks need sites, flanks cannot be negative")
    context = FlowContext(pos, flow or default_flow_field(panel.sparkSession), ne, mu, rho)
    return context.run_fb_blockwise(rows, core, flank_sites, mean_only, return_posterior)


class CoalescenceEstimator:
    """Tiers on one panel: spectra and diversity, windowed divergence, and the hidden Markov model."""

    def __init__(self, panel: DataFrame, mu: float = MU, rho: float = RHO, ne: float = NE):
        self.panel, self.mu, self.rho, self.ne = panel, mu, rho, ne
        self.positions = _sites(panel)
        self.packed = p.packed_wide(p.to_wide(panel)).drop("alleles")

    def sfs(self) -> DataFrame:
        return diversity.compute_sfs(self.panel)

    def site_pi(self) -> DataFrame:
        return diversity.site_pi(self.panel)

    def pairs(self, n: int = 100) -> DataFrame:
        """Seeded draws of pairs, or all if there are no more."""
        return p.draw_pairs(self.packed, n)

    def _xor(self, pairs: DataFrame | None, n: int = 100) -> DataFrame:
        return p.explicit_pairs(self.pairs(n) if pairs is None else pairs, self.packed)

    def pairwise_divergence(self, pairs: DataFrame | None = None, window_sizes: tuple[int, ...] = (100,)) -> DataFrame:
        return diversity.pairwise_divergence(self._xor(pairs), list(window_sizes), len(self.positions))

    def tmrca_landscape(self, n_pairs: int = 100, window_bp: float = 10_000.0) -> DataFrame:
        return diversity.tmrca_landscape(self._xor(None, n_pairs), self.positions, self.mu, window_bp)

    def infer_tmrca(self, pairs: DataFrame | None = None, n_time_bins: int = 32, t_max: float | None = None) -> DataFrame:
        """One pass of the model; re-estimation and trees are operators of their own."""
        model = {"k": n_time_bins, "ne": self.ne, "mu": self.mu, "rho": self.rho, "t_max": t_max}
        rows = self._xor(pairs)
        return hmm.hmm_posterior_batched(rows, self.positions, loglik=True, **model)


