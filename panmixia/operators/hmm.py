"""Discrete-time hidden Markov model of pair coalescence times, and re-estimation of its prior."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panmixia.operators import fold


def time_grid(spark: SparkSession, k: int = 32, ne: float = 1e4, t_max: float | None = None) -> DataFrame:
    """k, t_lo, t_hi, t_mid, q: quadratic bins up to ``t_max`` (10 Ne), their arithmetic middles, and the coalescent's mass."""
    top = t_max or 10 * ne
    edge = lambda c: top * (c / k) * (c / k)
    rows = spark.range(k).select(F.col("id").cast("int").alias("k"), edge(F.col("id")).alias("t_lo"), edge(F.col("id") + 1).alias("t_hi"))
    mass = F.exp(-F.col("t_lo") / (2 * ne)) - F.exp(-F.col("t_hi") / (2 * ne))
    whole = -math.expm1(-top / (2 * ne))
    return rows.select("k", "t_lo", "t_hi", ((F.col("t_lo") + F.col("t_hi")) / 2).alias("t_mid"), (mass / whole).alias("q"))


def grid_arrays(k: int, ne: float, t_max: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(middles, prior) for the folds."""
    edges = (t_max or 10 * ne) * (np.arange(k + 1) / k) ** 2
    q = np.exp(-edges[:-1] / (2 * ne)) - np.exp(-edges[1:] / (2 * ne))
    return (edges[:-1] + edges[1:]) / 2, q / q.sum()


class Model:
    """Forward and backward passes for a batch of pairs; states are pairs by bins."""

    def __init__(self, k: int = 32, ne: float = 1e4, mu: float = 1.25e-8, rho: float = 1e-8, t_max: float | None = None, prior: np.ndarray | None = None):
        self.t, q = grid_arrays(k, ne, t_max)
        self.q = q if prior is None else np.asarray(prior, float)
        self.mu, self.rho = mu, rho

    def _emission(self, d: np.ndarray, gap: float) -> np.ndarray:
        """Of a site's difference and of the unvarying stretch before it."""
        same = np.exp(-2 * self.mu * self.t)
        e = np.where(d[:, None] > 0, 1 - same, same)
        return e * np.exp(-2 * self.mu * self.t * (gap - 1)) if gap > 1 else e

    def passes(self, x: np.ndarray, pos: np.ndarray, messages: np.ndarray | None = None, backward: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """(posteriors pairs by sites by bins, log-likelihoods)."""
        n, sites = x.shape
        alpha = np.empty((sites, n, len(self.t)))
        ll = np.zeros(n)
        a = None
        for s in range(sites):
            gap = pos[s] - pos[s - 1] if s else 0.0
            if s:
                stay = np.exp(-self.rho * gap * self.t)
                a = stay * a + (a * (1 - stay)).sum(1, keepdims=True) * self.q
            else:
                a = np.broadcast_to(self.q, (n, len(self.q)))
            a = a * self._emission(x[:, s], gap)
            if messages is not None:
                a = a * messages[:, s]
            z = a.sum(1, keepdims=True)
            ll += np.where(z[:, 0] > 0, np.log(np.maximum(z[:, 0], 1e-300)), -1e30)
            a = np.divide(a, z, out=np.zeros_like(a), where=z > 0)
            alpha[s] = a
        if not backward:
            return None, ll
        b = np.ones((n, len(self.t)))
        for s in range(sites - 1, -1, -1):
            g = alpha[s] * b
            z = g.sum(1, keepdims=True)
            if s:
                gap = pos[s] - pos[s - 1]
                be = b * self._emission(x[:, s], gap)
                if messages is not None:
                    be = be * messages[:, s]
                stay = np.exp(-self.rho * gap * self.t)
                b = stay * be + (1 - stay) * (be @ self.q)[:, None]
                b = b / np.maximum(b.sum(1, keepdims=True), 1e-300)
            alpha[s] = np.divide(g, z, out=np.zeros_like(g), where=z > 0)
        return alpha.transpose(1, 0, 2), ll

    def summaries(self, gamma: np.ndarray) -> dict[str, np.ndarray]:
        """Mean time, and the first bins at which the posterior's sum reaches 2.5 and 97.5 percent."""
        cum = np.cumsum(gamma, axis=-1)
        last = len(self.t) - 1
        lo, hi = (np.minimum((cum < c).sum(-1), last) for c in (0.025, 0.975))
        return {"mean": gamma @ self.t, "lower": self.t[lo], "upper": self.t[hi]}

    def summary_kernel(self, x, pos):
        gamma, ll = self.passes(x, pos)
        return self.summaries(gamma) | {"loglik": np.repeat(ll[:, None], x.shape[1], axis=1)}


def hmm_log_likelihood(pairs_xor: DataFrame, positions: list[float], keep: tuple[str, ...] = (), **model) -> DataFrame:
    m = Model(**model)
    return fold.per_pair(pairs_xor, positions, lambda x, pos: {"loglik": m.passes(x, pos, backward=False)[1]}, ("loglik",), keep)


def hmm_posterior(pairs_xor: DataFrame, positions: list[float], **model) -> DataFrame:
    """i, j, site_idx, k, p."""
    m = Model(**model)
    bins = [f"p{k}" for k in range(len(m.t))]
    rows = fold.per_site(pairs_xor, positions, lambda x, pos: dict(zip(bins, m.passes(x, pos)[0].transpose(2, 0, 1), strict=True)), tuple(bins))
    return rows.select("i", "j", "site_idx", F.posexplode(F.array(*bins)).alias("k", "p"))


def hmm_posterior_batched(pairs_xor: DataFrame, positions: list[float], keep: tuple[str, ...] = (), loglik: bool = False, **model) -> DataFrame:
    """i, j, site_idx, pos, mean, lower, upper, and the pair's log-likelihood if asked: all from one pass."""
    return fold.per_site(pairs_xor, positions, Model(**model).summary_kernel, ("mean", "lower", "upper", *(["loglik"] * loglik)), keep)


def expected_bins(pairs_xor: DataFrame, positions: list[float], model: Model) -> tuple[np.ndarray, float, int]:
    """Posterior mass by bin over all pairs and sites, total log-likelihood, and the number of cells; a task sends one row."""
    pos = np.asarray(positions, float)

    def run(batches):
        total, ll, n = np.zeros(len(model.t)), 0.0, 0
        for _, x in fold.parts(batches, len(pos)):
            for at in range(0, len(x), 512):  # posteriors are bins times larger than differences
                gamma, own = model.passes(x[at : at + 512], pos)
                total, ll, n = total + gamma.sum((0, 1)), ll + own.sum(), n + gamma.shape[0] * gamma.shape[1]
        yield pa.RecordBatch.from_pydict({"total": [total.tolist()], "ll": [ll], "n": [n]})

    rows = pairs_xor.select("xor").mapInArrow(run, "total array<double>, ll double, n long").collect()
    return np.sum([r["total"] for r in rows], axis=0), sum(r["ll"] for r in rows), sum(r["n"] for r in rows)


def adaptive_prior_infer(pairs_xor: DataFrame, positions: list[float], max_iterations: int = 20, blend_alpha: float = 0.7, convergence_tol: float = 1e-6, **model):
    """Re-estimate the prior: a geometric blend of the old one and the mean posterior, until it changes by less than the tolerance.

    Returns (summaries under the final prior, prior, log-likelihood history, converged). Each round is
    one distributed pass; the driver holds K numbers.
    """
    m = Model(**model)
    history, converged = [], False
    for step in range(max_iterations):
        total, ll, n = expected_bins(pairs_xor, positions, m)
        history.append(ll)
        if step == max_iterations - 1:
            break
        blended = np.exp((1 - blend_alpha) * np.log(np.maximum(m.q, 1e-30)) + blend_alpha * np.log(np.maximum(total / n, 1e-30)))
        blended /= blended.sum()
        change, m.q = np.abs(blended - m.q).max(), blended
        if change < convergence_tol:
            converged = True
            history.append(expected_bins(pairs_xor, positions, m)[1])
            break
    return fold.per_site(pairs_xor, positions, m.summary_kernel, ("mean", "lower", "upper")), m.q, history, converged
