"""Moment-matched Gamma filter of pair coalescence times."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panmixia.functions.columns import log_quantise
from panmixia.operators import fold

#: Recombination probabilities up to this leave a state as it is.
LEAST_P = 1e-7


def credible(mean: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """95 percent limits by Wilson and Hilferty's cube."""
    s = 1 / (9 * alpha)
    lo, hi = np.maximum(1 - s - 1.96 * np.sqrt(s), 0), 1 - s + 1.96 * np.sqrt(s)
    return mean * lo**3, mean * hi**3


class Filter:
    """The recursion: over a gap a state mixes with the prior and keeps its first two moments, then gaps and differences are counted."""

    def __init__(self, mu: float, rho: float, ne: float):
        self.mu, self.rho, self.prior_mean = mu, rho, 2.0 * ne

    def mixed(self, a: np.ndarray, b: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
        p = -math.expm1(-self.rho * gap)
        if p <= LEAST_P:
            return a, b
        t = self.prior_mean
        m1 = (1 - p) * a / b + p * t
        m2 = (1 - p) * a * (a + 1) / (b * b) + p * 2 * t * t
        v = m2 - m1 * m1
        ok = v > 1e-30
        if ok.all():
            return m1 * m1 / v, m1 / v
        shape = np.divide(m1 * m1, v, out=a.copy(), where=ok)
        rate = np.divide(m1, v, out=b.copy(), where=ok)
        return shape, rate

    def forward(self, x: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, sites = x.shape
        a, b = np.ones(n), np.full(n, 1 / self.prior_mean)
        shapes, rates = np.empty((sites, n)), np.empty((sites, n))
        for s in range(sites):
            if s:
                gap = pos[s] - pos[s - 1]
                a, b = self.mixed(a, b, gap)
                b = b + 2 * self.mu * gap
            a = a + x[:, s]
            shapes[s], rates[s] = a, b
        return shapes.T, rates.T

    def backward(self, x: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States before the site's own difference is counted."""
        n, sites = x.shape
        a, b = np.ones(n), np.full(n, 1 / self.prior_mean)
        shapes, rates = np.empty((sites, n)), np.empty((sites, n))
        for s in range(sites - 1, -1, -1):
            shapes[s], rates[s] = a, b
            a = a + x[:, s]
            if s:
                gap = pos[s] - pos[s - 1]
                a, b = self.mixed(a, b + 2 * self.mu * gap, gap)
        return shapes.T, rates.T

    def forward_means(self, x: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Means alone, sites by pairs."""
        a, b = self.forward(x, pos)
        return a.T / b.T

    def forward_kernel(self, x, pos):
        a, b = self.forward(x, pos)
        lo, hi = credible(a / b, a)
        return {"mean": a / b, "lower": lo, "upper": hi, "alpha": a, "beta": b}

    def smoothed_kernel(self, x, pos):
        """Both passes joined: shapes add up less one, rates less the prior's."""
        fa, fb = self.forward(x, pos)
        ba, bb = self.backward(x, pos)
        a, b = np.maximum(fa + ba - 1, 1), np.maximum(fb + bb - 1 / self.prior_mean, 1e-30)
        lo, hi = credible(a / b, a)
        return {"mean": a / b, "lower": lo, "upper": hi, "alpha": a, "beta": b}


def _strided(n: int, stride: int) -> list[int]:
    return list(range(0, n, stride))


def gamma_filter_forward(pairs_xor: DataFrame, positions: list[float], ne: float, mu: float, rho: float, stride: int = 1, mean_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Filtered mean (and limits) at every ``stride``-th site; the state passes through all of them."""
    columns = ("mean",) if mean_only else ("mean", "lower", "upper")
    return fold.per_site(pairs_xor, positions, Filter(mu, rho, ne).forward_kernel, columns, keep, _strided(len(positions), stride))


def gamma_filter_forward_backward(pairs_xor: DataFrame, positions: list[float], ne: float, mu: float, rho: float, keep: tuple[str, ...] = ()) -> DataFrame:
    return fold.per_site(pairs_xor, positions, Filter(mu, rho, ne).smoothed_kernel, ("mean", "lower", "upper", "alpha", "beta"), keep)


def gamma_filter_forward_quantized(pairs_xor: DataFrame, positions: list[float], ne: float, mu: float, rho: float, stride: int = 1, bits: int = 8) -> DataFrame:
    """i, j, site_idx, bucket of the log mean; 4-bit buckets leave two to a byte, earlier sites low."""
    rows = gamma_filter_forward(pairs_xor, positions, ne, mu, rho, stride, mean_only=True).withColumn("q", log_quantise(F.col("mean"), ne, bits))
    if bits == 8:
        return rows.select("i", "j", "site_idx", "q")
    slot = F.floor(F.col("site_idx") / stride)
    byte = rows.select("i", "j", F.floor(slot / 2).cast("int").alias("byte_idx"), (F.col("q") * F.when(slot % 2 == 0, 1).otherwise(16)).alias("q"))
    return byte.groupBy("i", "j", "byte_idx").agg(F.sum("q").cast("int").alias("q"))


def gamma_filter_site_summary(pairs_xor: DataFrame, positions: list[float], ne: float, mu: float, rho: float, stride: int = 1) -> DataFrame:
    return fold.site_summary(pairs_xor, positions, Filter(mu, rho, ne).forward_kernel, "mean", _strided(len(positions), stride))
