"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row for ``body``; an alias might be inlined into every lambda call."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbers_below(i: Column) -> Column:
    """Pairs of the haplotypes before ``i``, in whole numbers: a double is not exact beyond 2^53, and costs more."""
    return F.shiftright(i * (i - 1), 1)


def pair_index(i: Column, j: Column) -> Column:
    """Linear index of an unordered pair of haplotypes, the larger number first."""
    hi, lo = F.greatest(i, j).cast("long"), F.least(i, j).cast("long")
    return _numbers_below(hi) + lo


def pair_members(p: Column) -> tuple[Column, Column]:
    """(i, j) of a linear index; the square root's rounding is corrected by one either way."""
    guess = F.floor((1 + F.sqrt(1 + 8 * p.cast("double"))) / 2).cast("long")
    first = _numbers_below(guess)
    i = F.when(first > p, guess - 1).when(first + guess <= p, guess + 1).otherwise(guess)
    return i, p.cast("long") - _numbers_below(i)


def round_half_away(x: Column, digits: int) -> Column:
    """As DuckDB rounds a double: its multiple, halves away from 0, divided again. F.round makes decimals of texts, which costs far more a row."""
    scaled = x * F.lit(10.0**digits)
    near = F.rint(scaled)
    whole = F.when((scaled - near == 0.5) & (scaled > 0), near + 1).when((scaled - near == -0.5) & (scaled < 0), near - 1).otherwise(near)
    return whole / F.lit(10.0**digits)


def wilson_hilferty(mean: Column, alpha: Column, z: float) -> Column:
    """Gamma quantile at ``z`` standard scores; shapes below 1 count as 1, results below 0 as 0."""
    s = 1 / (9 * F.greatest(alpha, F.lit(1.0)))
    base = F.greatest(1 - s + z * F.sqrt(s), F.lit(0.0))
    return mean * base * base * base


def log_quantise(mean: Column, ne: float, bits: int) -> Column:
    """Bucket of ln(max(mean, 1)) on [0, ln(20 Ne)], rounded half up, in ``bits`` bits."""
    top = 2**bits - 1
    q = F.floor(F.ln(F.greatest(mean, F.lit(1.0))) / math.log(20 * ne) * top + 0.5)
    return F.least(F.greatest(q, F.lit(0)), F.lit(top)).cast("int")


def log_dequantise(bucket: Column, ne: float, bits: int) -> Column:
    return F.exp(bucket / (2**bits - 1) * math.log(20 * ne))


def hudson_fst(p1: Column, n1: Column, p2: Column, n2: Column) -> Column:
    """Hudson's estimator; null where its denominator is not positive; no correction from a single haplotype."""

    def noise(p: Column, n: Column) -> Column:
        return F.when(n > 1, p * (1 - p) / (n - 1)).otherwise(0.0)

    num = (p1 - p2) * (p1 - p2) - noise(p1, n1) - noise(p2, n2)
    den = p1 * (1 - p2) + p2 * (1 - p1)
    return F.when(den > 0, num / den)


def rank_pct(value: str, *by: str, ascending: bool = True, nulls_bottom: bool = False) -> Column:
    """Average rank over the number of values, ties sharing their mean rank.

    Nulls have no rank, or, with ``nulls_bottom``, tie for the last ones among all rows.
    """
    order = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    group = Window.partitionBy(*by)
    tie = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    rank = F.rank().over(group.orderBy(order)) + (tie - 1) / 2.0
    if nulls_bottom:
        return rank / F.count(F.lit(1)).over(group)
    return F.when(F.col(value).isNotNull(), rank / F.count(value).over(group))


def histogram_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Left-closed bin of equal widths, clipped to the first and last one."""
    return F.least(F.greatest(F.floor((x - lo) / ((hi - lo) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(K >= k) for K ~ Binomial(n, p): the terms from 0 up by a running ratio, their sum from k on."""
    odds = p / (1 - p)

    def step(acc: Column, t: Column) -> Column:
        term = acc["term"] * F.when(t == 0, F.lit(1.0)).otherwise((n - t + 1) / F.greatest(t, F.lit(1)) * odds)
        return F.struct(term.alias("term"), (acc["sum"] + F.when(t >= k, term).otherwise(0.0)).alias("sum"))

    start = F.struct(F.pow(F.lit(1 - p), n.cast("double")).alias("term"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.sequence(F.lit(0), n.cast("int")), start, step, lambda a: a["sum"])
