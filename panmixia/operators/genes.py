"""Mergeable per-gene accumulators, the statistics read from them, ranks and summaries."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panmixia.functions.columns import histogram_bin
from panmixia.operators import fold

LO, HI, BINS = math.log(10.0), math.log(1e6), 50
#: Pairs that lead windows take at once, so that a site's states stay in cache.
LEAD_PAIRS = 2048


def pair_means(sites: DataFrame, *by: str) -> DataFrame:
    """Per gene and pair: mean time, and mean of its log with times floored at 1, over at least 2 sites."""
    g = sites.groupBy(*by, "i", "j").agg(F.avg("tmrca").alias("lin"), F.avg(F.ln(F.greatest("tmrca", F.lit(1.0)))).alias("log"), F.count(F.lit(1)).alias("n_sites"))
    return g.where("n_sites >= 2")


def lead_pair_means(pairs_xor: DataFrame, positions: list[float], leads: list[tuple[int, float]], half: float, kernel: fold.Kernel, least_sites: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """lead, i, j, n_sites, lin, log: means of a pair's times and of their logs within ``half`` of each lead, both ends included.

    Windows of fewer than ``least_sites`` sites are left out. The kernel's times are reduced to windows
    inside the fold, so no row per site leaves a task.
    """
    at = np.asarray(positions, float)
    spans = [(lead, int(np.searchsorted(at, c - half)), int(np.searchsorted(at, c + half, side="right"))) for lead, c in leads]
    spans = [(lead, a, z) for lead, a, z in spans if z - a >= max(least_sites, 1)]
    first, last = (np.array([s[k] for s in spans], int) for k in (1, 2))

    def windows(x, pos):
        t = kernel(x, pos)["mean"]
        out = {}
        for name, v in (("lin", t), ("log", np.log(np.maximum(t, 1.0)))):
            sums = np.concatenate([np.zeros((len(x), 1)), np.cumsum(v, axis=1)], axis=1)
            out[name] = ((sums[:, last] - sums[:, first]) / np.maximum(last - first, 1)).tolist()
        return out | {"lead": [[lead for lead, _, _ in spans]] * len(x), "n": [[z - a for _, a, z in spans]] * len(x)}

    rows = fold.per_pair(pairs_xor, positions, windows, ("lead:array<long>", "n:array<long>", "lin:array<double>", "log:array<double>"), keep)
    rows = rows.select("i", "j", *keep, F.explode(F.arrays_zip("lead", "n", "lin", "log")).alias("e"))
    return rows.select("e.lead", "i", "j", *keep, F.col("e.n").alias("n_sites"), "e.lin", "e.log")


def lead_pair_accumulators(pairs_xor: DataFrame, positions: list[float], leads: list[tuple[int, float]], half: float, means: Callable[[np.ndarray, np.ndarray], np.ndarray], least_sites: int, by: str) -> DataFrame:
    """The accumulators of ``lead_pair_means`` per lead and ``by``; ``means`` gives a matrix of sites by pairs.

    A task adds them up as ``accumulate`` would and sends a row per lead and group, not one per lead and pair.
    """
    at = np.asarray(positions, float)
    spans = [(lead, int(np.searchsorted(at, c - half)), int(np.searchsorted(at, c + half, side="right"))) for lead, c in leads]
    spans = [(lead, a, z) for lead, a, z in spans if z - a >= max(least_sites, 1)]
    first, last = (np.array([s[k] for s in spans], int) for k in (1, 2))
    size, row0 = (last - first)[:, None], np.arange(len(spans))[:, None] * BINS

    def within(v: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, v.shape[1])), np.cumsum(v, axis=0)])
        return (sums[last] - sums[first]) / size

    def added(held: dict[str, np.ndarray] | None, lin: np.ndarray, log: np.ndarray) -> dict[str, np.ndarray]:
        bins = np.clip(np.floor((log - LO) / ((HI - LO) / BINS)), 0, BINS - 1).astype(np.int64) + row0
        hist = np.bincount(bins.ravel(), minlength=len(spans) * BINS).reshape(-1, BINS)
        new = {"lin_sum": lin.sum(1), "log_sum": log.sum(1), "log_sq_sum": (log * log).sum(1), "min_lin": lin.min(1), "min_log": log.min(1), "hist": hist}
        return {k: np.minimum(held[k], v) if k.startswith("min") else held[k] + v for k, v in new.items()} if held else new

    def run(batches):
        held: dict = {}
        for part, x in fold.parts(batches, len(at), LEAD_PAIRS * len(at)):
            groups = part.column(by).dictionary_encode(null_encoding="encode")
            codes = groups.indices.to_numpy()
            t = means(x, at)
            lin, log = within(t), within(np.log(np.maximum(t, 1.0)))
            for k, g in enumerate(groups.dictionary.to_pylist()):
                own = codes == k
                if own.any():
                    held[g] = added(held.get(g), *((lin, log) if own.all() else (lin[:, own], log[:, own])))
        for g, acc in held.items():
            columns = {"lead": pa.array([lead for lead, _, _ in spans], pa.int64()), by: pa.array([g] * len(spans), kind), "count": pa.array(acc["hist"].sum(1))}
            columns |= {k: pa.array(v) for k, v in acc.items() if k != "hist"} | {"hist": pa.array(acc["hist"].tolist(), pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(columns)

    field = pairs_xor.schema[by].dataType
    kind = to_arrow_type(field)
    if not spans:
        pairs_xor = pairs_xor.limit(0)
    schema = f"lead long, `{by}` {field.simpleString()}, count long, lin_sum double, log_sum double, log_sq_sum double, min_lin double, min_log double, hist array<long>"
    return merge(pairs_xor.select(by, "xor").mapInArrow(run, schema), "lead", by)


def from_values(rows: DataFrame, value: str = "value") -> DataFrame:
    """Pairs that have one time each, in the form of ``pair_means``."""
    return rows.withColumns({"lin": F.col(value), "log": F.ln(F.greatest(F.col(value), F.lit(1.0)))})


def accumulate(pairs: DataFrame, *by: str) -> DataFrame:
    """Accumulators per group: count, lin_sum, log_sum, log_sq_sum, min_lin, min_log and a histogram of 50 bins.

    All of them merge by sums and minima, so chunks of pairs can be added later; the histogram is 50
    conditional counts, which aggregate partially before the shuffle.
    """
    bin_ = histogram_bin(F.col("log"), LO, HI, BINS)
    counts = [F.count_if(F.col("__bin") == k).alias(f"h{k}") for k in range(BINS)]
    g = pairs.withColumn("__bin", bin_).groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.sum("lin").alias("lin_sum"), F.sum("log").alias("log_sum"),
        F.sum(F.col("log") * F.col("log")).alias("log_sq_sum"), F.min("lin").alias("min_lin"), F.min("log").alias("min_log"), *counts,
    )
    return g.withColumn("hist", F.array(*[f"h{k}" for k in range(BINS)])).drop(*[f"h{k}" for k in range(BINS)])


def merge(accumulators: DataFrame, *by: str) -> DataFrame:
    """Accumulators of chunks added up."""
    sums = [F.sum(F.get("hist", F.lit(k))).alias(f"h{k}") for k in range(BINS)]
    g = accumulators.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("count", "lin_sum", "log_sum", "log_sq_sum")], F.min("min_lin").alias("min_lin"), F.min("min_log").alias("min_log"), *sums)
    return g.withColumn("hist", F.array(*[f"h{k}" for k in range(BINS)])).drop(*[f"h{k}" for k in range(BINS)])


def percentile(q: float) -> Column:
    """exp of the centre of the first bin at which the counts up to it reach q of all."""
    target = q * F.col("count")
    centre = LO + (HI - LO) / BINS * 0.5
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).alias("passed"))
    # one pass: bins whose running sum stays below the target come before the first that reaches it
    walked = F.aggregate("hist", start, lambda a, x: F.struct((a["upto"] + x).alias("upto"), (a["passed"] + F.when(a["upto"] + x < target, 1).otherwise(0)).alias("passed")), lambda a: a["passed"])
    return F.when(target <= F.col("count"), F.exp(centre + walked * ((HI - LO) / BINS)))


def frac_below(years: float) -> Column:
    """Share of pairs below a time: whole bins, and of the bin that it cuts a linear part."""
    at = (math.log(max(years, 1.0)) - LO) / ((HI - LO) / BINS)
    full = min(max(math.floor(at), 0), BINS)
    whole = F.aggregate(F.slice("hist", 1, full), F.lit(0).cast("long"), lambda a, x: a + x) if full else F.lit(0)
    part = F.get("hist", F.lit(full)) * (at - full) if 0 <= at < BINS else F.lit(0.0)
    return (whole + part) / F.col("count")


def statistic(name: str) -> Column:
    """geom_mean, arith_mean, log_variance, min, min_log, p<percent> or frac_below_<time>, from accumulators alone."""
    n = F.col("count")
    simple = {
        "geom_mean": F.exp(F.col("log_sum") / n), "arith_mean": F.col("lin_sum") / n, "min": F.col("min_lin"), "min_log": F.exp("min_log"),
        "log_variance": F.col("log_sq_sum") / n - (F.col("log_sum") / n) * (F.col("log_sum") / n),
    }
    if name in simple:
        return simple[name]
    if m := re.fullmatch(r"p(\d+(?:\.\d+)?)", name):
        return percentile(float(m[1]) / 100)
    if m := re.fullmatch(r"frac_below_(\d+(?:\.\d+)?)", name):
        return frac_below(float(m[1]))
    raise ValueError(f"unknown statistic {name!r}")


def ascending(name: str) -> bool:
    """Small times are extreme; of shares below a time the large ones are."""
    return not name.startswith("frac_below")


def rank_summary(ranks: DataFrame) -> DataFrame:
    """gene, min_rank, min_pop (the first population of the smallest rank), max_rank, rank_range."""
    g = ranks.where("rank is not null").groupBy("gene").agg(F.min("rank").alias("min_rank"), F.min_by("pop", F.struct("rank", "pop")).alias("min_pop"), F.max("rank").alias("max_rank"))
    return g.withColumn("rank_range", F.col("max_rank") - F.col("min_rank"))


def pivot(rows: DataFrame, value: str, pops: list) -> DataFrame:
    """One column per population; the list of them is given, so no extra pass finds it."""
    return rows.groupBy("gene").pivot("pop", pops).agg(F.first(value))


def manhattan(genes: DataFrame, chroms: DataFrame) -> DataFrame:
    """Genome-wide midpoints by cumulative chromosome lengths, and -log10 of the clipped smallest rank."""
    before = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)  # a row per chromosome
    offsets = chroms.select("chrom", F.coalesce(F.sum("length").over(before), F.lit(0.0)).alias("offset"))
    clipped = F.greatest(F.least(F.col("min_rank"), F.lit(1.0)), F.lit(1e-6))
    return genes.join(F.broadcast(offsets), "chrom").withColumns({"x": F.col("offset") + (F.col("start") + F.col("end")) / 2, "y": -F.log10(clipped)})


def heatmap(rows: DataFrame, pops: int, years: float = 29.0, least_sites: int = 20) -> DataFrame:
    """Cells in thousands of years, null under ``least_sites``; rows with at least half of them, in the order of their minimum."""
    cells = rows.withColumn("kya", F.when(F.col("n_sites") >= least_sites, F.col("value") * years / 1000))
    w = Window.partitionBy("gene")
    cells = cells.withColumns({"row_min": F.min("kya").over(w), "valid": F.count("kya").over(w)}).where(F.col("valid") * 2 >= pops)
    return cells.withColumn("colour", F.log10(F.greatest("kya", F.lit(0.1)))).select("gene", "pop", "kya", "colour", "row_min")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def control_counts(ranks: DataFrame, controls: DataFrame) -> DataFrame:
    """Control genes under 10, 5 and 1 percent by statistic."""
    rows = ranks.join(controls, "gene", "left_semi")
    return rows.groupBy("stat").agg(*[F.count_if(F.col("min_rank") < t).alias(f"below_{p}") for p, t in (("10", 0.10), ("5", 0.05), ("1", 0.01))])


def neutral_controls(genes: DataFrame, superpops: list) -> list[tuple]:
    """Per superpopulation the unmasked named gene whose smallest rank is nearest 0.5, on a chromosome not used yet.

    Candidates are ranked in Spark; the driver sees, for each superpopulation, one gene per chromosome.
    """
    ok = genes.where(~F.col("masked") & ~F.col("gene_name").startswith("ENSG"))
    best = ok.groupBy("superpop", "chrom").agg(F.min_by(F.struct("gene_name", F.abs(F.col("min_rank") - 0.5).alias("d")), F.struct(F.abs(F.col("min_rank") - 0.5), F.col("gene_name"))).alias("g"))
    rows = sorted(((r["superpop"], r["g"]["d"], r["g"]["gene_name"], r["chrom"]) for r in best.collect()), key=lambda r: (superpops.index(r[0]), r[1], r[2]))
    used, out = set(), []
    for s in superpops:
        pick = next((r for r in rows if r[0] == s and r[3] not in used), None)
        if pick:
            used.add(pick[3])
            out.append((s, pick[2], pick[3]))
    return out


def missed_sweeps(accumulators: DataFrame) -> DataFrame:
    """Share of pairs in the five youngest bins beside the usual means and minimum."""
    young = F.aggregate(F.slice("hist", 1, 5), F.lit(0).cast("long"), lambda a, x: a + x) / F.col("count")
    return accumulators.withColumns({"young_share": young, "geom": statistic("geom_mean"), "arith": statistic("arith_mean"), "least": statistic("min")})


