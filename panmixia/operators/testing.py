"""Multiple testing, replication and comparison of runs."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panmixia.functions.columns import binomial_tail, rank_pct


def bh_fdr(df: DataFrame, p: str = "p", *by: str) -> DataFrame:
    """Benjamini and Hochberg's q within groups: p n / rank, made monotone from the largest p down, at most 1."""
    group = Window.partitionBy(*by)
    n = F.count(p).over(group)
    rank = F.rank().over(group.orderBy(F.col(p).asc_nulls_last())) + F.count(F.lit(1)).over(Window.partitionBy(*by, p)) - 1
    raw = F.when(F.col(p).isNotNull(), F.col(p) * n / rank)
    out = df.withColumn("__raw", raw)
    falling = group.orderBy(F.col(p).desc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)
    return out.withColumn("q", F.least(F.min("__raw").over(falling), F.lit(1.0))).withColumn("q", F.when(F.col(p).isNotNull(), F.col("q"))).drop("__raw")


def pathway_enrichment(members: DataFrame, ranks: DataFrame, cut: float = 0.10, least: int = 5, most: int = 500) -> DataFrame:
    """Genes under ``cut`` per pathway of 5 to 500 genes: expected number, fold, and an exact binomial tail in place of resampling."""
    gw = ranks.agg(F.avg((F.col("min_rank") < cut).cast("double"))).first()[0] or 0.0
    g = members.join(ranks, "gene").groupBy("pathway").agg(F.count(F.lit(1)).alias("n_genes"), F.count_if(F.col("min_rank") < cut).alias("n_below"))
    g = g.where(F.col("n_genes").between(least, most)).withColumn("expected", F.col("n_genes") * gw)
    return g.withColumns({"fold": F.col("n_below") / F.greatest("expected", F.lit(0.01)), "p": binomial_tail(F.col("n_below"), F.col("n_genes"), min(max(gw, 1e-12), 1 - 1e-12))})


def keyword_flag(column: Column, words: list[str]) -> Column:
    """Whether any of the words occurs, in either case."""
    import re

    return F.lower(column).rlike("|".join(re.escape(w.lower()) for w in words))


def threshold_counts(ranks: DataFrame, cuts: list[float], pops: int) -> DataFrame:
    """Genes below each cut in any population, and as many as independence would give: n (1 - (1 - t)^k)."""
    low = ranks.groupBy("gene").agg(F.min("rank").alias("low"))
    t = F.explode(F.array(*[F.lit(c) for c in cuts])).alias("cut")
    return low.select("gene", "low", t).groupBy("cut").agg(F.count_if(F.col("low") < F.col("cut")).alias("observed"), (F.count(F.lit(1)) * (1 - F.pow(1 - F.first("cut"), F.lit(float(pops))))).alias("expected"))


def spearman(df: DataFrame, a: str, b: str) -> Column:
    """Correlation of average ranks over the rows that have both; use with columns added by ``with_ranks``."""
    return F.corr(f"__r_{a}", f"__r_{b}")


def with_ranks(df: DataFrame, *columns: str) -> DataFrame:
    full = df.dropna(subset=list(columns))
    return full.withColumns({f"__r_{c}": rank_pct(c) for c in columns})


def spearman_pairs(long: DataFrame, by: str = "superpop") -> DataFrame:
    """Spearman's r of every two populations of a group, over the genes that all of its populations have."""
    pops = Window.partitionBy(by, "gene")
    sizes = long.where("value is not null").groupBy(by).agg(F.countDistinct("pop").alias("__k"))
    full = long.where("value is not null").withColumn("__n", F.count(F.lit(1)).over(pops)).join(F.broadcast(sizes), by).where("__n = __k")
    ranked = full.withColumn("r", rank_pct("value", by, "pop"))
    a, b = ranked.alias("a"), ranked.alias("b")
    both = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.gene") == F.col("b.gene")) & (F.col("a.pop") < F.col("b.pop")))
    return both.groupBy(F.col(f"a.{by}").alias(by), F.col("a.pop").alias("pop_a"), F.col("b.pop").alias("pop_b")).agg(F.corr("a.r", "b.r").alias("rho"))


def galwey_neff(matrix: np.ndarray) -> float:
    """(sum of square roots of positive eigenvalues)^2 over their sum."""
    values = np.linalg.eigvalsh(np.asarray(matrix, float))
    values = values[values > 0]
    return float(np.sqrt(values).sum() ** 2 / values.sum())


def effective_numbers(pairs: DataFrame, by: str = "superpop") -> list[tuple]:
    """(group, populations, mean correlation, Galwey's number, n / (1 + (n - 1) mean)); matrices are a few dozen wide."""
    groups: dict = {}
    for r in pairs.collect():
        groups.setdefault(r[by], {})[(r["pop_a"], r["pop_b"])] = r["rho"]
    out = []
    for g, cells in sorted(groups.items()):
        pops = sorted({p for k in cells for p in k})
        m = np.eye(len(pops))
        for (a, b), rho in cells.items():
            m[pops.index(a), pops.index(b)] = m[pops.index(b), pops.index(a)] = rho
        mean = float(np.mean(list(cells.values())))
        out.append((g, len(pops), mean, galwey_neff(m), len(pops) / (1 + (len(pops) - 1) * mean)))
    return out


def beta_pvalue(rank: Column, neff: Column) -> Column:
    """P of the smallest of ``neff`` independent ranks being this small or smaller, by its distribution's power form."""
    return F.pow(rank, neff)


def adjusted_replication(b5: Column, n: Column, neff: Column) -> Column:
    """Binomial tail at 5 percent of counts scaled to the effective number of populations."""
    return binomial_tail(F.ceil(b5 * neff / n), F.round(neff).cast("int"), 0.05)


def hierarchical_fdr(ranks: DataFrame, neff: DataFrame, family: str = "superpop") -> DataFrame:
    """Two stages: per gene the family's p from its smallest rank; q within families, then across them on the families' best.

    stage2_rank numbers the genes by their hierarchical q, smallest first, ties by gene.
    """
    low = ranks.groupBy("gene", family).agg(F.min("rank").alias("low")).join(F.broadcast(neff), family)
    stage1 = bh_fdr(low.withColumn("p", 1 - F.pow(1 - F.col("low"), F.col("neff"))), "p", family)
    best = stage1.groupBy("gene").agg(F.min("q").alias("q_family"), F.min_by(family, F.struct("q", family)).alias("best_family"))
    both = bh_fdr(best, "q_family").withColumnRenamed("q", "q_hier")
    return both.withColumn("stage2_rank", F.row_number().over(Window.orderBy("q_hier", "gene")))


def candidate_cascade(genes: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """step, name, n_genes: how many genes are left by each condition and all before it, one aggregation for all; null is no."""
    left, counts = F.lit(True), []
    for name, condition in steps:
        left = left & F.coalesce(condition, F.lit(False))
        counts.append((name, F.count_if(left)))
    row = genes.agg(*[c.alias(f"c{k}") for k, (_, c) in enumerate(counts)])
    each = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(name).alias("name"), F.col(f"c{k}").alias("n_genes")) for k, (name, _) in enumerate(counts)])
    return row.select(F.inline(each))


def candidate_replication(ranks: DataFrame, family: str = "superpop") -> DataFrame:
    """Per gene and family: populations under 1, 5 and 10 percent, their binomial tails and expected numbers."""
    g = ranks.groupBy("gene", family).agg(F.count("rank").alias("n"), *[F.count_if(F.col("rank") < t / 100).alias(f"b{t}") for t in (1, 5, 10)])
    for t in (1, 5, 10):
        g = g.withColumns({f"p{t}": binomial_tail(F.col(f"b{t}"), F.col("n"), t / 100), f"expected{t}": F.col("n") * (t / 100)})
    return g


def rel_err_summary(df: DataFrame, a: str, b: str, *by: str, floor: float = 1e-10) -> DataFrame:
    """Median, 95th percentile and maximum of |a - b| / |b|, and the correlation of logs where 10 rows are finite."""
    err = F.abs(F.col(a) - F.col(b)) / F.greatest(F.abs(F.col(b)), F.lit(floor))
    logs = [F.when((F.col(x) > 0), F.ln(F.col(x))) for x in (a, b)]
    return df.withColumns({"__e": err, "__a": logs[0], "__b": logs[1]}).groupBy(*by).agg(
        F.percentile("__e", F.lit(0.5)).alias("median"), F.percentile("__e", F.lit(0.95)).alias("p95"), F.max("__e").alias("max"),
        F.when(F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()) >= 10, F.corr("__a", "__b")).alias("log_r"),
    )


def top_discrepant(df: DataFrame, a: str, b: str, k: int, order: str = "site_idx") -> DataFrame:
    """The k rows of largest relative error, to 9 digits, each with the gap from the row before it."""
    err = F.round(F.abs(F.col(a) - F.col(b)) / F.abs(F.col(b)), 9)
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy("series").orderBy(order, "pos"))
    return df.withColumns({"rel_err": err, "gap": gap}).orderBy(F.col("rel_err").desc_nulls_last(), "series", order, "pos").limit(k)


def compare_runs(a: DataFrame, b: DataFrame, key: str = "gene", top: int = 20) -> DataFrame:
    """Agreement of two runs' values: correlations of values and of ranks, relative differences, equal share, shared top."""
    both = a.select(key, F.col("value").alias("a")).join(b.select(key, F.col("value").alias("b")), key)
    rel = F.abs(F.col("a") - F.col("b")) / F.abs(F.col("b"))
    both = both.withColumns({"ra": F.rank().over(Window.orderBy("a")), "rb": F.rank().over(Window.orderBy("b")), "rel": rel})
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("rank_r"), F.max("rel").alias("max_rel"),
        F.percentile("rel", F.lit(0.99)).alias("p99_rel"), F.percentile("rel", F.lit(0.5)).alias("median_rel"),
        F.avg((F.col("a") == F.col("b")).cast("double")).alias("equal"), F.count_if((F.col("ra") <= top) & (F.col("rb") <= top)).alias("top_shared"),
    )


def accuracy(df: DataFrame, estimate: str, truth: str, *by: str) -> DataFrame:
    """Per series the correlation and root mean square error of logs, values floored at 1e-10."""
    e, t = (F.ln(F.greatest(F.col(c), F.lit(1e-10))) for c in (estimate, truth))
    return df.withColumns({"__e": e, "__t": t}).groupBy(*by).agg(F.corr("__e", "__t").alias("r"), F.sqrt(F.avg((F.col("__e") - F.col("__t")) * (F.col("__e") - F.col("__t")))).alias("rmse"))


def max_delta(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Largest absolute change of a value between two versions of a table."""
    both = a.select(*key, F.col(value).alias("a")).join(b.select(*key, F.col(value).alias("b")), key)
    return both.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_delta"))


