"""Haplotype and allele-frequency statistics of selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panmixia.functions.columns import hudson_fst
from panmixia.operators.intervals import band_join


def allele_frequency(panel: DataFrame, by: str = "pop") -> DataFrame:
    """site_idx, pos, group, p, n: missing (negative) alleles are left out."""
    seen = F.when(F.col("allele") >= 0, F.col("allele"))
    return panel.groupBy("site_idx", "pos", by).agg(F.avg(seen).alias("p"), F.count(seen).alias("n"))


def focal_and_rest(panel: DataFrame, by: str = "superpop") -> DataFrame:
    """site_idx, pos, group, p1, n1 (the group), p2, n2 (all other haplotypes): one pass, the rest by difference of sums."""
    own = panel.groupBy("site_idx", "pos", by).agg(F.sum("allele").alias("a"), F.count(F.lit(1)).alias("n"))
    site = Window.partitionBy("site_idx", "pos")
    own = own.withColumns({"ta": F.sum("a").over(site), "tn": F.sum("n").over(site)})
    return own.select("site_idx", "pos", by, (F.col("a") / F.col("n")).alias("p1"), F.col("n").alias("n1"), ((F.col("ta") - F.col("a")) / (F.col("tn") - F.col("n"))).alias("p2"), (F.col("tn") - F.col("n")).alias("n2"))


def drop_fixed_in_both(freqs: DataFrame) -> DataFrame:
    return freqs.where(~((F.col("p1") == 0) & (F.col("p2") == 0)) & ~((F.col("p1") == 1) & (F.col("p2") == 1)))


def fst(freqs: DataFrame) -> DataFrame:
    return freqs.withColumn("fst", hudson_fst(F.col("p1"), F.col("n1"), F.col("p2"), F.col("n2")))


def variant_evidence(freqs: DataFrame, genes: DataFrame, by: str = "superpop", half: float = 500_000.0) -> DataFrame:
    """Per gene and group, over the sites around the gene's midpoint: counts of enriched and depleted sites, and FST's extremes.

    The ratio is infinite without enriched sites; the mean of the ten largest FST needs ten; of the
    sites with the largest difference the first counts.
    """
    centre = F.floor((F.col("start") + F.col("end")) / 2).cast("double")
    rows = band_join(fst(drop_fixed_in_both(freqs)), genes.select("gene_id", centre.alias("centre")), half)
    diff = F.col("p1") - F.col("p2")
    place = F.row_number().over(Window.partitionBy("gene_id", by).orderBy(F.desc_nulls_last("fst")))
    top = F.when(place <= 10, F.col("fst"))
    out = rows.withColumn("diff", diff).withColumn("top_fst", top).groupBy("gene_id", by).agg(
        F.count(F.lit(1)).alias("n_variants"), F.count_if(F.col("diff") > 0).alias("n_enriched"), F.count_if(F.col("diff") < 0).alias("n_depleted"),
        F.max("fst").alias("max_fst"), F.avg("top_fst").alias("top"), F.count("top_fst").alias("n_top"), F.min_by("pos", F.struct(-F.abs("diff"), F.col("pos"))).alias("most_diff_pos"), F.max(F.abs("diff")).alias("max_diff"),
    )
    ratio = F.when(F.col("n_enriched") > 0, F.col("n_depleted") / F.col("n_enriched")).otherwise(F.lit(float("inf")))
    mean10 = F.when(F.col("n_top") == 10, F.col("top"))
    return out.withColumns({"ratio": ratio, "mean_top10_fst": mean10}).drop("top", "n_top")


def delta_af(freqs: DataFrame, focal, near: list, far: list, maf: float = 0.05, k: int = 15) -> DataFrame:
    """Sites of common variants by the focal population's distance from the mean of its neighbours."""

    def mean(pops: list) -> Column:
        return F.avg(F.when(F.col("pop").isin(pops), F.col("p")))

    g = freqs.groupBy("site_idx").agg(F.max(F.when(F.col("pop") == focal, F.col("p"))).alias("focal"), mean(near).alias("near"), mean(far).alias("far"))
    g = g.where(F.least("focal", 1 - F.col("focal")) >= maf)
    g = g.withColumns({"d_near": F.col("focal") - F.col("near"), "d_far": F.col("focal") - F.col("far")})
    return g.orderBy(F.abs("d_near").desc(), "site_idx").limit(k)


def ld(panel: DataFrame, anchors: DataFrame) -> DataFrame:
    """r2 and D' of every site with each anchor site, over haplotypes in which neither allele is missing."""
    a = panel.join(F.broadcast(anchors.select(F.col("site_idx").alias("anchor"))), F.col("site_idx") == F.col("anchor")).select("hap_id", "anchor", F.col("allele").alias("x"))
    both = panel.select("hap_id", "site_idx", F.col("allele").alias("y")).join(a, "hap_id").where((F.col("x") >= 0) & (F.col("y") >= 0))
    g = both.groupBy("anchor", "site_idx").agg(F.avg("x").alias("pa"), F.avg("y").alias("pb"), F.avg(F.col("x") * F.col("y")).alias("pab"))
    pa_, pb, d = F.col("pa"), F.col("pb"), F.col("pab") - F.col("pa") * F.col("pb")
    var = pa_ * (1 - pa_) * pb * (1 - pb)
    most = F.when(d >= 0, F.least(pa_ * (1 - pb), (1 - pa_) * pb)).otherwise(F.least(pa_ * pb, (1 - pa_) * (1 - pb)))
    return g.select("anchor", "site_idx", F.when(var > 0, d * d / var).alias("r2"), F.when(most > 0, d / most).alias("d_prime"))


def ld_scan(r2: DataFrame, k: int = 20, strong: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The sites of the largest r2 to any anchor, and per anchor the number of strong ones."""
    top = r2.groupBy("site_idx").agg(F.max("r2").alias("r2")).orderBy(F.col("r2").desc_nulls_last(), "site_idx").limit(k)
    return top, r2.groupBy("anchor").agg(F.count_if(F.col("r2") >= strong).alias("n_strong"))


def haplotype_windows(panel: DataFrame, size: int, step: int, by: str = "pop", midpoint: str = "centre") -> DataFrame:
    """by, win, mid, hap, n: haplotypes of each full window of ``size`` sites and their numbers.

    ``panel`` numbers the sites that count (site_no from 0, last_no at the end). midpoint is the position at the middle
    site, or with "ends" the mean of the first and the last one. A window's haplotype is one string,
    so windows are grouped without their sites meeting again.
    """
    win = F.sequence(F.greatest(F.ceil((F.col("site_no") - size + 1) / step), F.lit(0)), F.floor(F.col("site_no") / step))
    rows = panel.withColumn("win", F.explode(win)).where(F.col("win") * step + size - 1 <= F.col("last_no"))
    cells = F.sort_array(F.collect_list(F.struct("site_no", "allele", "pos")))
    mid = F.get("cells", F.lit(size // 2))["pos"] if midpoint == "centre" else (F.get("cells", F.lit(0))["pos"] + F.get("cells", F.lit(size - 1))["pos"]) / 2
    haps = rows.groupBy(by, "win", "hap_id").agg(cells.alias("cells"))
    haps = haps.select(by, "win", mid.alias("mid"), F.array_join(F.transform("cells", lambda c: c["allele"].cast("string")), "").alias("hap"))
    return haps.groupBy(by, "win", "mid", "hap").agg(F.count(F.lit(1)).alias("n"))


def h_statistics(windows: DataFrame, by: str = "pop") -> DataFrame:
    """H1, H12 and H2/H1 of each window's haplotype frequencies; (1, 0) where there is a single haplotype."""
    window = Window.partitionBy(by, "win")
    freq = windows.withColumns({"p": F.col("n") / F.sum("n").over(window), "place": F.row_number().over(window.orderBy(F.desc("n")))})
    first, second = (F.max(F.when(F.col("place") == k, F.col("p"))) for k in (1, 2))
    g = freq.groupBy(by, "win", "mid").agg(F.sum(F.col("p") * F.col("p")).alias("h1"), first.alias("p1"), F.coalesce(second, F.lit(0.0)).alias("p2"), F.count(F.lit(1)).alias("n_haps"))
    p1, p2 = F.col("p1"), F.col("p2")
    return g.select(by, "win", "mid", "h1", (F.col("h1") + 2 * p1 * p2).alias("h12"), ((F.col("h1") - p1 * p1) / F.col("h1")).alias("h2h1"), "n_haps")


def number_sites(panel: DataFrame, by: str = "pop", drop_monomorphic: bool = True) -> DataFrame:
    """Adds site_no and last_no: the sites in order, those without both alleles in the group left out if asked."""
    sites = panel.groupBy(by, "site_idx").agg(F.sum("allele").alias("ac"), F.count(F.lit(1)).alias("an"))
    if drop_monomorphic:
        sites = sites.where((F.col("ac") > 0) & (F.col("ac") < F.col("an")))
    no = (F.row_number().over(Window.partitionBy(by).orderBy("site_idx")) - 1).alias("site_no")
    last = (F.count(F.lit(1)).over(Window.partitionBy(by)) - 1).alias("last_no")
    return panel.join(sites.select(by, "site_idx", no, last), [by, "site_idx"])


def gene_max(windows: DataFrame, genes: DataFrame, by: str = "pop") -> DataFrame:
    """Per gene the largest H12 of windows whose midpoint it holds, its H2/H1 there, and how many there are."""
    from panmixia.operators.intervals import point_join

    met = point_join(windows, genes.select("gene_id", "start", "end"), pos="mid")
    return met.groupBy("gene_id", by).agg(F.max("h12").alias("max_h12"), F.max_by("h2h1", F.struct("h12", -F.col("win"))).alias("h2h1_at_max"), F.count(F.lit(1)).alias("n_windows"))


def frequency_bins(freq: Column, width: float = 0.05, bins: int = 20, closed: str = "right") -> Column:
    """Bins of equal width over 0 to 1: right-closed with 0 in the first, or left-closed with 1 in the last; other values have none."""
    scaled = F.round(freq / width, 9)  # edges coincide with data values
    at = F.greatest(F.ceil(scaled) - 1, F.lit(0)) if closed == "right" else F.least(F.floor(scaled), F.lit(bins - 1))
    return F.when(freq.between(0, 1), F.least(at, F.lit(bins - 1))).cast("int")


def normalise_in_bins(df: DataFrame, stat: str = "stat", bin_: str = "bin", least: int = 50, *by: str) -> DataFrame:
    """z-scores by the population deviation inside frequency bins; null in bins of few values or no spread."""
    told = df.groupBy(*by, bin_).agg(F.count(stat).alias("__n"), F.avg(stat).alias("__mean"), F.stddev_pop(stat).alias("__sd"))
    told = told.where((F.col("__n") >= least) & (F.col("__sd") > 0) & F.col(bin_).isNotNull())  # a few bins a group
    z = (F.col(stat) - F.col("__mean")) / F.col("__sd")
    return df.join(told, [*by, bin_], "left").withColumn("z", z).drop("__n", "__mean", "__sd")


def gene_extremes(z: DataFrame, gene: str = "gene", cut: float = 2.0, value: str = "z") -> DataFrame:
    """Per gene the number of scored sites, the largest absolute score and the share beyond the cut."""
    return z.where(F.col(value).isNotNull()).groupBy(gene).agg(F.count(F.lit(1)).alias("n_sites"), F.max(F.abs(value)).alias("max_abs"), F.avg((F.abs(value) > cut).cast("double")).alias("frac_extreme"))


def integrated_homozygosity(panel_wide: DataFrame, positions: list[float], by: str = "pop", cutoff: float = 0.05, core_sites: int = 2048, flank_sites: int = 8192) -> DataFrame:
    """by, site_idx, pos, ihh: each group's homozygosity around every site, integrated over positions.

    Homozygosity around a core site is the chance that two haplotypes of a group agree from the core
    out to a site; it is integrated by trapezes on both sides until it falls under the cutoff. A task has
    a group's alleles in one block of core sites with flanks, beyond which nothing is integrated.
    """
    one = _in_blocks(panel_wide, positions, by, core_sites, flank_sites, lambda haps, pos, core: [integrated_ehh(haps, pos, core, cutoff)])
    return one.select(by, "site_idx", "pos", F.get("area", F.lit(0)).alias("ihh"))


def _in_blocks(panel_wide: DataFrame, positions: list[float], by: str, core_sites: int, flank_sites: int, areas) -> DataFrame:
    """by, site_idx, pos, area: what ``areas`` gives for each core site, from a group's alleles in a block with flanks."""
    from panmixia.operators.flow import block_windows

    pos = np.asarray(positions, float)
    blocks = block_windows(len(pos), core_sites, flank_sites)
    core = F.col("block") * core_sites
    start = F.greatest(core - flank_sites, F.lit(0))
    stop = F.least(F.least(core + core_sites, F.lit(len(pos))) + flank_sites, F.lit(len(pos)))
    rows = panel_wide.select(by, "alleles", F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1))).alias("block"))
    rows = rows.select(by, "block", F.slice("alleles", start + 1, stop - start).alias("alleles"))

    def integrated(key, group):
        _, first, last, a, z = blocks[key[1].as_py()]
        haps = group.column("alleles").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, z - a)
        found = [areas(haps, pos[a:z], site - a) for site in range(first, last)]
        n = last - first
        return pa.table({by: pa.array([key[0].as_py()] * n, group.schema.field(by).type), "site_idx": pa.array(range(first, last), pa.int32()), "pos": pa.array(pos[first:last]), "area": pa.array(found, pa.list_(pa.float64()))})

    kind = panel_wide.schema[by].dataType.simpleString()
    return rows.groupBy(by, "block").applyInArrow(integrated, f"`{by}` {kind}, site_idx int, pos double, area array<double>")


def xpehh(ihh: DataFrame, by: str = "pop") -> DataFrame:
    """a, b, site_idx, pos, ihh_a, ihh_b, xpehh: log ratios of two groups' integrated homozygosity, for all pairs of groups."""
    a, b = ihh.alias("a"), ihh.alias("b")
    pairs = a.join(b, (F.col("a.site_idx") == F.col("b.site_idx")) & (F.col(f"a.{by}") < F.col(f"b.{by}")))
    x, y = F.col("a.ihh"), F.col("b.ihh")
    return pairs.select(F.col(f"a.{by}").alias("a"), F.col(f"b.{by}").alias("b"), "a.site_idx", "a.pos", x.alias("ihh_a"), y.alias("ihh_b"), F.when((x > 0) & (y > 0), F.log(x / y)).alias("xpehh"))


def gene_xpehh(scores: DataFrame, genes: DataFrame, flank: float = 500_000.0) -> DataFrame:
    """Per gene and pair of groups the largest and the mean score of sites within ``flank`` of the gene."""
    from panmixia.operators.intervals import point_join

    wide = genes.select("gene_id", (F.col("start") - flank).alias("start"), (F.col("end") + flank).alias("end"))
    met = point_join(scores.where("xpehh is not null"), wide, pos="pos")
    return met.groupBy("gene_id", "a", "b").agg(F.max("xpehh").alias("max_xpehh"), F.avg("xpehh").alias("mean_xpehh"), F.count(F.lit(1)).alias("n_sites"))


def ihs(panel_wide: DataFrame, positions: list[float], by: str = "pop", cutoff: float = 0.05, core_sites: int = 2048, flank_sites: int = 8192) -> DataFrame:
    """by, site_idx, pos, ihh_0, ihh_1, ihs: the log ratio of integrated homozygosity around a site among the carriers of either allele.

    Not standardised: ``normalise_in_bins`` does that by frequency. Blocks as in ``integrated_homozygosity``.
    """
    both = _in_blocks(panel_wide, positions, by, core_sites, flank_sites, lambda haps, pos, core: [integrated_ehh(haps[haps[:, core] == a], pos, core, cutoff) for a in (0, 1)])
    x, y = F.get("area", F.lit(0)), F.get("area", F.lit(1))
    return both.select(by, "site_idx", "pos", x.alias("ihh_0"), y.alias("ihh_1"), F.when((x > 0) & (y > 0), F.log(x / y)).alias("ihs"))


def site_spread(panel: DataFrame, by: str = "pop") -> DataFrame:
    """a, b, site_idx, d: the chance that a haplotype of group a and another one of group b differ at a site, from allele counts alone."""
    counts = panel.groupBy(by, "site_idx").agg(F.sum("allele").cast("double").alias("c"), F.count(F.lit(1)).cast("double").alias("n"))
    x, y = counts.alias("x"), counts.alias("y")
    met = x.join(y, (F.col("x.site_idx") == F.col("y.site_idx")) & (F.col(f"x.{by}") <= F.col(f"y.{by}")))
    own = F.col(f"x.{by}") == F.col(f"y.{by}")
    within = 2 * F.col("x.c") * (F.col("x.n") - F.col("x.c")) / (F.col("x.n") * (F.col("x.n") - 1))
    between = (F.col("x.c") * (F.col("y.n") - F.col("y.c")) + F.col("y.c") * (F.col("x.n") - F.col("x.c"))) / (F.col("x.n") * F.col("y.n"))
    return met.select(F.col(f"x.{by}").alias("a"), F.col(f"y.{by}").alias("b"), "x.site_idx", F.when(own & (F.col("x.n") > 1), within).when(~own, between).alias("d"))


def group_distances(panel: DataFrame, by: str = "pop", replicates: int = 100, seed: int = 42) -> DataFrame:
    """a, b, mean, lower, upper: mean distance per site within (a = b) and between groups, with 95 percent bootstrap limits over sites.

    No pair of haplotypes is made. Draw k of replicate r is the site numbered by md5 over "seed:r:k"; a
    replicate is a sum over the sites' draws, so sites are joined with their counts, not drawn rows with sites.
    """
    spread = site_spread(panel, by)
    sites = spread.select("site_idx").distinct().withColumn("no", F.row_number().over(Window.orderBy("site_idx")) - 1)  # a number per site
    n = sites.count()
    draws = panel.sparkSession.range(replicates * n).select(F.floor(F.col("id") / max(n, 1)).alias("r"), (F.col("id") % max(n, 1)).alias("k"))
    named = F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col("k").cast("string"))
    drawn = F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long") % max(n, 1)
    times = draws.groupBy("r", drawn.alias("no")).agg(F.count(F.lit(1)).alias("times"))
    rows = spread.join(sites, "site_idx").join(times, "no").groupBy("a", "b", "r").agg((F.sum(F.col("d") * F.col("times")) / F.sum("times")).alias("m"))
    limits = rows.groupBy("a", "b").agg(F.percentile("m", 0.025).alias("lower"), F.percentile("m", 0.975).alias("upper"))
    return spread.groupBy("a", "b").agg(F.avg("d").alias("mean")).join(limits, ["a", "b"])


def integrated_ehh(haps: np.ndarray | None, pos: np.ndarray, core: int, cutoff: float) -> float:
    """Area under homozygosity on both sides of a core; classes of equal haplotypes split as sites are added."""
    if haps is None or len(haps) < 2:
        return 0.0
    total, pairs = 0.0, len(haps) * (len(haps) - 1) / 2
    for step in (-1, 1):
        label = haps[:, core].astype(np.int64)
        before = (np.bincount(label) * (np.bincount(label) - 1) / 2).sum() / pairs
        s = core + step
        while 0 <= s < len(pos) and before >= cutoff:
            _, label = np.unique(label * 2 + haps[:, s], return_inverse=True)
            n = np.bincount(label)
            now = (n * (n - 1) / 2).sum() / pairs
            total += (before + now) / 2 * abs(pos[s] - pos[s - step])
            before, s = now, s + step
    return float(total)
