"""Edge cases of panels, intervals, ranks and texts."""

from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from panmixia.functions.columns import pair_index, pair_members, rank_pct
from panmixia.operators import diversity, genes, intervals, panel, selection, testing
from panmixia.sources import tables, vcf


def long(spark, g, pos=None):
    pos = pos or [10.0 * (s + 1) for s in range(len(g[0]))]
    return spark.createDataFrame([(h, s, pos[s], a) for h, row in enumerate(g) for s, a in enumerate(row)], "hap_id long, site_idx int, pos double, allele int")


@pytest.mark.parametrize("sites", [1, 63, 64, 65, 128, 150])
def test_packing_round_trip_and_counts(spark, sites):
    g = (np.random.default_rng(sites).random((4, sites)) < 0.5).astype(int).tolist()
    p = long(spark, g)
    back = panel.unpack(panel.bitpack(p), sites)
    assert sorted(map(tuple, back.collect())) == sorted((h, s, g[h][s]) for h in range(4) for s in range(sites))
    packed = panel.packed_wide(panel.to_wide(p))
    words = {(r["hap_id"], i): w for r in packed.collect() for i, w in enumerate(r["words"])}
    assert words == {(r["hap_id"], r["word_idx"]): r["word"] for r in panel.bitpack(p).collect()}
    pairs = panel.explicit_pairs(spark.createDataFrame([(2, 0), (0, 2), (3, 3)], "i long, j long"), packed)
    scan = {}
    for r in panel.prefix_scan(pairs).orderBy("site_idx").collect():
        scan.setdefault((r["i"], r["j"]), []).append(r["n_diff"])
    d = np.cumsum(np.array(g[2]) ^ np.array(g[0])).tolist()
    assert scan == {(2, 0): d, (0, 2): d, (3, 3): [0] * sites}
    assert {r["h"] for r in pairs.where("i <> j").select(panel.hamming(F.col("xor")).alias("h")).collect()} == {d[-1]}


@pytest.mark.parametrize("sites", [1, 4, 64, 70, 150])
def test_site_counts_are_expressions(spark, sites):
    """Running and windowed counts of panels of any number of words, with no Python on the executors and no job of their own."""
    g = np.random.default_rng(sites).random((4, sites)) < 0.5
    pairs = panel.pair_words(panel.packed_wide(panel.to_wide(long(spark, g.astype(int).tolist()))))
    tracker = spark.sparkContext.statusTracker()
    jobs = len(tracker.getJobIdsForGroup(None))
    scans = {0: panel.prefix_scan(pairs)} | {w: diversity.windowed_divergence(pairs, w, sites) for w in (1, 5, 200)}
    assert len(tracker.getJobIdsForGroup(None)) == jobs
    for w, df in scans.items():
        assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("MapInArrow", "Python"))
        assert df.dtypes == [("i", "bigint"), ("j", "bigint"), ("site_idx", "int"), ("n_diff", "bigint")]
        found = {(r["i"], r["j"], r["site_idx"]): r["n_diff"] for r in df.collect()}
        assert df.count() == len(found) == 6 * sites
        for (i, j, s), n in found.items():
            first = max(s - w + 1, 0) if w else 0
            assert n == (g[i] ^ g[j])[first : s + w + 1].sum()


def test_pair_index_is_a_bijection(spark):
    n = 300
    df = spark.range(n * (n - 1) // 2)
    i, j = pair_members(F.col("id"))
    back = df.select("id", i.alias("i"), j.alias("j")).withColumn("again", pair_index(F.col("i"), F.col("j")))
    assert back.where("again <> id or j >= i or j < 0").count() == 0
    big = spark.createDataFrame([(10**9 * (10**9 - 1) // 2 + k,) for k in (-1, 0, 1)], "id long")
    assert big.select(pair_index(*pair_members(F.col("id"))).alias("x"), "id").where("x <> id").count() == 0


def test_pair_index_is_exact_beyond_doubles(spark):
    ids = [(i, j) for i in (134_217_731, 300_000_003, 1_000_000_007, 3_000_000_019) for j in (0, 1, 77_777_777, i - 1)]
    pairs = spark.createDataFrame(ids, "i long, j long").withColumn("id", pair_index(F.col("i"), F.col("j")))
    back = pair_members(F.col("id"))
    assert [tuple(r) for r in pairs.select("i", "j", "id", *back).collect()] == [(i, j, i * (i - 1) // 2 + j, i, j) for i, j in ids]


@pytest.mark.parametrize("sites, most", [(64, 64), (70, 66), (150, 100)])
def test_site_counts_take_a_words_bits(spark, sites, most):
    """Windows to both sides of where words no longer suffice, sites cut off, and no array read for a site."""
    g = np.random.default_rng(sites).random((3, sites)) < 0.5
    pairs = panel.pair_words(panel.packed_wide(panel.to_wide(long(spark, g.astype(int).tolist()))))
    scans = {0: panel.prefix_scan(pairs)} | {w: diversity.windowed_divergence(pairs, w, most) for w in (5, 31, 32)}
    for w, df in scans.items():
        if w < 32:
            assert "xor" not in df._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
        found = {(r["i"], r["j"], r["site_idx"]): r["n_diff"] for r in df.collect()}
        last = most if w else sites
        assert len(found) == 3 * last
        for (i, j, s), n in found.items():
            assert n == (g[i] ^ g[j])[max(s - w + 1, 0) if w else 0 : min(s + w + 1, last)].sum()


def test_theta_golden_values(spark):
    a = diversity.estimate_theta(long(spark, [[0, 0, 1, 1], [0, 1, 1, 1], [0, 0, 0, 1], [1, 0, 0, 1]], [10.0, 20.0, 30.0, 40.0]), 2e-8, 5e-8, 1e4).first()
    assert a["mu_eff"] * 4e4 == pytest.approx(1 / 41) and a["rho_eff"] * 4e4 == pytest.approx(2.5 / 41)
    b = diversity.estimate_theta(long(spark, [[0, 1], [1, 1], [0, 0], [0, 1]], [100.0, 200.0]), 2e-8, 5e-8, 1e4).first()
    assert b["mu_eff"] * 4e4 == pytest.approx(1 / 201)
    same = diversity.estimate_theta(long(spark, [[1, 1], [1, 1]]), 2e-8, 5e-8, 1e4).first()
    odd = diversity.estimate_theta(long(spark, [[1, 0], [0, 1], [0, 0]]), 2e-8, 5e-8, 1e4).first()
    assert (same["mu_eff"], same["rho_eff"]) == (odd["mu_eff"], odd["rho_eff"]) == (2e-8, 5e-8)


def test_spectrum_of_constant_panels(spark):
    zeros = {r["ac"]: r["n_sites"] for r in diversity.compute_sfs(long(spark, [[0] * 5] * 3)).collect()}
    assert zeros == {0: 5, 1: 0, 2: 0, 3: 0}
    assert panel.filter_segregating(long(spark, [[0, 1, 0], [0, 1, 1]])).select("site_idx").distinct().count() == 1


def test_small_populations_are_left_out(spark):
    samples = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b")], "sample_no long, pop string")
    p = long(spark, [[0, 1]] * 6)
    assert panel.subset_population(p, samples, "pop", "a").count() == 0
    assert panel.subset_population(p, samples, "pop", "b").count() == 8
    assert panel.subset_population(p, samples, "pop", "a", complement=True).count() == 8


def test_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 1.0), ("d", None)], "k string, v double")
    assert {r["k"]: r["r"] for r in df.withColumn("r", rank_pct("v")).collect()} == {"a": 1.0, "b": 0.5, "c": 0.5, "d": None}
    assert {r["k"]: r["r"] for r in df.withColumn("r", rank_pct("v", ascending=False, nulls_bottom=True)).collect()} == {"a": 0.25, "b": 0.625, "c": 0.625, "d": 1.0}


def test_statistics_from_accumulators(spark):
    rows = spark.createDataFrame([(1, 1, 1.0 * v) for v in (5, 20, 1e3, 1e3, 9e6)], "gene long, pop long, value double")
    r = genes.accumulate(genes.from_values(rows), "gene", "pop").select("*", genes.statistic("p50").alias("p50"), genes.statistic("frac_below_1000000").alias("f"), genes.statistic("min").alias("least")).first()
    assert r["hist"][0] == 1 and r["hist"][-1] == 1 and sum(r["hist"]) == 5 and r["least"] == 5.0
    assert 900 < r["p50"] < 1200 and r["f"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        genes.statistic("mode")


def test_masks_merged_or_not(spark):
    g = spark.createDataFrame([(1, "x", 0.0, 100.0), (2, "y", 1000.0, 1100.0)], "gene_id long, gene_name string, start double, end double")
    m = spark.createDataFrame([(0.0, 40.0), (10.0, 40.0)], "m_start double, m_end double")
    once = {r["gene_id"]: r["fraction"] for r in intervals.mask_flags(g, m, merge=True).collect()}
    twice = {r["gene_id"]: r["masked"] for r in intervals.mask_flags(g, m).collect()}
    assert once == {1: pytest.approx(0.4), 2: 0.0} and twice == {1: True, 2: False}


def test_interpolation_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.sort(rng.choice(5000, 60, replace=False)).astype(float)
    y, at = rng.random(60), np.unique(np.concatenate([rng.choice(6000, 200) - 300.0, x[:5]]))
    source = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "pos double, value double")
    got = dict(map(tuple, intervals.interpolate(spark.createDataFrame([(v,) for v in at.tolist()], "pos double"), source, chunk=97.0).collect()))
    assert np.allclose([got[v] for v in at.tolist()], np.interp(at, x, y))


def test_fdr_and_effective_numbers(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, None]
    df = spark.createDataFrame(list(enumerate(p)), "k int, p double")
    q = {r["k"]: r["q"] for r in testing.bh_fdr(df).collect()}
    assert [q[i] for i in range(5)] == pytest.approx([0.025, 0.05, 0.05, 0.025, 0.5]) and q[5] is None
    assert testing.galwey_neff(np.eye(4)) == pytest.approx(4) and testing.galwey_neff(np.ones((4, 4))) == pytest.approx(1)


def test_haplotype_statistics_of_one_haplotype(spark):
    p = long(spark, [[0, 1, 0, 1]] * 3).withColumn("pop", F.lit(1))
    w = selection.h_statistics(selection.haplotype_windows(selection.number_sites(p, drop_monomorphic=False), 4, 2))
    assert [(r["h12"], r["h2h1"]) for r in w.collect()] == [(1.0, 0.0)]


def test_homozygosity_integral():
    haps = np.array([[0, 0, 0], [0, 0, 1], [1, 0, 0], [1, 0, 0]])
    # at the core all agree; to the left pairs (0,1) and (2,3), to the right (0,2), (0,3), (2,3)
    assert selection.integrated_ehh(haps, np.array([0.0, 10.0, 20.0]), 1, 0.0) == pytest.approx((1 + 2 / 6) / 2 * 10 + (1 + 3 / 6) / 2 * 10)
    assert selection.integrated_ehh(None, np.array([0.0]), 0, 0.05) == 0.0


def test_texts(spark):
    lines = spark.createDataFrame([("##x",), ("#CHROM\tPOS\tID\tREF\tALT\tQ\tF\tI\tFORMAT\tS1\tS2",), ("1\t5\t.\tA\tT\t.\t.\t.\tGT:DP\t0|1:3\t./1",), ("",)], "value string")
    assert [r["allele"] for r in vcf.read_haplotypes(lines).orderBy("hap_id").collect()] == [0, 1, -1, 1]
    assert [tuple(r) for r in vcf.sample_names(lines).collect()] == [(0, "S1"), (1, "S2")]
    empty = genes.accumulate(genes.from_values(spark.createDataFrame([(1, 1, float("nan"))], "gene long, pop long, value double")), "gene", "pop")
    assert tables.gene_csv(empty).first()["arith_mean_tmrca"] == ""


def test_streamed_accumulators_survive_a_half_written_batch(spark, tmp_path):
    import os
    import shutil

    from panmixia.streaming import accumulators

    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    for k in range(4):
        spark.createDataFrame([(1, 2.0 + k), (2, 5.0)], "gene long, value double").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("gene long, value double").parquet(source)
        accumulators.run_available(stream, out, checkpoint, "gene").awaitTermination()
        assert {r["gene"]: r["count"] for r in accumulators.latest(spark, out).collect()} == {1: k + 1, 2: k + 1}
    batches = sorted(d for d in os.listdir(out) if d.startswith("batch="))
    assert len(batches) == 2
    shutil.copytree(f"{out}/{batches[-1]}", f"{out}/batch=99")
    os.remove(f"{out}/batch=99/_SUCCESS")
    assert accumulators.latest(spark, out).count() == 2 and accumulators._batches(spark, out)[0][-1] == 3


def test_smallest_hashes_of_groups_leave_a_task():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = [(None if g == 3 else int(g), int(i), int(i) - 1, f"{k:04x}") for g, i, k in zip(rng.integers(0, 4, 6000), rng.integers(1, 50, 6000), rng.integers(0, 900, 6000), strict=True)]
    rows += [(9, 2, 1, "0001")] * 3 + [(8, 7, 5, "ffff")]
    names = ["pop", "i", "j", "__key"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) if k else pa.array(c, pa.int64()) for k, c in enumerate(zip(*rows[at : at + 250], strict=True))], names=names) for at in range(0, len(rows), 250)]
    got = [tuple(r[c] for c in names) for b in panel._smallest(5, ("pop",), most=700)(iter(batches)) for r in b.to_pylist()]
    groups = {r[0] for r in rows}
    expected = [r for g in groups for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[3], r[1], r[2]))[:5]]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert list(panel._smallest(5, ("pop",))(iter([]))) == []


def test_sorted_pairs_of_small_and_shared_groups(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (5, "a"), (3, "b"), (4, "b"), (7, "c"), (2, "c"), (1, "c"), (None, "a"), (6, None), (8, None)]
    haps = spark.createDataFrame(rows, "hap_id long, pop string")
    got = [tuple(r) for r in panel.sorted_pairs(haps, "pop", least=3).collect()]
    assert got == [(2, 1), (5, 1), (5, 2), (7, 1), (7, 2)]
    assert [tuple(r) for r in panel.sorted_pairs(haps.where("pop = 'a'"), "pop").collect()] == [(2, 1), (5, 1), (5, 2)]


def test_sorted_unique_pairs_leaves_out_groups_below_four(spark, tmp_path):
    from panmixia.plans.registry import QUERIES

    rows = [(i, 0 if i < 4 else 1, [1.0] * 64) for i in range(7)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in QUERIES["sorted_unique_pairs"](spark, str(tmp_path)).collect()] == [(i, j) for i in range(4) for j in range(i)]


def test_pairs_leave_in_runs_that_parquet_repeats(spark, tmp_path):
    n = 5000
    panel.pairs(spark.range(n).toDF("hap_id")).write.parquet(str(tmp_path / "pairs"))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "pairs").glob("*.parquet")]
    assert sum(m.num_rows for m in files) == n * (n - 1) // 2
    stored = {c: sum(m.row_group(g).column(c).total_compressed_size for m in files for g in range(m.num_row_groups)) for c in (0, 1)}
    assert stored[0] + stored[1] < 0.3 * n * (n - 1) // 2


@pytest.mark.parametrize("within", [(), ("pop",)])
def test_pairs_of_odd_numbers(spark, within):
    """Repeated, missing, negative and far numbers, more than a run of them in a block, and missing groups."""
    haps = [(h, "ab"[h % 3 % 2]) for h in range(0, 8 * (panel.RUN + 40), 4)]
    haps += [(8, "a"), (8, "a"), (None, "a"), (-5, "b"), (-5, "b"), (10**15, "a"), (7, None), (9, None)]
    df = spark.createDataFrame(haps, "hap_id long, pop string")
    want = Counter((x, y) for x, p in haps for y, q in haps if x is not None and y is not None and x > y and (not within or p == q and p is not None))
    assert Counter((r["i"], r["j"]) for r in panel.pairs(df, *within).collect()) == want
    assert Counter((r["j"], r["i"]) for r in panel.pairs(df, *within, ordered="i<j").collect()) == want
