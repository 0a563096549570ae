"""Decoders against plain per-pair versions."""

import inspect
import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panmixia import api
from panmixia.functions import special
from panmixia.operators import flow, gamma_filter, hmm, panel, segments, ultrametric
from panmixia.plans import queries_decode as q

NE, MU, RHO = 1e4, 1.25e-8, 1e-8
POS = [1000.0 * s + 37.0 * ((s * s) % 11) for s in range(1, 25)]


@pytest.fixture(scope="module")
def haps(spark):
    rng = np.random.default_rng(5)
    g = (rng.random((6, len(POS))) < 0.4).astype(int)
    g[3] = g[2]  # identical haplotypes
    rows = [(h, s, POS[s], int(g[h, s])) for h in range(6) for s in range(len(POS))]
    long = spark.createDataFrame(rows, "hap_id long, site_idx int, pos double, allele int")
    wide = panel.packed_wide(panel.to_wide(long))
    return g, long, panel.pair_words(wide)


def by_pair(df, column):
    out = {}
    for r in df.orderBy("i", "j", "site_idx").collect():
        out.setdefault((r["i"], r["j"]), []).append(r[column])
    return out


def plain_filter(d, pos):
    """(shape, rate) after each site: mean and variance by the laws of total expectation and variance over recombination."""
    prior = 2 * NE
    mean, variance, out = prior, prior**2, []
    for s, x in enumerate(d):
        gap = pos[s] - pos[s - 1] if s else 0.0
        moved = -math.expm1(-RHO * gap)
        variance = (1 - moved) * variance + moved * prior**2 + moved * (1 - moved) * (mean - prior) ** 2
        mean += moved * (prior - mean)
        shape, rate = mean**2 / variance + x, mean / variance + 2 * MU * gap
        out.append((shape, rate))
        mean, variance = shape / rate, shape / rate**2
    return out


def test_moment_matched_filter(haps):
    g, _, pairs = haps
    got = by_pair(gamma_filter.gamma_filter_forward(pairs, POS, NE, MU, RHO), "mean")
    assert len(got) == 15
    for (i, j), means in got.items():
        assert np.allclose(means, [a / b for a, b in plain_filter(g[i] ^ g[j], POS)], rtol=1e-9)
    strided = by_pair(gamma_filter.gamma_filter_forward(pairs, POS, NE, MU, RHO, stride=7), "mean")
    assert all(np.allclose(v, got[k][::7]) for k, v in strided.items())
    wide = gamma_filter.gamma_filter_forward(pairs, POS, NE, MU, RHO)
    assert wide.where("lower > mean or mean > upper").count() == 0
    s = {r["site_idx"]: r for r in gamma_filter.gamma_filter_site_summary(pairs, POS, NE, MU, RHO).collect()}
    assert s[4]["n_pairs"] == 15 and math.isclose(s[4]["site_mean"], np.mean([v[4] for v in got.values()])) and math.isclose(s[4]["site_max"], max(v[4] for v in got.values()))


def plain_hmm(d, pos, k):
    t, q = hmm.grid_arrays(k, NE)
    emit = lambda s: (1 - np.exp(-2 * MU * t) if d[s] else np.exp(-2 * MU * t)) * (np.exp(-2 * MU * t * (pos[s] - pos[s - 1] - 1)) if s and pos[s] - pos[s - 1] > 1 else 1)
    fs, ll = [q * emit(0)], 0.0
    for s in range(len(pos)):
        if s:
            stay = np.exp(-RHO * (pos[s] - pos[s - 1]) * t)
            move = np.diag(stay) + np.outer(1 - stay, q)
            fs.append(fs[-1] @ move * emit(s))
        ll += math.log(fs[-1].sum())
        fs[-1] = fs[-1] / fs[-1].sum()
    bs = [np.ones(k)]
    for s in range(len(pos) - 2, -1, -1):
        stay = np.exp(-RHO * (pos[s + 1] - pos[s]) * t)
        move = np.diag(stay) + np.outer(1 - stay, q)
        b = move @ (bs[0] * emit(s + 1))
        bs.insert(0, b / b.sum())
    g = np.array(fs) * np.array(bs)
    return g / g.sum(1, keepdims=True), ll


@pytest.mark.parametrize("k", [32, 64])
def test_hidden_markov_model(haps, k):
    g, _, pairs = haps
    lls = {(r["i"], r["j"]): r["loglik"] for r in hmm.hmm_log_likelihood(pairs, POS, k=k).collect()}
    means = by_pair(hmm.hmm_posterior_batched(pairs, POS, k=k), "mean")
    t, _ = hmm.grid_arrays(k, NE)
    for (i, j), ll in lls.items():
        gamma, expected = plain_hmm(g[i] ^ g[j], POS, k)
        assert math.isclose(ll, expected, rel_tol=1e-10)
        assert np.allclose(means[i, j], gamma @ t, rtol=1e-8)
    sums = hmm.hmm_posterior(pairs, POS, k=k).groupBy("i", "j", "site_idx").agg(F.sum("p").alias("s"))
    assert sums.where("abs(s - 1) > 1e-9").count() == 0


def test_grid_and_prior(spark):
    rows = hmm.time_grid(spark, 16, 5000.0).orderBy("k").collect()
    t, q = hmm.grid_arrays(16, 5000.0)
    assert np.allclose([r["t_mid"] for r in rows], t) and np.allclose([r["q"] for r in rows], q) and math.isclose(sum(r["q"] for r in rows), 1)


def test_prior_is_re_estimated(haps):
    _, _, pairs = haps
    _, prior, history, _ = hmm.adaptive_prior_infer(pairs, POS, max_iterations=6, blend_alpha=1.0)
    assert math.isclose(prior.sum(), 1) and all(b >= a - 1e-6 for a, b in zip(history, history[1:], strict=False))
    _, _, history, converged = hmm.adaptive_prior_infer(pairs, POS, convergence_tol=1.0)
    assert converged and len(history) == 2


def plain_segments(prefix, pos, penalty):
    n = len(prefix)
    cost = lambda a, b: 1e30 if pos[b] <= pos[a] else 2 * MU * (pos[b] - pos[a]) if prefix[b] == prefix[a] else (c := prefix[b] - prefix[a]) - c * math.log(c / (pos[b] - pos[a]))
    best, back = [0.0] + [math.inf] * (n - 1), [0] * n
    for s in range(1, n):
        for t in range(s):
            if best[t] + cost(t, s) + penalty < best[s]:
                best[s], back[s] = best[t] + cost(t, s) + penalty, t
    path = [n - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


def test_segmentation_equals_the_full_search():
    rng = np.random.default_rng(1)
    pos = np.arange(1, 121) * 1000.0
    x = np.concatenate([rng.random((5, 40)) < 0.9, rng.random((5, 40)) < 0.05, rng.random((5, 40)) < 0.6], axis=1)
    prefix = np.cumsum(x, axis=1)
    for penalty in (0.5, 3.0, 1e9):
        found = segments.changepoints(prefix, pos, MU, penalty)
        assert found == [plain_segments(p, pos, penalty) for p in prefix]
    assert all(f == [0, 119] for f in found)
    assert segments.changepoints(prefix[:, :1], pos[:1], MU, 1.0) == [[0]] * 5


def test_segments_of_many_pairs_take_few_logarithms(monkeypatch):
    """Costs are worked out by site, start and number of differences, not by pair; few and many sites agree with the full search."""
    asked, cost = [], segments._cost
    monkeypatch.setattr(segments, "_cost", lambda n, length, mu: asked.append(np.broadcast(n, length).size) or cost(n, length, mu))
    segments._tables.cache_clear() if hasattr(segments, "_tables") else None
    rng = np.random.default_rng(2)
    prefix = np.cumsum(rng.random((3000, 40)) < np.repeat(rng.random((3000, 4)), 10, axis=1), axis=1)
    pos = np.sort(rng.integers(1, 4000, 40).cumsum()).astype(float)
    found = segments.changepoints(prefix, pos, MU, 0.5)
    assert sum(asked) <= 40 * 40 * 41
    assert found[::100] == [plain_segments(p, pos, 0.5) for p in prefix[::100]]
    assert max(map(len, found)) > 3
    monkeypatch.setattr(segments, "TABLE_SITES", 8)
    assert segments.changepoints(prefix[:200], pos, MU, 0.5) == found[:200]


def test_pairs_of_one_segment_are_known_without_a_recursion(monkeypatch):
    """The same segments, ties and steps included, and nearly no pair of an even rate goes through all starts."""
    rng, origins, seen = np.random.default_rng(19), segments._origins, []
    pos, penalty = np.arange(1, 65) * 1000.0, math.log(64)
    monkeypatch.setattr(segments, "_origins", lambda prefix, *rest: seen.append(len(prefix)) or origins(prefix, *rest))
    step = np.where(np.arange(64) < rng.integers(0, 64, (100, 1)), 0.1, 0.7)
    rates = [np.full((1000, 64), 0.5), np.full((100, 64), 0.03), step, np.zeros((5, 64)), np.ones((5, 64)), np.arange(64)[None, :] % 2 * np.ones((5, 1))]
    found = []
    for rate in rates:
        prefix = np.cumsum(rng.random(rate.shape) < rate, axis=1, dtype=np.int64)
        found.append((prefix, len(seen), segments.changepoints(prefix, pos, MU, penalty)))
    assert sum(seen[: found[1][1]]) < 100  # of the first thousand
    monkeypatch.setattr(segments, "_whole", lambda prefix, *_: np.zeros(len(prefix), bool))
    for prefix, _, paths in found:
        assert paths == segments.changepoints(prefix, pos, MU, penalty)
        assert paths[::50] == [plain_segments(p, pos, penalty) for p in prefix[::50]]
    assert any(len(x) > 2 for x in found[2][2])


@pytest.mark.parametrize("name, column, digits", [("infer", "mean", 2), ("pelt_changepoint", "tmrca", 4)])
def test_results_are_rounded_as_their_sql_rounds(name, column, digits, spark, sf_dir, monkeypatch):
    """The multiple is rounded, not the number's text: 1.005 times 100 is less than 100.5."""
    values = [0.0, 1.005, 1.00005, 2.675, 1.125, 1.375, 0.03125, 0.00009, 12345.678949, 98765.4321, 1e12 + 0.125, *np.random.default_rng(3).uniform(0, 1e5, 500).tolist()]
    rows = spark.createDataFrame([(x,) for x in values] + [(None,), (math.nan,)], f"{column} double")
    monkeypatch.setattr(api, "infer", lambda *_, **__: rows)
    monkeypatch.setattr(segments, "pelt_changepoint", lambda *_: rows)
    got = [r[0] for r in getattr(q, name)(spark, sf_dir).collect()]
    want = [x for (x,) in duckdb.sql(f"select round(v, {digits}) from (select unnest({values}::DOUBLE[]) as v)").fetchall()]
    assert got[: len(values)] == want
    assert got[-2] is None and math.isnan(got[-1])


def test_segments_cover_the_sites(haps):
    g, _, pairs = haps
    rows = segments.pelt_changepoint(pairs, POS, MU, penalty=0.1).orderBy("i", "j", "seg_no").collect()
    for i, j in {(r["i"], r["j"]) for r in rows}:
        own = [r for r in rows if (r["i"], r["j"]) == (i, j)]
        assert own[0]["start_idx"] == 0 and own[-1]["end_idx"] == len(POS) - 1
        assert all(a["end_idx"] == b["start_idx"] for a, b in zip(own, own[1:], strict=False))
        d = np.cumsum(g[i] ^ g[j])
        assert all(r["n_mut"] == d[r["end_idx"]] - d[r["start_idx"]] for r in own)


def plain_tree(post, m, bins):
    """Pairs' bins in the greedy tree: of all unions of two clusters at all bins not below theirs, the best; then the lowest and first."""
    heights, pairs = {frozenset([i]): 0 for i in range(m)}, {}
    while len(heights) > 1:
        moves = []
        for a, b in itertools.combinations(sorted(heights, key=min), 2):
            for k in range(max(heights[a], heights[b]), bins):
                total = math.fsum(post[i, j, k] for i in a for j in b)
                moves.append(((round(total, 9), -k, -min(a), -min(b)), a, b))
        (_, k, _, _), a, b = max(moves, key=lambda move: move[0])
        pairs |= {tuple(sorted(pair)): -k for pair in itertools.product(a, b)}
        del heights[a], heights[b]
        heights[a | b] = -k
    return pairs


def test_trees_equal_the_plain_search():
    rng = np.random.default_rng(3)
    table = np.log(rng.dirichlet(np.ones(6), size=(4, 5, 5)))
    table = (table + table.transpose(0, 2, 1, 3)) / 2
    got = ultrametric.project(table.copy())
    for s in range(4):
        tree = plain_tree(table[s], 5, 6)
        assert all(got[s, i, j] == got[s, j, i] == k for (i, j), k in tree.items())
        for i, j, k in ((0, 1, 2), (1, 3, 4), (0, 2, 4)):  # of three distances the two largest agree
            d = sorted((got[s, i, j], got[s, i, k], got[s, j, k]))
            assert d[1] == d[2]


def test_messages_and_propagation(haps, spark):
    g, _, _ = haps
    q = np.full(4, 0.25)
    assert np.allclose(ultrametric.messages(np.array([2]), q, 1.0), np.eye(4)[2]) and np.allclose(ultrametric.messages(np.array([2]), q, 0.0), q)
    sets = spark.createDataFrame([(h // 3, h, g[h].tolist()) for h in range(6)] + [(9, 90, g[0].tolist())], "set_id long, hap_id long, alleles array<tinyint>")
    rows = ultrametric.ep_infer(sets, POS, max_iterations=3).collect()
    assert len(rows) == 2 * 3 * len(POS) and all(r["lower"] <= r["mean"] * 1.5 and r["n_iterations"] <= 3 for r in rows)
    once = {(r["i"], r["j"], r["site_idx"]): r["mean"] for r in ultrametric.ep_infer(sets, POS, max_iterations=1).collect()}
    t, _ = hmm.grid_arrays(32, NE)
    assert math.isclose(once[1, 0, 3], (plain_hmm(g[1] ^ g[0], POS, 32)[0] @ t)[3], rel_tol=1e-8)


def test_special_functions():
    for a, x in ((0.5, 0.3), (3.0, 2.0), (3.0, 9.0), (100.0, 95.0), (1e4, 1.01e4)):
        if a == int(a) and a <= 100:
            tail = math.fsum(math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for k in range(int(a)))
            assert math.isclose(special.gammaincc(a, np.array([x]))[0], tail, rel_tol=1e-10)
        assert math.isclose(special.gammainc(a, np.array([x]))[0] + special.gammaincc(a, np.array([x]))[0], 1, rel_tol=1e-12)
        p = special.gammainc(a, np.array([x]))[0]
        assert math.isclose(special.gammaincinv(a, p), x, rel_tol=1e-6)
    assert math.isclose(special.gammainc(0.5, np.array([0.3]))[0], math.erf(math.sqrt(0.3)), rel_tol=1e-12)
    assert math.isclose(float(special.digamma(1.0)), -0.5772156649015329, rel_tol=1e-10)
    assert math.isclose(special.scaled_kummer(1.0, np.array([2.0]))[0], (1 - math.exp(-2)) / 2, rel_tol=1e-12)


@pytest.fixture(scope="module")
def field():
    """A smooth field that pulls states towards the prior."""
    m, c = np.meshgrid(np.linspace(flow.M_LO, flow.M_HI, flow.M_N), np.linspace(flow.C_LO, flow.C_HI, flow.C_N), indexing="ij")
    return flow.FlowField(-0.3 * m, -0.2 * c)


def test_bilinear_edges():
    table = np.arange(flow.M_N * flow.C_N, dtype=float).reshape(flow.M_N, flow.C_N)
    assert flow.bilinear(table, np.array([flow.M_HI]), np.array([flow.C_HI]))[0] == pytest.approx(table[-1, -1])
    assert flow.bilinear(table, np.array([-99.0]), np.array([-99.0]))[0] == table[0, 0]
    step = (flow.M_HI - flow.M_LO) / (flow.M_N - 1)
    assert math.isclose(flow.bilinear(table, np.array([flow.M_LO + step / 2]), np.array([flow.C_LO]))[0], (table[0, 0] + table[1, 0]) / 2)


def test_flow_passes_against_unit_steps(field, monkeypatch):
    """Short segments, without the entropy limit's step at mean 1: tables give nearly what unit steps give."""
    monkeypatch.setattr(flow, "_LIMIT", [np.zeros(5001)])
    pos = np.cumsum([3.0, 1.0, 4.0, 2.0, 6.0])
    rho, mu = 4 * NE * RHO, 4 * NE * MU
    x = np.array([[0, 1, 0, 0, 1], [1, 1, 0, 1, 0]])
    m, c = flow.Decoder(flow.FlowCache(field, rho, mu), NE, pos).forward(x)
    for p in range(2):
        sm = sc = np.zeros(1)
        for s, n in enumerate(flow.segment_lengths(pos).tolist()):
            for u in range(n):
                if u:
                    sm, sc = flow._emit(sm, sc, mu, 0)
                sm, sc = field.recombine(sm, sc, rho)
            sm, sc = flow.clipped(*flow._emit(sm, sc, mu, x[p, s]))
            assert abs(m[s, p] - sm[0]) < 0.02 and abs(c[s, p] - sc[0]) < 0.02


def test_steps_agree_with_tables(haps, field, monkeypatch):
    """Without the entropy limit, which only tables have."""
    monkeypatch.setattr(flow, "_LIMIT", [np.zeros(5001)])
    g, _, _ = haps
    x, pos = np.array([g[i] ^ g[j] for i, j in ((1, 0), (4, 2), (3, 2))]), np.array(POS)
    rho, mu = 4 * NE * RHO, 4 * NE * MU
    a = flow.Decoder(flow.FlowCache(field, rho, mu), NE, pos).posterior(x)["mean"]
    b = flow.Decoder(flow.StepCache(field, rho, mu), NE, pos).posterior(x)["mean"]
    assert np.median(np.abs(np.log(a / b))) < 0.1


def test_long_segments_are_made_of_parts(field):
    rho, mu = 4 * NE * RHO, 4 * NE * MU
    cache = flow.FlowCache(field, rho, mu, steps=10).prepare({7, 25, 30})
    assert set(cache.stretch) == {5, 7, 10}
    m, c = np.array([0.1]), np.array([-0.4])
    a = cache.advance(m, c, 25, np.array([1]))
    b = m, c
    for _ in range(2):
        b = flow.FlowCache._look(cache.stretch[10], *b)
    b = cache._site(cache.forward, 5, np.array([1]), *b)
    assert np.allclose(a, b)


def test_blocks(haps, field):
    _, _, pairs = haps
    context = flow.FlowContext(POS, field)
    full = by_pair(context.run_fb(pairs), "mean")
    single = by_pair(context.run_fb_blockwise(pairs, len(POS), 0), "mean")
    assert all(np.allclose(full[k], single[k]) for k in full)
    several = context.run_fb_blockwise(pairs, 8, 12)
    got = by_pair(several, "mean")
    assert all(len(v) == len(POS) for v in got.values()) and np.median([abs(math.log(a / b)) for k in full for a, b in zip(full[k], got[k], strict=True)]) < 0.2
    with pytest.raises(ValueError):
        context.run_fb_blockwise(pairs, 8, 0)
    assert flow.block_windows(10, 4, 3) == [(0, 0, 4, 0, 7), (1, 4, 8, 1, 10), (2, 8, 10, 5, 10)]


def test_summary_and_merge(haps, field):
    _, _, pairs = haps
    context = flow.FlowContext(POS, field)
    means = by_pair(context.run_fb(pairs), "mean")
    whole = {r["site_idx"]: r for r in context.run_fb_summary(pairs).collect()}
    parts = context.run_fb_summary(pairs.where("i < 4")).unionByName(context.run_fb_summary(pairs.where("i >= 4")))
    merged = {r["site_idx"]: r for r in flow.merge_summaries(parts).collect()}
    for s in range(len(POS)):
        assert math.isclose(whole[s]["site_mean"], np.mean([v[s] for v in means.values()]), rel_tol=1e-9)
        assert math.isclose(merged[s]["site_mean"], whole[s]["site_mean"], rel_tol=1e-9) and merged[s]["site_min"] == whole[s]["site_min"]


def test_constant_demography_gives_the_constant_field():
    d = flow.Sizes.of([NE] * 3, [0, 1e4, 5e4, 1e6], NE)
    for mean, cv in ((0.01, 0.3), (1.0, 0.5), (0.5, 0.9), (1e-5, 0.01), (100.0, 1.0)):
        assert np.allclose(flow.flow_at(mean, cv, 500), flow.flow_at(mean, cv, 500, d), rtol=1e-7)
        assert np.allclose(flow.flow_at(mean, cv, 500), flow.flow_at(mean, cv, 1000), rtol=1e-5)


@pytest.mark.parametrize("rates", [[1.0], [0.5, 10.0, 0.2], [0.01, 30.0, 5.0]])
def test_flow_against_sums_over_a_fine_grid(rates):
    """The definition by running sums over half a million times; rates above b would tilt the density's integral the other way."""
    sizes = flow.Sizes(np.array([0.0, 0.25, 1.0])[: len(rates)], np.array(rates))
    for mean, cv in ((0.5, 0.5), (1.0, 0.9), (0.2, 0.2)):
        a = cv**-2
        b = a / mean
        t = np.linspace(0, mean * (1 + 25 * cv), 500_001)[1:]
        step = t[0]
        f = np.exp(a * math.log(b) - math.lgamma(a) + (a - 1) * np.log(t) - b * t)
        edges = np.append(sizes.starts[1:], np.inf)
        total = sum(r * (np.clip(t, lo, hi) - lo) for r, lo, hi in zip(sizes.rates, sizes.starts, edges, strict=True))
        # what has come from earlier times, in stretches short enough for the exponential
        earlier, level = np.zeros_like(t), 0.0
        for k in range(0, len(t), 1000):
            own = slice(k, k + 1000)
            lift = total[own] - total[k]
            got = (f * -np.expm1(-2 * total))[own] * np.exp(lift) * step
            earlier[own] = np.exp(-lift) * (level * np.exp(-(total[k] - (total[k - 1] if k else 0.0))) + np.cumsum(got) - got / 2)
            level = earlier[own][-1] + got[-1] / 2 * np.exp(-lift[-1])
        moved = -np.expm1(-2 * total)
        change = earlier + moved * (1 - (np.cumsum(f) - f / 2) * step) - (total + moved / 2) * f
        rate, shape = f * (a - b * t), f * a * (np.log(b * t) - float(special.digamma(a)))
        u, v = np.linalg.lstsq(np.column_stack([-rate, -2 * (shape + rate)]) * math.log(10), change, rcond=None)[0] * math.log(10) ** 2 / 5.302
        assert np.allclose(flow.flow_at(mean, cv, 500, sizes), (u, v), rtol=2e-3, atol=1e-5)


def test_recommended_blocks():
    assert flow.recommend_core_block_size(5000, 0, 1 << 30) == 5000
    assert flow.recommend_core_block_size(10**6, 10_000, 1 << 34) == 32768
    assert flow.recommend_core_block_size(10**6, 10**6, 1 << 30) == 1024
    assert flow.recommend_core_block_size(2000, 1, 1 << 34) == 2000


def test_infer_ignores_monomorphic_sites(haps, spark, field):
    _, long, _ = haps
    extra = long.select("hap_id", (F.col("site_idx") + 100).alias("site_idx"), (F.col("pos") + 5e5).alias("pos"), F.lit(1).alias("allele"))
    a = by_pair(api.infer(long, flow=field), "mean")
    b = by_pair(api.infer(long.unionByName(extra), flow=field, auto_estimate_theta=False, mu=MU), "mean")
    c = by_pair(api.infer(long, flow=field, auto_estimate_theta=False, mu=MU), "mean")
    assert b == c and a != c
    e = api.CoalescenceEstimator(long)
    assert e.sfs().count() == 7 and e.infer_tmrca().count() == 15 * len(POS) and e.pairs(3).count() == 3
    with pytest.raises(ValueError):
        api._sites(long.withColumn("pos", F.col("pos") + F.col("hap_id")))


def test_queries_do_not_work_less_than_the_operators(monkeypatch):
    def default(f, name):
        return inspect.signature(f).parameters[name].default

    assert default(api.default_flow_field, "n_steps") == default(flow.generate_flow_field, "n_steps") == 500

    class Called(Exception):
        pass

    def caught(owner, name):
        def stop(*_, **options):
            raise Called(options)
        monkeypatch.setattr(owner, name, stop)

    for name in ("phases", "_sets"):
        monkeypatch.setattr(q, name, lambda *_: None)
    monkeypatch.setattr(api, "default_flow_field", lambda *_: None)
    for owner, name, run in ((hmm, "adaptive_prior_infer", q.adaptive_prior_infer), (ultrametric, "ep_infer", q.ep_infer), (flow, "DemographicFlowContext", q.demographic_flow)):
        caught(owner, name)
        with pytest.raises(Called) as said:
            run(None, None)
        assert not said.value.args[0]


def test_lead_accumulators_are_those_of_pair_means(spark):
    from panmixia.operators import fold, gamma_filter, genes, panel

    rng = np.random.default_rng(11)
    rows = [(i, None if i % 4 == 3 else int(i % 3), rng.integers(0, 2, 40).tolist()) for i in range(36)]
    haps = panel.packed_wide(spark.createDataFrame(rows, "hap_id long, pop int, alleles array<int>")).drop("alleles")
    pairs, pos, leads = panel.pair_words(haps, "pop"), [700.0 * (k + 1) for k in range(40)], [(4, 3000.0), (5, 15000.0), (6, 28000.0)]
    f = gamma_filter.Filter(1.25e-8, 1e-8, 1e4)
    sent = genes.lead_pair_accumulators(pairs, pos, leads, 5000.0, f.forward_means, 8, "pop")
    plain = genes.accumulate(genes.lead_pair_means(pairs, pos, leads, 5000.0, f.forward_kernel, 8, ("pop",)), "lead", "pop")
    a, z = ({(r["lead"], r["pop"]): r for r in df.collect()} for df in (sent, plain))
    assert a.keys() == z.keys() and len(a) == 9
    for k, r in a.items():
        assert r["hist"] == z[k]["hist"] and r["count"] == z[k]["count"]
        assert np.allclose([r[c] for c in ("lin_sum", "log_sum", "log_sq_sum", "min_lin", "min_log")], [z[k][c] for c in ("lin_sum", "log_sum", "log_sq_sum", "min_lin", "min_log")], rtol=1e-12)
    assert genes.lead_pair_accumulators(pairs, pos, leads, 5000.0, f.forward_means, 50, "pop").count() == 0
