"""Projection of pairwise posteriors on trees, and expectation propagation with it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from panmixia.operators.hmm import Model


def project(log_post: np.ndarray) -> np.ndarray:
    """Merge bins (sites, m, m) of the greedy tree that maximises the summed log posteriors (sites, m, m, K).

    All sites go through their m - 1 merges together. Scores of clusters are sums over the pairs across
    them, so a merge adds two rows of the score table. A merge's bin is at least those inside both
    clusters; of equal scores the lowest bin counts, then the first clusters.
    """
    sites, m, _, bins = log_post.shape
    score = np.where(np.isfinite(log_post), log_post, -1e30)
    upper = np.triu(np.ones((m, m), bool), 1)
    active = np.ones((sites, m), bool)
    floor = np.zeros((sites, m), int)
    label = np.tile(np.arange(m), (sites, 1))
    out = np.full((sites, m, m), -1)
    every, k_index = np.arange(sites), np.arange(bins)
    for _ in range(m - 1):
        open_ = upper & active[:, :, None] & active[:, None, :]
        least = np.maximum(floor[:, :, None], floor[:, None, :])
        ok = open_[..., None] & (k_index >= least[..., None])
        flat = np.where(ok, score, -np.inf).transpose(0, 3, 1, 2).reshape(sites, -1)
        pick = flat.argmax(1)
        k, ab = pick // (m * m), pick % (m * m)
        a, b = ab // m, ab % m
        in_a, in_b = label == a[:, None], label == b[:, None]
        across = in_a[:, :, None] & in_b[:, None, :]
        across |= across.transpose(0, 2, 1)
        out = np.where(across, k[:, None, None], out)
        score[every, a] += score[every, b]
        score[every, :, a] = score[every, a]
        label = np.where(in_b, a[:, None], label)
        active[every, b] = False
        floor[every, a] = k
    return out


def messages(assigned: np.ndarray, prior: np.ndarray, damping: float = 0.5) -> np.ndarray:
    """damping * (the assigned bin) + (1 - damping) * prior."""
    return damping * np.eye(len(prior))[assigned] + (1 - damping) * prior


def _square(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i > j of m haplotypes in the order of their linear index."""
    return np.array([(i, j) for i in range(m) for j in range(i)], int).reshape(-1, 2).T


def propagate(haps: np.ndarray, pos: np.ndarray, model: Model, iterations: int = 5, damping: float = 0.5, tol: float = 0.01) -> tuple[np.ndarray, np.ndarray, bool, int]:
    """(posteriors, log-likelihoods, converged, rounds) of all pairs of a set of haplotypes.

    Rounds of forward-backward with messages, tree projection per site, and messages over prior, held
    between 0.1 and 10, until they change by less than the tolerance; the last round projects nothing.
    """
    i, j = _square(len(haps))
    x = haps[i] ^ haps[j]
    msg = np.ones((len(x), len(pos), len(model.t)))
    converged, gamma, ll, n = False, None, None, 0
    for n in range(1, iterations + 1):
        gamma, ll = model.passes(x, pos, msg)
        if n == iterations:
            break
        table = np.zeros((len(pos), len(haps), len(haps), len(model.t)))
        with np.errstate(divide="ignore"):
            table[:, i, j] = np.log(gamma).transpose(1, 0, 2)
        table[:, j, i] = table[:, i, j]
        assigned = project(table)[:, i, j].T
        factor = np.where(model.q > 1e-10, messages(assigned, model.q, damping) / np.maximum(model.q, 1e-300), 1.0)
        new = np.clip(factor, 0.1, 10.0)
        change, msg = np.abs(new - msg).max(), new
        if change < tol:
            converged = True
            break
    return gamma, ll, converged, n


def _trees(names_i: np.ndarray, names_j: np.ndarray, log_post: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bins by sites) of all pairs of a set, from log posteriors (pairs, sites, bins)."""
    names = np.unique(np.concatenate([names_i, names_j]))
    a, b = np.searchsorted(names, names_i), np.searchsorted(names, names_j)
    table = np.full((log_post.shape[1], len(names), len(names), log_post.shape[2]), -1e30)
    table[:, a, b] = table[:, b, a] = log_post.transpose(1, 0, 2)
    i, j = _square(len(names))
    return names[i], names[j], project(table)[:, i, j].T


def ultrametric_project(pairs_xor: DataFrame, positions: list[float], **model) -> DataFrame:
    """set_id, site_idx, i, j, k: the bin of each pair in the trees of its set, from all pairs of small sets (set_id, i, j, xor).

    A set's posteriors and trees are one task's work: what is shuffled are packed differences, a row per
    pair, not posteriors of sites and bins.
    """
    pos = np.asarray(positions, float)
    hmm = Model(**model)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        words = np.ascontiguousarray(np.stack(pdf["xor"].to_numpy()).astype(np.int64))
        x = np.unpackbits(words.view(np.uint8).reshape(len(pdf), -1), axis=1, bitorder="little")[:, : len(pos)]
        with np.errstate(divide="ignore"):
            i, j, bins = _trees(pdf["i"].to_numpy(), pdf["j"].to_numpy(), np.log(hmm.passes(x, pos)[0]))
        sites = len(pos)
        return pd.DataFrame({"set_id": pdf["set_id"].iloc[0], "site_idx": np.tile(np.arange(sites, dtype=np.int32), len(i)), "i": np.repeat(i, sites), "j": np.repeat(j, sites), "k": bins.ravel()})

    return pairs_xor.select("set_id", "i", "j", "xor").groupBy("set_id").applyInPandas(one, "set_id long, site_idx int, i long, j long, k int")


def ep_infer(haps: DataFrame, positions: list[float], max_iterations: int = 5, damping: float = 0.5, tol: float = 0.01, **model) -> DataFrame:
    """set_id, i, j, site_idx, mean, lower, upper, loglik, converged, n_iterations for sets of haplotypes (set_id, hap_id, alleles).

    A set is small by the method's own nature (its trees cost the cube of it), so all rounds of one
    set run in one task without regrouping, and sets run in parallel.
    """
    pos = np.asarray(positions, float)
    hmm = Model(**model)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hap_id")
        names = pdf["hap_id"].to_numpy()
        i, j = _square(len(names))
        if not len(i):
            return pd.DataFrame({c: [] for c in ("set_id", "i", "j", "site_idx", "mean", "lower", "upper", "loglik", "converged", "n_iterations")})
        gamma, ll, converged, n = propagate(np.stack(pdf["alleles"]).astype(np.int8), pos, hmm, max_iterations, damping, tol)
        s = hmm.summaries(gamma)
        sites = len(pos)
        return pd.DataFrame({
            "set_id": pdf["set_id"].iloc[0], "i": np.repeat(names[i], sites), "j": np.repeat(names[j], sites), "site_idx": np.tile(np.arange(sites), len(i)),
            **{c: v.ravel() for c, v in s.items()}, "loglik": np.repeat(ll, sites), "converged": converged, "n_iterations": n,
        })

    return haps.groupBy("set_id").applyInPandas(one, "set_id long, i long, j long, site_idx int, mean double, lower double, upper double, loglik double, converged boolean, n_iterations int")
