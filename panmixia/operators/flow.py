"""Flow-field filter: Gamma states move on a grid of (log10 mean, log10 coefficient of variation).

A field gives the direction in which recombination moves a state. Tables of many unit steps are
compounded from it, so a segment of any length is one or a few bilinear lookups. Fields, tables and
positions go to the tasks as they are; pairs are folded in batches.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panmixia.functions.special import digamma, gammaln
from panmixia.operators import fold
from panmixia.operators.panel import sample_pairs

# Fixed values of the grid: rows by log10 mean, columns by log10 cv; the field's unit; the entropy limit's table.
M_LO, M_HI, M_N = -5.0, 2.0, 51
C_LO, C_HI, C_N = -2.0, 0.0, 50
# moves are in units of log10 squared, with the rounding that published fields have
UNIT = math.log(10) ** 2 / 5.302
ENTROPY_TOP, ENTROPY_STEP = 4.0, 0.0008
CACHE_STEPS, FLANK = 1000, 2048


def bilinear(table: np.ndarray, m: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Values between grid points; beyond an edge the edge counts, and at the upper one the last cell carries it."""
    rows, columns = table.shape
    fm = np.clip((m - M_LO) / ((M_HI - M_LO) / (M_N - 1)), 0, rows - 1)
    fc = np.clip((c - C_LO) / ((C_HI - C_LO) / (C_N - 1)), 0, columns - 1)
    i, j = np.minimum(fm.astype(int), rows - 2), np.minimum(fc.astype(int), columns - 2)
    wm, wc = fm - i, fc - j
    top = table[i, j] * (1 - wc) + table[i, j + 1] * wc
    return top * (1 - wm) + (table[i + 1, j] * (1 - wc) + table[i + 1, j + 1] * wc) * wm


def _entropy(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    a = 10.0 ** (-2 * c)
    return a - np.log(a / 10.0**m) + gammaln(a) + (1 - a) * digamma(a)


def _entropy_limit() -> np.ndarray:
    """Largest log10 cv of entropy 1 at most, by bisection, for means from 1 to 10^4."""
    m = np.arange(round(ENTROPY_TOP / ENTROPY_STEP) + 1) * ENTROPY_STEP
    lo, hi = np.full(len(m), C_LO), np.full(len(m), C_HI)
    never, always = _entropy(m, lo) > 1, _entropy(m, hi) <= 1
    for _ in range(40):
        mid = (lo + hi) / 2
        over = _entropy(m, mid) > 1
        lo, hi = np.where(over, lo, mid), np.where(over, mid, hi)
    return np.where(never, C_LO, np.where(always, C_HI, hi))


_LIMIT: list[np.ndarray] = []
_LN10 = math.log(10)


def clipped(m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A state back on the grid, and under the entropy limit where its mean is 1 or more."""
    if not _LIMIT:
        _LIMIT.append(_entropy_limit())
    m, c = np.clip(m, M_LO, M_HI), np.clip(c, C_LO, C_HI)
    limit = np.interp(m, np.arange(len(_LIMIT[0])) * ENTROPY_STEP, _LIMIT[0])
    return m, np.where(m >= 0, np.clip(np.minimum(c, limit), C_LO, C_HI), c)


def gamma_parameters(m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.exp(-2 * _LN10 * c), np.exp(-_LN10 * (2 * c + m))


def _emit(m: np.ndarray, c: np.ndarray, mu: float, het) -> tuple[np.ndarray, np.ndarray]:
    """A site's emission: the rate grows by mu, the shape by 1 where the pair differs."""
    a, b = gamma_parameters(m, c)
    a = np.log10(a + het)
    return a - np.log10(b + mu), -0.5 * a


@dataclass
class FlowField:
    u: np.ndarray
    v: np.ndarray

    def recombine(self, m: np.ndarray, c: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
        m, c = clipped(m, c)
        return clipped(m + bilinear(self.u, m, c) * rho, c + bilinear(self.v, m, c) * rho)


@dataclass
class FlowCache:
    """Compounded tables, for the segment lengths that a set of positions needs.

    A stretch of n units is a recombination step, then n - 1 times an unvarying emission and a
    recombination step. Segments longer than ``steps`` take whole stretches of that length first
    (last, backwards). Site tables join a stretch and the emission at its end (start, backwards).
    """

    field: FlowField
    scaled_rho: float
    scaled_mu: float
    steps: int = CACHE_STEPS
    stretch: dict[int, np.ndarray] = field(default_factory=dict)
    forward: dict[int, np.ndarray] = field(default_factory=dict)
    backward: dict[int, np.ndarray] = field(default_factory=dict)

    def prepare(self, lengths: set[int]) -> FlowCache:
        rest = {self._rest(n) for n in lengths} | ({self.steps} if any(n > self.steps for n in lengths) else set())
        missing = rest - self.stretch.keys()
        m0, c0 = np.meshgrid(np.linspace(M_LO, M_HI, M_N), np.linspace(C_LO, C_HI, C_N), indexing="ij")
        m, c = m0, c0
        for n in range(1, max(missing, default=0) + 1):
            if n > 1:
                m, c = _emit(m, c, self.scaled_mu, 0)
            m, c = self.field.recombine(m, c, self.scaled_rho)
            if n in missing:
                self.stretch[n] = np.stack([m, c], axis=-1)
                before = [clipped(*_emit(m0, c0, self.scaled_mu, het)) for het in (0, 1)]
                self.forward[n] = np.stack([np.stack(clipped(*_emit(m, c, self.scaled_mu, het)), axis=-1) for het in (0, 1)])
                self.backward[n] = np.stack([np.stack([bilinear(t, *at) for t in (m, c)], axis=-1) for at in before])
        return self

    def _rest(self, n: int) -> int:
        return (n - 1) % self.steps + 1

    @staticmethod
    def _look(table: np.ndarray, m: np.ndarray, c: np.ndarray, part: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Both values of a stacked table (part, row, column, value) at once, each pair in its own part."""
        flat = table.reshape(-1, 2)
        fm = np.clip((m - M_LO) * ((M_N - 1) / (M_HI - M_LO)), 0, M_N - 1)
        fc = np.clip((c - C_LO) * ((C_N - 1) / (C_HI - C_LO)), 0, C_N - 1)
        i, j = np.minimum(fm.astype(np.int64), M_N - 2), np.minimum(fc.astype(np.int64), C_N - 2)
        wm, wc = (fm - i)[:, None], (fc - j)[:, None]
        at = i * C_N + j + part * (M_N * C_N)
        near, far = flat.take(at, axis=0), flat.take(at + C_N, axis=0)
        near += (flat.take(at + 1, axis=0) - near) * wc
        far += (flat.take(at + C_N + 1, axis=0) - far) * wc
        near += (far - near) * wm
        return near[:, 0], near[:, 1]

    def _site(self, tables: dict, n: int, het: np.ndarray, m, c):
        return self._look(tables[n], m, c, het.astype(np.int64))

    def advance(self, m, c, n: int, het):
        for _ in range((n - 1) // self.steps):
            m, c = self._look(self.stretch[self.steps], m, c)
        return self._site(self.forward, self._rest(n), het, m, c)

    def retreat(self, m, c, n: int, het):
        m, c = self._site(self.backward, self._rest(n), het, m, c)
        for _ in range((n - 1) // self.steps):
            m, c = self._look(self.stretch[self.steps], m, c)
        return m, c


def segment_lengths(pos: np.ndarray, block_start: bool = False) -> np.ndarray:
    """Whole units before each site, 1 at least; the first site is counted from -1, or from the unit before it in a block."""
    gaps = np.diff(pos, prepend=pos[0] - 1 if block_start else -1.0)
    return np.maximum(1, np.rint(gaps).astype(int))


class Decoder:
    """Forward-backward passes of a batch of pairs over the sites of a block."""

    def __init__(self, cache: FlowCache | StepCache, ne: float, positions: np.ndarray, start: int = 0, stop: int | None = None):
        stop = len(positions) if stop is None else stop
        self.cache, self.ne = cache, ne
        self.lengths = segment_lengths(np.asarray(positions[start:stop], float), start > 0)
        cache.prepare(set(self.lengths.tolist()))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = c = np.zeros(len(x))
        ms, cs = np.empty((x.shape[1], len(x))), np.empty((x.shape[1], len(x)))
        for s, n in enumerate(self.lengths.tolist()):
            m, c = self.cache.advance(m, c, n, x[:, s])
            ms[s], cs[s] = m, c
        return ms, cs

    def posterior(self, x: np.ndarray, columns: tuple[str, ...] = ("mean", "lower", "upper", "alpha", "beta")) -> dict[str, np.ndarray]:
        """Means in generations and the joined Gamma parameters; limits hold the shape at 1 or more. Only what is asked is worked out."""
        ms, cs = self.forward(x)  # overwritten by the joined parameters from the end on
        m = c = np.zeros(len(x))
        for s in range(x.shape[1] - 1, -1, -1):
            (fa, fb), (ba, bb) = gamma_parameters(ms[s], cs[s]), gamma_parameters(m, c)
            np.add(fa, ba - 1, out=ms[s])
            np.add(fb, bb - 1, out=cs[s])
            if s:
                m, c = self.cache.retreat(m, c, int(self.lengths[s]), x[:, s])
        out = {"alpha": ms, "beta": cs, "mean": ms / np.maximum(cs, 1e-10) * (2 * self.ne)}
        if "lower" in columns or "upper" in columns:
            k = 1 / (9 * np.maximum(ms, 1))
            spread = 1.96 * np.sqrt(k)
            lo, hi = np.maximum(1 - k - spread, 0), 1 - k + spread
            out |= {"lower": np.maximum(out["mean"] * (lo * lo * lo), 0), "upper": out["mean"] * (hi * hi * hi)}
        return {name: out[name].T for name in columns}

    def kernel(self, columns: tuple[str, ...] = ("mean",)):
        return functools.partial(self._posterior_of, columns)

    def _posterior_of(self, columns, x, pos):
        return self.posterior(x, columns)

    def state_kernel(self, x, pos):
        m, c = self.forward(x)
        return {"mean_log10": m.T, "cv_log10": c.T, "mean": (10.0**m).T * 2 * self.ne}


@dataclass
class StepCache:
    """The same segments without tables: a unit's recombination, then the rest in few steps, each of a scaled rate of ``most`` at most.

    States are only held to the grid. It needs no memory for tables and serves as a cross-check of them.
    """

    field: FlowField
    scaled_rho: float
    scaled_mu: float
    most: float = 0.1

    def prepare(self, lengths: set[int]) -> StepCache:
        return self

    def _move(self, m, c, rho: float):
        u, v = bilinear(self.field.u, m, c), bilinear(self.field.v, m, c)
        return np.clip(m + u * rho, M_LO, M_HI), np.clip(c + v * rho, C_LO, C_HI)

    def _stretch(self, m, c, n: int):
        m, c = self._move(m, c, self.scaled_rho)
        units = n - 1
        steps = max(1, math.ceil(units * self.scaled_rho / self.most)) if units else 0
        for _ in range(steps):
            m, c = _emit(m, c, units * self.scaled_mu / steps, 0)
            m, c = self._move(m, c, units * self.scaled_rho / steps)
        return m, c

    def advance(self, m, c, n: int, het):
        return _emit(*self._stretch(m, c, n), self.scaled_mu, het)

    def retreat(self, m, c, n: int, het):
        return self._stretch(*_emit(m, c, self.scaled_mu, het), n)


_CACHES: dict[tuple, FlowCache] = {}


def _cache(flow: FlowField, rho: float, mu: float, steps: int) -> FlowCache:
    """Tables are kept for the last few fields and rates of an application."""
    key = (id(flow), rho, mu, steps)
    if key not in _CACHES:
        if len(_CACHES) >= 4:
            del _CACHES[next(iter(_CACHES))]
        _CACHES[key] = FlowCache(flow, rho, mu, steps)  # holds the field, so its id stays its own
    return _CACHES[key]


class FlowContext:
    """Decoding of pairs of a panel under one field; parameters per bp and generation."""

    def __init__(self, positions: list[float], flow: FlowField, ne: float = 1e4, mu: float = 1.25e-8, rho: float = 1e-8, cache_steps: int = 0):
        self.positions, self.ne = list(map(float, positions)), ne
        self.cache = _cache(flow, 4 * ne * rho, 4 * ne * mu, cache_steps or CACHE_STEPS)

    def _decoder(self) -> Decoder:
        return Decoder(self.cache, self.ne, np.array(self.positions))

    def run_fb(self, pairs_xor: DataFrame, mean_only: bool = True, return_posterior: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
        columns = ("mean",) + (() if mean_only else ("lower", "upper")) + (("alpha", "beta") if return_posterior else ())
        return fold.per_site(pairs_xor, self.positions, self._decoder().kernel(columns), columns, keep)

    def run_fb_iterative(self, pairs_xor: DataFrame) -> DataFrame:
        """Both passes by steps instead of tables."""
        steps = StepCache(self.cache.field, self.cache.scaled_rho, self.cache.scaled_mu)
        return fold.per_site(pairs_xor, self.positions, Decoder(steps, self.ne, np.array(self.positions)).kernel(("mean", "lower", "upper")), ("mean", "lower", "upper"))

    def run_fwd(self, pairs_xor: DataFrame) -> DataFrame:
        """The forward pass alone: the very states that run_fb joins."""
        return fold.per_site(pairs_xor, self.positions, self._decoder().state_kernel, ("mean",))

    def run_fwd_states(self, pairs_xor: DataFrame) -> DataFrame:
        return fold.per_site(pairs_xor, self.positions, self._decoder().state_kernel, ("mean_log10", "cv_log10"))

    def run_fb_summary(self, pairs_xor: DataFrame) -> DataFrame:
        return fold.site_summary(pairs_xor, self.positions, self._decoder().kernel())

    def run_fb_blockwise(self, pairs_xor: DataFrame, core_block_sites: int = 8192, flank_sites: int = FLANK, mean_only: bool = True, return_posterior: bool = False) -> DataFrame:
        """Blocks of sites with flanks, each decoded from a fresh state; only a block's own sites come out.

        Blocks of a pair are rows, so they run as tasks of their own and memory follows the block, not
        the chromosome.
        """
        sites = len(self.positions)
        blocks = block_windows(sites, core_block_sites, flank_sites)
        if len(blocks) > 1 and flank_sites == 0:
            raise ValueError("several blocks need flanks")
        pos = np.array(self.positions)
        columns = ("mean",) + (() if mean_only else ("lower", "upper")) + (("alpha", "beta") if return_posterior else ())
        for _, _, _, start, stop in blocks:
            self.cache.prepare(set(segment_lengths(pos[start:stop], start > 0).tolist()))
        cache, ne = self.cache, self.ne

        def run(batches):
            decoders: dict[int, Decoder] = {}
            for batch in batches:
                ids = batch.column("block_id").to_numpy()
                for b in np.unique(ids).tolist():
                    _, core, core_stop, start, stop = blocks[b]
                    decoder = decoders.setdefault(b, Decoder(cache, ne, pos, start, stop))
                    own = batch.filter(pa.array(ids == b))
                    step = max(1, fold.CELLS // (stop - start))
                    for at in range(0, own.num_rows, step):
                        part = own.slice(at, step)
                        got = decoder.posterior(fold.unpack(part.column("xor"), sites)[:, start:stop], columns)
                        keep = slice(core - start, core_stop - start)
                        pick = pa.array(np.repeat(np.arange(part.num_rows), core_stop - core))
                        arrays = [part.column(c).take(pick) for c in ("i", "j", "block_id")]
                        arrays += [pa.array(np.tile(np.arange(core, core_stop, dtype=np.int32), part.num_rows)), pa.array(np.tile(pos[core:core_stop], part.num_rows))]
                        arrays += [pa.array(np.ascontiguousarray(got[c][:, keep]).ravel()) for c in columns]
                        yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "block_id", "site_idx", "pos", *columns])

        rows = pairs_xor.select("i", "j", "xor", F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1))).alias("block_id"))
        return rows.mapInArrow(run, "i long, j long, block_id int, site_idx int, pos double, " + ", ".join(f"{c} double" for c in columns))


def block_windows(sites: int, core: int, flank: int) -> list[tuple[int, int, int, int, int]]:
    """(block_id, core_start, core_stop, padded_start, padded_stop)."""
    return [(b, at, min(sites, at + core), max(0, at - flank), min(sites, min(sites, at + core) + flank)) for b, at in enumerate(range(0, sites, core))]


def recommend_core_block_size(n_sites: int, n_pairs: int, free_bytes: int, mean_only: bool = True, flank: int = FLANK, least: int = 1024, most: int = 32768) -> int:
    """The largest power-of-two block whose arrays for all pairs fit the memory that is left after headroom."""
    if n_pairs <= 0:
        return min(n_sites, most)
    usable = free_bytes - max(512 << 20, free_bytes // 5)
    core = max(usable, 0) // (4 * (2 + (1 if mean_only else 3)) * n_pairs) - 2 * flank
    if core <= 0:
        return min(n_sites, least)
    if core >= n_sites:
        return n_sites
    return max(least, min(1 << (core.bit_length() - 1), most, n_sites))


# --- fields ---------------------------------------------------------------------------------------


@dataclass
class Sizes:
    """Piecewise-constant population size over time in units of 2 ``ne_ref`` generations: from each start on, a coalescence rate."""

    starts: np.ndarray
    rates: np.ndarray

    @classmethod
    def of(cls, ne_values, boundaries, ne_ref: float) -> Sizes:
        ne = np.asarray(ne_values, float)
        return cls(np.append(0.0, np.asarray(boundaries, float)[1 : len(ne)] / (2 * ne_ref)), ne_ref / ne)

    def at(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rate and integrated rate at times; the integral is linear between starts, and beyond the last."""
        upto = np.append(0.0, np.cumsum(self.rates[:-1] * np.diff(self.starts)))
        k = np.searchsorted(self.starts, t, side="right") - 1
        return self.rates[k], upto[k] + self.rates[k] * (t - self.starts[k])


CONSTANT = Sizes(np.zeros(1), np.ones(1))


def _collocation(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gauss points of [0, 1], their weights, and the matrix that integrates from 0 to each of them."""
    x, w = np.polynomial.legendre.leggauss(n)
    back = np.linalg.inv(np.polynomial.legendre.legvander(x, n - 1))
    integrals = np.array([np.polynomial.legendre.legint(np.eye(n)[k], lbnd=-1) for k in range(n)])
    return (x + 1) / 2, w / 2, np.polynomial.legendre.legvander(x, n) @ integrals.T @ back / 2


_POINTS, _WEIGHTS, _UPTO = _collocation(16)


def _panels(a: float, b: float, n_steps: int, sizes: Sizes) -> np.ndarray:
    """Edges in log time: as far as a Gamma density exceeds float precision beside its peak, with an edge at each change of rate.

    In log time x the density is exp(a x - b exp(x)), which falls on both sides of x = log(a / b) as
    a (z + 1 - exp(z)) does in the distance z; the ends are where that is the log of the precision.
    """
    lost = math.log(np.finfo(float).eps) / a
    lo = hi = 0.0
    for _ in range(60):  # fixed points of z = lost - 1 + exp(z) and of z = log(1 + z - lost)
        lo, hi = lost - 1 + math.exp(lo), math.log(1 + hi - lost)
    if lost > -0.1:  # near the peak both converge slowly, and the exponent is a parabola there
        lo, hi = -math.sqrt(-2 * lost) * 1.1, math.sqrt(-2 * lost) * 1.1
    centre = math.log(a / b)
    edges = np.linspace(centre + lo, centre + hi, max(4, n_steps // len(_POINTS)) + 1)
    change = np.log(sizes.starts[sizes.starts > 0])
    return np.union1d(edges, change[(change > edges[0]) & (change < edges[-1])])


def flow_at(mean: float, cv: float, n_steps: int, sizes: Sizes = CONSTANT) -> tuple[float, float]:
    """(u, v): how log10 mean and log10 cv of a Gamma density of coalescence times move per unit of recombination.

    Under the sequential coalescent with density f, tail S and integrated rate L, the density changes by
    D = Y + (1 - exp(-2 L)) S - (L + (1 - exp(-2 L)) / 2) f, where Y collects what has come from
    earlier times: Y' = (1 - exp(-2 L)) f - rate Y, Y(0) = 0. That equation and S are integrated together
    by collocation on panels of log time, which is stable for any rate and time, and D is fitted by
    least squares with the density's own derivatives by the two parameters.
    """
    a = cv**-2
    b = a / mean
    edges = _panels(a, b, n_steps, sizes)
    width = np.diff(edges)[:, None]
    x = edges[:-1, None] + width * _POINTS
    t = np.exp(x)
    rate, total = sizes.at(t)
    rate = rate * t
    density = np.exp(a * (x + math.log(b)) - b * t - math.lgamma(a))  # in log time
    moved = -np.expm1(-2 * total)
    mass = np.concatenate([[0.0], np.cumsum((width * density) @ _WEIGHTS)])
    tail = 1 - (mass[:-1, None] + (width * density) @ _UPTO.T) / mass[-1]
    # in each panel Y = start * alone + driven, both by one solution of its collocation equations
    system = np.eye(len(_POINTS)) + width[:, :, None] * _UPTO * rate[:, None, :]
    driven, alone = np.moveaxis(np.linalg.solve(system, np.stack([(width * density * moved) @ _UPTO.T, np.ones_like(t)], axis=-1)), -1, 0)
    gain = ((width * (density * moved - rate * driven)) @ _WEIGHTS, 1 - (width * rate * alone) @ _WEIGHTS)
    start = np.zeros(len(width))
    for k in range(1, len(start)):
        start[k] = gain[0][k - 1] + gain[1][k - 1] * start[k - 1]
    earlier = start[:, None] * alone + driven
    f = density / t
    change = earlier + moved * tail - (total + moved / 2) * f
    by_rate = f * (a - b * t)
    by_shape = f * a * (x + math.log(b) - float(digamma(a)))
    # the mean alone moves the rate against it; the cv moves both, twice against it
    design = np.stack([-by_rate, -2 * (by_shape + by_rate)], axis=-1).reshape(-1, 2) * math.log(10)
    weight = np.sqrt(width * _WEIGHTS * t).ravel()
    scale = np.abs(design * weight[:, None]).max(axis=0)
    u, v = np.linalg.lstsq(design * weight[:, None] / scale, change.ravel() * weight, rcond=None)[0] / scale
    return float(u) * UNIT, float(v) * UNIT


def flow_grid(ids, n_steps: int, sizes: Sizes = CONSTANT) -> list[tuple[float, float]]:
    """The field at grid points, numbered by rows."""
    means, cvs = np.logspace(M_LO, M_HI, M_N), np.logspace(C_LO, C_HI, C_N)
    return [flow_at(float(means[k // C_N]), float(cvs[k % C_N]), n_steps, sizes) for k in ids]


def generate_flow_field(spark: SparkSession, ne_values=None, epoch_boundaries=None, ne_ref: float = 10_000.0, n_steps: int = 500, partitions: int = 32) -> FlowField:
    """The field of a constant or a piecewise-constant size, on about ``n_steps`` times a grid point; points are fitted in parallel."""
    sizes = CONSTANT if ne_values is None else Sizes.of(ne_values, epoch_boundaries, ne_ref)

    def fit(batches):
        for batch in batches:
            uv = np.array(flow_grid(batch.column("id").to_pylist(), n_steps, sizes)).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(uv[:, 0]), pa.array(uv[:, 1])], names=["id", "u", "v"])

    rows = spark.range(0, M_N * C_N, 1, partitions).mapInArrow(fit, "id long, u double, v double").collect()
    rows.sort(key=lambda r: r["id"])
    u, v = (np.array([r[k] for r in rows]).reshape(M_N, C_N) for k in ("u", "v"))
    return FlowField(u, v)


def estimate_demography(means: DataFrame, ne_init: float, n_epochs: int = 20, t_max: float | None = None) -> DataFrame:
    """epoch, t_lo, t_hi, ne: sizes from the histogram's hazard on quadratic epochs.

    An epoch of under 10 values, or one that under 1 percent of values reach, keeps the initial size.
    """
    top = t_max or 10 * ne_init
    value = F.col("mean")
    ok = means.where(value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf")))
    k = F.floor(F.sqrt(value / top) * n_epochs).cast("int")
    k = F.when(value < top * (k / n_epochs) * (k / n_epochs), k - 1).when(value >= top * ((k + 1) / n_epochs) * ((k + 1) / n_epochs), k + 1).otherwise(k)
    counts = ok.groupBy(F.least(k, F.lit(n_epochs)).alias("epoch")).agg(F.count(F.lit(1)).alias("n"))
    spark = means.sparkSession
    edge = lambda e: top * (e / n_epochs) * (e / n_epochs)
    grid = spark.range(n_epochs + 1).select(F.col("id").cast("int").alias("epoch")).join(counts, "epoch", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    from pyspark.sql import Window

    later = Window.orderBy("epoch").rowsBetween(0, Window.unboundedFollowing)  # a row per epoch
    whole = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    grid = grid.withColumns({"left": F.sum("n").over(later), "all": F.sum("n").over(whole), "t_lo": edge(F.col("epoch")), "t_hi": edge(F.col("epoch") + 1)})
    hazard = (F.col("n") / (F.col("all") * (F.col("t_hi") - F.col("t_lo")))) / (F.col("left") / F.col("all"))
    fitted = F.greatest(F.lit(100.0), 1 / (2 * hazard))
    ne = F.when((F.col("n") >= 10) & (F.col("left") / F.col("all") > 0.01), fitted).otherwise(F.lit(float(ne_init)))
    return grid.select("epoch", "t_lo", "t_hi", ne.alias("ne")).where(F.col("epoch") < n_epochs)


class DemographicFlowContext(FlowContext):
    """Two stages: times of a few calibration pairs give sizes over time, and the field of those decodes the rest."""

    def __init__(self, pairs_xor: DataFrame, positions: list[float], flow: FlowField, ne_init: float = 1e4, mu: float = 1.25e-8, rho: float = 1e-8, n_calibration_pairs: int = 50, n_epochs: int = 20, n_steps: int = 500, cache_steps: int = 0):
        first = FlowContext(positions, flow, ne_init, mu, rho, cache_steps)
        times = first.run_fb(sample_pairs(pairs_xor, n_calibration_pairs))
        epochs = estimate_demography(times, ne_init, n_epochs).orderBy("epoch").collect()
        self.ne_values = [r["ne"] for r in epochs]
        self.epoch_boundaries = [r["t_lo"] for r in epochs] + [epochs[-1]["t_hi"]]
        own = generate_flow_field(pairs_xor.sparkSession, self.ne_values, self.epoch_boundaries, ne_init, n_steps)
        super().__init__(positions, own, ne_init, mu, rho, cache_steps)


def merge_summaries(parts: DataFrame) -> DataFrame:
    """Site summaries of disjoint sets of pairs as one: means weighted by their pairs."""
    return parts.groupBy("site_idx").agg((F.sum(F.col("site_mean") * F.col("n_pairs")) / F.sum("n_pairs")).alias("site_mean"), F.min("site_min").alias("site_min"), F.max("site_max").alias("site_max"), F.sum("n_pairs").alias("n_pairs"))
