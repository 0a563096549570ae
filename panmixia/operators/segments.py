"""Changepoint segmentation of a pair's differences by penalised Poisson likelihood with pruning."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panmixia.operators import fold

CHUNK = 1024
#: Up to so many sites, the costs of all segments by their differences are held as a table and no start is pruned; above, starts leave at each PRUNE-th site.
TABLE_SITES, PRUNE = 128, 16
#: Rounding makes equal costs differ by less.
TIE = 1e-9
#: By so much a bound must hold, so that the rounding of its single-precision tables doesn't matter.
MARGIN = 1e-3


def _cost(n: np.ndarray, length: np.ndarray, mu: float) -> np.ndarray:
    safe = np.maximum(length, 1e-300)
    c = np.where(n > 0, n - n * np.log(np.maximum(n, 1) / safe), 2 * mu * length)
    return np.where(length > 0, c, 1e30)


@functools.lru_cache(maxsize=4)
def _tables(pos: tuple[float, ...], mu: float) -> list[np.ndarray]:
    """For each site s, the costs of the segments [t, s) by t and by their differences."""
    at, n = np.asarray(pos), np.arange(len(pos) + 1)[None, :]
    return [_cost(n, (at[s] - at[:s])[:, None], mu) for s in range(len(pos))]


def _origins(prefix: np.ndarray, pos: np.ndarray, mu: float, penalty: float) -> np.ndarray:
    """Sites by pairs: where the last segment of the best segmentation up to each site starts.

    All pairs go through the sites together, a row per start, so that whole rows are worked on. Costs
    within TIE of the least are ties, which the earliest start wins; on many sites, a start whose cost
    without the penalty exceeds the best by more can't win for that pair, and leaves when no pair needs it.
    """
    sites, pairs = len(pos), len(prefix)
    counts = np.ascontiguousarray(prefix.T, dtype=np.int64)
    tables = _tables(tuple(pos.tolist()), mu) if sites <= TABLE_SITES else None
    best, origin = np.zeros((sites, pairs)), np.zeros((sites, pairs), np.int32)
    starts, alive = np.arange(1), np.ones((1, pairs), bool)
    for s in range(1, sites):
        whole = len(starts) == s  # then all are there, in order
        own = slice(0, s) if whole else starts
        n = counts[s] - counts[own]
        if tables is None:
            costs = _cost(n, (pos[s] - pos[own])[:, None], mu)
        else:
            table = tables[s] if whole else tables[s][starts]
            n += np.arange(0, table.size, table.shape[1])[:, None]
            costs = table.ravel().take(n)
        costs += best[own]
        least = costs.min(axis=0)
        # the first of the starts within the tie, as the largest of numbers that fall with the start
        fall = np.arange(len(starts), 0, -1, dtype=np.uint8 if len(starts) < 256 else np.int32)[:, None]
        k = len(starts) - ((costs <= least + TIE) * fall).max(axis=0).astype(np.int64)
        origin[s] = k if whole else starts[k]
        best[s] = np.take_along_axis(costs, k[None, :], axis=0)[0] + penalty
        if tables is None:
            alive &= costs <= best[s] + TIE
            if s % PRUNE == 0:
                used = alive.any(axis=1)
                starts, alive = starts[used], alive[used]
            alive = np.concatenate([alive, np.ones((1, pairs), bool)])
        starts = np.append(starts, s)
    return origin


def _excess(n: np.ndarray, length: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """By how much a segment's likelihood with a rate of its own exceeds that with the given one."""
    due = rate * length
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(n > 0, n * np.log(np.where(n > 0, n, 1) / due), 0.0)
    return np.maximum(own - n + due, 0)


@functools.lru_cache(maxsize=4)
def _bounds(pos: tuple[float, ...], penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By a pair's differences after the first site: the excess of what lies before and after each site, by the differences
    before it, and the fewest and most differences of windows of each number of sites whose excess stays under the penalty."""
    at, sites = np.asarray(pos) - pos[0], len(pos)
    n = np.arange(sites)
    total, part = n[:, None, None], n[None, None, :]
    rate = total / at[-1]
    before = _excess(part, at[None, :, None], rate)
    after = np.where(part <= total, _excess(np.maximum(total - part, 0), at[-1] - at[None, :, None], rate), np.inf)
    low, high = np.full((sites, sites), 255, np.uint8), np.zeros((sites, sites), np.uint8)
    for width in range(1, sites):
        length = at[width:] - at[:-width]
        most = np.maximum(_excess(n[None, :], length.min(), rate[:, 0]), _excess(n[None, :], length.max(), rate[:, 0]))
        fits = most <= penalty - MARGIN  # a range of n, since the excess is convex in it
        some = fits.any(axis=1)
        low[width, some], high[width, some] = fits.argmax(axis=1)[some], sites - 1 - fits[some, ::-1].argmax(axis=1)
    return before.astype(np.float32).ravel(), after.astype(np.float32).ravel(), low, high


def _whole(prefix: np.ndarray, pos: np.ndarray, mu: float, penalty: float) -> np.ndarray:
    """Which pairs are surely one segment; the others are not known.

    What a segmentation gains over one segment is the sum of its parts' excesses over the common rate (no more, since an
    empty part costs what it does). If the largest of a first part and of a last part come to less than the penalty, and
    that of every window is less as well, k parts gain less than k - 1 penalties.
    """
    sites = len(pos)
    if not 3 <= sites <= TABLE_SITES or mu < 0 or (np.diff(pos) <= 0).any():
        return np.zeros(len(prefix), bool)
    before, after, low, high = _bounds(tuple(pos.tolist()), penalty)
    counts = np.ascontiguousarray((prefix - prefix[:, :1]).T.astype(np.uint8))
    total = counts[-1].astype(np.int64)
    cell = total * sites**2 + (np.arange(1, sites - 1) * sites)[:, None] + counts[1:-1]
    sure = before.take(cell).max(axis=0) + after.take(cell).max(axis=0) <= penalty - MARGIN
    for width in range(1, sites):
        n = counts[width:] - counts[:-width]
        sure &= (n.min(axis=0) >= low[width].take(total)) & (n.max(axis=0) <= high[width].take(total))
    return sure


def segments(prefix: np.ndarray, pos: np.ndarray, mu: float, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of prefix counts, start and end of every segment, in order; a single site has none."""
    sure = np.concatenate([np.zeros(0, bool), *[_whole(prefix[at : at + 4 * CHUNK], pos, mu, penalty) for at in range(0, len(prefix), 4 * CHUNK)]])
    one, rest = np.flatnonzero(sure), np.flatnonzero(~sure)
    found = [(one, np.zeros_like(one), np.full_like(one, len(pos) - 1))]
    for at in range(0, len(rest), CHUNK):  # a few pairs at once, so that the rows of starts stay in cache
        own = rest[at : at + CHUNK]
        origin = _origins(prefix[own], pos, mu, penalty)
        row, end = np.arange(len(own)), np.full(len(own), len(pos) - 1)
        while len(row := row[end > 0]):
            end = end[end > 0]
            start = origin[end, row].astype(np.int64)
            found.append((own[row], start, end))
            end = start
    row, start, end = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((start, row))
    return row[order], start[order], end[order]


def changepoints(prefix: np.ndarray, pos: np.ndarray, mu: float, penalty: float) -> list[list[int]]:
    """Segment borders, from 0 to the last site, for each row of prefix counts."""
    paths = [[0] for _ in prefix]
    for row, _, end in zip(*(x.tolist() for x in segments(prefix, pos, mu, penalty)), strict=True):
        paths[row].append(end)
    return paths


def pelt_changepoint(pairs_xor: DataFrame, positions: list[float], mu: float, penalty: float | None = None) -> DataFrame:
    """i, j, seg_no, start_idx, end_idx, n_mut, tmrca.

    Segments share their ends, the last one ends at the last site; a segment [a, b) has the
    differences of sites a + 1 to b. Without a penalty it is the log of the number of sites.
    """
    level, pos = math.log(len(positions)) if penalty is None else penalty, np.asarray(positions, float)

    def run(batches):
        for part, x in fold.parts(batches, len(pos)):
            prefix = np.cumsum(x, axis=1, dtype=np.int64)
            row, start, end = segments(prefix, pos, mu, level)
            n, length = prefix[row, end] - prefix[row, start], pos[end] - pos[start]
            known = (n > 0) & (length > 0)
            tmrca = np.where(known, n / np.where(known, 2 * mu * length, 1.0), 0.0)
            pick = pa.array(row)
            arrays = [part.column("i").take(pick), part.column("j").take(pick), pa.array(np.arange(len(row)) - np.searchsorted(row, row), pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(n, pa.int64()), pa.array(tmrca)]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "seg_no", "start_idx", "end_idx", "n_mut", "tmrca"])

    return pairs_xor.select("i", "j", "xor").mapInArrow(run, "i long, j long, seg_no int, start_idx int, end_idx int, n_mut long, tmrca double")
