"""Ordered folds over the sites of pairs: NumPy across the pairs of a batch, a loop over sites.

A pair is one row with its packed differences, so a fold needs no shuffle. A kernel gets the
differences of some pairs as a matrix (pairs by sites) and the positions, and gives one matrix per
output column. Results leave as rows of (i, j, site), or reduced over pairs where only that is asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells (pairs by sites) that a kernel works on at once; this bounds a task's memory whatever the batch.
CELLS = 2_000_000

Kernel = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]


def unpack(words: pa.Array, n_sites: int) -> np.ndarray:
    """Packed words as a 0/1 matrix."""
    flat = np.ascontiguousarray(words.flatten().to_numpy(zero_copy_only=False))
    bits = np.unpackbits(flat.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
    return bits[:, :n_sites]


def parts(batches: Iterable[pa.RecordBatch], n_sites: int, cells: int = CELLS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their differences as matrices."""
    step = max(1, cells // max(n_sites, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, unpack(part.column("xor"), n_sites)


def _schema(df: DataFrame, keep: tuple[str, ...]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema)


def per_site(pairs_xor: DataFrame, positions: list[float], kernel: Kernel, columns: tuple[str, ...], keep: tuple[str, ...] = (), sites: list[int] | None = None) -> DataFrame:
    """Rows (i, j, keep, site_idx, pos, columns); ``sites`` are the ones that come out, all take part."""
    pos = np.asarray(positions, float)
    out_sites = np.arange(len(pos), dtype=np.int32) if sites is None else np.asarray(sites, np.int32)
    names = ["i", "j", *keep]
    kinds = dict(c.split(":") if ":" in c else (c, "double") for c in columns)
    arrow = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32()}

    def run(batches):
        for part, x in parts(batches, len(pos)):
            got = kernel(x, pos)
            pick = pa.array(np.repeat(np.arange(len(x)), len(out_sites)))
            arrays = [part.column(c).take(pick) for c in names]
            arrays += [pa.array(np.tile(out_sites, len(x))), pa.array(np.tile(pos[out_sites], len(x)))]
            arrays += [pa.array(np.ascontiguousarray(got[c] if sites is None else got[c][:, out_sites]).ravel(), arrow[k]) for c, k in kinds.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "site_idx", "pos", *kinds])

    schema = f"i long, j long, {_schema(pairs_xor, keep)}site_idx int, pos double, " + ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    return pairs_xor.select(*names, "xor").mapInArrow(run, schema)


def per_pair(pairs_xor: DataFrame, positions: list[float], kernel: Kernel, columns: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (i, j, keep, columns), one per pair; an entry may be a number or a list of them."""
    pos = np.asarray(positions, float)
    names = ["i", "j", *keep]
    kinds = dict(c.split(":") if ":" in c else (c, "double") for c in columns)
    arrow = {"double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}

    def run(batches):
        for part, x in parts(batches, len(pos)):
            got = kernel(x, pos)
            arrays = [part.column(c) for c in names] + [pa.array(list(got[c]), arrow[k]) for c, k in kinds.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *kinds])

    schema = f"i long, j long, {_schema(pairs_xor, keep)}" + ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    return pairs_xor.select(*names, "xor").mapInArrow(run, schema)


def site_summary(pairs_xor: DataFrame, positions: list[float], kernel: Kernel, column: str = "mean", sites: list[int] | None = None) -> DataFrame:
    """site_idx, site_mean, site_min, site_max, n_pairs: a task sends one row per site, not one per pair and site."""
    pos = np.asarray(positions, float)
    out_sites = np.arange(len(pos)) if sites is None else np.asarray(sites)

    def run(batches):
        total, low, high, n = np.zeros(len(out_sites)), np.full(len(out_sites), np.inf), np.full(len(out_sites), -np.inf), 0
        for _, x in parts(batches, len(pos)):
            v = kernel(x, pos)[column][:, out_sites]
            total, low, high, n = total + v.sum(0), np.minimum(low, v.min(0)), np.maximum(high, v.max(0)), n + len(v)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(out_sites, pa.int32()), pa.array(total), pa.array(low), pa.array(high), pa.array(np.full(len(out_sites), n))], names=["site_idx", "s", "lo", "hi", "n"])

    rows = pairs_xor.select("xor").mapInArrow(run, "site_idx int, s double, lo double, hi double, n long")
    return rows.groupBy("site_idx").agg((F.sum("s") / F.sum("n")).alias("site_mean"), F.min("lo").alias("site_min"), F.max("hi").alias("site_max"), F.sum("n").alias("n_pairs"))
