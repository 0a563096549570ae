"""Nearest neighbours by largest inner product through an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panmixia.llm.common import cut, hash_sample

#: Centroids a half: enough for cells of about CELL_ROWS rows, within bounds; vectors that train them, for each and at most.
CELL_ROWS, FEWEST, MOST = 50, 16, 1024
TRAINED_ON, SAMPLE = 32, 32_768
#: Queries whose exact neighbours in the whole table fix how many rows a walk must hold, and the share of these it finds.
PROBES, RECALL = 256, 0.96


@dataclass
class MultiIndex:
    """Codebooks of two vector halves, and the number of rows that a query's cells must hold.

    Largest inner products are made nearest neighbours: the second half of a row has one coordinate
    more, which brings all rows to the norm of the longest; that of a query is 0 there.
    """

    first: np.ndarray
    second: np.ndarray
    norm2: float
    quota: float

    def _distances(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))
        return _squared(x[:, :h], self.first), _squared(np.column_stack([x[:, h:], extra]), self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self._distances(x, query=False)
        return a.argmin(1).astype(np.int64) * len(self.second) + b.argmin(1)

    def visits(self, x: np.ndarray, counts: np.ndarray, quota: np.ndarray) -> Iterator[np.ndarray]:
        """Each query's cells in the order of summed distance, until they hold its ``quota`` of rows."""
        for a, b, n in zip(*self._distances(x, query=True), quota.tolist(), strict=True):
            yield np.array(traverse(a, b, counts, n), np.int32)


def traverse(a: np.ndarray, b: np.ndarray, counts: np.ndarray, quota: float) -> list[int]:
    """The multi-sequence walk: pairs of centroids by rising a[i] + b[j] from a heap; empty cells are passed over.

    A pair enters the heap when its neighbours at smaller ranks have left it, so the heap never holds
    more than one pair per centroid of a half.
    """
    i_of, j_of = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    ra, rb = a[i_of].tolist(), b[j_of].tolist()
    i_of, j_of, width = i_of.tolist(), j_of.tolist(), len(b)
    heap, seen_in_row, found, held = [(ra[0] + rb[0], 0, 0)], [0] * (len(ra) + 1), [], 0
    while heap and held < quota:
        _, r, s = heapq.heappop(heap)
        seen_in_row[r] = s + 1
        cell = i_of[r] * width + j_of[s]
        if n := counts[cell]:
            found.append(cell)
            held += int(n)
        if s + 1 < width and (r == 0 or seen_in_row[r - 1] > s + 1):
            heapq.heappush(heap, (ra[r] + rb[s + 1], r, s + 1))
        if r + 1 < len(ra) and seen_in_row[r + 1] == s:
            heapq.heappush(heap, (ra[r + 1] + rb[s], r + 1, s))
    return found


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(0)
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        nearest = _squared(x, c).argmin(1)
        n = np.bincount(nearest, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _ordered(c: np.ndarray) -> np.ndarray:
    """Centroids so that near ones have near numbers: halved again and again along their widest direction."""
    if len(c) < 3:
        return c
    centred = c - c.mean(0)
    along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
    order = np.argsort(along, kind="stable")
    half = len(c) // 2
    return np.concatenate([_ordered(c[order[:half]]), _ordered(c[order[half:]])])


def codebooks(clean: DataFrame, dim: int, centroids: int | None = None) -> MultiIndex:
    """Codebooks from at most SAMPLE vectors, those of smallest id hash; all rows are indexed by them."""
    total, norm2 = clean.agg(F.count(F.lit(1)), F.max(F.aggregate("vec", F.lit(0.0), lambda t, v: t + v * v))).first()
    c = centroids or int(min(MOST, max(FEWEST, math.ceil(math.sqrt(total / CELL_ROWS)))))
    rows = hash_sample(clean, min(SAMPLE, TRAINED_ON * c), "vec_id").select("vec").collect()
    x = np.array([r["vec"] for r in rows], float)
    extra = np.sqrt(np.maximum(norm2 - (x * x).sum(1), 0))
    c, half = max(1, min(c, len(x) // 2)), dim // 2
    return MultiIndex(_ordered(_kmeans(x[:, :half], c)), _ordered(_kmeans(np.column_stack([x[:, half:], extra]), c)), norm2, math.inf)


def fit_quota(rows: DataFrame, index: MultiIndex, counts: np.ndarray, dim: int, k: int, probes: int = PROBES, recall: float = RECALL) -> float:
    """How many rows a walk must hold to find ``recall`` of the true k nearest, measured on the table itself.

    ``probes`` rows are compared with all rows, a block at a time; every task keeps k a probe. What
    counts is at which place of the probe's walk the cells of its true neighbours come, so the number
    does not grow with the table where its neighbourhoods do not.
    """
    asked = hash_sample(rows.select("vec_id", "vec"), probes, "vec_id").collect()
    ids, q = np.array([r["vec_id"] for r in asked]), np.array([r["vec"] for r in asked], float)

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
        for batch in batches:
            x, own, cell = _matrix(batch.column("vec"), dim), batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
            scores = q @ x.T
            scores[ids[:, None] == own[None, :]] = -np.inf
            for i, s in enumerate(scores):
                top = np.argpartition(-s, k - 1)[:k] if len(s) > k else np.arange(len(s))
                top = top[np.isfinite(s[top])]
                cost, cells = np.concatenate([best[i][0], -s[top]]), np.concatenate([best[i][1], cell[top]])
                keep = np.argsort(cost, kind="stable")[:k]
                best[i] = cost[keep], cells[keep]
        at = pa.array(np.cumsum([0, *[len(c) for c, _ in best]]), pa.int32())
        found = pa.StructArray.from_arrays([pa.array(np.concatenate([x[j] for x in best])) for j in (0, 1)], names=["cost", "cell"])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(q)), pa.int32()), pa.array([part] * len(q), pa.int32()), pa.ListArray.from_arrays(at, found)], names=["probe", "shard", "found"])

    best = _merged(rows.mapInArrow(compared, "probe int, shard int, found array<struct<cost:double,cell:long>>"), "probe", k)
    needed = []
    for r in best.collect():  # probes times k at most
        a, b = index._distances(q[r["probe"]][None, :], query=True)
        order = np.argsort((a[0][:, None] + b[0][None, :]).ravel(), kind="stable")
        upto = np.empty(len(order))
        upto[order] = np.cumsum(counts[order])
        needed += [upto[f["cell"]] for f in r["found"]]
    return float(np.quantile(needed, recall, method="higher")) if needed else math.inf


def _merged(found: DataFrame, key: str, k: int) -> DataFrame:
    """The k of least cost in each key's lists; 64 shards are merged at first, so that no list grows with their number."""
    for keys in ([key, F.floor(F.col("shard") / 64).cast("int").alias("shard")], [key]):
        found = found.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    return found


def _clean(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles, without those that take no part."""
    vec = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select("vec_id", vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda v: v != 0))
    return rows


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(vectors: DataFrame, queries: Column, k: int = 20, centroids: int | None = None, rows_per_shard: int = 4096, quota: float | None = None) -> DataFrame:
    """The k rows of largest inner product for every row that satisfies ``queries``, by an inverted multi-index.

    All rows are indexed. Cells lie in shards of about ``rows_per_shard`` rows, near cells together; a
    cell with more is split over several, so a vector with very many copies fills shards and not one
    task. A query walks the cells until they hold its quota, which ``fit_quota`` measures on the table
    unless it is given, and goes once to each shard that holds cells it visits; a shard's task keeps
    its rows as a matrix, reads queries in batches and returns k rows for each, and the shards' bests
    are merged.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids
    or vectors of another length than most. Rows with a query's own id are no candidates of it, and do
    not count in its quota; of a repeated query id the smallest vector asks. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    clean = _clean(vectors)
    lengths = {r[0]: r[1] for r in clean.groupBy(F.size("vec")).count().collect()}
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = max(lengths, key=lambda n: (lengths[n], n))
    clean = clean.where(F.size("vec") == dim)
    index = codebooks(clean, dim, centroids)
    width, cells_n = len(index.second), len(index.first) * len(index.second)

    def celled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(index.cells(_matrix(part.column("vec"), dim)), pa.int64())], names=["vec_id", "vec", "cell"])

    rows = cut(clean.mapInArrow(celled, "vec_id long, vec array<double>, cell long"))
    # one count per cell at most, so bounded by the codebooks
    counts = np.zeros(cells_n, np.int64)
    for r in rows.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    total = int(counts.sum())
    enough = max(k, fit_quota(rows, index, counts, dim, k) if quota is None else quota)
    shards = max(1, -(-total // rows_per_shard))
    parts = np.maximum(1, -(-counts // rows_per_shard))
    # square tiles of near centroids one after another, dealt to shards in turn by rows before them
    i, j = np.divmod(np.arange(cells_n), width)
    side = max(1, math.ceil(width / max(1, round(math.sqrt(shards)))))
    order = np.lexsort((j, i, j // side, i // side))
    before = np.empty(cells_n, np.int64)
    before[order] = np.cumsum(counts[order]) - counts[order]
    home = np.minimum(before * shards // max(total, 1), shards - 1)
    many = int((home + parts).max())

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = batch.column("cell").to_numpy()
                ids = batch.column("vec_id").to_numpy()
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                shard = home[cell] + (mixed % parts[cell].astype(np.uint64)).astype(np.int64)
                visits = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1), pa.int32()), pa.array(cell, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.zeros(len(ids)), pa.int32()), batch.column("vec_id"), batch.column("vec"), visits], names=["shard", "kind", "vec_id", "vec", "cells"])

    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                shard, row, ends, cells = [], [], [0], []
                for n, walk in enumerate(index.visits(_matrix(part.column("vec"), dim), counts, enough + part.column("own").to_numpy())):
                    again = np.repeat(walk, parts[walk])  # once for each part of a split cell
                    nth = np.arange(len(again)) - np.repeat(np.cumsum(parts[walk]) - parts[walk], parts[walk])
                    to = home[again] + nth
                    by = np.argsort(to, kind="stable")
                    own, first = np.unique(to[by], return_index=True)
                    shard += own.tolist()
                    row += [n] * len(own)
                    ends += (ends[-1] + np.append(first[1:], len(by))).tolist()
                    cells.append(again[by])
                row = pa.array(row, pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(cells), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.ones(len(row)), pa.int32()), part.column("vec_id").take(row), part.column("vec").take(row), lists], names=["shard", "kind", "vec_id", "vec", "cells"])

    schema = "shard int, kind int, vec_id long, vec array<double>, cells array<int>"
    asking = rows.where(queries).groupBy("vec_id").agg(F.min("vec").alias("vec"), F.count(F.lit(1)).alias("own"))
    dealt = rows.mapInArrow(placed, schema).unionByName(asking.mapInArrow(asked, schema))
    dealt = dealt.repartition(many, "shard").sortWithinPartitions("shard", "kind")

    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, x, ids, cell = None, [], [], []
        for batch in batches:
            s, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(s) != 0) | (np.diff(kind) != 0)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(s)], strict=True):
                if a == z:
                    continue
                part = batch.slice(a, z - a)
                if s[a] != shard:
                    shard, x, ids, cell = s[a], [], [], []
                if kind[a] == 0:
                    x.append(_matrix(part.column("vec"), dim)), ids.append(part.column("vec_id").to_numpy()), cell.append(part.column("cells").flatten().to_numpy())
                    continue
                if not x:
                    continue
                if len(x) > 1:
                    x, ids, cell = [np.concatenate(x)], [np.concatenate(ids)], [np.concatenate(cell)]
                for at in range(0, part.num_rows, 256):
                    yield from _answers(part.slice(at, 256), dim, x[0], ids[0], cell[0], k, int(shard))

    best = _merged(dealt.mapInArrow(searched, "query_id long, shard int, found array<struct<cost:double,vec_id:long>>"), "query_id", k)
    top = best.select("query_id", F.posexplode("found").alias("rank", "f"))
    return top.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.cost")).alias("score"))


def _answers(part: pa.RecordBatch, dim: int, x: np.ndarray, ids: np.ndarray, cell: np.ndarray, k: int, shard: int) -> Iterator[pa.RecordBatch]:
    """The bests of a batch of queries among the rows of a shard that lie in cells they visit.

    One matrix product over the rows that any of them visits, scored again in a fixed order of
    summation, ties to smaller ids.
    """
    q, q_ids, lists = _matrix(part.column("vec"), dim), part.column("vec_id").to_numpy(), part.column("cells")
    visited = lists.flatten().to_numpy()
    held, place = np.unique(visited, return_inverse=True)
    take = np.flatnonzero(np.isin(cell, held))
    if not len(take):
        return
    x, ids, at = x[take], ids[take], np.searchsorted(held, cell[take])
    allowed = np.zeros((len(q), len(held)), bool)
    allowed[np.repeat(np.arange(len(q)), pc.list_value_length(lists).to_numpy()), place] = True
    rough = np.where(allowed[:, at] & (q_ids[:, None] != ids[None, :]), q @ x.T, -np.inf)
    out_q, out_n, out_s, out_v = [], [0], [], []
    for n, s in enumerate(rough):
        near = np.arange(len(s))
        if len(s) > k:
            # rounding of the product differs by position, so near ties of the k-th stay in
            kth = np.partition(s, len(s) - k)[len(s) - k]
            near = np.flatnonzero(s >= kth - 1e-9 * max(1.0, abs(kth))) if np.isfinite(kth) else near
        near = near[np.isfinite(s[near])]
        if len(near):
            exact = (x[near] * q[n]).sum(axis=1)
            best = np.lexsort((ids[near], -exact))[:k]
            out_q.append(q_ids[n]), out_s.append(-exact[best]), out_v.append(ids[near][best])
            out_n.append(out_n[-1] + len(best))
    if out_q:
        found = pa.StructArray.from_arrays([pa.array(np.concatenate(out_s), pa.float64()), pa.array(np.concatenate(out_v), pa.int64())], names=["cost", "vec_id"])
        yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array([shard] * len(out_q), pa.int32()), pa.ListArray.from_arrays(pa.array(out_n, pa.int32()), found)], names=["query_id", "shard", "found"])
