"""N-gram Jaccard join: a forest of sorted MinHash tries proposes pairs, exact counts decide them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panmixia.llm.common import cut, free_name, salted, slices, stored, trimmed

WORDS, THRESHOLD = 5, 0.8
#: A pair at the threshold is missed with probability 1 - RECALL at most. A trie's strings have up to LONGEST values.
RECALL, LONGEST, MOST_TREES = 0.9999, 7, 64
#: The first values of a string have two bytes, so that strangers share none of them by chance, the others one.
WIDE = 3
#: Shingles and sets that a block of a large component holds, and rows up to which ids are broadcast (under 100 bytes each).
BLOCK_SHINGLES, BLOCK_SETS, BROADCAST_ROWS = 200_000, 2_000, 200_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def descent(threshold: float = THRESHOLD, recall: float = RECALL, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(trees, prefix length) of the search's steps.

    A set that meets no other at prefixes of this length in the first so many trees has no partner at
    the threshold, but for its share of 1 - recall, and its search ends there. In few trees that needs
    short prefixes; a set that has company at short prefixes goes on to longer ones in more trees,
    and what shares one of the last length with it is compared exactly.
    """
    depth = longest
    trees = lambda d: math.ceil(math.log((1 - recall) / 3) / math.log(1 - min(threshold, 0.999999) ** d))
    while depth > 1 and trees(depth) > MOST_TREES:
        depth -= 1
    return [(trees(d), d) for d in (depth - 4, depth - 2, depth) if d > 0]


def shingles(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct 64-bit hashes of n consecutive words, sorted; a shorter text is one shingle, an empty one none."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten()
    coded = flat.dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    at = split.offsets.to_numpy().astype(np.int64)
    codes = coded.indices.to_numpy()
    # the split leaves an empty string where a text begins or ends with a space
    full = own[codes] != 0
    words = own[codes][full]
    at = np.concatenate([[0], np.cumsum(full)])[at]
    h = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for i in range(n):
        h = (h + words[i : i + len(h)]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    out = []
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if z - a >= n:
            out.append(np.unique(h[a : z - n + 1]))
        elif z > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[a:z].tobytes(), seed=z - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, count, dtype=np.uint32)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values; long sets go in parts."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(x), 8192):
        y = x[None, i : i + 8192] * a[:, None]
        y ^= y >> np.uint32(15)
        y += b[:, None]
        y *= np.uint32(0x85EBCA6B)
        np.minimum(low, y.min(axis=1), out=low)
    return low


def _width(depth: int) -> int:
    return depth + min(depth, WIDE)


def signatures(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """Per row: a key of its shingle set, the set's size, and its string of min-hashes in each tree, one behind another."""
    a, b = _permutations(trees * depth)

    @trimmed
    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3_000_000):
                sets = shingles(part.column("text"))
                keys = [hashlib.md5(s.tobytes()).digest() for s in sets]
                strung = np.zeros((len(sets), trees, _width(depth)), np.uint8)
                for j, s in enumerate(sets):
                    if len(s):
                        m = signature(s, a, b).reshape(trees, depth) * np.uint32(0x9E3779B1)
                        at = 0
                        for k in range(depth):  # minima are small numbers, so the product spreads them over the upper bits
                            for shift in (16, 24) if k < WIDE else (24,):
                                strung[j, :, at] = m[:, k] >> np.uint32(shift)
                                at += 1
                flat = [x.tobytes() for x in strung]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(flat, pa.binary())], names=["doc_id", "set_key", "n", "strings"])

    return docs.select("doc_id", "text").mapInArrow(signed, "doc_id long, set_key binary, n int, strings binary")


def shared_prefix(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many values the strings in rows of ``a`` and ``b`` share from the start."""
    same = a == b
    wide = min(depth, WIDE)
    values = np.concatenate([same[:, : 2 * wide : 2] & same[:, 1 : 2 * wide : 2], same[:, 2 * wide :]], axis=1)
    return np.cumprod(values, axis=1).sum(axis=1)


def _walked(depth: int, least: int):
    """Walk sorted tries: links of each set to the first one of its run of full prefixes, and the sets with company at ``least``.

    A run that begins in the partition before is linked by the partitions' first and last rows.
    """

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, width = TaskContext.get().partitionId(), _width(depth)
        tree, text, node = np.zeros(0, np.int32), np.zeros((0, width), np.uint8), np.zeros(0, np.int64)
        head, before, begun = 0, 0, False

        def rows(kind: int, u: np.ndarray, v: np.ndarray, trees=None, texts=None) -> pa.RecordBatch:
            n = len(u)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(trees if n and trees is not None else [None] * n, pa.int32()), pa.array(texts if n and texts is not None else [None] * n, pa.binary())], names=["kind", "u", "v", "tree", "string"])

        def finished(upto: int, lcp: np.ndarray, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Rows whose neighbours on both sides are known; lcp[i] is that of row i with the one before."""
            own, company = node[:upto], np.maximum(lcp[:upto], lcp[1 : upto + 1])
            linked = heads[:upto] != own
            yield rows(0, own[linked], heads[:upto][linked])
            met = company >= least
            yield rows(1, own[met], company[met])

        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.frombuffer(b"".join(batch.column("string").to_pylist()), np.uint8).reshape(-1, width)
            tree = np.concatenate([tree, batch.column("tree").to_numpy()])
            node = np.concatenate([node, batch.column("node").to_numpy()])
            text = np.concatenate([text, more])
            if not begun:
                yield rows(2, np.array([2 * part]), node[:1], tree[:1].tolist(), [text[0].tobytes()])
                head, begun = node[0], True
            lcp = np.zeros(len(node) + 1, np.int64)
            lcp[0] = before
            lcp[1:-1] = np.where(tree[1:] == tree[:-1], shared_prefix(text[1:], text[:-1], depth), 0)
            first = lcp[:-1] < depth
            first[0] = False  # goes on with the run that is held
            at = np.maximum.accumulate(np.where(first, np.arange(len(node)), 0))
            heads = np.where(at > 0, node[at], head)
            yield from finished(len(node) - 1, lcp, heads)
            head, before = heads[-1], lcp[-2]
            tree, text, node = tree[-1:], text[-1:], node[-1:]
        if begun:
            yield from finished(1, np.array([before, 0]), np.array([head]))
            yield rows(2, np.array([2 * part + 1]), node, tree.tolist(), [text[0].tobytes()])

    return run


def _candidates(reps: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Edges (u, v) whose components hold every pair of sets that share a full prefix in a tree that both are searched in.

    Each step sorts the tries of its trees, dealt by ranges of (tree, string, node): a prefix that a
    third of all sets share spreads over as many tasks as it fills. Sets without company leave.
    """
    spark, depth = reps.sparkSession, steps[-1][1]
    width, done, live, met, edges = _width(depth), 0, None, None, None
    for trees, least in steps:
        own = reps.select("node", "strings") if live is None else reps.select("node", "strings").join(live, "node", "left_semi")
        leaves = own.select("node", F.explode(F.sequence(F.lit(done), F.lit(trees - 1))).alias("tree"), "strings")
        leaves = leaves.select("tree", F.col("strings").substr(F.col("tree") * width + 1, F.lit(width)).alias("string"), "node")
        leaves = leaves.repartitionByRange("tree", "string", "node").sortWithinPartitions("tree", "string", "node")
        found = cut(leaves.mapInArrow(_walked(depth, least), "kind int, u long, v long, tree int, string binary"))
        # two rows a partition
        ends = found.where("kind = 2").orderBy("u").collect()
        between = []
        for x, y in zip(ends, ends[1:], strict=False):
            if x["tree"] == y["tree"] and x["v"] != y["v"]:
                n = int(shared_prefix(*(np.frombuffer(r["string"], np.uint8)[None, :] for r in (x, y)), depth)[0])
                between.append((x["v"], y["v"], n))
        between = spark.createDataFrame(between, "u long, v long, n long")
        links = found.where("kind = 0").select("u", "v").unionByName(between.where(F.col("n") >= depth).select("u", "v"))
        edges = links if edges is None else edges.unionByName(links)
        company = found.where("kind = 1").select(F.col("u").alias("node"), F.col("v").alias("n"))
        company = company.unionByName(between.select(F.explode(F.array("u", "v")).alias("node"), "n"))
        met = company if met is None else met.unionByName(company)
        if trees < steps[-1][0]:
            met = cut(met.where(F.col("n") >= least).groupBy("node").agg(F.max("n").alias("n")))
            live, done = met.select("node"), trees
    return edges.distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), the root being its component's smallest node.

    Alternates the large-star and small-star steps, which need a number of rounds logarithmic in the
    longest path; all state is in tables, none of it on the driver. A hub's edges are dealt out.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted(both.where("v > u"), low, ["u"], 16, [F.col("v")]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # what has no larger neighbour keeps its own smallest one
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted(large, least, ["u"], 16, [F.col("v")])
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = cut(small.where("u <> v").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold: shared shingles counted exactly, by matrix products over those that two sets hold."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(at, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    row, column = row[keep], column[at[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n_left, width = len(left), 4096
    both = np.zeros((n_left, len(right) if right is not None else n_left), np.float32)
    for c in range(0, int(shared.sum()), width):
        a, z = np.searchsorted(column, [c, c + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:z], column[a:z] - c] = 1
        both += m[:n_left] @ (m[n_left:] if right is not None else m).T
    other = sizes[n_left:] if right is not None else sizes
    union = sizes[:n_left, None] + other[None, :] - both
    found = both >= threshold * union - 1e-6
    if right is None:
        np.fill_diagonal(found, False)
    return found


def _roots(found: np.ndarray, square: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a link matrix, the smallest position (rows first) that links lead to."""
    r, c = found.shape
    rows, columns = np.arange(r), np.arange(c) if square else np.arange(c) + r
    big = r + c
    while True:
        new_rows = np.minimum(rows, np.where(found, columns[None, :], big).min(axis=1, initial=big))
        new_columns = new_rows if square else np.minimum(columns, np.where(found, new_rows[:, None], big).min(axis=0, initial=big))
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns


def _verify(threshold: float):
    """Per block pair of a component: each set's links in it, counted with copies, and a link towards its root."""

    def decided(group: tuple, parts: list[tuple]) -> list[tuple[int, int, int]]:
        _, a, b = group
        blocks, nodes, copies, sets = (np.concatenate([p[i] for p in parts]) if i < 3 else [s for p in parts for s in p[i]] for i in range(4))
        if a == b:
            found = _linked(sets, None, threshold)
            left = right = np.arange(len(sets))
        else:
            left, right = np.flatnonzero(blocks == a), np.flatnonzero(blocks == b)
            if not len(left) or not len(right):
                return []
            found = _linked([sets[i] for i in left], [sets[i] for i in right], threshold)
        rows, columns = _roots(found, a == b)
        name = nodes[left] if a == b else np.concatenate([nodes[left], nodes[right]])
        out = list(zip(nodes[left].tolist(), name[rows].tolist(), (found @ copies[right]).tolist(), strict=True))
        if a != b:
            out += zip(nodes[right].tolist(), name[columns].tolist(), (found.T @ copies[left]).tolist(), strict=True)
        return [x for x in out if x[2]]

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, out = [], None, []

        def ready() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ([], [], [])
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "root", "links"])
            out.clear()
            return batch

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("root", "a", "b")]
            cuts = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
            for i, z in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if i == z:
                    continue
                key = tuple(int(k[i]) for k in keys)
                if key != group:
                    if held:
                        out += decided(group, held)
                    held, group = [], key
                part = batch.slice(i, z - i)
                column = part.column("shingles")
                values, at = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())])
                held.append((part.column("block").to_numpy(), part.column("node").to_numpy(), part.column("copies").to_numpy(), [values[p:q] for p, q in zip(at[:-1], at[1:], strict=True)]))
            if len(out) > 10_000:
                yield ready()
        if held:
            out += decided(group, held)
        yield ready()

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Documents whose sets of 5-word shingles have a Jaccard similarity of ``threshold`` or more.

    Returns one row per input row: doc_id, class_id (the smallest doc_id among documents connected by
    links), n_links (the documents it is linked to, counting every copy), n_shingles.

    Documents with the same set are collapsed first. A forest of sorted tries, searched by each set at
    prefixes and in trees that depend on the company it meets, joins sets of one prefix in runs; the
    components of runs hold all candidate pairs, so each set's shingles are shipped once, and once per
    block for components above BLOCK_SHINGLES or BLOCK_SETS. Every pair in a component is counted
    exactly, in matrix form: no pair rows are made, and none is capped.

    Null and empty texts have no shingles and link to nothing; texts of 1 to 4 words are one shingle;
    texts of any length count whole; repeated rows are copies of each other; a null id is never a
    class's id unless there is no other; an empty table gives an empty one; other columns are not read.
    """
    steps = descent(threshold, recall)
    rows = stored(signatures(docs, *steps[-1]))
    full = rows.where("n > 0")
    reps = full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("strings").alias("strings"))
    reps = stored(reps.withColumn("node", F.monotonically_increasing_id()))
    members = cut(components(_candidates(reps, steps)))
    totals = reps.select("node", "n").join(members, "node").groupBy("root").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sets"))
    totals = totals.select("root", F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("sets") / BLOCK_SETS)).cast("int").alias("blocks"))
    needed = salted(members, totals, ["root"], 16, [F.col("node")]).join(reps.select("node", "rep", "copies", "set_key"), "node")
    needed = cut(needed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    few = needed.count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    texts = texts.join(F.broadcast(needed) if few else needed, texts["doc_id"].eqNullSafe(needed["rep"])).drop("doc_id", "rep")

    @trimmed
    def shipped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3_000_000):
                sets = shingles(part.column("text"))
                # a repeated id may come with another text
                own = np.array([hashlib.md5(s.tobytes()).digest() == k for s, k in zip(sets, part.column("set_key").to_pylist(), strict=True)], bool)
                sets = [s for s, ok in zip(sets, own, strict=True) if ok]
                part = part.filter(pa.array(own))
                at = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
                names = ["root", "node", "block", "blocks", "copies"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.ListArray.from_arrays(at, flat)], names=[*names, "shingles"])

    sets = texts.mapInArrow(shipped, "root long, node long, block int, blocks int, copies long, shingles array<long>")
    paired = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("root", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "node", "block", "copies", "shingles")
    # a row that repeats its id and text would ship its set twice
    paired = paired.repartition("root", "a", "b").dropDuplicates(["root", "a", "b", "node"]) if _repeats(rows) else paired.repartition("root", "a", "b")
    paired = paired.sortWithinPartitions("root", "a", "b", "node")
    found = cut(paired.mapInArrow(_verify(threshold), "node long, root long, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = cut(components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    named = classes.join(reps.select("node", "rep"), "node")
    ids = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = salted(classes, ids, ["root"], 16, [F.col("node")]).select("node", "class_id")
    told = reps.select("node", "set_key", "rep", "copies").join(named, "node", "left").join(links, "node", "left")
    told = told.select("set_key", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = full.select("doc_id", "n", "set_key").join(told, "set_key").drop("set_key")
    out = out.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("class_id"), F.lit(0).alias("n_links")))
    return out.select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), F.col("n").cast("long").alias("n_shingles"))


def _repeats(rows: DataFrame) -> bool:
    return bool(rows.groupBy("doc_id").count().where("count > 1").limit(1).count())


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each class: that with the class's id. Documents without words are classes of their own.

    The columns stay as they are, whatever their names. Of rows that repeat a kept id, those with its
    text are kept once; a document without id is kept if its class has no id at all; null and empty
    texts all stay, but for repeats of an id; an empty table gives an empty one.
    """
    result = cut(join(docs, **options))
    gone, key = free_name(docs.columns, "gone"), free_name(docs.columns, "text_key")
    dropped = result.where(F.col("class_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("class_id")))
    dropped = cut(dropped.select(F.col("doc_id").alias(gone)).distinct())
    few = dropped.count() <= BROADCAST_ROWS
    out = docs.join(F.broadcast(dropped) if few else dropped, docs["doc_id"].eqNullSafe(dropped[gone]), "left_anti")
    if _repeats(result):
        digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
        out = out.withColumn(key, digest).dropDuplicates(["doc_id", key]).drop(key)
    return out
