import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from panmixia.llm import neardup


def sets(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(given):
    """Per document: class, links."""
    s = {i: sets(t) for i, t in given.items()}
    holders = defaultdict(list)
    for i, x in s.items():
        for g in x:
            holders[g].append(i)
    both = Counter((a, b) for ids in holders.values() for k, a in enumerate(sorted(ids)) for b in sorted(ids)[k + 1 :])
    root, links = {i: i for i in s}, Counter()

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in both.items():
        if n >= 0.8 * (len(s[a]) + len(s[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (top(i), links[i]) for i in s}


def check(rows, given):
    expected = brute(given)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {i: len(sets(t)) for i, t in given.items()}


def test_matches_brute_force(documents, texts):
    check(neardup.join(documents).collect(), texts)


def test_chains_copies_and_a_large_group(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"t{rng.randrange(9999)}" for _ in range(120)]
    given = {i: " ".join(base) for i in range(20)}
    for i in range(20, 110):
        w = list(base)
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(len(w))] = f"u{rng.randrange(99999)}"
        given[i] = " ".join(w)
    for i in range(110, 130):  # a chain whose ends have little in common
        given[i] = " ".join(f"c{j}" for j in range(4 * (i - 110), 4 * (i - 110) + 100))
    given |= {200: "three short words", 201: "three short words", 202: "", 203: None, 204: "three short"}
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 2000)  # several blocks, and block pairs
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    check(neardup.join(spark.createDataFrame(list(given.items()), "doc_id long, text string")).collect(), given)


def test_lone_pairs_at_the_threshold(spark):
    """2,000 pairs of similarity 0.8, at the parameters that the query has."""
    given = {}
    for i in range(2000):
        words = [f"p{i}x{j}" for j in range(44)]
        given[2 * i], given[2 * i + 1] = " ".join(words[:40]), " ".join(words[:36] + words[40:])
    rows = neardup.join(spark.createDataFrame(list(given.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == {i: (i - i % 2, 1) for i in given}


def test_descent_reaches_the_recall():
    steps = neardup.descent()
    assert [d for _, d in steps] == [3, 5, 7] and sum((1 - 0.8**d) ** t for t, d in steps) <= 1 - neardup.RECALL
    assert all(t <= neardup.MOST_TREES for s in (0.5, 0.7, 0.9, 1.0) for t, _ in neardup.descent(s))


def test_tries_against_plain_prefixes(spark):
    """Links and company of every set, by comparing all strings; runs cross partitions."""
    rng = np.random.default_rng(5)
    depth, trees = 7, 3
    width = neardup._width(depth)
    raw = rng.integers(0, 2, (400, trees * width), dtype=np.uint8)
    raw[:60] = raw[0]  # one string under many sets
    reps = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(raw)], "node long, strings binary").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = neardup.cut(neardup._candidates(reps, [(1, 3), (3, 7)]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = dict(neardup.components(edges).collect())

    def values(i, t):
        s = raw[i, t * width : (t + 1) * width].tolist()
        return [*zip(s[:6:2], s[1:6:2], strict=True), *s[6:]]

    met = {i for i in range(400) if any(j != i and values(i, 0)[:3] == values(j, 0)[:3] for j in range(400))}
    root = {i: i for i in range(400)}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for t in range(trees):
        for i in range(400):
            for j in range(i):
                if values(i, t) == values(j, t) and (t == 0 or {i, j} <= met):
                    x, y = sorted((top(i), top(j)))
                    root[y] = x
    classes = {i: top(i) for i in range(400)}
    shared = Counter(classes.values())
    assert got == {i: c for i, c in classes.items() if shared[c] > 1}


def test_many_small_sets_of_a_template(spark):
    """5,000 texts of 12 words that differ in one: linked pairs by rule, in blocks that are bounded by sets."""
    given = [(i, f"this is page number n{i} of the book that we read") for i in range(3000)]
    given += [(5000 + i, f"this is the book that we read on page number n{i // 2} today") for i in range(1000)]
    rows = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in neardup.join(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert rows == {**{i: (i, 0) for i in range(3000)}, **{5000 + i: (5000 + i - i % 2, 1) for i in range(1000)}}


def test_signatures_estimate_similarity():
    a, b = neardup._permutations(2048)
    x, y = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(200, 1200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    same = np.mean(neardup.signature(x, a, b) == neardup.signature(y, a, b))
    assert abs(same - 800 / 1200) < 0.05


def test_shingles_of_awkward_texts():
    got = neardup.shingles(pa.array([None, "", " ", "a", " a ", "a b c d e", "a\tb\nc d  e ", "a b c d e f"]))
    assert [len(s) for s in got] == [0, 0, 0, 1, 1, 1, 1, 2]
    assert got[3] == got[4] and got[5] == got[6] and got[5][0] in got[7]


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    rows = dict(neardup.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert rows == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}


def test_awkward(awkward, empty):
    rows = neardup.join(awkward).collect()
    assert len(rows) == awkward.count()
    by = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows)
    assert by[(1, 1, 2)] == 2 and by[(None, 1, 2)] == 1 and by[(3, 3, 0)] == 1
    assert neardup.join(empty).count() == 0
    kept = Counter(r["doc_id"] for r in neardup.keep_one(awkward).collect())
    assert kept == Counter(range(1, 10))
    assert neardup.keep_one(awkward).columns == awkward.columns
