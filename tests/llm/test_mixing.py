import hashlib
import math
from collections import Counter, defaultdict

import pytest

from panmixia.llm import mixing


def targets(sizes):
    """Sources by code point with null last; caps taken away one after another."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, left = sum(sizes.values()), {}, set(order)
    while True:
        rest, w = total - sum(out.values()), sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / w > 3 * sizes[s]}
        if not over:
            return out | {s: rest * weight[s] / w for s in left}
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= over


def expected_rows(given):
    """Per document what its source's rounds take, word by word: (doc_id, size, taken) with their number."""
    sized = [(i, s, len((t or "").encode().split())) for i, s, t in given]
    sizes = Counter()
    for _, s, n in sized:
        sizes[s] += n
    out = Counter()
    for source, goal in targets(sizes).items():
        own = sorted((hashlib.md5(f"{'' if i is None else i}:{n}".encode()).hexdigest()[:15], i is not None, i or 0, n) for i, s, n in sized if s == source)
        owner = [k for k, (_, _, _, n) in enumerate(own) for _ in range(n)]
        count = Counter(owner[k % len(owner)] for k in range(min(3 * sizes[source], math.floor(goal + 0.5)))) if owner else {}
        for k, (_, known, i, n) in enumerate(own):
            out[i if known else None, n, count.get(k, 0)] += 1
    return out


def check(rows, given):
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in rows) == expected_rows(given)
    words = [(i, s, len((t or "").encode().split())) for i, s, t in given]
    sizes = Counter()
    for _, s, n in words:
        sizes[s] += n
    goal = targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, n) for i, _, n in words)
    by = defaultdict(lambda: [0, set()])
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source_no"]][0] += r["taken"]
        by[r["source_no"]][1].add((r["source_size"], r["target"]))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    for no, (taken, told) in by.items():
        source = order[no - 1]
        assert len(told) == 1 and next(iter(told)) == (sizes[source], pytest.approx(goal[source]))
        assert abs(taken - goal[source]) <= 1


def test_matches_brute_force(documents):
    rows = mixing.mix(documents).collect()
    check(rows, [(r["doc_id"], r["source"], r["text"]) for r in documents.collect()])
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(documents.repartition(5)).collect()))


def test_awkward(awkward, empty):
    check(mixing.mix(awkward).collect(), [(r["doc_id"], r["source"], r["text"]) for r in awkward.collect()])
    assert mixing.mix(empty).count() == mixing.resample(empty).count() == 0
    assert mixing.resample(awkward).columns == awkward.columns


def test_hot_keys(spark):
    """Null ids, one id over and over, and many empty texts of one source, against brute force."""
    given = [(None, "a", "w " * 7)] * 500 + [(1, "a", "w " * 5)] * 300 + [(i, "b", "") for i in range(400)] + [(2000 + i, "b", "w " * (i % 50)) for i in range(300)]
    check(mixing.mix(spark.createDataFrame(given, "doc_id long, source string, text string").repartition(6)).collect(), given)


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 2)
    monkeypatch.setattr(mixing, "CHUNK_SLOTS", 8)
    given = [(i, f"host{i % 900}", "w " * (i * 7 % 400)) for i in range(2700)]
    check(mixing.mix(spark.createDataFrame(given, "doc_id long, source string, text string")).collect(), given)


def test_sums_before_in_stretches(spark):
    rows = [(k, i, i + k) for k in (1, 2) for i in range(300)]
    got = mixing._sums_before(spark.createDataFrame(rows, "k int, i int, v int"), "k", "i", "v", wide=16).collect()
    assert {(r["k"], r["i"]): r["before"] for r in got} == {(k, i): sum(j + k for j in range(i)) for k, i, _ in rows}


def test_capped_sources(spark):
    given = [(i, s, "w " * n) for i, (s, n) in enumerate([("a", 10), ("b", 3000), ("c", 700), (None, 900), ("d", 1), ("é", 2500)] * 3)]
    check(mixing.mix(spark.createDataFrame(given, "doc_id long, source string, text string")).collect(), given)


def test_schedule_is_spread_evenly(spark):
    given = [(i, s, "w " * 2560) for i, s in enumerate("abc" * 20)]
    docs = spark.createDataFrame(given, "doc_id long, source string, text string")
    from pyspark.sql import functions as F

    groups = mixing._grouped(docs.select("doc_id", "source", F.lit(2560).cast("long").alias("size")))
    slots = mixing.schedule(mixing._targets(groups)).where("slot is not null").orderBy("slot").collect()
    first = Counter(r["source_no"] for r in slots[: len(slots) // 2])
    whole = Counter(r["source_no"] for r in slots)
    assert all(abs(first[s] - whole[s] / 2) <= 3 for s in whole)


def test_resample_follows_the_plan(documents):
    plan = {r["doc_id"]: r for r in mixing.mix(documents).collect()}
    got = Counter(r["doc_id"] for r in mixing.resample(documents).collect())
    assert all(got[i] == (int(r["taken"] / r["size"] + 0.5) if r["size"] else 1) for i, r in plan.items())
