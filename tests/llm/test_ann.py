import math

import numpy as np
from pyspark.sql import functions as F

from panmixia.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, vec int, cell int"


def brute(rows, asked, k):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, v in rows:
        if asked(i):
            best = sorted(((-float((x * v).sum()), j) for j, x in rows if j != i))[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


def answers(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found.setdefault(r["query_id"], [])) + 1
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    return found


def test_recall_on_the_test_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    exact = brute([(r["vec_id"], r["embedding"]) for r in table.collect()], lambda i: i % 20 == 0, 20)
    got = answers(ann.search(table, F.col("vec_id") % 20 == 0, rows_per_shard=100))
    assert got.keys() == exact.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in exact[i]}) for i in exact)
    assert hits >= 0.9 * 20 * len(exact)
    scores = {(i, j): s for i, v in brute([(r["vec_id"], r["embedding"]) for r in table.collect()], lambda i: i % 20 == 0, 10**6).items() for j, s in v}
    assert all(abs(s - scores[i, j]) < 1e-12 for i, v in got.items() for j, s in v)


def recall(spark, given, monkeypatch):
    """Share of the true neighbours found, and of the rows that a walk must hold."""
    quotas = []
    fitted = ann.fit_quota
    monkeypatch.setattr(ann, "fit_quota", lambda *a, **k: quotas.append(fitted(*a, **k)) or quotas[-1])
    table = spark.createDataFrame([(i, v.tolist(), 0, None, None) for i, v in given.items()], SCHEMA)
    ids, x = np.array(list(given)), np.array(list(given.values()), np.float32).astype(float)
    got = answers(ann.search(table, F.col("vec_id") % 20 == 0))
    hits = n = 0
    for i in np.flatnonzero(ids % 20 == 0).tolist():
        s = x @ x[i]
        s[i] = -np.inf
        hits += len({j for j, _ in got[int(ids[i])]} & set(ids[np.argsort(-s)[:20]].tolist()))
        n += 20
    return hits / n, quotas[0] / len(given)


def test_recall_on_2000_random_vectors(spark, monkeypatch):
    """Directions without any structure, the hardest case: sf0.1's table."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found, share = recall(spark, {r["vec_id"]: np.array(r["embedding"]) for r in table.collect()}, monkeypatch)
    assert found >= 0.9 and share < 0.8


def test_recall_on_20000_vectors_of_unequal_norm(spark, monkeypatch):
    """2,000 neighbourhoods, norms from 0.2 to 5: few cells are walked."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(2000, 32))
    x = (centres[rng.integers(0, 2000, 20_000)] + 0.2 * rng.normal(size=(20_000, 32))) * np.exp(rng.uniform(-1.6, 1.6, (20_000, 1)))
    found, share = recall(spark, dict(enumerate(x)), monkeypatch)
    assert found >= 0.9 and share < 0.3


def test_ties_copies_and_unfit_vectors(spark):
    rng = np.random.default_rng(1)
    same = rng.normal(size=8)
    rows = [(i, same.tolist()) for i in range(300)] + [(300 + i, rng.normal(size=8).tolist()) for i in range(100)]
    bad = [(1000, None), (1020, [0.0] * 8), (1040, [math.nan] * 8), (1060, [1.0] * 7 + [math.inf]), (1080, [1.0] * 7 + [None]), (1100, [1.0, 2.0]), (None, same.tolist())]
    df = spark.createDataFrame([(i, v, 0, None, None) for i, v in rows + bad], SCHEMA)
    got = answers(ann.search(df, F.col("vec_id") % 20 == 0, rows_per_shard=64, quota=math.inf))
    exact = brute(rows, lambda i: i % 20 == 0, 20)
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in exact.items()}


def test_small_tables(spark):
    one = spark.createDataFrame([(0, [1.0, 0.0], 0, None, None), (1, [0.5, 0.5], 0, None, None), (0, [1.0, 0.0], 0, None, None)], SCHEMA)
    assert answers(ann.search(one, F.lit(True))) == {0: [(1, 0.5)], 1: [(0, 0.5), (0, 0.5)]}
    assert ann.search(one.where("vec_id > 5"), F.lit(True)).count() == 0


def test_traversal_visits_pairs_by_rising_distance():
    rng = np.random.default_rng(2)
    a, b, counts = rng.random(7), rng.random(5), rng.integers(0, 3, 35)
    walk = ann.traverse(a, b, counts, np.inf)
    sums = [a[c // 5] + b[c % 5] for c in walk]
    assert sums == sorted(sums) and set(walk) == set(np.flatnonzero(counts))
    assert sum(counts[c] for c in ann.traverse(a, b, counts, 9)) >= 9
