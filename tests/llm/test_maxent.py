import dataclasses
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from panmixia.llm import maxent


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def check(rows, given):
    counts = Counter()
    for i, t in given:
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for i, t in given:
        w = tokens(t)
        expected[(i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == expected


def test_base_and_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = maxent.score(docs).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.85 * sum(r["base_score"] for r in out)


def test_model_sums_to_one(documents, monkeypatch):
    monkeypatch.setattr(maxent, "LEAST_COUNT", 8)
    from pyspark.sql import functions as F

    counts = documents.select("text").mapInArrow(maxent._counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    model = maxent.fit(documents, counts)
    head, total = model.head, sum(r["n"] for r in counts.collect())
    assert model.n == total and model.tail == total - int(head.counts.sum())
    p = np.exp(model.classes.astype(float))
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    used = np.unique(head.word_class)
    for before in [0, *np.flatnonzero((model.pairs != 0).any(axis=1))[:300].tolist()]:
        ids = np.arange(len(head.words))
        words = np.exp(model.word_log_probs(np.full(len(ids), before), ids))
        assert np.allclose(np.bincount(head.word_class, weights=words, minlength=maxent.CLASSES)[used], 1, atol=1e-4)
    assert maxent.TAIL not in head.word_class
    # and the outside: known words by their counts, the unseen as one
    assert (1 - model.unseen) * model.tail / model.tail + model.unseen == pytest.approx(1)


def test_rare_words_are_clustered_by_all_documents(spark):
    """2,000 words of two kinds in three documents each: all of a kind have the same neighbours."""
    from pyspark.sql import functions as F

    texts = [f"{k}0 {k}w{i} {k}1" for i in range(1000) for k in "lr"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = docs.select("text").mapInArrow(maxent._counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    head = maxent.fit(docs, counts, steps=1).head
    kinds = [{int(head.word_class[head.id[f"{k}w{i}".encode()]]) for i in range(1000)} for k in "lr"]
    assert not kinds[0] & kinds[1]


def test_contexts_do_not_cross_documents():
    head = maxent.Head([b"", b"a", b"b"], np.array([2.0, 3.0, 4.0]))
    head.word_class = np.array([0, 1, 2], np.int32)
    both = maxent.stream(head, [b"a", b"b", b"", b"z", b"a", b""], [3, 3])
    alone = maxent.stream(head, [b"z", b"a", b""], [3])
    assert both.cell[3:].tolist() == alone.cell.tolist() and both.before[3:].tolist() == alone.before.tolist()
    assert both.classes.tolist() == [1, 2, 0, maxent.TAIL, 1, 0]


def test_scores_match_a_plain_version(spark, documents, monkeypatch):
    """Every document's score word by word, from the model's tables, and its classes' weights by plain counts."""
    monkeypatch.setattr(maxent, "LEAST_COUNT", 6)
    docs = documents.where("doc_id < 60")
    models = []
    fitted = maxent.fit
    monkeypatch.setattr(maxent, "fit", lambda *a, **k: models.append(fitted(*a, **k)) or dataclasses.replace(models[-1]))
    rows = {r["doc_id"]: r for r in maxent.score(docs).collect()}
    model, texts = models[0], {r["doc_id"]: r["text"] for r in docs.collect()}
    head, counts = model.head, Counter()
    for i, t in texts.items():
        if not held(i):
            counts.update(tokens(t))

    def known(w):
        return head.id.get(w)

    def bucket(w):
        n = known(w)
        return maxent.TAIL * maxent.HASHES + zlib.crc32(w[-2:]) % maxent.HASHES if n is None else int(head.word_class[n]) * maxent.HASHES + zlib.crc32(w) % maxent.HASHES

    mass = Counter()
    for w, n in head.id.items():
        mass[int(head.word_class[n])] += head.counts[n] + 0.5
    for i, t in texts.items():
        w = [b"", b"", *tokens(t)]
        total = 0.0
        for k in range(2, len(w)):
            one, two, n = bucket(w[k - 1]), bucket(w[k - 2]) // maxent.HASHES, known(w[k])
            c = maxent.TAIL if n is None else int(head.word_class[n])
            total += float(model.classes[one * maxent.CLASSES + two, c])
            if n is None:
                total += math.log((1 - model.unseen) * counts[w[k]] / model.tail if counts[w[k]] else model.unseen)
            else:
                slot = zlib.crc32(w[k] + b"\0") % head.slots
                total += math.log((head.counts[n] + 0.5) / mass[c]) + float(model.pairs[one, slot]) - float(model.norms[one, c])
        assert rows[i]["score"] == pytest.approx(total / math.log(10), rel=1e-4)


def test_awkward(awkward, empty):
    check(maxent.score(awkward).collect(), [(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert maxent.score(empty).count() == 0


def test_driver_gets_one_table_a_step(spark, monkeypatch):
    """The driver's share of the training does not follow the number of partitions, and neither does the result."""
    from pyspark.sql.classic.dataframe import DataFrame

    rng, steps, got = np.random.default_rng(5), 3, []
    counts = [(int(b), rng.poisson(0.2, maxent.CLASSES**2).astype(np.int64).tobytes()) for b in rng.choice(maxent.BUCKETS, 24, replace=False)]
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: got.append(collect(self)) or got[-1])
    found = [maxent._train_classes(spark.createDataFrame(counts, "bucket int, cells binary").repartition(n), steps, n) for n in (8, 1)]
    assert np.allclose(*found, atol=1e-4)
    assert found[0][0].std() > 0
    tables = [x for rows in got for r in rows for x in r if isinstance(x, (bytes, bytearray))]
    assert len(tables) == 2 * (steps + 1)


def test_driver_takes_the_tables_in_parts(documents, monkeypatch):
    """No collected result holds more buckets than a part, and every bucket that was trained arrives."""
    from pyspark.sql import functions as F
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(maxent, "PART", 300)
    parts, rows, to_arrow, walk = [], [], DataFrame.toArrow, DataFrame.toLocalIterator
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: (t := to_arrow(self), parts.append(t.column("bucket").to_pylist()) if "bucket" in t.column_names else None)[0])
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *a: (rows.append(r) or r for r in walk(self, *a)))
    counts = documents.select("text").mapInArrow(maxent._counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    model = maxent.fit(documents, counts, steps=2)
    assert not rows and max(len(p) for p in parts) <= 300 and len(parts) == -(-maxent.BUCKETS // 300)
    got = [b for p in parts for b in p]
    assert len(got) == len(set(got)) > 300
    assert set(np.flatnonzero((model.norms != 0).any(axis=1)).tolist()) <= set(got)
