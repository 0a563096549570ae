from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from panmixia.llm import mixing, secrets, toxicity
from panmixia.llm.common import table

from .test_neardup import brute as near_duplicates
from .test_packing import check as packed


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    given = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, sf_dir).cache()
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    assert {r["doc_id"]: r for r in clean.collect()} == {i: r for i, r in given.items() if model.score(r["text"] or "") < 0.5}

    single = stages["near_duplicates"](spark, clean, sf_dir).cache()
    classes = near_duplicates({r["doc_id"]: r["text"] for r in clean.collect()})
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, (c, _) in classes.items() if c == i)

    safe = stages["secrets"](spark, single, sf_dir).cache()
    assert {r["doc_id"]: r["text"] for r in safe.collect()} == {r["doc_id"]: secrets.redacted(r["text"]) for r in single.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in safe.collect())

    mixed = stages["mix"](spark, safe, sf_dir).cache()
    plan = {r["doc_id"]: r for r in mixing.mix(safe).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, r in plan.items() if (n := int(r["taken"] / r["size"] + 0.5))})
    for stage in (clean, single, safe, mixed):
        assert stage.columns == docs.columns

    once = mixed.dropDuplicates(["doc_id"])
    packed(stages["pack"](spark, once, sf_dir).collect(), {r["doc_id"]: r["text"] for r in once.collect()})


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_stages_take_awkward_and_empty_tables(spark, sf_dir, awkward, empty):
    """Nulls, empty texts, repeats, and columns with the very names that the stages' own results have."""
    names = ("score", "predicted", "times", "planned", "copy", "gone", "text_key", "class_id", "taken", "size", "node")
    clashing = awkward
    for n in names:
        clashing = clashing.withColumn(n, F.lit(7))
    for docs, some in ((clashing, True), (clashing.where("false"), False)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert bool(out.count()) == some
            if name != "pack":
                assert out.columns == clashing.columns and out.where("score <> 7 or times <> 7 or node <> 7").count() == 0
                docs = out.cache()
