import math
import zlib

import pytest

from panmixia.llm import toxicity


def test_folding():
    assert toxicity.folded("Іdi0t ＳＣＵＭ cl0wn löser pаthetic").split() == ["idiot", "scum", "clown", "loser", "pathetic"]
    assert toxicity.folded("") == ""


def test_terms_and_exceptions():
    model = toxicity.ToxicityModel({" idiot ": 4.0, " lowei": 3.0}, frozenset({("idiot", "proof")}), (-2.0, 2.0, 1.0))
    assert model.score("you 1d1ot") > 0.5 > model.score("an idiot proof lock")
    assert model.score("loweisch") > 0.5 > model.score("slowei")
    assert model.score("") == model.score("fine words") < 0.5
    assert model.score("idiot " + "word " * 50) > model.score("idiot " + "word " * 5000)


def test_held_out_accuracy_and_no_leak(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    scored = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(scored) == docs.count()
    held = [(r["toxic"], scored[r["doc_id"]]["predicted"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(string(doc_id) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    other = toxicity.fit(docs, flipped)
    assert (other.weights, other.beta) == (model.weights, model.beta)


def test_awkward_rows_and_no_labels(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(awkward, none)
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(empty, model).count() == 0
    kept = toxicity.score(awkward, model, keep=tuple(awkward.columns))
    assert kept.count() == awkward.count() and sorted(kept.columns) == sorted({*awkward.columns, "predicted"})
    assert toxicity.keep_clean(awkward, model).columns == awkward.columns and toxicity.keep_clean(empty, model).count() == 0


def brute(model, raw):
    """Every place of every term, the longest at each place, words around it found by splitting."""
    text = f" {toxicity.folded(raw)} "
    total = 0.0
    for at in range(len(text)):
        found = max((t for t in model.weights if text.startswith(t, at)), key=len, default=None)
        if found is None:
            continue
        before, behind = text[:at].split(), text[at:].split()
        around = {(before[-1], behind[0])} if before else set()
        around |= {(behind[0], behind[1])} if len(behind) > 1 else set()
        if not around & model.exceptions:
            total += model.weights[found]
    n = len(text.split())
    a, b = math.log1p(total), math.log1p(100 * total / (n + 20)) if total else 0.0
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.beta[0] + model.beta[1] * a + model.beta[2] * b))))


def test_matches_brute_force(spark, texts):
    sf = "/root/testdata/sf0.01"
    learned = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    long = "q" * 300
    own = toxicity.ToxicityModel({" idiot ": 4.0, " idio": 2.0, " lowei": 3.0}, frozenset({(long, "idiot"), ("idiot", long)}), (-2.0, 2.0, 1.0))
    made = [f"{long} idiot {long}", f"idiot    {long}", "idiot", "1diot  idiotic \n lowei idiot", "", f"{long} x idiot", "idi0t proof"]
    for model in (learned, own):
        for t in [*made, *[(t or "")[:3000] for t in texts.values()]]:
            assert model.score(t) == pytest.approx(brute(model, t))
