"""Toxicity: a learned weighted lexicon, matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panmixia.llm.common import cut, fold_of, hash_sample, slices, strings, trimmed

# Letters of other scripts that look like Latin ones, and digits and signs used for letters.
LOOKALIKES = dict(zip("аеорсухікмтвнѕјԁһԛԝαεορτυικνηβχ", "aeopcyxikmtbhsjdhqwaeoptuiknnbx", strict=True))
LEET = dict(zip("0134578@$", "oieastbas", strict=True))

_MARKS = re.compile("[̀-ͯ​-‍﻿­]+")
_OTHER = re.compile("[Ͱ-ԯ]")
_LOOK = str.maketrans(LOOKALIKES | {k.upper(): v for k, v in LOOKALIKES.items() if len(k.upper()) == 1})
_BYTES = bytes.maketrans(bytes(range(256)), bytes(ord(LEET.get(chr(i), chr(i).lower() if chr(i).isalpha() and i < 128 else " ")) for i in range(256)))
PREFIXES = range(4, 9)


def folded(text: str) -> str:
    """Lower-case Latin letters and spaces: marks dropped, lookalikes and digits put back."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        if _OTHER.search(text):
            text = text.translate(_LOOK)
        # what is still foreign breaks words, as a space does
    return text.encode("ascii", "replace").translate(_BYTES).decode("ascii")


def terms_of(text: str) -> set[str]:
    """A text's candidate terms: whole words, between spaces, and beginnings of words, after one."""
    found = set()
    for w in set(folded(text).split()):
        found.add(f" {w} ")
        found.update(f" {w[:k]}" for k in PREFIXES if k <= len(w))
    return found


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    exceptions: frozenset[tuple[str, str]]
    beta: tuple[float, float, float] = (-4.0, 0.0, 0.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "beta": self.beta, "_automaton": None}

    def matches(self, text: str) -> list[tuple[int, str]]:
        """(start, term) of every match, the longest at each start; exception phrases are left out."""
        if not self.weights:
            return []
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term in self.weights:
                self._automaton.add_word(term, term)
            self._automaton.make_automaton()
        best: dict[int, str] = {}
        for end, term in self._automaton.iter(text):
            start = end - len(term) + 1
            if len(term) > len(best.get(start, "")):
                best[start] = term
        return [(s, t) for s, t in sorted(best.items()) if not (self.exceptions and self.exceptions & phrases(text, s, t))]

    def features(self, raw: str) -> tuple[float, float]:
        text = f" {folded(raw)} "
        total = sum(self.weights[t] for _, t in self.matches(text))
        return math.log1p(total), math.log1p(100 * total / (len(text.split()) + 20)) if total else 0.0

    def score(self, raw: str) -> float:
        a, b = self.features(raw)
        z = self.beta[0] + self.beta[1] * a + self.beta[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def phrases(text: str, start: int, term: str) -> set[tuple[str, str]]:
    """The pairs of words around a match, whole however long: with the one before, and with the one after.

    ``text`` is folded and lies between spaces, so a term begins at a word's space or inside a word.
    """

    def word_at(i: int) -> tuple[str, int]:
        while i < len(text) and text[i] == " ":
            i += 1
        end = text.find(" ", i)
        end = len(text) if end < 0 else end
        return text[i:end], end

    word, end = word_at(start)
    after = [w] if (w := word_at(end)[0]) else []
    stop = start
    while stop > 0 and text[stop - 1] == " ":
        stop -= 1
    before = [text[text.rfind(" ", 0, stop) + 1 : stop]] if stop else []
    return {(x, word) for x in before} | {(word, x) for x in after}


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally: list[Counter] = [Counter(), Counter()]

    def flush():
        names = list(tally[0].keys() | tally[1].keys())
        if names:
            yield pa.RecordBatch.from_pydict({"term": names, "bad": [tally[1][x] for x in names], "good": [tally[0][x] for x in names]})
        tally[0].clear(), tally[1].clear()

    for batch in batches:
        for text, y in zip(strings(batch), batch.column("toxic").to_pylist(), strict=True):
            tally[y].update(terms_of(text))
            if len(tally[0]) + len(tally[1]) > 300_000:
                yield from flush()
    yield from flush()


def _bound(bad, good, n_bad, n_good):
    """Lower confidence bound of the log odds that a document with the term is toxic rather than not."""
    odds = math.log((bad + 0.5) / (n_bad + 1)) - math.log((good + 0.5) / (n_good + 1))
    return odds - 1.5 * math.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, min_docs: int = 4, extra_exceptions: Iterable[tuple[str, str]] = ()) -> ToxicityModel:
    """Learn weights, exception phrases and the length-normalised link.

    ``max_labelled`` bounds the labelled rows used: at most half of it per class, those of smallest
    hash. That bounds the label table that is broadcast, the candidate terms and what is collected.
    Rows whose crc32(doc_id) mod 5 is 0 are never used.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of("doc_id", 5) != 0)
    ).distinct()
    halves = [hash_sample(usable.where(F.col("toxic") == y), max_labelled // 2, "doc_id") for y in (0, 1)]
    sample = cut(halves[0].unionByName(halves[1]))
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    train = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    train = cut(train.where(F.col("text").isNotNull()))
    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return ToxicityModel({}, frozenset(extra_exceptions))
    terms = train.mapInArrow(_counts, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n[1] + 1)) - F.log((F.col("good") + 0.5) / (n[0] + 1))
    spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    found = terms.where((F.col("bad") >= min_docs) & (odds - 1.5 * spread > 1.5)).collect()
    ranked = sorted(found, key=lambda r: (len(r["term"].rstrip()), r["term"]))
    weights: dict[str, float] = {}
    bounds: dict[str, float] = {}
    for r in ranked:
        term, low = r["term"], _bound(r["bad"], r["good"], n[1], n[0])
        word = term.rstrip()
        if any(bounds.get(word[:k], -9) >= low for k in range(5, len(word) + 1)):
            continue  # a beginning of this term is at least as telling
        bounds[term] = low
        weights[term] = min(low, 6.0)
    model = ToxicityModel(weights, frozenset())
    learned = _exceptions(train, model, min_docs)
    model = ToxicityModel(weights, frozenset(learned) | frozenset(extra_exceptions))
    model.beta = _link(train, model, n, totals)
    return model


def _exceptions(train: DataFrame, model: ToxicityModel, min_docs: int) -> list[tuple[str, str]]:
    """Phrases around a term that only documents without the label hold."""

    def around(batches):
        for batch in batches:
            rows = []
            for text, y in zip(strings(batch), batch.column("toxic").to_pylist(), strict=True):
                t = f" {folded(text)} "
                rows += [(a, b, y) for a, b in {p for s, w in model.matches(t) for p in phrases(t, s, w)}]
            yield pa.RecordBatch.from_pydict({"a": [r[0] for r in rows], "b": [r[1] for r in rows], "y": pa.array([r[2] for r in rows], pa.int32())}, schema=pa.schema([("a", pa.string()), ("b", pa.string()), ("y", pa.int32())]))

    pairs = train.mapInArrow(around, "a string, b string, y int").groupBy("a", "b").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"))
    return [(r["a"], r["b"]) for r in pairs.where((F.col("n") >= 2 * min_docs) & (F.col("bad") == 0)).collect()]


def _link(train: DataFrame, model: ToxicityModel, n: dict, totals: dict) -> tuple[float, float, float]:
    """Logistic link on (log total weight, log weight a hundred words), a small ridge, classes at their true shares."""

    def measured(batches):
        for batch in batches:
            f = [model.features(t) for t in strings(batch)]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in f], pa.float64()), "b": pa.array([x[1] for x in f], pa.float64()), "toxic": batch.column("toxic")})

    got = train.mapInArrow(measured, "a double, b double, toxic int").select(F.round("a", 1).alias("a"), F.round("b", 1).alias("b"), "toxic")
    got = got.groupBy("a", "b", "toxic").count().orderBy("a", "b", "toxic").collect()
    x = np.array([[1.0, r["a"], r["b"]] for r in got])
    y = np.array([float(r["toxic"]) for r in got])
    w = np.array([r["count"] * totals[r["toxic"]] / n[r["toxic"]] for r in got], float)
    w /= w.sum() / 1000
    beta = np.zeros(3)
    ridge = np.array([1e-3, 0.05, 0.05])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (p - y)) + ridge * beta
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add score and predicted to the columns in ``keep``.

    One row per input row; null and empty texts get the score of a text without matches, texts of
    any length are read whole; repeated rows repeat; an empty table gives an empty one; with no
    labels at all nothing is predicted. Columns outside ``keep`` are dropped before they can clash, and
    columns of ``keep`` named score or predicted give way to the new ones.
    """
    keep = [c for c in keep if c.lower() not in ("score", "predicted")]
    schema = docs.select(*keep).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    names, kept = list(keep), list(keep)
    told = names if "text" in names else [*names, "text"]

    @trimmed
    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 4_000_000)):
            s = [model.score(t) for t in strings(batch)]
            columns = [batch.column(k) for k in kept] + [pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "score", "predicted"])

    return docs.select(*told).mapInArrow(scored, f"{out}, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows that the model does not predict to be toxic, with their columns as they are, of any names.

    Null and empty texts have no match; texts of any length are read whole; repeated rows share their
    fate; an empty table gives an empty one.
    """

    @trimmed
    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 4_000_000)):
            yield batch.filter(pa.array([model.score(t) < 0.5 for t in strings(batch)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
