"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panmixia.llm.common import fold_of, give_back, relieve, stored, strings, trimmed

#: A token that no word equals: a document's end, and the context before its first word.
END = b""
#: Words of at least this share of the training tokens are modelled one by one; there are at most 1 / HEAD_SHARE.
HEAD_SHARE = 2e-6
LEAST_COUNT = 3
CLASSES, CLUSTERS, CONTEXTS = 64, 8, 32
#: A class's words have so many hashes as contexts; a word has one of up to 2^SLOT_BITS hashes as what follows.
HASHES, SLOT_BITS = 32, 13
BUCKETS = CLASSES * HASHES
#: The last class holds all words outside the head, unseen ones included.
TAIL = CLASSES - 1
CELLS = BUCKETS * CLASSES
CHUNK = 200_000
#: Buckets whose tables the driver takes at once, 9 MB at most.
PART = 256
#: Counts that a weight must outweigh.
RIDGE = 1.0


def tokens(text: str) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def hashed(word: bytes, n: int) -> int:
    return zlib.crc32(word) % n


@trimmed
def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally: Counter = Counter()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.binary()), pa.array(tally.values(), pa.int64())], names=["token", "n"])
        tally.clear()
        return batch

    for batch in batches:
        for text in strings(batch):
            tally.update(tokens(text))
            if len(tally) > 400_000:
                yield flush()
    yield flush()


@dataclass
class Head:
    """The frequent words: counts, hashes, and, once induced, classes.

    A word before is known by its class and a hash of the word itself; one outside by that of its ending.
    """

    words: list[bytes]
    counts: np.ndarray
    word_class: np.ndarray | None = None

    def __post_init__(self):
        self.id = {w: i for i, w in enumerate(self.words)}
        self.hash = np.array([hashed(w, HASHES) for w in self.words], np.int32)
        self.slots = 1 << min(SLOT_BITS, max(8, len(self.words).bit_length() - 1))
        self.slot = np.array([hashed(w + b"\0", self.slots) for w in self.words], np.int32)

    def base(self) -> np.ndarray:
        """log P(word | class) by counts alone."""
        mass = np.bincount(self.word_class, weights=self.counts + 0.5, minlength=CLASSES)
        return np.log((self.counts + 0.5) / mass[self.word_class])

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words, -1 for those outside."""
        get = self.id.get
        return np.fromiter((get(w, -1) for w in words), np.int32, len(words))


def _documents(texts: list[str]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Tokens of some whole documents after another, and each one's number of tokens."""
    words, sizes = [], []
    for text in texts:
        own = tokens(text)
        words += own
        sizes.append(len(own))
        if len(words) > CHUNK:
            yield words, sizes
            words, sizes = [], []
    if sizes:
        yield words, sizes


@dataclass
class Stream:
    """A run of documents as arrays: word numbers and classes, and each token's contexts."""

    ids: np.ndarray
    starts: np.ndarray
    classes: np.ndarray
    before: np.ndarray
    cell: np.ndarray


def stream(head: Head, words: list[bytes], sizes: list[int]) -> Stream:
    """Contexts never reach over a document's start: what would lie before it is the end token."""
    ids = head.ids(words)
    starts = np.cumsum([0, *sizes[:-1]])
    outside = np.flatnonzero(ids < 0)
    classes = np.where(ids < 0, TAIL, head.word_class[ids])
    hashes = head.hash[ids]
    hashes[outside] = [hashed(words[i][-2:], HASHES) for i in outside.tolist()]
    end = head.id[END]

    def shifted(a: np.ndarray, first: int, by: int) -> np.ndarray:
        out = np.empty_like(a)
        out[by:], out[:by] = a[:-by] if len(a) > by else a[:0], first
        for k in range(by):
            at = starts + k
            out[at[at < len(out)]] = first
        return out

    # the word before by class and hash, and with the class of the one before that
    one = shifted(classes * HASHES + hashes, int(head.word_class[end]) * HASHES + int(head.hash[end]), 1)
    two = shifted(classes, int(head.word_class[end]), 2)
    return Stream(ids, starts, classes, one, one * CLASSES + two)


def _neighbours(train: DataFrame, head: Head, width: int) -> np.ndarray:
    """How often each head word has each of the ``width`` most frequent ones within three words of its document, over all of ``train``."""
    shared = train.sparkSession.sparkContext.broadcast(head)

    @trimmed
    def tallied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known.words) * width, np.int64)
        for batch in batches:
            for words, sizes in _documents(strings(batch)):
                ids = known.ids(words)
                own = np.repeat(np.arange(len(sizes)), sizes)
                for d in (1, 2, 3):
                    same = own[:-d] == own[d:]
                    for a, b in ((ids[:-d], ids[d:]), (ids[d:], ids[:-d])):
                        ok = same & (a >= 0) & (b >= 0) & (b < width)
                        np.add.at(total, a[ok].astype(np.int64) * width + b[ok], 1)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], names=["at", "n"])

    sums = train.select("text").mapInArrow(tallied, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    found = sums.select(F.col("at").cast("int"), F.col("n").cast("float")).toArrow()
    m = np.zeros(len(head.words) * width, np.float32)
    m[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return m


def _induce(train: DataFrame, head: Head) -> None:
    """Classes of head words: clusters by their neighbours among the most frequent ones, each split into words of like frequency."""
    width = min(CONTEXTS, len(head.words))
    m = _neighbours(train, head, width)
    m = np.log1p(m.reshape(len(head.words), width))
    norms = np.linalg.norm(m, axis=1)
    x = m / np.maximum(norms, 1e-9)[:, None]
    centres = [x[0]]
    for _ in range(CLUSTERS - 1):  # each next centre is the frequent word least like those there
        like = np.max(x[: 64 * CLUSTERS] @ np.array(centres).T, axis=1)
        centres.append(x[int(like.argmin())])
    c = np.array(centres)
    for _ in range(12):
        cluster = (x @ c.T).argmax(1)
        for g in range(CLUSTERS):
            if (own := x[(cluster == g) & (norms > 0)]).size:
                c[g] = own.sum(0) / max(np.linalg.norm(own.sum(0)), 1e-9)
    mass = np.bincount(cluster, weights=head.counts + 1, minlength=CLUSTERS)
    bins = np.maximum(1, np.floor((TAIL - CLUSTERS) * mass / mass.sum())).astype(int)
    head.word_class = np.zeros(len(head.words), np.int32)
    first = 0
    for g in range(CLUSTERS):
        own = np.flatnonzero(cluster == g)
        if len(own):
            root = np.sqrt(head.counts[own] + 1.0)
            share = (np.cumsum(root) - root) / root.sum()
            head.word_class[own] = first + np.minimum((share * bins[g]).astype(int), bins[g] - 1)
        first += bins[g]


def _statistics(train: DataFrame, shared) -> DataFrame:
    """Over all training tokens, counts of (word before, class of the one before that, class), a row per word before's bucket, and of (bucket, slot of the word) and (bucket, class) behind them.

    A task adds up dense arrays of fixed size and sends what has any counts once, as rows of numbers.
    """

    @trimmed
    def tallied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        one = np.zeros(CELLS * CLASSES, np.int32)
        two = np.zeros(BUCKETS * head.slots, np.int32)
        for batch in batches:
            for words, sizes in _documents(strings(batch)):
                s = stream(head, words, sizes)
                at, n = np.unique(s.cell.astype(np.int64) * CLASSES + s.classes, return_counts=True)
                one[at] += n.astype(np.int32)
                ok = s.ids >= 0
                at, n = np.unique(s.before[ok].astype(np.int64) * head.slots + head.slot[s.ids[ok]], return_counts=True)
                two[at] += n.astype(np.int32)
        one, two = one.reshape(BUCKETS, -1), two.reshape(BUCKETS, -1)
        own = np.flatnonzero(one.any(axis=1))
        for k in range(0, len(own), 64):
            part = own[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([x.tobytes() for x in one[part]]), pa.array([x.tobytes() for x in two[part]])], names=["bucket", "cells", "slots"])

    return train.select("text").mapInArrow(tallied, "bucket int, cells binary, slots binary")


def _summed(counts: DataFrame) -> DataFrame:
    """One row per bucket: the sums of all tasks' counts, as longs."""

    @trimmed
    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, [0, 0]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([x.tobytes()]) for x in held]], names=["bucket", "cells", "slots"])

        for batch in batches:
            for b, *both in zip(*[batch.column(c).to_pylist() for c in ("bucket", "cells", "slots")], strict=True):
                if b != bucket:
                    if bucket is not None:
                        yield row()
                    bucket, held = b, [0, 0]
                held = [x + np.frombuffer(y, np.int32).astype(np.int64) for x, y in zip(held, both, strict=True)]
        if bucket is not None:
            yield row()

    return counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(added, "bucket int, cells binary, slots binary")


#: Weights that cells share, one row of CLASSES each: bias, the word before by its hash, its class, the class before, both classes.
OFFSETS = np.cumsum([0, 1, BUCKETS, CLASSES, CLASSES, CLASSES * CLASSES])


def _features(cell: np.ndarray) -> list[np.ndarray]:
    one, two = cell // CLASSES, cell % CLASSES
    c = one // HASHES
    return [np.zeros_like(cell), OFFSETS[1] + one, OFFSETS[2] + c, OFFSETS[3] + two, OFFSETS[4] + c * CLASSES + two]


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=-1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=-1, keepdims=True))


def class_log_probs(weights: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return _log_softmax(sum(weights[f] for f in _features(cell)))


def _cells(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each bucket's cells with any counts, and their counts by class."""
    for b, raw in zip(batch.column("bucket").to_pylist(), batch.column("cells").to_pylist(), strict=True):
        counts = np.frombuffer(raw, np.int64).reshape(CLASSES, CLASSES)
        own = np.flatnonzero(counts.any(axis=1))
        yield b * CLASSES + own, counts[own].astype(np.float32)


def _train_classes(stats: DataFrame, steps: int, partitions: int = 8) -> np.ndarray:
    """Gradient updates of the weights that cells share: each step's gradient is summed over the partitions of the counts.

    A step divides by the model's own expected counts, which bound the curvature from above; a small
    ridge keeps weights of rare features near 0. Sums over partitions are made by a task, so that the
    driver gets one table as large as the weights a step, and the counts seen, which no step changes, once.
    """
    spark = stats.sparkSession
    # each task sends a gradient as large as the weights, so their number is fixed here
    rows = stats.select("bucket", "cells").coalesce(partitions)
    weights = np.zeros((int(OFFSETS[-1]), CLASSES), np.float32)

    def classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((n.sum(axis=0, dtype=float) for batch in batches for _, n in _cells(batch)), np.zeros(CLASSES))
        yield pa.RecordBatch.from_pydict({"total": [total.tolist()]})

    def by_feature(f: np.ndarray, values: np.ndarray, to: np.ndarray) -> None:
        order = np.argsort(f, kind="stable")
        ids, first = np.unique(f[order], return_index=True)
        to[ids] += np.add.reduceat(values[order], first, axis=0)

    def summed(of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all cells of what ``of`` makes of cells and their counts, by feature."""
        shape = weights.shape

        def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, np.float32)
            for batch in batches:
                for own, counts in _cells(batch):
                    values = of(own, counts)
                    for f in _features(own):
                        by_feature(f, values, total)
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "total": [total.tobytes()]})

        def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for raw in batch.column("total"):
                    total += np.frombuffer(raw.as_buffer(), np.float32).reshape(shape)
            yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

        parts = rows.mapInArrow(part, "part long, total binary").repartition(1).sortWithinPartitions("part")
        return np.frombuffer(parts.select("total").mapInArrow(whole, "total binary").first()["total"]).reshape(shape)

    total = sum((np.array(r["total"]) for r in rows.mapInArrow(classes, "total array<double>").collect()), np.zeros(CLASSES))
    weights[0] = np.log((total + 0.5) / (total.sum() + 0.5 * CLASSES))
    active = 4
    seen = summed(lambda own, counts: counts)

    for _ in range(steps):
        shared = spark.sparkContext.broadcast(weights)
        expected = summed(lambda own, counts, shared=shared: np.exp(class_log_probs(shared.value, own)) * counts.sum(1, keepdims=True))
        step = (seen - expected - weights) / (np.maximum(expected, seen / 4) + 2.0)
        step[0] = 0.0
        weights = (weights + np.clip(step, -2, 2) / active).astype(np.float32)
        shared.destroy()
    return weights


def _train_buckets(stats: DataFrame, shared, weights, steps: int = 12) -> DataFrame:
    """bucket, classes, slots, norms: what only a bucket's own tokens tell, on top of the shared weights.

    Log probabilities of the classes in each of its cells, with a weight per (bucket, class of the word
    before that, class); weights per (bucket, slot of the word), the hashed pairs of words; and the
    logarithms by which these make each class's words sum to 1. Buckets share none of them, so each
    one's updates run where its counts are. Pairs without counts have the weight 0.
    """

    @trimmed
    def trained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, w = shared.value, weights.value
        share, by_slot = np.exp(head.base()), np.argsort(head.slot, kind="stable")
        first = np.searchsorted(head.slot[by_slot], np.arange(head.slots + 1))
        for batch in batches:
            for b, (own, counts), raw in zip(batch.column("bucket").to_pylist(), _cells(batch), batch.column("slots").to_pylist(), strict=True):
                base = class_log_probs(w, b * CLASSES + np.arange(CLASSES))
                z, at = base[own % CLASSES], np.zeros_like(counts)
                for _ in range(steps):
                    expected = np.exp(_log_softmax(z + at)) * counts.sum(1, keepdims=True)
                    at += 0.5 * np.clip((counts - expected - RIDGE * at) / (np.maximum(expected, counts / 4) + RIDGE), -2, 2)
                base[own % CLASSES] = _log_softmax(z + at)
                seen = np.frombuffer(raw, np.int64)
                held = np.flatnonzero(seen)
                size = first[held + 1] - first[held]
                words = by_slot[np.repeat(first[held] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                of, kind, p = np.repeat(np.arange(len(held)), size), head.word_class[words], share[words]
                n = counts.sum(axis=0, dtype=float)
                pair = np.zeros(len(held))
                for _ in range(steps):
                    e = p * np.exp(pair[of])
                    norm = 1 + np.bincount(kind, e - p, CLASSES)
                    expected = np.bincount(of, n[kind] * e / norm[kind], len(held))
                    pair += 0.7 * np.clip((seen[held] - expected - RIDGE * pair) / (np.maximum(expected, seen[held] / 4) + RIDGE), -2, 2)
                slots = np.zeros(head.slots, np.float16)
                slots[held] = pair
                pair = slots[held].astype(float)
                norm = np.log(1 + np.bincount(kind, p * np.exp(pair[of]) - p, CLASSES)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *[pa.array([x.tobytes()]) for x in (base.astype(np.float32), slots, norm)]], names=["bucket", "classes", "slots", "norms"])

    return stats.mapInArrow(trained, "bucket int, classes binary, slots binary, norms binary")


def _gather(trained: DataFrame, into: dict[str, np.ndarray]) -> None:
    """Write the buckets' rows, tens of MB in all, into arrays. They come by stretches of buckets, so what the driver's JVM holds at once has a bound."""
    for k in range(0, BUCKETS, PART):
        t = trained.where(F.col("bucket").between(k, k + PART - 1)).toArrow()
        buckets = t.column("bucket").to_pylist()
        for name, to in into.items():
            for b, raw in zip(buckets, t.column(name), strict=True):
                to[b] = np.frombuffer(raw.as_buffer(), to.dtype)


@dataclass
class Model:
    """What scoring needs: bounded by the head's size and the hashed tables, whatever the corpus."""

    head: Head
    classes: np.ndarray
    pairs: np.ndarray
    norms: np.ndarray
    n: int
    v: int
    tail: int
    unseen: float

    def word_log_probs(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log P(word | class, word before) of head words."""
        head = self.head
        return head.base()[ids] + self.pairs[before, head.slot[ids]] - self.norms[before, head.word_class[ids]]


def fit(train: DataFrame, counts: DataFrame, steps: int = 14) -> Model:
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = counts.where((F.col("n") >= F.lit(max(HEAD_SHARE * n, LEAST_COUNT))) | (F.col("token") == F.lit(bytearray(END)))).toArrow()
    pairs = sorted(zip(frequent.column("token").to_pylist(), frequent.column("n").to_pylist(), strict=True), key=lambda p: (-p[1], p[0]))
    if not any(w == END for w, _ in pairs):
        pairs.append((END, 0))
    head = Head([w for w, _ in pairs], np.array([c for _, c in pairs], float))
    tail = int(n) - sum(c for _, c in pairs)
    once = counts.where("n = 1").count()
    unseen = (once + 1) / (tail + 2) if tail else 1.0
    _induce(train, head)
    sc = train.sparkSession.sparkContext
    shared = sc.broadcast(head)
    stats = stored(_summed(_statistics(train, shared)))
    weights = _train_classes(stats, steps)
    shared_weights = sc.broadcast(weights)
    trained = stored(_train_buckets(stats, shared, shared_weights))
    classes = np.empty((BUCKETS, CLASSES * CLASSES), np.float32)
    for b in range(BUCKETS):
        classes[b] = class_log_probs(weights, b * CLASSES + np.arange(CLASSES)).ravel()
    pairs, norms = np.zeros((BUCKETS, head.slots), np.float16), np.zeros((BUCKETS, CLASSES), np.float32)
    shared_weights.destroy()
    shared.destroy()
    relieve(train.sparkSession)
    _gather(trained, {"classes": classes, "slots": pairs, "norms": norms})
    give_back()
    relieve(train.sparkSession)
    return Model(head, classes.reshape(CELLS, CLASSES), pairs, norms, int(n), int(v), tail, min(unseen, 0.99) if tail else 1.0)


_DOC = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("n_tail", pa.int64()), ("base_head", pa.float64()), ("score_head", pa.float64()), ("tail", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])


def _scored(docs: DataFrame, shared) -> DataFrame:
    """Per row: sums over head words and over classes, and the words outside the head with their counts."""

    @trimmed
    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        head = m.head
        base, own = np.log10((head.counts + 1) / (m.n + m.v + 1)), head.base()
        for batch in batches:
            doc_ids = batch.column("doc_id")
            at = 0
            for words, sizes in _documents(strings(batch)):
                s = stream(head, words, sizes)
                inside = s.ids >= 0
                p = m.classes[s.cell, s.classes].astype(float)
                ids, before = s.ids[inside], s.before[inside]
                p[inside] += own[ids] + m.pairs[before, head.slot[ids]] - m.norms[before, s.classes[inside]]
                b = np.where(inside, base[s.ids], 0.0)
                ends = np.append(s.starts[1:], len(words))
                tails = [Counter(words[a + i] for i in np.flatnonzero(~inside[a:z]).tolist()) for a, z in zip(s.starts.tolist(), ends.tolist(), strict=True)]
                n_head = np.add.reduceat(inside.astype(np.int64), s.starts)
                columns = [doc_ids.slice(at, len(sizes)), pa.array(sizes, pa.int64()), pa.array(n_head), pa.array(np.array(sizes) - n_head), pa.array(np.add.reduceat(b, s.starts)), pa.array(np.add.reduceat(p, s.starts) / math.log(10)), pa.array([list(t) for t in tails], pa.list_(pa.binary())), pa.array([list(t.values()) for t in tails], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, schema=_DOC)
                at += len(sizes)

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n_tokens long, n_head long, n_tail long, base_head double, score_head double, tail array<binary>, times array<int>")


def score(docs: DataFrame, folds: int = 7, held_out: int = 2, **options) -> DataFrame:
    """Score every text by a smoothed unigram base and by the model, both learned from the other folds.

    Words whose share of the training tokens is at least HEAD_SHARE are few whatever the corpus and
    are scored where the text is; the others, whose number has no bound but none of which is common,
    are joined with their counts. In the model they share a class, in which unseen words together have
    the share of words seen once (Good and Turing's) and the known ones the rest by their counts, so it
    sums to 1 over known words and the unseen as one, which is also what the base is spread over.

    One row per input row, repeated rows included; null and empty texts are an end alone; texts of any
    length are read whole; a null id counts as an empty text in the fold; without training rows N and
    V are 0; other columns are not read.
    """
    train = docs.where(fold_of("doc_id", folds) != held_out).select("doc_id", "text")
    counts = stored(train.select("text").mapInArrow(_counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")))
    model = fit(train, counts, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    table = stored(_scored(docs, shared).withColumn("row", F.monotonically_increasing_id()))
    shared.destroy()  # the table is written, so nothing reads it again
    model.classes = model.pairs = model.norms = None
    give_back()
    relieve(docs.sparkSession)
    tails = table.where("n_tail > 0").select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("token"), F.col("t.times").alias("times"))
    joined = tails.join(counts, "token", "left").select("row", "times", F.coalesce(F.col("n"), F.lit(0)).alias("c"))
    sums = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10(F.greatest("c", F.lit(1)))).alias("shares"))
    out = table.select("row", "doc_id", "n_tokens", "n_head", "n_tail", "base_head", "score_head").join(sums, "row", "left")
    logs, shares = F.coalesce(F.col("logs"), F.lit(0.0)), F.coalesce(F.col("shares"), F.lit(0.0))
    known = F.coalesce(F.col("known"), F.lit(0))
    known_share = math.log10((1 - model.unseen) / model.tail) if model.tail else 0.0
    in_training = F.lit(model.n > 0).cast("long")
    return out.select(
        "doc_id", (fold_of("doc_id", folds) == held_out).alias("held_out"), "n_tokens",
        (F.col("n_head") * in_training + known).cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base_head") + logs - F.col("n_tail") * math.log10(model.n + model.v + 1)).alias("base_score"),
        (F.col("score_head") + shares + known * known_share + (F.col("n_tail") - known) * math.log10(model.unseen)).alias("score"),
    )
