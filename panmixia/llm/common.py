"""What the operators share: reading tables, cutting lineage, byte-exact words."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than these (in Java's syntax).
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session where none is set, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores behind it while a column in ``taken`` has that name in any case."""
    names = {c.lower() for c in taken}
    while base.lower() in names:
        base += "_"
    return base


def cut(df: DataFrame) -> DataFrame:
    """Compute once, into the shared folder: later readers do not recompute, and a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, for wide or nested rows: a Parquet table in the shared folder, so that readers take single columns."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The ``n`` rows of smallest key hash (all, if fewer), of columns that may be wide.

    What is sorted has a hash below four times the n-th one expected, so it does not grow with the
    table; where keys repeat so often that fewer than n rows have such a hash, all rows are sorted.
    """
    h = F.shiftrightunsigned(F.xxhash64(*keys), 1)
    total = df.count()
    if total > 8 * n:
        low = df.where(h < int(2**63 * 4 * n / total))
        if low.limit(n).count() == n:
            df = low
    return df.orderBy(h, *keys).limit(n)


def give_back() -> None:
    """Return memory that a worker no longer needs to the system; workers are used again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def relieve(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage and shrink its heap, which else grows to its limit before it does."""
    spark.sparkContext._jvm.System.gc()


def trimmed(f):
    """A map over batches whose worker gives memory back when its task ends, since workers are used again.

    Cyclic collection is off meanwhile: the maps make no cycles, and it would walk their large tables again and again.
    """

    @functools.wraps(f)
    def run(batches):
        gc.disable()
        try:
            yield from f(batches)
        finally:
            gc.enable()
            give_back()

    return run


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (a plain alias may be inlined into every lambda call)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold_of(name: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as str, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def slices(batch: pa.RecordBatch, size: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text, one row at least: long texts make short parts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        stop = max(done, at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def words_of(text: str | bytes) -> list[bytes]:
    """bytes.split() breaks at exactly the six ASCII spaces."""
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).split()


def salted(big: DataFrame, small: DataFrame, keys: list[str], salts: int, spread: list[Column]) -> DataFrame:
    """Left join on null-safe ``keys`` in which each key's rows of ``big`` go to ``salts`` partitions.

    ``small`` has one row per key; its columns other than the keys are added. ``spread`` are the
    columns of ``big`` that deal a key's rows out.
    """
    other = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    other = other.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = big.withColumn("__part", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    on = F.col("__part") == F.col("__salt")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return dealt.join(other, on, "left").drop("__part", "__salt", *[f"__{k}" for k in keys])
