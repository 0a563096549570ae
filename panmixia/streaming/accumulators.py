"""Accumulators kept up by a stream of chunks of pairs.

All their fields are sums, minima or conditional counts, so a streaming aggregation's state is the
accumulators themselves and any batch of pairs, in any order, may come later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from panmixia.operators import genes


def running(pairs: DataFrame, *by: str) -> DataFrame:
    """The accumulators of a stream of rows with ``value``; write with update or complete mode."""
    return genes.accumulate(genes.from_values(pairs), *by)


def _batches(spark: SparkSession, path: str) -> tuple[list[int], object]:
    """Numbers of the batches that are written whole, in order, and the file system that holds them."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(p.getName()[6:]) for p in found if p.getName().startswith("batch=") and fs.exists(hadoop.Path(p, "_SUCCESS"))), fs


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The accumulators of the last batch that was written whole."""
    return spark.read.parquet(f"{path}/batch={_batches(spark, path)[0][-1]}")


def run_available(stream: DataFrame, path: str, checkpoint: str, *by: str) -> StreamingQuery:
    """Process what has arrived, and keep the latest accumulators under ``path`` as Parquet; a restart goes on from the checkpoint.

    Each batch has a folder of its own, and the one before stays until the new one is whole: a crash
    in between loses nothing, and a batch that is run again replaces its own folder.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        done, fs = _batches(spark, path)
        for old in done[:-2]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={old}"), True)

    return running(stream, *by).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()
