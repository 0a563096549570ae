"""Joins of points and intervals, by equal bins first so that no side is broadcast or crossed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(lo: Column, hi: Column, width: float) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(hi / width))


def point_join(points: DataFrame, intervals: DataFrame, pos: str = "pos", start: str = "start", end: str = "end", width: float = 10_000.0, half_open: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Every point with every interval that holds it; closed intervals, or [start, end)."""
    left = points.withColumn("__bin", F.floor(F.col(pos) / width))
    right = intervals.withColumn("__bin", F.explode(_bins(F.col(start), F.col(end), width)))
    inside = (F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(end) if half_open else F.col(pos) <= F.col(end))
    return left.join(right, ["__bin", *by]).where(inside).drop("__bin")


def overlap_join(a: DataFrame, b: DataFrame, a_range: tuple[str, str], b_range: tuple[str, str], width: float = 10_000.0) -> DataFrame:
    """Pairs of overlapping closed intervals, each once: in the first bin that both reach."""
    (a0, a1), (b0, b1) = a_range, b_range
    left = a.withColumn("__bin", F.explode(_bins(F.col(a0), F.col(a1), width)))
    right = b.withColumn("__bin", F.explode(_bins(F.col(b0), F.col(b1), width)))
    first = F.floor(F.greatest(F.col(a0), F.col(b0)) / width)
    return left.join(right, "__bin").where((F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1)) & (F.col("__bin") == first)).drop("__bin")


def mask_flags(genes: DataFrame, masks: DataFrame, share: float = 0.5, merge: bool = False) -> DataFrame:
    """gene rows with the covered share and whether it reaches ``share``; overlapping masks count twice unless merged."""
    if merge:
        order = Window.orderBy("m_start").rowsBetween(Window.unboundedPreceding, -1)
        starts = masks.withColumn("__new", (F.col("m_start") > F.coalesce(F.max("m_end").over(order), F.lit(float("-inf")))).cast("int"))
        starts = starts.withColumn("__run", F.sum("__new").over(Window.orderBy("m_start").rowsBetween(Window.unboundedPreceding, 0)))
        masks = starts.groupBy("__run").agg(F.min("m_start").alias("m_start"), F.max("m_end").alias("m_end")).drop("__run")
    pairs = overlap_join(genes.select("gene_id", "start", "end"), masks.select("m_start", "m_end"), ("start", "end"), ("m_start", "m_end"))
    covered = pairs.groupBy("gene_id").agg(F.sum(F.least("end", "m_end") - F.greatest("start", "m_start")).alias("covered"))
    out = genes.join(covered, "gene_id", "left")
    part = F.coalesce("covered", F.lit(0.0)) / (F.col("end") - F.col("start"))
    return out.withColumn("fraction", part).withColumn("masked", part >= share).drop("covered")


def nearest_gene(points: DataFrame, genes: DataFrame, within: float = 500_000.0, key: str = "point_id") -> DataFrame:
    """Per point the first overlapping gene, else that of the nearest centre within reach, else an empty name."""
    reach = genes.select("gene_id", "gene_name", "start", "end", ((F.col("start") + F.col("end")) / 2).alias("centre"))
    reach = reach.withColumns({"lo": F.least(F.col("start"), F.col("centre") - within), "hi": F.greatest(F.col("end"), F.col("centre") + within)})
    met = point_join(points, reach, start="lo", end="hi", width=within)
    overlaps = (F.col("pos") >= F.col("start")) & (F.col("pos") <= F.col("end"))
    far = F.when(overlaps, 0.0).otherwise(F.abs(F.col("pos") - F.col("centre")))
    best = met.groupBy(key).agg(F.min_by("gene_name", F.struct((~overlaps).cast("int"), far, F.col("gene_id"))).alias("gene_name"))
    return points.join(best, key, "left").withColumn("gene_name", F.coalesce("gene_name", F.lit("")))


def first_label(points: DataFrame, labelled: DataFrame, key: str = "point_id") -> DataFrame:
    """Per point the name of the first interval, in the order of ``ord``, that holds it."""
    met = point_join(points, labelled)
    best = met.groupBy(key).agg(F.min_by("name", "ord").alias("label"))
    return points.join(best, key, "left")


def band_join(points: DataFrame, centres: DataFrame, half: float, pos: str = "pos", centre: str = "centre") -> DataFrame:
    """Points within ``half`` of a centre, both ends included."""
    windows = centres.withColumns({"__lo": F.col(centre) - half, "__hi": F.col(centre) + half})
    return point_join(points, windows, pos, "__lo", "__hi", width=max(2 * half, 1.0)).drop("__lo", "__hi")


def interpolate(grid: DataFrame, source: DataFrame, chunk: float = 1_000_000.0) -> DataFrame:
    """Values of ``source`` (pos, value) at the positions of ``grid``: linear between neighbours, flat beyond the ends.

    Neighbours are looked up inside chunks of positions; each chunk also gets the last point before it
    and the first after it, so no window spans the whole sequence.
    """
    cell = F.floor(F.col("pos") / chunk)
    ends = source.groupBy(cell.alias("cell")).agg(F.min_by(F.struct("pos", "value"), "pos").alias("first"), F.max_by(F.struct("pos", "value"), "pos").alias("last"))
    cells = grid.select(cell.alias("cell")).distinct().unionByName(ends.select("cell")).distinct().join(ends, "cell", "left")
    w = Window.orderBy("cell")  # one row per chunk
    edges = cells.select(
        "cell",
        F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    extra = edges.select("cell", F.explode(F.array("before", "after")).alias("p")).where("p is not null").select("cell", F.col("p.pos").alias("pos"), F.col("p.value").alias("value"))
    known = source.select(cell.alias("cell"), "pos", "value").unionByName(extra).withColumn("asked", F.lit(False))
    every = known.unionByName(grid.select(cell.alias("cell"), "pos", F.lit(None).cast("double").alias("value"), F.lit(True).alias("asked")))
    point = F.when(~F.col("asked"), F.struct("pos", "value"))
    by = Window.partitionBy("cell").orderBy("pos", "asked")
    every = every.withColumns({
        "l": F.last(point, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)),
        "r": F.first(point, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing)),
    })
    weight = (F.col("pos") - F.col("l.pos")) / (F.col("r.pos") - F.col("l.pos"))
    value = F.when(F.col("l").isNull(), F.col("r.value")).when(F.col("r").isNull() | (F.col("l.pos") == F.col("pos")), F.col("l.value"))
    return every.where("asked").select("pos", value.otherwise(F.col("l.value") + weight * (F.col("r.value") - F.col("l.value"))).alias("value"))


def liftover(points: DataFrame, chain: DataFrame) -> DataFrame:
    """Positions moved by an interval table (start, end half-open, to_chrom, offset); those unmapped or on another chromosome go, the old position stays."""
    met = point_join(points.withColumnRenamed("pos", "old_pos"), chain, "old_pos", half_open=True)
    return met.where(F.col("chrom") == F.col("to_chrom")).withColumn("pos", F.col("old_pos") + F.col("offset")).drop("start", "end", "to_chrom", "offset")
