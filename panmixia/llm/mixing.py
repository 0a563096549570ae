"""Mixing sources to target weights on a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panmixia.llm.common import WORD_BREAK, cut, free_name, salted, text_or_empty

WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST = 3
BLOCK_WORDS = 256
#: Consecutive Fibonacci numbers: i * LESS mod PERIOD runs through the golden-ratio lattice.
LESS, PERIOD = 1134903170, 1836311903
SALTS, CHUNK_ROWS, CHUNK_SLOTS, BINS = 32, 2_000, 65_536, 4096


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with the sums of each column over the rows before, in an order that tells all rows apart.

    Rows are dealt by ranges of the order and a task sums one range; only the ranges' totals, a row
    per partition, are summed in one place.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    inner = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    totals = totals.select("__range", *[F.coalesce(F.sum(n).over(outer), F.lit(0)).alias(f"__{n}") for n in sums])
    own = ranged.withColumns({n: F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in sums.items()})
    own = own.join(F.broadcast(totals), "__range").withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums})
    return own.drop("__range", *[f"__{n}" for n in sums])


def _sums_before(sums: DataFrame, key: str, at: str, value: str, wide: int = 1024) -> DataFrame:
    """(key, at, before): the key's sum of ``value`` at smaller ``at``; summed in stretches first, so that no task gets a whole key."""
    parted = sums.select(key, at, value, F.floor(F.col(at) / wide).alias("stretch"))
    inner = Window.partitionBy(key, "stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = parted.groupBy(key, "stretch").agg(F.sum(value).alias("whole"))
    whole = whole.select(key, "stretch", F.coalesce(F.sum("whole").over(outer), F.lit(0)).alias("earlier"))
    parted = parted.withColumn("within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return parted.join(whole, [key, "stretch"]).select(key, at, (F.col("earlier") + F.col("within")).alias("before"))


def _grouped(sized: DataFrame) -> DataFrame:
    """Rows that agree in (source, doc_id, size) as one with their number, so that null or repeated ids are no hot key.

    They are interchangeable in the mix. A very large group stays in up to SALTS parts.
    """
    part = (F.spark_partition_id() % SALTS).alias("part")
    return cut(sized.groupBy("source", "doc_id", "size", part).agg(F.count(F.lit(1)).alias("copies")))


def _targets(groups: DataFrame) -> DataFrame:
    """One row per source: its size, weight, and target with what capped sources leave reshared by weight.

    Sources reach their caps in the order of cap over weight, so the level at which sharing stops is
    found by running sums in that order.
    """
    sources = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sources = _running(sources, [F.col("source").asc_nulls_last()], {"source_no": F.lit(1)})
    sources = sources.withColumn("source_no", (F.col("source_no") + 1).cast("long"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("source_no") - 1) % len(WEIGHTS)).cast("int"))
    sources = sources.withColumns({"weight": weight, "cap": (MOST * F.col("source_size")).cast("double")})
    sources = cut(sources.withColumn("ratio", F.col("cap") / F.col("weight")))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    before = _running(sources, [F.col("ratio"), F.col("source_no")], {"caps": F.col("cap"), "weights": F.col("weight")})
    level = (F.lit(float(total[0])) - F.col("caps")) / (F.lit(float(total[1] or 1.0)) - F.col("weights"))
    levels = before.select(level.alias("level"), "ratio", "source_no").where("level <= ratio")
    stop = levels.agg(F.min_by("level", F.struct("ratio", "source_no"))).first()[0] or 0.0
    sources = sources.withColumn("target", F.least("cap", F.col("weight") * stop))
    quota = F.least(MOST * F.col("source_size"), F.round("target").cast("long"))
    sources = sources.withColumn("quota", quota)
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    rest = F.col("quota") % size
    sources = sources.withColumns({"blocks": blocks, "rest": rest})
    slots = F.floor(F.col("quota") / size).cast("long") * blocks + F.ceil(rest / BLOCK_WORDS).cast("long")
    return cut(sources.withColumn("slots", slots).drop("cap", "ratio"))


def _streams(groups: DataFrame, sources: DataFrame) -> DataFrame:
    """Each group's first word in its source's shuffled stream; long sources are summed in chunks.

    A stream is in the order of the first 60 bits of md5 over "id:size".
    """
    spread = [F.col("doc_id"), F.col("size")]
    told = salted(groups, sources.select("source", "source_no", "docs", "source_size", "target"), ["source"], SALTS, spread)
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    h = F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")
    chunk = F.floor(F.col("h") / F.lit(float(2**60)) * F.ceil(F.col("docs") / CHUNK_ROWS)).cast("long")
    told = told.withColumn("h", h).withColumn("chunk", chunk)
    words = F.col("size") * F.col("copies")
    inner = Window.partitionBy("source_no", "chunk").orderBy("h", "doc_id", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    told = cut(told.withColumn("within", F.coalesce(F.sum(words).over(inner), F.lit(0))))
    sums = told.groupBy("source_no", "chunk").agg(F.sum(words).alias("words"))
    placed = salted(told, _sums_before(sums, "source_no", "chunk", "words"), ["source_no", "chunk"], SALTS, spread)
    return placed.select("doc_id", "source_no", "size", "copies", "source_size", "target", (F.col("before") + F.col("within")).alias("first"))


def schedule(sources: DataFrame) -> DataFrame:
    """Slots in order, each with its source, the slot's rank in it, the block that it takes and how many of its words.

    Slot i falls on the point i * LESS / PERIOD of the unit interval, on which each source has a
    stretch as wide as its slots; ranks are counted within short ranges of slots and added up.
    Ranks over a source's quota are dropped, and the few that the points leave out end the schedule.
    """
    total, count = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    spark = sources.sparkSession
    # more bins than sources, so that a bin's slots meet few stretches
    wide = max(1, -(-total // (BINS + 4 * count)))
    stretches = _running(sources.where("slots > 0").select("source_no", "slots", "blocks", "rest"), [F.col("source_no")], {"lo": F.col("slots")})
    stretches = cut(stretches.withColumn("hi", F.col("lo") + F.col("slots")))
    binned = stretches.select("source_no", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor((F.col("hi") - 1) / wide))).alias("bin"))
    point = ((F.col("slot") % PERIOD) * LESS % PERIOD) / F.lit(float(PERIOD))
    at = F.least(F.floor(point * total).cast("long"), F.lit(total - 1))
    slots = spark.range(total).withColumnRenamed("id", "slot").withColumn("at", at).withColumn("bin", F.floor(F.col("at") / wide))
    drawn = slots.join(binned, "bin").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("slot", "source_no")
    drawn = drawn.withColumn("range", F.floor(F.col("slot") / CHUNK_SLOTS))
    drawn = cut(drawn.withColumn("inner", F.row_number().over(Window.partitionBy("source_no", "range").orderBy("slot"))))
    counts = drawn.groupBy("source_no", "range").agg(F.count(F.lit(1)).alias("n"))
    ranked = salted(drawn, _sums_before(counts, "source_no", "range", "n"), ["source_no", "range"], SALTS, [F.col("slot")])
    ranked = ranked.select("slot", "source_no", (F.col("before") + F.col("inner") - 1).alias("rank"))
    have = counts.groupBy("source_no").agg(F.sum("n").alias("have"))
    short = stretches.join(have, "source_no", "left").where(F.coalesce(F.col("have"), F.lit(0)) < F.col("slots"))
    extra = short.select(F.lit(None).cast("long").alias("slot"), "source_no", F.explode(F.sequence(F.coalesce(F.col("have"), F.lit(0)), F.col("slots") - 1)).alias("rank"))
    every = salted(ranked.unionByName(extra), stretches.select("source_no", "slots", "blocks", "rest"), ["source_no"], SALTS, [F.col("rank")])
    last = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
    words = F.when(last, F.col("rest") - F.floor((F.col("rest") - 1) / BLOCK_WORDS) * BLOCK_WORDS).otherwise(F.lit(BLOCK_WORDS))
    return every.where("rank < slots").select("slot", "source_no", "rank", (F.col("rank") % F.col("blocks")).alias("block"), words.cast("long").alias("words"))


def _overlap(words: Column, start: Column, end: Column) -> Column:
    return F.greatest(F.least(end, words) - start, F.lit(0))


def mix(docs: DataFrame) -> DataFrame:
    """How many words of each document a mix takes in which sources have their target shares.

    Sources, in the order of their code points with null last, weigh 5, 2, 1 and so on; a source's
    target is its share of all words, at most 3 times its size, and what that leaves over is shared
    again. Each source's documents form a shuffled stream, cut into blocks of 256 words; the
    schedule's slots take its blocks in turn, and the last one only as many words as are still due.

    Null and empty texts have size 0 and nothing is taken of them; long texts count whole; repeated
    rows stand in the stream as often as they come; an empty table gives an empty one; null ids are
    kept; other columns are not read.
    """
    words = F.size(F.array_remove(F.split(text_or_empty(), WORD_BREAK, -1), "")).cast("long")
    groups = _grouped(docs.select("doc_id", "source", words.alias("size")))
    sources = _targets(groups)
    placed = cut(_streams(groups, sources))
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    each = each.withColumn("first", F.col("first") + F.col("copy") * F.col("size"))
    full = each.where("size > 0")
    b = F.lit(BLOCK_WORDS)
    pieces = full.select("source_no", "first", "size", F.explode(F.sequence(F.floor(F.col("first") / b), F.floor((F.col("first") + F.col("size") - 1) / b))).alias("block"))
    start = F.greatest(F.col("first") - F.col("block") * b, F.lit(0))
    end = F.least(F.col("first") + F.col("size") - F.col("block") * b, b)
    pieces = pieces.select("source_no", "first", "block", start.alias("a"), end.alias("z"))
    taken = pieces.join(schedule(sources), ["source_no", "block"]).groupBy("source_no", "first").agg(F.sum(_overlap(F.col("words"), F.col("a"), F.col("z"))).alias("taken"))
    out = full.join(taken, ["source_no", "first"], "left").unionByName(each.where("size = 0").withColumn("taken", F.lit(0)))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"), "source_no")


def resample(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes most of its words; columns stay as they are, whatever their names.

    A document taken in whole rounds comes that often, and once more if at least half of it is due in
    the round that its source does not finish. Documents without words (null and empty texts) stay
    once: the mix cannot tell how often to take them. A repeated or null id comes as often as its rows'
    words are taken together. An empty table gives an empty one.
    """
    planned, times, copy = (free_name(docs.columns, n) for n in ("planned", "times", "copy"))
    per = mix(docs).groupBy(F.col("doc_id").alias(planned)).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    often = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5).cast("int"))
    per = cut(per.select(planned, often.alias(times)))
    joined = docs.join(per, docs["doc_id"].eqNullSafe(per[planned])).where(F.col(times) > 0)
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(copy)).drop(copy)
