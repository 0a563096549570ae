"""Haplotype panels: shapes, filters, bit packing, pairs and what differs between them.

A long panel has a row per haplotype and site (hap_id, site_idx, pos, allele); a wide one has a row per
haplotype with its alleles, or its packed words, in an array. Pair operators work on wide rows: a
pair's sites are then one row, and nothing is shuffled by pair.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def to_wide(panel: DataFrame, *keep: str) -> DataFrame:
    """One row per haplotype with its alleles in the order of the sites."""
    cells = F.sort_array(F.collect_list(F.struct("site_idx", "allele")))
    return panel.groupBy("hap_id", *keep).agg(F.transform(cells, lambda c: c["allele"].cast("tinyint")).alias("alleles"))


def filter_segregating(panel: DataFrame) -> DataFrame:
    """Keep sites at which both alleles occur among the given haplotypes."""
    sites = panel.groupBy("site_idx").agg(F.sum("allele").alias("ac"), F.count(F.lit(1)).alias("an"))
    return panel.join(sites.where((F.col("ac") > 0) & (F.col("ac") < F.col("an"))).select("site_idx"), "site_idx", "left_semi")


def subset_population(panel: DataFrame, samples: DataFrame, column: str, value: str, least: int = 4, complement: bool = False) -> DataFrame:
    """Haplotypes 2i and 2i + 1 of the samples of a population (or of all others); none if fewer than ``least``."""
    wanted = F.col(column) == value
    chosen = samples.where(~wanted if complement else wanted).select(F.col("sample_no").alias("__sample"))
    rows = panel.join(chosen, F.floor(panel["hap_id"] / 2) == F.col("__sample"), "left_semi")
    enough = rows.select("hap_id").distinct().groupBy().count().where(F.col("count") >= least)
    return rows.join(F.broadcast(enough.select(F.lit(1).alias("__ok"))), F.lit(True), "left_semi")


def slice_region(panel: DataFrame, lo: float, hi: float) -> DataFrame:
    return panel.where(F.col("pos").between(lo, hi))


def stride_sites(df: DataFrame, stride: int) -> DataFrame:
    return df.where(F.col("site_idx") % stride == 0)


def maf_filter(panel: DataFrame, least: float = 0.05) -> DataFrame:
    """Sites with a minor-allele frequency of ``least`` or more over non-missing (not negative) alleles."""
    p = F.avg(F.when(F.col("allele") >= 0, F.col("allele")))
    sites = panel.groupBy("site_idx").agg(p.alias("p")).where(F.least(F.col("p"), 1 - F.col("p")) >= least)
    return panel.join(sites.select("site_idx"), "site_idx", "left_semi")


def bitpack(panel: DataFrame) -> DataFrame:
    """hap_id, word_idx, word: bit s % 64 of word s div 64 is the allele's lowest bit."""
    bit = F.call_function("shiftleft", F.col("allele").cast("long").bitwiseAND(F.lit(1)), F.col("site_idx") % 64)
    return panel.groupBy("hap_id", F.floor(F.col("site_idx") / 64).cast("int").alias("word_idx")).agg(F.bit_or(bit).alias("word"))


def unpack(packed: DataFrame, n_sites: int) -> DataFrame:
    bits = packed.select("hap_id", "word_idx", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    allele = F.call_function("shiftright", F.col("word"), F.col("bit")).bitwiseAND(F.lit(1)).cast("int")
    return bits.select("hap_id", (F.col("word_idx") * 64 + F.col("bit")).cast("int").alias("site_idx"), allele.alias("allele")).where(F.col("site_idx") < n_sites)


def pack_words(alleles: Column) -> Column:
    """Packed words of an allele array."""

    def word(w: Column) -> Column:
        part = F.slice(alleles, w * 64 + 1, F.lit(64))
        bits = F.transform(part, lambda a, k: F.call_function("shiftleft", a.cast("long").bitwiseAND(F.lit(1)), k))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(alleles) - 1) / 64).cast("int")), word)


def packed_wide(wide: DataFrame) -> DataFrame:
    return wide.withColumn("words", pack_words(F.col("alleles"))).withColumn("n_sites", F.size("alleles"))


#: Haplotypes of a run of ``pairs``: a multiple of the 8 values that Parquet packs at once, and short against its pages.
RUN = 256


def _blocks(haps: DataFrame) -> tuple[int, int]:
    """Blocks on a side of the grid, and tasks; both follow the cores."""
    cores = haps.sparkSession.sparkContext.defaultParallelism
    return max(8, math.ceil(math.sqrt(2 * cores))), 8 * cores


def _grid(haps: DataFrame, *within: str, blocks: int | None = None) -> DataFrame:
    """Rows a.* and b.* of all pairs within groups, a's haplotype number the larger.

    Groups are few and large, so haplotypes lie in blocks, and a cell of the grid of two blocks is a join
    key: a group's pairs are made in ``blocks`` squared cells, for which a row is copied ``blocks`` times
    on either side. Both sides are dealt by the join's own keys to a number of tasks that follows the
    cores; Spark would else merge them by the bytes of the haplotypes, and what follows a pair costs much more.
    """
    follows, tasks = _blocks(haps)
    n = blocks or follows
    own, each = F.pmod("hap_id", F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = ["__a", "__b", *within]
    a = haps.withColumn("__a", own).withColumn("__b", each).repartition(tasks, *cell).alias("a")
    b = haps.withColumn("__b", own).withColumn("__a", each).repartition(tasks, *cell).alias("b")
    on = F.col("a.hap_id") > F.col("b.hap_id")
    for c in cell:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b.hint("shuffle_hash"), on)


def pairs(haps: DataFrame, *within: str, ordered: str = "i>j") -> DataFrame:
    """All pairs of haplotypes that agree on ``within``, the larger number first (or last with "i<j").

    The same grid, but a block's smaller numbers are sorted and cut into runs, and a run meets all larger numbers of the
    cell before the next run comes: a file then repeats few numbers in one order, which costs next to nothing in Parquet.
    """
    n, tasks = _blocks(haps)
    own, each = F.pmod("hap_id", F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = ["__a", "__b", *within]
    a = haps.select("hap_id", *within, own.alias("__a"), each.alias("__b")).repartition(tasks, *cell).alias("a")
    block = haps.where("hap_id is not null").groupBy(own.alias("__b"), *within).agg(F.array_sort(F.collect_list("hap_id")).alias("__all"))
    starts = F.explode(F.sequence(F.lit(1), F.size("__all"), F.lit(RUN)))
    runs = block.select("__b", *within, "__all", starts.alias("__at")).select("__b", *within, F.slice("__all", F.col("__at"), F.lit(RUN)).alias("__run"))
    b = runs.withColumn("__a", each).repartition(tasks, *cell).alias("b")
    on = F.col("a.hap_id") > F.get("b.__run", F.lit(0))
    for c in cell:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    rows = b.join(a.hint("shuffle_hash"), on).select(F.col("a.hap_id").alias("__i"), *[F.col(f"a.{c}").alias(c) for c in within], F.explode("b.__run").alias("__j"))
    i, j = ("__i", "__j") if ordered == "i>j" else ("__j", "__i")
    return rows.where("__i > __j").select(F.col(i).alias("i"), F.col(j).alias("j"), *within)


def sorted_pairs(haps: DataFrame, within: str, least: int = 1) -> DataFrame:
    """The different pairs (i, j), i > j, of haplotypes that agree on ``within``, in order; groups of fewer than ``least`` rows have none.

    Haplotypes are made different and sorted, not pairs: a task has a range of them, each meets its
    group's numbers in order, and those before its own are its pairs. Pairs are never moved.
    """
    cores = haps.sparkSession.sparkContext.defaultParallelism
    group = haps.groupBy(within).agg(F.array_sort(F.collect_set("hap_id")).alias("__all"), F.count(F.lit(1)).alias("__n"))
    first = haps.select("hap_id", within).distinct().repartitionByRange(8 * cores, "hap_id").sortWithinPartitions("hap_id")
    first = first.mapInArrow(lambda batches: batches, first.schema)  # else the optimiser drops the sort, since a join follows
    rows = first.join(F.broadcast(group.where(F.col("__n") >= least).drop("__n")), within)
    rows = rows.select("hap_id", F.slice("__all", F.lit(1), (F.array_position("__all", F.col("hap_id")) - 1).cast("int")).alias("__below"))
    if not haps.select("hap_id", within).distinct().groupBy("hap_id").count().where("count > 1").isEmpty():  # numbers that lie in several groups
        rows = rows.groupBy("hap_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__below")))).alias("__below")).sortWithinPartitions("hap_id")
    return rows.select(F.col("hap_id").alias("i"), F.explode("__below").alias("j"))


def pair_words(packed: DataFrame, *within: str, blocks: int | None = None) -> DataFrame:
    """i, j, xor: packed differences of all pairs within groups, by one join of packed rows."""
    rows = _grid(packed, *within, blocks=blocks)
    return rows.select(F.col("a.hap_id").alias("i"), F.col("b.hap_id").alias("j"), *[F.col(f"a.{c}").alias(c) for c in within], F.zip_with("a.words", "b.words", lambda x, y: x.bitwiseXOR(y)).alias("xor"), F.col("a.n_sites").alias("n_sites"))


def explicit_pairs(pair_list: DataFrame, packed: DataFrame) -> DataFrame:
    """The same for a list of pairs (i, j): two equi-joins, a self-pair included."""
    a, b = packed.alias("a"), packed.alias("b")
    joined = pair_list.join(a, F.col("i") == F.col("a.hap_id")).join(b, F.col("j") == F.col("b.hap_id"))
    return joined.select(*pair_list.columns, F.zip_with("a.words", "b.words", lambda x, y: x.bitwiseXOR(y)).alias("xor"), F.col("a.n_sites").alias("n_sites"))


def phase_pairs(packed: DataFrame) -> DataFrame:
    """The two haplotypes of each individual as a pair, by an equi-join."""
    individual = F.floor(F.col("hap_id") / 2)
    cores = packed.sparkSession.sparkContext.defaultParallelism
    first = packed.where("hap_id % 2 = 0").withColumn("ind", individual).repartition(cores, "ind").alias("a")
    second = packed.where("hap_id % 2 = 1").withColumn("ind", individual).repartition(cores, "ind").alias("b")
    return first.join(second, "ind").select(F.col("b.hap_id").alias("i"), F.col("a.hap_id").alias("j"), F.zip_with("a.words", "b.words", lambda x, y: x.bitwiseXOR(y)).alias("xor"), F.col("a.n_sites").alias("n_sites"))


def hamming(xor: Column) -> Column:
    return F.aggregate(F.transform(xor, F.bit_count), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def xor_bit(xor: Column, site: Column) -> Column:
    word = F.get(xor, F.floor(site / 64).cast("int"))
    return F.call_function("shiftright", word, (site % 64).cast("int")).bitwiseAND(F.lit(1)).cast("int")


def with_word_counts(pairs_xor: DataFrame) -> DataFrame:
    """i, j, n_sites, xor and __before: the differences in all words before each one."""
    before = F.transform("xor", lambda _, k: hamming(F.slice("xor", F.lit(1), k)))
    return pairs_xor.select("i", "j", "n_sites", "xor", before.alias("__before"))


def count_to(site: Column) -> Column:
    """Differences at the sites from 0 to ``site`` of rows with word counts: a word's bits under a mask, and the words before."""
    word = F.shiftright(site, 6)
    mask = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 63 - site.bitwiseAND(F.lit(63)))
    return F.get("__before", word) + F.bit_count(F.get("xor", word).bitwiseAND(mask)).cast("long")


def at_sites(pairs_xor: DataFrame, count) -> DataFrame:
    """i, j, site_idx, n_diff: ``count`` of (site_idx, number of sites), a row per pair and site, by expressions alone."""
    words = F.explode(F.sequence(F.lit(0), F.size("xor") - 1)).alias("__word")
    rows = with_word_counts(pairs_xor).select("*", words).select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("__bit"))
    rows = rows.withColumn("site_idx", F.col("__word") * 64 + F.col("__bit")).where("site_idx < n_sites")
    return rows.select("i", "j", "site_idx", count(F.col("site_idx"), F.col("n_sites")).alias("n_diff"))


def at_bits(pairs_xor: DataFrame, count) -> DataFrame:
    """The same with ``count`` of a site's bit in its word, for what needs no words but the site's and the two beside it.

    __bits, __left, __right (0 beyond the ends) and __before, the differences in all words before, are made once a word,
    so that a site only takes bits under a mask. Bits from ``n_sites`` on are 0.
    """
    word = F.col("__word")

    def bits(at: Column) -> Column:
        own = F.col("n_sites") - 64 * at
        part = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - own)
        return F.when(own >= 64, F.get("xor", at)).when(own > 0, F.get("xor", at).bitwiseAND(part)).otherwise(0)

    before = F.when(word > 0, hamming(F.slice("xor", F.lit(1), word))).otherwise(0)
    left, right = F.when(word > 0, bits(word - 1)).otherwise(0), F.when(word + 1 < F.size("xor"), bits(word + 1)).otherwise(0)
    words = pairs_xor.select("*", F.explode(F.sequence(F.lit(0), F.size("xor") - 1)).alias("__word"))
    words = words.select("i", "j", "n_sites", "__word", bits(word).alias("__bits"), left.alias("__left"), right.alias("__right"), before.alias("__before"))
    rows = words.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("__bit")).withColumn("site_idx", word * 64 + F.col("__bit"))
    return rows.where("site_idx < n_sites").select("i", "j", "site_idx", count(F.col("__bit")).alias("n_diff"))


def prefix_scan(pairs_xor: DataFrame) -> DataFrame:
    """i, j, site_idx, n_diff: inclusive running counts."""

    def upto(bit: Column) -> Column:
        mask = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 63 - bit)
        return F.col("__before") + F.bit_count(F.col("__bits").bitwiseAND(mask)).cast("long")

    return at_bits(pairs_xor, upto)


def _smallest(n: int, by: tuple[str, ...], most: int = 100_000):
    """A map over batches that hands on the ``n`` rows of smallest (__key, i, j) of each group of its task.

    Rows above a group's n-th smallest key so far are dropped as they come, so few are ever held.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def groups(t: pa.Table) -> tuple[np.ndarray, list[tuple]]:
        codes, keys = np.zeros(t.num_rows, np.int64), [()]
        for c in by:
            d = t.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
            codes = codes * len(d.dictionary) + d.indices.to_numpy()
            keys = [(*k, x) for k in keys for x in d.dictionary.to_pylist()]
        return codes, keys

    def run(batches):
        bounds, held, size, full = {}, [], 0, most

        def pruned() -> pa.Table:
            t = pa.Table.from_batches([b for h in held for b in h.to_batches()])
            codes, keys = groups(t)
            t = t.append_column("__code", pa.array(codes))
            t = t.take(pc.sort_indices(t, [(c, "ascending") for c in ("__code", "__key", "i", "j")]))
            codes = t.column("__code").to_numpy()
            rank = np.arange(len(codes)) - np.searchsorted(codes, codes)
            last = np.flatnonzero(rank == n - 1)
            bounds.update(zip((keys[k] for k in codes[last]), t.column("__key").take(pa.array(last)).to_pylist(), strict=True))
            return t.filter(pa.array(rank < n)).drop_columns(["__code"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if bounds:
                codes, keys = groups(t)
                used, at = np.unique(codes, return_inverse=True)  # a bound that no key exceeds where there is none
                t = t.filter(pc.less_equal(t.column("__key"), pa.array([bounds.get(keys[k], "g") for k in used], pa.string()).take(pa.array(at))))
            held, size = [*held, t], size + t.num_rows
            if size >= full:
                held = [pruned()]
                size = held[0].num_rows
                full = size + most
        if size:
            yield from pruned().to_batches()

    return run


def sample_pairs(pair_rows: DataFrame, n: int, *by: str, seed: int = 42) -> DataFrame:
    """``n`` pairs (of each group) without replacement: those of the smallest hash of (i, j, seed), so reruns agree.

    A task hands on the n smallest of each group among its pairs, so the others are neither sorted nor moved.
    """
    key = F.md5(F.concat_ws(":", "i", "j", F.lit(str(seed))))
    if not by:
        return pair_rows.orderBy(key, "i", "j").limit(n)
    keyed = pair_rows.withColumn("__key", key)
    rows = keyed.mapInArrow(_smallest(n, by), keyed.schema)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("__key", "i", "j"))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank", "__key")


def numbered_pairs(haps: DataFrame, numbers: list[int]) -> DataFrame:
    """The pairs (i, j), i > j, of these numbers: haplotypes in order, each with those before it. No other pair is made."""
    spark = haps.sparkSession
    rows = [(i, x - i * (i - 1) // 2) for x in numbers for i in [(1 + math.isqrt(8 * x + 1)) // 2]]
    ranks = haps.select("hap_id", (F.row_number().over(Window.orderBy("hap_id")) - 1).alias("rank"))  # a number per haplotype
    wanted = spark.createDataFrame(rows, "__i long, __j long")
    first = ranks.join(F.broadcast(wanted), F.col("rank") == F.col("__i")).select(F.col("hap_id").alias("i"), "__j")
    return ranks.join(F.broadcast(first), F.col("rank") == F.col("__j")).select("i", F.col("hap_id").alias("j"))


def draw_pairs(haps: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` different pairs of a panel, drawn by number: the work follows n and the haplotypes, not their pairs."""
    count = haps.count()
    total = count * (count - 1) // 2
    drawn: dict[int, None] = dict.fromkeys(range(total)) if n >= total else {}
    draw = 0
    while len(drawn) < min(n, total):
        drawn[int(hashlib.md5(f"{seed}:{draw}".encode()).hexdigest()[:15], 16) % total] = None
        draw += 1
    return numbered_pairs(haps, list(drawn))


def split_pairs(pair_rows: DataFrame, chunk: int) -> DataFrame:
    """Chunks of ``chunk`` pairs along the linear index, which numbers all pairs of a panel without gaps."""
    from panmixia.functions.columns import pair_index

    return pair_rows.withColumn("chunk", F.floor(pair_index(F.col("i"), F.col("j")) / chunk).cast("long"))
