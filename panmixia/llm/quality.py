"""Host-level quality rules, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panmixia.llm.common import WORD_BREAK, cut, let, salted, text_or_empty

SYMBOLS = r"[#*$%&|<>]"
#: Copies of each host's verdict, so that a host with a third of all rows is joined in as many parts.
SALTS = 32


def _covered(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice.

    A window's hash takes the high bits of a long and its position the low bits; after one
    primitive sort equal windows are neighbours, and the words themselves confirm a match.
    """
    n = F.size(words)
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long")))) - F.lit(1).cast("long")

    def at(i: Column) -> Column:
        return F.get(words, i.cast("int"))

    def same(x: Column, y: Column, mask: Column) -> Column:
        i, j = x.bitwiseAND(mask), y.bitwiseAND(mask)
        alike = F.shiftright(x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(mask)), 1) == 0
        return F.coalesce(alike & (at(i) == at(j)) & (at(i + 1) == at(j + 1)) & (at(i + 2) == at(j + 2)), F.lit(False))

    def counted(mask: Column) -> Column:
        packed = F.sort_array(
            F.transform(
                F.sequence(F.lit(0).cast("long"), n.cast("long") - 3),
                lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i),
            )
        )
        return let(packed, lambda p: let(repeated(p, mask), union_length))

    def repeated(p: Column, mask: Column) -> Column:
        marked = F.transform(
            p,
            lambda x, k: F.when(
                same(x, F.get(p, k - 1), mask) | same(x, F.get(p, k + 1), mask), x.bitwiseAND(mask)
            ),
        )
        return F.sort_array(F.array_compact(marked))

    def union_length(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(starts, k + 1) - x, F.lit(3).cast("long"))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(n >= 4, let(low, counted)).otherwise(F.lit(0).cast("long"))


def document_counts(text: Column) -> Column:
    """A struct of the counts on which rules rest, each from the whole text; a null text counts as empty."""

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

        def with_lines(ls: Column, words: Column) -> Column:
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _covered(words).alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
            )

        return let(F.array_remove(F.split(t, WORD_BREAK, -1), ""), lambda w: let(lines, lambda ls: with_lines(ls, w)))

    return let(text, of)


def rules() -> dict[str, Column]:
    """Failures of one document, from its counts."""
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }


def host_quality(docs: DataFrame, host: str = "source", reject_rate: float = 0.5) -> DataFrame:
    """Judge documents by their own rules and by their host's record.

    Rule failures are summed by host. A Beta prior for each rule is fitted to all hosts' rates by
    moments, its strength a + b held to 1 to 10,000 (where hosts differ no more than counting does, it
    is 10,000), and a host's rate is shrunk to (failures + a) / (documents + a + b). A host whose
    shrunk rate of any rule is over ``reject_rate`` loses, besides the documents that fail outright
    (under 50 words, or over half of the words in repeated 3-word windows), those that break any rule.

    Null hosts form a host of their own; null or empty texts have no words and fail; each input row
    gives one row, repeated rows included; an empty table gives an empty one. Other columns are not
    read, and none of their names can clash.
    """
    base = docs.select("doc_id", F.col(host).alias("host"), document_counts(text_or_empty()).alias("c"))
    base = base.select("doc_id", "host", "c.*")
    names = list(rules())
    base = cut(base.select("*", *[v.alias(k) for k, v in rules().items()]))
    hosts = base.groupBy("host").agg(
        F.count(F.lit(1)).alias("docs"), *[F.count_if(F.col(k)).alias(k) for k in names]
    )
    moments = hosts.agg(
        *[F.avg(F.col(k) / F.col("docs")).alias(f"m_{k}") for k in names],
        *[F.coalesce(F.var_samp(F.col(k) / F.col("docs")), F.lit(0.0)).alias(f"v_{k}") for k in names],
        F.avg(1 / F.col("docs")).alias("inverse"),
    ).first()
    verdict = [F.col("host")]
    for k in names:
        m = min(max(moments[f"m_{k}"] or 0.0, 1e-6), 1 - 1e-6)
        # what varies between hosts beyond the noise of counting
        between = (moments[f"v_{k}"] or 0.0) - m * (1 - m) * (moments["inverse"] or 0.0)
        strength = min(max(m * (1 - m) / between - 1, 1.0), 1e4) if between > 0 else 1e4
        verdict.append(((F.col(k) + m * strength) / (F.col("docs") + strength)).alias(f"rate_{k}"))
    judged = hosts.select(*verdict, "docs").withColumnRenamed("docs", "host_docs")
    judged = judged.withColumn("host_rejected", F.greatest(*[F.col(f"rate_{k}") for k in names]) > reject_rate)
    joined = salted(base, judged, ["host"], SALTS, [F.col("doc_id"), F.col("n_words"), F.col("word_chars")])
    failed = F.col("short") | F.col("repeats")
    broken = F.greatest(*[F.col(k).cast("int") for k in names]) == 1
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~(F.col("host_rejected") & broken)).alias("kept"),
        "host", "host_docs", "host_rejected", *[f"rate_{k}" for k in names],
    )
