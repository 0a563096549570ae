"""Personal data, with DataFrame operations only: overlapping candidates, boosted trees, calibrated thresholds."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panmixia.llm.common import cut, let, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# Possessive or unrolled where a plain form would recurse or backtrack; the matches are the same. An
# address starts where its run of signs does, or where the last match ended.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)++|[0-9]{2,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High recall: forms that the base leaves out. They may overlap each other and the base.
LOOSE = {
    "mail": rf"(?<!{_LOCAL}){_LOCAL}++\s?(?:\(at\)|\[at\]|\sat\s)\s?{_LABEL}++(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\sdot\s)\s?){_LABEL}{{2,}}+)++",
    "number": r"(?<![0-9])\(?[0-9]{2,}+\)?(?:[\x20./-]\(?[0-9]{2,}+\)?)++(?![0-9])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])",  # of 15 to 34 signs, by its standard
}
KINDS = (*BASE_KINDS, *LOOSE)
# Top-level domains that an obfuscated address may end in.
DOMAINS = r"(?i)(?:\.|\s?(?:\(dot\)|\[dot\]|\sdot\s)\s?)(?:com|org|net|edu|gov|info|biz|io|co|eu|de|at|ch|fr|es|it|nl|uk|us|ca|au|jp|cn|in|br|ru|pl|se|example|invalid|test)$"
CUES = r"(?i)(?:phone|call|tel|fax|mobile|handy|mail|contact|ssn|social|passport|account|konto|iban|card|address|dial|whatsapp|nummer|numéro|teléfono)[^\n]{0,12}$"
COUNTER_CUES = r"(?i)(?:version|page|figure|table|isbn|order|item|\bno\b|total|price|usd|eur|\$|€|section|chapter|pages|build|date)[^\n]{0,8}$"


def _matches(text: Column, pattern: str, most_gaps: int = 256) -> Column:
    """(value, start, end) of every match, in code points.

    The text between matches and the matches themselves add up to positions; running sums are taken
    in blocks of ``most_gaps``, so the work stays well under the square of the matches.
    """

    def placed(found: Column) -> Column:
        def of(gaps: Column) -> Column:
            steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
            return let(steps, lambda s: let(_block_sums(s), lambda b: with_sums(s, b)))

        def with_sums(s: Column, b: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                block = F.floor(i / most_gaps).cast("int")
                before = F.aggregate(F.slice(s, block * most_gaps + 1, i - block * most_gaps + 1), F.get(b, block), lambda a, x: a + x)
                return let(before, lambda end: F.struct(m.alias("value"), (end - F.length(m)).alias("start"), end.alias("end")))

            return F.transform(found, span)

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), of)).otherwise(F.array().cast(SPANS))

    def _block_sums(s: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(s) - 1) / most_gaps).cast("int")),
            lambda k: F.aggregate(F.slice(s, k * most_gaps + 1, F.lit(most_gaps)), F.lit(0), lambda a, x: a + x),
        )
        return let(blocks, lambda q: F.transform(q, lambda _, k: F.aggregate(F.slice(q, F.lit(1), k), F.lit(0), lambda a, x: a + x)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


SPANS = "array<struct<value:string,start:int,end:int>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether every second digit from the right doubled, digits of the products added, gives a sum that ends in 0."""
    signs = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(signs, lambda c, i: let(F.coalesce(c.try_cast("int"), F.lit(0)) * (F.lit(1) + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0))),
        F.lit(0), lambda a, x: a + x,
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """The base's own conditions on a match."""
    if kind == "ip":
        parts = F.split(value, r"\.")
        return ~F.exists(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) > 3) & ~F.exists(parts, lambda p: F.coalesce(p.try_cast("int"), F.lit(0)) > 255)
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(16, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _mod97(value: Column) -> Column:
    """Whether a bank account number's letters and digits, the first four moved to the end, leave 1 by 97."""
    plain = F.regexp_replace(value, " ", "")
    signs = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")

    def add(rest: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(c == "", rest).when(v < 58, (rest * 10 + v - 48) % 97).otherwise((rest * 100 + v - 55) % 97)

    return F.aggregate(signs, F.lit(0), add) == 1


#: Bits of a candidate's pattern: its format, then its context.
FEATURES = ("digits_7_up", "digits_10_up", "digits_14_up", "parts_3_up", "spaced", "dashed", "dotted", "paren", "letters", "slashed", "domain", "bracketed", "checksum", "cue", "counter_cue", "glued")


def _pattern(kind: str, value: Column, span: Column, text: Column) -> Column:
    """The features of ``value``, which stands or might stand in a span of the text, as bits of an int."""
    before = F.substring(text, F.greatest(span["start"] - 23, F.lit(1)), F.least(span["start"], F.lit(24)))
    after = F.substring(text, span["end"] + 1, F.lit(1))

    def bits(n: Column) -> Column:
        flags = [
            n >= 7, n >= 10, n >= 14, F.length(F.regexp_replace(value, "[^ ./-]", "")) >= 2, F.contains(value, F.lit(" ")), F.contains(value, F.lit("-")),
            F.contains(value, F.lit(".")), F.contains(value, F.lit("(")), value.rlike("[A-Za-z]"), F.contains(value, F.lit("/")),
            value.rlike(DOMAINS) if kind == "mail" else F.lit(False), value.rlike(r"[(\[]at[)\]]") if kind == "mail" else F.lit(False), _mod97(value) if kind == "iban" else F.lit(False),
        ]
        at = len(flags)
        around = let(before, lambda b: F.when(b.rlike(CUES), 1 << at).otherwise(0) + F.when(b.rlike(COUNTER_CUES), 2 << at).otherwise(0) + F.when(b.rlike(r"[\w$€%]$") | after.rlike(r"[\w%$€]"), 4 << at).otherwise(0))
        total = around
        for i, f in enumerate(flags):
            total = total + F.when(f, 1 << i).otherwise(0)
        return total

    return let(F.length(_digits(value)), bits)


@dataclass
class PiiModel:
    """An additive model of depth-2 trees on bits of the pattern, and a threshold per loose kind."""

    prior: float = -2.0
    trees: list[tuple[int, int, tuple[float, float, float, float]]] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def margin(self, pattern: int) -> float:
        total = self.prior  # in the order of margin_column, so that both round alike
        for a, b, leaves in self.trees:
            total += leaves[2 * (pattern >> a & 1) + (pattern >> b & 1)]
        return total

    def margin_column(self, pattern: Column) -> Column:
        total = F.lit(self.prior)
        for a, b, leaves in self.trees:
            leaf = F.shiftright(pattern, a).bitwiseAND(F.lit(1)) * 2 + F.shiftright(pattern, b).bitwiseAND(F.lit(1))
            total = total + F.get(F.array(*[F.lit(v) for v in leaves]), leaf)
        return total


def boost(counts: dict[int, tuple[float, float]], rounds: int = 24, rate: float = 0.3, ridge: float = 1.0) -> PiiModel:
    """Newton boosting on counts of (pattern: negatives, positives).

    There are at most 2 ** 16 patterns whatever the corpus, so the trees' splits are searched over
    counts of all candidates rather than over a sample of them.
    """
    negatives, positives = (sum(c[i] for c in counts.values()) for i in (0, 1))
    if not negatives or not positives:
        return PiiModel()
    model = PiiModel(prior=math.log(positives / negatives))
    margins = {p: model.prior for p in counts}
    n = len(FEATURES)
    for _ in range(rounds):
        stats = []
        for p, (neg, pos) in counts.items():
            q = 1 / (1 + math.exp(-margins[p]))
            stats.append((p, pos - q * (pos + neg), q * (1 - q) * (pos + neg)))
        best = (0.0, None)
        for a in range(n):
            for b in range(a + 1, n):
                g, h = [0.0] * 4, [0.0] * 4
                for p, gradient, hessian in stats:
                    leaf = 2 * (p >> a & 1) + (p >> b & 1)
                    g[leaf] += gradient
                    h[leaf] += hessian
                gain = sum(x * x / (y + ridge) for x, y in zip(g, h, strict=True))
                if gain > best[0] + 1e-9:
                    best = (gain, (a, b, tuple(rate * x / (y + ridge) for x, y in zip(g, h, strict=True))))
        if best[1] is None or best[0] < 1e-3:
            break
        model.trees.append(best[1])
        a, b, leaves = best[1]
        for p in margins:
            margins[p] += leaves[2 * (p >> a & 1) + (p >> b & 1)]
    return model


def calibrate(model: PiiModel, counts: dict[int, tuple[float, float]], precision: float) -> float:
    """The lowest margin from which on at least ``precision`` of the labelled candidates are positive."""
    found, pos, total = math.inf, 0.0, 0.0
    for p in sorted(counts, key=lambda p: -model.margin(p)):
        pos, total = pos + counts[p][1], total + sum(counts[p])
        if pos >= precision * total:
            found = model.margin(p)
    return found


def candidates(docs: DataFrame) -> DataFrame:
    """Per document: base spans by kind, loose candidates (kind, start, end, pattern, label), and made ones (pattern).

    Silver labels, from what the trees do not see as such. A number has 1 if it lies in a span that the
    base accepts by its sign or checksum, 0 if it lies in one that the base matches and drops, or looks
    like a date, a decimal or a plain count. A bank account number has 1 if it leaves 1 by 97, else 0. A
    mail form has 0 if it has neither a known domain nor brackets, and 1 where an address that the base
    accepts is rewritten into one, in its own place: those are the made candidates, which give no span.
    """
    text = F.col("text")
    needs = {"email": text.contains("@"), "phone": text.contains("+")}
    base = docs.select("doc_id", text_or_empty().alias("text"))
    for kind, pattern in BASE.items():
        found = _matches(text, pattern)
        if kind in needs:
            found = F.when(needs[kind], found).otherwise(F.array().cast(SPANS))
        base = base.withColumn(f"all_{kind}", found)
    digits = text.rlike("[0-9]{2}")
    for kind, pattern in LOOSE.items():
        cheap = text.rlike(r"(?:\(at\)|\[at\]|\sat\s)") if kind == "mail" else digits
        base = base.withColumn(f"all_{kind}", F.when(cheap, _matches(text, pattern)).otherwise(F.array().cast(SPANS)))

    def bare(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def inside(s: Column, spans: Column) -> Column:
        return F.exists(spans, lambda t: (t["start"] <= s["start"]) & (s["end"] <= t["end"]))

    def accepted_of(kind: str) -> Column:
        return bare(F.filter(F.col(f"all_{kind}"), lambda s: _valid(kind, s["value"])))

    kept = {k: accepted_of(k) for k in BASE}
    base = base.withColumns(kept)

    def judged(kind: str) -> Column:
        accepted = F.flatten(F.array(*[F.col(k) for k in BASE]))
        # any two digits match the card's pattern, so only its long matches say something
        long = F.filter(F.col("all_card"), lambda s: F.length(_digits(s["value"])) >= 13)
        matched = F.flatten(F.array(bare(F.col("all_ip")), bare(F.col("all_phone")), bare(long)))

        def of(good: Column, tried: Column) -> Column:
            def one(s: Column) -> Column:
                plain = s["value"].rlike(r"^(?:[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}|[0-9]+[. ][0-9]{2,3}|[0-9]{2,4}[-/][0-9]{2,4})$")
                if kind == "number":
                    label = F.when(inside(s, good), 1).when(plain | inside(s, tried), 0)
                elif kind == "iban":
                    label = _mod97(s["value"]).cast("int")
                else:
                    label = F.when(~s["value"].rlike(DOMAINS) & ~s["value"].rlike(r"[(\[]at[)\]]"), 0)
                return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _pattern(kind, s["value"], s, text).alias("pattern"), label.alias("label"))

            return F.transform(F.col(f"all_{kind}"), one)

        return F.when(F.size(f"all_{kind}") > 0, let(accepted, lambda g: let(matched, lambda t: of(g, t)))).otherwise(F.array().cast(LOOSE_SPANS))

    def rewritten(s: Column, i: Column) -> Column:
        # the forms in turn, so that each is as frequent
        forms = [F.regexp_replace(s["value"], "@", f) for f in (" (at) ", " at ", "[at]")]
        spelt = F.when(i % 2 == 0, F.get(F.array(*forms), i % 3)).otherwise(F.regexp_replace(F.get(F.array(*forms), i % 3), r"\.", " dot "))
        return let(spelt, lambda v: _pattern("mail", v, s, text))

    made = F.when(F.size("all_email") > 0, F.transform(F.col("all_email"), rewritten)).otherwise(F.array().cast("array<int>"))
    return base.select("doc_id", *BASE, F.flatten(F.array(*[judged(k) for k in LOOSE])).alias("loose"), made.alias("made"))


LOOSE_SPANS = "array<struct<kind:string,start:int,end:int,pattern:int,label:int>>"


def fit(found: DataFrame, precision: float = 0.97) -> PiiModel:
    """Boost on the silver labels of all loose candidates, and calibrate a threshold for each kind."""
    one = found.where(F.size("loose") > 0).select(F.explode("loose").alias("c")).select("c.*").where("label is not null")
    made = found.where(F.size("made") > 0).select(F.lit("mail").alias("kind"), F.explode("made").alias("pattern"), F.lit(1).alias("label"))
    one = one.select("kind", "pattern", "label").unionByName(made)
    rows = one.groupBy("kind", "pattern").agg(F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == 1).alias("pos")).collect()
    whole: dict[int, tuple[float, float]] = {}
    for r in rows:
        neg, pos = whole.get(r["pattern"], (0.0, 0.0))
        whole[r["pattern"]] = (neg + r["neg"], pos + r["pos"])
    model = boost(whole)
    floor = math.log(precision / (1 - precision))
    for kind in LOOSE:
        own = {r["pattern"]: (float(r["neg"]), float(r["pos"])) for r in rows if r["kind"] == kind}
        # a kind without enough labels of its own is held to the same precision by the model's own probability
        model.thresholds[kind] = max(calibrate(model, own, precision), 0.0) if sum(map(sum, own.values())) >= 50 else floor
    return model


def detect(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """Find personal data in every text; fit the model on the same candidates where none is given.

    Base spans are kept as they are; a loose candidate is added where the trees' margin reaches its
    kind's threshold and no base span overlaps it. One row per input row: null and empty texts have no
    spans, texts of any length are read whole, repeated rows repeat, an empty table gives an empty one,
    other columns are not read.
    """
    found = cut(candidates(docs))
    model = model or fit(found)

    def of_kind(no: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(F.lit(no).alias("no"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    base = F.flatten(F.array(*[of_kind(i, k) for i, k in enumerate(BASE)]))

    def chosen(c: Column, spans: Column) -> Column:
        limit = F.lit(math.inf)
        for kind, t in model.thresholds.items():
            limit = F.when(c["kind"] == kind, F.lit(t)).otherwise(limit)
        return (model.margin_column(c["pattern"]) >= limit) & ~F.exists(spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))

    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    added = let(base, lambda b: F.transform(F.filter(F.col("loose"), lambda c: chosen(c, b)), lambda c: F.struct(F.element_at(order, c["kind"]).alias("no"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    extra = F.when(F.size("loose") > 0, added).otherwise(F.array().cast("array<struct<no:int,start:int,end:int,kind:string>>"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"),
        let(base, lambda b: told(F.concat(b, extra))).alias("spans"),
        F.size(extra).cast("long").alias("n_added"),
    )
