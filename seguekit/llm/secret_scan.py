"""Secret scans by rules and a randomness test battery, with DataFrame functions only.

Rules give the base spans (kinds assign, access, hex). The battery looks at every long run of encoding characters:

1. its encoding is inferred (hex, base32, alphanumeric, base64) and gives the alphabet; runs of digits alone are none;
2. chi-squared statistic of uniform use of that alphabet. Text uses few letters often: the divergence of its letters from
   uniform use is at least ``UNEVEN`` by alphabet. At that divergence the statistic of a run of n characters is
   noncentral chi-squared with noncentrality n * divergence, and the lower tail (Patnaik's central approximation, then
   Wilson and Hilferty's cube root) is the p-value against "this is text": longer runs can give smaller ones;
3. a runs test (lower against upper half of the alphabet) and lag-1 serial correlation, both with known distributions for
   random strings: a run beyond ``accept`` is not random, whatever letters it uses, and gets the p-value 1;
4. Benjamini and Hochberg's procedure over all runs of a length class (powers of two from 16 to 128) finds the largest
   p-value at which the expected share of text among what is flagged stays within ``fdr``.

p-values are binned on a log scale, so step 4 needs one small aggregate over all documents: at most a few thousand bins
for each of the four length classes. Only the thresholds, one for a class, come to the driver.

Offsets count code points, ends are exclusive. Defined results: null texts are empty and have no span; ``random`` holds all
flagged runs, ``added`` those that no base span overlaps; an empty table gives an empty result; texts of any length are
scanned whole; equal and repeated rows are scanned each and count each in step 4; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seguekit.llm.common import text_or_empty

#: Fixed values of the rules: pattern, group that must be long enough, its least length; kinds in report order.
RULES = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # maximal runs, so the least length can stand in the pattern
}
KINDS = (*RULES, "random")
SPAN = "struct<start:bigint,rank:int,end:bigint>"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LEAST, CLASSES = 20, (4, 7)  # the least length of a run; the length classes, powers of two
ALPHABETS = {
    16: "0123456789abcdef",
    32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    62: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Half of what text has: letters of European languages meet with a probability of at least 0.065, so text diverges by
#: 0.065 * alphabet - 1. For hex what digits alone have, 16 / 10 - 1; they are no candidates, and letters diverge by more.
UNEVEN = {16: 0.6, 32: 0.54, 62: 1.5, 64: 1.58}
#: The normal tail is its density times a polynomial in 1 / (1 + 0.2316419 x).
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
PIECE = 256  # matches put together at a time


@dataclass(frozen=True)
class Battery:
    fdr: float = 0.05
    accept: float = 13.82  #: runs and serial scores squared and added: random strings stay below in 999 of 1000 cases (chi-squared, 2 degrees)
    bins_per_unit: int = 20  #: of -ln(p-value)
    most_bins: int = 2_000


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end,value>> of the leftmost non-overlapping matches; value: the group's text.

    The text between matches comes from a split at the same pattern, and positions are running sums of both lengths,
    made ``PIECE`` matches at a time, so that arrays don't grow by one element each.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    pairs = F.filter(pairs, lambda x: x["hit"].isNotNull())
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(PIECE)), lambda i: F.slice(pairs, i, F.lit(PIECE)))
    found = "array<struct<start:bigint,end:bigint,value:string>>"

    def empty(at: Column, kind: str) -> Column:
        return F.struct(at.alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    def piece(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, empty(acc["at"], found), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    whole = F.aggregate(pieces, empty(F.lit(0).cast("long"), f"array<{found}>"), piece, lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(pattern), whole).otherwise(F.array().cast(found))


def base_spans(text: Column) -> Column:
    """array<struct<start,rank,end>> of the rules, by start and then kind."""
    return F.array_sort(F.concat(*(_rule_spans(text, rank, *rule) for rank, rule in enumerate(RULES.values()))))


def _rule_spans(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    good = F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))


def alphabet_size(token: Column) -> Column:
    return F.when(token.rlike("^[0-9a-f]+$"), 16).when(token.rlike("^[A-Z2-7]+$"), 32).when(token.rlike("^[A-Za-z0-9]+$"), 62).otherwise(64)


def p_value(token: Column, battery: Battery = Battery()) -> Column:
    """Probability that text of the token's length looks as random; 1 for digits alone and where a test rejects randomness."""
    by_size = None
    for size in ALPHABETS:
        plain = F.translate(F.regexp_replace(token, "=", ""), "-_", "+/") if size == 64 else token
        one = _p_value(plain, size, battery)
        by_size = F.when(alphabet_size(token) == size, one) if by_size is None else by_size.when(alphabet_size(token) == size, one)
    return F.when(token.rlike("^[0-9]+$"), 1.0).otherwise(by_size)


def _p_value(token: Column, size: int, battery: Battery) -> Column:
    letters, n = ALPHABETS[size], F.greatest(F.length(token), F.lit(2)).cast("double")
    counts = F.transform(F.array(*map(F.lit, letters)), lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"))
    squares = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * c)
    uniform = F.greatest(squares * size / n - n, F.lit(0.0))
    centred = F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(letters)) - (size + 1) / 2.0)
    shifted = F.slice(centred, F.lit(2), F.greatest(F.size(centred) - 1, F.lit(0)))
    paired = F.filter(F.arrays_zip(centred.alias("a"), shifted.alias("b")), lambda p: p["b"].isNotNull())
    product = F.aggregate(paired, F.lit(0.0), lambda acc, p: acc + p["a"] * p["b"])
    serial = product / ((n - 1) ** 0.5 * (size * size - 1) / 12.0)
    changes = F.aggregate(paired, F.lit(0.0), lambda acc, p: acc + F.when((p["a"] > 0) == (p["b"] > 0), 0.0).otherwise(1.0))
    runs = (changes - (n - 1) / 2.0) / ((n - 1) ** 0.5 / 2.0)
    good = (F.length(token) >= LEAST) & (serial**2 + runs**2 <= battery.accept)
    return F.when(good, _lower_tail(uniform, size - 1, n * UNEVEN[size])).otherwise(1.0)


def _lower_tail(x: Column, degrees: int, noncentrality: Column) -> Column:
    """P(noncentral chi-squared <= x)."""
    mean = noncentrality + degrees
    f = mean * mean / (noncentrality * 2 + degrees)
    z = (F.cbrt(x / mean) - (1 - 2 / (9 * f))) / F.sqrt(2 / (9 * f))
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = F.lit(0.0)
    for c in reversed(TAIL):
        series = (series + c) * t
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z > 0, 1 - tail).otherwise(tail)


def candidates(text: Column, battery: Battery) -> Column:
    """array<struct<start,end,class,bin>> of the long runs of encoding characters; bin 0: p-values near 1."""

    def judged(m: Column) -> Column:
        p = F.greatest(p_value(m["value"], battery), F.lit(1e-300))
        bin_ = F.least(F.greatest(F.floor(-F.log(p) * battery.bins_per_unit), F.lit(0)), F.lit(battery.most_bins)).cast("int")
        class_ = F.least(F.floor(F.log2(F.length(m["value"]))), F.lit(CLASSES[1])).cast("int")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), class_.alias("class"), bin_.alias("bin"))

    return F.transform(matches(text, CANDIDATE), judged)


def thresholds(docs: DataFrame, battery: Battery = Battery()) -> dict[int, int]:
    """Length class -> least bin that is flagged, from all documents."""
    each = docs.select(F.explode_outer(candidates(text_or_empty(), battery)).alias("c")).where(F.col("c").isNotNull()).select("c.class", "c.bin")
    bins = each.groupBy("class", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("class").orderBy(F.desc("bin"))
    most = F.exp(-F.col("bin") / battery.bins_per_unit)  # the largest p-value of a bin
    rate = most * F.sum("n").over(Window.partitionBy("class")) / F.sum("n").over(upto)
    good = bins.withColumn("rate", rate).where(F.col("rate") <= battery.fdr)
    return {r["class"]: r["bin"] for r in good.groupBy("class").agg(F.min("bin").alias("bin")).collect()}  # a row per length class


def scan(docs: DataFrame, battery: Battery = Battery()) -> DataFrame:
    """(doc_id, base, random, added): spans of the rules, of the battery, and of the battery outside the rules' spans.

    Spans are (start, rank of KINDS, end).
    """
    cuts = thresholds(docs, battery)
    text = text_or_empty()
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base_spans(text).alias("base"), (candidates(text, battery) if cuts else F.array()).alias("found"))
    if not cuts:
        none = F.array().cast(f"array<{SPAN}>")
        return out.select("doc_id", "base", none.alias("random"), none.alias("added"))
    cut = F.create_map(*(F.lit(x) for pair in sorted(cuts.items()) for x in pair))
    flagged = F.filter("found", lambda c: c["bin"] >= F.coalesce(F.try_element_at(cut, c["class"]), F.lit(battery.most_bins + 1)))
    spans = F.transform(flagged, lambda c: F.struct(c["start"].alias("start"), F.lit(len(RULES)).alias("rank"), c["end"].alias("end")))
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    return out.select("doc_id", "base", spans.alias("random")).withColumn("added", F.filter("random", free))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")
