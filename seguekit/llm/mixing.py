"""Mixing sources to target weights along a curriculum, with DataFrame functions only.

Weights of the sources turn into word targets by water filling: target = min(cap, weight * level), with one level for
all, such that the targets add up to the wanted total. That is what resharing the excess again and again ends at.

Each source lays its documents on a line in a seeded random order, once per epoch. The mix takes the words up to the
target: whole passes first, then the documents up to the point where the target falls. A source's weight schedule
over training time u in [0, 1] is linear from ``start`` to ``end`` times its weight; its integral, scaled to the
target, is its cumulative demand. A document in the middle of its words at fraction q of the target is trained at the
time where the cumulative demand reaches q: the integral is inverted in closed form. Documents are range-sorted by it.

Running sums are made in three steps, so that a hot source is no single task: sums by (source, slice of the random order)
and by groups of slices, a window over groups, one over the slices of a group, and one inside each slice. With the
defaults a window over groups sees a row for 4 million documents.

Defined results: null text has size 0 and is taken 0 times; a null source is a source of its own and comes last in
code-point order; sources of size 0 have target 0; repeated rows and repeated ids are documents of their own (in
``mixed_documents`` rows equal in id and text share what the greatest of them takes); texts of any length count whole;
an empty table gives an empty result; other columns are ignored by ``mix`` and passed on by ``mixed_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seguekit.llm.common import WORD, cut, text_or_empty


@dataclass(frozen=True)
class MixPlan:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  #: repeating over the sources by code point
    share: float = 1.5  #: of all words
    max_epochs: float = 2.0
    ramps: tuple[tuple[float, float], ...] = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))  #: start and end of a source's weight over time, repeating like the weights
    seed: int = 7
    rows_per_slice: int = 2_000
    slices_per_group: int = 2_000


def source_targets(sizes: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """(source, source_size) -> with weight, target and ramp; one row per source, so the windows over it are short.

    Level k belongs to the case that the k sources with the least cap per weight are at their caps; the right k is
    the first whose level is within the cap per weight of the next source, which is the highest such level.
    """
    n, weights = len(plan.weights), F.array(*map(F.lit, plan.weights))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("__rank", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(weights, (F.col("__rank") % n + 1).cast("int")))
    for name, at in (("ramp_start", 0), ("ramp_end", 1)):
        ramps = F.array(*(F.lit(r[at]) for r in plan.ramps))
        s = s.withColumn(name, F.element_at(ramps, (F.col("__rank") % len(plan.ramps) + 1).cast("int")))
    s = s.withColumn("__cap", plan.max_epochs * F.col("source_size")).withColumn("__full", F.col("__cap") / F.col("weight"))
    by_full = Window.orderBy("__full", "__rank")
    before, every = by_full.rowsBetween(Window.unboundedPreceding, -1), by_full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (
        s.withColumn("__caps", F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
        .withColumn("__w", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("__total", plan.share * F.sum("source_size").over(every))
        .withColumn("__level", (F.col("__total") - F.col("__caps")) / F.col("__w"))
    )
    level = F.max(F.when(F.col("__level") <= F.col("__full"), F.col("__level"))).over(every)
    target = F.least(F.col("__cap"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))
    s = s.withColumn("target", target.cast("double")).withColumn("run_words", F.sum("target").over(every))
    return s.select("source", "source_size", "weight", "ramp_start", "ramp_end", "target", "run_words")


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def demand_time(q: Column, start: Column, end: Column) -> Column:
    """The u in [0, 1] with (start * u + (end - start) * u^2 / 2) / ((start + end) / 2) = q."""
    goal, slope = q * (start + end) / 2, end - start
    root = F.sqrt(F.greatest(start * start + 2 * slope * goal, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-12, q).otherwise((root - start) / slope)


def _placed(docs: DataFrame, plan: MixPlan) -> DataFrame:
    """A row per document with its place on its source's line (``__at``) and the words taken."""
    narrow = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
            row_hash(plan).alias("__row"),
        )
    )
    slices = max(1, narrow.count() // plan.rows_per_slice)
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    narrow = narrow.withColumn("__key", key).withColumn("__slice", F.pmod(F.col("__row"), F.lit(slices)))
    by_slice = cut(narrow.groupBy("source", "__key", "__slice").agg(F.sum("size").alias("__words")))
    sources = source_targets(by_slice.groupBy("source").agg(F.sum("__words").alias("source_size")), plan).withColumn("__key", key).drop("source")
    grouped = by_slice.withColumn("__group", F.floor(F.col("__slice") / plan.slices_per_group))
    by_group = grouped.groupBy("__key", "__group").agg(F.sum("__words").alias("__sum"))
    before = lambda keys, at, x: F.coalesce(F.sum(x).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_group.select("__key", "__group", before(["__key"], "__group", "__sum").alias("__offset"))
    starts = grouped.withColumn("__along", before(["__key", "__group"], "__slice", "__words")).join(offsets, ["__key", "__group"]).select("__key", "__slice", (F.col("__offset") + F.col("__along")).alias("__from"))
    heads = starts.join(sources, "__key")
    inside = Window.partitionBy("__key", "__slice").orderBy("__row", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(heads, ["__key", "__slice"])
    goal = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0))
    placed = placed.withColumn("__at", F.col("__from") + F.col("__in")).withColumn("__epochs", epochs).withColumn("__rest", goal - F.col("__epochs") * F.col("source_size"))
    part = F.least(F.greatest(F.col("__rest") - F.col("__at"), F.lit(0)), F.col("size"))
    return placed.withColumn("taken", (F.col("__epochs") * F.col("size") + part).cast("long"))


def row_hash(plan: MixPlan) -> Column:
    """The seeded random order of the documents; equal rows have equal hashes."""
    return F.xxhash64(F.lit(plan.seed), F.col("doc_id").cast("long"), text_or_empty("text"))


def training_position(epoch: Column) -> Column:
    """Words into the run at which the middle of a document is trained in a source's epoch 0, 1, ..."""
    words = F.least(F.col("size"), F.col("taken") - epoch * F.col("size"))
    q = (epoch * F.col("source_size") + F.col("__at") + words / 2) / F.col("target")
    return demand_time(F.least(q, F.lit(1.0)), F.col("ramp_start"), F.col("ramp_end")) * F.col("run_words")


def mix(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, position.

    ``taken`` counts words, repeats included: whole epochs of the source, then the words of this document that lie
    before the target. ``position`` is that of the first epoch, null where nothing is taken.
    """
    first = F.when(F.col("taken") > 0, training_position(F.lit(0)))
    return _placed(docs, plan).select("doc_id", "size", "source_size", "target", "taken", first.alias("position"))


def mixed_documents(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """The documents of the mix in training order, each as often as the mix takes it, with the columns of ``docs``.

    Texts stay whole: a document is repeated round(taken / size) times, so the one at a source's target is in or out.
    """
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    takes = _placed(docs, plan).where("taken > 0").withColumn("__times", times).where("__times > 0")
    takes = takes.groupBy("__row").agg(F.max(F.struct("__times", "size", "taken", "source_size", "target", "ramp_start", "ramp_end", "run_words", "__at")).alias("__t"))
    positions = F.transform(F.sequence(F.lit(0), F.col("__times") - 1), training_position)
    takes = takes.select("__row", "__t.*").select("__row", positions.alias("__positions"))
    kept = docs.withColumn("__row", row_hash(plan)).join(takes, "__row").withColumn("__position", F.explode("__positions"))
    return kept.repartitionByRange("__position", "__row").sortWithinPartitions("__position", "__row").select(*docs.columns)
