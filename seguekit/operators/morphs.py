"""Tempo morphs and the positions of a set's parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHAPES = ["smooth", "exponential", "stepped", "linear"]


def morph_share(shape: Column, i: Column, points: Column, steps: Column) -> Column:
    """Share of the way to the new tempo at point ``i`` of ``points``; a stepped morph is on the value that ends its step."""
    t = F.coalesce(F.try_divide(i.cast("double"), points - 1), F.lit(0.0))
    stair = F.ceil((i + 1) * steps / points).cast("double") / steps
    fall = (1 - F.exp(-3 * t)) / (1 - F.exp(F.lit(-3.0)))
    return F.when(shape == "smooth", 0.5 * (1 - F.cos(F.lit(3.141592653589793) * t))).when(shape == "exponential", fall).when(shape == "stepped", stair).otherwise(t)


def tempo_morph(plans: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, shape, i, tempo, stretch, elapsed) of plans (key, tempo_a, tempo_b, duration_sec, points, max_pct), for every shape.

    The target is clamped to ``max_pct`` of tempo_a either way. Under half a beat a minute of change, or with a clamp of zero
    or below, the tempo stays. ``stretch`` is tempo_a / tempo; ``elapsed`` is its integral by trapezoids over the plan's
    seconds, the time that has passed when point i of the source is reached. A stepped morph has a step a bar, four at least.
    Null tempos give null curves. Plans are shuffled by their key before their points are made, so a plan travels as one row.
    """
    a, p = F.col("tempo_a"), F.col("max_pct")
    target = F.greatest(F.least(F.col("tempo_b"), a * (1 + p)), a * (1 - p))
    still = (p <= 0) | (F.abs(target - a) < 0.5)
    bars = F.floor(F.floor(F.col("duration_sec") * a / 60) / 4)
    dealt = plans.repartition(key).withColumns({"__goal": F.when(still, a).otherwise(target), "__steps": F.greatest(F.lit(4), bars)})
    rows = dealt.withColumn("shape", F.explode(F.array(*map(F.lit, SHAPES)))).withColumn("i", F.explode(F.when(F.col("points") > 0, F.sequence(F.lit(0), F.col("points").cast("int") - 1))))
    tempo = a + (F.col("__goal") - a) * morph_share(F.col("shape"), F.col("i"), F.col("points"), F.col("__steps"))
    rows = rows.withColumn("tempo", tempo).withColumn("stretch", F.try_divide(a, F.col("tempo")))
    w = Window.partitionBy(key, "shape").orderBy("i")
    part = F.coalesce((F.col("stretch") + F.lag("stretch").over(w)) / 2 * F.try_divide(F.col("duration_sec"), F.col("points") - 1), F.lit(0.0))
    rows = rows.withColumn("__part", part)
    return rows.select(key, "shape", "i", "tempo", "stretch", F.sum("__part").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("elapsed"))


def set_markers(plans: DataFrame, key: str, order: str) -> DataFrame:
    """(key, kind, index, start, end) of the bodies, blends and tail of sets, from a row (t1, b_in, blend, b_length) per transition.

    A body runs from where the track resumes to the blend at ``t1`` (nothing if it resumes later); the next track comes in at
    ``b_in`` and resumes at b_in + blend. The tail is what the last track has left. One window order serves all sums.
    """
    w = Window.partitionBy(key).orderBy(order)
    resume = F.col("b_in") + F.col("blend")
    p = plans.withColumns({"__n": F.row_number().over(w) - 1, "__body": F.greatest(F.lit(0), F.col("t1") - F.coalesce(F.lag(resume).over(w), F.lit(0)))})
    p = p.withColumns({"__at": F.sum(F.col("__body") + F.col("blend")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__last": F.lead(order).over(w).isNull()})
    end, n, none = F.col("__at"), F.col("__n"), F.lit(None)
    mark = lambda kind, i, start, stop: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("index"), start.alias("start"), stop.alias("end"))
    blend_at = end - F.col("blend")
    tail = F.when(F.col("__last"), mark("track", n + 1, end, end + F.greatest(F.lit(0), F.col("b_length") - resume))).otherwise(none)
    marks = F.array(mark("track", n, blend_at - F.col("__body"), blend_at), mark("transition", n, blend_at, end), tail)
    return p.select(key, F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m")).select(key, "m.kind", "m.index", "m.start", "m.end")
