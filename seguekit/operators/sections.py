"""Sections and changes of energy curves, from peaks and valleys (frames are numbered 0 to n - 1 in each track)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seguekit.operators.blocks import energy_change, split_peaks
from seguekit.operators.series import moving_average, ordered


def extremes(series: DataFrame, key: str, at: str, value: str, distance: int, prominence: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Peaks and valleys (key, at, value)."""
    below = series.withColumn(value, -F.col(value))
    return tuple(split_peaks(x, key, at, value, distance=distance, prominence=prominence) for x in (series, below))


def fallback_changes(frames: DataFrame, key: str, at: str, value: str, frame_sec: float, gap_sec: float = 60.0, span_sec: float = 30.0) -> DataFrame:
    """(key, at, start_sec, end_sec, change): where the energy changes most, ``gap_sec`` apart; a change lasts ``span_sec`` or to the end.

    The curve is rounded to nine decimals, so that plateaus don't depend on the order of sums.
    """
    curve = energy_change(frames, key, at, value).withColumn("change", F.round("change", 9))
    found = split_peaks(curve, key, at, "change", height=0.2, distance=int(gap_sec / frame_sec))
    whole = frames.groupBy(key).agg((F.count("*") * frame_sec).alias("__end"))
    start = F.col(at) * frame_sec
    return found.join(whole, key).select(key, at, start.alias("start_sec"), F.least(start + span_sec, F.col("__end")).alias("end_sec"), "change")


def energy_segments(frames: DataFrame, key: str, at: str, value: str, frame_sec: float) -> DataFrame:
    """(key, segment, start_sec, end_sec, mid_sec, energy): sections between peaks and valleys of the energy over four seconds.

    Under four sections, a track is cut into 4 to 8 equal ones of some 30 seconds, whose energy takes the frames from the one nearest
    to the start to the one nearest to the end. A section between extremes leaves its last frame to the next.
    """
    size = max(10, int(4 / frame_sec))
    smooth = frames.select(key, at, F.round(moving_average(value, key, at, size), 9).alias("__s"))
    tops, valleys = extremes(smooth, key, at, "__s", max(5, size // 2), 0.1)
    ends = frames.groupBy(key).agg(F.max(at).alias("__last"))
    marks = ends.select(key, F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.col("__last").cast("long")))).alias(at))
    marks = marks.unionByName(tops.select(key, at)).unionByName(valleys.select(key, at)).distinct()
    o = ordered(key, at)
    marks = marks.select(key, at, (F.row_number().over(o) - 1).alias("segment"), F.lead(at).over(o).alias("__to"), (F.count("*").over(Window.partitionBy(key)) - 1).alias("__n")).where("__to IS NOT NULL")
    keys = ("__key", "__at")
    of = marks.where("__n >= 4").select(F.col(key).alias(keys[0]), F.col(at).alias(keys[1]), "segment", "__to")
    placed = frames.select(key, at, value).join(of, (F.col(key) == F.col("__key")) & (F.col(at) == F.col("__at")), "left")
    run = o.rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select(key, at, value, *(F.last(c, ignorenulls=True).over(run).alias(c) for c in ("segment", "__at", "__to"))).where(F.col("__to") > F.col(at))
    between = placed.groupBy(key, "segment", "__at", "__to").agg(F.avg(value).alias("energy"))
    start, end = F.col("__at") * frame_sec, F.col("__to") * frame_sec
    between = between.select(key, F.col("segment").cast("long").alias("segment"), start.alias("start_sec"), end.alias("end_sec"), ((start + end) / 2).alias("mid_sec"), "energy")

    long = marks.where("__n >= 4").select(F.col(key).alias("__key")).distinct()
    rest = ends.join(long, F.col(key) == F.col("__key"), "left_anti").withColumn("__dur", (F.col("__last") + 1) * F.lit(float(frame_sec)))
    n = F.least(F.lit(8), F.greatest(F.lit(4), F.floor(F.col("__dur") / 30)))
    equal = rest.select(F.col(key).alias("__key"), "__dur", "__last", n.alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("segment"))
    from_, to = F.col("segment") * F.col("__dur") / F.col("__n"), (F.col("segment") + 1) * F.col("__dur") / F.col("__n")
    nearest = lambda t: F.ceil(t / frame_sec - 0.5)  # noqa: E731 (of two equally near frames the first)
    equal = equal.withColumns({"start_sec": from_, "end_sec": to}).withColumns({"__a": nearest(F.col("start_sec")), "__b": nearest(F.least(F.col("end_sec"), F.col("__last") * frame_sec))})
    held = frames.select(key, at, value).join(equal, (F.col(key) == F.col("__key")) & F.col(at).between(F.col("__a"), F.col("__b")))
    equal = held.groupBy(key, "segment", "start_sec", "end_sec").agg(F.avg(value).alias("energy")).select(key, "segment", "start_sec", "end_sec", ((F.col("start_sec") + F.col("end_sec")) / 2).alias("mid_sec"), "energy")
    return between.unionByName(equal)


def voted_peaks(votes: DataFrame, key: str, at: str, vote: str, distance: int = 8) -> DataFrame:
    """(key, at, vote): peaks of at least 0.2 and 0.15 prominent; series of over 30 bars with under three get 0.15 and 0.1."""
    rows = votes.select(key, at, vote)
    strict, loose = (split_peaks(rows, key, at, vote, height=h, distance=distance, prominence=p) for h, p in ((0.2, 0.15), (0.15, 0.1)))
    bars = rows.groupBy(key).agg(F.count("*").alias("__bars"))
    n = strict.groupBy(key).agg(F.count("*").alias("__n"))
    few = bars.join(n, key, "left").where("__bars > 30 AND coalesce(__n, 0) < 3").select(F.col(key).alias("__key"))
    on = F.col(key) == F.col("__key")
    return strict.join(few, on, "left_anti").unionByName(loose.join(few, on, "left_semi"))
