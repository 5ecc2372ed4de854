"""Operators over ordered series: frames, beats, bars. Every window is partitioned by its series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seguekit.operators.blocks import split_peaks


def ordered(key: str, at: str):
    return Window.partitionBy(key).orderBy(at)


def bars_from_beats(beats: DataFrame, per_bar: int = 4) -> DataFrame:
    """(track_id, bar_idx, start_sec, end_sec): every fourth beat begins a bar; the last needs a beat after it."""
    end = F.lead("t_sec", per_bar).over(ordered("track_id", "beat_idx"))
    return beats.withColumn("end_sec", end).where((F.col("beat_idx") % per_bar == 0) & F.col("end_sec").isNotNull()).select("track_id", F.floor(F.col("beat_idx") / per_bar).alias("bar_idx"), F.col("t_sec").alias("start_sec"), "end_sec")


def local_gaps(series: DataFrame, key: str, at: str, value: str, w: int) -> DataFrame:
    """Rows that are the first minimum of their centred window of ``w`` rows either side; edges are left out."""
    o = ordered(key, at)
    x = F.col(value)
    least = F.min(x).over(o.rowsBetween(-w, w))
    before = F.min(x).over(o.rowsBetween(-w, -1))
    n = F.count("*").over(Window.partitionBy(key))
    i = F.row_number().over(o) - 1
    return series.withColumn("__least", least).withColumn("__before", before).withColumn("__i", i).withColumn("__n", n).where((x == F.col("__least")) & (F.col("__before") > x) & (F.col("__i") >= w) & (F.col("__i") < F.col("__n") - w)).drop("__least", "__before", "__i", "__n")


def moving_average(value: str, key: str, at: str, size: int) -> Column:
    """Centred, zero padded: the sum is divided by ``size`` at the edges too. An even size reaches further back."""
    return F.sum(value).over(ordered(key, at).rowsBetween(-(size // 2), (size - 1) // 2)) / size


def peaks(values: np.ndarray, height: float | None = None, distance: int = 1, prominence: float | None = None) -> np.ndarray:
    """Indices of local maxima: plateaus count at their middle, then height, then distance (highest first), then prominence."""
    x, n, found, i = np.asarray(values, float), len(values), [], 1
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < n and x[j + 1] == x[i]:
                j += 1
            if j + 1 < n and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    at = np.array(found, int)
    if height is not None:
        at = at[x[at] >= height]
    if distance > 1 and len(at):
        keep = np.ones(len(at), bool)
        for p in np.argsort(x[at], kind="stable")[::-1]:
            if keep[p]:
                near = np.abs(at - at[p]) < distance
                near[p] = False
                keep[near] = False
        at = at[keep]
    if prominence is not None:
        at = np.array([p for p in at if _prominence(x, p) >= prominence], int)
    return at


def _prominence(x: np.ndarray, p: int) -> float:
    """Height over the higher of the two lowest points between the peak and higher ground on each side."""
    left = np.flatnonzero(x[:p] > x[p])
    right = np.flatnonzero(x[p + 1 :] > x[p])
    a = x[(left[-1] + 1 if len(left) else 0) : p + 1].min()
    b = x[p : (p + 1 + right[0] if len(right) else len(x))].min()
    return float(x[p] - max(a, b))


def min_gap(events: DataFrame, key: str, at: str, confidence: str, gap: float = 60.0) -> DataFrame:
    """Keep an event if it is ``gap`` after the last kept one, else let it replace that one if it is more confident."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(at).cast("double").alias("t"), F.col(confidence).cast("double").alias("c"))))
    empty = F.array().cast("array<struct<t:double,c:double>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        swapped = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["t"] - last["t"] >= gap, F.concat(acc, F.array(x))).when(x["c"] > last["c"], swapped).otherwise(acc)

    return events.groupBy(key).agg(rows.alias("r")).select(key, F.explode(F.aggregate("r", empty, step)).alias("e")).select(key, F.col("e.t").alias(at), F.col("e.c").alias(confidence))


def islands(frames: DataFrame, key: str, at: str, value: str, threshold: float) -> DataFrame:
    """Runs of neighbouring rows at or over the threshold: key, start_idx, end_idx, n, peak, mean."""
    hit = frames.where(F.col(value) >= threshold)
    island = F.col(at) - F.row_number().over(ordered(key, at))
    return hit.withColumn("__i", island).groupBy(key, "__i").agg(F.min(at).alias("start_idx"), F.max(at).alias("end_idx"), F.count("*").alias("n"), F.max(value).alias("peak"), F.avg(value).alias("mean")).drop("__i")


def voice_runs(frames: DataFrame, key: str, at: str, value: str, share: float = 0.3, size: int = 5) -> DataFrame:
    """(key, silent, start_idx, end_idx, last): runs of silence (smoothed value under ``share`` of its mean) and of sound."""
    whole = Window.partitionBy(key)
    s = frames.select(key, at, moving_average(value, key, at, size).alias("__x"))
    s = s.withColumn("silent", F.round("__x", 9) < F.round(share * F.avg("__x").over(whole), 9)).withColumn("last", F.max(at).over(whole))
    run = F.col(at) - F.row_number().over(Window.partitionBy(key, "silent").orderBy(at))
    return s.withColumn("__g", run).groupBy(key, "silent", "__g").agg(F.min(at).alias("start_idx"), F.max(at).alias("end_idx"), F.max("last").alias("last")).drop("__g")


def vocal_phrases(frames: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, start_idx, end_idx): sound up to the silent frame that ends it, or to the last frame."""
    r = voice_runs(frames, key, at, value).where("not silent")
    return r.select(key, "start_idx", F.least(F.col("end_idx") + 1, F.col("last")).alias("end_idx"))


def safe_points(frames: DataFrame, key: str, at: str, value: str, step_sec: float, least: int = 5) -> DataFrame:
    """(key, center_sec) of the silences of over ``least`` frames that sound follows."""
    r = voice_runs(frames, key, at, value).where(F.col("silent") & (F.col("end_idx") < F.col("last")) & (F.col("end_idx") + 1 - F.col("start_idx") > least))
    return r.select(key, ((F.col("start_idx") + F.col("end_idx") + 1) / 2 * step_sec).alias("center_sec"))


def robust_norm(frames: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Between the 5th and 95th percentile of the series, clipped to 0..1; a flat series is 0."""
    lim = frames.groupBy(key).agg(F.percentile(value, 0.05).alias("__lo"), F.percentile(value, 0.95).alias("__hi"))
    share = F.coalesce(F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))
    return frames.join(lim, key).withColumn(out, F.when(F.col("__hi") > F.col("__lo"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(0.0)).drop("__lo", "__hi")


def min_max(value: str, key: str) -> Column:
    w = Window.partitionBy(key)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi > lo, F.try_divide(F.col(value) - lo, hi - lo)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """0 if either vector is null or zero, never NaN."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when(norm > 0, 1 - F.try_divide(dot(a, b), norm)), F.lit(0.0))


def repetition_break(bars: DataFrame, lags: tuple[int, ...] = (4, 8, 16)) -> DataFrame:
    """Largest cosine distance to the bars ``lags`` back (raw), before smoothing."""
    o = ordered("mix_id", "bar_idx")
    each = [cosine_distance(F.col("features"), F.lag("features", k).over(o)) for k in lags]
    return bars.withColumn("novelty", F.greatest(*each))


def checkerboard_novelty(rows: DataFrame, key: str, at: str, features: str, half: int = 16) -> DataFrame:
    """(key, at, novelty): how much the ``half`` rows before a place differ from those after, over the series' maximum.

    A checkerboard kernel with a Hann taper over the cosine similarities of unit vectors x is a product of its two sides,
    so its sum is the squared length of the tapered difference vector: no pair of rows is formed. Places nearer than
    ``half`` to an end are 0; series of under twice ``half`` rows use half of their length.
    """
    whole = Window.partitionBy(key)
    norm = F.sqrt(dot(F.col(features), F.col(features))) + 1e-9
    u = rows.select(key, at, F.transform(features, lambda x: x / norm).alias("__u"), F.count("*").over(whole).alias("__n"), (F.row_number().over(ordered(key, at)) - 1).alias("__i"))
    u = u.withColumn("__l", F.least(F.lit(half), F.floor(F.col("__n") / 2)).cast("int"))
    near = F.collect_list("__u").over(ordered(key, at).rowsBetween(-half, half - 1))
    u = u.withColumn("__near", near).withColumn("__own", F.slice("__near", F.least(F.col("__i"), F.lit(half)).cast("int") - F.col("__l") + 1, 2 * F.col("__l")))
    weight = lambda k: (0.5 - 0.5 * F.cos(2 * F.pi() * k / (2 * F.col("__l") - 1))) * F.when(k < F.col("__l"), -1.0).otherwise(1.0)
    zero = F.transform("__u", lambda x: F.lit(0.0))
    total = F.aggregate(F.transform("__own", lambda x, k: F.transform(x, lambda v: v * weight(k))), zero, lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q))
    inside = (F.col("__l") >= 2) & (F.col("__i") >= F.col("__l")) & (F.col("__i") < F.col("__n") - F.col("__l"))
    raw = u.where(inside).withColumn("__v", total).select(key, at, dot(F.col("__v"), F.col("__v")).alias("__raw"))
    out = rows.select(key, at).join(raw, [key, at], "left").na.fill(0.0, ["__raw"])
    top = F.max("__raw").over(whole)
    return out.select(key, at, F.when(top > 0, F.col("__raw") / top).otherwise(0.0).alias("novelty"))


def novelty_sections(novelty: DataFrame, energy: DataFrame, key: str, at: str, bar: int = 4, height: float = 0.3, distance: int = 16) -> DataFrame:
    """(key, start_idx, end_idx, energy, label): sections between peaks of the novelty, snapped to bars of ``bar`` rows.

    A peak over 0.4 bar off the nearest downbeat is no border; sections under a bar are left out; a section is high if its
    mean energy at downbeats is at least the series' median there. A series without a border is one section.
    """
    p = split_peaks(novelty, key, at, "novelty", height, distance)
    snap = F.round(F.col(at) / bar) * bar
    borders = p.where(F.abs(snap - F.col(at)) <= 0.4 * bar).select(key, snap.cast("long").alias("start_idx"))
    ends = energy.groupBy(key).agg((F.max(at) + 1).alias("__end"))
    starts = borders.unionByName(ends.select(key, F.lit(0).cast("long").alias("start_idx"))).distinct()
    w = Window.partitionBy(key).orderBy("start_idx")
    s = starts.join(ends, key).withColumn("end_idx", F.coalesce(F.lead("start_idx").over(w), F.col("__end"))).where(F.col("end_idx") - F.col("start_idx") >= bar).drop("__end")
    down = energy.where(F.col(at) % bar == 0).select(key, F.col(at).alias("__at"), F.col("energy").alias("__e"))
    median = down.groupBy(key).agg(F.percentile("__e", 0.5).alias("__median"))
    spread = s.withColumn("__at", F.explode(F.sequence(F.ceil(F.col("start_idx") / bar) * bar, F.col("end_idx") - 1, F.lit(bar).cast("long"))))
    g = spread.join(down, [key, "__at"]).groupBy(key, "start_idx", "end_idx").agg(F.avg("__e").alias("energy")).join(median, key)
    return g.select(key, "start_idx", "end_idx", "energy", F.when(F.col("energy") >= F.col("__median"), "high").otherwise("low").alias("label"))


def complexity_change(bars: DataFrame, back: int = 4) -> DataFrame:
    """Rise over the mean of the 4 bars before, floored at 0, over the series' maximum."""
    o = ordered("mix_id", "bar_idx")
    mean = F.avg("complexity").over(o.rowsBetween(-back, -1))
    rise = F.when(F.row_number().over(o) > back, F.greatest(F.lit(0.0), F.try_divide(F.col("complexity") - mean, mean)))
    top = F.max("__rise").over(Window.partitionBy("mix_id"))
    return bars.withColumn("__rise", F.coalesce(rise, F.lit(0.0))).withColumn("change", F.when(top > 0, F.try_divide(F.col("__rise"), top)).otherwise(0.0)).drop("__rise")


def vocal_novelty(bars: DataFrame, back: int = 8) -> DataFrame:
    """Mean absolute z of every feature against the 8 bars before (2 or more needed, spread over 0), over 3, at most 1."""
    long = bars.select("mix_id", "bar_idx", F.posexplode("features").alias("dim", "x"))
    o = Window.partitionBy("mix_id", "dim").orderBy("bar_idx").rowsBetween(-back, -1)
    z = F.abs(F.try_divide(F.col("x") - F.avg("x").over(o), F.stddev_pop("x").over(o)))
    valid = long.withColumn("z", F.when(F.count("x").over(o) >= 2, z))
    return valid.groupBy("mix_id", "bar_idx").agg(F.coalesce(F.least(F.lit(1.0), F.avg("z") / 3), F.lit(0.0)).alias("novelty"))


def band_independence(bars: DataFrame, back: int = 4, bands: int = 4) -> DataFrame:
    """Spread of the bands' relative changes since 4 bars ago, halved where the total changes by 0.3 or more, over the maximum."""
    o = ordered("mix_id", "bar_idx")
    now = F.transform(F.slice("features", 1, bands), F.abs)
    b = bars.select("mix_id", "bar_idx", now.alias("now"), F.lag(now, back).over(o).alias("then"))
    change = F.zip_with("now", "then", lambda x, y: F.coalesce(F.try_divide(x - y, y), F.lit(0.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    b = b.withColumn("c", change).withColumn("m", total(F.col("c")) / bands)
    spread = F.sqrt(F.aggregate("c", F.lit(0.0), lambda acc, x: acc + (x - F.col("m")) * (x - F.col("m"))) / bands)
    moved = F.abs(F.coalesce(F.try_divide(total(F.col("now")) - total(F.col("then")), total(F.col("then"))), F.lit(0.0)))
    b = b.withColumn("raw", F.coalesce(F.when(moved >= 0.3, spread / 2).otherwise(spread), F.lit(0.0)))
    top = F.max("raw").over(Window.partitionBy("mix_id"))
    return b.select("mix_id", "bar_idx", F.when(top > 0, F.try_divide(F.col("raw"), top)).otherwise(0.0).alias("independence"))


def transition_vote(repetition: Column, vocal: Column, complexity: Column, band: Column, bar_idx: Column) -> Column:
    """Weighted vote of the four scores, raised on phrase (8) and half-phrase (4) boundaries."""
    vote = (2 * repetition + 2 * vocal + 1.5 * complexity + band) / 6.5
    return vote * F.when(bar_idx % 8 == 0, 1.3).when(bar_idx % 8 == 4, 1.1).otherwise(1.0)


def track_boundaries(transitions: DataFrame, key: str, duration: Column) -> DataFrame:
    """(key, idx, start_sec, end_sec) of the tracks between transitions (start_sec, end_sec), the tail included."""
    w = Window.partitionBy(key).orderBy("start_sec", "end_sec")
    body = transitions.select(key, (F.row_number().over(w) - 1).alias("idx"), F.coalesce(F.lag("end_sec").over(w), F.lit(0.0)).alias("__from"), F.col("start_sec").alias("__to"))
    tail = transitions.groupBy(key).agg(F.count("*").alias("idx"), F.max("end_sec").alias("__from"), F.first(duration).alias("__to"))
    return body.unionByName(tail).where(F.col("__to") > F.col("__from")).select(key, "idx", F.col("__from").alias("start_sec"), F.col("__to").alias("end_sec"))


def downbeat_phase(beats: DataFrame) -> DataFrame:
    """(track_id, phase): the offset 0 to 3 with the strongest mean onset, the first on ties."""
    by = beats.groupBy("track_id", (F.col("beat_idx") % 4).alias("phase")).agg(F.avg("onset_strength").alias("mean"))
    return by.groupBy("track_id").agg(F.max_by("phase", F.struct(F.round("mean", 9), -F.col("phase"))).alias("phase"))


def microtiming(beats: DataFrame) -> DataFrame:
    """Deviation of the beat intervals (track_id, beat_idx, t, tempo) from the tempo in ms, swing between pairs of intervals, groove."""
    off = (F.col("t") - F.lag("t").over(ordered("track_id", "beat_idx")) - 60.0 / F.col("tempo")) * 1000
    o = beats.select("track_id", (F.col("beat_idx") - 1).alias("i"), off.alias("off")).where("off is not null")
    pairs = o.groupBy("track_id", F.floor(F.col("i") / 2).alias("pair")).agg(F.sum(F.when(F.col("i") % 2 == 1, F.col("off")).otherwise(-F.col("off"))).alias("s"), F.count("*").alias("n")).where("n = 2")
    swing = pairs.groupBy("track_id").agg(F.avg("s").alias("swing_ms"))
    g = o.groupBy("track_id").agg(F.avg(F.abs("off")).alias("mean_ms"), F.stddev_pop("off").alias("std_ms")).join(swing, "track_id", "left").na.fill(0.0, ["swing_ms"])
    size = F.abs("swing_ms")
    return g.select("track_id", "mean_ms", "std_ms", (1 - F.least(F.lit(1.0), F.col("std_ms") / 50)).alias("human"), "swing_ms", F.when(size > 20, "swing").when(size > 5, "shuffle").otherwise("straight").alias("groove"), (F.col("std_ms") < 10).alias("locked"))


def groove_pattern(onsets: DataFrame, first: int = 100, bins: int = 16) -> DataFrame:
    """(track_id, mean_ms, std_ms, swing, complexity, template) of onsets (track_id, i, t, strength, tempo); tracks of under 4 onsets are left out."""
    w = ordered("track_id", "i")
    beat = 60.0 / F.col("tempo")
    p = onsets.withColumn("beat", beat).withColumn("pos", F.pmod("t", "beat") / F.col("beat"))
    p = p.withColumn("gap", F.col("t") - F.lag("t").over(w)).withColumn("flux", F.abs(F.col("strength") - F.lag("strength").over(w))).withColumn("__mean", F.avg("strength").over(Window.partitionBy("track_id")))
    at = F.when(F.col("pos") <= 0.125, 0.0).when(F.col("pos") <= 0.375, 0.25).when(F.col("pos") <= 0.625, 0.5).otherwise(0.75)
    dev = (F.col("pos") - at) * F.col("beat") * 1000
    long = (F.col("gap") >= 0.35 * F.col("beat")) & (F.col("gap") < 0.72 * F.col("beat"))
    swing = F.coalesce(F.least(F.lit(0.75), F.greatest(F.lit(0.4), F.avg(F.when(long, F.col("gap") / F.col("beat"))))), F.lit(0.5))
    bin_ = F.floor(F.col("pos") * bins).cast("int") % bins
    counts = [F.count_if((bin_ == k) & (F.col("i") < first)).cast("double") for k in range(bins)]
    complexity = F.least(F.lit(1.0), (F.avg("flux") * 10 + F.count_if(F.col("strength") > F.col("__mean")) / F.count("*")) / 2)
    g = p.groupBy("track_id").agg(F.count("*").alias("n"), F.avg(F.abs(dev)).alias("mean_ms"), F.stddev_pop(dev).alias("std_ms"), swing.alias("swing"), complexity.alias("complexity"), F.array(*counts).alias("c")).where("n >= 4")
    return g.select("track_id", "mean_ms", "std_ms", "swing", "complexity", F.transform("c", lambda x: F.try_divide(x, F.array_max("c"))).alias("template"))


def rhythm_dna(frames: DataFrame, per_beat: int = 4, places: int = 16) -> DataFrame:
    """(track_id, pattern, syncopation, accents, density): the energy of every beat at 16 places, added up over the beats.

    A beat is ``per_beat`` rows of (track_id, frame_idx, rms), and one that another beat follows.
    """
    b = frames.groupBy("track_id", F.floor(F.col("frame_idx") / per_beat).alias("beat")).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "rms"))), lambda x: x["rms"]).alias("x"))
    b = b.withColumn("last", F.max("beat").over(Window.partitionBy("track_id"))).where((F.col("beat") < F.col("last")) & (F.size("x") == per_beat))

    def place(j: int) -> Column:
        at = j * (per_beat - 1) / (places - 1)
        lo = min(int(at), per_beat - 2)
        return F.col("x")[lo] + (F.col("x")[lo + 1] - F.col("x")[lo]) * (at - lo)

    r = b.select("track_id", *(place(j).alias(f"p{j}") for j in range(places)))
    mean = lambda js: sum((F.col(f"p{j}") for j in js), F.lit(0.0)) / len(js)
    strong, medium, weak = mean(range(0, places, 4)), mean(range(2, places, 4)), mean(range(1, places, 2))
    sync = F.least(F.lit(1.0), F.when(strong > 0, F.try_divide(medium + 2 * weak, 3 * strong)).otherwise(0.5))
    g = r.groupBy("track_id").agg(F.array(*(F.sum(f"p{j}") for j in range(places))).alias("s"), F.avg(sync).alias("syncopation"))
    g = g.withColumn("pattern", F.when(F.array_max("s") > 0, F.transform("s", lambda v: v / F.array_max("s"))).otherwise(F.col("s")))
    g = g.withColumn("m", F.aggregate("pattern", F.lit(0.0), lambda a, v: a + v) / places)
    g = g.withColumn("sd", F.sqrt(F.aggregate("pattern", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))) / places))
    accents = F.filter(F.transform("pattern", lambda v, j: F.when(v > F.col("m") + F.col("sd"), j)), lambda j: j.isNotNull())
    return g.select("track_id", "pattern", "syncopation", accents.alias("accents"), (F.size(F.filter("pattern", lambda v: v > 0.3)) / F.lit(float(places))).alias("density"))


def rhythm_match(pairs: DataFrame, dna: DataFrame) -> DataFrame:
    """(pair_id, pattern_correlation, syncopation_fit, density_fit, overall) of pairs (pair_id, a_id, b_id)."""
    side = lambda x: dna.select(F.col("track_id").alias(f"{x}_id"), *(F.col(c).alias(f"{c}_{x}") for c in ("pattern", "syncopation", "density")))
    both = pairs.join(side("a"), "a_id").join(side("b"), "b_id")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)
    centred = lambda c: F.transform(c, lambda v: v - mean(F.col(c)))
    both = both.withColumns({"ca": centred("pattern_a"), "cb": centred("pattern_b")})
    r = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(dot(F.col("ca"), F.col("cb")), F.sqrt(dot(F.col("ca"), F.col("ca")) * dot(F.col("cb"), F.col("cb")))), F.lit(0.0)))
    fit = lambda c: 1 - F.abs(F.col(f"{c}_a") - F.col(f"{c}_b"))
    return both.select("pair_id", r.alias("pattern_correlation"), fit("syncopation").alias("syncopation_fit"), fit("density").alias("density_fit"), (0.4 * r + 0.3 * fit("syncopation") + 0.3 * fit("density")).alias("overall"))


def variety_penalty(scores: DataFrame, set_col: str, step: str, option: str, score: str) -> DataFrame:
    """(set, step, option): the best option of each step after penalties of 0.4, 0.2 and 0.1 for the last three choices.

    A choice depends on those before it, so a set is folded in order; sets run in parallel.
    """
    kinds = dict(scores.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last, out = [], []
        for at, group in pdf.sort_values([step, option]).groupby(step, sort=True):
            lowered = [s - (0.4, 0.2, 0.1)[last.index(o)] if o in last else s for o, s in zip(group[option], group[score], strict=True)]
            best = group[option].iloc[int(np.argmax(lowered))]
            out.append((group[set_col].iloc[0], at, best))
            last = [best, *last][:3]
        return pd.DataFrame(out, columns=[set_col, step, option])

    return scores.select(set_col, step, option, score).groupBy(set_col).applyInPandas(run, f"{set_col} {kinds[set_col]}, {step} {kinds[step]}, {option} {kinds[option]}")
