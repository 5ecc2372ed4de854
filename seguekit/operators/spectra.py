"""Operators over spectra, chroma and pairs of them. Dimensions (bands, templates, techniques) are fixed and small."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coarse bands in Hz, lower edge closed.
BANDS = [("sub_bass", 20.0, 60.0), ("bass", 60.0, 250.0), ("low_mid", 250.0, 500.0), ("mid", 500.0, 2000.0), ("high_mid", 2000.0, 4000.0), ("high", 4000.0, 20000.0)]
#: Frequency ratios that resonate, in order.
RATIOS = [1.0, 2.0, 1.5, 1.333, 1.25, 1.2, 0.5, 0.667]


def band_of(freq: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(BANDS):
        out = F.when((freq >= lo) & (freq < hi), name).otherwise(out)
    return out


def band_energies(spectrum: DataFrame) -> DataFrame:
    """(track_id, band, energy, share): summed squared magnitudes; bins outside all bands are left out."""
    e = spectrum.withColumn("band", band_of(F.col("freq_hz"))).where("band is not null").groupBy("track_id", "band").agg(F.sum(F.col("mag") ** 2).alias("energy"))
    return e.withColumn("share", F.coalesce(F.try_divide(F.col("energy"), F.sum("energy").over(Window.partitionBy("track_id"))), F.lit(0.0)))


def spectrum_summary(spectrum: DataFrame) -> DataFrame:
    """Centroid, bandwidth and flatness of each spectrum."""
    total = F.sum("mag")
    c = F.try_divide(F.sum(F.col("mag") * F.col("freq_hz")), total)
    square = F.try_divide(F.sum(F.col("mag") * F.col("freq_hz") ** 2), total)
    flat = F.exp(F.avg(F.log(F.col("mag") + 1e-10))) / (F.avg("mag") + 1e-10)
    return spectrum.groupBy("track_id").agg(c.alias("centroid"), F.sqrt(F.greatest(square - c * c, F.lit(0.0))).alias("bandwidth"), flat.alias("flatness"))


def key_detect(chroma: DataFrame) -> DataFrame:
    """(track_id, root, mode): the best of 24 rotated scale templates by dot product; major only if strictly better.

    A template's product is a sum over the key's seven notes, so a note goes to the keys that hold it.
    """
    scale = (0, 2, 4, 5, 7, 9, 11)
    minor = (0, 2, 3, 5, 7, 8, 10)
    mean = chroma.groupBy("track_id", "pc").agg(F.avg("value").alias("x"))
    roots = lambda steps: F.array(*(F.pmod(F.col("pc") - s, F.lit(12)) for s in steps))
    each = mean.select("track_id", "x", F.explode(F.concat(F.transform(roots(minor), lambda r: F.struct(F.lit("minor").alias("mode"), r.alias("root"))), F.transform(roots(scale), lambda r: F.struct(F.lit("major").alias("mode"), r.alias("root"))))).alias("k"))
    score = each.groupBy("track_id", "k.mode", "k.root").agg(F.round(F.sum("x"), 9).alias("score"))
    best = score.groupBy("track_id").agg(F.max_by(F.struct("mode", "root"), F.struct(F.col("score"), F.col("mode") == "minor", -F.col("root"))).alias("b"))
    return best.select("track_id", "b.root", "b.mode")


def bark(freq: Column) -> Column:
    return F.least(F.floor(13 * F.atan(0.00076 * freq) + 3.5 * F.atan((freq / 7500) ** 2)), F.lit(24))


def bark_bands(spectrum: DataFrame) -> DataFrame:
    b = spectrum.groupBy("track_id", bark(F.col("freq_hz")).alias("band")).agg(F.sum("mag").alias("e"))
    return b.withColumn("e", F.coalesce(F.try_divide(F.col("e"), F.max("e").over(Window.partitionBy("track_id"))), F.lit(0.0)))


def sides(df: DataFrame, pairs: DataFrame, on: list[str], value: str) -> DataFrame:
    """(pair_id, *on, a, b): a value of both tracks of each pair (pair_id, a_id, b_id), where both have one."""
    a = df.select(F.col("track_id").alias("a_id"), *on, F.col(value).alias("a"))
    b = df.select(F.col("track_id").alias("b_id"), *on, F.col(value).alias("b"))
    return pairs.join(a, "a_id").join(b, ["b_id", *on]).select("pair_id", *on, "a", "b")


def bark_clash(spectrum: DataFrame, pairs: DataFrame) -> DataFrame:
    """Summed products over 25 Bark bands, how many are loud in both, and whether the bass (bands 0 to 4) is."""
    both = sides(bark_bands(spectrum), pairs, ["band"], "e")
    loud = (F.col("a") > 0.5) & (F.col("b") > 0.5)
    g = both.groupBy("pair_id").agg((F.sum(F.col("a") * F.col("b")) / 25).alias("clash"), F.count_if(loud).alias("loud_bands"), F.count_if(loud & (F.col("band") <= 4)).alias("bass_bands"))
    return g.withColumn("advice", F.array_compact(F.array(F.when(F.col("bass_bands") > 0, "swap bass"), F.when(F.col("clash") > 0.3, "cut mids"))))


def predict_quality(spectrum: DataFrame, pairs: DataFrame) -> DataFrame:
    """Correlation, overlap and level ratio of two spectra, and the score with its verdict at 0.55."""
    g = sides(spectrum, pairs, ["bin"], "mag").groupBy("pair_id").agg(
        F.coalesce(F.corr("a", "b"), F.lit(0.0)).alias("corr"), F.coalesce(F.try_divide(F.sum(F.least("a", "b")), F.sum("a") + F.sum("b")), F.lit(0.0)).alias("overlap"),
        F.coalesce(F.try_divide(F.least(F.sqrt(F.avg(F.col("a") ** 2)), F.sqrt(F.avg(F.col("b") ** 2))), F.greatest(F.sqrt(F.avg(F.col("a") ** 2)), F.sqrt(F.avg(F.col("b") ** 2)))), F.lit(0.0)).alias("level"),
    )
    score = 0.35 * F.greatest(F.lit(0.0), F.col("corr")) + 0.30 * (1 - F.col("overlap")) + 0.25 * F.col("level") + 0.05
    return g.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).withColumn("proceed", F.col("score") > 0.55)


def band_negotiation(spectrum: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per band: conflict, importance, owner at 1.2 times the other, and whether it is critical (over 0.6)."""
    both = sides(band_energies(spectrum), pairs, ["band"], "share")
    conflict = 2 * F.least("a", "b")
    top = F.max(F.greatest("a", "b")).over(Window.partitionBy("pair_id"))
    importance = F.when(F.greatest("a", "b") == top, 1.5).when(F.col("band").isin("sub_bass", "bass"), 1.3).when(F.col("band").isin("mid", "low_mid"), 1.2).otherwise(1.0)
    owner = F.when(F.col("a") > 1.2 * F.col("b"), "A").when(F.col("b") > 1.2 * F.col("a"), "B").otherwise("shared")
    return both.select("pair_id", "band", conflict.alias("conflict"), importance.alias("importance"), owner.alias("owner")).withColumn("critical", F.col("conflict") * F.col("importance") > 0.6)


def harmonic_resonance(spectrum: DataFrame, pairs: DataFrame, first: int = 30, keep: int = 20, tolerance: float = 0.05) -> DataFrame:
    """Peaks of both whose frequency ratio is near one of eight: the ``keep`` lowest of a for each pair."""
    w = Window.partitionBy("track_id").orderBy("bin")
    peak = (F.col("mag") > F.lag("mag").over(w)) & (F.col("mag") > F.lead("mag").over(w))
    p = spectrum.withColumn("peak", peak).where("peak").withColumn("i", F.row_number().over(w)).where(F.col("i") <= first)
    a = p.select(F.col("track_id").alias("a_id"), F.col("bin").alias("bin_a"), F.col("freq_hz").alias("fa"))
    b = p.select(F.col("track_id").alias("b_id"), F.col("bin").alias("bin_b"), F.col("freq_hz").alias("fb"))
    ratio = F.try_divide(F.col("fb"), F.col("fa"))
    hits = F.filter(F.array(*(F.when(F.abs(ratio - r) <= tolerance, F.lit(r)) for r in RATIOS)), lambda x: x.isNotNull())
    found = pairs.join(a, "a_id").join(b, "b_id").withColumn("ratio", F.get(hits, F.lit(0))).where("ratio is not null and fa > 0")
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy("bin_a", "bin_b"))
    return found.withColumn("rank", rank).where(F.col("rank") <= keep).select("pair_id", "rank", "bin_a", "bin_b", "ratio")


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b))))


def library_cells(library: DataFrame, most: int = 64) -> tuple[DataFrame, list[tuple[list[float], float]]]:
    """The library with its ``cell``, the nearest pivot, and (pivot, radius) of the cells.

    Pivots are ``most`` rows of the library or fewer (the square root of its size), by a hash of their id; only they and the radii come to the driver.
    """
    count = max(1, min(most, math.isqrt(library.count())))
    pivots = [r.lib for r in library.where("lib is not null").orderBy(F.xxhash64("lib_id"), "lib_id").limit(count).collect()]
    if not pivots:
        return library.withColumn("cell", F.lit(0)), []
    to = F.transform(F.lit(pivots), lambda p: _angle(p, F.col("lib")))
    dealt = library.where("lib is not null").withColumn("__to", to).withColumn("cell", (F.array_position("__to", F.array_min("__to")) - 1).cast("int"))
    radius = dict(dealt.groupBy("cell").agg(F.max(F.array_min("__to"))).collect())  # a row for each pivot
    return dealt.drop("__to"), [(p, radius.get(i, -math.inf)) for i, p in enumerate(pivots)]


def cells_to_ask(segment: Column, cells: list[tuple[list[float], float]], least: float, slack: float = 1e-4) -> Column:
    """The cells that may hold the best match of a unit vector over ``least``.

    Angles keep the triangle inequality, so nothing in a cell is nearer than the angle to its pivot less its radius. The best match
    is at least as near as the nearest pivot, which is of the library itself. ``slack`` covers the rounding of similarities.
    """
    near = F.transform(F.lit([p for p, _ in cells]), lambda p: _angle(p, segment))
    limit = F.least(F.lit(math.acos(least)), F.array_min(near)) + slack
    reach = F.zip_with(near, F.lit([r for _, r in cells]), lambda a, r: a - r)
    return F.filter(F.transform(reach, lambda x, i: F.when(x <= limit, i)), lambda i: i.isNotNull())


def identify_tracks(segments: DataFrame, library: DataFrame, least: float = 0.7, block: int = 1_000, most: int = 64) -> DataFrame:
    """(segment_id, track_id, similarity): the most similar library chroma over ``least``; equal ones by the smallest id.

    The library (lib_id, lib) lies in cells around pivots, and cells in pieces of some ``block`` rows. A segment (segment_id,
    chroma) meets the pieces of those cells only that the triangle inequality cannot leave out, in an equi-join, and keeps its
    best there. Exact. Both are unit vectors; null ones match nothing.
    """
    dealt, cells = library_cells(library, most)
    if not cells:
        return segments.select("segment_id", F.lit(None).cast(library.schema["lib_id"].dataType).alias("track_id"), F.lit(0.0).alias("similarity")).where("false")
    sizes = dict(dealt.groupBy("cell").count().collect())  # a row for each pivot
    pieces = F.lit([max(1, -(-sizes.get(i, 0) // block)) for i in range(len(cells))])
    piece = F.pmod(F.xxhash64("lib_id", F.lit(1)), F.get(pieces, F.col("cell"))).cast("int")
    own = dealt.groupBy("cell", piece.alias("piece")).agg(F.collect_list(F.struct("lib_id", "lib")).alias("__rows"))
    asks = segments.where("chroma is not null").withColumn("cell", F.explode(cells_to_ask(F.col("chroma"), cells, least)))
    met = asks.withColumn("piece", F.explode(F.sequence(F.lit(0), F.get(pieces, F.col("cell")) - 1))).join(own, ["cell", "piece"])
    top = F.array_max(F.transform("__rows", lambda r: F.struct(F.round(cosine(F.col("chroma"), r["lib"]), 9).alias("similarity"), (-r["lib_id"]).alias("k"))))
    best = met.select("segment_id", top.alias("b")).groupBy("segment_id").agg(F.max("b").alias("b"))
    return best.where(F.col("b.similarity") > least).select("segment_id", (-F.col("b.k")).alias("track_id"), F.col("b.similarity").alias("similarity"))


def chord_changes(chroma: DataFrame, key: str, step_sec: float) -> DataFrame:
    """(key, changes, rhythm_sec, cadences) of frames (key, frame, pc, value) in order, ``step_sec`` apart.

    A change is a frame whose summed difference to the one before is over the 75th percentile; the rhythm is the median
    time between changes (4 s without two), and a cadence ends an interval of over 1.5 times that, if there are over 3.
    """
    diff = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy(key, "pc").orderBy("frame")))
    moved = chroma.withColumn("__d", diff).where("__d is not null").groupBy(key, "frame").agg(F.sum("__d").alias("moved"))
    moved = moved.withColumn("t", (F.row_number().over(Window.partitionBy(key).orderBy("frame")) - 1) * step_sec)
    limit = moved.groupBy(key).agg(F.percentile("moved", 0.75).alias("limit"))
    hits = moved.join(limit, key).where("moved > limit").withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy(key).orderBy("t")))
    rhythm = hits.groupBy(key).agg(F.count("*").alias("changes"), F.coalesce(F.percentile("gap", 0.5), F.lit(4.0)).alias("rhythm_sec"))
    long = hits.join(rhythm, key).where("changes > 3 and gap > rhythm_sec * 1.5").groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("cadences"))
    out = limit.select(key).join(rhythm, key, "left").join(long, key, "left")
    return out.select(key, F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("rhythm_sec", F.lit(4.0)).alias("rhythm_sec"), F.coalesce("cadences", F.array().cast("array<double>")).alias("cadences"))


def unit(a: Column) -> Column:
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(n > 0, F.transform(a, lambda x: F.try_divide(x, n))).otherwise(a)


def curve_fit(points: DataFrame, key: str) -> DataFrame:
    """Best of exponential, linear and logarithmic for every curve (key, x, y): kind, b, a, c, r2.

    For a fixed b, y = a * g(bx) + c is linear in a and c, so least squares is an aggregate; b runs over a fixed
    log-spaced grid. Under 3 points or without spread the curve is constant, with r2 0. On equal r2 the order decides.
    """
    grid = [math.exp(math.log(0.01) + i * (math.log(50) - math.log(0.01)) / 59) for i in range(60)]
    kinds = F.concat(F.array(*(F.struct(F.lit("exponential").alias("kind"), F.lit(b).alias("b"), F.lit(0).alias("pref")) for b in grid)), F.array(F.struct(F.lit("linear").alias("kind"), F.lit(1.0).alias("b"), F.lit(1).alias("pref"))), F.array(*(F.struct(F.lit("logarithmic").alias("kind"), F.lit(b).alias("b"), F.lit(2).alias("pref")) for b in grid)))
    bx = F.col("g.b") * F.col("x")
    basis = F.when(F.col("g.kind") == "exponential", F.exp(-bx)).when(F.col("g.kind") == "linear", F.col("x")).otherwise(F.log1p(bx))
    each = points.select(key, "x", "y", F.explode(kinds).alias("g")).withColumn("u", basis)
    fit = each.groupBy(key, "g").agg(F.regr_slope("y", "u").alias("a"), F.regr_intercept("y", "u").alias("c"), F.regr_r2("y", "u").alias("r2"), F.count("*").alias("n"), F.var_pop("y").alias("v"), F.avg("y").alias("m"))
    flat = (F.col("n") < 3) | (F.col("v") <= 1e-12)
    best = fit.groupBy(key).agg(F.max_by(F.struct("g", "a", "c", "r2"), F.struct(F.round(F.coalesce("r2", F.lit(0.0)), 9), -F.col("g.pref"), -F.col("g.b"))).alias("f"), F.max(flat).alias("flat"), F.max("m").alias("m"))
    pick = lambda x, y: F.when(F.col("flat"), y).otherwise(x)
    return best.select(key, pick(F.col("f.g.kind"), F.lit("constant")).alias("kind"), pick(F.col("f.g.b"), F.lit(0.0)).alias("b"), pick(F.col("f.a"), F.lit(0.0)).alias("a"), pick(F.col("f.c"), F.col("m")).alias("c"), pick(F.col("f.r2"), F.lit(0.0)).alias("r2"))
