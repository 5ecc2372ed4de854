"""Candidate points of tracks, their pairs, and the choice of the best pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seguekit.functions import harmony as H


def candidate_frames(frames: DataFrame, every: int = 4) -> DataFrame:
    """Every fourth frame of a track with energy, trend, gap flag, length and vocal presence, all in one window pass.

    ``centroid`` and ``bandwidth`` are means over 8 frames (2 s) either side, ``singing`` is that of ``vocal`` over 12 (3 s).
    """
    w = Window.partitionBy("track_id").orderBy("frame_idx")
    whole = Window.partitionBy("track_id")
    before, after = F.avg("rms").over(w.rowsBetween(-8, -1)), F.avg("rms").over(w.rowsBetween(0, 7))
    edge = (F.row_number().over(w) <= 8) | (F.row_number().over(w) > F.count("*").over(whole) - 7)
    trend = F.when(edge, "stable").when(after > before * 1.2, "rising").when(after < before * 0.6, "dip").when(after < before * 0.8, "falling").otherwise("stable")
    gap = (F.col("rms") == F.min("rms").over(w.rowsBetween(-2, 2))) & (F.min("rms").over(w.rowsBetween(-2, -1)) > F.col("rms"))
    c = frames.select("track_id", "frame_idx", F.col("t_sec").alias("t"), F.col("rms").alias("energy"), trend.alias("trend"), F.coalesce(gap, F.lit(False)).alias("gap"), F.max("t_sec").over(whole).alias("duration"), "vocal", F.avg("centroid").over(w.rowsBetween(-8, 8)).alias("centroid"), F.avg("bandwidth").over(w.rowsBetween(-8, 8)).alias("bandwidth"), F.avg("vocal").over(w.rowsBetween(-12, 12)).alias("singing"))
    return c.where(F.col("frame_idx") % every == 0)


AROUND = ("centroid", "bandwidth", "singing")


def label(t: Column, duration: Column, energy: Column, out: bool) -> Column:
    """Section guess by position, then by energy."""
    if out:
        return F.when(t > duration * 0.85, "outro").when(t > duration * 0.7, "breakdown").when(energy < 0.3, "breakdown").otherwise("verse")
    early = F.when(energy > 0.7, "build").otherwise("intro")
    return F.when(t < duration * 0.15, "intro").when(t < duration * 0.3, early).when(energy > 0.75, "drop").when(energy < 0.4, "breakdown").otherwise("verse")


def point_score(c: dict[str, Column], out: bool) -> Column:
    """Additive rules: leaving wants few vocals, gaps and late places; entering wants intros, builds and rising energy."""
    plus = lambda cond, x: F.when(cond, x).otherwise(0.0)
    if out:
        late, place = c["t"] >= c["duration"] * 0.55, F.try_divide(c["t"], c["duration"])
        s = 0.6 + F.when(c["vocal"] > 0.45, -0.25).when(c["vocal"] > 0.35, -0.15).otherwise(0.05)
        s = s + F.when(late & c["gap"] & (c["energy"] > 0.05), 0.25).when(late & c["label"].isin("outro", "breakdown"), 0.15).otherwise(0.0)
        s = s + plus(c["trend"].isin("falling", "dip", "stable"), 0.1) + F.when((place > 0.45) & (place < 0.9), place * 0.2).otherwise(0.0)
    else:
        s = 0.6 + plus(c["label"].isin("intro", "build", "drop", "chorus"), 0.3) + plus(c["trend"] == "rising", 0.2)
        s = s + plus((c["energy"] > 0.3) & (c["energy"] < 0.8), 0.2) + plus(c["label"].isin("intro", "build", "drop"), 0.1)
    return F.least(F.lit(1.0), s)


def candidate_points(frames: DataFrame, out: bool, keep: int = 30) -> DataFrame:
    """(track_id, frame_idx, t, energy, trend, label, score, rank): the best points over 0.3 within the search range."""
    c = candidate_frames(frames)
    c = c.where((F.col("t") >= F.col("duration") * (0.3 if out else 0.0)) & (F.col("t") <= F.col("duration") * 0.95) & (F.col("energy") >= 0.04))
    c = c.withColumn("label", label(F.col("t"), F.col("duration"), F.col("energy"), out))
    c = c.withColumn("score", F.round(point_score({n: F.col(n) for n in c.columns}, out), 9)).where("score > 0.3")
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("score"), "frame_idx"))
    return c.withColumn("rank", rank).where(F.col("rank") <= keep).select("track_id", "frame_idx", "t", "energy", "trend", "label", "score", "rank", *AROUND)


def candidate_pairs(pairs: DataFrame, outs: DataFrame, ins: DataFrame, top: int = 10) -> DataFrame:
    """At most top x top point pairs of each track pair (pair_id, a_id, b_id)."""
    side = lambda df, x: df.where(F.col("rank") <= top).select(F.col("track_id").alias(f"{x}_id"), *(F.col(c).alias(f"{c}_{x}") for c in ("t", "energy", "trend", "label", "score", "rank", *AROUND)))
    return pairs.join(side(outs, "a"), "a_id").join(side(ins, "b"), "b_id")


def basic_score(df: DataFrame) -> Column:
    """Tempo, key, trend, structure and the points' own scores."""
    d = F.abs(F.col("bpm_a") - F.col("bpm_b"))
    s = F.when(d < 2, 0.4).when(d < 5, 0.3).when(d < 10, 0.1).otherwise(0.0) + F.when(H.pitch_compatible(F.col("key_a"), F.col("key_b")), 0.2).otherwise(0.0)
    s = s + F.when(F.col("trend_a").isin("falling", "dip") & (F.col("trend_b") == "rising"), 0.2).when(F.col("trend_a").isin("falling", "stable") & (F.col("trend_b") != "falling"), 0.1).otherwise(0.0)
    s = s + F.when(F.col("label_a").isin("outro", "breakdown") & F.col("label_b").isin("intro", "build"), 0.2).otherwise(0.0)
    return s + 0.1 + (F.col("score_a") + F.col("score_b")) * 0.2


#: Weights of the quality factors; risks count inverted.
WEIGHTS = {"harmonic": 0.20, "energy": 0.15, "structure": 0.15, "tempo": 0.20, "spectral_risk": 0.15, "vocal_risk": 0.10, "beat": 0.05}


def quality(factors: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, w in WEIGHTS.items():
        total = total + (1 - factors[name] if name.endswith("risk") else factors[name]) * w
    return total


def harmonic_factor(a: Column, b: Column) -> Column:
    d = F.abs(H.root(a) - H.root(b))
    return F.when(a.isNull() | b.isNull(), 0.7).when(H.pitch_compatible(a, b), 1.0).otherwise(F.greatest(F.lit(0.3), 1 - F.least(d, 12 - d) / 6))


#: Sections that follow one another best.
IDEAL = (("outro", "intro"), ("outro", "build"), ("breakdown", "intro"), ("breakdown", "build"), ("verse", "verse"), ("verse", "intro"))


def quality_factors() -> dict[str, Column]:
    """The seven factors of a point pair, from the columns of ``candidate_pairs``. Candidates stand on beats."""
    c = lambda n: (F.col(f"{n}_a"), F.col(f"{n}_b"))
    (ta, tb), (la, lb), (ca, cb), (wa, wb), (sa, sb) = map(c, ("trend", "label", "centroid", "bandwidth", "singing"))
    energy = F.when(ta.isin("falling", "dip") & (tb == "rising"), 1.0).when(ta.isin("falling", "stable") & (tb != "falling"), 0.8).when((ta == "stable") & (tb == "stable"), 0.6).otherwise(0.4)
    ideal = F.concat_ws(">", la, lb).isin(*(">".join(x) for x in IDEAL))
    structure = F.when(ideal, 1.0).when((la == "outro") & lb.isin("intro", "verse") | la.isin("breakdown", "verse") & (lb == "intro"), 0.8).otherwise(0.6)
    off = F.abs(F.col("bpm_a") - F.col("bpm_b"))
    tempo = F.when(off < 1, 1.0).when(off < 2, 0.9).when(off < 5, 0.8).when(off < 10, 0.6).otherwise(0.3)
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    clash = unit((1 - F.abs(ca - cb) / (ca + cb + 1e-10) * 0.5) * F.least(wa, wb) / (F.greatest(wa, wb) + 1e-10))
    return {"harmonic": harmonic_factor(F.col("key_a"), F.col("key_b")), "energy": energy, "structure": structure, "tempo": tempo, "spectral_risk": clash, "vocal_risk": unit(sa * sb), "beat": F.lit(1.0)}


def best_pair(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """The best point pair of each track pair by 0.6 quality + 0.4 basic; a safe default where there is none."""
    best = scored.groupBy("pair_id").agg(F.max_by(F.struct("t_a", "t_b", "total"), F.struct("total", -F.col("rank_a"), -F.col("rank_b"))).alias("b"))
    out = pairs.select("pair_id").join(best, "pair_id", "left")
    return out.select("pair_id", F.coalesce("b.t_a", F.lit(0.0)).alias("t_a"), F.coalesce("b.t_b", F.lit(0.0)).alias("t_b"), F.coalesce("b.total", F.lit(0.5)).alias("total"), F.col("b").isNull().alias("fallback"))
