"""Quality of a transition from its frames, and who gives vocals and bed. The weights, limits and bonuses are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of smoothness, clarity, harmony, balance and continuity.
PARTS = {"smoothness": 0.3, "clarity": 0.25, "harmony": 0.2, "balance": 0.15, "continuity": 0.1}
#: Shares of the bands in a balanced mix.
IDEAL = {"bass": 0.3, "mid": 0.4, "high": 0.3}


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _mean_of_bands(f) -> Column:
    return sum((f(b) for b in IDEAL), F.lit(0.0)) / len(IDEAL)


def mix_quality(frames: DataFrame, key: str = "track_id", order: str = "frame_idx") -> DataFrame:
    """(key, smoothness, clarity, harmony, balance, continuity, score) of frames (key, order, rms, bass, mid, high, contrast, clash, tension).

    Smoothness: squared change of the bands against their energy, and jumps of the level by over 0.1. Clarity: clash and contrast (dB
    against 40). Harmony: 1 - tension. Balance: bands' energies against the ideal. Continuity: changes over one standard
    deviation of the level, and how near it is to its mean of ten frames (five back, four ahead, zeros outside). One frame has
    no change: smooth and without large changes. Silence is in balance at a third each. One order of a key's frames serves all.
    """
    w, whole = Window.partitionBy(key).orderBy(order), Window.partitionBy(key)
    back = {b: F.pow(F.col(b) - F.lag(b).over(w), F.lit(2.0)) for b in IDEAL}
    f = frames.select("*", _mean_of_bands(lambda b: back[b]).alias("__flux"), F.abs(F.col("rms") - F.lag("rms").over(w)).alias("__step"), F.stddev_pop("rms").over(whole).alias("__sd"), (F.sum("rms").over(w.rowsBetween(-5, 4)) / 10).alias("__near"))
    share = lambda cond: F.coalesce(F.try_divide(F.sum(F.when(cond, 1).otherwise(0)).cast("double"), F.count("__step")), F.lit(0.0))
    e = f.groupBy(key).agg(
        F.coalesce(F.avg("__flux"), F.lit(0.0)).alias("flux"), F.avg(_mean_of_bands(lambda b: F.col(b) * F.col(b))).alias("energy"), (F.sum(F.when(F.col("__step") > 0.1, 1).otherwise(0)) / F.count("*")).alias("jumps"),
        F.avg("clash").alias("clash"), F.avg("contrast").alias("contrast"), F.avg("tension").alias("tension"), *(F.avg(F.col(b) * F.col(b)).alias(b) for b in IDEAL),
        share(F.round("__step", 9) > F.round("__sd", 9)).alias("large"), F.stddev_pop(F.col("rms") - F.col("__near")).alias("off"), F.avg("rms").alias("level"),
    )
    total = sum((F.col(b) for b in IDEAL), F.lit(0.0))
    astray = sum((F.abs(F.coalesce(F.try_divide(F.col(b), total), F.lit(0.33)) - ideal) for b, ideal in IDEAL.items()), F.lit(0.0))
    parts = {
        "smoothness": 0.7 * (1 - F.least(F.lit(1.0), F.col("flux") / (F.col("energy") + 1e-10))) + 0.3 * F.greatest(F.lit(0.0), 1 - 10 * F.col("jumps")),
        "clarity": 0.6 * (1 - F.col("clash")) + 0.4 * _clip(F.col("contrast") / 40),
        "harmony": 1 - F.col("tension"),
        "balance": _clip(1 - astray / 3),
        "continuity": 0.6 * F.greatest(F.lit(0.0), 1 - 5 * F.col("large")) + 0.4 * _clip(1 - F.col("off") / (F.col("level") + 1e-10)),
    }
    out = e.select(key, *(v.alias(k) for k, v in parts.items()))
    return out.withColumn("score", sum((F.col(k) * x for k, x in PARTS.items()), F.lit(0.0)))


def role_plan(pairs: DataFrame, key: str = "pair_id", max_pct: float = 0.06) -> DataFrame:
    """(key, bed, vocal, tempo, score) of pairs (vocals_x, content_x, drums_x, drum_energy_x and tempo_x for x in a, b; clash, safe_points, phrases).

    Up to four plans of (bed, vocals) are scored; of equal scores (nine digits) the first stays. Without vocals the quieter drums are
    the bed, if both have drums; else there is no plan and all columns are null. Safe points and phrases are those of b's vocals.
    """
    c = F.col
    in_reach = F.abs(c("tempo_a") - c("tempo_b")) <= max_pct * F.greatest("tempo_a", "tempo_b")
    phrases = F.least(c("safe_points") * 0.02, F.lit(0.2)) + F.least(c("phrases") * 0.01, F.lit(0.1))

    def plan(k: int, bed: str, vocal: str) -> Column:
        score = F.lit(0.15 if bed == "a" else 0.05) + F.when(c(f"content_{vocal}"), 0.25 if vocal == "b" else 0.15).otherwise(0.0)
        if bed != vocal:
            score = score - 0.3 * c("clash")
        score = score + F.when(in_reach, 0.2).otherwise(-0.2)
        if vocal == "b":
            score = score + phrases
        return F.when(c(f"vocals_{vocal}"), F.struct(F.round(score, 9).alias("score"), F.lit(-k).alias("k"), F.lit(bed).alias("bed"), F.lit(vocal).alias("vocal"), F.lit(vocal).alias("tempo")))

    plans = F.array(*(plan(k, bed, vocal) for k, (bed, vocal) in enumerate([("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")])))
    quiet = F.when(c("drum_energy_a") <= c("drum_energy_b"), "a").otherwise("b")
    drums = F.when(c("drums_a") & c("drums_b"), F.struct(F.lit(None).cast("double").alias("score"), F.lit(0).alias("k"), quiet.alias("bed"), quiet.alias("vocal"), F.lit("a").alias("tempo")))
    best = F.when(c("vocals_a") | c("vocals_b"), F.array_max(F.filter(plans, lambda p: p.isNotNull()))).otherwise(drums)
    return pairs.select(key, best.alias("b")).select(key, "b.bed", "b.vocal", "b.tempo", "b.score")
