"""Similarity of the stems of two tracks, and plans of which to morph.

A stem plane is rows (key, stem, frame, bin, mag), frames and bins numbered from 0 without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Techniques that suit a stem, and weights of spectrum, rhythm, energy and harmony for drums and for other stems.
TECHNIQUES = {
    "drums": ("onset_replacement", "spectral_envelope", "multiband_crossfade"),
    "bass": ("chroma_modulation", "spectral_envelope", "cross_synthesis"),
    "vocals": ("spectral_envelope", "cross_synthesis"),
    "other": ("chroma_modulation", "spectral_envelope", "cross_synthesis"),
}
WEIGHTS = {True: (0.20, 0.45, 0.20, 0.15), False: (0.25, 0.15, 0.20, 0.40)}


def _positive_corr(a: str, b: str) -> Column:
    """0 where a side has no spread."""
    both = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)
    spread = F.stddev_pop(F.col(a) * both) * F.stddev_pop(F.col(b) * both)
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.covar_pop(a, b), spread), F.lit(0.0)))


def stem_similarity(plane: DataFrame, pairs: DataFrame, chroma_bins: int = 12) -> DataFrame:
    """(pair_id, stem, spectral, rhythmic, energy_ratio, harmonic, score, rank) of pairs (pair_id, a_id, b_id) over the frames both have.

    Spectral: the cosine of mean spectra. Rhythmic: 0.6 of the positive correlation of onsets (summed rises from frame to frame, as shares of
    their largest) and 0.4 of the likeness of their density over 0.3; 0.5 under four frames. Harmonic: the positive correlation of the first
    ``chroma_bins`` bins of the mean spectra; 0.5 for drums. A side without spread correlates 0.
    """
    key = ["pair_id", "stem"]
    rise = F.greatest(F.lit(0.0), F.col("mag") - F.lag("mag").over(Window.partitionBy("key", "stem", "bin").orderBy("frame")))
    rising = plane.withColumn("__rise", F.coalesce(rise, F.lit(0.0)))
    lengths = plane.groupBy("key", "stem").agg((F.max("frame") + 1).alias("n"))
    of = lambda x: lengths.select(F.col("key").alias(f"{x}_id"), "stem", F.col("n").alias(f"n{x}"))
    sized = pairs.join(of("a"), "a_id").join(of("b"), ["b_id", "stem"]).withColumn("n", F.least("na", "nb")).drop("na", "nb")
    one = lambda x: sized.join(rising.withColumnRenamed("key", f"{x}_id"), [f"{x}_id", "stem"]).where("frame < n")

    spectra = {x: one(x).groupBy(*key, "bin").agg(F.avg("mag").alias(f"m{x}"), F.sum(F.col("mag") ** 2).alias(f"e{x}")) for x in "ab"}
    both = spectra["a"].join(spectra["b"], [*key, "bin"])
    low = lambda c: F.when(F.col("bin") < chroma_bins, F.col(c))
    cosine = F.try_divide(F.sum(F.col("ma") * F.col("mb")), F.sqrt(F.sum(F.col("ma") ** 2)) * F.sqrt(F.sum(F.col("mb") ** 2)) + 1e-10)
    louder, softer = (f(F.sqrt(F.sum("ea")), F.sqrt(F.sum("eb"))) for f in (F.greatest, F.least))
    tone = both.withColumns({"la": low("ma"), "lb": low("mb")}).groupBy(*key).agg(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)).alias("spectral"), F.try_divide(softer, louder + 1e-10).alias("energy_ratio"), F.when(F.col("stem") == "drums", 0.5).otherwise(_positive_corr("la", "lb")).alias("harmonic")
    )

    onsets = {x: one(x).groupBy(*key, "frame").agg(F.sum("__rise").alias(f"o{x}"), F.first("n").alias(f"n{x}")) for x in "ab"}
    share = lambda x: F.col(f"o{x}") / (F.max(f"o{x}").over(Window.partitionBy(*key)) + 1e-10)
    beat = onsets["a"].join(onsets["b"], [*key, "frame"]).withColumns({"oa": share("a"), "ob": share("b")})
    density = F.abs(F.avg((F.col("oa") > 0.3).cast("double")) - F.avg((F.col("ob") > 0.3).cast("double")))
    pulse = beat.groupBy(*key).agg(F.when(F.max("na") < 4, 0.5).otherwise(0.6 * _positive_corr("oa", "ob") + 0.4 * (1 - density)).alias("rhythmic"))

    parts = ("spectral", "rhythmic", "energy_ratio", "harmonic")
    weighted = lambda drums: sum((w * F.col(c) for w, c in zip(WEIGHTS[drums], parts, strict=True)), F.lit(0.0))
    scored = tone.join(pulse, key).withColumn("score", F.when(F.col("stem") == "drums", weighted(True)).otherwise(weighted(False)))
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc(F.round("score", 9)), "stem"))
    return scored.select(*key, *parts, "score", rank.alias("rank"))


def morph_plans(ranked: DataFrame, depth: float = 0.8) -> DataFrame:
    """(pair_id, strategy, stem, depth, score, techniques) for every strategy: all stems, the best two (the second by half), drums, or a stem by its name."""
    stems = [F.lit(s) for s in TECHNIQUES]
    strategies = F.explode(F.concat(F.array(F.lit("all"), F.lit("best_match"), F.lit("drums_first")), F.array(*stems))).alias("strategy")
    taken = (F.col("strategy") == "all") | ((F.col("strategy") == "best_match") & (F.col("rank") <= 2)) | ((F.col("strategy") == "drums_first") & (F.col("stem") == "drums")) | (F.col("strategy") == F.col("stem"))
    halved = F.when((F.col("strategy") == "best_match") & (F.col("rank") == 2), depth * 0.5).otherwise(depth)
    suits = F.coalesce(*(F.when(F.col("stem") == s, F.array(*map(F.lit, t))) for s, t in TECHNIQUES.items()), F.array(F.lit("spectral_envelope")))
    return ranked.select("pair_id", "stem", "score", "rank", strategies).where(taken).select("pair_id", "strategy", "stem", halved.alias("depth"), "score", suits.alias("techniques"))
