"""Technique dimensions and the operators that use them."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seguekit.operators.ranks import bucketed_rank

from seguekit.functions.scoring import energy_direction, queue_score

#: Technique, bars, energy direction, harmonic requirement, preferred sections.
TECHNIQUES = [
    ("long_blend", 32, "maintain", "compatible", ["verse", "chorus"]),
    ("quick_cut", 4, "up", "any", ["drop", "chorus"]),
    ("bass_swap", 16, "maintain", "any", ["verse", "chorus"]),
    ("filter_sweep", 16, "down", "any", ["outro", "breakdown"]),
    ("echo_out", 8, "down", "any", ["outro", "verse"]),
    ("drop_mix", 8, "down", "compatible", ["chorus", "breakdown"]),
    ("staggered_stem_mix", 16, "maintain", "any", ["verse", "chorus", "breakdown"]),
    ("partial_stem_separation", 24, "maintain", "any", ["verse", "chorus", "breakdown"]),
    ("vocal_layering", 20, "maintain", "compatible", ["verse", "chorus"]),
    ("phrase_match", 24, "maintain", "compatible", ["verse", "chorus", "breakdown"]),
    ("backspin", 8, "down", "any", ["outro", "chorus", "drop"]),
    ("double_drop", 12, "up", "compatible", ["drop", "chorus"]),
    ("acapella_overlay", 20, "maintain", "compatible", ["verse", "chorus"]),
    ("modulation", 24, "maintain", "compatible", ["verse", "chorus", "breakdown"]),
    ("energy_build", 20, "up", "any", ["verse", "breakdown", "build"]),
    ("loop_transition", 16, "maintain", "any", ["verse", "chorus", "breakdown"]),
    ("breakdown_to_build", 20, "up", "compatible", ["breakdown", "build"]),
    ("drop_on_the_one", 2, "up", "any", ["drop", "chorus"]),
    ("back_and_forth", 24, "maintain", "compatible", ["verse", "chorus"]),
    ("drum_roll", 8, "up", "any", ["build", "drop", "chorus"]),
    ("thematic_handoff", 24, "maintain", "compatible", ["verse", "chorus", "breakdown"]),
    ("washout", 12, "down", "any", ["outro", "chorus", "verse"]),
]
#: Technique, category, energy change, complexity, boldness, compatible with, incompatible with.
PROFILES = [
    ("long_blend", "crossfade", "stable", 0.3, 0.2, ["bass_swap", "filter_sweep", "echo_out"], ["quick_cut", "backspin"]),
    ("quick_cut", "cut", "sudden", 0.2, 0.8, ["double_drop"], ["long_blend", "echo_out", "filter_sweep"]),
    ("bass_swap", "frequency", "stable", 0.5, 0.4, ["long_blend", "filter_sweep", "staggered_stem_mix"], ["quick_cut"]),
    ("filter_sweep", "frequency", "building", 0.4, 0.5, ["long_blend", "bass_swap", "energy_build"], ["quick_cut"]),
    ("echo_out", "effect", "fading", 0.4, 0.6, ["long_blend", "drop_mix"], ["quick_cut", "double_drop"]),
    ("drop_mix", "energy", "dip_then_build", 0.6, 0.7, ["energy_build", "double_drop"], ["long_blend"]),
    ("staggered_stem_mix", "stem", "gradual", 0.7, 0.4, ["bass_swap", "vocal_layering"], ["quick_cut"]),
    ("vocal_layering", "stem", "gradual", 0.6, 0.5, ["staggered_stem_mix", "long_blend"], ["quick_cut"]),
    ("energy_build", "energy", "building", 0.5, 0.6, ["filter_sweep", "drop_mix"], ["echo_out"]),
    ("double_drop", "energy", "peak", 0.5, 0.9, ["drop_mix", "quick_cut"], ["long_blend", "echo_out"]),
    ("phrase_match", "timing", "stable", 0.3, 0.3, ["long_blend", "bass_swap", "staggered_stem_mix"], []),
    ("backspin", "effect", "dramatic", 0.4, 0.8, ["quick_cut", "drop_mix"], ["long_blend", "filter_sweep"]),
    ("loop_transition", "timing", "stable", 0.5, 0.3, ["long_blend", "bass_swap", "phrase_match"], ["quick_cut", "backspin"]),
    ("drop_on_the_one", "cut", "sudden", 0.2, 0.8, ["quick_cut", "double_drop"], ["long_blend", "echo_out"]),
    ("back_and_forth", "timing", "stable", 0.6, 0.5, ["long_blend", "phrase_match", "vocal_layering"], ["quick_cut"]),
    ("drum_roll", "energy", "building", 0.5, 0.7, ["filter_sweep", "quick_cut", "drop_mix"], ["long_blend"]),
    ("thematic_handoff", "timing", "stable", 0.3, 0.3, ["phrase_match", "long_blend", "vocal_layering"], []),
]
#: How two energy changes go together, in either order; 0.5 for other pairs.
ENERGY_FIT = {
    ("stable", "stable"): 0.9, ("stable", "gradual"): 0.8, ("gradual", "gradual"): 0.9, ("building", "peak"): 0.9, ("dip_then_build", "peak"): 0.8,
    ("fading", "stable"): 0.7, ("fading", "building"): 0.5, ("sudden", "stable"): 0.4, ("dramatic", "building"): 0.6,
}
#: Hybrid presets, their techniques and weights.
PRESETS = {
    "cinematic_blend": [("filter_sweep", 0.4), ("echo_out", 0.3), ("long_blend", 0.3)],
    "festival_drop": [("energy_build", 0.3), ("drop_mix", 0.3), ("double_drop", 0.4)],
    "smooth_operator": [("bass_swap", 0.35), ("staggered_stem_mix", 0.35), ("phrase_match", 0.3)],
    "creative_chaos": [("backspin", 0.3), ("filter_sweep", 0.4), ("quick_cut", 0.3)],
    "deep_immersion": [("long_blend", 0.35), ("vocal_layering", 0.35), ("bass_swap", 0.3)],
}

TECHNIQUES_SQL = "tech(idx, name, bars, energy, harmony, structure) AS (VALUES " + ", ".join(str((i, *t)) for i, t in enumerate(TECHNIQUES)) + ")"
PROFILES_SQL = "prof(name, category, change, complexity, boldness, likes, dislikes) AS (VALUES " + ", ".join(str(p).replace("[]", "[]::VARCHAR[]") for p in PROFILES) + ")"


def techniques(spark) -> DataFrame:
    rows = [(i, *t) for i, t in enumerate(TECHNIQUES)]
    return spark.createDataFrame(rows, "idx int, technique string, bars int, t_energy string, t_harmony string, structure array<string>")


def profiles(spark) -> DataFrame:
    return spark.createDataFrame(PROFILES, "technique string, category string, change string, complexity double, boldness double, likes array<string>, dislikes array<string>")


def technique_scores(contexts: DataFrame) -> DataFrame:
    """Every context against the 22 techniques; additive rules."""
    t = contexts.crossJoin(F.broadcast(techniques(contexts.sparkSession)))  # 22 rows
    fit, clash, vocal, diff = F.col("keys_fit"), F.col("clash"), F.col("vocal"), F.col("energy_diff")
    direction = energy_direction(F.lit(0.0), diff)
    a, b = F.col("section_a"), F.col("section_b")
    name = F.col("technique")
    mixed = ("verse", "chorus", "breakdown")

    def when(condition: Column, points: float) -> Column:
        return F.when(condition, points).otherwise(0.0)

    rules = [
        F.when((F.col("t_harmony") == "compatible") & fit, 0.3).when(F.col("t_harmony") == "any", 0.2).otherwise(0.0),
        when((F.col("t_energy") == direction) | ((F.col("t_energy") == "maintain") & (F.abs(diff) < 0.2)), 0.3),
        when(F.array_contains("structure", a) | F.array_contains("structure", b), 0.2),
        when((name == "bass_swap") & (clash > 0.5), 0.3),
        when((name == "long_blend") & (clash < 0.3), 0.2),
        when((name == "staggered_stem_mix") & (vocal > 0.6), 0.4),
        when((name == "vocal_layering") & (vocal > 0.6), 0.3),
        when((name == "partial_stem_separation") & (vocal > 0.6), 0.2),
        when(name.isin("vocal_layering", "acapella_overlay") & fit & (vocal > 0.4) & (vocal < 0.8), 0.3),
        when((name == "phrase_match") & fit, 0.3),
        when((name == "double_drop") & (direction == "up") & b.isin("drop", "chorus"), 0.4),
        when((name == "backspin") & (direction == "down") & a.isin("outro", "chorus"), 0.3),
        when((name == "modulation") & fit, 0.2),
        when((name == "energy_build") & (direction == "up"), 0.3),
        when((name == "breakdown_to_build") & (a == "breakdown") & (b == "build"), 0.4),
        when((name == "loop_transition") & (direction == "maintain") & (a.isin(*mixed) | b.isin(*mixed)), 0.25),
        when((name == "loop_transition") & (direction == "maintain") & clash.between(0.3, 0.6), 0.15),
        when((name == "drop_on_the_one") & (direction == "up") & b.isin("drop", "chorus"), 0.35),
        when((name == "back_and_forth") & (direction == "maintain") & fit & a.isin("verse", "chorus") & b.isin("verse", "chorus"), 0.3),
        when((name == "drum_roll") & (direction == "up") & b.isin("build", "drop", "chorus"), 0.3),
        when((name == "washout") & (direction == "down"), 0.4),
        when((name == "washout") & a.isin("outro", "chorus"), 0.2),
    ]
    return t.withColumn("score", reduce(lambda x, y: x + y, rules))


def technique_shortlist(scores: DataFrame) -> DataFrame:
    """The top 3 of each context, 2 if the first leads by over 0.4, with weights and seconds."""
    w = Window.partitionBy("pair_id").orderBy(F.desc(F.round("score", 9)), "idx")
    ranked = scores.withColumn("rank", F.row_number().over(w)).withColumn("__gap", F.round("score", 9) - F.lead(F.round("score", 9)).over(w))
    every = Window.partitionBy("pair_id")
    lead = F.max(F.when(F.col("rank") == 1, F.col("__gap"))).over(every)
    top = ranked.withColumn("__lead", lead).where(F.col("rank") <= F.when(F.col("__lead") > 0.4, 2).otherwise(3))
    points = F.greatest(F.lit(0.01), F.col("score"))
    return top.withColumn("weight", points / F.sum(points).over(every)).withColumn("duration_sec", F.col("bars") * 4 * 60 / F.col("tempo")).drop("__gap", "__lead")


def weighted_draw(options: DataFrame, key: str, option: str, seed: int) -> DataFrame:
    """One option per key, drawn by weight: the least -ln(u) / weight, with u from a hash, so any partitioning agrees."""
    u = (F.conv(F.left(seeded_hash(seed, F.col(key), F.col(option)), F.lit(10)), 16, 10).cast("long") + 0.5) / float(1 << 40)
    return options.groupBy(key).agg(F.min_by(option, F.struct(-F.log(u) / F.col("weight"), F.col(option))).alias(option))


def best_next(candidates: DataFrame, most: int = 5) -> DataFrame:
    """Of the first ``most`` candidates (by i) the best score plus a bonus for standing early."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    score = queue_score(*(F.col(f"{c}_{x}") for c in ("bpm", "camelot", "energy") for x in "ab")) + (1 - F.col("i") / n) * 0.1
    scored = candidates.withColumn("score", F.round(score, 9)).where(F.col("i") < most)
    return scored.groupBy("query_id").agg(F.max_by("song_id", F.struct("score", -F.col("i"))).alias("next_id"), F.max("score").alias("score"))


def _queue_score(a, b) -> float:
    tempo = max(0.0, 1 - abs(a.bpm - b.bpm) / (a.bpm * 0.08))
    na, nb, la, lb = int(a.camelot[:-1]), int(b.camelot[:-1]), a.camelot[-1], b.camelot[-1]
    key = 1.0 if a.camelot == b.camelot else 0.8 if abs(na - nb) % 12 == 1 and la == lb else 0.6 if na == nb else 0.2
    return tempo * 0.4 + key * 0.4 + (1 - abs(a.energy - b.energy)) * 0.2


def order_playlists(songs: DataFrame, most: int = 5) -> DataFrame:
    """(playlist, position, song_id): greedy order from the first song on. Sequential in a playlist, parallel over playlists."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = list(pdf.sort_values("song_id").itertuples(index=False))
        order = [rest.pop(0)]
        while rest:
            n = len(rest)
            best = max(range(min(most, n)), key=lambda i: (_queue_score(order[-1], rest[i]) + (1 - i / n) * 0.1, -i))
            order.append(rest.pop(best))
        return pd.DataFrame({"playlist": [s.playlist for s in order], "position": range(len(order)), "song_id": [s.song_id for s in order]})

    return songs.select("playlist", "song_id", "bpm", "camelot", "energy").groupBy("playlist").applyInPandas(run, "playlist string, position int, song_id long")


def merge_sources(sources: list[DataFrame], defaults: dict) -> DataFrame:
    """Union by name with defaults for what a source lacks, and ids name_NN by source."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    ranked = bucketed_rank(both, ["source"], F.floor(F.col("k") / 100_000), ["k"], "__n")
    n = F.col("__n").cast("string")
    padded = F.when(F.length(n) < 2, F.concat(F.lit("0"), n)).otherwise(n)
    return ranked.na.fill(defaults).withColumn("id", F.concat_ws("_", F.replace(F.lower("source"), F.lit(" "), F.lit("_")), padded)).drop("__n")


def stratified_split(df: DataFrame, key: str, stratum: str, seed: int, cuts: tuple[float, float] = (0.7, 0.85)) -> DataFrame:
    """train / val / test with exact shares in every stratum, by the rank of a seeded hash."""
    drawn = df.withColumn("__h", seeded_hash(seed, F.col(key)))
    ranked = bucketed_rank(drawn, [stratum], F.left("__h", F.lit(3)), ["__h", key], "__r")
    n = df.groupBy(F.col(stratum).alias("__s")).agg(F.count("*").alias("__n"))
    share = (F.col("__r") - 1) / F.col("__n")
    split = F.when(share < cuts[0], "train").when(share < cuts[1], "val").otherwise("test")
    return ranked.join(n, F.equal_null(F.col(stratum), F.col("__s"))).withColumn("split", split).select(*df.columns, "split")


def seeded_hash(seed: int, *keys: Column) -> Column:
    """Hex digits that only depend on the seed and the keys; SHA-256, so other engines can check them."""
    return F.sha2(F.concat_ws("-", F.lit(str(seed)), *keys), 256)


def technique_pairs(spark) -> DataFrame:
    """(tech_a, tech_b, score): directed compatibility of the 17 profiles."""
    p = profiles(spark)
    a = p.select(*(F.col(c).alias(f"{c}_a") for c in p.columns))
    b = p.select(*(F.col(c).alias(f"{c}_b") for c in p.columns))
    both = a.crossJoin(F.broadcast(b))  # 17 x 17
    fit = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for (m, n), v in ENERGY_FIT.items() for pair in {(m, n), (n, m)} for x in (f"{pair[0]}|{pair[1]}", v))), F.concat_ws("|", "change_a", "change_b")), F.lit(0.5))
    score = 0.3 * F.when(F.col("category_a") == F.col("category_b"), 1.0).otherwise(0.5) + 0.4 * fit + 0.3 * (1 - F.abs(F.col("complexity_a") - F.col("complexity_b")))
    score = F.when(F.array_contains("dislikes_a", F.col("technique_b")), 0.0).when(F.array_contains("likes_a", F.col("technique_b")), 0.9).otherwise(score)
    return both.select(F.col("technique_a").alias("tech_a"), F.col("technique_b").alias("tech_b"), score.alias("score"))


def hybrids(members: DataFrame, keys: list[str]) -> DataFrame:
    """keys -> fit (mean score of all ordered pairs), complexity and boldness (weighted means) of the techniques of each hybrid.

    ``members``: keys, i (place), technique, weight. Hybrids are small by definition.
    """
    spark = members.sparkSession
    a, b = (members.select(*keys, F.col("i").alias(f"i_{x}"), F.col("technique").alias(f"tech_{x}")) for x in "ab")
    fit = a.join(b, keys).where("i_a < i_b").join(F.broadcast(technique_pairs(spark)), ["tech_a", "tech_b"]).groupBy(*keys).agg(F.avg("score").alias("fit"))  # 17 x 17 pairs
    mean = lambda c: (F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias(c)
    own = members.join(F.broadcast(profiles(spark)), "technique").groupBy(*keys).agg(mean("complexity"), mean("boldness"))  # 17 profiles
    return fit.join(own, keys)
