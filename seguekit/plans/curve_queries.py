"""Queries of parameter structs and curve libraries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seguekit.operators import spectra as SP
from seguekit.operators import training as T
from seguekit.plans import views as V
from seguekit.plans.registry import query
from seguekit.plans.spectra_queries import CONFLICT_SQL, epairs

r6 = lambda c: F.round(c, 6)


@query("F32_eq_params", "SELECT pair_id, CASE WHEN abs(energy_a - energy_b) / 12 < 0.3 THEN 'quick' WHEN abs(energy_a - energy_b) / 12 <= 0.7 THEN 'moderate' ELSE 'slow' END AS speed, round(abs(energy_a - energy_b) / 12, 6) AS ratio FROM v_pairs")
def f32(spark, d):
    ratio = F.abs(F.col("energy_a") - F.col("energy_b")) / 12
    eq = F.struct(F.when(ratio < 0.3, "quick").when(ratio <= 0.7, "moderate").otherwise("slow").alias("speed"), r6(ratio).alias("ratio"))
    return V.pairs(spark, d).select("pair_id", eq.alias("bass_swap")).select("pair_id", "bass_swap.speed", "bass_swap.ratio")


@query("F38_stem_advice", "WITH s AS (SELECT track_id, ['drums', 'bass', 'other', 'vocals'][CAST(bin // 16 + 1 AS INT)] AS stem, sqrt(avg(mag * mag)) AS rms FROM v_spectrum GROUP BY ALL) SELECT track_id, bool_or(stem = 'vocals' AND rms > 0.1) AS has_vocals, bool_or(stem = 'drums' AND rms > 0.1) AS has_drums, count(*) FILTER (WHERE rms > 0.1) AS stems FROM s GROUP BY track_id")
def f38(spark, d):
    stem = F.element_at(F.array(*map(F.lit, ("drums", "bass", "other", "vocals"))), (F.floor(F.col("bin") / 16) + 1).cast("int"))
    s = V.spectrum(spark, d).groupBy("track_id", stem.alias("stem")).agg(F.sqrt(F.avg(F.col("mag") ** 2)).alias("rms"))
    has = lambda n: F.bool_or((F.col("stem") == n) & (F.col("rms") > 0.1))
    return s.groupBy("track_id").agg(has("vocals").alias("has_vocals"), has("drums").alias("has_drums"), F.count_if(F.col("rms") > 0.1).alias("stems"))


@query("F40_fade_library", "SELECT pair_id, i, round(greatest(0, 1 - i / 10.0), 6) AS fast, round(pow(1 - i / 20.0, 2), 6) AS gentle, CASE WHEN i < 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS handoff FROM v_pairs, (SELECT CAST(unnest(range(21)) AS INT) AS i)")
def f40(spark, d):
    """Point tables of a fast fade, a gentle fade and a drum handoff at the middle bar."""
    i = F.col("i")
    c = V.pairs(spark, d).select("pair_id", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    return c.select("pair_id", "i", r6(F.greatest(F.lit(0.0), 1 - i / 10.0)).alias("fast"), r6((1 - i / 20.0) ** 2).alias("gentle"), F.when(i < 10, 1.0).otherwise(0.0).alias("handoff"))


_STAGES = ["hold", "linear", "exponential", "smooth", "aggressive", "moderate"]
STAGE_SQL = f"""sg AS (SELECT mix_id, row_number() OVER w - 1 AS stage, {_STAGES}[CAST((row_number() OVER w - 1) % 6 + 1 AS INT)] AS kind, quality_score AS v FROM v_transitions WINDOW w AS (PARTITION BY mix_id ORDER BY transition_id)),
    sb AS (SELECT *, lag(v) OVER (PARTITION BY mix_id ORDER BY stage) AS before, CAST(unnest(range(5)) AS INT) AS i FROM sg), sc AS (SELECT mix_id, stage, i, kind, v, coalesce(before, CASE kind WHEN 'smooth' THEN 0.0 ELSE 1.0 END) AS b, i / 4.0 AS t FROM sb)"""


@query(
    "F41_multi_stage_curve",
    f"""WITH {STAGE_SQL} SELECT mix_id, stage, i, greatest(0, least(1, CASE kind WHEN 'hold' THEN v WHEN 'linear' THEN b + (v - b) * t WHEN 'exponential' THEN b * exp(-3 * t) + v * (1 - exp(-3 * t)) WHEN 'smooth' THEN b + (v - b) * 0.5 * (1 - cos(pi() * t))
    WHEN 'aggressive' THEN b * pow(1 - t, 3) + v * (1 - pow(1 - t, 3)) ELSE 0.5 * (1 + cos(pi() * t)) * b + (1 - 0.5 * (1 + cos(pi() * t))) * v END)) AS gain FROM sc""",
)
def f41(spark, d):
    """A mix's transitions as stages of all six kinds in turn, towards their scores."""
    w = Window.partitionBy("mix_id").orderBy("transition_id")
    stage = F.row_number().over(w) - 1
    kind = F.element_at(F.array(*map(F.lit, _STAGES)), (stage % 6 + 1).cast("int"))
    s = V.transitions(spark, d).select("mix_id", stage.alias("stage"), kind.alias("kind"), F.col("quality_score").alias("end_value"))
    return multi_stage_curve(s, "mix_id", 5)


def multi_stage_curve(stages, key, points):
    """(key, stage, i, gain): points of stages (key, stage, kind, end_value), each from where the one before ends.

    The first begins at 1, or at 0 if it is smooth; a hold stands at its value; gains are cut to 0..1.
    """
    first = F.when(F.col("kind") == "smooth", 0.0).otherwise(1.0)
    s = stages.withColumn("b", F.coalesce(F.lag("end_value").over(Window.partitionBy(key).orderBy("stage")), first)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    t, b, v = F.col("i") / float(points - 1), F.col("b"), F.col("end_value")
    turn = lambda w: b * w + v * (1 - w)
    shapes = {"hold": v, "linear": turn(1 - t), "exponential": turn(F.exp(-3 * t)), "smooth": turn(0.5 * (1 + F.cos(F.pi() * t))), "aggressive": turn((1 - t) ** 3), "moderate": turn(0.5 * (1 + F.cos(F.pi() * t)))}
    gain = F.coalesce(*(F.when(F.col("kind") == k, c) for k, c in shapes.items()))
    return s.select(key, "stage", "i", F.greatest(F.lit(0.0), F.least(F.lit(1.0), gain)).alias("gain"))


@query(
    "F43_eq_plans",
    f"""WITH {CONFLICT_SQL}, t AS (SELECT pair_id, band, conflict, CASE WHEN a > 1.2 * b THEN 'A' WHEN b > 1.2 * a THEN 'B' ELSE 'shared' END AS owner, i, i / 10.0::DOUBLE AS t FROM cf, (SELECT CAST(unnest(range(11)) AS INT) AS i))
    SELECT pair_id, band, i, owner, CASE WHEN conflict < 0.2 THEN sqrt(1 - t) WHEN owner = 'A' THEN sqrt(1 - t * 0.8) WHEN owner = 'B' THEN sqrt((1 - t) * 0.5) ELSE sqrt(1 - t) * CASE WHEN abs(t - 0.5) <= 0.1 THEN 0.7 ELSE 1 END END AS gain_a,
    CASE WHEN conflict < 0.2 THEN sqrt(t) WHEN owner = 'A' THEN sqrt(t) * 0.5 WHEN owner = 'B' THEN least(1.2, sqrt(t * 1.2)) ELSE sqrt(t) * CASE WHEN abs(t - 0.5) <= 0.1 THEN 0.7 ELSE 1 END END AS gain_b FROM t""",
)
def f43(spark, d):
    """Curves of every band of every pair by its conflict and owner."""
    n = SP.band_negotiation(V.spectrum(spark, d), epairs(spark, d))
    return T.eq_plan(n.select("pair_id", "band", "conflict", "owner")).select("pair_id", "band", "i", "owner", "gain_a", "gain_b")