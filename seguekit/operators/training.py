"""Inputs, targets and quality labels of training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seguekit.functions.scoring import parse_tempo, truthy

#: Default of each input where a sample lacks it.
DEFAULTS = {"tempo_outgoing": 120.0, "tempo_incoming": 120.0, "energy_before": 0.5, "energy_after": 0.5, "harmonic_tension": 0.1, "spectral_smoothness": 0.8, "frequency_masking": 0.1, "energy_during": 0.5}
#: Class of each technique, and the places of the keys.
TECHNIQUES = {"cut": 0, "blend": 1, "linear": 1, "drop": 2}
KEYS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def feature_vector(df: DataFrame) -> Column:
    """Array of the 13 normalised inputs; columns that ``df`` lacks and nulls take their defaults."""

    def x(name: str) -> Column:
        if name not in df.columns:
            return F.lit(DEFAULTS[name])
        own = parse_tempo(F.col(name).cast("string")) if name.startswith("tempo") else F.col(name).cast("double")
        return F.coalesce(own, F.lit(DEFAULTS[name]))

    flag = lambda name: F.when(F.coalesce(F.col(name), F.lit(False)), 1.0).otherwise(0.0) if name in df.columns else F.lit(0.0)
    a, b = (x("tempo_outgoing") - 60) / 120, (x("tempo_incoming") - 60) / 120
    return F.array(
        a, b, x("energy_before"), x("energy_after"), flag("key_compatible"), x("harmonic_tension"), x("spectral_smoothness"), x("frequency_masking"),
        F.abs(x("energy_after") - x("energy_before")), F.abs(a - b), x("energy_during"), flag("energy_build"), flag("energy_dip"),
    )


def key_place(key: Column) -> Column:
    """0 to 11; 0 for unknown keys."""
    return F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, KEYS)), key), F.lit(1)).cast("int") - 1, F.lit(0))


def target_labels() -> dict[str, Column]:
    """technique (class), three flags and duration in bars (5 if unknown)."""
    technique = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in TECHNIQUES.items() for x in pair)), F.col("crossfade_type")), F.lit(0))
    flags = {"bass_swap": "bass_swap_detected", "low_cut": "low_cut_on_incoming", "high_cut": "high_cut_on_outgoing"}
    return {"technique": technique} | {n: F.coalesce(truthy(F.col(c).cast("string")), F.lit(False)) for n, c in flags.items()} | {"duration": F.coalesce(F.col("bars_duration").cast("double"), F.lit(5.0))}


def quality_labels() -> dict[str, Column | dict[str, Column]]:
    """overall and failure_modes from beat_match, harmonic_clash, vocal_clash, energy_flow, spectral_balance and energy_delta."""
    beat, harmonic, vocal, flow, balance = map(F.col, ("beat_match", "harmonic_clash", "vocal_clash", "energy_flow", "spectral_balance"))
    overall = beat * 0.3 + (1 - harmonic) * 0.2 + (1 - vocal) * 0.2 + flow * 0.15 + balance * 0.15
    modes = {"beat_mismatch": beat < 0.7, "harmonic_clash": harmonic > 0.3, "vocal_overlap": vocal > 0.5, "energy_drop": F.col("energy_delta") < -0.3, "spectral_mud": balance < 0.6}
    return {"overall": overall, "failure_modes": modes}


# --- curves of plans ----------------------------------------------------------------------------------------------


def equal_power(plans: DataFrame) -> DataFrame:
    """``plans`` (shape, points, ...) with i, out_gain and in_gain of every point; shapes linear, smooth and fast."""
    p = plans.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("points") - 1)))
    t = F.when(F.col("points") > 1, F.col("i") / (F.col("points") - 1)).otherwise(0.0)
    wave = F.cos(F.pi() * t)
    out = F.when(F.col("shape") == "linear", F.sqrt(1 - t)).when(F.col("shape") == "fast", (1 - t) * (1 - t)).otherwise(F.sqrt(0.5 * (1 + wave)))
    into = F.when(F.col("shape") == "linear", F.sqrt(t)).when(F.col("shape") == "fast", F.sqrt(F.greatest(F.lit(0.0), 1 - (1 - t) ** 4))).otherwise(F.sqrt(0.5 * (1 - wave)))
    return p.withColumns({"out_gain": out, "in_gain": into})


def bass_swap(plans: DataFrame, points: int) -> DataFrame:
    """``plans`` (swap: where in the transition, ...) with i, bass_a (never under 0.1), bass_b and the high-pass of a in Hz."""
    t, s = F.col("i") / float(points - 1), F.col("swap")
    before = t < s
    a = F.greatest(F.lit(0.1), F.when(before, 1 - t / s * 0.5).otherwise(0.5 * (1 - (t - s) / (1 - s))))
    b = F.when(before, 0.3 + 0.2 * t / s).otherwise(0.5 + 0.5 * (t - s) / (1 - s))
    return plans.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumns({"bass_a": a, "bass_b": b, "high_pass": 200 * t}).drop("swap")


def eq_plan(conflicts: DataFrame, points: int = 11, dip: float = 0.7) -> DataFrame:
    """``conflicts`` (conflict, owner, ...) with i, gain_a and gain_b of every point of both curves.

    Under a conflict of 0.2 both cross at equal power; the owner of a band fades later than the other; where no one owns it
    both dip around the middle.
    """
    t = F.col("i") / float(points - 1)
    middle = F.when(F.abs(t - 0.5) <= 0.1, dip).otherwise(1.0)
    calm, own = F.col("conflict") < 0.2, F.col("owner")
    a = F.when(calm, F.sqrt(1 - t)).when(own == "A", F.sqrt(1 - t * 0.8)).when(own == "B", F.sqrt((1 - t) * 0.5)).otherwise(F.sqrt(1 - t) * middle)
    b = F.when(calm, F.sqrt(t)).when(own == "A", F.sqrt(t) * 0.5).when(own == "B", F.least(F.lit(1.2), F.sqrt(t * 1.2))).otherwise(F.sqrt(t) * middle)
    return conflicts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumns({"gain_a": a, "gain_b": b})
