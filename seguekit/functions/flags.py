"""Classification of transitions: crossfade type, techniques, tags and effectiveness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crossfade_type(gains_a: Column, seconds: Column) -> Column:
    """By length, the last gain of a (dB), and a drop right after the start."""
    last, first, second = F.try_element_at(gains_a, F.lit(-1)), F.try_element_at(gains_a, F.lit(1)), F.try_element_at(gains_a, F.lit(2))
    gone = F.when(seconds < 16, "fade_out").otherwise("long_blend")
    return F.when(seconds < 4, "quick_cut").when(last < -40, gone).when((first > -6) & (F.size(gains_a) > 2) & (second < -30), "drop_mix").otherwise("long_blend")


def primary_technique(seconds: Column, crossfade: Column) -> Column:
    return F.when(seconds < 4, "quick_cut").when(crossfade == "drop_mix", "drop_mix").when(seconds > 30, "long_blend").otherwise("crossfade")


def secondary_techniques(bass_swap: Column, high_pass: Column, low_pass: Column) -> Column:
    return F.array_compact(F.array(F.when(bass_swap, "bass_swap"), F.when(high_pass, "filter_sweep"), F.when(low_pass, "lowpass_sweep")))


def technique_confidence(bass_swap: Column, high_pass: Column, low_pass: Column) -> Column:
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    return F.least(F.lit(1.0), 0.7 + plus(bass_swap, 0.1) + plus(high_pass, 0.05) + plus(low_pass, 0.05))


def technique_tags(crossfade: Column, bass_swap: Column, low_cut: Column, high_cut: Column, automation: Column, dip: Column, build: Column, fit: Column, tension: Column) -> Column:
    """Tags in a fixed order, from five kinds of evidence."""
    shape = F.when(crossfade == "cut", "quick_cut").when(crossfade == "s_curve", "s_curve_crossfade").when(crossfade == "exponential_out", "exponential_fade").otherwise("linear_crossfade")
    rest = [(bass_swap, "bass_swap"), (low_cut, "low_cut_on_incoming"), (high_cut, "high_cut_on_outgoing"), (automation & ~bass_swap, "eq_automation"), (dip, "energy_dip"), (build, "energy_build"), (fit, "key_matched"), (tension < 0.2, "harmonic_blend")]
    return F.array_compact(F.array(shape, *(F.when(c, t) for c, t in rest)))


def effectiveness(beat_aligned: Column, fit: Column, tension: Column, spectral: Column, bass_swap: Column, dip: Column, build: Column) -> tuple[Column, Column, Column]:
    """(smoothness, complexity, factors): the mean of five scores, six with a bass swap."""
    managed = ~dip | build
    rules = [(beat_aligned, "beat_aligned", 1.0, 0.5), (fit, "key_compatible", 1.0, 0.6), (tension < 0.3, "low_harmonic_tension", 1.0, 0.7), (spectral > 0.7, "smooth_spectral_transition", 1.0, 0.6), (managed, "good_energy_management", 0.9, 0.7)]
    total = F.when(bass_swap, 0.9).otherwise(0.0)
    for c, _, yes, no in rules:
        total = total + F.when(c, yes).otherwise(no)
    named = [(c, n) for c, n, _, _ in rules]
    named.insert(4, (bass_swap, "clean_bass_swap"))
    factors = F.array_compact(F.array(*(F.when(c, n) for c, n in named)))
    others = F.size(factors) - F.when(beat_aligned, 1).otherwise(0)
    return total / F.when(bass_swap, 6).otherwise(5), F.least(F.lit(1.0), others / 4), factors


def technique_params(name: Column, bars: dict[str, int], extras: dict[str, dict[str, str]], default: str = "long_blend") -> Column:
    """map<string,string> of a technique's parameters; unknown names give the default's."""
    table = F.create_map(*(x for n, b in bars.items() for x in (F.lit(n), F.create_map(*(F.lit(v) for kv in {"duration_bars": str(b), **extras.get(n, {})}.items() for v in kv)))))
    return F.coalesce(F.try_element_at(table, name), F.element_at(table, F.lit(default)))
