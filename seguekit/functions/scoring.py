"""Scores, labels and parameters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seguekit.functions.harmony import number


def queue_score(bpm_a: Column, bpm_b: Column, camelot_a: Column, camelot_b: Column, energy_a: Column, energy_b: Column) -> Column:
    """0.4 tempo (8 % of a) + 0.4 key + 0.2 energy. From 12 to 1 the key does not wrap."""
    tempo = F.greatest(F.lit(0.0), 1 - F.abs(bpm_a - bpm_b) / (bpm_a * 0.08))
    na, nb = number(camelot_a), number(camelot_b)
    letters = F.right(camelot_a, F.lit(1)) == F.right(camelot_b, F.lit(1))
    step = F.abs(na - nb) % 12
    key = F.when(camelot_a == camelot_b, 1.0).when((step == 1) & letters, 0.8).when((na == nb) & ~letters, 0.6).otherwise(0.2)
    return tempo * 0.4 + F.coalesce(key, F.lit(0.2)) * 0.4 + (1 - F.abs(energy_a - energy_b)) * 0.2


def tempo_rate(bpm_a: Column, bpm_b: Column) -> Column:
    """Of a/b, a/2b and 2a/b the one nearest to 1 on a log scale; 1.0 if it is off by over 12 %."""
    rates = [bpm_a / bpm_b, bpm_a / (2 * bpm_b), 2 * bpm_a / bpm_b]
    off = [F.abs(F.log2(r)) for r in rates]
    best = F.when((off[0] <= off[1]) & (off[0] <= off[2]), rates[0]).when(off[1] <= off[2], rates[1]).otherwise(rates[2])
    return F.when(F.abs(best - 1) > 0.12, 1.0).otherwise(best)


def pitch_shift(bpm_a: Column, bpm_b: Column) -> Column:
    return 12 * F.log2(bpm_b / bpm_a)


def energy_direction(a: Column, b: Column, margin: float = 0.2) -> Column:
    return F.when(b - a > margin, "up").when(b - a < -margin, "down").otherwise("maintain")


def energy_direction_ratio(a: Column, b: Column, factor: float = 1.2) -> Column:
    return F.when(b > a * factor, "building").when(a > b * factor, "fading").otherwise("stable")


#: Ideal seconds of a transition by part of the technique's name, first match; 32 for the rest.
IDEAL_SECONDS = {64.0: "morph|superhuman", 8.0: "cut|drop|echo|backspin", 48.0: "staggered|operator"}


def ideal_duration(technique: Column, clash: Column, bpm_a: Column, bpm_b: Column) -> Column:
    """Seconds of a transition without a request: long for layered techniques, shortened by clash and tempo gap, 8 to 95."""
    base = F.lit(32.0)
    for seconds, names in reversed(IDEAL_SECONDS.items()):
        base = F.when(technique.rlike(names), seconds).otherwise(base)
    plain = F.abs(bpm_a - bpm_b)
    gap = F.when(plain > 30, F.least(F.abs(bpm_a - bpm_b * 0.5), plain, F.abs(bpm_a - bpm_b * 2.0))).otherwise(plain)
    out = base - F.when(clash > 0.55, (clash - 0.5) * 80).otherwise(0.0) - F.when(gap > 5, gap * 5).otherwise(0.0)
    return F.greatest(F.lit(8.0), F.least(F.lit(95.0), out))


def loudness_gain(lufs: Column, target: float = -14.0, most: float = 10.0) -> Column:
    return F.pow(F.lit(10.0), F.greatest(F.least(target - lufs, F.lit(most)), F.lit(-most)) / 20)


def pair_gain_db(lufs_a: Column, lufs_b: Column, most: float = 6.0, ignored: float = 0.5) -> Column:
    """Gain in dB that brings b to a; 0 within ``ignored``."""
    d = lufs_a - lufs_b
    return F.when(F.abs(d) <= ignored, 0.0).otherwise(F.greatest(F.least(d, F.lit(most)), F.lit(-most)))


def quality_rating(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.75, "very_good").when(score >= 0.6, "good").when(score >= 0.4, "fair").otherwise("poor")


def energy_pattern(before: Column, after: Column, build: Column, dip: Column) -> Column:
    """BUILD and DIP by their flags, else by the ends."""
    return F.when(build, "BUILD").when(dip, "DIP").when(after > before, "RISE").when(after < before, "DROP").otherwise("MAINTAIN")


def truthy(x: Column) -> Column:
    """A boolean that may have been written as text; other texts are false."""
    return F.coalesce(x.cast("string").isin("true", "True"), F.lit(False))


def parse_tempo(text: Column) -> Column:
    """123, '[123.0]' and '[123.0, 90]' give 123; '[]' and other texts give null."""
    return F.regexp_replace(F.split(text, ",")[0], r"^[\[\]]+|[\[\]]+$", "").try_cast("double")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def timestamp_to_seconds(text: Column) -> Column:
    """M:SS and H:MM:SS; null for anything else."""
    p = F.split(text, ":")
    ok = text.rlike(r"^\d+:\d{1,2}(:\d{1,2})?$")
    two = F.try_element_at(p, F.lit(1)).try_cast("int") * 60 + F.try_element_at(p, F.lit(2)).try_cast("int")
    return F.when(ok & (F.size(p) == 3), two * 60 + F.try_element_at(p, F.lit(3)).try_cast("int")).when(ok, two)


def seconds_to_timestamp(sec: Column) -> Column:
    s = F.floor(sec).cast("int")
    h, m = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


#: Genre by keyword of a source's name, first match; for reports and for stratified splits.
REPORT_GENRES = {
    "Hip-hop/Trap": "heroes|villains|metro|trap", "Electronic": "boiler|techno|house", "Dubstep": "dubstep|skream|benga",
    "Baile/Jersey": "syber|baby_j|baile|jersey", "Hip-hop/R&B": "lex|rb|hip hop", "Electronic/J-Music": "yusuke|tokyo|osaka",
}
SPLIT_GENRES = {
    "Baile/Jersey": "syber|baby_j|baile|jersey", "Electronic": "boiler|techno|house|electronic", "Hip-hop/R&B": "hip|rap|trap|rnb|rb",
    "World/Global": "reggaeton|dancehall|afrobeats|amapiano",
}
#: Words in the titles of recorded sets.
MIX_WORDS = "dj set|boiler room|mix|live set|b2b|essential mix|fabric|dekmantel|resident advisor"


def genre_of(name: Column, genres: dict[str, str] = REPORT_GENRES) -> Column:
    out = F.lit("Mixed")
    for genre, words in reversed(genres.items()):
        out = F.when(F.lower(name).rlike(words), genre).otherwise(out)
    return out


def is_dj_mix(title: Column, duration_sec: Column, least_sec: int = 1800) -> Column:
    return (F.coalesce(duration_sec, F.lit(0)) >= least_sec) & F.coalesce(F.lower(title).rlike(MIX_WORDS), F.lit(False))


def compatibility(bpm_a: Column, bpm_b: Column, energy_a: Column, energy_b: Column, centroid_a: Column, centroid_b: Column, vocals_a: Column, vocals_b: Column, distance: Column) -> dict[str, Column]:
    similar = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(centroid_a - centroid_b) / 5000))
    diff = F.abs(bpm_a - bpm_b)
    return {"bpm_diff": diff, "bpm_ratio": bpm_b / bpm_a, "energy_delta": energy_b - energy_a, "spectral_similarity": similar, "vocal_clash": vocals_a & vocals_b, "sounds_good": (diff < 6) & (distance <= 1)}
