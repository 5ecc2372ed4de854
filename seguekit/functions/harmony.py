"""Keys and their compatibility as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seguekit.plans.views import NAMES

#: Pitch intervals that count as compatible.
CONSONANT = (0, 3, 4, 5, 7, 8, 9)


def camelot_number(semitone: int, minor: bool) -> int:
    """Fifths wheel: C major is 8, A minor is 8."""
    return (7 * (semitone - (9 if minor else 0)) + 7) % 12 + 1


#: Key name -> Camelot code, by rule.
CAMELOT = {n + ("m" if minor else ""): f"{camelot_number(i, minor)}{'A' if minor else 'B'}" for i, n in enumerate(NAMES) for minor in (False, True)}
#: Key name -> its seven pitch classes, by rule: major steps from the root, a minor key shares its relative major's.
SCALE = (0, 2, 4, 5, 7, 9, 11)
NOTES = {n + ("m" if minor else ""): sorted((i + (3 if minor else 0) + s) % 12 for s in SCALE) for i, n in enumerate(NAMES) for minor in (False, True)}


def lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def key_index(key: Column) -> Column:
    """0 to 11 of a sharps name; anything else, null too, is 0."""
    return F.coalesce(lookup({n: i for i, n in enumerate(NAMES)}, key), F.lit(0))


def key_to_camelot(key: Column) -> Column:
    """Camelot code of a key name or code; null if it is neither. 'min' becomes 'm' before 'minor' is looked for."""
    code = key.rlike("^(1[0-2]|0*[1-9])[AB]$")
    name = F.replace(F.replace(F.trim(key), F.lit("maj"), F.lit("")), F.lit("min"), F.lit("m"))
    return F.when(code, F.regexp_replace(key, "^0+", "")).otherwise(lookup(CAMELOT, name))


def number(code: Column) -> Column:
    return F.regexp_extract(code, r"^(\d+)[AB]$", 1).try_cast("int")


def camelot_distance(a: Column, b: Column) -> Column:
    """0 same, 1 neighbour or other letter, 2 two steps, 3 for the rest and for anything that is no code."""
    na, nb = number(a), number(b)
    d = F.abs(na - nb)
    out = F.when(a == b, 0).when(d == 0, 1).when(d.isin(1, 11), 1).when(d.isin(2, 10), 2).otherwise(3)
    return F.when(na.isNull() | nb.isNull(), 3).otherwise(out)


def camelot_delta(a: Column, b: Column) -> Column:
    """Steps on the wheel from a to b, -5 to 6."""
    d = F.pmod(number(b) - number(a), F.lit(12))
    return F.when(d > 6, d - 12).otherwise(d)


def camelot_score(a: Column, b: Column) -> Column:
    d = F.abs(camelot_delta(a, b))
    other = F.right(a, F.lit(1)) != F.right(b, F.lit(1))
    s = F.when(d == 0, 1.0).when(d == 1, 0.9).when((d == 5) & other, 0.85).when(d == 2, 0.75).when(d.isin(3, 4), 0.5).otherwise(0.2)
    return F.when(d.isNull(), 0.0).otherwise(s)


def camelot_compatible(a: Column, b: Column, strict: bool = False) -> Column:
    return camelot_score(a, b) >= (0.85 if strict else 0.5)


def root(key: Column) -> Column:
    return key_index(F.regexp_replace(key, "[mM]", ""))


def pitch_compatible(a: Column, b: Column) -> Column:
    d = F.abs(root(a) - root(b))
    return d.isin(*CONSONANT) | (12 - d).isin(*CONSONANT)


def pitch_compatible_directed(a: Column, b: Column) -> Column:
    return F.pmod(root(b) - root(a), F.lit(12)).isin(*CONSONANT)


def semitones(a: Column, b: Column) -> Column:
    s = F.pmod(camelot_delta(a, b) * 7, F.lit(12))
    return F.when(s > 6, s - 12).otherwise(s)


def clip(x: Column, most: int) -> Column:
    return F.greatest(F.least(x, F.lit(most)), F.lit(-most)).cast("int")


def modulation(a: Column, b: Column, strategy: str, most: int = 2) -> tuple[Column, Column]:
    """Semitones to shift a and b by; 0 where a code is missing."""
    s, none = F.coalesce(semitones(a, b), F.lit(0)), F.lit(0)
    if strategy == "match_b":
        return clip(s, most), none
    if strategy == "match_a":
        return none, clip(-s, most)
    return clip(F.bround(s / 2), most), clip(F.bround(-s / 2), most)


def notes(key: Column) -> Column:
    """Pitch classes of a key; C major if unknown."""
    name = F.replace(F.replace(F.trim(key), F.lit("maj"), F.lit("")), F.lit("min"), F.lit("m"))
    table = F.create_map(*(x for k, v in NOTES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(table, name), F.array(*map(F.lit, NOTES["C"])))


def common_tones(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(notes(a), notes(b)))


def voice_distance(a: Column, b: Column) -> Column:
    """Mean over a's notes of the distance on the circle to b's nearest note."""
    near = F.transform(notes(a), lambda x: F.array_min(F.transform(notes(b), lambda y: F.least(F.abs(x - y), 12 - F.abs(x - y)))))
    return F.aggregate(near, F.lit(0), lambda acc, x: acc + x) / 7


def voice_smoothness(a: Column, b: Column) -> Column:
    return (1 - voice_distance(a, b) / 6) * 0.5 + common_tones(a, b) / 7 * 0.5


def tempo_closeness(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - d / 10))


def harmonic_score(key_a: Column, key_b: Column, bpm_a: Column, bpm_b: Column) -> Column:
    fit = camelot_score(key_to_camelot(key_a), key_to_camelot(key_b))
    return fit * 0.5 + voice_smoothness(key_a, key_b) * 0.3 + tempo_closeness(bpm_a, bpm_b) * 0.2


def harmonic_label(score: Column) -> Column:
    return F.when(score > 0.8, "excellent").when(score > 0.6, "good").when(score > 0.4, "moderate").otherwise("poor")
