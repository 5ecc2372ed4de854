"""Queries of the scalar functions (F*, V5, V6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seguekit.functions import harmony as H
from seguekit.functions import scoring as S
from seguekit.plans import views as V
from seguekit.plans.registry import query

_KEYS = ", ".join(f"('{k}', '{c}', {list(H.NOTES[k])})" for k, c in H.CAMELOT.items())
K_DIM = f"k_dim(k, c, notes) AS (VALUES {_KEYS})"
_NAMES = "[" + ", ".join(f"'{n}'" for n in V.NAMES) + "]"
#: Test texts of a key column: names, codes, spellings and junk, by song.
KEY_TEXT = "CASE CAST(song_id % 7 AS INT) WHEN 0 THEN key_name WHEN 1 THEN camelot WHEN 2 THEN replace(key_name, 'm', '') || 'maj' WHEN 3 THEN replace(key_name, 'm', '') || 'min' WHEN 4 THEN replace(key_name, 'm', '') || 'minor' WHEN 5 THEN '13A' ELSE 'x' END"


@query("F1_key_index", f"SELECT song_id, coalesce(list_position({_NAMES}, key_name) - 1, 0) AS key_index FROM v_songs")
def f1(spark, d):
    return V.songs(spark, d).select("song_id", H.key_index(F.col("key_name")).alias("key_index"))


@query(
    "F2_key_to_camelot",
    f"""WITH {K_DIM}, t AS (SELECT song_id, {KEY_TEXT} AS key_text FROM v_songs)
    SELECT song_id, key_text, CASE WHEN regexp_matches(key_text, '^(1[0-2]|[1-9])[AB]$') THEN key_text ELSE c END AS camelot
    FROM t LEFT JOIN k_dim ON k = replace(replace(trim(key_text), 'maj', ''), 'min', 'm')""",
)
def f2(spark, d):
    t = V.songs(spark, d).select("song_id", F.expr(KEY_TEXT).alias("key_text"))
    return t.withColumn("camelot", H.key_to_camelot(F.col("key_text")))


_NUM = "CAST(regexp_extract({0}, '^([0-9]+)[AB]$', 1) AS INT)"
NA, NB = _NUM.format("camelot_a"), _NUM.format("camelot_b")
DISTANCE = f"CASE WHEN camelot_a = camelot_b THEN 0 WHEN abs({NA} - {NB}) IN (0, 1, 11) THEN 1 WHEN abs({NA} - {NB}) IN (2, 10) THEN 2 ELSE 3 END"
DELTA = f"(CASE WHEN ({NB} - {NA} + 12) % 12 > 6 THEN ({NB} - {NA} + 12) % 12 - 12 ELSE ({NB} - {NA} + 12) % 12 END)"
CAMELOT_SCORE = f"(CASE WHEN {DELTA} = 0 THEN 1.0 WHEN abs({DELTA}) = 1 THEN 0.9 WHEN abs({DELTA}) = 5 AND right(camelot_a, 1) <> right(camelot_b, 1) THEN 0.85 WHEN abs({DELTA}) = 2 THEN 0.75 WHEN abs({DELTA}) IN (3, 4) THEN 0.5 ELSE 0.2 END)::DOUBLE"
SEMI = f"(CASE WHEN ({DELTA} * 7 % 12 + 12) % 12 > 6 THEN ({DELTA} * 7 % 12 + 12) % 12 - 12 ELSE ({DELTA} * 7 % 12 + 12) % 12 END)"


@query("F3_camelot_distance", f"SELECT pair_id, {DISTANCE} AS distance FROM v_pairs")
def f3(spark, d):
    return V.pairs(spark, d).select("pair_id", H.camelot_distance(F.col("camelot_a"), F.col("camelot_b")).alias("distance"))


@query("F4_camelot_compat", f"SELECT pair_id, {DELTA} AS delta, {CAMELOT_SCORE} AS score, {CAMELOT_SCORE} >= 0.5 AS compatible, {CAMELOT_SCORE} >= 0.85 AS compatible_strict FROM v_pairs")
def f4(spark, d):
    a, b = F.col("camelot_a"), F.col("camelot_b")
    return V.pairs(spark, d).select("pair_id", H.camelot_delta(a, b).alias("delta"), H.camelot_score(a, b).alias("score"), H.camelot_compatible(a, b).alias("compatible"), H.camelot_compatible(a, b, True).alias("compatible_strict"))


_IA, _IB = (f"(list_position({_NAMES}, replace({k}, 'm', '')) - 1)" for k in ("key_a", "key_b"))


@query("F5_pitch_compat", f"SELECT pair_id, abs({_IA} - {_IB}) IN (0,3,4,5,7,8,9) OR 12 - abs({_IA} - {_IB}) IN (0,3,4,5,7,8,9) AS compatible FROM v_pairs")
def f5(spark, d):
    return V.pairs(spark, d).select("pair_id", H.pitch_compatible(F.col("key_a"), F.col("key_b")).alias("compatible"))


@query("F6_pitch_compat_directed", f"SELECT pair_id, ({_IB} - {_IA} + 12) % 12 IN (0,3,4,5,7,8,9) AS compatible FROM v_pairs")
def f6(spark, d):
    return V.pairs(spark, d).select("pair_id", H.pitch_compatible_directed(F.col("key_a"), F.col("key_b")).alias("compatible"))


@query(
    "F7_modulation_plan",
    f"""SELECT pair_id, {SEMI} AS semitones, least(greatest({SEMI}, -2), 2) AS match_b, least(greatest(-{SEMI}, -2), 2) AS match_a,
    CAST(least(greatest(round_even({SEMI} / 2.0, 0), -2), 2) AS INT) AS mid_a, CAST(least(greatest(round_even(-{SEMI} / 2.0, 0), -2), 2) AS INT) AS mid_b FROM v_pairs""",
)
def f7(spark, d):
    a, b = F.col("camelot_a"), F.col("camelot_b")
    mid = H.modulation(a, b, "midpoint")
    return V.pairs(spark, d).select("pair_id", H.semitones(a, b).alias("semitones"), H.modulation(a, b, "match_b")[0].alias("match_b"), H.modulation(a, b, "match_a")[1].alias("match_a"), mid[0].alias("mid_a"), mid[1].alias("mid_b"))


VOICE = f"""WITH {K_DIM}, kk AS (SELECT a.k AS ka, b.k AS kb, a.c AS ca, b.c AS cb, len(list_intersect(a.notes, b.notes)) AS common,
    list_sum([list_min([least(abs(x - y), 12 - abs(x - y)) for y in b.notes]) for x in a.notes]) / 7.0 AS distance FROM k_dim a, k_dim b)"""


@query("F8_voice_leading", f"{VOICE} SELECT pair_id, common AS common_tones, round(distance, 6) AS distance, round((1 - distance / 6) * 0.5 + common / 7.0 * 0.5, 6) AS smoothness FROM v_pairs JOIN kk ON ka = key_a AND kb = key_b")
def f8(spark, d):
    a, b = F.col("key_a"), F.col("key_b")
    return V.pairs(spark, d).select("pair_id", H.common_tones(a, b).alias("common_tones"), F.round(H.voice_distance(a, b), 6).alias("distance"), F.round(H.voice_smoothness(a, b), 6).alias("smoothness"))


_KSCORE = CAMELOT_SCORE.replace("camelot_a", "ca").replace("camelot_b", "cb")


@query(
    "F9_harmonic_score",
    f"""{VOICE}, s AS (SELECT pair_id, {_KSCORE} * 0.5 + ((1 - distance / 6) * 0.5 + common / 7.0 * 0.5) * 0.3 + CASE WHEN abs(bpm_a - bpm_b) < 2 THEN 1.0 ELSE greatest(0, 1 - abs(bpm_a - bpm_b) / 10) END * 0.2 AS score
    FROM v_pairs JOIN kk ON ka = key_a AND kb = key_b) SELECT pair_id, round(score, 6) AS score, CASE WHEN score > 0.8 THEN 'excellent' WHEN score > 0.6 THEN 'good' WHEN score > 0.4 THEN 'moderate' ELSE 'poor' END AS label FROM s""",
)
def f9(spark, d):
    s = V.pairs(spark, d).withColumn("score", H.harmonic_score(F.col("key_a"), F.col("key_b"), F.col("bpm_a"), F.col("bpm_b")))
    return s.select("pair_id", F.round("score", 6).alias("score"), H.harmonic_label(F.col("score")).alias("label"))


QUEUE = f"""(greatest(0.0, 1 - abs(bpm_a - bpm_b) / (bpm_a * 0.08)) * 0.4 + CASE WHEN camelot_a = camelot_b THEN 1.0 WHEN abs({NA} - {NB}) % 12 = 1 AND right(camelot_a, 1) = right(camelot_b, 1) THEN 0.8
    WHEN {NA} = {NB} THEN 0.6 ELSE 0.2 END * 0.4 + (1 - abs(energy_a - energy_b)) * 0.2)"""


@query("F10_queue_score", f"SELECT pair_id, CAST({QUEUE} AS DOUBLE) AS score FROM v_pairs")
def f10(spark, d):
    return V.pairs(spark, d).select("pair_id", S.queue_score(*(F.col(f"{n}_{s}") for n in ("bpm", "camelot", "energy") for s in "ab")).alias("score"))


@query(
    "F11_tempo_rate",
    """WITH r AS (SELECT pair_id, bpm_a / bpm_b AS x, bpm_a / (2 * bpm_b) AS y, 2 * bpm_a / bpm_b AS z FROM v_pairs), b AS (SELECT pair_id, CASE WHEN abs(log2(x)) <= abs(log2(y)) AND abs(log2(x)) <= abs(log2(z)) THEN x WHEN abs(log2(y)) <= abs(log2(z)) THEN y ELSE z END AS best FROM r)
    SELECT pair_id, round(CASE WHEN abs(best - 1) > 0.12 THEN 1.0 ELSE best END, 6) AS rate FROM b""",
)
def f11(spark, d):
    return V.pairs(spark, d).select("pair_id", F.round(S.tempo_rate(F.col("bpm_a"), F.col("bpm_b")), 6).alias("rate"))


@query("F12_pitch_shift", "SELECT pair_id, round(12 * log2(bpm_b / bpm_a), 6) AS semitones FROM v_pairs")
def f12(spark, d):
    return V.pairs(spark, d).select("pair_id", F.round(S.pitch_shift(F.col("bpm_a"), F.col("bpm_b")), 6).alias("semitones"))


@query(
    "F13_energy_direction",
    """SELECT pair_id, CASE WHEN energy_b - energy_a > 0.2 THEN 'up' WHEN energy_b - energy_a < -0.2 THEN 'down' ELSE 'maintain' END AS direction,
    CASE WHEN energy_b > energy_a * 1.2 THEN 'building' WHEN energy_a > energy_b * 1.2 THEN 'fading' ELSE 'stable' END AS by_ratio FROM v_pairs""",
)
def f13(spark, d):
    a, b = F.col("energy_a"), F.col("energy_b")
    return V.pairs(spark, d).select("pair_id", S.energy_direction(a, b).alias("direction"), S.energy_direction_ratio(a, b).alias("by_ratio"))


_TECH = "CASE CAST(pair_id % 4 AS INT) WHEN 0 THEN 'superhuman_morph' WHEN 1 THEN 'quick_cut' WHEN 2 THEN 'staggered_stem_mix' ELSE 'long_blend' END"
_CLASH = "(pair_id % 100) / 100.0"


@query(
    "F14_duration_policy",
    f"""WITH p AS (SELECT pair_id, {_TECH} AS technique, {_CLASH}::DOUBLE AS clash, bpm_a, bpm_b, abs(bpm_a - bpm_b) AS gap0 FROM v_pairs),
    q AS (SELECT *, CASE technique WHEN 'superhuman_morph' THEN 64.0 WHEN 'quick_cut' THEN 8.0 WHEN 'staggered_stem_mix' THEN 48.0 ELSE 32.0 END AS base, CASE WHEN gap0 > 30 THEN least(abs(bpm_a - bpm_b / 2), abs(bpm_a - 2 * bpm_b), gap0) ELSE gap0 END AS gap FROM p)
    SELECT pair_id, technique, round(greatest(8.0, least(95.0, base - CASE WHEN clash > 0.55 THEN (clash - 0.5) * 80 ELSE 0 END - CASE WHEN gap > 5 THEN gap * 5 ELSE 0 END)), 6) AS seconds FROM q""",
)
def f14(spark, d):
    p = V.pairs(spark, d).withColumn("technique", F.expr(_TECH)).withColumn("clash", F.expr(_CLASH).cast("double"))
    return p.select("pair_id", "technique", F.round(S.ideal_duration(F.col("technique"), F.col("clash"), F.col("bpm_a"), F.col("bpm_b")), 6).alias("seconds"))


@query("F15_loudness_gain", "SELECT song_id, round(power(10.0, greatest(least(-14 - (-energy * 3), 10), -10) / 20), 6) AS gain FROM v_songs")
def f15(spark, d):
    return V.songs(spark, d).select("song_id", F.round(S.loudness_gain(-F.col("energy") * 3), 6).alias("gain"))


_SOURCES = ["Metro Trap", "Boiler House", "Skream", "Baile", "hip hop RB", "Tokyo", "amapiano", "x"]
_SOURCE_SQL = "(SELECT song_id, title || ' ' || " + str(_SOURCES) + "[CAST(song_id % 8 + 1 AS INT)] AS source FROM v_songs)"


def _case(genres: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(source), '{w}') THEN '{g}'" for g, w in genres.items()) + " ELSE 'Mixed' END"


@query("F16_genre_of", f"SELECT song_id, {_case(S.REPORT_GENRES)} AS report_genre, {_case(S.SPLIT_GENRES)} AS split_genre FROM {_SOURCE_SQL}")
def f16(spark, d):
    source = F.concat_ws(" ", "title", F.element_at(F.array(*map(F.lit, _SOURCES)), (F.col("song_id") % 8 + 1).cast("int")))
    return V.songs(spark, d).select("song_id", S.genre_of(source).alias("report_genre"), S.genre_of(source, S.SPLIT_GENRES).alias("split_genre"))


@query("F17_is_dj_mix", f"SELECT song_id FROM v_songs WHERE duration_sec * 8 >= 1800 AND regexp_matches(lower(title || CASE WHEN song_id % 3 = 0 THEN ' Boiler Room' ELSE '' END), '{S.MIX_WORDS}')")
def f17(spark, d):
    title = F.concat("title", F.when(F.col("song_id") % 3 == 0, " Boiler Room").otherwise(""))
    return V.songs(spark, d).where(S.is_dj_mix(title, F.col("duration_sec") * 8)).select("song_id")


_SEC = "CAST(song_id * 37 % 9000 AS INT)"
_HMS = f"CASE WHEN {_SEC} >= 3600 THEN CAST({_SEC} // 3600 AS VARCHAR) || ':' || lpad(CAST({_SEC} % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST({_SEC} // 60 AS VARCHAR) END || ':' || lpad(CAST({_SEC} % 60 AS VARCHAR), 2, '0')"


@query("F18_timestamps", f"SELECT song_id, {_HMS} AS text, {_SEC} AS seconds FROM v_songs")
def f18(spark, d):
    s = V.songs(spark, d).select("song_id", S.seconds_to_timestamp(F.col("song_id") * 37 % 9000).alias("text"))
    return s.withColumn("seconds", S.timestamp_to_seconds(F.col("text")))


@query("F19_shift_timestamps", "SELECT mix_id, frame_idx, frame_idx * 45 - 100 AS seconds, CASE WHEN frame_idx * 45 >= 3700 THEN printf('%d:%02d:%02d', (frame_idx * 45 - 100) // 3600, (frame_idx * 45 - 100) % 3600 // 60, (frame_idx * 45 - 100) % 60) ELSE printf('%d:%02d', (frame_idx * 45 - 100) // 60, (frame_idx * 45 - 100) % 60) END AS text FROM v_mix_text WHERE frame_idx * 45 >= 100")
def f19(spark, d):
    t = V.mix_text(spark, d).withColumn("seconds", S.timestamp_to_seconds(F.split("text", " ")[0]).cast("long") - 100)
    return t.where("seconds >= 0").select("mix_id", "frame_idx", "seconds", S.seconds_to_timestamp(F.col("seconds")).alias("text"))


@query("F20_slug", "SELECT song_id, regexp_replace(regexp_replace(title || ' / ' || dj || '!', '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM v_songs")
def f20(spark, d):
    return V.songs(spark, d).select("song_id", S.slug(F.concat("title", F.lit(" / "), "dj", F.lit("!"))).alias("slug"))


@query("F21_quality_rating", "SELECT transition_id, CASE WHEN quality_score >= 0.9 THEN 'excellent' WHEN quality_score >= 0.75 THEN 'very_good' WHEN quality_score >= 0.6 THEN 'good' WHEN quality_score >= 0.4 THEN 'fair' ELSE 'poor' END AS rating FROM v_transitions")
def f21(spark, d):
    return V.transitions(spark, d).select("transition_id", S.quality_rating(F.col("quality_score")).alias("rating"))


@query("F29_energy_pattern", "SELECT pair_id, CASE WHEN pair_id % 5 = 0 THEN 'BUILD' WHEN pair_id % 5 = 1 THEN 'DIP' WHEN energy_b > energy_a THEN 'RISE' WHEN energy_b < energy_a THEN 'DROP' ELSE 'MAINTAIN' END AS pattern FROM v_pairs")
def f29(spark, d):
    return V.pairs(spark, d).select("pair_id", S.energy_pattern(F.col("energy_a"), F.col("energy_b"), F.col("pair_id") % 5 == 0, F.col("pair_id") % 5 == 1).alias("pattern"))


@query(
    "F30_compat_metrics",
    f"""SELECT pair_id, abs(bpm_a - bpm_b) AS bpm_diff, round(bpm_b / bpm_a, 6) AS bpm_ratio, round(energy_b - energy_a, 6) AS energy_delta, round(greatest(0, least(1, 1 - abs(duration_a - duration_b) * 20 / 5000)), 6) AS spectral_similarity,
    vocals_a AND vocals_b AS vocal_clash, abs(bpm_a - bpm_b) < 6 AND {DISTANCE} <= 1 AS sounds_good, {DISTANCE} AS camelot_distance FROM v_pairs""",
)
def f30(spark, d):
    distance = H.camelot_distance(F.col("camelot_a"), F.col("camelot_b"))
    m = S.compatibility(*(F.col(f"{n}_{s}") for n in ("bpm", "energy") for s in "ab"), F.col("duration_a") * 20, F.col("duration_b") * 20, F.col("vocals_a"), F.col("vocals_b"), distance)
    rounded = {k: F.round(c, 6) if k in ("bpm_ratio", "energy_delta", "spectral_similarity") else c for k, c in m.items()}
    return V.pairs(spark, d).select("pair_id", *(c.alias(k) for k, c in rounded.items()), distance.alias("camelot_distance"))


@query("F39_pair_gain", "SELECT pair_id, round(CASE WHEN abs(energy_a - energy_b) <= 0.5 THEN 0.0 ELSE greatest(least(energy_a - energy_b, 6), -6) END, 6) AS gain_db FROM v_pairs")
def f39(spark, d):
    return V.pairs(spark, d).select("pair_id", F.round(S.pair_gain_db(F.col("energy_a"), F.col("energy_b")), 6).alias("gain_db"))


_FEATURES = "'tempo:' || CAST(bpm AS INT) || ',key:' || key_name || ',energy:' || CASE WHEN song_id % 9 = 0 THEN 'high' ELSE CAST(CAST(song_id % 100 AS INT) AS VARCHAR) END"


@query("F44_parse_features", "SELECT song_id, bpm AS tempo, key_name AS key, CASE WHEN song_id % 9 = 0 THEN NULL ELSE (song_id % 100)::DOUBLE END AS energy FROM v_songs")
def f44(spark, d):
    energy = F.when(F.col("song_id") % 9 == 0, "high").otherwise((F.col("song_id") % 100).cast("string"))
    m = F.str_to_map(F.concat(F.lit("tempo:"), F.col("bpm").cast("int").cast("string"), F.lit(",key:"), "key_name", F.lit(",energy:"), energy), F.lit(","), F.lit(":"))
    return V.songs(spark, d).select("song_id", m["tempo"].try_cast("double").alias("tempo"), m["key"].alias("key"), m["energy"].try_cast("double").alias("energy"))


@query("V5_parse_tempo", "SELECT song_id, CASE WHEN song_id % 4 = 3 THEN NULL ELSE bpm END AS tempo FROM v_songs")
def v5(spark, d):
    n = F.col("bpm").cast("string")
    text = F.when(F.col("song_id") % 4 == 0, n).when(F.col("song_id") % 4 == 1, F.concat(F.lit("["), n, F.lit("]"))).when(F.col("song_id") % 4 == 2, F.concat(F.lit("["), n, F.lit(", 90.0]"))).otherwise("[]")
    return V.songs(spark, d).select("song_id", S.parse_tempo(text).alias("tempo"))


@query("V6_truthy", "SELECT song_id, song_id % 4 < 2 AS flag FROM v_songs")
def v6(spark, d):
    text = F.when(F.col("song_id") % 4 == 0, "True").when(F.col("song_id") % 4 == 1, "true").when(F.col("song_id") % 4 == 2, "False")
    return V.songs(spark, d).select("song_id", S.truthy(text).alias("flag"))
