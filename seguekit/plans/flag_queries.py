"""Queries of classification, sections and plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seguekit.functions import flags as FL
from seguekit.functions import harmony as H
from seguekit.operators import asof as AO
from seguekit.operators import series as SE
from seguekit.operators import validation as VA
from seguekit.plans import dims
from seguekit.plans import views as V
from seguekit.plans.registry import query
from seguekit.plans import series_queries as SQ
from seguekit.plans.spectra_queries import EPAIRS_SQL, epairs
from seguekit.sources import files

r6 = lambda c: F.round(c, 6)
_SEC = "(transition_id % 45)"
_GAINS = "[CAST(-(transition_id % 9) AS DOUBLE), CAST(-(transition_id % 50) AS DOUBLE), CAST(-(transition_id % 70) AS DOUBLE)]"
XF = f"CASE WHEN {_SEC} < 4 THEN 'quick_cut' WHEN g[3] < -40 THEN CASE WHEN {_SEC} < 16 THEN 'fade_out' ELSE 'long_blend' END WHEN g[1] > -6 AND g[2] < -30 THEN 'drop_mix' ELSE 'long_blend' END"
_T = f"(SELECT transition_id, {_GAINS} AS g, transition_id % 2 = 0 AS b, transition_id % 3 = 0 AS h, transition_id % 5 = 0 AS l FROM v_transitions)"


def executed(spark, d):
    i = F.col("transition_id")
    gains = F.array(*((-(i % n)).cast("double") for n in (9, 50, 70)))
    return V.transitions(spark, d).select(i, (i % 45).alias("sec"), gains.alias("g"), (i % 2 == 0).alias("b"), (i % 3 == 0).alias("h"), (i % 5 == 0).alias("l"), ((i % 10) / 10.0).alias("tension"))


@query("F22_crossfade_type", f"SELECT transition_id, {XF} AS type FROM {_T}")
def f22(spark, d):
    return executed(spark, d).select("transition_id", FL.crossfade_type(F.col("g"), F.col("sec")).alias("type"))


@query("F23_classify_technique", f"WITH x AS (SELECT *, {XF} AS type FROM {_T}) SELECT transition_id, CASE WHEN {_SEC} < 4 THEN 'quick_cut' WHEN type = 'drop_mix' THEN 'drop_mix' WHEN {_SEC} > 30 THEN 'long_blend' ELSE 'crossfade' END AS technique, list_filter([CASE WHEN b THEN 'bass_swap' END, CASE WHEN h THEN 'filter_sweep' END, CASE WHEN l THEN 'lowpass_sweep' END], lambda t: t IS NOT NULL) AS secondary, round(0.7 + CASE WHEN b THEN 0.1 ELSE 0 END + CASE WHEN h THEN 0.05 ELSE 0 END + CASE WHEN l THEN 0.05 ELSE 0 END, 6)::DOUBLE AS confidence FROM x")
def f23(spark, d):
    b, h, low = F.col("b"), F.col("h"), F.col("l")
    return executed(spark, d).select("transition_id", FL.primary_technique(F.col("sec"), FL.crossfade_type(F.col("g"), F.col("sec"))).alias("technique"), FL.secondary_techniques(b, h, low).alias("secondary"), r6(FL.technique_confidence(b, h, low)).alias("confidence"))


@query("F24_technique_tags", f"SELECT transition_id, list_filter(['linear_crossfade', CASE WHEN b THEN 'bass_swap' END, CASE WHEN h THEN 'low_cut_on_incoming' END, CASE WHEN l THEN 'high_cut_on_outgoing' END, CASE WHEN h AND NOT b THEN 'eq_automation' END, CASE WHEN l THEN 'energy_dip' END, CASE WHEN b THEN 'energy_build' END, CASE WHEN h THEN 'key_matched' END, CASE WHEN transition_id % 10 < 2 THEN 'harmonic_blend' END], lambda t: t IS NOT NULL) AS tags FROM {_T}")
def f24(spark, d):
    b, h, low = F.col("b"), F.col("h"), F.col("l")
    return executed(spark, d).select("transition_id", FL.technique_tags(F.lit("linear"), b, h, low, h, low, b, h, F.col("tension")).alias("tags"))


@query("F25_effectiveness", f"WITH x AS (SELECT *, transition_id % 10 / 10.0 AS t FROM {_T}) SELECT transition_id, round((CASE WHEN b THEN 1.0 ELSE 0.5 END + CASE WHEN h THEN 1.0 ELSE 0.6 END + CASE WHEN t < 0.3 THEN 1.0 ELSE 0.7 END + CASE WHEN 1 - t > 0.7 THEN 1.0 ELSE 0.6 END + CASE WHEN b THEN 0.9 ELSE 0 END + CASE WHEN NOT l OR b THEN 0.9 ELSE 0.7 END) / CASE WHEN b THEN 6 ELSE 5 END, 6)::DOUBLE AS smoothness, least(1.0, (CAST(h AS INT) + CAST(t < 0.3 AS INT) + CAST(1 - t > 0.7 AS INT) + CAST(b AS INT) + CAST(NOT l OR b AS INT)) / 4)::DOUBLE AS complexity FROM x")
def f25(spark, d):
    b, h, low, t = F.col("b"), F.col("h"), F.col("l"), F.col("tension")
    s, c, _ = FL.effectiveness(b, h, t, 1 - F.col("tension"), b, low, b)
    return executed(spark, d).select("transition_id", r6(s).alias("smoothness"), c.alias("complexity"))


@query("F28_training_sample", "SELECT transition_id, CASE WHEN transition_id % 3 = 0 THEN 'build' WHEN transition_id % 5 = 0 THEN 'dip' ELSE 'maintain' END AS energy_target, quality_score AS smoothness FROM v_transitions")
def f28(spark, d):
    t = V.transitions(spark, d)
    target = F.when(F.col("transition_id") % 3 == 0, "build").when(F.col("transition_id") % 5 == 0, "dip").otherwise("maintain")
    s = t.select("transition_id", F.struct("technique").alias("input"), F.struct(target.alias("energy_target")).alias("output"), F.struct(F.col("quality_score").alias("smoothness")).alias("quality"))
    return s.select("transition_id", "output.energy_target", "quality.smoothness")


@query("F33_crossfade_shape", "SELECT mix_id, bar_idx, CASE WHEN features[15] > 0.1 THEN 'early' WHEN features[15] < -0.1 THEN 'late' ELSE 'linear' END AS shape FROM v_bars")
def f33(spark, d):
    mid = F.element_at("features", F.floor(F.size("features") / 2).cast("int") + 1)
    return V.bars(spark, d).select("mix_id", "bar_idx", F.when(mid > 0.1, "early").when(mid < -0.1, "late").otherwise("linear").alias("shape"))


@query("F34_ensemble_action", "WITH m AS (SELECT mix_id, avg(quality_score) AS m, bool_and(quality_score > 0.5) AS c FROM v_transitions GROUP BY 1) SELECT mix_id, CASE WHEN c AND m > 0.7 THEN 'proceed' WHEN m > 0.5 THEN 'adjust' ELSE 'avoid' END AS action FROM m")
def f34(spark, d):
    m = V.transitions(spark, d).groupBy("mix_id").agg(F.avg("quality_score").alias("m"), F.bool_and(F.col("quality_score") > 0.5).alias("c"))
    return m.select("mix_id", F.when(F.col("c") & (F.col("m") > 0.7), "proceed").when(F.col("m") > 0.5, "adjust").otherwise("avoid").alias("action"))


_BARS = {t[0]: t[1] for t in dims.TECHNIQUES}


@query("F35_technique_params", f"WITH {dims.TECHNIQUES_SQL}, t AS (SELECT transition_id, {[*_BARS, 'unheard_of']}[CAST(transition_id % 23 + 1 AS INT)] AS technique FROM v_transitions) SELECT transition_id, CAST(coalesce(bars, 32) AS VARCHAR) AS duration_bars, CASE technique WHEN 'bass_swap' THEN '0.5' END AS swap_point FROM t LEFT JOIN tech ON name = technique")
def f35(spark, d):
    name = F.element_at(F.array(*map(F.lit, [*_BARS, "unheard_of"])), (F.col("transition_id") % 23 + 1).cast("int"))
    params = FL.technique_params(name, _BARS, {"bass_swap": {"swap_point_ratio": "0.5", "bass_cut_db": "-12", "bass_boost_db": "6"}})
    return V.transitions(spark, d).select("transition_id", params.alias("p")).select("transition_id", F.col("p")["duration_bars"].alias("duration_bars"), F.col("p")["swap_point_ratio"].alias("swap_point"))


@query("F45_sample_from_songs", "SELECT pair_id, round((energy_a + energy_b) / 2, 6) AS energy_during, energy_b > energy_a AS energy_build, 0.8::DOUBLE AS smoothness, 0.1::DOUBLE AS masking FROM v_pairs")
def f45(spark, d):
    return V.pairs(spark, d).select("pair_id", r6((F.col("energy_a") + F.col("energy_b")) / 2).alias("energy_during"), (F.col("energy_b") > F.col("energy_a")).alias("energy_build"), F.lit(0.8).alias("smoothness"), F.lit(0.1).alias("masking"))


@query("S4_flatten_song", "SELECT song_id, title, bpm, has_vocals, CASE WHEN song_id % 2 = 0 THEN genre END AS genre FROM v_songs")
def s4(spark, d):
    genre = F.when(F.col("song_id") % 2 == 0, F.array("genre")).otherwise(F.array().cast("array<string>"))
    tempo = F.when(F.col("song_id") % 3 == 0, F.to_json(F.struct("bpm"))).otherwise(F.to_json(F.struct(F.struct("bpm").alias("tempo"))))
    doc = F.concat(F.lit('{"tempo": '), tempo, F.lit(', "rest": '), F.to_json(F.struct("song_id", F.struct("title").alias("metadata"), F.struct(F.struct("has_vocals").alias("vocals")).alias("vocals"), F.struct(F.struct(genre.alias("genre")).alias("semantic_tags")).alias("embeddings"))), F.lit("}"))
    merged = F.regexp_replace(F.regexp_replace(doc, r'"rest": \{', ""), r"\}\}$", "}")
    row = files.flatten_song(merged)
    return V.songs(spark, d).select(row["song_id"].cast("long").alias("song_id"), row["title"].alias("title"), row["bpm"].alias("bpm"), row["has_vocals"].alias("has_vocals"), row["genre"].alias("genre"))


@query(
    "S5_flatten_transition",
    """SELECT transition_id, mix_id, track_a_id, track_b_id, transition_id * 0.5 AS start_time_sec, transition_id * 0.5 + 16 AS end_time_sec, 16.0::DOUBLE AS duration_sec, 8.0::DOUBLE AS duration_bars, technique, CASE WHEN transition_id % 4 = 0 THEN 0.0 ELSE 0.75 END::DOUBLE AS technique_confidence,
    a.bpm::DOUBLE AS bpm_a, b.bpm::DOUBLE AS bpm_b, a.key_name AS key_a, b.key_name AS key_b, (transition_id % 7)::DOUBLE AS camelot_distance, transition_id % 2 = 0 AS has_bass_swap, transition_id % 3 = 0 AS has_filter_sweep, transition_id % 5 = 0 AS has_echo_out,
    0.5 + (transition_id % 5) / 10.0 AS beat_alignment_quality, (transition_id % 9 - 4)::DOUBLE AS energy_delta, CASE WHEN transition_id % 6 = 0 THEN '{}' ELSE '{"track_a_gain_db":[0,-6]}' END AS volume_curves_json, '{}' AS eq_automation_json,
    'transitions/' || transition_id || '.json' AS transition_analysis_json_path, quality_score, analyzed_at FROM v_transitions LEFT JOIN v_songs a ON a.song_id = track_a_id LEFT JOIN v_songs b ON b.song_id = track_b_id""",
)
def s5(spark, d):
    """Documents as producers write them, flattened to the table's row again."""
    s = V.songs(spark, d)
    side = lambda x: s.select(F.col("song_id").alias(f"track_{x}_id"), F.struct("song_id", "bpm", F.col("key_name").alias("key"), "camelot").alias(f"track_{x}_features"))
    t = V.transitions(spark, d).join(side("a"), "track_a_id", "left").join(side("b"), "track_b_id", "left")
    i = F.col("transition_id")
    second = F.array_compact(F.array(*(F.when(i % n == 0, name) for n, name in ((2, "bass_swap"), (3, "filter_sweep"), (5, "echo_out")))))
    own = lambda x: F.when(F.col(f"track_{x}_features").isNotNull(), F.col(f"track_{x}_features")).otherwise(F.struct(F.col(f"track_{x}_id").alias("song_id"), *(F.lit(None).cast(k).alias(n) for n, k in (("bpm", "double"), ("key", "string"), ("camelot", "string")))))
    run = F.struct(F.col("technique").alias("technique_primary"), second.alias("technique_secondary"), F.lit(16.0).alias("duration_sec"), F.lit(8).alias("duration_bars"), F.when(i % 4 != 0, 0.75).alias("technique_confidence"), F.when(i % 6 != 0, F.struct(F.array(F.lit(0), F.lit(-6)).alias("track_a_gain_db"))).alias("volume_curves"))
    doc = F.to_json(F.struct(
        i, F.struct(F.col("mix_id").alias("source_mix_id")).alias("context"), own("a").alias("track_a_features"), own("b").alias("track_b_features"), F.struct((i * 0.5).alias("start_time_sec"), (i * 0.5 + 16).alias("end_time_sec")).alias("transition"), run.alias("transition_execution"),
        F.struct((i % 7).alias("camelot_distance"), (i % 9 - 4).alias("energy_delta")).alias("compatibility_metrics"), F.struct((0.5 + i % 5 / 10.0).alias("beat_match_quality"), F.col("quality_score").alias("overall_transition_quality")).alias("quality_assessment"),
    ))
    row = files.transition_row(doc, F.concat(F.lit("transitions/"), i.cast("string"), F.lit(".json")), F.col("analyzed_at"))
    ids = ("transition_id", "mix_id", "track_a_id", "track_b_id")
    return t.select(*((c.cast("long") if n in ids else c).alias(n) for n, c in row.items()))


@query(
    "V2_validate_transition",
    """SELECT transition_id, list_filter([CASE WHEN i % 6 = 0 THEN 'Missing required field: track_b_features' END, CASE WHEN i % 11 = 0 THEN 'Missing required field: transition_execution' END,
    CASE WHEN i % 8 = 0 THEN 'track_a_features.camelot is required' END, CASE WHEN i % 6 <> 0 AND i % 5 = 0 THEN 'track_b_features.key is required' END,
    CASE WHEN i % 11 <> 0 AND i % 4 = 0 THEN 'transition_execution.duration_sec is required' END, CASE WHEN i % 11 <> 0 AND i % 7 = 0 THEN 'transition_execution.technique_primary is required' END,
    CASE WHEN i % 11 <> 0 AND i % 3 = 0 AND i % 9 = 0 THEN 'volume_curves requires track_a_gain_db and track_b_gain_db' END], lambda x: x IS NOT NULL) AS errors FROM (SELECT transition_id, transition_id AS i FROM v_transitions)""",
)
def v2(spark, d):
    """Documents that lack one thing or another by their number."""
    i = F.col("transition_id")
    track = lambda x, key, camelot: F.struct(F.col(f"track_{x}_id").alias("song_id"), F.lit(120.0).alias("bpm"), F.when(key, "C").alias("key"), F.when(camelot, "8B").alias("camelot"))
    always = F.lit(True)
    curves = F.when(i % 3 == 0, F.struct(F.array(F.lit(0)).alias("track_a_gain_db"), F.when(i % 9 != 0, F.array(F.lit(-60))).alias("track_b_gain_db")))
    run = F.when(i % 11 != 0, F.struct(F.when(i % 4 != 0, 16.0).alias("duration_sec"), F.when(i % 7 != 0, F.col("technique")).alias("technique_primary"), curves.alias("volume_curves")))
    doc = F.to_json(F.struct(i, track("a", always, i % 8 != 0).alias("track_a_features"), F.when(i % 6 != 0, track("b", i % 5 != 0, always)).alias("track_b_features"), run.alias("transition_execution")))
    return V.transitions(spark, d).select("transition_id", VA.transition_errors(doc).alias("errors"))


@query("J18_vocal_bed_plan", "SELECT pair_id, CASE WHEN vocals_a AND NOT vocals_b THEN 'a_vocal_b_bed' WHEN vocals_b AND NOT vocals_a THEN 'b_vocal_a_bed' WHEN vocals_a AND vocals_b THEN CASE WHEN energy_a >= energy_b THEN 'a_vocal_b_bed' ELSE 'b_vocal_a_bed' END ELSE 'drums_only' END AS plan FROM v_pairs")
def j18(spark, d):
    """Candidates by the stems at hand, scored by energy; the first best, else drums only."""
    options = F.filter(F.array(F.when(F.col("vocals_a"), F.struct(F.col("energy_a").alias("score"), F.lit(-1).alias("k"), F.lit("a_vocal_b_bed").alias("plan"))), F.when(F.col("vocals_b"), F.struct(F.col("energy_b").alias("score"), F.lit(-2).alias("k"), F.lit("b_vocal_a_bed").alias("plan")))), lambda x: x.isNotNull())
    return V.pairs(spark, d).select("pair_id", F.coalesce(F.array_max(options)["plan"], F.lit("drums_only")).alias("plan"))


@query("J19_stem_ranking", f"WITH {EPAIRS_SQL}, s AS (SELECT pair_id, ['drums', 'bass', 'other', 'vocals'][CAST(a.bin // 16 + 1 AS INT)] AS stem, sum(a.mag * b.mag) / sqrt(sum(a.mag * a.mag) * sum(b.mag * b.mag)) AS c FROM ep JOIN v_spectrum a ON a.track_id = a_id JOIN v_spectrum b ON b.track_id = b_id AND b.bin = a.bin GROUP BY ALL) SELECT pair_id, stem, round(c, 6) AS score, row_number() OVER (PARTITION BY pair_id ORDER BY round(c, 9) DESC, stem) AS rank FROM s")
def j19(spark, d):
    from seguekit.operators import spectra as SP

    both = SP.sides(V.spectrum(spark, d), epairs(spark, d), ["bin"], "mag")
    stem = F.element_at(F.array(*map(F.lit, ("drums", "bass", "other", "vocals"))), (F.floor(F.col("bin") / 16) + 1).cast("int"))
    s = both.groupBy("pair_id", stem.alias("stem")).agg(F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") ** 2) * F.sum(F.col("b") ** 2))).alias("c"))
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc(F.round("c", 9)), "stem"))
    return s.select("pair_id", "stem", r6("c").alias("score"), rank.alias("rank"))


VOCAL_RUNS_SQL = """vx AS (SELECT track_id, frame_idx, sum(CASE WHEN vocal > 0.5 THEN rms ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS x FROM v_frames),
    vs AS (SELECT *, round(x, 9) < round(0.3 * avg(x) OVER (PARTITION BY track_id), 9) AS silent, max(frame_idx) OVER (PARTITION BY track_id) AS last FROM vx), vi AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY track_id, silent ORDER BY frame_idx) AS g FROM vs),
    runs AS (SELECT track_id, silent, min(frame_idx) AS start_idx, max(frame_idx) AS end_idx, any_value(last) AS last FROM vi GROUP BY track_id, silent, g),
    safe AS (SELECT track_id, (start_idx + end_idx + 1) / 2 * 0.25 AS center_sec FROM runs WHERE silent AND end_idx < last AND end_idx + 1 - start_idx > 5)"""


@query("J22_phrase_fade_timing", f"WITH {VOCAL_RUNS_SQL} SELECT t.track_id, coalesce(min(center_sec) FILTER (WHERE center_sec BETWEEN 2 AND 12), CASE WHEN max(center_sec) FILTER (WHERE center_sec <= 12) >= 2 THEN max(center_sec) FILTER (WHERE center_sec <= 12) ELSE min(center_sec) FILTER (WHERE center_sec <= 12) END)::DOUBLE AS fade_out, (min(center_sec) FILTER (WHERE center_sec < 12))::DOUBLE AS fade_in FROM (SELECT DISTINCT track_id FROM v_frames) t LEFT JOIN safe USING (track_id) GROUP BY t.track_id")
def j22(spark, d, segment_sec=12.0, least_sec=2.0):
    """Outgoing: the first safe point that leaves 2 s for the fade, else the last one of the segment; incoming: the first one."""
    c = F.col("center_sec")
    tracks = V.frames(spark, d).select("track_id").distinct().join(safe_points(spark, d), "track_id", "left")
    within = F.when(c <= segment_sec, c)
    out = F.coalesce(F.min(F.when(c.between(least_sec, segment_sec), c)), F.when(F.max(within) >= least_sec, F.max(within)).otherwise(F.min(within)))
    return tracks.groupBy("track_id").agg(out.alias("fade_out"), F.min(F.when(c < segment_sec, c)).alias("fade_in"))


@query("W17_mix_points", "WITH p AS (SELECT track_id, frame_idx // 8 AS k, min(t_sec) AS s, max(t_sec) AS e, avg(rms) FILTER (WHERE frame_idx % 8 < 4) AS a, avg(rms) FILTER (WHERE frame_idx % 8 >= 4) AS b FROM v_frames GROUP BY ALL HAVING count(*) = 8), q AS (SELECT *, max(k) OVER (PARTITION BY track_id) AS last FROM p) SELECT track_id, coalesce(list_sort(list(DISTINCT s) FILTER (WHERE k < 8 AND b > a * 1.2)), []) AS ins, coalesce(list_sort(list(DISTINCT e) FILTER (WHERE k > last - 8 AND b <= a * 1.2)), []) AS outs FROM q GROUP BY track_id")
def w17(spark, d):
    half = lambda c: F.avg(F.when(c, F.col("rms")))
    p = V.frames(spark, d).groupBy("track_id", F.floor(F.col("frame_idx") / 8).alias("k")).agg(F.min("t_sec").alias("s"), F.max("t_sec").alias("e"), half(F.col("frame_idx") % 8 < 4).alias("a"), half(F.col("frame_idx") % 8 >= 4).alias("b"), F.count("*").alias("n")).where("n = 8")
    q = p.withColumn("last", F.max("k").over(Window.partitionBy("track_id")))
    rising = F.col("b") > F.col("a") * 1.2
    return q.groupBy("track_id").agg(F.array_sort(F.collect_set(F.when((F.col("k") < 8) & rising, F.col("s")))).alias("ins"), F.array_sort(F.collect_set(F.when((F.col("k") > F.col("last") - 8) & ~rising, F.col("e")))).alias("outs"))


@query("W21_plan_transition", "WITH b AS (SELECT track_id, frame_idx // 4 AS k, min(t_sec) AS s, avg(rms) AS e, count(*) AS n FROM v_frames GROUP BY ALL HAVING count(*) = 4), m AS (SELECT track_id, quantile_cont(e, 0.5) AS med, max(k) AS last FROM b GROUP BY 1) SELECT b.track_id, coalesce(max(s) FILTER (WHERE e < med AND k <= last - 2), max(s) FILTER (WHERE k = last)) AS switch_sec, coalesce(min(s) FILTER (WHERE e < med), min(s) FILTER (WHERE e > 0.15 * med)) AS mix_in_sec FROM b JOIN m USING (track_id) GROUP BY b.track_id")
def w21(spark, d):
    """Leave at the last low bar with room, else at the last bar; enter at the first low bar, else the first not silent."""
    b = V.frames(spark, d).groupBy("track_id", F.floor(F.col("frame_idx") / 4).alias("k")).agg(F.min("t_sec").alias("s"), F.avg("rms").alias("e"), F.count("*").alias("n")).where("n = 4")
    m = b.groupBy("track_id").agg(F.percentile("e", 0.5).alias("med"), F.max("k").alias("last"))
    j = b.join(m, "track_id")
    when = lambda c: F.when(c, F.col("s"))
    low = F.col("e") < F.col("med")
    return j.groupBy("track_id").agg(F.coalesce(F.max(when(low & (F.col("k") <= F.col("last") - 2))), F.max(when(F.col("k") == F.col("last")))).alias("switch_sec"), F.coalesce(F.min(when(low)), F.min(when(F.col("e") > 0.15 * F.col("med")))).alias("mix_in_sec"))


@query("W27_vocal_phrases", f"WITH {VOCAL_RUNS_SQL} SELECT track_id, start_idx, least(end_idx + 1, last) AS end_idx FROM runs WHERE NOT silent")
def w27(spark, d):
    return SE.vocal_phrases(vocal_frames(spark, d), "track_id", "frame_idx", "voice")


@query("W27_safe_point", f"WITH {VOCAL_RUNS_SQL}, {SQ.POINTS_SQL}, r AS (SELECT p.track_id, p.point, p.t, center_sec, row_number() OVER (PARTITION BY p.track_id, p.point ORDER BY abs(center_sec - p.t), center_sec) AS r FROM pts p LEFT JOIN safe ON safe.track_id = p.track_id AND abs(center_sec - p.t) <= 2) SELECT track_id, point, coalesce(center_sec, t)::DOUBLE AS t FROM r WHERE r = 1")
def w27_safe(spark, d):
    """The nearest silence within 2 s of each point, else the point itself."""
    n = AO.nearest(SQ.points(spark, d), safe_points(spark, d).withColumn("one", F.lit(1.0)), "track_id", "point", "center_sec", "one")
    return n.select("track_id", "point", F.when(F.col("gap") <= 2, F.col("near_t")).otherwise(F.col("t")).alias("t"))


def vocal_frames(spark, d):
    return V.frames(spark, d).withColumn("voice", F.when(F.col("vocal") > 0.5, F.col("rms")).otherwise(0.0))


def safe_points(spark, d):
    return SE.safe_points(vocal_frames(spark, d), "track_id", "frame_idx", "voice", 0.25)


_PLACE = [(j * 3 / 15, min(int(j * 3 / 15), 2)) for j in range(16)]
_P16 = "[" + ", ".join(f"x[{lo + 1}] + (x[{lo + 2}] - x[{lo + 1}]) * {at - lo}" for at, lo in _PLACE) + "]"
_MEAN = lambda js: "(" + " + ".join(f"p[{j + 1}]" for j in js) + f") / {len(js)}"
DNA_SQL = f"""b4 AS (SELECT track_id, frame_idx // 4 AS beat, list(rms ORDER BY frame_idx) AS x FROM v_frames GROUP BY ALL), b5 AS (SELECT track_id, beat, {_P16} AS p FROM (SELECT *, max(beat) OVER (PARTITION BY track_id) AS l FROM b4) WHERE beat < l AND len(x) = 4),
    sy AS (SELECT track_id, avg(least(1, CASE WHEN {_MEAN(range(0, 16, 4))} > 0 THEN ({_MEAN(range(2, 16, 4))} + 2 * {_MEAN(range(1, 16, 2))}) / (3 * {_MEAN(range(0, 16, 4))}) ELSE 0.5 END)) AS syncopation FROM b5 GROUP BY 1),
    ps AS (SELECT track_id, j, sum(p[j]) AS s FROM b5, (SELECT CAST(unnest(range(1, 17)) AS INT) AS j) GROUP BY ALL), pn AS (SELECT track_id, j, CASE WHEN max(s) OVER w > 0 THEN s / max(s) OVER w ELSE s END AS v FROM ps WINDOW w AS (PARTITION BY track_id)),
    dna AS (SELECT track_id, list(v ORDER BY j) AS pattern, any_value(syncopation) AS syncopation, coalesce(list(j - 1 ORDER BY j) FILTER (WHERE v > m + sd), []) AS accents, count(*) FILTER (WHERE v > 0.3) / 16 AS density FROM (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd FROM pn WINDOW w AS (PARTITION BY track_id)) JOIN sy USING (track_id) GROUP BY track_id)"""


@query("A18_rhythm_dna", f"WITH {DNA_SQL} SELECT track_id, place - 1 AS place, pattern[place] AS energy, list_contains(accents, place - 1) AS accent, syncopation, density FROM dna, (SELECT CAST(unnest(range(1, 17)) AS INT) AS place)")
def a18(spark, d):
    """A row for each of the 16 places; beats of four frames."""
    dna = SE.rhythm_dna(V.frames(spark, d)).select("track_id", F.posexplode("pattern").alias("place", "energy"), "accents", "syncopation", "density")
    return dna.select("track_id", "place", "energy", F.array_contains("accents", F.col("place")).alias("accent"), "syncopation", "density")


@query(
    "A18_rhythm_match",
    f"""WITH {DNA_SQL.replace(" dna AS (", " dna AS MATERIALIZED (")}, nt AS (SELECT count(DISTINCT user_id) AS n FROM events), da AS MATERIALIZED (SELECT dna.*, (track_id * 7 + 3) % n AS other FROM dna, nt),
    tp AS MATERIALIZED (SELECT a.track_id AS pair_id, a.*, b.pattern AS pattern_b, b.syncopation AS sb, b.density AS db FROM da a JOIN dna b ON b.track_id = a.other),
    r AS (SELECT pair_id, greatest(0, coalesce(corr(x, y), 0)) AS r FROM (SELECT pair_id, unnest(pattern) AS x, unnest(pattern_b) AS y FROM tp) GROUP BY 1)
    SELECT pair_id, r AS pattern_correlation, 1 - abs(syncopation - sb) AS syncopation_fit, 1 - abs(density - db) AS density_fit, 0.4 * r + 0.3 * (1 - abs(syncopation - sb)) + 0.3 * (1 - abs(density - db)) AS overall FROM tp JOIN r USING (pair_id)""",
)
def a18_match(spark, d):
    from seguekit.plans.point_queries import track_pairs

    return SE.rhythm_match(track_pairs(spark, d).select("pair_id", "a_id", "b_id"), SE.rhythm_dna(V.frames(spark, d)))


@query("A25_masking_by_chunk", f"WITH {EPAIRS_SQL}, p AS (SELECT a.track_id AS t, b.bin, max(a.mag * greatest(0, 1 - abs(log2(a.freq_hz / b.freq_hz)) / 2)) AS thr FROM v_spectrum a JOIN v_spectrum b ON a.track_id = b.track_id AND a.bin >= 1 AND b.bin >= 1 AND abs(log2(a.freq_hz / b.freq_hz)) < 2 GROUP BY ALL) SELECT pair_id, round(count(*) FILTER (WHERE s.mag < thr) / count(*), 6) AS masked FROM ep JOIN p ON t = a_id JOIN v_spectrum s ON s.track_id = b_id AND s.bin = p.bin GROUP BY pair_id")
def a25(spark, d):
    """Share of b's bins under the spread of a: a bin covers two octaves, fading on a log scale. Bin pairs are fixed."""
    s = V.spectrum(spark, d).where("bin >= 1")
    reach = spark.range(1, 64).select(F.col("id").cast("int").alias("bin"), F.explode(F.sequence(F.lit(1), F.lit(63))).alias("to")).withColumn("w", 1 - F.abs(F.log2(F.col("bin") / F.col("to"))) / 2).where("w > 0")
    threshold = s.join(F.broadcast(reach), "bin").groupBy(F.col("track_id").alias("a_id"), F.col("to").alias("bin")).agg(F.max(F.col("mag") * F.col("w")).alias("thr"))
    b = s.select(F.col("track_id").alias("b_id"), "bin", "mag")
    return epairs(spark, d).join(threshold, "a_id").join(b, ["b_id", "bin"]).groupBy("pair_id").agg(r6(F.count_if(F.col("mag") < F.col("thr")) / F.count("*")).alias("masked"))


@query(
    "A28_spectral_smoothness",
    """WITH m AS (SELECT track_id, bin, mag, mag / nullif(max(mag) OVER (PARTITION BY track_id), 0) AS share FROM v_spectrum) SELECT d.track_id, sum(d.mag * (b.mag + a.mag) / 2) / sqrt(sum(d.mag * d.mag) * sum((b.mag + a.mag) * (b.mag + a.mag) / 4)) AS smoothness, avg(least(b.share, a.share)) AS masking
    FROM m d JOIN m b ON b.track_id = d.track_id - 1 AND b.bin = d.bin JOIN m a ON a.track_id = d.track_id + 1 AND a.bin = d.bin GROUP BY d.track_id""",
)
def a28(spark, d):
    """Every spectrum against the mean of the ones before and after it, and how much those two overlap."""
    m = V.spectrum(spark, d).select("track_id", "bin", "mag", F.try_divide(F.col("mag"), F.max("mag").over(Window.partitionBy("track_id"))).alias("share"))
    beside = lambda x, by: m.select((F.col("track_id") + by).alias("track_id"), "bin", F.col("mag").alias(f"mag_{x}"), F.col("share").alias(f"share_{x}"))
    near = m.join(beside("before", 1), ["track_id", "bin"]).join(beside("after", -1), ["track_id", "bin"]).withColumn("mean", (F.col("mag_before") + F.col("mag_after")) / 2)
    cosine = F.try_divide(F.sum(F.col("mag") * F.col("mean")), F.sqrt(F.sum(F.col("mag") ** 2) * F.sum(F.col("mean") ** 2)))
    return near.groupBy("track_id").agg(F.coalesce(cosine, F.lit(0.5)).alias("smoothness"), F.coalesce(F.avg(F.least("share_before", "share_after")), F.lit(0.0)).alias("masking"))


@query("A29_eq_evidence", "WITH p AS (SELECT track_id, max(frame_idx) // 2 AS half FROM v_frames GROUP BY 1), e AS (SELECT f.track_id, avg(bass) FILTER (WHERE frame_idx < half) AS bb, avg(bass) FILTER (WHERE frame_idx >= half) AS ba, avg(mid) FILTER (WHERE frame_idx < half) AS mb, avg(mid) FILTER (WHERE frame_idx >= half) AS ma, var_pop(bass) AS v, min_by(frame_idx, (bass, frame_idx)) AS pos FROM v_frames f JOIN p USING (track_id) WHERE frame_idx BETWEEN half - 50 AND half + 49 GROUP BY 1) SELECT track_id, coalesce(ba < 0.7 * bb, FALSE) AS swap, coalesce(ba > 1.3 * bb, FALSE) AS low_cut, coalesce(ma < 0.7 * mb, FALSE) AS high_cut, v > 0.02 AS automation, pos AS swap_idx FROM e")
def a29(spark, d):
    """What the bands do around the middle of a track: bass that drops or comes in, mids that drop, and moving bass."""
    f = V.frames(spark, d)
    p = f.groupBy("track_id").agg(F.floor(F.max("frame_idx") / 2).alias("half"))
    early = F.col("frame_idx") < F.col("half")
    mean = lambda c, cond: F.avg(F.when(cond, F.col(c)))
    near = f.join(p, "track_id").where(F.col("frame_idx").between(F.col("half") - 50, F.col("half") + 49))
    e = near.groupBy("track_id").agg(mean("bass", early).alias("bb"), mean("bass", ~early).alias("ba"), mean("mid", early).alias("mb"), mean("mid", ~early).alias("ma"), F.var_pop("bass").alias("v"), F.min_by("frame_idx", F.struct("bass", "frame_idx")).alias("swap_idx"))
    held = lambda c: F.coalesce(c, F.lit(False))
    return e.select("track_id", held(F.col("ba") < 0.7 * F.col("bb")).alias("swap"), held(F.col("ba") > 1.3 * F.col("bb")).alias("low_cut"), held(F.col("ma") < 0.7 * F.col("mb")).alias("high_cut"), (F.col("v") > 0.02).alias("automation"), "swap_idx")


@query("A34_mix_quality", "WITH f AS (SELECT track_id, rms, abs(rms - lag(rms) OVER (PARTITION BY track_id ORDER BY frame_idx)) AS d FROM v_frames) SELECT track_id, round(0.3 * greatest(0, 1 - avg(d)) + 0.25 * (1 - stddev_pop(rms)) + 0.2 * 0.5 + 0.15 * least(1, avg(rms)) + 0.1, 6) AS score FROM f GROUP BY track_id")
def a34(spark, d):
    diff = F.abs(F.col("rms") - F.lag("rms").over(SE.ordered("track_id", "frame_idx")))
    parts = [(0.3, F.greatest(F.lit(0.0), 1 - F.avg("d"))), (0.25, 1 - F.stddev_pop("rms")), (0.2, F.lit(0.5)), (0.15, F.least(F.lit(1.0), F.avg("rms"))), (0.1, F.lit(1.0))]
    return V.frames(spark, d).withColumn("d", diff).groupBy("track_id").agg(r6(sum((w * c for w, c in parts), F.lit(0.0))).alias("score"))


@query("A43_preview_meta", "WITH k AS (SELECT label, pc, round(avg(value), 9) AS v FROM v_chroma GROUP BY ALL), b AS (SELECT label, pc FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY v DESC, pc) AS r FROM k) WHERE r = 1), e AS (SELECT mix_id AS label, sqrt(avg(rms * rms)) AS rms FROM v_bars GROUP BY 1) SELECT b.label, CAST((7 * pc + 7) % 12 + 1 AS VARCHAR) || 'B' AS camelot, round(least(1, 5 * rms), 6) AS energy FROM b JOIN e USING (label)")
def a43(spark, d):
    k = V.chroma(spark, d).groupBy("label", "pc").agg(F.round(F.avg("value"), 9).alias("v")).groupBy("label").agg(F.max_by("pc", F.struct("v", -F.col("pc"))).alias("pc"))
    code = F.element_at(F.array(*(F.lit(H.CAMELOT[n]) for n in V.NAMES)), F.col("pc") + 1)
    e = V.bars(spark, d).groupBy(F.col("mix_id").alias("label")).agg(F.sqrt(F.avg(F.col("rms") ** 2)).alias("rms"))
    return k.join(e, "label").select("label", code.alias("camelot"), r6(F.least(F.lit(1.0), 5 * F.col("rms"))).alias("energy"))


@query("J4_refined_interval", "WITH p AS (SELECT track_id, max(t_sec)::DOUBLE * 0.2::DOUBLE AS s, max(t_sec)::DOUBLE * 0.8::DOUBLE AS e FROM v_frames GROUP BY 1), n AS (SELECT p.track_id, min_by(b.t_sec, (abs(b.t_sec - s), b.t_sec)) AS ns, min(abs(b.t_sec - s)) AS gs, min_by(b.t_sec, (abs(b.t_sec - e), b.t_sec)) AS ne, min(abs(b.t_sec - e)) AS ge, any_value(s) AS s, any_value(e) AS e FROM p JOIN v_beats b USING (track_id) GROUP BY p.track_id) SELECT track_id, round(CASE WHEN gs < 0.2 THEN ns ELSE s END, 6) AS start_sec, round(CASE WHEN ge < 0.2 THEN ne ELSE e END, 6) AS end_sec FROM n")
def j4b(spark, d):
    """Both ends of an interval go to their nearest beat if it is within 0.2 s."""
    t = V.frames(spark, d).groupBy("track_id").agg(F.max("t_sec").alias("m"))
    ends = t.select("track_id", F.explode(F.array(F.struct(F.lit(0).alias("point"), (F.col("m") * 0.2).alias("t")), F.struct(F.lit(1).alias("point"), (F.col("m") * 0.8).alias("t")))).alias("e")).select("track_id", "e.point", "e.t")
    n = AO.nearest(ends, V.beats(spark, d), "track_id", "point", "t_sec", "onset_strength")
    snapped = F.when(F.col("gap") < 0.2, F.col("near_t")).otherwise(F.col("t"))
    side = lambda i: r6(F.max(F.when(F.col("point") == i, snapped)))
    return n.groupBy("track_id").agg(side(0).alias("start_sec"), side(1).alias("end_sec"))
