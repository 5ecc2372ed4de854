"""Queries of candidate points, technique presets, tracklists, curves and flags."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seguekit.functions import harmony as H
from seguekit.operators import points as P
from seguekit.functions import scoring as S
from seguekit.operators import tracklists as TR
from seguekit.operators import training as T
from seguekit.plans import dims
from seguekit.plans import series_queries as SQ
from seguekit.plans import views as V
from seguekit.plans.corpus_queries import CHAIN_SQL, PAIR_FIT_SQL, technique_chain
from seguekit.plans.registry import query

r6 = lambda c: F.round(c, 6)

BASE_SQL = """cf AS (SELECT * FROM (SELECT track_id, frame_idx, t_sec AS t, rms AS energy, max(t_sec) OVER (PARTITION BY track_id) AS duration, vocal, avg(mid) OVER (w ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS centroid, avg(bass) OVER (w ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS bandwidth, avg(vocal) OVER (w ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS singing,
    CASE WHEN row_number() OVER w <= 8 OR row_number() OVER w > count(*) OVER (PARTITION BY track_id) - 7 THEN 'stable' WHEN avg(rms) OVER (w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) > avg(rms) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) * 1.2 THEN 'rising'
      WHEN avg(rms) OVER (w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) < avg(rms) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) * 0.6 THEN 'dip' WHEN avg(rms) OVER (w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) < avg(rms) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) * 0.8 THEN 'falling' ELSE 'stable' END AS trend,
    coalesce(rms = min(rms) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AND min(rms) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) > rms, FALSE) AS gap
    FROM v_frames WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)) WHERE frame_idx % 4 = 0),
  o1 AS (SELECT *, CASE WHEN t > duration * 0.85 THEN 'outro' WHEN t > duration * 0.7 THEN 'breakdown' WHEN energy < 0.3 THEN 'breakdown' ELSE 'verse' END AS label FROM cf WHERE t >= duration * 0.3 AND t <= duration * 0.95 AND energy >= 0.04),
  i1 AS (SELECT *, CASE WHEN t < duration * 0.15 THEN 'intro' WHEN t < duration * 0.3 THEN CASE WHEN energy > 0.7 THEN 'build' ELSE 'intro' END WHEN energy > 0.75 THEN 'drop' WHEN energy < 0.4 THEN 'breakdown' ELSE 'verse' END AS label FROM cf WHERE t <= duration * 0.95 AND energy >= 0.04),
  o2 AS (SELECT *, round(least(1.0, 0.6 + CASE WHEN vocal > 0.45 THEN -0.25 WHEN vocal > 0.35 THEN -0.15 ELSE 0.05 END + CASE WHEN t >= duration * 0.55 AND gap AND energy > 0.05 THEN 0.25 WHEN t >= duration * 0.55 AND label IN ('outro', 'breakdown') THEN 0.15 ELSE 0 END
    + CASE WHEN trend IN ('falling', 'dip', 'stable') THEN 0.1 ELSE 0 END + CASE WHEN t / nullif(duration, 0) > 0.45 AND t / duration < 0.9 THEN t / duration * 0.2 ELSE 0 END)::DOUBLE, 9) AS score FROM o1),
  i2 AS (SELECT *, round(least(1.0, 0.6 + CASE WHEN label IN ('intro', 'build', 'drop') THEN 0.4 ELSE 0 END + CASE WHEN trend = 'rising' THEN 0.2 ELSE 0 END + CASE WHEN energy > 0.3 AND energy < 0.8 THEN 0.2 ELSE 0 END)::DOUBLE, 9) AS score FROM i1),
  outs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, frame_idx) AS rank FROM o2 WHERE score > 0.3) WHERE rank <= 30),
  ins AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, frame_idx) AS rank FROM i2 WHERE score > 0.3) WHERE rank <= 30),
  tp AS (SELECT DISTINCT user_id AS pair_id, user_id AS a_id, b_id, 100.0 + user_id % 30 AS bpm_a, 100.0 + b_id % 30 AS bpm_b, user_id % 12 AS ka, b_id % 12 AS kb FROM (SELECT user_id, (user_id * 7 + 3) % (SELECT count(DISTINCT user_id) FROM events) AS b_id FROM events)),
  cp AS (SELECT pair_id, a.t AS t_a, b.t AS t_b, a.rank AS rank_a, b.rank AS rank_b, a.energy AS energy_a, b.energy AS energy_b, bpm_a, bpm_b, ka, kb, a.score AS score_a, b.score AS score_b, a.trend AS trend_a, b.trend AS trend_b, a.label AS label_a, b.label AS label_b, a.centroid AS ca, b.centroid AS cb, a.bandwidth AS wa, b.bandwidth AS wb, a.singing AS sa, b.singing AS sb,
    CASE WHEN abs(bpm_a - bpm_b) < 2 THEN 0.4 WHEN abs(bpm_a - bpm_b) < 5 THEN 0.3 WHEN abs(bpm_a - bpm_b) < 10 THEN 0.1 ELSE 0 END + CASE WHEN abs(ka - kb) IN (0,3,4,5,7,8,9) OR 12 - abs(ka - kb) IN (0,3,4,5,7,8,9) THEN 0.2 ELSE 0 END
    + CASE WHEN a.trend IN ('falling', 'dip') AND b.trend = 'rising' THEN 0.2 WHEN a.trend IN ('falling', 'stable') AND b.trend <> 'falling' THEN 0.1 ELSE 0 END + CASE WHEN a.label IN ('outro', 'breakdown') AND b.label IN ('intro', 'build') THEN 0.2 ELSE 0 END + 0.1 + (a.score + b.score) * 0.2 AS basic
    FROM tp JOIN outs a ON a.track_id = a_id AND a.rank <= 10 JOIN ins b ON b.track_id = b_id AND b.rank <= 10),
  qf AS (SELECT *, CASE WHEN abs(ka - kb) IN (0,3,4,5,7,8,9) OR 12 - abs(ka - kb) IN (0,3,4,5,7,8,9) THEN 1.0 ELSE greatest(0.3, 1 - least(abs(ka - kb), 12 - abs(ka - kb)) / 6.0) END AS harmonic,
    CASE WHEN trend_a IN ('falling', 'dip') AND trend_b = 'rising' THEN 1.0 WHEN trend_a IN ('falling', 'stable') AND trend_b <> 'falling' THEN 0.8 WHEN trend_a = 'stable' AND trend_b = 'stable' THEN 0.6 ELSE 0.4 END AS energy,
    CASE WHEN label_a || '>' || label_b IN ('outro>intro', 'outro>build', 'breakdown>intro', 'breakdown>build', 'verse>verse', 'verse>intro') THEN 1.0 WHEN label_a = 'outro' AND label_b IN ('intro', 'verse') OR label_a IN ('breakdown', 'verse') AND label_b = 'intro' THEN 0.8 ELSE 0.6 END AS structure,
    CASE WHEN abs(bpm_a - bpm_b) < 1 THEN 1.0 WHEN abs(bpm_a - bpm_b) < 2 THEN 0.9 WHEN abs(bpm_a - bpm_b) < 5 THEN 0.8 WHEN abs(bpm_a - bpm_b) < 10 THEN 0.6 ELSE 0.3 END AS tempo,
    greatest(0, least(1, (1 - abs(ca - cb) / (ca + cb + 1e-10) * 0.5) * least(wa, wb) / (greatest(wa, wb) + 1e-10))) AS spectral_risk, greatest(0, least(1, sa * sb)) AS vocal_risk FROM cp),
  qp AS (SELECT *, (harmonic * 0.20 + energy * 0.15 + structure * 0.15 + tempo * 0.20 + (1 - spectral_risk) * 0.15 + (1 - vocal_risk) * 0.10 + 0.05)::DOUBLE AS quality FROM qf)"""


def cframes(spark, d):
    """Frames with the columns that candidate points look at: mids stand for the centroid, bass for the bandwidth."""
    return V.frames(spark, d).withColumnsRenamed({"mid": "centroid", "bass": "bandwidth"})


def track_pairs(spark, d):
    t = V.read(spark, d, "events").select(F.col("user_id").alias("pair_id")).distinct()
    b = (F.col("pair_id") * 7 + 3) % t.count()
    names = F.array(*map(F.lit, V.NAMES))
    key = lambda i: F.element_at(names, (i % 12 + 1).cast("int"))
    return t.select("pair_id", F.col("pair_id").alias("a_id"), b.alias("b_id"), (100.0 + F.col("pair_id") % 30).alias("bpm_a"), (100.0 + b % 30).alias("bpm_b"), key(F.col("pair_id")).alias("key_a"), key(b).alias("key_b"))


@query("K1_candidate_points", f"WITH {BASE_SQL} SELECT 'out' AS role, track_id, frame_idx, trend, label, round(score, 6) AS score, rank FROM outs UNION ALL SELECT 'in', track_id, frame_idx, trend, label, round(score, 6), rank FROM ins")
def k1(spark, d):
    f = cframes(spark, d)
    both = P.candidate_points(f, True).withColumn("role", F.lit("out")).unionByName(P.candidate_points(f, False).withColumn("role", F.lit("in")))
    return both.select("role", "track_id", "frame_idx", "trend", "label", r6("score").alias("score"), "rank")


@query("K2_segment_label", f"WITH {BASE_SQL} SELECT track_id, frame_idx, o1.label FROM o1")
def k2(spark, d):
    c = P.candidate_frames(cframes(spark, d)).where((F.col("t") >= F.col("duration") * 0.3) & (F.col("t") <= F.col("duration") * 0.95) & (F.col("energy") >= 0.04))
    return c.select("track_id", "frame_idx", P.label(F.col("t"), F.col("duration"), F.col("energy"), True).alias("label"))


@query("K3_point_score", f"WITH {BASE_SQL} SELECT track_id, frame_idx, round(score, 6) AS score FROM i2")
def k3(spark, d):
    c = P.candidate_frames(cframes(spark, d)).where((F.col("t") <= F.col("duration") * 0.95) & (F.col("energy") >= 0.04))
    c = c.withColumn("label", P.label(F.col("t"), F.col("duration"), F.col("energy"), False))
    return c.select("track_id", "frame_idx", r6(P.point_score({n: F.col(n) for n in c.columns}, False)).alias("score"))


def point_pairs(spark, d):
    f = cframes(spark, d)
    return P.candidate_pairs(track_pairs(spark, d), P.candidate_points(f, True), P.candidate_points(f, False))


def scored_pairs(spark, d):
    c = point_pairs(spark, d)
    factors = P.quality_factors()
    c = c.withColumns({f"f_{n}": x for n, x in factors.items()})
    factors = {n: F.col(f"f_{n}") for n in factors}
    return c.withColumn("basic", P.basic_score(c)).withColumn("quality", P.quality(factors)).withColumn("total", F.round(0.6 * F.col("quality") + 0.4 * F.col("basic"), 9))


@query("J3_candidate_pairs", f"WITH {BASE_SQL} SELECT pair_id, count(*) AS pairs, round(max(basic), 6) AS best_basic FROM cp GROUP BY pair_id")
def j3(spark, d):
    c = point_pairs(spark, d)
    return c.groupBy("pair_id").agg(F.count("*").alias("pairs"), r6(F.max(P.basic_score(c))).alias("best_basic"))


@query("K4_pair_basic_score", f"WITH {BASE_SQL} SELECT pair_id, rank_a, rank_b, round(basic, 6) AS basic FROM cp")
def k4(spark, d):
    c = point_pairs(spark, d)
    return c.select("pair_id", "rank_a", "rank_b", r6(P.basic_score(c)).alias("basic"))


@query("K5_quality_factors", f"WITH {BASE_SQL} SELECT pair_id, rank_a, rank_b, harmonic::DOUBLE AS harmonic, energy::DOUBLE AS energy, structure::DOUBLE AS structure, tempo::DOUBLE AS tempo, spectral_risk, vocal_risk, quality FROM qp")
def k5(spark, d):
    return scored_pairs(spark, d).select("pair_id", "rank_a", "rank_b", *(F.col(f"f_{n}").alias(n) for n in ("harmonic", "energy", "structure", "tempo", "spectral_risk", "vocal_risk")), "quality")


@query("K6_best_pair", f"WITH {BASE_SQL}, s AS (SELECT *, round(0.6 * quality + 0.4 * basic, 9) AS total FROM qp), b AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY total DESC, rank_a, rank_b) AS r FROM s) SELECT tp.pair_id, coalesce(t_a, 0) AS t_a, coalesce(t_b, 0) AS t_b, round(coalesce(total, 0.5), 6) AS total, total IS NULL AS fallback FROM tp LEFT JOIN b ON b.pair_id = tp.pair_id AND r = 1")
def k6(spark, d):
    return P.best_pair(scored_pairs(spark, d), track_pairs(spark, d)).withColumn("total", r6("total"))


@query("K13_best_tracklist", "WITH t AS (SELECT mix_id, frame_idx, text, like_count, row_number() OVER (PARTITION BY mix_id ORDER BY like_count DESC, frame_idx) AS r FROM v_mix_text) SELECT mix_id, count(*) AS lines, max(like_count) AS likes FROM t WHERE r <= 50 AND regexp_matches(text, '^\\d+:\\d{2} ') GROUP BY mix_id HAVING count(*) >= 15")
def k13(spark, d):
    top = F.row_number().over(Window.partitionBy("mix_id").orderBy(F.desc("like_count"), "frame_idx"))
    t = V.mix_text(spark, d).withColumn("r", top).where((F.col("r") <= 50) & F.col("text").rlike(r"^\d+:\d{2} "))
    return t.groupBy("mix_id").agg(F.count("*").alias("lines"), F.max("like_count").alias("likes")).where("lines >= 15")


SOURCES_SQL = """src AS (SELECT mix_id, frame_idx * 20 AS sec, event_type AS kind, event_type || repeat('!', (like_count % 7)::INT) AS track, CASE WHEN event_type = 'purchase' AND mix_id % 5 = 0 THEN 1 WHEN event_type IN ('signup', 'error') THEN 2 ELSE 3 END AS priority FROM (SELECT user_id AS mix_id, event_type, CAST(floor(value) AS INT) AS like_count, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx FROM events))"""


@query(
    "K14_timestamps_for_mix",
    f"""WITH RECURSIVE {SOURCES_SQL}, de AS (SELECT *, sec - lag(sec) OVER (PARTITION BY mix_id ORDER BY sec) AS gap FROM src WHERE priority = 2 AND length(track) >= 3), ok AS (SELECT mix_id FROM de GROUP BY 1 HAVING count(*) >= 3 AND coalesce(min(gap) >= 30, TRUE)),
    co AS (SELECT mix_id, sec, arg_max(left(track, 100), (length(left(track, 100)), track)) AS track FROM src WHERE priority = 3 GROUP BY ALL),
    kept(mix_id, sec) AS (SELECT mix_id, min(sec) FROM co GROUP BY 1 UNION ALL SELECT k.mix_id, (SELECT min(c.sec) FROM co c WHERE c.mix_id = k.mix_id AND c.sec >= k.sec + 30) FROM kept k WHERE k.sec IS NOT NULL),
    al AS (SELECT mix_id, sec, track, 1 AS priority FROM src WHERE priority = 1 UNION ALL SELECT mix_id, sec, track, 2 FROM de JOIN ok USING (mix_id) UNION ALL SELECT mix_id, sec, track, 3 FROM kept JOIN co USING (mix_id, sec)),
    b AS (SELECT mix_id, min(priority) AS p FROM al GROUP BY 1) SELECT al.mix_id, sec, track, priority FROM al JOIN b ON b.mix_id = al.mix_id AND priority = p""",
)
def k14(spark, d):
    """Chapters before a valid description before comments: the first that a mix has."""
    e = V.mix_text(spark, d).withColumn("kind", F.split("text", " ")[1])
    chapters = (F.col("kind") == "purchase") & (F.col("mix_id") % 5 == 0)
    source = F.when(chapters, "chapters").when(F.col("kind").isin("signup", "error"), "description").otherwise("comments")
    track = F.concat("kind", F.repeat(F.lit("!"), F.col("like_count") % 7))
    lines = e.select("mix_id", source.alias("source"), S.seconds_to_timestamp(F.col("frame_idx") * 20).alias("time"), track.alias("track"))
    return TR.timestamps(lines).select("mix_id", "sec", "track", "priority")


STARTS_SQL = "starts AS (SELECT track_id, p AS point, CASE p WHEN 0 THEN max(t_sec) * 0.37 ELSE 0 END AS t FROM v_frames, (SELECT CAST(unnest([0, 1]) AS INT) AS p) GROUP BY track_id, p)"
_STATE = ("section", "energy", "trend", "history_mean", "oldest")


@query("J10_training_examples", f"WITH {STARTS_SQL}, {SQ.state_sql('starts')}, n AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT t.transition_id, t.technique, t.quality_score AS quality, {', '.join(f'{x}.{c} AS {c}_{x}' for x in 'ab' for c in _STATE)}, b.energy - a.energy AS energy_delta FROM v_transitions t, n JOIN st a ON a.track_id = t.track_a_id % n.n AND a.point = 0 JOIN st b ON b.track_id = t.track_b_id % n.n AND b.point = 1")
def j10(spark, d):
    """Every transition with the state of the outgoing track where it leaves and of the incoming track at its start."""
    frames = V.frames(spark, d)
    ends = frames.groupBy("track_id").agg(F.max("t_sec").alias("end"))
    starts = ends.select("track_id", F.explode(F.array(F.struct(F.lit(0).alias("point"), (F.col("end") * 0.37).alias("t")), F.struct(F.lit(1).alias("point"), F.lit(0.0).alias("t")))).alias("e")).select("track_id", "e.*")
    states = SQ.song_states(starts, frames, SQ.sections(spark, d)).select("track_id", "point", F.struct("section", "energy", "trend", *SQ.history_columns()).alias("state"))
    n = ends.count()
    side = lambda x, p: states.where(F.col("point") == p).select(F.col("track_id").alias(f"t_{x}"), F.col("state").alias(x))
    t = V.transitions(spark, d).withColumns({"t_a": F.col("track_a_id") % n, "t_b": F.col("track_b_id") % n})
    e = t.join(side("a", 0), "t_a").join(side("b", 1), "t_b")
    example = e.select("transition_id", F.struct("a", "b", (F.col("b.energy") - F.col("a.energy")).alias("energy_delta")).alias("input_features"), F.struct("technique").alias("output_labels"), F.struct(F.col("quality_score").alias("overall")).alias("quality_labels"))
    own = [F.col(f"input_features.{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in _STATE]
    return example.select("transition_id", "output_labels.technique", F.col("quality_labels.overall").alias("quality"), *own, "input_features.energy_delta")


HYBRID_SQL = f"""{CHAIN_SQL}, n AS (SELECT mix_id, tech, row_number() OVER (PARTITION BY mix_id ORDER BY transition_id) - 1 AS k FROM t), pre AS (SELECT mix_id, k // 4 AS part, k % 4 AS i, tech, 1.0 / (1 + k % 4) AS weight FROM n)"""


@query("J17_hybrid_presets", f"WITH {PAIR_FIT_SQL}, {HYBRID_SQL}, fits AS (SELECT a.mix_id, a.part, avg(score) AS fit FROM pre a JOIN pre b ON a.mix_id = b.mix_id AND a.part = b.part AND a.i < b.i JOIN fit ON tech_a = a.tech AND tech_b = b.tech GROUP BY ALL), k AS (SELECT mix_id, part, sum(weight * complexity) / sum(weight) AS complexity, sum(weight * boldness) / sum(weight) AS boldness FROM pre JOIN prof ON name = tech GROUP BY ALL) SELECT mix_id, part, fit, complexity, boldness, fit >= 0.3 AS kept FROM fits JOIN k USING (mix_id, part)")
def j17(spark, d):
    """Four techniques in a row of a mix as a hybrid, the earlier the heavier: six pairs each, whatever a mix holds."""
    k = F.row_number().over(Window.partitionBy("mix_id").orderBy("transition_id")) - 1
    members = technique_chain(spark, d).select("mix_id", F.floor(k / 4).alias("part"), (k % 4).alias("i"), F.col("tech_b").alias("technique"), (1.0 / (1 + k % 4)).alias("weight"))
    return dims.hybrids(members, ["mix_id", "part"]).select("mix_id", "part", "fit", "complexity", "boldness", (F.col("fit") >= 0.3).alias("kept"))


TRANS_TECH = [t[0] for t in dims.PROFILES]


@query("J21_technique_path", f"WITH {PAIR_FIT_SQL}, t AS (SELECT transition_id, {TRANS_TECH}[CAST(transition_id % 17 + 1 AS INT)] AS s, {TRANS_TECH}[CAST((transition_id * 5 + 3) % 17 + 1 AS INT)] AS e FROM v_transitions) SELECT transition_id, s AS start, e AS finish, CASE WHEN score > 0.4 THEN NULL ELSE (SELECT m.name FROM prof m WHERE list_contains(a.likes, m.name) AND list_contains(b.likes, m.name) ORDER BY m.complexity, m.name LIMIT 1) END AS bridge FROM t JOIN fit ON tech_a = s AND tech_b = e JOIN prof a ON a.name = s JOIN prof b ON b.name = e")
def j21(spark, d):
    """A bridge for incompatible techniques: the least complex one that both go with, by name on ties."""
    at = lambda i: F.element_at(F.array(*map(F.lit, TRANS_TECH)), (i % 17 + 1).cast("int"))
    t = V.transitions(spark, d).select("transition_id", at(F.col("transition_id")).alias("tech_a"), at(F.col("transition_id") * 5 + 3).alias("tech_b"))
    p = dims.profiles(spark)
    likes = lambda x: F.broadcast(p.select(F.col("technique").alias(f"tech_{x}"), F.col("likes").alias(f"likes_{x}")))
    price = F.create_map(*(F.lit(v) for row in dims.PROFILES for v in (row[0], row[3])))
    j = t.join(F.broadcast(dims.technique_pairs(spark)), ["tech_a", "tech_b"]).join(likes("a"), "tech_a").join(likes("b"), "tech_b")
    common = F.array_sort(F.transform(F.array_intersect("likes_a", "likes_b"), lambda n: F.struct(F.try_element_at(price, n).alias("c"), n.alias("n"))))
    return j.select("transition_id", F.col("tech_a").alias("start"), F.col("tech_b").alias("finish"), F.when(F.col("score") <= 0.4, F.get(common, F.lit(0))["n"]).alias("bridge"))


_FIT = f"(list_position({[*V.NAMES]}, key_incoming) - list_position({[*V.NAMES]}, key_outgoing) + 12) % 12 IN (0,3,4,5,7,8,9)"
VECTOR_SQL = f"""vec AS (SELECT order_id, part_id, (tempo_outgoing - 60) / 120 AS f0, (tempo_incoming - 60) / 120 AS f1, energy_before AS f2, energy_after AS f3, CASE WHEN {_FIT} THEN 1.0 ELSE 0.0 END AS f4, harmonic_tension AS f5, perceived_smoothness AS f6, 0.1 AS f7,
    abs(energy_after - energy_before) AS f8, abs(tempo_outgoing - tempo_incoming) / 120 AS f9, 0.5 AS f10, CASE WHEN energy_after > energy_before THEN 1.0 ELSE 0.0 END AS f11, CASE WHEN energy_after < energy_before THEN 1.0 ELSE 0.0 END AS f12,
    list_position({[*V.NAMES]}, key_outgoing) - 1 AS key_a, list_position({[*V.NAMES]}, key_incoming) - 1 AS key_b FROM v_samples)"""


@query("F26_feature_vector", f"WITH {VECTOR_SQL} SELECT order_id, part_id, key_a, key_b, {', '.join(f'f{i}::DOUBLE AS f{i}' for i in range(13))} FROM vec")
def f26(spark, d):
    s = V.samples(spark, d).withColumnRenamed("perceived_smoothness", "spectral_smoothness")
    fit = F.pmod(H.key_index(F.col("key_incoming")) - H.key_index(F.col("key_outgoing")), F.lit(12)).isin(*H.CONSONANT)
    s = s.withColumns({"key_compatible": fit, "energy_build": F.col("energy_after") > F.col("energy_before"), "energy_dip": F.col("energy_after") < F.col("energy_before")})
    v = T.feature_vector(s)
    return s.select("order_id", "part_id", T.key_place(F.col("key_outgoing")).alias("key_a"), T.key_place(F.col("key_incoming")).alias("key_b"), v.alias("v")).select("order_id", "part_id", "key_a", "key_b", *(F.col("v")[i].alias(f"f{i}") for i in range(13)))


@query("F27_target_labels", "SELECT crossfade_type, CASE crossfade_type WHEN 'cut' THEN 0 WHEN 'linear' THEN 1 WHEN 'blend' THEN 1 WHEN 'drop' THEN 2 ELSE 0 END AS technique, bass_swap_detected AS bass_swap, harmonic_tension > 0.04 AS low_cut, perceived_smoothness > 0.95 AS high_cut, coalesce(bars_duration, 5)::DOUBLE AS duration, count(*) AS n FROM v_samples GROUP BY ALL")
def f27(spark, d):
    said = lambda c: F.when(c, "True").otherwise("False")
    s = V.samples(spark, d).withColumns({"low_cut_on_incoming": said(F.col("harmonic_tension") > 0.04), "high_cut_on_outgoing": said(F.col("perceived_smoothness") > 0.95)})
    return s.select("crossfade_type", *(c.alias(n) for n, c in T.target_labels().items())).groupBy("crossfade_type", "technique", "bass_swap", "low_cut", "high_cut", "duration").agg(F.count("*").alias("n"))


LABEL_SQL = """lab AS (SELECT pair_id, greatest(0, 1 - abs(bpm_a - bpm_b) / 20) AS beat_match, abs(energy_a - energy_b) / 12 AS harmonic_clash, CASE WHEN vocals_a AND vocals_b THEN 0.8 WHEN vocals_a OR vocals_b THEN 0.3 ELSE 0.0 END AS vocal_clash,
    least(duration_a, duration_b) / greatest(duration_a, duration_b) AS energy_flow, 1 - abs(bpm_a - bpm_b) / 100 AS spectral_balance, energy_b - energy_a AS energy_delta FROM v_pairs)"""


@query("F31_quality_labels", f"WITH {LABEL_SQL} SELECT pair_id, (beat_match * 0.3 + (1 - harmonic_clash) * 0.2 + (1 - vocal_clash) * 0.2 + energy_flow * 0.15 + spectral_balance * 0.15)::DOUBLE AS overall, beat_match < 0.7 AS beat_mismatch, harmonic_clash > 0.3 AS clash, vocal_clash > 0.5 AS vocal_overlap, energy_delta < -0.3 AS energy_drop, spectral_balance < 0.6 AS spectral_mud FROM lab")
def f31(spark, d):
    off = F.abs(F.col("bpm_a") - F.col("bpm_b"))
    p = V.pairs(spark, d).select(
        "pair_id", F.greatest(F.lit(0.0), 1 - off / 20).alias("beat_match"), (F.abs(F.col("energy_a") - F.col("energy_b")) / 12).alias("harmonic_clash"), F.when(F.col("vocals_a") & F.col("vocals_b"), 0.8).when(F.col("vocals_a") | F.col("vocals_b"), 0.3).otherwise(0.0).alias("vocal_clash"),
        (F.least("duration_a", "duration_b") / F.greatest("duration_a", "duration_b")).alias("energy_flow"), (1 - off / 100).alias("spectral_balance"), (F.col("energy_b") - F.col("energy_a")).alias("energy_delta"),
    )
    labels = T.quality_labels()
    modes = labels["failure_modes"]
    return p.select("pair_id", labels["overall"].alias("overall"), modes["beat_mismatch"].alias("beat_mismatch"), modes["harmonic_clash"].alias("clash"), modes["vocal_overlap"].alias("vocal_overlap"), modes["energy_drop"].alias("energy_drop"), modes["spectral_mud"].alias("spectral_mud"))


FADE_SQL = "fd AS (SELECT pair_id, CASE WHEN abs(bpm_a - bpm_b) < 8 THEN 'smooth' WHEN abs(bpm_a - bpm_b) < 20 THEN 'linear' ELSE 'fast' END AS shape, 8 + CAST(duration_a AS INT) // 5 % 9 AS points FROM v_pairs), fp AS (SELECT *, CAST(unnest(range(points)) AS INT) AS i FROM fd), ft AS (SELECT *, i / (points - 1) AS t FROM fp)"


@query(
    "F36_fade_curves",
    f"""WITH {FADE_SQL} SELECT pair_id, shape, i, CASE shape WHEN 'linear' THEN sqrt(1 - t) WHEN 'smooth' THEN sqrt(0.5 * (1 + cos(pi() * t))) ELSE (1 - t) * (1 - t) END AS out_gain,
    CASE shape WHEN 'linear' THEN sqrt(t) WHEN 'smooth' THEN sqrt(0.5 * (1 - cos(pi() * t))) ELSE sqrt(greatest(0, 1 - pow(1 - t, 4))) END AS in_gain FROM ft""",
)
def f36(spark, d):
    """Equal-power fades by the shape and the number of points of each plan: the farther the tempos, the faster."""
    off = F.abs(F.col("bpm_a") - F.col("bpm_b"))
    plan = V.pairs(spark, d).select("pair_id", F.when(off < 8, "smooth").when(off < 20, "linear").otherwise("fast").alias("shape"), (8 + F.floor(F.col("duration_a").cast("int") / 5).cast("int") % 9).alias("points"))
    return T.equal_power(plan).select("pair_id", "shape", "i", "out_gain", "in_gain")


@query("F37_curve_resample", "WITH c AS (SELECT mix_id, bar_idx, features AS v FROM v_bars), p AS (SELECT *, i * 28 / 9.0 AS x FROM c, (SELECT CAST(unnest(range(10)) AS INT) AS i)) SELECT mix_id, bar_idx, i, round(v[CAST(floor(x) AS INT) + 1] + (v[least(CAST(floor(x) AS INT) + 2, 29)] - v[CAST(floor(x) AS INT) + 1]) * (x - floor(x)), 6) AS v FROM p")
def f37(spark, d):
    """29 points to 10 by linear interpolation."""
    x = F.col("i") * 28 / 9.0
    lo = F.floor(x).cast("int")
    p = V.bars(spark, d).select("mix_id", "bar_idx", "features", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    a, b = F.element_at("features", lo + 1), F.element_at("features", F.least(lo + 2, F.lit(29)))
    return p.select("mix_id", "bar_idx", "i", r6(a + (b - a) * (x - lo)).alias("v"))


@query(
    "F42_bass_swap_curves",
    """WITH p AS (SELECT pair_id, least(0.8, greatest(0.2, energy_a / nullif(energy_a + energy_b, 0)))::DOUBLE AS s, i, i / 20.0::DOUBLE AS t FROM v_pairs, (SELECT CAST(unnest(range(21)) AS INT) AS i))
    SELECT pair_id, i, greatest(0.1, CASE WHEN t < s THEN 1 - t / s * 0.5 ELSE 0.5 * (1 - (t - s) / (1 - s)) END) AS bass_a, CASE WHEN t < s THEN 0.3 + 0.2 * t / s ELSE 0.5 + 0.5 * (t - s) / (1 - s) END AS bass_b, 200 * t AS high_pass FROM p""",
)
def f42(spark, d):
    """The bass goes over where the outgoing track's share of the energy lies."""
    share = F.least(F.lit(0.8), F.greatest(F.lit(0.2), F.try_divide(F.col("energy_a"), F.col("energy_a") + F.col("energy_b"))))
    return T.bass_swap(V.pairs(spark, d).select("pair_id", share.cast("double").alias("swap")), 21)


@query("A27_harmonic_tension", "WITH p AS (SELECT label, CASE WHEN track_id % 3 = 0 THEN 'before' WHEN track_id % 3 = 1 THEN 'during' ELSE 'after' END AS phase, pc, avg(value) AS v FROM v_chroma GROUP BY ALL), c AS (SELECT a.label, b.phase, sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) AS c FROM p a JOIN p b ON a.label = b.label AND a.pc = b.pc AND a.phase = 'during' AND b.phase <> 'during' GROUP BY ALL) SELECT label, round(1 - max(c), 6) AS tension FROM c GROUP BY label")
def a27(spark, d):
    third = F.col("track_id") % 3
    p = V.chroma(spark, d).groupBy("label", F.when(third == 0, "before").when(third == 1, "during").otherwise("after").alias("phase"), "pc").agg(F.avg("value").alias("v"))
    a = p.where("phase = 'during'").select("label", "pc", F.col("v").alias("x"))
    c = p.where("phase <> 'during'").join(a, ["label", "pc"]).groupBy("label", "phase").agg(F.try_divide(F.sum(F.col("v") * F.col("x")), F.sqrt(F.sum(F.col("v") ** 2) * F.sum(F.col("x") ** 2))).alias("c"))
    return c.groupBy("label").agg(r6(F.coalesce(1 - F.max("c"), F.lit(0.5))).alias("tension"))


@query(
    "A31_crossfade_slope",
    """WITH f AS (SELECT track_id, frame_idx, 20 * log10(rms + 1e-6) AS db, frame_idx < (max(frame_idx) OVER (PARTITION BY track_id)) // 2 AS early FROM v_frames), s AS (SELECT track_id, regr_slope(db, frame_idx) FILTER (WHERE early) AS b, regr_slope(db, frame_idx) FILTER (WHERE NOT early) AS a, count(*) FILTER (WHERE early) AS nb, count(*) FILTER (WHERE NOT early) AS na FROM f GROUP BY 1)
    SELECT track_id, b AS before, a AS after, CASE WHEN nb > 10 AND na > 10 THEN CASE WHEN abs(b) < 0.1 AND abs(a) < 0.1 THEN 'cut' WHEN b < -0.2 AND a > 0.1 THEN 's_curve' WHEN b < -0.5 THEN 'exponential_out' ELSE 'linear' END ELSE 'linear' END AS kind FROM s""",
)
def a31(spark, d):
    """Slopes of the level before and after the middle of each track."""
    early = F.col("frame_idx") < F.floor(F.max("frame_idx").over(Window.partitionBy("track_id")) / 2)
    f = V.frames(spark, d).select("track_id", "frame_idx", (20 * F.log10(F.col("rms") + 1e-6)).alias("db"), early.alias("early"))
    slope = lambda c: F.regr_slope(F.when(c, F.col("db")), F.when(c, F.col("frame_idx")))
    s = f.groupBy("track_id").agg(slope(F.col("early")).alias("before"), slope(~F.col("early")).alias("after"), F.count_if("early").alias("nb"), F.count_if(~F.col("early")).alias("na"))
    b, a = F.col("before"), F.col("after")
    kind = F.when((F.abs(b) < 0.1) & (F.abs(a) < 0.1), "cut").when((b < -0.2) & (a > 0.1), "s_curve").when(b < -0.5, "exponential_out").otherwise("linear")
    return s.select("track_id", "before", "after", F.when((F.col("nb") > 10) & (F.col("na") > 10), kind).otherwise("linear").alias("kind"))


@query("A30_bass_swap_point", "SELECT track_id, min_by(frame_idx, (rms, frame_idx)) AS at, round(min(rms) / max(rms), 6) AS depth, min(rms) < 0.7 * max(rms) AS swap FROM v_frames GROUP BY track_id HAVING max(rms) > 0")
def a30(spark, d):
    g = V.frames(spark, d).groupBy("track_id").agg(F.min_by("frame_idx", F.struct("rms", "frame_idx")).alias("at"), F.min("rms").alias("lo"), F.max("rms").alias("hi")).where("hi > 0")
    return g.select("track_id", "at", r6(F.col("lo") / F.col("hi")).alias("depth"), (F.col("lo") < 0.7 * F.col("hi")).alias("swap"))


NINE_SQL = """nf AS (SELECT track_id, frame_idx, rms / (max(rms) OVER w + 1e-8) AS rms, bass / (max(bass) OVER w + 1e-8) AS bass, mid / (max(mid) OVER w + 1e-8) AS mid, count(*) OVER w AS n FROM v_frames WINDOW w AS (PARTITION BY track_id)),
    nine AS (SELECT * FROM nf WHERE frame_idx IN (SELECT unnest([floor(i * (n - 1) / (least(9, n) - 1))::BIGINT for i in range(least(9, n))])))"""


@query("A33_transition_quality", f"WITH {NINE_SQL}, iv AS (SELECT track_id, t_sec - lag(t_sec) OVER (PARTITION BY track_id ORDER BY beat_idx) AS iv FROM v_beats), bt AS (SELECT track_id, CASE WHEN count(*) <= 4 THEN 0.5 ELSE greatest(0, least(1, 1 - stddev_pop(iv) / avg(iv))) END AS beat FROM iv GROUP BY track_id), q AS (SELECT track_id, greatest(0, least(1, 1 - avg(d))) AS smooth, count(*) AS points, 1 - avg(bass * mid) AS balance FROM (SELECT *, abs(rms - lag(rms) OVER (PARTITION BY track_id ORDER BY frame_idx)) AS d FROM nine) GROUP BY track_id) SELECT track_id, CASE WHEN points > 2 THEN smooth ELSE 0.5 END::DOUBLE AS smoothness, balance, beat::DOUBLE AS beat, 0.4 * beat + 0.3 * CASE WHEN points > 2 THEN smooth ELSE 0.5 END + 0.3 * balance AS overall FROM q JOIN bt USING (track_id)")
def a33(spark, d):
    """Energy, bass and mids over each track's own maximum at nine points from its first to its last frame."""
    whole = Window.partitionBy("track_id")
    f = V.frames(spark, d).select("track_id", "frame_idx", *((F.col(c) / (F.max(c).over(whole) + 1e-8)).alias(c) for c in ("rms", "bass", "mid")), F.count("*").over(whole).alias("n"))
    points = F.least(F.lit(9), F.col("n"))
    at = F.transform(F.sequence(F.lit(0), points - 1), lambda i: F.when(points > 1, F.floor(i * (F.col("n") - 1) / (points - 1))).otherwise(F.lit(0)))
    nine = f.where(F.array_contains(at, F.col("frame_idx"))).withColumn("d", F.abs(F.col("rms") - F.lag("rms").over(Window.partitionBy("track_id").orderBy("frame_idx"))))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    q = nine.groupBy("track_id").agg(F.when(F.count("*") > 2, unit(1 - F.avg("d"))).otherwise(0.5).alias("smoothness"), (1 - F.avg(F.col("bass") * F.col("mid"))).alias("balance"))
    gap = F.col("t_sec") - F.lag("t_sec").over(Window.partitionBy("track_id").orderBy("beat_idx"))
    beat = V.beats(spark, d).select("track_id", gap.alias("iv")).groupBy("track_id").agg(F.when(F.count("*") <= 4, 0.5).otherwise(unit(1 - F.stddev_pop("iv") / F.avg("iv"))).alias("beat"))
    return q.join(beat, "track_id").select("track_id", "smoothness", "balance", "beat", (0.4 * F.col("beat") + 0.3 * F.col("smoothness") + 0.3 * F.col("balance")).alias("overall"))


@query("W16_label_sections", "WITH p AS (SELECT track_id, frame_idx // 8 AS k, avg(rms) AS e, count(*) AS n FROM v_frames GROUP BY ALL HAVING count(*) = 8), q AS (SELECT *, max(k) OVER (PARTITION BY track_id) AS last FROM p), t AS (SELECT track_id, quantile_cont(e, 0.75) AS p75, count(*) AS m FROM q WHERE k >= 2 GROUP BY 1), l AS (SELECT q.*, CASE WHEN k < 2 THEN 'intro' WHEN k > last - 2 THEN 'outro' WHEN m > 4 AND e > p75 THEN 'chorus' ELSE 'verse' END AS label FROM q LEFT JOIN t USING (track_id)), i AS (SELECT *, k - row_number() OVER (PARTITION BY track_id, label ORDER BY k) AS g FROM l) SELECT track_id, label, min(k) AS first, max(k) AS last FROM i GROUP BY track_id, label, g")
def w16(spark, d):
    """Runs of phrases of one label: intro, outro, chorus over the 75th percentile of the rest, verse."""
    p = V.frames(spark, d).groupBy("track_id", F.floor(F.col("frame_idx") / 8).alias("k")).agg(F.avg("rms").alias("e"), F.count("*").alias("n")).where("n = 8")
    t = p.where("k >= 2").groupBy("track_id").agg(F.percentile("e", 0.75).alias("p75"), F.count("*").alias("m"))
    q = p.join(t, "track_id", "left").withColumn("end", F.max("k").over(Window.partitionBy("track_id")))
    label = F.when(F.col("k") < 2, "intro").when(F.col("k") > F.col("end") - 2, "outro").when((F.col("m") > 4) & (F.col("e") > F.col("p75")), "chorus").otherwise("verse")
    i = q.withColumn("label", label).withColumn("g", F.col("k") - F.row_number().over(Window.partitionBy("track_id", "label").orderBy("k")))
    return i.groupBy("track_id", "label", "g").agg(F.min("k").alias("first"), F.max("k").alias("last")).drop("g")
