"""Queries of series and as-of operators (W*, J4-J9, A9, A14-A16, A20, A26, A32, A35)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seguekit.operators import asof as AO
from seguekit.operators import blocks as BL
from seguekit.operators import series as SE
from seguekit.plans import views as V
from seguekit.plans.registry import query

r6 = lambda c: F.round(c, 6)


def points(spark, d):
    """Two odd times per track, for as-of joins."""
    t = V.frames(spark, d).groupBy("track_id").agg(F.max("t_sec").alias("end"))
    return t.select("track_id", F.explode(F.array(F.struct(F.lit(0).alias("point"), (F.col("end") * 0.37).alias("t")), F.struct(F.lit(1).alias("point"), (F.col("end") + 5).alias("t")))).alias("e")).select("track_id", "e.point", "e.t")


POINTS_SQL = "pts AS (SELECT track_id, p AS point, CASE p WHEN 0 THEN max(t_sec) * 0.37 ELSE max(t_sec) + 5 END AS t FROM v_frames, (SELECT CAST(unnest([0, 1]) AS INT) AS p) GROUP BY track_id, p)"


@query("J4_nearest_beat", f"WITH {POINTS_SQL}, r AS (SELECT p.track_id, p.point, b.t_sec AS near_t, b.onset_strength AS near_v, abs(p.t - b.t_sec) AS gap, row_number() OVER (PARTITION BY p.track_id, p.point ORDER BY abs(p.t - b.t_sec), b.t_sec) AS r FROM pts p JOIN v_beats b USING (track_id)) SELECT track_id, point, round(near_t, 6) AS near_t, round(gap, 6) AS gap, gap < 0.05 AS aligned FROM r WHERE r = 1")
def j4(spark, d):
    n = AO.nearest(points(spark, d), V.beats(spark, d), "track_id", "point", "t_sec", "onset_strength")
    return n.select("track_id", "point", r6("near_t").alias("near_t"), r6("gap").alias("gap"), (F.col("gap") < 0.05).alias("aligned"))


@query("J5_downbeat_snap", f"WITH {POINTS_SQL}, r AS (SELECT p.track_id, p.point, b.beat_idx, row_number() OVER (PARTITION BY p.track_id, p.point ORDER BY abs(p.t - b.t_sec), b.t_sec) AS r FROM pts p JOIN v_beats b USING (track_id)) SELECT r.track_id, r.point, b.beat_idx, round(b.t_sec, 6) AS t_sec FROM r JOIN v_beats b ON b.track_id = r.track_id AND b.beat_idx = r.beat_idx // 4 * 4 WHERE r = 1")
def j5(spark, d):
    b = V.beats(spark, d)
    n = AO.nearest(points(spark, d), b, "track_id", "point", "t_sec", "beat_idx").select("track_id", "point", (F.floor(F.col("near_v") / 4) * 4).alias("beat_idx"))
    return n.join(b, ["track_id", "beat_idx"]).select("track_id", "point", "beat_idx", r6("t_sec").alias("t_sec"))


def sections(spark, d):
    """Sections of 10 frames with a gap after each third."""
    f = V.frames(spark, d).withColumn("idx", F.floor(F.col("frame_idx") / 10))
    g = f.groupBy("track_id", "idx").agg(F.min("t_sec").alias("start_sec"), F.max("kind").alias("type"))
    return g.withColumn("end_sec", F.col("start_sec") + F.when(F.col("idx") % 3 == 2, 1.0).otherwise(2.5))


SECTIONS_SQL = "sec AS (SELECT track_id, frame_idx // 10 AS idx, min(t_sec) AS start_sec, max(kind) AS type, min(t_sec) + CASE WHEN frame_idx // 10 % 3 = 2 THEN 1.0 ELSE 2.5 END AS end_sec FROM v_frames GROUP BY track_id, frame_idx // 10)"


@query("J6_section_at", f"WITH {POINTS_SQL}, {SECTIONS_SQL} SELECT p.track_id, p.point, min(s.idx) AS idx, min_by(s.type, s.idx) AS type FROM pts p LEFT JOIN sec s ON s.track_id = p.track_id AND p.t >= s.start_sec AND p.t < s.end_sec GROUP BY ALL")
def j6(spark, d):
    return AO.in_interval(points(spark, d), sections(spark, d), "track_id", "point").select("track_id", "point", "idx", "type")


@query("J7_track_at", f"WITH {POINTS_SQL}, {SECTIONS_SQL} SELECT p.track_id, p.point, min(s.idx) AS idx FROM pts p LEFT JOIN sec s ON s.track_id = p.track_id AND p.t >= s.start_sec AND p.t <= s.end_sec GROUP BY ALL")
def j7(spark, d):
    return AO.in_interval(points(spark, d), sections(spark, d), "track_id", "point", closed=True).select("track_id", "point", "idx")


VALUE_AT = "(SELECT p.track_id, p.point, p.t, arg_max(f.rms, f.t_sec) FILTER (WHERE f.t_sec <= p.t) AS v0, max(f.t_sec) FILTER (WHERE f.t_sec <= p.t) AS t0, arg_min(f.rms, f.t_sec) FILTER (WHERE f.t_sec >= p.t) AS v1, min(f.t_sec) FILTER (WHERE f.t_sec >= p.t) AS t1 FROM pts p JOIN v_frames f USING (track_id) GROUP BY ALL)"


@query("J8_value_at", f"WITH {POINTS_SQL} SELECT track_id, point, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS rms FROM {VALUE_AT}")
def j8(spark, d):
    return AO.interpolate(points(spark, d), V.frames(spark, d), "track_id", "point", "t_sec", "rms").select("track_id", "point", r6("rms").alias("rms"))


def state_sql(points_view):
    """Section, energy, trend and history of 32 bars at the points of a view (track_id, point, t)."""
    value = VALUE_AT.replace("FROM pts p", f"FROM {points_view} p")
    return f"""{SECTIONS_SQL}, sa AS (SELECT p.track_id, p.point, min_by(s.type, s.idx) AS section FROM {points_view} p LEFT JOIN sec s ON s.track_id = p.track_id AND p.t >= s.start_sec AND p.t < s.end_sec GROUP BY ALL),
    tr AS (SELECT p.track_id, p.point, (arg_max(f.rms, f.t_sec) - arg_min(f.rms, f.t_sec)) / count(*) AS slope FROM {points_view} p JOIN v_frames f ON f.track_id = p.track_id AND f.t_sec BETWEEN p.t - 10 AND p.t GROUP BY ALL),
    hq AS (SELECT track_id, point, i, t - i * 2.0 AS t FROM {points_view}, (SELECT CAST(unnest(range(32)) AS INT) AS i)), hv AS (SELECT q.track_id, q.point, q.i, arg_max(f.rms, f.t_sec) AS v FROM hq q ASOF JOIN v_frames f ON f.track_id = q.track_id AND q.t >= f.t_sec GROUP BY ALL),
    hi AS (SELECT q.track_id, q.point, avg(coalesce(v, 0.5)) AS mean, arg_max(coalesce(v, 0.5), q.i) AS oldest FROM hq q LEFT JOIN hv USING (track_id, point, i) GROUP BY ALL),
    st AS (SELECT sa.track_id, sa.point, coalesce(section, 'unknown') AS section, coalesce(nullif(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 0), 0.5) AS energy,
      CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS trend, mean AS history_mean, oldest FROM sa JOIN {value} v USING (track_id, point) JOIN hi USING (track_id, point) LEFT JOIN tr USING (track_id, point))"""


def song_states(p, frames, intervals):
    """(track_id, point, section, energy, trend, history) of tracks at points; an energy of exactly 0 counts as unknown, 0.5."""
    at = AO.in_interval(p, intervals, "track_id", "point").select("track_id", "point", F.coalesce("type", F.lit("unknown")).alias("section"))
    value = AO.interpolate(p, frames, "track_id", "point", "t_sec", "rms").select("track_id", "point", F.coalesce(F.nullif("rms", F.lit(0.0)), F.lit(0.5)).alias("energy"))
    trend = energy_trend(p, frames).select("track_id", "point", "trend")
    whole = at.join(value, ["track_id", "point"]).join(bar_history(p, frames), ["track_id", "point"]).join(trend, ["track_id", "point"], "left")
    return whole.withColumn("trend", F.coalesce("trend", F.lit("stable")))


def history_columns():
    return (F.aggregate("history", F.lit(0.0), lambda a, x: a + x) / 32).alias("history_mean"), F.get("history", F.lit(0)).alias("oldest")


@query("J9_song_state_at", f"WITH {POINTS_SQL}, {state_sql('pts')} SELECT * FROM st")
def j9(spark, d):
    s = song_states(points(spark, d), V.frames(spark, d), sections(spark, d))
    return s.select("track_id", "point", "section", "energy", "trend", *history_columns())


@query("W1_bars_from_beats", "SELECT track_id, beat_idx // 4 AS bar_idx, round(t_sec, 6) AS start_sec, round(e, 6) AS end_sec FROM (SELECT *, lead(t_sec, 4) OVER (PARTITION BY track_id ORDER BY beat_idx) AS e FROM v_beats) WHERE beat_idx % 4 = 0 AND e IS NOT NULL")
def w1(spark, d):
    return SE.bars_from_beats(V.beats(spark, d)).withColumns({"start_sec": r6("start_sec"), "end_sec": r6("end_sec")})


@query("W2_energy_trend", f"WITH {POINTS_SQL}, t AS (SELECT p.track_id, p.point, (arg_max(f.rms, f.t_sec) - arg_min(f.rms, f.t_sec)) / count(*) AS slope FROM pts p JOIN v_frames f ON f.track_id = p.track_id AND f.t_sec BETWEEN p.t - 10 AND p.t GROUP BY ALL) SELECT track_id, point, round(slope, 6) AS slope, CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS trend FROM t")
def w2(spark, d):
    return energy_trend(points(spark, d), V.frames(spark, d)).select("track_id", "point", r6("slope").alias("slope"), "trend")


def energy_trend(p, frames):
    """(track_id, point, slope, trend) over the 10 s before each point."""
    f = AO.around(p, frames, "track_id", "t_sec", 10, 0)
    t = f.groupBy("track_id", "point").agg(((F.max_by("rms", "t_sec") - F.min_by("rms", "t_sec")) / F.count("*")).alias("slope"))
    return t.withColumn("trend", F.when(F.col("slope") > 0.01, "increasing").when(F.col("slope") < -0.01, "decreasing").otherwise("stable"))


@query("W3_bar_history", f"WITH {POINTS_SQL}, q AS (SELECT track_id, point, i, t - i * 2.0 AS t FROM pts, (SELECT CAST(unnest(range(32)) AS INT) AS i)), v AS (SELECT q.track_id, q.point, q.i, arg_max(f.rms, f.t_sec) AS v FROM q ASOF JOIN v_frames f ON f.track_id = q.track_id AND q.t >= f.t_sec GROUP BY ALL) SELECT q.track_id, q.point, avg(coalesce(v, 0.5)) AS mean, arg_max(coalesce(v, 0.5), q.i) AS oldest FROM q LEFT JOIN v USING (track_id, point, i) GROUP BY ALL")
def w3(spark, d):
    """32 values at bars of 2 s before each point, oldest first; 0.5 before the track begins."""
    h = bar_history(points(spark, d), V.frames(spark, d))
    return h.select("track_id", "point", (F.aggregate("history", F.lit(0.0), lambda a, x: a + x) / 32).alias("mean"), F.get("history", F.lit(0)).alias("oldest"))


def bar_history(p, frames):
    """(track_id, point, history): the 32 values."""
    at = p.select("track_id", "point", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("t") - i * 2.0)).alias("i", "t")).withColumn("p", F.col("point") * 32 + F.col("i"))
    n = AO.neighbours(at, frames, "track_id", "p", "t_sec", "rms")
    v = n.select("track_id", F.floor(F.col("p") / 32).cast("int").alias("point"), (F.col("p") % 32).alias("i"), F.coalesce("before_v", F.lit(0.5)).alias("v"))
    return v.groupBy("track_id", "point").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("i")).alias("k"), "v"))), lambda x: x["v"]).alias("history"))


@query("W4_local_gap", "SELECT track_id, frame_idx, rms FROM (SELECT *, min(rms) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m, min(rms) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b, count(*) OVER (PARTITION BY track_id) AS n FROM v_frames WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)) WHERE rms = m AND b > rms AND frame_idx >= 2 AND frame_idx < n - 2")
def w4(spark, d):
    return SE.local_gaps(V.frames(spark, d), "track_id", "frame_idx", "rms", 2).select("track_id", "frame_idx", "rms")


@query("W5_smooth_moving", "SELECT track_id, frame_idx, round(sum(rms) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM v_frames")
def w5(spark, d):
    return V.frames(spark, d).select("track_id", "frame_idx", r6(SE.moving_average("rms", "track_id", "frame_idx", 5)).alias("smooth"))


GAUSS_SQL = """k AS (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS w FROM (SELECT CAST(unnest(range(-4, 5)) AS BIGINT) AS k)),
    x AS (SELECT mix_id, bar_idx, {value} AS x, count(*) OVER (PARTITION BY mix_id) AS n FROM {table}),
    q AS (SELECT mix_id, bar_idx, n, w, ((bar_idx + k) % (2 * n) + 2 * n) % (2 * n) AS m FROM x, k),
    g AS (SELECT q.mix_id, q.bar_idx, sum(w * x.x) AS smooth FROM q JOIN x ON x.mix_id = q.mix_id AND x.bar_idx = CASE WHEN m >= q.n THEN 2 * q.n - 1 - m ELSE m END GROUP BY ALL)"""


@query("W5_smooth_gaussian", f"WITH {GAUSS_SQL.format(value='rms', table='v_bars')} SELECT mix_id, bar_idx, round(smooth, 6) AS smooth FROM g")
def w5g(spark, d):
    return BL.gaussian_smooth(V.bars(spark, d).select("mix_id", "bar_idx", "rms"), "mix_id", "bar_idx", "rms", 1.0).select("mix_id", "bar_idx", r6("smooth").alias("smooth"))


_CD = "coalesce(CASE WHEN {p} IS NULL OR list_dot_product({p}, {p}) = 0 OR list_dot_product(features, features) = 0 THEN 0 ELSE 1 - list_dot_product(features, {p}) / sqrt(list_dot_product({p}, {p}) * list_dot_product(features, features)) END, 0)"
NOVELTY_SQL = f"nov AS (SELECT mix_id, bar_idx, greatest({_CD.format(p='f4')}, {_CD.format(p='f8')}, {_CD.format(p='f16')}) AS novelty FROM (SELECT *, lag(features, 4) OVER w AS f4, lag(features, 8) OVER w AS f8, lag(features, 16) OVER w AS f16 FROM v_bars WINDOW w AS (PARTITION BY mix_id ORDER BY bar_idx)))"


@query("W7_repetition_break", f"WITH {NOVELTY_SQL}, {GAUSS_SQL.format(value='novelty', table='nov')} SELECT mix_id, bar_idx, round((smooth - min(smooth) OVER w) / (max(smooth) OVER w - min(smooth) OVER w), 5) AS score FROM g WINDOW w AS (PARTITION BY mix_id)")
def w7(spark, d):
    n = SE.repetition_break(V.bars(spark, d)).select("mix_id", "bar_idx", "novelty")
    s = BL.gaussian_smooth(n, "mix_id", "bar_idx", "novelty", 1.0)
    return s.select("mix_id", "bar_idx", F.round(SE.min_max("smooth", "mix_id"), 5).alias("score"))


COMPLEX_SQL = "rise AS (SELECT mix_id, bar_idx, CASE WHEN row_number() OVER w > 4 THEN greatest(0, complexity / avg(complexity) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) - 1) ELSE 0 END AS rise FROM v_bars WINDOW w AS (PARTITION BY mix_id ORDER BY bar_idx))"


@query("W8_complexity_change", f"WITH {COMPLEX_SQL} SELECT mix_id, bar_idx, round(coalesce(rise / nullif(max(rise) OVER (PARTITION BY mix_id), 0), 0), 5) AS change FROM rise")
def w8(spark, d):
    return SE.complexity_change(V.bars(spark, d)).select("mix_id", "bar_idx", F.round("change", 5).alias("change"))


VOCAL_SQL = "z AS (SELECT mix_id, bar_idx, CASE WHEN count(x) OVER w >= 2 AND stddev_pop(x) OVER w > 0 THEN abs(x - avg(x) OVER w) / stddev_pop(x) OVER w END AS z FROM (SELECT mix_id, bar_idx, i, features[i] AS x FROM v_bars, (SELECT unnest(range(1, 30)) AS i)) WINDOW w AS (PARTITION BY mix_id, i ORDER BY bar_idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))"


@query("W9_vocal_novelty", f"WITH {VOCAL_SQL} SELECT mix_id, bar_idx, round(coalesce(least(1, avg(z) / 3), 0), 5) AS novelty FROM z GROUP BY ALL")
def w9(spark, d):
    return SE.vocal_novelty(V.bars(spark, d)).withColumn("novelty", F.round("novelty", 5))


BAND_SQL = "bb AS (SELECT mix_id, bar_idx, [abs(x) for x in features[1:4]] AS b, lag([abs(x) for x in features[1:4]], 4) OVER (PARTITION BY mix_id ORDER BY bar_idx) AS p FROM v_bars), cc AS (SELECT *, [coalesce((b[i] - p[i]) / nullif(p[i], 0), 0) for i in [1, 2, 3, 4]] AS c FROM bb), sd AS (SELECT *, coalesce(sqrt(list_avg([(x - list_avg(c)) * (x - list_avg(c)) for x in c])) / CASE WHEN abs(list_sum(b) / list_sum(p) - 1) >= 0.3 THEN 2 ELSE 1 END, 0) AS raw FROM cc)"


INDEP_SQL = BAND_SQL.replace("coalesce(sqrt", "CASE WHEN p IS NULL THEN 0 ELSE coalesce(sqrt").replace("ELSE 1 END, 0) AS raw", "ELSE 1 END, 0) END AS raw") + ", ind AS (SELECT mix_id, bar_idx, coalesce(raw / nullif(max(raw) OVER (PARTITION BY mix_id), 0), 0) AS d FROM sd)"


@query("W10_band_independence", f"WITH {INDEP_SQL} SELECT mix_id, bar_idx, round(coalesce(raw / nullif(max(raw) OVER (PARTITION BY mix_id), 0), 0), 5) AS independence FROM sd")
def w10(spark, d):
    return SE.band_independence(V.bars(spark, d)).withColumn("independence", F.round("independence", 5))


@query("W11_transition_vote", f"WITH {NOVELTY_SQL}, {COMPLEX_SQL}, {VOCAL_SQL}, {INDEP_SQL}, v AS (SELECT mix_id, bar_idx, coalesce(least(1, avg(z) / 3), 0) AS v FROM z GROUP BY ALL), c AS (SELECT mix_id, bar_idx, coalesce(rise / nullif(max(rise) OVER (PARTITION BY mix_id), 0), 0) AS c FROM rise) SELECT mix_id, bar_idx, (2 * novelty + 2 * v + 1.5 * c + d) / 6.5 * CASE bar_idx % 8 WHEN 0 THEN 1.3 WHEN 4 THEN 1.1 ELSE 1.0 END AS vote, concat_ws('+', CASE WHEN novelty > 0.2 THEN 'repetition' END, CASE WHEN v > 0.2 THEN 'vocal' END, CASE WHEN c > 0.2 THEN 'complexity' END, CASE WHEN d > 0.2 THEN 'band' END) AS method, least(bar_idx + 4, max(bar_idx) OVER (PARTITION BY mix_id)) AS end_bar FROM nov JOIN v USING (mix_id, bar_idx) JOIN c USING (mix_id, bar_idx) JOIN ind USING (mix_id, bar_idx)")
def w11(spark, d):
    b = V.bars(spark, d)
    rep, voc, cplx = SE.repetition_break(b).select("mix_id", "bar_idx", "novelty"), SE.vocal_novelty(b).withColumnRenamed("novelty", "v"), SE.complexity_change(b).select("mix_id", "bar_idx", "change")
    j = rep.join(voc, ["mix_id", "bar_idx"]).join(cplx, ["mix_id", "bar_idx"]).join(SE.band_independence(b), ["mix_id", "bar_idx"])
    said = F.concat_ws("+", *(F.when(F.col(c) > 0.2, name) for c, name in (("novelty", "repetition"), ("v", "vocal"), ("change", "complexity"), ("independence", "band"))))
    end = F.least(F.col("bar_idx") + 4, F.max("bar_idx").over(Window.partitionBy("mix_id")))  # votes that are peaks span four bars
    return j.select("mix_id", "bar_idx", SE.transition_vote(F.col("novelty"), F.col("v"), F.col("change"), F.col("independence"), F.col("bar_idx")).alias("vote"), said.alias("method"), end.alias("end_bar"))


@query(
    "W12_min_gap",
    """WITH RECURSIVE e AS (SELECT track_id, t_sec * 40 AS t, rms AS c, row_number() OVER (PARTITION BY track_id ORDER BY t_sec * 40, rms) AS n FROM v_frames), s(track_id, n, t, c, k) AS (SELECT track_id, n, t, c, 0 FROM e WHERE n = 1
    UNION ALL SELECT s.track_id, e.n, CASE WHEN e.t - s.t >= 60 OR e.c > s.c THEN e.t ELSE s.t END, CASE WHEN e.t - s.t >= 60 OR e.c > s.c THEN e.c ELSE s.c END, CASE WHEN e.t - s.t >= 60 THEN s.k + 1 ELSE s.k END FROM s JOIN e ON e.track_id = s.track_id AND e.n = s.n + 1)
    SELECT track_id, arg_max(t, n) AS t, arg_max(c, n) AS rms FROM s GROUP BY track_id, k""",
)
def w12(spark, d):
    return SE.min_gap(V.frames(spark, d).withColumn("t", F.col("t_sec") * 40), "track_id", "t", "rms", 60.0)


TRANS_SQL = "tr AS (SELECT mix_id, row_number() OVER (PARTITION BY mix_id ORDER BY transition_id) * 200.0 AS start_sec, row_number() OVER (PARTITION BY mix_id ORDER BY transition_id) * 200.0 + 16 AS end_sec FROM v_transitions)"


@query("W14_track_boundaries", f"WITH {TRANS_SQL} SELECT mix_id, row_number() OVER w - 1 AS idx, coalesce(lag(end_sec) OVER w, 0) AS start_sec, start_sec AS end_sec FROM tr WINDOW w AS (PARTITION BY mix_id ORDER BY start_sec) UNION ALL SELECT mix_id, count(*), max(end_sec), 20000.0 FROM tr GROUP BY mix_id")
def w14(spark, d):
    i = F.row_number().over(Window.partitionBy("mix_id").orderBy("transition_id"))
    t = V.transitions(spark, d).select("mix_id", (i * 200.0).alias("start_sec"), (i * 200.0 + 16).alias("end_sec"))
    return SE.track_boundaries(t, "mix_id", F.lit(20000.0))


@query("W15_phrases", "WITH p AS (SELECT track_id, frame_idx // 8 AS phrase, count(*) AS n, avg(rms) AS energy, avg(rms) FILTER (WHERE frame_idx % 8 < 4) AS a, avg(rms) FILTER (WHERE frame_idx % 8 >= 4) AS b FROM v_frames GROUP BY ALL) SELECT track_id, phrase, energy, CASE WHEN b > a * 1.2 THEN 'rising' WHEN b < a * 0.8 THEN 'falling' ELSE 'stable' END AS trend FROM p WHERE n = 8")
def w15(spark, d):
    half = lambda c: F.avg(F.when(c, F.col("rms")))
    p = V.frames(spark, d).groupBy("track_id", F.floor(F.col("frame_idx") / 8).alias("phrase")).agg(F.count("*").alias("n"), F.avg("rms").alias("energy"), half(F.col("frame_idx") % 8 < 4).alias("a"), half(F.col("frame_idx") % 8 >= 4).alias("b"))
    return p.where("n = 8").select("track_id", "phrase", "energy", F.when(F.col("b") > F.col("a") * 1.2, "rising").when(F.col("b") < F.col("a") * 0.8, "falling").otherwise("stable").alias("trend"))


@query("W18_downbeat_phase", "WITH m AS (SELECT track_id, beat_idx % 4 AS phase, round(avg(onset_strength), 9) AS m FROM v_beats GROUP BY ALL) SELECT track_id, phase FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY m DESC, phase) AS r FROM m) WHERE r = 1")
def w18(spark, d):
    return SE.downbeat_phase(V.beats(spark, d))


@query("W19_bar_energy", "WITH b AS (SELECT track_id, beat_idx // 4 AS bar_idx, t_sec AS s, lead(t_sec, 4) OVER (PARTITION BY track_id ORDER BY beat_idx) AS e, beat_idx FROM v_beats) SELECT b.track_id, bar_idx, round(sqrt(avg(rms * rms)), 6) AS energy FROM b JOIN v_frames f ON f.track_id = b.track_id AND f.t_sec >= s AND f.t_sec < e WHERE beat_idx % 4 = 0 GROUP BY ALL")
def w19(spark, d):
    bars = SE.bars_from_beats(V.beats(spark, d)).withColumnRenamed("bar_idx", "idx")
    f = V.frames(spark, d).select("track_id", "frame_idx", F.col("t_sec").alias("t"), "rms")
    return AO.in_interval(f, bars, "track_id", "frame_idx").where("idx is not null").groupBy("track_id", F.col("idx").alias("bar_idx")).agg(r6(F.sqrt(F.avg(F.col("rms") ** 2))).alias("energy"))


@query("W22_set_timeline", "WITH t AS (SELECT mix_id, transition_id, 60 + transition_id % 120 AS body, 8 + transition_id % 16 AS blend FROM v_transitions) SELECT mix_id, transition_id, coalesce(sum(body + blend) OVER (PARTITION BY mix_id ORDER BY transition_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS body_at, coalesce(sum(body + blend) OVER (PARTITION BY mix_id ORDER BY transition_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + body AS blend_at FROM t")
def w22(spark, d):
    body, blend = 60 + F.col("transition_id") % 120, 8 + F.col("transition_id") % 16
    before = F.sum(body + blend).over(Window.partitionBy("mix_id").orderBy("transition_id").rowsBetween(Window.unboundedPreceding, -1))
    at = F.coalesce(before, F.lit(0))
    return V.transitions(spark, d).select("mix_id", "transition_id", at.alias("body_at"), (at + body).alias("blend_at"))


@query("W23_tracklist_transitions", "SELECT mix_id, frame_idx, lag(name) OVER w AS from_track, name AS to_track FROM (SELECT mix_id, frame_idx, regexp_extract(text, '^\\d+:\\d{2} (.*)$', 1) AS name FROM v_mix_text) WINDOW w AS (PARTITION BY mix_id ORDER BY frame_idx) QUALIFY from_track IS NOT NULL")
def w23(spark, d):
    t = V.mix_text(spark, d).withColumn("to_track", F.regexp_extract("text", r"^\d+:\d{2} (.*)$", 1))
    return t.withColumn("from_track", F.lag("to_track").over(SE.ordered("mix_id", "frame_idx"))).where("from_track is not null").select("mix_id", "frame_idx", "from_track", "to_track")


@query("W24_robust_norm", "WITH l AS (SELECT track_id, quantile_cont(rms, 0.05) AS lo, quantile_cont(rms, 0.95) AS hi FROM v_frames GROUP BY 1) SELECT track_id, frame_idx, round(CASE WHEN hi > lo THEN greatest(0, least(1, (rms - lo) / (hi - lo))) ELSE 0 END, 6) AS norm FROM v_frames JOIN l USING (track_id)")
def w24(spark, d):
    return SE.robust_norm(V.frames(spark, d), "track_id", "rms", "norm").select("track_id", "frame_idx", r6("norm").alias("norm"))


@query("W25_frame_scores", "WITH s AS (SELECT track_id, avg(rms) AS m, stddev_pop(rms) AS sd FROM v_frames GROUP BY 1) SELECT track_id, frame_idx, round(0.45 * greatest(0, coalesce((rms - m) / nullif(sd, 0), 0)) + 0.35 * greatest(0, -coalesce((rms - m) / nullif(sd, 0), 0)), 6) AS unwanted FROM v_frames JOIN s USING (track_id)")
def w25(spark, d):
    s = V.frames(spark, d).groupBy("track_id").agg(F.avg("rms").alias("m"), F.stddev_pop("rms").alias("sd"))
    z = F.coalesce(F.try_divide(F.col("rms") - F.col("m"), F.col("sd")), F.lit(0.0))
    return V.frames(spark, d).join(s, "track_id").select("track_id", "frame_idx", r6(0.45 * F.greatest(F.lit(0.0), z) + 0.35 * F.greatest(F.lit(0.0), -z)).alias("unwanted"))


@query("W26_islands", "WITH h AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY track_id ORDER BY frame_idx) AS i FROM v_frames WHERE rms >= 0.1) SELECT track_id, min(frame_idx) AS start_idx, max(frame_idx) AS end_idx, count(*) AS n, round(max(rms), 6) AS peak, round(avg(rms), 6) AS mean FROM h GROUP BY track_id, i")
def w26(spark, d):
    return SE.islands(V.frames(spark, d), "track_id", "frame_idx", "rms", 0.1).withColumns({"peak": r6("peak"), "mean": r6("mean")})


@query("W28_variety_penalty")
def w28(spark, d):
    from seguekit.plans import catalogue_queries as C
    from seguekit.plans import dims

    scores = dims.technique_scores(C.contexts(spark, d)).withColumn("set_id", F.col("pair_id") % 50)
    return SE.variety_penalty(scores, "set_id", "pair_id", "technique", "score")


@query("W30_point_trend", "WITH m AS (SELECT track_id, frame_idx, avg(rms) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS b, avg(rms) OVER (w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS a, row_number() OVER w AS i, count(*) OVER (PARTITION BY track_id) AS n FROM v_frames WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)) SELECT track_id, frame_idx, CASE WHEN i <= 8 OR i > n - 7 THEN 'stable' WHEN a > b * 1.2 THEN 'rising' WHEN a < b * 0.6 THEN 'dip' WHEN a < b * 0.8 THEN 'falling' ELSE 'stable' END AS trend FROM m")
def w30(spark, d):
    w = SE.ordered("track_id", "frame_idx")
    b, a = F.avg("rms").over(w.rowsBetween(-8, -1)), F.avg("rms").over(w.rowsBetween(0, 7))
    m = V.frames(spark, d).select("track_id", "frame_idx", b.alias("b"), a.alias("a"), F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("track_id")).alias("n"))
    edge = (F.col("i") <= 8) | (F.col("i") > F.col("n") - 7)
    return m.select("track_id", "frame_idx", F.when(edge, "stable").when(F.col("a") > F.col("b") * 1.2, "rising").when(F.col("a") < F.col("b") * 0.6, "dip").when(F.col("a") < F.col("b") * 0.8, "falling").otherwise("stable").alias("trend"))


@query("W32_tempo_stability", "WITH i AS (SELECT track_id, t_sec, t_sec - lag(t_sec) OVER (PARTITION BY track_id ORDER BY beat_idx) AS gap FROM v_beats), w AS (SELECT track_id, k, 60 / quantile_cont(gap, 0.5) AS tempo FROM i, (SELECT unnest(range(0, 40)) AS k) WHERE gap IS NOT NULL AND t_sec >= k * 5 AND t_sec < k * 5 + 10 GROUP BY ALL) SELECT track_id, count(*) AS windows, round(stddev_pop(tempo), 6) AS stability FROM w GROUP BY track_id")
def w32(spark, d):
    b = V.beats(spark, d)
    gap = F.col("t_sec") - F.lag("t_sec").over(SE.ordered("track_id", "beat_idx"))
    last = F.floor(F.col("t_sec") / 5)
    k = F.explode(F.filter(F.sequence(last - 1, last), lambda x: x >= 0)).alias("k")  # each time is in two windows
    w = b.withColumn("gap", gap).where("gap is not null").select("track_id", "gap", k).groupBy("track_id", "k").agg((60 / F.percentile("gap", 0.5)).alias("tempo"))
    return w.groupBy("track_id").agg(F.count("*").alias("windows"), r6(F.stddev_pop("tempo")).alias("stability"))


JITTER_SQL = "jt AS (SELECT track_id, beat_idx, t_sec + onset_strength / 10000 AS t, onset_strength, 100 + track_id % 30 AS tempo FROM v_beats)"


@query(
    "A15_microtiming",
    f"""WITH {JITTER_SQL}, i AS (SELECT track_id, beat_idx - 1 AS i, (t - lag(t) OVER (PARTITION BY track_id ORDER BY beat_idx) - 60.0 / tempo) * 1000 AS off FROM jt), o AS (SELECT * FROM i WHERE off IS NOT NULL),
    w AS (SELECT track_id, avg(s) AS swing FROM (SELECT track_id, i // 2 AS pair, sum(CASE WHEN i % 2 = 1 THEN off ELSE -off END) AS s FROM o GROUP BY ALL HAVING count(*) = 2) GROUP BY 1),
    g AS (SELECT track_id, avg(abs(off)) AS mean_ms, stddev_pop(off) AS std_ms FROM o GROUP BY 1) SELECT track_id, mean_ms, std_ms, 1 - least(1, std_ms / 50) AS human, coalesce(swing, 0) AS swing_ms, CASE WHEN abs(coalesce(swing, 0)) > 20 THEN 'swing' WHEN abs(coalesce(swing, 0)) > 5 THEN 'shuffle' ELSE 'straight' END AS groove, std_ms < 10 AS locked FROM g LEFT JOIN w USING (track_id)""",
)
def a15(spark, d):
    return SE.microtiming(jittered(spark, d))


def jittered(spark, d):
    """Beats off the grid by their strength, with each track's tempo."""
    return V.beats(spark, d).select("track_id", "beat_idx", (F.col("t_sec") + F.col("onset_strength") / 10000).alias("t"), "onset_strength", (100 + F.col("track_id") % 30).alias("tempo"))


@query(
    "A16_groove_pattern",
    f"""WITH {JITTER_SQL}, o AS (SELECT track_id, beat_idx, t / 2 AS t, onset_strength / 500 AS e, 60.0 / tempo AS bd FROM jt), p AS (SELECT *, (t % bd) / bd AS pos, t - lag(t) OVER w AS gap, abs(e - lag(e) OVER w) AS flux, avg(e) OVER (PARTITION BY track_id) AS me FROM o WINDOW w AS (PARTITION BY track_id ORDER BY beat_idx)),
    c AS (SELECT *, (pos - CASE WHEN pos <= 0.125 THEN 0 WHEN pos <= 0.375 THEN 0.25 WHEN pos <= 0.625 THEN 0.5 ELSE 0.75 END) * bd * 1000 AS dev FROM p),
    b AS (SELECT track_id, k, count(*) FILTER (WHERE floor(pos * 16)::INT % 16 = k AND beat_idx < 100) AS n FROM p, (SELECT CAST(unnest(range(16)) AS INT) AS k) GROUP BY ALL), h AS (SELECT track_id, list(n / m ORDER BY k) AS template FROM (SELECT *, max(n) OVER (PARTITION BY track_id) AS m FROM b) GROUP BY 1)
    SELECT track_id, avg(abs(dev)) AS mean_ms, stddev_pop(dev) AS std_ms, coalesce(least(0.75, greatest(0.4, avg(gap / bd) FILTER (WHERE gap >= 0.35 * bd AND gap < 0.72 * bd))), 0.5) AS swing, least(1, (avg(flux) * 10 + count(*) FILTER (WHERE e > me) / count(*)) / 2) AS complexity, any_value(template) AS template FROM c JOIN h USING (track_id) GROUP BY track_id HAVING count(*) >= 4""",
)
def a16(spark, d):
    """Onsets on half beats, off the grid by their strength."""
    o = jittered(spark, d).select("track_id", F.col("beat_idx").alias("i"), (F.col("t") / 2).alias("t"), (F.col("onset_strength") / 500).alias("strength"), "tempo")
    return SE.groove_pattern(o)


@query("A20_loudness", "WITH b AS (SELECT track_id, -0.691 + 10 * log10(avg(rms * rms) + 1e-10) AS l FROM v_frames GROUP BY track_id, floor(t_sec / 3) HAVING count(*) = 12) , t AS (SELECT track_id, -0.691 + 10 * log10(avg(rms * rms) + 1e-10) AS lufs, 20 * log10(max(abs(rms)) + 1e-10) AS peak FROM v_frames GROUP BY 1) SELECT t.track_id, round(any_value(lufs), 6) AS lufs, round(coalesce(quantile_cont(l, 0.95) - quantile_cont(l, 0.1), 0), 6) AS lra, round(any_value(peak), 6) AS peak_db, round(any_value(peak - lufs), 6) AS plr FROM t LEFT JOIN b USING (track_id) GROUP BY t.track_id")
def a20(spark, d):
    f = V.frames(spark, d)
    lufs = lambda x: -0.691 + 10 * F.log10(F.avg(x * x) + 1e-10)
    blocks = f.groupBy("track_id", F.floor(F.col("t_sec") / 3).alias("b")).agg(lufs(F.col("rms")).alias("l"), F.count("*").alias("n")).where("n = 12").groupBy("track_id").agg((F.percentile("l", 0.95) - F.percentile("l", 0.1)).alias("lra"))
    t = f.groupBy("track_id").agg(lufs(F.col("rms")).alias("lufs"), (20 * F.log10(F.max(F.abs("rms")) + 1e-10)).alias("peak"))
    return t.join(blocks, "track_id", "left").select("track_id", r6("lufs").alias("lufs"), r6(F.coalesce("lra", F.lit(0.0))).alias("lra"), r6("peak").alias("peak_db"), r6(F.col("peak") - F.col("lufs")).alias("plr"))


@query("A26_energy_flow", f"WITH {POINTS_SQL}, e AS (SELECT p.track_id, avg(rms) FILTER (WHERE t_sec < t - 2) AS b, avg(rms) FILTER (WHERE t_sec BETWEEN t - 2 AND t + 2) AS m, avg(rms) FILTER (WHERE t_sec > t + 2) AS a FROM pts p JOIN v_frames f ON f.track_id = p.track_id AND f.t_sec BETWEEN p.t - 6 AND p.t + 6 WHERE p.point = 0 GROUP BY p.track_id) SELECT track_id, b AS before, m AS during, a AS after, coalesce(m < 0.8 * least(b, a), FALSE) AS dip, coalesce(a > b * 1.2, FALSE) AS build FROM e")
def a26(spark, d):
    f = AO.around(points(spark, d).where("point = 0"), V.frames(spark, d), "track_id", "t_sec", 6, 6)
    at = F.col("t_sec") - F.col("t")
    e = f.groupBy("track_id").agg(F.avg(F.when(at < -2, F.col("rms"))).alias("b"), F.avg(F.when(F.abs(at) <= 2, F.col("rms"))).alias("m"), F.avg(F.when(at > 2, F.col("rms"))).alias("a"))
    return e.select("track_id", F.col("b").alias("before"), F.col("m").alias("during"), F.col("a").alias("after"), F.coalesce(F.col("m") < 0.8 * F.least("b", "a"), F.lit(False)).alias("dip"), F.coalesce(F.col("a") > F.col("b") * 1.2, F.lit(False)).alias("build"))


@query("A32_beat_regularity", "WITH i AS (SELECT track_id, beat_idx, t_sec + onset_strength / 1000 AS t, t_sec + onset_strength / 1000 - lag(t_sec + onset_strength / 1000) OVER (PARTITION BY track_id ORDER BY beat_idx) AS gap FROM v_beats) SELECT track_id, (CASE WHEN count(*) <= 4 THEN 0.5 ELSE greatest(0, least(1, 1 - stddev_pop(gap) / avg(gap))) END)::DOUBLE AS regularity, min(t) * 1000 AS phase_ms, min(t) * 1000 < 50 AS aligned FROM i GROUP BY track_id")
def a32(spark, d):
    t = F.col("t_sec") + F.col("onset_strength") / 1000
    i = V.beats(spark, d).withColumn("t", t).withColumn("gap", t - F.lag(t).over(SE.ordered("track_id", "beat_idx")))
    regular = F.when(F.count("*") <= 4, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(F.stddev_pop("gap"), F.avg("gap")))))
    return i.groupBy("track_id").agg(regular.alias("regularity"), (F.min("t") * 1000).alias("phase_ms"), (F.min("t") * 1000 < 50).alias("aligned"))


@query("A40_vocal_start", "WITH b AS (SELECT track_id, floor(t_sec / 0.5) AS k, sum(rms * rms) AS e FROM v_frames GROUP BY ALL), m AS (SELECT *, max(e) OVER (PARTITION BY track_id) AS top, count(*) OVER (PARTITION BY track_id) AS n FROM b) SELECT track_id, round(coalesce(min(k) FILTER (WHERE e > 0.3 * top) / max(n), 0.5), 6) AS share FROM m GROUP BY track_id")
def a40(spark, d):
    b = V.frames(spark, d).groupBy("track_id", F.floor(F.col("t_sec") / 0.5).alias("k")).agg(F.sum(F.col("rms") ** 2).alias("e"))
    m = b.withColumn("top", F.max("e").over(Window.partitionBy("track_id")))
    return m.groupBy("track_id").agg(r6(F.coalesce(F.min(F.when(F.col("e") > 0.3 * F.col("top"), F.col("k"))) / F.count("*"), F.lit(0.5))).alias("share"))
