"""Queries of peaks over whole series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seguekit.operators import blocks as BL
from seguekit.operators import sections as SC
from seguekit.operators import series as SE
from seguekit.plans import series_queries as SQ
from seguekit.plans import views as V
from seguekit.plans.registry import query

r6 = lambda c: F.round(c, 6)


def peaks_sql(name: str, source: str, key: str, at: str, x: str, height: float | None = None, distance: int = 1, prominence: float | None = None) -> str:
    """CTEs that end in ``name`` (k, p, x): the peaks of a relation."""
    tall = f" AND x >= {height}" if height is not None else ""
    kept = f"""{name}_s AS MATERIALIZED (SELECT {key} AS k, {at} AS p, {x} AS x FROM {source}),
    {name}_r AS (SELECT k, x, min(p) AS lo, max(p) AS hi FROM (SELECT *, p - row_number() OVER (PARTITION BY k, x ORDER BY p) AS g FROM {name}_s) GROUP BY k, x, g),
    {name}_m AS (SELECT k, x, (lo + hi) // 2 AS p FROM (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM {name}_r WINDOW w AS (PARTITION BY k ORDER BY lo)) WHERE b < x AND a < x{tall}),
    {name}_d AS MATERIALIZED (SELECT k, unnest(list_reduce(list([p] ORDER BY x DESC, p DESC), lambda kept, y: CASE WHEN len([z for z in kept if abs(z - y[1]) < {distance}]) > 0 THEN kept ELSE list_concat(kept, y) END)) AS p FROM {name}_m GROUP BY k),
    {name}_k AS MATERIALIZED (SELECT k, p, x FROM {name}_d JOIN {name}_s USING (k, p))"""
    if prominence is None:
        return f"{kept}, {name} AS (SELECT * FROM {name}_k)"
    return f"""{kept},
    {name}_b AS (SELECT q.k, q.p, q.x, max(s.p) FILTER (WHERE s.x > q.x AND s.p < q.p) AS l, min(s.p) FILTER (WHERE s.x > q.x AND s.p > q.p) AS r FROM {name}_k q JOIN {name}_s s ON s.k = q.k GROUP BY ALL),
    {name} AS (SELECT b.k, b.p, b.x FROM {name}_b b JOIN {name}_s s ON s.k = b.k AND s.p > coalesce(l, -1) AND s.p < coalesce(r, 9e15) GROUP BY b.k, b.p, b.x HAVING b.x - greatest(min(s.x) FILTER (WHERE s.p <= b.p), min(s.x) FILTER (WHERE s.p >= b.p)) >= {prominence})"""


@query("W6_find_peaks", f"WITH {peaks_sql('pk', 'v_frames', 'track_id', 'frame_idx', 'rms', 0.1, 3, 0.05)} SELECT k AS track_id, p AS frame_idx, x AS rms FROM pk")
def w6(spark, d):
    return BL.split_peaks(V.frames(spark, d), "track_id", "frame_idx", "rms", height=0.1, distance=3, prominence=0.05)


def kernel_sql(name: str, source: str, x: str, sigma: int) -> str:
    """CTEs that end in ``name`` (k, p, x): ``x`` of ``source`` (k, p, n, ...) under a mirrored kernel."""
    radius = int(4 * sigma + 0.5)
    return f"""{name}_w AS (SELECT j, exp(-0.5 * (j / {sigma}) ** 2) / sum(exp(-0.5 * (j / {sigma}) ** 2)) OVER () AS w FROM (SELECT CAST(unnest(range(-{radius}, {radius + 1})) AS BIGINT) AS j)),
    {name} AS MATERIALIZED (SELECT q.k, q.p, any_value(q.n) AS n, sum(w * s.{x}) AS x FROM (SELECT k, p, n, w, ((p + j) % (2 * n) + 2 * n) % (2 * n) AS m FROM {source}, {name}_w) q JOIN {source} s ON s.k = q.k AND s.p = CASE WHEN m >= q.n THEN 2 * q.n - 1 - m ELSE m END GROUP BY q.k, q.p)"""


CHANGE_SQL = f"""f0 AS MATERIALIZED (SELECT track_id AS k, frame_idx AS p, rms AS x, count(*) OVER (PARTITION BY track_id) AS n FROM v_frames), {kernel_sql("f1", "f0", "x", 50)},
    f2 AS MATERIALIZED (SELECT k, p, n, abs(coalesce(CASE WHEN p = 0 THEN lead(x) OVER w - x WHEN p = n - 1 THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END, 0)) AS x FROM f1 WINDOW w AS (PARTITION BY k ORDER BY p)), {kernel_sql("f3", "f2", "x", 20)},
    f4 AS MATERIALIZED (SELECT k, p, n, round(CASE WHEN max(x) OVER w > min(x) OVER w THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE x END, 9) AS x FROM f3 WINDOW w AS (PARTITION BY k))"""


@query("W13_fallback_change", f"WITH {CHANGE_SQL}, {peaks_sql('pk', 'f4', 'k', 'p', 'x', 0.2, 240)} SELECT pk.k AS track_id, p AS frame_idx, p * 0.25::DOUBLE AS start_sec, least(p * 0.25 + 30, n * 0.25)::DOUBLE AS end_sec, round(x, 6) AS change FROM pk JOIN (SELECT DISTINCT k, n FROM f0) USING (k)")
def w13(spark, d):
    found = SC.fallback_changes(V.frames(spark, d), "track_id", "frame_idx", "rms", 0.25)
    return found.withColumn("change", r6("change"))


_RETRY = "SELECT k, p, x FROM {a} WHERE k NOT IN (SELECT k FROM few) UNION ALL SELECT k, p, x FROM {b} WHERE k IN (SELECT k FROM few)"
PEAK_VOTE_SQL = f"""{SQ.NOVELTY_SQL}, {SQ.GAUSS_SQL.format(value="novelty", table="nov")}, rep AS (SELECT mix_id, bar_idx, CASE WHEN max(smooth) OVER w > min(smooth) OVER w THEN (smooth - min(smooth) OVER w) / (max(smooth) OVER w - min(smooth) OVER w) ELSE 0 END AS r FROM g WINDOW w AS (PARTITION BY mix_id)),
    {SQ.COMPLEX_SQL}, {SQ.VOCAL_SQL}, {SQ.INDEP_SQL}, v AS (SELECT mix_id, bar_idx, coalesce(least(1, avg(z) / 3), 0) AS v FROM z GROUP BY ALL), c AS (SELECT mix_id, bar_idx, coalesce(rise / nullif(max(rise) OVER (PARTITION BY mix_id), 0), 0) AS c FROM rise),
    vote AS MATERIALIZED (SELECT mix_id, bar_idx, r, v, c, d, round((2 * r + 2 * v + 1.5 * c + d) / 6.5 * CASE bar_idx % 8 WHEN 0 THEN 1.3 WHEN 4 THEN 1.1 ELSE 1.0 END, 9)::DOUBLE AS vote, max(bar_idx) OVER (PARTITION BY mix_id) AS l FROM rep JOIN v USING (mix_id, bar_idx) JOIN c USING (mix_id, bar_idx) JOIN ind USING (mix_id, bar_idx)),
    {peaks_sql("pa", "vote", "mix_id", "bar_idx", "vote", 0.2, 8, 0.15)}, {peaks_sql("pb", "vote", "mix_id", "bar_idx", "vote", 0.15, 8, 0.1)},
    few AS (SELECT b.k FROM (SELECT mix_id AS k, count(*) AS bars FROM vote GROUP BY 1) b LEFT JOIN (SELECT k, count(*) AS n FROM pa GROUP BY 1) a USING (k) WHERE bars > 30 AND coalesce(n, 0) < 3),
    pk AS ({_RETRY.format(a="pa", b="pb")}),
    kept AS (SELECT k, unnest(list_reduce(list([[p * 2.0::DOUBLE, x]] ORDER BY p), lambda a, y: CASE WHEN y[1][1] - a[len(a)][1] >= 60 THEN list_concat(a, y) WHEN y[1][2] > a[len(a)][2] THEN list_concat(a[:len(a) - 1], y) ELSE a END)) AS e FROM pk GROUP BY k)"""


@query(
    "W11_transition_peaks",
    f"""WITH {PEAK_VOTE_SQL} SELECT mix_id, bar_idx, bar_idx * 2.0::DOUBLE AS start_sec, (least(bar_idx + 4, l) + 1) * 2.0::DOUBLE AS end_sec, round(vote, 6) AS confidence, round(v, 5) AS novelty,
    coalesce(nullif(concat_ws('+', CASE WHEN r > 0.2 THEN 'repetition' END, CASE WHEN v > 0.2 THEN 'vocal' END, CASE WHEN c > 0.2 THEN 'complexity' END, CASE WHEN d > 0.2 THEN 'band' END), ''), 'combined') AS method FROM kept JOIN vote ON mix_id = k AND bar_idx * 2.0 = e[1]""",
)
def w11_peaks(spark, d):
    """Votes cut to peaks, of which the stronger of two within a minute stays; bars last two seconds."""
    b = V.bars(spark, d)
    on = ["mix_id", "bar_idx"]
    rep = BL.gaussian_smooth(SE.repetition_break(b).select(*on, "novelty"), *on, "novelty", 1.0).select(*on, SE.min_max("smooth", "mix_id").alias("r"))
    voc, cplx = SE.vocal_novelty(b).withColumnRenamed("novelty", "v"), SE.complexity_change(b).select(*on, "change")
    j = rep.join(voc, on).join(cplx, on).join(SE.band_independence(b), on)
    vote = F.round(SE.transition_vote(F.col("r"), F.col("v"), F.col("change"), F.col("independence"), F.col("bar_idx")), 9)
    votes = j.select("*", vote.alias("vote"), F.max("bar_idx").over(Window.partitionBy("mix_id")).alias("last"))
    found = SC.voted_peaks(votes, *on, "vote").withColumn("start_sec", F.col("bar_idx") * F.lit(2.0))
    kept = SE.min_gap(found, "mix_id", "start_sec", "vote", 60.0).select("mix_id", (F.col("start_sec") / 2).cast("long").alias("bar_idx"), "start_sec")
    said = F.concat_ws("+", *(F.when(F.col(c) > 0.2, name) for c, name in (("r", "repetition"), ("v", "vocal"), ("change", "complexity"), ("independence", "band"))))
    end = (F.least(F.col("bar_idx") + 4, F.col("last")) + 1) * F.lit(2.0)
    return kept.join(votes, on).select(*on, "start_sec", end.alias("end_sec"), r6("vote").alias("confidence"), F.round("v", 5).alias("novelty"), F.when(said == "", "combined").otherwise(said).alias("method"))


@query(
    "W31_energy_segments",
    f"""WITH sm AS MATERIALIZED (SELECT track_id, frame_idx, round(sum(rms) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING) / 16, 9) AS s FROM v_frames), {peaks_sql("pk", "sm", "track_id", "frame_idx", "s", None, 8, 0.1)}, {peaks_sql("va", "sm", "track_id", "frame_idx", "-s", None, 8, 0.1)},
    e AS (SELECT track_id AS k, max(frame_idx) AS last FROM v_frames GROUP BY 1), mk AS (SELECT k, 0::BIGINT AS p FROM e UNION SELECT k, last FROM e UNION SELECT k, p FROM pk UNION SELECT k, p FROM va),
    sg AS MATERIALIZED (SELECT * FROM (SELECT k AS track_id, row_number() OVER w - 1 AS k, p AS a, lead(p) OVER w AS b, count(*) OVER (PARTITION BY k) - 1 AS n FROM mk WINDOW w AS (PARTITION BY k ORDER BY p)) WHERE b IS NOT NULL AND n >= 4),
    eq AS (SELECT k AS track_id, unnest(range(0, n)) AS i, n, last, dur FROM (SELECT *, (last + 1) * 0.25::DOUBLE AS dur, least(8, greatest(4, floor((last + 1) * 0.25 / 30)))::BIGINT AS n FROM e) WHERE k NOT IN (SELECT track_id FROM sg)),
    ef AS (SELECT track_id, i AS k, i * dur / n AS s, (i + 1) * dur / n AS t, ceil(i * dur / n / 0.25::DOUBLE - 0.5) AS a, ceil(least((i + 1) * dur / n, last * 0.25) / 0.25::DOUBLE - 0.5) AS b FROM eq)
    SELECT sg.track_id, k AS segment, a * 0.25::DOUBLE AS start_sec, b * 0.25::DOUBLE AS end_sec, (a + b) * 0.125::DOUBLE AS mid_sec, avg(rms) AS energy FROM sg JOIN v_frames f ON f.track_id = sg.track_id AND frame_idx >= a AND frame_idx < b GROUP BY ALL
    UNION ALL SELECT ef.track_id, k, round(s, 6), round(t, 6), round((s + t) / 2, 6), avg(rms) FROM ef JOIN v_frames f ON f.track_id = ef.track_id AND frame_idx BETWEEN a AND b GROUP BY ef.track_id, k, s, t""",
)
def w31(spark, d):
    found = SC.energy_segments(V.frames(spark, d), "track_id", "frame_idx", "rms", 0.25)
    return found.select("track_id", "segment", *(r6(c).alias(c) for c in ("start_sec", "end_sec", "mid_sec")), "energy")


_FIRST = "(SELECT k AS track_id, list(p * 0.25::DOUBLE ORDER BY p)[:10] AS {name} FROM {source} GROUP BY 1)"


@query(
    "A9_energy_stats",
    f"""WITH x AS MATERIALIZED (SELECT track_id, frame_idx, round(CASE WHEN max(rms) OVER w > min(rms) OVER w THEN (rms - min(rms) OVER w) / (max(rms) OVER w - min(rms) OVER w) ELSE 0 END, 9)::DOUBLE AS x FROM v_frames WINDOW w AS (PARTITION BY track_id)), {peaks_sql("pk", "x", "track_id", "frame_idx", "x", None, 4)}, {peaks_sql("va", "x", "track_id", "frame_idx", "-x", None, 4)}
    SELECT track_id, mean, std, low, high, p10, p90, coalesce(peak_sec, []) AS peak_sec, coalesce(valley_sec, []) AS valley_sec FROM (SELECT track_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS low, max(x) AS high, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.9), 6) AS p90 FROM x GROUP BY track_id)
    LEFT JOIN {_FIRST.format(name="peak_sec", source="pk")} USING (track_id) LEFT JOIN {_FIRST.format(name="valley_sec", source="va")} USING (track_id)""",
)
def a9(spark, d):
    """Energy as a share of its range, and the first ten peaks and valleys that are a second apart."""
    x = V.frames(spark, d).select("track_id", "frame_idx", F.round(SE.min_max("rms", "track_id"), 9).alias("x"))
    stats = x.groupBy("track_id").agg(r6(F.avg("x")).alias("mean"), r6(F.stddev_pop("x")).alias("std"), F.min("x").alias("low"), F.max("x").alias("high"), r6(F.percentile("x", 0.1)).alias("p10"), r6(F.percentile("x", 0.9)).alias("p90"))
    for name, found in zip(("peak_sec", "valley_sec"), SC.extremes(x, "track_id", "frame_idx", "x", 4), strict=True):
        ranked = found.withColumn("__r", F.row_number().over(SE.ordered("track_id", "frame_idx"))).where("__r <= 10")
        first = ranked.groupBy("track_id").agg(F.array_sort(F.collect_list(F.col("frame_idx") * F.lit(0.25))).alias(name))
        stats = stats.join(first, "track_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<double>")))
    return stats
