"""Queries of validation and corpus statistics (V*, A1-A8, A13, A20-A22, A41, F25-F28, J16-J17, J20-J21)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seguekit.functions import harmony as H
from seguekit.operators import ranks as R
from seguekit.operators import validation as VA
from seguekit.plans import dims
from seguekit.plans import views as V
from seguekit.plans.registry import query

DOC = """'{"song_id": "' || song_id || '"' || CASE WHEN song_id % 3 = 0 THEN '' ELSE ', "duration_sec": 1' END || ', "tempo": 1, "key": null, "energy": 1, "structure": {"sections": [{"type": "verse", "start_sec": 0, "end_sec": 1}, {' || CASE WHEN song_id % 2 = 0 THEN '"type": "drop", ' ELSE '' END || '"start_sec": 1, "end_sec": 2}]}' || CASE WHEN song_id % 5 = 0 THEN '' ELSE ', "vocals": 1' END || ', "embeddings": 1}'"""


@query(
    "V1_validate_song",
    """SELECT song_id, CASE WHEN song_id % 7 = 0 THEN ['Invalid JSON'] ELSE list_filter([CASE WHEN song_id % 3 = 0 THEN 'Missing required field: duration_sec' END, CASE WHEN song_id % 5 = 0 THEN 'Missing required field: vocals' END, CASE WHEN song_id % 2 = 1 THEN 'structure.sections[1].type is required' END], lambda x: x IS NOT NULL) END AS errors FROM v_songs""",
)
def v1(spark, d):
    doc = F.when(F.col("song_id") % 7 == 0, F.lit("{broken")).otherwise(F.expr(DOC.replace("\n", " ")))
    return V.songs(spark, d).select("song_id", VA.document_errors(doc).alias("errors"))


@query("V3_validate_corpus", "SELECT song_id % 7 = 0 AS invalid_json, count(*) AS n, count(*) FILTER (WHERE song_id % 7 <> 0 AND song_id % 3 <> 0 AND song_id % 5 <> 0 AND song_id % 2 = 0) AS valid FROM v_songs GROUP BY 1")
def v3(spark, d):
    doc = F.when(F.col("song_id") % 7 == 0, F.lit("{broken")).otherwise(F.expr(DOC.replace("\n", " ")))
    e = V.songs(spark, d).select(VA.document_errors(doc).alias("errors"))
    return e.groupBy(F.coalesce(F.get("errors", F.lit(0)) == "Invalid JSON", F.lit(False)).alias("invalid_json")).agg(F.count("*").alias("n"), F.count_if(F.size("errors") == 0).alias("valid"))


def raw_samples(spark, d):
    """Samples as loosely typed text, some of them broken."""
    s = V.samples(spark, d)
    bad = F.col("part_id") % 10
    return s.select("order_id", "part_id", F.when(bad == 0, None).otherwise(F.lit("a")).alias("from_track"), F.lit("b").alias("to_track"), F.when(bad == 1, "[]").when(bad == 2, "fast").otherwise(F.concat(F.lit("["), F.col("tempo_outgoing").cast("string"), F.lit("]"))).alias("tempo_outgoing"), F.col("tempo_incoming").cast("string").alias("tempo_incoming"), F.when(bad == 3, "NaN").otherwise(F.col("energy_before").cast("string")).alias("energy_before"), "energy_after", "perceived_smoothness", "harmonic_tension", F.when(bad == 4, " ").otherwise(F.col("key_outgoing")).alias("key_outgoing"), "key_incoming")


@query(
    "V4_validate_sample",
    """WITH e AS (SELECT part_id % 10 AS bad FROM v_samples) SELECT error, count(*) AS n FROM (SELECT CASE bad WHEN 0 THEN 'missing from_track' WHEN 1 THEN 'bad tempo_outgoing' WHEN 2 THEN 'bad tempo_outgoing' WHEN 3 THEN 'bad energy_before' WHEN 4 THEN 'empty key_outgoing' END AS error FROM e) WHERE error IS NOT NULL GROUP BY error""",
)
def v4(spark, d):
    raw = raw_samples(spark, d)
    return raw.select(F.explode(VA.sample_errors(raw)).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("V7_validation_summary", "SELECT count(*) AS total, count(*) FILTER (WHERE part_id % 10 > 4) AS valid, round(100.0 * count(*) FILTER (WHERE part_id % 10 > 4) / count(*), 6) AS valid_pct, count(*) FILTER (WHERE part_id % 10 > 4) >= 500 AS ready_nn, count(*) FILTER (WHERE part_id % 10 > 4) >= 2000 AS ready_lstm FROM v_samples")
def v7(spark, d):
    raw = raw_samples(spark, d)
    return VA.validation_summary(raw, VA.sample_errors(raw))


_FIELDS = ["tempo_outgoing", "tempo_incoming", "energy_before", "energy_after", "perceived_smoothness"]


@query(
    "V8_feature_distribution",
    f"""WITH l AS ({' UNION ALL '.join(f"SELECT '{f}' AS field, {f}::DOUBLE AS x FROM v_samples" for f in _FIELDS)}), s AS (SELECT field, avg(x) AS m, stddev_pop(x) AS sd FROM l GROUP BY field)
    SELECT field, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, quantile_cont(x, 0.5) AS median, count(*) FILTER (WHERE abs(x - m) > 3 * sd) AS outliers FROM l JOIN s USING (field) GROUP BY field""",
)
def v8(spark, d):
    return VA.feature_distribution(V.samples(spark, d), _FIELDS)


@query("V9_dedup_pairs", "SELECT mix_id, technique, min_by(transition_id, transition_id) AS transition_id FROM (SELECT CASE WHEN mix_id % 5 = 0 THEN NULL ELSE mix_id END AS mix_id, technique, transition_id FROM v_transitions) GROUP BY ALL")
def v9(spark, d):
    t = V.transitions(spark, d).select(F.when(F.col("mix_id") % 5 != 0, F.col("mix_id")).alias("mix_id"), "technique", "transition_id")
    return VA.dedup_first(t, ["mix_id", "technique"], "transition_id").select("mix_id", "technique", "transition_id")


@query("V10_readiness_dashboard", "SELECT count(*) AS samples, count(DISTINCT genre) AS sources, round(least(100.0, 100.0 * count(*) / 500), 6) AS progress_500, CASE WHEN count(*) < 500 THEN (500 - count(*)) // 25 + 1 ELSE 0 END AS mixes_needed_500, round(least(100.0, 100.0 * count(*) / 2000), 6) AS progress_2000, CASE WHEN count(*) < 2000 THEN (2000 - count(*)) // 25 + 1 ELSE 0 END AS mixes_needed_2000 FROM v_mixes")
def v10(spark, d):
    return VA.readiness(V.mixes(spark, d), "genre")


_USED_SQL = "[CASE WHEN bass_swap_detected THEN 'bass_swap' END, CASE WHEN crossfade_type = 'cut' THEN 'quick_cut' END, CASE WHEN energy_after > energy_before THEN 'energy_build' END, 'blend']"


def with_techniques(df):
    return df.withColumn("techniques_used", F.array_compact(F.array(F.when(F.col("bass_swap_detected"), "bass_swap"), F.when(F.col("crossfade_type") == "cut", "quick_cut"), F.when(F.col("energy_after") > F.col("energy_before"), "energy_build"), F.lit("blend"))))


@query("A1_technique_counts", f"WITH u AS (SELECT unnest({_USED_SQL}) AS technique FROM v_samples) SELECT technique, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM v_samples), 6) AS pct FROM u WHERE technique IS NOT NULL GROUP BY technique ORDER BY n DESC, technique LIMIT 8")
def a1(spark, d):
    s = with_techniques(V.samples(spark, d))
    n = s.agg(F.count("*").alias("total"))
    c = s.select(F.explode("techniques_used").alias("technique")).groupBy("technique").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(n), F.lit(True)).select("technique", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct")).orderBy(F.desc("n"), "technique").limit(8)


@query("A2_quality_stats", "SELECT round(avg(coalesce(perceived_smoothness, 0)), 6) AS smoothness, round(100.0 * count(*) FILTER (WHERE bass_swap_detected) / count(*), 6) AS bass_pct, round(100.0 * count(*) FILTER (WHERE beat_aligned) / count(*), 6) AS beat_pct, round(100.0 * count(*) FILTER (WHERE key_outgoing = key_incoming) / count(*), 6) AS key_pct FROM v_samples")
def a2(spark, d):
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 6)
    return V.samples(spark, d).agg(F.round(F.avg(F.coalesce("perceived_smoothness", F.lit(0))), 6).alias("smoothness"), pct(F.col("bass_swap_detected")).alias("bass_pct"), pct(F.col("beat_aligned")).alias("beat_pct"), pct(F.col("key_outgoing") == F.col("key_incoming")).alias("key_pct"))


@query("A3_source_counts", "SELECT source_mix, count(*) AS n, max(crossfade_type) AS type FROM v_samples GROUP BY source_mix ORDER BY n DESC, source_mix")
def a3(spark, d):
    return V.samples(spark, d).groupBy("source_mix").agg(F.count("*").alias("n"), F.max("crossfade_type").alias("type")).orderBy(F.desc("n"), "source_mix")


def style_profile(s):
    """One row per mix; the histogram is a sorted array of (type, n)."""
    ia, ib = H.key_index(F.col("key_outgoing")), H.key_index(F.col("key_incoming"))
    fit = F.pmod(ib - ia, F.lit(12)).isin(*H.CONSONANT)
    types = s.groupBy("source_mix", "crossfade_type").agg(F.count("*").alias("n")).groupBy("source_mix").agg(F.array_sort(F.collect_list(F.struct("crossfade_type", "n"))).alias("types"))
    base = s.groupBy("source_mix").agg(
        F.count("*").alias("transitions"), F.count_if(F.col("energy_after") > F.col("energy_before")).alias("builds"), F.count_if(F.col("energy_after") < F.col("energy_before")).alias("dips"), F.count_if("bass_swap_detected").alias("swaps"),
        F.count_if(F.col("crossfade_type") == "cut").alias("cuts"), F.count_if(fit).alias("key_fits"), F.avg("harmonic_tension").alias("tension"), F.count_if("beat_aligned").alias("aligned"), F.avg("perceived_smoothness").alias("smoothness"),
        F.min("tempo_outgoing").alias("tempo_min"), F.max("tempo_outgoing").alias("tempo_max"),
    )
    return base.join(types, "source_mix")


_KEYFIT = f"(list_position({[*V.NAMES]}, key_incoming) - list_position({[*V.NAMES]}, key_outgoing) + 12) % 12 IN (0,3,4,5,7,8,9)"
STYLE_SQL = f"""style AS (SELECT source_mix, count(*) AS transitions, count(*) FILTER (WHERE energy_after > energy_before) AS builds, count(*) FILTER (WHERE energy_after < energy_before) AS dips, count(*) FILTER (WHERE bass_swap_detected) AS swaps,
    count(*) FILTER (WHERE crossfade_type = 'cut') AS cuts, count(*) FILTER (WHERE {_KEYFIT}) AS key_fits, avg(harmonic_tension) AS tension, count(*) FILTER (WHERE beat_aligned) AS aligned, avg(perceived_smoothness) AS smoothness, min(tempo_outgoing) AS tempo_min, max(tempo_outgoing) AS tempo_max FROM v_samples GROUP BY source_mix)"""


@query("A4_style_profile", f"WITH {STYLE_SQL}, h AS (SELECT source_mix, string_agg(crossfade_type || '=' || n, ',' ORDER BY crossfade_type) AS types FROM (SELECT source_mix, crossfade_type, count(*) AS n FROM v_samples GROUP BY ALL) GROUP BY source_mix) SELECT * REPLACE (round(tension, 6) AS tension, round(smoothness, 6) AS smoothness) FROM style JOIN h USING (source_mix)")
def a4(spark, d):
    p = style_profile(V.samples(spark, d))
    return p.withColumns({"tension": F.round("tension", 6), "smoothness": F.round("smoothness", 6), "types": F.array_join(F.transform("types", lambda t: F.concat_ws("=", t["crossfade_type"], t["n"].cast("string"))), ",")})


INSIGHTS_SQL = """concat_ws('; ', CASE WHEN abs(a.smoothness - b.smoothness) > 0.005 THEN CASE WHEN a.smoothness > b.smoothness THEN 'a is smoother' ELSE 'b is smoother' END END,
    CASE WHEN a.cuts / a.transitions > b.cuts / b.transitions THEN 'a cuts more' WHEN a.cuts / a.transitions < b.cuts / b.transitions THEN 'b cuts more' END,
    CASE WHEN a.builds / a.transitions > b.builds / b.transitions THEN 'a builds more' WHEN a.builds / a.transitions < b.builds / b.transitions THEN 'b builds more' END,
    CASE WHEN a.swaps / a.transitions > b.swaps / b.transitions THEN 'a swaps more' WHEN a.swaps / a.transitions < b.swaps / b.transitions THEN 'b swaps more' END)"""


@query("J20_style_compare", f"WITH {STYLE_SQL} SELECT a.source_mix AS mix_a, b.source_mix AS mix_b, a.smoothness - b.smoothness AS smoother_by, a.tension - b.tension AS tenser_by, a.transitions AS transitions_a, b.transitions AS transitions_b, a.cuts AS cuts_a, b.cuts AS cuts_b, {INSIGHTS_SQL} AS insights FROM style a JOIN style b ON b.source_mix = a.source_mix + 1")
def j20(spark, d):
    """Profiles of every mix and the next one side by side."""
    p = style_profile(V.samples(spark, d))
    pairs = p.select(F.col("source_mix").alias("mix_a"), (F.col("source_mix") + 1).alias("mix_b"))
    return style_compare(p, pairs, "source_mix")


def style_compare(profiles, pairs, key):
    """Both profiles of each pair (mix_a, mix_b) and what sets them apart; two equi-joins, no product of profiles."""
    fields = ["transitions", "smoothness", "tension", "cuts", "builds", "swaps"]
    side = lambda x: profiles.select(F.col(key).alias(f"mix_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in fields))
    both = pairs.join(side("a"), "mix_a").join(side("b"), "mix_b")
    share = lambda c, x: F.col(f"{c}_{x}") / F.col(f"transitions_{x}")
    more = lambda c, verb: F.when(share(c, "a") > share(c, "b"), f"a {verb} more").when(share(c, "a") < share(c, "b"), f"b {verb} more")
    smoother = F.col("smoothness_a") - F.col("smoothness_b")
    said = F.concat_ws("; ", F.when(F.abs(smoother) > 0.005, F.when(smoother > 0, "a is smoother").otherwise("b is smoother")), more("cuts", "cuts"), more("builds", "builds"), more("swaps", "swaps"))
    return both.select("mix_a", "mix_b", smoother.alias("smoother_by"), (F.col("tension_a") - F.col("tension_b")).alias("tenser_by"), "transitions_a", "transitions_b", "cuts_a", "cuts_b", said.alias("insights"))


@query("A5_merge_stats", f"SELECT crossfade_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct, round(avg(perceived_smoothness), 6) AS smoothness, min(perceived_smoothness) AS least, max(perceived_smoothness) AS most, round(100.0 * count(*) FILTER (WHERE {_KEYFIT}) / count(*), 6) AS key_pct, round(avg(harmonic_tension), 6) AS tension FROM v_samples GROUP BY crossfade_type")
def a5(spark, d):
    fit = F.pmod(H.key_index(F.col("key_incoming")) - H.key_index(F.col("key_outgoing")), F.lit(12)).isin(*H.CONSONANT)
    g = V.samples(spark, d).groupBy("crossfade_type").agg(F.count("*").alias("n"), F.round(F.avg("perceived_smoothness"), 6).alias("smoothness"), F.min("perceived_smoothness").alias("least"), F.max("perceived_smoothness").alias("most"), F.round(100.0 * F.count_if(fit) / F.count("*"), 6).alias("key_pct"), F.round(F.avg("harmonic_tension"), 6).alias("tension"))
    total = g.agg(F.sum("n").alias("total"))
    return g.join(F.broadcast(total), F.lit(True)).withColumn("pct", F.round(100.0 * F.col("n") / F.col("total"), 6)).drop("total")


PRED_SQL = "pred AS (SELECT crossfade_type AS truth, CASE WHEN part_id % 4 = 0 THEN 'cut' ELSE crossfade_type END AS guess, perceived_smoothness AS y, perceived_smoothness + (part_id % 7 - 3) / 100.0 AS p FROM v_samples)"


def predictions(spark, d):
    return V.samples(spark, d).select(F.col("crossfade_type").alias("truth"), F.when(F.col("part_id") % 4 == 0, "cut").otherwise(F.col("crossfade_type")).alias("guess"), F.col("perceived_smoothness").alias("y"), (F.col("perceived_smoothness") + (F.col("part_id") % 7 - 3) / 100.0).alias("p"))


def confusion(df):
    return df.groupBy("truth", "guess").agg(F.count("*").alias("n"))


@query("A6_confusion_matrix", f"WITH {PRED_SQL} SELECT truth, guess, count(*) AS n FROM pred GROUP BY ALL")
def a6c(spark, d):
    return confusion(predictions(spark, d))


@query(
    "A6_classification_report",
    f"""WITH {PRED_SQL}, c AS (SELECT DISTINCT truth AS label FROM pred), k AS (SELECT label, count(*) FILTER (WHERE truth = label AND guess = label) AS tp, count(*) FILTER (WHERE guess = label) AS guessed, count(*) FILTER (WHERE truth = label) AS support FROM c, pred GROUP BY label)
    SELECT label, support, round(coalesce(tp / nullif(guessed, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(guessed + support, 0), 0), 6) AS f1, round((SELECT count(*) FILTER (WHERE truth = guess) / count(*) FROM pred), 6) AS accuracy FROM k""",
)
def a6(spark, d):
    m = confusion(predictions(spark, d))
    long = m.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), (F.col("truth") == F.col("guess")).cast("int").alias("g")), F.struct(F.col("guess").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("g")))).alias("e"), "n", "truth", "guess")
    per = long.groupBy("e.label").agg(F.sum(F.when(F.col("e.t") == 1, F.col("n"))).alias("support"), F.sum(F.when(F.col("e.t") == 0, F.col("n"))).alias("guessed"), F.sum(F.when((F.col("e.t") == 1) & (F.col("e.g") == 1), F.col("n"))).alias("tp")).na.fill(0)
    acc = m.agg((F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return per.join(F.broadcast(acc), F.lit(True)).select("label", "support", ratio(F.col("tp"), F.col("guessed")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("guessed") + F.col("support")).alias("f1"), F.round("accuracy", 6).alias("accuracy"))


@query("A7_regression_report", f"WITH {PRED_SQL} SELECT round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p) / (y + 1e-6)) * 100, 6) AS mape, round(min(p), 6) AS p_min, round(max(p), 6) AS p_max FROM pred")
def a7(spark, d):
    e = F.col("y") - F.col("p")
    return predictions(spark, d).agg(F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(F.abs(e) / (F.col("y") + 1e-6)) * 100, 6).alias("mape"), F.round(F.min("p"), 6).alias("p_min"), F.round(F.max("p"), 6).alias("p_max"))


@query(
    "A8_curve_report",
    """WITH c AS (SELECT b.mix_id, b.bar_idx, f.i, b.features[f.i] AS t, n.features[f.i] AS p FROM v_bars b JOIN v_bars n ON n.mix_id = b.mix_id AND n.bar_idx = b.bar_idx + 1, (SELECT unnest(range(1, 11)) AS i) f),
    l AS (SELECT *, t - lag(t) OVER w AS dt, p - lag(p) OVER w AS dp FROM c WINDOW w AS (PARTITION BY mix_id, i ORDER BY bar_idx)) SELECT i - 1 AS param, round(avg((t - p) * (t - p)), 6) AS mse, round(avg(abs(dp)), 6) AS smoothness, round(avg(abs(dp)) / avg(abs(dt)), 6) AS ratio FROM l GROUP BY i""",
)
def a8(spark, d):
    b = V.bars(spark, d)
    long = b.select("mix_id", "bar_idx", F.posexplode(F.slice("features", 1, 10)).alias("param", "t"))
    nxt = long.select("mix_id", (F.col("bar_idx") - 1).alias("bar_idx"), "param", F.col("t").alias("p"))
    w = Window.partitionBy("mix_id", "param").orderBy("bar_idx")
    c = long.join(nxt, ["mix_id", "bar_idx", "param"]).withColumn("dt", F.col("t") - F.lag("t").over(w)).withColumn("dp", F.col("p") - F.lag("p").over(w))
    return c.groupBy("param").agg(F.round(F.avg((F.col("t") - F.col("p")) ** 2), 6).alias("mse"), F.round(F.avg(F.abs("dp")), 6).alias("smoothness"), F.round(F.avg(F.abs("dp")) / F.avg(F.abs("dt")), 6).alias("ratio"))


@query("A21_leaderboard", "SELECT technique, round(max(quality_score), 6) AS best, round(avg(quality_score), 6) AS mean, round(stddev_pop(quality_score), 6) AS std, round(min(quality_score), 6) AS least, count(*) AS trials FROM v_transitions GROUP BY technique")
def a21(spark, d):
    return leaderboard(V.transitions(spark, d)).withColumns({c: F.round(c, 6) for c in ("best", "mean", "std", "least")})


def leaderboard(trials):
    return trials.groupBy("technique").agg(F.max("quality_score").alias("best"), F.avg("quality_score").alias("mean"), F.stddev_pop("quality_score").alias("std"), F.min("quality_score").alias("least"), F.count("*").alias("trials"))


@query("A21_pareto", "WITH l AS (SELECT mix_id, max(quality_score) AS best, avg(quality_score) AS mean FROM v_transitions GROUP BY 1) SELECT mix_id, best FROM l WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.best > l.best AND o.mean >= l.mean)")
def a21p(spark, d):
    """No other mix is better at its best and as good on average."""
    board = V.transitions(spark, d).groupBy("mix_id").agg(F.max("quality_score").alias("best"), F.avg("quality_score").alias("mean"))
    return R.pareto(board).select("mix_id", "best")


@query("A22_ensemble", "SELECT mix_id, round(avg(quality_score), 6) AS mean, round(stddev_pop(quality_score), 6) AS std, round(1 - stddev_pop(quality_score), 6) AS confidence, bool_and(quality_score > 0.5) AS consensus FROM v_transitions GROUP BY mix_id")
def a22(spark, d):
    q = F.col("quality_score")
    return V.transitions(spark, d).groupBy("mix_id").agg(F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_pop(q), 6).alias("std"), F.round(1 - F.stddev_pop(q), 6).alias("confidence"), F.bool_and(q > 0.5).alias("consensus"))


@query("A41_mix_training_summary", "SELECT mix_id, sum(n) AS examples, sum(s) / sum(n) AS mean, min(lo) AS least, max(hi) AS most, string_agg(technique || '=' || n, ',' ORDER BY technique) AS techniques FROM (SELECT mix_id, technique, count(*) AS n, sum(quality_score) AS s, min(quality_score) AS lo, max(quality_score) AS hi FROM v_transitions GROUP BY ALL) GROUP BY mix_id")
def a41(spark, d):
    per = V.transitions(spark, d).groupBy("mix_id", "technique").agg(F.count("*").alias("n"), F.sum("quality_score").alias("s"), F.min("quality_score").alias("lo"), F.max("quality_score").alias("hi"))
    g = per.groupBy("mix_id").agg(F.sum("n").alias("examples"), (F.sum("s") / F.sum("n")).alias("mean"), F.min("lo").alias("least"), F.max("hi").alias("most"), F.array_sort(F.collect_list(F.struct("technique", "n"))).alias("t"))
    return g.withColumn("techniques", F.array_join(F.transform("t", lambda x: F.concat_ws("=", x["technique"], x["n"].cast("string"))), ",")).drop("t")


@query("A42_ingest_report", "SELECT count(*) FILTER (WHERE event_type = 'click') AS success, count(*) FILTER (WHERE event_type = 'view') AS no_timestamps, count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) AS error, coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_type = 'click'), 0) AS transitions FROM events")
def a42(spark, d):
    e = V.read(spark, d, "events")
    t = F.col("event_type")
    return e.agg(F.count_if(t == "click").alias("success"), F.count_if(t == "view").alias("no_timestamps"), F.count_if(~t.isin("click", "view")).alias("error"), F.coalesce(F.sum(F.when(t == "click", F.floor("value"))), F.lit(0)).alias("transitions"))


_FIT_SQL = "coalesce((SELECT max(v) FROM (VALUES " + ", ".join(f"('{a}', '{b}', {v})" for (a, b), v in dims.ENERGY_FIT.items()) + ") f(x, y, v) WHERE (x = a.change AND y = b.change) OR (x = b.change AND y = a.change)), 0.5)"
PAIR_FIT_SQL = f"""{dims.PROFILES_SQL}, fit AS (SELECT a.name AS tech_a, b.name AS tech_b, CASE WHEN list_contains(a.dislikes, b.name) THEN 0 WHEN list_contains(a.likes, b.name) THEN 0.9 ELSE 0.3 * CASE WHEN a.category = b.category THEN 1.0 ELSE 0.5 END + 0.4 * {_FIT_SQL} + 0.3 * (1 - abs(a.complexity - b.complexity)) END::DOUBLE AS score FROM prof a, prof b)"""


TRANS_TECH = [t[0] for t in dims.PROFILES]


CHAIN_SQL = f"t AS (SELECT mix_id, transition_id, {TRANS_TECH}[CAST(transition_id % 17 + 1 AS INT)] AS tech FROM v_transitions), c AS (SELECT *, lag(tech) OVER (PARTITION BY mix_id ORDER BY transition_id) AS prev FROM t)"


def technique_chain(spark, d):
    """Each transition's technique (tech_b) and the one before it in the mix (tech_a)."""
    tech = F.element_at(F.array(*map(F.lit, TRANS_TECH)), (F.col("transition_id") % 17 + 1).cast("int"))
    t = V.transitions(spark, d).select("mix_id", "transition_id", tech.alias("tech_b"))
    return t.withColumn("tech_a", F.lag("tech_b").over(Window.partitionBy("mix_id").orderBy("transition_id")))


@query("J16_technique_pair_compat", f"WITH {PAIR_FIT_SQL}, {CHAIN_SQL} SELECT prev AS tech_a, tech AS tech_b, count(*) AS uses, any_value(score) AS score FROM c JOIN fit ON tech_a = prev AND tech_b = tech GROUP BY ALL")
def j16(spark, d):
    """How often one technique follows another in a mix, and how well the two fit."""
    used = technique_chain(spark, d).where("tech_a is not null").groupBy("tech_a", "tech_b").agg(F.count("*").alias("uses"))
    return used.join(F.broadcast(dims.technique_pairs(spark)), ["tech_a", "tech_b"]).select("tech_a", "tech_b", "uses", "score")  # 17 x 17 pairs


@query("J16_transition_chain_compat", f"WITH {PAIR_FIT_SQL}, {CHAIN_SQL} SELECT transition_id, score FROM c JOIN fit ON tech_a = prev AND tech_b = tech")
def j16b(spark, d):
    """Fit of each transition's technique to the one before it in the mix."""
    return technique_chain(spark, d).join(F.broadcast(dims.technique_pairs(spark)), ["tech_a", "tech_b"]).select("transition_id", "score")
