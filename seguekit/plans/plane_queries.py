"""Queries of time-frequency planes, stems, sweeps and anomalies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seguekit.operators import anomaly as AN
from seguekit.operators import fits as FT
from seguekit.operators import masking as MK
from seguekit.operators import spectra as SP
from seguekit.operators import stems as ST
from seguekit.plans import views as V
from seguekit.plans.registry import query
from seguekit.plans.spectra_queries import ORDERED_RESONANCE_SQL, epairs

CHUNK_SQL = """le AS (SELECT key, max(frame) + 1 AS n FROM v_plane GROUP BY 1), sz AS (SELECT p.*, least(a.n, b.n) AS n, greatest(1, least(a.n, b.n) // 10) AS w FROM v_label_pairs p JOIN le a ON a.key = a_id JOIN le b ON b.key = b_id),
    ca AS MATERIALIZED (SELECT pair_id, frame // w * w AS chunk_idx, bin, any_value(freq_hz) AS f, avg(mag) AS x FROM sz JOIN v_plane ON key = a_id AND frame < n GROUP BY 1, 2, 3),
    cb AS MATERIALIZED (SELECT pair_id, frame // w * w AS chunk_idx, bin, avg(mag) AS x FROM sz JOIN v_plane ON key = b_id AND frame < n GROUP BY 1, 2, 3),
    fr AS (SELECT DISTINCT bin, bin * 344.53125 AS f FROM v_plane), rc AS (SELECT s.bin AS s, t.bin AS t, t.f AS tf, abs(log2(s.f / t.f + 1e-10)) AS o FROM (SELECT bin, greatest(f, 1e-300) AS f FROM fr) s, fr t WHERE t.f > 0),
    th AS (SELECT pair_id, chunk_idx, t AS bin, max((x + 1e-10) * CASE WHEN o < 1 THEN pow(10, -o) WHEN o < 2 THEN pow(10, -2 - (o - 1) / 2) ELSE 1e-5 / (x + 1e-10) END) AS thr FROM ca JOIN rc ON s = bin WHERE 20 * log10(x + 1e-10) >= -60 GROUP BY ALL),
    mr AS MATERIALIZED (SELECT cb.pair_id, cb.chunk_idx, avg(CASE WHEN cb.x < coalesce(thr, 0) THEN 1.0 ELSE 0.0 END)::DOUBLE AS mask_ratio FROM cb LEFT JOIN th USING (pair_id, chunk_idx, bin) GROUP BY ALL),
    mo AS MATERIALIZED (SELECT *, avg(mask_ratio) OVER (PARTITION BY pair_id) AS overall FROM mr), sv AS (SELECT *, CASE WHEN overall > 0.4 THEN 'high' WHEN overall > 0.2 THEN 'medium' ELSE 'low' END AS severity FROM mo)"""


@query("A25_masking_chunks", f"WITH {CHUNK_SQL} SELECT pair_id, chunk_idx, mask_ratio, mask_ratio > 0.3 AS severe, overall, severity, CASE WHEN overall > 0.5 THEN 'aggressive_eq_carving' WHEN overall > 0.3 THEN 'bass_swap_with_mid_cut' WHEN overall > 0.15 THEN 'gentle_eq_adjustment' ELSE 'standard_crossfade' END AS action FROM sv")
def a25_chunks(spark, d):
    return MK.masking_by_chunk(V.plane(spark, d), V.label_pairs(spark, d))


@query(
    "F43_anti_masking",
    f"""WITH {CHUNK_SQL}, t AS (SELECT DISTINCT pair_id, severity, i, i / 20.0::DOUBLE AS t FROM sv, (SELECT CAST(unnest(range(21)) AS INT) AS i)) SELECT pair_id, i, CASE severity WHEN 'high' THEN 'aggressive' WHEN 'medium' THEN 'moderate' ELSE 'standard' END AS technique,
    CASE severity WHEN 'high' THEN greatest(0.1, least(1, 1 - t * 1.5)) ELSE sqrt(1 - t) END AS outgoing_low_cut, CASE severity WHEN 'high' THEN 1 - t * 0.6 WHEN 'medium' THEN 1 - t * 0.3 ELSE sqrt(1 - t) END AS outgoing_mid_cut, CASE WHEN severity = 'high' AND t > 0.5 THEN 1 + (t - 0.5) * 0.4 ELSE 1 END::DOUBLE AS incoming_presence_boost FROM t""",
)
def f43_masking(spark, d):
    """Curves by how severely the one masks the other."""
    told = MK.masking_by_chunk(V.plane(spark, d), V.label_pairs(spark, d)).select("pair_id", "severity").distinct()
    return MK.anti_masking_curves(told, 21)


@query(
    "F43_resonance_boost",
    f"WITH {ORDERED_RESONANCE_SQL}, bo AS (SELECT pair_id, list(bin_a * 344.53125::DOUBLE ORDER BY rank) FILTER (WHERE rank <= 10) AS boosted FROM res GROUP BY 1), i AS (SELECT CAST(unnest(range(21)) AS INT) AS i) SELECT pair_id, i, CASE WHEN boosted IS NULL THEN 1 ELSE pow(10, 3.0::DOUBLE * exp(-pow(i / 20.0::DOUBLE - 0.5, 2) / 0.045::DOUBLE) / 20) END::DOUBLE AS gain, coalesce(boosted, []) AS boosted FROM ep LEFT JOIN bo USING (pair_id), i",
)
def f43_resonance(spark, d):
    """A bell on the resonances of every pair."""
    p = epairs(spark, d)
    found = SP.harmonic_resonance(V.spectrum(spark, d), p).select("pair_id", "rank", (F.col("bin_a") * F.lit(344.53125)).alias("freq_a"))
    return MK.resonance_boost(found, p, 21)


STEM_SQL = """pl AS (SELECT key, ['drums', 'bass', 'vocals', 'other'][bin // 16 + 1] AS stem, frame, bin % 16 AS bin, mag FROM v_plane), ri AS MATERIALIZED (SELECT *, greatest(0, coalesce(mag - lag(mag) OVER (PARTITION BY key, stem, bin ORDER BY frame), 0)) AS rise FROM pl),
    ln AS (SELECT key, max(frame) + 1 AS n FROM v_plane GROUP BY 1), sz AS (SELECT p.*, least(a.n, b.n) AS n FROM v_label_pairs p JOIN ln a ON a.key = a_id JOIN ln b ON b.key = b_id),
    sa AS (SELECT pair_id, stem, bin, avg(mag) AS m, sum(mag * mag) AS e FROM sz JOIN ri ON key = a_id AND frame < n GROUP BY ALL), sb AS (SELECT pair_id, stem, bin, avg(mag) AS m, sum(mag * mag) AS e FROM sz JOIN ri ON key = b_id AND frame < n GROUP BY ALL),
    tn AS (SELECT pair_id, stem, greatest(0, least(1, sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m)) + 1e-10))) AS spectral, least(sqrt(sum(a.e)), sqrt(sum(b.e))) / (greatest(sqrt(sum(a.e)), sqrt(sum(b.e))) + 1e-10) AS energy_ratio,
        CASE WHEN stem = 'drums' THEN 0.5 ELSE greatest(0, coalesce(corr(a.m, b.m) FILTER (WHERE bin < 12), 0)) END AS harmonic FROM sa a JOIN sb b USING (pair_id, stem, bin) GROUP BY pair_id, stem),
    oa AS (SELECT pair_id, stem, frame, sum(rise) AS o, any_value(n) AS n FROM sz JOIN ri ON key = a_id AND frame < n GROUP BY ALL), ob AS (SELECT pair_id, stem, frame, sum(rise) AS o FROM sz JOIN ri ON key = b_id AND frame < n GROUP BY ALL),
    oc AS (SELECT pair_id, stem, n, a.o / (max(a.o) OVER w + 1e-10) AS oa, b.o / (max(b.o) OVER w + 1e-10) AS ob FROM oa a JOIN ob b USING (pair_id, stem, frame) WINDOW w AS (PARTITION BY pair_id, stem)),
    rh AS (SELECT pair_id, stem, CASE WHEN max(n) < 4 THEN 0.5 ELSE 0.6 * greatest(0, coalesce(corr(oa, ob), 0)) + 0.4 * (1 - abs(avg(CASE WHEN oa > 0.3 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN ob > 0.3 THEN 1.0 ELSE 0.0 END))) END AS rhythmic FROM oc GROUP BY ALL),
    sc AS (SELECT pair_id, stem, spectral, rhythmic, energy_ratio, harmonic, CASE WHEN stem = 'drums' THEN 0.2 * spectral + 0.45 * rhythmic + 0.2 * energy_ratio + 0.15 * harmonic ELSE 0.25 * spectral + 0.15 * rhythmic + 0.2 * energy_ratio + 0.4 * harmonic END AS score FROM tn JOIN rh USING (pair_id, stem)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY round(score, 9) DESC, stem) AS rank FROM sc)"""


def stem_scores(spark, d):
    """Four stems of sixteen bins each."""
    stem = F.element_at(F.array(*map(F.lit, ST.TECHNIQUES)), (F.floor(F.col("bin") / 16) + 1).cast("int"))
    plane = V.plane(spark, d).select("key", stem.alias("stem"), "frame", (F.col("bin") % 16).alias("bin"), "mag")
    return ST.stem_similarity(plane, V.label_pairs(spark, d))


@query("A39_stem_scores", f"WITH {STEM_SQL} SELECT * FROM rk")
def a39_scores(spark, d):
    return stem_scores(spark, d)


@query(
    "J19_morph_plan",
    f"""WITH {STEM_SQL}, st AS (SELECT unnest(['all', 'best_match', 'drums_first', 'drums', 'bass', 'vocals', 'other']) AS strategy)
    SELECT pair_id, strategy, stem, CASE WHEN strategy = 'best_match' AND rank = 2 THEN 0.4 ELSE 0.8 END::DOUBLE AS depth, score, CASE stem WHEN 'drums' THEN ['onset_replacement', 'spectral_envelope', 'multiband_crossfade'] WHEN 'vocals' THEN ['spectral_envelope', 'cross_synthesis'] ELSE ['chroma_modulation', 'spectral_envelope', 'cross_synthesis'] END AS techniques
    FROM rk, st WHERE strategy = 'all' OR (strategy = 'best_match' AND rank <= 2) OR (strategy = 'drums_first' AND stem = 'drums') OR strategy = stem""",
)
def j19_plan(spark, d):
    return ST.morph_plans(stem_scores(spark, d))


def _sweep_sql(rounds: int = 5, grid: int = 13) -> str:
    """Rounds of narrower grids, as the operator takes them."""
    out = ["pt AS MATERIALIZED (SELECT track_id AS k, CASE WHEN n > 1 THEN frame_idx / (n - 1) ELSE 0 END::DOUBLE AS x, y, frame_idx FROM (SELECT track_id, frame_idx, count(*) OVER (PARTITION BY track_id) AS n, sum(rms) OVER (PARTITION BY track_id ORDER BY frame_idx)::DOUBLE AS y FROM v_frames))"]
    out.append("wh AS MATERIALIZED (SELECT k, count(*) AS n, var_pop(y) AS v, avg(y) AS m, (ln(0.01) + ln(50.0)) / 2 AS lb FROM pt GROUP BY k)")
    for r in range(rounds):
        before = "wh" if r == 0 else f"s{r - 1}"
        half = f"((ln(50.0) - ln(0.01)) / 2 * pow(2.0 / {grid - 1}, {r}))"
        out.append(f"g{r} AS (SELECT k, exp(greatest(ln(0.01), least(ln(50.0), lb + (2.0 * g / {grid - 1} - 1) * {half}))) AS b FROM {before}, (SELECT unnest(range({grid})) AS g))")
        out.append(f"f{r} AS (SELECT k, b, regr_slope(y, 1 - exp(-b * x)) AS a, regr_intercept(y, 1 - exp(-b * x)) AS c, regr_r2(y, 1 - exp(-b * x)) AS r2 FROM g{r} JOIN pt USING (k) GROUP BY k, b)")
        out.append(f"s{r} AS MATERIALIZED (SELECT k, ln(b) AS lb, a, b, c, r2 FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(coalesce(r2, 0), 9) DESC, b) AS o FROM f{r}) WHERE o = 1)")
    out.append(f"ft AS MATERIALIZED (SELECT k, CASE WHEN n < 3 OR v <= 1e-12 THEN 'constant' ELSE 'filter_sweep' END AS kind, a, b, c, r2, n, v, m FROM wh JOIN s{rounds - 1} USING (k))")
    return ", ".join(out)


def _swept(spark, d):
    """The cumulative energy of each whole track from its first frame to its last."""
    w, n = Window.partitionBy("track_id"), F.count("*").over(Window.partitionBy("track_id"))
    return V.frames(spark, d).select("track_id", "frame_idx", F.when(n > 1, F.col("frame_idx") / (n - 1)).otherwise(0.0).alias("x"), F.sum("rms").over(w.orderBy("frame_idx")).alias("y"))


@query("A36_sweep_fit", f"WITH {_sweep_sql()} SELECT k AS track_id, kind, CASE kind WHEN 'constant' THEN 0 ELSE round(ln(b), 3) END AS log_rate, CASE kind WHEN 'constant' THEN 0 ELSE round(r2, 6) END AS r2, CASE kind WHEN 'constant' THEN 0 ELSE round(sqrt(greatest(0, (1 - r2) * v)), 6) END AS rmse, n FROM ft")
def a36_sweep(spark, d):
    fit = FT.sweep_fit(_swept(spark, d), "track_id")
    return fit.select("track_id", "kind", F.when(F.col("kind") == "constant", 0.0).otherwise(F.round(F.log("b"), 3)).alias("log_rate"), F.round("r2", 6).alias("r2"), F.round("rmse", 6).alias("rmse"), "n")


@query("A36_reconstruction", f"WITH {_sweep_sql()} SELECT k AS track_id, frame_idx, y, round(CASE kind WHEN 'constant' THEN m ELSE a * (1 - exp(-b * x)) + c END, 4) AS fitted FROM pt JOIN ft USING (k)")
def a36_reconstruction(spark, d):
    """Every curve's points and what its fit makes of them."""
    points = _swept(spark, d)
    return FT.reconstruct(points, FT.sweep_fit(points, "track_id"), "track_id").select("track_id", "frame_idx", "y", F.round("fitted", 4).alias("fitted"))


@query("A38_pca_anomaly")
def a38_pca(spark, d):
    """Distances in each label's own space of principal components (eigenvectors are beyond SQL; held against numpy in a test)."""
    e = V.read(spark, d, "embeddings")
    return AN.frame_anomaly(e.select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", 64)
