"""Queries of spectra, chroma and pair operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seguekit.operators import series as SE
from seguekit.operators import spectra as SP
from seguekit.plans import views as V
from seguekit.plans.registry import query

r6 = lambda c: F.round(c, 6)
BAND_CASE = "CASE " + " ".join(f"WHEN freq_hz >= {lo} AND freq_hz < {hi} THEN '{n}'" for n, lo, hi in SP.BANDS) + " END"
BANDS_SQL = f"be AS (SELECT track_id, band, energy, energy / sum(energy) OVER (PARTITION BY track_id) AS share FROM (SELECT track_id, band, sum(mag * mag) AS energy FROM (SELECT track_id, mag, {BAND_CASE} AS band FROM v_spectrum) WHERE band IS NOT NULL GROUP BY track_id, band))"
EPAIRS_SQL = "ep AS (SELECT vec_id AS pair_id, vec_id AS a_id, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS b_id FROM embeddings)"


def epairs(spark, d):
    e = V.read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("pair_id"), F.col("vec_id").alias("a_id"), ((F.col("vec_id") * 7 + 3) % e.count()).alias("b_id"))


@query("A10_band_energies", f"WITH {BANDS_SQL} SELECT track_id, band, round(energy, 6) AS energy, round(share, 6) AS share FROM be")
def a10(spark, d):
    return SP.band_energies(V.spectrum(spark, d)).withColumns({"energy": r6("energy"), "share": r6("share")})


@query("A11_spectrum_summary", "WITH c AS (SELECT track_id, sum(mag * freq_hz) / sum(mag) AS c, sum(mag * freq_hz * freq_hz) / sum(mag) AS s, exp(avg(ln(mag + 1e-10))) / (avg(mag) + 1e-10) AS f FROM v_spectrum GROUP BY 1) SELECT track_id, round(c, 4) AS centroid, round(sqrt(greatest(s - c * c, 0)), 4) AS bandwidth, round(f, 6) AS flatness FROM c")
def a11(spark, d):
    return SP.spectrum_summary(V.spectrum(spark, d)).select("track_id", F.round("centroid", 4).alias("centroid"), F.round("bandwidth", 4).alias("bandwidth"), r6("flatness").alias("flatness"))


@query("A12_key_detect", "WITH t AS (SELECT 'major' AS mode, unnest([0,2,4,5,7,9,11]) AS s UNION ALL SELECT 'minor', unnest([0,2,3,5,7,8,10])), k AS (SELECT track_id, mode, (pc - s + 12) % 12 AS root, round(sum(value), 9) AS score FROM v_chroma, t GROUP BY ALL) SELECT track_id, root, mode FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, mode DESC, root) AS r FROM k) WHERE r = 1")
def a12(spark, d):
    return SP.key_detect(V.chroma(spark, d))


@query("A13_pitch_distribution", "SELECT track_id, pc, round(value / sum(value) OVER (PARTITION BY track_id), 6) AS share FROM v_chroma")
def a13(spark, d):
    return V.chroma(spark, d).select("track_id", "pc", r6(F.col("value") / F.sum("value").over(Window.partitionBy("track_id"))).alias("share"))


@query("A14_key_over_time", "WITH f AS (SELECT label, pc, value, dense_rank() OVER (PARTITION BY label ORDER BY track_id) - 1 AS frame FROM v_chroma), w AS (SELECT label, k, pc, round(avg(value), 9) AS v, count(*) AS n FROM f, (SELECT unnest(range(0, 200)) AS k) WHERE frame >= k * 5 AND frame < k * 5 + 10 GROUP BY ALL HAVING count(*) = 10) SELECT label, k, pc AS key FROM (SELECT *, row_number() OVER (PARTITION BY label, k ORDER BY v DESC, pc) AS r FROM w) WHERE r = 1")
def a14(spark, d):
    """Strongest pitch class in windows of 10 frames every 5; part windows are left out."""
    frame = F.dense_rank().over(Window.partitionBy("label").orderBy("track_id")) - 1
    f = V.chroma(spark, d).withColumn("frame", frame)
    last = F.floor(F.col("frame") / 5)
    w = f.select("label", "pc", "value", F.explode(F.filter(F.sequence(last - 1, last), lambda x: x >= 0)).alias("k")).groupBy("label", "k", "pc").agg(F.round(F.avg("value"), 9).alias("v"), F.count("*").alias("n")).where("n = 10")
    return w.groupBy("label", "k").agg(F.max_by("pc", F.struct("v", -F.col("pc"))).alias("key"))


@query("A17_groove_match", f"WITH {EPAIRS_SQL} SELECT pair_id, round(1 - 0.4 * (1 - greatest(0, coalesce(corr(a.mag, b.mag), 0))), 5) AS match FROM ep JOIN v_spectrum a ON a.track_id = a_id AND a.bin < 16 JOIN v_spectrum b ON b.track_id = b_id AND b.bin = a.bin GROUP BY pair_id")
def a17(spark, d):
    """Pattern part of the groove match over 16 bins; equal swing and complexity."""
    both = SP.sides(V.spectrum(spark, d).where("bin < 16"), epairs(spark, d), ["bin"], "mag")
    return both.groupBy("pair_id").agg(F.round(1 - 0.4 * (1 - F.greatest(F.lit(0.0), F.coalesce(F.corr("a", "b"), F.lit(0.0)))), 5).alias("match"))


@query("A19_rhythm_motifs", "WITH c AS (SELECT a.mix_id, a.bar_idx, b.bar_idx AS hit, (SELECT corr(x, y) FROM (SELECT unnest(a.features[1:4]) AS x, unnest(b.features[1:4]) AS y)) AS c FROM v_bars a JOIN v_bars b ON b.mix_id = a.mix_id AND b.bar_idx BETWEEN a.bar_idx + 1 AND a.bar_idx + 4 ) SELECT mix_id, bar_idx, min(hit) AS hit FROM c WHERE c > 0.8 GROUP BY ALL")
def a19(spark, d):
    """Bars whose four band values come back within 4 bars: a banded join by exploded offsets."""
    b = V.bars(spark, d)
    long = b.select("mix_id", "bar_idx", F.posexplode(F.slice("features", 1, 4)).alias("i", "x"))
    probe = long.select("mix_id", "bar_idx", "i", F.col("x").alias("px"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).withColumn("hit", F.col("bar_idx") + F.col("k"))
    hits = probe.join(long.select("mix_id", F.col("bar_idx").alias("hit"), "i", "x"), ["mix_id", "hit", "i"]).groupBy("mix_id", "bar_idx", "hit").agg(F.corr("px", "x").alias("c"))
    return hits.where("c > 0.8").groupBy("mix_id", "bar_idx").agg(F.min("hit").alias("hit"))


@query("A23_predict_quality", f"""WITH {EPAIRS_SQL}, g AS (SELECT pair_id, coalesce(corr(a.mag, b.mag), 0) AS c, sum(least(a.mag, b.mag)) / (sum(a.mag) + sum(b.mag)) AS o, sqrt(avg(a.mag * a.mag)) AS ra, sqrt(avg(b.mag * b.mag)) AS rb FROM ep JOIN v_spectrum a ON a.track_id = a_id JOIN v_spectrum b ON b.track_id = b_id AND b.bin = a.bin GROUP BY pair_id),
    s AS (SELECT *, 0.35 * greatest(0, c) + 0.30 * (1 - o) + 0.25 * least(ra, rb) / greatest(ra, rb) + 0.05 AS score FROM g) SELECT pair_id, round(c, 5) AS corr, round(o, 5) AS overlap, round(least(ra, rb) / greatest(ra, rb), 5) AS level, round(score, 5) AS score, score > 0.55 AS proceed FROM s""")
def a23(spark, d):
    q = SP.predict_quality(V.spectrum(spark, d), epairs(spark, d))
    return q.withColumns({c: F.round(c, 5) for c in ("corr", "overlap", "level", "score")})


_BARK = "CAST(least(floor(13 * atan(0.00076 * freq_hz) + 3.5 * atan((freq_hz / 7500) * (freq_hz / 7500))), 24) AS BIGINT)"
BARK_SQL = f"bk AS (SELECT track_id, band, e / max(e) OVER (PARTITION BY track_id) AS e FROM (SELECT track_id, {_BARK} AS band, sum(mag) AS e FROM v_spectrum GROUP BY ALL))"


@query("A24_bark_clash", f"WITH {EPAIRS_SQL}, {BARK_SQL}, g AS (SELECT pair_id, sum(a.e * b.e) / 25 AS clash, count(*) FILTER (WHERE a.e > 0.5 AND b.e > 0.5) AS loud_bands, count(*) FILTER (WHERE a.e > 0.5 AND b.e > 0.5 AND a.band <= 4) AS bass_bands FROM ep JOIN bk a ON a.track_id = a_id JOIN bk b ON b.track_id = b_id AND b.band = a.band GROUP BY pair_id) SELECT pair_id, round(clash, 6) AS clash, loud_bands, bass_bands, list_filter([CASE WHEN bass_bands > 0 THEN 'swap bass' END, CASE WHEN clash > 0.3 THEN 'cut mids' END], lambda x: x IS NOT NULL) AS advice FROM g")
def a24(spark, d):
    return SP.bark_clash(V.spectrum(spark, d), epairs(spark, d)).withColumn("clash", r6("clash"))


@query("A35_spectral_flux", "WITH f AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings), x AS (SELECT f.label, i, bin, mag - lag(mag) OVER (PARTITION BY f.label, bin ORDER BY i) AS diff FROM v_spectrum JOIN f ON vec_id = track_id) SELECT label, round(sum(greatest(diff, 0) * greatest(diff, 0)) / count(DISTINCT i), 6) AS flux, round(sqrt(sum(diff * diff)), 6) AS total FROM x GROUP BY label")
def a35(spark, d):
    e = V.read(spark, d, "embeddings").select(F.col("vec_id").alias("track_id"), "label")
    s = V.spectrum(spark, d).join(e, "track_id")
    x = s.withColumn("diff", F.col("mag") - F.lag("mag").over(Window.partitionBy("label", "bin").orderBy("track_id")))
    return x.groupBy("label").agg(r6(F.sum(F.greatest("diff", F.lit(0.0)) ** 2) / F.countDistinct("track_id")).alias("flux"), r6(F.sqrt(F.sum(F.col("diff") ** 2))).alias("total"))


GRID_SQL = "[exp(ln(0.01) + i * (ln(50) - ln(0.01)) / 59) for i in range(60)]"


@query(
    "A36_curve_fit",
    f"""WITH p AS (SELECT track_id, frame_idx / count(*) OVER (PARTITION BY track_id) AS x, sum(rms) OVER (PARTITION BY track_id ORDER BY frame_idx) AS y FROM v_frames),
    g AS (SELECT 'exponential' AS kind, unnest({GRID_SQL}) AS b, 0 AS pref UNION ALL SELECT 'linear', 1.0, 1 UNION ALL SELECT 'logarithmic', unnest({GRID_SQL}), 2),
    u AS (SELECT track_id, y, g.*, CASE kind WHEN 'exponential' THEN exp(-b * x) WHEN 'linear' THEN x ELSE ln(1 + b * x) END AS u FROM p, g),
    f AS (SELECT track_id, kind, b, pref, regr_slope(y, u) AS a, regr_intercept(y, u) AS c, regr_r2(y, u) AS r2, count(*) AS n, var_pop(y) AS v, avg(y) AS m FROM u GROUP BY ALL),
    r AS (SELECT *, n < 3 OR v <= 1e-12 AS flat, row_number() OVER (PARTITION BY track_id ORDER BY round(coalesce(r2, 0), 9) DESC, pref, b) AS k FROM f)
    SELECT track_id, CASE WHEN flat THEN 'constant' ELSE kind END AS kind, CASE WHEN flat THEN 0 ELSE b END AS b, CASE WHEN flat THEN 0 ELSE a END AS a, CASE WHEN flat THEN m ELSE c END AS c, CASE WHEN flat THEN 0 ELSE r2 END AS r2 FROM r WHERE k = 1""",
)
def a36(spark, d):
    """The cumulative energy of each whole track over its length."""
    cum = F.sum("rms").over(Window.partitionBy("track_id").orderBy("frame_idx"))
    x = F.col("frame_idx") / F.count("*").over(Window.partitionBy("track_id"))
    return SP.curve_fit(V.frames(spark, d).select("track_id", x.alias("x"), cum.alias("y")), "track_id")


@query("A37_feature_pca")
def a37(spark, d):
    """Standardised embeddings on 16 principal components; signs of components are not fixed."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = V.read(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    s = StandardScaler(withMean=True, withStd=True, inputCol="v", outputCol="s").fit(e).transform(e)
    return PCA(k=16, inputCol="s", outputCol="p").fit(s).transform(s).select("vec_id", vector_to_array("p").alias("components"))


@query("A38_frame_anomaly", "WITH z AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) / 64 AS n, pow(coalesce((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0), 2) AS z FROM (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)) WINDOW w AS (PARTITION BY label, i)) SELECT vec_id, CASE WHEN max(n) < 32 THEN 0 ELSE round(sum(z), 4) END AS score FROM z GROUP BY vec_id")
def a38(spark, d):
    """Squared z-distance within the label; under 32 rows 0."""
    long = V.read(spark, d, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    stats = long.groupBy("label", "i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n"))
    z = long.join(stats, ["label", "i"]).groupBy("vec_id").agg(F.sum(F.coalesce(F.try_divide(F.col("x") - F.col("m"), F.col("s")), F.lit(0.0)) ** 2).alias("d"), F.max("n").alias("n"))
    return z.select("vec_id", F.when(F.col("n") < 32, 0.0).otherwise(F.round("d", 4)).alias("score"))


@query("A39_stem_similarity", f"WITH {EPAIRS_SQL} SELECT pair_id, round(greatest(0, least(1, sum(a.mag * b.mag) / sqrt(sum(a.mag * a.mag) * sum(b.mag * b.mag)))), 6) AS timbre, round(greatest(0, coalesce(corr(a.mag, b.mag) FILTER (WHERE a.bin < 12), 0)), 5) AS harmony FROM ep JOIN v_spectrum a ON a.track_id = a_id JOIN v_spectrum b ON b.track_id = b_id AND b.bin = a.bin GROUP BY pair_id")
def a39(spark, d):
    both = SP.sides(V.spectrum(spark, d), epairs(spark, d), ["bin"], "mag")
    cos = F.coalesce(F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") ** 2) * F.sum(F.col("b") ** 2))), F.lit(0.0))
    low = lambda c: F.when(F.col("bin") < 12, F.col(c))
    return both.groupBy("pair_id").agg(r6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos))).alias("timbre"), F.round(F.greatest(F.lit(0.0), F.coalesce(F.corr(low("a"), low("b")), F.lit(0.0))), 5).alias("harmony"))


@query("J11_identify_tracks", "WITH m AS (SELECT label, pc, avg(value) AS x FROM v_chroma GROUP BY ALL), n AS (SELECT label, pc, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m), s AS (SELECT track_id, pc, value / sqrt(sum(value * value) OVER (PARTITION BY track_id)) AS x FROM v_chroma), k AS (SELECT s.track_id, n.label, round(sum(s.x * n.x), 9) AS c FROM s JOIN n USING (pc) GROUP BY ALL) SELECT track_id AS segment_id, label AS track_id, round(c, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY c DESC, label) AS r FROM k) WHERE r = 1 AND c > 0.7")
def j11(spark, d):
    c = V.chroma(spark, d)
    together = lambda key, x: F.transform(F.array_sort(F.collect_list(F.struct("pc", x))), lambda s: s["x"])
    library = c.groupBy("label", "pc").agg(F.avg("value").alias("x")).groupBy("label").agg(SP.unit(together("label", "x")).alias("lib")).withColumnRenamed("label", "lib_id")  # a row per label
    segments = c.withColumnRenamed("value", "x").groupBy("track_id").agg(SP.unit(together("track_id", "x")).alias("chroma")).withColumnRenamed("track_id", "segment_id")
    return SP.identify_tracks(segments, library).withColumn("similarity", r6("similarity"))


@query("J12_transient_alignment", """WITH p AS (SELECT DISTINCT a.user_id AS pair_id FROM events a), x AS (SELECT a.track_id AS pair_id, CAST(round((b.t_sec - a.t_sec) * 2000) AS INT) AS off FROM v_beats a JOIN v_frames b ON b.track_id = a.track_id AND abs(b.t_sec - a.t_sec) <= 0.054),
    o AS (SELECT pair_id, off + k AS o, count(*) AS n FROM x, (SELECT CAST(unnest(range(-4, 5)) AS INT) AS k) WHERE off + k BETWEEN -100 AND 100 GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, o) AS r FROM o) SELECT pair_id, o AS half_ms, n AS hits FROM b WHERE r = 1""")
def j12(spark, d):
    """Best offset (in half milliseconds, -50 to 50 ms) between two onset lists: only offsets near a pair's difference are counted."""
    near = 0.054
    cell = lambda t: F.floor(t / near)
    a = V.beats(spark, d).select(F.col("track_id").alias("pair_id"), F.col("t_sec").alias("ta")).withColumn("c", F.explode(F.array(cell(F.col("ta")) - 1, cell(F.col("ta")), cell(F.col("ta")) + 1)))
    b = V.frames(spark, d).select(F.col("track_id").alias("pair_id"), F.col("t_sec").alias("tb")).withColumn("c", cell(F.col("tb")))
    x = a.join(b, ["pair_id", "c"]).where(F.abs(F.col("tb") - F.col("ta")) <= near).withColumn("off", F.round((F.col("tb") - F.col("ta")) * 2000).cast("int"))
    o = x.select("pair_id", F.explode(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda k: F.col("off") + k)).alias("o")).where(F.col("o").between(-100, 100)).groupBy("pair_id", "o").agg(F.count("*").alias("n"))
    return o.groupBy("pair_id").agg(F.max(F.struct("n", (-F.col("o")).alias("k"))).alias("b")).select("pair_id", (-F.col("b.k")).alias("half_ms"), F.col("b.n").alias("hits"))


_RATIOS = "[" + ", ".join(map(str, SP.RATIOS)) + "]"


RESONANCE_SQL = f"""{EPAIRS_SQL}, pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY bin) AS i FROM (SELECT *, lag(mag) OVER w AS l, lead(mag) OVER w AS n FROM v_spectrum WINDOW w AS (PARTITION BY track_id ORDER BY bin)) WHERE mag > l AND mag > n) WHERE i <= 30),
    x AS (SELECT pair_id, a.bin AS bin_a, b.bin AS bin_b, list_filter({_RATIOS}, lambda r: abs(b.freq_hz / a.freq_hz - r) <= 0.05)[1]::DOUBLE AS ratio FROM ep JOIN pk a ON a.track_id = a_id JOIN pk b ON b.track_id = b_id), y AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY bin_a, bin_b) AS rank FROM x WHERE ratio IS NOT NULL)"""
ORDERED_RESONANCE_SQL = f"{RESONANCE_SQL}, res AS (SELECT pair_id, rank, bin_a FROM y WHERE rank <= 20)"


@query("J13_harmonic_resonance", f"WITH {RESONANCE_SQL} SELECT pair_id, rank, bin_a, bin_b, ratio FROM y WHERE rank <= 20")
def j13(spark, d):
    return SP.harmonic_resonance(V.spectrum(spark, d), epairs(spark, d))


CONFLICT_SQL = f"{EPAIRS_SQL}, {BANDS_SQL}, cf AS (SELECT pair_id, a.band, a.share AS a, b.share AS b, 2 * least(a.share, b.share) AS conflict FROM ep JOIN be a ON a.track_id = a_id JOIN be b ON b.track_id = b_id AND b.band = a.band)"


@query("J14_band_negotiation", f"""WITH {EPAIRS_SQL}, {BANDS_SQL}, x AS (SELECT pair_id, a.band, a.share AS a, b.share AS b FROM ep JOIN be a ON a.track_id = a_id JOIN be b ON b.track_id = b_id AND b.band = a.band), y AS (SELECT *, 2 * least(a, b) AS conflict, CASE WHEN greatest(a, b) = max(greatest(a, b)) OVER (PARTITION BY pair_id) THEN 1.5 WHEN band IN ('sub_bass', 'bass') THEN 1.3 WHEN band IN ('mid', 'low_mid') THEN 1.2 ELSE 1.0 END AS importance FROM x)
    SELECT pair_id, band, round(conflict, 6) AS conflict, importance::DOUBLE AS importance, CASE WHEN a > 1.2 * b THEN 'A' WHEN b > 1.2 * a THEN 'B' ELSE 'shared' END AS owner, conflict * importance > 0.6 AS critical FROM y""")
def j14(spark, d):
    return SP.band_negotiation(V.spectrum(spark, d), epairs(spark, d)).withColumn("conflict", r6("conflict"))


@query("J15_band_clash", f"WITH {EPAIRS_SQL}, {BANDS_SQL}, p AS (SELECT pair_id, a.band, a.energy * b.energy AS x FROM ep JOIN be a ON a.track_id = a_id JOIN be b ON b.track_id = b_id AND b.band = a.band) SELECT pair_id, band, round(x / max(x) OVER (PARTITION BY pair_id), 6) AS clash FROM p")
def j15(spark, d):
    x = SP.sides(SP.band_energies(V.spectrum(spark, d)), epairs(spark, d), ["band"], "energy").withColumn("x", F.col("a") * F.col("b"))
    return x.select("pair_id", "band", r6(F.coalesce(F.try_divide(F.col("x"), F.max("x").over(Window.partitionBy("pair_id"))), F.lit(0.0))).alias("clash"))


@query(
    "W29_chord_changes",
    """WITH f AS (SELECT label, track_id, pc, abs(value - lag(value) OVER (PARTITION BY label, pc ORDER BY track_id)) AS diff FROM v_chroma), c AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY track_id) - 1) * 0.5::DOUBLE AS t, c FROM (SELECT label, track_id, sum(diff) AS c FROM f WHERE diff IS NOT NULL GROUP BY ALL)),
    l AS (SELECT label, quantile_cont(c, 0.75) AS p FROM c GROUP BY label), h AS (SELECT label, t, t - lag(t) OVER (PARTITION BY label ORDER BY t) AS gap FROM c JOIN l USING (label) WHERE c > p), m AS (SELECT label, count(*) AS changes, coalesce(quantile_cont(gap, 0.5), 4.0) AS rhythm FROM h GROUP BY 1)
    SELECT l.label, coalesce(any_value(changes), 0) AS changes, coalesce(any_value(rhythm), 4.0)::DOUBLE AS rhythm_sec, coalesce(list(t::DOUBLE ORDER BY t) FILTER (WHERE changes > 3 AND gap > rhythm * 1.5), []) AS cadences FROM l LEFT JOIN m ON m.label = l.label LEFT JOIN h ON h.label = l.label GROUP BY l.label""",
)
def w29(spark, d):
    """The vectors of a label in order, half a second apart."""
    c = V.chroma(spark, d).select("label", F.col("track_id").alias("frame"), "pc", "value")
    return SP.chord_changes(c, "label", 0.5)


NOVEL_SQL = """fu AS (SELECT mix_id, bar_idx AS i, [x / (sqrt(list_dot_product(features, features)) + 1e-9) for x in features] AS u, count(*) OVER (PARTITION BY mix_id) AS n FROM v_bars), fl AS (SELECT *, least(16, n // 2) AS l FROM fu),
    fs AS (SELECT a.mix_id, a.i, d, sum(b.u[d] * (0.5 - 0.5 * cos(2 * pi() * (b.i - a.i + a.l) / (2 * a.l - 1))) * CASE WHEN b.i < a.i THEN -1 ELSE 1 END) AS v FROM fl a JOIN fl b ON b.mix_id = a.mix_id AND b.i BETWEEN a.i - a.l AND a.i + a.l - 1, (SELECT CAST(unnest(range(1, 30)) AS INT) AS d) WHERE a.l >= 2 AND a.i >= a.l AND a.i < a.n - a.l GROUP BY ALL),
    fn AS (SELECT mix_id, i, sum(v * v) AS raw FROM fs GROUP BY ALL)"""


@query("W20_checkerboard_novelty", f"WITH {NOVEL_SQL} SELECT fl.mix_id, fl.i AS bar_idx, coalesce(coalesce(raw, 0) / nullif(max(raw) OVER (PARTITION BY fl.mix_id), 0), 0) AS novelty FROM fl LEFT JOIN fn USING (mix_id, i)")
def w20_novelty(spark, d):
    return SE.checkerboard_novelty(V.bars(spark, d), "mix_id", "bar_idx", "features")


@query("W20_novelty_sections")
def w20(spark, d):
    """Sections of each mix between the peaks of its novelty, low or high."""
    b = V.bars(spark, d)
    return SE.novelty_sections(SE.checkerboard_novelty(b, "mix_id", "bar_idx", "features"), b.select("mix_id", "bar_idx", F.col("rms").alias("energy")), "mix_id", "bar_idx")