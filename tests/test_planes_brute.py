"""Masking, stems, sweeps and anomalies against plain loops and numpy."""

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from seguekit.operators import anomaly, fits, masking, stems
from seguekit.operators.series import robust_norm


def test_thresholds_equal_plain_loops():
    rng = np.random.default_rng(1)
    freqs = np.arange(20) * 100.0
    for spectrum in (rng.random(20), rng.random(20) * 1e-4, np.zeros(20)):
        want = np.zeros(20)
        for j in range(1, 20):
            for i in range(20):
                level = 20 * math.log10(spectrum[i] + 1e-10)
                if level < -60:
                    continue
                octaves = abs(math.log2(freqs[i] / freqs[j] + 1e-10))
                db = level - 20 * octaves if octaves < 1 else level - 40 - 10 * (octaves - 1) if octaves < 2 else -100
                want[j] = max(want[j], 10 ** (db / 20))
        assert np.allclose(masking.thresholds(spectrum[None], freqs)[0], want, rtol=1e-9, atol=1e-15)


def test_masking_of_equal_and_silent_sides(spark):
    plane = spark.createDataFrame([(k, f, b, b * 100.0, v) for k, v in ((1, 1.0), (2, 1e-9), (3, 1.0)) for f in range(23 if k == 1 else 25) for b in range(8)], "key long, frame long, bin int, freq_hz double, mag double")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 2, 1), (3, 1, 3)], "pair_id long, a_id long, b_id long")
    rows = defaultdict(list)
    for r in masking.masking_by_chunk(plane, pairs).orderBy("pair_id", "chunk_idx").collect():
        rows[r.pair_id].append(r)
    assert [r.chunk_idx for r in rows[1]] == list(range(0, 23, 2))  # ten chunks of two frames, and the rest
    assert all(r.mask_ratio == 7 / 8 and r.severe and r.severity == "high" for r in rows[1])
    assert all(r.mask_ratio == 0 and r.action == "standard_crossfade" for r in rows[2])
    assert all(r.mask_ratio <= 7 / 8 for r in rows[3])


def test_anomaly_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = {1: rng.standard_normal((80, 6)) @ rng.standard_normal((6, 6)) + 50, 2: rng.random((40, 6)) * [1, 1, 1, 0, 1, 1], 3: rng.random((31, 6)), 4: np.ones((33, 6))}
    x[1][7] += 30
    rows = [(k, i, [float(v) for v in r]) for k, m in x.items() for i, r in enumerate(m)]
    df = spark.createDataFrame(rows, "k long, i long, v array<double>").repartition(5)
    got = {(r.k, r.i): r for r in anomaly.frame_anomaly(df, "k", "i", "v", 6, components=3).collect()}
    assert len(got) == len(rows)
    for k, m in x.items():
        z = (m - m.mean(axis=0)) / np.where(m.std(axis=0) > 1e-9, m.std(axis=0), 1)
        values, vectors = np.linalg.eigh(z.T @ z / len(z))
        top = [j for j in np.argsort(values)[::-1][:3] if values[j] > 1e-9]
        want = ((z @ vectors[:, top]) ** 2 / values[top]).sum(axis=1) if len(m) >= 32 else np.zeros(len(m))
        assert np.allclose([got[k, i].distance for i in range(len(m))], want, rtol=1e-6, atol=1e-6)
    assert got[1, 7].score == 1.0 and got[3, 0].score == 0.0 and got[4, 0].score == 0.0


def test_sweeps_find_their_rates(spark):
    rates = {1: 0.05, 2: 1.0, 3: 7.3, 4: 40.0}
    rows = [(k, i / 99, 300 + 4000 * (1 - math.exp(-b * i / 99))) for k, b in rates.items() for i in range(100)]
    rows += [(5, 0.0, 1.0), (5, 1.0, 2.0)] + [(6, i / 9, 5.0) for i in range(10)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    fit = fits.sweep_fit(df, "k", rounds=7)
    got = {r.k: r for r in fit.collect()}
    for k, b in rates.items():
        assert abs(math.log(got[k].b / b)) < 0.05 and got[k].r2 > 0.99999 and got[k].rmse < 2
    assert got[5].kind == got[6].kind == "constant" and got[5].c == 1.5 and got[6].rmse == 0
    worst = fits.reconstruct(df, fit, "k").groupBy("k").agg(F.max(F.abs(F.col("y") - F.col("fitted"))).alias("e"))
    assert all(r.e < (5 if r.k < 5 else 0.6) for r in worst.collect())


def test_stems_that_agree_and_plans(spark):
    rng = np.random.default_rng(3)
    base = rng.random((12, 16))
    rows = [(k, s, f, b, float(base[f, b] * g)) for k, g in ((1, 1.0), (2, 3.0)) for s in stems.TECHNIQUES for f in range(12) for b in range(16)]
    rows += [(3, "drums", f, b, 0.0) for f in range(3) for b in range(16)]
    plane = spark.createDataFrame(rows, "key long, stem string, frame long, bin int, mag double")
    ranked = stems.stem_similarity(plane, spark.createDataFrame([(1, 1, 2), (2, 1, 3)], "pair_id long, a_id long, b_id long"))
    got = {(r.pair_id, r.stem): r for r in ranked.collect()}
    assert math.isclose(got[1, "bass"].spectral, 1, abs_tol=1e-6) and math.isclose(got[1, "bass"].rhythmic, 1, abs_tol=1e-6) and math.isclose(got[1, "bass"].energy_ratio, 1 / 3, abs_tol=1e-6)
    assert got[1, "drums"].harmonic == 0.5 and (got[2, "drums"].rhythmic, got[2, "drums"].spectral, got[2, "drums"].energy_ratio) == (0.5, 0, 0)
    assert [s for p, s in got if p == 2] == ["drums"]
    plans = defaultdict(dict)
    for r in stems.morph_plans(ranked, 0.6).where("pair_id = 1").collect():
        plans[r.strategy][r.stem] = r.depth
    best = sorted((r.rank, r.stem) for (p, _), r in got.items() if p == 1)
    assert plans["best_match"] == {best[0][1]: 0.6, best[1][1]: 0.3} and len(plans["all"]) == 4
    assert plans["drums_first"] == plans["drums"] == {"drums": 0.6} and plans["vocals"] == {"vocals": 0.6}


def test_robust_norm_of_a_flat_series(spark):
    assert {r.s for r in robust_norm(spark.createDataFrame([(1, 2.0)] * 5, "k long, v double"), "k", "v", "s").collect()} == {0.0}
