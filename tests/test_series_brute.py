"""Operators without SQL, and buckets of ranks, against brute force on generated rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seguekit.functions.scoring import queue_score
from seguekit.operators import blocks, ranks, sections, series
from seguekit.plans import dims


def slow_peaks(x, height, distance):
    """Local maxima (plateaus at their middle), the highest first, none within the distance of a higher one."""
    found, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            found.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted((p for p in found if x[p] >= height), key=lambda p: (-x[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return sorted(kept)


def test_find_peaks(spark):
    rng = random.Random(1)
    rows = [(k, i, float(rng.choice([0.1, 0.2, 0.3, 0.5, rng.random()]))) for k in range(6) for i in range(80)]
    got = series.split_peaks(spark.createDataFrame(rows, "k long, i long, v double"), "k", "i", "v", height=0.25, distance=4)
    by = {k: [v for kk, _, v in rows if kk == k] for k in range(6)}
    assert sorted((r.k, r.i) for r in got.collect()) == sorted((k, p) for k, x in by.items() for p in slow_peaks(x, 0.25, 4))


def slow_novelty(x, half=16):
    """The sum of the tapered checkerboard kernel over the similarity matrix, at every place."""
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    s, n = u @ u.T, len(x)
    size = min(half, n // 2)
    out = np.zeros(n)
    if size >= 2:
        sign = np.r_[-np.ones(size), np.ones(size)]
        kernel = np.outer(np.hanning(2 * size), np.hanning(2 * size)) * np.outer(sign, sign)
        for i in range(size, n - size):
            out[i] = max(0.0, (s[i - size : i + size, i - size : i + size] * kernel).sum())
    return out / out.max() if out.max() > 0 else out


@pytest.mark.parametrize("lengths", [(90, 40, 7, 1)])
def test_novelty_and_sections(spark, lengths):
    rng = np.random.default_rng(2)
    rows, energy, data = [], [], {}
    for k, n in enumerate(lengths):
        x = rng.random((n, 5)) * 0.2 + np.repeat(rng.random((-(-n // 25), 5)), 25, axis=0)[:n]
        e = rng.random(n)
        data[k] = (x, e)
        rows += [(k, i, x[i].tolist()) for i in range(n)]
        energy += [(k, i, float(e[i])) for i in range(n)]
    nov = series.checkerboard_novelty(spark.createDataFrame(rows, "k long, i long, f array<double>"), "k", "i", "f").cache()
    got = {(r.k, r.i): r.novelty for r in nov.collect()}
    want = {k: slow_novelty(x) for k, (x, _) in data.items()}
    assert all(abs(got[k, i] - v) < 1e-6 for k, x in want.items() for i, v in enumerate(x)) and len(got) == sum(lengths)
    sections = series.novelty_sections(nov, spark.createDataFrame(energy, "k long, i long, energy double"), "k", "i").collect()
    expect = []
    for k, (_, e) in data.items():
        snap = {p: int(np.round(p / 4)) * 4 for p in slow_peaks(want[k], 0.3, 16)}
        borders = sorted({0, *(s for p, s in snap.items() if abs(s - p) <= 1.6)}) + [len(e)]
        for a, b in zip(borders, borders[1:], strict=False):
            own = [e[i] for i in range(a, b) if i % 4 == 0]
            if b - a >= 4:
                expect.append((k, a, b, "high" if np.mean(own) >= np.median(e[::4]) else "low"))
    assert sorted((r.k, r.start_idx, r.end_idx, r.label) for r in sections) == expect and len(expect) > 5


def test_bucketed_rank_and_pareto(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randint(0, 500), i) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, k long, i long")
    got = ranks.bucketed_rank(df, ["g"], F.floor(F.col("k") / 37), ["k", "i"]).collect()
    for g in ("hot", "b", None):
        assert [r.i for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == [i for _, _, i in sorted((x for x in rows if x[0] == g), key=lambda x: x[1:])]
    board = [(i, rng.choice([0.1, 0.5, rng.random()]), rng.choice([0.2, rng.random()])) for i in range(150)]
    front = ranks.pareto(spark.createDataFrame(board, "i long, best double, mean double"), buckets=20).collect()
    assert sorted(r.i for r in front) == [i for i, b, m in board if not any(x > b and y >= m for _, x, y in board)]
    assert ranks.pareto(spark.createDataFrame([], "i long, best double, mean double")).collect() == []


def test_variety_penalty(spark):
    rng = random.Random(4)
    rows = [(s, t, o, round(rng.random(), 3)) for s in range(5) for t in range(12) for o in "abcd"]
    got = {(r.s, r.t): r.o for r in series.variety_penalty(spark.createDataFrame(rows, "s long, t long, o string, v double"), "s", "t", "o", "v").collect()}
    for s in range(5):
        past = []
        for t in range(12):
            own = {o: v for ss, tt, o, v in rows if (ss, tt) == (s, t)}
            for o, p in zip(past[::-1][:3], (0.4, 0.2, 0.1), strict=False):
                if past[::-1].index(o) == (0.4, 0.2, 0.1).index(p):
                    own[o] -= p
            best = max(own, key=lambda o: (own[o], -ord(o)))
            assert got[s, t] == best
            past.append(best)


def test_order_playlists(spark):
    rng = random.Random(5)
    songs = [(i, f"p{i % 3}", float(rng.randint(80, 130)), f"{rng.randint(1, 12)}{rng.choice('AB')}", rng.random()) for i in range(40)]
    df = spark.createDataFrame(songs, "song_id long, playlist string, bpm double, camelot string, energy double")
    side = lambda x: df.select(F.col("song_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("bpm", "camelot", "energy")))
    both = side("a").crossJoin(side("b")).select("a", "b", queue_score(*(F.col(f"{c}_{x}") for c in ("bpm", "camelot", "energy") for x in "ab")).alias("s"))
    score = {(r.a, r.b): r.s for r in both.collect()}
    got = {}
    for r in dims.order_playlists(df).collect():
        got.setdefault(r.playlist, {})[r.position] = r.song_id
    for p, places in got.items():
        rest = sorted(i for i, q, *_ in songs if q == p)
        order = [rest.pop(0)]
        while rest:
            options = [(score[order[-1], x] + (1 - k / len(rest)) * 0.1, -k, x) for k, x in enumerate(rest[:5])]
            order.append(max(options)[2])
            rest.remove(order[-1])
        assert [places[i] for i in range(len(places))] == order


def test_stratified_split_is_exact_in_every_stratum(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 5}") for i in range(600)]
    got = dims.stratified_split(spark.createDataFrame(rows, "song_id long, genre string"), "song_id", "genre", 42).collect()
    assert len(got) == 600
    sizes, parts = Counter(g for _, g in rows), Counter((r.genre, r.split) for r in got)
    for g, n in sizes.items():
        assert parts[g, "train"] == sum(k / n < 0.7 for k in range(n)) and parts[g, "val"] == sum(0.7 <= k / n < 0.85 for k in range(n))


# --- series in blocks ---------------------------------------------------------------------------------------------


def mirrored(x, sigma):
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, radius, "symmetric"), w / w.sum(), "valid")


@pytest.mark.parametrize("size", [16, 64, 4096])
def test_kernels_in_blocks_equal_whole_series(spark, size):
    rng = np.random.default_rng(4)
    series_of = {k: rng.random(n).cumsum() % 3 for k, n in enumerate((1, 2, 15, 16, 17, 33, 300))}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series_of.items() for i, v in enumerate(x)], "k long, i long, v double").repartition(4)
    got = {(r.k, r.i): r.smooth for r in blocks.gaussian_smooth(df, "k", "i", "v", 5.0, size).collect()}
    assert len(got) == sum(map(len, series_of.values()))
    for k, x in series_of.items():
        assert np.allclose([got[k, i] for i in range(len(x))], mirrored(x, 5.0))
    changed = {(r.k, r.i): r.change for r in blocks.energy_change(df, "k", "i", "v", 9, 4, size).collect()}
    for k, x in series_of.items():
        slope = np.gradient(mirrored(x, 9)) if len(x) > 1 else np.zeros(1)
        want = mirrored(np.abs(slope), 4)
        want = (want - want.min()) / np.ptp(want) if np.ptp(want) > 0 else want
        assert np.allclose([changed[k, i] for i in range(len(x))], want, atol=1e-7)


@pytest.mark.parametrize("size", [8, 50, 4096])
@pytest.mark.parametrize(("height", "distance", "prominence"), [(None, 1, None), (0.3, 5, None), (None, 9, 0.3), (0.2, 2, 0.6)])
def test_peaks_in_blocks_equal_whole_series(spark, size, height, distance, prominence):
    """Noise, plateaus, and slopes on which suppression runs through the whole series."""
    rng = np.random.default_rng(5)
    chain = np.where(np.arange(400) % 2, np.linspace(0.5, 1, 400), 0)
    series_of = {0: rng.random(300), 1: rng.integers(0, 3, 400) / 3, 2: chain, 3: chain[::-1], 4: np.array([0.5]), 5: np.zeros(90), 6: np.concatenate(([0], np.ones(120), [0]))}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series_of.items() for i, v in enumerate(x)], "k long, i long, v double").repartition(4)
    got = {(r.k, r.i, r.v) for r in blocks.split_peaks(df, "k", "i", "v", height, distance, prominence, size).collect()}
    assert got == {(k, int(i), float(x[i])) for k, x in series_of.items() for i in series.peaks(x, height, distance, prominence)}


def test_peaks_of_just_the_prominence_in_blocks(spark):
    """Values of two decimals over 500: differences that stand on either side of the threshold by rounding only."""
    x = np.array([0.0, *(v / 500 for i in range(300) for v in (75 + i * 0.61, 50 + i * 0.61)), 0.0])
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "k long, i long, v double")
    got = sorted(r.i for r in blocks.split_peaks(df, "k", "i", "v", 0.1, 1, 0.05, 64).collect())
    assert got == series.peaks(x, 0.1, 1, 0.05).tolist()
    assert 1 < len(got) < 300


def test_blocks_of_empty_series(spark):
    df = spark.createDataFrame([], "k long, i long, v double")
    assert blocks.gaussian_smooth(df, "k", "i", "v", 2.0).count() == blocks.split_peaks(df, "k", "i", "v").count() == blocks.energy_change(df, "k", "i", "v").count() == 0


def test_segments_between_extremes(spark):
    x = [0.5 + 0.5 * float(np.sin(i / 12)) for i in range(300)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)] + [(2, i, 0.25) for i in range(300)], "k long, i long, v double")
    rows = sections.energy_segments(df, "k", "i", "v", 0.25).orderBy("k", "start_sec").collect()
    wave = [r for r in rows if r[0] == 1]
    assert len(wave) == 9 and wave[0].start_sec == 0 and wave[-1].end_sec == 299 * 0.25
    assert all(a.end_sec == b.start_sec for a, b in zip(wave, wave[1:]))
    assert all(abs(r.energy - np.mean(x[int(r.start_sec * 4) : int(r.end_sec * 4)])) < 1e-9 for r in wave)
    flat = [r for r in rows if r[0] == 2]
    assert [(r.start_sec, r.end_sec) for r in flat] == [(i * 18.75, (i + 1) * 18.75) for i in range(4)]
