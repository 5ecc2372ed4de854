"""Hand-computed cases, edge cases and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seguekit.functions import harmony as H
from seguekit.functions import scoring as S
from seguekit.operators import asof, blocks, catalogue, series, spectra, validation
from seguekit.plans import dims
from seguekit.streaming import live


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_camelot_edges(spark):
    pairs = {("12A", "1A"): 1, ("1A", "12A"): 1, ("8A", "8B"): 1, ("8A", "10B"): 2, ("x", "8A"): 3, (None, "8A"): 3, ("8A", "8A"): 0}
    for (a, b), want in pairs.items():
        assert one(spark, H.camelot_distance(F.lit(a).cast("string"), F.lit(b)))[0] == want
    assert one(spark, H.camelot_score(F.lit("12A"), F.lit("1A")))[0] == 0.9
    assert one(spark, *(H.key_to_camelot(F.lit(k)) for k in ("Am", "C", "Aminor", "8A", "08A", "13A", "Cmaj", "Amin"))) == ("8A", "8B", None, "8A", "8A", None, "8B", "8A")
    assert one(spark, catalogue.camelot_friends(F.lit("12A")))[0] == ["12A", "1A", "11A", "12B"]
    assert one(spark, catalogue.camelot_friends(F.lit("junk")))[0] == []


def test_queue_score_example(spark):
    x = lambda a, b: [F.lit(v) for v in (*a, *b)]
    assert math.isclose(one(spark, S.queue_score(*x((128.0, 126.0), ("8A", "9A")), F.lit(0.70), F.lit(0.65)))[0], 0.831875)
    assert math.isclose(one(spark, S.queue_score(*x((128.0, 128.0), ("12A", "1A")), F.lit(0.5), F.lit(0.5)))[0], 0.4 + 0.4 * 0.2 + 0.2)


def test_tempo_rate_and_loose_types(spark):
    assert one(spark, S.tempo_rate(F.lit(128.0), F.lit(64.0)))[0] == 1.0
    texts = {"123": 123.0, "[123.0]": 123.0, "[123.0, 90]": 123.0, "[]": None, "fast": None, None: None}
    assert [one(spark, S.parse_tempo(F.lit(t).cast("string")))[0] for t in texts] == list(texts.values())
    assert one(spark, *(S.truthy(F.lit(v).cast("string")) for v in ("True", "true", "False", None))) == (True, True, False, False)
    assert one(spark, *(S.timestamp_to_seconds(F.lit(t)) for t in ("1:05", "1:02:03", "x", "5"))) == (65, 3723, None, None)


def test_asof_edges(spark):
    s = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 3.0), (1, 2.0, 9.0), (1, 4.0, 5.0)], "k int, at double, v double")
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate([-1.0, 0.0, 1.0, 2.0, 3.0, 9.0])] + [(2, 9, 1.0)], "k int, p int, t double")
    near = {r.p: (r.near_t, r.near_v) for r in asof.nearest(p, s, "k", "p", "at", "v").collect()}
    assert near == {0: (0.0, 1.0), 1: (0.0, 1.0), 2: (0.0, 1.0), 3: (2.0, 3.0), 4: (2.0, 3.0), 5: (4.0, 5.0), 9: (None, None)}
    value = {r.p: r.v for r in asof.interpolate(p, s, "k", "p", "at", "v").collect()}
    assert value[0] == 1.0 and value[2] == 2.0 and value[3] == 3.0 and value[5] == 5.0 and value[9] is None
    parts = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0), (1, 2, 35.0, 99.0)], "k int, idx int, start_sec double, end_sec double")
    at = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (1, 2, 2.0), (1, 3, 70.0), (2, 4, 0.0)], "k int, p int, t double")
    hit = {r.p: r.idx for r in asof.in_interval(at, parts, "k", "p").collect()}
    assert hit == {0: 0, 1: 1, 2: None, 3: 2, 4: None}
    assert {r.p: r.idx for r in asof.in_interval(at, parts, "k", "p", closed=True).collect()}[1] == 0


def brute_peaks(x, height, distance):
    out = []
    for i in range(1, len(x) - 1):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            out.append((i + j) // 2)
    out = [i for i in out if x[i] >= height]
    kept = []
    for i in sorted(out, key=lambda i: (-x[i], -i)):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    return sorted(kept)


def test_peaks():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(0, 6, 40).astype(float)
        assert series.peaks(x, height=2, distance=3).tolist() == brute_peaks(x.tolist(), 2, 3)
    assert series.peaks(np.array([0, 2, 1.5, 3, 0]), prominence=0.5).tolist() == [1, 3]
    assert series.peaks(np.array([0, 2, 1.6, 3, 0]), prominence=0.5).tolist() == [3]


def test_gap_and_islands(spark):
    df = spark.createDataFrame([(1, 0.0, 0.5), (1, 30.0, 0.9), (1, 59.0, 0.1), (1, 90.0, 0.2), (1, 150.0, 0.3)], "k int, t double, c double")
    assert [r.t for r in series.min_gap(df, "k", "t", "c").orderBy("t").collect()] == [30.0, 90.0, 150.0]
    runs = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0])], "k int, i int, v double")
    assert [(r.start_idx, r.end_idx) for r in series.islands(runs, "k", "i", "v", 0.5).orderBy("start_idx").collect()] == [(0, 1), (3, 3), (5, 6)]
    assert series.islands(runs, "k", "i", "v", 2.0).count() == 0


def test_silent_bar_is_no_distance(spark):
    got = one(spark, series.cosine_distance(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))), series.cosine_distance(F.array(F.lit(1.0)), F.lit(None).cast("array<double>")))
    assert got == (0.0, 0.0)


def test_gaussian_keeps_a_constant(spark):
    df = spark.createDataFrame([(1, i, 3.0) for i in range(3)], "k int, i int, v double")
    assert all(math.isclose(r.smooth, 3.0) for r in blocks.gaussian_smooth(df, "k", "i", "v", 2.0).collect())


def test_curve_fit_finds_the_family(spark):
    xs = [i / 20 for i in range(40)]
    curves = {1: [2 * math.exp(-3 * x) + 1 for x in xs], 2: [4 * x - 1 for x in xs], 3: [math.log(2 * x + 1) for x in xs], 4: [5.0] * 40, 5: [1.0, 2.0]}
    df = spark.createDataFrame([(k, x, y) for k, ys in curves.items() for x, y in zip(xs, ys, strict=False)], "k int, x double, y double")
    got = {r.k: r for r in spectra.curve_fit(df, "k").collect()}
    assert got[1].kind == "exponential" and got[1].r2 > 0.999
    assert got[2].kind in ("linear", "exponential", "logarithmic") and got[2].r2 > 0.999
    assert got[3].r2 > 0.999 and got[4].kind == "constant" and got[4].r2 == 0.0 and got[5].kind == "constant"


def test_split_shares_and_draws(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(200)], "id int, g string")
    n = {(r.g, r.split): r["count"] for r in dims.stratified_split(df, "id", "g", 42).groupBy("g", "split").count().collect()}
    assert n == {(g, s): c for g in "ab" for s, c in (("train", 70), ("val", 15), ("test", 15))}
    options = spark.createDataFrame([(i, o, w) for i in range(400) for o, w in (("x", 0.8), ("y", 0.2))], "k int, o string, weight double")
    drawn = dims.weighted_draw(options, "k", "o", 1).collect()
    assert 280 < sum(r.o == "x" for r in drawn) < 360
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, dims.weighted_draw(options.repartition(7), "k", "o", 1).collect()))


def test_document_errors(spark):
    docs = ['{"song_id": 1}', "{broken", "{}", None, '{"song_id": null, "structure": {"sections": [{"type": "a"}]}}']
    got = [r[0] for r in spark.createDataFrame([(d,) for d in docs], "d string").select(validation.document_errors(F.col("d"), ("song_id",))).collect()]
    assert got == [[], ["Invalid JSON"], ["Missing required field: song_id"], ["Invalid JSON"], ["structure.sections[0].start_sec is required", "structure.sections[0].end_sec is required"]]


def test_transition_errors_read_a_document_once(spark):
    track = '{"song_id": 1, "bpm": null, "key": "C", "camelot": "8B"}'
    docs = ["{broken", None, "{}", f'{{"transition_id": null, "track_a_features": {track}, "track_b_features": [1], "transition_execution": {{"duration_sec": 1, "volume_curves": {{"track_a_gain_db": []}}}}}}']
    got = [r[0] for r in spark.createDataFrame([(d,) for d in docs], "d string").select(validation.transition_errors(F.col("d"))).collect()]
    assert got == [["Invalid JSON"], ["Invalid JSON"], [f"Missing required field: {f}" for f in validation.TRANSITION_FIELDS], ["transition_execution.technique_primary is required", "volume_curves requires track_a_gain_db and track_b_gain_db"]]
    plan = spark.range(1).select(validation.transition_errors(F.to_json(F.struct("id"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator(") == 1 and plan.count("get_json_object(") <= 8  # the plan names each of four paths twice


def test_queue_state(spark):
    rows = [(0, "add", "z", None, {}), (1, "clear", None, None, None), (2, "add", "a", None, {"x": "1"}), (3, "status", "a", "playing", {"y": "2"}), (4, "status", "ghost", "playing", {}), (5, "add", "b", None, None), (6, "remove", "b", None, None), (7, "status", "a", None, {"x": "3"})]
    got = catalogue.queue_state(spark.createDataFrame(rows, "seq long, op string, item_id string, status string, meta map<string,string>")).collect()
    assert [(r.item_id, r.status, r.meta) for r in got] == [("a", "playing", {"y": "2", "x": "3"})]


@pytest.mark.parametrize("op", [live.listener_sessions, live.rate_violations, live.live_status])
def test_stream_equals_batch(spark, op, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    (tmp_path / "in").mkdir()
    batch.repartition(3).write.parquet(str(tmp_path / "in" / "events"))
    stream = live.stream_events(spark, str(tmp_path / "in" / "events"), batch.schema)
    run = (lambda df: op(df, most=1)) if op is live.rate_violations else op
    got = live.run_once(run(live.with_event_time(stream)), op.__name__, str(tmp_path / "cp")).collect()
    assert sorted(map(str, got)) == sorted(map(str, run(live.with_event_time(batch)).collect()))


def test_rate_violations_begin_above_thirty_in_an_hour(spark):
    at = lambda i: f"2024-01-01 {10 + i // 60:02d}:{i % 60:02d}:00"
    rows = [(u, at(i)) for u, n in ((1, 30), (2, 31)) for i in range(n)] + [(3, at(45 + i)) for i in range(31)]
    df = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [(r.user_id, r.n) for r in live.rate_violations(df).collect()] == [(2, 31)]
