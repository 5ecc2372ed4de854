"""Tempo morphs, set markers, marked tracklists, documents, track cells and streams with late rows."""

import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from seguekit.operators import catalogue, morphs, quality, spectra, tracklists
from seguekit.sources import files
from seguekit.streaming import live


def morph(spark, a, b, pct, points=9, seconds=32.0):
    df = spark.createDataFrame([(1, a, b, seconds, points, pct)], "pair_id long, tempo_a double, tempo_b double, duration_sec double, points int, max_pct double")
    out = {}
    for r in morphs.tempo_morph(df).orderBy("shape", "i").collect():
        out.setdefault(r["shape"], []).append(r)
    return out


def test_tempo_morph_shapes_clamp_and_integral(spark):
    got = morph(spark, 120.0, 150.0, 0.1)
    assert sorted(got) == sorted(morphs.SHAPES)
    for shape, rows in got.items():
        tempo = [r.tempo for r in rows]
        assert len(rows) == 9 and math.isclose(tempo[-1], 132.0) and tempo == sorted(tempo)  # 10 % of 120 is the most
        assert shape == "stepped" or math.isclose(tempo[0], 120.0)
        passed, want = 0.0, [0.0]
        for x, y in zip(rows, rows[1:], strict=False):
            passed += (120 / x.tempo + 120 / y.tempo) / 2 * 4.0
            want.append(passed)
        assert [r.elapsed for r in rows] == pytest.approx(want)
    assert min(r.tempo for r in morph(spark, 120.0, 60.0, 0.05)["linear"]) == pytest.approx(114.0)


def test_stepped_morph_is_a_loop_over_steps(spark):
    got = morph(spark, 120.0, 130.0, 0.2, points=50, seconds=20.0)["stepped"]
    steps, want = max(4, int(20.0 * 120 / 60) // 4), [0.0] * 50
    for k in range(steps):
        for i in range(k * 50 // steps, (k + 1) * 50 // steps):
            want[i] = 120 + 10 * (k + 1) / steps
    assert [r.tempo for r in got] == pytest.approx(want)


def test_no_morph_where_none_is_due(spark):
    for b, pct in ((120.4, 0.1), (150.0, 0.0), (150.0, -1.0)):
        assert all(r.tempo == 120.0 and r.stretch == 1.0 for rows in morph(spark, 120.0, b, pct).values() for r in rows)
    one = morph(spark, 120.0, 130.0, 0.1, points=1)
    assert [(len(rows), rows[0].elapsed) for rows in one.values()] == [(1, 0.0)] * 4
    assert morph(spark, 120.0, 130.0, 0.1, points=0) == {}


def test_set_markers_follow_a_loop(spark):
    rng = random.Random(3)
    rows = [(m, i, rng.randint(0, 90), rng.randint(0, 60), rng.randint(1, 20), rng.randint(30, 200)) for m in range(12) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "mix_id long, at long, t1 long, b_in long, blend long, b_length long")
    want = []
    for m in range(12):
        pos = resume = 0
        own = [r for r in rows if r[0] == m]
        for n, (_, _, t1, b_in, blend, length) in enumerate(own):
            body = max(0, t1 - resume)
            want += [(m, "track", n, pos, pos + body), (m, "transition", n, pos + body, pos + body + blend)]
            pos, resume = pos + body + blend, b_in + blend
        want.append((m, "track", len(own), pos, pos + max(0, length - resume)))
    assert sorted(map(tuple, morphs.set_markers(df, "mix_id", "at").collect())) == sorted(want)


def test_marked_tracklists_follow_a_fold(spark):
    rng, rows, want = random.Random(5), [], []
    for mix in range(40):
        current, found = None, 0
        for i in range(rng.randint(0, 12)):
            name = rng.choice(["Transition", "transition", "Song A", "Song B - live", None, "no time"])
            rows.append((mix, i, name if name in (None, "no time") else f" {i}:{i % 60:02d}  {name} "))
            if name in (None, "no time"):
                continue
            to = f"Track_{found + 2}" if name.lower() == "transition" else name
            if current is None:
                current = "Track_1" if name.lower() == "transition" else name
                continue
            want.append((mix, i * 60 + i % 60, current, to))
            found += 1
            current = f"Track_{found + 1}" if name.lower() == "transition" else name
    df = spark.createDataFrame(rows, "mix_id long, n int, text string")
    assert sorted(map(tuple, tracklists.marked_transitions(df, "mix_id", "n").collect())) == sorted(want)


def test_document_lookup_reads_one_shelf(spark, tmp_path):
    path = str(tmp_path / "docs")
    files.write_documents(spark.range(500).select(F.col("id").cast("string").alias("doc_id"), F.to_json(F.struct("id")).alias("body")), path, 8)
    one = files.get_document(spark, path, 8, "77")
    assert [tuple(r) for r in one.collect()] == [("77", '{"id":77}')]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shelf" in plan and "PushedFilters" in plan
    shelves = one.sparkSession.read.parquet(path).where("doc_id = '77'").select("shelf").first()[0]
    assert f" = {shelves})" in plan
    assert files.get_document(spark, path, 8, "none").collect() == []
    asked = spark.createDataFrame([("3",), ("none",), (None,)], "doc_id string")
    assert sorted(map(tuple, files.get_documents(spark, path, 8, asked).collect()), key=repr) == sorted([("3", '{"id":3}'), ("none", None), (None, None)], key=repr)


def clustered(rng, n, centres):
    rows = []
    for i in range(n):
        v = [abs(x + rng.gauss(0, 0.05)) for x in centres[i % len(centres)]]
        size = math.sqrt(sum(x * x for x in v))
        rows.append((i, [x / size for x in v]))
    return rows


def test_cells_leave_out_and_lose_nothing(spark):
    rng = random.Random(8)
    centres = [[float(rng.random() < 0.25) for _ in range(12)] for _ in range(12)]
    lib, seg = clustered(rng, 900, centres), clustered(rng, 150, centres) + [(1000 + i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(20)]
    seg = [(i, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for i, v in seg]
    lib += [(900, lib[0][1]), (901, None)]  # a copy, and one without a vector
    library, segments = spark.createDataFrame(lib, "lib_id long, lib array<double>"), spark.createDataFrame([*seg, (5000, None)], "segment_id long, chroma array<double>")
    want = {}
    for i, v in seg:
        s, k = max((round(sum(a * b for a, b in zip(v, u, strict=True)), 9), -j) for j, u in lib if u)
        if s > 0.7:
            want[i] = (-k, s)
    got = {r.segment_id: (r.track_id, r.similarity) for r in spectra.identify_tracks(segments, library, block=50).collect()}
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in want.items()}
    assert [got[i][1] for i in sorted(got)] == pytest.approx([want[i][1] for i in sorted(got)])
    _, cells = spectra.library_cells(library.where("lib is not null"))
    asked = segments.where("chroma is not null").select(F.size(spectra.cells_to_ask(F.col("chroma"), cells, 0.7)).alias("n")).agg(F.sum("n")).first()[0]
    assert asked < 0.6 * len(seg) * len(cells)
    assert spectra.identify_tracks(segments, library.where("false")).collect() == []


LATE = [
    [("2024-01-01 10:00:01", 1, 0.5), ("2024-01-01 10:00:02", 1, 1.5), ("2024-01-01 10:30:00", 1, 4.0)],
    [("2024-01-01 10:00:03", 1, 9.0), ("2024-01-01 11:30:00", 1, 1.0)],  # the first is later than the watermark of 10:20
    [("2024-01-01 13:00:00", 1, 2.0)],
]


@pytest.mark.parametrize("op", [live.chunk_rollup, live.live_loudness, live.live_energy_trend])
def test_append_streams_drop_and_count_late_rows(spark, op, tmp_path):
    schema = "ts timestamp, track_id long, rms double"
    (tmp_path / "in").mkdir()
    whole = [spark.createDataFrame(b, "ts string, track_id long, rms double").withColumn("ts", F.to_timestamp("ts")) for b in LATE]
    late = 0
    for n, batch in enumerate(whole):
        batch.coalesce(1).write.parquet(str(tmp_path / "w" / str(n)))
        (part,) = (tmp_path / "w" / str(n)).glob("part-*.parquet")
        shutil.move(part, tmp_path / "in" / f"{n}.parquet")
        stream = op(live.with_event_time(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))))
        q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
        late += sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    assert late >= 1
    kept = whole[0].unionByName(whole[1].where("rms <> 9.0"))  # windows before 12:50 are closed
    want = op(live.with_event_time(kept)).collect()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, want))


def test_status_upsert_keeps_the_newest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "ts timestamp, event_id long, user_id long, event_type string"
    batches = [[("2024-01-01 10:00:00", 1, 1, "queued"), ("2024-01-01 10:00:00", 2, 2, "queued")], [("2024-01-01 11:00:00", 3, 1, "done")], [("2024-01-01 10:30:00", 4, 1, "late"), ("2024-01-01 10:00:00", 5, 2, "playing")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts string, event_id long, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "w" / str(n)))
        (part,) = (tmp_path / "w" / str(n)).glob("part-*.parquet")
        shutil.move(part, tmp_path / "in" / f"{n}.parquet")
        live.upsert_status(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, live.statuses(spark, str(tmp_path / "state"), 2).collect())) == [(1, "done"), (2, "playing")]
    assert sorted(p.name for p in (tmp_path / "state").iterdir() if p.is_dir()) == ["1", "2"]


def test_mix_quality_by_hand(spark):
    rng = random.Random(2)
    rows = [(k, i, *(rng.random() for _ in range(4)), 20 * rng.random(), rng.random(), 0.3) for k, n in ((1, 40), (2, 1), (3, 2)) for i in range(n)] + [(4, i, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(12)]
    df = spark.createDataFrame(rows, "track_id long, frame_idx long, rms double, bass double, mid double, high double, contrast double, clash double, tension double")
    got = {r.track_id: r for r in quality.mix_quality(df).collect()}
    mean = lambda x: sum(x) / len(x) if x else 0.0
    sd = lambda x: math.sqrt(mean([(y - mean(x)) ** 2 for y in x]))
    for k in (1, 2, 3, 4):
        own = [r[2:] for r in rows if r[0] == k]
        level = [r[0] for r in own]
        steps = [abs(y - x) for x, y in zip(level, level[1:], strict=False)]
        flux = mean([mean([(y[b] - x[b]) ** 2 for b in (1, 2, 3)]) for x, y in zip(own, own[1:], strict=False)])
        energy = mean([mean([r[b] ** 2 for b in (1, 2, 3)]) for r in own])
        smooth = 0.7 * (1 - min(1, flux / (energy + 1e-10))) + 0.3 * max(0, 1 - 10 * sum(s > 0.1 for s in steps) / len(own))
        clarity = 0.6 * (1 - mean([r[5] for r in own])) + 0.4 * max(0, min(1, mean([r[4] for r in own]) / 40))
        bands = [mean([r[b] ** 2 for r in own]) for b in (1, 2, 3)]
        shares = [b / sum(bands) if sum(bands) else 0.33 for b in bands]
        balance = 1 - sum(abs(s - i) for s, i in zip(shares, (0.3, 0.4, 0.3), strict=True)) / 3
        near = [sum(level[max(0, i - 5) : i + 5]) / 10 for i in range(len(level))]
        large = mean([float(s > sd(level)) for s in steps])
        held = 0.6 * max(0, 1 - 5 * large) + 0.4 * max(0, min(1, 1 - sd([a - b for a, b in zip(level, near, strict=True)]) / (mean(level) + 1e-10)))
        want = [smooth, clarity, 1 - own[0][6], balance, held]
        assert [got[k][c] for c in quality.PARTS] == pytest.approx(want)
        assert got[k].score == pytest.approx(sum(w * x for w, x in zip((0.3, 0.25, 0.2, 0.15, 0.1), want, strict=True)))


def test_role_plan_candidates(spark):
    schema = "pair_id long, vocals_a boolean, vocals_b boolean, content_a boolean, content_b boolean, drums_a boolean, drums_b boolean, drum_energy_a double, drum_energy_b double, tempo_a double, tempo_b double, clash double, safe_points int, phrases int"
    rows = [
        (1, False, False, False, False, True, True, 0.9, 0.4, 120.0, 121.0, 0.0, 0, 0),  # the quieter drums
        (2, False, False, False, False, True, False, 0.9, 0.4, 120.0, 121.0, 0.0, 0, 0),  # no plan
        (3, True, True, True, True, True, True, 0.5, 0.5, 120.0, 121.0, 0.0, 20, 20),  # a's bed under b's vocals
        (4, True, True, True, True, True, True, 0.5, 0.5, 120.0, 121.0, 1.0, 20, 20),  # they clash: b alone
        (5, True, False, True, False, True, True, 0.5, 0.5, 120.0, 160.0, 0.2, 9, 9),  # a alone, tempos out of reach
        (6, False, True, False, False, True, True, 0.5, 0.5, 100.0, 106.0, 1 / 3, 0, 0),  # equal: the first
    ]
    got = {r.pair_id: tuple(r)[1:] for r in quality.role_plan(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("b", "b", "a", None), 2: (None,) * 4, 3: ("a", "b", "b", 0.9), 4: ("b", "b", "b", 0.8), 5: ("a", "a", "a", 0.1), 6: ("a", "b", "b", 0.25)}


def test_compatible_pairs_keep_to_the_songs_and_equal_all_pairs(spark):
    """Against all pairs, on few tempos and energies, copies, nulls and junk; then 30,000 songs that all fit each other, 900 million pairs."""
    rng = random.Random(3)
    codes, names = ["1A", "12A", "2A", "1B", "8B", "junk", None], ["C", "Cm", "G", None]
    rows = [(i, rng.choice([0.0, -3.0, None, 90.0, 94.0, 95.4, 100.0, 100.3, 106.0, rng.uniform(80, 130)]), rng.choice(codes), rng.choice(names), rng.choice([None, 0.2, 0.4, 0.6, -0.1, rng.random()])) for i in range(300)]
    rows += [(300 + i, 100.0, "1A", "C", 0.4) for i in range(12)]
    kinds = "song_id long, bpm double, camelot string, key_name string, energy double"
    got = {(r.song_id, r.match_id, r.rank) for r in catalogue.compatible_pairs(spark.createDataFrame(rows, kinds)).collect()}

    def friends(code):
        if code in (None, "junk"):
            return []
        n, x = int(code[:-1]), code[-1]
        return [code, f"{n % 12 + 1}{x}", f"{(n + 10) % 12 + 1}{x}", f"{n}{'B' if x == 'A' else 'A'}"]

    want = set()
    for i, b, c, k, e in rows:
        fit = [(abs(b2 - b), j) for j, b2, c2, k2, e2 in rows if i != j and None not in (b, b2, e, e2) and b * 0.94 <= b2 <= b * 1.06 and e - 0.2 <= e2 <= e + 0.2 and (c2 in friends(c) and c2 is not None or k is not None and k == k2)]
        want |= {(i, j, n + 1) for n, (_, j) in enumerate(sorted(fit)[:5])}
    assert got == want and len(want) > 500
    close = spark.range(30_000).selectExpr("id as song_id", "100.0D + id % 5 as bpm", "'1A' as camelot", "'C' as key_name", "0.5D + id % 100 / 1000.0D as energy")
    assert catalogue.compatible_pairs(close).selectExpr("count(*)", "max(bpm_diff)").first()[:] == (150_000, 0.0)


def test_comments_are_thinned_as_in_a_loop(spark):
    rng = random.Random(4)
    rows = [(k, t) for k in range(5) for t in sorted(rng.sample(range(20_000), 3000 if k else 1))]
    want, last = set(), {}
    for k, t in rows:
        if k not in last or t - last[k] >= 30:
            want.add((k, t))
            last[k] = t
    got = tracklists.thinned(spark.createDataFrame(rows, "k long, t long").repartition(3), "k", "t", 30).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
