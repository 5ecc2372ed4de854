"""Readers and writers round trip."""

import json

from pyspark.sql import functions as F

from seguekit.sources import files


def test_read_samples(spark, tmp_path):
    (tmp_path / "a_analysis.json").write_text(json.dumps([{"from_track": "x", "to_track": "y", "tempo_outgoing": "[123.0]", "bass_swap_detected": "True"}, {"from_track": None, "crossfade_type": "cut", "tempo_outgoing": 99, "bass_swap_detected": False}]))
    (tmp_path / "object.json").write_text(json.dumps({"other": 1}))
    (tmp_path / "broken.json").write_text("[{")
    got = files.typed_samples(files.read_samples(spark, str(tmp_path / "*.json"))).orderBy("tempo_outgoing").collect()
    assert [(r.source, r.tempo_outgoing, r.bass_swap_detected) for r in got] == [("a", 99.0, False), ("a", 123.0, True)]


def test_list_media(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.mp3", "sub/b.wav", "c.txt"):
        (tmp_path / n).write_bytes(b"xx")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.list_media(spark, str(tmp_path)).collect()) == ["a.mp3", "b.wav"]


def test_flatten(spark):
    song = {"song_id": "s", "metadata": {"title": "t", "duration_sec": "9.5"}, "tempo": {"tempo": {"bpm": 128}}, "vocals": {"vocals": {"has_vocals": True}}, "embeddings": {"semantic_tags": {"genre": []}, "vector": [1, 2]}}
    row = spark.createDataFrame([(json.dumps(song),)], "d string").select(*(c.alias(k) for k, c in files.flatten_song(F.col("d")).items())).first()
    assert (row.song_id, row.title, row.duration_sec, row.bpm, row.has_vocals, row.genre, row.embedding) == ("s", "t", 9.5, 128.0, True, None, [1.0, 2.0])
    t = {"transition_id": "t", "transition_execution": {"technique_primary": "cut", "technique_secondary": ["bass_swap"]}, "quality": {"overall_score": 0.5}}
    row = spark.createDataFrame([(json.dumps(t),)], "d string").select(*(c.alias(k) for k, c in files.flatten_transition(F.col("d")).items())).first()
    assert (row.technique, row.quality_score, row.bass_swap, row.echo_out) == ("cut", 0.5, True, False)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(0.0, 1.0, "a", 0.5, 0.25, "train"), (1.0, 2.0, "b", 0.5, 0.25, "val")], "start_sec double, end_sec double, label string, peak_score double, mean_score double, split string")
    files.write_splits(df, str(tmp_path / "s"))
    files.write_samples(df, str(tmp_path / "j"))
    files.write_events_csv(df, str(tmp_path / "c"))
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["split=train", "split=val"]
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["start_sec", "end_sec", "label", "peak_score", "mean_score"]
