"""Round trips through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from seguekit.plans import views as V
from seguekit.plans.registry import query
from seguekit.sources import files


@query("S1_S9_samples_round_trip", "SELECT crossfade_type, bass_swap_detected, count(*) AS n, round(sum(tempo_outgoing), 3) AS tempo FROM v_samples GROUP BY ALL")
def s9(spark, d):
    """Samples written as JSON with loosely typed tempo and flag, read and typed again."""
    s = V.samples(spark, d)
    loose = s.select(F.lit("a").alias("from_track"), F.lit("b").alias("to_track"), "crossfade_type", F.concat(F.lit("["), F.col("tempo_outgoing").cast("string"), F.lit("]")).alias("tempo_outgoing"), F.when(F.col("bass_swap_detected"), "True").otherwise("False").alias("bass_swap_detected"))
    path = files.scratch_path(spark, "samples")
    files.write_samples(loose, path)
    back = files.typed_samples(files.read_samples(spark, path, multi_line=False))
    return back.groupBy("crossfade_type", "bass_swap_detected").agg(F.count("*").alias("n"), F.round(F.sum("tempo_outgoing"), 3).alias("tempo"))


@query("S2_list_media", "SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)$', 1) AS name FROM pages WHERE regexp_matches(regexp_replace(url, '[?#].*$', ''), '^.*/(?:en|de)/.*$')")
def s2(spark, d):
    """Addresses among all pages that match a pattern, and their last part; contents are not read."""
    p = V.read(spark, d, "pages").where(files.matches_glob(F.col("url"), "*/{en,de}/*"))
    return p.select("page_id", F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]+)$", 1).alias("name"))


@query("S10_write_events_csv", "SELECT kind AS label, count(*) AS n, round(sum(rms), 4) AS score FROM v_frames GROUP BY kind")
def s10(spark, d):
    e = V.frames(spark, d).select(F.col("t_sec").alias("start_sec"), (F.col("t_sec") + 0.25).alias("end_sec"), F.col("kind").alias("label"), F.col("rms").alias("peak_score"), F.col("rms").alias("mean_score"))
    path = files.scratch_path(spark, "events")
    files.write_events_csv(e, path)
    back = spark.read.option("header", True).schema("start_sec double, end_sec double, label string, peak_score double, mean_score double").csv(path)
    return back.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("peak_score"), 4).alias("score"))


@query("S11_write_splits", "SELECT CASE WHEN song_id % 20 < 14 THEN 'train' WHEN song_id % 20 < 17 THEN 'val' ELSE 'test' END AS split, count(*) AS n, sum(song_id)::BIGINT AS ids FROM v_songs GROUP BY 1")
def s11(spark, d):
    split = F.when(F.col("song_id") % 20 < 14, "train").when(F.col("song_id") % 20 < 17, "val").otherwise("test")
    path = files.scratch_path(spark, "splits")
    files.write_splits(V.songs(spark, d).select("song_id", split.alias("split")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("song_id").alias("ids"))
