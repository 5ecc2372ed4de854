"""The music tables as views over the star-schema tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The sharps names in semitone order.
NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
_SQL_NAMES = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"

VIEW_SQL = {
    "v_songs": f"""SELECT p_partkey AS song_id, p_name AS title, p_type AS genre, p_brand AS dj, 80.0 + p_size AS bpm,
        CAST(p_partkey % 12 + 1 AS VARCHAR) || CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS camelot,
        {_SQL_NAMES}[CAST(p_partkey % 12 + 1 AS INT)] || CASE WHEN p_size % 2 = 0 THEN 'm' ELSE '' END AS key_name,
        (p_retailprice - 900) / 100 AS energy, p_size % 3 = 0 AS has_vocals, 120.0 + p_size * 5 AS duration_sec FROM part""",
    "v_pairs": """SELECT a.song_id AS pair_id, b.song_id AS b_id, a.bpm AS bpm_a, b.bpm AS bpm_b, a.camelot AS camelot_a, b.camelot AS camelot_b,
        a.key_name AS key_a, b.key_name AS key_b, a.energy AS energy_a, b.energy AS energy_b, a.has_vocals AS vocals_a, b.has_vocals AS vocals_b,
        a.duration_sec AS duration_a, b.duration_sec AS duration_b, a.genre AS genre_a, b.genre AS genre_b
        FROM v_songs a JOIN v_songs b ON b.song_id = (a.song_id * 7 + 3) % (SELECT count(*) FROM part)""",
    "v_mixes": "SELECT c_custkey AS mix_id, c_name AS title, c_mktsegment AS genre FROM customer",
    "v_transitions": """SELECT o_orderkey AS transition_id, o_custkey AS mix_id, o_orderkey % (SELECT count(*) FROM part) AS track_a_id,
        (o_orderkey * 7 + 3) % (SELECT count(*) FROM part) AS track_b_id, o_totalprice / 500000 AS quality_score, o_orderpriority AS technique,
        o_orderdate AS analyzed_at FROM orders""",
    "v_samples": f"""SELECT l_suppkey AS source_mix, 100 + l_quantity AS tempo_outgoing, 100.0 + l_partkey % 50 AS tempo_incoming, l_discount * 10 AS energy_before,
        l_tax * 10 AS energy_after, 1 - l_discount AS perceived_smoothness, l_tax AS harmonic_tension,
        CASE l_returnflag WHEN 'A' THEN 'cut' WHEN 'N' THEN 'linear' ELSE 's_curve' END AS crossfade_type, l_linestatus = 'O' AS bass_swap_detected,
        {_SQL_NAMES}[CAST(l_partkey % 12 + 1 AS INT)] AS key_outgoing, {_SQL_NAMES}[CAST(l_suppkey % 12 + 1 AS INT)] AS key_incoming, l_linenumber AS bars_duration,
        l_quantity % 2 = 0 AS beat_aligned, l_orderkey AS order_id, l_partkey AS part_id FROM lineitem""",
    "v_frames": """SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
        CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 0.25 AS DOUBLE) AS t_sec, value / 500 AS rms, event_type AS kind, CASE event_type WHEN 'click' THEN 0.1 WHEN 'view' THEN 0.4 ELSE 0.8 END::DOUBLE AS vocal,
        least(1.0, value / 250)::DOUBLE AS bass, (value % 50 / 50)::DOUBLE AS mid FROM events""",
    "v_beats": """SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS beat_idx,
        (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 60.0 / (100 + user_id % 30) AS t_sec, value AS onset_strength FROM events""",
    "v_bars": """SELECT label AS mix_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS bar_idx, embedding[1:29]::DOUBLE[] AS features,
        abs(embedding[30])::DOUBLE AS rms, abs(embedding[31])::DOUBLE AS complexity FROM embeddings""",
    "v_spectrum": """SELECT vec_id AS track_id, bin, bin * 344.53125 AS freq_hz, abs(embedding[bin + 1])::DOUBLE AS mag
        FROM embeddings, (SELECT CAST(unnest(range(64)) AS INT) AS bin)""",
    "v_plane": """SELECT label AS key, frame, bin, bin * 344.53125 AS freq_hz, abs(embedding[bin + 1])::DOUBLE AS mag
        FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings), (SELECT CAST(unnest(range(64)) AS INT) AS bin)""",
    "v_label_pairs": "SELECT a_id AS pair_id, a_id, coalesce(lead(a_id) OVER (ORDER BY a_id), min(a_id) OVER ()) AS b_id FROM (SELECT DISTINCT label AS a_id FROM embeddings)",
    "v_chroma": """SELECT vec_id AS track_id, label, pc, abs(embedding[pc + 1])::DOUBLE AS value FROM embeddings, (SELECT CAST(unnest(range(12)) AS INT) AS pc)""",
    "v_mix_text": """SELECT user_id AS mix_id, frame_idx, CAST((frame_idx * 45) // 60 AS VARCHAR) || ':' || lpad(CAST((frame_idx * 45) % 60 AS VARCHAR), 2, '0') || ' ' || event_type AS text,
        CAST(floor(value) AS INT) AS like_count FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx FROM events)""",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def song_count(spark: SparkSession, sf_dir: str) -> int:
    return read(spark, sf_dir, "part").count()


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    even = F.col("p_size") % 2 == 0
    return p.select(
        F.col("p_partkey").alias("song_id"), F.col("p_name").alias("title"), F.col("p_type").alias("genre"), F.col("p_brand").alias("dj"), (80.0 + F.col("p_size")).alias("bpm"),
        F.concat((F.col("p_partkey") % 12 + 1).cast("string"), F.when(even, "A").otherwise("B")).alias("camelot"),
        F.concat(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 12 + 1).cast("int")), F.when(even, "m").otherwise("")).alias("key_name"),
        ((F.col("p_retailprice") - 900) / 100).alias("energy"), (F.col("p_size") % 3 == 0).alias("has_vocals"), (120.0 + F.col("p_size") * 5).alias("duration_sec"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = songs(spark, sf_dir), song_count(spark, sf_dir)
    a = s.select(F.col("song_id").alias("pair_id"), ((F.col("song_id") * 7 + 3) % n).alias("b_id"), F.col("bpm").alias("bpm_a"), F.col("camelot").alias("camelot_a"), F.col("key_name").alias("key_a"), F.col("energy").alias("energy_a"), F.col("has_vocals").alias("vocals_a"), F.col("duration_sec").alias("duration_a"), F.col("genre").alias("genre_a"))
    b = s.select(F.col("song_id").alias("b_id"), F.col("bpm").alias("bpm_b"), F.col("camelot").alias("camelot_b"), F.col("key_name").alias("key_b"), F.col("energy").alias("energy_b"), F.col("has_vocals").alias("vocals_b"), F.col("duration_sec").alias("duration_b"), F.col("genre").alias("genre_b"))
    return a.join(b, "b_id")


def mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mix_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("genre"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = song_count(spark, sf_dir)
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("transition_id"), F.col("o_custkey").alias("mix_id"), (F.col("o_orderkey") % n).alias("track_a_id"), ((F.col("o_orderkey") * 7 + 3) % n).alias("track_b_id"),
        (F.col("o_totalprice") / 500000).alias("quality_score"), F.col("o_orderpriority").alias("technique"), F.col("o_orderdate").alias("analyzed_at"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, names = read(spark, sf_dir, "lineitem"), F.array(*map(F.lit, NAMES))
    return li.select(
        F.col("l_suppkey").alias("source_mix"), (100 + F.col("l_quantity")).alias("tempo_outgoing"), (100.0 + F.col("l_partkey") % 50).alias("tempo_incoming"), (F.col("l_discount") * 10).alias("energy_before"),
        (F.col("l_tax") * 10).alias("energy_after"), (1 - F.col("l_discount")).alias("perceived_smoothness"), F.col("l_tax").alias("harmonic_tension"),
        F.when(F.col("l_returnflag") == "A", "cut").when(F.col("l_returnflag") == "N", "linear").otherwise("s_curve").alias("crossfade_type"), (F.col("l_linestatus") == "O").alias("bass_swap_detected"),
        F.element_at(names, (F.col("l_partkey") % 12 + 1).cast("int")).alias("key_outgoing"), F.element_at(names, (F.col("l_suppkey") % 12 + 1).cast("int")).alias("key_incoming"),
        F.col("l_linenumber").alias("bars_duration"), (F.col("l_quantity") % 2 == 0).alias("beat_aligned"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"),
    )


def _indexed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").withColumn("idx", (F.row_number().over(order) - 1).cast("long"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed_events(spark, sf_dir).select(F.col("user_id").alias("track_id"), F.col("idx").alias("frame_idx"), (F.col("idx") * 0.25).cast("double").alias("t_sec"), (F.col("value") / 500).alias("rms"), F.col("event_type").alias("kind"), F.when(F.col("event_type") == "click", 0.1).when(F.col("event_type") == "view", 0.4).otherwise(0.8).alias("vocal"), F.least(F.lit(1.0), F.col("value") / 250).alias("bass"), (F.col("value") % 50 / 50).alias("mid"))


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed_events(spark, sf_dir).select(F.col("user_id").alias("track_id"), F.col("idx").alias("beat_idx"), (F.col("idx") * F.lit(60.0) / (100 + F.col("user_id") % 30)).alias("t_sec"), F.col("value").alias("onset_strength"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("label").orderBy("vec_id")
    e = read(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return e.select(F.col("label").alias("mix_id"), (F.row_number().over(order) - 1).cast("long").alias("bar_idx"), F.slice("embedding", 1, 29).alias("features"), F.abs(F.col("embedding")[29]).alias("rms"), F.abs(F.col("embedding")[30]).alias("complexity"))


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return e.select(F.col("vec_id").alias("track_id"), F.posexplode("embedding").alias("bin", "x")).where("bin < 64").select("track_id", "bin", (F.col("bin") * F.lit(344.53125)).alias("freq_hz"), F.abs("x").alias("mag"))


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of a label in their order, as frames of 64 bins."""
    order = Window.partitionBy("label").orderBy("vec_id")
    e = read(spark, sf_dir, "embeddings").select(F.col("label").alias("key"), (F.row_number().over(order) - 1).cast("long").alias("frame"), F.col("embedding").cast("array<double>").alias("x"))
    return e.select("key", "frame", F.posexplode("x").alias("bin", "x")).where("bin < 64").select("key", "frame", "bin", (F.col("bin") * F.lit(344.53125)).alias("freq_hz"), F.abs("x").alias("mag"))


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label and the next one; the number of labels is small and fixed."""
    labels = read(spark, sf_dir, "embeddings").select(F.col("label").alias("a_id")).distinct().groupBy().agg(F.array_sort(F.collect_list("a_id")).alias("ls"))
    return labels.select("ls", F.posexplode("ls").alias("i", "a_id")).select(F.col("a_id").alias("pair_id"), "a_id", F.element_at("ls", ((F.col("i") + 1) % F.size("ls") + 1).cast("int")).alias("b_id"))


def chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").withColumn("embedding", F.slice(F.col("embedding").cast("array<double>"), 1, 12))
    return e.select(F.col("vec_id").alias("track_id"), "label", F.posexplode("embedding").alias("pc", "x")).select("track_id", "label", "pc", F.abs("x").alias("value"))


def mix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec = F.col("idx") * 45
    text = F.concat(F.floor(sec / 60).cast("string"), F.lit(":"), F.lpad((sec % 60).cast("string"), 2, "0"), F.lit(" "), F.col("event_type"))
    return _indexed_events(spark, sf_dir).select(F.col("user_id").alias("mix_id"), F.col("idx").alias("frame_idx"), text.alias("text"), F.floor("value").cast("int").alias("like_count"))
