"""Readers and writers of analysis files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seguekit.functions.scoring import parse_tempo, truthy

MEDIA = "*.{mp3,wav,flac,m4a,aiff}"
#: Loose types stay text on read; ``typed_samples`` makes them numbers and booleans.
SAMPLE_SCHEMA = (
    "from_track string, to_track string, crossfade_type string, tempo_outgoing string, tempo_incoming string, energy_before double, energy_after double, "
    "perceived_smoothness double, harmonic_tension double, key_outgoing string, key_incoming string, bass_swap_detected string, beat_aligned string, techniques_used array<string>, _corrupt_record string"
)


def read_samples(spark: SparkSession, paths: str | list[str], multi_line: bool = True) -> DataFrame:
    """Rows of JSON files that hold a list of samples, with the ``source`` (file stem without _analysis, 40 characters).

    Unreadable files and files that hold no list of samples give no row. ``multi_line``: a file is one JSON document; otherwise every line is a sample, and files can be split.
    """
    raw = spark.read.schema(SAMPLE_SCHEMA).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(paths)
    stem = F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.json)?$", 1), "_analysis$", "")
    good = F.col("_corrupt_record").isNull() & (F.col("from_track").isNotNull() | F.col("crossfade_type").isNotNull())
    return raw.withColumn("source", F.substring(stem, 1, 40)).where(good).drop("_corrupt_record")


def typed_samples(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"tempo_outgoing": parse_tempo(F.col("tempo_outgoing")), "tempo_incoming": parse_tempo(F.col("tempo_incoming")), "bass_swap_detected": truthy(F.col("bass_swap_detected")), "beat_aligned": truthy(F.col("beat_aligned"))})


def list_media(spark: SparkSession, root: str, pattern: str = MEDIA) -> DataFrame:
    """path, length, modificationTime of the media files under ``root``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime")


def matches_glob(path: Column, pattern: str) -> Column:
    """Whether a path or address, without query and fragment, matches a pattern of ``*``, ``?`` and ``{a,b}``."""
    signs = {"*": ".*", "?": ".", "{": "(?:", "}": ")", ",": "|"}
    return F.regexp_replace(path, "[?#].*$", "").rlike("^" + "".join(signs.get(c) or re.escape(c) for c in pattern) + "$")


def flatten_song(doc: Column) -> dict[str, Column]:
    """The catalogue row of a song document (JSON text); readings that producers nest in two ways are taken from either."""
    at = lambda p: F.get_json_object(doc, p)
    return {
        "song_id": at("$.song_id"), "title": at("$.metadata.title"), "artist": at("$.metadata.artist"), "duration_sec": at("$.metadata.duration_sec").try_cast("double"),
        "bpm": F.coalesce(at("$.tempo.bpm"), at("$.tempo.tempo.bpm")).try_cast("double"), "key": at("$.harmony.key"), "mode": at("$.harmony.mode"), "camelot": at("$.harmony.camelot"),
        "energy_mean": at("$.energy.mean").try_cast("double"), "has_vocals": F.coalesce(at("$.vocals.has_vocals"), at("$.vocals.vocals.has_vocals")).try_cast("boolean"),
        "genre": at("$.embeddings.semantic_tags.genre[0]"), "embedding": F.from_json(at("$.embeddings.vector"), "array<double>"),
    }


def flatten_transition(doc: Column) -> dict[str, Column]:
    """The transition row of a document; flags tell which secondary techniques it lists."""
    at = lambda p: F.get_json_object(doc, p)
    second = F.coalesce(F.from_json(at("$.transition_execution.technique_secondary"), "array<string>"), F.array().cast("array<string>"))
    flags = {f: F.array_contains(second, f) for f in ("bass_swap", "filter_sweep", "echo_out")}
    return {"transition_id": at("$.transition_id"), "mix_id": at("$.mix_id"), "technique": at("$.transition_execution.technique_primary"), "quality_score": at("$.quality.overall_score").try_cast("double"), "volume_curve": at("$.transition_execution.volume_curve")} | flags


def transition_row(doc: Column, path: Column, analyzed_at: Column) -> dict[str, Column]:
    """The 25 columns of a transition's table row from its document (JSON text), where that lies and when it was analysed."""
    at = lambda p: F.get_json_object(doc, p)
    num = lambda p: at(p).try_cast("double")
    run = "$.transition_execution"
    second = F.coalesce(F.from_json(at(f"{run}.technique_secondary"), "array<string>"), F.array().cast("array<string>"))
    return {
        "transition_id": at("$.transition_id"), "mix_id": at("$.context.source_mix_id"), "track_a_id": at("$.track_a_features.song_id"), "track_b_id": at("$.track_b_features.song_id"),
        "start_time_sec": num("$.transition.start_time_sec"), "end_time_sec": num("$.transition.end_time_sec"), "duration_sec": num(f"{run}.duration_sec"), "duration_bars": num(f"{run}.duration_bars"),
        "technique": at(f"{run}.technique_primary"), "technique_confidence": F.coalesce(num(f"{run}.technique_confidence"), F.lit(0.0)),
        "bpm_a": num("$.track_a_features.bpm"), "bpm_b": num("$.track_b_features.bpm"), "key_a": at("$.track_a_features.key"), "key_b": at("$.track_b_features.key"),
        "camelot_distance": num("$.compatibility_metrics.camelot_distance"), "has_bass_swap": F.array_contains(second, "bass_swap"), "has_filter_sweep": F.array_contains(second, "filter_sweep"), "has_echo_out": F.array_contains(second, "echo_out"),
        "beat_alignment_quality": num("$.quality_assessment.beat_match_quality"), "energy_delta": num("$.compatibility_metrics.energy_delta"),
        "volume_curves_json": F.coalesce(at(f"{run}.volume_curves"), F.lit("{}")), "eq_automation_json": F.coalesce(at(f"{run}.eq_automation"), F.lit("{}")),
        "transition_analysis_json_path": path, "quality_score": num("$.quality_assessment.overall_transition_quality"), "analyzed_at": analyzed_at,
    }


def write_samples(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)


def write_events_csv(df: DataFrame, path: str) -> None:
    df.select("start_sec", "end_sec", "label", "peak_score", "mean_score").write.mode("error").option("header", True).csv(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per value of ``split``."""
    df.write.mode("error").partitionBy("split").parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; where none is set, in a temporary folder in local mode, else an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="seguekit-checkpoint-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder of the shared scratch space, and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _shelf(doc_id: Column, shelves: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(shelves)).cast("int")


def write_documents(docs: DataFrame, path: str, shelves: int) -> None:
    """Documents (doc_id text, body JSON text) in ``shelves`` folders by a hash of the id, sorted by id, so that a lookup reads the row groups of one."""
    placed = docs.select("doc_id", "body", _shelf(F.col("doc_id"), shelves).alias("shelf"))
    placed.repartition("shelf").sortWithinPartitions("shelf", "doc_id").write.mode("error").partitionBy("shelf").parquet(path)


def get_document(spark: SparkSession, path: str, shelves: int, doc_id: str) -> DataFrame:
    """The document of one id, no row if there is none; the folder is told before files are listed into the scan."""
    return spark.read.parquet(path).where((F.col("shelf") == _shelf(F.lit(doc_id), shelves)) & (F.col("doc_id") == doc_id)).select("doc_id", "body")


def get_documents(spark: SparkSession, path: str, shelves: int, asked: DataFrame) -> DataFrame:
    """``asked`` (doc_id, ...) with ``body``, null where there is none; the join takes the shelf too, so that small ``asked`` prune folders at run time."""
    held = spark.read.parquet(path)
    return asked.withColumn("shelf", _shelf(F.col("doc_id"), shelves)).join(held, ["shelf", "doc_id"], "left").drop("shelf")
