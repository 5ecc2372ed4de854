"""Validation and cleaning: error arrays per row, summaries and distributions. Nothing raises; bad rows are rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seguekit.functions.scoring import parse_tempo

#: Required fields.
SONG_FIELDS = ("song_id", "duration_sec", "tempo", "key", "energy", "structure", "vocals", "embeddings")
SAMPLE_FIELDS = ("from_track", "to_track", "tempo_outgoing", "tempo_incoming")
NUMERIC_FIELDS = ("tempo_outgoing", "tempo_incoming", "energy_before", "energy_after", "perceived_smoothness", "harmonic_tension")


def errors(*found: tuple[Column, str | Column]) -> Column:
    """Array of the messages whose condition holds, in order."""
    each = [F.when(F.coalesce(cond, F.lit(False)), F.lit(msg) if isinstance(msg, str) else msg) for cond, msg in found]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def document_errors(doc: Column, required: tuple[str, ...] = SONG_FIELDS) -> Column:
    """Errors of a song document given as JSON text: missing fields, then broken sections with their index.

    A field that is present but null is not missing: presence is looked up in the object's keys.
    """
    keys = F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>"))
    missing = F.transform(F.filter(F.array(*map(F.lit, required)), lambda f: ~F.array_contains(keys, f)), lambda f: F.concat(F.lit("Missing required field: "), f))
    sections = F.coalesce(F.from_json(F.get_json_object(doc, "$.structure.sections"), "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    broken = F.flatten(F.transform(sections, lambda s, i: F.filter(F.transform(F.array(F.lit("type"), F.lit("start_sec"), F.lit("end_sec")), lambda f: F.when(~F.map_contains_key(s, f), F.concat(F.lit("structure.sections["), i.cast("string"), F.lit("]."), f, F.lit(" is required")))), lambda x: x.isNotNull())))
    return F.when(keys.isNull() | (F.size(keys) == 0) & ~F.coalesce(doc.rlike(r"^\s*\{\s*\}\s*$"), F.lit(False)), F.array(F.lit("Invalid JSON"))).otherwise(F.concat(missing, broken))


TRANSITION_FIELDS = ("transition_id", "track_a_features", "track_b_features", "transition_execution")
TRACK_FIELDS = ("song_id", "bpm", "key", "camelot")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often ``use`` names it: a lambda's variable is not expanded."""
    return F.transform(F.array(value), use)[0]


def transition_errors(doc: Column) -> Column:
    """Errors of a transition document given as JSON text: fields, then those of both tracks, of the execution and its curves.

    The text is made once, and each object is read once, for its keys.
    """
    paths = {"track_a_features": "$.track_a_features", "track_b_features": "$.track_b_features", "execution": "$.transition_execution", "curves": "$.transition_execution.volume_curves"}
    keys = lambda text: F.struct(F.json_object_keys(text).alias("top"), *(F.json_object_keys(F.get_json_object(text, path)).alias(name) for name, path in paths.items()))
    lacks = lambda have, field: have.isNotNull() & ~F.array_contains(have, F.lit(field))

    def told(k: Column) -> Column:
        found = [(lacks(k["top"], f), f"Missing required field: {f}") for f in TRANSITION_FIELDS]
        for track in ("track_a_features", "track_b_features"):
            found += [(lacks(k[track], f), f"{track}.{f} is required") for f in TRACK_FIELDS]
        found += [(lacks(k["execution"], f), f"transition_execution.{f} is required") for f in ("duration_sec", "technique_primary")]
        found.append((lacks(k["curves"], "track_a_gain_db") | lacks(k["curves"], "track_b_gain_db"), "volume_curves requires track_a_gain_db and track_b_gain_db"))
        return F.when(k["top"].isNull(), F.array(F.lit("Invalid JSON"))).otherwise(errors(*found))

    return _once(doc, lambda text: _once(keys(text), told))


def sample_errors(df: DataFrame) -> Column:
    """Missing required fields, numeric fields that do not parse or aren't finite, empty keys."""
    out = [(F.col(f).isNull(), f"missing {f}") for f in SAMPLE_FIELDS if f in df.columns]
    for f in NUMERIC_FIELDS:
        x = parse_tempo(F.col(f).cast("string")) if f.startswith("tempo") else F.col(f).cast("string").try_cast("double")
        out.append((F.col(f).isNotNull() & (x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), f"bad {f}"))
    out += [(F.coalesce(F.trim(f), F.lit("")) == "", f"empty {f}") for f in ("key_outgoing", "key_incoming")]
    return errors(*out)


def split_valid(df: DataFrame, found: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejects with their ``errors``."""
    marked = df.withColumn("errors", found)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def validation_summary(df: DataFrame, found: Column, nn_rows: int = 500, lstm_rows: int = 2000) -> DataFrame:
    """One row: totals, percentage, and whether there are enough rows to train."""
    ok = F.count_if(F.size("__e") == 0)
    return df.withColumn("__e", found).agg(F.count("*").alias("total"), ok.alias("valid"), F.round(100.0 * F.try_divide(ok, F.count("*")), 6).alias("valid_pct"), (ok >= nn_rows).alias("ready_nn"), (ok >= lstm_rows).alias("ready_lstm"))


def first_invalid(df: DataFrame, found: Column, key: str, rows: int = 10, each: int = 3) -> DataFrame:
    return df.select(key, F.slice(found, 1, each).alias("errors")).where(F.size("errors") > 0).orderBy(key).limit(rows)


def feature_distribution(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, n, mean, std, min, max, median and the number of values over 3 population deviations off the mean."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields))).alias("e")).select("e.*").where("x is not null")
    stats = long.groupBy("field").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    each = long.groupBy("field", "x").agg(F.count("*").alias("times"))  # equal values are counted before one task per field sees them
    stats = stats.join(each.groupBy("field").agg(F.percentile("x", 0.5, F.col("times")).alias("median")), "field")
    far = long.join(F.broadcast(stats.select("field", "mean", "std")), "field").groupBy("field").agg(F.count_if(F.abs(F.col("x") - F.col("mean")) > 3 * F.col("std")).alias("outliers"))  # a row per field
    return stats.join(far, "field")


def dedup_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row of each key by ``order``; nulls are equal as keys."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in df.columns if c not in keys)), order).alias("__r")).select(*keys, "__r.*")


def readiness(df: DataFrame, source: str, targets: tuple[int, int] = (500, 2000), per_mix: int = 25) -> DataFrame:
    """One row: samples, sources, progress towards both targets in percent, and mixes still needed."""
    n = F.count("*")
    cols = [n.alias("samples"), F.countDistinct(source).alias("sources")]
    for t in targets:
        need = F.greatest(F.lit(t) - n, F.lit(0))
        cols += [F.round(F.least(F.lit(100.0), 100.0 * n / t), 6).alias(f"progress_{t}"), F.when(need > 0, F.floor(need / per_mix) + 1).otherwise(F.lit(0)).alias(f"mixes_needed_{t}")]
    return df.agg(*cols)


def rank_rows(partition: list[str], order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
