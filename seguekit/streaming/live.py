"""Live operators. Each is one function over a DataFrame with an event time, so a stream and a batch share it.

Rows later than the watermark are dropped on a stream. ``ts`` must be a timestamp (NTZ is cast by ``with_event_time``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seguekit.functions.scoring import loudness_gain


def with_event_time(df: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late) if df.isStreaming else df


def chunk_rollup(frames: DataFrame) -> DataFrame:
    """4 s tumbling windows per track: rows, mean and largest level."""
    return frames.groupBy("track_id", F.window("ts", "4 seconds")).agg(F.count("*").alias("n"), F.avg("rms").alias("mean"), F.max("rms").alias("top")).select("track_id", F.col("window.start").alias("start"), "n", "mean", "top")


def listener_sessions(events: DataFrame, gap_sec: int = 1800) -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", f"{gap_sec} seconds")).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def rate_violations(events: DataFrame, most: int = 30) -> DataFrame:
    """Users with over ``most`` events in a clock hour."""
    return events.groupBy("user_id", F.window("ts", "1 hour")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("user_id", F.col("window.start").alias("hour"), "n")


def live_loudness(frames: DataFrame) -> DataFrame:
    """Loudness of 3 s blocks and the gain that would bring it to -14."""
    b = frames.groupBy("track_id", F.window("ts", "3 seconds")).agg((-0.691 + 10 * F.log10(F.avg(F.col("rms") * F.col("rms")) + 1e-10)).alias("lufs"))
    return b.select("track_id", F.col("window.start").alias("start"), "lufs", loudness_gain(F.col("lufs")).alias("gain"))


def live_energy_trend(frames: DataFrame) -> DataFrame:
    return frames.groupBy("track_id", F.window("ts", "10 seconds", "5 seconds")).agg(F.avg("rms").alias("mean")).select("track_id", F.col("window.start").alias("start"), "mean")


def live_status(events: DataFrame) -> DataFrame:
    """Latest status per item; equal times go to the larger event id."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


def stream_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now into an in-memory table, for tests and backfills."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"))


def upsert_status(events: DataFrame, path: str, checkpoint: str):
    """Keep the latest status of every item as a table under ``path``, a version a micro-batch; the started query.

    A version is made of the one before and the batch, so a batch that is tried again after a failure writes the same rows
    over its own version. Only the last two versions stay. Late rows change nothing if the item has a newer status.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = _newest(batch)
        if number:
            old = batch.sparkSession.read.parquet(f"{path}/{number - 1}")
            new = new.unionByName(old).groupBy("user_id").agg(F.max("last").alias("last"))
        new.write.mode("overwrite").parquet(f"{path}/{number}")
        if number > 1:
            at = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/{number - 2}")
            at.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).delete(at, True)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statuses(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{version}").select("user_id", F.col("last.event_type").alias("status"))
