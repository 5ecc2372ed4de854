"""Queries of the live operators (T*), in batch; the tests hold them against streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from seguekit.plans import views as V
from seguekit.plans.registry import query
from seguekit.streaming import live as L

r6 = lambda c: F.round(c, 6)


def events(spark, d):
    return L.with_event_time(V.read(spark, d, "events"))


def frames(spark, d):
    return events(spark, d).select("ts", F.col("user_id").alias("track_id"), (F.col("value") / 500).alias("rms"))


def plain(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, k in df.dtypes if k == "timestamp"})


_BUCKET = "time_bucket(INTERVAL '{0} seconds', ts, TIMESTAMP '1970-01-01')"


@query("T1_chunk_rollup", f"SELECT user_id AS track_id, {_BUCKET.format(4)} AS start, count(*) AS n, round(avg(value / 500), 6) AS mean, round(max(value / 500), 6) AS top FROM events GROUP BY ALL")
def t1(spark, d):
    return plain(L.chunk_rollup(frames(spark, d))).withColumns({"mean": r6("mean"), "top": r6("top")})


@query("T2_listener_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '1800 seconds' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '1800 seconds' AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def t2(spark, d):
    return plain(L.listener_sessions(events(spark, d)))


@query("T3_rate_violations", "SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 30")
def t3(spark, d):
    """30 an hour, as in production; the tests have a case on either side of it."""
    return plain(L.rate_violations(events(spark, d)))


@query("T4_live_loudness", f"WITH b AS (SELECT user_id AS track_id, {_BUCKET.format(3)} AS start, -0.691 + 10 * log10(avg(value / 500 * value / 500) + 1e-10) AS lufs FROM events GROUP BY ALL) SELECT track_id, start, round(lufs, 6) AS lufs, round(power(10.0, greatest(least(-14 - lufs, 10), -10) / 20), 6) AS gain FROM b")
def t4(spark, d):
    return plain(L.live_loudness(frames(spark, d))).withColumns({"lufs": r6("lufs"), "gain": r6("gain")})


@query("T5_live_energy_trend", f"SELECT user_id AS track_id, {_BUCKET.format(5)} - to_seconds(5 * k) AS start, round(avg(value / 500), 6) AS mean FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def t5(spark, d):
    return plain(L.live_energy_trend(frames(spark, d))).withColumn("mean", r6("mean"))


@query("T6_live_status", "SELECT user_id, max_by(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def t6(spark, d):
    return L.live_status(events(spark, d))
