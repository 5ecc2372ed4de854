"""As-of joins by one pass over the union of points and series, and interval joins with an equi key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(points: DataFrame, series: DataFrame, key: str, point: str, at: str, value: str) -> DataFrame:
    """(key, point, __t, before_t, before_v, after_t, after_v): the series rows next to each point, both sides closed.

    ``points`` has (key, point, t), ``series`` (key, at, value). The union is sorted once per key; no join is needed.
    Among series rows of one time the first by value counts before and after.
    """
    p = points.select(key, F.col(point).alias("__p"), F.col("t").cast("double").alias("__t"), F.lit(None).cast("double").alias("__st"), F.lit(None).cast("double").alias("__sv"))
    s = series.select(key, F.lit(None).cast(dict(points.dtypes)[point]).alias("__p"), F.col(at).cast("double").alias("__t"), F.col(at).cast("double").alias("__st"), F.col(value).cast("double").alias("__sv"))
    both = p.unionByName(s).withColumn("__pair", F.when(F.col("__st").isNotNull(), F.struct("__st", "__sv")))
    rank = F.when(F.col("__st").isNull(), 1).otherwise(0)
    up = Window.partitionBy(key).orderBy("__t", rank, F.desc("__sv")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy(F.desc("__t"), rank, F.desc("__sv")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__before", F.last("__pair", ignorenulls=True).over(up)).withColumn("__after", F.last("__pair", ignorenulls=True).over(down))
    return out.where(F.col("__st").isNull()).select(key, F.col("__p").alias(point), "__t", F.col("__before.__st").alias("before_t"), F.col("__before.__sv").alias("before_v"), F.col("__after.__st").alias("after_t"), F.col("__after.__sv").alias("after_v"))


def nearest(points: DataFrame, series: DataFrame, key: str, point: str, at: str, value: str) -> DataFrame:
    """(key, point, t, near_t, near_v, gap): the nearest series row; the earlier one if both are as near."""
    n = neighbours(points, series, key, point, at, value)
    earlier = F.col("after_t").isNull() | (F.col("before_t").isNotNull() & (F.col("__t") - F.col("before_t") <= F.col("after_t") - F.col("__t")))
    near_t = F.when(earlier, F.col("before_t")).otherwise(F.col("after_t"))
    return n.select(key, point, F.col("__t").alias("t"), near_t.alias("near_t"), F.when(earlier, F.col("before_v")).otherwise(F.col("after_v")).alias("near_v"), F.abs(F.col("__t") - near_t).alias("gap"))


def interpolate(points: DataFrame, series: DataFrame, key: str, point: str, at: str, value: str) -> DataFrame:
    """(key, point, t, value): linear between neighbours, the end values beyond the ends, null for an empty series."""
    n = neighbours(points, series, key, point, at, value)
    share = F.try_divide(F.col("__t") - F.col("before_t"), F.col("after_t") - F.col("before_t"))
    between = F.col("before_v") + (F.col("after_v") - F.col("before_v")) * share
    out = F.when(F.col("before_t").isNull(), F.col("after_v")).when(F.col("after_t").isNull() | (F.col("before_t") == F.col("after_t")), F.col("before_v")).otherwise(between)
    return n.select(key, point, F.col("__t").alias("t"), out.alias(value))


def in_interval(points: DataFrame, intervals: DataFrame, key: str, point: str, closed: bool = False, bucket_sec: float = 30.0) -> DataFrame:
    """``points`` with the first interval (by ``idx``) that holds their t, or nulls.

    Intervals (key, idx, start_sec, end_sec, ...) are cut to time buckets, so the join is on (key, bucket).
    """
    cut = lambda c: F.floor(c / bucket_sec)
    spread = intervals.withColumn("__bucket", F.explode(F.sequence(cut(F.col("start_sec")), F.greatest(cut(F.col("end_sec")), cut(F.col("start_sec")))))).withColumnRenamed(key, "__key")
    inside = (F.col("t") <= F.col("end_sec")) if closed else (F.col("t") < F.col("end_sec"))
    hit = points.join(spread, (F.col(key) == F.col("__key")) & (cut(F.col("t")) == F.col("__bucket")) & (F.col("t") >= F.col("start_sec")) & inside, "left").drop("__key", "__bucket")
    rest = [c for c in intervals.columns if c not in (key, "idx")]
    first = F.min_by(F.struct("idx", *rest), "idx").alias("__i")
    return hit.groupBy(*points.columns).agg(first).select(*points.columns, "__i.*")


def around(points: DataFrame, series: DataFrame, key: str, at: str, before: float, after: float, bucket_sec: float = 30.0) -> DataFrame:
    """``points`` (key, t, ...) with every row of ``series`` from t - before to t + after, joined on (key, time bucket)."""
    cut = lambda c: F.floor(c / bucket_sec)
    spread = points.withColumnRenamed(key, "__key").withColumn("__bucket", F.explode(F.sequence(cut(F.col("t") - before), cut(F.col("t") + after))))
    same = (F.col(key) == F.col("__key")) & (cut(F.col(at)) == F.col("__bucket"))
    return series.join(spread, same & F.col(at).between(F.col("t") - before, F.col("t") + after)).drop("__key", "__bucket")


def lerp(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share
