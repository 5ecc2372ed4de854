"""Ranks and running values over large groups in two steps: buckets of the order, then rows inside a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_rank(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "rank") -> DataFrame:
    """``df`` with the row number of ``order`` within ``keys``, from 1.

    ``bucket`` must not fall as ``order`` rises. Only counts by bucket meet in a window over the whole group; a task
    sorts the rows of one bucket, however many rows a group has.
    """
    b = df.withColumn("__bucket", bucket)
    counts = b.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy(F.col("__bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    starts = starts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__bucket"])), "__before")
    same = [F.equal_null(F.col(k), F.col(f"__k{i}")) for i, k in enumerate([*keys, "__bucket"])]
    on = same[0]
    for c in same[1:]:
        on = on & c
    inside = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order))
    ranked = b.withColumn("__inside", inside).join(starts, on)
    return ranked.withColumn(name, F.col("__before") + F.col("__inside")).select(*df.columns, name)


def pareto(board: DataFrame, best: str = "best", mean: str = "mean", buckets: int = 10_000) -> DataFrame:
    """Rows that no other beats at ``best`` with at least their ``mean``: running maxima over bests, by bucket and inside it."""
    lim = board.agg(F.min(best).alias("__lo"), F.max(best).alias("__hi"))
    place = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col(best) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (buckets - 1))).otherwise(F.lit(0))
    tops = board.join(F.broadcast(lim), F.lit(True)).withColumn("__b", place).groupBy("__b", best).agg(F.max(mean).alias("__top"))  # the broadcast is one row
    above = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)  # over at most ``buckets`` rows
    by_bucket = tops.groupBy("__b").agg(F.max("__top").alias("__m")).withColumn("__over", F.max("__m").over(above)).select(F.col("__b").alias("__bb"), "__over")
    higher = F.max("__top").over(Window.partitionBy("__b").orderBy(F.desc(best)).rowsBetween(Window.unboundedPreceding, -1))
    bars = tops.withColumn("__higher", higher).join(by_bucket, F.col("__b") == F.col("__bb")).select(F.col(best).alias("__best"), F.greatest("__higher", "__over").alias("__bar"))
    return board.join(bars, F.col(best) == F.col("__best")).where(F.col("__bar").isNull() | (F.col(mean) > F.col("__bar"))).select(*board.columns)
