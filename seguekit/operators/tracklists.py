"""Timestamps of mixes from chapters, descriptions and comments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seguekit.functions.scoring import timestamp_to_seconds
from seguekit.sources.files import written

#: Words that no track line holds.
SKIP = ("subscribe", "follow", "http", "www.", "@", "#")


def thinned(rows: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """Of the rows of each key in the order of ``at``, the first and then each that is ``gap`` after the last one kept.

    One pass over sorted partitions holds one number, however long a key's rows are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = last = None
        for b in batches:
            keep = []
            for k, t in zip(b.column(key).to_pylist(), b.column(at).to_pylist(), strict=True):
                keep.append(k != of or t - last >= gap)
                if keep[-1]:
                    of, last = k, t
            yield b.filter(pa.array(keep, pa.bool_()))

    return rows.repartition(key).sortWithinPartitions(key, at).mapInArrow(run, rows.schema)


def timestamps(lines: DataFrame, gap: int = 30, least: int = 3) -> DataFrame:
    """(mix_id, sec, track, priority) from lines (mix_id, source, time, track) of the sources chapters, description, comments.

    A description counts if it has ``least`` lines that may be tracks and all are ``gap`` seconds apart. Comments give the
    longest text of each second, cut to 100 characters, thinned to the gap. The first source that a mix has is taken.
    """
    t = lines.select("mix_id", "source", timestamp_to_seconds(F.col("time")).cast("long").alias("sec"), F.trim("track").alias("track")).where("sec is not null")
    plain = ~F.exists(F.array(*map(F.lit, SKIP)), lambda w: F.contains(F.lower("track"), w))
    told = (F.col("source") == "description") & (F.length("track") >= 3) & plain
    priority = F.when(F.col("source") == "chapters", 1).when(told, 2).when(F.col("source") == "comments", 3)
    t = written(t.select("mix_id", priority.alias("priority"), "sec", "track").where("priority is not null"), "timestamps")  # lines are read once
    apart = F.col("sec") - F.lag("sec").over(Window.partitionBy("mix_id", "priority").orderBy("sec"))
    sizes = t.withColumn("apart", apart).groupBy("mix_id").agg(*(F.count_if(F.col("priority") == n).alias(f"n{n}") for n in (1, 2, 3)), F.min(F.when(F.col("priority") == 2, F.col("apart"))).alias("apart"))
    whole = (F.col("n2") >= least) & (F.coalesce("apart", F.lit(gap)) >= gap)
    best = sizes.select("mix_id", F.when(F.col("n1") > 0, 1).when(whole, 2).when(F.col("n3") > 0, 3).alias("priority"))
    taken = t.join(best, ["mix_id", "priority"])
    short = F.left("track", F.lit(100))
    said = taken.where("priority = 3").groupBy("mix_id", "sec").agg(F.max_by(short, F.struct(F.length(short), "track")).alias("track"))
    comments = thinned(said, "mix_id", "sec", gap).select("mix_id", "sec", "track", F.lit(3).alias("priority"))
    return taken.where("priority < 3").select("mix_id", "sec", "track", "priority").unionByName(comments)


def marked_transitions(lines: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """(key, sec, from_track, to_track) of tracklists with or without lines that only say "transition".

    Lines are ``M:SS name``; others are left out. A marker is a change to a track without a name, which is called by its place
    among the lines, Track_n; the next line comes from that track. So a name depends on the line's number and the line before
    only, and a window tells it. Lines of one place in the order go by their text.
    """
    read = F.regexp_extract(F.trim(text), r"^(\d+):(\d+)\s+(.+)$", 0) != ""
    at = lambda g: F.regexp_extract(F.trim(text), r"^(\d+):(\d+)\s+(.+)$", g)
    w = Window.partitionBy(key).orderBy(order, text)
    t = lines.where(read).withColumns({"sec": at(1).cast("long") * 60 + at(2).cast("long"), "__name": F.trim(at(3)), "__n": F.row_number().over(w)})
    name = F.when(F.lower("__name") == "transition", F.concat(F.lit("Track_"), F.col("__n").cast("string"))).otherwise(F.col("__name"))
    t = t.withColumn("to_track", name).withColumn("from_track", F.lag("to_track").over(w))
    return t.where("__n > 1").select(key, "sec", "from_track", "to_track")
