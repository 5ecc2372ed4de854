"""Kernels and peaks over long series, which are cut into blocks that overlap their neighbours.

``at`` numbers the rows of a series 0, 1, ..., n - 1 without gaps, and values are not null. A series becomes one row for each block of
``size`` places, a block is put next to enough of its neighbours (a window over blocks), and numpy works on the block and its halo
in Arrow batches. So no row is multiplied by a kernel, and a series of any length is shared by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seguekit.sources.files import written

Work = Callable[[np.ndarray, int, int, bool, bool], dict[str, np.ndarray]]


def blocks(series: DataFrame, key: str, at: str, value: str, size: int) -> DataFrame:
    """(key, block, xs, last): the values of each block in their order, and the number of the series' last block."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(at).cast("long").alias("at"), F.col(value).cast("double").alias("x"))))
    made = series.groupBy(key, F.floor(F.col(at) / size).cast("long").alias("block")).agg(F.transform(rows, lambda r: r["x"]).alias("xs"))
    return made.withColumn("last", F.max("block").over(Window.partitionBy(key)))


def over_blocks(cut: DataFrame, key: str, size: int, halo: int, work: Work, out: dict[str, str]) -> DataFrame:
    """(key, at, columns of ``out``) that ``work`` makes of the values around each block.

    ``work`` gets the values of a block and at least ``halo`` places on both sides, the first and the end place of the block among
    them, and whether the series begins and ends there. It returns ``at`` (places among the values) and the other columns.
    """
    m = -(-halo // size)
    w = Window.partitionBy(key).orderBy("block")
    near = cut.select(key, "block", "last", F.flatten(F.collect_list("xs").over(w.rowsBetween(-m, m))).alias("xs"), F.size("xs").alias("own"))
    kinds = dict(cut.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (block, last, own, xs) in enumerate(zip(*(b.column(c).to_pylist() for c in ("block", "last", "own")), b.column("xs"), strict=True)):
                low = min(block, m) * size
                made = work(xs.values.to_numpy(zero_copy_only=False), low, low + own, block <= m, block + m >= last)
                places = made.pop("at") + (block * size - low)
                keys = b.column(key).take(pa.array(np.full(len(places), i)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(places, pa.int64()), *(pa.array(made[c]) for c in out)], names=[key, "at", *out])

    return near.mapInArrow(run, ", ".join([f"{key} {kinds[key]}", "at long", *(f"{c} {t}" for c, t in out.items())]))


def gaussian(sigma: float) -> np.ndarray:
    """The weights of a kernel of radius int(4 sigma + 0.5)."""
    radius = int(4 * sigma + 0.5)
    w = np.array([math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)])
    return w / w.sum()


def smoothed(x: np.ndarray, weights: np.ndarray, begins: bool, ends: bool) -> np.ndarray:
    """``x`` under a kernel; mirrored, with the edge value repeated, where the series begins or ends, and shorter by its radius elsewhere."""
    radius = len(weights) // 2
    return np.convolve(np.pad(x, (radius * begins, radius * ends), "symmetric"), weights, "valid")


def slopes(x: np.ndarray, begins: bool, ends: bool) -> np.ndarray:
    """Central differences; one-sided where the series begins or ends, and shorter by one elsewhere."""
    if len(x) < 2:
        return np.zeros(len(x))
    return np.concatenate((x[1:2] - x[:1] if begins else [], (x[2:] - x[:-2]) / 2, x[-1:] - x[-2:-1] if ends else []))


def gaussian_smooth(series: DataFrame, key: str, at: str, value: str, sigma: float, size: int = 4096) -> DataFrame:
    """(key, at, smooth)."""
    weights = gaussian(sigma)
    radius = len(weights) // 2

    def work(x, low, high, begins, ends):
        y = smoothed(x, weights, begins, ends)
        skip = low - (0 if begins else radius)
        return {"at": np.arange(low, high), "smooth": y[skip : skip + high - low]}

    return over_blocks(blocks(series, key, at, value, size), key, size, radius, work, {"smooth": "double"}).withColumnRenamed("at", at)


def energy_change(series: DataFrame, key: str, at: str, value: str, wide: float = 50, narrow: float = 20, size: int = 4096) -> DataFrame:
    """(key, at, change): the smoothed slope of the smoothed values, as a share of its range (as it is if the range is zero)."""
    first, second = gaussian(wide), gaussian(narrow)
    lost = len(first) // 2 + 1 + len(second) // 2

    def work(x, low, high, begins, ends):
        y = smoothed(np.abs(slopes(smoothed(x, first, begins, ends), begins, ends)), second, begins, ends)
        skip = low - (0 if begins else lost)
        return {"at": np.arange(low, high), "raw": y[skip : skip + high - low]}

    raw = over_blocks(blocks(series, key, at, value, size), key, size, lost, work, {"raw": "double"}).withColumnRenamed("at", at)
    span = raw.groupBy(key).agg(F.min("raw").alias("__low"), F.max("raw").alias("__high"))
    scaled = F.when(F.col("__high") > F.col("__low"), (F.col("raw") - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(F.col("raw"))
    return raw.join(span, key).select(key, at, scaled.alias("change"))


def _plateaus(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of one value."""
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, int)
    return first, np.append(first[1:], len(x)) - 1


def _prominent(x: np.ndarray, p: int, least: float, begins: bool, ends: bool) -> bool | None:
    """Whether the ground falls by ``least`` on both sides before it rises over the peak; None if that lies beyond ``x``."""
    known = True
    for side, closed in ((x[:p][::-1], begins), (x[p + 1 :], ends)):
        low, high = x[p] - side >= least, side > x[p]  # the difference is what is rounded, as in ``peaks`` and in SQL
        fall, rise = (int(m.argmax()) if m.any() else len(side) for m in (low, high))
        if fall < rise:
            continue
        if rise < len(side) or closed:
            return False
        known = None
    return known


def certain_peaks(x: np.ndarray, low: int, high: int, begins: bool, ends: bool, height: float | None, distance: int, prominence: float | None) -> tuple[list[int], bool]:
    """Peaks at the places from ``low`` to ``high`` - 1 that hold whatever lies beyond ``x``, and whether that is all of them.

    The highest peaks come first (of equal ones the later) and keep others from the next ``distance`` - 1 places. A peak that could be
    kept off by something unknown is unknown, and so is what depends on it.
    """
    first, last = _plateaus(x)
    if not len(first):
        return [], True
    up = np.concatenate(([False], x[first[1:]] > x[last[:-1]]))
    down = np.concatenate((x[last[:-1]] > x[first[1:]], [False]))
    floor = -math.inf if height is None else height
    at = ((first + last) // 2)[up & down & (x[first] >= floor)]
    left = -math.inf if begins else int(last[0]) + 1  # before this and from ``right`` on, peaks are unknown
    right = math.inf if ends else int(first[-1])
    kept, unsure = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for p in at[np.lexsort((at, x[at]))[::-1]].tolist():
        near = slice(max(0, p - distance + 1), p + distance)
        if not kept[near].any():
            (unsure if p - distance + 1 < left or p + distance - 1 >= right or unsure[near].any() else kept)[p] = True
    found, whole = [], left <= low and right >= high
    for p in (np.flatnonzero((kept | unsure)[low:high]) + low).tolist():
        good = True if prominence is None else _prominent(x, p, prominence, begins, ends)
        if kept[p] and good:
            found.append(p)
        elif good is not False:
            whole = False
    return found, whole


def split_peaks(series: DataFrame, key: str, at: str, value: str, height: float | None = None, distance: int = 1, prominence: float | None = None, size: int = 4096) -> DataFrame:
    """(key, at, value) of the peaks of each series, the same as if every series were one task's.

    Peaks are local maxima (a plateau counts at its middle) of at least ``height``, of which the higher ones suppress those nearer than
    ``distance``, and of those the ones of at least ``prominence``. Suppression can pass from peak to peak over any length, so blocks tell what
    their halo leaves open, and series with open blocks are asked again with twice the halo, until nothing is open.
    """
    cut, halo, done = blocks(series, key, at, value, size), max(size, 8 * distance), None

    def work(x, low, high, begins, ends):
        found, whole = certain_peaks(x, low, high, begins, ends, height, distance, prominence)
        places = np.array([*found, *([] if whole else [low])], np.int64)
        return {"at": places, "value": x[places], "open": np.arange(len(places)) >= len(found)}

    while True:
        found = written(over_blocks(cut, key, size, halo, work, {"value": "double", "open": "boolean"}), "peaks")
        again = found.where("open").select(F.col(key).alias("__key")).distinct()
        whole = found.join(again, F.col(key) == F.col("__key"), "left_anti")
        done = whole if done is None else done.unionByName(whole)
        if again.isEmpty():
            return done.select(key, F.col("at").alias(at), F.col("value").alias(value))
        cut, halo = cut.join(again, F.col(key) == F.col("__key"), "left_semi"), 2 * halo
