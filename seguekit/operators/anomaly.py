"""Anomaly of rows within their series, in a space of principal components of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seguekit.operators.series import robust_norm


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def moments(rows: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(key, n, sums, squares): count, sums and sums of products (row by row) of each series' vectors, added up in the tasks first."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(key).dictionary_encode()
            x, at = _matrix(b.column(vector), width), names.indices.to_numpy(zero_copy_only=False)
            own = [x[at == i] for i in range(len(names.dictionary))]
            yield pa.RecordBatch.from_arrays([names.dictionary, pa.array([len(o) for o in own], pa.int64()), pa.array([o.sum(axis=0).tolist() for o in own]), pa.array([(o.T @ o).ravel().tolist() for o in own])], names=[key, "n", "sums", "squares"])

    part = rows.select(key, vector).mapInArrow(run, f"{key} {kind}, n long, sums array<double>, squares array<double>")
    both = F.posexplode(F.concat("sums", "squares")).alias("at", "x")
    flat = part.select(key, "n", both).groupBy(key, "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    whole = flat.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("all"))
    return whole.select(key, "n", F.slice("all", 1, width).alias("sums"), F.slice("all", width + 1, width * width).alias("squares"))


def component_space(n: int, sums: np.ndarray, squares: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, w): (x - mean) @ w are the scores of x on the principal components of its standardised columns, each divided by its deviation."""
    mean = sums / n
    cov = squares / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    scale[scale < 1e-12] = 1
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    top = np.argsort(values)[::-1][: min(components, n, len(mean))]
    top = top[values[top] > 1e-9]  # directions without spread tell nothing
    return mean, vectors[:, top] / scale[:, None] / np.sqrt(values[top])


def frame_anomaly(rows: DataFrame, key: str, at: str, vector: str, width: int, components: int = 16, least: int = 32) -> DataFrame:
    """(key, at, distance, score): the squared distance from the middle of the series over ``components`` standardised principal components, and
    its place between the 5th and 95th percentile of the series. Series under ``least`` rows get 0. Vectors have ``width`` numbers, none null.
    """
    kinds = dict(rows.dtypes)
    rows = rows.select(key, at, F.transform(vector, lambda x: x.cast("double")).alias(vector))

    def spaces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [component_space(n, np.array(s), np.array(q).reshape(width, width), components) for n, s, q in zip(*(b.column(c).to_pylist() for c in ("n", "sums", "squares")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("n"), pa.array([m.tolist() for m, _ in made], pa.list_(pa.float64())), pa.array([w.ravel().tolist() for _, w in made], pa.list_(pa.float64()))], names=[key, "n", "mean", "w"])

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                b = whole.slice(low, 1024)
                out = []
                for columns in zip(b.column(vector), b.column("mean"), b.column("w"), strict=True):
                    x, mean, w = (c.values.to_numpy(zero_copy_only=False) for c in columns)
                    z = (x - mean) @ w.reshape(width, -1)
                    out.append(float(z @ z))
                yield pa.RecordBatch.from_arrays([b.column(key), b.column(at), pa.array(out, pa.float64())], names=[key, at, "distance"])

    total = moments(rows, key, vector, width)
    known = total.where(F.col("n") >= least).mapInArrow(spaces, f"{key} {kinds[key]}, n long, mean array<double>, w array<double>")
    told = rows.join(known.drop("n"), key).mapInArrow(distances, f"{key} {kinds[key]}, {at} {kinds[at]}, distance double")
    few = rows.join(total.where(F.col("n") < least).select(F.col(key).alias("__key")), F.col(key) == F.col("__key"), "left_semi").select(key, at, F.lit(0.0).alias("distance"))
    return robust_norm(told.unionByName(few), key, "distance", "score").select(key, at, "distance", "score")
