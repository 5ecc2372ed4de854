"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's ``spark.checkpoint.dir``; where none is set, a temporary folder in local mode, else an error."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="seguekit-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this session, which the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows.

    Replicated reads do not depend on one executor, unlike a local checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def put(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a compressed table in the shared folder, and its path, for ``remove`` once what reads it is written."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


#: Slots of a bitmap of keys: at most 2 ** 20 rows of a word and its bits, about 50 MB as a broadcast side.
SLOT_BITS = 26


def _slot(keys: list[str]) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << SLOT_BITS) - 1))


def bitmap(rows: DataFrame, keys: list[str], **sets: Column) -> DataFrame:
    """(__word, a column for each of ``sets``): the slots of the rows' ``keys`` for which the condition holds; of fixed size."""
    slot = _slot(keys)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    none = F.lit(0).cast("long")
    return rows.groupBy(F.shiftright(slot, 6).alias("__word")).agg(*(F.bit_or(F.when(c, bit).otherwise(none)).alias(n) for n, c in sets.items()))


def with_bits(rows: DataFrame, keys: list[str], bits: DataFrame) -> DataFrame:
    """``rows`` with a boolean for each set of the bitmap: false is certain, true may be a false alarm (another key's slot)."""
    slot, names = _slot(keys), [c for c in bits.columns if c != "__word"]
    met = rows.withColumns({"__at": F.shiftright(slot, 6), "__bit": slot.bitwiseAND(F.lit(63)).cast("int")}).join(F.broadcast(bits), F.col("__at") == F.col("__word"), "left")
    return met.withColumns({n: F.coalesce(F.bit_get(n, F.col("__bit")) == 1, F.lit(False)) for n in names}).drop("__at", "__bit", "__word")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def unaligned(col: Column) -> Column:
    """The same long value under an expression that the optimizer does not see through.

    A side that is already partitioned by its key is joined without an exchange, and AQE then cannot split the
    hot partitions of the other side. Joining on this expression gives both sides an exchange of their own.
    """
    return col.bitwiseXOR(F.lit(0).cast("long"))
