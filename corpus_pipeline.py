"""A corpus pipeline in five stages, each written as Parquet and read again as the next one's documents.

All stages but the last return the columns of ``documents``. Each works on every row its predecessor kept.

Defined results: an empty table gives an empty result. Null and empty texts score as not toxic, have no line to lose, are
copies of one another (the one with the smallest id stays) and leave at the mixing stage, which takes no words of them.
Null sources are one source for the mix, and no source for the line stage (their lines stay). Rows equal in id and text
are one document from the near-dedup on. Texts of any length are taken whole. Extra columns, whatever their names, are
kept up to the last stage; names that begin with two underscores are reserved.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seguekit.llm import byte_bpe, line_dedup, mixing, simhash, toxicity
from seguekit.llm.common import remove, shared_folder, table
from seguekit.llm.queries import RANKS, toxic_hold_out

#: A line on more than one in twenty documents of a source is its furniture, not what one of them says.
LINE_RATIO = 0.05


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model rejects go; it learns from the given labels, held-out rows left aside."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxic_hold_out)
    return toxicity.drop_toxic(docs, model)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on over one in twenty of a source's different texts go; ``n_chars`` follows the text. No document goes.

    Equal texts count once: the near-dedup has yet to come, and a large group of copies is no boilerplate.
    """
    rows = docs.select("text", "source", F.struct(*(c for c in docs.columns if c != "text")).alias("__row"))
    kept = line_dedup.drop_boilerplate(rows, F.col("source"), max_ratio=LINE_RATIO, copies_once=True)
    n_chars = F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("__row.n_chars"))
    new = {"text": F.col("text"), "n_chars": n_chars}
    return kept.select(*((new[c] if c in new else F.col("__row").getField(c)).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id; links: a similarity of 0.8 of 5-word shingles."""
    return simhash.near_dedup_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, a row for each document of the mix."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level bpe", encode_bpe),
]

#: Fingerprints, components and BPE are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; in between, rows are written to the shared checkpoint folder.

    The rows of a stage are removed when the next one has written its own; those that the result reads stay.
    """
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{i}")
            docs = spark.read.parquet(f"{root}/{i}")
            if i:
                remove(spark, f"{root}/{i - 1}")
    return docs
