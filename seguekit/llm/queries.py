"""The registered queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seguekit.llm import byte_bpe, chat, line_dedup, media, mixing, periodic_runs, ranked_search, secret_scan, simhash, substring_dedup, token_counts, topk_search, toxicity
from seguekit.llm.common import table
from seguekit.llm.oracles import ORACLES

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest_formatted(chat.format_conversations(chat.as_text_parts(turns)))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", *(count(i).alias(f"n_{kind}") for i, kind in enumerate(secret_scan.RULES)), F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"),
        secret_scan.written(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("random").cast("long").alias("n_random"), F.size("added").cast("long").alias("n_added"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", line_dedup.url_host(F.col("url")).alias("host"), line_dedup.html_text(F.col("html")).alias("text"))
    kept = line_dedup.drop_boilerplate(pages, F.col("host"), min_pages=2)  # the ratio decides; a line of one page is no repeat
    return kept.select("page_id", "host", "lines_total", "lines_dropped", F.sha2("text", 256).alias("text_sha256"))


def toxic_hold_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxic_hold_out)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(toxic_hold_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = simhash.cut(simhash.with_fingerprints(table(spark, sf_dir, "documents")))
    return simhash.components(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0, alike=F.col("lang"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), order=periodic_runs.planted_order))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_secret_scans, op3_line_dedup, op4_toxicity, op5_simhash, op6_mixing, op7_byte_bpe, op8_media, op9_token_counts, op10_topk_search, op11_periodic_runs, op12_substring_dedup, op13_ranked_search, pipeline)
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
