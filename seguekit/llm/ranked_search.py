"""Exact ranked search by posting lists in geometric blocks with coordinatewise-maximum summaries.

A term weighs w = floor(1000 * ln((2 N + 2) / (2 df + 1))), a document gives it (10^9 tf) div (1000 tf + 8 m) with m = 10 + (90 n N) div L,
and a score is the sum of the products over a query's terms: whole numbers, so sums don't depend on their order and ties are exact.

A pass takes queries of about ``pass_terms`` terms, whose vocabulary goes to all tasks:

1. Texts are split into terms once. The forward table holds each document's number of terms and the counts of those in the vocabulary; it is written.
2. Document frequencies are counted over it, as sums of one array per task.
3. Tasks read the forward table in shards of a bounded number of (document, term) cells. In a shard, a term's posting list is cut into blocks of
   like documents: each goes to the nearest of evenly drawn representatives, by the angle between projections of their weighted vectors, and
   clusters are cut by length into blocks of at most ``block``. A block's summary holds the largest impact of each term among its documents.

A query takes its lists from the heaviest term to the lightest. A document of a list that holds a heavier term was met before, so the summary's
sum over this term and the lighter ones bounds all that is left in the block: it is skipped if, and only if, that is below the
query's k-th best score so far. Blocks go by falling bounds, so the best come early. Lists end when not even the shard's maxima reach it. Lists that no query comes to are not blocked at all.

Each task answers with its k best for each query; the k best of those are the k best of all.

Defined results: rows of one item id ask together with the terms of all, once each; items without id or terms have no row; null and
empty texts have no terms and don't count; rows without id count for the statistics but are no answers; rows of one id are documents of
their own; equal scores are ranked by id; texts of any length are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seguekit.llm.common import cut

#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest separates.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


@dataclass(frozen=True)
class Search:
    k: int = 10
    block: int = 16
    cells: int = 1 << 23  #: (document, term) cells of a shard
    shard: int = 2048  #: documents of a shard at most
    directions: int = 16  #: of the projection that likeness is measured in
    pass_terms: int = 1_000_000


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def forward_table(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, counts): numbers and counts, as bytes of 32-bit integers, of a document's terms in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(vocabulary.value)}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sizes, terms, counts = [], [], []
                for text in b.column("text"):
                    own = terms_of(text.as_py())
                    ids = np.fromiter(map(number.get, own, repeat(-1)), np.int32, len(own))
                    ids, n = np.unique(ids[ids >= 0], return_counts=True)
                    sizes.append(len(own))
                    terms.append(ids.tobytes())
                    counts.append(n.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, counts binary").where("n > 0")


def document_frequencies(forward: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of the ``size`` terms of the vocabulary stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), np.int32), minlength=size)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], names=["term", "n"])

    found = forward.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the pass
    df = np.zeros(size, np.int64)
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return df


class Shard:
    """Documents of one shard as rows of impacts, a column for each term that they hold, the heaviest term first; and their posting lists in blocks."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, column: np.ndarray, impacts: np.ndarray, weights: np.ndarray, p: Search):
        self.ids, self.p = ids, p
        self.columns, at = np.unique(column, return_inverse=True)
        self.impacts = np.zeros((len(ids), len(self.columns)), np.int32)
        self.impacts[doc, at] = impacts
        self.tops = self.impacts.max(axis=0).astype(np.int64)
        rays = np.random.default_rng(7).standard_normal((len(self.columns), p.directions)).astype(np.float32)
        self.likeness = (self.impacts * weights[self.columns].astype(np.float32)) @ rays
        self.likeness /= np.maximum(np.linalg.norm(self.likeness, axis=1, keepdims=True), 1e-9)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def blocks(self, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents in the order of blocks, starts of the blocks, summaries from this column on) of a term's posting list."""
        if column not in self.lists:
            docs = np.flatnonzero(self.impacts[:, column])
            count = -(-len(docs) // self.p.block)
            drawn = docs[np.arange(count) * len(docs) // count]
            own = (self.likeness[docs] @ self.likeness[drawn].T).argmax(axis=1)
            order = np.lexsort((self.impacts[docs, column], own))
            docs, own = docs[order], own[order]
            place = np.arange(len(docs)) - np.searchsorted(own, own)
            starts = np.flatnonzero(place % self.p.block == 0)
            self.lists[column] = docs, starts, np.maximum.reduceat(self.impacts[docs, column:], starts, axis=0)
        return self.lists[column]


class Asked:
    """The queries of a pass and their k best documents so far."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, weights: np.ndarray, p: Search):
        self.starts, self.columns, self.weights, self.p = starts, columns, weights, p
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * (len(starts) - 1)
        self.seen = self.bounded = 0  # postings of the lists that were read, and of those the ones in blocks that no bound left out

    def read(self, shard: Shard) -> None:
        place = np.searchsorted(shard.columns, self.columns)
        held = shard.columns[np.minimum(place, len(shard.columns) - 1)] == self.columns
        for q in range(len(self.best)):
            own = slice(self.starts[q], self.starts[q + 1])
            columns, weights = place[own][held[own]], self.weights[self.columns[own][held[own]]]
            if len(columns):
                self._ask(q, shard, columns, weights)

    def _ask(self, q: int, shard: Shard, columns: np.ndarray, weights: np.ndarray) -> None:
        met = np.zeros(len(shard.ids), bool)
        reach = np.cumsum((shard.tops[columns] * weights)[::-1])[::-1]
        for k, column in enumerate(columns.tolist()):
            if reach[k] < self.bar(q):
                break
            docs, starts, summaries = shard.blocks(column)
            bounds = summaries[:, columns[k:] - column].astype(np.int64) @ weights[k:]
            order, ends, at = np.argsort(-bounds, kind="stable"), np.append(starts[1:], len(docs)), 0
            while at < len(order) and bounds[order[at]] >= self.bar(q):  # the most promising blocks first, twice as many at a time
                own = order[at : 2 * at + 4]
                own = own[bounds[own] >= self.bar(q)]
                at += len(own)
                found = np.concatenate([docs[starts[x] : ends[x]] for x in own.tolist()])
                self.bounded += len(found)
                found = found[~met[found]]
                met[found] = True
                self._take(q, shard.impacts[found[:, None], columns].astype(np.int64) @ weights, shard.ids[found])
            self.seen += len(docs)

    def bar(self, q: int) -> int:
        scores = self.best[q][0]
        return scores[-1] if len(scores) == self.p.k else 1

    def _take(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.bar(q)
        if good.any():
            s, d = np.concatenate((self.best[q][0], scores[good])), np.concatenate((self.best[q][1], ids[good]))
            order = np.lexsort((d, -s))[: self.p.k]
            self.best[q] = s[order], d[order]


def _shards(batches: Iterator[pa.RecordBatch], place: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, p: Search) -> Iterator[Shard]:
    """``place``: the column of each term, by falling weight."""

    def made(b: pa.RecordBatch) -> Iterator[Shard]:
        lists = b.column("terms").to_pylist()
        lengths = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        column = place[np.frombuffer(b"".join(lists), np.int32)]
        if b.num_rows > 1 and len(np.unique(column)) * b.num_rows > p.cells:
            half = b.num_rows // 2
            yield from made(b.slice(0, half))
            yield from made(b.slice(half))
        elif len(column):
            tf = np.frombuffer(b"".join(b.column("counts").to_pylist()), np.int32).astype(np.int64)
            m = np.array([10 + 90 * n * n_docs // n_terms for n in b.column("n").to_pylist()], np.int64)
            doc = np.repeat(np.arange(b.num_rows), lengths)
            yield Shard(b.column("doc_id").to_numpy(zero_copy_only=False), doc, column, 1_000_000_000 * tf // (1000 * tf + 8 * m[doc]), weights, p)

    for whole in batches:
        for at in range(0, whole.num_rows, p.shard):
            yield from made(whole.slice(at, p.shard))


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, term): the different terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = sorted(set(terms_of(text)))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.int64()), pa.array(own, pa.binary())], names=["item_id", "term"])

    rows = queries.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, term binary").distinct()


def search(docs: DataFrame, queries: DataFrame, p: Search = Search()) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of ``docs`` (doc_id, text) for each of ``queries`` (item_id, text)."""
    spark = docs.sparkSession
    asked = cut(query_terms(queries))
    passes = max(1, -(-asked.count() // p.pass_terms))
    best = None
    for i in range(passes):
        pairs = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i).toArrow()  # some pass_terms rows
        found = cut(_answers_of_pass(spark, docs, pairs, p))
        best = found if best is None else best.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= p.k).select("item_id", "rank", "doc_id", "score")


def _answers_of_pass(spark, docs: DataFrame, pairs: pa.Table, p: Search) -> DataFrame:
    coded = pairs.column("term").combine_chunks().dictionary_encode()
    vocabulary, term = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    forward = cut(forward_table(docs, spark.sparkContext.broadcast(vocabulary)))
    n_docs, n_terms = forward.agg(F.count("*"), F.sum("n")).first()
    df = document_frequencies(forward, len(vocabulary))
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    order = np.argsort(df, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    items, item = np.unique(pairs.column("item_id").to_numpy(), return_inverse=True)
    by_item = np.lexsort((place[term], item))
    starts = np.searchsorted(item[by_item], np.arange(len(items) + 1))
    sent = spark.sparkContext.broadcast((items, starts, place[term][by_item], place, weight[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, starts, columns, place, weights = sent.value
        asked = Asked(starts, columns, weights, p)
        for shard in _shards(batches, place, weights, n_docs, n_terms, p):
            asked.read(shard)
        for low in range(0, len(items), 5_000):
            part = asked.best[low : low + 5_000]
            sizes = [len(s) for s, _ in part]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(items[low : low + 5_000], sizes)), *(pa.array(np.concatenate([x[c] for x in part]) if part else []) for c in (1, 0))], names=["item_id", "doc_id", "score"])

    answering = forward.where(F.col("doc_id").isNotNull())
    return answering.mapInArrow(run, "item_id long, doc_id long, score long")
