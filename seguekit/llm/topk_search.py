"""Exact BM25 top-k search: an inverted index per shard, block-max WAND, and an exact merge by global statistics.

A query is all terms of its whole text. Statistics (documents, mean length, document frequencies) are global. Impacts,
the contributions of a term to a document, are rounded to millionths, so sums don't depend on their order and ties are
exact.

Texts are split into terms once; the index is written, dealt to ``shards`` parts by hash. A part is a stream of blocks of
at most ``block`` documents (and 1,024 words for each of so many, unless one text is longer) of one kind (``alike``), in
the order of their length, each written as posting lists: its terms once, with documents and counts. Blocks are those of a document-oriented block-max index: they cut all lists at the
same documents, so WAND's test for a pivot is one for all lists of a query: if the largest impacts that its terms have in
the block do not add up to its bar, the query skips the block; a query little over its bar also if those of no part of
``PART`` documents do.

Bars are shared: a sixteenth of the documents, chosen by hash, has an index of its own in a quarter of the shards. Each
pass first scores these early documents, and the k-th best of them is a lower bound of each query's k-th best. The shards
then answer only with documents that reach it. For the queries that stay, scores are summed over the block's postings, many
queries at a time, in single precision; what reaches the bar within the error of those sums is summed again exactly.

Each shard answers with its best for each query, k at most; the k best of all shards are the k best. Queries of equal
terms are asked once. A pass over the index takes queries of about ``pass_terms`` terms, so a task holds a bounded block
of queries and one block of documents; passes grow with the data, and the number of shards is a setting (a few for each
core of the cluster). The work is the product of queries and documents, as every document may share a term: skipping
lowers its factor, not its order.

Defined results: rows with null ids neither ask nor answer; null texts are empty; a query without terms has no row; rows
of one id are documents of their own, and ask together with the terms of all; texts of any length are taken whole; equal
scores are ranked by id; a document finds itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seguekit.llm.common import cut

_TERM = re.compile(r"[^\W_]+")
UNIT = 1_000_000
PIECE = 4096  #: bytes of a block in a row of the index
PART = 32


@dataclass(frozen=True)
class Bm25:
    k: int = 10
    k1: float = 1.2
    b: float = 0.75
    block: int = 2048
    shards: int = 48
    pass_terms: int = 4_000_000
    queries_at_once: int = 1024
    dense: float = 0.003  #: share of (query, document) pairs of a block from which a term is summed by a matrix product


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


_DOC = {"doc_id": pa.int64(), "asks": pa.bool_(), "early": pa.bool_(), "alike": pa.string(), "size": pa.int64(), "terms": pa.string(), "counts": pa.binary()}
_INDEX = {"piece": pa.binary(), "last": pa.bool_(), "n": pa.int64(), "words": pa.int64()} | _DOC
_DOC_SQL = "doc_id long, asks boolean, early boolean, alike string, size long, terms string, counts binary"


def term_index(docs: DataFrame, asks: Column, alike: Column | None = None, p: Bm25 = Bm25()) -> DataFrame:
    """The documents' blocks, written in shards, and the documents that ask or are early.

    A block is a run of rows with a ``piece`` each, up to the ``last``, which has its number of documents ``n`` and of
    ``words``; a document that asks or is early also has a row of its own without a piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sizes, terms, counts = [], [], []
                for x in b.column("text"):
                    own = terms_of(x.as_py())
                    tf = Counter(own)
                    sizes.append(len(own))
                    terms.append(" ".join(tf))
                    counts.append(np.fromiter(tf.values(), np.int32, len(tf)).tobytes())
                made = [pa.array(sizes, pa.int64()), pa.array(terms, pa.string()), pa.array(counts, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "asks", "early", "alike")), *made], names=list(_DOC))

    early = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(16)) == 0
    of_doc = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(asks, F.lit(False)).alias("asks"), early.alias("early"), (F.lit(None) if alike is None else alike).cast("string").alias("alike")]
    split = docs.where(F.col("doc_id").isNotNull()).select(*of_doc, "text").mapInArrow(run, _DOC_SQL)
    return _dealt(split, p.shards, True, p)


def _dealt(split: DataFrame, shards: int, whole: bool, p: Bm25) -> DataFrame:
    kinds = "piece binary, last boolean, n long, words long, " + _DOC_SQL
    return cut(split.repartition(shards, "doc_id", "terms").sortWithinPartitions("alike", "size").mapInArrow(_written(whole, p), kinds))


def _written(whole: bool, p: Bm25):
    """A map of sorted documents to the rows of the index; those without a piece only for the ``whole`` index."""

    def rows_of(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _INDEX.items()], names=list(_INDEX))

    def block(held: pa.Table) -> pa.RecordBatch:
        data, sizes = _lists(held), held.column("size").to_numpy()
        pieces = [data[at : at + PIECE] for at in range(0, len(data), PIECE)]
        rest = [None] * (len(pieces) - 1)
        return rows_of(piece=pieces, last=[False] * len(rest) + [True], n=[*rest, len(sizes)], words=[*rest, int(sizes.sum())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        kind, n, words = None, 0, 0
        for b in batches:
            again = b.filter(pc.or_(b.column("asks"), b.column("early")))
            if whole and again.num_rows:
                yield rows_of(**{c: again.column(c) for c in _DOC})
            low = 0
            for i, (size, own) in enumerate(zip(b.column("size").to_pylist(), b.column("alike").to_pylist(), strict=True)):
                if n and (own != kind or n == p.block or words + size > p.block * 1024):
                    if low < i:
                        kept.append(b.slice(low, i - low))
                    yield block(pa.Table.from_batches(kept))
                    kept, low, n, words = [], i, 0, 0
                kind, n, words = own, n + 1, words + size
            kept.append(b.slice(low))
        if kept:
            yield block(pa.Table.from_batches(kept))

    return run


def _least(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _lists(held: pa.Table) -> bytes:
    """Ids and sizes of the documents; the terms, the documents of each, which of them, and the counts there."""
    split = [pc.split_pattern(x, " ") for x in held.column("terms").chunks]
    lengths = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in split])
    sizes = held.column("size").to_numpy()
    lengths[sizes == 0] = 1  # one empty word
    flat = pa.chunked_array([x.flatten() for x in split]).combine_chunks().dictionary_encode()
    codes, words = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()
    docs = np.repeat(np.arange(len(sizes)), lengths)
    real = (sizes > 0)[docs]
    codes, docs = codes[real], docs[real]
    counts = np.frombuffer(b"".join(held.column("counts").to_pylist()), np.int32)
    order = np.argsort(codes, kind="stable")
    n = np.bincount(codes, minlength=len(words))
    words = [w for w, x in zip(words, n, strict=True) if x]
    return pickle.dumps((held.column("doc_id").to_numpy(), sizes, " ".join(words), n[n > 0].astype(np.int32), _least(docs[order]), _least(counts[order])), protocol=5)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The blocks of an index, as ``_lists`` put them."""
    pieces: list[bytes] = []
    for b in batches:
        for piece, last in zip(b.column("piece").to_pylist(), b.column("last").to_pylist(), strict=True):
            pieces.append(piece)
            if last:
                ids, sizes, words, n, docs, counts = pickle.loads(b"".join(pieces))
                pieces = []
                yield ids, sizes, words.split(" ") if words else [], n, docs, counts


def _block_rows(index: DataFrame) -> DataFrame:
    return index.where("piece IS NOT NULL").select("piece", "last")


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, n): n documents hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

        for _, _, words, held, _, _ in _stored(batches):
            for w, x in zip(words, held.tolist(), strict=True):
                n[w] += x
            if len(n) > 300_000:
                yield out()
                n = Counter()
        yield out()

    return _block_rows(index).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def impact(tf: np.ndarray, size: np.ndarray, df: np.ndarray, docs: int, mean: float, p: Bm25) -> np.ndarray:
    """In millionths, as doubles: whole numbers and their sums are exact below 2 ** 53."""
    idf = np.log1p((docs - df + 0.5) / (df + 0.5))
    return np.floor(idf * (tf * (p.k1 + 1)) / (tf + p.k1 * (1 - p.b + p.b * size / mean)) * UNIT + 0.5)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and size, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _portions(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of ``sizes`` that add up to about ``most``."""
    ends = np.cumsum(sizes)
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        yield low, high
        low = high


class Block:
    """Postings of a block of documents by term, and the largest impact of each term.

    ``terms`` are those of the postings, or with ``sizes`` those of the lists that the postings come in.
    """

    def __init__(self, ids: np.ndarray, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, sizes: np.ndarray | None = None):
        if sizes is None:
            order = np.argsort(terms, kind="stable")
            docs, impacts = docs[order], impacts[order]
            terms, sizes = np.unique(terms[order], return_counts=True)
        self.ids, self.docs, self.impacts, self.terms, self.sizes = ids, docs.astype(np.intp), impacts, terms, sizes
        self.starts = np.cumsum(sizes) - sizes
        self.tops = np.maximum.reduceat(self.impacts, self.starts) if len(self.terms) else np.empty(0)
        self.near = impacts.astype(np.float32)

    @cached_property
    def parts(self) -> np.ndarray:
        """(terms, parts): the largest impacts in parts of ``PART`` documents of the block."""
        out = np.zeros((len(self.terms), -(-len(self.ids) // PART)), np.float32)
        at = np.repeat(np.arange(len(self.terms)) * out.shape[1], self.sizes) + self.docs // PART
        order = np.argsort(at, kind="stable")  # lists are mostly in the order of their documents
        firsts = np.flatnonzero(np.diff(at[order], prepend=-1))
        if len(firsts):
            out.reshape(-1)[at[order][firsts]] = np.maximum.reduceat(self.near[order], firsts)
        return out

    @cached_property
    def by_document(self) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Where the documents' postings start and end, and their places in ``terms`` and impacts."""
        order = np.argsort(self.docs.astype(np.min_scalar_type(len(self.ids))), kind="stable")
        ends = np.cumsum(np.bincount(self.docs, minlength=len(self.ids)))
        return [0, *ends.tolist()], np.repeat(np.arange(len(self.terms), dtype=np.int32), self.sizes)[order], self.impacts[order]

    def near_scores(self, queries: np.ndarray, slots: np.ndarray, count: int, dense: float) -> np.ndarray:
        """(queries, documents) in single precision, from pairs of a query below ``count``, in their order, and a place in ``terms``.

        Terms that many of the queries and documents hold go by a matrix product, the others posting by posting.
        """
        n = len(self.ids)
        asked = np.bincount(slots, minlength=len(self.terms))
        common = np.flatnonzero(asked * self.sizes > dense * count * n)
        place = np.full(len(self.terms), -1, np.int32)
        place[common] = np.arange(len(common))
        matrix = np.zeros((len(common), n), np.float32)
        own = _ranges(self.starts[common], self.sizes[common])
        matrix[np.repeat(np.arange(len(common)), self.sizes[common]), self.docs[own]] = self.near[own]
        at = place[slots]
        held = at >= 0
        picks = np.zeros((count, len(common)), np.float32)
        picks[queries[held], at[held]] = 1
        out = picks @ matrix
        flat = out.reshape(-1)
        queries, slots = queries[~held], slots[~held]
        sizes = self.sizes[slots]
        for low, high in _portions(sizes, 100_000):  # what the caches hold
            own = _ranges(self.starts[slots[low:high]], sizes[low:high])
            to = np.repeat(queries[low:high] * n, sizes[low:high])
            to += self.docs[own]
            np.add.at(flat, to, self.near[own])
        return out

    def scores(self, queries: np.ndarray, slots: np.ndarray, rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of a query (``rows``) and a document, from pairs of a query, in their order, and a place in ``terms``."""
        bounds, places, impacts = self.by_document
        own, names = np.unique(rows, return_inverse=True)
        asked = [slots[a:b] for a, b in zip(np.searchsorted(queries, own), np.searchsorted(queries, own, "right"), strict=True)]
        order = np.argsort(docs, kind="stable")
        held, out, now, here = np.zeros(len(self.terms)), np.empty(len(rows)), -1, places[:0]
        for i, q, d in zip(order.tolist(), names[order].tolist(), docs[order].tolist(), strict=True):
            if d != now:
                held[here] = 0
                now, here = d, places[bounds[d] : bounds[d + 1]]
                held[here] = impacts[bounds[d] : bounds[d + 1]]
            out[i] = held.take(asked[q]).sum()
        return out


class Best:
    """The k best (score, id) of each query so far; a query's bar is its k-th best score or ``floors``, 0 as long as it has neither."""

    def __init__(self, queries: int, k: int, floors: np.ndarray | None = None):
        self.scores, self.ids, self.k = np.zeros((queries, k)), np.zeros((queries, k), np.int64), k
        self.floors = np.zeros(queries) if floors is None else floors

    @property
    def bars(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floors)

    def take(self, q: np.ndarray, s: np.ndarray, d: np.ndarray) -> None:
        """Merge (query, score, id) of any queries."""
        if not len(q):
            return
        own = np.unique(q)
        q = np.concatenate((np.repeat(own, self.k), q))
        s = np.concatenate((self.scores[own].ravel(), s))
        d = np.concatenate((self.ids[own].ravel(), d))
        order = np.lexsort((d, -s, q))
        q, s, d = q[order], s[order], d[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        self.scores[q[kept], rank[kept]], self.ids[q[kept], rank[kept]] = s[kept], d[kept]


class Queries:
    """(query, term) pairs by query, in batches, and a table of the places that terms have in a block.

    ``floors``: lower bounds of the k-th best scores; documents below them are no answers. Without ``exact``, scores are
    lower bounds, too, and not summed again.
    """

    def __init__(self, count: int, queries: np.ndarray, terms: np.ndarray, n_terms: int, p: Bm25, floors: np.ndarray | None = None, exact: bool = True):
        self.queries, self.terms, self.p, self.count, self.exact = queries, terms, p, count, exact
        self.starts = np.searchsorted(queries, np.arange(count + 1))
        self.slot = np.full(n_terms, -1, np.int32)
        self.best = Best(count, p.k, floors)
        self.skipped = self.seen = self.summed = 0

    def read(self, block: Block) -> None:
        """Take a block's documents into the best of all queries, but for queries that cannot find a better one there."""
        self.slot[block.terms] = np.arange(len(block.terms), dtype=np.int32)
        bars = self.best.bars
        for low in range(0, self.count, self.p.queries_at_once):
            high = min(self.count, low + self.p.queries_at_once)
            own = slice(self.starts[low], self.starts[high])
            slots = self.slot[self.terms[own]]
            held = slots >= 0
            queries, slots = self.queries[own][held] - low, slots[held]
            bounds = np.bincount(queries, block.tops[slots], high - low)
            live = (bounds >= bars[low:high]) & (bounds > 0)
            self._leave_out(live, bounds, bars[low:high], block, queries, slots)
            self.seen, self.skipped = self.seen + high - low, self.skipped + high - low - int(live.sum())
            if live.any():
                names, stay = np.cumsum(live) - 1, live[queries]
                self._take(block, low + np.flatnonzero(live), names[queries[stay]], slots[stay])
        self.slot[block.terms] = -1

    def _leave_out(self, live: np.ndarray, bounds: np.ndarray, bars: np.ndarray, block: Block, queries: np.ndarray, slots: np.ndarray) -> None:
        """Queries that are little over their bars (as those of another language) are tried on the block's parts."""
        close = live & (bounds < 3 * bars)
        for low, high in _portions(np.bincount(queries, minlength=len(live)) * close, 50_000):
            a, b = np.searchsorted(queries, (low, high))
            stay = close[queries[a:b]]
            own, starts = np.unique(queries[a:b][stay], return_index=True)
            if len(own):
                most = np.add.reduceat(block.parts[slots[a:b][stay]], starts, axis=0).max(axis=1)
                error = (np.bincount(queries[a:b][stay])[own] + 4) / 2.0**23
                live[own] = most >= bars[own] * (1 - np.minimum(error, 1))

    def _take(self, block: Block, own: np.ndarray, queries: np.ndarray, slots: np.ndarray) -> None:
        near = block.near_scores(queries, slots, len(own), self.p.dense)
        # n sums and roundings of 2 ** -24 each, and as much again to be safe
        error = np.minimum((np.bincount(queries, minlength=len(own)) + 4) / 2.0**23, 1)
        low = np.maximum(self.best.bars[own], 1)
        reach = near >= (low * (1 - error)).astype(np.float32)[:, None]
        many = np.flatnonzero(np.count_nonzero(reach, axis=1) > 4 * self.p.k)
        if len(many):  # as with low bars: the block's own k-th best is a bar, too
            low[many] = np.maximum(low[many], np.partition(near[many], -self.p.k, axis=1)[:, -self.p.k] * (1 - error[many]))
            reach[many] = near[many] >= (low * (1 - error)).astype(np.float32)[many, None]
        at = np.flatnonzero(reach)
        rows, docs = np.divmod(at, near.shape[1])
        self.summed += len(rows)
        scores = block.scores(queries, slots, rows, docs) if self.exact else np.floor(near.reshape(-1)[at] * (1 - error[rows]))
        good = scores >= np.floor(low[rows])
        self.best.take(own[rows[good]], scores[good], block.ids[docs[good]])


def _asked(index: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, same) of all queries, and (same, rep, alike, terms) of those with different terms; ``terms`` have their document frequency."""
    held = index.where("asks").select(F.col("doc_id").alias("query_id"), "alike", F.explode(F.split("terms", " ")).alias("term")).where("term <> ''")
    held = held.groupBy("query_id", "term").agg(F.min("alike").alias("alike"))
    known = held.join(stats.withColumnRenamed("term", "__t"), F.col("term") == F.col("__t")).select("query_id", "alike", "term", "n")
    of_query = known.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "n"))).alias("terms"), F.min("alike").alias("alike"))
    of_query = cut(of_query.select("query_id", "alike", F.sha2(F.array_join("terms.term", " "), 256).alias("same"), "terms"))
    reps = cut(of_query.groupBy("same").agg(F.min("query_id").alias("rep"), F.min("alike").alias("alike"), F.first("terms").alias("terms")))
    return of_query.select("query_id", "same"), reps


def search(docs: DataFrame, asks: Column, p: Bm25 = Bm25(), alike: Column | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each row of ``docs`` for which ``asks`` holds.

    ``alike``: documents of equal value resemble each other; a hint that changes the speed only.
    """
    sc = docs.sparkSession.sparkContext
    index = term_index(docs, asks, alike, p)
    n_docs, words = index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("words")).first()
    mean = max(words or 0, 1) / max(n_docs, 1)
    of_query, reps = _asked(index, document_frequencies(index))
    early = _block_rows(_dealt(index.where("early").select(*_DOC), max(1, p.shards // 4), False, p))
    pairs, queries = reps.agg(F.sum(F.size("terms")), F.count("*")).first()
    passes = max(1, min(queries, -(-(pairs or 0) // p.pass_terms)))
    best = None
    for i in range(passes):
        block = reps.where(F.pmod(F.xxhash64("rep"), F.lit(passes)) == i).select("rep", "alike", "terms").toArrow()  # of bounded size
        packed = _packed(block)
        sent = sc.broadcast(packed)
        lows = early.mapInArrow(_lows(sent, n_docs, mean, p), "q int, lows array<long>").groupBy("q").agg(F.sort_array(F.flatten(F.collect_list("lows")), False).alias("lows"))
        known = lows.where(F.size("lows") >= p.k).select("q", F.element_at("lows", p.k).alias("low")).toArrow()  # a row for each query of the pass at most
        floors = np.zeros(len(packed[0]))
        floors[known.column("q").to_numpy()] = known.column("low").to_numpy()
        bars = sc.broadcast(floors)
        found = cut(_block_rows(index).mapInArrow(_answers(sent, bars, n_docs, mean, p), "rep long, doc_id long, score long"))
        sent.unpersist()
        bars.unpersist()
        best = found if best is None else best.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "doc_id"))
    top = best.withColumn("rank", rank).where(F.col("rank") <= p.k)
    asked_by = of_query.join(reps.select("same", F.col("rep").alias("__rep")), "same")
    return asked_by.join(top, F.col("__rep") == F.col("rep")).select("query_id", "rank", "doc_id", (F.col("score") / UNIT).alias("score"))


def _packed(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, str, np.ndarray]:
    """Ids of the queries, their (query, term) pairs by number, and the words and document frequencies of the terms."""
    block = block.sort_by([("alike", "ascending"), ("rep", "ascending")])
    lists = block.column("terms").combine_chunks()
    flat = lists.flatten()
    words = flat.field("term").dictionary_encode()
    numbers = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    df = np.zeros(len(words.dictionary), np.int64)
    df[numbers] = flat.field("n").to_numpy(zero_copy_only=False)
    lengths = np.diff(lists.offsets.to_numpy())
    queries = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    return block.column("rep").to_numpy(), queries, numbers, " ".join(words.dictionary.to_pylist()), df


def _blocks(batches: Iterator[pa.RecordBatch], number: dict[str, int], df: np.ndarray, n_docs: int, mean: float, p: Bm25) -> Iterator[Block]:
    for ids, size, words, n, docs, counts in _stored(batches):
        terms = np.fromiter(map(number.get, words, repeat(-1)), np.int32, len(words))
        known = terms >= 0
        held = np.repeat(known, n)
        terms, n, docs = terms[known], n[known], docs[held]
        yield Block(ids, terms, docs, impact(counts[held].astype(np.int32), size[docs], np.repeat(df[terms], n), n_docs, mean, p), n)


def _numbers(words: str) -> dict[str, int]:
    return {w: i for i, w in enumerate(words.split(" "))} if words else {}


def _lows(sent, n_docs: int, mean: float, p: Bm25):
    """A map of one shard's early documents to lower bounds of the k best scores of each query that was sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, queries, terms, words, df = sent.value
        asked = Queries(len(reps), queries, terms, len(df), p, exact=False)
        for block in _blocks(batches, _numbers(words), df, n_docs, mean, p):
            asked.read(block)
        for low in range(0, len(reps), 5_000):
            own = asked.best.scores[low : low + 5_000].astype(np.int64)
            ends = np.concatenate(([0], np.cumsum((own > 0).sum(axis=1))))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own[own > 0], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + len(own)), pa.int32()), lists], names=["q", "lows"])

    return run


def _answers(sent, bars, n_docs: int, mean: float, p: Bm25):
    """A map of one shard's documents to the k best of each query that was sent, those that reach its bar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, queries, terms, words, df = sent.value
        asked = Queries(len(reps), queries, terms, len(df), p, bars.value)
        for block in _blocks(batches, _numbers(words), df, n_docs, mean, p):
            asked.read(block)
        for low in range(0, len(reps), 5_000):
            scores, ids = asked.best.scores[low : low + 5_000], asked.best.ids[low : low + 5_000]
            row, col = np.nonzero(scores > 0)
            yield pa.RecordBatch.from_arrays([pa.array(reps[low + row]), pa.array(ids[row, col]), pa.array(scores[row, col].astype(np.int64))], names=["rep", "doc_id", "score"])

    return run
