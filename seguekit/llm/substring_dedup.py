"""Removal of word passages that stand in an earlier document, by super-k-mer partitioning.

A window is ``width`` consecutive words of one document. A word goes if a window over it also starts in a document with a smaller id.

Each window has a minimiser, the least hash of its runs of ``mer`` words. Consecutive windows of one minimiser are a
super-k-mer; it travels as one packed string to the bucket of its minimiser, where the bucket's windows are sorted and equal ones
stand together, smallest id first. Equal windows have equal minimisers, so a bucket sees all of a window and results are exact.

Three passes over the texts:

1. Ids by minimiser, aggregated on the map side: a minimiser of one document only cannot hold a repeat, and one with more than
   ``dense`` super-k-mers is hot. Both facts go to a bitmap of fixed size (``filter_bits`` slots, 16 MB each), which is
   broadcast. A slot that two minimisers share is a false alarm: it costs a shuffled row and no result. Once a corpus fills the
   bitmap, all super-k-mers travel, some three times the text.
2. Super-k-mers of the marked slots go to their buckets. Equal strings of a bucket (copies) are sorted once.
3. Hot slots have windows that a large share of all documents hold, next to as many different ones. There each window goes by
   itself, by a hash of 128 bits; the least id of a window is aggregated on the map side, and the join back to it can split a hot window.

The spans found are joined to the documents, which are shuffled once.

Defined results: null and empty texts have no words; a null id counts as the largest id there is (2 ** 63 - 1), so it keeps nothing
that another id has; documents of one id don't remove each other's words, and each is answered for; repeats within a document
stay; texts of any length are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seguekit.llm.common import cut, unaligned

LAST_ID = (1 << 63) - 1
#: Words of texts that are hashed at a time, and different words whose hash is remembered.
BATCH, MEMORY = 200_000, 500_000
ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Windows:
    width: int = 50
    mer: int = 8
    dense: int = 2_000  #: super-k-mers of a minimiser from which its windows go one by one
    filter_bits: int = 27


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def super_kmers(hashes: np.ndarray, sizes: np.ndarray, p: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, text, first window's place in the text, windows) of texts whose word hashes stand one after another."""
    windows = np.maximum(sizes - p.width + 1, 0)
    if not windows.sum():
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    n = len(hashes)
    mers = np.zeros(n - p.mer + 1, np.uint64)
    for j in range(p.mer):
        mers = mers * ODD + hashes[j : n - p.mer + 1 + j]
    least, span, wide = mixed(mers), 1, p.width - p.mer + 1
    while span * 2 <= wide:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    least = np.minimum(least[: n - p.width + 1], least[wide - span : wide - span + n - p.width + 1])
    text = np.repeat(np.arange(len(sizes)), windows)
    place = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    key = least[place + (np.cumsum(sizes) - sizes)[text]]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (text[1:] != text[:-1]))))
    return key[first], text[first], place[first], np.diff(np.append(first, len(key)))


class Texts:
    """A batch of texts as words, with their super-k-mers."""

    def __init__(self, ids: list[int], hashes: list[int], words: list[list[bytes]], known: WordHashes, p: Windows):
        self.ids, self.hashes, self.words, self.p = np.array(ids, np.int64), np.array(hashes, np.int64), words, p
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.concatenate([np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for w in words])
        self.key, self.text, self.place, self.count = super_kmers(flat, self.sizes, p)

    def packed(self, which: np.ndarray) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """Of the super-k-mers of these numbers: their words as one string, and where in it each word starts and ends."""
        at = -1
        for k in which.tolist():
            if at != self.text[k]:
                at = self.text[k]
                line = b" ".join(self.words[at])
                ends = np.cumsum([len(w) + 1 for w in self.words[at]])
                starts = np.concatenate(([0], ends[:-1]))
            a, b = self.place[k], self.place[k] + self.count[k] + self.p.width - 1
            yield line[starts[a] : ends[b - 1] - 1], starts[a:b] - starts[a], ends[a:b] - 1 - starts[a]


def _texts(batches: Iterator[pa.RecordBatch], p: Windows) -> Iterator[Texts]:
    held, size, known = ([], [], []), 0, WordHashes()
    for b in batches:
        for doc_id, h, text in zip(b.column("id"), b.column("hash"), b.column("text"), strict=True):
            words = text.as_py().encode().split()  # bytes: only 9-13 and 32 split
            if len(words) < p.width:
                continue
            for column, value in zip(held, (doc_id.as_py(), h.as_py(), words), strict=True):
                column.append(value)
            size += len(words)
            if size >= BATCH:
                yield Texts(*held, known, p)
                held, size = ([], [], []), 0
    if size:
        yield Texts(*held, known, p)


def _slots(key: np.ndarray, p: Windows) -> tuple[np.ndarray, np.ndarray]:
    """The word of the bitmap and the bit in it."""
    slot = key & np.uint64((1 << p.filter_bits) - 1)
    return slot >> np.uint64(6), slot & np.uint64(63)


def marked_minimisers(rows: DataFrame, p: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of fixed size: slots of minimisers of two or more documents, and slots of hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _texts(batches, p):
            yield pa.RecordBatch.from_arrays([pa.array(t.key.view(np.int64)), pa.array(t.ids[t.text])], names=["key", "id"])

    ids = rows.mapInArrow(run, "key long, id long").groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    slot = F.col("key").bitwiseAND(F.lit((1 << p.filter_bits) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = ids.where("low < high").groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("shared"), F.bit_or(F.when(F.col("n") > p.dense, bit).otherwise(F.lit(0).cast("long"))).alias("hot"))
    found = words.toArrow()  # at most 2 ** filter_bits / 64 rows
    shared, hot = np.zeros((2, 1 << p.filter_bits - 6), np.uint64)
    at = found.column("word").to_numpy()
    shared[at], hot[at] = (found.column(c).to_numpy().view(np.uint64) for c in ("shared", "hot"))
    return shared, hot


def _marked(t: Texts, bits: np.ndarray) -> np.ndarray:
    word, bit = _slots(t.key, t.p)
    return (bits[word] >> bit & np.uint64(1)).astype(bool)


def _bucket(rows: list[tuple[int, int, int, bytes]], width: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, hash, start, end) of the words under windows that a smaller id has; ``rows`` (id, hash, start, packed) by id."""
    least: dict[bytes, int] = {}
    for doc_id, _, _, packed in rows:
        least.setdefault(packed, doc_id)
    if len(least) == 1:
        for doc_id, h, start, packed in rows:
            if doc_id > rows[0][0]:
                yield doc_id, h, start, start + packed.count(b" ") + 1
        return
    windows, owner, first = [], [], {}
    for packed, doc_id in least.items():
        spaces = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32)
        starts, ends = [0, *(spaces[: len(spaces) - width + 1] + 1).tolist()], [*spaces[width - 1 :].tolist(), len(packed)]
        first[packed] = len(windows)
        windows += [packed[a:b] for a, b in zip(starts, ends, strict=True)]
        owner += [doc_id] * len(ends)
    order = sorted(range(len(windows)), key=windows.__getitem__)  # stable: equal windows by id
    low = [0] * len(windows)
    before = None
    for k in order:
        if windows[k] != before:
            before, smallest = windows[k], owner[k]
        low[k] = smallest
    for doc_id, h, start, packed in rows:
        begin, open_at = first[packed], None
        n = packed.count(b" ") + 2 - width
        for k in range(n):
            if low[begin + k] < doc_id:
                open_at = k if open_at is None else open_at
            elif open_at is not None:
                yield doc_id, h, start + open_at, start + k - 1 + width
                open_at = None
        if open_at is not None:
            yield doc_id, h, start + open_at, start + n - 1 + width


SPAN = "id long, hash long, start long, end long"


def _spans_in_buckets(rows: DataFrame, sent, p: Windows) -> DataFrame:
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, hot = sent.value
        for t in _texts(batches, p):
            which = np.flatnonzero(_marked(t, shared) & ~_marked(t, hot))
            for low in range(0, len(which), 4096):
                k = which[low : low + 4096]
                packed = pa.array([x[0] for x in t.packed(k)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(t.key[k].view(np.int64)), pa.array(t.ids[t.text[k]]), pa.array(t.hashes[t.text[k]]), pa.array(t.place[k]), packed], names=["key", "id", "hash", "start", "packed"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_pydict(dict(zip(("id", "hash", "start", "end"), map(list, zip(*made, strict=True)), strict=True)), pa.schema([(c, pa.int64()) for c in ("id", "hash", "start", "end")]))

        open_key, held, made = None, [], []
        for b in batches:
            for key, *row in zip(*(b.column(c).to_pylist() for c in ("key", "id", "hash", "start", "packed")), strict=True):
                if key != open_key:
                    if len(held) > 1:
                        made += _bucket(held, p.width)
                    open_key, held = key, []
                    if len(made) > 10_000:
                        yield out()
                        made = []
                held.append(row)
        if len(held) > 1:
            made += _bucket(held, p.width)
        if made:
            yield out()

    strings = rows.mapInArrow(cut_up, "key long, id long, hash long, start long, packed binary")
    return strings.repartition("key").sortWithinPartitions("key", "id").mapInArrow(sort, SPAN)


def _spans_of_hot_windows(rows: DataFrame, sent, p: Windows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _texts(batches, p):
            which = np.flatnonzero(_marked(t, sent.value[1]))
            for low in range(0, len(which), 1024):
                k = which[low : low + 1024]
                digest = b"".join(xxhash.xxh3_128_digest(line[a:b]) for line, starts, ends in t.packed(k) for a, b in zip(starts[: len(starts) - p.width + 1].tolist(), ends[p.width - 1 :].tolist(), strict=True))
                text, count = np.repeat(t.text[k], t.count[k]), t.count[k]
                start = np.repeat(t.place[k] - np.cumsum(count) + count, count) + np.arange(count.sum())
                halves = np.frombuffer(digest, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*(pa.array(halves[:, i]) for i in (0, 1)), pa.array(t.ids[text]), pa.array(t.hashes[text]), pa.array(start)], names=["h0", "h1", "id", "hash", "start"])

    windows = cut(rows.mapInArrow(run, "h0 long, h1 long, id long, hash long, start long"))
    least = windows.groupBy("h0", "h1").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    least = least.select(unaligned(F.col("h0")).alias("__h0"), F.col("h1").alias("__h1"), "low")
    later = windows.join(least, (F.col("h0") == F.col("__h0")) & (F.col("h1") == F.col("__h1"))).where("id > low")
    return later.select("id", "hash", "start", (F.col("start") + p.width).alias("end"))


def repeated_spans(rows: DataFrame, p: Windows = Windows()) -> DataFrame:
    """(id, hash, start, end): words of ``rows`` (id, hash, text) that go; spans may overlap."""
    shared, hot = marked_minimisers(rows, p)
    sent = rows.sparkSession.sparkContext.broadcast((shared, hot))
    spans = _spans_in_buckets(rows, sent, p)
    return spans.unionByName(_spans_of_hot_windows(rows, sent, p)) if hot.any() else spans


def _identified(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST_ID))


def drop_repeats(docs: DataFrame, p: Windows = Windows()) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept): each text's words, the spans of those that go, and the others joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sizes, gone, removed, kept = [], [], [], []
                for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
                    words = text.as_py().encode().split()
                    marks = np.zeros(len(words) + 2, np.int64)
                    for s in spans or ():
                        marks[s["start"] + 1] += 1
                        marks[s["end"] + 1] -= 1
                    out = np.cumsum(marks) > 0
                    edges = np.flatnonzero(out[1:] != out[:-1]).reshape(-1, 2).tolist()
                    sizes.append(len(words))
                    gone.append(int(out.sum()))
                    removed.append([{"start": x, "end": y} for x, y in edges])
                    cuts = [0, *(i for e in edges for i in e), len(words)]
                    kept.append(b" ".join(w for k in range(0, len(cuts), 2) for w in words[cuts[k] : cuts[k + 1]]).decode())
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, span), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "removed", "kept"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _identified(F.col("doc_id")).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    spans = repeated_spans(rows.select("id", "hash", "text"), p).groupBy("id", "hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = spans.select(unaligned(F.col("id")).alias("__id"), F.col("hash").alias("__hash"), "spans")
    joined = rows.join(spans, (F.col("id") == F.col("__id")) & (F.col("hash") == F.col("__hash")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept string")
