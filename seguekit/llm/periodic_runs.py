"""Runs of periodic words by recompression.

A run is a stretch of words with smallest period q, at least ``min_length`` words and ``min_exponent`` periods long, that
no neighbouring word extends.

Candidates lie on a harmonic grid: a run of period p holds a place i, a multiple of (``min_exponent`` - 1) * p, with word i
equal to word i + p, and so equal are the words beside them on one side. That is n log n pairs (i, i + p) a text, of which few pass. For
those that do, the longest common extensions of i and i + p to the right and to the left give the run exactly. Smaller periods of the
same stretch are candidates too, so the least period found for a stretch is its smallest.

Extensions come from a run-length grammar: levels alternate block compression (a maximal run of one symbol becomes one symbol)
and pair compression (symbols are split by a coin each, and every left one followed by a right one becomes one symbol). Levels parse
equal words equally but for a symbol or two at the ends, so two places climb the levels with at most one step a level until their
symbols differ, and come down with at most one step a level to the words where the extension ends: no suffix array and O(log n) a
question. A grammar covers a batch of texts, which fences of unique symbols separate; another one over the reversed words answers for the left.

Texts are independent, so this is one narrow map. Memory is a few arrays over the words of a batch or of one text, and candidates are made in pieces.

Defined results: null and empty texts have no words and no run; null ids are kept (and never rearranged); repeated rows are rows of their
own; texts of any length are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = "struct<start: long, length: long, period: long>"
#: Words of a batch of texts that share a grammar, and candidates that are asked about at a time.
BATCH, PIECE, COINS = 200_000, 200_000, np.uint64(0x9E3779B97F4A7C15)
Order = Callable[[int, int], np.ndarray | None]


class Grammar:
    """Levels of block and pair compression; ``fenced`` marks symbols that stay alone and differ from all others."""

    def __init__(self, symbols: np.ndarray, fenced: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]] = []
        self.rules = int(symbols.max()) + 1
        while np.diff(np.flatnonzero(fenced)).max() > 4:
            symbols, fenced = self._add_blocks(symbols, fenced)
            symbols, fenced = self._add_pairs(symbols, fenced)
        self.top = symbols

    def _add(self, symbols, heads, block_ends, changed, keys, fenced):
        """A level: its symbols, the ends of its blocks, which of them begin a phrase, the phrase of each, and the first symbol of each phrase."""
        first = np.flatnonzero(heads)
        self.levels.append((symbols, block_ends, heads, np.cumsum(heads) - 1, first))
        above = symbols[first]
        names, number = np.unique(keys, return_inverse=True)
        above[changed] = self.rules + number
        self.rules += len(names)
        return above, fenced[first]

    def _add_blocks(self, symbols, fenced):
        heads = np.concatenate(([True], symbols[1:] != symbols[:-1]))
        if heads.all():
            return symbols, fenced
        first = np.flatnonzero(heads)
        sizes = np.diff(np.append(first, len(symbols)))
        long = sizes > 1
        keys = symbols[first[long]] * (int(sizes.max()) + 1) + sizes[long]
        return self._add(symbols, heads, np.repeat(first + sizes, sizes), long, keys, fenced)

    def _add_pairs(self, symbols, fenced):
        coin = (symbols.astype(np.uint64) + np.uint64(len(self.levels) * 0xD1B54A32D192ED03 & (1 << 64) - 1)) * COINS
        coin = (coin ^ (coin >> np.uint64(32))) * COINS >> np.uint64(63)
        free = ~(fenced[:-1] | fenced[1:])
        rising, falling = (free & (coin[:-1] == c) & (coin[1:] == 1 - c) for c in (0, 1))
        left = np.flatnonzero(rising if rising.sum() >= falling.sum() else falling)
        heads = np.ones(len(symbols), bool)
        heads[left + 1] = False
        phrase = np.cumsum(heads) - 1
        return self._add(symbols, heads, None, phrase[left], symbols[left] * self.rules + symbols[left + 1], fenced)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` on equal those from ``b`` on; a fence stands after one of them at the latest."""
        at = np.stack((a, b))
        differ = np.full(len(a), len(self.levels))  # the level at which a question's symbols differ
        live = np.arange(len(a))
        for h, (symbols, ends, heads, phrase, _) in enumerate(self.levels):
            x = at[:, live]
            same = symbols[x[0]] == symbols[x[1]]
            step = same & ~heads[x].all(axis=0)  # to the next place where both begin a phrase
            if ends is None:
                x += step
            else:
                left = ends[x] - x
                same &= ~step | (left[0] == left[1])
                x += np.where(step, left.min(axis=0), 0)
            differ[live[~same]] = h
            at[:, live] = np.where(same, phrase[np.where(same, x, 0)], x)
            live = live[same]
        while len(live):
            x = at[:, live]
            live = live[self.top[x[0]] == self.top[x[1]]]
            at[:, live] += 1
        for h in range(len(self.levels) - 1, -1, -1):
            symbols, ends, _, _, first = self.levels[h]
            down = np.flatnonzero(differ > h)
            x = first[at[:, down]]
            same = symbols[x[0]] == symbols[x[1]]
            at[:, down] = x + np.where(same, 1 if ends is None else (ends[x] - x).min(axis=0), 0)
        return at[0] - a


@lru_cache(2)
def _grid_table(most: int, step: int, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, periods, least text length) of all candidates for texts of up to ``most`` words, by that length."""
    parts = list(_grid(most, step, min_length, 1 << 62))
    i, p = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
    need = np.maximum(np.maximum(i + p + 1, (step + 1) * p), min_length)
    order = np.argsort(need, kind="stable")
    return i[order], p[order], need[order]


def _grid(n: int, step: int, min_length: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    low, last = 1, n // (step + 1) if n >= min_length else 0
    while low <= last:
        high = min(last, low + max(1, piece * step * low // n))
        p = np.arange(low, high + 1)
        counts = (n - p - 1) // (step * p) + 1
        ends = np.cumsum(counts)
        periods = np.repeat(p, counts)
        yield (np.arange(ends[-1]) - np.repeat(ends - counts, counts)) * step * periods, periods
        low = high + 1


def candidates(words: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, periods) of the grid that may lie in a run: equal words there, and at the next two places of one side."""
    n, step = len(words), min_exponent - 1
    if n <= 4096:
        i, p, need = _grid_table(4096, step, min_length)
        pieces = [(i[: (k := np.searchsorted(need, n, "right"))], p[:k])]
    else:
        pieces = _grid(n, step, min_length, PIECE)
    beside = min(2, min(max(min_length - p, step * p) for p in (1, 2, 3)) // 2)  # equal places on the longer side of any in a run
    padded = np.concatenate(([-1, -2], words, [-3, -4]))
    found = []
    for i, p in pieces:
        hit = words[i] == words[i + p]
        i, p = i[hit], p[hit]
        if beside and len(i):
            at = i + 2
            right, left = (np.logical_and.reduce([padded[at + s * d] == padded[at + s * d + p] for d in range(1, beside + 1)]) for s in (1, -1))
            i, p = i[right | left], p[right | left]
        found.append((i, p))
    return tuple(np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))


def find_runs(texts: list[np.ndarray], min_length: int = 6, min_exponent: int = 4) -> list[np.ndarray]:
    """For each text, given as word numbers, its runs as rows (start, length, period), by start and period."""
    out = [np.empty((0, 3), np.int64)] * len(texts)
    asked = [(k, *c) for k, t in enumerate(texts) if len((c := candidates(t, min_length, min_exponent))[0])]
    if not asked:
        return out
    names = 1 + max(int(texts[k].max()) for k, _, _ in asked)
    joined, offset, at = [np.array([names])], {}, 1
    for n, (k, _, _) in enumerate(asked):
        offset[k] = at
        joined += [texts[k], [names + n + 1]]
        at += len(texts[k]) + 1
    symbols = np.concatenate(joined).astype(np.int64)
    fenced = symbols >= names
    right, left, last = Grammar(symbols, fenced), Grammar(symbols[::-1].copy(), fenced[::-1].copy()), len(symbols) - 1
    for k, places, periods in asked:
        found = []
        for low in range(0, len(places), PIECE):
            i, p = places[low : low + PIECE] + offset[k], periods[low : low + PIECE]
            start = i - left.extension(last - i + 1, last - i - p + 1)
            end = i + p + right.extension(i, i + p)
            long = end - start >= np.maximum(min_length, min_exponent * p)
            found.append(np.unique(np.stack((start - offset[k], end - start, p), axis=1)[long], axis=0))
        runs = np.unique(np.concatenate(found), axis=0)  # by start, length, period
        runs = runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)))] if len(runs) else runs
        out[k] = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay if every run is cut down to its first period."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(marks)[:n] == 0


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, order: Order | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all runs of each text, and its words without the repeats, joined by one space.

    ``order`` may give, for an id and a number of words, the places whose words the text is to be read as.
    """

    def answer(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        texts = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for _, words in held]
        runs, sizes, collapsed = find_runs(texts, min_length, min_exponent), [len(t) for t in texts], []
        for (_, words), own in zip(held, runs, strict=True):
            if len(own):
                stay = kept_words(len(words), own)
                words = [words[i] for i in np.flatnonzero(stay).tolist()]
            collapsed.append(b" ".join(words).decode())
        flat = np.concatenate([np.empty((0, 3), np.int64), *runs])
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
        spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"]))
        columns = [pa.array([x for x, _ in held], pa.int64()), pa.array(sizes, pa.int64()), spans, pa.array(collapsed, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                doc_id, words = doc_id.as_py(), (text.as_py() or "").encode().split()  # bytes: only 9-13 and 32 split
                places = order(doc_id, len(words)) if order and doc_id is not None and words else None
                if places is not None:
                    words = [words[i] for i in places.tolist()]
                held.append((doc_id, words))
                size += len(words)
                if size >= BATCH or len(held) >= 4096:
                    yield answer(held)
                    held, size = [], 0
        if held:
            yield answer(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def planted_order(doc_id: int, n: int) -> np.ndarray | None:
    """Places that make a tenth of all texts periodic from some word on, by a checksum of their id."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((np.arange(a), a + np.arange(n - a) % p))


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: least start, then period) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.select("doc_id", "n_words", "runs", "collapsed", best.alias("best"))
    length, period = F.col("best.length"), -F.col("best.p")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"), F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
