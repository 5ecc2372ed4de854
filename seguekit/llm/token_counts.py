"""Token counts under a unigram model, with forward scores shared along a trie of the distinct pre-tokens.

Scores of the vocabulary's tokens are Zipf log-probabilities of their ranks, -ln((rank + 1) * H), in millionths, so
sums are exact. The best segmentation of a pre-token has the highest sum, and among equals the fewest tokens.

The forward score at a byte depends only on the bytes before it. The distinct pre-tokens of a batch are taken in sorted
order, which is a depth-first walk through their trie: what two neighbours share is worked out once, and the state at
each terminal is stored as the count of its pre-token. Counts of pieces already seen are kept in a bounded table
that goes with the task.

Defined results: null texts are empty and have no token; a byte that the vocabulary lacks is a token of its own, one unit
below the lowest score; texts of any length are counted whole; an empty table gives an empty result; repeated rows are
counted each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seguekit.llm.byte_bpe import read_ranks, safe_pieces

SEEN_PIECES = 700_000
UNIT = 1_000_000
BITS = 40
FIELD = (1 << BITS) - 1


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    harmonic = sum(1.0 / (r + 1) for r in ranks.values())
    return {t: round(-math.log((r + 1) * harmonic) * UNIT) for t, r in ranks.items()}


class TrieCounter:
    def __init__(self, scores: dict[bytes, int], pattern: str):
        low = min(scores.values(), default=0) - UNIT
        scores = {bytes([b]): low for b in range(256)} | scores
        self.scores = scores
        self.endings = {t[i:] for t in scores for i in range(len(t))}  # a look back stops where no token ends so
        self._findall = regex.compile(pattern).findall
        self._seen: dict[str, int] = {}  # pre-tokens, tokens and -score of a piece side by side in one number, so that a text is one sum

    def terminals(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, int]]:
        """(tokens, score) of each word. ``best`` and ``count`` hold the states of the trie path to the last word."""
        scores, endings = self.scores, self.endings
        best, count, last, out = [0], [0], b"", {}
        for w in sorted(words):
            shared, most = 0, min(len(last), len(w))
            while shared < most and last[shared] == w[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for i in range(shared + 1, len(w) + 1):
                top, n, j = None, 0, i - 1
                while j >= 0 and (piece := w[j:i]) in endings:
                    s = scores.get(piece)
                    if s is not None:
                        s += best[j]
                        if top is None or s > top or s == top and count[j] + 1 < n:
                            top, n = s, count[j] + 1
                    j -= 1
                best.append(top)
                count.append(n)
            out[w] = (count[-1], best[-1])
            last = w
        return out

    def count_batch(self, texts: list[str], at_once: int = 200_000) -> Iterator[tuple[int, int, int]]:
        """(pre-tokens, tokens, score) of each text. Pieces of many texts are learnt together, so that the trie shares more."""
        parts, ends = [], []
        for text in texts:
            parts += safe_pieces(text)
            ends.append(len(parts))
            if len(parts) >= at_once:
                yield from self._sums(parts, ends, at_once)
                parts, ends = [], []
        yield from self._sums(parts, ends, at_once)

    def _sums(self, parts: list[str], ends: list[int], at_once: int) -> Iterator[tuple[int, int, int]]:
        packed: list[int] = []
        for i in range(0, len(parts), at_once):
            some = parts[i : i + at_once]
            self._learn(some)
            packed += map(self._seen.__getitem__, some)
        start = 0
        for end in ends:
            total = sum(packed[start:end])
            yield total & FIELD, total >> BITS & FIELD, -(total >> 2 * BITS)
            start = end

    def forget(self) -> None:
        self._seen.clear()

    def _learn(self, pieces: Iterable[str]) -> None:
        seen = self._seen
        new = [p for p in set(pieces) if p not in seen]
        if not new:
            return
        if len(seen) > SEEN_PIECES:
            seen.clear()
            new = list(set(pieces))
        cut = [[p.encode("utf-8")] if p[0] == " " and p[1:].isalpha() else [w.encode("utf-8") for w in self._findall(p)] for p in new]
        of = self.terminals({w for own in cut for w in own})
        for p, own in zip(new, cut, strict=True):
            tokens, score = of[own[0]] if len(own) == 1 else map(sum, zip(*(of[w] for w in own), strict=True))
            seen[p] = len(own) | tokens << BITS | -score << 2 * BITS


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> TrieCounter:
    """One counter per worker process."""
    return TrieCounter(zipf_scores(read_ranks(path)), pattern)


def token_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, score); a narrow map over whole texts. ``score`` is the log-probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                rows = list(counter.count_batch(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] / UNIT for r in rows], pa.float64())], names=["doc_id", "n_pretokens", "n_tokens", "score"])
        counter.forget()  # workers live on and serve other tasks

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")
