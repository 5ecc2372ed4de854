"""Byte-level BPE with the tokenizers library over Arrow batches.

The ranks of a public vocabulary become a BPE model of the library: bytes are written as printable characters by the
usual byte table, and every way to split a token in two known tokens is a merge, in order of the token's rank, so
merges happen exactly where their result is the lowest rank, as with plain ranks. Texts are cut by the vocabulary's
pattern. Each piece between two single spaces is cut and encoded once per worker and then looked up: a single space
between two characters that aren't white space is always a boundary of the pattern, so pieces do not depend on their
neighbours. The table of seen pieces is bounded, starts anew when full and goes with the task; it only saves time.

Decoding turns ids to token characters, those to bytes by the reversed table, and bytes to text at the end, so
characters split over tokens come back whole. Offsets are code points in the text; a token that ends inside a
character ends after it, and the token that continues it begins before it.

Defined results: null texts are empty; empty texts have no ids; texts of any length are encoded whole; an empty table gives
an empty result; repeated rows are encoded each; other columns are ignored, whatever their names. The vocabulary must hold
every single byte.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

#: White space that touches a space: there the spaces are no safe boundary by themselves.
_TOUCHING = re.compile(r"\s | \s")
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
SEEN_PIECES = 400_000


def byte_table() -> list[str]:
    """Character of each byte: printable Latin-1 stands for itself, the others for 256, 257, ... in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def safe_pieces(text: str) -> list[str]:
    """Parts of ``text`` at safe boundaries; all but the first begin with their space."""
    if not text:
        return []
    parts = _BOUNDARY.split(text) if _TOUCHING.search(text) else text.split(" ")
    if len(parts) > 1 and not parts[0]:  # the text begins with a space
        return [" " + p for p in parts[1:]]
    return [parts[0], *(" " + p for p in parts[1:])]


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        self.table = byte_table()
        self._chars = dict(enumerate(self.table))
        self.ranks = read_ranks(path)
        merges = [(self.to_chars(t[:i]), self.to_chars(t[i:])) for t in sorted(self.ranks, key=self.ranks.get) for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        vocabulary = {self.to_chars(t): r for t, r in self.ranks.items()}
        self._names = {r: c for c, r in vocabulary.items()}
        self._tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
        self._pattern = regex.compile(pattern)
        self._seen: dict[str, bytes] = {}

    def to_chars(self, raw: bytes) -> str:
        return raw.decode("latin-1").translate(self._chars)

    def _learn(self, pieces: list[str]) -> None:
        findall = self._pattern.findall
        cut = [[p] if p[1:].isalpha() and p[0] == " " else findall(p) for p in pieces]  # " letters" is one match
        words = list({w for own in cut for w in own})
        done = self._tokenizer.encode([w.encode("utf-8").decode("latin-1").translate(self._chars) for w in words], is_pretokenized=True, add_special_tokens=False)
        ends = (4 * np.searchsorted(np.array(done.word_ids, np.int64), np.arange(len(words)), side="right")).tolist()
        raw = np.array(done.ids, "<u4").tobytes()
        of = {w: raw[a:b] for w, a, b in zip(words, [0, *ends], ends, strict=False)}
        self._seen.update((p, of[own[0]] if len(own) == 1 else b"".join([of[w] for w in own])) for p, own in zip(pieces, cut, strict=True))

    def encode_batch(self, texts: list[str], at_once: int = 50_000) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; pieces are learnt ``at_once`` at most."""
        parts, ends = [], []
        for text in texts:
            parts += safe_pieces(text)
            ends.append(len(parts))
            if len(parts) >= at_once:
                yield from self._ids(parts, ends, at_once)
                parts, ends = [], []
        yield from self._ids(parts, ends, at_once)

    def forget(self) -> None:
        self._seen.clear()

    def _ids(self, parts: list[str], ends: list[int], at_once: int) -> Iterator[bytes]:
        seen, found = self._seen, []
        for i in range(0, len(parts), at_once):
            some = parts[i : i + at_once]
            if len(seen) > SEEN_PIECES:
                seen.clear()
            new = list({p for p in some if p not in seen})
            if new:
                self._learn(new)
            found += [seen[p] for p in some]
        start = 0
        for end in ends:
            yield b"".join(found[start:end])
            start = end

    @cached_property
    def reverse(self) -> list[bytes]:
        """Bytes of each id: its token's characters through the reversed byte table."""
        byte = {c: b for b, c in enumerate(self.table)}
        return [bytes(byte[c] for c in self._names.get(i, "")) for i in range(max(self._names) + 1)]

    @cached_property
    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in self.reverse], np.int64)
        return np.frombuffer(b"".join(self.reverse), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode_bytes(self, ids) -> bytes:
        """The tokens' bytes one after another, in steps of bounded size."""
        text, start, size = self._flat
        ids, out = np.asarray(ids, np.int64), []
        for i in range(0, len(ids), 1 << 18):
            n = size[ids[i : i + (1 << 18)]]
            ends = np.cumsum(n)
            at = np.repeat(start[ids[i : i + (1 << 18)]] - (ends - n), n) + np.arange(ends[-1])
            out.append(text[at].tobytes())
        return b"".join(out)

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def offsets(self, ids) -> list[tuple[int, int]]:
        """(start, end) of each token in code points of the decoded text."""
        out, chars, pending = [], 0, 0
        for i in ids:
            start = chars - 1 if pending else chars
            for b in self.reverse[i]:
                if pending and b & 0xC0 == 0x80:
                    pending -= 1
                else:
                    chars += 1
                    pending = 0 if b < 0xC0 else 1 if b < 0xE0 else 2 if b < 0xF0 else 3
            out.append((start, chars))
        return out


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """One model per worker process."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """(doc_id, ids array<int>[, offsets array<struct<start,end>>]); a narrow map over whole texts."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode_batch(b.column("text").to_pylist())]
            cols = [b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))]
            if offsets:
                cols.append(pa.array([[{"start": s, "end": e} for s, e in bpe.offsets(x.tolist())] for x in ids], spans))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "offsets"][: len(cols)])
        bpe.forget()  # workers live on and serve other tasks

    kind = "doc_id long, ids array<int>" + ", offsets array<struct<start:bigint,end:bigint>>" * offsets
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, kind)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids and of the bytes that they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            rows = []
            for raw in bpe.encode_batch(b.column("text").to_pylist()):
                decoded = bpe.decode_bytes(np.frombuffer(raw, "<u4"))
                rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
