"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints at ``radius`` = 4 or fewer differing bits are linked, and documents that links connect are one component.

Two fingerprints within the radius are both within half of it of a fingerprint in the middle. With ``blocks`` = 1
every fingerprint emits all variants within 2 bits, 2081 keys of 64 bits each. With ``blocks`` = 2 (production) the
same is done on each half of the bits: of 4 differing bits at most 2 fall on one of the halves, so there the pair meets
at a variant within 1 bit, and a fingerprint emits 2 * 33 keys. Both are exact; colliding pairs are verified on all 64
bits. Keys go through one shuffle on the variant.

Dense variants: a task reads the fingerprints of a variant as a sorted run, compares them blockwise and writes only
the edges of a spanning forest, so a group of near copies gives a row per member, not a row per pair. Variants held by
more than ``dense`` different fingerprints take another way that is linear in their number: their members emit their
full 64-bit balls, and any two that share a variant there are within the radius (2 + 2), so they are linked to
the smallest fingerprint of the variant with no comparison at all.

Links by similarity (``near_dedup_similar``): four bits are far less than what separates texts whose word shingles have a
Jaccard similarity of 0.8 (a seventh of all bits). There, fingerprints have 192 bits in eight blocks of 24; each block is
hashed as a ball of radius 2 (25 keys of variants within 1 bit), and two texts are candidates if they meet at one of the
blocks and differ in at most ``near`` bits. Blocks differ in 3.5 of 24 bits on average at a similarity of 0.8, and the chance
to meet on none of the eight is some 6 %; at 0.9 it is below 1 %. Candidates are then held against the texts themselves.
That goes in three steps. First a node is compared with one other, the least node that shares a whole block with it: members of a
large group of near copies nearly all link to a few hubs there, one candidate each. Then all keys are searched for what is near, but
nodes that whole blocks have brought into one near component give no candidates among themselves; the others are compared pair by pair.
Near components are crowds: any two members may be similar, whatever forest holds them together. A crowd that the links found so far
don't make one component is compared as a whole: its texts go to tiles, one for any two of its blocks of bounded size, and a tile counts
the shared shingles of all its pairs and writes a forest of the similar ones. So no step writes a row per pair; a crowd of n texts
that stay apart costs n * n / ``tile_rows`` rows of text. Nothing below ``similarity`` is ever linked. Unrelated documents meet at random
on 25 * documents / 2 ** block_bits of keys, so ``block_bits`` should grow with the logarithm of the corpus (and ``words`` with the blocks).

Defined results: null and empty texts have fingerprint zero and link to each other (and to near-zero fingerprints);
equal fingerprints are one node, so exact copies add no work to the search; repeated rows and ids are rows of their own;
a null doc_id counts only where a component has no other (its component_id is then null); texts of any length are taken
whole; an empty table gives an empty result; extra columns are ignored by fingerprints and kept by the dedups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seguekit.llm.common import bitmap, cut, put, remove, unaligned, with_bits

SEED, BITS, CHUNK = 42, 64, 1 << 18


def shingle_hashes(text: str | None, width: int = 4) -> Iterator[np.ndarray]:
    """XXH64 of each word shingle, repeats included, in bounded pieces."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z fold, only 9-13 and 32 split
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    starts = np.concatenate(([0], ends[:-1]))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), CHUNK):
        part = zip(starts[i : i + CHUNK].tolist(), (ends[i : i + CHUNK] - 1).tolist(), strict=True)
        yield np.array([digest(line[a:b], SEED) for a, b in part], np.uint64)


def count_bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 4096):
        bits = np.unpackbits(h[i : i + 4096].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
        whole = len(bits) // 128 * 128  # sums of 128 rows fit in a byte
        ones += bits[:whole].reshape(-1, 128, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return ones


def rehash(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th further hash of hashes, by multiplications and shifts (splitmix64); the 0-th is the hash itself."""
    if not n:
        return h
    x = h + np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint_words(text: str | None, width: int, words: int) -> list[int]:
    """64-bit words of a fingerprint as signed longs. Bit b is 1 if bit b of over half the shingle hashes is 1; 0 without words."""
    ones, n = np.zeros((words, BITS), np.int64), 0
    for h in shingle_hashes(text, width):
        for w in range(words):
            ones[w] += count_bits(rehash(h, w))
        n += len(h)
    if not n:
        return [0] * words
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view("<i8").ravel().tolist()


def fingerprint(text: str | None, width: int = 4) -> int:
    return fingerprint_words(text, width, 1)[0]


def with_fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 4, words: int = 1) -> DataFrame:
    """(doc_id, fp, text_hash); a narrow map over whole texts. With more ``words``, f0, f1, ... and fp, a hash of them."""
    names = ["fp"] if words == 1 else [f"f{w}" for w in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint_words(x.as_py(), width, words) for x in b.column("text")], np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *(pa.array(fps[:, w]) for w in range(words))], names=["doc_id", "text_hash", *names])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    out = rows.mapInArrow(run, ", ".join(["doc_id long", "text_hash long", *(f"{n} long" for n in names)]))
    return out.select("doc_id", "fp", "text_hash") if words == 1 else out.withColumn("fp", F.xxhash64(*names))


def masks(bits: int, radius: int) -> np.ndarray:
    """All patterns of at most ``radius`` of the low ``bits`` bits."""
    found = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return np.array(found, np.uint64)


def _variants(fps: DataFrame, blocks: int, radius: int) -> DataFrame:
    """(key, fp) for every variant of every fingerprint; the block number is kept apart by a bit above short keys."""
    width = BITS // blocks
    own = (radius // blocks + 1) // 2  # half of the radius that one of the blocks must keep to
    flips = masks(width, own)
    low = np.uint64((1 << width) - 1 if blocks > 1 else 0xFFFFFFFFFFFFFFFF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), max(1, CHUNK // len(flips))):
                piece = fp[at : at + max(1, CHUNK // len(flips))]
                for k in range(blocks):
                    part = (piece.view(np.uint64) >> np.uint64(k * width)) & low
                    keys = (part[:, None] ^ flips[None, :]).ravel()
                    if blocks > 1:
                        keys |= np.uint64(k << width)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(piece, len(flips)))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among different fingerprints, by breadth-first search: O(n) memory."""
    left = fps.view(np.uint64).copy()
    a, b = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                hit = left[near]
                a.append(np.full(len(hit), at))
                b.append(hit)
                queue.extend(hit)
                left = left[~near]
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def _long_runs(key: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of two or more, and of the first and the last, which neighbouring batches may continue."""
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
    keep = ends - starts > 1
    keep[0] = keep[-1] = True
    return zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)


def _edges_in_variants(variants: DataFrame, radius: int, dense: int) -> DataFrame:
    """(a, b, dense): links found in the variants; for a variant over ``dense`` only its members, as a = b rows."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, bool]]:
        """The fingerprints of each key that two or more hold, and whether the key is dense.

        A run may go on into the next batch. It is held up to ``dense`` fingerprints; beyond that its rows stream out.
        """
        open_key, held, n = None, [], 0
        for b in batches:
            key, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
            if not len(key):
                continue
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True) if len(cuts) < 64 else _long_runs(key, cuts):
                if key[start] != open_key:
                    if 1 < n <= dense:
                        yield np.concatenate(held), False
                    open_key, held, n = key[start], [], 0
                if n <= dense:
                    held.append(fp[start:end].copy())
                    n += end - start
                    if n > dense:
                        yield np.concatenate(held), True
                        held = []
                else:
                    yield fp[start:end], True
        if 1 < n <= dense:
            yield np.concatenate(held), False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # variants repeat each other's edges; cleared when full
        for g, flag in groups(batches):
            a, b = (g, g) if flag else forest(g, radius)
            pairs = [p for p in zip(a.tolist(), b.tolist(), strict=True) if p not in seen]
            if len(seen) > 200_000:
                seen.clear()
            seen.update(pairs)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.array([flag] * len(pairs), pa.bool_())], names=["a", "b", "dense"])

    runs = variants.repartition("key").sortWithinPartitions("key", "fp")
    return runs.mapInArrow(run, "a long, b long, dense boolean")


def links(fps: DataFrame, radius: int = 4, blocks: int = 2, dense: int = 4096) -> DataFrame:
    """(a, b): links that connect whatever fingerprints within the radius connect. ``fps``: different values of fp."""
    found = cut(_edges_in_variants(_variants(fps, blocks, radius), radius, dense).distinct())
    edges = found.where("not dense").select("a", "b")
    crowded = found.where("dense").select(F.col("a").alias("fp")).distinct()
    if crowded.isEmpty():
        return edges
    stars = _variants(crowded, 1, radius)
    least = stars.groupBy("key").agg(F.min("fp").alias("__least"), F.max("fp").alias("__most")).where("__least < __most").select(unaligned(F.col("key")).alias("__k"), "__least")
    star_edges = stars.join(least, F.col("key") == F.col("__k")).where("fp > __least").select(F.col("__least").alias("a"), F.col("fp").alias("b"))
    return edges.unionByName(star_edges.distinct())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", write: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Alternates large and small stars: each round hangs the larger (then the smaller) neighbours of every node on its
    smallest neighbour, until nothing changes. Rounds grow with the logarithm of the longest path. Each round is
    written to the checkpoint folder (``write``). Hubs are aggregated on the map side, and the join back to them has an exchange
    on both sides, so that AQE can split a hub.
    """
    flat = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    state, before = write(flat), None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("__m")), larger=True)
        small = write(_hang(large, large.groupBy("u").agg(F.min("v").alias("__m")), larger=False))
        row = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if row == before:
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state, before = small, row


def _hang(pairs: DataFrame, least: DataFrame, larger: bool) -> DataFrame:
    m = least.select(unaligned(F.col("u")).alias("__u"), "__m")
    joined = pairs.join(m, F.col("u") == F.col("__u"))
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("__m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("__m").alias("v")), F.struct(F.col("v").alias("u"), F.col("__m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def components(prints: DataFrame, radius: int = 4, blocks: int = 2, dense: int = 4096) -> DataFrame:
    """``prints`` (doc_id, fp, ...) with component_id, the smallest doc_id that links reach, and component_fp."""
    return grouped(prints, lambda by_fp: links(by_fp, radius, blocks, dense))


def grouped(prints: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``prints`` with the components of the links (a, b) that ``link`` finds among the different values of fp."""
    by_fp = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("__first")))
    roots = connected_components(link(by_fp))
    linked = by_fp.join(roots, by_fp["fp"] == roots["node"]).select("fp", "root", "__first")
    firsts = linked.groupBy("root").agg(F.min("__first").alias("__id"))
    of = linked.join(firsts.withColumnRenamed("root", "__root"), F.col("root") == F.col("__root")).select(F.col("fp").alias("__f"), F.col("root").alias("__rt"), "__id")
    told = by_fp.join(of, F.col("fp") == F.col("__f"), "left").select(
        unaligned(F.col("fp")).alias("__fp"), F.when(F.col("__f").isNull(), F.col("__first")).otherwise(F.col("__id")).alias("component_id"), F.coalesce("__rt", "fp").alias("component_fp")
    )
    return prints.join(told, F.col("fp") == F.col("__fp")).drop("__fp")


def near_dedup(docs: DataFrame, radius: int = 4, blocks: int = 2, dense: int = 4096, width: int = 4) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id (nulls last, ties by text hash).

    Rows equal in doc_id and text count as one document.
    """
    prints = cut(with_fingerprints(docs, width=width))
    return one_of_each(docs, components(prints, radius, blocks, dense))


KEY = ["__no", "__id", "__hash"]


def _key(doc_id: Column, text_hash: Column) -> dict[str, Column]:
    return {"__no": doc_id.isNull(), "__id": F.coalesce(doc_id.cast("long"), F.lit(0)), "__hash": text_hash}


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component in ``groups`` (doc_id, text_hash, component_fp).

    Two bitmaps of fixed size tell most rows without a shuffle of their texts: a row whose slot no kept key has goes, one whose
    slot only kept keys have that stand once stays. The others (repeated rows and false alarms, all rows of a corpus that
    fills the bitmaps) are joined with the kept keys.
    """
    rows = cut(groups.select(F.col("component_fp").alias("c"), *(v.alias(k) for k, v in _key(F.col("doc_id"), F.col("text_hash")).items())))
    least = rows.groupBy("c").agg(F.min(F.struct(*KEY)).alias("__k")).select(unaligned(F.col("c")).alias("__c"), "__k")
    told = rows.groupBy("c", *KEY).agg((F.count("*") > 1).alias("more")).join(least, F.col("c") == F.col("__c"))
    told = cut(told.select(*KEY, "more", (F.struct(*KEY) == F.col("__k")).alias("stays")))
    bits = cut(bitmap(told, KEY, __kept=F.col("stays"), __asked=~F.col("stays") | F.col("more")))
    marked = with_bits(docs.withColumns(_key(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))))), KEY, bits).where("__kept")
    joined = marked.where("__asked").join(told.where("stays").select(*KEY), KEY, "left_semi")
    first = joined.withColumn("__n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(0)))).where("__n = 1")
    return marked.where("not __asked").select(*docs.columns).union(first.select(*docs.columns))


# --- links by similarity -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Similar:
    similarity: float = 0.8  #: least Jaccard similarity of the sets of word shingles
    width: int = 5
    words: int = 3  #: of 64 bits in a fingerprint
    block_bits: int = 24  #: whole bytes
    near: int = 42  #: bits of a fingerprint; 29 +- 5 differ at a similarity of 0.8
    piece: int = 1 << 18  #: pairs of one key that are compared at a time
    tile_rows: int = 512  #: texts of a block of a crowd, on average
    tile_chars: int = 1 << 23  #: characters of a block, on average


def _block_variants(nodes: DataFrame, p: Similar, own: int = 1) -> DataFrame:
    """(key, f0, f1, ..., label): all variants within ``own`` bits of every block of every fingerprint."""
    flips, step, names = masks(p.block_bits, own), p.block_bits // 8, [f"f{w}" for w in range(p.words)]
    blocks = p.words * 8 // step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, label = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1), b.column("label")
            for at in range(0, len(whole), 4096):
                f = np.ascontiguousarray(whole[at : at + 4096])
                raw = f.view(np.uint8).reshape(len(f), -1).astype(np.uint64)
                for k in range(blocks):
                    part = sum(raw[:, k * step + i] << np.uint64(8 * i) for i in range(step))
                    keys = (part[:, None] ^ flips[None, :]).ravel() | np.uint64(k << p.block_bits)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(np.repeat(f[:, w], len(flips))) for w in range(p.words)), label.slice(at, 4096).take(pa.array(np.repeat(np.arange(len(f)), len(flips))))], names=["key", *names, "label"])

    return nodes.select(*names, "label").mapInArrow(run, ", ".join(["key long", *(f"{n} long" for n in names), "label long"]))


def _star_links(nodes: DataFrame, p: Similar) -> DataFrame:
    """(a, b): for every node that shares a whole block with a smaller one and is near the smallest such node of the block, the smallest of those."""
    step, names = p.block_bits // 8, [f"f{w}" for w in range(p.words)]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.ascontiguousarray(np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1))
            raw = f.view(np.uint8).reshape(len(f), -1).astype(np.uint64)
            for k in range(p.words * 8 // step):
                key = sum(raw[:, k * step + i] << np.uint64(8 * i) for i in range(step)) | np.uint64(k << p.block_bits)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(f[:, w]) for w in range(p.words))], names=["key", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, first = None, None
        for b in batches:
            if not b.num_rows:
                continue
            key, f = b.column("key").to_numpy(zero_copy_only=False), np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            hubs = f[np.repeat(starts, np.diff(np.append(starts, len(key))))]
            if key[0] == open_key:
                hubs[key == open_key] = first
            open_key, first = key[-1], hubs[-1].copy()
            hit = (np.bitwise_count(f.view(np.uint64) ^ hubs.view(np.uint64)).sum(axis=1) <= p.near) & (f != hubs).any(axis=1)
            yield pa.RecordBatch.from_arrays([*(pa.array(f[hit, w]) for w in range(p.words)), *(pa.array(hubs[hit, w]) for w in range(p.words))], names=["a" + n for n in names] + ["b" + n for n in names])

    keys = nodes.select(*names).mapInArrow(blocks, ", ".join(["key long", *(f"{n} long" for n in names)]))
    found = keys.repartition("key").sortWithinPartitions("key", *names).mapInArrow(run, ", ".join(f"{x}{n} long" for x in "ab" for n in names))
    hub = F.min(F.struct(*(f"b{n}" for n in names)))
    stars = found.groupBy(*(f"a{n}" for n in names)).agg(hub.alias("hub"))
    return stars.select(F.xxhash64(*(f"a{n}" for n in names)).alias("a"), F.xxhash64(*(f"hub.b{n}" for n in names)).alias("b"))


def near_rows(f: np.ndarray, near: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j) that connect the rows of ``f`` that differ in at most ``near`` bits, where equal labels don't already; and a row of each tree."""
    left, a, b, roots = np.arange(len(f)), [], [], []
    while len(left):
        roots.append(left[0])
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            same = label[left] == label[at]
            hit = same | (np.bitwise_count(f[left] ^ f[at]).sum(axis=1) <= near)
            if hit.any():
                new = left[hit & ~same]
                new = new[np.unique(label[new], return_index=True)[1]]
                a.append(np.full(len(new), at))
                b.append(new)
                queue.extend(left[hit])
                left = left[~hit]
    return *(np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b)), np.array(roots, np.int64)


def run_links(key: np.ndarray, f: np.ndarray, near: int, label: np.ndarray, few: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of different labels that connect, among rows of equal keys (which stand together), what differs in at most ``near`` bits.

    Up to ``few`` rows, that is every such pair but the ones whose labels an earlier pair has already brought together.
    """
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    a, b = [], []
    for size in range(2, few + 1):
        first = starts[sizes == size]
        same = {(i, j): label[first + i] == label[first + j] for i in range(size) for j in range(size)}
        hits = {(i, j): ~same[i, j] & (np.bitwise_count(f[first + i] ^ f[first + j]).sum(axis=1) <= near) for i, j in combinations(range(size), 2)}
        for n, (i, j) in enumerate(hits):
            needed = hits[i, j].copy()
            for k, m in list(hits)[:n]:
                needed &= ~(hits[k, m] & (same[k, i] & same[m, j] | same[k, j] & same[m, i]))
            a.append(first[needed] + i)
            b.append(first[needed] + j)
    for at, size in zip(starts[sizes > few].tolist(), sizes[sizes > few].tolist(), strict=True):
        i, j, _ = near_rows(f[at : at + size], near, label[at : at + size])
        a.append(at + i)
        b.append(at + j)
    return np.concatenate(a), np.concatenate(b)


def own_label(f: np.ndarray) -> np.ndarray:
    """A label for a fingerprint that is linked to nothing; such rows travel without one."""
    mixed = np.zeros(len(f), np.uint64)
    for w in range(f.shape[1]):
        mixed = rehash(mixed ^ f[:, w], w + 1)
    return mixed.view(np.int64)


def all_links(key: np.ndarray, f: np.ndarray, near: int, label: np.ndarray, piece: int, short: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every (i, j) of different labels among rows of equal keys (which stand together) that differ in at most ``near`` bits, in pieces.

    Runs of up to ``short`` rows go all at once, by the distance of i and j. In a longer run the rows of its most frequent label are not
    compared with each other, so a group of near copies that is linked already costs its size times the other rows.
    """
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    i, end, d = np.arange(len(key)), np.repeat(starts + sizes, sizes), 1
    i = i[np.repeat(sizes <= short, sizes)]
    while len(i := i[i + d < end[i]]):
        other = i[label[i] != label[i + d]]
        hit = other[np.bitwise_count(f[other] ^ f[other + d]).sum(axis=1) <= near]
        yield hit, hit + d
        d += 1
    for at, size in zip(starts[sizes > short].tolist(), sizes[sizes > short].tolist(), strict=True):
        _, group, often = np.unique(label[at : at + size], return_inverse=True, return_counts=True)
        if len(often) == 1:
            continue
        order = np.argsort(np.argsort(-often, kind="stable")[group], kind="stable")  # the most frequent label first
        g, group = f[at + order], group[order]
        step = max(1, piece // size)
        for n in range(int(often.max()), size, step):
            rows = np.arange(n, min(n + step, size))
            hit = (np.bitwise_count(g[rows][:, None] ^ g[None, : rows[-1]]).sum(axis=2) <= near) & (group[rows][:, None] != group[None, : rows[-1]]) & (np.arange(rows[-1])[None, :] < rows[:, None])
            b, a = np.nonzero(hit)
            yield at + order[a], at + order[rows[b]]


def _candidate_links(variants: DataFrame, p: Similar, every: bool = False) -> DataFrame:
    """(a, b): hashes of fingerprints of different labels that meet at a key and are near: what connects them, or ``every`` such pair.

    The rows of a key may go on over batches: they are held, 40 bytes each, until the key ends.
    """
    names = [f"f{w}" for w in range(p.words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, label, f):
            for i, j in all_links(key, f, p.near, label, p.piece) if every else [run_links(key, f, p.near, label)]:
                if len(i):
                    yield pa.RecordBatch.from_arrays([*(pa.array(f[i, w].view(np.int64)) for w in range(p.words)), *(pa.array(f[j, w].view(np.int64)) for w in range(p.words))], names=["a" + n for n in names] + ["b" + n for n in names])

        held = []
        for b in batches:
            if not b.num_rows:
                continue
            f = np.stack([b.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names], axis=1)
            known = b.column("label").is_valid().to_numpy(zero_copy_only=False)
            label = np.where(known, b.column("label").fill_null(0).to_numpy(zero_copy_only=False), own_label(f))
            key = b.column("key").to_numpy(zero_copy_only=False)
            held.append((key, label, f))
            if held[0][0][-1] == key[-1]:
                continue
            key, label, f = map(np.concatenate, zip(*held, strict=True))
            last = int(np.searchsorted(key, key[-1]))
            yield from out(key[:last], label[:last], f[:last])
            held = [(key[last:].copy(), label[last:].copy(), f[last:].copy())]
        if held:
            yield from out(*map(np.concatenate, zip(*held, strict=True)))

    ends = [f"{x}{n}" for x in "ab" for n in names]
    # In the order of the fingerprints, the runs of a group of near copies begin with the same few of them.
    found = variants.repartition("key").sortWithinPartitions("key", "f0").mapInArrow(run, ", ".join(f"{n} long" for n in ends))
    pairs = found.select(*(F.xxhash64(*(f"{x}{n}" for n in names)).alias(x) for x in "ab"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similarity(a: str | None, b: str | None, width: int) -> float:
    """Jaccard similarity of the sets of word shingles; two texts without words are equal."""
    x, y = (np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(t, width)])) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _similar_pairs(pairs: DataFrame, texts: DataFrame, p: Similar) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose ``texts`` (node, text) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [similarity(x.as_py(), y.as_py(), p.width) >= p.similarity for x, y in zip(b.column("ta"), b.column("tb"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    of = lambda x: texts.select(unaligned(F.col("node")).alias(f"__{x}"), F.col("text").alias(f"t{x}"))
    both = pairs.join(of("a"), F.col("a") == F.col("__a")).join(of("b"), F.col("b") == F.col("__b"))
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _texts_of(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> tuple[DataFrame, str]:
    """(node, text) of the different nodes in ``asked`` (node), and the path of that table. A bitmap keeps most other texts out of the shuffle."""
    wanted = asked.join(nodes.select(F.col("fp").alias("__f"), "k"), F.col("node") == F.col("__f"))
    wanted = cut(wanted.select("node", *(v.alias(k) for k, v in _key(F.col("k.doc_id"), F.col("k.text_hash")).items())))
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(_key(F.col("doc_id"), F.xxhash64("text"))).drop("doc_id")
    held = with_bits(held, KEY, bitmap(wanted, KEY, __asked=F.lit(True))).where("__asked")
    return put(held.join(wanted, KEY).dropDuplicates(KEY).select("node", "text"))


def _checked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, p: Similar) -> DataFrame:
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts, path = _texts_of(docs, nodes, asked)
    good = cut(_similar_pairs(pairs, texts, p))
    remove(docs.sparkSession, path)
    return good


def alike(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, least: float, columns: int = 4096) -> np.ndarray:
    """Whether ``sets[x[i]]`` and ``sets[y[j]]``, of different values each, have a Jaccard similarity of ``least``: a matrix of i and j."""
    n = np.array([len(s) for s in sets], np.int64)
    _, value, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often[value] > 1)
    shared = shared[np.argsort(value[shared], kind="stable")]
    owner, value = np.repeat(np.arange(len(sets)), n)[shared], np.unique(value[shared], return_inverse=True)[1]
    both = np.zeros((len(x), len(y)), np.int64)
    for first in range(0, int(value[-1]) + 1 if len(value) else 0, columns):
        at, end = np.searchsorted(value, (first, first + columns))
        has = np.zeros((len(sets), columns), np.float32)  # counts up to ``columns`` are exact
        has[owner[at:end], value[at:end] - first] = 1
        both += (has[x] @ has[y].T).astype(np.int64)
    either = n[x][:, None] + n[y][None, :] - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0) >= least


def tile_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """(i, j): a spanning forest of the similar pairs of a set of ``left`` and one of ``right`` (rows of ``sets``, in both or in one)."""
    hit = np.zeros((len(sets), len(sets)), bool)
    hit[np.ix_(left, right)] = alike(sets, left, right, least)
    hit |= hit.T
    rest, a, b = np.ones(len(sets), bool), [], []
    for root in range(len(sets)):
        queue = [root] if rest[root] else []
        rest[root] = False
        while queue:
            at = queue.pop()
            new = np.flatnonzero(hit[at] & rest)
            rest[new] = False
            a += [at] * len(new)
            b += new.tolist()
            queue += new.tolist()
    return a, b


def _links_in_tiles(rows: DataFrame, p: Similar) -> DataFrame:
    """(a, b): links among the texts of each tile. ``rows``: crowd, the tile's blocks i and j, the row's block, fp, text."""

    def out(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held)
        fp, block, i, j = (t.column(c).to_numpy() for c in ("fp", "block", "i", "j"))
        sets = [np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(x.as_py(), p.width)])) for x in t.column("text")]
        a, b = tile_links(sets, np.flatnonzero(block == i), np.flatnonzero(block == j), p.similarity)
        return fp[a], fp[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for b in batches:
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("crowd", "i", "j")], axis=1)
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))) if len(key) else []
            found = []
            for at, end in zip(starts, [*starts[1:], len(key)], strict=True) if len(key) else []:
                if tile != (tile := tuple(key[at].tolist())) and held:
                    found.append(out(held))
                    held = []
                held.append(b.slice(at, end - at))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out(held)], names=["a", "b"])

    tiles = rows.select("crowd", "i", "j", "block", "fp", "text").repartition("crowd", "i", "j").sortWithinPartitions("crowd", "i", "j")
    return tiles.mapInArrow(run, "a long, b long").distinct()


def _tabled(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a table: a checkpoint keeps constraints and estimated sizes, which are products of products after several searches for components."""
    return put(df)[0]


def _crowd_links(docs: DataFrame, nodes: DataFrame, near: DataFrame, linked: DataFrame, p: Similar) -> DataFrame:
    """(a, b): links that connect all similar texts of each component of ``near`` (a, b) which ``linked`` does not make one component."""
    crowds, roots = connected_components(near, write=_tabled), connected_components(linked, write=_tabled).withColumnRenamed("node", "__n")
    members = crowds.join(roots.select("__n", F.col("root").alias("label")), F.col("node") == F.col("__n"), "left").select("node", F.col("root").alias("crowd"), F.coalesce("label", "node").alias("label"))
    open_ = members.groupBy("crowd").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(unaligned(F.col("crowd")).alias("__c"))
    members, members_path = put(members.join(open_, F.col("crowd") == F.col("__c"), "left_semi").select("node", "crowd"))
    if members.isEmpty():
        return members.select(F.col("node").alias("a"), F.col("crowd").alias("b"))
    texts, path = _texts_of(docs, nodes, members.select("node"))
    held = members.join(texts.select(unaligned(F.col("node")).alias("__n"), F.length("text").cast("long").alias("chars")), F.col("node") == F.col("__n")).select("node", "crowd", "chars")
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(p.tile_rows), F.sum("chars") / F.lit(p.tile_chars), F.lit(1.0))).alias("blocks")
    sizes = held.groupBy("crowd").agg(blocks).select(unaligned(F.col("crowd")).alias("__c"), "blocks")
    placed = members.join(sizes, F.col("crowd") == F.col("__c")).select("node", "crowd", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    tiles = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("node", "crowd", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = tiles.join(texts.select(unaligned(F.col("node")).alias("fp"), "text"), F.col("node") == F.col("fp"))
    links, _ = put(_links_in_tiles(rows, p))
    for done in (path, members_path):
        remove(docs.sparkSession, done)
    return links


def similar_links(docs: DataFrame, prints: DataFrame, p: Similar = Similar()) -> DataFrame:
    """(a, b): links between values of fp of a similarity of at least ``similarity``, by texts of the documents that the values stand for."""
    names = [f"f{w}" for w in range(p.words)]
    nodes = cut(prints.groupBy("fp", *names).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("k")))
    linked = _checked(docs, nodes, cut(_star_links(nodes, p)), p)
    whole = connected_components(_candidate_links(_block_variants(nodes.withColumn("label", F.lit(None).cast("long")), p, 0), p), write=_tabled)
    labelled = nodes.join(whole, F.col("fp") == F.col("node"), "left").select(*names, F.col("root").alias("label"))
    found = _tabled(_candidate_links(_block_variants(labelled, p), p))
    linked = linked.unionByName(_checked(docs, nodes, found, p))
    near = found.unionByName(whole.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return _tabled(linked.unionByName(_crowd_links(docs, nodes, near, linked, p)))


def near_dedup_similar(docs: DataFrame, p: Similar = Similar()) -> DataFrame:
    """Like ``near_dedup``, with links between texts of at least ``similarity``; rows of equal fingerprints are linked."""
    prints = cut(with_fingerprints(docs, width=p.width, words=p.words))
    return one_of_each(docs, grouped(prints, lambda _: similar_links(docs, prints, p)))
