"""SimHash, mixing, BPE, media, token counts, search and the pipeline against brute force."""

import functools
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from seguekit.llm import byte_bpe, common, media, mixing, queries, simhash, token_counts, topk_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = ["red", "Green", "blue", "ocean", "Étude", "sky", "tree", "stone", "river", "cloud", "sand", "wind"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def near_copies(seed=1, groups=12):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(300)]
        for c in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(c):
                w[rng.randrange(300)] = "edit"
            rows.append((g * 10 + c, " ".join(w), f"s{g % 4}"))
    return rows + [(900, None, None), (901, "", "s1"), (902, " \n", "s2"), (903, "one two", "s1"), (904, "ONE  two", "s1"), (905, "one", "s1"), (0, rows[0][1], "s0")]


# --- simhash -----------------------------------------------------------------------------------------------------


def brute_fp(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    f = [brute_fp(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for (i, _, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, i), i)
    return Counter((i, f"{x:016x}", least[r]) for (i, _, _), x, r in zip(rows, f, root, strict=True))


@pytest.mark.parametrize(("blocks", "dense"), [(2, 4096), (1, 4096), (2, 2)])
def test_simhash_components(spark, blocks, dense):
    rows = near_copies()
    prints = simhash.with_fingerprints(docs(spark, rows))
    got = simhash.components(prints, blocks=blocks, dense=dense).collect()
    assert Counter((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in got) == brute_components(rows)


def test_simhash_links_exactly_up_to_the_radius(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(200)]
    fps = set(base)
    for x in base:
        for d in (3, 4, 5, 6):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(63), d)))
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    assert all((e.a ^ e.b).bit_count() <= 4 for e in edges)

    def parts(pairs):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in fps}

    arr = np.array(fps, np.uint64)
    brute = [(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4)]
    assert parts((e.a, e.b) for e in edges) == parts(brute)


def test_near_dedup_keeps_one_of_each(spark):
    rows = near_copies()
    df = docs(spark, rows)
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(rows)})
    assert simhash.near_dedup(docs(spark, [])).collect() == []
    nulls = simhash.near_dedup(docs(spark, [(None, "a b", "s"), (None, "a b", "s"), (None, "c d", None)])).collect()
    assert sorted(r.text for r in nulls) == ["a b", "c d"]


@pytest.mark.parametrize("bits", [6, 26])
def test_one_of_each_with_a_full_bitmap_and_repeated_rows(spark, monkeypatch, bits):
    """With 64 slots nearly every row is a false alarm and goes by the exact join; the rows that stay are the same."""
    monkeypatch.setattr(common, "SLOT_BITS", bits)
    rows = [(i, f"text {i % 60}", "s") for i in range(300)] + [(7, "text 7", "other"), (7, "text 7", "s"), (None, "text 1", "s"), (None, "lone", None), (None, "lone", None), (None, None, "s"), (900, "", "s")]
    df = docs(spark, rows)
    same = df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("component_fp"))
    kept = simhash.one_of_each(df, same)
    assert kept.columns == df.columns
    want = [(i, f"text {i}") for i in range(60)] + [(None, "lone"), (900, "")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def shingled(t, width=5):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(x, y):
    a, b = shingled(x), shingled(y)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, base, share):
    return [w if rng.random() > share else f"edit{rng.randint(0, 9999)}" for w in base]


def kept_ids(spark, rows, p):
    return sorted(r.doc_id for r in simhash.near_dedup_similar(docs(spark, rows), p).collect())


def brute_kept(rows):
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    least = {}
    for (i, _, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, i), i)
    return sorted(least.values())


@pytest.mark.parametrize("piece", [4096, 3])
def test_near_dedup_by_similarity(spark, piece):
    rng, rows = random.Random(12), []
    for g in range(14):
        base = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(400)]
        share = 0.004 if g < 10 else 0.09  # similarities of some 0.95, and of some 0.3
        rows += [(g * 20 + c, " ".join(edited(rng, base, share) if c else base), f"s{g % 4}") for c in range(rng.randint(1, 8))]
    chain = [f"w{i}" for i in range(300)]
    rows += [(300 + i, " ".join(chain[10 * i : 10 * i + 200]), "s") for i in range(8)]  # neighbours: 186 of 206 shingles, ends: 126 of 266
    rows += [(400, None, None), (401, "", "s1"), (402, " \n", "s2"), (403, "one two", "s1"), (404, "ONE  two", "s1"), (405, "one", "s1"), (406, "long text " * 30_000, "s")]
    assert kept_ids(spark, rows, simhash.Similar(piece=piece)) == brute_kept(rows)
    assert simhash.near_dedup_similar(docs(spark, [])).collect() == []
    nulls = simhash.near_dedup_similar(docs(spark, [(None, "a b", "s"), (None, "a b", "s"), (None, "c d", None)])).collect()
    assert sorted(r.text for r in nulls) == ["a b", "c d"]


def test_near_dedup_by_similarity_finds_nine_of_ten_and_nothing_below(spark):
    rng, rows, close = random.Random(13), [], 0
    for g in range(300):
        base = [rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(250)]
        other = edited(rng, base, rng.choice([0.01, 0.015, 0.02, 0.03, 0.04]))
        close += jaccard(" ".join(base), " ".join(other)) >= 0.8
        rows += [(2 * g, " ".join(base), "s"), (2 * g + 1, " ".join(other), "s")]
    kept = set(kept_ids(spark, rows, simhash.Similar()))
    gone = [i for i, *_ in rows if i not in kept]
    assert all(jaccard(rows[i - 1][1], rows[i][1]) >= 0.8 for i in gone)
    assert len(gone) >= 0.9 * close and close > 100


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r.node: r.root for r in simhash.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_near_dedup_of_a_group_over_one_piece(spark, monkeypatch):
    """5,000 copies with one word of 120 replaced and 40 texts of their own: one of the group stays, and the search writes under five links a member."""
    rng, counts = random.Random(14), []
    base = [rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(120)]
    rows = [(0, " ".join(base), "s")]
    for i in range(1, 5001):
        copy = list(base)
        copy[rng.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(copy), "s"))
    rows += [(6000 + i, " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(100)), "s") for i in range(40)]
    similar = simhash._similar_pairs
    monkeypatch.setattr(simhash, "_similar_pairs", lambda pairs, *more: (counts.append(pairs.count()), similar(pairs, *more))[1])
    kept = kept_ids(spark, rows, simhash.Similar())
    assert len([i for i in kept if i < 6000]) <= 5 and sum(i >= 6000 for i in kept) == 40
    assert len(counts) == 2 and counts[0] <= 5000 and counts[1] < 25_000


def test_run_links_reach_every_pair_of_labels():
    """Up to six rows of a key, all near pairs of different labels are joined by the links and the labels."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(2, 7))
        f = rng.integers(0, 1 << 40, (1, 3), dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 40, (n, 3), dtype=np.uint64))
        label = rng.integers(0, 3, n)
        i, j = simhash.run_links(np.zeros(n, np.int64), f, 4, label)
        assert (label[i] != label[j]).all()
        linked = {frozenset((label[a], label[b])) for a, b in zip(i, j, strict=True)}
        near = {frozenset((label[a], label[b])) for a in range(n) for b in range(a) if label[a] != label[b] and np.bitwise_count(f[a] ^ f[b]).sum() <= 4}
        assert linked == near and len(i) == len(linked)


# --- mixing ------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    w = {k: weights[i % 3] for i, k in enumerate(order)}
    out, free, rest = {}, set(order), share * sum(sizes.values())
    while free:
        level = rest / sum(w[k] for k in free)
        over = [k for k in free if w[k] * level > cap * sizes[k]]
        if not over:
            return out | {k: w[k] * level for k in free}
        for k in over:
            out[k] = cap * sizes[k]
            rest -= out[k]
            free.discard(k)
    return out


def test_mixing_targets_and_takes(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 80))), rng.choice(["a", "b", "c", "d", "é", "z", None])) for i in range(400)]
    rows += [(1000 + i, "x " * 50, "hot") for i in range(300)] + [(5, None, "void"), (6, None, "void"), rows[0]]
    got = mixing.mix(docs(spark, rows), mixing.MixPlan(rows_per_slice=40, slices_per_group=3)).collect()
    sizes, size = Counter(), {}
    for i, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        size.setdefault(i, []).append((n, s))
    targets = brute_targets(dict(sizes))
    taken = Counter()
    source = {i: s for i, _, s in rows}
    assert len(got) == len(rows)
    for r in got:
        s = "void" if r.doc_id in (5, 6) and r.source_size == 0 else source[r.doc_id] if r.doc_id not in (5, 6) else rows[r.doc_id][2]
        assert r.source_size == sizes[s] and math.isclose(r.target, targets[s], abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r["size"] and (r.position is None) == (r.taken == 0)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) < 1
    again = mixing.mix(docs(spark, rows).repartition(7), mixing.MixPlan(rows_per_slice=40)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(docs(spark, [])).collect() == []


def test_demand_time_inverts_the_schedule(spark):
    df = spark.createDataFrame([(q / 10, a, b) for q in range(11) for a, b in ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))], "q double, a double, b double")
    for r in df.withColumn("u", mixing.demand_time(F.col("q"), F.col("a"), F.col("b"))).collect():
        assert 0 <= r.u <= 1 + 1e-12
        assert math.isclose((r.a * r.u + (r.b - r.a) * r.u**2 / 2) / ((r.a + r.b) / 2), r.q, abs_tol=1e-9)


def test_mixed_documents_repeat_whole_texts(spark):
    rows = [(i, "w " * (10 + i % 7), f"s{i % 3}") for i in range(300)]
    df = docs(spark, rows)
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    times = Counter(r.doc_id for r in got.collect())
    plan = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert all(abs(times[i] - r.taken / r["size"]) <= 0.5 for i, r in plan.items()) and max(times.values()) <= 2


# --- BPE and token counts ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.load(PATH, PATTERN)


@pytest.fixture(scope="module")
def reference(bpe):
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


TEXTS = ["", " ", "  a", "a  b \n c", "don't STOP", "文字 😀👩‍👩‍👧 é", "x" * 3000, "\r\n\t\u0085　y", "a\x1c b", " lead", "trail ", "١٢٣ ½ ___---===", "\n \n"]


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.lists(st.sampled_from([*TEXTS, "word", " ", "\n"]), max_size=12).map("".join)))
def test_bpe_equals_plain_ranks(text, bpe, reference):
    ids = np.frombuffer(next(iter(bpe.encode_batch([text]))), "<u4").tolist()
    assert ids == reference.encode_ordinary(text)
    assert bpe.decode(ids) == text
    spans = bpe.offsets(ids)
    assert (spans[-1][1] if spans else 0) == len(text) and all(a <= b for a, b in spans)


def test_bpe_over_a_table(spark, reference):
    texts = [*TEXTS, None, "The quick " * 20_000, TEXTS[4]]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for r in byte_bpe.round_trip(df, PATH, PATTERN).collect():
        t = texts[r.doc_id] or ""
        ids = np.array(reference.encode_ordinary(t), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert byte_bpe.encode(docs(spark, []), PATH, PATTERN, offsets=True).collect() == []
    one = byte_bpe.encode(docs(spark, [(1, "é😀", "s")]), PATH, PATTERN, offsets=True).collect()[0]
    assert one.ids == reference.encode_ordinary("é😀") and one.offsets[-1].end == 2


def test_bpe_table_begins_anew(monkeypatch, reference):
    monkeypatch.setattr(byte_bpe, "SEEN_PIECES", 3)
    own = byte_bpe.ByteBpe(PATH, PATTERN)
    texts = ["a b c d e f", "a b", "g h i j", "a b c"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(texts, at_once=2)] == [reference.encode_ordinary(t) for t in texts]


def brute_unigram(word, scores):
    best = [(0, 0)] + [None] * len(word)
    for i in range(1, len(word) + 1):
        found = [(best[j][0] + scores[word[j:i]], best[j][1] - 1) for j in range(i) if word[j:i] in scores]
        best[i] = max(found)
    return -best[-1][1], best[-1][0]


def test_token_counts(spark, bpe):
    counter = token_counts.TrieCounter(token_counts.zipf_scores(bpe.ranks), PATTERN)
    words = {w.encode() for t in TEXTS[:6] + WORDS + ["reader reading reads read", "unbelievable"] for w in bpe._pattern.findall(t)}
    assert counter.terminals(words) == {w: brute_unigram(w, counter.scores) for w in words}
    texts = [*TEXTS, None, "reader " * 500]
    got = token_counts.token_counts(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), PATH, PATTERN).collect()
    for r in got:
        ends = [brute_unigram(w.encode(), counter.scores) for w in bpe._pattern.findall(texts[r.doc_id] or "")]
        assert (r.n_pretokens, r.n_tokens) == (len(ends), sum(e[0] for e in ends)) and math.isclose(r.score, sum(e[1] for e in ends) / 1e6)
    assert token_counts.token_counts(docs(spark, []), PATH, PATTERN).collect() == []


# --- media -------------------------------------------------------------------------------------------------------


def test_media_decoders():
    x = np.random.default_rng(1).integers(0, 256, (5, 7, 3), np.uint8)
    assert (media.decode(media.encode_ppm(x)) == x).all() and (media.decode(media.encode_bmp(x)) == x).all()
    assert media.decode(b"P2 # c\n2 2\n3\n0 1\n2 3\n")[:, :, 0].tolist() == [[0, 85], [170, 255]]
    assert media.decode(b"P1\n3 1\n101")[0, :, 0].tolist() == [0, 1, 0] or media.decode(b"P1\n3 1\n101")[0, :, 0].tolist() == [0, 255, 0]
    assert media.decode(b"P4\n3 1\n\xa0").shape == (1, 3, 1)
    assert media.decode(b"P3 1 1 255 1 2 3")[0, 0].tolist() == [1, 2, 3]


def test_area_resize_is_the_mean_over_areas():
    x = np.random.default_rng(2).random((6, 10))
    up = np.kron(x, np.ones((4, 9)))  # 24 x 90 fine cells: exact for 4 x 9 targets
    want = up.reshape(4, 6, 9, 10).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(x, 4, 9), want)
    assert np.allclose(media.area_resize(x, 6, 10), x)


def test_media_tables(spark):
    x = np.arange(8 * 9 * 3, dtype=np.uint8).reshape(8, 9, 3)
    df = spark.createDataFrame([(1, media.encode_bmp(x)), (2, None), (3, b"junk"), (4, b"P5 1000 1000 255 x")], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.tiles(df).collect()}
    assert np.load(io.BytesIO(got[1].tile)).shape == (8, 9) and got[1].dhash == "ff" * 8
    assert got[2].error == "null" and got[3].tile is None and got[4].tile is None
    texts = [None, "", "a" * 192, "é" * 97, "long " * 50_000]
    for r in media.text_media(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect():
        b = (texts[r.doc_id] or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert media.text_media(docs(spark, [])).collect() == []


# --- search ------------------------------------------------------------------------------------------------------


def brute_search(rows, asks, p):
    """Rows are documents of their own; rows of one id ask together."""
    held = [(i, Counter(topk_search.terms_of(t))) for i, t, _ in rows if i is not None]
    df = Counter(w for _, c in held for w in c)
    mean = max(sum(sum(c.values()) for _, c in held), 1) / max(len(held), 1)
    asked = {}
    for i, c in held:
        if asks(i):
            asked.setdefault(i, set()).update(c)
    out = []
    for q, terms in asked.items():
        found = []
        for i, c in held:
            s = 0
            for w in terms & c.keys():
                idf = math.log1p((len(held) - df[w] + 0.5) / (df[w] + 0.5))
                s += math.floor(idf * (c[w] * (p.k1 + 1)) / (c[w] + p.k1 * (1 - p.b + p.b * sum(c.values()) / mean)) * 1e6 + 0.5)
            found += [(-s, i)] * (s > 0)
        out += [(q, n + 1, i, -s / 1e6) for n, (s, i) in enumerate(sorted(found)[: p.k])]
    return sorted(out)


def searched(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


PLANS = [topk_search.Bm25(k=3, block=2, shards=5), topk_search.Bm25(k=5, block=16, shards=2, pass_terms=400, queries_at_once=3), topk_search.Bm25(k=300, dense=0.0, shards=3), topk_search.Bm25(dense=2.0, block=64, shards=3)]


@pytest.mark.parametrize("plan", PLANS)
def test_search_equals_brute_force(spark, plan):
    rng = random.Random(6)
    pool = [f"t{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 40))), "s") for i in range(200)]
    rows += [(300 + i, "same words here t1", "s") for i in range(30)] + [(400, None, "s"), (401, "", "s"), (None, "t1 t2", "s"), (402, "only_here", "s"), (410, "held by no other text", None)]
    rows += [rows[10], (20, "a second text of one id t1 t2", "s"), (420, "long t3 " * 30_000, "s")]
    got = topk_search.search(docs(spark, rows), F.col("doc_id") % 10 == 0, plan, alike=F.col("source"))
    assert got.columns == ["query_id", "rank", "doc_id", "score"]
    assert searched(got) == brute_search(rows, lambda i: i % 10 == 0, plan)


def test_search_ignores_columns_of_its_own_names(spark):
    rows = [(i, f"word{i % 7} all {'x' * (i % 3)}", "s") for i in range(60)]
    df = docs(spark, rows).selectExpr("doc_id", "text", "'a' as terms", "1 as size", "true as asks", "2 as rank", "3.0 as score", "doc_id as query_id", "'z' as alike")
    assert searched(topk_search.search(df, F.col("doc_id") % 20 == 0)) == brute_search(rows, lambda i: i % 20 == 0, topk_search.Bm25())


def test_search_skips_blocks_but_stays_exact():
    rng = np.random.default_rng(3)
    n_terms, n_docs = 40, 4000
    held = [np.sort(rng.choice(n_terms // 2, 6, replace=False)) + (n_terms // 2) * (d >= n_docs // 2) for d in range(n_docs)]  # two vocabularies
    impacts = [rng.integers(1, 1000, 6) for _ in held]
    asked = [np.sort(rng.choice(n_terms // 2, 4, replace=False)) + (n_terms // 2) * (q % 2) for q in range(50)] + [np.array([0, n_terms - 1])]
    q, t = np.repeat(np.arange(51), [len(x) for x in asked]), np.concatenate(asked)
    for k in (1, 5, 50):
        ours = topk_search.Queries(51, q, t, n_terms, topk_search.Bm25(k=k, queries_at_once=7))
        for low in range(0, n_docs, 100):
            own = range(low, low + 100)
            ours.read(topk_search.Block(np.arange(low, low + 100), np.concatenate([held[d] for d in own]), np.repeat(np.arange(100), 6), np.concatenate([impacts[d] for d in own]).astype(float)))
        assert ours.skipped > ours.seen / 3
        for i, terms in enumerate(asked):
            total = sorted((-int(impacts[d][np.isin(held[d], terms)].sum()), d) for d in range(n_docs))[:k]
            got = [(-int(s), d) for s, d in zip(ours.best.scores[i], ours.best.ids[i].tolist(), strict=True) if s]
            assert got == [x for x in total if x[0]]


def test_search_leaves_out_blocks_whose_words_never_meet():
    """Eight words that two languages share: the block's largest impacts add up to the bar, but no document holds two of them."""
    own = [(np.arange(8), np.full(8, 1000.0)), (np.arange(8), np.full(8, 900.0))]
    q, t = np.repeat(np.arange(20), 8), np.tile(np.arange(8), 20)
    ours = topk_search.Queries(20, q, t, 9, topk_search.Bm25(k=2))
    ours.read(topk_search.Block(np.arange(2), np.concatenate([x for x, _ in own]), np.repeat([0, 1], 8), np.concatenate([x for _, x in own])))
    other = np.repeat(np.arange(8), 32)  # a document holds one of the eight
    ours.read(topk_search.Block(np.arange(2, 258), other, np.arange(256), np.full(256, 1000.0)))
    assert ours.skipped == 20 and ours.seen == 40
    assert ours.best.scores.tolist() == [[8000.0, 7200.0]] * 20 and ours.best.ids.tolist() == [[0, 1]] * 20


def test_search_sums_again_what_single_precision_cannot_tell():
    rng = np.random.default_rng(5)
    n_terms, n_docs, k = 300, 1500, 10
    base = rng.integers(1_000_000, 30_000_000, n_terms).astype(float)  # sums of 2 ** 32 and more: steps of single precision are hundreds
    impacts = base + rng.integers(0, 2, (n_docs, n_terms))
    impacts[::7] = 0  # some hold nothing
    doc, term = np.nonzero(impacts)
    q, t = np.repeat(np.arange(3), 250), np.concatenate([np.sort(rng.choice(n_terms, 250, replace=False)) for _ in range(3)])
    total = np.stack([impacts[:, t[q == i]].sum(axis=1) for i in range(3)])
    bars = np.sort(total, axis=1)[:, -k] - 3
    for plan in (topk_search.Bm25(k=k), topk_search.Bm25(k=k, dense=0.0), topk_search.Bm25(k=k, dense=2.0)):
        for floors in (None, bars):
            ours, low = topk_search.Queries(3, q, t, n_terms, plan, floors), topk_search.Queries(3, q, t, n_terms, plan, exact=False)
            for at in range(0, n_docs, 500):
                held = (doc >= at) & (doc < at + 500)
                block = topk_search.Block(np.arange(at, at + 500), term[held], doc[held] - at, impacts[doc[held], term[held]])
                ours.read(block)
                low.read(block)
            for i in range(3):
                best = sorted((-s, d) for d, s in enumerate(total[i]))[:k]
                assert [(-s, d) for s, d in zip(ours.best.scores[i], ours.best.ids[i].tolist(), strict=True)] == best
                assert 0.999 * -best[-1][0] < low.best.scores[i, -1] <= -best[-1][0]


def test_search_blocks_hold_one_kind_and_every_posting(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{int(rng.paretovariate(0.8))}" for _ in range(rng.randint(0, 300))), "ab"[i % 2]) for i in range(150)] + [(500, "w " * 40_000 + "x", "a"), (501, None, "b")]
    plan = topk_search.Bm25(block=16, shards=3)
    index = topk_search.term_index(docs(spark, rows), F.col("doc_id") % 20 == 0, F.col("source"), plan)
    found = {}
    for part in topk_search._block_rows(index).rdd.glom().collect():
        for ids, sizes, words, n, own, counts in topk_search._stored([pa.RecordBatch.from_pylist([r.asDict() for r in part], pa.schema([("piece", pa.binary()), ("last", pa.bool_())]))]):
            assert len(ids) <= 16 and (len(ids) == 1 or sizes.sum() <= 16 * 1024)
            assert len({rows[i][2] if i < 500 else "ab"[i - 500] for i in ids.tolist()}) == 1
            for w, d, c in zip(np.repeat(np.array(words, object), n), own.tolist(), counts.tolist(), strict=True):
                found.setdefault(int(ids[d]), Counter())[w] = c
    assert found == {i: Counter(topk_search.terms_of(t)) for i, t, _ in rows if topk_search.terms_of(t)}


def test_registered_search_asks_with_the_whole_text(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(f"t{rng.randint(0, 60)}" for _ in range(rng.randint(1, 60))), "s") for i in range(160)] + [(180, "held by no other text", "s")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert searched(queries.op10_topk_search(spark, str(tmp_path))) == brute_search(rows, lambda i: i % 20 == 0, topk_search.Bm25())


def test_search_empty(spark):
    assert topk_search.search(docs(spark, []), F.col("doc_id") % 20 == 0).collect() == []
    assert topk_search.search(docs(spark, [(20, None, "s"), (None, "a", "s")]), F.col("doc_id") % 20 == 0).collect() == []


# --- all registered queries --------------------------------------------------------------------------------------

CLASHES = ["score", "size", "taken", "target", "position", "fp", "text_hash", "component_id", "key", "node", "media", "feature", "n_tokens", "tokens", "terms", "rank", "query_id", "host", "lines_total", "lines_dropped", "base", "spans", "found", "toxic", "predicted", "held_out", "n", "id", "hash", "start", "end", "runs", "collapsed", "counts", "item_id", "term"]


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Two folders with the same rows, one with extra columns of clashing names; nulls, empty and long texts, repeated rows."""
    rng = random.Random(21)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))) + ("\nall rights" if i % 3 == 0 else ""), rng.choice(["a", "b", None])) for i in range(120)]
    rows += [(200, None, "a"), (220, "", "b"), (None, "red blue", "a"), (None, None, None), (240, "long river " * 20_000, "a"), rows[5], rows[5], (260, "token = abcdefghijklmnop", "b"), (3, "other text of id 3", "b")]
    pages = [(i, f"https://h{i % 3}.example/{i}" if i % 7 else None, f"<p>menu</p><p>{t}</p>" if t else t) for i, t, _ in rows if i is not None]
    labels = [(i, 0, int(i % 5 == 0)) for i in range(0, 120, 2)]
    turns = [(i // 4 if i % 9 else None, i % 4, "user" if i % 2 else None, t) for i, (_, t, _) in enumerate(rows)]
    out = []
    for extra in (False, True):
        sf = str(tmp_path_factory.mktemp("odd"))
        for name, df in {
            "documents": docs(spark, rows), "pages": spark.createDataFrame(pages, "page_id long, url string, html string"), "labels": spark.createDataFrame(labels, "doc_id long, quality long, toxic long"),
            "conversations": spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"),
            "benchmark": spark.createDataFrame([(1, "red blue"), (1, "Long,red"), (2, ""), (3, None), (None, "red")], "item_id long, text string"),
        }.items():
            more = {c: F.lit(f"own {c}") for c in CLASHES if c not in df.columns} if extra else {}
            df.withColumns(more).write.parquet(f"{sf}/{name}.parquet")
        out.append(sf)
    return out


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.startswith("op")])
def test_queries_ignore_other_columns_and_stand_odd_rows(spark, odd_tables, name):
    plain, extra = (queries.QUERIES[name](spark, sf) for sf in odd_tables)
    assert plain.columns == extra.columns and len(set(plain.columns)) == len(plain.columns)
    a, b = (Counter(map(repr, df.collect())) for df in (plain, extra))
    assert a == b and a


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.startswith("op")])
def test_queries_stand_empty_tables(spark, odd_tables, name, tmp_path):
    for t in ("documents", "pages", "labels", "conversations", "benchmark"):
        spark.read.parquet(f"{odd_tables[0]}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == (1 if name.startswith("op1_") else 0)


# --- pipeline ----------------------------------------------------------------------------------------------------


def brute_lines(rows, ratio=0.05):
    """(id, text, source) without the lines on over ``ratio`` of the different texts of a source, two at least."""
    texts, on = {}, Counter()
    for _, t, s in rows:
        if s:
            texts.setdefault(s, set()).add(frozenset(x.strip(" ") for x in (t or "").split("\n")) - {""})
    for s, own in texts.items():
        on.update((s, x) for lines in own for x in lines)
    drop = {k for k, n in on.items() if n >= 2 and n > ratio * len(texts[k[0]])}
    cut = [(i, t, s, [x for x in (t or "").split("\n") if not x.strip(" ") or (s, x.strip(" ")) not in drop]) for i, t, s in rows]
    return [(i, "\n".join(kept) if len(kept) < len((t or "").split("\n")) else t, s) for i, t, s, kept in cut]


def test_pipeline_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "mixing sources", "byte-level bpe"]
    stages, columns = dict(corpus_pipeline.STAGES), rows.columns
    own = [(r.doc_id, r.text, r.source) for r in rows.collect()]

    clean = stages["toxicity"](spark, rows, sf)
    rejected = {r.doc_id for r in queries.op4_toxicity(spark, sf).where("predicted = 1").collect()}
    assert clean.columns == columns and sorted(r.doc_id for r in clean.collect()) == sorted(i for i, *_ in own if i not in rejected)

    lines = stages["line dedup"](spark, rows, sf)
    assert lines.columns == columns and sorted((r.doc_id, r.text, r.source) for r in lines.collect()) == sorted(brute_lines(own))

    once = stages["simhash near-dedup"](spark, rows, sf)
    assert once.columns == columns and sorted(r.doc_id for r in once.collect()) == brute_kept(own)

    mixed = stages["mixing sources"](spark, rows, sf)
    plan = {r.doc_id: r for r in mixing.mix(rows).collect()}
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and all(abs(times[i] - (r.taken / r["size"] if r["size"] else 0)) <= 0.5 for i, r in plan.items())

    reference = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=byte_bpe.load(PATH, PATTERN).ranks, special_tokens={})
    for r in stages["byte-level bpe"](spark, rows.limit(40), sf).collect():
        t = next(t for i, t, _ in own if i == r.doc_id) or ""
        ids = np.array(reference.encode_ordinary(t), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_pipeline_over_odd_tables(spark, odd_tables, tmp_path):
    results = []
    for sf in odd_tables:
        rows = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, sf).columns == rows.columns
        results.append(Counter(map(repr, corpus_pipeline.run(spark, sf).collect())))
    assert results[0] == results[1] and results[0]
    for t in ("documents", "labels"):
        spark.read.parquet(f"{odd_tables[0]}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_drops_a_sources_header(spark):
    rows = [(i, f"site header\nbody {i} text" if i % 5 == 0 else f"body {i} text", "en", "s", 0) for i in range(100)]
    out = dict(corpus_pipeline.STAGES)["line dedup"](spark, spark.createDataFrame(rows, DOCS), "")
    assert {r.text for r in out.collect()} == {f"body {i} text" for i in range(100)}
    assert all(r.n_chars in (0, len(r.text)) for r in out.collect())


def test_all_links_leave_out_no_pair():
    """Long and short runs: each near pair of different labels, none twice, where a forest leaves pairs out."""
    rng, fewer = np.random.default_rng(7), 0
    for n in (1, 2, 9, 60, 200):
        f = rng.integers(0, 1 << 40, (1, 3), dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 40, (n, 3), dtype=np.uint64))
        key, label = np.sort(rng.integers(0, 1 + n // 50, n)), rng.integers(0, 30, n) * rng.integers(0, 2, n)
        want = {frozenset((a, b)) for a in range(n) for b in range(a) if key[a] == key[b] and label[a] != label[b] and np.bitwise_count(f[a] ^ f[b]).sum() <= 4}
        for piece in (3, 1000):
            got = [frozenset(map(int, p)) for i, j in simhash.all_links(key, f, 4, label, piece) for p in zip(i, j, strict=True)]
            assert len(got) == len(set(got)) and set(got) == want
        fewer += len(want) - len(simhash.run_links(key, f, 4, label)[0])
    assert fewer > 0


def test_similar_pairs_behind_less_similar_ones_are_found(spark):
    """Ten pairs of similar texts in one crowd of near fingerprints, where a forest runs from pair to pair and its links do not hold."""
    rows = [(10 * g + c, " ".join(f"g{g}w{i}" for i in range(60)) + f" end{c}", "s") for g in range(10) for c in range(2)]
    p = simhash.Similar(near=192)  # all that meets at a key is near, and the fingerprints below share all blocks but one
    prints = spark.createDataFrame([(i, 7 + ((i * 0x9E3779 & 0xFFFFFF) << 24), 0, 0, i) for i, *_ in rows], "doc_id long, f0 long, f1 long, f2 long, text_hash long")
    prints = prints.withColumns({"fp": F.xxhash64("f0", "f1", "f2"), "text_hash": F.lit(0).cast("long")})
    texts = docs(spark, rows)
    prints = prints.drop("text_hash").join(texts.select("doc_id", F.xxhash64("text").alias("text_hash")), "doc_id")
    links = simhash.similar_links(texts, prints, p)
    of = {r.fp: r.doc_id for r in prints.collect()}
    assert {frozenset((of[r.a], of[r.b])) for r in links.collect()} == {frozenset((10 * g, 10 * g + 1)) for g in range(10)}


def test_every_near_pair_of_a_key_is_a_candidate(spark):
    """Nine near texts of one key: a forest gives eight links, all pairs are 36."""
    rows = [(7, 1 << i, 0, 0, None) for i in range(9)]
    variants = spark.createDataFrame(rows, "key long, f0 long, f1 long, f2 long, label long")
    assert simhash._candidate_links(variants, simhash.Similar(), every=True).count() == 36


def test_a_crowd_that_stays_apart_gives_no_row_per_pair(spark, monkeypatch):
    """300 pairs of similar texts whose fingerprints are all near: every pair is found, and the searches write a few links a text."""
    rows = [(10 * g + c, " ".join(f"g{g}w{i}" for i in range(60)) + f" end{c}", "s") for g in range(300) for c in range(2)]
    prints = spark.createDataFrame([(i, 7 + ((i * 0x9E3779 & 0xFFFFFF) << 24), 0, 0) for i, *_ in rows], "doc_id long, f0 long, f1 long, f2 long")
    texts, counts = docs(spark, rows), []
    prints = prints.withColumn("fp", F.xxhash64("f0", "f1", "f2")).join(texts.select("doc_id", F.xxhash64("text").alias("text_hash")), "doc_id")
    search = simhash._candidate_links
    monkeypatch.setattr(simhash, "_candidate_links", lambda *a, **k: (counts.append((found := search(*a, **k)).count()), found)[1])
    links = simhash.similar_links(texts, prints, simhash.Similar(near=192))
    of = {r.fp: r.doc_id for r in prints.collect()}
    assert {frozenset((of[r.a], of[r.b])) for r in links.collect()} == {frozenset((10 * g, 10 * g + 1)) for g in range(300)}
    assert sum(counts) <= 10 * len(rows)


def test_tiles_link_what_is_similar():
    """One side and two, with empty sets and few columns at a time: the forest connects just what similar pairs connect."""
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 40, 60)[: rng.integers(20, 60)]).astype(np.uint64) for _ in range(60)] + [np.empty(0, np.uint64)] * 2
    similar = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.8 if len(x) + len(y) else True
    for left, right in ((np.arange(62), np.arange(62)), (np.arange(0, 62, 2), np.arange(1, 62, 2))):
        for columns in (7, 4096):
            hit = simhash.alike(sets, left, right, 0.8, columns)
            assert hit.tolist() == [[similar(sets[x], sets[y]) for y in right] for x in left]
        roots = lambda pairs: functools.reduce(lambda root, p: [min(root[i] for i in p) if r in {root[i] for i in p} else r for r in root], pairs, list(range(62)))
        i, j = simhash.tile_links(sets, left, right, 0.8)
        assert all(similar(sets[x], sets[y]) for x, y in zip(i, j, strict=True)) and len(i) < 62
        assert roots(list(zip(i, j, strict=True))) == roots([(x, y) for x in left for y in right if similar(sets[x], sets[y])])
