"""Periodic runs, substring dedup and ranked search against brute force and against their SQL on odd rows."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seguekit.llm import periodic_runs, queries, ranked_search, substring_dedup
from seguekit.llm.oracles import ORACLES

DOCS = "doc_id long, text string"


def brute_runs(words, min_length=6, min_exponent=4):
    found = {}
    for p in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > start and i + p - start >= max(min_length, min_exponent * p):
                found.setdefault((start, i + p - start), p)
            i = max(i, start + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("bounds", [(6, 4), (5, 3), (2, 2)])
def test_runs_equal_brute_force(bounds):
    rng = random.Random(5)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 5)):
            text = []
            for _ in range(rng.randint(0, 5)):
                text += [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(1, 9))] * rng.randint(1, 9) + [rng.randrange(9) for _ in range(rng.randint(0, 6))]
            texts.append(np.array(text, np.int64))
        for text, got in zip(texts, periodic_runs.find_runs(texts, *bounds), strict=True):
            assert [tuple(r) for r in got.tolist()] == brute_runs(text.tolist(), *bounds)


def test_runs_of_long_texts_and_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PIECE", 1000)
    rng = random.Random(6)
    text = [rng.randrange(50) for _ in range(3000)] + [rng.randrange(3) for _ in range(700)] * 5 + [7] * 9000
    assert [tuple(r) for r in periodic_runs.find_runs([np.array(text)])[0].tolist()] == brute_runs(text)


def test_extensions_climb_few_levels():
    """A grammar over n symbols has levels in the order of log n, and extensions equal plain comparison."""
    rng = np.random.default_rng(3)
    text = np.concatenate((rng.integers(0, 3, 20_000), np.tile(rng.integers(0, 3, 500), 40)))
    symbols = np.concatenate(([3], text, [4]))
    grammar = periodic_runs.Grammar(symbols, symbols >= 3)
    assert len(grammar.levels) < 90
    a = rng.integers(1, len(text) - 1000, 400)
    b = a + 500
    want = [next(n for n in range(len(text)) if symbols[i + n] != symbols[j + n]) for i, j in zip(a, b, strict=True)]
    assert grammar.extension(a, b).tolist() == want


def test_runs_table_and_collapsed_text(spark):
    rows = [(1, "x " + "a b " * 5 + "y"), (2, None), (None, "z z z z z z"), (3, "A a A a\tA\n\x0b a A")]
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(spark.createDataFrame(rows, DOCS)).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 10, 2)] and got[1].collapsed == "x a b y"
    assert got[2].runs == [] and got[2].collapsed == "" and got[2].n_words == 0
    assert got[None].collapsed == "z" and [tuple(x) for x in got[3].runs] == []


def brute_removed(rows, width):
    first = {}
    words = [(substring_dedup.LAST_ID if i is None else i, (t or "").split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            first[x] = min(first.get(x, i), i)
    return [(len(w), [j for j in range(len(w)) if not any(first[tuple(w[k : k + width])] < i for k in range(max(0, j - width + 1), min(j, len(w) - width) + 1))]) for i, w in words]


@pytest.mark.parametrize(("dense", "bits"), [(2000, 27), (3, 27), (3, 6), (0, 8)])
def test_substring_dedup_equals_brute_force(spark, dense, bits):
    """Buckets, hot windows, and a bitmap whose slots are all false alarms."""
    rng = random.Random(7)
    shared = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 40))] for _ in range(6)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choice(shared) if rng.random() < 0.6 else [rng.choice("abcdefgh") for _ in range(rng.randint(1, 15))]
        rows.append((rng.choice([None, *range(80)]), " ".join(text)))
    rows += [rows[3], rows[3], (90, None), (91, ""), (92, "a " * 500), (93, "a " * 499), (1, "a " * 12)]
    p = substring_dedup.Windows(width=12, mer=3, dense=dense, filter_bits=bits)
    got = substring_dedup.drop_repeats(spark.createDataFrame(rows, DOCS).repartition(3), p).collect()
    want = [(i, n, n - len(k), " ".join((t or "").split()[j] for j in k)) for (i, t), (n, k) in zip(rows, brute_removed(rows, 12), strict=True)]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == sorted(want, key=repr)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)


def test_super_kmers_cover_all_windows_once():
    rng = np.random.default_rng(1)
    sizes = np.array([60, 0, 49, 50, 300])
    hashes = rng.integers(0, 1 << 63, sizes.sum()).astype(np.uint64)
    key, text, place, count = substring_dedup.super_kmers(hashes, sizes, substring_dedup.Windows())
    assert sorted((t, p + k) for t, p, n in zip(text, place, count, strict=True) for k in range(n)) == [(t, k) for t, n in enumerate(sizes) for k in range(n - 49)]
    assert count.mean() > 10 and len(key) == len(count)


def brute_search(docs, items, k):
    import math

    terms = [(i, ranked_search.terms_of(t)) for i, t in docs]
    n, total = sum(1 for _, t in terms if t), sum(len(t) for _, t in terms)
    df = {}
    for _, t in terms:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = set()
    for item in {i for i, _ in items if i is not None}:
        asked = {x for i, t in items if i == item for x in ranked_search.terms_of(t)}
        scores = []
        for doc, t in terms:
            if t and doc is not None:
                m = 10 + 90 * len(t) * n // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in asked if x in t)
                scores += [(-s, doc)] if s > 0 else []
        out |= {(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("plan", [ranked_search.Search(), ranked_search.Search(k=3, block=2, cells=400, shard=16, pass_terms=20)])
def test_ranked_search_equals_brute_force(spark, plan):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß9"]
    text = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.06)), 61)] for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(150)] + [(7, "w1 w2"), (None, "w1 w2 w3"), (None, None), (200, None)]
    docs += [(300 + i, docs[5][1]) for i in range(20)]
    items = [(i, text(rng.randint(0, 9))) for i in range(15)] + [(1, "W1, w2;É"), (None, "w1"), (50, docs[9][1]), (51, None), (52, "none of these")]
    got = ranked_search.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string"), plan)
    assert {tuple(r) for r in got.collect()} == brute_search(docs, items, plan.k)


def test_ranked_search_skips_blocks_but_stays_exact():
    rng = np.random.default_rng(2)
    p = ranked_search.Search(k=2, block=8)
    n, terms = 2000, 40
    impacts = rng.integers(1, 1000, (n, terms)) * (rng.random((n, terms)) < 0.2)
    impacts[:30] = rng.integers(900, 1000, (30, terms))
    doc, column = np.nonzero(impacts)
    weights = np.arange(terms, 0, -1)
    asked = ranked_search.Asked(np.array([0, 6]), np.array([1, 4, 9, 20, 30, 39]), weights, p)
    asked.read(ranked_search.Shard(np.arange(n), doc, column, impacts[doc, column], weights, p))
    s = impacts[:, asked.columns] @ weights[asked.columns]
    order = np.lexsort((np.arange(n), -s))[:2]
    assert asked.best[0][1].tolist() == order.tolist() and asked.best[0][0].tolist() == s[order].tolist()
    assert asked.bounded < asked.seen / 2 < 6 * n


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_substring_dedup", "op13_ranked_search"])
def test_queries_equal_their_sql_on_odd_rows(spark, tmp_path, name):
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(30)}" for _ in range(70))
    rows = [(i, " ".join(rng.choice(["red", "Red", "blue", "é", "x-y"]) for _ in range(rng.randint(0, 90))) + (f" {passage}" if i % 3 == 0 else "")) for i in range(150)]
    rows += [(200, None), (220, ""), (None, "red blue " * 9), (None, None), (240, "long river " * 300), rows[5], rows[5], (3, "other text of id 3"), (-4, "a\x0bb\x1cc d " * 8), (9, passage)]
    items = [(1, "red blue"), (1, "Long,red"), (2, ""), (3, None), (None, "red"), (4, passage)]
    spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("own")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("own")).write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, cursor.fetchall()))
