"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding: lower case, look-alike letters of other scripts and digits or signs written for letters become letters.
Entries are whole words (``=idiot``) and word beginnings (``^idio``). A word start counts once, with its heaviest
entry; words inside an exception phrase do not count. The weight found is set against the length of the text, and a
logistic curve turns weight and density into a score from 0 to 1.

The lexicon, the exception phrases and the curve are fitted on labelled rows: entries by how surely they tell the classes
apart, under false-discovery control over all that are tested; exceptions as phrases of two words that hold an entry and yet are no more toxic than the rows at large, in document
frequencies summed by Spark. At most about ``max_fit_rows`` labelled ids, chosen by hash, are used, a documented bound, and
what they hold bounds the lexicon. Their marks are broadcast and their texts written once. Scoring covers every row.

Defined results: null and empty texts hold no word and get the score of zero weight; texts of any length are scored whole;
without usable labels every score is 0; an empty table gives an empty result; null labels are left out; repeated rows
count each; several labels for an id count each; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seguekit.llm.common import cut

#: Look-alikes (Cyrillic, Greek, full-width by rule below), and digits and signs written for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнαειοκνρτυχ", "aeopcyxijsdhkmtbhaeiokvptux", strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
FULL_WIDTH = {chr(0xFEE0 + c): chr(c) for c in range(ord("a"), ord("z") + 1)}
FOLDS = {**HOMOGLYPHS, **SUBSTITUTES, **FULL_WIDTH}
_FOLD = re.compile("[" + "".join(map(re.escape, FOLDS)) + "]")
_WORD = re.compile(r"[^\W\d_]+")

#: Phrases in which a listed word is not meant as an insult, besides those that are learnt.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "worthless check", "loser bracket", "stupid simple")

PREFIXES = range(3, 9)


def fold(text: str) -> str:
    return _FOLD.sub(lambda m: FOLDS[m[0]], text.lower())


@dataclass(frozen=True)
class ToxicityModel:
    entries: dict[str, float] = field(default_factory=dict)  #: "=word" or "^beginning" -> weight
    curve: tuple[float, float, float] = (-50.0, 0.0, 0.0)  #: bias, by weight, by density
    exceptions: tuple[str, ...] = EXCEPTIONS
    threshold: float = 0.7


class Matcher:
    """The automaton of a model; weigh() gives the summed weight and the number of words of a text."""

    def __init__(self, model: ToxicityModel):
        self.model, self.auto = model, ahocorasick.Automaton()
        both: dict[str, list] = {}
        for entry, w in model.entries.items():
            both.setdefault(entry[1:], []).append((entry[0], w))
        for phrase in model.exceptions:
            both.setdefault(fold(phrase), []).append(("!", 0.0))
        for word, kinds in both.items():
            self.auto.add_word(word, (len(word), kinds))
        if both:
            self.auto.make_automaton()

    def weigh(self, text: str | None) -> tuple[float, int]:
        x = fold(text or "")
        words = x.count(" ") + x.count("\n") + 1
        if not len(self.auto):
            return 0.0, words
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for last, (size, kinds) in self.auto.iter(x):
            start = last - size + 1
            if start and x[start - 1].isalpha():
                continue
            whole = last + 1 == len(x) or not x[last + 1].isalpha()
            for kind, w in kinds:
                if kind == "!" and whole:
                    excused.append((start, last))
                elif (kind == "^" or kind == "=" and whole) and w > best.get(start, 0.0):
                    best[start] = w
        excused.sort()
        total, n, until = 0.0, 0, -1
        for at in sorted(best):
            while n < len(excused) and excused[n][0] <= at:
                until, n = max(until, excused[n][1]), n + 1
            if at > until:
                total += best[at]
        return total, words

    def score(self, text: str | None) -> float:
        bias, by_weight, by_density = self.model.curve
        a, b = evidence(*self.weigh(text))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, bias + by_weight * a + by_density * b))))


def evidence(weight: float, words: int) -> tuple[float, float]:
    """Weight and length-normalised weight, both on a log scale."""
    return math.log1p(weight), math.log1p(100.0 * weight / max(words, 1))


def features_of(text: str | None) -> set[str]:
    found = set()
    for w in set(_WORD.findall(fold(text or ""))):
        found.add("=" + w)
        found.update("^" + w[:n] for n in PREFIXES if len(w) >= n)
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, max_fit_rows: int, hold_out=None) -> DataFrame:
    """(text, n, toxic) of the labelled rows: n labels, of which so many say toxic; by hash about ``max_fit_rows`` ids.

    ``hold_out``: a condition on doc_id to leave out.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), (F.col("toxic") != 0).alias("__toxic"))
    if hold_out is not None:
        marks = marks.where(~hold_out(F.col("__id")))
    marks = marks.groupBy("__id").agg(F.count("*").alias("n"), F.count_if("__toxic").alias("toxic"))
    n = marks.count()
    if n > max_fit_rows:
        marks = marks.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(1e6 * max_fit_rows / n))
    return docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("__id")).select("text", "n", "toxic")


def counted(sample: DataFrame, found_in) -> DataFrame:
    """(entry, n, toxic): labels, and toxic ones, of the rows in whose text ``found_in`` finds an entry; "" counts rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, hits = Counter(), Counter()

        def out():
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[k] for k in keys], pa.int64()), pa.array([hits[k] for k in keys], pa.int64())], names=["entry", "n", "toxic"])

        for b in batches:
            for text, n, toxic in zip(*(b.column(c).to_pylist() for c in ("text", "n", "toxic")), strict=True):
                found = found_in(text) | {""}
                for _ in range(n):
                    seen.update(found)
                for _ in range(toxic):
                    hits.update(found)
                if len(seen) > 100_000:
                    yield out()
                    seen, hits = Counter(), Counter()
        yield out()

    return sample.mapInArrow(run, "entry string, n long, toxic long").groupBy("entry").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def surest(cells: dict[int, int], tested: int, rate: float) -> float:
    """The least evidence, in nats, that Benjamini and Hochberg's procedure accepts at a false-discovery rate.

    ``cells``: how many entries have a statistic of n / 100 nats or a little more; ``tested``: how many were tested. Twice the nats are a squared normal deviate.
    """
    least, above = math.inf, 0
    for cell in sorted(cells, reverse=True):
        above += cells[cell]
        if 0.5 * math.erfc(math.sqrt(cell / 100)) <= rate * above / tested:
            least = cell / 100
    return least


def fit(docs: DataFrame, labels: DataFrame, hold_out=None, max_fit_rows: int = 20_000, false_rate: float = 0.05, exceptions: tuple[str, ...] = EXCEPTIONS, least_rows: int = 3, least_weight: float = 2.0) -> ToxicityModel:
    """Lexicon, exceptions and curve from labelled rows.

    An entry's evidence is its likelihood-ratio statistic against the base rate. All entries of ``least_rows`` rows are tested, and those go in that
    stay under a false-discovery rate over all tests, so that the bar follows the size of the sample; and that are ``least_weight`` in log odds.
    """
    sample = cut(labelled_sample(docs, labels, max_fit_rows, hold_out))
    counts = cut(counted(sample, features_of).where((F.col("entry") == "") | (F.col("n") >= least_rows)))
    rows = counts.where("entry = ''").first()
    if rows is None or not 0 < rows["toxic"] < rows["n"]:
        return ToxicityModel(exceptions=exceptions)
    n, toxic = rows["n"], rows["toxic"]
    base, a, b = toxic / n, F.col("toxic"), F.col("n")
    share = (a + 0.01) / (b + 0.02)
    nats = b * (share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base)))
    odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b - a + 0.5) / (n - toxic + 1))
    tested = counts.where(F.col("entry") != "").withColumns({"weight": odds, "nats": F.when(share > base, nats).otherwise(0.0)})
    cells = {r["cell"]: r["n"] for r in tested.groupBy(F.floor(F.col("nats") * 100).alias("cell")).agg(F.count("*").alias("n")).collect()}  # bounded by the nats that max_fit_rows rows can hold
    least = surest(cells, sum(cells.values()), false_rate)
    best = tested.where((F.col("nats") >= least) & (F.col("weight") >= least_weight))
    kept = best.collect()  # what sure entries at most max_fit_rows rows can hold
    entries = prune({r["entry"]: r["weight"] for r in kept}, {r["entry"]: r["toxic"] for r in kept})
    phrases = counted(sample, lambda text: phrases_of(text, entries)).where((F.col("entry") != "") & (b - a >= 5) & (a <= base * b))
    learnt = sorted(r["entry"] for r in phrases.select("entry").collect())  # bounded likewise
    return _fit_curve(sample, ToxicityModel(entries=entries, exceptions=(*exceptions, *learnt)))


def phrases_of(text: str | None, entries: dict[str, float]) -> set[str]:
    """Pairs of neighbouring words, one space apart, of which one matches an entry."""
    x, found, last, last_held = fold(text or ""), set(), None, False
    for m in _WORD.finditer(x):
        held = "=" + m[0] in entries or any("^" + m[0][:n] in entries for n in PREFIXES if len(m[0]) >= n)
        if last is not None and (held or last_held) and x[last.end() : m.start()] == " ":
            found.add(f"{last[0]} {m[0]}")
        last, last_held = m, held
    return found


def prune(entries: dict[str, float], hits: dict[str, int]) -> dict[str, float]:
    """Leave out beginnings that say no more than a longer one: nearly all of their hits come through it."""
    longer: dict[str, list[str]] = {}
    for e in entries:
        if e[0] == "^":
            longer.setdefault(e[:-1], []).append(e)
    return {e: w for e, w in entries.items() if not any(hits[k] >= 0.98 * hits[e] and entries[k] >= w - 1e-9 for k in longer.get(e, ()))}


def _fit_curve(sample: DataFrame, model: ToxicityModel, cell: float = 0.1) -> ToxicityModel:
    """Logistic curve by Newton steps over a grid of evidence: the grid's size is bounded, not the sample's."""

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cells = Matcher(model), Counter()
        for b in batches:
            for text, n, toxic in zip(*(b.column(c).to_pylist() for c in ("text", "n", "toxic")), strict=True):
                x, y = evidence(*m.weigh(text))
                cells[round(x / cell), round(y / cell), 0] += n - toxic
                cells[round(x / cell), round(y / cell), 1] += toxic
        k = list(cells)
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in k], pa.int64()) for i in range(3)] + [pa.array([cells[c] for c in k], pa.int64())], names=["x", "y", "toxic", "n"])

    rows = sample.mapInArrow(grid, "x long, y long, toxic long, n long").groupBy("x", "y", "toxic").agg(F.sum("n").alias("n")).collect()  # a row for each cell
    if not rows:
        return model
    z = np.array([[1.0, r["x"] * cell, r["y"] * cell] for r in rows])
    t, n = np.array([r["toxic"] for r in rows], float), np.array([r["n"] for r in rows], float)
    # Both evidences can only speak for toxicity; a small ridge keeps separable samples finite.
    beta, ridge = np.array([-3.0, 1.0, 0.0]), np.diag([1e-6, 0.5, 0.5])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(3), z.T @ (n * (t - p)) - ridge @ beta)
        beta = beta + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(model.entries, tuple(map(float, beta)), model.exceptions, model.threshold)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted); a narrow map over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(model)
        for b in batches:
            s = [m.score(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array([int(x >= model.threshold) for x in s], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns; a narrow filter."""
    names, kinds = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(model)
        at = names.index("text")
        for b in batches:
            yield b.filter(pa.array([m.score(x.as_py()) < model.threshold for x in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, kinds)
