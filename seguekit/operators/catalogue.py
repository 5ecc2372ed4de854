"""Catalogue operators: ids, upserts, lookups, change logs and compatible songs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seguekit.functions.harmony import number


def short_id(content: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def upsert(current: DataFrame, changes: DataFrame, key: str, stamp: str = "analyzed_at", tie: str | None = None) -> DataFrame:
    """Last write wins by ``stamp``; between equal stamps a change beats a current row, then the larger ``tie``.

    A hot key meets one task only with its own versions: the winner is an aggregate with map-side combine.
    """
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    row = F.struct(*(F.col(c) for c in both.columns if c != "__new"))
    order = F.struct(stamp, "__new", *([tie] if tie else []))
    return both.groupBy(key).agg(F.max_by(row, order).alias("__row")).select("__row.*")


def by_technique(transitions: DataFrame, technique: str, limit: int = 100) -> DataFrame:
    return transitions.where(F.col("technique") == technique).orderBy(F.desc_nulls_last("quality_score"), "transition_id").limit(limit)


def camelot_friends(code: Column) -> Column:
    """The code itself, both neighbours on the wheel and the other letter; empty for junk."""
    n, letter = number(code), F.right(code, F.lit(1))
    other = F.when(letter == "A", "B").otherwise("A")
    friends = F.array(F.concat(n, letter), F.concat(n % 12 + 1, letter), F.concat((n + 10) % 12 + 1, letter), F.concat(n, other))
    return F.when(n.isNotNull(), friends).otherwise(F.array().cast("array<string>"))


def compatible_songs(songs: DataFrame, bpm: float, key: str, camelot: str | None, energy: float, limit: int = 20) -> DataFrame:
    """Catalogue rows within 6 % of the tempo and 0.2 of the energy, in a friendly code or the same key, nearest tempo first."""
    keyed = F.array_contains(camelot_friends(F.lit(camelot)), F.col("camelot")) if camelot else F.lit(False)
    near = F.col("bpm").between(bpm * 0.94, bpm * 1.06) & F.col("energy").between(energy - 0.2, energy + 0.2)
    return songs.where(near & (F.coalesce(keyed, F.lit(False)) | (F.col("key_name") == key))).orderBy(F.abs(F.col("bpm") - bpm), "song_id").limit(limit)


#: Widths of the cells of tempo (of its logarithm) and energy; any widths give the same pairs.
BAND, LEVEL = 0.24, 0.4


def _first_fits(key: np.ndarray, energy: np.ndarray, song: np.ndarray, base: dict[str, np.ndarray], start: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the first ``most`` rows of ``base`` from ``start`` to before ``end`` that fit each query by energy, its own song left out.

    All queries step through their rows together; one leaves when it has enough.
    """
    low, high = energy - 0.2, energy + 0.2
    at, left, found = start.copy(), np.flatnonzero(start < end), np.zeros(len(key), np.int64)
    queries, rows = [], []
    while len(left):
        row = at[left]
        e = base["m_energy"][row]
        hit = (e >= low[left]) & (e <= high[left]) & (base["match_id"][row] != song[left])
        queries.append(left[hit])
        rows.append(row[hit])
        found[left[hit]] += 1
        at[left] += 1
        left = left[(found[left] < most) & (at[left] < end[left])]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *queries]), np.concatenate([none, *rows])


def nearest_in_cell(songs: dict[str, np.ndarray], base: dict[str, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(song, row of base): for each song of a cell the ``most`` rows nearest in tempo (by match_id among equals) that fit, and maybe some more.

    Rows of equal or higher tempo in the order of (tempo, match_id), and lower ones in that of (-tempo, match_id), stand in the order of the
    difference, so the nearest ones are among the first that fit on each side.
    """
    bpm, tempo, out = songs["bpm"], base["m_bpm"], []
    up, down = np.lexsort((base["match_id"], tempo)), np.lexsort((base["match_id"], -tempo))
    sides = (
        (up, np.searchsorted(tempo[up], bpm, "left"), np.searchsorted(tempo[up], bpm * 1.06, "right")),
        (down, np.searchsorted(-tempo[down], -bpm, "right"), np.searchsorted(-tempo[down], -(bpm * 0.94), "right")),
    )
    for order, start, end in sides:
        sorted_base = {n: base[n][order] for n in ("match_id", "m_energy")}
        q, r = _first_fits(bpm, songs["energy"], songs["song_id"], sorted_base, start, end, most)
        out.append((q, order[r]))
    return np.concatenate([q for q, _ in out]), np.concatenate([r for _, r in out])


def compatible_pairs(songs: DataFrame, most: int = 5) -> DataFrame:
    """(song_id, match_id, bpm_diff, rank, columns of both): the batch form for every song, itself left out.

    Which keys go together is told on the different (camelot, key_name) only. A song of the base goes to the keys it suits and to the cells
    of tempo and energy from which it can be met; a song asks in its own cell, where rows are taken in the order of the difference until
    ``most`` fit. So work grows with the songs, not with their pairs. Songs equal in all four values are one place: its first ``most`` + 1 ids
    are all that anyone can come to.
    """
    s = songs.select("song_id", F.col("bpm").cast("double").alias("bpm"), "camelot", "key_name", F.col("energy").cast("double").alias("energy")).where("song_id is not null and bpm >= 0 and not isnan(bpm) and not isnan(energy)")
    tags = s.select("camelot", "key_name").distinct()
    met = tags.select(F.col("camelot").alias("m_camelot"), F.col("key_name").alias("m_key"))
    by_code = tags.withColumn("friend", F.explode(camelot_friends(F.col("camelot")))).join(met, F.col("friend") == F.col("m_camelot")).drop("friend")
    by_key = tags.join(met, F.col("key_name") == F.col("m_key"))
    suits = by_code.unionByName(by_key).distinct().select(F.col("camelot").alias("c"), F.col("key_name").alias("k"), "m_camelot", "m_key")

    band = lambda x: F.when(x > 0, F.floor(F.log(x) / BAND)).otherwise(-(1 << 30)).cast("long")
    level = lambda x: F.floor(x / LEVEL).cast("long")
    place = Window.partitionBy("camelot", "key_name", "bpm", "energy").orderBy("song_id")
    first = s.withColumn("__n", F.dense_rank().over(place)).where(F.col("__n") <= most + 1)
    base = first.select(F.col("song_id").alias("match_id"), F.col("bpm").alias("m_bpm"), F.col("camelot").alias("mc"), F.col("key_name").alias("mk"), F.col("energy").alias("m_energy"))
    base = base.join(suits, F.col("mc").eqNullSafe(F.col("m_camelot")) & F.col("mk").eqNullSafe(F.col("m_key"))).drop("mc", "mk", "m_key")
    bands, levels = F.sequence(band(F.col("m_bpm") / 1.0601), band(F.col("m_bpm") / 0.9399)), F.sequence(level(F.col("m_energy") - 0.201), level(F.col("m_energy") + 0.201))
    base = base.withColumn("b", F.explode(bands)).withColumn("l", F.explode(levels))
    asked = s.select("song_id", "bpm", "energy", F.col("camelot").alias("c"), F.col("key_name").alias("k"), band(F.col("bpm")).alias("b"), level(F.col("energy")).alias("l"))
    cell = ["c", "k", "b", "l"]

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        q, r = nearest_in_cell(*({n: t.column(n).to_numpy() for n in names} for t, names in ((left, ("song_id", "bpm", "energy")), (right, ("match_id", "m_bpm", "m_energy")))), most)
        mine, other = left.select(["song_id", "bpm", "c", "energy"]).take(pa.array(q)), right.select(["match_id", "m_bpm", "m_camelot", "m_energy"]).take(pa.array(r))
        return pa.table([*mine.columns, *other.columns], names=["song_id", "bpm", "camelot", "energy", "match_id", "m_bpm", "m_camelot", "m_energy"])

    kinds = dict(songs.dtypes)
    schema = f"song_id {kinds['song_id']}, bpm double, camelot string, energy double, match_id {kinds['song_id']}, m_bpm double, m_camelot string, m_energy double"
    both = asked.groupBy(*cell).cogroup(base.groupBy(*cell)).applyInArrow(near, schema).withColumn("bpm_diff", F.abs(F.col("m_bpm") - F.col("bpm")))
    rank = F.row_number().over(Window.partitionBy("song_id").orderBy("bpm_diff", "match_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= most)


def queue_state(log: DataFrame) -> DataFrame:
    """Change log (seq, op, item_id, status, meta map) -> the queue's items: item_id, status, meta.

    Rows up to the last 'clear' are void; 'remove' drops an item; a status for an item that was never added does
    nothing; metadata is merged in order, later values win.
    """
    live = log.join(F.broadcast(log.where("op = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("__cleared"))), F.col("seq") > F.col("__cleared"))
    steps = F.array_sort(F.collect_list(F.struct("seq", "op", "status", "meta")), lambda a, b: F.signum(a["seq"] - b["seq"]).cast("int"))
    items = live.where("item_id IS NOT NULL").groupBy("item_id").agg(steps.alias("steps"))
    empty = F.create_map().cast("map<string,string>")
    start = F.struct(F.lit(False).alias("there"), F.lit(None).cast("string").alias("status"), empty.alias("meta"))

    def step(acc: Column, x: Column) -> Column:
        meta = F.coalesce(x["meta"], empty)
        merged = F.map_concat(F.map_filter(acc["meta"], lambda k, _: ~F.map_contains_key(meta, k)), meta)
        added = F.struct(F.lit(True).alias("there"), F.coalesce(x["status"], F.lit("queued")).alias("status"), meta.alias("meta"))
        changed = F.struct(F.lit(True).alias("there"), F.coalesce(x["status"], acc["status"]).alias("status"), merged.alias("meta"))
        return F.when(x["op"] == "add", added).when(x["op"] == "remove", start).when(acc["there"] & (x["op"] == "status"), changed).otherwise(acc)

    return items.select("item_id", F.aggregate("steps", start, step).alias("s")).where("s.there").select("item_id", "s.status", "s.meta")
