"""Queries of sources, catalogue, joins on songs, ranking and sets (S*, J1-J2, K*, G*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seguekit.functions import harmony as H
from seguekit.functions import scoring as S
from seguekit.operators import catalogue as C
from seguekit.plans import dims
from seguekit.plans import views as V
from seguekit.plans.registry import query
from seguekit.plans.scalar_queries import QUEUE


@query("S3_song_id", "SELECT p_partkey AS song_id, left(sha256(p_name), 16) AS short_id FROM part")
def s3(spark, d):
    return V.songs(spark, d).select("song_id", C.short_id(F.col("title")).alias("short_id"))


@query(
    "S6_upsert",
    """SELECT o_custkey AS mix_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS transition_id, max_by(o_totalprice, (o_orderdate, o_orderkey)) / 500000 AS quality_score
    FROM orders GROUP BY o_custkey""",
)
def s6(spark, d):
    t = V.transitions(spark, d).select("mix_id", "transition_id", "quality_score", "analyzed_at")
    stamped = t.withColumn("stamp", F.struct("analyzed_at", "transition_id"))
    old, new = stamped.where("analyzed_at < date'1996-01-01'"), stamped.where("analyzed_at >= date'1996-01-01' or analyzed_at is null")  # all rows, the later ones as changes
    return C.upsert(old, new, "mix_id", "stamp").select("mix_id", "transition_id", "quality_score")


@query("S7_get_transition", "SELECT t.transition_id, t.quality_score, m.title FROM v_transitions t LEFT JOIN v_mixes m USING (mix_id)")
def s7(spark, d):
    return V.transitions(spark, d).join(V.mixes(spark, d), "mix_id", "left").select("transition_id", "quality_score", "title")


@query("S8_transitions_by_technique", "SELECT transition_id, quality_score FROM v_transitions WHERE technique = '1-URGENT' ORDER BY quality_score DESC NULLS LAST, transition_id LIMIT 100")
def s8(spark, d):
    return C.by_technique(V.transitions(spark, d), "1-URGENT").select("transition_id", "quality_score")


@query(
    "S12_dataset_manifest",
    "SELECT track_id, count(*) AS n_frames, round(max(rms), 6) AS top_score, (SELECT count(DISTINCT user_id) FROM events) AS tracks FROM v_frames GROUP BY track_id",
)
def s12(spark, d):
    per = V.frames(spark, d).groupBy("track_id").agg(F.count("*").alias("n_frames"), F.round(F.max("rms"), 6).alias("top_score"))
    return per.join(F.broadcast(per.agg(F.count("*").alias("tracks"))), F.lit(True))


@query(
    "S13_queue_state",
    """WITH log AS (SELECT event_id AS seq, user_id AS item_id, event_type, CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'add' ELSE 'status' END AS op, CAST(CAST(floor(value) AS INT) AS VARCHAR) AS v FROM events WHERE event_id >= 100),
    adds AS (SELECT item_id, max(seq) AS added FROM log WHERE op = 'add' GROUP BY item_id)
    SELECT a.item_id, coalesce(max_by(event_type, seq) FILTER (WHERE seq > added), 'queued') AS status, coalesce(max_by(v, seq) FILTER (WHERE seq > added), max_by(v, seq) FILTER (WHERE seq = added)) AS last_value
    FROM adds a JOIN log USING (item_id) GROUP BY a.item_id""",
)
def s13(spark, d):
    e = V.read(spark, d, "events")
    op = F.when(F.col("event_type").isin("click", "view"), "add").otherwise("status")
    log = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("item_id"), F.when(F.col("event_id") == 99, "clear").otherwise(op).alias("op"), F.when(op == "status", F.col("event_type")).alias("status"), F.create_map(F.lit("value"), F.floor("value").cast("string")).alias("meta"))
    return C.queue_state(log).select("item_id", "status", F.col("meta")["value"].alias("last_value"))


PROBE = ("(SELECT song_id, title, bpm, camelot, key_name, energy FROM v_songs WHERE bpm BETWEEN 100 * 0.94 AND 100 * 1.06 AND energy BETWEEN 1.0 - 0.2 AND 1.0 + 0.2 "
         "AND (camelot IN ('12A', '1A', '11A', '12B') OR key_name = 'Am') ORDER BY abs(bpm - 100), song_id LIMIT 20)")  # fmt: skip


@query("J1_compatible_songs", f"SELECT song_id, bpm, camelot FROM {PROBE}")
def j1(spark, d):
    return C.compatible_songs(V.songs(spark, d), 100.0, "Am", "12A", 1.0).select("song_id", "bpm", "camelot")


PAIRS_SQL = """ok AS (SELECT a.song_id, b.song_id AS match_id, abs(b.bpm - a.bpm) AS bpm_diff, a.bpm AS bpm_a, b.bpm AS bpm_b, a.camelot AS camelot_a, b.camelot AS camelot_b, a.energy AS energy_a, b.energy AS energy_b
    FROM (SELECT *, CAST(regexp_extract(camelot, '[0-9]+') AS INT) AS n, right(camelot, 1) AS l FROM v_songs) a JOIN v_songs b ON a.song_id <> b.song_id AND b.bpm BETWEEN a.bpm * 0.94 AND a.bpm * 1.06
    AND b.energy BETWEEN a.energy - 0.2 AND a.energy + 0.2 AND (a.key_name = b.key_name OR b.camelot IN (a.camelot, (a.n % 12 + 1) || a.l, ((a.n + 10) % 12 + 1) || a.l, a.n || CASE WHEN a.l = 'A' THEN 'B' ELSE 'A' END))),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY bpm_diff, match_id) AS rank FROM ok)"""


@query("J2_compatible_pairs", f"WITH {PAIRS_SQL} SELECT song_id, match_id, bpm_diff, rank, round({QUEUE.replace('pair_id', 'song_id')}, 6) AS score FROM ranked WHERE rank <= 5")
def j2(spark, d):
    top = C.compatible_pairs(V.songs(spark, d), 5)
    score = S.queue_score(*(F.col(x + n) for n in ("bpm", "camelot", "energy") for x in ("", "m_")))
    return top.select("song_id", "match_id", "bpm_diff", "rank", F.round(score, 6).alias("score"))


# --- techniques --------------------------------------------------------------------------------------------------

_SECTIONS = ["verse", "chorus", "drop", "outro", "breakdown", "build"]
CONTEXT_SQL = f"""ctx AS (SELECT pair_id, {_SECTIONS}[CAST(pair_id % 6 + 1 AS INT)] AS section_a, {_SECTIONS}[CAST(pair_id % 5 + 1 AS INT)] AS section_b, energy_b - energy_a AS diff,
    (pair_id % 10) / 10.0 AS clash, (pair_id % 11) / 11.0 AS vocal, pair_id % 3 = 0 AS fit, (bpm_a + bpm_b) / 2 AS tempo,
    CASE WHEN energy_b - energy_a > 0.2 THEN 'up' WHEN energy_b - energy_a < -0.2 THEN 'down' ELSE 'maintain' END AS direction FROM v_pairs)"""
_HAS = "list_contains(structure, {})"
SCORE_SQL = f"""scored AS (SELECT pair_id, tempo, t.name AS technique, t.bars, t.idx,
    (CASE WHEN t.harmony = 'compatible' AND fit THEN 0.3 WHEN t.harmony = 'any' THEN 0.2 ELSE 0 END
    + CASE WHEN t.energy = direction OR (t.energy = 'maintain' AND abs(diff) < 0.2) THEN 0.3 ELSE 0 END
    + CASE WHEN {_HAS.format('section_a')} OR {_HAS.format('section_b')} THEN 0.2 ELSE 0 END
    + CASE WHEN clash > 0.5 AND t.name = 'bass_swap' THEN 0.3 WHEN clash < 0.3 AND clash <= 0.5 AND t.name = 'long_blend' THEN 0.2 ELSE 0 END
    + CASE WHEN vocal > 0.6 THEN CASE t.name WHEN 'staggered_stem_mix' THEN 0.4 WHEN 'vocal_layering' THEN 0.3 WHEN 'partial_stem_separation' THEN 0.2 ELSE 0 END ELSE 0 END
    + CASE WHEN fit AND vocal > 0.4 AND vocal < 0.8 AND t.name IN ('vocal_layering', 'acapella_overlay') THEN 0.3 ELSE 0 END
    + CASE WHEN t.name = 'phrase_match' AND fit THEN 0.3 WHEN t.name = 'double_drop' AND direction = 'up' AND section_b IN ('drop', 'chorus') THEN 0.4
      WHEN t.name = 'backspin' AND direction = 'down' AND section_a IN ('outro', 'chorus') THEN 0.3 WHEN t.name = 'modulation' AND fit THEN 0.2
      WHEN t.name = 'energy_build' AND direction = 'up' THEN 0.3 WHEN t.name = 'breakdown_to_build' AND section_a = 'breakdown' AND section_b = 'build' THEN 0.4
      WHEN t.name = 'drop_on_the_one' AND direction = 'up' AND section_b IN ('drop', 'chorus') THEN 0.35
      WHEN t.name = 'back_and_forth' AND direction = 'maintain' AND fit AND section_a IN ('verse', 'chorus') AND section_b IN ('verse', 'chorus') THEN 0.3
      WHEN t.name = 'drum_roll' AND direction = 'up' AND section_b IN ('build', 'drop', 'chorus') THEN 0.3 ELSE 0 END
    + CASE WHEN t.name = 'loop_transition' AND direction = 'maintain' THEN CASE WHEN section_a IN ('verse', 'chorus', 'breakdown') OR section_b IN ('verse', 'chorus', 'breakdown') THEN 0.25 ELSE 0 END + CASE WHEN clash BETWEEN 0.3 AND 0.6 THEN 0.15 ELSE 0 END ELSE 0 END
    + CASE WHEN t.name = 'washout' THEN CASE WHEN direction = 'down' THEN 0.4 ELSE 0 END + CASE WHEN section_a IN ('outro', 'chorus') THEN 0.2 ELSE 0 END ELSE 0 END)::DOUBLE AS score
    FROM ctx, tech t)"""


def contexts(spark, d):
    sections = F.array(*map(F.lit, _SECTIONS))
    at = lambda n: F.element_at(sections, (F.col("pair_id") % n + 1).cast("int"))
    p = V.pairs(spark, d)
    return p.select("pair_id", at(6).alias("section_a"), at(5).alias("section_b"), (F.col("energy_b") - F.col("energy_a")).alias("energy_diff"), ((F.col("pair_id") % 10) / 10.0).alias("clash"), ((F.col("pair_id") % 11) / 11.0).alias("vocal"), (F.col("pair_id") % 3 == 0).alias("keys_fit"), ((F.col("bpm_a") + F.col("bpm_b")) / 2).alias("tempo"))


@query("K7_technique_scores", f"WITH {dims.TECHNIQUES_SQL}, {CONTEXT_SQL}, {SCORE_SQL} SELECT pair_id, technique, round(score, 6) AS score FROM scored")
def k7(spark, d):
    return dims.technique_scores(contexts(spark, d)).select("pair_id", "technique", F.round("score", 6).alias("score"))


SHORTLIST_SQL = f"""{dims.TECHNIQUES_SQL}, {CONTEXT_SQL}, {SCORE_SQL}, r AS (SELECT *, row_number() OVER w AS rank, score - lead(score) OVER w AS gap FROM (SELECT * REPLACE (round(score, 9) AS score) FROM scored) WINDOW w AS (PARTITION BY pair_id ORDER BY score DESC, idx)),
    g AS (SELECT *, max(gap) FILTER (WHERE rank = 1) OVER (PARTITION BY pair_id) AS first_gap FROM r), k AS (SELECT * FROM g WHERE rank <= CASE WHEN first_gap > 0.4 THEN 2 ELSE 3 END)"""


@query(
    "K8_technique_pick",
    f"""WITH {SHORTLIST_SQL}
    SELECT pair_id, technique, rank, round(greatest(0.01, score) / sum(greatest(0.01, score)) OVER (PARTITION BY pair_id), 6) AS weight, round(bars * 4 * 60 / tempo, 6) AS duration_sec FROM k""",
)
def k8(spark, d):
    return dims.technique_shortlist(dims.technique_scores(contexts(spark, d))).select("pair_id", "technique", "rank", F.round("weight", 6).alias("weight"), F.round("duration_sec", 6).alias("duration_sec"))


@query("K8_technique_draw", f"WITH {SHORTLIST_SQL}, u AS (SELECT pair_id, technique, greatest(0.01, score) / sum(greatest(0.01, score)) OVER (PARTITION BY pair_id) AS weight, (('0x' || left(sha256('42-' || pair_id || '-' || technique), 10))::BIGINT + 0.5) / 1099511627776.0::DOUBLE AS u FROM k) SELECT pair_id, arg_min(technique, -ln(u) / weight) AS technique FROM u GROUP BY pair_id")
def k8_draw(spark, d):
    return dims.weighted_draw(dims.technique_shortlist(dims.technique_scores(contexts(spark, d))), "pair_id", "technique", seed=42)


CAND = "cand AS (SELECT a.song_id AS query_id, b.song_id, b.bpm AS bpm_b, b.camelot AS camelot_b, b.energy AS energy_b, a.bpm AS bpm_a, a.camelot AS camelot_a, a.energy AS energy_a, o.i FROM v_songs a CROSS JOIN (SELECT unnest(range(8)) AS i) o JOIN v_songs b ON b.song_id = (a.song_id * 3 + o.i * 11) % (SELECT count(*) FROM part))"


@query(
    "K9_best_next",
    f"WITH {CAND}, s AS (SELECT query_id, song_id, i, round({QUEUE} + (1 - i / 8.0) * 0.1, 9) AS score FROM cand WHERE i < 5) SELECT query_id, song_id AS next_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, i) AS r FROM s) WHERE r = 1",
)
def k9(spark, d):
    s, n = V.songs(spark, d), V.song_count(spark, d)
    q = s.select(F.col("song_id").alias("query_id"), F.col("bpm").alias("bpm_a"), F.col("camelot").alias("camelot_a"), F.col("energy").alias("energy_a"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).withColumn("song_id", (F.col("query_id") * 3 + F.col("i") * 11) % n)
    b = s.select("song_id", F.col("bpm").alias("bpm_b"), F.col("camelot").alias("camelot_b"), F.col("energy").alias("energy_b"))
    return dims.best_next(q.join(b, "song_id")).select("query_id", "next_id", F.round("score", 6).alias("score"))


@query(
    "K11_top_events",
    "SELECT track_id, frame_idx, rms, rank FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY rms DESC, frame_idx) AS rank FROM v_frames) WHERE rank <= 24",
)
def k11(spark, d):
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("rms"), "frame_idx"))
    return V.frames(spark, d).withColumn("rank", rank).where("rank <= 24").select("track_id", "frame_idx", "rms", "rank")


@query("K12_rank_transitions", "SELECT mix_id, transition_id, row_number() OVER (PARTITION BY mix_id ORDER BY quality_score DESC, transition_id) AS rank FROM v_transitions")
def k12(spark, d):
    rank = F.row_number().over(Window.partitionBy("mix_id").orderBy(F.desc("quality_score"), "transition_id"))
    return V.transitions(spark, d).select("mix_id", "transition_id", rank.alias("rank"))


@query("K10_order_playlist")
def k10(spark, d):
    return dims.order_playlists(V.songs(spark, d).withColumn("playlist", F.col("dj")))


# --- sets and splits ---------------------------------------------------------------------------------------------


@query(
    "G1_merge_sources",
    """SELECT replace(lower(source), ' ', '_') || '_' || lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY k) AS VARCHAR), CAST(greatest(2, length(CAST(row_number() OVER (PARTITION BY source ORDER BY k) AS VARCHAR))) AS INT), '0') AS id, source, tempo, smoothness
    FROM (SELECT 'Part One' AS source, p_partkey AS k, 80.0 + p_size AS tempo, 0.5 AS smoothness FROM part UNION ALL SELECT 'Supp', s_suppkey, 120.0, round(s_acctbal / 10000, 6) FROM supplier)""",
)
def g1(spark, d):
    a = V.read(spark, d, "part").select(F.lit("Part One").alias("source"), F.col("p_partkey").alias("k"), (80.0 + F.col("p_size")).alias("tempo"))
    b = V.read(spark, d, "supplier").select(F.lit("Supp").alias("source"), F.col("s_suppkey").alias("k"), F.round(F.col("s_acctbal") / 10000, 6).alias("smoothness"))
    return dims.merge_sources([a, b], {"tempo": 120.0, "smoothness": 0.5}).select("id", "source", "tempo", "smoothness")


@query("G2_distinct_points", "SELECT track_id, list_sort(list(DISTINCT CAST(floor(t_sec) AS BIGINT))) AS points FROM v_frames GROUP BY track_id")
def g2(spark, d):
    return V.frames(spark, d).groupBy("track_id").agg(F.array_sort(F.collect_set(F.floor("t_sec"))).alias("points"))


@query(
    "G3_key_union",
    """WITH h AS (SELECT source_mix, crossfade_type, count(*) AS n FROM v_samples GROUP BY ALL)
    SELECT coalesce(a.source_mix, b.source_mix - 1) AS mix_a, coalesce(a.crossfade_type, b.crossfade_type) AS crossfade_type, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, a.n IS NOT NULL AND b.n IS NOT NULL AS common
    FROM h a FULL OUTER JOIN h b ON b.source_mix = a.source_mix + 1 AND a.crossfade_type = b.crossfade_type""",
)
def g3(spark, d):
    """Keys of the histograms of each mix and the next one: their union, and which of them both have."""
    h = V.samples(spark, d).groupBy("source_mix", "crossfade_type").count()
    a = h.select(F.col("source_mix").alias("mix_a"), "crossfade_type", F.col("count").alias("n_a"))
    b = h.select((F.col("source_mix") - 1).alias("mix_a"), "crossfade_type", F.col("count").alias("n_b"))
    both = a.join(b, ["mix_a", "crossfade_type"], "full").withColumn("common", F.col("n_a").isNotNull() & F.col("n_b").isNotNull())
    return both.na.fill(0, ["n_a", "n_b"])


SPLIT_SQL = """SELECT song_id, genre, CASE WHEN s < 0.7 THEN 'train' WHEN s < 0.85 THEN 'val' ELSE 'test' END AS split FROM (SELECT song_id, genre, (row_number() OVER (PARTITION BY genre ORDER BY sha256('42-' || song_id), song_id) - 1) / count(*) OVER (PARTITION BY genre) AS s FROM v_songs)"""


@query("G4_stratified_split", SPLIT_SQL)
def g4(spark, d):
    return dims.stratified_split(V.songs(spark, d), "song_id", "genre", seed=42).select("song_id", "genre", "split")


@query("G5_split_report", f"SELECT split, genre, count(*) AS n FROM ({SPLIT_SQL}) GROUP BY split, genre")
def g5(spark, d):
    return dims.stratified_split(V.songs(spark, d), "song_id", "genre", seed=42).groupBy("split", "genre").agg(F.count("*").alias("n"))
