"""Queries of tempo morphs, set markers, marked tracklists and document lookups, roles and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from seguekit.operators import morphs as M
from seguekit.operators import quality as Q
from seguekit.operators import tracklists as TL
from seguekit.plans import views as V
from seguekit.plans.registry import query
from seguekit.sources import files

r6 = lambda c: F.round(c, 6)


@query(
    "F36_tempo_morph",
    """WITH p AS (SELECT pair_id, bpm_a::DOUBLE AS a, bpm_b::DOUBLE AS b, duration_a / 10.0::DOUBLE AS dur, 8 + CAST(duration_a AS INT) // 5 % 9 AS points, CASE WHEN vocals_a THEN 0.04 ELSE 0.08 END::DOUBLE AS pct FROM v_pairs),
    g AS (SELECT *, greatest(least(b, a * (1 + pct)), a * (1 - pct)) AS target, greatest(4, floor(floor(dur * a / 60) / 4)) AS steps FROM p),
    c AS (SELECT *, CASE WHEN abs(target - a) < 0.5 THEN a ELSE target END AS goal, CAST(unnest(range(points)) AS INT) AS i FROM g),
    s AS (SELECT c.*, shape, i::DOUBLE / (points - 1) AS t FROM c, (SELECT unnest(['smooth', 'exponential', 'stepped', 'linear']) AS shape)),
    m AS (SELECT *, a + (goal - a) * CASE shape WHEN 'smooth' THEN 0.5 * (1 - cos(pi() * t)) WHEN 'exponential' THEN (1 - exp(-3 * t)) / (1 - exp(-3.0)) WHEN 'stepped' THEN ceil((i + 1) * steps / points) / steps ELSE t END AS tempo FROM s),
    d AS (SELECT *, coalesce((a / tempo + lag(a / tempo) OVER w) / 2 * dur / (points - 1), 0) AS part FROM m WINDOW w AS (PARTITION BY pair_id, shape ORDER BY i))
    SELECT pair_id, shape, i, round(tempo, 6) AS tempo, round(a / tempo, 6) AS stretch, round(sum(part) OVER (PARTITION BY pair_id, shape ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS elapsed FROM d""",
)
def f36_morph(spark, d):
    """Tempo curves of every pair in all four shapes, with the time that passes; vocals take half the change."""
    p = V.pairs(spark, d).select(
        "pair_id", F.col("bpm_a").alias("tempo_a"), F.col("bpm_b").alias("tempo_b"), (F.col("duration_a") / 10).alias("duration_sec"),
        (8 + F.floor(F.col("duration_a").cast("int") / 5).cast("int") % 9).alias("points"), F.when(F.col("vocals_a"), 0.04).otherwise(0.08).alias("max_pct"),
    )
    return M.tempo_morph(p).withColumns({c: r6(c) for c in ("tempo", "stretch", "elapsed")})


_SET = "CAST(60 + floor(quality_score * 120) AS BIGINT) AS t1, CAST(floor(quality_score * 40) AS BIGINT) AS b_in, CAST(8 + floor(quality_score * 16) AS BIGINT) AS blend, CAST(180 + floor(quality_score * 200) AS BIGINT) AS b_length"


@query(
    "W22_set_markers",
    f"""WITH t AS (SELECT mix_id, transition_id, {_SET} FROM v_transitions),
    b AS (SELECT *, row_number() OVER w - 1 AS n, greatest(0, t1 - coalesce(lag(b_in + blend) OVER w, 0)) AS body, lead(transition_id) OVER w IS NULL AS last FROM t WINDOW w AS (PARTITION BY mix_id ORDER BY transition_id)),
    e AS (SELECT *, CAST(sum(body + blend) OVER (PARTITION BY mix_id ORDER BY transition_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM b)
    SELECT mix_id, 'track' AS kind, CAST(n AS INT) AS index, upto - blend - body AS start, upto - blend AS "end" FROM e
    UNION ALL SELECT mix_id, 'transition', CAST(n AS INT), upto - blend, upto FROM e
    UNION ALL SELECT mix_id, 'track', CAST(n + 1 AS INT), upto, upto + greatest(0, b_length - b_in - blend) FROM e WHERE last""",
)
def w22_markers(spark, d):
    q = F.col("quality_score")
    plans = V.transitions(spark, d).select(
        "mix_id", "transition_id", (60 + F.floor(q * 120)).alias("t1"), F.floor(q * 40).alias("b_in"), (8 + F.floor(q * 16)).alias("blend"), (180 + F.floor(q * 200)).alias("b_length")
    )
    return M.set_markers(plans, "mix_id", "transition_id")


@query(
    "W23_marked_tracklist",
    r"""WITH l AS (SELECT mix_id, frame_idx, regexp_replace(text, ' view$', ' Transition') AS text, row_number() OVER (PARTITION BY mix_id ORDER BY frame_idx) AS n FROM v_mix_text),
    t AS (SELECT *, regexp_extract(text, '^(\d+):(\d+)\s+(.+)$', 3) AS name FROM l),
    k AS (SELECT *, CASE WHEN lower(name) = 'transition' THEN 'Track_' || n ELSE name END AS to_track FROM t)
    SELECT mix_id, CAST(regexp_extract(text, '^(\d+):', 1) AS BIGINT) * 60 + CAST(regexp_extract(text, ':(\d+) ', 1) AS BIGINT) AS sec, lag(to_track) OVER (PARTITION BY mix_id ORDER BY frame_idx) AS from_track, to_track FROM k QUALIFY n > 1""",
)
def w23_marked(spark, d):
    """Views stand for lines that only mark a change; lists without one are plain."""
    lines = V.mix_text(spark, d).withColumn("text", F.regexp_replace("text", " view$", " Transition"))
    return TL.marked_transitions(lines, "mix_id", "frame_idx")


@query(
    "S7_get_song",
    "SELECT CAST(track_a_id AS VARCHAR) AS doc_id, title, bpm::DOUBLE AS bpm, camelot, genre FROM (SELECT DISTINCT track_a_id FROM v_transitions) LEFT JOIN v_songs ON song_id = track_a_id",
)
def s7_song(spark, d):
    """The documents of all songs written in shelves; those of the songs that transitions start from looked up and opened."""
    s = V.songs(spark, d)
    body = F.to_json(F.struct(F.struct("title").alias("metadata"), F.struct("bpm").alias("tempo"), F.struct("camelot").alias("harmony"), F.struct(F.struct(F.array("genre").alias("genre")).alias("semantic_tags")).alias("embeddings")))
    path = files.scratch_path(spark, "documents")
    files.write_documents(s.select(F.col("song_id").cast("string").alias("doc_id"), body.alias("body")), path, 16)
    asked = V.transitions(spark, d).select(F.col("track_a_id").cast("string").alias("doc_id")).distinct()
    row = files.flatten_song(F.col("body"))
    return files.get_documents(spark, path, 16, asked).select("doc_id", *(row[c].alias(c) for c in ("title", "bpm", "camelot", "genre")))


@query(
    "J18_role_plan",
    """WITH p AS (SELECT pair_id, vocals_a AS va, vocals_b AS vb, energy_a > 1 AS da, energy_b > 1 AS db, energy_a AS ea, energy_b AS eb, vocals_a AND energy_a > 0.5 AS ca, vocals_b AND energy_b > 0.5 AS cb,
        abs(bpm_a - bpm_b) <= 0.06::DOUBLE * greatest(bpm_a, bpm_b) AS near, least(1.0, abs(energy_a - energy_b) / 10)::DOUBLE AS clash, floor(duration_b / 20) AS safe, floor(duration_b / 12) AS phrases FROM v_pairs),
    k AS (SELECT *, unnest([1, 2, 3, 4]) AS k FROM p),
    s AS (SELECT *, CASE WHEN k < 3 THEN 'a' ELSE 'b' END AS bed, CASE WHEN k % 2 = 1 THEN 'a' ELSE 'b' END AS vocal FROM k),
    o AS (SELECT *, round((CASE WHEN bed = 'a' THEN 0.15 ELSE 0.05 END + CASE WHEN vocal = 'b' AND cb THEN 0.25 WHEN vocal = 'a' AND ca THEN 0.15 ELSE 0 END)::DOUBLE - CASE WHEN bed <> vocal THEN 0.3::DOUBLE * clash ELSE 0 END
        + CASE WHEN near THEN 0.2::DOUBLE ELSE -0.2 END + CASE WHEN vocal = 'b' THEN least(safe * 0.02::DOUBLE, 0.2) + least(phrases * 0.01::DOUBLE, 0.1) ELSE 0 END, 9) AS score FROM s WHERE CASE WHEN vocal = 'a' THEN va ELSE vb END),
    b AS (SELECT pair_id, bed, vocal, score FROM o QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, k) = 1)
    SELECT p.pair_id, coalesce(bed, CASE WHEN da AND db THEN CASE WHEN ea <= eb THEN 'a' ELSE 'b' END END) AS bed, coalesce(vocal, CASE WHEN da AND db THEN CASE WHEN ea <= eb THEN 'a' ELSE 'b' END END) AS vocal,
    coalesce(vocal, CASE WHEN da AND db THEN 'a' END) AS tempo, score FROM p LEFT JOIN b USING (pair_id)""",
)
def j18_roles(spark, d):
    """All four plans of bed and vocals; content, clash and phrases follow from energies and lengths."""
    c = F.col
    side = lambda x: {f"drums_{x}": c(f"energy_{x}") > 1, f"drum_energy_{x}": c(f"energy_{x}"), f"content_{x}": c(f"vocals_{x}") & (c(f"energy_{x}") > 0.5), f"tempo_{x}": c(f"bpm_{x}")}
    both = {"clash": F.least(F.lit(1.0), F.abs(c("energy_a") - c("energy_b")) / 10), "safe_points": F.floor(c("duration_b") / 20), "phrases": F.floor(c("duration_b") / 12)}
    return Q.role_plan(V.pairs(spark, d).withColumns(side("a") | side("b") | both))


@query(
    "A34_quality_parts",
    """WITH f AS (SELECT track_id, frame_idx, rms, bass, mid, vocal AS high, 50 * rms AS contrast, least(bass, mid) AS clash, 0.5::DOUBLE * vocal AS tension FROM v_frames),
    g AS (SELECT *, (pow(bass - lag(bass) OVER w, 2) + pow(mid - lag(mid) OVER w, 2) + pow(high - lag(high) OVER w, 2)) / 3 AS flux, abs(rms - lag(rms) OVER w) AS step, stddev_pop(rms) OVER (PARTITION BY track_id) AS sd,
        sum(rms) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10 AS near FROM f WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)),
    e AS (SELECT track_id, coalesce(avg(flux), 0) AS flux, avg((bass * bass + mid * mid + high * high) / 3) AS energy, count(*) FILTER (WHERE step > 0.1) / count(*) AS jumps, avg(clash) AS clash, avg(contrast) AS contrast, avg(tension) AS tension,
        avg(bass * bass) AS b, avg(mid * mid) AS m, avg(high * high) AS h, coalesce(count(*) FILTER (WHERE round(step, 9) > round(sd, 9)) / nullif(count(step), 0), 0) AS large, stddev_pop(rms - near) AS off, avg(rms) AS level FROM g GROUP BY track_id),
    p AS (SELECT track_id, 0.7 * (1 - least(1, flux / (energy + 1e-10))) + 0.3 * greatest(0, 1 - 10 * jumps) AS smoothness, 0.6 * (1 - clash) + 0.4 * greatest(0, least(1, contrast / 40)) AS clarity, 1 - tension AS harmony,
        greatest(0, least(1, 1 - (abs(coalesce(b / nullif(b + m + h, 0), 0.33) - 0.3) + abs(coalesce(m / nullif(b + m + h, 0), 0.33) - 0.4) + abs(coalesce(h / nullif(b + m + h, 0), 0.33) - 0.3)) / 3)) AS balance,
        0.6 * greatest(0, 1 - 5 * large) + 0.4 * greatest(0, least(1, 1 - off / (level + 1e-10))) AS continuity FROM e)
    SELECT track_id, round(smoothness, 6) AS smoothness, round(clarity, 6) AS clarity, round(harmony, 6) AS harmony, round(balance, 6) AS balance, round(continuity, 6) AS continuity,
    round(0.3 * smoothness + 0.25 * clarity + 0.2 * harmony + 0.15 * balance + 0.1 * continuity, 6) AS score FROM p""",
)
def a34_parts(spark, d):
    """All five parts from frames; vocals stand for the highs and for tension, the level for contrast."""
    c = F.col
    f = V.frames(spark, d).withColumns({"high": c("vocal"), "contrast": 50 * c("rms"), "clash": F.least("bass", "mid"), "tension": 0.5 * c("vocal")})
    q = Q.mix_quality(f)
    return q.select("track_id", *(r6(k).alias(k) for k in q.columns[1:]))
