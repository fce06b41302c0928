"""Queries on candidate operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import timecode as T
from ..operators import candidates as C
from ..operators import intervals as I
from ..views import view, with_views

KEY = ["recording_id"]


def on_segments(spark, sf):
    """Candidates moved to the recordings of the segments view: a third of the conversations' axis."""
    c = view(spark, sf, "candidates")
    s = view(spark, sf, "segments")
    n = s.select(F.max("recording_id")).first()[0] + 1
    short = (F.col("start_ms") / 12).cast("long")
    return c.select((F.col("recording_id") % n).alias("recording_id"), "cand_idx", short.alias("start_ms"), (short + (F.col("end_ms") - F.col("start_ms")) / 4).cast("long").alias("end_ms")), s


def snap_to_boundaries(spark, sf):
    c, s = on_segments(spark, sf)
    return C.snap(c, s, KEY, ["cand_idx"])


def enforce_duration(spark, sf):
    c, s = on_segments(spark, sf)
    return C.enforce_duration(c, s, KEY, ["cand_idx"], 6000, 15000)


def clamp_to_end(spark, sf):
    c, s = on_segments(spark, sf)
    return C.clamp_to_end(c, s, KEY, 500)


def select_candidates(spark, sf):
    return C.select_candidates(view(spark, sf, "candidates"), KEY, "cand_idx")


def dedupe_candidates(spark, sf):
    c = view(spark, sf, "candidates").withColumns({"start_ms": F.expr("start_ms div 60000 * 60000"), "end_ms": F.expr("end_ms div 60000 * 60000")})
    return C.dedupe(c, KEY, "cand_idx")


def window_candidates(spark, sf):
    return C.window_filter(view(spark, sf, "candidates"), F.lit(60_000), F.lit(300_000))


def candidate_stats(spark, sf):
    return C.candidate_stats(view(spark, sf, "candidates"), KEY)


def extract_json(spark, sf):
    c = C.extract_candidates(view(spark, sf, "llm_answers"), ["answer_id"])
    ms = lambda x: F.bround(F.col(x) * 1000).cast("long")
    return c.select("answer_id", "position", ms("start").alias("start_ms"), ms("end").alias("end_ms"), "title", F.bround(F.col("score") * 10).cast("long").alias("score_tenths"))


def parse_llm_candidates(spark, sf):
    s = view(spark, sf, "segments")
    n = s.select(F.max("recording_id")).first()[0] + 1
    a = view(spark, sf, "llm_answers").withColumn("recording_id", F.col("recording_id") % n)
    return C.parse_llm_candidates(a, s, KEY).select("recording_id", "answer_id", "position", "start_ms", "end_ms", "changed")


def greedy_match(spark, sf):
    c = view(spark, sf, "candidates")
    left = c.filter("cand_idx % 2 = 0").select(*KEY, F.col("cand_idx").alias("i"), "start_ms", "end_ms")
    right = c.filter("cand_idx % 2 = 1").select(*KEY, F.col("cand_idx").alias("j"), F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"))
    return C.greedy_match(left, right, KEY)


def eval_models(spark, sf):
    """Even candidates against odd ones as baseline; some recordings lack a transcript or a baseline, or have another model's."""
    c = view(spark, sf, "candidates").withColumn("pos", F.col("cand_idx"))
    k = F.col("recording_id")
    cases = c.select(*KEY).distinct().select(*KEY, (k % 11 > 0).alias("has_transcript"), F.when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, "other").otherwise("base").alias("base_model"))
    e = C.eval_models(cases, c.filter("cand_idx % 2 = 0"), c.filter("cand_idx % 2 = 1"), KEY, "base")
    return e.withColumns({r: F.bround(r, 6) for r in C.RATES})


def eval_summary(spark, sf):
    s = C.eval_summary(eval_models(spark, sf))
    return s.select("total_cases", "ok_cases", *(F.bround(r, 4).alias(r) for r in C.RATES))


def union_chunk_candidates(spark, sf):
    a = C.extract_candidates(view(spark, sf, "llm_answers"), [*KEY, "answer_id"]).withColumnRenamed("answer_id", "chunk_idx")
    return C.union_chunk_candidates([a.filter("chunk_idx % 3 = 0"), a.filter("chunk_idx % 3 > 0")], KEY).select(*KEY, "chunk_idx", "pos", F.bround(F.col("start") * 1000).cast("long").alias("start_ms"))


def fallback_windows(spark, sf):
    s = view(spark, sf, "segments")
    return C.fallback_windows(I.pause_groups(s, KEY, 2400), KEY, 12, target=20_000, least=5_000, longest=40_000).select("recording_id", "start_ms", "end_ms", "score_milli")


def fill_candidates(spark, sf):
    c = view(spark, sf, "candidates").withColumn("pos", F.row_number().over(W.partitionBy("recording_id").orderBy("cand_idx")))
    return C.fill_candidates(c.filter("cand_idx % 3 = 0"), c.filter("cand_idx % 3 > 0"), KEY, 6)


def chunk_transcript(spark, sf):
    return C.chunk_transcript(view(spark, sf, "segments"), KEY, 1200, 1)


def render_prompts(spark, sf):
    s = view(spark, sf, "segments")
    p = C.render_prompts(C.chunk_transcript(s, KEY, 1200, 1), s, KEY, "Up to {max_time}:\n{transcript}")
    return p.select("recording_id", "chunk_idx", F.length("prompt").alias("n_chars"), F.md5(F.col("prompt").cast("binary")).alias("digest"))


def normalize_candidate_rows(spark, sf):
    c = view(spark, sf, "candidates").select(*KEY, "cand_idx", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000 - F.col("cand_idx") % 40).alias("end"))
    return C.normalize_rows(c, KEY, "cand_idx", 4).select(*KEY, "cand_idx", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def mmss_number_to_seconds(spark, sf):
    c = view(spark, sf, "candidates").select("cand_idx", (F.col("cand_idx") % 20 + F.col("cand_idx") % 70 / 100).alias("v"))
    s = T.mmss_number_to_seconds(F.col("v"), F.lit(600.0), F.lit(1200.0))
    return c.select("cand_idx", F.bround(s * 100).cast("long").alias("hundredths"))


QUERIES = {f.__name__: f for f in (snap_to_boundaries, enforce_duration, clamp_to_end, select_candidates, dedupe_candidates, window_candidates, candidate_stats, extract_json, parse_llm_candidates, greedy_match, eval_models, eval_summary, union_chunk_candidates, fallback_windows, fill_candidates, chunk_transcript, render_prompts, normalize_candidate_rows, mmss_number_to_seconds)}

_C = with_views("candidates")
_ON = with_views("candidates", "segments") + """, n AS (SELECT max(recording_id) + 1 AS n FROM segments),
 c AS (SELECT recording_id % n AS recording_id, cand_idx, CAST(floor(start_ms / 12) AS BIGINT) AS start_ms, CAST(floor(floor(start_ms / 12) + (end_ms - start_ms) / 4) AS BIGINT) AS end_ms FROM candidates, n)"""
_NEAR = "(SELECT arg_min({v}, (abs({v} - {t}), {v})) FROM segments s WHERE s.recording_id = c.recording_id{w})"
_RANK = """rk AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY score_milli * 45000 - 80 * abs(end_ms - start_ms - 45000) DESC, score_milli DESC, cand_idx) AS rn FROM candidates),
 st AS (SELECT DISTINCT recording_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(i BIGINT, s BIGINT, e BIGINT)[]) AS kept FROM candidates
  UNION ALL SELECT st.recording_id, st.n + 1, CASE WHEN len(kept) < 6 AND len(list_filter(kept, lambda k: greatest(0, least(k.e, rk.end_ms) - greatest(k.s, rk.start_ms)) * 10 >= 8 * least(k.e - k.s, rk.end_ms - rk.start_ms))) = 0
    THEN list_append(kept, {'i': rk.cand_idx, 's': rk.start_ms, 'e': rk.end_ms}) ELSE kept END FROM st JOIN rk ON rk.recording_id = st.recording_id AND rk.rn = st.n + 1),
 fin AS (SELECT recording_id, unnest(kept) AS k FROM st QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY n DESC) = 1)"""
_MATCH = """p AS (SELECT a.recording_id, a.cand_idx AS i, b.cand_idx AS j, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS overlap_ms, abs(a.start_ms - b.start_ms) AS start_error_ms, abs(a.end_ms - b.end_ms) AS end_error_ms, greatest(a.end_ms, b.end_ms) - least(a.start_ms, b.start_ms) AS union_ms
   FROM candidates a JOIN candidates b ON a.recording_id = b.recording_id AND a.cand_idx % 2 = 0 AND b.cand_idx % 2 = 1 AND a.end_ms > b.start_ms AND a.start_ms < b.end_ms),
 rk AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY overlap_ms DESC, i DESC, j DESC) AS rn FROM p),
 st AS (SELECT DISTINCT recording_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS ui, CAST([] AS BIGINT[]) AS uj, CAST([] AS BIGINT[]) AS keep FROM p
  UNION ALL SELECT st.recording_id, st.n + 1, CASE WHEN list_contains(ui, rk.i) OR list_contains(uj, rk.j) THEN ui ELSE list_append(ui, rk.i) END, CASE WHEN list_contains(ui, rk.i) OR list_contains(uj, rk.j) THEN uj ELSE list_append(uj, rk.j) END, CASE WHEN list_contains(ui, rk.i) OR list_contains(uj, rk.j) THEN keep ELSE list_append(keep, rk.rn) END FROM st JOIN rk ON rk.recording_id = st.recording_id AND rk.rn = st.n + 1),
 fin AS (SELECT recording_id, unnest(keep) AS rn FROM st QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY n DESC) = 1),
 mt AS (SELECT rk.* EXCLUDE (rn) FROM rk JOIN fin ON fin.recording_id = rk.recording_id AND fin.rn = rk.rn)"""
_CASES = """ca AS (SELECT DISTINCT recording_id, CASE WHEN recording_id % 11 = 0 THEN 'missing_transcript' WHEN recording_id % 13 = 0 THEN 'missing_baseline' WHEN recording_id % 17 = 0 THEN 'other_baseline' ELSE 'ok' END AS status,
   CASE WHEN recording_id % 13 = 0 THEN NULL WHEN recording_id % 17 = 0 THEN 'other' ELSE 'base' END AS base_model FROM candidates)"""
# The baseline is the first set of the match, the model's candidates the second.
_EVAL = _MATCH.replace("a.cand_idx % 2 = 0 AND b.cand_idx % 2 = 1", "a.cand_idx % 2 = 1 AND b.cand_idx % 2 = 0") + "," + _CASES + """,
 b AS (SELECT recording_id, count(*) AS n, CAST(sum(greatest(0, end_ms - start_ms)) AS BIGINT) AS d FROM candidates WHERE cand_idx % 2 = 1 GROUP BY ALL), m AS (SELECT recording_id, count(*) AS n, CAST(sum(greatest(0, end_ms - start_ms)) AS BIGINT) AS d FROM candidates WHERE cand_idx % 2 = 0 GROUP BY ALL),
 k AS (SELECT recording_id, count(*) AS n, CAST(sum(overlap_ms) AS BIGINT) AS o, avg(overlap_ms / union_ms) AS iou, avg(start_error_ms) AS se, avg(end_error_ms) AS ee, count(*) FILTER (start_error_ms <= 5000 AND end_error_ms <= 5000) AS c FROM mt GROUP BY ALL),
 ev0 AS (SELECT ca.recording_id, base_model, status, status = 'ok' AS ok, coalesce(b.n, 0) AS bn, coalesce(m.n, 0) AS mn, coalesce(b.d, 0) AS bd, coalesce(m.d, 0) AS md, coalesce(k.n, 0) AS kn, coalesce(o, 0) AS o, coalesce(iou, 0) AS iou, coalesce(se, 0) AS se, coalesce(ee, 0) AS ee, coalesce(c, 0) AS c
  FROM ca LEFT JOIN b ON b.recording_id = ca.recording_id LEFT JOIN m ON m.recording_id = ca.recording_id LEFT JOIN k ON k.recording_id = ca.recording_id),
 ev AS (SELECT recording_id, base_model, status, CASE WHEN ok THEN bn END AS n_base, CASE WHEN ok THEN mn END AS n_model, CASE WHEN ok THEN bd END AS base_ms, CASE WHEN ok THEN md END AS model_ms, CASE WHEN ok THEN kn END AS matched, CASE WHEN ok THEN o END AS overlap_ms, CASE WHEN ok THEN c END AS n_close,
   CASE WHEN ok THEN round_even(iou, 6) END AS avg_iou, CASE WHEN ok THEN round_even(se, 6) END AS avg_start_error_ms, CASE WHEN ok THEN round_even(ee, 6) END AS avg_end_error_ms, CASE WHEN ok THEN round_even(CASE WHEN bn > 0 THEN kn / bn ELSE 0 END, 6) END AS base_rate, CASE WHEN ok THEN round_even(CASE WHEN mn > 0 THEN kn / mn ELSE 0 END, 6) END AS model_rate,
   CASE WHEN ok THEN round_even(CASE WHEN kn > 0 THEN c / kn ELSE 0 END, 6) END AS close_share, CASE WHEN ok THEN round_even(CASE WHEN bd > 0 THEN o / bd ELSE 0 END, 6) END AS base_covered, CASE WHEN ok THEN round_even(CASE WHEN md > 0 THEN o / md ELSE 0 END, 6) END AS model_covered FROM ev0)"""
_CHUNKS = """z AS (SELECT *, 30 + length(text) + 1 AS sz, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) AS rn FROM segments),
      f AS (SELECT recording_id, rn, CAST(0 AS BIGINT) AS chunk, CAST(sz AS BIGINT) AS used, false AS rep FROM z WHERE rn = 1
        UNION ALL SELECT z.recording_id, z.rn, CASE WHEN f.used + z.sz > 1200 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.used + z.sz > 1200 THEN p.sz + z.sz ELSE f.used + z.sz END, f.used + z.sz > 1200 FROM f JOIN z ON z.recording_id = f.recording_id AND z.rn = f.rn + 1 JOIN z p ON p.recording_id = f.recording_id AND p.rn = f.rn),
      o AS (SELECT recording_id, rn, chunk FROM f UNION ALL SELECT recording_id, rn - 1, chunk FROM f WHERE rep)"""
_STAMP = "lpad(CAST({t} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({t} % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({t} % 60000 // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST({t} % 1000 AS VARCHAR), 3, '0')"
SQL = {
    "snap_to_boundaries": _ON + f", z AS (SELECT recording_id, cand_idx, {_NEAR.format(v='s.start_ms', t='c.start_ms', w='')} AS a, {_NEAR.format(v='s.end_ms', t='c.end_ms', w='')} AS b FROM c) SELECT recording_id, cand_idx, a AS start_ms, CASE WHEN b <= a THEN coalesce((SELECT min(s.end_ms) FROM segments s WHERE s.recording_id = z.recording_id AND s.end_ms > z.a), b) ELSE b END AS end_ms FROM z WHERE a IS NOT NULL",
    "enforce_duration": _ON + f""", z AS (SELECT *, (SELECT min(s.end_ms) FROM segments s WHERE s.recording_id = c.recording_id AND s.end_ms >= c.start_ms + 6000) AS g, {_NEAR.format(v='s.end_ms', t='(c.start_ms + 15000)', w=' AND s.end_ms > c.start_ms')} AS x FROM c WHERE recording_id IN (SELECT recording_id FROM segments)),
      y AS (SELECT recording_id, cand_idx, start_ms, CASE WHEN end_ms - start_ms < 6000 THEN CASE WHEN g - start_ms <= 18750 THEN g END WHEN end_ms - start_ms > 18750 THEN CASE WHEN x - start_ms <= 18750 THEN x END ELSE end_ms END AS end_ms, end_ms - start_ms < 6000 OR end_ms - start_ms > 18750 AS changed FROM z) SELECT * FROM y WHERE end_ms > start_ms""",
    "clamp_to_end": _ON + ", l AS (SELECT recording_id, max(end_ms) AS m FROM segments GROUP BY ALL) SELECT c.recording_id, cand_idx, start_ms, least(end_ms, m) AS end_ms FROM c JOIN l ON l.recording_id = c.recording_id WHERE end_ms <= m + 500 AND least(end_ms, m) > start_ms",
    "select_candidates": _C + "," + _RANK + " SELECT f.recording_id, c.cand_idx, c.start_ms, c.end_ms, c.score_milli FROM fin f JOIN candidates c ON c.recording_id = f.recording_id AND c.cand_idx = f.k.i",
    "dedupe_candidates": _C + ", d AS (SELECT recording_id, cand_idx, start_ms // 60000 * 60000 AS start_ms, end_ms // 60000 * 60000 AS end_ms, score_milli FROM candidates) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY recording_id, start_ms, end_ms ORDER BY cand_idx) = 1",
    "window_candidates": _C + " SELECT * FROM candidates WHERE start_ms >= 60000 AND end_ms <= 300000",
    "candidate_stats": _C + " SELECT recording_id, count(*) AS n, CAST(sum(greatest(0, end_ms - start_ms)) AS BIGINT) AS total_ms, min(greatest(0, end_ms - start_ms)) AS min_ms, max(greatest(0, end_ms - start_ms)) AS max_ms FROM candidates GROUP BY recording_id",
    "extract_json": with_views("llm_answers") + """ SELECT answer_id, 0 AS position, CASE answer_id % 4 WHEN 0 THEN (answer_id * 37) % 600 * 1000 ELSE (answer_id % 10) * 60000 + 10500 END AS start_ms, CASE answer_id % 4 WHEN 0 THEN ((answer_id * 37) % 600 + 30) * 1000 ELSE (answer_id % 10) * 60000 + 50000 END AS end_ms,
      CASE answer_id % 4 WHEN 0 THEN 't' END AS title, CAST(CASE answer_id % 4 WHEN 0 THEN 5 ELSE 7 END AS BIGINT) AS score_tenths FROM llm_answers WHERE answer_id % 4 < 2""",
    "normalize_candidate_rows": _C + ", c AS (SELECT recording_id, cand_idx, start_ms // 1000 AS start, end_ms // 1000 - cand_idx % 40 AS \"end\" FROM candidates) SELECT * FROM c WHERE \"end\" > start + 4 QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY cand_idx) <= 4",
    "mmss_number_to_seconds": _C + " SELECT cand_idx, CASE WHEN cand_idx % 70 < 60 AND (cand_idx % 20) * 60 + cand_idx % 70 BETWEEN 420 AND 1380 THEN ((cand_idx % 20) * 60 + cand_idx % 70) * 100 ELSE (cand_idx % 20) * 100 + cand_idx % 70 END AS hundredths FROM candidates",
    "greedy_match": _C + "," + _MATCH + " SELECT * FROM mt",
    "eval_models": _C + "," + _EVAL + " SELECT * FROM ev",
    "eval_summary": _C + "," + _EVAL + " SELECT count(*) AS total_cases, count(*) FILTER (status = 'ok') AS ok_cases, " + ", ".join(f"round_even(coalesce(avg({r}) FILTER (status = 'ok'), 0.0), 4) AS {r}" for r in C.RATES) + " FROM ev",
    "union_chunk_candidates": with_views("llm_answers") + " SELECT recording_id, answer_id AS chunk_idx, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY answer_id) - 1 AS INTEGER) AS pos, CASE answer_id % 4 WHEN 0 THEN (answer_id * 37) % 600 * 1000 ELSE (answer_id % 10) * 60000 + 10500 END AS start_ms FROM llm_answers WHERE answer_id % 4 < 2",
    "parse_llm_candidates": with_views("llm_answers", "segments") + f""", n AS (SELECT max(recording_id) + 1 AS n FROM segments),
      c AS (SELECT recording_id % n AS recording_id, answer_id, CASE answer_id % 4 WHEN 0 THEN (answer_id * 37) % 600 * 1000 ELSE (answer_id % 10) * 60000 + 10500 END AS start_ms, CASE answer_id % 4 WHEN 0 THEN ((answer_id * 37) % 600 + 30) * 1000 ELSE (answer_id % 10) * 60000 + 50000 END AS end_ms FROM llm_answers, n WHERE answer_id % 4 < 2),
      z AS (SELECT recording_id, answer_id, {_NEAR.format(v='s.start_ms', t='c.start_ms', w='')} AS a, {_NEAR.format(v='s.end_ms', t='c.end_ms', w='')} AS b FROM c),
      s1 AS (SELECT recording_id, answer_id, a AS start_ms, CASE WHEN b <= a THEN coalesce((SELECT min(s.end_ms) FROM segments s WHERE s.recording_id = z.recording_id AND s.end_ms > z.a), b) ELSE b END AS end_ms FROM z WHERE a IS NOT NULL),
      s2 AS (SELECT *, (SELECT min(s.end_ms) FROM segments s WHERE s.recording_id = c.recording_id AND s.end_ms >= c.start_ms + 16000) AS g, {_NEAR.format(v='s.end_ms', t='(c.start_ms + 70000)', w=' AND s.end_ms > c.start_ms')} AS x FROM s1 c WHERE end_ms > start_ms),
      s3 AS (SELECT recording_id, answer_id, start_ms, CASE WHEN end_ms - start_ms < 16000 THEN CASE WHEN g - start_ms <= 87500 THEN g END WHEN end_ms - start_ms > 87500 THEN CASE WHEN x - start_ms <= 87500 THEN x END ELSE end_ms END AS end_ms, end_ms - start_ms < 16000 OR end_ms - start_ms > 87500 AS changed FROM s2),
      l AS (SELECT recording_id, max(end_ms) AS m FROM segments GROUP BY ALL)
      SELECT s3.recording_id, answer_id, 0 AS position, start_ms, least(end_ms, m) AS end_ms, changed FROM s3 JOIN l ON l.recording_id = s3.recording_id WHERE end_ms > start_ms AND end_ms <= m + 500 AND least(end_ms, m) > start_ms""",
    "fallback_windows": with_views("segments") + """, f AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms) > 2400 THEN 1 ELSE 0 END AS nw FROM segments), g AS (SELECT *, sum(nw) OVER (PARTITION BY recording_id ORDER BY start_ms) AS grp FROM f),
      q AS (SELECT recording_id, grp, list(start_ms ORDER BY start_ms, end_ms) AS s, list(end_ms ORDER BY start_ms, end_ms) AS e FROM g WHERE trim(text) <> '' AND end_ms > start_ms GROUP BY ALL),
      t AS (SELECT recording_id, grp, s, e, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM q
        UNION ALL SELECT recording_id, grp, s, e, j + 1, s[i], CASE WHEN e[j] - s[i] >= 5000 THEN e[j] END
        FROM (SELECT *, CASE WHEN ext IS NULL THEN j0 ELSE ext END AS j FROM (SELECT *, j0 + len(list_filter(range(j0 + 1, len(s) + 1), lambda x: len(list_filter(range(j0, x), lambda y: NOT (e[y] - s[i] < 5000 AND e[y + 1] - s[i] <= 40000))) = 0)) AS ext
          FROM (SELECT *, i + len(list_filter(range(i + 1, len(s) + 1), lambda x: len(list_filter(range(i + 1, x + 1), lambda y: NOT (e[y] - s[i] <= 20000))) = 0)) AS j0 FROM t WHERE i <= len(s))))),
      w AS (SELECT recording_id, a AS s, b AS e, abs(b - a - 20000) AS away, row_number() OVER (PARTITION BY recording_id ORDER BY abs(b - a - 20000), a) AS rn FROM t WHERE b IS NOT NULL AND i > 1),
      st AS (SELECT DISTINCT recording_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(s BIGINT, e BIGINT, w BIGINT)[]) AS kept FROM w
        UNION ALL SELECT st.recording_id, st.n + 1, CASE WHEN len(kept) < 12 AND len(list_filter(kept, lambda k: NOT (w.e <= k.s + 1000 OR w.s >= k.e - 1000))) = 0 THEN list_append(kept, {'s': w.s, 'e': w.e, 'w': w.away}) ELSE kept END FROM st JOIN w ON w.recording_id = st.recording_id AND w.rn = st.n + 1),
      fin AS (SELECT recording_id, unnest(kept) AS k FROM st QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY n DESC) = 1)
      SELECT recording_id, k.s AS start_ms, k.e AS end_ms, CAST(round_even(1000 / (1 + k.w / 1000), 0) AS BIGINT) AS score_milli FROM fin""",
    "fill_candidates": _C + """, c AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY cand_idx) AS pos FROM candidates), b AS (SELECT recording_id, pos, start_ms AS s, end_ms AS e, cand_idx % 3 > 0 AS fb FROM c),
      m AS (SELECT recording_id, list({'p': pos, 's': s, 'e': e, 'k': 0} ORDER BY pos)[1 : 6] AS own FROM b WHERE NOT fb GROUP BY ALL),
      x AS (SELECT recording_id, pos, s, e, row_number() OVER (PARTITION BY recording_id ORDER BY pos) AS rn, count(*) OVER (PARTITION BY recording_id) AS n FROM b WHERE fb),
      ids AS (SELECT DISTINCT recording_id FROM b),
      st AS (SELECT ids.recording_id, CAST(0 AS BIGINT) AS i, CAST(coalesce(own, []) AS STRUCT(p BIGINT, s BIGINT, e BIGINT, k INTEGER)[]) AS own FROM ids LEFT JOIN m ON m.recording_id = ids.recording_id
        UNION ALL SELECT st.recording_id, i + 1, CASE WHEN len(own) >= 6 THEN own
            WHEN i < n AND len(list_filter(own, lambda o: NOT (x.e <= o.s + 1000 OR x.s >= o.e - 1000))) = 0 THEN own || [{'p': x.pos, 's': x.s, 'e': x.e, 'k': 1}]
            WHEN i >= n AND len(list_filter(own, lambda o: o.s = x.s AND o.e = x.e)) = 0 THEN own || [{'p': x.pos, 's': x.s, 'e': x.e, 'k': 1}] ELSE own END
          FROM st JOIN x ON x.recording_id = st.recording_id AND x.rn = i % n + 1 WHERE i < 2 * n),
      fin AS (SELECT recording_id, own FROM st QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY i DESC) = 1),
      o AS (SELECT recording_id, unnest(range(1, len(own) + 1)) AS rank, own FROM fin)
      SELECT recording_id, own[rank].p AS pos, own[rank].s AS start_ms, own[rank].e AS end_ms, own[rank].k AS from_fallback, rank FROM o""",
    "render_prompts": with_views("segments") + ", " + _CHUNKS + """, r AS (SELECT o.recording_id, o.chunk AS chunk_idx, z.seg_idx, '[' || """ + _STAMP.format(t="start_ms") + """ || ' - ' || """ + _STAMP.format(t="end_ms") + """ || '] ' || text AS line, end_ms FROM o JOIN z ON z.recording_id = o.recording_id AND z.rn = o.rn),
      p AS (SELECT recording_id, chunk_idx, 'Up to ' || """ + _STAMP.format(t="max(end_ms)") + """ || ':' || chr(10) || array_to_string(list(line ORDER BY seg_idx), chr(10)) AS p FROM r GROUP BY ALL) SELECT recording_id, chunk_idx, CAST(length(p) AS INTEGER) AS n_chars, md5(p) AS digest FROM p""",
    "chunk_transcript": with_views("segments") + ", " + _CHUNKS + " SELECT o.recording_id, z.seg_idx, o.chunk AS chunk_idx FROM o JOIN z ON z.recording_id = o.recording_id AND z.rn = o.rn",
}
