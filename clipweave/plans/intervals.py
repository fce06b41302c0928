"""Queries on interval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..views import view, with_views

KEY = ["recording_id"]
DAY0, DAY30 = 1704067200000, 1704067200000 + 30 * 86_400_000


def segment_bounds(segments: DataFrame) -> DataFrame:
    """From 0 to two seconds past the last segment of each recording."""
    return segments.groupBy("recording_id").agg(F.lit(0).cast("long").alias("lo"), (F.max("end_ms") + 2000).alias("hi"))


def fixed_bounds(df: DataFrame, lo: int, hi: int) -> DataFrame:
    return df.select("recording_id").distinct().select("recording_id", F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))


def speech_intervals(spark, sf):
    s = view(spark, sf, "segments")
    return I.speech_intervals(s, KEY, F.lit(3000), F.lit(40000), 500, 600)


def pause_cuts(spark, sf):
    s = view(spark, sf, "segments")
    return I.pause_cuts(s, segment_bounds(s), KEY, "medium")


def pause_summary(spark, sf):
    s = view(spark, sf, "segments")
    b = segment_bounds(s)
    return I.pause_summary(I.pause_cuts(s, b, KEY, "medium"), b, KEY)


def merge_intervals(spark, sf):
    return I.merge_intervals(view(spark, sf, "intervals"), KEY, gap=60_000)


def complement(spark, sf):
    v = view(spark, sf, "intervals")
    return I.complement(I.merge_intervals(v, KEY), fixed_bounds(v, DAY0, DAY30), KEY, least=3_600_000)


def overlap_join(spark, sf):
    v = view(spark, sf, "intervals")
    left = v.filter("interval_id % 3 = 0").select("recording_id", "interval_id", "start_ms", "end_ms")
    right = v.filter("interval_id % 3 <> 0").select("recording_id", F.col("interval_id").alias("r_id"), F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"))
    return I.overlap_join(left, right, KEY, width=4 * 3_600_000).select("recording_id", "interval_id", "r_id", "clip_start_ms", "clip_end_ms", "overlap_ms")


def subtract_intervals(spark, sf):
    v = view(spark, sf, "intervals")
    cuts = I.merge_intervals(v.filter("interval_id % 3 <> 0"), KEY)
    return I.subtract_intervals(v.filter("interval_id % 3 = 0"), cuts, KEY, ["interval_id"], least=60_000, width=4 * 3_600_000)


def removed_before(spark, sf):
    v = view(spark, sf, "intervals")
    cuts = I.merge_intervals(v.filter("interval_id % 3 <> 0"), KEY)
    points = v.filter("interval_id % 3 = 0").select("recording_id", "interval_id", F.col("start_ms").alias("t_ms"))
    return I.removed_before(points, cuts, KEY)


def coalesce_shots(spark, sf):
    s = view(spark, sf, "segments").select("recording_id", F.col("speaker").alias("camera"), F.when(F.col("seg_idx") % 4 == 0, F.lit(None)).otherwise(F.lit("user")).alias("audio_camera"), "start_ms", "end_ms")
    return I.coalesce_shots(s, KEY, eps=600)


def loudest(levels: DataFrame) -> DataFrame:
    """The loudest camera per hop, the first by name of equals."""
    return levels.groupBy("recording_id", F.col("hop_idx").alias("step")).agg(F.min_by("camera", F.struct(-F.col("level"), F.col("camera"))).alias("camera"))


def run_length_shots(spark, sf):
    return I.run_length_shots(loudest(view(spark, sf, "levels")), KEY, 3_600_000, F.lit(720 * 3_600_000))


def covers_range(spark, sf):
    v = view(spark, sf, "intervals")
    b = v.groupBy("recording_id").agg(F.min("start_ms").alias("lo"), F.max("end_ms").alias("hi"))
    return I.covers_range(v, b, KEY, tolerance=4 * 3_600_000)


def pause_groups(spark, sf):
    return I.pause_groups(view(spark, sf, "segments"), KEY, gap=1500).select("recording_id", "seg_idx", "group_idx")


def silence_intervals(spark, sf):
    return I.silence_intervals(view(spark, sf, "levels"), ["recording_id", "camera"], F.lit(20000), 3_600_000, 2 * 3_600_000)


def batch_windows(spark, sf):
    s = view(spark, sf, "segments")
    return I.windows(segment_bounds(s), KEY, 10_000, 10_000, least_last=800)


def offset_windows(spark, sf):
    s = view(spark, sf, "segments")
    return I.windows(segment_bounds(s), KEY, 12_000, 5_000).filter("end_ms - start_ms = 12000")


def best_speech_window(spark, sf):
    s = view(spark, sf, "segments")
    speech = I.merge_intervals(s, KEY)
    return I.best_speech_window(speech, segment_bounds(s), KEY, 15_000, 1_000)


QUERIES = {f.__name__: f for f in (pause_summary, speech_intervals, pause_cuts, merge_intervals, complement, overlap_join, subtract_intervals, removed_before, coalesce_shots, run_length_shots, covers_range, pause_groups, silence_intervals, batch_windows, offset_windows, best_speech_window)}

# SQL: each merge keeps an interval start that no other interval reaches, and ends it before the next such start.
_MERGE = """
{n}_s AS (SELECT DISTINCT recording_id, start_ms FROM {t} a WHERE end_ms > start_ms AND NOT EXISTS (SELECT 1 FROM {t} b WHERE b.recording_id = a.recording_id AND b.end_ms > b.start_ms AND b.start_ms < a.start_ms AND b.end_ms + {gap} >= a.start_ms)),
{n}_n AS (SELECT recording_id, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY recording_id ORDER BY start_ms), 9000000000000000) AS nxt FROM {n}_s),
{n} AS (SELECT s.recording_id, s.start_ms, max(x.end_ms) AS end_ms FROM {n}_n s JOIN {t} x ON x.recording_id = s.recording_id AND x.start_ms >= s.start_ms AND x.start_ms < s.nxt AND x.end_ms > x.start_ms GROUP BY s.recording_id, s.start_ms)"""


def _merge(t: str, n: str, gap: int = 0) -> str:
    return _MERGE.format(t=t, n=n, gap=gap)


_GAPS = """
{n}_p AS (SELECT recording_id, end_ms AS a, lead(start_ms) OVER (PARTITION BY recording_id ORDER BY start_ms) AS b FROM {t}
  UNION ALL SELECT b.recording_id, b.lo, min(t.start_ms) FROM {bounds} b JOIN {t} t ON t.recording_id = b.recording_id GROUP BY b.recording_id, b.lo
  UNION ALL SELECT b.recording_id, max(t.end_ms), b.hi FROM {bounds} b JOIN {t} t ON t.recording_id = b.recording_id GROUP BY b.recording_id, b.hi),
{n} AS (SELECT DISTINCT recording_id, a AS start_ms, b AS end_ms FROM {n}_p WHERE b > a)"""
_SB = "b AS (SELECT recording_id, CAST(0 AS BIGINT) AS lo, max(end_ms) + 2000 AS hi FROM segments GROUP BY recording_id)"
_CUTS = (
    with_views("segments") + ",\n" + _SB + ", sp AS (SELECT s.recording_id, greatest(lo, start_ms) AS start_ms, least(hi, end_ms) AS end_ms FROM segments s JOIN b ON b.recording_id = s.recording_id WHERE trim(text) <> '' AND end_ms - start_ms >= 90)," + _merge("sp", "m", 120) + "," + _GAPS.format(n="g", t="m", bounds="b")
    + ", k AS (SELECT *, end_ms - start_ms AS d FROM g WHERE end_ms - start_ms >= 380), c AS (SELECT recording_id, start_ms, end_ms, d - least(greatest(160, least(340, d * 55 // 100)), d) AS cut FROM k), cuts AS (SELECT recording_id, start_ms + cut // 2 AS start_ms, end_ms - cut // 2 AS end_ms FROM c WHERE cut >= 30 AND (end_ms - cut // 2) - (start_ms + cut // 2) >= 30)"
)
_A = "a AS (SELECT * FROM intervals WHERE interval_id % 3 = 0), o AS (SELECT * FROM intervals WHERE interval_id % 3 <> 0)"
_WIN = "w AS (SELECT recording_id, i AS window_idx, lo + i * {step} AS start_ms, least(hi, lo + i * {step} + {length}) AS end_ms FROM b, LATERAL (SELECT unnest(range(0, CAST(ceil((hi - lo) / {step}.0) AS BIGINT))) AS i))"
SQL = {
    "speech_intervals": with_views("segments") + ", sp AS (SELECT recording_id, greatest(3000, start_ms) AS start_ms, least(40000, end_ms) AS end_ms FROM segments WHERE trim(text) <> ''), sq AS (SELECT * FROM sp WHERE end_ms - start_ms >= 500)," + _merge("sq", "m", 600) + " SELECT * FROM m",
    "pause_cuts": _CUTS + " SELECT * FROM cuts",
    "pause_summary": _CUTS + " SELECT b.recording_id, count(c.start_ms) AS n_cuts, CAST(coalesce(sum(c.end_ms - c.start_ms), 0) AS BIGINT) AS removed_ms, CAST(b.hi - b.lo - coalesce(sum(c.end_ms - c.start_ms), 0) AS BIGINT) AS output_ms FROM b LEFT JOIN cuts c ON c.recording_id = b.recording_id GROUP BY b.recording_id, b.lo, b.hi",
    "merge_intervals": with_views("intervals") + "," + _merge("intervals", "m", 60000) + " SELECT * FROM m",
    "complement": with_views("intervals") + "," + _merge("intervals", "m") + f", b AS (SELECT DISTINCT recording_id, CAST({DAY0} AS BIGINT) AS lo, CAST({DAY30} AS BIGINT) AS hi FROM intervals), mc AS (SELECT recording_id, greatest(start_ms, {DAY0}) AS start_ms, least(end_ms, {DAY30}) AS end_ms FROM m WHERE start_ms < {DAY30} AND end_ms > {DAY0})," + _GAPS.format(n="g", t="mc", bounds="b") + " SELECT * FROM g WHERE end_ms - start_ms >= 3600000",
    "overlap_join": with_views("intervals") + "," + _A + " SELECT a.recording_id, a.interval_id, o.interval_id AS r_id, greatest(a.start_ms, o.start_ms) AS clip_start_ms, least(a.end_ms, o.end_ms) AS clip_end_ms, least(a.end_ms, o.end_ms) - greatest(a.start_ms, o.start_ms) AS overlap_ms FROM a JOIN o ON a.recording_id = o.recording_id AND a.end_ms > o.start_ms AND a.start_ms < o.end_ms",
    "subtract_intervals": with_views("intervals") + "," + _A + "," + _merge("o", "m") + """,
      x AS (SELECT a.recording_id, a.interval_id, greatest(a.start_ms, m.start_ms) AS s, least(a.end_ms, m.end_ms) AS e FROM a JOIN m ON a.recording_id = m.recording_id AND a.end_ms > m.start_ms AND a.start_ms < m.end_ms),
      y AS (SELECT recording_id, interval_id, s, e FROM x UNION ALL SELECT recording_id, interval_id, start_ms, start_ms FROM a UNION ALL SELECT recording_id, interval_id, end_ms, end_ms FROM a),
      z AS (SELECT recording_id, interval_id, e AS start_ms, lead(s) OVER (PARTITION BY recording_id, interval_id ORDER BY s, e) AS end_ms FROM y)
      SELECT recording_id, interval_id, start_ms, end_ms FROM z WHERE end_ms > start_ms AND end_ms - start_ms >= 60000""",
    "removed_before": with_views("intervals") + "," + _A + "," + _merge("o", "m") + " SELECT a.recording_id, a.interval_id, a.start_ms AS t_ms, CAST(coalesce(sum(least(m.end_ms, a.start_ms) - m.start_ms), 0) AS BIGINT) AS removed_ms FROM a LEFT JOIN m ON m.recording_id = a.recording_id AND m.start_ms < a.start_ms GROUP BY ALL",
    "coalesce_shots": with_views("segments") + """,
      s AS (SELECT recording_id, speaker AS camera, coalesce(CASE WHEN seg_idx % 4 <> 0 THEN 'user' END, speaker) AS audio_camera, start_ms, end_ms FROM segments WHERE end_ms - start_ms > 10),
      f AS (SELECT *, CASE WHEN lag(camera) OVER w = camera AND lag(audio_camera) OVER w = audio_camera AND abs(lag(end_ms) OVER w - start_ms) <= 600 THEN 0 ELSE 1 END AS nw FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms)),
      g AS (SELECT *, sum(nw) OVER (PARTITION BY recording_id ORDER BY start_ms) AS run FROM f)
      SELECT recording_id, camera, audio_camera, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY recording_id, run, camera, audio_camera""",
    "run_length_shots": with_views("levels") + """,
      l AS (SELECT recording_id, hop_idx AS step, arg_max(camera, (level, -ascii(camera))) AS c0 FROM levels GROUP BY ALL),
      p AS (SELECT recording_id, hop_idx AS step, camera, row_number() OVER (PARTITION BY recording_id, hop_idx ORDER BY level DESC, camera) AS rn FROM levels),
      q AS (SELECT *, lag(camera) OVER (PARTITION BY recording_id ORDER BY step) AS before FROM p WHERE rn = 1),
      r AS (SELECT recording_id, camera, step FROM q WHERE before IS NULL OR before <> camera)
      SELECT recording_id, camera, camera AS audio_camera, step * 3600000 AS start_ms, coalesce(least(lead(step) OVER (PARTITION BY recording_id ORDER BY step) * 3600000, 2592000000), 2592000000) AS end_ms FROM r""",
    "covers_range": with_views("intervals") + """,
      v AS (SELECT *, start_ms - max(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hole FROM intervals)
      SELECT recording_id, coalesce(max(hole), 0) <= 14400000 AND abs(arg_max(end_ms, start_ms) - max(end_ms)) <= 14400000 AS covered FROM v GROUP BY recording_id""",
    "pause_groups": with_views("segments") + ", f AS (SELECT recording_id, seg_idx, start_ms, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms) > 1500 THEN 1 ELSE 0 END AS nw FROM segments) SELECT recording_id, seg_idx, CAST(sum(nw) OVER (PARTITION BY recording_id ORDER BY start_ms) AS BIGINT) AS group_idx FROM f",
    "silence_intervals": with_views("levels") + """,
      q AS (SELECT * FROM levels WHERE level < 20000),
      s AS (SELECT *, row_number() OVER (PARTITION BY recording_id, camera ORDER BY hop_idx) AS rn FROM q a WHERE NOT EXISTS (SELECT 1 FROM q b WHERE b.recording_id = a.recording_id AND b.camera = a.camera AND b.hop_idx = a.hop_idx - 1)),
      e AS (SELECT *, row_number() OVER (PARTITION BY recording_id, camera ORDER BY hop_idx) AS rn FROM q a WHERE NOT EXISTS (SELECT 1 FROM q b WHERE b.recording_id = a.recording_id AND b.camera = a.camera AND b.hop_idx = a.hop_idx + 1))
      SELECT s.recording_id, s.camera, s.hop_idx * 3600000 AS start_ms, (e.hop_idx + 1) * 3600000 AS end_ms FROM s JOIN e ON s.recording_id = e.recording_id AND s.camera = e.camera AND s.rn = e.rn WHERE e.hop_idx + 1 - s.hop_idx >= 2""",
    "batch_windows": with_views("segments") + "," + _SB + "," + _WIN.format(step=10000, length=10000) + " SELECT * FROM w WHERE end_ms - start_ms > 800",
    "offset_windows": with_views("segments") + "," + _SB + "," + _WIN.format(step=5000, length=12000) + " SELECT * FROM w WHERE end_ms - start_ms = 12000",
    "best_speech_window": with_views("segments") + "," + _SB + "," + _merge("segments", "m") + "," + _WIN.format(step=1000, length=15000) + """,
      f AS (SELECT w.*, coalesce((SELECT sum(least(w.end_ms, m.end_ms) - greatest(w.start_ms, m.start_ms)) FROM m WHERE m.recording_id = w.recording_id AND m.end_ms > w.start_ms AND m.start_ms < w.end_ms), 0) AS sp FROM w JOIN b ON b.recording_id = w.recording_id WHERE hi - lo > 15000 AND w.end_ms - w.start_ms = 15000)
      SELECT recording_id, start_ms, end_ms FROM f QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY sp DESC, window_idx) = 1
      UNION ALL SELECT recording_id, lo, hi FROM b WHERE hi - lo <= 15000""",
}
