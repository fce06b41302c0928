"""Queries on catalog operators: tracker, media checks, upload state, run records, cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..views import scratch, view, with_views


def parse_tracker(spark, sf):
    t = C.parse_tracker(view(spark, sf, "tracker"))
    return t.select("file_index", "title", "is_reel", "is_posted", F.col("day").cast("string").alias("day"), *(f"{m}_n" for m in C.METRICS))


def mark_posted_until(spark, sf):
    return C.mark_posted_until(view(spark, sf, "tracker"), "1995-06-30").select("date", "file_index", "posted", "status", "changed")


def tracker_summary(spark, sf):
    return C.tracker_summary(view(spark, sf, "tracker")).drop("views_avg")


def top_reels(spark, sf):
    return C.top_reels(view(spark, sf, "tracker"), 20, F.col("file_index").cast("long"))


def metric_fill(spark, sf):
    return C.metric_fill(view(spark, sf, "tracker"))


def engagement_totals(spark, sf):
    return C.engagement_totals(view(spark, sf, "tracker"))


def select_indices(spark, sf):
    return C.select_indices(view(spark, sf, "media"), "5,30-12,70-90", lo=10, index="file_index").select("file_index")


def media_qc(spark, sf):
    q = C.media_qc(view(spark, sf, "media"), manual=(66, 69))
    return q.select("file_index", "status", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), "notes")


def output_checks(spark, sf):
    m = view(spark, sf, "media")
    return C.output_checks(m, C.finished_file_checks()).select("file_index", F.array_join("failed", ",").alias("failed"))


def probe_flatten(spark, sf):
    """Probe JSON of each file: a data stream first, sound before picture in every other file, a second picture stream of another codec last."""
    m = view(spark, sf, "media")
    stream = lambda kind, codec, more="": F.when(codec.isNotNull(), F.concat(F.lit(f'{{"codec_type": "{kind}", "codec_name": "'), codec, F.lit('"'), F.lit(more) if isinstance(more, str) else more, F.lit("}")))
    size = F.concat(F.lit(', "width": '), F.col("width").cast("string"), F.lit(', "height": '), F.col("height").cast("string"), F.lit(', "r_frame_rate": "'), "r_frame_rate", F.lit('"'))
    picture, sound = stream("video", F.col("video_codec"), size), stream("audio", F.concat(F.upper(F.substring("audio_codec", 1, 1)), F.substring("audio_codec", 2, 9)))
    odd = F.col("file_index") % 2 == 1
    streams = F.array(F.lit('{"codec_type": "data"}'), F.when(odd, sound).otherwise(picture), F.when(odd, picture).otherwise(sound), F.when(F.col("video_codec").isNotNull(), F.lit('{"codec_type": "video", "codec_name": "mjpeg", "width": 1, "height": 1, "r_frame_rate": "1/1"}')))
    duration = F.when(F.col("duration_s").isNull(), F.lit('"N/A"')).otherwise(F.concat(F.lit('"'), F.col("duration_s").cast("string"), F.lit('.5"')))
    probe = F.concat(F.lit('{"streams": ['), F.array_join(F.array_compact(streams), ", "), F.lit('], "format": {"duration": '), duration, F.lit("}}"))
    return C.probe_flatten(m.select("file_index", probe.alias("probe")), ["file_index"])


def merge_keyed_results(spark, sf):
    m = view(spark, sf, "media").select("file_index", "width")
    new = m.filter("file_index % 7 = 0").withColumn("width", F.lit(720))
    return C.merge_keyed_results(m, new, "file_index")


def missing_ids(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("id"))
    recent = spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderdate >= '1998-01-01'").select(F.col("o_custkey").alias("id"))
    return C.missing_ids(orders, recent, "id")


def missing_fields(spark, sf):
    return C.missing_fields(view(spark, sf, "media"), "file_index", ["video_codec", "audio_codec", "duration_s"]).select("file_index", F.array_join("missing", ",").alias("missing"))


def resolve_caption(spark, sf):
    m = view(spark, sf, "media").select(F.col("file_index").alias("index"), "filename", F.col("video_codec").alias("camera"), F.col("duration_s").alias("start"), F.lit(None).cast("string").alias("end"))
    own = m.filter("index % 5 = 0").select("index", F.concat(F.lit("own "), "filename").alias("caption"))
    return C.resolve_caption(m, own, "#{index} {filename} [{camera}] {start}-{end}")


def upload_plan(spark, sf):
    m = view(spark, sf, "media")
    items = m.select((F.col("file_index") % 5).alias("account"), F.col("file_index").alias("index"))
    progress = items.filter("index % 4 < 2").withColumn("status", F.when(F.col("index") % 4 == 0, "published").otherwise("failed"))
    qc = C.media_qc(m).select(F.col("file_index").alias("index"), "status")
    return C.upload_plan(items, progress, qc, "account", batch_size=20, strict=False)


def run_log_summary(spark, sf):
    """Step records of each run (an order), written as lines of JSON and read again."""
    from ..sources.readers import read_run_records

    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    kind = F.when(F.col("l_linenumber") == 1, "transcribe").when(F.col("l_linenumber") == 2, "analyze").when(F.col("l_linenumber") == 3, "candidates").otherwise("render")
    status = F.when((F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 2 == 0), "error").when(F.col("l_returnflag") == "A", "skip_exists").otherwise("ok")
    records = li.select(F.col("l_orderkey").cast("string").alias("run_id"), kind.alias("type"), status.alias("status"), F.col("l_linenumber").cast("double").alias("seconds"), F.when(F.col("l_linenumber") == 3, F.col("l_suppkey") % 3).cast("int").alias("count"))
    path = scratch(spark, "run-records")
    records.write.json(path)
    return C.run_log_summary(read_run_records(spark, path), "run_id").withColumn("seconds", F.col("seconds").cast("long"))


def batch_rollup(spark, sf):
    return C.batch_rollup(run_log_summary(spark, sf).withColumn("batch", F.col("run_id").cast("long") % 50), "batch")


def publication_cards(spark, sf):
    s = view(spark, sf, "segments")
    cards = s.filter("seg_idx = 0").select(F.col("recording_id").alias("id"), F.col("recording_id").alias("position"), F.concat(F.lit("<"), F.substring("text", 1, 12), F.lit("> & co")).alias("title"))
    durations = s.groupBy(F.col("recording_id").alias("id")).agg(F.max("end_ms").alias("duration_ms"))
    return C.publication_cards(cards, s.select(F.col("recording_id").alias("id")), durations)


def list_files(spark, sf):
    files = view(spark, sf, "media").select(F.col("filename").alias("path"), F.when(F.col("filename").endswith(".avi"), "image").otherwise("video").alias("media_type"))
    return C.list_files(files, "small", "video")


QUERIES = {f.__name__: f for f in (parse_tracker, mark_posted_until, tracker_summary, top_reels, metric_fill, engagement_totals, select_indices, media_qc, output_checks, probe_flatten, batch_rollup, merge_keyed_results, missing_ids, missing_fields, resolve_caption, upload_plan, run_log_summary, publication_cards, list_files)}

_NUM = "CASE WHEN regexp_full_match(replace({0}, ',', '.'), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(replace({0}, ',', '.') AS DOUBLE) END"
_T = with_views("tracker") + f""",
 t AS (SELECT *, trim(file_index) <> '' AS is_reel, lower(trim(posted)) IN ('1', 'y', 'yes', 'true') OR lower(trim(status)) = 'posted' AS is_posted,
   CASE WHEN regexp_full_match(date, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN TRY_CAST(date AS DATE) END AS day,
   {_NUM.format('views_24h')} AS v, {_NUM.format('likes_24h')} AS l, {_NUM.format('comments_24h')} AS c FROM tracker)"""
_FPS = "CASE WHEN r_frame_rate = '0/0' THEN NULL ELSE CAST(split_part(r_frame_rate, '/', 1) AS DOUBLE) / CAST(split_part(r_frame_rate, '/', 2) AS DOUBLE) END"
_E = """list_filter([CASE WHEN video_codec IS NULL THEN 'no video stream' END, CASE WHEN audio_codec IS NULL THEN 'no audio stream' END,
   CASE WHEN NOT regexp_matches(filename, '[.](mp4|mov)$') THEN 'extension' END, CASE WHEN duration_s IS NULL OR duration_s < 3 OR duration_s > 900 THEN 'duration' END], lambda x: x IS NOT NULL)"""
_W = f"""list_filter([CASE WHEN video_codec NOT IN ('h264', 'hevc') THEN 'video codec' END, CASE WHEN audio_codec <> 'aac' THEN 'audio codec' END, CASE WHEN greatest(width, height) > 1920 THEN 'resolution' END,
   CASE WHEN ({_FPS}) IS NULL OR ({_FPS}) < 23 OR ({_FPS}) > 60 THEN 'frame rate' END, CASE WHEN size_bytes > 314572800 THEN 'size' END, CASE WHEN file_index BETWEEN 66 AND 69 THEN 'check by hand' END], lambda x: x IS NOT NULL)"""
_Q = with_views("media") + f", q AS (SELECT *, {_E} AS e, {_W} AS w FROM media)"
_RUNS = """WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS run_id, l_linenumber AS n, l_suppkey % 3 AS c, CASE WHEN l_returnflag = 'R' AND l_suppkey % 2 = 0 THEN 'error' WHEN l_returnflag = 'A' THEN 'skip' ELSE 'ok' END AS st FROM lineitem),
 a AS (SELECT run_id, count(*) FILTER (n > 3 AND st = 'ok') AS n_ok, count(*) FILTER (n > 3 AND st = 'error') AS n_error, count(*) FILTER (n > 3 AND st = 'skip') AS n_skipped, CAST(sum(n) AS BIGINT) AS seconds, bool_or(n = 1 AND st = 'error') AS t, bool_or(n = 2 AND st = 'error') AS y, coalesce(max(c) FILTER (n = 3), 1) AS c FROM l GROUP BY run_id),
 rs AS (SELECT run_id, n_ok, n_error, n_skipped, seconds, CASE WHEN t THEN 'error_transcribe' WHEN y THEN 'error_analyze' WHEN c = 0 THEN 'ok_no_candidates' WHEN n_error > 0 THEN 'partial' ELSE 'ok' END AS run_status FROM a)"""
SQL = {
    "parse_tracker": _T + " SELECT file_index, title, is_reel, is_posted, CAST(day AS VARCHAR) AS day, v AS views_24h_n, l AS likes_24h_n, c AS comments_24h_n FROM t",
    "mark_posted_until": _T + """, h AS (SELECT *, is_reel AND coalesce(day <= DATE '1995-06-30', false) AS hit FROM t)
      SELECT date, file_index, CASE WHEN hit THEN 'yes' ELSE posted END AS posted, CASE WHEN hit THEN 'posted' ELSE status END AS status, hit AND (posted <> 'yes' OR status <> 'posted') AS changed FROM h""",
    "tracker_summary": _T + """ SELECT count(*) AS total, count(*) FILTER (is_posted) AS posted, count(*) FILTER (NOT is_posted) AS not_posted, sum(v) FILTER (is_posted) AS views_sum, median(v) FILTER (is_posted) AS views_median,
      count(v) FILTER (is_posted) AS views_filled, count(*) FILTER (is_posted AND v IS NULL) AS views_missing, count(*) FILTER (is_posted AND v IS NULL AND l IS NULL AND c IS NULL) AS posted_without_stats FROM t WHERE is_reel""",
    "top_reels": _T + " SELECT file_index, title, v AS views FROM t WHERE is_reel AND is_posted AND v IS NOT NULL ORDER BY v DESC, CAST(file_index AS BIGINT) LIMIT 20",
    "metric_fill": _T + ", p AS (SELECT * FROM t WHERE is_reel AND is_posted) SELECT 'views_24h' AS metric, count(v) AS filled, count(*) - count(v) AS missing FROM p UNION ALL SELECT 'likes_24h', count(l), count(*) - count(l) FROM p UNION ALL SELECT 'comments_24h', count(c), count(*) - count(c) FROM p",
    "engagement_totals": _T + " SELECT coalesce(sum(l), 0.0) AS likes_24h, coalesce(sum(c), 0.0) AS comments_24h FROM t WHERE is_reel AND is_posted",
    "select_indices": with_views("media") + " SELECT file_index FROM media WHERE (file_index = 5 OR file_index BETWEEN 12 AND 30 OR file_index BETWEEN 70 AND 90) AND file_index >= 10",
    "media_qc": _Q + " SELECT file_index, CASE WHEN len(e) > 0 THEN 'failed' WHEN len(w) > 0 THEN 'warn' ELSE 'ok' END AS status, len(e) AS n_errors, len(w) AS n_warnings, array_to_string(e || w, '; ') AS notes FROM q",
    "output_checks": with_views("media") + f""", k AS (SELECT file_index, list_sort(list_filter([
      CASE WHEN video_codec IS NULL THEN 'has_video' END, CASE WHEN audio_codec IS NULL THEN 'has_audio' END, CASE WHEN NOT coalesce(video_codec = 'h264', false) THEN 'video_codec' END, CASE WHEN NOT coalesce(audio_codec = 'aac', false) THEN 'audio_codec' END,
      CASE WHEN width <> 1080 THEN 'width' END, CASE WHEN height <> 1920 THEN 'height' END, CASE WHEN NOT coalesce(abs(({_FPS}) - 30) < 0.05, false) THEN 'frame_rate' END, CASE WHEN duration_s IS NULL THEN 'duration_known' END,
      CASE WHEN NOT coalesce(duration_s >= 3, false) THEN 'duration_short' END, CASE WHEN NOT coalesce(duration_s <= 900, false) THEN 'duration_long' END, CASE WHEN NOT suffix(filename, '.mp4') THEN 'extension' END, CASE WHEN size_bytes > 314572800 THEN 'size' END], lambda x: x IS NOT NULL)) AS f FROM media)
      SELECT file_index, array_to_string(f, ',') AS failed FROM k""",
    "probe_flatten": with_views("media") + f" SELECT file_index, video_codec, CASE WHEN video_codec IS NOT NULL THEN width END AS width, CASE WHEN video_codec IS NOT NULL THEN height END AS height, CASE WHEN video_codec IS NOT NULL THEN {_FPS} END AS fps, audio_codec, duration_s + 0.5::DOUBLE AS duration_s FROM media",
    "merge_keyed_results": with_views("media") + " SELECT file_index, CASE WHEN file_index % 7 = 0 THEN 720 ELSE width END AS width FROM media",
    "missing_ids": "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1998-01-01')",
    "missing_fields": with_views("media") + ", m AS (SELECT file_index, list_filter([CASE WHEN video_codec IS NULL THEN 'video_codec' END, CASE WHEN audio_codec IS NULL THEN 'audio_codec' END, CASE WHEN duration_s IS NULL THEN 'duration_s' END], lambda x: x IS NOT NULL) AS f FROM media) SELECT file_index, array_to_string(f, ',') AS missing FROM m WHERE len(f) > 0",
    "resolve_caption": with_views("media") + " SELECT file_index AS index, CASE WHEN file_index % 5 = 0 THEN 'own ' || filename ELSE '#' || file_index || ' ' || filename || ' [' || coalesce(video_codec, '') || '] ' || coalesce(CAST(duration_s AS VARCHAR), '0.0') || '-0.0' END AS caption FROM media",
    "upload_plan": _Q.replace(", CASE WHEN file_index BETWEEN 66 AND 69 THEN 'check by hand' END", "") + """,
      f AS (SELECT file_index % 5 AS account, file_index AS index, CASE WHEN file_index % 4 = 0 THEN 'skip_published' WHEN file_index % 4 = 1 THEN 'skip_failed' WHEN len(e) > 0 THEN 'failed' END AS fx FROM q),
      n AS (SELECT *, count(*) FILTER (fx IS NULL) OVER (PARTITION BY account ORDER BY index) AS n FROM f)
      SELECT account, index, CASE WHEN n > 20 THEN 'untouched' ELSE coalesce(fx, 'dry_run') END AS action FROM n""",
    "run_log_summary": _RUNS + " SELECT * FROM rs",
    "batch_rollup": _RUNS + " SELECT CAST(run_id AS BIGINT) % 50 AS batch, count(*) AS n_runs, count(*) FILTER (run_status = 'ok') AS n_runs_ok, count(*) FILTER (prefix(run_status, 'error')) AS n_runs_failed, CAST(sum(n_ok) AS BIGINT) AS n_ok, CAST(sum(n_error) AS BIGINT) AS n_error, CAST(sum(n_skipped) AS BIGINT) AS n_skipped, CAST(sum(seconds) AS BIGINT) AS seconds FROM rs GROUP BY ALL",
    "publication_cards": with_views("segments") + """,
      d AS (SELECT recording_id AS id, count(*) AS n, max(end_ms) AS ms FROM segments GROUP BY ALL),
      c AS (SELECT s.recording_id AS id, substr(text, 1, 12) AS t, n, ms FROM segments s JOIN d ON d.id = s.recording_id WHERE seg_idx = 0),
      x AS (SELECT id, t, n || ' ' || CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN 'клип' WHEN n % 10 BETWEEN 2 AND 4 AND n % 100 NOT BETWEEN 12 AND 14 THEN 'клипа' ELSE 'клипов' END || ', ' || ms // 60000 || ':' || lpad(CAST(ms % 60000 // 1000 AS VARCHAR), 2, '0') AS k FROM c)
      SELECT id, id AS position, '## <' || t || '> & co' || chr(10) || k AS markdown, '<h2>&lt;' || replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '&gt; &amp; co</h2><p>' || k || '</p>' AS html FROM x""",
    "list_files": with_views("media") + " SELECT filename AS path, 'video' AS media_type FROM media WHERE prefix(filename, 'small') AND NOT suffix(filename, '.avi')",
}
