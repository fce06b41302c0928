"""Queries on readers and writers: tables derived from the given ones are written in the format and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers as R
from ..sources import wav as S
from ..sources import writers as O
from ..views import scratch, view, with_views

KEY = ["recording_id"]


def seconds(c):
    return F.col(c) / 1000


def documents(rows, name, path, key="recording_id"):
    """One JSON file per key, from a column of JSON text."""
    rows.select(F.col(key).alias("k"), F.col(name).alias("value")).write.partitionBy("k").text(path)
    return f"{path}/*/*"


def number_of(path):
    return F.regexp_extract(path, r"/k=(-?\d+)/", 1).cast("long")


def transcripts(spark, sf):
    """Paths of transcript files: a file per recording; every third segment has no words."""
    s = view(spark, sf, "segments")
    word = F.struct(seconds("start_ms").alias("start"), seconds("end_ms").alias("end"), F.col("speaker").alias("word"))
    words = F.when(F.col("seg_idx") % 3 > 0, F.array(word, word)).otherwise(F.array().cast("array<struct<start:double,end:double,word:string>>"))
    seg = F.struct("seg_idx", F.struct(seconds("start_ms").alias("start"), seconds("end_ms").alias("end"), "text", words.alias("words")).alias("s"))
    files = s.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.to_json(seg["s"]).alias("j")))), lambda x: x["j"]).alias("js"))
    text = F.concat(F.lit('{"video_path": "v", "language": "en", "segments": ['), F.array_join("js", ", "), F.lit("]}"))
    return documents(files.select("recording_id", text.alias("j")), "j", scratch(spark, "transcripts"))


def ms(c):
    return F.bround(F.col(c) * 1000).cast("long")


def read_transcripts(spark, sf):
    t = R.read_transcripts(spark, transcripts(spark, sf))
    return t.select(number_of("path").alias("recording_id"), "seg_idx", ms("start").alias("start_ms"), ms("end").alias("end_ms"), F.md5(F.col("text").cast("binary")).alias("text"), F.size("words").alias("n_words"))


def read_words(spark, sf):
    w = R.read_words(spark, transcripts(spark, sf))
    return w.select(number_of("path").alias("recording_id"), "seg_idx", "word_idx", ms("start").alias("start_ms"), "word")


def plans(spark, sf):
    """A plan per reel: a source per speaker, clips, two cues per clip, an inset."""
    c, q = view(spark, sf, "clips"), view(spark, sf, "cues")
    ordered = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda y: y["j"]), ", ")
    clip = F.struct("clip_idx", F.format_string('["%s", %s, %s]', "source", seconds("start_ms").cast("string"), seconds("end_ms").cast("string")).alias("j"))
    sources = F.array_join(F.array_sort(F.collect_set(F.format_string('"%s": {"video": "%s.mov", "audio": "/abs/%s.wav", "advance": %s}', "source", "source", "source", seconds("advance_ms").cast("string")))), ", ")
    cue = F.struct("cue_idx", F.format_string('["%s", %s, %s, "t%d"]', "source", seconds("start_ms").cast("string"), seconds("end_ms").cast("string"), "cue_idx").alias("j"))
    rows = c.groupBy("reel_id").agg(ordered(clip).alias("clips"), sources.alias("sources")).join(q.groupBy("reel_id").agg(ordered(cue).alias("cues")), "reel_id")
    text = F.format_string('{"id": "%d", "sources": {%s}, "clips": [%s], "cues": [%s], "insets": [[1.5, 2.5, "st.png", 10, 20]]}', "reel_id", "sources", "clips", "cues")
    return documents(rows.select(F.col("reel_id").alias("recording_id"), text.alias("j")), "j", scratch(spark, "plans"))


def read_plans(spark, sf):
    """All four tables of the plans as one."""
    p = R.read_plans(spark, plans(spark, sf), root="/media")
    part = lambda what, df, *cs: df.select(F.lit(what).alias("what"), F.col("id").cast("long").alias("reel_id"), *(c.alias(n) for n, c in zip(("idx", "source", "start_ms", "end_ms", "text"), cs, strict=True)))
    none = F.lit(None).cast("string")
    return (
        part("clips", p["clips"], F.col("idx"), F.col("source"), ms("start"), ms("end"), none)
        .unionByName(part("cues", p["cues"], F.col("idx"), F.col("source"), ms("start"), ms("end"), F.col("text")))
        .unionByName(part("insets", p["insets"], F.col("idx"), none, ms("start"), ms("end"), F.col("path")))
        .unionByName(part("sources", p["sources"], F.lit(0), F.col("source"), ms("advance"), F.lit(0).cast("long"), F.concat_ws(" ", "video", "audio")))
    )


def read_candidates(spark, sf):
    """Candidates of each recording as one analysis file; every fifth has no end."""
    c = view(spark, sf, "candidates")
    end = F.when(F.col("cand_idx") % 5 > 0, seconds("end_ms"))
    one = F.struct("cand_idx", F.to_json(F.struct(seconds("start_ms").alias("start"), end.alias("end"), F.col("cand_idx").cast("string").alias("title"), (F.col("score_milli") / 1000).alias("score"))).alias("j"))
    files = c.groupBy("recording_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["j"]), ", ").alias("js"))
    path = scratch(spark, "candidates")  # a file per recording would be one per customer: files of many analyses, as lists
    text = F.concat(F.lit('{"transcript_path": "'), F.col("recording_id").cast("string"), F.lit('", "candidates": ['), "js", F.lit("]}"))
    lists = files.groupBy(F.pmod("recording_id", F.lit(64)).alias("part"), F.floor(F.col("recording_id") / 4096).alias("k")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(text), ", "), F.lit("]")).alias("value"))
    lists.select("value", F.concat_ws("-", "part", "k").alias("k")).write.partitionBy("k").text(path)
    return R.read_candidates(spark, f"{path}/*/*").select(F.col("transcript_path").cast("long").alias("recording_id"), F.col("title").cast("long").alias("cand_idx"), ms("start").alias("start_ms"), ms("end").alias("end_ms"), ms("score").alias("score_milli"))


def read_offsets(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    fit = F.when(F.col("n_nationkey") % 2 == 0, F.struct(F.lit(0.5).alias("slope_per_sec"), F.lit(2.0).alias("intercept_seconds")))
    j = F.to_json(F.struct(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("ref"), F.col("n_name").alias("other"), (F.col("n_nationkey") * 1.5).alias("offset_start"), fit.alias("fit_drift")))
    return R.read_offsets(spark, documents(n.select(F.col("n_nationkey").alias("recording_id"), j.alias("j")), "j", scratch(spark, "offsets")))


def read_cut_list(spark, sf):
    """The clips of each reel as one cut list."""
    c = view(spark, sf, "clips")
    cut = F.struct("clip_idx", F.struct(F.col("source").alias("label"), seconds("start_ms").alias("start"), seconds("end_ms").alias("end")).alias("c"))
    rows = c.groupBy("reel_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(cut)), lambda x: x["c"])).alias("j"))
    text = F.format_string('{"reel%d": %s}', "reel_id", "j")
    path = documents(rows.select(F.col("reel_id").alias("recording_id"), text.alias("j")), "j", scratch(spark, "cuts"))
    return R.read_cut_list(spark, path).select("file", "idx", "label", ms("start").alias("start_ms"), ms("end").alias("end_ms"))


def read_speaker_samples(spark, sf):
    """Segments as speaker samples: a list, or an object with samples, refs or segments, by recording."""
    s = view(spark, sf, "segments")
    one = F.struct("seg_idx", F.struct(F.col("speaker").alias("label"), F.format_string("v%d.mp4", "recording_id").alias("video"), seconds("start_ms").alias("start"), seconds("end_ms").alias("end")).alias("s"))
    rows = s.groupBy("recording_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"])).alias("j"))
    form = F.when(F.col("recording_id") % 4 == 0, F.lit("%s")).when(F.col("recording_id") % 4 == 1, F.lit('{"samples": %s}')).when(F.col("recording_id") % 4 == 2, F.lit('{"refs": %s}')).otherwise(F.lit('{"segments": %s}'))
    path = documents(rows.select("recording_id", F.replace(form, F.lit("%s"), F.col("j")).alias("j")), "j", scratch(spark, "samples"))
    return R.read_speaker_samples(spark, path).select("label", "video", ms("start").alias("start_ms"), ms("end").alias("end_ms"))


def write_tracker_csv(spark, sf):
    path = scratch(spark, "tracker")
    O.write_tracker_csv(view(spark, sf, "tracker"), path)
    return R.read_tracker(spark, path)


def write_excel_csv(spark, sf):
    """The file's lines as they are; Spark's reader takes the byte order mark off the first."""
    path = scratch(spark, "excel")
    t = view(spark, sf, "tracker").select("file_index", "title", F.concat(F.lit('a;"'), "views_24h").alias("views")).filter("file_index <> ' '").orderBy(F.col("file_index").cast("long"))
    O.write_excel_csv(t, path)
    lines = spark.read.text(path, lineSep="\r\n")
    return lines.select(F.length("value").alias("n"), F.md5(F.col("value").cast("binary")).alias("line"))


def write_excel_tsv(spark, sf):
    path = scratch(spark, "tsv")
    O.write_excel_tsv(view(spark, sf, "tracker"), path)
    return spark.read.csv(path, header=True, sep="\t", encoding="UTF-16", multiLine=True).fillna("")


def read_upload_list(spark, sf):
    """Media files as an upload list; the name stands in one of three columns, every tenth index is no number."""
    m = view(spark, sf, "media")
    i = F.col("file_index")
    name = lambda k: F.when(i % 3 == k, F.col("filename")).otherwise(F.lit(" "))
    index = F.when(i % 10 == 0, F.concat(F.lit("no "), i.cast("string"))).otherwise(i.cast("string"))
    rows = m.select(index.alias("index"), name(0).alias("symlink_name"), name(1).alias("filename"), name(2).alias("basename"), F.coalesce("video_codec", F.lit("")).alias("camera"), F.coalesce(F.col("duration_s").cast("string"), F.lit("x")).alias("start"), (i / 2).cast("string").alias("end"))
    path = scratch(spark, "upload")
    O.write_tracker_csv(rows, path)
    return R.read_upload_list(spark, path)


def read_caption_overrides(spark, sf):
    """Two captions for each file, the later one counts; every tenth index is no number."""
    m = view(spark, sf, "media")
    i = F.col("file_index")
    index = F.when(i % 10 == 0, F.lit("none")).otherwise(i.cast("string"))
    rows = m.select(index.alias("index"), F.explode(F.array(F.concat(F.lit("old, "), "filename"), F.concat(F.lit("new, "), "filename"))).alias("caption"))
    path = scratch(spark, "captions")
    rows.coalesce(1).sortWithinPartitions(F.desc("caption")).write.csv(path, header=True)
    return R.read_caption_overrides(spark, path)


def progress_rows(spark, sf):
    m = view(spark, sf, "media")
    return m.select(F.col("file_index").alias("index"), "filename", F.when(F.col("file_index") % 4 == 0, "published").otherwise("failed").alias("status"), F.lit("").alias("instagram_post_url"), F.lit("2024-01-02").alias("published_at"), F.concat(F.lit('note "'), "filename", F.lit('", x')).alias("notes"))


def write_progress(spark, sf):
    path = scratch(spark, "progress")
    O.write_progress(progress_rows(spark, sf), path)
    return R.read_progress(spark, path)


def read_progress(spark, sf):
    """Two rows for each index, the later one counts."""
    p = progress_rows(spark, sf)
    later = p.filter("index % 2 = 0").withColumn("status", F.lit("done"))
    path = scratch(spark, "progress")
    p.select("*", F.lit(0).alias("o")).unionByName(later.select("*", F.lit(1).alias("o"))).coalesce(1).sortWithinPartitions("o").drop("o").write.csv(path, header=True, emptyValue="")
    return R.read_progress(spark, path).select("index", "status")


def write_json_report(spark, sf):
    """Per recording a report with its segments, read back as JSON."""
    s = view(spark, sf, "segments")
    r = s.groupBy("recording_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seg_idx", "speaker"))).alias("segments"))
    path = scratch(spark, "report")
    O.write_json_report(r, path)
    back = spark.read.schema("recording_id long, n long, segments array<struct<seg_idx:long,speaker:string>>").json(path)
    return back.select("recording_id", "n", F.element_at("segments", -1)["speaker"].alias("last_speaker"))


def write_eval_tsv(spark, sf):
    c = view(spark, sf, "candidates").select("cand_idx", F.when(F.col("cand_idx") % 3 == 0, "missing_baseline").otherwise("ok").alias("status"), (F.col("score_milli") / 1024).alias("avg_iou"), (F.col("start_ms") / 1024).alias("avg_start_error"))
    path = scratch(spark, "eval")
    O.write_eval_tsv(c, path, ["avg_iou"], ["avg_start_error"])
    return spark.read.csv(path, header=True, sep="\t").fillna("")


def read_wav_chunks(spark, sf):
    """A sound file per label, of its vectors (64 samples each, at 800 a second, with a gap after every fifth), read in chunks of a second with a tenth more."""
    from pyspark.sql import Window as W

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    n = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    chunks = e.select("label", (n * 64 + F.floor(n / 5) * 100).cast("long").alias("start_sample"), F.transform("embedding", lambda v: v.cast("double")).alias("samples"))
    files = S.write_wav(chunks, scratch(spark, "wav"), "label", 800)
    read = S.read_wav_chunks(spark, files.first()["path"].rpartition("/")[0] + "/*.wav", 1.0, 0.1, run=2, task_bytes=1 << 16)
    whole = F.transform("samples", lambda v: F.bround(v * 32768).cast("long"))
    return read.select(F.regexp_extract("path", r"/(-?\d+)\.wav$", 1).cast("int").alias("label"), F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("sr").cast("long").alias("sr"), "start_sample", F.size("samples").cast("long").alias("n"), F.aggregate(whole, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.coalesce(F.element_at(whole, 1), F.lit(0)).alias("head"))


NAMES = "read_transcripts read_words read_plans read_candidates read_offsets read_cut_list read_speaker_samples write_tracker_csv write_excel_csv write_excel_tsv read_upload_list read_caption_overrides write_progress read_progress write_json_report write_eval_tsv read_wav_chunks"
QUERIES = {n: globals()[n] for n in NAMES.split()}

_S, _M, _C = with_views("segments"), with_views("media"), with_views("candidates")
SQL = {
    "read_wav_chunks": """WITH n AS (SELECT label, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings),
      s AS (SELECT label, n * 64 + n // 5 * 100 + i AS pos, CAST(trunc(greatest(-1.0, least(1.0, x[i + 1])) * 32767) AS BIGINT) AS v FROM n, LATERAL (SELECT unnest(range(64)) AS i)),
      f AS (SELECT label, max(pos) + 1 AS len FROM s GROUP BY label),
      c AS (SELECT label, i AS chunk_idx, i * 800 AS start_sample, least(880, len - i * 800) AS n FROM f, LATERAL (SELECT unnest(range(CAST(ceil(len / 800) AS BIGINT))) AS i))
      SELECT c.label, chunk_idx, CAST(800 AS BIGINT) AS sr, start_sample, n, CAST(coalesce(sum(v), 0) AS BIGINT) AS total, coalesce(max(v) FILTER (pos = start_sample), 0) AS head
      FROM c LEFT JOIN s ON s.label = c.label AND s.pos >= start_sample AND s.pos < start_sample + n GROUP BY ALL""",
    "read_transcripts": _S + " SELECT recording_id, CAST(seg_idx AS INTEGER) AS seg_idx, start_ms, end_ms, md5(text) AS text, CASE WHEN seg_idx % 3 > 0 THEN 2 ELSE 0 END AS n_words FROM segments",
    "read_words": _S + " SELECT recording_id, CAST(seg_idx AS INTEGER) AS seg_idx, w AS word_idx, start_ms, speaker AS word FROM segments, (SELECT unnest([0, 1]) AS w) WHERE seg_idx % 3 > 0 UNION ALL SELECT recording_id, CAST(seg_idx AS INTEGER), NULL, NULL, NULL FROM segments WHERE seg_idx % 3 = 0",
    "read_plans": with_views("clips", "cues") + """ SELECT 'clips' AS what, reel_id, CAST(row_number() OVER (PARTITION BY reel_id ORDER BY clip_idx) - 1 AS INTEGER) AS idx, source, start_ms, end_ms, NULL AS text FROM clips
      UNION ALL SELECT 'cues', reel_id, CAST(row_number() OVER (PARTITION BY reel_id ORDER BY cue_idx) - 1 AS INTEGER), source, start_ms, end_ms, 't' || cue_idx FROM cues
      UNION ALL SELECT DISTINCT 'insets', reel_id, 0, NULL, 1500, 2500, '/media/st.png' FROM clips
      UNION ALL SELECT DISTINCT 'sources', reel_id, 0, source, advance_ms, 0, '/media/' || source || '.mov /abs/' || source || '.wav' FROM clips""",
    "read_candidates": _C + " SELECT recording_id, cand_idx, start_ms, end_ms, score_milli FROM candidates WHERE cand_idx % 5 > 0",
    "read_offsets": "SELECT 'r' || n_nationkey AS ref, n_name AS other, n_nationkey * 1.5::DOUBLE AS offset_start, CASE WHEN n_nationkey % 2 = 0 THEN 0.5::DOUBLE END AS slope, CASE WHEN n_nationkey % 2 = 0 THEN 2.0::DOUBLE END AS intercept FROM nation",
    "read_cut_list": with_views("clips") + " SELECT 'reel' || reel_id AS file, CAST(row_number() OVER (PARTITION BY reel_id ORDER BY clip_idx) - 1 AS INTEGER) AS idx, source AS label, start_ms, end_ms FROM clips",
    "read_speaker_samples": _S + " SELECT speaker AS label, 'v' || recording_id || '.mp4' AS video, start_ms, end_ms FROM segments",
    "write_tracker_csv": with_views("tracker") + " SELECT * FROM tracker",
    "write_excel_tsv": with_views("tracker") + " SELECT * FROM tracker",
    "write_excel_csv": with_views("tracker") + """, l AS (SELECT 'sep=;' AS v UNION ALL SELECT 'file_index;title;views' UNION ALL SELECT file_index || ';' || title || ';"a;""' || views_24h || '"' FROM tracker WHERE file_index <> ' ') SELECT CAST(length(v) AS INTEGER) AS n, md5(v) AS line FROM l""",
    "read_upload_list": _M + " SELECT CAST(file_index AS INTEGER) AS index, filename, coalesce(video_codec, CAST(NULL AS VARCHAR)) AS camera, CAST(duration_s AS DOUBLE) AS start, file_index / 2 AS \"end\" FROM media WHERE file_index % 10 > 0",
    "read_caption_overrides": _M + " SELECT CAST(file_index AS INTEGER) AS index, 'new, ' || filename AS caption FROM media WHERE file_index % 10 > 0",
    "write_progress": _M + """ SELECT CAST(file_index AS INTEGER) AS index, filename, CASE WHEN file_index % 4 = 0 THEN 'published' ELSE 'failed' END AS status, '' AS instagram_post_url, '2024-01-02' AS published_at, 'note "' || filename || '", x' AS notes FROM media""",
    "read_progress": _M + " SELECT CAST(file_index AS INTEGER) AS index, CASE WHEN file_index % 2 = 0 THEN 'done' ELSE 'failed' END AS status FROM media",
    "write_json_report": _S + " SELECT recording_id, count(*) AS n, arg_max(speaker, seg_idx) AS last_speaker FROM segments GROUP BY recording_id",
    "write_eval_tsv": _C + " SELECT CAST(cand_idx AS VARCHAR) AS cand_idx, CASE WHEN cand_idx % 3 = 0 THEN 'missing_baseline' ELSE 'ok' END AS status, CASE WHEN cand_idx % 3 = 0 THEN '' ELSE printf('%.4f', score_milli / 1024) END AS avg_iou, CASE WHEN cand_idx % 3 = 0 THEN '' ELSE printf('%.2f', start_ms / 1024) END AS avg_start_error FROM candidates",
}
