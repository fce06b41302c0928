"""Queries on plan, caption and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import timecode as T
from ..operators import align as A
from ..operators import captions as K
from ..operators import intervals as I
from ..operators import timeline as L
from ..sources.writers import clip_manifest as manifest
from ..views import view, with_views

KEY = ["recording_id"]


def build_clips(spark, sf):
    return L.build_clips(view(spark, sf, "clips"))


def build_timeline(spark, sf):
    clips = L.laid_out(view(spark, sf, "clips"))
    return L.to_reel_time(clips, view(spark, sf, "cues"), ["reel_id", "source"], ["cue_idx", "text"]).select("reel_id", "source", "clip_idx", "cue_idx", "reel_start_ms", "reel_end_ms", "text")


def seamless_joins(spark, sf):
    return L.seamless_joins(view(spark, sf, "clips"), "reel_id", "source", 900).select("reel_id", "clip_idx", "seamless")


def graphic_edges(spark, sf):
    items = view(spark, sf, "cues").select("reel_id", F.col("cue_idx").alias("item_id"), "start_ms", "end_ms")
    return L.graphic_edges(items, "reel_id").select("reel_id", "start_ms", "end_ms", F.array_join(F.transform("active", lambda x: x.cast("string")), ",").alias("active"))


def heard_vs_planned(spark, sf):
    cues = view(spark, sf, "cues").withColumnRenamed("reel_id", "recording_id")
    return L.heard_vs_planned(cues.select(*KEY, "cue_idx", "start_ms", "end_ms"), view(spark, sf, "segments"), "recording_id", ["cue_idx"]).select(*KEY, "cue_idx", F.md5(F.col("heard").cast("binary")).alias("heard"))


def snippet_for_windows(spark, sf):
    s = view(spark, sf, "segments")
    w = s.select(*KEY, F.col("seg_idx").alias("w"), (F.col("start_ms") - 4000).alias("start_ms"), (F.col("start_ms") + 4000).alias("end_ms"))
    return L.snippets(w, s, "recording_id", ["w"], 80)


def cue_spots(spark, sf):
    return L.cue_spots(view(spark, sf, "cues"), "reel_id", "an")


def slice_words(spark, sf):
    return L.slice_words(view(spark, sf, "segments").select(*KEY, "seg_idx", "start_ms", "end_ms"), 5_000, 30_000)


def find_cached_chunk(spark, sf):
    s = view(spark, sf, "segments")
    b = s.groupBy("recording_id").agg(F.lit(0).cast("long").alias("lo"), (F.max("end_ms") + 2000).alias("hi"))
    chunks = I.windows(b, KEY, 30_000, 12_000).withColumnRenamed("window_idx", "chunk_idx")
    return L.find_cached_chunk(s.select(*KEY, "seg_idx", "start_ms", "end_ms"), chunks, "recording_id", ["seg_idx"])


def write_srt(spark, sf):
    return L.srt(view(spark, sf, "cues"), "reel_id").select("reel_id", F.md5(F.col("srt").cast("binary")).alias("digest"), F.length("srt").alias("n"))


def parse_srt(spark, sf):
    return L.parse_srt(L.srt(view(spark, sf, "cues").withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))), "reel_id"), "reel_id").select("reel_id", "start_ms", "end_ms")


def write_ass(spark, sf):
    return L.ass(view(spark, sf, "segments"), "recording_id").select(*KEY, F.length("ass").alias("n"), F.md5(F.col("ass").cast("binary")).alias("digest"))


def parse_ass(spark, sf):
    return L.parse_ass(L.ass(view(spark, sf, "segments"), "recording_id"), "recording_id").select(*KEY, "start_ms", "end_ms", F.length("text").alias("n"))


def clip_manifest(spark, sf):
    c = view(spark, sf, "candidates").withColumn("stem", F.concat(F.lit("rec"), F.col("recording_id").cast("string")))
    return manifest(c, "recording_id", "stem").select(*KEY, "n", F.element_at("files", 1).alias("first_file"))


def time_functions(spark, sf):
    s = view(spark, sf, "segments")
    t = s.select(*KEY, "seg_idx", T.srt_time(F.col("start_ms")).alias("srt"), T.ass_time(F.col("start_ms") * 10).alias("ass"), T.seconds_to_timestamp(F.col("start_ms") / 1000).alias("stamp"))
    return t.withColumns({"back_ms": T.parse_clock_ms(F.col("srt")), "seconds": F.bround(T.timestamp_to_seconds(F.col("stamp")) * 1000).cast("long")})


def overlap_functions(spark, sf):
    c = view(spark, sf, "candidates")
    a = [F.col("start_ms"), F.col("end_ms"), F.lit(200_000), F.lit(260_000)]
    return c.select("cand_idx", (T.overlap_ratio(*a) >= 0.5).alias("half"), (T.iou(*a) >= 0.25).alias("quarter"))


def text_functions(spark, sf):
    d = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    return d.select(
        "conv_id", "turn", X.n_words(F.col("text")).alias("n_words"), X.safe_title(F.col("text"), F.col("turn")).alias("title"), X.safe_label(F.col("text")).alias("label"), X.text_width(F.col("text"), F.lit(48)).alias("width"),
        X.needs_scroll(F.col("text"), F.lit(48)).alias("scroll"), F.size(X.accent_spans(F.col("text"), ["the", "an"])).alias("n_accents"),
    )


def source_functions(spark, sf):
    u = F.col("url")
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", X.source_stem(u).alias("stem"), X.source_extension(u).alias("ext"), X.cache_key(u).alias("key"))


def token_f1(spark, sf):
    """Every turn of a conversation against the next one."""
    d = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", X.tokens(F.col("text")).alias("a"))
    pairs = d.join(d.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.size(F.array_intersect("a", "b")).alias("common"), F.size("a").alias("n_a"), F.size("b").alias("n_b"), (X.token_f1(F.col("a"), F.col("b")) >= 0.25).alias("close"))


def words_per_second(spark, sf):
    s = view(spark, sf, "segments")
    return s.select(*KEY, "seg_idx", F.bround(X.words_per_second(F.col("text"), F.col("end_ms") - F.col("start_ms")), 6).alias("words_per_second"))


def cache_name(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    source = F.concat(F.lit("/media/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_partkey") % 3 == 0, ".MOV").when(F.col("p_partkey") % 3 == 1, ".mp4").otherwise(""))
    return p.select("p_partkey", X.cache_name(source).alias("name"))


def sequence_ratio(spark, sf):
    """Each turn of a conversation against the next one of its role."""
    from pyspark.sql import Window as W

    c = spark.read.parquet(f"{sf}/conversations.parquet")
    after = F.lead("text").over(W.partitionBy("conv_id", "role").orderBy("turn"))
    return c.select("conv_id", "turn", F.col("text"), after.alias("after")).filter("after IS NOT NULL").select("conv_id", "turn", X.sequence_ratio(F.col("text"), F.col("after")).alias("ratio"))


def title_functions(spark, sf):
    d = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    return d.select("conv_id", "turn", F.length(X.polish_title(F.col("text"))).alias("n"), X.title_seconds(F.col("text"), F.lit(1.5)).alias("seconds"), F.md5(X.title_typography(F.col("text")).cast("binary")).alias("digest"))


def wrap_text(spark, sf):
    d = view(spark, sf, "segments")
    lines = d.select(*KEY, "seg_idx", X.wrap_text(22)("text").alias("w"), X.wrap_by_width(1200)("text").alias("u"), X.wrap_title()("text").alias("t"))
    return lines.select(*KEY, "seg_idx", F.size("w").alias("n_lines"), F.size("u").alias("n_wide"), F.col("t").alias("title"))


def wrap_balanced(spark, sf):
    return view(spark, sf, "segments").select(*KEY, "seg_idx", F.array_join(X.wrap_balanced(6000)("text"), "\n").alias("lines"))


def slice_text(spark, sf):
    s = view(spark, sf, "segments")
    mid = F.expr("(start_ms + end_ms) div 2")
    return s.select(*KEY, "seg_idx", X.slice_text(F.col("text"), None, F.col("start_ms"), F.col("end_ms"), F.col("start_ms"), mid).alias("part"))


def merge_segments(spark, sf):
    return K.merge_segments(view(spark, sf, "segments"), KEY, gap=1000, longest=12000)


def merge_dense_segments(spark, sf):
    return K.merge_dense(view(spark, sf, "segments"), KEY, most_wps=2.5, longest=20000, gap=1500)


def caption_pages(spark, sf):
    return K.caption_pages(view(spark, sf, "segments"), KEY)


def captions_for_clips(spark, sf):
    s = view(spark, sf, "segments")
    b = s.groupBy("recording_id").agg(F.lit(0).cast("long").alias("lo"), (F.max("end_ms") + 2000).alias("hi"))
    clips = I.windows(b, KEY, 20_000, 15_000).withColumnRenamed("window_idx", "clip_idx")
    return K.captions_for_clips(clips, s, I.pause_cuts(s, b, KEY, "medium"), "recording_id")


def caption_fit_check(spark, sf):
    return K.caption_fit_check(view(spark, sf, "cues").select("reel_id", "text"), ["reel_id"], 48, 560)


def speech_text_filter(spark, sf):
    return A.speech_text_filter(view(spark, sf, "segments"), markers=("the", "an"), short=5).select(*KEY, "seg_idx")


def align_blocks(spark, sf):
    """Script blocks: every third segment's text of a recording, to be found again in its transcript."""
    s = view(spark, sf, "segments").select(*KEY, "seg_idx", "start_ms", "end_ms", X.normalize_text(F.col("text")).alias("text"))
    blocks = s.filter("seg_idx % 3 = 1").select(*KEY, F.col("seg_idx").alias("block_idx"), "text")
    return A.align_blocks(blocks, s, "recording_id").select(*KEY, "block_idx", "start_ms", "end_ms")


def monotonic_clamp(spark, sf):
    s = view(spark, sf, "segments").select(*KEY, "seg_idx", (F.col("start_ms") - F.col("seg_idx") * 700).alias("start_ms"), (F.col("end_ms") - (F.col("seg_idx") % 3) * 2500).alias("end_ms"))
    return K.monotonic_clamp(s, KEY, "seg_idx")


def retime_captions(spark, sf):
    s = view(spark, sf, "segments").withColumns({"v": F.lit(10_000), "a": F.lit(10_000) + (F.col("recording_id") % 5) * 100})
    return K.retime_captions(s, (F.col("v"), F.col("a"))).select(*KEY, "seg_idx", "start_ms", "end_ms")


def retime_transcript(spark, sf):
    s = view(spark, sf, "segments")
    word = F.array(F.struct((F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("speaker").alias("word")))
    t = K.retime_transcript(s.select(*KEY, "seg_idx", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), word.alias("words")), 1.25)
    ms = lambda c: F.bround(c * 1000).cast("long")
    return t.select(*KEY, "seg_idx", ms(F.col("start")).alias("start_ms"), ms(F.col("end")).alias("end_ms"), ms(F.col("words")[0]["end"]).alias("word_end_ms"))


def timed_words(spark, sf):
    """segments in seconds with their words, which share the time evenly, in hundredths."""
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    step = (F.col("end_ms") - F.col("start_ms")) / F.size("w")
    at = lambda i: (F.floor((F.col("start_ms") + step * i) / 10) / 100).cast("double")
    words = F.transform("w", lambda x, i: F.struct(at(i).alias("start"), at(i + 1).alias("end"), x.alias("word"), F.lit(None).cast("double").alias("probability")))
    return view(spark, sf, "segments").withColumn("w", w).select(*KEY, "seg_idx", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text", words.alias("words"))


def show_words(spark, sf):
    return L.show_words(timed_words(spark, sf), 5.0, 30.0).select(*KEY, "seg_idx", "shown")


def slice_transcript(spark, sf):
    t = L.slice_transcript(timed_words(spark, sf), 5.0, 25.0)
    cents = lambda c: F.bround(c * 100).cast("long")
    return t.select(*KEY, "seg_idx", cents(F.col("start")).alias("start"), F.size("words").alias("n_words"), cents(F.col("words")[0]["start"]).alias("first_word"))


def auto_title(spark, sf):
    s = view(spark, sf, "segments")
    w = s.select(*KEY, F.col("seg_idx").alias("w"), "start_ms", (F.col("start_ms") + 9000).alias("end_ms"))
    rules = [([["the"], ["ing", "ung"]], "What of this thing?"), ([["qu", "ver"]], "How to begin?")]
    return L.auto_title(w, s, "recording_id", ["w"], 60, rules)


QUERIES = {f.__name__: f for f in (build_clips, build_timeline, seamless_joins, graphic_edges, heard_vs_planned, snippet_for_windows, cue_spots, slice_words, find_cached_chunk, write_srt, parse_srt, write_ass, parse_ass, clip_manifest, time_functions, overlap_functions, text_functions, source_functions, token_f1, words_per_second, cache_name, sequence_ratio, title_functions, wrap_text, wrap_balanced, slice_text, merge_segments, merge_dense_segments, caption_pages, captions_for_clips, caption_fit_check, speech_text_filter, align_blocks, monotonic_clamp, retime_captions, retime_transcript, show_words, slice_transcript, auto_title)}

_S, _K = with_views("segments"), with_views("cues")
_HMS = "lpad(CAST({t} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({t} % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({t} % 60000 // 1000 AS VARCHAR), 2, '0') || '{p}' || lpad(CAST({t} % 1000 AS VARCHAR), 3, '0')"
_SRT = "array_to_string(list(rn || chr(10) || " + _HMS.format(t="start_ms", p=",") + " || ' --> ' || " + _HMS.format(t="end_ms", p=",") + " || chr(10) || text || chr(10) ORDER BY rn), chr(10))"
_WORDS = "list_filter(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')"
_ASS = "(CAST(round_even({t} / 10, 0) AS BIGINT) // 360000) || ':' || lpad(CAST(CAST(round_even({t} / 10, 0) AS BIGINT) % 360000 // 6000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(round_even({t} / 10, 0) AS BIGINT) % 6000 // 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(CAST(round_even({t} / 10, 0) AS BIGINT) % 100 AS VARCHAR), 2, '0')"
_TW = _S + r", tv AS (SELECT *, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM segments), tw AS (SELECT *, list_transform(range(0, len(w) + 1), lambda i: floor((start_ms + (end_ms - start_ms) / len(w) * i) / 10) * 10) AS a FROM tv)"
_DENSE = "(1000 * len(list_filter(string_split_regex({x}, '\\s+'), lambda z: z <> '')) > {k} * 2.5 * greatest(0.001, {d}))"
SQL = {
    "words_per_second": _S + " SELECT recording_id, seg_idx, round_even(len(" + _WORDS + ") / (greatest(end_ms - start_ms, 0.001) / 1000.0), 6) AS words_per_second FROM segments",
    "cache_name": "WITH s AS (SELECT p_partkey, replace(p_name, ' ', '_') AS stem, CASE p_partkey % 3 WHEN 0 THEN '.MOV' WHEN 1 THEN '.mp4' ELSE '' END AS ext FROM part) SELECT p_partkey, stem || '_' || substr(md5('/media/' || stem || ext), 1, 8) || lower(ext) AS name FROM s",
    "build_clips": with_views("clips") + ", f AS (SELECT reel_id, clip_idx, source, CAST(round_even((start_ms - advance_ms) * 30 / 1000, 0) AS BIGINT) AS start_frame, CAST(round_even((end_ms - advance_ms) * 30 / 1000, 0) AS BIGINT) AS end_frame FROM clips) SELECT *, CAST(coalesce(sum(end_frame - start_frame) OVER (PARTITION BY reel_id ORDER BY clip_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_frame FROM f",
    "build_timeline": with_views("clips", "cues") + """, l AS (SELECT reel_id, clip_idx, source, start_ms - advance_ms AS s, end_ms - advance_ms AS e, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY reel_id ORDER BY clip_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ms FROM clips)
      SELECT l.reel_id, l.source, clip_idx, cue_idx, CAST(greatest(l.s, c.start_ms) - l.s + at_ms AS BIGINT) AS reel_start_ms, CAST(least(l.e, c.end_ms) - l.s + at_ms AS BIGINT) AS reel_end_ms, text FROM l JOIN cues c ON c.reel_id = l.reel_id AND c.source = l.source AND least(l.e, c.end_ms) - greatest(l.s, c.start_ms) > 70""",
    "seamless_joins": with_views("clips") + " SELECT reel_id, clip_idx, coalesce(lag(source) OVER w = source AND abs(lag(end_ms) OVER w - start_ms) < 900, false) AS seamless FROM clips WINDOW w AS (PARTITION BY reel_id ORDER BY clip_idx)",
    "graphic_edges": _K + ", e AS (SELECT DISTINCT reel_id, unnest([start_ms, end_ms]) AS a FROM cues), c AS (SELECT reel_id, a, lead(a) OVER (PARTITION BY reel_id ORDER BY a) AS b FROM e) SELECT c.reel_id, a AS start_ms, b AS end_ms, array_to_string(list(cue_idx ORDER BY cue_idx), ',') AS active FROM c JOIN cues q ON q.reel_id = c.reel_id AND q.start_ms < b AND q.end_ms > a WHERE b IS NOT NULL GROUP BY ALL",
    "heard_vs_planned": with_views("segments", "cues") + " SELECT q.reel_id AS recording_id, q.cue_idx, md5(coalesce(array_to_string(list(s.text ORDER BY s.start_ms, s.end_ms) FILTER (s.text IS NOT NULL), ' / '), '')) AS heard FROM cues q LEFT JOIN segments s ON s.recording_id = q.reel_id AND s.end_ms > q.start_ms AND s.start_ms < q.end_ms AND q.end_ms > q.start_ms GROUP BY ALL",
    "snippet_for_windows": _S + ", j AS (SELECT w.recording_id, w.seg_idx AS w, array_to_string(list(trim(s.text) ORDER BY s.start_ms), ' ') AS t FROM segments w JOIN segments s ON s.recording_id = w.recording_id AND s.end_ms > w.start_ms - 4000 AND s.start_ms < w.start_ms + 4000 GROUP BY ALL) SELECT recording_id, w, CASE WHEN length(t) > 80 THEN rtrim(substr(t, 1, 79)) || '…' ELSE t END AS snippet FROM j",
    "cue_spots": _K + " SELECT reel_id, cue_idx, p AS pad, greatest(0, start_ms - p) AS start_ms, end_ms + p AS end_ms FROM cues, (SELECT unnest([300, 1500]) AS p) WHERE contains(text, 'an')",
    "slice_words": _S + " SELECT recording_id, seg_idx, greatest(0, start_ms - 5000) AS start_ms, least(30000, end_ms) - 5000 AS end_ms FROM segments WHERE end_ms > 5000 AND start_ms < 30000",
    "find_cached_chunk": _S + ", b AS (SELECT recording_id, max(end_ms) + 2000 AS hi FROM segments GROUP BY ALL), w AS (SELECT recording_id, i AS chunk_idx, i * 12000 AS s, least(hi, i * 12000 + 30000) AS e FROM b, LATERAL (SELECT unnest(range(0, CAST(ceil(hi / 12000.0) AS BIGINT))) AS i)) SELECT g.recording_id, seg_idx, min(chunk_idx) AS chunk_idx, arg_min(start_ms - s, chunk_idx) AS offset_ms FROM segments g JOIN w ON w.recording_id = g.recording_id AND w.s <= start_ms AND w.e >= end_ms GROUP BY ALL",
    "write_srt": _K + ", n AS (SELECT *, row_number() OVER (PARTITION BY reel_id ORDER BY start_ms, end_ms, text) AS rn FROM cues), t AS (SELECT reel_id, " + _SRT + " AS srt FROM n GROUP BY reel_id) SELECT reel_id, md5(srt) AS digest, length(srt) AS n FROM t",
    "parse_srt": _K + " SELECT reel_id, start_ms, end_ms FROM cues",
    "parse_ass": _S + " SELECT recording_id, CAST(round_even(start_ms / 10, 0) AS BIGINT) * 10 AS start_ms, CAST(round_even(end_ms / 10, 0) AS BIGINT) * 10 AS end_ms, length(text) AS n FROM segments",
    "clip_manifest": with_views("candidates") + ", r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms) AS rn FROM candidates) SELECT recording_id, count(*) AS n, min('rec' || recording_id || '_01_' || replace(" + _HMS.format(t="start_ms", p=".") + ", ':', '-') || '_' || replace(" + _HMS.format(t="end_ms", p=".") + ", ':', '-') || '.mp4') FILTER (rn = 1) AS first_file FROM r GROUP BY recording_id",
    "time_functions": _S + ", t AS (SELECT *, start_ms * 10 AS x FROM segments) SELECT recording_id, seg_idx, " + _HMS.format(t="start_ms", p=",") + " AS srt, (x // 3600000) || ':' || lpad(CAST(x % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(x % 60000 // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST(x % 1000 // 10 AS VARCHAR), 2, '0') AS ass, " + _HMS.format(t="start_ms", p=".") + " AS stamp, start_ms AS back_ms, start_ms AS seconds FROM t",
    "overlap_functions": with_views("candidates") + ", o AS (SELECT cand_idx, end_ms - start_ms AS l, greatest(0, least(end_ms, 260000) - greatest(start_ms, 200000)) AS i FROM candidates) SELECT cand_idx, 2 * i >= least(l, 60000) AS half, 4 * i >= l + 60000 - i AS quarter FROM o",
    "text_functions": r"""WITH t AS (SELECT conv_id, turn, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q, coalesce(text, '') AS h, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS lb FROM conversations),
      w AS (SELECT *, (SELECT sum(CASE WHEN contains(' ilI1|.,:;!''`', c) THEN 34 WHEN contains('WwMm@%#&ЖШЩЮФЫД', c) THEN 90 ELSE 60 END) FROM (SELECT unnest(string_split(h, '')) AS c)) * 48 AS wd FROM t)
      SELECT conv_id, turn, CASE WHEN q = '' THEN 0 ELSE len(string_split(q, ' ')) END AS n_words,
        CASE WHEN q = '' THEN 'Фрагмент ' || turn WHEN length(q) <= 68 THEN q ELSE regexp_replace(CASE WHEN contains(substr(q, 1, 68), ' ') THEN regexp_replace(substr(q, 1, 68), ' [^ ]*$', '') ELSE substr(q, 1, 68) END, '[ ,.;:-]+$', '') || '…' END AS title,
        CASE WHEN lb = '' THEN 'item' ELSE lb END AS label, CAST(coalesce(wd, 0) AS INTEGER) AS width, coalesce(wd, 0) / 100 > 784.08 AS scroll,
        len(regexp_extract_all(text, '(?i)(?:^|[^\p{L}\p{N}_])(the|an)')) AS n_accents FROM w""",
    "source_functions": r"""WITH t AS (SELECT page_id, url, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/\\]*)$', 1) AS n FROM pages)
      SELECT page_id, regexp_replace(n, '(.)\.[^.]*$', '\1') AS stem, lower(regexp_extract(n, '.(\.[^.]*)$', 1)) AS ext, md5(url) AS key FROM t""",
    "token_f1": r"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(trim(regexp_replace(replace(lower(text), 'ё', 'е'), '[^a-z0-9а-я]+', ' ', 'g')), ' '), lambda w: w <> '')) AS k FROM conversations),
      j AS (SELECT a.conv_id, a.turn, a.k AS a, b.k AS b, len(list_intersect(a.k, b.k)) AS c FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
      SELECT conv_id, turn, CAST(c AS INTEGER) AS common, CAST(len(a) AS INTEGER) AS n_a, CAST(len(b) AS INTEGER) AS n_b, len(a) > 0 AND len(b) > 0 AND 2.0 * c / (len(a) + len(b)) >= 0.25 AS close FROM j""",
    "merge_segments": _S + """, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms) AS rn FROM segments),
      f AS (SELECT recording_id, rn, CAST(0 AS BIGINT) AS g, start_ms AS s0, end_ms AS e0 FROM r WHERE rn = 1
        UNION ALL SELECT r.recording_id, r.rn, CASE WHEN r.start_ms - f.e0 <= 1000 AND r.end_ms - f.s0 <= 12000 THEN f.g ELSE f.g + 1 END, CASE WHEN r.start_ms - f.e0 <= 1000 AND r.end_ms - f.s0 <= 12000 THEN f.s0 ELSE r.start_ms END, r.end_ms FROM f JOIN r ON r.recording_id = f.recording_id AND r.rn = f.rn + 1)
      SELECT f.recording_id, min(r.start_ms) AS start_ms, max(r.end_ms) AS end_ms, CASE WHEN count(*) > 1 THEN trim(array_to_string(list(r.text ORDER BY r.rn), ' ')) ELSE any_value(r.text) END AS text FROM f JOIN r ON r.recording_id = f.recording_id AND r.rn = f.rn GROUP BY f.recording_id, f.g""",
    "monotonic_clamp": _S + """, r AS (SELECT recording_id, seg_idx, start_ms - seg_idx * 700 AS s, end_ms - (seg_idx % 3) * 2500 AS e, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) AS rn FROM segments),
      f AS (SELECT recording_id, seg_idx, rn, s AS start_ms, CASE WHEN e > s THEN e ELSE s + 3000 END AS end_ms FROM r WHERE rn = 1
        UNION ALL SELECT r.recording_id, r.seg_idx, r.rn, greatest(r.s, f.end_ms), CASE WHEN r.e > greatest(r.s, f.end_ms) THEN r.e ELSE greatest(r.s, f.end_ms) + 3000 END FROM f JOIN r ON r.recording_id = f.recording_id AND r.rn = f.rn + 1)
      SELECT recording_id, seg_idx, start_ms, end_ms FROM f""",
    "caption_fit_check": _K + """, l AS (SELECT reel_id, unnest(string_split(text, chr(10))) AS line FROM cues), w AS (SELECT reel_id, CAST(coalesce(list_sum(list_transform(string_split(line, ''), lambda c: CASE WHEN c = '' THEN 0 WHEN contains(' ilI1|.,:;!''`', c) THEN 34 WHEN contains('WwMm@%#&ЖШЩЮФЫД', c) THEN 90 ELSE 60 END)), 0) * 48 AS INTEGER) AS w FROM l)
      SELECT reel_id, count(*) AS n_lines, count(*) FILTER (w > 56000) AS n_over, max(w) AS widest FROM w GROUP BY reel_id""",
    "speech_text_filter": _S + r", t AS (SELECT recording_id, seg_idx, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM segments) SELECT recording_id, seg_idx FROM t WHERE q <> '' AND NOT (len(string_split(q, ' ')) <= 5 AND regexp_matches(q, '(?i)(^|[^\p{L}\p{N}_])(the|an)'))",
    "retime_captions": _S + ", f AS (SELECT *, CASE WHEN recording_id % 5 IN (1, 2) THEN 10000 / (10000 + recording_id % 5 * 100) END AS f FROM segments) SELECT recording_id, seg_idx, CASE WHEN f IS NULL THEN start_ms ELSE CAST(round_even(start_ms * f, 0) AS BIGINT) END AS start_ms, CASE WHEN f IS NULL THEN end_ms ELSE CAST(round_even(end_ms * f, 0) AS BIGINT) END AS end_ms FROM f",
    "retime_transcript": _S + " SELECT recording_id, seg_idx, start_ms + 1250 AS start_ms, end_ms + 1250 AS end_ms, end_ms + 1250 AS word_end_ms FROM segments",
    "show_words": _TW + """ SELECT recording_id, seg_idx, printf('[%7.2f-%7.2f] ', start_ms / 1000, end_ms / 1000) || trim(text) || chr(10) || '   ' || array_to_string(list_transform(range(1, len(w) + 1), lambda i: w[i] || '·' || printf('%.2f', a[i] / 1000)), '  ') AS shown FROM tw WHERE end_ms >= 5000 AND start_ms <= 30000""",
    "slice_transcript": _TW + """, k AS (SELECT recording_id, seg_idx, start_ms, list_filter(a[1 : len(w)], lambda t: t >= 5000 AND t <= 30000) AS k FROM tw WHERE end_ms >= 5000 AND start_ms <= 30000)
      SELECT recording_id, seg_idx, CAST(round_even(start_ms / 10.0 - 500, 0) AS BIGINT) AS start, CAST(len(k) AS INTEGER) AS n_words, CAST(round_even(k[1] / 10.0 - 500, 0) AS BIGINT) AS first_word FROM k WHERE len(k) > 0""",
    "auto_title": _S + r""", j AS (SELECT w.recording_id, w.seg_idx AS w, s.seg_idx AS i, trim(regexp_replace(s.text, '\s+', ' ', 'g')) AS t FROM segments w JOIN segments s ON s.recording_id = w.recording_id AND s.end_ms > w.start_ms AND s.start_ms < w.start_ms + 9000),
      b AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY recording_id, w ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS before FROM j WHERE t <> ''),
      g AS (SELECT recording_id, w, array_to_string(list(t ORDER BY i), ' ') AS t FROM b WHERE before < 60 GROUP BY ALL),
      p AS (SELECT *, trim(substr(array_to_string(string_split(regexp_replace(string_split_regex(t, '[.!?]')[1], '^[ ,:;-]+|[ ,:;-]+$', '', 'g'), ' ')[1 : 8], ' '), 1, 64)) AS p FROM g)
      SELECT s.recording_id, s.seg_idx AS w, CASE WHEN contains(lower(t), 'the') AND (contains(lower(t), 'ing') OR contains(lower(t), 'ung')) THEN 'What of this thing?' WHEN contains(lower(t), 'qu') OR contains(lower(t), 'ver') THEN 'How to begin?' WHEN length(p) >= 8 THEN upper(substr(p, 1, 1)) || substr(p, 2) || '?' END AS title
      FROM segments s LEFT JOIN p ON p.recording_id = s.recording_id AND p.w = s.seg_idx""",
    "title_functions": r"""WITH q AS (SELECT conv_id, turn, text, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS q FROM conversations),
      p AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(q, '^[ "''«»]+|[ "''«»]+$', '', 'g'), ' {2,}', ' ', 'g'), '([!?.,;:])[!?.,;:]+', '\1', 'g') AS p, CASE WHEN q = '' THEN 0 ELSE len(string_split(q, ' ')) END AS w FROM q),
      c AS (SELECT *, substr(p, 1, 140) AS c, length(regexp_replace(substr(p, 1, 140), ' [^ ]*$', '')) AS sp FROM p)
      SELECT conv_id, turn, CAST(length(CASE WHEN length(p) <= 140 THEN p ELSE rtrim(CASE WHEN contains(c, ' ') AND sp > 80 THEN substr(c, 1, sp) ELSE c END) END) AS INTEGER) AS n,
        CASE WHEN w <= 7 AND length(q) <= 42 THEN 1.5 ELSE round_even(least(3.2, 1.5 + least(1.2, greatest(0.0, (w - 7) * 0.06::DOUBLE, (length(q) - 42) * 0.012::DOUBLE))), 3) END AS seconds,
        md5(translate(text, ' ‐‑‒–—―−', ' -------')) AS digest FROM c""",
    "write_ass": _S + ", l AS (SELECT recording_id, start_ms, end_ms, 'Dialogue: 0,' || " + _ASS.format(t="start_ms") + " || ',' || " + _ASS.format(t="end_ms") + " || ',Default,,0,0,0,,' || replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '{', '['), '}', ']'), chr(10), chr(92) || 'N') AS l FROM segments), t AS (SELECT recording_id, array_to_string(list(l ORDER BY start_ms, end_ms, l), chr(10)) AS a FROM l GROUP BY ALL) SELECT recording_id, CAST(length(a) AS INTEGER) AS n, md5(a) AS digest FROM t",
    "slice_text": _S + r""", q AS (SELECT recording_id, seg_idx, start_ms, end_ms, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM segments), n AS (SELECT *, string_split(q, ' ') AS p, (start_ms + end_ms) // 2 AS mid FROM q), b AS (SELECT *, len(p) AS n, greatest(0.0, least(1.0, (mid - start_ms) / greatest(end_ms - start_ms, 1))) AS b FROM n)
      SELECT recording_id, seg_idx, CASE WHEN b <= 0 OR b >= 0.999 OR n <= 3 THEN q ELSE array_to_string(p[1 : greatest(1, least(n, CAST(ceil(b * n) AS BIGINT)))], ' ') END AS part FROM b""",
    "wrap_text": _S + """, w AS (SELECT recording_id, seg_idx, """ + _WORDS + """ AS w FROM segments),
      f AS (SELECT recording_id, seg_idx, w, 0 AS i, 0 AS n, 0 AS l, 0 AS m, 0 AS u, CAST([] AS VARCHAR[]) AS t FROM w
        UNION ALL SELECT recording_id, seg_idx, w, i + 1, CASE WHEN n > 0 AND l + 1 + length(x) <= 22 THEN n ELSE n + 1 END, CASE WHEN n > 0 AND l + 1 + length(x) <= 22 THEN l + 1 + length(x) ELSE length(x) END,
          CASE WHEN m > 0 AND u + 34 + xu <= 1200 THEN m ELSE m + 1 END, CASE WHEN m > 0 AND u + 34 + xu <= 1200 THEN u + 34 + xu ELSE xu END,
          CASE WHEN len(t) > 3 THEN t WHEN len(t) > 0 AND length(t[-1]) + 1 + length(x) <= 28 THEN t[1 : len(t) - 1] || [t[-1] || ' ' || x] ELSE t || [x] END
        FROM (SELECT *, w[i + 1] AS x, list_sum(list_transform(string_split(w[i + 1], ''), lambda c: CASE WHEN contains(' ilI1|.,:;!''`', c) THEN 34 WHEN contains('WwMm@%#&ЖШЩЮФЫД', c) THEN 90 ELSE 60 END)) AS xu FROM f WHERE i < len(w)))
      SELECT recording_id, seg_idx, CAST(greatest(n, 1) AS INTEGER) AS n_lines, CAST(greatest(m, 1) AS INTEGER) AS n_wide, CASE WHEN len(t) > 3 THEN t[1] || chr(10) || t[2] || chr(10) || rtrim(substr(t[3], 1, 25)) || '...' ELSE array_to_string(t, chr(10)) END AS title FROM f WHERE i = len(w)""",
    "merge_dense_segments": _S + """, r AS (SELECT recording_id, start_ms AS s, end_ms AS e, text AS t, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms) AS rn FROM segments),
      k AS (SELECT recording_id, max(rn) AS n FROM r GROUP BY ALL),
      f AS (SELECT recording_id, CAST(1 AS BIGINT) AS i, CAST([] AS STRUCT(s BIGINT, e BIGINT, t VARCHAR)[]) AS o, {'s': s, 'e': e, 't': t} AS c, 20000 AS lim FROM r WHERE rn = 1
        UNION ALL SELECT recording_id, i + 1,
          CASE WHEN take THEN o WHEN back THEN o[1 : len(o) - 1] || [{'s': o[-1].s, 'e': c.e, 't': trim(o[-1].t || ' ' || c.t)}] ELSE o || [c] END,
          CASE WHEN take THEN {'s': c.s, 'e': e, 't': trim(c.t || ' ' || t)} ELSE {'s': s, 'e': e, 't': t} END, 20000
        FROM (SELECT f.recording_id, f.i, f.o, f.c, f.lim, r.s, r.e, r.t, """ + _DENSE.format(x="f.c.t", d="(f.c.e - f.c.s)", k=1) + """ AND r.s IS NOT NULL AND r.s - f.c.e <= 1500 AND r.e - f.c.s <= f.lim AS take,
            """ + _DENSE.format(x="f.c.t", d="(f.c.e - f.c.s)", k=1) + """ AND len(f.o) > 0 AND f.c.s - f.o[-1].e <= 1500 AND f.c.e - f.o[-1].s <= f.lim AS back
          FROM f JOIN k ON k.recording_id = f.recording_id AND f.i <= k.n LEFT JOIN r ON r.recording_id = f.recording_id AND r.rn = f.i + 1)),
      g AS (SELECT f.recording_id, unnest(o) AS o FROM f JOIN k ON k.recording_id = f.recording_id AND f.i = k.n + 1)
      SELECT recording_id, o.s AS start_ms, o.e AS end_ms, o.t AS text FROM g""",
}
