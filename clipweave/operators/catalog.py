"""Catalog tables: publication tracker, media checks, upload state, run records, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timecode import number

POSTED = ("1", "y", "yes", "true")
METRICS = ("views_24h", "likes_24h", "comments_24h")


def _flag(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def parse_tracker(rows: DataFrame, metrics=METRICS) -> DataFrame:
    """Typed columns of an all-string tracker: is_reel, is_posted, day, and a number or null per metric (decimal comma allowed)."""
    day = F.when(F.trim("date").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(F.trim("date"), "yyyy-M-d"))
    out = rows.withColumns({"is_reel": F.trim(F.coalesce("file_index", F.lit(""))) != "", "is_posted": _flag("posted").isin(*POSTED) | (_flag("status") == "posted"), "day": day})
    return out.withColumns({f"{m}_n": number(F.replace(F.coalesce(F.col(m), F.lit("")), F.lit(","), F.lit("."))) for m in metrics})


def mark_posted_until(rows: DataFrame, cutoff: str) -> DataFrame:
    """Reel rows dated up to the cutoff become posted=yes, status=posted; `changed` tells whether either field was another."""
    t = parse_tracker(rows, ())
    hit = F.col("is_reel") & F.coalesce(F.col("day") <= F.lit(cutoff).cast("date"), F.lit(False))
    changed = hit & ((F.coalesce("posted", F.lit("")) != "yes") | (F.coalesce("status", F.lit("")) != "posted"))
    return t.withColumns({"changed": changed, "posted": F.when(hit, F.lit("yes")).otherwise(F.col("posted")), "status": F.when(hit, F.lit("posted")).otherwise(F.col("status"))}).select(*rows.columns, "changed")


def tracker_summary(rows: DataFrame) -> DataFrame:
    """One row: reels, posted, not posted, sum, mean and median of views, filled and missing, posted without any metric."""
    t = parse_tracker(rows).filter("is_reel")
    views = F.when(F.col("is_posted"), F.col("views_24h_n"))
    bare = F.col("is_posted") & F.coalesce(*(F.col(f"{m}_n") for m in METRICS)).isNull()
    return t.agg(
        F.count("*").alias("total"), F.count_if("is_posted").alias("posted"), F.count_if(~F.col("is_posted")).alias("not_posted"), F.sum(views).alias("views_sum"), F.avg(views).alias("views_avg"), F.median(views).alias("views_median"),
        F.count(views).alias("views_filled"), F.count_if(F.col("is_posted") & F.col("views_24h_n").isNull()).alias("views_missing"), F.count_if(bare).alias("posted_without_stats"),
    )


def top_reels(rows: DataFrame, n: int, order: Column) -> DataFrame:
    """The n posted reels with most views, `order` (the file's order) first of equals. Top-n, no full sort."""
    t = parse_tracker(rows).filter("is_reel AND is_posted AND views_24h_n IS NOT NULL")
    return t.orderBy(F.desc("views_24h_n"), order).limit(n).select("file_index", "title", F.col("views_24h_n").alias("views"))


def metric_fill(rows: DataFrame, metrics=METRICS) -> DataFrame:
    """metric, filled, missing among posted reels."""
    t = parse_tracker(rows, metrics).filter("is_reel AND is_posted").select(F.col("file_index"), *(F.col(f"{m}_n").alias(m) for m in metrics))
    return t.unpivot("file_index", list(metrics), "metric", "value").groupBy("metric").agg(F.count("value").alias("filled"), F.count_if(F.col("value").isNull()).alias("missing"))


def engagement_totals(rows: DataFrame, metrics=METRICS[1:]) -> DataFrame:
    return parse_tracker(rows, metrics).filter("is_reel AND is_posted").agg(*(F.coalesce(F.sum(f"{m}_n"), F.lit(0.0)).alias(m) for m in metrics))


def select_indices(df: DataFrame, expr: str, lo: int | None = None, hi: int | None = None, index: str = "index") -> DataFrame:
    """Rows whose index is in a list like '1,2,5-10' (a reversed range is turned) and in [lo, hi]."""
    ranges = [tuple(sorted(map(int, p.split("-")))) * (1 if "-" in p else 1) for p in (x.strip() for x in expr.split(",")) if p]
    ranges = [(r[0], r[-1]) for r in ranges]
    keep = F.lit(not ranges)
    for a, b in ranges:
        keep = keep | F.col(index).between(a, b)
    if lo is not None:
        keep = keep & (F.col(index) >= lo)
    if hi is not None:
        keep = keep & (F.col(index) <= hi)
    return df.filter(keep)


def frame_rate(text: Column) -> Column:
    """'30000/1001' as a number; null when it cannot be divided."""
    p = F.split(text, "/")
    return F.when(F.size(p) == 2, F.try_divide(number(p[0]), number(p[1]))).otherwise(number(text))


MIB = 1024 * 1024


def media_qc(media: DataFrame, manual: tuple[int, int] | None = None) -> DataFrame:
    """file_index, status (failed over warn over ok), errors, warnings, notes from probe facts."""
    fps = frame_rate(F.col("r_frame_rate"))
    ext = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    when = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), F.lit(text))
    d = F.col("duration_s")
    errors = [
        when(F.col("video_codec").isNull(), "no video stream"),
        when(F.col("audio_codec").isNull(), "no audio stream"),
        when(~ext.isin(".mp4", ".mov"), "extension"),
        when((d < 3) | (d > 900) | d.isNull(), "duration"),
    ]
    warnings = [
        when(~F.col("video_codec").isin("h264", "hevc"), "video codec"),
        when(F.col("audio_codec") != "aac", "audio codec"),
        when(F.greatest("width", "height") > 1920, "resolution"),
        when((fps < 23) | (fps > 60) | fps.isNull(), "frame rate"),
        when(F.col("size_bytes") > 300 * MIB, "size"),
    ]
    if manual:
        warnings.append(when(F.col("file_index").between(*manual), "check by hand"))
    clean = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    out = media.select("file_index", clean(errors).alias("errors"), clean(warnings).alias("warnings"))
    status = F.when(F.size("errors") > 0, "failed").when(F.size("warnings") > 0, "warn").otherwise("ok")
    return out.withColumns({"status": status, "notes": F.concat_ws("; ", "errors", "warnings")})


def output_checks(files: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """files with a map of named booleans and the list of those that failed; null counts as failed."""
    pairs = [x for name, c in checks.items() for x in (F.lit(name), F.coalesce(c, F.lit(False)))]
    return files.withColumn("checks", F.create_map(*pairs)).withColumn("failed", F.array_sort(F.map_keys(F.map_filter("checks", lambda _, v: ~v))))


def finished_file_checks() -> dict[str, Column]:
    """The named checks of a finished vertical clip, over probe columns and measured flags."""
    fps = frame_rate(F.col("r_frame_rate"))
    return {
        "has_video": F.col("video_codec").isNotNull(), "has_audio": F.col("audio_codec").isNotNull(), "video_codec": F.col("video_codec") == "h264", "audio_codec": F.col("audio_codec") == "aac", "width": F.col("width") == 1080, "height": F.col("height") == 1920,
        "frame_rate": F.abs(fps - 30) < 0.05, "duration_known": F.col("duration_s").isNotNull(), "duration_short": F.col("duration_s") >= 3, "duration_long": F.col("duration_s") <= 900, "extension": F.lower("filename").endswith(".mp4"), "size": F.col("size_bytes") <= 300 * MIB,
    }


def merge_keyed_results(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def missing_ids(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return asked.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def missing_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, missing: names of required fields that are null or blank, for rows with any."""
    gone = F.filter(F.array(*(F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "", F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return rows.select(key, gone.alias("missing")).filter(F.size("missing") > 0)


def resolve_caption(items: DataFrame, overrides: DataFrame, template: str) -> DataFrame:
    """index, caption: the override, else the template with {index}, {filename}, {camera}, {start}, {end} filled in."""
    text = F.lit(template)
    for name, empty in (("index", ""), ("filename", ""), ("camera", ""), ("start", "0.0"), ("end", "0.0")):
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.col(name).cast("string"), F.lit(empty)))
    joined = items.join(overrides.select("index", F.col("caption").alias("_own")), "index", "left")
    return joined.select("index", F.coalesce("_own", text).alias("caption"))


def upload_plan(items: DataFrame, progress: DataFrame, qc: DataFrame, account: str, batch_size: int, strict: bool = False, force: bool = False, qc_only: bool = False, dry_run: bool = True) -> DataFrame:
    """account, index, action: what an upload run does with each item.

    Published ones are skipped, failed ones too unless force; failed checks fail; a warning is
    skipped when strict; qc_only skips what passed; the others are published (dry_run says so
    only) up to batch_size per account (all if it is 0 or less), and what follows the last one of
    these is untouched. The running count is per account and only over eligible rows. Earlier
    statuses count without regard to case and outer spaces.
    """
    rows = items.join(progress.select(account, "index", F.lower(F.trim("status")).alias("_was")), [account, "index"], "left").join(qc.select("index", F.col("status").alias("_qc")), "index", "left")
    fixed = F.when(F.col("_was") == "published", "skip_published")
    if not force:
        fixed = fixed.when(F.col("_was") == "failed", "skip_failed")
    fixed = fixed.when(F.col("_qc") == "failed", "failed")
    if strict:
        fixed = fixed.when(F.col("_qc") == "warn", "skipped")
    if qc_only:
        fixed = fixed.when(F.lit(True), "skipped")
    rows = rows.withColumn("_fixed", fixed)
    order = W.partitionBy(account).orderBy("index").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.sum(F.col("_fixed").isNull().cast("int")).over(order))
    past = F.col("_n") > batch_size if batch_size > 0 else F.lit(False)
    action = F.when(past, "untouched").otherwise(F.coalesce("_fixed", F.lit("dry_run" if dry_run else "publish")))
    return rows.select(account, "index", action.alias("action"))


def run_log_summary(records: DataFrame, run: str) -> DataFrame:
    """Per run: rendered clips ok, failed, skipped, seconds of all steps, and the run's status.

    records: run, type, status, seconds, count (kept candidates, of type candidates). A failed
    transcription or analysis is the run's status; without candidates nothing was rendered.
    """
    clip = ~F.col("type").isin("transcribe", "analyze", "abs_shift", "candidates")
    is_ = lambda *status: clip & F.col("status").isin(*status)
    broke = lambda step: F.bool_or((F.col("type") == step) & (F.col("status") == "error"))
    agg = records.groupBy(run).agg(
        F.count_if(is_("ok")).alias("n_ok"), F.count_if(is_("error")).alias("n_error"), F.count_if(is_("skipped", "skip_exists")).alias("n_skipped"), F.coalesce(F.sum("seconds"), F.lit(0)).alias("seconds"),
        broke("transcribe").alias("_t"), broke("analyze").alias("_a"), F.coalesce(F.max(F.when(F.col("type") == "candidates", F.col("count"))), F.lit(1)).alias("_c"),
    )
    status = F.when(F.col("_t"), "error_transcribe").when(F.col("_a"), "error_analyze").when(F.col("_c") == 0, "ok_no_candidates").when(F.col("n_error") > 0, "partial").otherwise("ok")
    return agg.withColumn("run_status", status).drop("_t", "_a", "_c")


def batch_rollup(runs: DataFrame, batch: str) -> DataFrame:
    """Runs of one batch summed: runs by status, clips, seconds."""
    return runs.groupBy(batch).agg(F.count("*").alias("n_runs"), F.count_if(F.col("run_status") == "ok").alias("n_runs_ok"), F.count_if(F.col("run_status").startswith("error")).alias("n_runs_failed"), *(F.sum(c).alias(c) for c in ("n_ok", "n_error", "n_skipped", "seconds")))


PROBE = "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,sample_rate:string>>,format:struct<duration:string>>"


def probe_flatten(probes: DataFrame, ids: list[str], text: str = "probe") -> DataFrame:
    """ids, video_codec, width, height, fps, audio_codec, duration_s from probe JSON: the first video and the first audio stream; nulls where there is none, blank or zero sizes and rates over 0 are unknown."""
    p = F.from_json(text, PROBE)
    first = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    rows = probes.select(*ids, first("video").alias("v"), first("audio").alias("a"), number(p["format"]["duration"]).alias("duration_s"))
    name = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    return rows.select(*ids, name(F.col("v.codec_name")).alias("video_codec"), *(F.nullif(F.col(f"v.{c}"), F.lit(0)).alias(c) for c in ("width", "height")), frame_rate(F.col("v.r_frame_rate")).alias("fps"), name(F.col("a.codec_name")).alias("audio_codec"), "duration_s")


def plural_ru(n: Column, one: str, few: str, many: str) -> Column:
    """Russian plural form by the last two digits."""
    return F.when((n % 10 == 1) & (n % 100 != 11), one).when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), few).otherwise(many)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def publication_cards(cards: DataFrame, plans: DataFrame, durations: DataFrame) -> DataFrame:
    """id, position, markdown, html for each card in order, with its clip count and length."""
    rows = cards.join(plans.groupBy("id").agg(F.count("*").alias("n_clips")), "id", "left").join(durations, "id", "left").withColumn("n_clips", F.coalesce("n_clips", F.lit(0)))
    length = F.format_string("%d:%02d", F.floor(F.coalesce("duration_ms", F.lit(0)) / 60000), F.floor(F.pmod(F.coalesce("duration_ms", F.lit(0)), F.lit(60000)) / 1000))
    count = F.concat(F.col("n_clips").cast("string"), F.lit(" "), plural_ru(F.col("n_clips"), "клип", "клипа", "клипов"))
    return rows.select("id", "position", F.concat(F.lit("## "), "title", F.lit("\n"), count, F.lit(", "), length).alias("markdown"), F.concat(F.lit("<h2>"), escape_html(F.col("title")), F.lit("</h2><p>"), count, F.lit(", "), length, F.lit("</p>")).alias("html"))


def list_files(files: DataFrame, prefix: str, media_type: str | None = None, limit: int | None = None) -> DataFrame:
    rows = files.filter(F.col("path").startswith(prefix))
    if media_type:
        rows = rows.filter(F.col("media_type") == media_type)
    return rows.orderBy("path").limit(limit) if limit is not None else rows
