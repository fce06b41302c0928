"""Level series: thresholds, smoothing, quiet spots, cut checks, clip levels, gains. Levels are any unit; hops are whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import percentiles


def percentile_level(levels: DataFrame, keys: list[str], share: float, name: str, margin=0) -> DataFrame:
    """Exact, linearly interpolated percentile per key, plus a margin. Speech level: 0.88; noise floor: 0.2."""
    return percentiles(levels, keys, "level", {name: share}).withColumn(name, F.col(name) + margin)


def level_normalize(levels: DataFrame, floors: DataFrame, key: str, camera: str, target: str = "median", most: float = 0.0) -> DataFrame:
    """key, camera, shift: moves each camera's speech median (95th percentile without speech) to the target over cameras; clamped if most > 0."""
    rows = levels.join(floors, [key, camera])
    rows = rows.withColumn("_speech", F.when(F.col("level") >= F.col("threshold"), F.col("level")))
    speech = percentiles(rows, [key, camera], "_speech", {"m": 0.5})
    med = speech.join(percentiles(rows, [key, camera], "level", {"_high": 0.95}), [key, camera]).select(key, camera, F.coalesce("m", "_high").alias("m"))
    goal = {"max": F.max, "min": F.min, "median": F.median}[target]("m")
    shift = F.col("goal") - F.col("m")
    if most > 0:
        shift = F.greatest(F.lit(-most), F.least(F.lit(most), shift))
    return med.join(med.groupBy(key).agg(goal.alias("goal")), key).select(key, camera, shift.alias("shift"))


def moving_average(levels: DataFrame, keys: list[str], n: int, name: str = "smooth") -> DataFrame:
    """Zero-padded mean of n hops around each: rows -(n // 2) to n - 1 - n // 2, divided by n."""
    order = W.partitionBy(*keys).orderBy("hop_idx").rowsBetween(-(n // 2), n - 1 - n // 2)
    return levels.withColumn(name, F.sum("level").over(order) / n)


def near_levels(points: DataFrame, levels: DataFrame, keys: list[str], at: str, lo: int, hi: int) -> DataFrame:
    """Each point with the hops in [at + lo, at + hi]: equi-join on key and hop, a row per hop of the window."""
    rows = points.withColumn("hop_idx", F.explode(F.sequence(F.col(at) + lo, F.col(at) + hi)))
    return rows.join(levels, [*keys, "hop_idx"])


def quietest_near(points: DataFrame, levels: DataFrame, keys: list[str], ids: list[str], at: str, lo: int, hi: int, value: str = "level") -> DataFrame:
    """keys, ids, quiet_hop, quiet_level: the first lowest hop around each point."""
    rows = near_levels(points, levels, keys, at, lo, hi)
    best = F.min(F.struct(F.col(value).alias("v"), F.col("hop_idx").alias("h"))).alias("b")
    return rows.groupBy(*keys, *ids).agg(best).select(*keys, *ids, F.col("b.h").alias("quiet_hop"), F.col("b.v").alias("quiet_level"))


def check_cuts(edges: DataFrame, levels: DataFrame, speech: DataFrame, keys: list[str], ids: list[str], around: int, margin) -> DataFrame:
    """Edges (hop) whose quietest level within `around` hops is above speech level minus margin: cuts inside speech."""
    near = quietest_near(edges.filter(~F.col("seamless")), levels, keys, ids, "hop", -around, around)
    return near.join(speech, keys).filter(F.col("quiet_level") > F.col("speech") - margin).select(*keys, *ids, "quiet_hop", "quiet_level")


def nudge_cuts(edges: DataFrame, levels: DataFrame, speech: DataFrame, keys: list[str], ids: list[str], before: int, after: int, margin) -> DataFrame:
    """Edges moved to the quietest hop around them if the level there is above speech minus margin and a quieter one exists: old and new hop, moved."""
    here = edges.join(levels.withColumnsRenamed({"hop_idx": "hop", "level": "now"}), [*keys, "hop"], "left")
    near = quietest_near(edges, levels, keys, ids, "hop", -before, after)
    rows = here.join(near, [*keys, *ids], "left").join(speech, keys, "left")
    move = F.coalesce((F.col("now") > F.col("speech") - margin) & (F.col("quiet_level") < F.col("now")), F.lit(False))
    return rows.select(*keys, *ids, F.col("hop").alias("old_hop"), F.when(move, F.col("quiet_hop")).otherwise(F.col("hop")).alias("new_hop"), move.alias("moved"))


def clip_levels(clips: DataFrame, levels: DataFrame, keys: list[str], ids: list[str], within) -> DataFrame:
    """keys, ids, clip_level: median of the clip's levels that are within `within` of its loudest. clips: first_hop, last_hop. The levels of one clip, which are seconds, meet in a task."""
    rows = clips.withColumn("hop_idx", F.explode(F.sequence("first_hop", "last_hop"))).join(levels, [*keys, "hop_idx"])
    top = F.max("level").over(W.partitionBy(*keys, *ids))
    return rows.withColumn("_top", top).filter(F.col("level") >= F.col("_top") - within).groupBy(*keys, *ids).agg(F.median("level").alias("clip_level"))


def balance_gains(clips: DataFrame, key: str) -> DataFrame:
    """gain = three quarters of the distance to the key's median level, at most 5, nothing below 0.3; 0 for an unknown level."""
    mid = clips.groupBy(key).agg(F.median("clip_level").alias("_m"))
    g = F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (F.col("_m") - F.col("clip_level")) * 0.75))
    gain = F.when(F.col("clip_level").isNull() | (F.abs(g) < 0.3), F.lit(0.0)).otherwise(F.bround(g, 2))
    return clips.join(mid, key).withColumn("gain", gain).drop("_m")


def level_steps(clips: DataFrame, key: str, most) -> DataFrame:
    """key, spread, n_flagged: largest difference of clip levels, and clips further than `most` from the median."""
    mid = clips.groupBy(key).agg(F.median("clip_level").alias("m"), (F.max("clip_level") - F.min("clip_level")).alias("spread"))
    return clips.join(mid, key).groupBy(key, "spread").agg(F.count_if(F.abs(F.col("clip_level") - F.col("m")) > most).alias("n_flagged"))


def level_at(points: DataFrame, levels: DataFrame, keys: list[str], ids: list[str], at: Column) -> DataFrame:
    """keys, ids, level_at: linear interpolation on the hop grid at a fractional hop; null (minus infinity) outside it."""
    rows = points.withColumns({"_p": at, "_i": F.floor(at).cast("long")})
    a = levels.select(*keys, F.col("hop_idx").alias("_i"), F.col("level").alias("_a"))
    b = levels.select(*keys, (F.col("hop_idx") - 1).alias("_i"), F.col("level").alias("_b"))
    both = rows.join(a, [*keys, "_i"], "left").join(b, [*keys, "_i"], "left")
    f = F.col("_p") - F.col("_i")
    return both.select(*keys, *ids, F.when(f == 0, F.col("_a")).otherwise(F.col("_a") * (1 - f) + F.col("_b") * f).alias("level_at"))


def map_time(points: DataFrame, offsets: DataFrame, t: str = "t") -> DataFrame:
    """points (ref, other, t) with t_other = t + offset(t) and the offset; offsets are a small dimension table."""
    off = F.when(F.col("slope").isNull(), F.col("offset_start")).otherwise(F.col("slope") * F.col(t) + F.coalesce("intercept", "offset_start"))
    return points.join(offsets, ["ref", "other"]).withColumns({"offset": off, "t_other": F.col(t) + off})


def overlap_window(pairs: DataFrame, guard=0) -> DataFrame:
    """ref_start, ref_end: where the mapped time is inside the other recording, less a guard at both ends; null if empty.

    pairs: offset_start, slope, intercept, ref_duration, other_duration.
    """
    s, c = F.coalesce("slope", F.lit(0.0)), F.coalesce("intercept", "offset_start")
    lo = F.greatest(F.lit(0.0), -c / (1 + s)) + guard
    hi = F.least(F.col("ref_duration"), (F.col("other_duration") - c) / (1 + s)) - guard
    return pairs.withColumns({"ref_start": F.when(hi > lo, lo), "ref_end": F.when(hi > lo, hi)})


def motion_signal(frames: DataFrame, keys: list[str], n: int = 31) -> DataFrame:
    """|difference| of consecutive values less its moving average, as z-scores per key."""
    order = W.partitionBy(*keys).orderBy("hop_idx")
    d = frames.withColumn("level", F.abs(F.col("level") - F.lag("level").over(order))).filter("level IS NOT NULL")
    r = moving_average(d, keys, n).withColumn("r", F.col("level") - F.col("smooth"))
    whole = W.partitionBy(*keys)
    return r.select(*keys, "hop_idx", ((F.col("r") - F.avg("r").over(whole)) / (F.stddev_pop("r").over(whole) + F.lit(1e-9))).alias("motion"))


def lag_scan(a: DataFrame, b: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, lag, n, dot: sums of products of a at i and b at i + lag for |lag| <= most. a, b: hop_idx, x and hop_idx, y.

    Every row of a meets 2 * most + 1 rows of b, by equi-join on key and hop.
    """
    moved = a.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("hop_idx", F.col("hop_idx") + F.col("lag"))
    return moved.join(b, [*keys, "hop_idx"]).groupBy(*keys, "lag").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("y")).alias("dot"))


def motion_offset(scan: DataFrame, keys: list[str], apart: int = 3) -> DataFrame:
    """Best lag by mean product, and the best value further than `apart` from it."""
    mean = scan.withColumn("v", F.col("dot") / F.col("n"))
    best = mean.groupBy(*keys).agg(F.max(F.struct("v", -F.col("lag"))).alias("b")).select(*keys, F.col("b.v").alias("peak"), (-F.col("b.col2")).alias("lag"))
    rest = mean.join(best.select(*keys, F.col("lag").alias("_l")), keys).filter(F.abs(F.col("lag") - F.col("_l")) > apart).groupBy(*keys).agg(F.max("v").alias("next_peak"))
    return best.join(rest, keys, "left")


def best_offset(points: DataFrame, keys: list[str], least_score: float) -> DataFrame:
    """The window with the best score (envelope method counts tenfold), the first of equals; low: below least_score."""
    s = F.when(F.col("method") == "envelope", F.col("score") * 10).otherwise(F.col("score"))
    b = points.groupBy(*keys).agg(F.max_by(F.struct("window_idx", "offset", s.alias("score")), F.struct(s, -F.col("window_idx"))).alias("b")).select(*keys, "b.*")
    return b.withColumn("low", F.col("score") < least_score)


def filter_outliers(points: DataFrame, keys: list[str], most) -> DataFrame:
    """Points within `most` of the key's median offset; keys of fewer than four points keep all."""
    mid = points.groupBy(*keys).agg(F.median("offset").alias("_m"), F.count("*").alias("_n"))
    return points.join(mid, keys).filter((F.col("_n") < 4) | (F.abs(F.col("offset") - F.col("_m")) <= most)).drop("_m", "_n")


def fit_drift(points: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Weighted line through (t, offset): weights multiply residuals, so they count squared in the fit and plainly in the mean square. One aggregation for the fit, one for its error."""
    q = F.col("w") * F.col("w")
    t, o = F.col("t"), F.col("offset")
    s = points.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(q).alias("a"), F.sum(q * t).alias("b"), F.sum(q * o).alias("c"), F.sum(q * t * t).alias("d"), F.sum(q * t * o).alias("e")).filter(F.col("n") >= least)
    slope = (F.col("a") * F.col("e") - F.col("b") * F.col("c")) / (F.col("a") * F.col("d") - F.col("b") * F.col("b"))
    line = s.withColumn("slope", slope).withColumn("intercept", (F.col("c") - F.col("slope") * F.col("b")) / F.col("a")).select(*keys, "n", "slope", "intercept")
    r = F.col("offset") - F.col("slope") * F.col("t") - F.col("intercept")
    error = points.join(line, keys).groupBy(*keys).agg((F.sum(F.col("w") * r * r) / F.sum("w")).alias("mse"))
    return line.join(error, keys).withColumns({"ppm": F.col("slope") * 1e6, "drift_per_hour": F.col("slope") * 3600})


def end_window_drift(rows: DataFrame) -> DataFrame:
    """slope from the offsets of a first and a last window."""
    return rows.withColumn("slope", F.try_divide(F.col("end_offset") - F.col("start_offset"), F.col("end_t") - F.col("start_t")))


def sync_summary(windows: DataFrame, key: str, least_corr: float = 0.25, frame: float = 1 / 30) -> DataFrame:
    """Median and largest lag, the drift of confident windows, and whether both stay within a frame."""
    sure = F.col("correlation") >= least_corr
    agg = windows.groupBy(key).agg(F.median("lag").alias("median_lag"), F.max(F.abs("lag")).alias("max_lag"), F.max(F.when(sure, F.abs("lag"))).alias("sure_max"), (F.max(F.when(sure, F.col("lag"))) - F.min(F.when(sure, F.col("lag")))).alias("drift"))
    return agg.withColumn("in_sync", (F.abs("median_lag") <= frame) & (F.coalesce("sure_max", F.lit(0.0)) <= frame))


def transcript_coverage(segments: DataFrame, recordings: DataFrame, key: str, slack=3000) -> DataFrame:
    last = segments.groupBy(key).agg(F.max("end_ms").alias("text_end_ms"))
    return recordings.join(last, key, "left").withColumn("stops_early", F.coalesce("text_end_ms", F.lit(0)) < F.col("duration_ms") - slack)


def caption_pass_rate(captions: DataFrame, key: str) -> DataFrame:
    """Passed, total and the times of those that failed, in order."""
    return captions.groupBy(key).agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n_total"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("time")))).alias("failed_times"))


def qc_report(checks: DataFrame, sync: DataFrame, captions: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """Verdict per reel from its checks (frozen picture waived by still_ok), sync (waived by remeasured) and captions, with text and all_ok over all reels."""
    rows = checks.join(sync, key, "left").join(captions, key, "left").join(notes, key, "left")
    still, again = F.coalesce("still_ok", F.lit(False)), F.coalesce("remeasured", F.lit(False))
    failed = F.filter("failed", lambda x: ~(still & (x == "no_freeze")))
    sync_ok = F.coalesce("in_sync", F.lit(True)) | again
    caps_ok = F.coalesce(F.col("n_passed") == F.col("n_total"), F.lit(True))
    ok = (F.size(failed) == 0) & sync_ok & caps_ok
    text = F.concat_ws("; ", F.when(F.size(failed) > 0, F.concat(F.lit("failed: "), F.array_join(failed, ", "))), F.when(~sync_ok, F.lit("out of sync")), F.when(~caps_ok, F.lit("captions")))
    out = rows.select(key, ok.alias("ok"), text.alias("text"))
    return out.crossJoin(F.broadcast(out.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("all_ok"))))
