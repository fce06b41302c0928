"""Interval algebra per key.

Tables carry key columns, `start` and `end` columns (any numeric unit). Ordered rules are
windows over one key; joins are equi-joins on key and time bucket, so a recording of any
length spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import running

START, END = "start_ms", "end_ms"


#: Width of the time blocks over which a long recording is spread, in the unit of its times.
BLOCK = 3_600_000


def _joined_in_order(rows: DataFrame, by: list[str], gap, start: str, end: str) -> DataFrame:
    order = W.partitionBy(*by).orderBy(start, end)
    upto = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(F.col(start) > upto + F.lit(gap), F.lit(True)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def merge_intervals(df: DataFrame, keys: list[str], gap=0, start: str = START, end: str = END, block=BLOCK) -> DataFrame:
    """keys, start, end: empty intervals dropped; joined where start <= running end + gap (touching joins).

    In two levels: blocks of time are merged by themselves, so that a recording's intervals are
    spread over tasks; then what they have left, no more than the result and one a block, is
    merged in order. An interval is in the block of its start, and all starts of a block come
    before those of the next, so both levels join what one would.
    """
    rows = df.select(*keys, start, end).filter(F.col(end) > F.col(start)).withColumn("_block", F.floor(F.col(start) / F.lit(block)))
    return _joined_in_order(_joined_in_order(rows, [*keys, "_block"], gap, start, end).drop("_block"), keys, gap, start, end)


def speech_intervals(segments: DataFrame, keys: list[str], lo: Column, hi: Column, least, gap, start: str = START, end: str = END) -> DataFrame:
    """Segments with text, clipped to [lo, hi], at least `least` long, merged with gap."""
    spoken = segments.filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    clipped = spoken.select(*keys, F.greatest(lo, F.col(start)).alias(start), F.least(hi, F.col(end)).alias(end))
    return merge_intervals(clipped.filter(F.col(end) - F.col(start) >= F.lit(least)), keys, gap, start, end)


def complement(merged: DataFrame, bounds: DataFrame, keys: list[str], least=0, start: str = START, end: str = END) -> DataFrame:
    """Gaps between merged intervals inside the bounds (keys, lo, hi), longer than zero and at least `least`.

    A bound with no interval is one gap. Bound rows are the sentinels of the window, so keys
    are shuffled once.
    """
    cut = merged.join(bounds, keys).select(*keys, F.greatest(start, "lo").alias(start), F.least(end, "hi").alias(end)).filter(F.col(end) > F.col(start))
    marks = cut.unionByName(bounds.select(*keys, F.col("lo").alias(start), F.col("lo").alias(end))).unionByName(bounds.select(*keys, F.col("hi").alias(start), F.col("hi").alias(end)))
    order = W.partitionBy(*keys).orderBy(start, end)
    gaps = marks.select(*keys, F.lag(end).over(order).alias("_a"), F.col(start).alias("_b"))
    return gaps.filter((F.col("_b") > F.col("_a")) & (F.col("_b") - F.col("_a") >= F.lit(least))).select(*keys, F.col("_a").alias(start), F.col("_b").alias(end))


#: Fixed values: (least pause, kept share in percent, least and most kept, merge gap, least speech), milliseconds.
PAUSE_PROFILES = {"soft": (450, 70, 200, 420, 140, 100), "medium": (380, 55, 160, 340, 120, 90), "aggressive": (320, 42, 120, 280, 100, 80)}
LEAST_CUT = 30


def pauses(segments: DataFrame, bounds: DataFrame, keys: list[str], profile: str) -> DataFrame:
    """Gaps in speech inside the bounds, of at least the profile's pause; keys without speech have none."""
    least, _, _, _, gap, speech = PAUSE_PROFILES[profile]
    inside = segments.join(bounds, keys)
    spoken = speech_intervals(inside, keys, F.col("lo"), F.col("hi"), speech, gap)
    return complement(spoken, bounds.join(spoken.select(*keys).distinct(), keys, "left_semi"), keys, least)


def pause_cuts(segments: DataFrame, bounds: DataFrame, keys: list[str], profile: str) -> DataFrame:
    """The middle of each long pause, leaving the profile's share of it: keys, start, end (whole milliseconds, halves down and up)."""
    _, share, low, high, _, _ = PAUSE_PROFILES[profile]
    rows = pauses(segments, bounds, keys, profile)
    length = F.col(END) - F.col(START)
    keep = F.least(F.greatest(F.lit(low), F.least(F.lit(high), F.floor(length * share / 100))), length)
    rows = rows.withColumn("_cut", (length - keep).cast("long")).filter(F.col("_cut") >= LEAST_CUT)
    half = F.expr("_cut div 2")
    cuts = rows.select(*keys, (F.col(START) + half).alias(START), (F.col(END) - half).alias(END)).filter(F.col(END) - F.col(START) >= LEAST_CUT)
    return merge_intervals(cuts, keys)


def pause_summary(cuts: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_cuts, removed, output (what is left of the bounds)."""
    total = cuts.groupBy(*keys).agg(F.count("*").alias("n_cuts"), F.sum(F.col(END) - F.col(START)).alias("removed_ms"))
    rows = bounds.join(total, keys, "left").withColumns({"n_cuts": F.coalesce("n_cuts", F.lit(0).cast("long")), "removed_ms": F.coalesce("removed_ms", F.lit(0).cast("long"))})
    return rows.select(*keys, "n_cuts", "removed_ms", (F.col("hi") - F.col("lo") - F.col("removed_ms")).alias("output_ms"))


def bucketed(df: DataFrame, width, start: str, end: str, name: str) -> DataFrame:
    """A row per time bucket that [start, end) touches, with the first one."""
    first = F.floor(F.col(start) / F.lit(width)).cast("long")
    last = F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / F.lit(width)).cast("long")
    return df.withColumn(f"_first_{name}", first).withColumn("_bucket", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width=60_000, how: str = "inner") -> DataFrame:
    """Pairs with left.end > right.start and left.start < right.end.

    left has start_ms and end_ms, right r_start_ms and r_end_ms. Both are dealt to time
    buckets; a pair is kept in the first bucket common to both, so none appears twice.
    Adds clip_start_ms, clip_end_ms, overlap_ms. width None: a key's buckets are as wide as its
    intervals are on average, on the side where they are longer, and so deal a key to no more
    than three rows an interval, however long these are; a DataFrame: keys and such a _width.
    """
    left, right = left.filter(F.col(END) > F.col(START)), right.filter(F.col("r_end_ms") > F.col("r_start_ms"))
    if width is None:
        mean = lambda df, start, end, name: df.groupBy(*keys).agg(F.avg(F.col(end) - F.col(start)).alias(name))
        fit = mean(left, START, END, "_l").join(mean(right, "r_start_ms", "r_end_ms", "_r"), keys)
        width = fit.select(*keys, F.ceil(F.greatest("_l", "_r")).cast("long").alias("_width"))
    if isinstance(width, DataFrame):
        left, right, width = left.join(width, keys), right.join(width, keys), F.col("_width")
    a = bucketed(left, width, START, END, "l").drop("_width")
    b = bucketed(right, width, "r_start_ms", "r_end_ms", "r").drop("_width")
    pairs = a.join(b, [*keys, "_bucket"]).filter((F.col(END) > F.col("r_start_ms")) & (F.col(START) < F.col("r_end_ms")) & (F.col("_bucket") == F.greatest("_first_l", "_first_r")))
    s, e = F.greatest(START, "r_start_ms"), F.least(END, "r_end_ms")
    return pairs.drop("_bucket", "_first_l", "_first_r").withColumns({"clip_start_ms": s, "clip_end_ms": e, "overlap_ms": e - s})


def subtract_intervals(df: DataFrame, cuts: DataFrame, keys: list[str], ids: list[str], least=0, width=60_000) -> DataFrame:
    """Pieces of each interval (keys, ids) outside the merged cuts, at least `least` long and not empty. width: as overlap_join's.

    Each interval's cuts inside it and its own ends are the sentinels of one window.
    """
    renamed = cuts.withColumnsRenamed({START: "r_start_ms", END: "r_end_ms"})
    inside = overlap_join(df, renamed, keys, width).select(*keys, *ids, F.col("clip_start_ms").alias("a"), F.col("clip_end_ms").alias("b"))
    own = df.filter(F.col(END) > F.col(START))
    ends = own.select(*keys, *ids, F.explode(F.array(START, END)).alias("a")).withColumn("b", F.col("a"))
    order = W.partitionBy(*keys, *ids).orderBy("a", "b")
    gaps = inside.unionByName(ends).select(*keys, *ids, F.lag("b").over(order).alias(START), F.col("a").alias(END))
    return gaps.filter((F.col(END) > F.col(START)) & (F.col(END) - F.col(START) >= F.lit(least)))


def removed_before(points: DataFrame, cuts: DataFrame, keys: list[str], at: str = "t_ms", block=BLOCK) -> DataFrame:
    """points with removed_ms: how much of the merged cuts lies before t, a cut around t counted up to t.

    Running sums over the union of points and cuts, by blocks of time: no pair of a point and all
    cuts before it is made, and a recording is not one task's.
    """
    c = cuts.select(*keys, F.col(START).alias("_t"), F.lit(0).alias("_kind"), F.col(START).alias("_s"), F.col(END).alias("_e"))
    names = [n for n in points.columns if n not in keys]
    p = points.withColumns({"_t": F.col(at), "_kind": F.lit(1), "_s": F.lit(None).cast("long"), "_e": F.lit(None).cast("long")})
    both = p.unionByName(c, allowMissingColumns=True)
    # Merged cuts end in the order in which they begin.
    both = running(both, keys, F.floor(F.col("_t") / F.lit(block)), ["_t", "_kind"], {"_whole": ("sum", F.col("_e") - F.col("_s")), "_last": ("max", F.col("_e"))})
    over = F.greatest(F.lit(0), F.coalesce("_last", "_t") - F.col("_t"))
    rows = both.withColumn("removed_ms", (F.coalesce("_whole", F.lit(0)) - over).cast("long")).filter("_kind = 1")
    return rows.select(*keys, *names, "removed_ms")


def coalesce_shots(shots: DataFrame, keys: list[str], eps, least=10) -> DataFrame:
    """Shots (camera, audio_camera, start, end): those of at most `least` dropped, neighbours with both cameras equal and a gap within eps joined."""
    rows = shots.withColumn("audio_camera", F.coalesce("audio_camera", "camera")).filter(F.col("camera").isNotNull() & (F.col(END) - F.col(START) > F.lit(least)))
    order = W.partitionBy(*keys).orderBy(START, END)
    same = (F.lag("camera").over(order) == F.col("camera")) & (F.lag("audio_camera").over(order) == F.col("audio_camera")) & (F.abs(F.lag(END).over(order) - F.col(START)) <= F.lit(eps))
    rows = rows.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_run").agg(F.first("camera").alias("camera"), F.first("audio_camera").alias("audio_camera"), F.min(START).alias(START), F.max_by(END, START).alias(END)).drop("_run")


def run_length(steps: DataFrame, keys: list[str], order_by: str, value: str) -> DataFrame:
    """Runs of one value in order: keys, value, first, last, n."""
    order = W.partitionBy(*keys).orderBy(order_by)
    rows = steps.withColumn("_new", F.coalesce(~F.lag(value).over(order).eqNullSafe(F.col(value)) | F.lag(order_by).over(order).isNull(), F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_run", value).agg(F.min(order_by).alias("first"), F.max(order_by).alias("last"), F.count("*").alias("n")).drop("_run")


def run_length_shots(steps: DataFrame, keys: list[str], step_ms: int, end_ms: Column) -> DataFrame:
    """steps (step, camera) to shots: each run from its first step to the next run's first, the last to end_ms."""
    runs = run_length(steps, keys, "step", "camera")
    following = F.lead("first").over(W.partitionBy(*keys).orderBy("first")) * step_ms
    return runs.select(*keys, "camera", F.col("camera").alias("audio_camera"), (F.col("first") * step_ms).alias(START), F.coalesce(F.least(following, end_ms), end_ms).alias(END))


def covers_range(shots: DataFrame, bounds: DataFrame, keys: list[str], tolerance=30, block=BLOCK) -> DataFrame:
    """keys, covered: whether the intervals cover the bounds with no hole longer than the tolerance."""
    rows = running(shots, keys, F.floor(F.col(START) / F.lit(block)), [START, END], {"_upto": ("max", F.col(END))}, before=True)
    rows = rows.withColumn("_hole", F.col(START) - F.col("_upto"))
    agg = rows.groupBy(*keys).agg(F.min(START).alias("a"), F.max(END).alias("b"), F.max_by(END, F.struct(START, END)).alias("last"), F.coalesce(F.max("_hole"), F.lit(0)).alias("hole"))
    ok = (F.abs(F.col("a") - F.col("lo")) <= tolerance) & (F.abs(F.col("b") - F.col("hi")) <= tolerance) & (F.abs(F.col("last") - F.col("hi")) <= tolerance) & (F.col("hole") <= tolerance)
    return bounds.join(agg, keys, "left").select(*keys, F.coalesce(ok, F.lit(False)).alias("covered"))


def pause_groups(segments: DataFrame, keys: list[str], gap=2400) -> DataFrame:
    """segments with group_idx (from 0): a new group where silence since the previous segment is longer than gap."""
    order = W.partitionBy(*keys).orderBy(START, END)
    new = F.coalesce(F.col(START) - F.lag(END).over(order) > gap, F.lit(False)).cast("int")
    return segments.withColumn("_new", new).withColumn("group_idx", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def silence_intervals(levels: DataFrame, keys: list[str], threshold: Column, hop_ms: int, least_ms: int) -> DataFrame:
    """Runs of consecutive hops below the threshold, at least least_ms long."""
    quiet = levels.filter(F.col("level") < threshold)
    order = W.partitionBy(*keys).orderBy("hop_idx")
    runs = quiet.withColumn("_run", F.col("hop_idx") - F.row_number().over(order)).groupBy(*keys, "_run").agg(F.min("hop_idx").alias("a"), F.max("hop_idx").alias("b"))
    return runs.select(*keys, (F.col("a") * hop_ms).alias(START), ((F.col("b") + 1) * hop_ms).alias(END)).filter(F.col(END) - F.col(START) >= least_ms)


def windows(bounds: DataFrame, keys: list[str], length: int, step: int, least_last: int = 0) -> DataFrame:
    """Sliding windows over the bounds: window_idx, start, end (clipped); a last one of at most least_last is dropped."""
    n = F.greatest(F.lit(0), F.ceil((F.col("hi") - F.col("lo")) / step)).cast("long")
    rows = bounds.filter(F.col("hi") > F.col("lo")).withColumn("window_idx", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    rows = rows.select(*keys, "window_idx", (F.col("lo") + F.col("window_idx") * step).alias(START), F.least(F.col("hi"), F.col("lo") + F.col("window_idx") * step + length).alias(END))
    return rows.filter(F.col(END) - F.col(START) > least_last)


def best_speech_window(speech: DataFrame, bounds: DataFrame, keys: list[str], length: int, step: int) -> DataFrame:
    """Per key the full window with the most speech, the first of equals; the whole range where it is no longer than length."""
    short = bounds.filter(F.col("hi") - F.col("lo") <= length).select(*keys, F.col("lo").alias(START), F.col("hi").alias(END))
    full = windows(bounds.filter(F.col("hi") - F.col("lo") > length), keys, length, step).filter(F.col(END) - F.col(START) == length)
    hit = overlap_join(full, speech.withColumnsRenamed({START: "r_start_ms", END: "r_end_ms"}), keys, length)
    spoken = full.join(hit.groupBy(*keys, "window_idx").agg(F.sum("overlap_ms").alias("speech_ms")), [*keys, "window_idx"], "left").withColumn("speech_ms", F.coalesce("speech_ms", F.lit(0)))
    best = spoken.groupBy(*keys).agg(F.max_by(F.struct(START, END), F.struct("speech_ms", -F.col("window_idx"))).alias("w")).select(*keys, f"w.{START}", f"w.{END}")
    return best.unionByName(short)
