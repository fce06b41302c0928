"""Offset and drift of recordings that are stored as chunks, of any length.

tracks: key columns, start_sample, samples; chunks of a track touch and do not overlap. Times
are seconds, offsets add to the reference's time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import END, START, overlap_join
from .levels import best_offset, filter_outliers, fit_drift
from .signal import estimate_offset


def cut(tracks: DataFrame, windows: DataFrame, keys: list[str], ids: list[str], width: int = 480_000) -> DataFrame:
    """keys, ids, samples of each window (lo, hi: sample numbers) as far as its track goes; windows that a track has nothing of are left out. Only the samples asked for travel."""
    w = windows.select(*keys, *ids, F.col("lo").alias(START), F.col("hi").alias(END))
    t = tracks.select(*keys, F.col("start_sample").alias("r_start_ms"), (F.col("start_sample") + F.size("samples")).alias("r_end_ms"), F.col("samples").cast("array<double>").alias("samples"))
    parts = overlap_join(w, t, keys, width)
    inside = F.slice("samples", (F.col("clip_start_ms") - F.col("r_start_ms") + 1).cast("int"), F.col("overlap_ms").cast("int"))
    pieces = F.array_sort(F.collect_list(F.struct(F.col("clip_start_ms").alias("at"), inside.alias("x"))))
    return parts.groupBy(*keys, *ids).agg(F.flatten(F.transform(pieces, lambda p: p["x"])).alias("samples"))


def offset_points(tracks: DataFrame, pairs: DataFrame, window_s: float, step_s: float, most_s: float, least_score: float, rate: int, method: str = "best") -> DataFrame:
    """ref, other, window_idx, t, offset, confidence, method, score: the offset in windows from fit_start to fit_start + fit_duration, both included, where its score is enough. The score of an envelope is ten times its correlation. tracks: track, ...; pairs: ref, other, fit_start, fit_duration."""
    start = F.greatest(F.lit(0.0), F.col("fit_start").cast("double"))
    n = F.floor(F.greatest(F.lit(0.0), F.col("fit_duration").cast("double")) / step_s + 1e-9)
    w = pairs.select("ref", "other", start.alias("t0"), F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("window_idx"))
    w = w.withColumn("t", F.col("t0") + F.col("window_idx") * step_s).withColumn("lo", F.bround(F.col("t") * rate).cast("long")).withColumn("hi", F.col("lo") + round(window_s * rate))
    ids = ["ref", "other", "window_idx", "t"]
    sides = [cut(tracks, w.withColumn("track", F.col(c)), ["track"], ids).drop("track").withColumnRenamed("samples", name) for c, name in (("ref", "a"), ("other", "b"))]
    points = estimate_offset(sides[0].join(sides[1], ids), ids, most_s, float(rate), method)
    score = F.when(F.col("method") == "envelope", F.col("confidence") * 10).otherwise(F.col("confidence"))
    return points.withColumn("score", score).filter(F.col("score") >= least_score)


def sync_model(points: DataFrame, outlier_s: float, least_points: int = 2) -> DataFrame:
    """ref, other, offset_start (of the best window), low, n, slope, intercept, mse, ppm, drift_per_hour: the line through the offsets without outliers; nulls where fewer than least_points are left."""
    keys = ["ref", "other"]
    best = best_offset(points.withColumn("score", F.col("confidence")), keys, 0.0).select(*keys, F.col("offset").alias("offset_start"), "low")
    used = filter_outliers(points, keys, outlier_s) if outlier_s > 0 else points
    weight = F.greatest(F.col("score"), F.lit(1e-6))
    line = fit_drift(used.select(*keys, F.col("t"), "offset", weight.alias("w")), keys, max(2, least_points))
    return best.join(line, keys, "left")


def sync_recordings(tracks: DataFrame, pairs: DataFrame, rate: int, window_s: float = 30.0, step_s: float = 60.0, most_s: float = 5.0, least_score: float = 0.0, outlier_s: float = 0.25, least_points: int = 2, method: str = "best") -> DataFrame:
    """The whole job per pair: windows, their samples out of the chunks, offsets, outliers, best window and drift line. A task holds a window, never a recording."""
    return sync_model(offset_points(tracks, pairs, window_s, step_s, most_s, least_score, rate, method), outlier_s, least_points)


def long_xcorr(tracks: DataFrame, pairs: DataFrame, most: int, block: int = 1 << 18, width: int = 480_000) -> DataFrame:
    """ref, other, lag, score: plain correlation of whole tracks, as estimate_offset's xcorr gives it for short ones.

    The reference is cut into blocks; each is correlated by FFT with the stretch of the other
    track that its lags reach, and the sums by lag of all blocks are added up, first in the tasks.
    Means and energies are aggregates over the chunks. Tasks hold a block with its margins.
    pairs: ref, other; lags reach from -most to most, as far as both tracks go.
    """
    x = F.col("samples").cast("array<double>")
    total = lambda f: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))
    facts = tracks.groupBy("track").agg(F.max(F.col("start_sample") + F.size("samples")).alias("len"), F.sum(total(lambda v: v)).alias("s"), F.sum(total(lambda v: v * v)).alias("q"))
    facts = facts.filter("len > 0").select("track", "len", (F.col("s") / F.col("len")).alias("mean"), (F.col("q") - F.col("s") * F.col("s") / F.col("len")).alias("energy"))
    both = pairs.select("ref", "other")
    for side, p in (("ref", "a"), ("other", "b")):
        both = both.join(facts.withColumnsRenamed({"track": side, "len": f"len_{p}", "mean": f"mean_{p}", "energy": f"energy_{p}"}), side)
    blocks = both.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("len_a") / block) - 1)))
    lo, hi = F.col("k") * block, F.least((F.col("k") + 1) * block, F.col("len_a"))
    ids = ["ref", "other", "k"]
    a = cut(tracks, blocks.select(F.col("ref").alias("track"), *ids, lo.alias("lo"), hi.alias("hi")), ["track"], ids, width).drop("track").withColumnRenamed("samples", "a")
    b = cut(tracks, blocks.select(F.col("other").alias("track"), *ids, F.greatest(F.lit(0), lo - most).alias("lo"), F.least(hi + most, F.col("len_b")).alias("hi")), ["track"], ids, width).drop("track").withColumnRenamed("samples", "b")
    rows = blocks.join(a, ids).join(b, ids)
    kinds = dict(pairs.dtypes)

    def sums(batches):
        held: dict = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, y = np.asarray(r.a, float) - r.mean_a, np.asarray(r.b, float) - r.mean_b
                n = 1 << (len(x) + len(y) - 1).bit_length()
                c = np.fft.irfft(np.conj(np.fft.rfft(x, n)) * np.fft.rfft(y, n), n)
                at = np.arange(-most, most + 1) + r.k * block - max(0, r.k * block - most)  # place of each lag from where b's stretch begins
                inside = (at > -len(x)) & (at < len(y))
                held.setdefault((r.ref, r.other), np.zeros(2 * most + 1))[inside] += c[at[inside]]
            while len(held) > 64:
                yield frame([next(iter(held.items()))])
                held.pop(next(iter(held)))
        if held:
            yield frame(held.items())

    def frame(items):
        return pd.DataFrame([(*pair, v) for pair, v in items], columns=["ref", "other", "v"])

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        lags = np.arange(-min(most, int(r.len_a) - 1), min(most, int(r.len_b) - 1) + 1)
        v = np.sum(np.stack(pdf["v"].to_numpy()), 0)[lags + most]
        k = int(v.argmax())
        return pd.DataFrame({"ref": [r.ref], "other": [r.other], "lag": [int(lags[k])], "score": [v[k] / (np.sqrt(max(0.0, r.energy_a * r.energy_b)) + 1e-12)]})

    part = rows.select(*ids, "a", "b", "mean_a", "mean_b").mapInPandas(sums, f"ref {kinds['ref']}, other {kinds['other']}, v array<double>")
    return part.join(both, ["ref", "other"]).groupBy("ref", "other").applyInPandas(best, f"ref {kinds['ref']}, other {kinds['other']}, lag long, score double")
