"""Gated mix of a recording's cameras into one track, by output chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import END, START, overlap_join


def samples_at(ms: Column, rate: Column) -> Column:
    return F.bround(ms / 1000 * rate).cast("long")


def output_chunks(ranges: DataFrame, key: str, chunk_s: float) -> DataFrame:
    """ranges (key, sr, start_ms, end_ms) with total (samples), chunk_idx, first (sample of the range), n: a row per chunk."""
    size = F.bround(F.lit(float(chunk_s)) * F.col("sr")).cast("long")
    rows = ranges.withColumns({"total": samples_at(F.col(END) - F.col(START), F.col("sr")), "size": F.when(size > 0, size).otherwise(F.col("sr"))}).filter("total > 0")
    rows = rows.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") / F.col("size")) - 1)))
    return rows.withColumn("first", F.col("chunk_idx") * F.col("size")).withColumn("n", F.least("size", F.col("total") - F.col("first"))).drop("size")


def spans_on_air(shots: DataFrame, cameras: DataFrame, ranges: DataFrame, key: str, fade: Column) -> DataFrame:
    """key, camera, from, to: which camera is on air, in samples of the range.

    The first camera by position is on before the first shot; a camera stays on in gaps, and
    one that is not known is the first. Shots do not overlap (of those that do, the later one is
    on from its start).
    """
    first = cameras.groupBy(key).agg(F.min_by("camera", "camera_pos").alias("head"))
    base = ranges.filter(F.col(END) > F.col(START)).select(key, "sr", F.col(START).alias("zero"), samples_at(F.col(END) - F.col(START), F.col("sr")).alias("total"), fade.alias("fade")).join(first, key)
    known = cameras.select(key, F.col("camera").alias("name"), F.col("camera").alias("known"))
    at = lambda c: F.greatest(F.lit(0), samples_at(F.col(c) - F.col("zero"), F.col("sr")))
    s = shots.select(key, F.coalesce("audio_camera", "camera").alias("name"), START, END).join(base, key).join(known, [key, "name"], "left")
    s = s.select(key, F.coalesce("known", "head").alias("camera"), at(START).alias("from"), at(END).alias("to"), "total").filter("to > from AND from < total").drop("to", "total")
    s = s.unionByName(base.select(key, F.col("head").alias("camera"), (-F.col("fade") - 1).alias("from")))
    by = W.partitionBy(key).orderBy("from")
    s = s.withColumn("was", F.lag("camera").over(by)).filter("was IS NULL OR was <> camera")
    s = s.withColumn("to", F.lead("from").over(by)).join(base.select(key, "total"), key)
    return s.select(key, "camera", "from", F.coalesce("to", "total").alias("to")).filter("to > from")


def gains(first: int, n: int, camera: str, spans: list[tuple[int, str]], fade: int, low: float) -> np.ndarray:
    """Gain of camera for n samples from first: 1 on air, low otherwise, and a line between them for `fade` samples from each switch of its own; a later switch overrules. spans: (from, camera) in order, the first holds at first - fade."""
    at = np.arange(first, first + n)
    on = np.array([c == camera for _, c in spans])
    out = np.where(on[np.searchsorted([s for s, _ in spans], at, "right") - 1], 1.0, low)
    for (_, before), (start, after) in zip(spans, spans[1:], strict=False):
        if camera in (before, after) and fade > 1:
            a, z = np.clip([start - first, start - first + fade], 0, n)
            ramp = (at[a:z] - start) / fade
            out[a:z] = (1 - ramp) + ramp * low if camera == before else (1 - ramp) * low + ramp
    return out


def resampled(idx: np.ndarray, pieces: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Linear interpolation at fractional sample numbers; 0 where one of the two samples is missing."""
    i = np.floor(idx).astype(np.int64)
    low, size = i.min(), i.max() - i.min() + 2
    x, there = np.zeros(size), np.zeros(size, bool)
    for start, samples in pieces:
        a, z = max(start, low), min(start + len(samples), low + size)
        if a < z:
            x[a - low : z - low] = samples[a - start : z - start]
            there[a - low : z - low] = True
    i -= low
    part = idx - np.floor(idx)
    return np.where(there[i] & there[i + 1], x[i] * (1 - part) + x[i + 1] * part, 0.0)


def gated_mix(sources: DataFrame, cameras: DataFrame, shots: DataFrame, ranges: DataFrame, key: str, chunk_s: float = 10.0, fade_s: float = 0.08, duck_db: float = 18.0, hard_gate: bool = False, width: int = 480_000) -> DataFrame:
    """key, chunk_idx, start_sample, mixed: the camera on air at gain 1, the others ducked (hard_gate: silent), resampled at mapped times, summed and clipped to -1..1.

    sources: key, camera, start_sample, samples (chunks of a camera's track at the recording's
    rate); cameras: key, camera, camera_pos, offset_start, slope, intercept (seconds; without a
    slope the offset is constant, null is none), audio_start_s, shift_db; shots: key, camera,
    audio_camera, start_ms, end_ms; ranges: key, sr, start_ms, end_ms.

    Output chunks are the unit of work. Each is joined to the source chunks that hold its
    samples at the mapped time, one more at the end for interpolation, of which only those
    samples travel; and to the spans on air from one fade before it. So the result does not
    depend on the chunks, a chunk's memory is that of its samples, and a recording is spread
    over tasks. Fades start at the switch and are not cut at chunk ends.
    """
    fade = F.bround(F.lit(float(fade_s)) * F.col("sr")).cast("long")
    low = 0.0 if hard_gate else 10 ** (-duck_db / 20)
    out = output_chunks(ranges.select(key, "sr", START, END), key, chunk_s)
    spans = spans_on_air(shots, cameras, ranges, key, fade)
    heads = out.select(key, "chunk_idx", "first", "n", "sr", F.col(START).alias("zero"), (F.col("first") - fade).alias(START), (F.col("first") + F.col("n")).alias(END))
    on = overlap_join(heads, spans.select(key, F.col("camera").alias("on"), F.col("from").alias("r_start_ms"), F.col("to").alias("r_end_ms")), [key], width)
    head = on.groupBy(key, "chunk_idx", "first", "n", "sr", "zero").agg(F.array_sort(F.collect_list(F.struct("r_start_ms", "on"))).alias("spans"))

    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    maps = cameras.select(key, "camera", "camera_pos", zero("slope").alias("slope"), F.when(F.col("slope").isNull(), zero("offset_start")).otherwise(F.coalesce(F.col("intercept"), zero("offset_start"))).cast("double").alias("shift_s"), zero("audio_start_s").alias("begin_s"), F.pow(F.lit(10.0), zero("shift_db") / 20).alias("gain"))
    place = lambda p: (lambda t: (t + (F.col("slope") * t + F.col("shift_s")) - F.col("begin_s")) * F.col("sr"))(F.col("zero") / 1000 + p / F.col("sr"))
    ends = place(F.col("first")), place(F.col("first") + F.col("n") - 1)
    needs = heads.drop(START, END).join(maps, key).withColumns({START: F.floor(F.least(*ends)), END: F.floor(F.greatest(*ends)) + 2})
    tracks = sources.select(key, "camera", F.col("start_sample").alias("r_start_ms"), (F.col("start_sample") + F.size("samples")).alias("r_end_ms"), F.col("samples").cast("array<double>").alias("samples"))
    pieces = overlap_join(needs.select(key, "camera", "chunk_idx", "camera_pos", "slope", "shift_s", "begin_s", "gain", START, END), tracks, [key, "camera"], width)
    inside = F.slice("samples", (F.col("clip_start_ms") - F.col("r_start_ms") + 1).cast("int"), F.col("overlap_ms").cast("int"))
    pieces = pieces.select(key, "chunk_idx", "camera", "camera_pos", "slope", "shift_s", "begin_s", "gain", F.col("clip_start_ms").alias("at"), inside.alias("samples"))
    kinds = dict(ranges.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = next(r for r in pdf.itertuples(index=False) if r.spans is not None)
        first, n, sr = int(h.first), int(h.n), float(h.sr)
        spans = [(s["r_start_ms"], s["on"]) for s in h.spans]
        t = h.zero / 1000 + (first + np.arange(n)) / sr
        mixed = np.zeros(n)
        for (_, camera), rows in pdf[pdf["spans"].isna()].groupby(["camera_pos", "camera"]):
            r = next(rows.itertuples(index=False))
            idx = (t + (r.slope * t + r.shift_s) - r.begin_s) * sr
            x = resampled(idx, [(int(a), np.asarray(s)) for a, s in zip(rows["at"], rows["samples"], strict=True)])
            mixed += x * r.gain * gains(first, n, camera, spans, round(fade_s * sr), low)
        return pd.DataFrame({key: pdf[key].iloc[:1], "chunk_idx": pdf["chunk_idx"].iloc[:1], "start_sample": [first], "mixed": [np.clip(mixed, -1.0, 1.0)]})

    return head.unionByName(pieces, allowMissingColumns=True).groupBy(key, "chunk_idx").applyInPandas(run, f"{key} {kinds[key]}, chunk_idx long, start_sample long, mixed array<double>")
