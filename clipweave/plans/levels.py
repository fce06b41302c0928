"""Queries on level, shot, signal and speaker operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import levels as V
from ..operators import mixing as M
from ..operators import shots as H
from ..operators import signal as G
from ..operators import speakers as P
from ..operators import sync as Y
from ..views import view, with_views

CAM = ["recording_id", "camera"]
HOUR = 3_600_000


def speech_level(spark, sf):
    return V.percentile_level(view(spark, sf, "levels"), CAM, 0.88, "speech")


def noise_floor(spark, sf):
    return V.percentile_level(view(spark, sf, "levels"), CAM, 0.2, "threshold", margin=500)


def level_normalize(spark, sf):
    l = view(spark, sf, "levels")
    return V.level_normalize(l, V.percentile_level(l, CAM, 0.2, "threshold"), "recording_id", "camera", "median", 1500)


def moving_average(spark, sf):
    m = V.moving_average(view(spark, sf, "levels"), CAM, 10)
    return m.select(*CAM, "hop_idx", F.bround(F.col("smooth") * 10).cast("long").alias("sum_of_ten"))


def points_of(levels):
    return levels.select(*CAM, F.col("hop_idx").alias("hop"))


def quietest_near(spark, sf):
    l = view(spark, sf, "levels")
    return V.quietest_near(points_of(l), l, CAM, ["hop"], "hop", -6, 5)


def check_cuts(spark, sf):
    l = view(spark, sf, "levels")
    edges = points_of(l).withColumn("seamless", F.col("hop") % 5 == 0)
    return V.check_cuts(edges, l, V.percentile_level(l, CAM, 0.88, "speech"), CAM, ["hop"], 1, 20_000)


def nudge_cuts(spark, sf):
    l = view(spark, sf, "levels")
    return V.nudge_cuts(points_of(l), l, V.percentile_level(l, CAM, 0.5, "speech"), CAM, ["hop"], 4, 2, 3_000)


def day_clips(spark, sf):
    l = view(spark, sf, "levels")
    days = l.select(*CAM, F.expr("hop_idx div 24").alias("clip_idx")).distinct()
    return days.select(*CAM, "clip_idx", (F.col("clip_idx") * 24).alias("first_hop"), (F.col("clip_idx") * 24 + 23).alias("last_hop")), l


def clip_levels(spark, sf):
    clips, l = day_clips(spark, sf)
    return V.clip_levels(clips, l, CAM, ["clip_idx"], 16_000)


def level_steps(spark, sf):
    return V.level_steps(clip_levels(spark, sf), "recording_id", 9_000)


def balance_gains(spark, sf):
    g = V.balance_gains(clip_levels(spark, sf).withColumn("clip_level", F.col("clip_level") / 8192), "recording_id")
    return g.select(*CAM, "clip_idx", "gain")


def level_at(spark, sf):
    l = view(spark, sf, "levels")
    return V.level_at(points_of(l), l, CAM, ["hop"], F.col("hop") + 0.5)


def lag_scan(spark, sf):
    l = view(spark, sf, "levels")
    a = l.filter("camera = 'click'").select("recording_id", "hop_idx", F.col("level").alias("x"))
    b = l.filter("camera = 'view'").select("recording_id", "hop_idx", F.col("level").alias("y"))
    return V.lag_scan(a, b, ["recording_id"], 6)


def motion_offset(spark, sf):
    return V.motion_offset(lag_scan(spark, sf), ["recording_id"], 3).select("recording_id", "lag")


def motion_signal(spark, sf):
    return V.motion_signal(view(spark, sf, "levels"), CAM).withColumn("motion", F.bround("motion", 3) + 0.0)


def filter_offset_outliers(spark, sf):
    l = view(spark, sf, "levels").select(*CAM, "hop_idx", F.col("level").alias("offset"))
    return V.filter_outliers(l, CAM, 10_000)


def fit_drift(spark, sf):
    l = view(spark, sf, "levels").select(*CAM, F.col("hop_idx").cast("double").alias("t"), (F.col("hop_idx") * 3 + 7).cast("double").alias("offset"), (1 + F.col("level") % 3).cast("double").alias("w"))
    f = V.fit_drift(l, CAM)
    return f.select(*CAM, "n", F.bround("slope", 6).alias("slope"), F.bround("intercept", 4).alias("intercept"))


def best_offset(spark, sf):
    p = view(spark, sf, "levels").select(*CAM, F.col("hop_idx").alias("window_idx"), F.col("level").alias("offset"), (F.col("level") % 97).cast("double").alias("score"), F.when(F.col("hop_idx") % 2 == 0, "envelope").otherwise("gcc_phat").alias("method"))
    return V.best_offset(p, CAM, 5.0)


def map_time(spark, sf):
    o = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("ref"), F.col("n_regionkey").alias("other"), (F.col("n_nationkey") * 1.5).alias("offset_start"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(0.5)).alias("slope"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(2.0)).alias("intercept"))
    p = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("ref"), F.col("s_suppkey").cast("double").alias("t"))
    n = o.select("ref", "other")
    return V.map_time(p.join(n, "ref"), o).select("id", "offset", "t_other")


def overlap_window(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_size") - 25).cast("double").alias("offset_start"), F.lit(None).cast("double").alias("slope"), F.lit(None).cast("double").alias("intercept"), F.lit(20.0).alias("ref_duration"), (F.col("p_size") % 30).cast("double").alias("other_duration"))
    return V.overlap_window(p, guard=1.0).select("id", "ref_start", "ref_end")


def sync_summary(spark, sf):
    l = view(spark, sf, "levels").select("recording_id", (F.col("level") % 64 / 1024).alias("lag"), (F.col("level") % 4 / 4).alias("correlation"))
    return V.sync_summary(l, "recording_id").select("recording_id", "median_lag", "max_lag", "drift", "in_sync")


def transcript_coverage(spark, sf):
    s = view(spark, sf, "segments")
    r = s.groupBy("recording_id").agg((F.max("end_ms") + (F.first("recording_id") % 3) * 2000).alias("duration_ms"))
    return V.transcript_coverage(s, r, "recording_id")


def caption_pass_rate(spark, sf):
    c = view(spark, sf, "cues").select("reel_id", F.col("start_ms").alias("time"), (F.col("cue_idx") % 3 > 0).alias("passed"))
    return V.caption_pass_rate(c, "reel_id").select("reel_id", "n_passed", "n_total", F.array_join(F.transform("failed_times", lambda x: x.cast("string")), ",").alias("failed_times"))


def qc_report(spark, sf):
    m = view(spark, sf, "media").withColumnRenamed("file_index", "id")
    checks = m.select("id", F.when(F.col("id") % 3 == 0, F.array(F.lit("no_freeze"))).when(F.col("id") % 7 == 0, F.array(F.lit("width"))).otherwise(F.array().cast("array<string>")).alias("failed"))
    sync = m.filter("id % 2 = 0").select("id", (F.col("id") % 10 > 0).alias("in_sync"))
    caps = m.filter("id % 5 = 0").select("id", F.lit(3).alias("n_passed"), F.when(F.col("id") % 25 == 0, 4).otherwise(3).alias("n_total"))
    notes = m.filter("id % 4 = 0").select("id", (F.col("id") % 6 == 0).alias("still_ok"), (F.col("id") % 20 == 0).alias("remeasured"))
    return V.qc_report(checks, sync, caps, notes, "id")


def scores_of(levels):
    names = levels.select("camera").distinct()
    from pyspark.sql import Window as W

    pos = names.withColumn("camera_pos", F.row_number().over(W.orderBy("camera")) - 1)
    s = (F.col("level") - 15_000) / 100.0
    return levels.join(F.broadcast(pos), "camera").select("recording_id", F.col("hop_idx").alias("step"), "camera_pos", "camera", s.alias("score"), s.alias("speech"))


def camera_switch(spark, sf):
    return H.camera_switch(scores_of(view(spark, sf, "levels")), "recording_id", HOUR, 3 * HOUR, 30.0)


def switched(spark, sf):
    return I.run_length_shots(camera_switch(spark, sf), ["recording_id"], HOUR, F.lit(720 * HOUR))


def enforce_min_shot(spark, sf):
    s = view(spark, sf, "segments").select("recording_id", F.col("speaker").alias("camera"), F.col("speaker").alias("audio_camera"), "start_ms", "end_ms")
    return H.enforce_min_shot(s, "recording_id", 4000, eps=1500)


def min_shot_report(spark, sf):
    s = view(spark, sf, "segments").select("recording_id", F.col("speaker").alias("camera"), F.col("speaker").alias("audio_camera"), "start_ms", "end_ms")
    return H.min_shot_report(s, "recording_id", 4000, eps=1500)


def pin_camera(spark, sf):
    return H.pin_camera(switched(spark, sf), ["recording_id"], "click")


def camera_share(spark, sf):
    return H.camera_share(switched(spark, sf), "recording_id")


def insert_reactions(spark, sf):
    return H.insert_reactions(switched(spark, sf), scores_of(view(spark, sf, "levels")), "recording_id", HOUR, 12 * HOUR, 2 * HOUR, search=2 * HOUR, step=HOUR)


def balance_cameras(spark, sf):
    return H.balance_cameras(switched(spark, sf), scores_of(view(spark, sf, "levels")), "recording_id", HOUR, 0.2, cutaway=3 * HOUR, gap=4 * HOUR, side=HOUR, search=2 * HOUR, step=HOUR, least_cut=HOUR, advantage=100.0)


def shot_plan(spark, sf):
    cuts = I.merge_intervals(view(spark, sf, "intervals").select("recording_id", (F.col("start_ms") - 1704067200000).alias("start_ms"), (F.col("end_ms") - 1704067200000).alias("end_ms")).filter("end_ms - start_ms > 25000000"), ["recording_id"])
    return H.shot_plan(scores_of(view(spark, sf, "levels")), cuts, "recording_id", HOUR, F.lit(720 * HOUR), 3 * HOUR, 30.0)


def offsets_of(spark, sf):
    return view(spark, sf, "levels").select("camera").distinct().withColumn("offset_ms", F.length("camera").cast("long") * 1000 - 6000)


def camera_ranges(spark, sf):
    return H.camera_ranges(switched(spark, sf), offsets_of(spark, sf), "recording_id", 2000)


def edit_list(spark, sf):
    return H.edit_list(switched(spark, sf), offsets_of(spark, sf), "recording_id")


def subtract_shots(spark, sf):
    s = switched(spark, sf)
    cuts = s.filter("start_ms % 7200000 = 0").select("recording_id", (F.col("start_ms") + 600_000).alias("start_ms"), (F.col("start_ms") + 1_200_000).alias("end_ms"))
    return H.apply_cuts(s, cuts, "recording_id")


def speaker_centroids(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    c = P.speaker_centroids(e, "label", "embedding")
    return c.select("label", F.size("centroid").alias("n"), F.bround(P.dot(F.col("centroid"), F.col("centroid")), 4).alias("length"), F.bround(F.col("centroid")[0], 4).alias("x0"))


def speaker_similarity(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return P.speaker_similarity(e, P.speaker_centroids(e, "label", "embedding"), ["vec_id"], "embedding", "label").select("vec_id", "best", F.bround("best_sim", 4).alias("best_sim"))


def infer_speaker_map(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", F.when(F.col("label") % 2 == 0, F.concat(F.lit("cam"), F.col("label").cast("string"))).otherwise(F.concat(F.lit("cam"), (F.col("vec_id") % 3).cast("string"))).alias("camera"))
    return P.infer_speaker_map(e, "label", "camera")


def resolve_speaker_map(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    labels = e.select(F.concat(F.lit("cam"), F.col("label").cast("string")).alias("label")).distinct()
    pick = lambda cond, value: labels.filter(cond).select("label", value.alias("camera"))
    n = F.substring("label", 4, 9).cast("int")
    given = pick(n % 4 == 0, F.lit("/media/cam1.mov"))
    inferred = pick(n % 2 == 0, F.lit("cam2"))
    config = pick(n % 3 == 0, F.lit("nowhere"))
    return P.resolve_speaker_map(labels, given, inferred, config, labels.select(F.col("label").alias("camera")).filter(F.col("camera") != "cam7"))


def speaker_switch(spark, sf):
    s = scores_of(view(spark, sf, "levels"))
    sims = s.withColumn("sim", F.when(F.col("score") > -50, F.pmod(F.col("recording_id") * 37 + F.col("step") * 91 + F.col("camera_pos") * 53, F.lit(128)) / 128.0))
    return H.speaker_switch(sims, "recording_id", HOUR, 3 * HOUR, 0.375, 0.0625)


def end_window_drift(spark, sf):
    l = view(spark, sf, "levels").groupBy(*CAM).agg(F.min("hop_idx").cast("double").alias("start_t"), F.max("hop_idx").cast("double").alias("end_t"))
    o = l.withColumns({"start_offset": F.col("start_t") * 2 + 1, "end_offset": F.col("end_t") * 2 + 1})
    return V.end_window_drift(o).select(*CAM, "slope")


def xcorr_offset(spark, sf):
    """Each label's vectors in order are one signal; every vector against the next of its label, 8 samples late."""
    from pyspark.sql import Window as W

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    nxt = F.lead("embedding").over(W.partitionBy("label").orderBy("vec_id"))
    rows = e.withColumn("b", nxt).filter("b IS NOT NULL").select("vec_id", F.concat("embedding", "b").alias("a"), F.concat(F.slice(F.concat("embedding", "b"), 9, 120), F.array_repeat(F.lit(0.0).cast("float"), 8)).alias("b"))
    return G.estimate_offset(rows, ["vec_id"], 16, 1.0, "xcorr").select("vec_id", F.col("offset").cast("long").alias("lag"))


def tracks_of(spark, sf, late=0):
    """A track per label, of its vectors, 64 samples each; `late` samples of silence before them."""
    from pyspark.sql import Window as W

    n = (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", n.alias("n"), F.col("embedding").cast("array<double>").alias("x"))
    silent = F.when(F.col("n") == 0, F.array_repeat(F.lit(0.0), late)).otherwise(F.array().cast("array<double>"))
    return rows.select("label", F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("n") * 64 + late).cast("long").alias("start_sample"), F.concat(silent, "x").alias("samples"))


def long_xcorr(spark, sf):
    """Each label's track against the next label's, in blocks of 500 samples."""
    t = tracks_of(spark, sf).withColumnRenamed("label", "track")
    labels = t.select("track").distinct()
    pairs = labels.select(F.col("track").alias("ref"), (F.col("track") + 1).alias("other")).join(labels.withColumnRenamed("track", "other"), "other", "left_semi").select("ref", "other")
    return Y.long_xcorr(t, pairs, 30, 500, 512).withColumn("score", F.bround("score", 6))


def sync_recordings(spark, sf):
    """Each label's track against itself, 8 samples late at 100 a second, in windows of 256 samples."""
    a = tracks_of(spark, sf).select(F.concat(F.lit("a"), "label").alias("track"), "start_sample", "samples")
    b = tracks_of(spark, sf, 8).select(F.concat(F.lit("b"), "label").alias("track"), "start_sample", "samples")
    n = tracks_of(spark, sf).groupBy("label").agg(F.count("*").alias("n")).filter("n > 8")
    pairs = n.select(F.concat(F.lit("a"), "label").alias("ref"), F.concat(F.lit("b"), "label").alias("other"), F.lit(0.5).alias("fit_start"), ((F.col("n") - 6) * 0.64).alias("fit_duration"))
    model = Y.sync_recordings(a.unionByName(b), pairs, 100, 2.56, 0.64, 0.5)
    return model.select("ref", "other", F.bround("offset_start", 6).alias("offset_start"), "n", (F.bround("slope", 6) + 0.0).alias("slope"), F.bround("intercept", 6).alias("intercept"))


def frames(spark, sf):
    """Each vector as a chunk of 64 samples, 1,000 a second."""
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", F.lit(1000).alias("sr"), F.lit(0).cast("long").alias("start_sample"), F.col("embedding").alias("samples"))


def energy_envelope(spark, sf):
    return G.energy_envelope(frames(spark, sf), ["vec_id"], 16, 8).select("vec_id", "hop_idx", F.bround("rms", 4).alias("rms"))


def centred_envelope(spark, sf):
    return G.energy_envelope(frames(spark, sf), ["vec_id"], 16, 8, centred=True).select("vec_id", "hop_idx", (F.bround("rms", 4) + 0.0).alias("rms"))


def levels_db(spark, sf):
    return G.levels_db(frames(spark, sf), ["vec_id"], 8).select("vec_id", "hop_idx", F.bround("level", 3).alias("level"))


def abs_envelope(spark, sf):
    return G.abs_envelope(frames(spark, sf), ["vec_id"], 8).select("vec_id", F.posexplode("envelope").alias("hop_idx", "v")).select("vec_id", "hop_idx", (F.bround("v", 4) + 0.0).alias("v"))


def env_db(spark, sf):
    from ..functions.timecode import env_db as db

    return frames(spark, sf).select("vec_id", F.bround(db(F.abs(F.col("samples")[0]).cast("double")), 3).alias("db"))


def late_pairs(spark, sf):
    """vec_id, a, b: two vectors of a label in a row, and the same three samples later."""
    from pyspark.sql import Window as W

    nxt = F.lead("embedding").over(W.partitionBy("label").orderBy("vec_id"))
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("b", nxt).filter("b IS NOT NULL")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), 3)
    return rows.select("vec_id", F.concat("embedding", "b").alias("a"), F.concat(zeros, "embedding", F.slice("b", 1, 61)).alias("b"))


def gcc_phat_offset(spark, sf):
    return G.estimate_offset(late_pairs(spark, sf), ["vec_id"], 16, 1.0, "gcc_phat").select("vec_id", F.bround(F.col("offset") * 8).cast("long").alias("eighths"))


def estimate_offset(spark, sf):
    return G.estimate_offset(late_pairs(spark, sf), ["vec_id"], 0.05, 1000.0).select("vec_id", F.bround(F.col("offset") * 8000).cast("long").alias("eighths"), "method")


def refine_offset(spark, sf):
    p = late_pairs(spark, sf).withColumn("center", F.lit(1.0))
    return G.refine_offset(p, ["vec_id"], 1.0, 4.0, 1.0).select("vec_id", F.col("offset").cast("long").alias("offset"), F.bround("error", 4).alias("error"))


def verify_windows(spark, sf):
    c = view(spark, sf, "clips").select("reel_id", "clip_idx", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))
    ms = lambda x: F.bround(F.col(x) * 1000).cast("long").alias(x)
    return G.verify_windows(c, "reel_id").select("reel_id", "clip_idx", "window", ms("a"), ms("b"))


def window_lags(spark, sf):
    p = late_pairs(spark, sf).withColumnsRenamed({"a": "y", "b": "x"})
    return G.window_lags(p, ["vec_id"], 1, 16, 100, band=None).select("vec_id", F.col("lag_seconds").cast("long").alias("lag"), F.bround("correlation", 4).alias("correlation"))


def verify_alignment(spark, sf):
    p = late_pairs(spark, sf).withColumn("current", F.lit(1.0))
    return G.verify_alignment(p, ["vec_id"], 1.0, 0.1, 16).select("vec_id", F.col("corrected").cast("long").alias("corrected"), "aligned")


def gated_mix(spark, sf):
    """Two cameras a label, a of its even and b of its odd vectors, 64 samples each at 100 a second; a shot a vector, with gaps; b drifts and is softer."""
    from pyspark.sql import Window as W

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    n = (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("n")
    rows = e.select("label", "vec_id", "embedding", n)
    camera = F.when(F.col("n") % 2 == 0, "a").otherwise("b").alias("camera")
    sources = rows.select("label", camera, (F.floor(F.col("n") / 2) * 64).alias("start_sample"), F.col("embedding").alias("samples"))
    shots = rows.select("label", F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b").alias("camera"), F.lit(None).cast("string").alias("audio_camera"), (F.col("n") * 900).alias("start_ms"), (F.col("n") * 900 + 700).alias("end_ms"))
    ranges = rows.groupBy("label").agg(F.lit(100).alias("sr"), F.lit(200).cast("long").alias("start_ms"), (F.floor((F.max("n") + 1) / 2) * 640).alias("end_ms"))
    known = [("a", 0, 0.104, None, None, 0.0, None), ("b", 1, None, 0.003, -0.371, 0.25, -6.0)]
    cameras = ranges.select("label").crossJoin(F.broadcast(spark.createDataFrame(known, "camera string, camera_pos int, offset_start double, slope double, intercept double, audio_start_s double, shift_db double")))
    mixed = M.gated_mix(sources, cameras, shots, ranges, "label", chunk_s=1.7, fade_s=0.08, duck_db=12.0, width=512)
    mixed = mixed.select("label", "start_sample", F.posexplode("mixed").alias("i", "v"))
    return mixed.select("label", (F.col("start_sample") + F.col("i")).alias("sample"), (F.bround("v", 5) + 0.0).alias("v"))


def residual_windows(spark, sf):
    """Two cameras (click, view): arrays of 64 samples per hop from the label's vectors."""
    from pyspark.sql import Window as W

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    step = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    nxt = F.lead("embedding").over(W.partitionBy("label").orderBy("vec_id"))
    return e.select(F.col("label").alias("recording_id"), step.cast("long").alias("step"), F.col("embedding").alias("a"), nxt.alias("b"), F.lit(1.5).alias("shift_a"), F.lit(-0.5).alias("bias_b")).filter("b IS NOT NULL")


def residual_scores(spark, sf):
    return G.residual_scores(residual_windows(spark, sf), "recording_id").withColumn("score", F.bround("score", 3))


def residual_switch(spark, sf):
    w = residual_windows(spark, sf)
    two = F.explode(F.array(*(F.struct(F.lit(i).alias("camera_pos"), F.lit(c).alias("camera")) for i, c in enumerate(("click", "view")))))
    speech = w.select("recording_id", "step", two.alias("c")).select("recording_id", "step", "c.*", F.when(F.col("step") % 7 == 3, -1.0).otherwise(1.0).alias("speech"))
    return G.residual_switch(w, speech, "recording_id", 1000, 2000, 0.25)


NAMES = "speech_level noise_floor level_normalize moving_average quietest_near check_cuts nudge_cuts clip_levels level_steps balance_gains level_at lag_scan motion_offset motion_signal filter_offset_outliers fit_drift best_offset map_time overlap_window sync_summary transcript_coverage caption_pass_rate qc_report camera_switch enforce_min_shot min_shot_report pin_camera camera_share insert_reactions balance_cameras shot_plan camera_ranges edit_list subtract_shots speaker_centroids speaker_similarity infer_speaker_map resolve_speaker_map speaker_switch end_window_drift xcorr_offset energy_envelope centred_envelope levels_db abs_envelope env_db gcc_phat_offset estimate_offset refine_offset verify_windows window_lags verify_alignment gated_mix long_xcorr sync_recordings residual_scores residual_switch"
QUERIES = {n: globals()[n] for n in NAMES.split()}

_L = with_views("levels")
_PT = "pt AS (SELECT recording_id, camera, hop_idx AS hop, level AS now FROM levels)"
_NEAR = "nr AS (SELECT p.recording_id, p.camera, p.hop, arg_min(l.hop_idx, (l.level, l.hop_idx)) AS quiet_hop, min(l.level) AS quiet_level FROM pt p JOIN levels l ON l.recording_id = p.recording_id AND l.camera = p.camera AND l.hop_idx BETWEEN p.hop - {a} AND p.hop + {b} GROUP BY ALL)"
_PC = "quantile_cont(level, {q})"
_CL = "t AS (SELECT recording_id, camera, hop_idx // 24 AS clip_idx, level, max(level) OVER (PARTITION BY recording_id, camera, hop_idx // 24) AS top FROM levels), cl AS (SELECT recording_id, camera, clip_idx, median(level) AS clip_level FROM t WHERE level >= top - 16000 GROUP BY ALL)"
_SW = """p AS (SELECT *, (level - 15000) / 100.0 AS s FROM levels), st AS (SELECT recording_id, hop_idx AS step, list({'c': camera, 's': s} ORDER BY s DESC, camera) AS x, row_number() OVER (PARTITION BY recording_id ORDER BY hop_idx) AS rn FROM p GROUP BY recording_id, hop_idx),
 c0 AS (SELECT recording_id, min(camera) AS c FROM levels GROUP BY ALL),
 sw AS (SELECT st.recording_id, step, rn, c0.c AS camera, step AS since FROM st JOIN c0 ON c0.recording_id = st.recording_id WHERE rn = 1
  UNION ALL SELECT st.recording_id, st.step, st.rn, CASE WHEN go THEN x[1].c ELSE camera END, CASE WHEN go THEN st.step ELSE since END
   FROM (SELECT st.*, sw.camera, sw.since, x[1].s >= 0 AND x[1].c <> sw.camera AND st.step - sw.since >= 3 AND x[1].s - coalesce(list_filter(x, lambda y: y.c = sw.camera)[1].s, -1e300) >= 30 AS go FROM sw JOIN st ON st.recording_id = sw.recording_id AND st.rn = sw.rn + 1) st)"""
_SHOTS = _SW + """, ch AS (SELECT *, lag(camera) OVER (PARTITION BY recording_id ORDER BY step) AS b FROM sw), sh AS (SELECT recording_id, camera, step * 3600000 AS start_ms, coalesce(least(lead(step) OVER (PARTITION BY recording_id ORDER BY step) * 3600000, 2592000000), 2592000000) AS end_ms FROM ch WHERE b IS NULL OR b <> camera)"""
_FR = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) "
#: p: two vectors of a label in a row.
_LATE = "WITH n AS (SELECT vec_id, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings), p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) || CAST(b AS DOUBLE[]) AS x FROM n WHERE b IS NOT NULL)"
#: sc: sums of products of a at i and b at i + lag.
_SCAN0 = "la AS (SELECT unnest(range(-{most}, {most} + 1)) AS lag), sc AS (SELECT vec_id, lag, list_dot_product(CASE WHEN lag >= 0 THEN a[1 : 128 - lag] ELSE a[1 - lag : 128] END, CASE WHEN lag >= 0 THEN b[1 + lag : 128] ELSE b[1 : 128 + lag] END) AS v, list_dot_product(a, a) AS ea, list_dot_product(b, b) AS eb FROM {t}, la)"
_SCAN = "mn AS (SELECT vec_id, a, b, list_avg(a) AS ma, list_avg(b) AS mb FROM {t}), cn AS (SELECT vec_id, list_transform(a, lambda v: v - ma) AS a, list_transform(b, lambda v: v - mb) AS b FROM mn), " + _SCAN0.replace("{t}", "cn")
_RES = """WITH e AS (SELECT label AS recording_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS step, CAST(embedding AS DOUBLE[]) AS a, CAST(lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS DOUBLE[]) AS b FROM embeddings),
  f AS (SELECT *, list_dot_product(a, b) AS ab, list_dot_product(a, a) AS aa, list_dot_product(b, b) AS bb FROM e WHERE b IS NOT NULL),
  r AS (SELECT recording_id, step, list_transform(list_zip(a, b), lambda u: u[1] - ab / (bb + 1e-8) * u[2]) AS ra, list_transform(list_zip(a, b), lambda u: u[2] - ab / (aa + 1e-8) * u[1]) AS rb FROM f),
  rs AS (SELECT recording_id, step, 0 AS camera_pos, 20 * log10(greatest(sqrt(list_dot_product(ra, ra) / 64 + 1e-8), 1e-8)) + 1.5 AS score FROM r UNION ALL SELECT recording_id, step, 1, 20 * log10(greatest(sqrt(list_dot_product(rb, rb) / 64 + 1e-8), 1e-8)) - 0.5 FROM r)"""
SQL = {
    "speech_level": _L + " SELECT recording_id, camera, " + _PC.format(q=0.88) + " AS speech FROM levels GROUP BY ALL",
    "noise_floor": _L + " SELECT recording_id, camera, " + _PC.format(q=0.2) + " + 500 AS threshold FROM levels GROUP BY ALL",
    "level_normalize": _L + ", f AS (SELECT recording_id, camera, quantile_cont(level, 0.2) AS th FROM levels GROUP BY ALL), m AS (SELECT l.recording_id, l.camera, coalesce(median(level) FILTER (level >= th), quantile_cont(level, 0.95)) AS m FROM levels l JOIN f ON f.recording_id = l.recording_id AND f.camera = l.camera GROUP BY ALL), g AS (SELECT recording_id, median(m) AS g FROM m GROUP BY ALL) SELECT m.recording_id, camera, greatest(-1500.0, least(1500.0, g - m)) AS shift FROM m JOIN g ON g.recording_id = m.recording_id",
    "moving_average": _L + " SELECT recording_id, camera, hop_idx, CAST(sum(level) OVER (PARTITION BY recording_id, camera ORDER BY hop_idx ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS BIGINT) AS sum_of_ten FROM levels",
    "quietest_near": _L + "," + _PT + "," + _NEAR.format(a=6, b=5) + " SELECT * FROM nr",
    "check_cuts": _L + "," + _PT + "," + _NEAR.format(a=1, b=1) + ", sp AS (SELECT recording_id, camera, quantile_cont(level, 0.88) AS sp FROM levels GROUP BY ALL) SELECT nr.* FROM nr JOIN sp ON sp.recording_id = nr.recording_id AND sp.camera = nr.camera WHERE hop % 5 <> 0 AND quiet_level > sp - 20000",
    "nudge_cuts": _L + "," + _PT + "," + _NEAR.format(a=4, b=2) + ", sp AS (SELECT recording_id, camera, quantile_cont(level, 0.5) AS sp FROM levels GROUP BY ALL) SELECT p.recording_id, p.camera, p.hop, p.hop AS old_hop, CASE WHEN now > sp - 3000 AND quiet_level < now THEN quiet_hop ELSE p.hop END AS new_hop, now > sp - 3000 AND quiet_level < now AS moved FROM pt p JOIN nr ON nr.recording_id = p.recording_id AND nr.camera = p.camera AND nr.hop = p.hop JOIN sp ON sp.recording_id = p.recording_id AND sp.camera = p.camera",
    "clip_levels": _L + "," + _CL + " SELECT * FROM cl",
    "level_steps": _L + "," + _CL + ", m AS (SELECT recording_id, median(clip_level) AS m, max(clip_level) - min(clip_level) AS spread FROM cl GROUP BY ALL) SELECT cl.recording_id, spread, count(*) FILTER (abs(clip_level - m) > 9000) AS n_flagged FROM cl JOIN m ON m.recording_id = cl.recording_id GROUP BY cl.recording_id, spread",
    "balance_gains": _L + "," + _CL + ", m AS (SELECT recording_id, median(clip_level) AS m FROM cl GROUP BY ALL), g AS (SELECT cl.recording_id, camera, clip_idx, greatest(-5.0::DOUBLE, least(5.0::DOUBLE, (m / 8192 - clip_level / 8192) * 0.75::DOUBLE)) AS g FROM cl JOIN m ON m.recording_id = cl.recording_id) SELECT recording_id, camera, clip_idx, CASE WHEN abs(g) < 0.3 THEN 0.0 ELSE round_even(g, 2) END AS gain FROM g",
    "level_at": _L + "," + _PT + " SELECT p.recording_id, p.camera, p.hop, p.now * 0.5 + l.level * 0.5 AS level_at FROM pt p LEFT JOIN levels l ON l.recording_id = p.recording_id AND l.camera = p.camera AND l.hop_idx = p.hop + 1",
    "lag_scan": _L + " SELECT a.recording_id, CAST(b.hop_idx - a.hop_idx AS INTEGER) AS lag, count(*) AS n, CAST(sum(a.level * b.level) AS BIGINT) AS dot FROM levels a JOIN levels b ON a.recording_id = b.recording_id AND a.camera = 'click' AND b.camera = 'view' AND abs(b.hop_idx - a.hop_idx) <= 6 GROUP BY ALL",
    "motion_offset": _L + ", s AS (SELECT a.recording_id, CAST(b.hop_idx - a.hop_idx AS INTEGER) AS lag, sum(a.level * b.level) / count(*) AS v FROM levels a JOIN levels b ON a.recording_id = b.recording_id AND a.camera = 'click' AND b.camera = 'view' AND abs(b.hop_idx - a.hop_idx) <= 6 GROUP BY ALL) SELECT recording_id, arg_max(lag, (v, -lag)) AS lag FROM s GROUP BY recording_id",
    "motion_signal": _L + """, d AS (SELECT recording_id, camera, hop_idx, abs(level - lag(level) OVER (PARTITION BY recording_id, camera ORDER BY hop_idx)) AS d FROM levels), e AS (SELECT * FROM d WHERE d IS NOT NULL),
      r AS (SELECT recording_id, camera, hop_idx, d - sum(d) OVER (PARTITION BY recording_id, camera ORDER BY hop_idx ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) / 31 AS r FROM e)
      SELECT recording_id, camera, hop_idx, round_even((r - avg(r) OVER w) / (stddev_pop(r) OVER w + 1e-9), 3) + 0.0::DOUBLE AS motion FROM r WINDOW w AS (PARTITION BY recording_id, camera)""",
    "filter_offset_outliers": _L + ", m AS (SELECT recording_id, camera, median(level) AS m, count(*) AS n FROM levels GROUP BY ALL) SELECT l.recording_id, l.camera, hop_idx, level AS offset FROM levels l JOIN m ON m.recording_id = l.recording_id AND m.camera = l.camera WHERE n < 4 OR abs(level - m) <= 10000",
    "fit_drift": _L + " SELECT recording_id, camera, count(*) AS n, 3.0 AS slope, 7.0 AS intercept FROM levels GROUP BY ALL HAVING count(*) >= 3",
    "best_offset": _L + ", p AS (SELECT recording_id, camera, hop_idx, level, CAST((level % 97) * CASE WHEN hop_idx % 2 = 0 THEN 10 ELSE 1 END AS DOUBLE) AS s FROM levels) SELECT recording_id, camera, hop_idx AS window_idx, level AS offset, s AS score, s < 5 AS low FROM p QUALIFY row_number() OVER (PARTITION BY recording_id, camera ORDER BY s DESC, hop_idx) = 1",
    "map_time": "SELECT s_suppkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 0.5 * s_suppkey + 2.0 ELSE n_nationkey * 1.5 END AS offset, s_suppkey + CASE WHEN n_nationkey % 2 = 0 THEN 0.5 * s_suppkey + 2.0 ELSE n_nationkey * 1.5 END AS t_other FROM supplier JOIN nation ON n_nationkey = s_nationkey",
    "overlap_window": "WITH w AS (SELECT p_partkey AS id, greatest(0.0, 25.0 - p_size) + 1 AS lo, least(20.0, p_size % 30 - (p_size - 25.0)) - 1 AS hi FROM part) SELECT id, CASE WHEN hi > lo THEN lo END AS ref_start, CASE WHEN hi > lo THEN hi END AS ref_end FROM w",
    "sync_summary": _L + ", l AS (SELECT recording_id, (level % 64) / 1024 AS g, level % 4 AS c FROM levels) SELECT recording_id, median(g) AS median_lag, max(g) AS max_lag, max(g) FILTER (c >= 1) - min(g) FILTER (c >= 1) AS drift, median(g) <= 1.0 / 30 AND coalesce(max(g) FILTER (c >= 1), 0) <= 1.0 / 30 AS in_sync FROM l GROUP BY recording_id",
    "transcript_coverage": with_views("segments") + ", e AS (SELECT recording_id, max(end_ms) AS t FROM segments GROUP BY ALL) SELECT recording_id, t + recording_id % 3 * 2000 AS duration_ms, t AS text_end_ms, t < t + recording_id % 3 * 2000 - 3000 AS stops_early FROM e",
    "caption_pass_rate": with_views("cues") + " SELECT reel_id, count(*) FILTER (cue_idx % 3 > 0) AS n_passed, count(*) AS n_total, coalesce(array_to_string(list(start_ms ORDER BY start_ms) FILTER (cue_idx % 3 = 0), ','), '') AS failed_times FROM cues GROUP BY reel_id",
    "qc_report": with_views("media") + """, m AS (SELECT file_index AS id FROM media),
      q AS (SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 12 = 0 THEN '' ELSE 'no_freeze' END WHEN id % 7 = 0 THEN 'width' ELSE '' END AS f, id % 10 = 0 AND id % 20 <> 0 AS bad_sync, id % 25 = 0 AS bad_caps FROM m)
      SELECT id, f = '' AND NOT bad_sync AND NOT bad_caps AS ok, bool_and(f = '' AND NOT bad_sync AND NOT bad_caps) OVER () AS all_ok, concat_ws('; ', CASE WHEN f <> '' THEN 'failed: ' || f END, CASE WHEN bad_sync THEN 'out of sync' END, CASE WHEN bad_caps THEN 'captions' END) AS text FROM q""",
    "camera_switch": _L + "," + _SW + " SELECT recording_id, step, camera FROM sw",
    "pin_camera": _L + "," + _SHOTS + " SELECT recording_id, 'click' AS camera, camera AS audio_camera, start_ms, end_ms FROM sh",
    "camera_share": _L + "," + _SHOTS + ", d AS (SELECT recording_id, camera, sum(end_ms - start_ms) AS d FROM sh GROUP BY ALL) SELECT recording_id, CAST(sum(d) AS BIGINT) AS total_ms, arg_min(camera, (-d, camera)) AS dominant, CAST(max(d) AS BIGINT) AS dominant_ms FROM d GROUP BY recording_id",
    "camera_ranges": _L + "," + _SHOTS + " SELECT recording_id, camera, greatest(0, min(start_ms) + length(camera) * 1000 - 6000 - 2000) AS from_ms, max(end_ms) + length(camera) * 1000 - 6000 + 2000 AS to_ms FROM sh GROUP BY recording_id, camera",
    "edit_list": _L + "," + _SHOTS + " SELECT recording_id, start_ms, end_ms - start_ms AS duration_ms, camera, greatest(0, start_ms + length(camera) * 1000 - 6000) AS picture_ms, camera AS audio_camera, greatest(0, start_ms + length(camera) * 1000 - 6000) AS sound_ms FROM sh WHERE end_ms - start_ms >= 50",
    "resolve_speaker_map": "WITH l AS (SELECT DISTINCT label AS n FROM embeddings), r AS (SELECT 'cam' || n AS label, CASE WHEN n % 4 = 0 THEN 'cam1' WHEN n % 2 = 0 THEN 'cam2' WHEN n % 3 = 0 THEN 'nowhere' WHEN n <> 7 THEN 'cam' || n END AS camera FROM l) SELECT * FROM r WHERE camera IS NOT NULL AND camera <> 'nowhere'",
    "end_window_drift": _L + " SELECT recording_id, camera, CASE WHEN min(hop_idx) < max(hop_idx) THEN 2.0 END AS slope FROM levels GROUP BY ALL",
    "infer_speaker_map": "SELECT label, 'cam' || label AS camera FROM embeddings WHERE label % 2 = 0 GROUP BY label",
    "speaker_centroids": """WITH x AS (SELECT label, unnest(range(1, 65)) AS p, embedding FROM embeddings), m AS (SELECT label, p, avg(CAST(embedding[p] AS DOUBLE)) AS v FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(v * v)) + 1e-9 AS n FROM m GROUP BY ALL)
      SELECT m.label, CAST(64 AS INTEGER) AS n, 1.0 AS length, round_even(v / n.n, 4) AS x0 FROM m JOIN n ON n.label = m.label WHERE p = 1""",
    "energy_envelope": _FR + "SELECT vec_id, h AS hop_idx, round_even(sqrt(list_sum(list_transform(x[h * 8 + 1 : h * 8 + 16], lambda v: v * v)) / 16), 4) AS rms FROM e, (SELECT unnest(range(7)) AS h)",
    "centred_envelope": _FR + ", r AS (SELECT vec_id, h, sqrt(list_sum(list_transform(x[h * 8 + 1 : h * 8 + 16], lambda v: v * v)) / 16) AS r FROM e, (SELECT unnest(range(7)) AS h)) SELECT vec_id, h AS hop_idx, round_even(r - avg(r) OVER (PARTITION BY vec_id), 4) + 0.0::DOUBLE AS rms FROM r",
    "levels_db": _FR + "SELECT vec_id, h AS hop_idx, round_even(20 * log10(sqrt(list_sum(list_transform(x[h * 8 + 1 : h * 8 + 8], lambda v: v * v)) / 8) + 1e-9), 3) AS level FROM e, (SELECT unnest(range(8)) AS h)",
    "abs_envelope": _FR + ", r AS (SELECT vec_id, h, list_sum(list_transform(x[h * 8 + 1 : h * 8 + 8], lambda v: abs(v))) / 8 AS r FROM e, (SELECT unnest(range(8)) AS h)) SELECT vec_id, CAST(h AS INTEGER) AS hop_idx, round_even(r - avg(r) OVER (PARTITION BY vec_id), 4) + 0.0::DOUBLE AS v FROM r",
    "env_db": _FR + "SELECT vec_id, round_even(20 * log10(greatest(abs(x[1]), 1e-8)), 3) AS db FROM e",
    "speaker_similarity": """WITH x AS (SELECT vec_id, label, unnest(range(1, 65)) AS p, embedding FROM embeddings), m AS (SELECT label, p, avg(CAST(embedding[p] AS DOUBLE)) AS v FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(v * v)) + 1e-9 AS n FROM m GROUP BY ALL), c AS (SELECT m.label, list(v / n.n ORDER BY p) AS c FROM m JOIN n ON n.label = m.label GROUP BY ALL),
      s AS (SELECT vec_id, c.label, list_dot_product(CAST(embedding AS DOUBLE[]), c.c) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 1e-9) AS s FROM embeddings, c) SELECT vec_id, arg_max(label, (s, label)) AS best, round_even(max(s), 4) AS best_sim FROM s GROUP BY vec_id""",
    "xcorr_offset": _LATE + ", y AS (SELECT vec_id, x AS a, x[9 : 128] || list_transform(range(8), lambda i: 0.0::DOUBLE) AS b FROM p), " + _SCAN.format(t="y", most=16) + " SELECT vec_id, arg_max(lag, (v, -lag)) AS lag FROM sc GROUP BY vec_id",
    "window_lags": _LATE + ", y AS (SELECT vec_id, x AS a0, [0.0::DOUBLE, 0.0, 0.0] || x[1 : 125] AS b0 FROM p), z AS (SELECT vec_id, a0 AS a, b0 AS b FROM y), " + _SCAN0.format(t="z", most=16) + " SELECT vec_id, arg_max(lag, (v, -lag)) AS lag, round_even(max(v) / sqrt(any_value(ea) * any_value(eb)), 4) AS correlation FROM sc GROUP BY vec_id",
    "refine_offset": _LATE + """, z AS (SELECT vec_id, x AS a, [0.0::DOUBLE, 0.0, 0.0] || x[1 : 125] AS b FROM p), t AS (SELECT z.*, t, row_number() OVER (PARTITION BY vec_id ORDER BY o) AS o FROM z, (VALUES (0, 1), (1, -3), (2, -2), (3, -1), (4, 0), (5, 1), (6, 2), (7, 3), (8, 4), (9, 5)) k(o, t)),
      q AS (SELECT vec_id, o, t, CASE WHEN t >= 0 THEN a[1 : 128 - t] ELSE a[1 - t : 128] END AS x, CASE WHEN t >= 0 THEN b[1 + t : 128] ELSE b[1 : 128 + t] END AS y FROM t),
      nn AS (SELECT vec_id, o, t, x, y, sqrt(list_dot_product(x, x) / len(x)) + 1e-9 AS rx, sqrt(list_dot_product(y, y) / len(y)) + 1e-9 AS ry FROM q),
      e AS (SELECT vec_id, o, t, sqrt(greatest(0, list_sum(list_transform(list_zip(x, y), lambda u: (u[1] / rx - u[2] / ry) * (u[1] / rx - u[2] / ry))) / len(x))) AS e FROM nn)
      SELECT vec_id, CAST(arg_min(t, (e, o)) AS BIGINT) AS offset, round_even(min(e), 4) AS error FROM e GROUP BY vec_id""",
    # The second signal is the first, three samples late: that is what the three estimators must find.
    "gcc_phat_offset": _LATE + " SELECT vec_id, CAST(3 * 8 AS BIGINT) AS eighths FROM p",
    "estimate_offset": _LATE + " SELECT vec_id, CAST(3 * 8 AS BIGINT) AS eighths, 'gcc_phat' AS method FROM p",
    "verify_alignment": _LATE + " SELECT vec_id, CAST(3 AS BIGINT) AS corrected, true AS aligned FROM p",
    "subtract_shots": _L + "," + _SHOTS + """, c AS (SELECT recording_id, start_ms + 600000 AS a, start_ms + 1200000 AS b FROM sh WHERE start_ms % 7200000 = 0),
      pc AS (SELECT sh.recording_id, camera, CASE WHEN c.a IS NULL THEN [{'s': start_ms, 'e': end_ms}] ELSE [{'s': start_ms, 'e': c.a}, {'s': c.b, 'e': end_ms}] END AS p FROM sh LEFT JOIN c ON c.recording_id = sh.recording_id AND c.a - 600000 = start_ms)
      SELECT recording_id, camera, camera AS audio_camera, x.s AS start_ms, x.e AS end_ms FROM (SELECT recording_id, camera, unnest(p) AS x FROM pc) WHERE x.e - x.s > 50""",
    "verify_windows": with_views("clips") + """, d AS (SELECT reel_id, clip_idx, start_ms AS s, end_ms AS e, end_ms - start_ms AS d FROM clips), w AS (SELECT reel_id, clip_idx, s, e, 0 AS "window", CASE WHEN d < 3000 THEN 150 ELSE 250 END AS i FROM d UNION ALL SELECT reel_id, clip_idx, s, e, 1, greatest(250, d - 2300) FROM d WHERE d >= 3000)
      SELECT reel_id, clip_idx, "window", s + i AS a, s + i + least(2000, e - s - i - 100) AS b FROM w WHERE e - s - i - 100 > 0""",
    "long_xcorr": """WITH n AS (SELECT label, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings), r AS (SELECT label, n * 64 + i AS p, x[i + 1] AS v FROM n, LATERAL (SELECT unnest(range(64)) AS i)),
      f AS (SELECT label, avg(v) AS m FROM r GROUP BY label), c AS (SELECT r.label, p, v - m AS v FROM r JOIN f ON f.label = r.label), e AS (SELECT label, sum(v * v) AS e FROM c GROUP BY label),
      s AS (SELECT a.label, l AS lag, sum(a.v * b.v) AS v FROM c a, (SELECT unnest(range(-30, 31)) AS l), c b WHERE b.label = a.label + 1 AND b.p = a.p + l GROUP BY ALL)
      SELECT s.label AS ref, s.label + 1 AS other, arg_max(lag, (v, -lag)) AS lag, round_even(max(v) / (sqrt(any_value(ea.e) * any_value(eb.e)) + 1e-12), 6) AS score FROM s JOIN e ea ON ea.label = s.label JOIN e eb ON eb.label = s.label + 1 GROUP BY s.label""",
    "sync_recordings": "SELECT 'a' || label AS ref, 'b' || label AS other, 0.08::DOUBLE AS offset_start, count(*) - 5 AS n, 0.0::DOUBLE AS slope, 0.08::DOUBLE AS intercept FROM embeddings GROUP BY label HAVING count(*) > 8",
    "gated_mix": """WITH n AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings),
      src AS (SELECT label, CASE WHEN n % 2 = 0 THEN 'a' ELSE 'b' END AS camera, n // 2 * 64 + i AS at, x[i + 1] AS v FROM n, LATERAL (SELECT unnest(range(64)) AS i)),
      rg AS (SELECT label, CAST(round_even(((max(n) + 1) // 2 * 640 - 200) / 1000 * 100, 0) AS BIGINT) AS total FROM n GROUP BY label HAVING (max(n) + 1) // 2 * 640 > 200),
      sh AS (SELECT n.label, CASE WHEN vec_id % 3 = 0 THEN 'a' ELSE 'b' END AS camera, greatest(0, CAST(round_even((n * 900 - 200) / 1000 * 100, 0) AS BIGINT)) AS s FROM n JOIN rg ON rg.label = n.label WHERE round_even((n * 900 - 200) / 1000 * 100, 0) < total UNION ALL SELECT label, 'a', -9 FROM rg),
      ch AS (SELECT *, lag(camera) OVER (PARTITION BY label ORDER BY s) AS was FROM sh), ev AS (SELECT * FROM ch WHERE was IS NULL OR was <> camera),
      px AS (SELECT label, p FROM rg, LATERAL (SELECT unnest(range(total)) AS p)),
      ac AS (SELECT px.label, px.p, ev.camera AS now, px.p - ev.s AS k FROM px ASOF JOIN ev ON px.label = ev.label AND px.p >= ev.s),
      tm AS (SELECT *, 200 / 1000 + p / 100 AS t FROM ac), pl AS (SELECT label, p, 'a' AS camera, now, k, 1.0::DOUBLE AS g, (t + (0.0 * t + 0.104::DOUBLE) - 0.0) * 100 AS x FROM tm
        UNION ALL SELECT label, p, 'b', now, k, pow(10.0, -6.0::DOUBLE / 20), (t + (0.003::DOUBLE * t + (-0.371::DOUBLE)) - 0.25::DOUBLE) * 100 FROM tm),
      lv AS (SELECT *, pow(10.0, -12.0::DOUBLE / 20) AS low, CASE WHEN k < 8 THEN k / 8 ELSE 1.0::DOUBLE END AS r FROM pl),
      v AS (SELECT lv.label, lv.p, lv.g * CASE WHEN lv.camera = now THEN (1 - r) * low + r ELSE (1 - r) + r * low END * coalesce(s.v * (1 - (x - floor(x))) + e.v * (x - floor(x)), 0) AS v
        FROM lv LEFT JOIN src s ON s.label = lv.label AND s.camera = lv.camera AND s.at = CAST(floor(x) AS BIGINT) LEFT JOIN src e ON e.label = lv.label AND e.camera = lv.camera AND e.at = CAST(floor(x) AS BIGINT) + 1)
      SELECT label, p AS sample, round_even(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sum(v))), 5) + 0.0::DOUBLE AS v FROM v GROUP BY label, p""",
    "residual_scores": _RES + " SELECT recording_id, step, camera_pos, round_even(score, 3) AS score FROM rs",
    "residual_switch": _RES.replace("WITH e", "WITH RECURSIVE e") + """, st AS (SELECT recording_id, step, max(score) FILTER (camera_pos = 0) AS s0, max(score) FILTER (camera_pos = 1) AS s1 FROM rs GROUP BY ALL),
      sw AS (SELECT recording_id, step, 0 AS cam, step AS since FROM st WHERE step = 0
        UNION ALL SELECT recording_id, step, CASE WHEN go THEN 1 - cam ELSE cam END, CASE WHEN go THEN step ELSE since END FROM (SELECT st.recording_id, st.step, sw.cam, sw.since, st.step % 7 <> 3 AND (CASE WHEN s1 > s0 THEN 1 ELSE 0 END) <> sw.cam AND st.step - sw.since >= 2 AND abs(s1 - s0) >= 0.25 AS go FROM sw JOIN st ON st.recording_id = sw.recording_id AND st.step = sw.step + 1))
      SELECT recording_id, step, CASE cam WHEN 0 THEN 'click' ELSE 'view' END AS camera FROM sw""",
    "speaker_switch": _L + """, cp AS (SELECT camera, row_number() OVER (ORDER BY camera) - 1 AS pos FROM (SELECT DISTINCT camera FROM levels)),
      p AS (SELECT recording_id, hop_idx AS step, pos, l.camera, (level - 15000) / 100.0 AS s, CASE WHEN (level - 15000) / 100.0 > -50 THEN ((recording_id * 37 + hop_idx * 91 + pos * 53) % 128) / 128 END AS sim FROM levels l JOIN cp ON cp.camera = l.camera),
      a AS (SELECT *, first(camera) OVER (PARTITION BY recording_id ORDER BY pos) AS cam0 FROM p),
      g AS (SELECT recording_id, step, max(s) AS top_s, list({'v': sim, 'c': camera} ORDER BY sim DESC, pos) FILTER (s >= 0 AND sim IS NOT NULL) AS x, min(cam0) AS cam0, row_number() OVER (PARTITION BY recording_id ORDER BY step) AS rn FROM a GROUP BY recording_id, step),
      k AS (SELECT *, CASE WHEN top_s < 0 THEN 'silence' WHEN x IS NULL OR len(x) = 0 THEN 'no_candidates' WHEN x[1].v < 0.375 THEN 'low_similarity' WHEN x[1].v - coalesce(x[2].v, -1.0) < 0.0625 THEN 'margin' END AS why FROM g),
      c0 AS (SELECT recording_id, arg_min(camera, pos) AS c FROM p GROUP BY ALL),
      sw AS (SELECT k.recording_id, step, rn, CAST(c0.c AS VARCHAR) AS camera, step AS since, CASE WHEN why IS NOT NULL THEN why WHEN x[1].c = c0.c THEN 'stay' ELSE 'min_shot' END AS reason FROM k JOIN c0 ON c0.recording_id = k.recording_id WHERE rn = 1
        UNION ALL SELECT recording_id, step, rn, CASE WHEN r = 'switch' THEN b ELSE camera END, CASE WHEN r = 'switch' THEN step ELSE since END, r
        FROM (SELECT k.recording_id, k.step, k.rn, k.x[1].c AS b, sw.camera, sw.since, CASE WHEN why IS NOT NULL THEN why WHEN k.x[1].c = sw.camera THEN 'stay' WHEN k.step - sw.since < 3 THEN 'min_shot' ELSE 'switch' END AS r FROM sw JOIN k ON k.recording_id = sw.recording_id AND k.rn = sw.rn + 1))
      SELECT recording_id, step, camera, reason FROM sw""",
}
