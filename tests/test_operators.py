"""Golden values and properties of single operators."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from clipweave.functions import text as X
from clipweave.functions import timecode as T
from clipweave.operators import align, candidates, captions, catalog, intervals, levels, mixing, ranks, shots, signal, speakers, sync, timeline
from clipweave.sources import readers, wav, writers
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_timeline_moves_clips_and_cues(spark):
    clips = spark.createDataFrame([("r", 0, "a", 1000, 3000, 0), ("r", 1, "b", 5000, 6000, 500)], "reel_id string, clip_idx int, source string, start_ms long, end_ms long, advance_ms long")
    cues = spark.createDataFrame([("r", "a", 1500, 2500, "first"), ("r", "b", 4000, 5500, "second"), ("r", "a", 5200, 5800, "hidden")], "reel_id string, source string, start_ms long, end_ms long, text string")
    got = timeline.to_reel_time(timeline.laid_out(clips), cues, ["reel_id", "source"], ["text"]).select("text", "reel_start_ms", "reel_end_ms")
    assert rows(got) == [("first", 500, 1500), ("second", 2000, 3000)]
    frames = timeline.build_clips(clips).orderBy("clip_idx").collect()
    assert [(r.start_frame, r.end_frame, r.at_frame) for r in frames] == [(30, 90, 0), (135, 165, 60)]


def test_srt_times_round_trip(spark):
    df = spark.range(1).select(T.srt_time(F.lit(3723456)).alias("t"))
    assert df.first().t == "01:02:03,456"
    assert df.select(T.parse_clock_ms(F.col("t"))).first()[0] == 3723456
    assert spark.range(1).select(T.timestamp_to_seconds(F.lit("nan")), T.timestamp_to_seconds(F.lit("1.5d")), T.timestamp_to_seconds(F.lit("02:10"))).first()[:] == (None, None, 130.0)


def test_accents_only_from_word_starts(spark):
    df = spark.createDataFrame([("на олимпиаду",), ("Пи или е",), ("культ плюсника",)], "t string")
    got = [r[0] for r in df.select(X.accent_spans(F.col("t"), ["пи", "плюсник"])).collect()]
    assert got == [[], ["Пи"], ["плюсника"]]


def test_balanced_wrap_keeps_words_and_fits(spark):
    text = "очень длинная русская подпись которую надо разбить ровно"
    lines = spark.createDataFrame([(text,)], "t string").select(X.wrap_balanced(1500)("t")).first()[0]
    assert " ".join(lines) == text and 2 <= len(lines) <= 3
    assert all(X.estimated_units(x) <= 1500 for x in lines)


def test_late_start_is_found():
    rng = np.random.default_rng(1)
    sr = 16000
    t = np.arange(10 * sr) / sr
    a = rng.normal(0, 0.2, len(t)) * (t % 1 < 0.7)
    b = a[int(0.37 * sr) :]
    hop = sr // 100
    lag, score = signal.xcorr_lag(signal.envelope_of(a, hop), signal.envelope_of(b, hop), 200)
    assert abs(lag / 100 + 0.37) <= 0.011 and score > 0.9
    lag, _ = signal.gcc_phat(a, b, sr)
    assert abs(lag / sr + 0.37) <= 0.011


def test_merge_is_idempotent_and_complement_adds_up(spark):
    rng = np.random.default_rng(3)
    s = rng.integers(0, 10_000, 300)
    df = spark.createDataFrame(pd.DataFrame({"k": rng.integers(0, 4, 300), "start_ms": s, "end_ms": s + rng.integers(0, 400, 300)}))
    once = intervals.merge_intervals(df, ["k"])
    assert rows(intervals.merge_intervals(once, ["k"]).select("k", "start_ms", "end_ms")) == rows(once.select("k", "start_ms", "end_ms"))
    bounds = df.select("k").distinct().select("k", F.lit(0).cast("long").alias("lo"), F.lit(11_000).cast("long").alias("hi"))
    length = lambda d: d.agg(F.sum(F.col("end_ms") - F.col("start_ms"))).first()[0]
    assert length(once) + length(intervals.complement(once, bounds, ["k"])) == bounds.count() * 11_000


def test_min_shot_keeps_cover(spark):
    df = spark.createDataFrame([("r", c, c, a, b) for c, a, b in [("x", 0, 3000), ("y", 3000, 3200), ("x", 3200, 6000), ("y", 6000, 6300), ("z", 6300, 9000)]], "r string, camera string, audio_camera string, start_ms long, end_ms long")
    got = [(r.camera, r.start_ms, r.end_ms) for r in shots.enforce_min_shot(df, "r", 1000).orderBy("start_ms").collect()]
    assert got == [("x", 0, 6300), ("z", 6300, 9000)]


def test_caption_pages_share_time():
    parts = captions.share_out(1000.0, [1, 1, 8], 180)
    assert sum(parts) == 1000 and min(parts) >= 180
    pages = captions.paged("one two three four five six seven eight nine ten eleven twelve", 2500, 10, 2, 2000)
    assert " ".join(" ".join(p) for p in pages) == "one two three four five six seven eight nine ten eleven twelve"
    assert len(pages) == 1


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"video_path": "v", "segments": [{"start": 0, "end": 1.5, "text": "a b", "words": [{"start": 0, "end": 1, "word": "a"}]}, {"start": 2, "end": 3, "text": "c"}]}')
    assert [(r.seg_idx, r.end) for r in readers.read_transcripts(spark, str(tmp_path / "t.json")).orderBy("seg_idx").collect()] == [(0, 1.5), (1, 3.0)]
    assert readers.read_words(spark, str(tmp_path / "t.json")).count() == 2
    (tmp_path / "p.json").write_text('{"id": "01", "sources": {"a": {"video": "a.mov", "audio": "a.mov"}}, "clips": [["a", 1.0, 3.0]], "cues": [["a", 1.5, 2.5, "hi"]], "insets": [[5.2, 5.4, "s.png", 10, 20]]}')
    plans = readers.read_plans(spark, str(tmp_path / "p.json"), root="/m")
    assert plans["cues"].first()[2:] == ("a", 1.5, 2.5, "hi") and plans["sources"].first().video == "/m/a.mov"
    (tmp_path / "u.csv").write_text("index,filename,basename,camera,start,end\n2,,b.mp4,c,1.5,2\nx,f.mp4,,,,\n1,a.mp4,z,,,\n")
    assert [(r[0], r.filename, r.start) for r in readers.read_upload_list(spark, str(tmp_path / "u.csv")).collect()] == [(1, "a.mp4", None), (2, "b.mp4", 1.5)]
    df = spark.createDataFrame([("a;b", 'q"x'), (None, "y")], "p string, q string")
    writers.write_excel_csv(df, str(tmp_path / "x"))
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "x").glob("part*")))
    assert data.decode("utf-8") == '﻿sep=;\r\np;q\r\n"a;b";"q""x"\r\n;y\r\n'
    writers.write_excel_tsv(df, str(tmp_path / "y"))
    assert any(f.read_bytes()[:2] in (b"\xfe\xff", b"\xff\xfe") for f in (tmp_path / "y").glob("part*"))


@pytest.mark.parametrize("by_range", [True, False, None])
def test_wav_chunks(spark, tmp_path, by_range):
    import wave

    x = (np.sin(np.arange(8000) / 10) * 20000).astype("<i2")
    for name, channels, data in (("a", 1, x), ("empty", 1, x[:0]), ("stereo", 2, x)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(8000)
            w.writeframes(data.tobytes())
    read = lambda name: wav.read_wav_chunks(spark, str(tmp_path / f"{name}.wav"), 0.25, 0.05, by_range, 1, 100)
    got = read("a").orderBy("chunk_idx").collect()
    assert [(r.chunk_idx, r.sr, r.start_sample, len(r.samples)) for r in got] == [(0, 8000, 0, 2400), (1, 8000, 2000, 2400), (2, 8000, 4000, 2400), (3, 8000, 6000, 2000)]
    assert np.allclose(got[1].samples, x[2000:4400] / 32768, atol=1e-6)
    assert [tuple(r)[1:] for r in read("empty").collect()] == [(0, 8000, 0, [])]
    with pytest.raises(Exception, match="not mono 16 bit"):
        read("stereo").count()
    if by_range:  # one file, several tasks
        assert read("a").select(F.spark_partition_id()).distinct().count() > 1


def test_wav_round_trip(spark, tmp_path):
    rows = [("x", 0, [0.0, 0.5, -1.0]), ("x", 5, [1.0, 2.0]), ("x", 6, [0.25, 0.25]), ("y/1", 2, [0.5])]
    df = spark.createDataFrame(rows, "k string, start_sample long, samples array<double>").repartition(3)
    files = wav.write_wav(df, f"file://{tmp_path}/out", "k", 10)
    assert rows_of(files.select("k", "n_samples")) == [("x", 8), ("y/1", 3)]
    got = {r.path.rpartition("/")[2]: [round(v * 32768) for v in r.samples] for r in wav.read_wav_chunks(spark, f"{tmp_path}/out/wav/*.wav", 10.0).collect()}
    assert got == {"x.wav": [0, 16383, -32767, 0, 0, 32767, 32767, 8191], "y_1.wav": [0, 0, 16383]}


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def mixed_by_hand(tracks, cameras, shots, sr, start_ms, end_ms, fade_s, low):
    """Sample by sample. tracks: camera -> {sample: value}; cameras: [(name, slope, shift, begin, gain)] by position; shots: (camera, start, end) apart from each other."""
    total, fade = int(round((end_ms - start_ms) / 1000 * sr)), int(round(fade_s * sr))
    at = lambda ms: max(0, int(round((ms - start_ms) / 1000 * sr)))
    names, on, events, out = [c[0] for c in cameras], cameras[0][0], [], []
    for p in range(total):
        now = next((c if c in names else names[0] for c, a, z in shots if at(a) <= p < at(z)), on)
        if now != on and p > 0:
            events.append((p, on, now))
        elif now != on:
            events.append((0, on, now))
        on, t, mix = now, start_ms / 1000 + p / sr, 0.0
        for name, slope, shift, begin, gain in cameras:
            x = (t + (slope * t + shift) - begin) * sr
            i = int(np.floor(x))
            v = tracks[name][i] * (1 - (x - i)) + tracks[name][i + 1] * (x - i) if i in tracks[name] and i + 1 in tracks[name] else 0.0
            g = 1.0 if name == on else low
            own = [e for e in events if name in e[1:]]
            if own and p - own[-1][0] < fade and fade > 1:
                r = (p - own[-1][0]) / fade
                g = (1 - r) + r * low if name == own[-1][1] else (1 - r) * low + r
            mix += v * gain * g
        out.append(max(-1.0, min(1.0, mix)))
    return out


@pytest.mark.parametrize("hard", [False, True])
def test_gated_mix_does_not_depend_on_chunks(spark, hard):
    rng = random.Random(4)
    sr, tracks, sources = 50, {}, []
    for c, size, lost in (("x", 37, 4), ("y", 64, 99), ("z", 300, 99)):
        tracks[c] = {}
        for k, a in enumerate(range(0, 600, size)):
            v = [rng.uniform(-0.6, 0.6) for _ in range(size)]
            if k != lost:  # a chunk is missing
                sources.append(("r", c, a, v))
                tracks[c] |= {a + i: s for i, s in enumerate(v)}
    cameras = [("r", "x", 0, 0.31, None, None, None, None), ("r", "y", 1, None, -0.013, None, 1.007, 3.0), ("r", "z", 2, 9.0, 0.02, -0.5, 0.0, -4.0)]
    plain = [("x", 0.0, 0.31, 0.0, 1.0), ("y", -0.013, 0.0, 1.007, 10 ** (3 / 20)), ("z", 0.02, -0.5, 0.0, 10 ** (-4 / 20))]
    t, shots_ = 400, []
    for _ in range(14):  # some shorter than a fade, some after a gap, one of an unknown camera
        d = rng.choice([60, 100, 900])
        shots_.append((rng.choice(["x", "y", "z", "?"]), t, t + d))
        t += d + rng.choice([0, 0, 240])
    want = mixed_by_hand(tracks, plain, shots_, sr, 700, 9_310, 0.2, 0.0 if hard else 10 ** (-18 / 20))
    src = spark.createDataFrame(sources, "r string, camera string, start_sample long, samples array<double>")
    cam = spark.createDataFrame(cameras, "r string, camera string, camera_pos int, offset_start double, slope double, intercept double, audio_start_s double, shift_db double")
    sh = spark.createDataFrame([("r", "no", c, a, z) for c, a, z in shots_], "r string, camera string, audio_camera string, start_ms long, end_ms long")
    rg = spark.createDataFrame([("r", sr, 700, 9_310), ("none", sr, 100, 100)], "r string, sr int, start_ms long, end_ms long")
    for chunk_s in (0.14, 1.0, 100.0):
        got = mixing.gated_mix(src, cam, sh, rg, "r", chunk_s, 0.2, hard_gate=hard, width=128).orderBy("chunk_idx").collect()
        assert np.allclose([v for r in got for v in r.mixed], want, atol=1e-9)
        assert [r.start_sample for r in got] == [i * len(got[0].mixed) for i in range(len(got))]


@pytest.fixture
def tiny_batches(spark):
    """Arrow batches of three rows: what goes through a key in order must carry its state over them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, old)


CAND = "recording_id long, cand_idx long, start_ms long, end_ms long, score_milli long"


def brute_selection(rows, target=45_000, most=6, percent=80):
    kept = []
    for r in sorted(rows, key=lambda r: (-((r[4] or 0) * target - 80 * abs(r[3] - r[2] - target)), -(r[4] or 0), r[1])):
        ratio = lambda k, r=r: 100 * max(0, min(k[3], r[3]) - max(k[2], r[2])) / min(k[3] - k[2], r[3] - r[2]) if min(k[3] - k[2], r[3] - r[2]) > 0 else 0
        if len(kept) < most and all(ratio(k) < percent for k in kept):
            kept.append(r)
    return kept


def test_selection_matches_brute_force(spark, tiny_batches):
    rng = random.Random(1)
    data = [(k, i, s := rng.randrange(0, 200_000), s + rng.choice([0, -500, 20_000, 45_000, 60_000]), rng.choice([None, *range(5)])) for k in range(5) for i in range(20 * (k > 0) + 1)]
    df = spark.createDataFrame([(k if k != 4 else None, *r) for k, *r in data], CAND)
    got = sorted(tuple(r)[1:] for r in candidates.select_candidates(df, ["recording_id"], "cand_idx").collect())
    want = sorted(tuple(r[1:]) for k in range(5) for r in brute_selection([d for d in data if d[0] == k]))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_empty_candidates_overlap_nothing(spark):
    df = spark.createDataFrame([(1, 0, 0, 45_000, 9), (1, 1, 10_000, 10_000, 8), (1, 2, 50_000, 95_000, 7)], CAND)
    assert candidates.select_candidates(df, ["recording_id"], "cand_idx").count() == 3


def test_matching_matches_brute_force(spark, tiny_batches):
    rng = random.Random(2)
    side = lambda: [(k, i, s := rng.randrange(0, 60_000), s + rng.randrange(1000, 30_000)) for k in range(4) for i in range(9)]
    a, b = side(), side()
    left = spark.createDataFrame(a, "k long, i long, start_ms long, end_ms long")
    right = spark.createDataFrame(b, "k long, j long, r_start_ms long, r_end_ms long")
    got = sorted((r.k, r.i, r.j, r.overlap_ms) for r in candidates.greedy_match(left, right, ["k"]).collect())
    want = []
    for k in range(4):
        pairs = [(min(x[3], y[3]) - max(x[2], y[2]), x[1], y[1]) for x in a for y in b if x[0] == y[0] == k and x[3] > y[2] and x[2] < y[3]]
        i_used, j_used = set(), set()
        for o, i, j in sorted(pairs, reverse=True):
            if i not in i_used and j not in j_used:
                i_used.add(i)
                j_used.add(j)
                want.append((k, i, j, o))
    assert got == sorted(want)


def test_evaluation_statuses_and_shares(spark):
    cases = spark.createDataFrame([("ok", True, "base"), ("none", True, "base"), ("t", False, "base"), ("b", True, None), ("o", True, "x")], "k string, has_transcript boolean, base_model string")
    rows = lambda *xs: spark.createDataFrame([(k, i, a, b) for k in ("ok", "t", "b", "o") for i, (a, b) in enumerate(xs)], "k string, pos int, start_ms long, end_ms long")
    e = candidates.eval_models(cases, rows((0, 10_000), (50_000, 60_000)), rows((0, 20_000)), ["k"], "base")
    got = {r.k: r for r in e.collect()}
    assert {k: r.status for k, r in got.items()} == {"ok": "ok", "none": "ok", "t": "missing_transcript", "b": "missing_baseline", "o": "other_baseline"}
    r = got["ok"]
    assert (r.matched, r.base_rate, r.model_rate, r.avg_iou, r.base_covered, r.model_covered, r.close_share) == (1, 1.0, 0.5, 0.5, 0.5, 0.5, 0.0)
    assert got["none"].base_rate == 0 and got["t"].matched is None
    total = candidates.eval_summary(e).first()
    assert (total.total_cases, total.ok_cases, total.base_rate) == (5, 2, 0.5)


def test_balanced_wrap_matches_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        words = ["".join(rng.choice("ilmWaeo.") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 11))]
        limit = rng.choice([300, 600, 900, 1500])
        want = None
        for n in (1, 2, 3, 4):
            best = None
            for cuts in itertools.combinations(range(1, len(words)), n - 1):
                lines = [words[a:b] for a, b in zip((0, *cuts), (*cuts, len(words)), strict=True)]
                wide = [X.estimated_units(" ".join(x)) for x in lines]
                if max(wide) > limit or any(len(x) == 1 and len(x[0]) <= 4 for x in lines[1:]):
                    continue
                score = 10 * max(wide) - 3 * min(wide)
                if best is None or score < best[0]:
                    best = score, [" ".join(x) for x in lines]
            if best:
                want = best[1]
                break
        assert X.balanced_lines(words, limit) == (want or [" ".join(words)])
    assert len(X.balanced_lines(["word"] * 50_000, 6000)) == 1


def plain_min_shot(shots_in, least, eps):
    """Restated plainly: one change at a time, from the first short shot that can be changed, until none can."""

    def join(s):
        out = []
        for c, a, x, y in s:
            if y - x > 10:
                if out and out[-1][:2] == [c, a] and abs(out[-1][3] - x) <= eps:
                    out[-1][3] = y
                else:
                    out.append([c, a, x, y])
        return out

    def one_pass(s):
        i, changed = 0, False
        while i < len(s):
            c, a, x, y = s[i]
            if y - x >= least:
                i += 1
                continue
            near = lambda p, q: abs(p - q) <= eps
            prev = s[i - 1] if i and near(s[i - 1][3], x) else None
            nxt = s[i + 1] if i + 1 < len(s) and near(s[i + 1][2], y) else None
            if prev and nxt and prev[:2] == nxt[:2]:
                prev[3] = nxt[3]
                s[i : i + 2] = []
                i = max(0, i - 1)
            elif prev and (not nxt or prev[3] - prev[2] >= nxt[3] - nxt[2]):
                prev[3] = y
                s[i : i + 1] = []
                i = max(0, i - 1)
            elif nxt:
                nxt[2] = x
                s[i : i + 1] = []
            elif i in (0, len(s) - 1) or y - x <= 350:
                s[i : i + 1] = []
            else:
                i += 1
                continue
            changed = True
        return changed

    s = join(shots_in)
    base = [list(x) for x in s]
    while len(s) > 1 and one_pass(s):
        s = join(s)
    return s or base


def test_min_shot_matches_a_plain_restatement(spark):
    rng = random.Random(4)
    data = {}
    for k in range(60):
        at, rows_k = 0, []
        for _ in range(rng.randrange(1, 12)):
            d = rng.choice([5, 100, 300, 600, 900, 2000, 5000])
            rows_k.append([c := rng.choice("xyz"), rng.choice([c, "x"]), at, at + d])
            at += d + rng.choice([0, 0, 0, 40, 500])
        data[k] = rows_k
    df = spark.createDataFrame([(k, *r) for k, rs in data.items() for r in rs], "k long, camera string, audio_camera string, start_ms long, end_ms long")
    got = {}
    for r in shots.enforce_min_shot(df, "k", 1000).orderBy("k", "start_ms").collect():
        got.setdefault(r.k, []).append([r.camera, r.audio_camera, r.start_ms, r.end_ms])
    assert all(got.get(k, []) == plain_min_shot(rs, 1000, 60) for k, rs in data.items())
    apart = spark.createDataFrame([(1, "x", "x", 0, 100), (1, "y", "y", 5000, 5100)], df.schema)
    assert shots.enforce_min_shot(apart, "k", 1000).count() == 2


def test_envelope_mean_and_lag_bounds(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 4000)
    df = spark.createDataFrame([("r", 1000, 0, x.tolist())], "r string, sr int, start_sample long, samples array<double>")
    got = [r.rms for r in signal.energy_envelope(df, ["r"], 20, 10, centred=True).orderBy("hop_idx").collect()]
    plain = np.array([np.sqrt((x[i : i + 20] ** 2).mean()) for i in range(0, 3981, 10)])
    assert np.allclose(got, plain - plain.mean()) and abs(np.mean(got)) < 1e-12
    assert signal.gcc_phat(x[:20], x[:20], 200)[0] == 0.0
    assert signal.gcc_phat(x[:20], x[:20], 0)[0] == 0.0


def test_offsets_of_late_signals(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(0, 1, 3000)
    late = np.concatenate([rng.normal(0, 0.01, 120), a])[:3000]
    df = spark.createDataFrame([(0, a.tolist(), late.tolist())], "id long, a array<double>, b array<double>")
    for method in ("best", "gcc_phat", "envelope", "xcorr"):
        r = signal.estimate_offset(df, ["id"], 1.0, 1000.0, method).first()
        assert abs(r.offset - 0.12) <= 0.011, method
    assert signal.estimate_offset(df, ["id"], 1.0, 1000.0).first().method == "gcc_phat"
    r = signal.refine_offset(df.withColumn("center", F.lit(0.1)), ["id"], 1000.0, 0.05, 0.005).first()
    assert abs(r.offset - 0.12) < 1e-9 and r.error < 0.2
    for start in (0.0, 0.05, 0.3):
        r = signal.verify_alignment(df.withColumn("current", F.lit(start)), ["id"], 1000.0, 0.002, 0.5).first()
        assert r.aligned and abs(r.corrected - 0.12) < 0.002
    r = signal.window_lags(df.withColumnsRenamed({"a": "y", "b": "x"}), ["id"], 8000).first()
    assert abs(r.lag_seconds - 120 / 8000) < 1e-9 and r.correlation > 0.5
    assert signal.window_lags(df.select("id", F.slice("a", 1, 700).alias("x"), F.col("b").alias("y")), ["id"]).count() == 0


def test_residual_scores_have_shift_and_bias(spark):
    df = spark.createDataFrame([("r", 0, [1.0, 0.0], [0.0, 0.1], 3.0, 0.5)], "r string, step long, a array<double>, b array<double>, shift_a double, bias_b double")
    got = {r.camera_pos: r.score for r in signal.residual_scores(df, "r").collect()}
    assert abs(got[0] - (20 * np.log10(np.sqrt(0.5)) + 3)) < 1e-4 and abs(got[1] - (20 * np.log10(np.sqrt(0.005)) + 0.5)) < 1e-4


def test_titles(spark):
    df = spark.createDataFrame([("Про вмк и мехмат",), ("ну это просто длинная фраза из многих разных слов подряд. Ещё",), ("Нет",), (None,), ("Тут задача",)], "t string")
    assert [r[0] for r in df.select(X.title_of(F.col("t"))).collect()] == ["ВМК против мехмата: куда идти?", "Это просто длинная фраза из многих разных слов?", None, None, "Как решать задачи и не застревать?"]
    t = spark.createDataFrame([("в целом, «привет»!!  мир",), ("слово " * 40,)], "t string").select(X.polish_title(F.col("t"))).collect()
    assert t[0][0] == ", «привет! мир" or "привет" in t[0][0]
    assert len(t[1][0]) <= 140 and t[1][0].endswith("слово")


def test_probe_and_run_records(spark):
    probe = '{"streams": [{"codec_type": "audio", "codec_name": " AAC "}, {"codec_type": "video", "codec_name": "H264", "width": 1080, "height": 0, "r_frame_rate": "30000/1001"}, {"codec_type": "video", "codec_name": "png"}], "format": {"duration": "12.5"}}'
    r = catalog.probe_flatten(spark.createDataFrame([(1, probe), (2, "{}"), (3, None)], "id long, probe string"), ["id"]).orderBy("id").collect()
    assert r[0][1:] == ("h264", 1080, None, 30000 / 1001, "aac", 12.5) and r[1][1:] == r[2][1:] == (None,) * 6
    runs = spark.createDataFrame([("a", "transcribe", "error", 1.0, None), ("b", "candidates", "ok", 1.0, 0), ("c", "candidates", "ok", 1.0, 2), ("c", "render", "error", 2.0, None), ("c", "render", "ok", 2.0, None)], "run string, type string, status string, seconds double, count int")
    got = {r.run: (r.run_status, r.n_ok, r.n_error) for r in catalog.run_log_summary(runs, "run").collect()}
    assert got == {"a": ("error_transcribe", 0, 0), "b": ("ok_no_candidates", 0, 0), "c": ("partial", 1, 1)}


def test_similarity_takes_the_best_centroid(spark):
    w = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0])], "id long, v array<double>")
    c = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "label string, centroid array<double>")
    got = [(r.best, round(r.best_sim, 6), round(r.margin, 6)) for r in speakers.speaker_similarity(w, c, ["id"], "v", "label").orderBy("id").collect()]
    assert got == [("a", 1.0, 1.0), ("b", 1.0, 1.0), ("b", round(0.5**0.5, 6), 0.0)]
    assert speakers.speaker_similarity(w, c.limit(0), ["id"], "v", "label").count() == 0


def align_by_hand(blocks, segs, most=90, least_ms=6000, longest_ms=140_000):
    """Windows tried one by one. blocks: normalized texts; segs: (start, end, normalized text, has a mark)."""
    import difflib

    out, at, latest = [], 0, None
    mean = sum(len(s[2].split()) for s in segs) / len(segs)
    for k, text in enumerate(blocks):
        goal = set(text.split())
        expected = max(2, int(round(len(text.split()) / max(1.0, mean))))
        best = None
        for i in range(at, max(at, len(segs) - (len(blocks) - k)) + 1):
            for j in range(i, min(len(segs), i + min(most, expected * 4 + 8))):
                window = segs[i : j + 1]
                if j - i + 1 < max(1, expected // 3) or not least_ms <= window[-1][1] - window[0][0] <= longest_ms:
                    continue
                joined = " ".join(s[2] for s in window)
                words = set(joined.split())
                f1 = 2.0 * len(goal & words) / (len(goal) + len(words)) if goal and words else 0.0
                score = 0.62 * f1 + 0.38 * difflib.SequenceMatcher(None, text[:3000], joined[:3000]).ratio()
                score = max(0.0, score - 0.08 if any(s[3] for s in window) else score)
                if best is None or score > best[0]:
                    best = score, i, j
        score, i, j = best or (0.0, min(at, len(segs) - 1), min(len(segs) - 1, min(at, len(segs) - 1) + max(2, expected)))
        start, end = segs[i][0], segs[j][1]
        start = start if latest is None else max(start, latest)
        latest = end if end > start else start + 3000
        out.append((k, start, latest, score))
        at = min(j + 1, len(segs) - 1)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_align_blocks_equals_trying_every_window(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["стоп", "удалить", "mistake", "застопорить"]
    t, segs = 0, []
    for _ in range(rng.choice([3, 14, 40])):
        d = rng.choice([900, 4000, 9000]) if seed else 200
        segs.append((t, t + d, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 9])))))
        t += d + rng.choice([0, 500])
    blocks = [" ".join(s[2] for s in segs[a : a + rng.choice([1, 2, 6])]) + " W1, w2!" for a in sorted(rng.sample(range(len(segs)), 3))]
    marked = [any(w.startswith(("стоп", "удали")) for w in s[2].split()) for s in segs]
    want = align_by_hand([" ".join(b.lower().replace(",", "").replace("!", "").split()) for b in blocks], [(*s, m) for s, m in zip(segs, marked, strict=True)])
    s = spark.createDataFrame([("r", i, *x) for i, x in enumerate(segs)], "r string, seg_idx long, start_ms long, end_ms long, text string")
    bl = spark.createDataFrame([("r", i, b) for i, b in enumerate(blocks)], "r string, block_idx long, text string")
    got = align.align_blocks(bl, s, "r").orderBy("block_idx").collect()
    assert [tuple(r)[1:] for r in got] == want


def test_align_blocks_without_segments_or_windows(spark, monkeypatch):
    segs = spark.createDataFrame([("r", i, i * 1000, i * 1000 + 500, "a b") for i in range(3)], "r string, seg_idx long, start_ms long, end_ms long, text string")
    blocks = spark.createDataFrame([("r", 0, "a b"), ("r", 1, None), ("other", 0, "a")], "r string, block_idx long, text string")
    # No window lasts 6 s: the next few segments, and times that do not go back.
    assert rows(align.align_blocks(blocks, segs, "r")) == [("r", 0, 0, 2500, 0.0), ("r", 1, 2500, 5500, 0.0)]
    assert align.align_blocks(blocks, segs.limit(0), "r").count() == 0
    monkeypatch.setattr(align, "SLAB", 2)
    long = spark.createDataFrame([("r", i, i * 4000, i * 4000 + 3900, f"w{i} w{i + 1} w{i * i % 7}") for i in range(12)], segs.schema)
    some = spark.createDataFrame([("r", i, f"w{i * 4} w{i * 4 + 1} w{i * 4 + 2}") for i in range(3)], blocks.schema)
    want = align_by_hand([f"w{i * 4} w{i * 4 + 1} w{i * 4 + 2}" for i in range(3)], [(i * 4000, i * 4000 + 3900, f"w{i} w{i + 1} w{i * i % 7}", False) for i in range(12)])
    assert [r[1:] for r in rows(align.align_blocks(some, long, "r"))] == want


def test_speech_text_filter_takes_the_reference_markers(spark):
    df = spark.createDataFrame([(1, "Вырезать это"), (2, "удалили"), (3, "  камера  пошла"), (4, "стоп раз два три четыре пять"), (5, "не застопорить"), (6, " "), (7, "перезаписываем дубль")], "i long, text string")
    assert rows(align.speech_text_filter(df).select("i", "text")) == [(3, "камера пошла"), (4, "стоп раз два три четыре пять"), (5, "не застопорить")]


def switch_by_hand(steps, hop, least, margin):
    """steps: {n: [(position, camera, score, speech)]}, one recording."""
    first = min((p, c) for cams in steps.values() for p, c, *_ in cams)[1]
    now, since, out = first, min(steps), []
    for n in sorted(steps):
        cams = sorted(steps[n])
        best = max(cams, key=lambda c: (c[2], -c[0]))
        own = next((c[2] for c in cams if c[1] == now), float("-inf"))
        if any(c[3] >= 0 for c in cams) and best[1] != now and (n - since) * hop >= least and best[2] - own >= margin:
            now, since = best[1], n
        out.append((n, now))
    return out


def speaker_by_hand(steps, hop, least, low, margin):
    first = min((p, c) for cams in steps.values() for p, c, *_ in cams)[1]
    now, since, out = first, min(steps), []
    for n in sorted(steps):
        near = sorted((-s, p, c) for p, c, s, v in steps[n] if v >= 0 and s is not None)
        if not any(c[3] >= 0 for c in steps[n]):
            why = "silence"
        elif not near:
            why = "no_candidates"
        elif -near[0][0] < low:
            why = "low_similarity"
        elif -near[0][0] - (-near[1][0] if len(near) > 1 else -1.0) < margin:
            why = "margin"
        elif near[0][2] == now:
            why = "stay"
        elif (n - since) * hop < least:
            why = "min_shot"
        else:
            why, now, since = "switch", near[0][2], n
        out.append((n, now, why))
    return out


@pytest.mark.parametrize(("block", "least", "margin"), [(1, 300, 1.0), (7, 0, 0.0), (7, 450, 0.5), (64, 1000, 0.0), (4096, 900, 1.0)])
def test_switching_is_the_same_for_any_block(spark, block, least, margin):
    rng = random.Random(block + least)
    data = []
    for r in ("a", "b"):
        for n in sorted(rng.sample(range(-20, 400), 250)):  # steps are missing, and cameras in some
            cams = [(p, c) for p, c in enumerate(["x", "y", "z"]) if rng.random() < 0.9] or [(2, "z")]
            data += [(r, n, p, c, float(rng.randrange(5)), rng.choice([1.0, 0.0, -1.0, -1.0])) for p, c in cams]
    df = spark.createDataFrame(data, "r string, step long, camera_pos int, camera string, score double, speech double").repartition(5)
    by = {r: {} for r in ("a", "b")}
    for r, n, *cam in data:
        by[r].setdefault(n, []).append(tuple(cam))
    want = sorted((r, *x) for r in by for x in switch_by_hand(by[r], 100, least, margin))
    assert rows(shots.camera_switch(df, "r", 100, least, margin, block)) == want
    sims = df.withColumnRenamed("score", "sim").withColumn("sim", F.when(F.col("sim") < 4, F.col("sim") / 4))
    sim = {r: {n: [(p, c, s / 4 if s < 4 else None, v) for p, c, s, v in cams] for n, cams in by[r].items()} for r in by}
    want = sorted((r, *x) for r in by for x in speaker_by_hand(sim[r], 100, least, 0.3, margin / 2))
    assert rows(shots.speaker_switch(sims, "r", 100, least, 0.3, margin / 2, block)) == want
def test_caption_pages_keep_words_and_time(spark):
    rng = random.Random(8)
    segs = [(i, i * 20_000, i * 20_000 + rng.choice([100, 800, 3000, 9000]), " ".join("x" * rng.randrange(1, 12) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    got = {}
    for r in captions.caption_pages(spark.createDataFrame(segs, "k long, start_ms long, end_ms long, text string"), ["k"]).orderBy("k", "start_ms").collect():
        got.setdefault(r.k, []).append(r)
    for k, a, b, text in segs:
        pages = got.get(k, [])
        if b - a < 180:
            assert not pages
            continue
        assert " ".join(" ".join(p.text.split("\n")) for p in pages) == text
        assert pages[0].start_ms == a and pages[-1].end_ms == b
        assert all(x.end_ms == y.start_ms for x, y in itertools.pairwise(pages)) and all(p.end_ms > p.start_ms for p in pages)
        assert len(pages) == 1 or (b - a) / len(pages) >= 2000


def scored_cameras(spark):
    """Three cameras, a score per second: x is always best, y better than z in even tens of seconds."""
    rows = [("r", t, i, c, float(s)) for t in range(0, 200) for i, (c, s) in enumerate([("x", 10), ("y", 5 if t // 10 % 2 == 0 else 1), ("z", 3)])]
    return spark.createDataFrame(rows, "k string, step long, camera_pos int, camera string, score double")


def test_cutaways_change_the_picture_only(spark):
    shot = spark.createDataFrame([("r", "x", "x", 0, 100_000), ("r", "y", "x", 100_000, 103_000)], "k string, camera string, audio_camera string, start_ms long, end_ms long")
    got = [tuple(r)[1:] for r in shots.insert_reactions(shot, scored_cameras(spark), "k", 1000, every=20_000, length=2000).orderBy("start_ms").collect()]
    assert all(a == "x" for _, a, _, _ in got) and got[0][2] == 0 and got[-1][3] == 103_000
    assert all(x[3] == y[2] for x, y in itertools.pairwise(got))  # no holes
    cut = [r for r in got if r[0] != "x" and r[2] < 100_000]
    assert len(cut) == 4 and all(r[3] - r[2] == 2000 for r in cut)
    best = lambda t: "y" if t // 10_000 % 2 == 0 else "z"
    assert all(r[0] == best((r[2] + r[3]) // 2) for r in cut)
    assert all(abs(r[2] + 1000 - 20_000 * (i + 1) - 0) <= 1200 + 1000 for i, r in enumerate(cut))
    few = shots.insert_reactions(shot, scored_cameras(spark), "k", 1000, every=20_000, length=2000, least_score=50.0).collect()
    assert len(few) == 2  # none is good enough


def reactions_by_hand(shots_, grid, hop, every, length, least, search, step):
    """One recording's shots (camera, start, end), apart from each other; grid: camera -> {step: score} by position."""
    out = []
    for cam, a, b in shots_:
        if b - a < length + 1600:
            out.append((cam, a, b))
            continue
        short = b - a < every + length + 500
        targets = [max(a + 800, min(a + (b - a - length) / 2, b - length - 800))] if short else [t for t in range(a + every, b, every) if t + length < b]
        cur = a
        for t in targets:
            best = None
            for k in range(2 * search // step + 1):
                at = max(cur + 50, min(t - search + k * step, b - length - 50)) + length / 2
                for c, g in grid.items():
                    x = at / hop
                    lo, hi = max((n for n in g if n <= x), default=None), min((n for n in g if n >= x), default=None)
                    if c == cam or lo is None or hi is None:
                        continue
                    v = g[lo] if lo == hi else g[lo] + (g[hi] - g[lo]) * (x - lo) / (hi - lo)
                    if best is None or v > best[0] + 1e-12:
                        best = v, at, c
            if best is None or best[0] < least:
                continue
            cut = int(max(cur + 50, min(best[1] - length / 2, b - length - 50)))
            if t - cur > 50:
                out.append((cam, int(cur), cut))
            out.append((best[2], cut, cut + length))
            cur = cut + length
        if b - cur > 50:
            out.append((cam, int(cur), b))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_reactions_equal_trying_every_probe(spark, seed):
    rng = random.Random(seed)
    grid = {c: {n: float(rng.randrange(-3, 9)) for n in range(0, 130) if rng.random() < 0.5} for c in "xyz"}
    t, cut = 0, []
    for _ in range(9):
        d = rng.choice([900, 4000, 9000, 30_000])
        cut.append((rng.choice("xyz"), t, t + d))
        t += d + 200  # apart, so that no neighbours are joined
    scores = spark.createDataFrame([("r", n, "xyz".index(c), c, v) for c, g in grid.items() for n, v in g.items()] + [("one", 3, 0, "x", 1.0)], "k string, step long, camera_pos int, camera string, score double")
    df = spark.createDataFrame([("r", c, "s", a, b) for c, a, b in cut] + [("one", "y", "s", 0, 60_000), ("none", "x", "s", 0, 60_000)], "k string, camera string, audio_camera string, start_ms long, end_ms long")
    got = [tuple(r) for r in shots.insert_reactions(df, scores, "k", 1000, every=7000, length=2000, least_score=0.5).orderBy("k", "start_ms").collect()]
    assert [r for r in got if r[0] != "r"] == [("none", "x", "s", 0, 60_000), ("one", "y", "s", 0, 60_000)]
    assert [(c, a, b) for k, c, _, a, b in got if k == "r"] == [s for s in reactions_by_hand(cut, grid, 1000, 7000, 2000, 0.5, 1200, 400) if s[2] - s[1] > 10]


def test_balance_brings_the_share_down(spark):
    shot = spark.createDataFrame([("r", "x", "x", 0, 100_000), ("r", "y", "y", 100_000, 120_000)], "k string, camera string, audio_camera string, start_ms long, end_ms long")
    share = lambda rs: sum(r.end_ms - r.start_ms for r in rs if r.camera == "x") / 120_000
    got = shots.balance_cameras(shot, scored_cameras(spark), "k", 1000, 0.7, advantage=20.0).orderBy("start_ms").collect()
    assert share(got) <= 0.7 + 1e-6 and share(got) > 0.6
    assert got[0].start_ms == 0 and got[-1].end_ms == 120_000 and all(x.end_ms == y.start_ms for x, y in itertools.pairwise(got))
    assert {r.audio_camera for r in got if r.end_ms <= 100_000} == {"x"}
    same = shots.balance_cameras(shot, scored_cameras(spark), "k", 1000, 0.7, advantage=2.0).collect()
    assert len(same) == 2  # the main camera clearly leads everywhere


def test_upload_plan_without_a_limit_and_with_untidy_statuses(spark):
    items = spark.createDataFrame([("a", i) for i in range(5)], "account string, index int")
    progress = spark.createDataFrame([("a", 0, " Published "), ("a", 1, "FAILED"), ("a", 2, None)], "account string, index int, status string")
    qc = spark.createDataFrame([(i, "ok") for i in range(5)], "index int, status string")
    plan = lambda size: [r[2] for r in rows(catalog.upload_plan(items, progress, qc, "account", size))]
    assert plan(0) == plan(-1) == ["skip_published", "skip_failed", "dry_run", "dry_run", "dry_run"]
    assert plan(2) == ["skip_published", "skip_failed", "dry_run", "dry_run", "untouched"]


def test_min_shot_report_counts_merged_dropped_and_left(spark):
    data = [("a", "x", 0, 5000), ("a", "y", 5000, 5400), ("a", "x", 5400, 9000), ("a", "y", 9000, 9500), ("a", "z", 11_000, 11_200), ("a", "y", 13_000, 13_900), ("a", "x", 15_000, 20_000), ("b", "x", 0, 300)]
    df = spark.createDataFrame([(r, c, None, a, z) for r, c, a, z in data], "r string, camera string, audio_camera string, start_ms long, end_ms long")
    got = {r.r: r for r in shots.min_shot_report(df, "r", 1000).collect()}
    # y at 5000 is a separator, y at 9000 goes to x before it, z is dropped, y at 13000 stands alone and stays.
    assert tuple(got["a"])[1:] == (2, 1, 1, True) and tuple(got["b"])[1:] == (0, 0, 1, False)
    assert {(r.start_ms, r.end_ms) for r in shots.enforce_min_shot(df.filter("r = 'a'"), "r", 1000).collect()} == {(0, 9500), (13_000, 13_900), (15_000, 20_000)}


def test_caption_lines_break_as_escaped_text_does(spark):
    text = "\\\\\\\\ab {cdef} ghi"  # four backslashes count as eight characters
    df = spark.createDataFrame([("r", 0, 9000, text)], "r string, start_ms long, end_ms long, text string")
    assert [r.text for r in captions.caption_pages(df, ["r"], most_chars=10).collect()] == ["\\\\\\\\ab\n[cdef] ghi"]


def test_sequence_ratio_is_that_of_longest_common_runs(spark):
    def matched(a, b):
        """Characters in common: the longest common run (the first of equals), then left and right of it."""
        n, i, j = max(((k, -i, -j) for i in range(len(a)) for j in range(len(b)) for k in range(min(len(a) - i, len(b) - j) + 1) if a[i : i + k] == b[j : j + k]), default=(0, 0, 0))
        return n + matched(a[:-i], b[:-j]) + matched(a[n - i :], b[n - j :]) if n else 0

    rng = random.Random(1)
    pairs = [("".join(rng.choices("abc", k=rng.randrange(9))), "".join(rng.choices("abc", k=rng.randrange(9)))) for _ in range(40)] + [("", ""), ("a", "")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", X.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(abs(r.r - (2 * matched(r.a, r.b) / (len(r.a) + len(r.b)) if r.a or r.b else 1.0)) < 1e-12 for r in got)


def test_percentiles_from_counts_are_exact(spark):
    rng = random.Random(6)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *map(float, range(9)), 0.5])) for _ in range(300)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: tuple(r)[1:] for r in ranks.percentiles(df, ["k"], "v", {"p": 0.88, "m": 0.5, "x": 1.0}).collect()}
    for k in {k for k, _ in data}:
        own = [v for q, v in data if q == k and v is not None]
        assert got[k] == ((None,) * 3 if not own else tuple(np.percentile(own, [88, 50, 100])) if len(own) == 1 else tuple(pytest.approx(np.percentile(own, q)) for q in (88, 50, 100)))


@pytest.mark.parametrize("block", [1, 50, 10**9])
def test_long_series_run_over_blocks(spark, block):
    rng = random.Random(block)
    spans = [(rng.choice(["a", None]), s, s + rng.choice([0, 1, 30, 400])) for s in (rng.randrange(-500, 3000) for _ in range(300))]
    df = spark.createDataFrame(spans, "k string, start_ms long, end_ms long")
    for gap in (0, 5):
        want = []
        for k in ("a", None):
            for s, e in sorted((s, e) for q, s, e in spans if q == k and e > s):
                if want and want[-1][0] == k and s <= want[-1][2] + gap:
                    want[-1][2] = max(want[-1][2], e)
                else:
                    want.append([k, s, e])
        got = intervals.merge_intervals(df, ["k"], gap, block=block).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    cuts = intervals.merge_intervals(df.filter("k = 'a'"), ["k"], block=block)
    plain = [tuple(r)[1:] for r in cuts.collect()]
    points = spark.createDataFrame([("a", t) for t in range(-600, 3600, 37)], "k string, t_ms long")
    got = intervals.removed_before(points, cuts, ["k"], block=block).collect()
    assert {r.t_ms: r.removed_ms for r in got} == {t: sum(max(0, min(e, t) - s) for s, e in plain) for t in range(-600, 3600, 37)}
    bounds = spark.createDataFrame([("a", min(s for s, _ in plain), max(e for _, e in plain))], "k string, lo long, hi long")
    hole = max((b[0] - a[1] for a, b in itertools.pairwise(sorted(plain))), default=0)
    assert [intervals.covers_range(cuts, bounds, ["k"], t, block).first().covered for t in (hole, hole - 1)] == [True, False]


def as_tracks(spark, tracks, sizes):
    data = [(k, a, x[a : a + sizes[k]].tolist()) for k, x in tracks.items() for a in range(0, len(x), sizes[k])]
    return spark.createDataFrame(data, "track string, start_sample long, samples array<double>").repartition(3)


@pytest.mark.parametrize("block", [64, 700, 1 << 20])
def test_long_correlation_equals_that_of_one_row(spark, block):
    rng = np.random.default_rng(block)
    x = rng.normal(size=1500) + 3
    tracks = {"a": x, "late": np.concatenate([np.zeros(37), x])[:1400], "early": x[60:] + 5, "short": x[500:530]}
    t = as_tracks(spark, tracks, {"a": 100, "late": 333, "early": 64, "short": 7})
    pairs = spark.createDataFrame([("a", "late"), ("a", "early"), ("late", "a"), ("a", "short"), ("short", "a")], "ref string, other string")
    for most in (80, 2000):
        got = {(r.ref, r.other): (r.lag, r.score) for r in sync.long_xcorr(t, pairs, most, block, 256).collect()}
        for (p, q), (lag, score) in got.items():
            want = signal.xcorr_lag(tracks[p], tracks[q], most)
            assert lag == want[0] and score == pytest.approx(want[1], abs=1e-9)
        assert len(got) == 5


def test_sync_finds_offset_and_drift_in_chunks(spark):
    rng = np.random.default_rng(9)
    rate, x = 1000, rng.normal(size=60_000)
    at = np.arange(60_000)
    smooth = np.convolve(x, np.ones(5) / 5, "same")
    other = np.interp(at - 40 - at * 0.0005, at, smooth)  # 40 samples late and slower
    tracks = {"ref": smooth, "cam": other, "none": rng.normal(size=2000)}
    t = as_tracks(spark, tracks, {"ref": 4000, "cam": 7001, "none": 500})
    pairs = spark.createDataFrame([("ref", "cam", 1.0, 50.0), ("ref", "none", 30.0, 5.0)], "ref string, other string, fit_start double, fit_duration double")
    points = sync.offset_points(t, pairs, 4.0, 5.0, 0.5, 0.0, rate).orderBy("window_idx").collect()
    assert [(r.ref, r.other, r.t) for r in points] == [("ref", "cam", 1.0 + 5 * k) for k in range(11)]
    for r in points:
        a, b = (tracks[k][int(r.t * rate) : int(r.t * rate) + 4000] for k in ("ref", "cam"))
        lag, sure = signal.gcc_phat(a, b, 500)
        assert r.method != "gcc_phat" or (r.offset == lag / rate and r.confidence == pytest.approx(sure))
    m = sync.sync_recordings(t, pairs, rate, 4.0, 5.0, 0.5).collect()
    assert len(m) == 1 and m[0].n == 11
    assert abs(m[0].slope - 0.0005) < 5e-5 and abs(m[0].intercept - 0.04) < 2e-3
    slope, intercept = np.polyfit([r.t for r in points], [r.offset for r in points], 1, w=[max(r.score, 1e-6) for r in points])
    assert m[0].slope == pytest.approx(slope, abs=1e-9) and m[0].intercept == pytest.approx(intercept, abs=1e-7)


def test_greedy_match_of_piles_makes_no_pairs(spark, tiny_batches):
    rng = random.Random(2)
    left, right = ([(k, i, s, s + d) for k in ("a", None, "b") for i, (s, d) in enumerate((rng.randrange(60), rng.choice([0, 5, 30, 30])) for _ in range(40 if k else 3))] for _ in range(2))
    want = []
    for k in ("a", None, "b"):
        pairs = sorted(((min(e, f) - max(s, t), i, j) for q, i, s, e in left if q == k and e > s for r, j, t, f in right if r == k and f > t and min(e, f) > max(s, t)), reverse=True)
        used = set(), set()
        for o, i, j in pairs:
            if i not in used[0] and j not in used[1]:
                used[0].add(i)
                used[1].add(j)
                want.append((k, i, j, o))
    df = [spark.createDataFrame(x, "k string, n long, s long, e long") for x in (left, right)]
    got = candidates.greedy_match(df[0].toDF("k", "i", "start_ms", "end_ms"), df[1].toDF("k", "j", "r_start_ms", "r_end_ms"), ["k"]).collect()
    assert sorted(((r.k, r.i, r.j, r.overlap_ms) for r in got), key=repr) == sorted(want, key=repr)
    one = np.zeros(50, np.int64), np.full(50, 9)  # all alike: lists run out and are made anew
    assert candidates.best_first(one, one, top=2) == [(n, n) for n in range(50)]
    assert candidates.greedy_match(df[0].toDF("k", "i", "start_ms", "end_ms").limit(0), df[1].toDF("k", "j", "r_start_ms", "r_end_ms"), ["k"]).count() == 0


def test_buckets_fit_long_intervals(spark):
    rng = random.Random(4)
    left, right = ([(rng.choice("ab"), i, s, s + rng.choice([0, 3, 200, 40_000, 10**14])) for i, s in enumerate(rng.randrange(60_000) for _ in range(60))] for _ in range(2))
    want = sorted((k, i, j, max(s, t), min(e, f)) for k, i, s, e in left for q, j, t, f in right if k == q and e > s and f > t and e > t and s < f)
    a, b = spark.createDataFrame(left, "k string, i long, start_ms long, end_ms long"), spark.createDataFrame(right, "k string, j long, r_start_ms long, r_end_ms long")
    got = intervals.overlap_join(a, b, ["k"], None)
    assert sorted(map(tuple, got.select("k", "i", "j", "clip_start_ms", "clip_end_ms").collect())) == want


def test_cuts_of_shots_of_any_length(spark):
    far = 3 * 10**14  # of minutes more than an array can hold
    df = spark.createDataFrame([("r", "x", None, 0, far), ("r", "y", "x", far, far + 500), ("r", "z", "z", far + 500, far + 2000), ("s", "x", "x", 0, far)], "k string, camera string, audio_camera string, start_ms long, end_ms long")
    cuts = spark.createDataFrame([("r", 100, 140), ("r", 130, 200), ("r", 5 * 10**13, 5 * 10**13 + 60), ("r", far - 10, far + 900), ("t", 0, 9)], "k string, start_ms long, end_ms long")
    got = [tuple(r) for r in shots.apply_cuts(df, cuts, "k").select("k", "camera", "audio_camera", "start_ms", "end_ms").orderBy("k", "start_ms").collect()]
    assert got == [("r", "x", "x", 0, 100), ("r", "x", "x", 200, 5 * 10**13), ("r", "x", "x", 5 * 10**13 + 60, far - 10), ("r", "z", "z", far + 900, far + 2000), ("s", "x", "x", 0, far)]


def test_reactions_between_far_scores(spark):
    far = 2 * 10**11  # seconds: of minutes more than an array can hold
    scores = spark.createDataFrame([("r", 0, 0, "x", 9.0), ("r", 0, 1, "y", 0.0), ("r", far, 1, "y", float(far))], "k string, step long, camera_pos int, camera string, score double")
    df = spark.createDataFrame([("r", "x", "x", 0, 30_000), ("s", "z", "x", 0, 1000 * far)], "k string, camera string, audio_camera string, start_ms long, end_ms long")
    got = shots.insert_reactions(df, scores, "k", 1000, every=20_000, length=2000).filter("k = 'r'").orderBy("start_ms")
    assert [tuple(r)[1:] for r in got.collect()] == [("x", "x", 0, 21_200), ("y", "x", 21_200, 23_200), ("x", "x", 23_200, 30_000)]


def late_pairs(spark):
    """Signals and the same three samples late. Of these 20,000 the first three are those whose phase transform the cut-off end moves by an eighth of a sample."""
    some = np.random.default_rng(11).normal(size=(20_000, 128))[[5090, 6598, 16_617, *range(50)]]
    late = np.concatenate([np.zeros((len(some), 3)), some[:, :125]], 1)
    return some, late, spark.createDataFrame([(i, x.tolist(), y.tolist(), 1.0) for i, (x, y) in enumerate(zip(some, late, strict=True))], "id long, a array<double>, b array<double>, current double")


def test_phase_transform_places_the_peak_by_plain_correlation(spark):
    some, late, df = late_pairs(spark)
    assert [signal.gcc_phat(x, y, 16)[0] for x, y in zip(some, late, strict=True)] == [3.0] * len(some)
    assert {r.offset for r in signal.estimate_offset(df, ["id"], 16, 1.0, "gcc_phat").collect()} == {3.0}
    rng, f = np.random.default_rng(12), np.fft.rfftfreq(1024)
    for d in (-7.25, 0.5, 3.0, 11.875):
        s = np.fft.rfft(rng.normal(size=1024)) / (1 + (f / 0.15) ** 4)
        a, b = np.fft.irfft(s)[256:768], np.fft.irfft(s * np.exp(-2j * np.pi * f * d))[256:768]
        for sign in (1, -1):
            assert abs(signal.gcc_phat(a + rng.normal(size=512) * 0.05, sign * b + rng.normal(size=512) * 0.05, 50)[0] - d) <= 0.125
    assert signal.gcc_phat(np.zeros(20), np.zeros(20), 5)[1] == 0.0


def test_offset_of_cut_off_signals(spark):
    assert {(r.offset, r.method) for r in signal.estimate_offset(late_pairs(spark)[2], ["id"], 0.05, 1000.0).collect()} == {(0.003, "gcc_phat")}


def test_alignment_of_cut_off_signals(spark):
    assert {(r.corrected, r.aligned) for r in signal.verify_alignment(late_pairs(spark)[2], ["id"], 1.0, 0.1, 16).collect()} == {(3.0, True)}


def test_listening_windows_of_clips_of_whole_milliseconds(spark):
    clips = [(i, a, a + d) for i, (a, d) in enumerate(itertools.product([0, 1, 2100, 5300, 86_399_700], [249, 250, 251, 2999, 3000, 3001, 4650]))]
    df = spark.createDataFrame([(0, i, a / 1000, b / 1000) for i, a, b in clips], "r long, clip_idx long, start double, end double")
    want = []
    for i, a, b in clips:
        into = [150] if b - a < 3000 else [250, max(250, b - a - 2300)]
        want += [(i, n, a + s, a + s + min(2000, b - a - s - 100)) for n, s in enumerate(into) if b - a - s - 100 > 0]
    got = [(r.clip_idx, r.window, r.a * 1000, r.b * 1000) for r in signal.verify_windows(df, "r").orderBy("clip_idx", "window").collect()]
    assert [(i, n, round(a), round(b)) for i, n, a, b in got] == want and all(abs(x - round(x)) < 1e-4 for r in got for x in r[2:])


def test_minimum_length_goes_through_many_recordings_at_once(spark, tiny_batches):
    rng = random.Random(8)
    want, given = {}, []
    for k in range(40):
        t, own = 0, []
        for _ in range(rng.randrange(1, 9)):
            d = rng.choice([20, 300, 700, 5000])
            own.append([rng.choice("xy"), "s", t, t + d])
            t += d + rng.choice([0, 0, 30, 900])
        want[k] = [(k, *r) for r in shots.dissolved(own, 1000, 60)[0]]
        given += [(k, *r) for r in own]
    rng.shuffle(given)
    df = spark.createDataFrame(given, "k long, camera string, audio_camera string, start_ms long, end_ms long")
    got = shots.enforce_min_shot(df, "k", 1000)
    assert sorted(map(tuple, got.collect())) == sorted(r for rs in want.values() for r in rs)
    assert shots.enforce_min_shot(df.limit(0), "k", 1000).count() == 0
    # A call of pandas for every recording took more time than the rule.
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
