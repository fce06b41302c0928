"""Camera shots: switching, minimum length, cutaways, balance, edit lists. Times are milliseconds.

Switching is a state machine over blocks of hops; edits go over one recording's shots at
once. Scores are made by joins before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import END, START, coalesce_shots, overlap_join
from .keyed import dealt, runs_of, whole_runs
from .switching import BLOCK, switched

SHOT = ["camera", "audio_camera", START, END]


def _steps(scores: DataFrame, key: str, *values: str) -> DataFrame:
    """key, step, cams: an array of the step's cameras by position (camera_pos, camera, values)."""
    return scores.groupBy(key, F.col("step").cast("long").alias("step")).agg(F.array_sort(F.collect_list(F.struct("camera_pos", "camera", *values))).alias("cams"))


def _firsts(steps: DataFrame, key: str) -> DataFrame:
    """key, first: the camera of the lowest position in any step. Made of the steps, which are there already."""
    lowest = steps.select(key, F.get(F.filter("cams", lambda c: c["camera_pos"].isNotNull()), F.lit(0)).alias("c"))
    return lowest.groupBy(key).agg(F.min_by("c.camera", "c.camera_pos").alias("first"))


def camera_switch(scores: DataFrame, key: str, hop_ms: int, min_shot_ms: int, margin: float, block: int = BLOCK) -> DataFrame:
    """key, step, camera from scores (key, step, camera_pos, camera, score, speech): hold in silence, switch to a better camera after min_shot by at least margin.

    speech decides silence (below 0 for all cameras), score the best camera; the first camera is
    chosen at the start and wins ties. Expressions tell of every step which cameras hold the
    picture; the state goes over blocks of steps (see switching).
    """
    steps = _steps(scores, key, "score", "speech").withColumn("top", F.expr("array_max(transform(cams, c -> struct(c.score AS score, -c.camera_pos AS pos, c.camera AS camera)))"))
    firsts, margin = _firsts(steps, key), F.lit(float(margin))
    held = F.transform(F.filter("cams", lambda c: (c["camera"] == F.col("top.camera")) | (F.col("top.score") - c["score"] < margin)), lambda c: c["camera"])
    loud = F.expr("exists(cams, c -> c.speech >= 0)")
    steps = steps.select(key, "step", F.col("top.camera").alias("best"), F.when(loud, held).alias("held"))
    return switched(steps, firsts, key, -(-min_shot_ms // hop_ms), [], block).select(key, "step", "camera")


def speaker_switch(sims: DataFrame, key: str, hop_ms: int, min_shot_ms: int, least: float, margin: float, block: int = BLOCK) -> DataFrame:
    """As camera_switch, by voice similarity: key, step, camera, reason. sims: camera_pos, camera, sim (null: not active), speech."""
    steps = _steps(sims, key, "sim", "speech").withColumn("near", F.expr("array_sort(transform(filter(cams, c -> c.speech >= 0 AND c.sim IS NOT NULL), c -> struct(-c.sim AS less, c.camera_pos AS pos, c.camera AS camera)))"))
    sim = lambda i: -F.get("near", F.lit(i))["less"]
    why = (
        F.when(~F.expr("exists(cams, c -> c.speech >= 0)"), "silence")
        .when(F.size("near") == 0, "no_candidates")
        .when(sim(0) < least, "low_similarity")
        .when(sim(0) - F.coalesce(sim(1), F.lit(-1.0)) < margin, "margin")
    )
    best, firsts = F.get("near", F.lit(0))["camera"], _firsts(steps, key)
    steps = steps.select(key, "step", best.alias("best"), why.alias("why")).withColumn("held", F.when(F.col("why").isNull(), F.array("best")))
    out = switched(steps, firsts, key, -(-min_shot_ms // hop_ms), ["best", "why"], block)
    moved = F.when(F.col("best") == F.col("before"), "stay").when(F.col("camera") == F.col("before"), "min_shot").otherwise("switch")
    return out.select(key, "step", "camera", F.coalesce("why", moved).alias("reason"))


def pin_camera(shots: DataFrame, keys: list[str], camera: str, eps: int = 50) -> DataFrame:
    """All pictures from one camera, sound as it was."""
    return coalesce_shots(shots.withColumns({"audio_camera": F.coalesce("audio_camera", F.lit(camera)), "camera": F.lit(camera)}), keys, eps)


def joined(shots: list[list], eps: int) -> list[list]:
    """Neighbours with equal cameras and a gap within eps as one; shots of 10 ms or less dropped."""
    out: list[list] = []
    for s in shots:
        if s[3] - s[2] > 10:
            if out and out[-1][:2] == s[:2] and abs(out[-1][3] - s[2]) <= eps:
                out[-1][3] = s[3]
            else:
                out.append(list(s))
    return out


def _frame(rows: list[list], key: str, pdf: pd.DataFrame) -> pd.DataFrame:
    """Shots as a typed frame with the group's key; there may be none."""
    out = pd.DataFrame(rows, columns=SHOT).astype({START: "int64", END: "int64"})
    out.insert(0, key, pdf[key].to_numpy()[[0] * len(rows)])
    return out


def per_recording(shots: DataFrame, key: str, edit, extra: str = "") -> DataFrame:
    """Applies edit(list of [camera, audio_camera, start, end]) to each recording's shots in order, many recordings to a frame."""

    def run(batches):
        for pdf in whole_runs(batches, [key]):
            at, rows, first = runs_of(pdf, [key]), [], []
            table = pdf[SHOT].values.tolist()
            for a, z in zip(at[:-1], at[1:], strict=True):
                done = edit(table[a:z])
                rows += done
                first += [a] * len(done)
            out = pd.DataFrame(rows, columns=SHOT).astype({START: "int64", END: "int64"})
            out.insert(0, key, pdf[key].iloc[first].array)
            yield out

    kind = dict(shots.dtypes)[key]
    return dealt(shots.select(key, *SHOT), [key]).sortWithinPartitions(key, START, END).mapInPandas(run, f"{key} {kind}, camera string, audio_camera string, {START} long, {END} long{extra}")


def dissolved(rows: list[list], least: int, eps: int) -> tuple[list[list], int, int]:
    """Shots without short ones where that can be, how many were merged into others, how many dropped."""

    def place(s: list[list], i: int) -> tuple[str, int] | None:
        """What to do with short shot i."""
        before = i > 0 and abs(s[i - 1][3] - s[i][2]) <= eps
        after = i + 1 < len(s) and abs(s[i + 1][2] - s[i][3]) <= eps
        if before and after and s[i - 1][:2] == s[i + 1][:2]:
            return "bridge", i
        if before and (not after or s[i - 1][3] - s[i - 1][2] >= s[i + 1][3] - s[i + 1][2]):
            return "left", i
        if after:
            return "right", i
        return ("drop", i) if i in (0, len(s) - 1) or s[i][3] - s[i][2] <= 350 else None

    base = joined(rows, eps)
    s = [list(x) for x in base]  # edits are made on a copy: base stays for the case that all shots go
    again, merged, dropped = True, 0, 0
    while again and len(s) > 1:
        again, i = False, 0
        while i < len(s):
            act = place(s, i) if s[i][3] - s[i][2] < least else None
            if act is None:
                i += 1
                continue
            again = True
            merged, dropped = merged + (act[0] != "drop"), dropped + (act[0] == "drop")
            if act[0] == "bridge":
                s[i - 1][3] = s[i + 1][3]
                del s[i : i + 2]
            elif act[0] == "left":
                s[i - 1][3] = s[i][3]
                del s[i]
            else:
                if act[0] == "right":
                    s[i + 1][2] = s[i][2]
                del s[i]
                continue
            i = max(0, i - 1)
        s = joined(s, eps)
    return s or base, merged, dropped


def enforce_min_shot(shots: DataFrame, key: str, least: int, eps: int = 60) -> DataFrame:
    """No shot shorter than `least` where it can be dissolved: a separator inside one camera goes, else the longer touching neighbour takes it (the earlier of equals), else a piece at an end or of at most 350 ms is dropped; until nothing changes."""
    return per_recording(shots, key, lambda rows: dissolved(rows, max(50, least), eps)[0])


def min_shot_report(shots: DataFrame, key: str, least: int, eps: int = 60) -> DataFrame:
    """key, n_merged, n_dropped, n_short, changed: what enforce_min_shot does with a recording, and how many short shots it has to leave."""
    least = max(50, least)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, merged, dropped = dissolved(pdf.sort_values([START, END], kind="stable")[SHOT].values.tolist(), least, eps)
        short = sum(r[3] - r[2] < least for r in rows)
        return pd.DataFrame({key: pdf[key].iloc[:1], "n_merged": [merged], "n_dropped": [dropped], "n_short": [short], "changed": [merged + dropped > 0]})

    return shots.groupBy(key).applyInPandas(run, f"{key} {dict(shots.dtypes)[key]}, n_merged long, n_dropped long, n_short long, changed boolean")


class Scores:
    """Camera scores of one recording on a hop grid, interpolated; -inf outside."""

    def __init__(self, pdf: pd.DataFrame, hop_ms: int):
        self.hop = hop_ms
        self.cameras = pdf.drop_duplicates("camera_pos").sort_values("camera_pos")["camera"].tolist()
        self.grid = {c: g.sort_values("step")[["step", "score"]].to_numpy(float) for c, g in pdf.groupby("camera")}

    def at(self, camera: str, t) -> np.ndarray:
        g = self.grid.get(camera)
        if g is None:
            return np.full(len(t), -np.inf)
        return np.interp(np.asarray(t, float) / self.hop, g[:, 0], g[:, 1], left=-np.inf, right=-np.inf)

    @classmethod
    def of(cls, spans, hop_ms: int) -> Scores:
        """From the spans of a slice (with_slices); null is an empty one."""
        table = cls.__new__(cls)
        table.hop, first, points = hop_ms, {}, {}
        rows = [] if spans is None else [p for r in spans for p in ((r["camera_pos"], r["seen"], r["step"], r["score"]), (r["camera_pos"], r["seen"], r["next"], r["next_score"])) if p[2] is not None]
        for pos, camera, step, score in sorted(set(rows)):
            first.setdefault(pos, camera)
            points.setdefault(camera, []).append((step, score))
        table.cameras = list(first.values())
        table.grid = {c: np.array(sorted(g), float) for c, g in points.items()}
        return table

    def best_other(self, camera: str, t: np.ndarray, ok=None) -> tuple[float, float, str] | None:
        """(score, time, camera) of the best other camera over times t; the earliest time, then the first camera of equals."""
        best = None
        others = [c for c in self.cameras if c != camera]
        table = np.array([self.at(c, t) for c in others]) if others else np.zeros((0, len(t)))
        if ok is not None:
            table = np.where(ok(table, self.at(camera, t)), table, -np.inf)
        for k in range(table.shape[1]):
            j = int(table[:, k].argmax()) if len(others) else -1
            if j >= 0 and table[j, k] > (best[0] if best else -np.inf):
                best = float(table[j, k]), float(t[k]), others[j]
        return best


def _with_scores(shots: DataFrame, scores: DataFrame, key: str, hop_ms: int, edit) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return _frame([], key, left)
        rows = left.sort_values([START, END], kind="stable")[SHOT].values.tolist()
        if right["camera"].nunique() >= 2:
            rows = edit(rows, Scores(right, hop_ms))
        return _frame(rows, key, left)

    kind = dict(shots.dtypes)[key]
    return shots.groupBy(key).cogroup(scores.groupBy(key)).applyInPandas(run, f"{key} {kind}, camera string, audio_camera string, {START} long, {END} long")


def insert_reactions(shots: DataFrame, scores: DataFrame, key: str, hop_ms: int, every: int, length: int, least_score: float = -0.35, force: bool = False, search: int = 1200, step: int = 400) -> DataFrame:
    """Cutaways of `length` to the best other camera every `every` of a shot, or centred in a short one.

    Where a target lies within 50 ms of the shot's last cut its lead-in piece is not written: that hole is kept as it is.
    """
    side = 800

    def edit(shot: tuple, table: Scores):
        cam, sound, a, b = shot
        size = b - a
        if size < length + 2 * side:
            yield shot
            return
        if size < every + length + 500:
            targets = [max(a + side, min(a + (size - length) / 2, b - length - side))]
        else:
            targets = [t for t in range(a + every, b, every) if t + length < b]
        cur = a
        for t in targets:
            probes = np.arange(t - search, t + search + 1e-3, max(100, step)) if search > 0 else np.array([t], float)
            limit = lambda x, c=cur: np.maximum(c + 50, np.minimum(x, b - length - 50))
            got = table.best_other(cam, limit(probes) + length / 2)
            if got is None or (got[0] < least_score and not force):
                continue
            cut = int(limit(got[1] - length / 2 if got[0] >= least_score else t))
            if t - cur > 50:
                yield cam, sound, int(cur), cut
            yield got[2], sound, cut, cut + length
            cur = cut + length
        if b - cur > 50:
            yield cam, sound, int(cur), b

    kind = dict(shots.dtypes)[key]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                shot = r.camera, r.audio_camera, r.start_ms, r.end_ms
                pieces = edit(shot, Scores.of(r.near, hop_ms)) if r.cameras >= 2 else [shot]
                out += [(getattr(r, key), *p) for p in pieces]
            yield pd.DataFrame(out, columns=[key, *SHOT]).astype({key: pdf[key].dtype, START: "int64", END: "int64"})

    rows = with_slices(coalesce_shots(shots, [key], 50).select(key, *SHOT), scores, key, hop_ms)
    pieces = rows.mapInPandas(run, f"{key} {kind}, camera string, audio_camera string, {START} long, {END} long")
    return coalesce_shots(pieces, [key], 50)


def with_slices(shots: DataFrame, scores: DataFrame, key: str, hop_ms: int) -> DataFrame:
    """shots with near (the scores that its time needs, with those before and after them, for interpolation) and cameras (how many the recording has scores of). Each shot gets its own slice, so no task holds a recording's scores."""
    # Dealt by recording, so that spans need no other shuffle to meet their width.
    follow = W.partitionBy(key, "camera").orderBy("step")
    spans = scores.select(key, "camera_pos", "camera", "step", "score").repartition(key)
    spans = spans.select(key, "camera_pos", F.col("camera").alias("seen"), "step", "score", F.lead("step").over(follow).alias("next"), F.lead("score").over(follow).alias("next_score"))
    spans = spans.withColumns({"r_start_ms": (F.col("step") * hop_ms).cast("long"), "r_end_ms": (F.coalesce("next", "step") * hop_ms + 1).cast("long")})
    # A camera's spans are as long together as from its first step to its last.
    lengths = scores.groupBy(key, "camera").agg(F.count("step").alias("n"), (F.max("step") - F.min("step")).alias("d"))
    facts = lengths.groupBy(key).agg(F.count("camera").alias("cameras"), (F.sum("d") * hop_ms / F.nullif(F.sum("n"), F.lit(0)) + 1).alias("_span"))
    width = facts.join(shots.groupBy(key).agg(F.avg(F.col(END) - F.col(START)).alias("_shot")), key).select(key, F.ceil(F.greatest("_span", "_shot")).cast("long").alias("_width"))
    span = F.struct("camera_pos", "seen", "step", "score", "next", "next_score")
    inside = overlap_join(shots, spans, [key], width).select(key, *SHOT, span.alias("near"))
    # Shots themselves are rows without a span: those that meet none stay, those that are there twice too.
    own = shots.join(facts.drop("_span"), key, "left").select(key, *SHOT, F.coalesce("cameras", F.lit(0)).alias("cameras"), F.lit(1).alias("_own"))
    rows = inside.unionByName(own, allowMissingColumns=True).groupBy(key, *SHOT).agg(F.collect_list("near").alias("near"), F.max("cameras").alias("cameras"), F.count("_own").cast("int").alias("_n"))
    return rows.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).drop("_n")


def balance_cameras(shots: DataFrame, scores: DataFrame, key: str, hop_ms: int, most_share: float, cutaway: int = 2400, gap: int = 7000, side: int = 800, search: int = 1200, step: int = 400, least_cut: int = 1600, advantage: float = 2.0, least_score: float = 0.0) -> DataFrame:
    """Cutaways in the camera that shows longest until its share is at most most_share; none where it clearly leads or the other is too quiet."""

    def edit(rows: list[list], table: Scores) -> list[list]:
        rows = joined(rows, 50)
        shown = pd.DataFrame(rows, columns=SHOT).assign(d=lambda x: x[END] - x[START]).groupby("camera", sort=False)["d"].sum()
        main, left = shown.idxmax(), shown.max() - most_share * shown.sum()
        if left <= 0 or main not in table.cameras:
            return rows
        short, goal = max(600, least_cut), max(600, least_cut, cutaway)
        fair = lambda s, own: (s >= least_score) & (own - s <= advantage)
        out: list[list] = []
        for cam, sound, a, b in rows:
            cur, target, misses = a, a + gap, 0
            while cam == main and left > 0 and misses < 8:
                size = goal if left >= goal else max(short, left)
                lo, hi = cur + side, b - size - side
                if hi <= lo:
                    break
                target = min(max(target, lo), hi)
                probes = np.arange(target - search, target + search + 1e-3, max(100, step)) if search > 0 else np.array([target], float)
                starts = np.clip(probes, lo, hi)
                got = table.best_other(main, starts + size / 2, fair)
                if got is None:
                    misses += 1
                    if target + max(gap, size) > hi:
                        break
                    target += max(gap, size)
                    continue
                cut = got[1] - size / 2
                if cut - cur > 50:
                    out.append([main, sound, int(cur), int(cut)])
                out.append([got[2], sound, int(cut), int(cut + size)])
                left, cur, misses = left - size, cut + size, 0
                target = cur + gap
            if b - cur > 50 or cam != main:
                out.append([cam, sound, int(cur), b])
        return joined(out, 5)

    return _with_scores(shots, scores, key, hop_ms, edit)


def camera_share(shots: DataFrame, key: str) -> DataFrame:
    """key, total, dominant camera (the first by name of equals) and its time."""
    d = shots.filter(F.col(END) > F.col(START)).groupBy(key, "camera").agg(F.sum(F.col(END) - F.col(START)).alias("shown_ms"))
    top = F.min(F.struct((-F.col("shown_ms")).alias("n"), F.col("camera").alias("c"))).alias("t")
    return d.groupBy(key).agg(F.sum("shown_ms").alias("total_ms"), top).select(key, "total_ms", F.col("t.c").alias("dominant"), (-F.col("t.n")).alias("dominant_ms"))


def apply_cuts(shots: DataFrame, cuts: DataFrame, key: str, least: int = 50) -> DataFrame:
    """Shots without the cut intervals; pieces shorter than `least` go, touching pieces of one camera join."""
    from .intervals import merge_intervals, subtract_intervals

    # A shot is known by all it has, so its cameras come along and need no join afterwards.
    ids = shots.select(key, *SHOT, F.col(START).alias("_from"), F.col(END).alias("_to"))
    pieces = subtract_intervals(ids, merge_intervals(cuts, [key]), [key], ["_from", "_to", "camera", "audio_camera"], least, None)
    return coalesce_shots(pieces.drop("_from", "_to"), [key], 5)


def shot_plan(scores: DataFrame, cuts: DataFrame | None, key: str, hop_ms: int, end_ms: Column, min_shot_ms: int, margin: float, pin: str | None = None, reaction: tuple[int, int] | None = None, most_share: float | None = None) -> DataFrame:
    """The chain: switch, runs, pin, reactions, balance, pause cuts, minimum length (between 200 ms and 1.2 s)."""
    from .intervals import run_length_shots

    shots = run_length_shots(camera_switch(scores, key, hop_ms, min_shot_ms, margin), [key], hop_ms, end_ms)
    if pin:
        shots = pin_camera(shots, [key], pin)
    if reaction:
        shots = insert_reactions(shots, scores, key, hop_ms, *reaction)
    if most_share:
        shots = balance_cameras(coalesce_shots(shots, [key], 50), scores, key, hop_ms, most_share)
    if cuts is not None:
        shots = apply_cuts(shots, cuts, key)
    return enforce_min_shot(shots, key, min(1200, max(200, min_shot_ms)))


def camera_ranges(shots: DataFrame, offsets: DataFrame, key: str, pad: int) -> DataFrame:
    """Per camera what must be fetched: mapped shot times with a pad, from 0 on. offsets: camera, offset_ms."""
    rows = shots.join(offsets, "camera", "left").withColumn("_o", F.coalesce("offset_ms", F.lit(0)))
    return rows.groupBy(key, "camera").agg(F.greatest(F.lit(0), F.min(F.col(START) + F.col("_o")) - pad).alias("from_ms"), (F.max(F.col(END) + F.col("_o")) + pad).alias("to_ms"))


def edit_list(shots: DataFrame, offsets: DataFrame, key: str) -> DataFrame:
    """Picture and sound source times of each shot of at least 50 ms, from 0 on."""
    at = lambda c, n: offsets.select(F.col("camera").alias(c), F.col("offset_ms").alias(n))
    rows = shots.filter(F.col(END) - F.col(START) >= 50).join(at("camera", "_p"), "camera", "left").join(at("audio_camera", "_s"), "audio_camera", "left")
    mapped = lambda n: F.greatest(F.lit(0), F.col(START) + F.coalesce(n, F.lit(0)))
    return rows.select(key, START, (F.col(END) - F.col(START)).alias("duration_ms"), "camera", mapped("_p").alias("picture_ms"), "audio_camera", mapped("_s").alias("sound_ms"))


def one_sound(shots: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """key, audio_camera where one camera's sound covers the whole range."""
    from .intervals import covers_range

    single = shots.groupBy(key).agg(F.count_distinct("audio_camera").alias("n"), F.min("audio_camera").alias("audio_camera")).filter("n = 1").drop("n")
    return single.join(covers_range(shots, bounds, [key]).filter("covered").select(key), key)

