"""Clip candidates: parsing model answers, snapping, bounds, selection, fallback windows, matching, evaluation."""

from __future__ import annotations

import functools
import heapq
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecode import number, seconds_to_timestamp, timestamp_to_seconds
from .keyed import dealt, fold_in_order, keep_in_order, runs_of, whole_runs

START, END = "start_ms", "end_ms"
CANDIDATE = "array<struct<start:string,end:string,title:string,reason:string,score:string>>"
_LITERAL = r'("(?:start|end)"\s*:\s*)(["\']?)(\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?)\2'


@F.pandas_udf(T.StringType())
def clean_json(answers: pd.Series) -> pd.Series:
    """The JSON text inside a model answer, time literals as seconds; null where there is none."""

    def seconds(m: re.Match) -> str:
        total = 0.0
        for part in m[3].split(":"):
            total = total * 60 + float(part)
        return f"{m[1]}{total:.3f}"

    def parses(t: str) -> bool:
        try:
            json.loads(t)
        except ValueError:
            return False
        return True

    def one(answer):
        t = re.sub(_LITERAL, seconds, (answer or "").strip())
        if not t:
            return "[]"
        opened = [i for i in (t.find("["), t.find("{")) if i >= 0]
        tail = t[min(opened) :].strip().strip("`").strip() if opened else ""
        closed = tail[: max(tail.rfind("]"), tail.rfind("}")) + 1]
        return next((x for x in (t, tail, closed) if x and parses(x)), None)

    return answers.map(one)


def extract_candidates(answers: DataFrame, ids: list[str], text: str = "answer") -> DataFrame:
    """ids, position, start and end in seconds, title, reason, score; items without times are dropped."""
    items = F.from_json(clean_json(F.col(text)), CANDIDATE)
    rows = answers.select(*ids, F.posexplode(items).alias("position", "c"))
    rows = rows.select(*ids, "position", timestamp_to_seconds(F.col("c.start")).alias("start"), timestamp_to_seconds(F.col("c.end")).alias("end"), "c.title", "c.reason", number(F.col("c.score")).alias("score"))
    return rows.filter(F.col("start").isNotNull() & F.col("end").isNotNull())


def normalize_rows(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """Rows longer than 4 s, times rounded to hundredths, the first `most` per key in order."""
    ok = rows.filter(F.col("end") > F.col("start") + 4).withColumns({"start": F.bround("start", 2), "end": F.bround("end", 2)})
    return ok.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter(F.col("_n") <= most).drop("_n")


def window_filter(rows: DataFrame, lo: Column, hi: Column, slack=0) -> DataFrame:
    return rows.filter((F.col(START) >= lo - slack) & (F.col(END) <= hi + slack))


def nearest(points: DataFrame, grid: DataFrame, keys: list[str], at: str, ids: list[str]) -> DataFrame:
    """keys, ids, nearest: the grid value nearest to `at`, the smaller of equals. One sort of points and grid together."""
    g = grid.select(*keys, F.col("t").alias("_t"), F.col("t").alias("_g")).distinct()
    p = points.select(*keys, *ids, F.col(at).alias("_t")).withColumn("_point", F.lit(1))
    both = p.unionByName(g, allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy("_t", F.col("_point").asc_nulls_first())
    below = F.last("_g", True).over(order.rowsBetween(W.unboundedPreceding, 0))
    above = F.first("_g", True).over(order.rowsBetween(0, W.unboundedFollowing))
    rows = both.withColumns({"_b": below, "_a": above}).filter("_point = 1")
    pick = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(F.col("_t") - F.col("_b") <= F.col("_a") - F.col("_t"), F.col("_b")).otherwise(F.col("_a"))
    return rows.select(*keys, *ids, pick.alias("nearest"))


def snap(cands: DataFrame, segments: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Starts to the nearest segment start, ends to the nearest segment end; an end not after its start moves to the next later end."""
    s = nearest(cands, segments.select(*keys, F.col(START).alias("t")), keys, START, ids).withColumnRenamed("nearest", "_s")
    e = nearest(cands, segments.select(*keys, F.col(END).alias("t")), keys, END, ids).withColumnRenamed("nearest", "_e")
    rows = cands.join(s, [*keys, *ids]).join(e, [*keys, *ids])
    rows = next_end(rows, segments, keys, ids, F.col("_s") + 1, "_later")
    end = F.when(F.col("_e") <= F.col("_s"), F.coalesce("_later", "_e")).otherwise(F.col("_e"))
    return rows.withColumns({START: F.col("_s"), END: end}).drop("_s", "_e", "_later")


def next_end(rows: DataFrame, segments: DataFrame, keys: list[str], ids: list[str], at: Column, name: str) -> DataFrame:
    """rows with the smallest segment end >= at (null: none), by one sort."""
    g = segments.select(*keys, F.col(END).alias("_t"), F.col(END).alias("_g")).distinct()
    p = rows.select(*keys, *ids, at.alias("_t")).withColumn("_point", F.lit(1))
    order = W.partitionBy(*keys).orderBy("_t", F.col("_point").desc_nulls_last()).rowsBetween(0, W.unboundedFollowing)
    found = p.unionByName(g, allowMissingColumns=True).withColumn(name, F.first("_g", True).over(order)).filter("_point = 1").select(*keys, *ids, name)
    return rows.join(found, [*keys, *ids])


def enforce_duration(cands: DataFrame, segments: DataFrame, keys: list[str], ids: list[str], least: int, most: int) -> DataFrame:
    """Bounds on length: short ones grow to the first segment end from start + least on within 1.25 * most; long ones end at the segment end nearest start + most; else dropped. Adds `changed`."""
    soft = most * 5 // 4
    rows = cands.filter(F.col(END) > F.col(START))
    rows = next_end(rows, segments, keys, ids, F.col(START) + least, "_grow")
    rows = rows.withColumn("_target", F.col(START) + most)
    near = nearest(rows, segments.select(*keys, F.col(END).alias("t")), keys, "_target", ids).withColumnRenamed("nearest", "_near")
    rows = next_end(rows.join(near, [*keys, *ids]), segments, keys, ids, F.col(START) + 1, "_first")
    length = F.col(END) - F.col(START)
    # The nearest end at or before the start cannot be taken: then the first end after it is nearest.
    cut = F.when(F.col("_near") > F.col(START), F.col("_near")).otherwise(F.col("_first"))
    end = F.when(length < least, F.when(F.col("_grow") - F.col(START) <= soft, F.col("_grow"))).when(length > soft, F.when(cut - F.col(START) <= soft, cut)).otherwise(F.col(END))
    rows = rows.withColumns({"_end": end, "changed": (length < least) | (length > soft)}).filter(F.col("_end") > F.col(START))
    return rows.withColumn(END, F.col("_end")).drop("_end", "_grow", "_target", "_near", "_first")


def clamp_to_end(cands: DataFrame, segments: DataFrame, keys: list[str], slack=500) -> DataFrame:
    """Ends over the transcript's end by at most slack move to it; others beyond are dropped."""
    last = segments.groupBy(*keys).agg(F.max(END).alias("_last"))
    rows = cands.join(last, keys).filter(F.col(END) <= F.col("_last") + slack).withColumn(END, F.least(END, "_last"))
    return rows.filter(F.col(END) > F.col(START)).drop("_last")


def rank_key(target: int) -> Column:
    """score - 0.08 * |length - target| / target, times 1000 * target, in whole numbers."""
    return F.coalesce("score_milli", F.lit(0)) * target - 80 * F.abs(F.col(END) - F.col(START) - target)


def select_candidates(cands: DataFrame, keys: list[str], order: str, target: int = 45_000, most: int = 6, percent: int = 80) -> DataFrame:
    """Best-ranked candidates that overlap no better kept one by `percent` of the shorter; at most `most` per key.

    An empty or reversed candidate overlaps nothing. A key's rows are read once, in order of
    rank; what is kept of it, `most` rows, is all that a task holds.
    """

    def keep(kept: list, c: dict, a: int, z: int) -> list[int]:
        taken, starts, ends = [], c[START], c[END]
        for i in range(a, z):
            if len(kept) == most:
                break
            s, e = starts[i], ends[i]
            if not any(100 * (min(e, y) - max(s, x)) >= percent * min(e - s, y - x) > 0 for x, y in kept):
                kept.append((s, e))
                taken.append(i)
        return taken

    ranked = cands.withColumns({"_rank": rank_key(target), "_score": F.coalesce("score_milli", F.lit(0))})
    return keep_in_order(ranked, keys, [F.desc("_rank"), F.desc("_score"), F.col(order)], list, keep, [START, END]).select(*cands.columns)


def _window_fold(target: int, least: int, most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([START, END], kind="stable").reset_index(drop=True)
        s, e = pdf[START].to_numpy(), pdf[END].to_numpy()
        rows, i = [], 0
        while i < len(s):
            j = i + int(np.argmin(np.append(e[i + 1 :] - s[i] <= target, False)))
            while j + 1 < len(s) and e[j] - s[i] < least and e[j + 1] - s[i] <= most:
                j += 1
            if e[j] - s[i] >= least:
                rows.append((i, s[i], e[j], " ".join(pdf["text"].iloc[i : j + 1])))
            i = j + 1
        # Typed columns: a group may have no window.
        new = {START: np.array([r[1] for r in rows], s.dtype), END: np.array([r[2] for r in rows], e.dtype), "text": np.array([r[3] for r in rows], object)}
        return pd.DataFrame({c: new.get(c, pdf[c].to_numpy()[[0] * len(rows)]) for c in pdf.columns})

    return run


def fallback_windows(grouped: DataFrame, keys: list[str], most: int, target=40_000, least=16_000, longest=70_000, slack=1000) -> DataFrame:
    """Windows of whole segments inside pause groups (keys and group_idx), those nearest to the target length first and apart from each other.

    grouped: keys, group_idx, start_ms, end_ms, text. Adds score 1 / (1 + distance in seconds), in thousandths.
    """
    rows = grouped.select(*keys, "group_idx", START, END, "text").filter((F.trim("text") != "") & (F.col(END) > F.col(START)))
    wins = rows.groupBy(*keys, "group_idx").applyInPandas(_window_fold(target, least, longest), rows.schema)
    away = F.abs(F.col(END) - F.col(START) - target)
    wins = wins.withColumns({"_away": away, "score_milli": F.bround(1000 / (1 + away / 1000)).cast("long")})

    def keep(kept: list[tuple], c: dict, a: int, z: int) -> list[int]:
        taken = []
        for n in range(a, z):
            s, e = c[START][n], c[END][n]
            if len(kept) < most and apart(s, e, kept, slack):
                kept.append((s, e))
                taken.append(n)
        return taken

    return keep_in_order(wins, keys, ["_away", START, END], list, keep, [START, END]).drop("_away", "group_idx")


def apart(start, end, taken: list[tuple], slack) -> bool:
    return all(end <= s + slack or start >= e - slack for s, e in taken)


def fill_candidates(cands: DataFrame, fallback: DataFrame, keys: list[str], most: int, slack=1000) -> DataFrame:
    """The first `most` candidates in order; short of that fallbacks that overlap none, then fallbacks with unseen times. Both: keys, pos, start_ms, end_ms. A task holds the times taken."""
    both = cands.select(*keys, "pos", START, END, F.lit(0).alias("_kind"), F.lit(0).alias("_turn"))
    # Fallbacks have two turns: apart from all that is taken, then at any times not taken yet.
    extra = fallback.select(*keys, "pos", START, END, F.lit(1).alias("_kind"), F.explode(F.array(F.lit(1), F.lit(2))).alias("_turn"))

    def keep(taken: list[tuple], c: dict, a: int, z: int) -> list[int]:
        out = []
        for n in range(a, z):
            turn, row = c["_turn"][n], (c[START][n], c[END][n])
            if len(taken) < most and (turn == 0 or (apart(*row, taken, slack) if turn == 1 else row not in taken)):
                taken.append(row)
                out.append(n)
        return out

    kept = keep_in_order(both.unionByName(extra), keys, ["_turn", "pos"], list, keep, [START, END, "_turn"])
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("_turn", "pos")).cast("long")  # of at most `most` rows
    return kept.withColumn("rank", rank).drop("_turn").withColumnRenamed("_kind", "from_fallback")


def dedupe(cands: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One candidate per (start, end), the first in order."""
    return cands.withColumn("_n", F.row_number().over(W.partitionBy(*keys, START, END).orderBy(order))).filter("_n = 1").drop("_n")


def chunk_transcript(segments: DataFrame, keys: list[str], most_chars: int, overlap: int = 1) -> DataFrame:
    """segments in chunks by the length of their prompt lines: keys, chunk_idx, seg_idx; the last `overlap` of a chunk begin the next. A task holds these."""
    line = prompt_line()
    sized = segments.select(*keys, "seg_idx", (F.length(line) + 1).alias("_size"))

    def step(state: dict, r: tuple):
        n, size = r
        if state["tail"] is not None and most_chars > 0 and state["used"] + size > most_chars:
            state["chunk"] += 1
            state["tail"] = state["tail"][-overlap:] if overlap else []
            state["used"] = sum(x[1] for x in state["tail"])
            yield from ((x[0], state["chunk"]) for x in state["tail"])
        state["tail"] = [*(state["tail"] or []), r][-max(1, overlap) :]
        state["used"] += size
        yield n, state["chunk"]

    return fold_in_order(sized, keys, ["seg_idx"], lambda: {"chunk": 0, "used": 0, "tail": None}, step, lambda _: (), ["seg_idx", "_size"], f"seg_idx {dict(sized.dtypes)['seg_idx']}, chunk_idx long")


def prompt_line() -> Column:
    return F.concat(F.lit("["), seconds_to_timestamp(F.col(START) / 1000.0), F.lit(" - "), seconds_to_timestamp(F.col(END) / 1000.0), F.lit("] "), "text")


def render_prompts(chunks: DataFrame, segments: DataFrame, keys: list[str], template: str) -> DataFrame:
    """keys, chunk_idx, prompt: the template with {transcript} and {max_time} filled in."""
    rows = chunks.join(segments, [*keys, "seg_idx"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", prompt_line().alias("line")))), lambda x: x["line"]), "\n")
    agg = rows.groupBy(*keys, "chunk_idx").agg(text.alias("_t"), seconds_to_timestamp(F.max(END) / 1000.0).alias("_m"))
    return agg.select(*keys, "chunk_idx", F.replace(F.replace(F.lit(template), F.lit("{transcript}"), F.col("_t")), F.lit("{max_time}"), F.col("_m")).alias("prompt"))


def parse_llm_candidates(answers: DataFrame, segments: DataFrame, keys: list[str], least=16_000, most=70_000) -> DataFrame:
    """Answer texts to snapped, bounded and clamped candidates."""
    raw = extract_candidates(answers, [*keys, "answer_id"])
    ms = raw.select(*keys, "answer_id", "position", F.bround(F.col("start") * 1000).cast("long").alias(START), F.bround(F.col("end") * 1000).cast("long").alias(END), "score")
    ids = ["answer_id", "position"]
    return clamp_to_end(enforce_duration(snap(ms, segments, keys, ids), segments, keys, ids, least, most), segments, keys)


def best_first(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], top: int = 16) -> list[tuple[int, int]]:
    """One-to-one pairs of places by falling overlap, the earlier places first of equals. left and right: starts and ends.

    Every left interval has a list of its best `top` free partners, made anew when it runs out,
    and stands in a heap with the first of them; so what is held grows with the intervals, not
    with their pairs.
    """
    (s, e), (t, f) = left, right
    free = np.ones(len(t), bool)
    lists: dict[int, list[tuple[float, int]]] = {}
    heap: list[tuple[float, int, int]] = []

    def offer(a: int) -> None:
        """Puts a into the heap with its best free partner, if it has one."""
        while True:
            if not lists.get(a):
                if a in lists and len(lists[a]) == 0 and not more[a]:
                    return
                near = np.flatnonzero(free & (f > s[a]) & (t < e[a]))
                overlap = np.minimum(e[a], f[near]) - np.maximum(s[a], t[near])
                order = np.argsort(-overlap, kind="stable")[:top]
                lists[a] = [(overlap[k].item(), int(near[k])) for k in order[::-1]]
                more[a] = len(near) > top
                if not lists[a]:
                    return
            overlap, b = lists[a].pop()
            if free[b]:
                heapq.heappush(heap, (-overlap, a, b))
                return

    more: dict[int, bool] = {}
    for a in range(len(s)):
        offer(a)
    out = []
    while heap:
        _, a, b = heapq.heappop(heap)
        if free[b]:
            free[b] = False
            out.append((a, b))
        else:
            offer(a)
    return out


def greedy_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one pairs by falling overlap, larger positions first of equals: keys, i, j, overlap_ms, start_error_ms, end_error_ms, union_ms.

    left: keys, i, start_ms, end_ms; right: keys, j, r_start_ms, r_end_ms. The intervals of a key
    meet in a task; rows of pairs are made for matches only (see best_first).
    """
    kinds, other = dict(left.dtypes), dict(right.dtypes)
    rows = left.select(*keys, F.lit(0).alias("_side"), F.col("i").alias("_n"), F.col(START).alias("_a"), F.col(END).alias("_b"))
    rows = rows.unionByName(right.select(*keys, F.lit(1).alias("_side"), F.col("j").alias("_n"), F.col("r_start_ms").alias("_a"), F.col("r_end_ms").alias("_b"))).filter("_b > _a")

    def run(batches):
        for pdf in whole_runs(batches, keys):
            cut = runs_of(pdf, keys)
            side, n, a, b = (pdf[c].to_numpy() for c in ("_side", "_n", "_a", "_b"))
            at = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                half = lo + int(np.searchsorted(side[lo:hi], 1))  # rows are sorted by side, then position, the largest first
                at += [(lo + x, half + y) for x, y in best_first((a[lo:half], b[lo:half]), (a[half:hi], b[half:hi]))]
            x, y = np.array(at, np.int64).reshape(-1, 2).T
            head = pdf[keys].iloc[x].reset_index(drop=True)
            yield head.assign(i=n[x], j=n[y], overlap_ms=np.minimum(b[x], b[y]) - np.maximum(a[x], a[y]), start_error_ms=abs(a[x] - a[y]), end_error_ms=abs(b[x] - b[y]), union_ms=np.maximum(b[x], b[y]) - np.minimum(a[x], a[y]))

    ms = kinds[START]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"i {kinds['i']}", f"j {other['j']}", *(f"{c} {ms}" for c in ("overlap_ms", "start_error_ms", "end_error_ms", "union_ms"))])
    return dealt(rows, keys).sortWithinPartitions(*keys, "_side", F.desc("_n")).mapInPandas(run, schema)


def candidate_stats(cands: DataFrame, keys: list[str]) -> DataFrame:
    d = F.greatest(F.lit(0), F.col(END) - F.col(START))
    return cands.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(d).alias("total_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"))


def eval_models(cases: DataFrame, model: DataFrame, baseline: DataFrame, keys: list[str], baseline_model: str, close_ms: int = 5000) -> DataFrame:
    """Per case: status, counts, matched pairs, rates, mean IoU and errors, share of close pairs, coverage both ways.

    cases: keys, has_transcript, base_model (null: no baseline). model and baseline: keys, pos,
    start_ms, end_ms. A case without transcript, without baseline or with one of another model
    is not compared and has nulls; rates over nothing are 0.
    """
    status = F.when(~F.coalesce("has_transcript", F.lit(False)), "missing_transcript").when(F.col("base_model").isNull(), "missing_baseline").when(F.col("base_model") != baseline_model, "other_baseline").otherwise("ok")
    cases = cases.select(*keys, "base_model", status.alias("status"))
    ok = cases.filter("status = 'ok'").select(*keys)
    size = F.greatest(F.lit(0), F.col(END) - F.col(START))
    left, right = (x.join(ok, keys, "left_semi") for x in (baseline, model))
    b, m = (x.groupBy(*keys).agg(F.count("*").alias(f"n_{n}"), F.sum(size).alias(f"{n}_ms")) for x, n in ((left, "base"), (right, "model")))
    pairs = greedy_match(left.select(*keys, F.col("pos").alias("i"), START, END), right.select(*keys, F.col("pos").alias("j"), F.col(START).alias("r_start_ms"), F.col(END).alias("r_end_ms")), keys)
    close = F.count_if((F.col("start_error_ms") <= close_ms) & (F.col("end_error_ms") <= close_ms))
    agg = pairs.groupBy(*keys).agg(F.count("*").alias("matched"), F.sum("overlap_ms").alias("overlap_ms"), F.avg(F.col("overlap_ms") / F.col("union_ms")).alias("avg_iou"), F.avg("start_error_ms").alias("avg_start_error_ms"), F.avg("end_error_ms").alias("avg_end_error_ms"), close.alias("n_close"))
    rows = cases.join(b, keys, "left").join(m, keys, "left").join(agg, keys, "left")
    here = F.col("status") == "ok"
    known = lambda c, zero: F.when(here, F.coalesce(c, F.lit(zero)))
    rows = rows.withColumns({c: known(c, 0).cast("long") for c in ("n_base", "n_model", "base_ms", "model_ms", "matched", "overlap_ms", "n_close")} | {c: known(c, 0.0) for c in ("avg_iou", "avg_start_error_ms", "avg_end_error_ms")})
    share = lambda part, whole: F.when(here, F.coalesce(F.try_divide(part, whole), F.lit(0.0)))
    return rows.withColumns({"base_rate": share("matched", "n_base"), "model_rate": share("matched", "n_model"), "close_share": share("n_close", "matched"), "base_covered": share("overlap_ms", "base_ms"), "model_covered": share("overlap_ms", "model_ms")})


#: Columns of eval_models that eval_summary averages.
RATES = ("base_rate", "model_rate", "avg_iou", "avg_start_error_ms", "avg_end_error_ms", "close_share", "base_covered", "model_covered")


def eval_summary(cases: DataFrame) -> DataFrame:
    """One row: cases, those that are ok, and the average of each rate over these (0 for none)."""
    return cases.agg(F.count("*").alias("total_cases"), F.count_if(F.col("status") == "ok").alias("ok_cases"), *(F.coalesce(F.avg(F.when(F.col("status") == "ok", F.col(c))), F.lit(0.0)).alias(c) for c in RATES))


def union_chunk_candidates(chunks: list[DataFrame] | DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of all chunks of a transcript in one list: keys, pos (by chunk, then position), their times and score. Repeats from overlapping chunks stay; select_candidates takes them out."""
    rows = chunks if isinstance(chunks, DataFrame) else functools.reduce(DataFrame.unionByName, chunks)
    return rows.withColumn("pos", F.row_number().over(W.partitionBy(*keys).orderBy("chunk_idx", "position")) - 1)
