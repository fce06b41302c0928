"""Script blocks to transcript windows."""

from __future__ import annotations

import difflib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import n_words, normalize_text, squeeze

#: Beginnings of words that mark an editor's remark; fixed values.
EDIT_MARKERS = ("вырез", "удали", "убер", "стоп", "перезапис")
#: Window starts scored at once: they bound a task's memory.
SLAB = 4096
#: Characters of a block and of a window that are compared.
COMPARED = 3000


def marked(text, markers=EDIT_MARKERS):
    """Whether a word of text begins with a marker."""
    return text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_])({'|'.join(markers)})")


def speech_text_filter(segments: DataFrame, markers=EDIT_MARKERS, short: int = 5) -> DataFrame:
    """Squeezed text, without empty segments and without short ones that hold an edit marker."""
    t = segments.withColumn("text", squeeze(F.col("text"))).filter("text <> ''")
    return t.filter(~(marked(F.col("text"), markers) & (n_words(F.col("text")) <= short)))


class Transcript:
    """One document's segments, with what the score of any window needs as arrays over (start, number of further segments)."""

    def __init__(self, starts, ends, texts: list[str], marks):
        self.n, self.texts = len(texts), texts
        self.starts, self.ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
        words = [t.split() for t in texts]
        self.mean_words = sum(map(len, words)) / max(1, self.n)
        self.upto = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.marks = np.concatenate([[0], np.cumsum(np.asarray(marks, bool))])
        # Positions of each word, and how far back the segment before that has it.
        self.places: dict[str, list[int]] = {}
        for at, ws in enumerate(words):
            for w in set(ws):
                self.places.setdefault(w, []).append(at)
        self.all = self._occurrences(self.places)

    def _occurrences(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(segment, distance to the word's segment before) of all occurrences of the words."""
        places = [self.places[w] for w in words if w in self.places]
        at = np.fromiter(itertools.chain.from_iterable(places), np.int64)
        gap = np.fromiter((b - a for p in places for a, b in zip([-self.n - 1, *p], p, strict=False)), np.int64)
        return at, gap

    def _distinct(self, occurrences, first: int, last: int, span: int) -> np.ndarray:
        """Of windows that start at first to last - 1: how many of the words occur in them, by number of further segments."""
        at, gap = occurrences
        out = np.zeros((last - first, span), np.int64)
        for d in range(span):  # a word counts where it is new: not in the d segments before
            new = at[gap > d] - d - first
            out[:, d] = np.bincount(new[(new >= 0) & (new < last - first)], minlength=last - first)
        return out.cumsum(1)

    def windows(self, goal: set[str], length: int, first: int, last: int, span: int, least_span: int, shortest_ms: int, longest_ms: int):
        """(bound, start, end, token score, has a mark) of the windows allowed; no score is above its bound."""
        own = self._occurrences(goal)
        for a in range(first, last, SLAB):
            z = min(last, a + SLAB)
            i, j = np.arange(a, z)[:, None], np.arange(a, z)[:, None] + np.arange(span)
            end = np.minimum(j, self.n - 1)
            lasts = self.ends[end] - self.starts[i]
            allowed = (j < self.n) & (np.arange(span) + 1 >= least_span) & (lasts >= shortest_ms) & (lasts <= longest_ms)
            both, size = self._distinct(own, a, z, span), self._distinct(self.all, a, z, span)
            token = np.where((size > 0) & bool(goal), 2.0 * both / np.maximum(1, len(goal) + size), 0.0)
            mark = self.marks[end + 1] > self.marks[i]
            other = np.minimum(COMPARED, self.upto[end + 1] - self.upto[i] - 1)
            most = np.where(length + other > 0, 2.0 * np.minimum(length, other) / np.maximum(1, length + other), 1.0)
            bound = np.maximum(0.0, 0.62 * token + 0.38 * most - 0.08 * mark) + 1e-12
            x, d = np.nonzero(allowed)
            yield bound[x, d], a + x, a + x + d, token[x, d], mark[x, d]

    def best_window(self, text: str, first: int, last: int, span: int, least_span: int, shortest_ms: int, longest_ms: int) -> tuple[float, int, int] | None:
        """(score, start, end) of the best window, the first of equals. Windows are tried by falling bound, so the slow ratio is taken only of those that can still win."""
        found = [np.concatenate(c) for c in zip(*self.windows(set(text.split()), min(len(text), COMPARED), first, last, span, least_span, shortest_ms, longest_ms), strict=True)]
        best = None
        for k in np.argsort(-found[0], kind="stable").tolist():
            bound, i, j, token, mark = (c[k] for c in found)
            if best and bound < best[0]:
                break
            match = difflib.SequenceMatcher(None, text[:COMPARED], " ".join(self.texts[i : j + 1])[:COMPARED])
            score = lambda ratio: max(0.0, 0.62 * token + 0.38 * ratio - 0.08 * mark)  # noqa: E731, B023
            if best and score(match.quick_ratio()) + 1e-12 < best[0]:
                continue
            now = (score(match.ratio()), int(i), int(j))
            if best is None or (-now[0], *now[1:]) < (-best[0], *best[1:]):
                best = now
        return best


def align_blocks(blocks: DataFrame, segments: DataFrame, key: str, most_segments: int = 90, shortest_ms: int = 6000, longest_ms: int = 140_000, markers=EDIT_MARKERS) -> DataFrame:
    """key, block_idx, start_ms, end_ms, score: a row for each block of a document that has segments.

    Blocks take windows of segments in order. A window's score is 0.62 token F1 + 0.38 sequence
    ratio, less 0.08 where a word of it begins with a marker, and not below 0; its length in
    segments follows from the block's words (a third of what is expected to four times and 8
    more, at most most_segments), a segment is left for every later block, and the first of equal
    windows is taken. A block without any window allowed takes the next few segments at score 0.
    Times never go back: a start before the end so far moves there, and an end not after its
    start is 3 s later.

    blocks: key, block_idx, text; segments: key, seg_idx, start_ms, end_ms, text. Texts are
    normalized here. A document's segments are in one task, as each block begins where the one
    before it ended; scores are computed for SLAB starts at once.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("seg_idx")
        t = Transcript(right["start_ms"], right["end_ms"], right["text"].tolist(), right["mark"])
        out, first, latest = [], 0, None
        rows = list(left.sort_values("block_idx").itertuples(index=False)) if t.n else []
        for k, row in enumerate(rows):
            expected = max(2, round(len(row.text.split()) / max(1.0, t.mean_words)))
            last = max(first, t.n - (len(rows) - k))
            best = t.best_window(row.text, first, min(last, t.n - 1) + 1, min(most_segments, expected * 4 + 8), max(1, expected // 3), shortest_ms, longest_ms)
            score, i, j = best or (0.0, first, min(t.n - 1, first + max(2, expected)))
            start, end = int(t.starts[i]), int(t.ends[j])
            start = start if latest is None else max(start, latest)
            latest = end if end > start else start + 3000
            out.append((getattr(row, key), row.block_idx, start, latest, score))
            first = min(j + 1, t.n - 1)
        kinds = {key: left[key].dtype, "block_idx": left["block_idx"].dtype, "start_ms": "int64", "end_ms": "int64", "score": "float64"}
        return pd.DataFrame(out, columns=list(kinds)).astype(kinds)  # there may be no row

    kind = dict(blocks.dtypes)
    text = normalize_text(F.coalesce(F.col("text"), F.lit("")))
    # New column identities: both sides may come from one table.
    mark = marked(F.coalesce(F.col("text"), F.lit("")), markers).alias("mark")
    segments = segments.select(*(F.col(c).alias(c) for c in (key, "seg_idx", "start_ms", "end_ms")), text.alias("text"), mark)
    blocks = blocks.select(*(F.col(c).alias(c) for c in (key, "block_idx")), text.alias("text"))
    return blocks.groupBy(key).cogroup(segments.groupBy(key)).applyInPandas(run, f"{key} {kind[key]}, block_idx {kind['block_idx']}, start_ms long, end_ms long, score double")
