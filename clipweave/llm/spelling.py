"""Spelling variants: words one edit apart, found in tries over letter-group counts.

1. Runs of letters are counted; a task sends a word once for about MOST_HELD words it holds,
   with its number, so a frequent word moves as often as there are such loads, not as often
   as it occurs. Of a run of a document all occurrences are changed alike, so the checksum is
   taken once a document and run.
2. The letters, at most 90, are dealt to GROUPS groups of about even weight by their numbers
   in the vocabulary. A word's vector is its length and its letters in each group. An edit
   changes the vector by a surplus of one (insertion), a deficit of one (deletion), one of
   each or nothing (replacement).
3. The words are arranged in a trie by successive counts. Nodes of more than a cell's words
   are divided by the next count, and the undivided nodes below them are the cells, each a
   subtrie in one task. A word goes to its own cell and, by depth-first search through the
   divided nodes with a budget of one surplus and one deficit, to the cells where words one
   edit away can be: longer ones, and of the same length those that come later, so that each
   pair meets once.
4. In a cell, the trie of what came in is searched against the trie of its own words, depth
   first with the same budget, whole groups of words at a time. The words of leaves that
   remain are verified; large leaves are first matched by equal halves, which one edit leaves.
5. Each word's near words are counted and its form is chosen by partial aggregation; roots
   follow forms by pointer jumping, in a number of rounds that grows with the logarithm of the
   longest chain. A form has at least five times the number, so there are no circles.

A cell has at most CELL words, or 1 / MOST_DIVIDED of the vocabulary if that is more; the
divided nodes, which are broadcast, so are at most MOST_DIVIDED at each depth.

Null and empty texts have no words. A null doc_id counts as an empty one in the checksum. Rows
that repeat are counted each. Of near words of equal number the first in code-point order is
the form. Texts and runs of any length are taken whole. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_memory, materialize, texts_of, whole_groups

LEAST_LENGTH, LEAST_COUNT, RATIO, DROP_ONE_IN = 6, 5, 5, 199
GROUPS = 12
#: Words of a cell, and most divided nodes at a depth.
CELL, MOST_DIVIDED = 8_000, 20_000
#: Words that a task holds before it sends their numbers.
MOST_HELD = 300_000
#: Word pairs of two leaves from which on they are matched by halves first.
MANY = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Characters that are no letters here and not ASCII: all but U+00C0 to U+00FF, which begin with the byte C3.
_OTHER = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]*")


def runs_of(text: bytes) -> list[bytes]:
    """Maximal runs [A-Za-z\\u00C0-\\u00FF]+ with A-Z lower-cased."""
    return _OTHER.sub(b" ", text).translate(_LOWER).split()


def changed(run: bytes, seed: int) -> bytes:
    """run, or where 199 divides its checksum (begun with seed) run without one code point."""
    h = crc32(run, seed)
    if h % DROP_ONE_IN:
        return run
    points = run.decode()
    at = h % len(points)
    return (points[:at] + points[at + 1 :]).encode()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: words long and frequent enough."""

    def send(held: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        free_memory("spelling")
        held: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                seed = crc32(b"%d:" % i if i is not None else b":")
                for word, n in Counter(runs_of(text) if text else ()).items():
                    if len(word) < LEAST_LENGTH:  # bytes: fewer code points still
                        continue
                    held[changed(word, seed)] += n
                if len(held) >= MOST_HELD:
                    yield send(held)
                    held = Counter()
        if held:
            yield send(held)

    counts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return counts.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> dict[str, int]:
    """letter -> group; letters by falling number, dealt out there and back so that groups weigh about the same."""

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            found.update("".join(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["letter", "n"])

    rows = words.select("word").mapInArrow(run, "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    order = [r["letter"] for r in rows.orderBy(F.desc("n"), "letter").collect()]  # 90 at most
    there_and_back = [*range(groups), *reversed(range(groups))]
    return {c: there_and_back[i % (2 * groups)] for i, c in enumerate(order)}


def vector(word: str, group: dict[str, int], groups: int = GROUPS) -> tuple[int, ...]:
    counts = [0] * groups
    for c in word:
        counts[group[c]] += 1
    return (len(word), *counts)


#: (change of a count, surplus left, deficit left) that a budget (surplus, deficit) allows.
MOVES = {(s, d): tuple([(0, s, d), *[(1, 0, d)] * s, *[(-1, s, 0)] * d]) for s in (0, 1) for d in (0, 1)}
#: The same for the length: a longer word takes one surplus, one of the same length one of each or none.
FIRST_MOVES = ((1, 1, 0), (0, 1, 1))


def cells_reached(vec: tuple[int, ...], divided: set[tuple[int, ...]]):
    """Cells where words one edit away can be, longer or not before vec; with the own cell first."""
    own = ()
    while own in divided:
        own = vec[: len(own) + 1]
    yield own
    stack = [((), 0, 0, 0)]
    while stack:
        path, grown, surplus, deficit = stack.pop()
        depth = len(path)
        if path not in divided:
            if path != own and (grown or path > own):
                yield path
            continue
        options = FIRST_MOVES if depth == 0 else MOVES[surplus, deficit]
        for change, s, d in options:
            if vec[depth] + change >= 0:
                stack.append(((*path, vec[depth] + change), change if depth == 0 else grown, s, d))


def divided_nodes(words: DataFrame, group: dict[str, int], cell: int) -> set[tuple[int, ...]]:
    """Trie nodes above the cells: those of more than cell words, counted depth by depth until none is left."""

    def run(batches):
        for batch in batches:
            vectors = np.array([vector(w, group) for w in batch.column(0).to_pylist()], ">u4").reshape(-1, GROUPS + 1)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in vectors], pa.binary())], names=["vec"])

    total = words.count()
    if total <= cell:
        return set()
    found: set[tuple[int, ...]] = {()}
    vectors = words.select("word").mapInArrow(run, "vec binary")
    for depth in range(1, GROUPS + 1):
        crowded = vectors.groupBy(F.substring("vec", 1, 4 * depth).alias("path")).count().filter(F.col("count") > cell).collect()
        if not crowded:
            break
        found.update(tuple(np.frombuffer(r["path"], ">u4").tolist()) for r in crowded)
    return found


def _arranged(words: list[tuple[str, int]], vectors: list[tuple[int, ...]]) -> dict:
    """Trie of nested dicts by successive counts; leaves are lists of words."""
    root: dict = {}
    for word, vec in zip(words, vectors, strict=True):
        node = root
        for count in vec[:-1]:
            node = node.setdefault(count, {})
        node.setdefault(vec[-1], []).append(word)
    return root


def _one_edit(a: str, b: str) -> bool:
    """Whether b (as long, or longer by one) is a with one code point replaced or inserted."""
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(b) > len(a) else a[i + 1 :] == b[i + 1 :] and i < len(a)


def _near_in_leaves(left: list, right: list, longer: int):
    """Pairs of words of two leaves that are one edit apart; right words are longer by `longer`."""
    if len(left) * len(right) <= MANY:
        yield from ((a, b) for a, b in product(left, right) if _one_edit(a[0], b[0]))
        return
    # One edit leaves the half before or the half behind it as it was.
    half = len(left[0][0]) // 2
    heads, tails = defaultdict(list), defaultdict(list)
    for b in right:
        heads[b[0][:half]].append(b)
        tails[b[0][half + longer :]].append(b)
    for a in left:
        head = a[0][:half]
        yield from ((a, b) for b in heads[head] if _one_edit(a[0], b[0]))
        yield from ((a, b) for b in tails[a[0][half:]] if b[0][:half] != head and _one_edit(a[0], b[0]))


def near_pairs(seeking: list[tuple[str, int]], own: list[tuple[str, int]], group: dict[str, int]):
    """Pairs (a, b) of words one edit apart, a of those seeking, b of the own ones: b longer, or as long and later by vector or word."""
    left = _arranged(seeking, [vector(w, group) for w, _ in seeking])
    right = _arranged(own, [vector(w, group) for w, _ in own])
    stack = [(left[n], right[n + change], 1, s, d, change) for n in left for change, s, d in FIRST_MOVES if n + change in right]
    while stack:
        a, b, depth, surplus, deficit, longer = stack.pop()
        first = not longer and surplus and deficit  # nothing differs so far: the right vector must get the larger count first
        if depth > GROUPS:
            if first:  # one leaf: the words themselves decide which comes first
                yield from ((x, y) for x, y in _near_in_leaves(a, b, 0) if x[0] < y[0])
            elif not surplus and not deficit:
                yield from _near_in_leaves(a, b, longer)
            continue
        for n, child in a.items():
            for change, s, d in MOVES[surplus, deficit]:
                if (first and change < 0) or n + change not in b:
                    continue
                stack.append((child, b[n + change], depth + 1, s, d, longer))


def near_words(words: DataFrame, cell: int | None = None) -> DataFrame:
    """word, n_near, best (number and form of the most frequent near word, number negated): words with near words."""
    group = letter_groups(words)
    cell = max(CELL, words.count() // MOST_DIVIDED) if cell is None else cell
    divided = words.sparkSession.sparkContext.broadcast(divided_nodes(words, group, cell))

    def deal(batches):
        free_memory("spelling")
        nodes = divided.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                cells, own, at = [], [], []
                for i, word in enumerate(part.column(0).to_pylist()):
                    for k, path in enumerate(cells_reached(vector(word, group), nodes)):
                        cells.append(np.array(path, ">u4").tobytes())
                        own.append(k == 0)
                        at.append(i)
                rows = part.take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()), pa.array(own), rows.column(0), rows.column(1)], names=["cell", "own", "word", "n"])

    def search(batches):
        free_memory("spelling")
        for batch in whole_groups(batches, ["cell"]):
            cells, own = batch.column("cell").to_pylist(), batch.column("own").to_pylist()
            rows = list(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True))
            starts = [i for i in range(len(cells)) if i == 0 or cells[i] != cells[i - 1]]
            for a, z in zip(starts, [*starts[1:], len(cells)], strict=True):
                found: dict[str, list] = {}
                homes = [r for r, o in zip(rows[a:z], own[a:z], strict=True) if o]
                for x, y in near_pairs(rows[a:z], homes, group):
                    for (word, _), (other, n) in ((x, y), (y, x)):
                        best = found.setdefault(word, [0, 0, ""])
                        best[0] += 1
                        if (-n, other) < (best[1], best[2]) or best[0] == 1:
                            best[1:] = -n, other
                if found:
                    best = list(found.values())
                    yield pa.RecordBatch.from_arrays([pa.array(list(found)), *(pa.array([b[i] for b in best], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["word", "near", "less", "other"])

    dealt = words.mapInArrow(deal, "cell binary, own boolean, word string, n long").repartition("cell").sortWithinPartitions("cell")
    found = dealt.mapInArrow(search, "word string, near long, less long, other string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "other")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following form (word, form of forms) ends."""
    up = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("_cw_next"))
        if up.join(over, "root", "left_semi").isEmpty():
            return up
        up = materialize(up.join(over, "root", "left").select("word", F.coalesce("_cw_next", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, cell: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for every word."""
    words = materialize(word_counts(docs), "words")
    best = materialize(words.join(near_words(words, cell), "word", "left"), "near")
    isform = -F.col("best.less") >= RATIO * F.col("n")
    rows = best.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(isform, F.col("best.other")).alias("form"), F.when(isform, -F.col("best.less")).alias("form_n"))
    up = roots(rows.filter("form IS NOT NULL"))
    return rows.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
