"""Benchmark decontamination: Smith-Waterman alignment wherever a score can be reached.

A pair of a document and a test item is scored by Smith-Waterman over words (lower-cased,
marks at word ends dropped; match 2, mismatch -1, gap -1). The score is the best
alignment's value as a share of the item's own; a pair with a score of at least
`least_score` is a leak: exact copies have 1, a copy with every fifth word changed about 0.6.

What is not aligned cannot be a leak:

1. An item of L words with score s or more has need = s L matched words at least, in
   (3 - 2 s) L words of text at most. Of the item's L - need + k rarest words, wherever they
   stand in it, at least k are matched; so only places with k of these words so near each
   other are looked at (k = NEAR, or need where that is less).
2. There the value is at most that of the best run of text in which each word of the item
   counts 2 and each other word -1, and no more words are matched than item and text share.

How rare a word is is counted over all documents. It decides what is looked at and the time
it takes, never what is found.

What is broadcast follows the test items, not the documents: at most MOST_WORDS words,
checked; more items are done in rounds of that size. Nothing of a document is shuffled but
the counts of the items' words.

Texts of any length are searched whole, in halves that overlap by a whole alignment where
they have very many hits; of places with equal scores the first is returned. Null or empty
texts have no words. An item with fewer than WHOLE words leaks only where all
its words stand in a row. Repeated rows are judged alike; an item_id that stands in several
rows has the best of their scores. Null item_ids are skipped. Empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_memory

NEAR, WHOLE = 4, 4
MOST_HITS, BLOCK = 2_000_000, 1 << 18
#: Bytes of text whose words are looked up at once.
PIECE = 2 << 20
LEAST_SCORE = 0.5
MOST_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_MARKS = " \t\r\n.,;:!?\"'()[]{}<>*#%&$|-_/\\"


def normal(word: str) -> str:
    return word.strip(_MARKS).lower()


def item_words(text: str | None) -> list[str]:
    return [w for w in map(normal, (text or "").split()) if w]


class _Numbers(dict):
    """Word -> its number; 0 for a word of no item, -1 for marks alone. Starts anew when large."""

    def __init__(self, vocab: dict[str, int]):
        self.vocab = vocab

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        t = normal(word.decode("utf-8", "replace"))
        n = self[word] = self.vocab.get(t, 0) if t else -1
        return n


class Items:
    """Items as arrays of word numbers, from 1 up."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.vocab: dict[str, int] = {}
        self.ids, self.words = [], []
        for item, text in items:
            ws = item_words(text)
            if ws:
                self.ids.append(item)
                self.words.append(np.fromiter((self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws), np.int64, len(ws)))
        self.known = _Numbers(self.vocab)

    def numbers(self, text: bytes | None) -> np.ndarray:
        """Word numbers of a text; 0 for a word of no item, and nothing for words of marks alone."""
        words = (text or b"").split()
        a = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return a[a >= 0]

    def numbers_of(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """numbers() of many texts in a row, and their offsets. Words of ASCII alone are looked up as arrays."""
        split = pc.ascii_split_whitespace(texts)
        sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
        words = split.flatten()
        bare = pc.ascii_lower(pc.ascii_trim(words, _MARKS))
        found = pc.index_in(bare, value_set=pa.array(self.vocab, pa.string()))  # vocab is in the order of its numbers
        a = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        a[pc.equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)] = -1
        other = np.flatnonzero(~pc.string_is_ascii(words).to_numpy(zero_copy_only=False))
        if len(other):
            a[other] = np.fromiter(map(self.known.__getitem__, words.take(pa.array(other)).cast(pa.binary()).to_pylist()), np.int64, len(other))
        kept = a >= 0
        upto = np.concatenate([[0], np.cumsum(kept)])
        return a[kept], upto[np.concatenate([[0], np.cumsum(sizes)])]


class Finder:
    """Where in a text an item can have its least score."""

    def __init__(self, items: Items, times: np.ndarray, least_score: float, near: int = NEAR):
        """times: how often each word number occurs."""
        self.base = len(items.vocab) + 1
        own, self.times = np.unique(np.concatenate([i * self.base + w for i, w in enumerate(items.words)] or [np.zeros(0, np.int64)]), return_counts=True)
        self.own = own  # item * base + word
        self.sizes = sizes = np.fromiter(map(len, items.words), np.int64, len(items.words))
        self.least = np.where(sizes < WHOLE, max(1.0, least_score), least_score)
        self.need = need = np.maximum(1, np.ceil(self.least * sizes - 1e-9).astype(np.int64))
        self.near = np.minimum(near, need)
        self.span = np.maximum(need, np.floor((3 - 2 * self.least) * sizes + 1e-9).astype(np.int64))
        searched = np.maximum(0, sizes - need + self.near)
        searched[need > sizes] = 0
        pairs = [(w, i) for i, ws in enumerate(items.words) for w in np.unique(ws[np.argsort(times[ws], kind="stable")[: searched[i]]]).tolist()]
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.owners = pairs[:, 1].astype(np.min_scalar_type(len(sizes)))
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(items.vocab) + 2))
        self.many = np.diff(self.first)

    def places(self, numbers: np.ndarray, start: int = 0):
        """(item, first, last + 1) of ranges that hold whatever alignment has the least score."""
        many = self.many[numbers]
        at = np.flatnonzero(many)
        many = many[at]
        n = int(many.sum())
        if not n:
            return
        if n > MOST_HITS and len(numbers) > 4 * (most := int(self.span.max())):  # halves that overlap by a whole alignment
            half = len(numbers) // 2
            yield from self.places(numbers[: half + most], start)
            yield from self.places(numbers[half:], start + half)
            return
        within = np.arange(n) - np.repeat(np.cumsum(many) - many, many)
        owner = self.owners[np.repeat(self.first[numbers[at]], many) + within]
        order = np.argsort(owner, kind="stable")
        owner, place = owner[order].astype(np.int64), np.repeat(at, many)[order]
        last = np.arange(n) + self.near[owner] - 1
        ok = last < n
        last = np.minimum(last, n - 1)
        ok &= (owner[last] == owner) & (place[last] - place < self.span[owner])
        i = np.flatnonzero(ok)
        if not len(i):
            return
        owner, span = owner[i], self.span[owner[i]]
        begin, end = np.maximum(0, place[last[i]] - span + 1), np.minimum(len(numbers), place[i] + span)
        fresh = np.ones(len(i), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (begin[1:] > end[:-1])
        head = np.flatnonzero(fresh)
        owner, begin, end = owner[head], begin[head], end[np.append(head[1:], len(i)) - 1]
        block = np.cumsum(end - begin) // BLOCK
        for k in np.unique(block).tolist():
            o, a, z = owner[block == k], begin[block == k], end[block == k]
            for j in np.flatnonzero(self.possible(numbers, o, a, z)).tolist():
                yield int(o[j]), start + int(a[j]), start + int(z[j])

    def possible(self, numbers: np.ndarray, owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a range can have its item's least score, for all ranges at once."""
        sizes = end - begin + 1  # with a place before each, where the sum drops under all before
        starts = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(begin - 1 - starts, sizes)
        key = np.repeat(owner * self.base, sizes) + numbers[np.maximum(at, 0)]
        found = np.minimum(np.searchsorted(self.own, key), len(self.own) - 1)
        held = self.own[found] == key
        held[starts] = False
        value = np.where(held, MATCH, MISMATCH)
        value[starts] = -MATCH * len(at) - 1
        total = np.cumsum(value)
        best = np.maximum.reduceat(total - np.minimum.accumulate(total), starts)
        ok = best / (MATCH * self.sizes[owner]) >= self.least[owner]
        for j in np.flatnonzero(ok).tolist():
            here = slice(starts[j], starts[j] + sizes[j])
            words, n = np.unique(found[here][held[here]], return_counts=True)
            ok[j] = np.minimum(n, self.times[words]).sum() >= self.need[owner[j]]
        return ok


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman over word numbers: (value / value of a full match, first and last + 1 place in text).

    Row by row; the horizontal gap of a row, a running maximum, is taken for all columns at once.
    """
    n = len(text)
    best, where = 0, (0, 0)
    score, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    slope = -GAP * np.arange(n + 1)
    for w in item.tolist():
        diagonal = score[:-1] + np.where((text == w) & (text > 0), MATCH, MISMATCH)
        up = score[1:] + GAP
        row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
        row[1:] = np.maximum(np.maximum(diagonal, up), 0)
        begin[1:] = np.where(row[1:] == 0, begin[1:], np.where(diagonal >= up, start[:-1], start[1:]))
        lifted = row + slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        flat = top - slope
        begin = np.where(flat > row, begin[source], begin)
        row = np.maximum(row, flat)
        score, start = row, begin
        j = int(row.argmax())
        if row[j] > best:
            best, where = int(row[j]), (int(begin[j]), j)
    return best / (MATCH * len(item)), *where


def _pieces(texts: pa.StringArray):
    """Ranges of the texts of about PIECE bytes each."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cut = np.flatnonzero(np.diff(upto // PIECE, prepend=0)) + 1
    ends = [*cut.tolist(), len(texts)] if not len(cut) or cut[-1] < len(texts) else cut.tolist()
    return [(a, z) for a, z in zip([0, *ends], ends, strict=False) if a < z]


def _counts(docs: DataFrame, known) -> DataFrame:
    """word, n: how often each word of the items occurs in all documents. A task sums before it sends."""

    def run(batches):
        free_memory("decontam")
        items = known.value
        total = np.zeros(len(items.vocab) + 1, np.int64)
        for batch in batches:
            for a, z in _pieces(batch.column(0)):
                total += np.bincount(items.numbers_of(batch.column(0).slice(a, z - a))[0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["word", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def leaks(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score, start, end (words of the document that align) for every leak."""
    spark = docs.sparkSession
    rows = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    words = rows.select(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), " ")))).first()[0] or 0
    rounds = max(1, -(-int(words) // MOST_WORDS))
    found = None
    for r in range(rounds):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r).orderBy("item_id", "text").collect()
        items = Items([tuple(x) for x in part])
        known = spark.sparkContext.broadcast(items)
        times = np.zeros(len(items.vocab) + 1, np.int64)
        for x in _counts(docs, known).collect():  # at most MOST_WORDS rows
            times[x["word"]] = x["n"]
        one = _aligned(docs, known, spark.sparkContext.broadcast(Finder(items, times, least_score)))
        found = one if found is None else found.unionByName(one)
    return found


def _aligned(docs: DataFrame, known, finder) -> DataFrame:
    def run(batches):
        free_memory("decontam")
        items, find = known.value, finder.value
        for batch in batches:
            out = []
            for first, end in _pieces(batch.column(1)):
                row, offsets = items.numbers_of(batch.column(1).slice(first, end - first))
                for i in range(first, end):
                    numbers = row[offsets[i - first] : offsets[i - first + 1]]
                    best: dict[int, tuple[float, int, int]] = {}
                    for o, a, z in find.places(numbers):
                        s, x, y = align(items.words[o], numbers[a:z])
                        if s >= find.least[o] and s > best.get(items.ids[o], (0.0,))[0]:
                            best[items.ids[o]] = (s, a + x, a + y)
                    out += [(i, item, *v) for item, v in sorted(best.items())]
            ids = batch.column(0).take(pa.array([x[0] for x in out], pa.int64()))
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[1 + j] for x in out], t) for j, t in enumerate(kinds))], names=["doc_id", "item_id", "score", "start", "end"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, score double, start long, end long")
