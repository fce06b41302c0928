"""Audit of how five text filters interact, with duplicates found in radix tries.

Filters over the words [^\\x20\\x09-\\x0D]+ of a whole text: A under 50 words; B fewer than 65
distinct words in 100; C more than 5 characters [A-Z] in 100; D any of [#$%&*|]; E a text that
a smaller doc_id has as well, anywhere in the table.

1. Boundaries: texts are dealt out by ranges between text prefixes. A bounded sample of heads
   gives the quantiles; heads that many texts share are sampled again at 16 times their
   length, so a boundary is as long as the texts around it need and a common opening does
   not gather in one range.
2. One scan computes the masks of A to D. Of the equal texts of a batch only the row with the
   smallest doc_id sends its text; the others have failed E there and travel without it. So a
   text that a third of all rows hold costs one text a batch.
3. A task inserts the texts of one range into a compressed trie, whose terminals hold minimum
   ids, and then goes over its rows once more: a row whose id is above its terminal's fails E.
   A range holds about RANGE_BYTES of text.
4. Masks are counted by part with their labels, and everything asked of the 120 orders follows
   from the 32 counts of a part: after the filters of a set S, kept(S) is the number of
   documents that fail none of S.

Null or empty texts are empty texts: they fail A (and E if a smaller doc_id has one). Rows
that repeat a doc_id are documents of their own; equal ids are not smaller, so they fail E
only by another id. Rows without a doc_id count as documents, never fail E nor make others
fail, and have no labels. Labels of a repeated doc_id hold if any of them does. A null source
is the part ''. An empty table gives no rows. Extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, free_memory, materialize, split_words, texts_of

LETTERS = "ABCDE"
DUPLICATE = 16
#: Bytes of text in a range, and most ranges.
RANGE_BYTES, MOST_RANGES = 4 << 20, 50_000
#: Samples of heads: texts a range, first length of a head, how much longer each next sample's heads are, and bytes of all heads of a sample.
SAMPLE, HEAD, LONGER, MOST_SAMPLED = 40, 16, 16, 48 << 20

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_NOT_UPPER = bytes(b for b in range(256) if b not in _UPPER)
_CONTINUES = bytes(range(0x80, 0xC0))
_NOT_SYMBOL = bytes(b for b in range(256) if b not in b"#$%&*|")


def mask_of(text: bytes) -> int:
    """Bits of the filters A to D that the text fails."""
    words = split_words(text)
    points = len(text.translate(None, _CONTINUES))
    upper = len(text.translate(None, _NOT_UPPER))
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * upper > 5 * points) << 2 | bool(text.translate(None, _NOT_SYMBOL)) << 3


class Trie:
    """Compressed trie of byte strings; each terminal holds the smallest id inserted there."""

    def __init__(self):
        self.edges: list[dict[int, tuple[bytes, int]]] = [{}]
        self.least: list[int | None] = [None]

    def _new(self) -> int:
        self.edges.append({})
        self.least.append(None)
        return len(self.edges) - 1

    def insert(self, text: bytes, key: int) -> int:
        """The terminal of text, after key has been held against its minimum."""
        node, at = 0, 0
        while at < len(text):
            known = self.edges[node].get(text[at])
            if known is None:
                child = self._new()
                self.edges[node][text[at]] = (text[at:], child)
                node, at = child, len(text)
                break
            label, child = known
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            rest = text[at : at + len(label)]
            a, b = np.frombuffer(label[: len(rest)], np.uint8), np.frombuffer(rest, np.uint8)
            apart = np.flatnonzero(a != b)
            cut = int(apart[0]) if len(apart) else len(rest)
            middle = self._new()
            self.edges[node][text[at]] = (label[:cut], middle)
            self.edges[middle][label[cut]] = (label[cut:], child)
            node, at = middle, at + cut
        if self.least[node] is None or key < self.least[node]:
            self.least[node] = key
        return node


def prefix_boundaries(texts: DataFrame, ranges: int) -> list[bytes]:
    """About ranges - 1 sorted text prefixes that divide the texts (column text) evenly, as far as equal texts allow."""
    text, n = F.coalesce(F.col("text"), F.lit("")).cast("binary"), texts.count()
    found: set[bytes] = set()
    shared: list[bytes] = []
    length = HEAD
    while n and ranges > 1:
        rows = texts
        if shared:  # what the shorter heads could not divide
            rows = texts.withColumn("_cw_head", F.substring(text, 1, length // LONGER)).filter(F.col("_cw_head").isin(shared))
            n = rows.count()
        most = min(SAMPLE * ranges, MOST_SAMPLED // length)
        heads = sorted(rows.select(F.substring(text, 1, length)).sample(min(1.0, most / max(1, n)), 7).limit(2 * most).toArrow().column(0).to_pylist())
        step = max(1, len(heads) // ranges)
        quantiles = heads[step::step]
        found.update(quantiles)
        shared = sorted({h for h, later in zip(quantiles, quantiles[1:], strict=False) if h == later and len(h) == length})
        ranges = len([q for q in quantiles if q in set(shared)])
        length *= LONGER
        if not shared:
            break
    return sorted(found)


def masked_rows(docs: DataFrame, boundaries: list[bytes]) -> DataFrame:
    """range, doc_id, part, mask (A to D, and E where the batch shows it), text (null where the row has no more to show)."""
    shared = docs.sparkSession.sparkContext.broadcast(boundaries)

    def run(batches):
        free_memory("audit")
        cuts = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or b"" for t in texts_of(batch.column(1))]
            least: dict[bytes, int] = {}
            for i, t in zip(ids, texts, strict=True):
                if i is not None and i <= least.get(t, i):
                    least[t] = i
            known: dict[bytes, tuple[int, int]] = {}
            ranges, masks, sent = [], [], []
            for n, (i, t) in enumerate(zip(ids, texts, strict=True)):
                if t not in known:
                    known[t] = mask_of(t), bisect_right(cuts, t)
                mask, at = known[t]
                shown = i is None or i > least[t]
                masks.append(mask | DUPLICATE * (i is not None and shown))
                ranges.append(-1 - n % 1024 if shown else at)  # rows with nothing to show are dealt out evenly
                sent.append(None if shown else t)
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), batch.column(0), batch.column(2), pa.array(masks, pa.int32()), pa.array(sent, pa.binary())], names=["range", "doc_id", "part", "mask", "text"])

    return docs.mapInArrow(run, "range int, doc_id long, part string, mask int, text binary")


def failures(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, part, mask (a bit for each of the filters ABCDE that the document fails): a row for every row of docs."""
    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), part)
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(min(MOST_RANGES, max(1, size // range_bytes)))
    rows = masked_rows(base, prefix_boundaries(base.select("text"), ranges))

    def run(batches):
        free_memory("audit")
        names = ["doc_id", "part", "mask"]
        now, trie, held = -1, Trie(), []  # held: rows of this range without their texts, and their terminals

        def judged():
            for batch, ends in held:
                ids, mask = batch.column("doc_id").to_pylist(), batch.column("mask").to_pylist()
                mask = [m | DUPLICATE * (i > trie.least[end]) for m, i, end in zip(mask, ids, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(mask, pa.int32())], names=names)

        for batch in batches:
            at = batch.column("range").to_numpy()
            starts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else [0]
            for a, z in zip(starts[:-1], starts[1:], strict=True):
                rows = batch.slice(a, z - a)
                if at[a] < 0:
                    yield rows.select(names)
                    continue
                if at[a] != now:
                    yield from judged()
                    now, trie, held = at[a], Trie(), []
                ends = [trie.insert(t, i) for t, i in zip(rows.column("text").to_pylist(), rows.column("doc_id").to_pylist(), strict=True)]
                held.append((rows.select(names), ends))
        yield from judged()

    dealt = rows.repartition(max(ranges, 1), "range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, "doc_id long, part string, mask int")


def audit(docs: DataFrame, labels: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = failures(docs, range_bytes).join(few(materialize(marks, "marks")), "doc_id", "left")
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("all"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "all", "good", "toxic")).alias("c"))  # 32 at most

    def kept(field: str) -> str:
        """Expression: documents of each of the 32 filter sets that fail none of its filters, as an array."""
        return f"transform(sequence(0, 31), s -> aggregate(filter(c, x -> (x.mask & s) = 0), 0L, (a, x) -> a + x.{field}))"

    # How many of the 120 orders have exactly the filters of a set before a given other one: |S|! (4 - |S|)!.
    orders = "element_at(array(24L, 6L, 4L, 6L, 24L), bit_count(s) + 1)"
    parts = parts.selectExpr("part", "c", *(f"{kept(f)} AS k_{f}" for f in ("all", "good", "toxic")))
    steps = parts.withColumn("filter_order", F.explode(F.lit(["".join(p) for p in permutations(LETTERS)]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    bit = "1 << (instr('ABCDE', {}) - 1)"
    steps = steps.selectExpr("*", f"CAST({bit.format('substr(filter_order, step, 1)')} AS INT) AS f", f"aggregate(sequence(1, 5), 0, (a, i) -> IF(i < step, a | ({bit.format('substr(filter_order, i, 1)')}), a)) AS before")
    lost = lambda field, s: f"(k_{field}[{s}] - k_{field}[{s} | f])"
    return steps.selectExpr(
        "part",
        "filter_order",
        "step",
        "k_all[before | f] AS kept",
        f"{lost('all', 'before')} AS removed",
        f"k_all[0] - k_all[f] - {lost('all', 'before')} AS redundant",
        "aggregate(filter(c, x -> x.mask = f), 0L, (a, x) -> a + x.all) AS unique_fails",
        f"{lost('good', 'before')} AS good_lost",
        f"{lost('toxic', 'before')} AS toxic_lost",
        f"aggregate(sequence(0, 31), 0L, (a, s) -> IF((s & f) = 0, a + {orders} * {lost('all', 's')}, a)) AS shapley",
    )
