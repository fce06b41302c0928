"""Jaccard join of word n-gram sets by the size-aware heavy-light scheme.

1. Documents with equal sets are one vertex, named by their smallest doc_id; copies take no
   part in what follows.
2. Light: two sets of sizes s and t link exactly when they share c(s, t) elements. Sets below
   a boundary emit a key for every subset of each size c that a partner below the boundary
   can ask for; equal keys are links. Of a key only the pairs with its smallest set are made:
   what that set need not share with a member, no two members need share either, so the
   components stay the same.
3. Heavy: pairs with a set at or above the boundary meet in inverted lists. Elements are
   ordered by rarity (a sketch of all sets, then hash), and a set is listed under its rarest
   n - ceil(0.85 n) + 1 elements, which every linked pair has one of in common. Elements that
   the sketch counts once are in no other set and are not listed.
4. The boundary is the one of least cost: keys of the sets below it, plus, for the sets above,
   lists scanned times their mean length. Both come from counts of all sets.
5. Lists are scanned in turns, by a parity bitmap of each set: two bitmaps differ in at most
   as many bits as the sets differ in elements, so no link is lost. First every member is
   held against its list's smallest set, then, in TURNS turns, against a random one of another
   component; then members of different components against each
   other, in blocks of BLOCK members. Candidates are confirmed on their full sets, and
   components found after each turn, so a group of copies costs a star and not its square.

The sketch has a cell a window up to MOST_CELLS cells of four bits (64 MB, gathered on the
driver and broadcast); with more windows the order gets coarser and lists longer, the result
stays the same. What remains quadratic is the comparison (never rows, but for candidates that
nearly link) of a list whose members do not link with each other.

Null or empty texts have an empty set and link with nothing. Rows that repeat a doc_id share
its vertex: links of any of them count for all. Rows without a doc_id link with nothing and
have a null component. An empty table gives an empty result. Extra columns are ignored.
Texts of any length are hashed whole. Similarity equal to the threshold is a link; a
component is named by its smallest doc_id, so ties need no rule.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, free_memory, in_pieces, materialize, mix, texts_of, whole_groups
from .links import components, confirmed, shingle_sets

SHINGLE, PERCENT = 4, 85
#: Bits of a parity bitmap.
BITMAP = 1024
#: Cells of the sketch: a power of two, one a window or more, within these limits; cells of a block, the unit in which sketches are merged.
LEAST_CELLS, MOST_CELLS, BLOCK_BITS = 1 << 16, 1 << 27, 16
#: Sets of this size or more are always heavy: their subsets are too many.
MOST_LIGHT = 32
#: Shingles gathered before a task sends them, bytes of text hashed at once: they bound a task's memory.
MOST_GATHERED, PIECE = 3_000_000, 2 << 20
#: Turns in which the members of a list that holds several components are held against one of them.
TURNS = 2
#: Members of a list compared with each other in one task.
BLOCK = 2048
_SUBSET = 0xD6E8FEB86659FD93


def least_overlap(s: int, t: int, percent: int = PERCENT) -> int:
    """Elements that sets of sizes s and t must share to link."""
    return -(-percent * (s + t) // (100 + percent))


def partners(s: int, percent: int = PERCENT) -> range:
    """Sizes of the sets that one of size s can link with."""
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (-(-percent * n // 100)) + 1


def subset_sizes(s: int, boundary: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a set of size s emits for partners below the boundary."""
    return sorted({least_overlap(s, t, percent) for t in partners(s, percent) if t < boundary})


def boundary_of(sizes: dict[int, int], list_length: float, percent: int = PERCENT) -> int:
    """Size from which sets are heavy: sizes holds how many sets there are of each size below MOST_LIGHT."""

    def cost(b: int) -> float:
        light = sum(n * sum(comb(s, c) for c in subset_sizes(s, b, percent)) for s, n in sizes.items() if s < b)
        return light + sum(n * prefix_length(s, percent) * list_length for s, n in sizes.items() if s >= b)

    return min(range(1, MOST_LIGHT + 1), key=cost)


def subset_keys(elements: np.ndarray, c: int) -> np.ndarray:
    """A key for every subset of c elements: the sum of its hashes, which is that of all less that of those left out."""
    own = mix(elements)
    gone = len(own) - c
    total = own.sum(dtype=np.uint64)
    if gone == 0:
        sums = np.array([total], np.uint64)
    else:
        sums = total - own[np.array(list(combinations(range(len(own)), gone)))].sum(1, dtype=np.uint64)
    return mix(sums + np.uint64(c * _SUBSET & (1 << 64) - 1))


def bitmap(elements: np.ndarray) -> np.ndarray:
    """Parity of the elements in each of BITMAP cells: the bitmaps' difference is the bitmap of the sets' difference."""
    cell = (mix(elements + np.uint64(1)) % np.uint64(BITMAP)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=BITMAP) & 1 == 1)


def set_rows(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set), bits (its parity bitmap)."""

    def run(batches):
        free_memory("jaccard")
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, z in in_pieces(texts, PIECE):
                sets = shingle_sets(texts[a:z], k)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "n_shingles", "set_key", "bits"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bits binary")


def _cells(h: np.ndarray, cells: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0x9E3779B97F4A7C15)) & np.uint64(cells - 1)).astype(np.uint32)


def _gaps(cells: np.ndarray) -> bytes:
    """Sorted cells, repeats included, as gaps of one byte; 255 stands for 255 more to come."""
    gap = np.diff(cells.astype(np.int64), prepend=0)
    out = np.full(int((gap // 255 + 1).sum()), 255, np.uint8)
    out[np.cumsum(gap // 255 + 1) - 1] = gap % 255
    return out.tobytes()


def _cells_of(gaps: bytes) -> np.ndarray:
    b = np.frombuffer(gaps, np.uint8)
    return np.cumsum(b, dtype=np.int64)[b != 255]


def rarity(texts: DataFrame, k: int, cells: int):
    """(levels, mean list length): a broadcast of four bits a cell, steps of a count's logarithm, from all sets of the texts."""
    block_bits = min(BLOCK_BITS, cells.bit_length() - 1)
    blocks, size = cells >> block_bits, (1 << block_bits) // 2

    def send(gathered):
        c = np.sort(np.concatenate(gathered))
        cut = np.searchsorted(c, np.arange(1, blocks, dtype=np.uint64) << np.uint64(block_bits))
        parts = np.split(c & np.uint32((1 << block_bits) - 1), cut)
        some = [i for i, p in enumerate(parts) if len(p)]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_gaps(parts[i]) for i in some], pa.binary())], names=["block", "cells"])

    def count(batches):
        free_memory("jaccard")
        gathered, n = [], 0
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, z in in_pieces(texts, PIECE):
                gathered.append(_cells(np.concatenate(shingle_sets(texts[a:z], k)), cells))
                n += len(gathered[-1])
                if n >= MOST_GATHERED:
                    yield send(gathered)
                    gathered, n = [], 0
        if n:
            yield send(gathered)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.zeros(1 << block_bits, np.int64)
        for gaps in pdf["cells"]:
            times += np.bincount(_cells_of(gaps), minlength=1 << block_bits)
        level = np.minimum(15, 1.5 * np.log2(np.maximum(times, 1))).astype(np.uint8)
        squares = float((times.astype(float) ** 2).sum())
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "levels": [(level[::2] << 4 | level[1::2]).tobytes()], "total": [float(times.sum())], "squares": [squares]})

    merged = texts.mapInArrow(count, "block int, cells binary").groupBy("block").applyInPandas(merge, "block int, levels binary, total double, squares double")
    merged = materialize(merged, "rarity")
    total, squares = merged.agg(F.sum("total"), F.sum("squares")).first()
    levels = np.zeros(blocks * size, np.uint8)
    step = max(1, blocks // 4)  # a quarter at a time: at most MOST_CELLS / 2 bytes in all, whatever the corpus holds
    for first in range(0, blocks, step):
        for row in merged.filter(F.col("block").between(first, first + step - 1)).select("block", "levels").collect():
            levels[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["levels"], np.uint8)
    return texts.sparkSession.sparkContext.broadcast(levels), (squares / total if total else 1.0)


def level_of(levels: np.ndarray, h: np.ndarray) -> np.ndarray:
    c = _cells(h, len(levels) * 2)
    both = levels[c >> np.uint32(1)]
    return np.where(c & np.uint32(1), both & 15, both >> 4)


def keys_of(texts: DataFrame, levels, boundary: int, percent: int, k: int) -> DataFrame:
    """c, key, rep, n: subsets of c elements of the light sets, and with c = 0 the listed elements of all that a heavy set can link with."""

    def of_set(s: np.ndarray, table: np.ndarray):
        n = len(s)
        if n < boundary:
            for c in subset_sizes(n, boundary, percent):
                yield c, subset_keys(s, c)
        if n and partners(n, percent).stop > boundary:
            level = level_of(table, s)
            rare = np.argsort(level, kind="stable")[: prefix_length(n, percent)]
            yield 0, s[rare[level[rare] > 0]]

    def run(batches):
        free_memory("jaccard")
        table = levels.value
        for batch in batches:
            texts = texts_of(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, z in in_pieces(texts, PIECE):
                found = []
                for rep, s in zip(ids[a:z], shingle_sets(texts[a:z], k), strict=True):
                    found += [(c, keys, rep, len(s)) for c, keys in of_set(s, table) if len(keys)]
                if found:
                    many = [len(x[1]) for x in found]
                    column = lambda i, kind: pa.array(np.repeat(np.array([x[i] for x in found], kind), many))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([column(0, np.int32), pa.array(np.concatenate([x[1] for x in found]).view(np.int64)), column(2, np.int64), column(3, np.int64)], names=["c", "key", "rep", "n"])

    return texts.mapInArrow(run, "c int, key long, rep long, n long")


def most_unlike(s, t, percent: int):
    """Elements by which sets of these sizes may differ and still link."""
    return s + t + 2 * (-(percent * (s + t)) // (100 + percent))


def by_bitmap(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps do not rule a link out."""
    one = sets.select("rep", "n", "bits")
    both = pairs.join(one.withColumnsRenamed({"rep": "a", "n": "s", "bits": "x"}), "a").join(one.withColumnsRenamed({"rep": "b", "n": "t", "bits": "y"}), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s, t = (batch.column(c).to_numpy() for c in ("s", "t"))
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("x", "y"))
                unlike = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                yield batch.select(["a", "b"]).filter(pa.array(unlike <= most_unlike(s, t, percent)))

    return both.select("a", "b", "s", "t", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _pairs_of_small(starts: np.ndarray, m: int):
    """Row pairs of the groups of m rows that begin at starts, some at a time."""
    i, j = np.triu_indices(m, 1)
    step = max(1, (1 << 18) // len(i))
    for x in range(0, len(starts), step):
        at = starts[x : x + step, None]
        yield (at + i).ravel(), (at + j).ravel()


def _pairs_of_block(left: np.ndarray, right: np.ndarray):
    step = max(1, (1 << 18) // max(1, len(right)))
    for x in range(0, len(left), step):
        yield np.repeat(left[x : x + step], len(right)), np.tile(right, len(left[x : x + step]))


def across(dealt: DataFrame, percent: int) -> DataFrame:
    """a, b: members of different components of a block (key, lo, hi) whose bitmaps do not rule a link out."""
    group = ["key", "lo", "hi"]

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, lo, hi, rep, comp, n, part = (batch.column(c).to_numpy() for c in (*group, "rep", "comp", "n", "part"))
        bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(len(rep), -1)
        new = np.ones(len(rep), bool)
        new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(rep)))
        small = (lo[starts] == hi[starts]) & (sizes <= 256)
        runs = [_pairs_of_small(starts[small & (sizes == m)], m) for m in np.unique(sizes[small]).tolist() if m > 1]
        for a, m in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
            rows = np.arange(a, a + m)
            runs.append(_pairs_of_block(rows[part[rows] == lo[a]], rows[part[rows] == hi[a]]))
        found = [np.zeros((2, 0), np.int64)]
        for u, v in (pair for run in runs for pair in run):
            apart = comp[u] != comp[v]
            u, v = u[apart], v[apart]
            near = np.bitwise_count(bits[u] ^ bits[v]).sum(1, dtype=np.int64) <= most_unlike(n[u], n[v], percent)
            u, v = rep[u[near]], rep[v[near]]
            found.append(np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1))
        a, b = np.unique(np.concatenate(found, 1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        free_memory("jaccard")
        for batch in whole_groups(batches, group):
            yield solve(batch)

    dealt = dealt.select(*group, "rep", "comp", "n", "part", "bits").repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def with_components(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with comp, the component of rep by the links."""
    label = components(links).withColumnsRenamed({"v": "rep", "c": "comp"})
    return materialize(rows.join(label, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "at")


def members_of(keys: DataFrame) -> DataFrame:
    """keys that several sets have, with the smallest set of each (led) and their number (many)."""
    lists = keys.groupBy("c", "key").agg(F.min(F.struct("n", "rep")).alias("led"), F.count("*").alias("many")).filter("many > 1")
    return materialize(keys.join(lists, ["c", "key"]), "members")


def star(rows: DataFrame, sets: DataFrame, docs: DataFrame, percent: int, k: int, allowed) -> DataFrame:
    """Links of members with the leader of their list."""
    fits = (F.col("n") * 100 >= F.col("led.n") * percent) & (F.col("n") * percent <= F.col("led.n") * 100)
    ends = F.least("rep", "led.rep").alias("a"), F.greatest("rep", "led.rep").alias("b")
    pairs = rows.filter(fits & (F.col("rep") != F.col("led.rep"))).select(*ends).distinct()
    return confirmed(materialize(allowed(by_bitmap(pairs, sets, percent)), "star"), docs, percent, k)


def mixed(rows: DataFrame, turn: int = 0) -> DataFrame:
    """Lists with members of several components, and a leader for this turn, another one in each list."""
    lead = F.min(F.struct(F.xxhash64("rep", "key", F.lit(turn)).alias("order"), "n", "rep", "comp")).alias("led")
    return rows.groupBy("key").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), lead).filter("p < q").select("key", "led")


def links_in_lists(members: DataFrame, sets: DataFrame, links: DataFrame, docs: DataFrame, percent: int, k: int, allowed) -> DataFrame:
    """links and those that join further components, between members of one inverted list."""
    at = with_components(members.filter("c = 0").select("key", "rep", "n", "many"), links)
    for turn in range(TURNS):
        links = materialize(links.union(star(at.join(mixed(at, turn), "key").filter("comp <> led.comp"), sets, docs, percent, k, allowed)), "links")
        at = with_components(at.drop("comp"), links)
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    dealt = at.join(mixed(at), "key", "left_semi").join(sets, ["rep", "n"]).withColumn("part", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"lo": F.least("part", "with"), "hi": F.greatest("part", "with")})
    rest = confirmed(materialize(allowed(across(dealt, percent)), "rest"), docs, percent, k)
    return links.union(rest)


def cells_for(sets: DataFrame) -> int:
    windows = sets.agg(F.sum("n")).first()[0] or 0
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << windows.bit_length()))


def links_across(texts: DataFrame, sets: DataFrame, links: DataFrame, docs: DataFrame, percent: int, k: int, allowed) -> DataFrame:
    """links and those that join further components among the documents of texts, all taken as heavy. sets: rep, n, bits of their texts; allowed filters candidate pairs (a, b)."""
    levels, _ = rarity(texts.select("text"), k, cells_for(sets))
    keys = materialize(keys_of(texts.select("doc_id", "text"), levels, 1, percent, k), "keys")
    levels.unpersist()
    return links_in_lists(members_of(keys), sets, links, docs, percent, k, allowed)


def jaccard_components(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, boundary: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; without a boundary the cheapest is taken."""
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = materialize(set_rows(base, k), "sets")
    linkable = sets.filter("doc_id IS NOT NULL AND n_shingles > 0")
    copied = linkable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("many")).filter("many > 1").drop("many")
    own = linkable.join(materialize(copied, "copied"), "set_key", "left").withColumn("rep", F.coalesce("rep", "doc_id")).withColumnRenamed("n_shingles", "n")
    reps = materialize(own.filter("doc_id = rep").select("rep", "n", "bits").dropDuplicates(["rep", "n", "bits"]), "reps")
    firsts = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("doc_id", "a")
    same = own.join(firsts, "doc_id").select("a", F.col("rep").alias("b")).filter("a < b")  # texts of one doc_id
    copies = own.filter("doc_id <> rep").select("doc_id").join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    single = base.filter("doc_id IS NOT NULL").join(few(materialize(copies.distinct(), "copies")), "doc_id", "left_anti")

    levels, length = rarity(single.select("text"), k, cells_for(reps))
    if boundary is None:
        boundary = boundary_of(dict(reps.filter(F.col("n") < MOST_LIGHT).groupBy("n").count().collect()), length, percent)
    keys = materialize(keys_of(single.select("doc_id", "text"), levels, boundary, percent, k), "keys")
    levels.unpersist()
    members, all_ = members_of(keys), lambda pairs: pairs
    links = materialize(same.distinct().union(star(members, reps, base, percent, k, all_)), "links")
    # Subsets have found their links; in the lists other leaders have their turns.
    label = components(links_in_lists(members, reps, links, base, percent, k, all_))

    rows = own.select("doc_id", F.col("n").alias("n_shingles"), "rep").join(label.withColumnsRenamed({"v": "rep", "c": "component_id"}), "rep", "left")
    rows = rows.select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    return rows.unionByName(sets.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
