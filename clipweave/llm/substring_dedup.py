"""Substring dedup: removes every word covered by a window of `width` words that starts earlier elsewhere.

Three passes over the texts, none of which shuffles windows that occur once:

1. Count-min prefilter. Each task counts its window hashes in a sketch of two rows;
   sparse sketch blocks are merged by block, and a cell's "twice or more" bit is kept.
   A window that occurs twice always has both bits set, so none is lost; windows that
   only share cells pass as well. Cells grow with the corpus (at least two per window,
   up to MOST_CELLS a row, which bounds the bits to 2 * MOST_CELLS / 8 bytes; beyond
   that more windows pass and the result stays the same). The bits are a file that every
   executor gets once and its workers map.
2. Windows with both bits set are resolved exactly by a 128-bit hash. Inside a batch all
   but the first start of a window are covered at once; only the batch's first start of
   each window is shuffled, so a passage in a third of all documents sends one row per
   batch, and a window's rows go to one task in that number.
3. Covered ranges are joined to their documents, and the kept words are hashed.

Documents that are exact copies of an earlier one are found first by text hash (a narrow
aggregation) and take no part in 1 and 2: all their windows start earlier.

Order: doc_id (null first), then 31 bits of the text's hash; rows equal in both are one
document, judged once and returned for each row. Texts of any length are read whole; one
longer than UNIT is a unit of its own. Null and empty texts have no words. A document shorter
than `width` keeps all. Extra columns are ignored (kept by the pipeline's variant). An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_memory, give_back, hashed_words, in_pieces, materialize, mix, send_array, sent_array, split_words, texts_of, window_hashes

WIDTH = 20
#: Cells of a sketch row: a power of two, two per window or more, within these limits.
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 29
#: By which the number of windows is estimated.
BYTES_A_WORD = 6
#: Cells of a block, the unit in which sketches are merged.
BLOCK_BITS = 16
#: Bytes of text hashed at once, and window cells gathered before a task sends them: they bound a task's memory.
PIECE, MOST_GATHERED = 2 << 20, 4_000_000
#: Bytes of text in which a window's first start is found before rows are sent.
UNIT = 12 << 20
#: More exact copies than this are taken out by a shuffled join, not a broadcast one.
MOST_BROADCAST_ROWS = 1_000_000
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ALL = 1 << 30
#: In place of a second hash: the row is a range that its batch has settled. No hash has this value.
SETTLED = (1 << 64) - 1


def _cells(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(h ^ np.uint64(SEEDS[row])) & np.uint64(cells - 1)).astype(np.int64)


def _gaps(cells: np.ndarray) -> bytes:
    """Sorted cells as gaps of one byte; 255 stands for 255 more to come."""
    gap = np.diff(cells, prepend=0)
    out = np.full(int((gap // 255 + 1).sum()), 255, np.uint8)
    out[np.cumsum(gap // 255 + 1) - 1] = gap % 255
    return out.tobytes()


def _cells_of(gaps: bytes) -> np.ndarray:
    b = np.frombuffer(gaps, np.uint8)
    return np.cumsum(b, dtype=np.int64)[b != 255]


def _listed(gathered: list[np.ndarray], blocks: int, block_bits: int):
    """(block, gaps) of the cells gathered for a row of the sketch; takes them out of the list, as they are most of a task's memory."""
    c = np.concatenate(gathered)
    gathered.clear()
    c.sort()
    # A cell is listed once, or twice when it was counted more than once: counts saturate at two.
    third = np.zeros(len(c), bool)
    third[2:] = c[2:] == c[:-2]
    c = c[~third]
    cut = np.append(np.searchsorted(c, (np.arange(blocks) << block_bits).astype(np.uint32)), len(c))  # both of 32 bits, so that c is not copied
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield b, _gaps((c[cut[b] : cut[b + 1]] & np.uint32((1 << block_bits) - 1)).astype(np.int64))


def _hashes(texts, width: int):
    """(window hashes, second hashes, document index, word position) of all windows of the texts in a row."""
    w, counts = hashed_words(texts)
    total = len(w)
    if total < width:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z
    doc = np.repeat(np.arange(len(texts)), counts)
    pos = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    inside = np.flatnonzero(doc[: total - width + 1] == doc[width - 1 :])
    h1 = window_hashes(w, width, 0x9FB21C651E98DF25)[inside]
    h2 = window_hashes(mix(w + np.uint64(1)), width, 0xD6E8FEB86659FD93)[inside]
    h2[h2 == np.uint64(SETTLED)] = 0
    return h1, h2, doc[inside], pos[inside]


def _sketch(texts: DataFrame, cells: int, width: int):
    """Name of the array sent to the executors: bits of the cells counted twice or more, for both rows, from all windows of the texts."""
    blocks = max(1, cells >> BLOCK_BITS)
    block_bits = min(BLOCK_BITS, cells.bit_length() - 1)

    def send(parts: list[list[np.ndarray]]):
        rows = [(r, b, gaps) for r, gathered in enumerate(parts) for b, gaps in _listed(gathered, blocks, block_bits)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.binary())], names=["row", "block", "cells"])

    def count(batches):
        free_memory("substrings")
        parts, n = [[] for _ in SEEDS], 0
        for batch in batches:
            col = texts_of(batch.column(0))
            for a, z in in_pieces(col, PIECE):
                h = _hashes(col[a:z], width)[0]
                for r in range(len(SEEDS)):
                    parts[r].append(_cells(h, r, cells).astype(np.uint32))
                n += len(h)
                if n >= MOST_GATHERED:
                    yield send(parts)
                    parts, n = [[] for _ in SEEDS], 0
        if n:
            yield send(parts)
        parts = []
        give_back()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.zeros(1 << block_bits, np.int64)
        for i in range(0, len(pdf), 256):
            times += np.bincount(np.concatenate([_cells_of(b) for b in pdf["cells"].iloc[i : i + 256]]), minlength=1 << block_bits)
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "block": pdf["block"].iloc[:1], "bits": [np.packbits(times > 1).tobytes()]})

    merged = texts.mapInArrow(count, "row int, block int, cells binary").groupBy("row", "block").applyInPandas(merge, "row int, block int, bits binary")
    # At most 2 * MOST_CELLS / 8 bytes, whatever the corpus holds.
    size = (1 << block_bits) // 8
    bits = np.zeros((len(SEEDS), blocks * size), np.uint8)
    merged = materialize(merged, "sketch")
    step = max(1, blocks // 4)  # a quarter of a row at a time: rows on the driver stay small beside the bits
    for r in range(len(SEEDS)):
        for first in range(0, blocks, step):
            for x in merged.filter((F.col("row") == r) & F.col("block").between(first, first + step - 1)).collect():
                bits[r, x["block"] * size : (x["block"] + 1) * size] = np.frombuffer(x["bits"], np.uint8)
    return send_array(texts.sparkSession, bits, "bits")


def _units(batches):
    """The rows of the batches (text is the third column) in batches of about UNIT bytes: joined where small, cut where large."""
    held, size = [], 0
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(upto[start - 1]) if start else 0
            end = min(batch.num_rows, int(np.searchsorted(upto, before + UNIT - size, "right")) + 1)
            held.append(batch.slice(start, end - start))
            size += int(upto[end - 1]) - before
            start = end
            if size >= UNIT:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _merged_ranges(doc: np.ndarray, pos: np.ndarray, width: int):
    """Ranges [from, to) covered by windows at (doc, pos): arrays doc, from, to."""
    o = np.lexsort((pos, doc))
    doc, pos = doc[o], pos[o]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + width)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], pos[first], pos[last] + width


def text_mark():
    """31 bits of the text's hash: tells rows of one doc_id with different texts apart."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(1 << 31)).cast("int")


def covered_ranges(docs: DataFrame, width: int = WIDTH, cells: int | None = None) -> DataFrame:
    """Ranges of word positions to remove: doc_id, _cw_th (text hash), lo, hi; hi is exclusive and may pass the end."""
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_mark().alias("_cw_th"))
    texts = base.filter(F.length("text") > 2 * (width - 1))  # shorter ones have no window
    named = texts.select("doc_id", "_cw_th", F.md5(F.col("text").cast("binary")).alias("digest"))
    firsts = named.groupBy("digest").agg(F.min(F.struct("doc_id", "_cw_th")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first._cw_th") == F.col("_cw_th"))
    copies = materialize(named.join(firsts, "digest").filter(~same).select("doc_id", "_cw_th").distinct(), "copies")
    few = copies.count() <= MOST_BROADCAST_ROWS
    out = F.broadcast(copies) if few else copies
    on = [texts["doc_id"].eqNullSafe(out["doc_id"]), texts["_cw_th"] == out["_cw_th"]]
    single = texts.join(out, on, "left_anti")
    if cells is None:
        windows = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_A_WORD
        cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << max(1, 2 * windows).bit_length()))
    bits = _sketch(single.select("text"), cells, width)

    def passing(col, b):
        """Windows of the texts whose bits are all set: both hashes, document index, word position."""
        out = []
        for a, z in in_pieces(col, PIECE):
            h1, h2, doc, pos = _hashes(col[a:z], width)
            keep = np.ones(len(h1), bool)
            for r in range(len(SEEDS)):
                c = _cells(h1, r, cells)
                keep &= ((b[r][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1).astype(bool)
            out.append((h1[keep], h2[keep], (doc[keep] + a).astype(np.int32), pos[keep].astype(np.int32)))
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4

    def document_ranks(keys: list, ties: list) -> np.ndarray:
        """Place of each row in document order; rows equal in both have one place."""
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, ties[i]))
        rank, step = np.empty(len(keys), np.int64), 0
        for n, i in enumerate(order):
            if n and (keys[i], ties[i]) != (keys[order[n - 1]], ties[order[n - 1]]):
                step += 1
            rank[i] = step
        return rank

    def unit_rows(batch: pa.RecordBatch, b):
        """Rows of one unit: the first start of each window, and the ranges that the unit settles; None where no window passes."""
        ids, ths = batch.column(0), batch.column(1)
        h1, h2, doc, pos = passing(texts_of(batch.column(2)), b)
        if not len(h1):
            return None
        rank = document_ranks(ids.to_pylist(), ths.to_pylist())
        o = np.lexsort((pos, rank[doc], h2, h1))
        h1, h2, doc, pos = h1[o], h2[o], doc[o], pos[o]
        head = np.ones(len(h1), bool)
        head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = (rank[doc] != rank[doc[lead]]) | (pos != pos[lead])  # not the first start, nor that of a repeated row
        rd, rf, rt = _merged_ranges(doc[later], pos[later], width) if later.any() else (np.zeros(0, np.int32),) * 3
        hd, hp = doc[head], pos[head]
        take = pa.array(np.concatenate([hd, rd]))
        # A head is (h1; h2; text mark, lo); a settled range is (random bits, hi; SETTLED; text mark, lo).
        spread = mix(rd.astype(np.uint64) * np.uint64(1 << 32) + rf.astype(np.uint64) + np.uint64(1)) >> np.uint64(32) << np.uint64(32) | rt.astype(np.uint64)
        mark = np.asarray(ths.to_pylist(), np.uint64)[np.concatenate([hd, rd])] << np.uint64(32)
        second = np.concatenate([h2[head], np.full(len(rd), SETTLED, np.uint64)])
        place = mark | np.concatenate([hp, rf]).astype(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h1[head], spread]).view(np.int64)), pa.array(second.view(np.int64)), pa.array(place.view(np.int64)), ids.take(take)], names=["h1", "h2", "place", "doc_id"])

    def candidates(batches):
        free_memory("substrings")
        b = sent_array(bits)
        for batch in _units(batches):
            found = unit_rows(batch, b)
            if found is not None:
                yield found
        batch = found = None
        give_back()

    # Four longs a row: this is what the prefilter leaves to be shuffled.
    rows = single.select("doc_id", "_cw_th", "text").mapInArrow(candidates, "h1 long, h2 long, place long, doc_id long")
    by_window = W.partitionBy("h1", "h2")
    # In `place` of one window and document order is (text mark, lo) order.
    start, settled = F.struct("doc_id", "place"), F.col("h2") == -1  # SETTLED
    # Settled ranges go as they are; of the others the first start of each window stays.
    later = rows.withColumn("first", F.min(start).over(by_window)).filter(settled | ~F.col("first").eqNullSafe(start))
    lo = F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("lo")
    th = F.shiftrightunsigned("place", 32).cast("int").alias("_cw_th")
    later = later.select("h1", settled.alias("settled"), "doc_id", th, lo)
    settled = F.col("settled")
    hi = F.when(settled, F.col("h1").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).otherwise(F.col("lo") + width)
    later = later.select("doc_id", "_cw_th", "lo", hi.alias("hi"))
    whole = copies.select("doc_id", "_cw_th", F.lit(0).alias("lo"), F.lit(ALL).alias("hi"))
    return later.unionByName(whole)


def _keep(ranges, words: list[bytes], width: int) -> list[bytes]:
    """Words outside the ranges; a document of fewer than width words keeps all."""
    if not ranges or len(words) < width:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    lo, hi = (np.minimum([r[k] for r in ranges], len(words)) for k in ("lo", "hi"))
    np.add.at(cover, lo, 1)
    np.add.at(cover, hi, -1)
    kept = np.cumsum(cover[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def _with_ranges(docs: DataFrame, width: int, cells: int | None) -> DataFrame:
    """docs with _cw_ranges (null where nothing is removed).

    Only the texts of documents with ranges are shuffled; the others are told apart by the
    list of those documents, which is broadcast if its size allows it.
    """
    per_doc = covered_ranges(docs, width, cells).groupBy("doc_id", "_cw_th").agg(F.collect_list(F.struct("lo", "hi")).alias("_cw_ranges"))
    per_doc = materialize(per_doc.withColumnsRenamed({"doc_id": "_cw_doc", "_cw_th": "_cw_hash"}), "ranges")
    left = docs.withColumn("_cw_id", F.col("doc_id").cast("long")).withColumn("_cw_th", text_mark())
    same = F.col("_cw_id").eqNullSafe(F.col("_cw_doc")) & (F.col("_cw_th") == F.col("_cw_hash"))
    keys = per_doc.select("_cw_doc", "_cw_hash")
    if per_doc.count() > MOST_BROADCAST_ROWS:
        return left.join(per_doc, same, "left").drop("_cw_doc", "_cw_hash")
    hit = left.join(F.broadcast(keys), same, "left_semi").join(per_doc.hint("shuffle_merge"), same).drop("_cw_doc", "_cw_hash")
    rest = left.join(F.broadcast(keys), same, "left_anti").withColumn("_cw_ranges", F.lit(None).cast(per_doc.schema["_cw_ranges"].dataType))
    return hit.unionByName(rest)


def substring_dedup(docs: DataFrame, width: int = WIDTH, cells: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: the kept words joined by one space."""

    def run(batches):
        free_memory("substrings")
        for batch in batches:
            words = [split_words(t) for t in texts_of(batch.column(1))]
            kept = [_keep(r, w, width) for r, w in zip(batch.column(2).to_pylist(), words, strict=True)]
            n = np.fromiter(map(len, words), np.int64, len(words))
            k = np.fromiter(map(len, kept), np.int64, len(kept))
            text = pa.array([b" ".join(x) for x in kept], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(n - k), text], names=["doc_id", "n_words", "n_removed", "kept_text"])

    rows = _with_ranges(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), width, cells)
    return rows.select("doc_id", "text", "_cw_ranges").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(result: DataFrame) -> DataFrame:
    """kept_text as lowercase hex SHA-256."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def dedup_texts(docs: DataFrame, width: int = WIDTH, least_words: int = 1) -> DataFrame:
    """docs, all columns, with text replaced by its kept words where any were removed.

    A document that loses words and is left with fewer than least_words goes; n_chars,
    where present, is counted anew. Line breaks of shortened texts become spaces.
    """

    def run(batches):
        free_memory("substrings")
        for batch in batches:
            t, r = batch.column(0), batch.column(1)
            rows = list(zip(texts_of(t), r.to_pylist(), strict=True))
            new, left = [], []
            for text, ranges in rows:
                words = split_words(text) if ranges else []
                kept = _keep(ranges, words, width)
                cut = len(kept) < len(words)
                new.append(b" ".join(kept) if cut else text)
                left.append(not cut or len(kept) >= least_words)
            out = [pa.array(new, pa.binary()).cast(pa.string()), pa.array(left)]
            yield pa.RecordBatch.from_arrays(out + [batch.column(i) for i in range(2, batch.num_columns)], names=["text", "_cw_left", *batch.schema.names[2:]])

    columns = docs.columns
    rows = _with_ranges(docs, width, None).select("text", "_cw_ranges", *[c for c in columns if c != "text"])
    schema = ", ".join(["text string", "_cw_left boolean", *(f"`{c}` {t}" for c, t in rows.dtypes if c not in ("text", "_cw_ranges"))])
    out = rows.mapInArrow(run, schema).filter("_cw_left").drop("_cw_left")
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*columns)
