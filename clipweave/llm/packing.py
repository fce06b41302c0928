"""Best-fit packing of token sequences by the sum-of-squares rule.

A piece goes to the open bin (sequence) after which the squared counts of open bins
per residual gap sum to the least; a new bin is opened when no open bin has room.
Pieces are taken longest first. Placement needs lengths only, so Spark deals pieces
to groups of bounded size, each group is packed by itself, and the sequences that
stay poorly filled are dissolved and packed again with those of other groups until
one group holds what is left: no task ever holds more than GROUP pieces.

Null or empty texts are documents of the one end id. Rows that repeat a doc_id are
packed like any others. A text of any length is tokenized whole and cut into pieces. An empty table gives an empty result; extra columns of the
input are ignored. Ties between gaps go to the smallest gap, between pieces to the
smaller (doc_id, piece).
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, materialize, texts_of
from .tokenizer import encoder

#: Words that a worker's encoder keeps: in the pipeline the workers stand beside a grown JVM.
MOST_WORDS = 500_000
CAPACITY = 2048
#: Pieces that one task packs at once.
GROUP = 60_000
#: A sequence with more free tokens than this is packed anew with other groups'.
LOOSE = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares_pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, given in the order of placement; 1 <= length <= capacity."""
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    # m[g] is 2 * (open bins with gap g) + 1, and 0 for a full bin: the change of the sum of
    # squares from moving a bin of gap g to gap g - s is then m[g - s] - m[g] + 2.
    m = np.ones(capacity + 1, np.int64)
    m[0] = 0
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    never, opened = np.int64(1) << 60, 0
    for i in range(n):
        s = int(lengths[i])
        room = m[s:capacity]
        change = np.where(room > 1, m[: capacity - s] - room + 2, never)
        j = int(change.argmin()) if s < capacity else 0
        if s < capacity and change[j] < never:
            gap = s + j
            b = by_gap[gap].pop()
            m[gap] -= 2
        else:
            gap, b, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            by_gap[gap - s].append(b)
            m[gap - s] += 2
    return bins, offsets


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of at most capacity ids of each document: doc_id, piece, start, length, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        code = encoder(tokenizer_path, MOST_WORDS)
        for batch in batches:
            texts, ids_of = texts_of(batch.column(1)), batch.column(0)
            for a, z in in_pieces(texts, 2 << 20):
                ids, off = code.encode(texts[a:z], end_id)
                size = np.diff(off)
                parts = -(-size // capacity)
                doc = np.repeat(np.arange(z - a), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                first = off[:-1][doc] + start
                raw = ids.astype("<u4").data.cast("B")
                crc = np.fromiter((zlib.crc32(raw[4 * f : 4 * (f + k)]) for f, k in zip(first.tolist(), length.tolist(), strict=True)), np.int64, len(doc))
                yield pa.RecordBatch.from_arrays([ids_of.slice(a, z - a).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def _pack_group(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = sum_of_squares_pack(pdf["length"].to_numpy(), capacity)
        free = capacity - np.bincount(bins, weights=pdf["length"].to_numpy()).astype(np.int64)
        return pdf.assign(bin=bins, offset=offsets, free=free[bins])

    return run


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, loose: int = LOOSE) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset.

    Rounds: deal pieces by hash to groups of about `group` rows, pack each, keep the
    sequences with at most `loose` free tokens, and go on with the pieces of the others
    until they fit one group. The last round keeps all. The number of rounds is about
    log(rows / group); each moves only what the round before left loose.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    left, done, n_before, turn, base = pieces, None, None, 0, 0
    while True:
        n = left.count()
        groups = max(1, -(-n // group))
        last = groups == 1 or (n_before is not None and n > 0.8 * n_before)
        seed = F.xxhash64("doc_id", "piece", "start", F.lit(turn))
        dealt = left.withColumn("_cw_group", F.pmod(seed, F.lit(groups)).cast("int"))
        schema = ", ".join(f"{c} {t}" for c, t in dealt.dtypes) + ", bin long, offset long, free long"
        packed = dealt.groupBy("_cw_group").applyInPandas(_pack_group(capacity), schema)
        packed = packed.withColumn("sequence_id", F.lit(base) + F.col("_cw_group").cast("long") * F.lit(2 * group + (1 << 20)) + F.col("bin"))
        packed = materialize(packed, f"packed{turn}") if not last else packed
        kept = packed if last else packed.filter(F.col("free") <= loose)
        kept = kept.select(*columns, "sequence_id", "offset")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        left = packed.filter(F.col("free") > loose).select(*columns)
        base += groups * (2 * group + (1 << 20))
        n_before, turn = n, turn + 1


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Tokenizes documents once, then packs their pieces by length."""
    pieces = materialize(tokenized_pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    return best_fit_pack(pieces, capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids array<int>, doc_ids array<long>.

    Joins each piece's ids to its place and puts the pieces of one sequence, at most
    capacity ids, in a row.
    """

    def run(batches):
        code = encoder(tokenizer_path, MOST_WORDS)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, z in in_pieces(texts, 2 << 20):
                ids, off = code.encode(texts[a:z], end_id)
                rows = [(k, q, ids[s : min(s + capacity, e)].astype(np.int32)) for k, (s0, e) in enumerate(zip(off[:-1], off[1:], strict=True)) for q, s in enumerate(range(s0, e, capacity))]
                doc = batch.column(0).slice(a, z - a).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([doc, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "piece", "ids"])

    ids = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, ids array<int>")
    rows = placed.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return rows.groupBy("sequence_id").agg(ordered.alias("_cw_parts")).select(
        "sequence_id", F.flatten(F.transform("_cw_parts", lambda p: p["ids"])).alias("ids"), F.transform("_cw_parts", lambda p: p["doc_id"]).alias("doc_ids")
    )
