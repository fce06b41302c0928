"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks; a chunk is named
by the BLAKE2b-128 digest of its bytes and stored once, however many documents hold
it. A document's recipe is its list of chunk names with their Merkle root. Layout:

  <path>/chunks    Parquet: chunk_id binary(16), ids binary (little-endian unsigned 16
                   or 32 bit), unique
  <path>/recipes   Parquet, ascending doc_id: doc_id, place (running number), start,
                   n_tokens, chunk_ids, root
  <path>/coded     what tasks wrote first: recipes, and chunks once per task
  <path>/manifest  Parquet, a Merkle tree over all recipes in order: level, node, documents,
                   root. A leaf binds place, doc_id, start, n_tokens and root of a recipe;
                   a node of level 0 is the root of FAN leaves, a node of the next level
                   that of FAN nodes, up to the one node of the last level

Start is the exclusive running sum of n_tokens over doc_id order: Spark range-sorts
the recipes, sums each part, and adds the sums of the parts before (one row per part).
Only chunk bytes that a task has not seen yet are written and shuffled.

Null or empty texts are documents of the end id alone. Rows that repeat a doc_id, and rows
without one (first), stay rows of their own, ordered by recipe root; rows equal in both are
equal. A text may be of any length; its ids are in one task's memory. Ids over 65,535 raise
an error unless the store is wide. An empty table writes an empty store. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_pieces, materialize, texts_of
from .tokenizer import encoder

#: A cut follows an id whose rolling hash ends in CUT_BITS zero bits; chunks have LEAST to MOST ids.
CUT_BITS, LEAST, MOST, SPAN = 9, 128, 2048, 8
#: Children of a manifest node.
FAN = 4096


def cut_points(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks in the concatenated streams: content-defined inside a document, and each document's end.

    The hash covers the last SPAN ids (a power of two), and no cut is made where these
    reach into the document before, so that equal passages are cut alike wherever they stand. A cut less than LEAST ids after the
    last one is skipped; a run of MOST ids without a cut is cut there.
    """
    roll = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    roll ^= roll >> np.uint32(15)
    reach = 1
    while reach < SPAN:  # a hash of 2n ids from two of n ids
        if len(roll) > reach:
            roll[reach:] = roll[reach:] + roll[:-reach] * np.uint32(pow(0x85EBCA6B, reach, 1 << 32) | 1)
        reach *= 2
    marks = np.flatnonzero(roll * np.uint32(0xC2B2AE35) >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends: list[int] = []
    lo = np.searchsorted(marks, offsets[:-1], "right")
    hi = np.searchsorted(marks, offsets[1:], "left")
    marks_l = marks.tolist()
    for a, z, i, k in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lo.tolist(), hi.tolist(), strict=True):
        at = a
        for m in marks_l[i:k]:
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST and m - a >= SPAN and z - m >= 1:
                at = m
                ends.append(at)
        while z - at > MOST:
            at += MOST
            ends.append(at)
        if z > at:
            ends.append(z)
    return np.asarray(ends, np.int64)


def merkle_root(names: list[bytes]) -> bytes:
    """Root of a binary hash tree over names; an odd last node moves up unchanged; no names: the digest of nothing."""
    level = list(names) or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


CODED = "doc_id long, n_tokens long, chunk_ids array<binary>, root binary, new array<struct<chunk_id: binary, ids: binary>>"
#: Chunk names that a task remembers, so as not to send a chunk again.
MOST_SEEN = 300_000


def coded(docs: DataFrame, tokenizer_path: str, end_id: int, wide: bool = False) -> DataFrame:
    """A row per document: its recipe, and the chunks that its task had not met before."""
    unit = "<u4" if wide else "<u2"
    w = np.dtype(unit).itemsize
    kind = pa.list_(pa.struct([("chunk_id", pa.binary()), ("ids", pa.binary())]))

    def run(batches):
        code, seen = encoder(tokenizer_path), set()
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, z in in_pieces(texts, 2 << 20):
                ids, off = code.encode(texts[a:z], end_id)
                if not wide and len(ids) and int(ids.max()) > 0xFFFF:
                    raise ValueError("ids over 65,535 need a wide store")
                ends = cut_points(ids, off)
                raw, at, names, new = ids.astype(unit).tobytes(), 0, [], []
                if len(seen) > MOST_SEEN:
                    seen = set()
                per_doc = np.searchsorted(ends, off[1:], "right") - np.searchsorted(ends, off[:-1], "right")
                cuts = iter(ends.tolist())
                for k in per_doc.tolist():
                    mine, fresh = [], []
                    for _ in range(k):
                        e = next(cuts)
                        piece, at = raw[w * at : w * e], e
                        name = hashlib.blake2b(piece, digest_size=16).digest()
                        mine.append(name)
                        if name not in seen:
                            seen.add(name)
                            fresh.append({"chunk_id": name, "ids": piece})
                    names.append(mine)
                    new.append(fresh)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, z - a), pa.array(np.diff(off), pa.int64()), pa.array(names, pa.list_(pa.binary())), pa.array([merkle_root(x) for x in names], pa.binary()), pa.array(new, kind)], names=["doc_id", "n_tokens", "chunk_ids", "root", "new"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, CODED)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, wide: bool = False) -> None:
    """Writes chunks, recipes and manifest of docs under path. wide: 32-bit ids (for vocabularies over 65,536)."""

    def once(batches):
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for i, n in enumerate(batch.column(0).to_pylist()):
                if n not in seen:
                    seen.add(n)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    coded(docs, tokenizer_path, end_id, wide).write.option("compression", "zstd").parquet(f"{path}/coded")
    plain = docs.sparkSession.read.parquet(f"{path}/coded")
    chunks = plain.select(F.explode("new").alias("c")).select("c.chunk_id", "c.ids")
    chunks.repartition("chunk_id").mapInArrow(once, "chunk_id binary, ids binary").write.option("compression", "zstd").parquet(f"{path}/chunks")

    plain = plain.drop("new")
    ordered = plain.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root").withColumn("part", F.spark_partition_id())
    ordered = materialize(ordered, "ordered")
    sums = ordered.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))  # a row per part
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("tokens", "rows")))
    inside = W.partitionBy("part").orderBy("doc_id", "root")
    placed = ordered.join(F.broadcast(before), "part")
    placed = placed.withColumns({"start": F.col("tokens_before") + F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "place": F.col("rows_before") + F.row_number().over(inside) - 1})
    placed.select("doc_id", "place", "start", "n_tokens", "chunk_ids", "root").write.parquet(f"{path}/recipes")
    spark = docs.sparkSession
    manifest(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def manifest(recipes: DataFrame) -> DataFrame:
    """level, node, documents, root of the Merkle tree over the recipes. FAN rows at most are a group."""

    def leaves(batches):
        for batch in batches:
            fields = [batch.column(i).to_pylist() for i in range(5)]
            digests = [hashlib.blake2b(b"%d,%s,%d,%d," % (p, b"" if d is None else b"%d" % d, s, n) + r, digest_size=16).digest() for p, d, s, n, r in zip(*fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], names=["place", "root"])

    def roots(batches):
        for batch in batches:
            found = [merkle_root([c["root"] for c in sorted(children, key=lambda c: c["place"])]) for children in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["node", "documents", "root"])

    rows = recipes.select("place", "doc_id", "start", "n_tokens", "root").mapInArrow(leaves, "place long, root binary").withColumn("documents", F.lit(1).cast("long"))
    found, level = None, 0
    while True:
        grouped = rows.groupBy(F.floor(F.col("place") / FAN).alias("node")).agg(F.sum("documents").alias("documents"), F.collect_list(F.struct("place", "root")).alias("children"))
        nodes = materialize(grouped.mapInArrow(roots, "node long, documents long, root binary"), "nodes")
        one = nodes.select(F.lit(level).alias("level"), "node", "documents", "root")
        found = one if found is None else found.unionByName(one)
        if nodes.count() <= 1:
            return found
        rows, level = nodes.withColumnRenamed("node", "place"), level + 1


def _zeros_after() -> np.ndarray:
    """Row n: what the 32 bits of a CRC-32 become after 4 n zero bytes, n up to MOST."""
    global _shifts
    if _shifts is None:
        one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # the register's step is linear
        rows = np.empty((MOST + 1, 32), np.uint32)
        rows[0] = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for n in range(1, MOST + 1):
            c = rows[n - 1]
            for _ in range(4):
                c = one[c & np.uint32(255)] ^ (c >> np.uint32(8))
            rows[n] = c
        _shifts = rows
    return _shifts


_shifts: np.ndarray | None = None


def joined_crc(crc: np.ndarray, more: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of texts followed by `sizes` ids of four bytes, whose CRC-32 is `more`, from the two alone."""
    bits = (crc[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(_zeros_after()[sizes] * bits, 1) ^ more


def read_digests(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files, verified.

    Each stored chunk is read once, checked against its name and digested; a document's
    digest is joined from those of its chunks in order, so that chunk bytes are not
    shuffled again. A chunk that is missing, a wrong name, a recipe that contradicts its
    Merkle root or length, and a manifest whose tree is not that of the recipes raise an error.
    """
    unit = "<u4" if wide else "<u2"

    def digests(batches):
        for batch in batches:
            names, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for n, d in zip(names, data, strict=True):
                if hashlib.blake2b(d, digest_size=16).digest() != n:
                    raise ValueError(f"chunk {n.hex()} does not have the content of its name")
                ids = np.frombuffer(d, unit)
                out.append((zlib.crc32(ids.astype("<u4").data), len(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["chunk_id", "crc", "size"])

    def joined(batches):
        for batch in batches:
            doc, n, said, parts = batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_numpy(), batch.column("root").to_pylist(), batch.column("parts")
            many = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = parts.flatten()
            at, lost = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "crc"))
            row = np.repeat(np.arange(len(many)), many)
            order = np.lexsort((at, row))
            names = flat.field("chunk_id").take(pa.array(order)).to_pylist()
            lost = np.isnan(lost.astype(float))
            crc, size = (np.nan_to_num(flat.field(c).to_numpy(zero_copy_only=False).astype(float))[order].astype(np.int64) for c in ("crc", "size"))
            first = np.cumsum(many) - many
            wrong = (np.bincount(row, size, len(many)) != n) | (np.bincount(row, lost, len(many)) > 0)
            for i, (a, k) in enumerate(zip(first.tolist(), many.tolist(), strict=True)):
                if wrong[i] or merkle_root(names[a : a + k]) != said[i]:
                    raise ValueError(f"document {doc[i]} cannot be rebuilt from its recipe")
            value, crc = crc[first].astype(np.uint32), crc.astype(np.uint32)
            for j in range(1, int(many.max(initial=0))):
                longer = np.flatnonzero(many > j)
                value[longer] = joined_crc(value[longer], crc[first[longer] + j], size[first[longer] + j])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(value.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    recipes = spark.read.parquet(f"{path}/recipes")
    _verify_manifest(spark, path)
    known = spark.read.parquet(f"{path}/chunks").mapInArrow(digests, "chunk_id binary, crc long, size long")
    uses = recipes.select("start", F.posexplode("chunk_ids").alias("at", "chunk_id"))
    parts = uses.join(known, "chunk_id", "left").groupBy("start").agg(F.collect_list(F.struct("at", "chunk_id", "crc", "size")).alias("parts"))
    rows = recipes.select("doc_id", "start", "n_tokens", "root").join(parts, "start")
    return rows.select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _verify_manifest(spark: SparkSession, path: str) -> None:
    """The Merkle tree of the recipes, node by node up to the root, against the stored one."""
    found = manifest(spark.read.parquet(f"{path}/recipes")).withColumnsRenamed({"documents": "n", "root": "r"})
    wrong = spark.read.parquet(f"{path}/manifest").join(found, ["level", "node"], "full").filter(~(F.col("documents").eqNullSafe(F.col("n")) & F.col("root").eqNullSafe(F.col("r"))))
    if not wrong.isEmpty():
        raise ValueError("the manifest contradicts the recipes")


def read_documents(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """doc_id, start and the ids themselves (array<int>), rebuilt from recipes and chunks."""
    unit = "<u4" if wide else "<u2"

    def decode(batches):
        for batch in batches:
            rows = batch.to_pydict()
            ids = [np.concatenate([np.frombuffer(p["ids"], unit) for p in sorted(parts, key=lambda p: p["at"])]).astype(np.int32) for parts in rows["parts"]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    recipes = spark.read.parquet(f"{path}/recipes")
    uses = recipes.select("doc_id", "start", F.posexplode("chunk_ids").alias("at", "chunk_id"))
    parts = uses.join(spark.read.parquet(f"{path}/chunks"), "chunk_id").groupBy("doc_id", "start").agg(F.collect_list(F.struct("at", "ids")).alias("parts"))
    return parts.mapInArrow(decode, "doc_id long, start long, ids array<int>")
