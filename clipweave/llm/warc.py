"""WARC archives: writing, and reading with boundary-chain verification.

Writing: one record per page through Spark's text writer, whose line separator is the
record separator, so archives go wherever Spark can write. Equal payloads of at least
LEAST_DEDUP bytes are stored once, in the record of the largest page_id; the others are
revisit records that refer to it.

Reading: Spark splits the archives at the record magic, block by block, so every magic,
also one inside a payload, starts a candidate. A task turns the candidates of a block into
record-to-successor offsets (from Content-Length) and follows them to where they leave the
block by pointer jumping over arrays. Block exits are then joined to block entries by
pointer jumping over tables from each file's start: log2(blocks of a file) rounds. A
second scan walks each block from its verified entry and emits the records that the chain
reaches; candidates that it does not reach are payload bytes. A record that leaves its
block is put together from fragments. Files may be of any size; only one block's offsets
are in a task's memory.

Null html is an empty payload, a null url an empty target. Payloads of any length are written and
read; of equal payloads the largest page_id is the response (all its rows, if it repeats). Rows that repeat a page_id are
records of their own. A null page_id stays null. A record that the file's end cuts off is
not returned. An empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

MAGIC, GAP = b"WARC/1.0\r\n", b"\r\n\r\n"
LEAST_DEDUP = 1000
#: More rows (revisits, file blocks) than this are joined by a shuffle, not broadcast.
MOST_BROADCAST_ROWS = 1_000_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_LENGTH = re.compile(rb"(?mi)^Content-Length:[ \t]*(\d+)[ \t]*\r?$")
_FIELD = re.compile(rb"(?m)^([A-Za-z-]+):[ \t]*(.*?)\r?$")


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to for the pages whose payload another record holds. Only ids and digests are shuffled."""
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    named = pages.filter("page_id IS NOT NULL").select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("size")).filter(F.col("size") >= LEAST_DEDUP).select("page_id", "digest")
    firsts = named.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).filter("low < refers_to").drop("low")
    return named.join(firsts, "digest").filter("page_id < refers_to").distinct()


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes page_id, url, html as WARC records under path."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    again = materialize(revisits(rows), "revisits")
    again = F.broadcast(again) if again.count() <= MOST_BROADCAST_ROWS else again
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).join(again, ["page_id", "digest"], "left")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    target = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    size = F.octet_length("html")
    seen = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(seen, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", size.cast("string")),
        F.when(seen, F.concat(line("WARC-Refers-To", urn("refers_to")), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.lit(len(HTTP)) + F.when(seen, 0).otherwise(size)).cast("string")),
        F.lit("\r\n" + HTTP),
    )
    record = F.concat(head, F.when(seen, F.lit("")).otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", GAP.decode()).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """file, block, value: what stands between magics, in order inside a block."""
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _record_size(value: bytes) -> int:
    """Bytes of the candidate record that starts with magic + value, separator included; -1 for no record."""
    end = value.find(GAP)
    found = _LENGTH.search(value, 0, end + 2) if end >= 0 else None
    return len(MAGIC) + end + len(GAP) + int(found[1]) + len(GAP) if found else -1


def _exits(at: np.ndarray, to: np.ndarray, total: int) -> np.ndarray:
    """Where the chain from each candidate leaves the block, by pointer jumping; -1 where it breaks off.

    at: sorted candidate offsets; to: their successors (-1: none); all relative to the block.
    """
    n = len(at)
    place = np.searchsorted(at, to)
    inside = (to >= 0) & (place < n) & (at[np.minimum(place, n - 1)] == to)
    outside = to >= total - len(MAGIC)
    # Nodes 0..n-1 are candidates; a node that leaves the block or breaks off points at itself.
    jump = np.where(inside, np.minimum(place, n - 1), np.arange(n))
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    last = jump
    return np.where(outside[last], to[last], -1)


def candidates(segments: DataFrame) -> DataFrame:
    """file, block, total (bytes of the block), at, exit: candidates of each block and where their chains leave it.

    Each block has a row with at = null as well, so that blocks without a candidate count.
    """

    def run(batches):
        now, sizes, at, to = None, 0, [], []

        def done():
            a, t = np.asarray(at, np.int64), np.asarray(to, np.int64)
            e = _exits(a, t, sizes) if len(a) else a
            keep = e >= 0
            n = int(keep.sum()) + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * n), pa.array([now[1]] * n, pa.int64()), pa.array([sizes] * n, pa.int64()), pa.array([None, *a[keep].tolist()], pa.int64()), pa.array([None, *e[keep].tolist()], pa.int64())], names=["file", "block", "total", "at", "exit"]
            )

        for batch in batches:
            for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if now != (file, block):
                    if now:
                        yield done()
                    now, sizes, at, to = (file, block), 0, [], []
                if sizes or block:  # the file's first segment is what stands before its first magic
                    size = _record_size(value)
                    start = sizes - len(MAGIC)
                    at.append(start)
                    to.append(start + size if size > 0 else -1)
                sizes += len(value) + len(MAGIC)
        if now:
            yield done()

    return segments.mapInArrow(run, "file string, block long, total long, at long, exit long")


def block_entries(found: DataFrame) -> DataFrame:
    """file, block, base, entry, key: per block its first byte, the first record of the chain in it (null: none) and the first at or after it (or the file's end)."""
    blocks = materialize(found.filter("at IS NULL").select("file", "block", "total"), "blocks")
    order = W.partitionBy("file").orderBy("block")
    bases = materialize(blocks.withColumn("base", F.coalesce(F.sum("total").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), "bases")
    starts = bases.select("file", "block", "base")
    starts = F.broadcast(starts) if starts.count() <= MOST_BROADCAST_ROWS else starts
    edges = found.filter("at IS NOT NULL").join(starts, ["file", "block"])
    edges = materialize(edges.select("file", "block", (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("exit")).alias("to")), "edges")
    reached = materialize(edges.select("file").distinct().select("file", F.lit(0).cast("long").alias("at")), "reached")
    jump, n = edges.select("file", "at", "to"), reached.count()
    while True:  # after t rounds reached holds the first 2**t entries of every file, jump leads 2**t blocks on
        more = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = materialize(reached.union(more).distinct(), "reached")
        m = reached.count()
        if m == n:
            break
        n = m
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = materialize(jump.join(far, ["file", "to"]).select("file", "at", F.col("far").alias("to")), "jump")
    entries = edges.join(reached, ["file", "at"], "left_semi").groupBy("file", "block").agg(F.min("at").alias("entry"))
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    end = F.sum("total").over(W.partitionBy("file")) - len(MAGIC)  # no magic follows the file's last segment
    return bases.join(entries, ["file", "block"], "left").withColumn("key", F.coalesce(F.first("entry", True).over(after), end)).select("file", "block", "base", "entry", "key")


RECORD = "record_id string, record_type string, target_uri string, refers_to string, digest string, payload_length long, payload binary"


def _parsed(values: list[bytes]) -> pa.RecordBatch:
    """Whole records (without magic) as columns."""
    out = []
    for v in values:
        end = v.find(GAP)
        fields = {k.lower(): x.decode("utf-8", "replace") for k, x in _FIELD.findall(v[:end])}
        size = int(fields.get(b"content-length", 0))
        body = v[end + len(GAP) : end + len(GAP) + size]
        http = body.find(GAP)
        payload = body[http + len(GAP) :] if http >= 0 else body
        said = fields.get(b"x-payload-length")
        out.append((fields.get(b"warc-record-id"), fields.get(b"warc-type"), fields.get(b"warc-target-uri"), fields.get(b"warc-refers-to"), (fields.get(b"warc-payload-digest") or "").removeprefix("sha1:"), int(said) if said else len(payload), payload))
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in RECORD.split(", ")])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: record_id, record_type, target_uri, refers_to, digest, payload_length, payload."""
    found = materialize(candidates(_segments(spark, path)), "candidates")
    entries = materialize(block_entries(found), "entries")
    few = F.broadcast(entries) if entries.count() <= MOST_BROADCAST_ROWS else entries
    # A broadcast join keeps the segments of a block in order; beyond its bound they are sorted by a running number.
    lines = _segments(spark, path).withColumn("_cw_n", F.monotonically_increasing_id())
    rows = lines.join(few, ["file", "block"]).select("file", "block", "value", "base", "entry", "key", "_cw_n")
    if few is entries:
        rows = rows.sortWithinPartitions("file", "block", "_cw_n")

    def walk(batches):
        # whole: complete records; part: fragments (file, key, at) of records that cross blocks.
        for batch in batches:
            whole, parts = [], []
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for file, block, value, base, entry, key in zip(*cols, strict=True):
                if state["now"] != (file, block):
                    state.update(now=(file, block), at=base, next=entry)
                    parts += flush()
                start = state["at"] - len(MAGIC) if state["at"] or block else None
                state["at"] += len(value) + len(MAGIC)
                if start is None:
                    continue
                if start == state["next"]:
                    parts += flush()
                    size = _record_size(value)
                    state["next"] = start + size
                    if len(MAGIC) + len(value) == size:
                        whole.append(value)
                    else:
                        state["open"] = [(file, start + size, start, value)]
                        state["left"] = size - len(MAGIC) - len(value)
                elif state["open"]:
                    state["open"].append((file, state["open"][0][1], start, value))
                    state["left"] -= len(MAGIC) + len(value)
                elif key is not None and start < key and (entry is None or start < entry):
                    parts.append((file, key, start, value))
                if state["open"] and state["left"] == 0:
                    whole.append(MAGIC.join(p[3] for p in state["open"]))
                    state["open"] = []
            yield rows_of(whole, parts)
        yield rows_of([], flush())

    def flush():
        out, state["open"] = state["open"], []
        return out

    def rows_of(whole, parts):
        n = len(whole)
        return pa.RecordBatch.from_arrays(
            [pa.array([None] * n + [p[0] for p in parts], pa.string()), pa.array([None] * n + [p[1] for p in parts], pa.int64()), pa.array([None] * n + [p[2] for p in parts], pa.int64()), pa.array(whole + [p[3] for p in parts], pa.binary())], names=["file", "key", "at", "value"]
        )

    state = {"now": None, "at": 0, "next": None, "open": [], "left": 0}
    def walk_and_parse(batches):  # in one Python worker: a second one beside it would hold the records once more
        for batch in walk(batches):
            yield _parsed(batch.column("value").filter(batch.column("key").is_null()).to_pylist())

    def parse(batches):
        for batch in batches:
            yield _parsed(batch.column(0).to_pylist())

    def parse_parts(batches):
        for batch in batches:
            values = [MAGIC.join(p["value"] for p in sorted(parts, key=lambda p: p["at"])) for parts in batch.column(0).to_pylist()]
            yield _parsed([v for v in values if len(MAGIC) + len(v) == _record_size(v)])

    if not _may_cross(entries):
        return rows.mapInArrow(walk_and_parse, RECORD)
    walked = materialize(rows.mapInArrow(walk, "file string, key long, at long, value binary"), "records")
    records = walked.filter("key IS NULL").select("value").mapInArrow(parse, RECORD)
    parts = walked.filter("key IS NOT NULL").groupBy("file", "key").agg(F.collect_list(F.struct("at", "value")).alias("parts"))
    return records.unionByName(parts.select("parts").mapInArrow(parse_parts, RECORD))


def _may_cross(entries: DataFrame) -> bool:
    """Whether a record may run over the end of a block: some block does not begin with the chain's next record."""
    return not entries.filter(~(F.col("entry").eqNullSafe(F.greatest(F.lit(0), F.col("base") - len(MAGIC)))) & ~(F.col("base") == 0)).isEmpty()
