"""What the operators of this subpackage share: shared folder, word arrays, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_kept: dict[str, dict] = {}
_last: str | None = None

def kept_in_worker(owner: str, cache: dict) -> dict:
    """A dict that an operator keeps in a Python worker from task to task, until a task of another operator frees it."""
    return _kept.setdefault(owner, cache)


def free_memory(owner: str) -> None:
    """Called as a task begins: where this worker's last task was another operator's, what that kept is freed and given back to the system, so that memory does not add up over stages."""
    global _last
    if _last == owner:
        return
    _last = owner
    for name, cache in _kept.items():
        if name != owner:
            cache.clear()
    give_back()


def give_back() -> None:
    """Gives memory that this worker no longer uses back to the system; called as a large task ends, as workers wait in memory for others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
        ctypes.CDLL(None).malloc_trim(0)


#: Most bytes of an Arrow batch: a batch of long texts stays small.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of about BATCH_BYTES at most in this session, unless it has smaller ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))  # Spark's own default where it is not set
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="clipweave-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/clipweave/{name}-{uuid.uuid4().hex}"


def send_array(spark: SparkSession, array: np.ndarray, name: str) -> str:
    """Sends an array as a compressed file to every executor and returns the file's name for sent_array. It stays until the application ends."""
    path = Path(tempfile.mkdtemp(prefix="clipweave-")) / f"{name}-{uuid.uuid4().hex}.npy.zst"
    with pa.output_stream(str(path), compression="zstd") as out:
        np.lib.format.write_array(out, array)
    spark.sparkContext.addFile(str(path))
    return path.name


def sent_array(name: str) -> np.ndarray:
    """In a worker: the array, mapped from one plain file beside the executor's compressed one, so that the workers of an executor share one copy."""
    sent = SparkFiles.get(name)
    plain = Path(sent.removesuffix(".zst"))
    if not plain.exists():
        own = plain.with_name(f"{plain.name}-{uuid.uuid4().hex}")
        with pa.input_stream(sent, compression="zstd") as packed, own.open("wb") as out:
            shutil.copyfileobj(packed, out, 1 << 20)
        own.replace(plain)  # workers that come at the same time write equal files; the name always has a whole one
    return np.asarray(np.load(plain, mmap_mode="r"))


#: Spark's setting (from 4.1) by which the shuffle files of a query are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Inside, what is written leaves no shuffle files behind: they would stay on the executors' disks until the driver collects garbage."""
    if not spark.conf.isModifiable(CLEANUP):
        yield
        return
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors, leaves no shuffle files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A list of doc_ids longer than this is joined by a shuffle, not broadcast.
MOST_BROADCAST_ROWS = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """df (narrow, materialized) with a broadcast hint if its row count allows it; otherwise its join shuffles."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST_ROWS else df


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without those whose doc_id is in gone; documents without a doc_id stay."""
    return docs.join(few(materialize(gone.distinct(), "gone")), "doc_id", "left_anti").select(*docs.columns)


def split_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+: bytes.split() divides at exactly these six characters."""
    return text.split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of every k consecutive values of h (uint64), polynomial in an odd base modulo 2**64."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b = np.uint64(base)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * b + h[j : j + n]
    return mix(out)


#: Words of more bytes are hashed one by one.
LONG_WORD = 512
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, and how many words each text has. Eight bytes of all words are taken in at a time."""
    data = b"\n".join([b"", *(t or b"" for t in texts), b" " * 8])
    b = np.frombuffer(data, np.uint8)
    space = (b == 0x20) | (b - np.uint8(9) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = mix(size.astype(np.uint64) + np.uint64(0x51))
    h = mix(h ^ (eight[starts] & _FIRST_BYTES[np.minimum(size, 8)]))
    longer, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(longer):
        h[longer] = mix(h[longer] ^ (eight[starts[longer] + done] & _FIRST_BYTES[np.minimum(size[longer] - done, 8)]))
        done += 8
        longer = longer[size[longer] > done]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + size[i]])
    ends = 1 + np.cumsum(np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts)))
    return h, np.diff(np.searchsorted(starts, ends), prepend=0)


def texts_of(column) -> list[bytes | None]:
    """An Arrow string column as bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def in_pieces(texts: list[bytes | None], most_bytes: int):
    """(first, last + 1) ranges of texts of about most_bytes each; a longer text is alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most_bytes:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def whole_groups(batches, names: list[str]):
    """Batches, sorted by the columns names, cut so that none ends inside a run of equal values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c) for c in names]
        other = [np.flatnonzero(~pc.equal(k, k[-1]).to_numpy(zero_copy_only=False)) for k in keys]
        start = max((int(o[-1]) + 1 for o in other if len(o)), default=0)  # of the last group
        if held and any(held[-1].column(c)[-1] != k[0] for c, k in zip(names, keys, strict=True)):
            yield _joined(held)
            held = []
        if start:
            yield _joined([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
