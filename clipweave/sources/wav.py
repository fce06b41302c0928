"""WAV files, mono with 16 bits: read by ranges, many tasks to a file, and written."""

from __future__ import annotations

import re
import struct
import uuid
import wave

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import dealt

#: Schemes of stores that tasks open themselves, for ranges; files elsewhere are read whole by Spark.
RANGED = ("file", "s3", "s3a", "gs")
#: Chunks of one file that a task reads in a row, and bytes of sound for a task.
RUN, TASK_BYTES = 32, 64 << 20


def opened(path: str):
    """(filesystem, path in it) of a URI or local path."""
    local = re.sub(r"^file:/*", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", path))


def layout(w: wave.Wave_read, path: str) -> tuple[int, int]:
    """(samples a second, samples) of mono 16-bit sound; other layouts raise."""
    if w.getnchannels() != 1 or w.getsampwidth() != 2:
        raise ValueError(f"{path}: not mono 16 bit")
    return w.getframerate(), w.getnframes()


def samples(w: wave.Wave_read, start: int, n: int) -> np.ndarray:
    w.setpos(start)
    return np.frombuffer(w.readframes(n), "<i2").astype(np.float32) / 32768


def read_wav_chunks(spark: SparkSession, paths, chunk_s: float, overlap_s: float = 0.0, by_range: bool | None = None, run: int = RUN, task_bytes: int = TASK_BYTES) -> DataFrame:
    """path, chunk_idx, sr, start_sample, samples (-1..1) of mono 16-bit files; other layouts raise. A file without samples has one empty chunk.

    Spark lists the files without reading them. A task reads each file's header, the chunks are
    dealt out in runs of `run` to a task for every task_bytes, and the tasks that get them seek to their samples: a file of any
    length is spread over tasks, and a task holds a chunk. Files in stores that only Spark's
    readers open (by_range false) are read whole, so they are limited to 2 GB each.
    """
    schema = "path string, chunk_idx int, sr int, start_sample long, samples array<float>"
    files = spark.read.format("binaryFile").load(paths)
    if by_range is None:
        one = files.select("path").first()
        by_range = one is None or one[0].split(":")[0] in RANGED

    def row(path, i, w, sr, n):
        start, size = i * int(chunk_s * sr), int((chunk_s + overlap_s) * sr)
        return pd.DataFrame({"path": [path], "chunk_idx": [i], "sr": [sr], "start_sample": [start], "samples": [samples(w, min(start, n), max(0, min(size, n - start)))]})

    def n_chunks(sr: int, n: int) -> int:
        return len(range(0, max(n, 1), int(chunk_s * sr)))

    def whole(batches):
        import io

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    sr, n = layout(w, path)
                    for i in range(n_chunks(sr, n)):
                        yield row(path, i, w, sr, n)

    def headers(batches):
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                store, at = opened(path)
                with store.open_input_file(at) as f, wave.open(f) as w:
                    out.append((path, n_chunks(*layout(w, path))))
            yield pd.DataFrame(out, columns=["path", "chunks"])

    def ranges(batches):
        for pdf in batches:
            for path, rows in pdf.groupby("path", sort=False):
                store, at = opened(path)
                with store.open_input_file(at) as f, wave.open(f) as w:
                    sr, n = layout(w, path)
                    for i in rows["chunk_idx"].tolist():
                        yield row(path, i, w, sr, n)

    if not by_range:
        return files.select("path", "content").mapInPandas(whole, schema)
    found = files.select("path").mapInPandas(headers, "path string, chunks int")
    named = found.select("path", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_idx"))
    tasks = 1 + (files.agg(F.sum("length")).first()[0] or 0) // task_bytes  # a fixed number: rows that name chunks are too small for Spark to tell
    return named.repartition(tasks, "path", F.floor(F.col("chunk_idx") / run)).sortWithinPartitions("path", "chunk_idx").mapInPandas(ranges, schema)


def write_wav(chunks: DataFrame, path: str, key: str, sr: int) -> DataFrame:
    """key, path, n_samples: a file for each key of chunks (key, start_sample, samples -1..1) in order, missing samples as silence.

    A task writes a key's chunks as they come, so it holds one of them. Files get their name when
    they are whole; a repeated task writes the same file again.
    """
    last = chunks.groupBy(key).agg(F.max(F.col("start_sample") + F.size("samples")).alias("n_samples"))
    rows = chunks.select(F.col(key).cast("string").alias("name"), key, F.col("start_sample").cast("long"), F.col("samples").cast("array<double>").alias("samples")).join(last, key)
    kind = dict(chunks.dtypes)[key]

    def run(batches):
        now, out, at = None, None, 0

        def close():
            nonlocal out
            store, goal, temp, k, n = now
            out.write(b"\0\0" * (n - at))
            out.close()
            store.move(temp, goal)
            out = None
            return pd.DataFrame({key: [k], "path": [f"{path}/wav/{goal.rpartition('/')[2]}"], "n_samples": [n]})

        for pdf in batches:
            for name, k, start, x, n in zip(pdf["name"], pdf[key], pdf["start_sample"], pdf["samples"], pdf["n_samples"], strict=True):
                if now is None or k != now[3]:
                    if out:
                        yield close()
                    store, folder = opened(f"{path}/wav")
                    store.create_dir(folder)
                    goal = f"{folder}/{re.sub(r'[^0-9A-Za-z._-]', '_', name)}.wav"
                    now, at = (store, goal, f"{goal}.{uuid.uuid4().hex}", k, n), 0
                    out = store.open_output_stream(now[2])
                    out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * n, b"WAVE", b"fmt ", 16, 1, 1, sr, 2 * sr, 2, 16, b"data", 2 * n))
                out.write(b"\0\0" * (start - at))
                pcm = (np.clip(np.asarray(x)[max(0, at - start) :], -1, 1) * 32767).astype("<i2")
                out.write(pcm.tobytes())
                at = max(at, start) + len(pcm)
        if out:
            yield close()

    done = dealt(rows, [key]).sortWithinPartitions(key, "start_sample").mapInPandas(run, f"{key} {kind}, path string, n_samples long")
    done.write.mode("overwrite").parquet(f"{path}/files")
    return chunks.sparkSession.read.parquet(f"{path}/files")
