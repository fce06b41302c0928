"""MinHash near-dedup with b-bit signatures.

Each document's set is its distinct word shingles (64-bit hashes). LANES minima give
band keys for candidates and, cut to their low BITS bits and packed in 64-bit words, a
signature from which similarity is estimated by counting equal lanes and correcting for
those equal by chance. Links are confirmed on the full sets.

1. Documents with equal sets are one vertex, named by their smallest doc_id.
2. Every band bucket links each member to its smallest: as many pairs as members, not
   squares. Pairs with an estimate of at least `least_estimate` are confirmed on their
   sets, and connected components are found.
3. Only documents in buckets that still hold several components are searched further. Inside
   such buckets members need not be alike, and comparing all would take squares; so they meet
   in inverted lists of their rarest shingles, of which any two linked sets share one (see
   jaccard_join): what a template has put in thousands of documents is rare in none of them.
   Pairs of different components whose sizes, parity bitmaps and estimates allow a link are
   confirmed on their sets; no text is dealt before that.

Bands follow the threshold: 24 of 5 from 85 % on, else 32 of 4. A pair at similarity 0.85
shares no band with probability 8e-7 (at 0.8: 5e-8), and `least_estimate` is five standard
deviations of the estimate below the threshold.

Null or empty texts have an empty set and link with nothing. Rows that repeat a doc_id
share its vertex: links of any of them count. Rows without a doc_id link with nothing,
have a null component and are kept. An empty table gives an empty result. Extra columns
are ignored. Texts of any length are hashed whole. Equal similarity at the threshold is a link; ties need no rule, as a component is named by its smallest doc_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, free_memory, in_pieces, materialize, mix, texts_of
from .jaccard_join import links_across, set_rows
from .links import components, confirmed, shingle_sets

SHINGLE, LANES, BITS = 3, 128, 4
#: How far below the threshold a pair's estimate may be and still be confirmed: five standard deviations.
MARGIN = 0.17
_MULTIPLIERS = mix(np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LANE_LOW = np.uint64(0x1111111111111111)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of LANES hash functions over the set."""
    low = np.full(LANES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(low, (shingles[i : i + 512, None] * _MULTIPLIERS).min(0), out=low)
    return mix(low)


def pack(lows: np.ndarray) -> np.ndarray:
    """Low BITS bits of minima (documents x LANES) in uint64 words."""
    per_word = 64 // BITS
    lanes = (lows & np.uint64((1 << BITS) - 1)).reshape(len(lows), LANES // per_word, per_word)
    return (lanes << (np.arange(per_word, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (last axis: words), corrected for lanes equal by chance."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    unlike = np.bitwise_count(x & _LANE_LOW).sum(-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return ((LANES - unlike) / LANES - chance) / (1 - chance)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows of a band): a pair at the threshold shares no band with probability below 1e-6."""
    return (24, 5) if percent >= 85 else (32, 4)


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set), bands (packed keys), bits (packed signature)."""

    def run(batches):
        free_memory("minhash")
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, z in in_pieces(texts, 4 << 20):
                sets = shingle_sets(texts[a:z], k)
                lows = np.stack([minima(s) for s in sets])
                keys = np.zeros((len(sets), bands), np.uint64)
                for r in range(rows):
                    keys = keys * np.uint64(0xD6E8FEB86659FD93) + lows[:, r : bands * rows : rows]
                keys, bits = mix(keys), pack(lows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, z - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([x.tobytes() for x in keys], pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary())],
                    names=["doc_id", "n_shingles", "set_key", "bands", "bits"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands binary, bits binary")


def estimated(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity is at least `least`."""
    bits = sigs.select("rep", "bits")
    both = pairs.join(bits.withColumnsRenamed({"rep": "a", "bits": "x"}), "a").join(bits.withColumnsRenamed({"rep": "b", "bits": "y"}), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, LANES * BITS // 64) for c in ("x", "y"))
                yield batch.select(["a", "b"]).filter(pa.array(estimate(x, y) >= least))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = SHINGLE, least_estimate: float | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    least = percent / 100 - MARGIN if least_estimate is None else least_estimate
    bands, per_band = banding(percent)
    sigs = materialize(signatures(docs, k, bands, per_band), "signatures")
    linkable = sigs.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = linkable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    copied = materialize(classes.filter("n > 1").select("set_key", "rep"), "copied")
    # The row that names its class carries its signature; rows of classes of one need no join.
    own = linkable.join(copied, "set_key", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    reps = materialize(own.filter("doc_id = rep").select("rep", "bands", "bits", "n_shingles").dropDuplicates(["rep", "bands"]), "reps")

    def explode(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(-1, bands)
            rep = batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), bands)))
            yield pa.RecordBatch.from_arrays([rep, pa.array(np.tile(np.arange(bands, dtype=np.int32), len(keys))), pa.array(keys.ravel())], names=["rep", "band", "key"])

    banded = reps.select("rep", "bands").mapInArrow(explode, "rep long, band int, key long")
    shared = banded.groupBy("band", "key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).filter("first < last").drop("last")
    members = materialize(banded.join(shared, ["band", "key"]), "members")

    star = members.filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    tried = materialize(estimated(star, reps, least), "star")
    links = materialize(confirmed(tried, docs, percent, k), "links")
    label = components(links)

    at = members.join(label.withColumnsRenamed({"v": "rep", "c": "comp"}), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = at.groupBy("band", "key").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).filter("p < q").select("band", "key")
    left = materialize(at.join(mixed, ["band", "key"], "left_semi").select("rep").distinct(), "mixed")
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = base.join(few(left.withColumnRenamed("rep", "doc_id")), "doc_id", "left_semi")
    sets = materialize(set_rows(texts, k).select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bits").filter("n > 0").distinct(), "sets")
    label = components(links_across(texts, sets, links, base, percent, k, lambda pairs: estimated(pairs, reps, least)))

    rows = own.select("doc_id", "n_shingles", "rep").join(label.withColumnsRenamed({"v": "rep", "c": "component_id"}), "rep", "left")
    rows = rows.select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    alone = sigs.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
