"""What both operators on word-shingle sets share: the sets, confirmation of pairs on them, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, hashed_words, materialize, texts_of, window_hashes

_BASE = 0x9FB21C651E98DF25


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, A-Z lower-cased; fewer than k words are one shingle."""
    h, many = hashed_words([t.lower() if t else t for t in texts])
    rolled, sets = window_hashes(h, k, _BASE), []
    ends = np.cumsum(many)
    for a, z in zip((ends - many).tolist(), ends.tolist(), strict=True):
        s = np.sort(rolled[a : z - k + 1] if z - a >= k else window_hashes(h[a:z], max(1, z - a), _BASE))
        new = np.ones(len(s), bool)
        np.not_equal(s[1:], s[:-1], out=new[1:])
        sets.append(s[new])
    return sets


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union. pairs are materialized."""
    ids = few(materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids"))
    texts = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids, "doc_id", "left_semi"), "texts")
    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(t)) for c, t in (("a", "s"), ("b", "t")))

    def run(batches):
        for batch in batches:
            a, s, t = batch.column("a").to_pylist(), texts_of(batch.column("s")), texts_of(batch.column("t"))
            known, keep = (None, None, None), []
            for key, x, y in zip(a, s, t, strict=True):
                if known[0] != key or known[1] != x:
                    known = key, x, shingle_sets([x], k)[0]
                other = shingle_sets([y], k)[0]
                both = len(np.intersect1d(known[2], other, assume_unique=True))
                keep.append(100 * both >= percent * (len(known[2]) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, c: the smallest vertex reachable from each vertex of the edges (a, b).

    Contraction: every vertex hooks to its smallest neighbour if that is smaller, chains
    of hooks are shortened by pointer jumping, and edges are moved to the roots until
    none is left. Each round at least halves what hangs on a root; each table is written
    to the shared folder.
    """
    ends = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    rest = materialize(edges.select(*ends).filter("lo < hi").distinct(), "edges")
    labels = rest.select(F.col("lo").alias("v")).union(rest.select("hi")).distinct().withColumn("c", F.col("v"))
    while not rest.isEmpty():
        up = materialize(rest.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("p")), "hooks")
        while True:
            over = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            if up.join(over, "p", "left_semi").isEmpty():
                break
            up = materialize(up.join(over, "p", "left").select("v", F.coalesce("q", "p").alias("p")), "hooks")
        to = lambda df, c: df.join(up.select(F.col("v").alias(c), F.col("p").alias("_cw_p")), c, "left").withColumn(c, F.coalesce("_cw_p", c)).drop("_cw_p")
        labels = materialize(to(labels, "c"), "labels")
        rest = materialize(to(to(rest, "lo"), "hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).filter("lo < hi").distinct(), "edges")
    return labels
