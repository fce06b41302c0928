"""Speaker centroids, similarity and label-to-camera maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import source_stem


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v):
    norm = F.sqrt(dot(v, v)) + F.lit(1e-9)
    return F.transform(v, lambda x: x / norm)


def speaker_centroids(samples: DataFrame, label: str, vector: str) -> DataFrame:
    """label, centroid: mean vector, scaled to length one. Means are taken by (label, position), so tasks sum before they send."""
    long = samples.select(label, F.posexplode(vector).alias("pos", "x"))
    mean = long.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("v"))
    return rows.select(label, unit(F.col("v")).alias("centroid"))


#: Speakers whose centroids are sent to tasks; more are an error, as they would be no dimension table.
MOST_SPEAKERS = 10_000


def speaker_similarity(windows: DataFrame, centroids: DataFrame, ids: list[str], vector: str, label: str) -> DataFrame:
    """ids, best, best_sim, second_sim, margin: cosine to each centroid, the largest label of equals.

    The centroids are one matrix in each task, MOST_SPEAKERS rows at most, so that windows are
    neither multiplied nor shuffled; each window's vector is scaled once.
    """
    got = centroids.select(label, "centroid").limit(MOST_SPEAKERS + 1).collect()
    if len(got) > MOST_SPEAKERS:
        raise ValueError(f"more than {MOST_SPEAKERS} centroids")
    got.sort(key=lambda r: r[0], reverse=True)
    table = windows.sparkSession.sparkContext.broadcast(([r[0] for r in got], np.array([r[1] for r in got], float)))

    def run(batches):
        names, matrix = table.value
        for pdf in batches:
            if not len(pdf) or not names:
                continue
            v = np.array(pdf[vector].tolist(), float)
            sims = (v / (np.sqrt((v * v).sum(1)) + 1e-9)[:, None]) @ matrix.T
            best = sims.argmax(1)  # labels fall, so the first of equals is the largest
            top = sims[np.arange(len(sims)), best]
            sims[np.arange(len(sims)), best] = -np.inf
            second = sims.max(1) if len(names) > 1 else np.full(len(sims), -1.0)
            yield pdf[ids].assign(best=[names[i] for i in best], best_sim=top, second_sim=second, margin=top - second)

    kinds, of = dict(windows.dtypes), dict(centroids.dtypes)[label]
    return windows.select(*ids, vector).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in ids) + f", best {of}, best_sim double, second_sim double, margin double")


def infer_speaker_map(samples: DataFrame, label: str, camera: str) -> DataFrame:
    """label, camera for labels whose samples all come from one camera."""
    return samples.groupBy(label).agg(F.min(camera).alias(camera), F.max(camera).alias("_hi")).filter(F.col(camera) == F.col("_hi")).drop("_hi")


def resolve_speaker_map(labels: DataFrame, given: DataFrame, inferred: DataFrame, config: DataFrame, cameras: DataFrame) -> DataFrame:
    """label, camera by precedence: given, inferred, config, a label that is a camera itself; a value may be a path, its stem counts; others are dropped."""
    rows = labels
    for name, table in (("_g", given), ("_i", inferred), ("_c", config)):
        rows = rows.join(table.select("label", F.col("camera").alias(name)), "label", "left")
    known = cameras.select(F.col("camera").alias("_cam"))
    own = rows.join(known.withColumnRenamed("_cam", "_self"), F.col("label") == F.col("_self"), "left")
    value = F.coalesce("_g", "_i", "_c", "_self")
    return own.select("label", source_stem(value).alias("camera")).join(known, F.col("camera") == F.col("_cam"), "left_semi")
