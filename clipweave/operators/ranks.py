"""Exact percentiles from counted values, and running values of long series by blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and a column per share: exact percentiles, linearly interpolated; null for a key without values.

    Equal values of a key are counted before they move, so a series of whole decibels is a few
    rows a key however long it is; the rows at the ranks asked for are found by running counts.
    """
    counts = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(value).alias("_c"))
    by = W.partitionBy(*keys)
    upto = F.sum("_c").over(by.orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    rows = counts.withColumns({"_upto": upto, "_n": F.sum("_c").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    place = {name: F.lit(float(share)) * (F.col("_n") - 1) for name, share in shares.items()}
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    found = rows.groupBy(*keys).agg(*(c for name, p in place.items() for c in (F.max(p).alias(f"_p_{name}"), at(F.floor(p)).alias(f"_a_{name}"), at(F.ceil(p)).alias(f"_b_{name}"))))

    def between(name: str) -> Column:
        p, a, b = (F.col(f"_{x}_{name}") for x in "pab")
        return F.when(F.floor(p) == F.ceil(p), a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b).alias(name)

    return found.select(*keys, *map(between, shares))


def running(rows: DataFrame, keys: list[str], block: Column, order: list[Column | str], values: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """rows with running maxima ("max") and sums ("sum") of each key's series in order: name -> (kind, column); with `before` the row itself is left out.

    The series is cut into blocks (block must not fall along the order). Every block's total is
    made where its rows are; only these, a row a block, are gone through in order, and what they
    add up to comes before each block's own rows. So one key's series is spread over tasks.
    """
    kinds = {"max": F.max, "sum": F.sum}
    rows = rows.withColumn("_block", block)
    totals = rows.groupBy(*keys, "_block").agg(*(kinds[kind](c).alias(n) for n, (kind, c) in values.items()))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*keys, "_block", *(kinds[kind](n).over(earlier).alias(f"_c_{n}") for n, (kind, _) in values.items()), F.lit(0).alias("_own"))
    both = rows.withColumns({f"_c_{n}": c for n, (_, c) in values.items()} | {"_own": F.lit(1)}).unionByName(carried, allowMissingColumns=True)
    inside = W.partitionBy(*keys, "_block").orderBy("_own", *order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    both = both.withColumns({n: kinds[kind](f"_c_{n}").over(inside) for n, (kind, _) in values.items()}).filter("_own = 1")
    return both.drop("_block", "_own", *(f"_c_{n}" for n in values))
