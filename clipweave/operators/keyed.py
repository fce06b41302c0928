"""Rules that go through each key's rows in order with a small state, many keys to a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with those of equal keys in one partition.

    The constant keeps the shuffle apart from one that a join below has on the same keys: Spark
    leaves a repetition out, and then deals that join anew at run time (a small side is
    broadcast, partitions are read where they lie), which nothing asks for above mapInPandas.
    """
    return rows.repartition(*keys, F.lit(0))


def runs_of(pdf: pd.DataFrame, keys: list[str]) -> list[int]:
    """Where the runs of equal keys begin, and the end."""
    code = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    return [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(pdf)]


def key_at(pdf: pd.DataFrame, keys: list[str], row: int) -> tuple:
    return tuple(None if pd.isna(v) else v for v in (pdf[k].iat[row] for k in keys))


def whole_runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterable[pd.DataFrame]:
    """Frames of sorted batches cut anew: none ends inside a run of equal keys."""
    kept: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        start = runs_of(pdf, keys)[-2]
        if kept and (start or key_at(pdf, keys, 0) != key_at(kept[-1], keys, -1)):
            same = key_at(pdf, keys, 0) == key_at(kept[-1], keys, -1)
            yield pd.concat([*kept, *([pdf.iloc[:start]] if same else [])], ignore_index=True)
            if not same and start:
                yield pdf.iloc[:start]
            kept = []
        elif start:
            yield pdf.iloc[:start]
        kept.append(pdf.iloc[start:])
    if kept:
        yield pd.concat(kept, ignore_index=True)


def keep_in_order(rows: DataFrame, keys: list[str], order: list[Column | str], begin: Callable[[], object], keep: Callable[[object, dict[str, list], int, int], list[int]], used: list[str]) -> DataFrame:
    """The rows that keep takes, with all their columns.

    Spark deals rows by key and sorts them; a task goes through its batches once, so that the
    memory of a key is that of its state, however many rows it has. begin() makes the state of
    a new key; keep(state, columns, a, z) gives the places of the rows it takes among rows a to
    z - 1 of the batch, all of one key; columns are lists, by name.
    """

    def run(batches):
        last, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            cut = runs_of(pdf, keys)
            columns, take = {c: pdf[c].tolist() for c in used}, []
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                if state is None or a > 0 or key_at(pdf, keys, 0) != last:
                    state = begin()
                take += keep(state, columns, a, z)
            last = key_at(pdf, keys, -1)
            yield pdf.iloc[take]

    return dealt(rows, keys).sortWithinPartitions(*keys, *order).mapInPandas(run, rows.schema)


def fold_in_order(rows: DataFrame, keys: list[str], order: list[Column | str], begin: Callable[[], object], step: Callable[[object, tuple], Iterable[tuple]], finish: Callable[[object], Iterable[tuple]], used: list[str], schema: str) -> DataFrame:
    """keys and what step and finish write (schema: their columns), going through each key's rows in order as keep_in_order does.

    step(state, values of `used`) writes rows (tuples) as soon as they are settled, finish(state)
    what is left when the key ends.
    """
    names = [*keys, *(f.split()[0] for f in schema.split(", "))]

    def run(batches):
        last, state = None, None
        kinds = None

        def frame(out):
            return pd.DataFrame({n: pd.Series([r[i] for r in out], dtype=kinds.get(n, object) if kinds else object) for i, n in enumerate(names)})

        for pdf in batches:
            if not len(pdf):
                continue
            kinds = {k: pdf[k].dtype for k in keys}
            cut, out = runs_of(pdf, keys), []
            columns = [pdf[c].tolist() for c in used]
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                key = key_at(pdf, keys, a)
                if state is None or key != last:
                    if state is not None:
                        out += [(*last, *r) for r in finish(state)]
                    state = begin()
                last = key
                for values in zip(*(c[a:z] for c in columns), strict=True):
                    out += [(*key, *r) for r in step(state, values)]
            yield frame(out)
        if state is not None:
            yield frame([(*last, *r) for r in finish(state)])

    types = dict(rows.dtypes)
    return dealt(rows, keys).sortWithinPartitions(*keys, *order).select(*keys, *used).mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + schema)
