"""Which camera is on air, as a state machine over hops whose work is spread over blocks of time.

A step may take the picture from every camera but those that hold it. The state is the camera
on air and the first step at which it may be left, which, seen from a block's begin, has no
more values than the least length of a shot. So a block of steps is a map from states to
states, found without knowing what comes before; the maps of a recording are composed in order
(one row a block), and then every block is gone through once more from the state it begins in.
Inside a block only switches are visited: the next one is the first step after the state's that
the camera on air does not hold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import dealt, fold_in_order, runs_of, whole_runs

#: Steps of a block.
BLOCK = 4096
#: In place of a camera: any that a block does not name.
OTHER = ""


class Block:
    """The steps of a block at which cameras can be left: step, best (camera), held (cameras that keep the picture)."""

    def __init__(self, step: np.ndarray, best: np.ndarray, held: list, least: int):
        self.step, self.best, self.least = step, best, least
        cameras = [c for h in held for c in h]
        at = np.repeat(np.arange(len(step)), [len(h) for h in held])
        code, self.names = pd.factorize(np.array(cameras, object))
        every = np.arange(len(step))
        # Places of the steps at which each camera can be left.
        self.open = {OTHER: every} | {c: np.delete(every, at[code == k]) for k, c in enumerate(self.names)}
        self._ends: dict[tuple[str, int], tuple[str, int]] = {}

    def next_switch(self, camera: str, free: int) -> int:
        """Place of the first step from `free` on at which camera is left, or -1."""
        places = self.open.get(camera, self.open[OTHER])
        k = np.searchsorted(self.step[places], free)
        return int(places[k]) if k < len(places) else -1

    def switches(self, camera: str, free: int):
        """Places of the switches from a state on."""
        while (at := self.next_switch(camera, free)) >= 0:
            yield at
            camera, free = self.best[at], int(self.step[at]) + max(1, self.least)

    def end(self, at: int) -> tuple[str, int]:
        """The state (camera, free step) at the block's end after a switch at place `at`."""
        trail, key = [], at
        while key not in self._ends:
            trail.append(key)
            camera, free = self.best[key], int(self.step[key]) + max(1, self.least)
            after = self.next_switch(camera, free)
            if after < 0:
                self._ends[key] = camera, free
                break
            key = after
        for k in trail:
            self._ends[k] = self._ends[key]
        return self._ends[at]

    def map(self, begin: int):
        """(camera, from, to, camera after, free step after): states with a free step begin + from to begin + to that end in another one; from 0 also stands for earlier ones. A camera that always holds has a row without a state."""
        for camera in [OTHER, *self.names]:
            places = self.open[camera]
            if not len(places):
                yield camera, 1, 0, camera, 0
            # A state that may leave later meets a later step; states that meet the same one end alike.
            met = np.searchsorted(self.step[places], begin + np.arange(self.least + 1))
            for k in np.unique(met[met < len(places)]).tolist():
                same = np.flatnonzero(met == k)
                yield (camera, int(same[0]), int(same[-1]), *self.end(int(places[k])))


def switched(steps: DataFrame, firsts: DataFrame, key: str, least_steps: int, carry: list[str], block: int = BLOCK) -> DataFrame:
    """key, step, before, camera and the carried columns: the camera on air before and after each step.

    steps: key, step, best, held (array of cameras that keep the picture; null: all do); firsts:
    key, first (camera on air at a recording's first step, free after least_steps).
    """
    kind = dict(steps.dtypes)[key]
    steps = steps.withColumn("block", F.floor(F.col("step") / block))
    order = [key, "block", "step"]

    def opened(pdf: pd.DataFrame):
        """(a, z, Block, places of its steps) of each block of a frame of whole ones; columns are taken out of the frame once."""
        step, best, held = pdf["step"].to_numpy(), pdf["best"].to_numpy(object), pdf["held"].to_numpy(object)
        some = pdf["held"].notna().to_numpy()
        at = runs_of(pdf, [key, "block"])
        for a, z in zip(at[:-1], at[1:], strict=True):
            places = a + np.flatnonzero(some[a:z])
            yield a, z, Block(step[places], best[places], held[places].tolist(), least_steps), places

    def maps(batches):
        names = ["camera", "lo", "hi", "after", "free"]
        for pdf in whole_runs(batches, [key, "block"]):
            starts, found = [], []
            for a, _, b, _ in opened(pdf):
                starts.append(a)
                found.append(list(zip(*b.map(int(pdf["step"].iat[a])), strict=True)) or [[]] * len(names))
            rows = pdf[[key, "block", "step"]].iloc[starts].rename(columns={"step": "begin"})
            yield rows.assign(**{c: pd.Series([x[i] for x in found], rows.index, object) for i, c in enumerate(names)})

    found = dealt(steps, [key, "block"]).sortWithinPartitions(*order).select(key, "block", "step", "best", "held").mapInPandas(maps, f"{key} {kind}, block long, begin long, camera array<string>, lo array<long>, hi array<long>, after array<string>, free array<long>")
    found = found.join(firsts.select(F.col(key).alias("_cw_key"), "first"), F.col(key).eqNullSafe(F.col("_cw_key"))).drop("_cw_key")

    def compose(state: dict, r: tuple):
        n, begin, camera, lo, hi, after, free, first = r
        if not state:
            state.update(now=first, free=begin + least_steps)
        yield n, state["now"], state["free"]
        wait = max(0, state["free"] - begin)
        own = state["now"] if state["now"] in camera else OTHER
        for c, a, z, to, until in zip(camera, lo, hi, after, free, strict=True):
            if c == own and a <= wait <= z:
                state.update(now=to, free=until)
                break

    used = ["block", "begin", "camera", "lo", "hi", "after", "free", "first"]
    begins = fold_in_order(found, [key], ["block"], dict, compose, lambda _: (), used, "block long, entry string, entry_free long")
    begins = begins.select(F.col(key).alias("_cw_key"), F.col("block").alias("_cw_block"), "entry", "entry_free")
    # Null-safe, so that no filter of one side only keeps Spark from making the steps once for both.
    both = steps.join(begins, F.col(key).eqNullSafe(F.col("_cw_key")) & F.col("block").eqNullSafe(F.col("_cw_block"))).drop("_cw_key", "_cw_block")

    def replay(batches):
        for pdf in whole_runs(batches, [key, "block"]):
            entry = pdf["entry"].to_numpy(object)
            now, before = entry.copy(), entry.copy()
            for a, z, b, places in opened(pdf):
                for at in b.switches(entry[a], int(pdf["entry_free"].iat[a])):
                    now[places[at] : z] = b.best[at]
                    before[places[at] + 1 : z] = b.best[at]
            yield pdf[[key, "step", *carry]].assign(before=before, camera=now)[[key, "step", "before", "camera", *carry]]

    kinds = dict(steps.dtypes)
    schema = ", ".join([f"{key} {kind}", "step long", "before string", "camera string", *(f"{c} {kinds[c]}" for c in carry)])
    both = both.select(*dict.fromkeys([*order, "best", "held", "entry", "entry_free", *carry]))
    return dealt(both, [key, "block"]).sortWithinPartitions(*order).mapInPandas(replay, schema)
