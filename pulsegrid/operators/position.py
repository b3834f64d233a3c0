"""Positions: satellite fixes on the metric grid, and ranging to fixed antennas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import dsp, scalar
from pulsegrid.operators import timeseries as ts
from pulsegrid.operators.timeseries import Cols

STEP = 0.5
POSITION = "x double, y double, z double"


def gps_grid(fixes: DataFrame, keys: Cols, t: str = "t") -> DataFrame:
    """latitude and longitude every half second from the first fix, without a gap rule.

    Both are resampled in one pass and put side by side by grouping: a join of grids, whose size Spark takes for that of the fixes, may be broadcast.
    """
    columns = ("latitude", "longitude")
    long = fixes.select(*keys, t, F.explode(F.array(*[F.struct(F.lit(c).alias("__c"), F.col(c).cast("double").alias("__y")) for c in columns])).alias("__x"))
    out = ts.resample(long.select(*keys, t, "__x.*"), [*keys, "__c"], t, "__y", STEP, None, 600.0, inclusive=True)
    of = {c: F.col("__c") == c for c in columns}
    values = [F.max(F.when(of[c], F.col("__y"))).alias(c) for c in columns]
    out = out.groupBy(*keys, "i").agg(F.max(F.when(of["latitude"], F.col(t))).alias(t), *values, F.count("*").alias("__n"))
    return out.filter(F.col("__n") == 2).drop("__n")


def solve_three(frames: DataFrame, ants: str = "ants") -> DataFrame:
    """Adds `pos` where three antennas or more were heard: the point that fits their distances best."""

    @F.pandas_udf(POSITION)
    def solve(x: pd.Series) -> pd.DataFrame:
        def one(found):
            if found is None or len(found) < 3:
                return [None] * 3
            c = np.array([[a["x"], a["y"], a["z"]] for a in found], float)
            return dsp.multilaterate(c, np.array([a["dist"] for a in found], float))

        return pd.DataFrame([one(f) for f in x], columns=["x", "y", "z"])

    return frames.withColumn("pos", F.when(F.size(ants) >= 3, solve(F.col(ants))))


def guesses(frames: DataFrame, keys: Cols, order: str, prefer_next: bool = False) -> DataFrame:
    """Adds `guess`: the solved position nearest in time; prefer_next takes the later one whenever there is one."""
    s = F.when(F.col("pos").isNotNull(), F.struct(F.col(order).alias("t"), F.col("pos").alias("p")))
    tie = F.xxhash64("ants")  # frames of one time have the same order both ways
    one_way, other = (Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1) for by in ((F.asc(order), tie.asc()), (F.desc(order), tie.desc())))
    out = frames.withColumn("__b", F.last(s, True).over(one_way)).withColumn("__a", F.last(s, True).over(other))
    back = F.col("__a").isNull() | (F.lit(not prefer_next) & (F.col(order) - F.col("__b.t") < F.col("__a.t") - F.col(order)))
    return out.withColumn("guess", F.when(back, F.col("__b.p")).otherwise(F.col("__a.p"))).drop("__a", "__b")


def solve_two(frames: DataFrame, keys: Cols, order: str, ants: str = "ants") -> DataFrame:
    """Solves frames of two antennas from the nearest solved position; a distance of 0 counts as 1e-10."""

    @F.pandas_udf(POSITION)
    def solve(x: pd.Series, guess: pd.DataFrame) -> pd.DataFrame:
        def one(found, g):
            if found is None or len(found) != 2 or np.isnan(g).any():
                return [None] * 3
            c = np.array([[a["x"], a["y"], a["z"]] for a in found], float)
            return dsp.multilaterate(c, np.maximum([a["dist"] for a in found], 1e-10), g)

        return pd.DataFrame([one(f, g) for f, g in zip(x, guess[["x", "y", "z"]].to_numpy(float))], columns=["x", "y", "z"])

    g = guesses(frames, keys, order)
    known = F.coalesce("guess", F.struct(*[F.lit(float("nan")).alias(n) for n in "xyz"]))
    solved = solve(F.col(ants), known)
    two = F.col("pos").isNull() & (F.size(ants) == 2) & F.col("guess").isNotNull()
    return g.withColumn("pos", F.when(two, solved).otherwise(F.col("pos"))).drop("guess")


def solve_one(frames: DataFrame, keys: Cols, order: str, ants: str = "ants") -> DataFrame:
    """Frames of one antenna take the point of its circle nearest to the guess, at the guess's height."""
    g = guesses(frames, keys, order)
    a = F.element_at(ants, 1)
    x, y = scalar.project_to_circle(F.col("guess.x"), F.col("guess.y"), a["x"], a["y"], a["dist"])
    one = F.col("pos").isNull() & (F.size(ants) == 1) & F.col("guess").isNotNull() & x.isNotNull()
    return g.withColumn("pos", F.when(one, F.struct(x.alias("x"), y.alias("y"), F.col("guess.z").alias("z"))).otherwise(F.col("pos"))).drop("guess")


def positions(frames: DataFrame, keys: Cols, order: str, floors: list[tuple[list[str], float]] = ()) -> DataFrame:
    """(keys, t, x, y, z) by the three passes; frames that none solves are left out."""
    out = solve_one(solve_two(solve_three(frames), keys, order), keys, order).filter("pos is not null")
    z = scalar.floor_height(F.transform("ants", lambda a: a["id"]), list(floors), F.col("pos.z"))
    return out.select(*keys, order, "pos.x", "pos.y", z.alias("z"))


def antennas(frames: DataFrame, keys: Cols, order: str) -> DataFrame:
    """Distinct antennas of frames with three or more, with the time at which each is first heard."""
    seen = frames.filter(F.size("ants") >= 3).select(*keys, order, F.explode("ants").alias("a")).select(*keys, order, "a.id", "a.x", "a.y", "a.z")
    return seen.groupBy(*keys, "id", "x", "y", "z").agg(F.min(order).alias("first_t"))
