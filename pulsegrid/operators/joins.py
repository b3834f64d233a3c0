"""Interval, containment, as-of, positional and nearest-neighbour joins, without nested loops over large sides."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.timeseries import Cols, neighbours

#: Rows up to which a dimension (zones, models) is sent to every task; a larger one is joined by a shuffle.
BROADCAST_ROWS = 10_000
#: Vectors of either side in a block of the nearest-neighbour join.
BLOCK_ROWS = 5_000


def interval_last_wins(
    rows: DataFrame, events: DataFrame, keys: Cols, t: str, start: str, end: str, seq: str, tag: str, width: float, excluded: Cols = ()
) -> DataFrame:
    """rows with the `tag` of the event whose closed interval holds their time; of several the last by `seq`, null if none.

    Events are dealt to buckets of `width`, a long one to all that it touches, so the join is an equi-join.
    """
    spans = events.filter(F.col(start) <= F.col(end))
    spans = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    span = F.struct(F.col(seq).alias("q"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(tag).alias("tag"))
    spans = spans.groupBy(*keys, "__b").agg(F.array_sort(F.collect_list(span)).alias("__spans"))
    out = rows.withColumn("__b", F.floor(F.col(t) / width)).join(spans, [*keys, "__b"], "left")
    holding = F.filter("__spans", lambda x: (F.col(t) >= x["s"]) & (F.col(t) <= x["e"]))
    out = out.withColumn(tag, F.try_element_at(holding, F.lit(-1))["tag"]).drop("__b", "__spans")
    return out.filter(F.col(tag).isNotNull() & ~F.col(tag).isin(list(excluded))) if excluded else out


def containment_last_wins(points: DataFrame, zones: DataFrame, seq: str, label: str, y_only: bool = False) -> DataFrame:
    """points(x, y) with the label of the rectangle zones(x, y, w, h) that holds them, edges included; of several the last by `seq`.

    y_only tests the second coordinate alone, as older results were made.
    """
    if zones.count() > BROADCAST_ROWS:
        return _contained_by_cells(points, zones, seq, label, y_only)
    z = zones.select(F.struct(seq, F.col("x").alias("zx"), F.col("y").alias("zy"), "w", "h", label).alias("z"))
    z = F.broadcast(z.agg(F.array_sort(F.collect_list("z")).alias("__zones")).withColumn("__one", F.lit(1)))
    inside = lambda r: (F.lit(True) if y_only else F.col("x").between(r["zx"], r["zx"] + r["w"])) & F.col("y").between(r["zy"], r["zy"] + r["h"])
    found = F.filter("__zones", inside)
    out = points.withColumn("__one", F.lit(1)).join(z, "__one", "left")
    return out.withColumn(label, F.try_element_at(found, F.lit(-1))[label]).drop("__zones", "__one")


def _contained_by_cells(points: DataFrame, zones: DataFrame, seq: str, label: str, y_only: bool) -> DataFrame:
    """The same for many zones: they are dealt to the cells of a lattice of their mean size, and points meet those of their cell."""
    mean = zones.agg(F.avg("w"), F.avg("h")).first()
    w, h = (m if m and m > 0 else 1.0 for m in mean)
    cells = lambda a, size, step: F.explode(F.sequence(F.floor(F.col(a) / step), F.floor((F.col(a) + F.col(size)) / step)))
    z = zones.withColumn("__cx", F.lit(0) if y_only else cells("x", "w", w)).withColumn("__cy", cells("y", "h", h))
    z = z.groupBy("__cx", "__cy").agg(F.array_sort(F.collect_list(F.struct(seq, "x", "y", "w", "h", label))).alias("__zones"))
    at = points.withColumn("__cx", F.lit(0) if y_only else F.floor(F.col("x") / w)).withColumn("__cy", F.floor(F.col("y") / h))
    inside = lambda r: (F.lit(True) if y_only else F.col("x").between(r["x"], r["x"] + r["w"])) & F.col("y").between(r["y"], r["y"] + r["h"])
    out = at.join(z, ["__cx", "__cy"], "left")
    return out.withColumn(label, F.try_element_at(F.filter("__zones", inside), F.lit(-1))[label]).drop("__cx", "__cy", "__zones")


def as_of(rows: DataFrame, other: DataFrame, keys: Cols, t: str, value: Column, width: float) -> DataFrame:
    """rows with `prev_value`, `next_value` and `nearest_value` of another table by time, by a union and windows instead of a join.

    Equal distances go to the later one.
    """
    s = F.struct(F.col(t).alias("t"), value.alias("v"))
    kind = other.select(s.alias("s")).schema["s"].dataType
    mine = rows.select(*keys, F.col(t), F.struct(*rows.columns).alias("__row"), F.lit(None).cast(kind).alias("__s"))
    theirs = other.select(*keys, F.col(t), F.lit(None).cast(mine.schema["__row"].dataType).alias("__row"), s.alias("__s"))
    both = neighbours(mine.unionByName(theirs), keys, t, F.col("__s"), width).filter(F.col("__row").isNotNull())
    nearer_prev = F.col("next").isNull() | (F.col(t) - F.col("prev.t") < F.col("next.t") - F.col(t))
    return both.select(
        "__row.*",
        F.col("prev.v").alias("prev_value"),
        F.col("next.v").alias("next_value"),
        F.when(nearer_prev, F.col("prev.v")).otherwise(F.col("next.v")).alias("nearest_value"),
    )


def look_back_windows(ticks: DataFrame, points: DataFrame, keys: Cols, t: str, p: str, length: float) -> DataFrame:
    """Each tick with the points in [t - length, t]: an equi-join on buckets as long as the window, two for each point."""
    b = F.floor(F.col(p) / length)
    dealt = points.withColumn("__b", F.explode(F.array(b, b + 1)))
    at = ticks.withColumn("__b", F.floor(F.col(t) / length))
    return at.join(dealt, [*keys, "__b"]).filter((F.col(p) <= F.col(t)) & (F.col(p) >= F.col(t) - length)).drop("__b")


def masked_in_span(df: DataFrame, keys: Cols, i: str, mask: str) -> DataFrame:
    """Adds `masked_before`: how many rows before this one are masked. The masked rows of a span are a difference of two."""
    w = Window.partitionBy(*keys).orderBy(i).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("masked_before", F.coalesce(F.sum(F.col(mask).cast("long")).over(w), F.lit(0)))


def masked_in_windows(windows: DataFrame, df: DataFrame, keys: Cols, i: str, mask: str, a: str, b: str) -> DataFrame:
    """windows with `n_masked`, the masked rows of df numbered `a` to `b`, both included and within the session's rows: a difference of two prefix sums."""
    sums = masked_in_span(df.select(*keys, F.col(i).alias("__i"), F.col(mask).alias("__m")), keys, "__i", "__m")
    ends = df.groupBy(*keys).agg(F.min(i).alias("__first"), F.max(i).alias("__last"))
    out = windows.join(ends, keys).withColumn("__a", F.greatest(F.col(a), "__first")).withColumn("__b", F.least(F.col(b), "__last"))
    before = sums.select(*keys, F.col("__i").alias("__a"), F.col("masked_before").alias("__before"))
    through = sums.select(*keys, F.col("__i").alias("__b"), (F.col("masked_before") + F.col("__m").cast("long")).alias("__through"))
    out = out.join(before, [*keys, "__a"], "left").join(through, [*keys, "__b"], "left")
    inside = F.when(F.col("__a") <= F.col("__b"), F.col("__through") - F.col("__before")).otherwise(F.lit(0))
    return out.withColumn("n_masked", inside).drop("__a", "__b", "__first", "__last", "__before", "__through")


def outside_masked(points: DataFrame, masked: DataFrame, on: Cols) -> DataFrame:
    """points whose place (session, or session and sample) isn't among the masked ones."""
    return points.join(masked.select(*on).distinct(), on, "left_anti")


def positional(left: DataFrame, right: DataFrame, keys: Cols, left_order: Cols, right_order: Cols) -> DataFrame:
    """Row n of one table beside row n of the other; the shorter one is filled with nulls."""
    a = left.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*left_order)))
    b = right.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*right_order)))
    return a.join(b, [*keys, "n"], "full")


def fuse(tables: list[DataFrame], keys: Cols, t: str, step: float) -> DataFrame:
    """Metric tables side by side on the shared grid of `step`."""
    on = [*keys, "__tick"]
    ticked = [d.withColumn("__tick", F.rint(F.col(t) / step).cast("long")).drop(t) for d in tables]
    out = ticked[0]
    for d in ticked[1:]:
        out = out.join(d, on, "full")
    return out.withColumn(t, F.col("__tick") * step).drop("__tick")


def knn_vote(queries: DataFrame, training: DataFrame, query_id: str, vector: str, train_id: str, label: str, k: int, precision: list[list[float]] | None = None) -> DataFrame:
    """(query_id, label, share): the k nearest training vectors' labels; Mahalanobis distance with a precision matrix, else Euclidean.

    A small training table is gathered in one row, whose size is checked, and each query is compared within its row; a larger one is compared in
    blocks, each giving its k best, which are then merged. Ties go to the smaller id. Rows without a vector are left out; a query's id is its own.
    """
    queries, training = queries.filter(F.col(vector).isNotNull()), training.filter(F.col(vector).isNotNull())
    n = training.count()
    if n > BROADCAST_ROWS:
        return _voted_by_blocks(queries, training, n, query_id, vector, train_id, label, k, precision)
    model = training.agg(F.collect_list(F.struct(F.col(train_id).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))).alias("__m"))

    def distance(v: Column) -> Column:
        d = F.zip_with(F.col(vector), v, lambda a, b: a.cast("double") - b.cast("double"))
        if precision is None:
            return F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)
        rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in precision])
        dot = lambda r: F.aggregate(F.zip_with(r, d, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return F.aggregate(F.zip_with(F.transform(rows, dot), d, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    ranked = F.transform("__m", lambda m: F.struct(distance(m["v"]).alias("d"), m["id"].alias("id"), m["label"].alias("label")))
    out = queries.withColumn("__one", F.lit(1)).join(F.broadcast(model.withColumn("__one", F.lit(1))), "__one")
    out = out.select(query_id, F.explode(F.slice(F.array_sort(ranked), 1, k)).alias("n"))
    return out.groupBy(query_id, F.col("n.label").alias(label)).agg((F.count("*") / k).alias("share"))


def _voted_by_blocks(
    queries: DataFrame, training: DataFrame, n: int, query_id: str, vector: str, train_id: str, label: str, k: int, precision: list[list[float]] | None
) -> DataFrame:
    """The same for many training vectors: every block of them meets every block of queries."""
    parts, own = -(-n // BLOCK_ROWS), max(1, -(-queries.count() // BLOCK_ROWS))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = lambda name, m: F.pmod(F.xxhash64(name), F.lit(m)).cast("int")
    v = F.transform(vector, lambda x: x.cast("double")).alias("v")
    asked = queries.select(F.col(query_id).alias("q"), v, block(query_id, own).alias("a"), numbers(parts).alias("b"))
    known = training.select(F.col(train_id).alias("id"), F.col(label).alias("label"), v, block(train_id, parts).alias("b"), numbers(own).alias("a"))
    kind = lambda d, c: f"{c} {d.schema[c].dataType.simpleString()}"
    best = asked.groupBy("a", "b").cogroup(known.groupBy("a", "b")).applyInPandas(
        _best_of_block(k, precision), f"{kind(asked, 'q')}, {kind(known, 'id')}, {kind(known, 'label')}, d double"
    )
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "id", "label"))
    best = best.withColumn("r", rank).filter(F.col("r") <= k)
    return best.groupBy(F.col("q").alias(query_id), F.col("label").alias(label)).agg((F.count("*") / k).alias("share"))


def _best_of_block(k: int, precision: list[list[float]] | None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values(["id", "label"], na_position="first")
        found: list[pd.DataFrame] = []
        x = np.stack(known.v.to_list()).astype(float) if len(known) else np.zeros((0, 0))
        for q, v in zip(asked.q, asked.v) if len(known) else ():
            d = x - np.asarray(v, float)
            d = ((d @ np.array(precision, float).T if precision is not None else d) * d).sum(1)
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
            near = near[np.argsort(d[near], kind="stable")[:k]]
            found.append(pd.DataFrame({"q": q, "id": known.id.to_numpy()[near], "label": known.label.to_numpy()[near], "d": d[near]}))
        return pd.concat(found) if found else pd.DataFrame({"q": [], "id": [], "label": [], "d": []})

    return run
