"""Gap-aware operators on irregular signals: (session, t, y) tables, t in seconds.

Nulls mark missing values everywhere; NaN is turned into null at the scan. Look-back and look-ahead are cut into time buckets whose
edges are carried over by a small table, so that one long recording isn't one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = list[str]


def normalise_time(df: DataFrame, keys: Cols, t: str, order: str) -> DataFrame:
    """Epoch milliseconds or seconds, told apart by the first value of a session, to seconds from its start."""
    first = F.first(t).over(Window.partitionBy(*keys).orderBy(order))
    scale = F.when(first > 1e10, F.lit(1000.0)).otherwise(F.lit(1.0))
    return df.withColumn(t, F.col(t) / scale - first / scale)


def gap_after(keys: Cols, t: str) -> Column:
    """Seconds to the next sample of the session; null at its end."""
    return F.lead(t).over(Window.partitionBy(*keys).orderBy(t)) - F.col(t)


def neighbours(df: DataFrame, keys: Cols, t: str, value: Column, width: float) -> DataFrame:
    """Adds `prev` and `next`: the non-null `value` nearest at or before, and at or after, each row's time.

    Rows with equal times see each other. A bucket of `width` seconds is a task's unit; what lies outside comes from a table with a row
    for each bucket.
    """
    df = df.withColumn("__v", value).withColumn("__b", F.floor(F.col(t) / width))
    upwards, downwards = (Window.partitionBy(*keys, "__b").orderBy(order) for order in (F.asc(t), F.desc(t)))
    # both frames grow row by row; a frame that shrinks towards the end is evaluated anew for each row
    df = df.withColumn("__p", F.last("__v", True).over(upwards.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    df = df.withColumn("__n", F.last("__v", True).over(downwards.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    at = F.when(F.col("__v").isNotNull(), F.col(t))
    edges = df.groupBy(*keys, "__b").agg(F.max_by("__v", at).alias("__l"), F.min_by("__v", at).alias("__f"))
    before, after = (Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1) for order in (F.asc("__b"), F.desc("__b")))
    edges = edges.select(*keys, "__b", F.last("__l", True).over(before).alias("__before"), F.last("__f", True).over(after).alias("__after"))
    out = df.join(edges, [*keys, "__b"])
    out = out.withColumn("prev", F.coalesce("__p", "__before")).withColumn("next", F.coalesce("__n", "__after"))
    return out.drop("__v", "__b", "__p", "__n", "__before", "__after")


def lerp(t: Column, t0: Column, y0: Column, t1: Column, y1: Column) -> Column:
    """Linear interpolation; the left value where both times are equal."""
    return F.when(t1 > t0, y0 + (y1 - y0) * (t - t0) / (t1 - t0)).otherwise(y0)


def grid(df: DataFrame, keys: Cols, t: str, step: float, inclusive: bool = False) -> DataFrame:
    """(keys, i, t): each session's regular times from its first to its last sample; the end itself only if inclusive.

    The number of points is ceil((last - first) / step), as a half-open range by steps has; inclusive ranges reach past the end by half a step's rounding.
    """
    span = df.groupBy(*keys).agg(F.min(t).alias("__t0"), F.max(t).alias("__t1"))
    n = F.ceil((F.col("__t1") - F.col("__t0") + (step if inclusive else 0)) / step).cast("int")
    points = span.withColumn("__n", n).filter("__n > 0")
    return points.select(*keys, "__t0", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("i")).select(
        *keys, "i", (F.col("__t0") + F.col("i") * step).alias(t)
    )


def resample(
    df: DataFrame, keys: Cols, t: str, y: str, step: float, gap: float | None, width: float, inclusive: bool = False
) -> DataFrame:
    """(keys, i, t, y, in_gap): linear interpolation on the grid; null and flagged within any closed interval of `gap` or more.

    A grid point exactly on a sample belongs to the intervals on both its sides. Without a gap rule (None) nothing is flagged.
    Null samples take no part. Beyond the last sample there is no value.
    """
    samples = df.filter(F.col(y).isNotNull()).select(*keys, t, y)
    w = Window.partitionBy(*keys).orderBy(t)
    samples = samples.withColumn("__before", F.col(t) - F.lag(t).over(w)).withColumn("__after", F.lead(t).over(w) - F.col(t))
    sample = F.struct(F.col(t).alias("t"), F.col(y).alias("y"), "__before", "__after")
    points = grid(samples, keys, t, step, inclusive)
    both = samples.select(*keys, t, F.lit(None).cast("int").alias("i"), sample.alias("__s")).unionByName(
        points.select(*keys, t, "i", F.lit(None).cast(samples.select(sample.alias("s")).schema["s"].dataType).alias("__s"))
    )
    both = neighbours(both, keys, t, F.col("__s"), width).filter(F.col("i").isNotNull())
    inside = F.col("prev.__after") >= F.lit(gap)
    touching = (F.col("next.t") == F.col(t)) & (F.col("next.__before") >= F.lit(gap))
    in_gap = F.coalesce(inside | touching, F.lit(False)) if gap is not None else F.lit(False)
    value = F.when(
        F.col("next").isNotNull(), lerp(F.col(t), F.col("prev.t"), F.col("prev.y"), F.col("next.t"), F.col("next.y"))
    )
    return both.select(*keys, "i", t, in_gap.alias("in_gap"), F.when(~in_gap, value).alias(y))


def resample_stats(df: DataFrame, gridded: DataFrame, keys: Cols, t: str, y: str) -> DataFrame:
    """n_raw, duration, effective_fs, n_grid, n_nan, n_added of each session."""
    raw = df.filter(F.col(y).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n_raw"), (F.max(t) - F.min(t)).alias("duration"))
    out = gridded.groupBy(*keys).agg(F.count("*").alias("n_grid"), F.count_if(F.col(y).isNull()).alias("n_nan"))
    return raw.join(out, keys).select(
        *keys,
        "n_raw",
        "duration",
        F.try_divide(F.col("n_raw") - 1, F.col("duration")).alias("effective_fs"),
        "n_grid",
        "n_nan",
        F.greatest(F.lit(0), F.col("n_grid") - F.col("n_raw") - F.col("n_nan")).cast("long").alias("n_added"),
    )


def snap(df: DataFrame, keys: Cols, t: str, y: str, step: float, width: float) -> DataFrame:
    """(keys, i, t, y) on 0, step, ... to the session's last row: interpolation of valid samples, null outside them.

    Null, too, where the valid sample at or before the point is followed by a gap of over two steps; the last sample is exempt.
    """
    last = df.groupBy(*keys).agg(F.max(t).alias("__t1"))
    n = F.ceil((F.col("__t1") + step) / step).cast("int")
    points = last.select(*keys, F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select(*keys, "i", (F.col("i") * step).alias(t))
    valid = df.filter(F.col(y).isNotNull()).select(*keys, t, y)
    valid = valid.withColumn("__after", gap_after(keys, t))
    s = F.struct(F.col(t).alias("t"), F.col(y).alias("y"), "__after")
    both = valid.select(*keys, t, F.lit(None).cast("int").alias("i"), s.alias("__s")).unionByName(
        points.select(*keys, t, "i", F.lit(None).cast(valid.select(s.alias("s")).schema["s"].dataType).alias("__s"))
    )
    both = neighbours(both, keys, t, F.col("__s"), width).filter(F.col("i").isNotNull())
    ok = F.col("prev").isNotNull() & F.col("next").isNotNull() & ~F.coalesce(F.col("prev.__after") > 2 * step, F.lit(False))
    value = lerp(F.col(t), F.col("prev.t"), F.col("prev.y"), F.col("next.t"), F.col("next.y"))
    return both.select(*keys, "i", t, F.when(ok, value).alias(y))


def bin_mean(df: DataFrame, keys: Cols, t: str, values: Cols, step: float) -> DataFrame:
    """(keys, bin, values): mean of each bin of `step` from 0; bins between a session's first and last without rows are null."""
    binned = df.withColumn("bin", F.floor(F.col(t) / step)).groupBy(*keys, "bin").agg(*[F.avg(v).alias(v) for v in values])
    span = binned.groupBy(*keys).agg(F.min("bin").alias("__a"), F.max("bin").alias("__b"))
    return span.select(*keys, F.explode(F.sequence("__a", "__b")).alias("bin")).join(binned, [*keys, "bin"], "left")


def fill_linear(df: DataFrame, keys: Cols, position: str, y: str, width: float, both_ends: bool = False) -> DataFrame:
    """Replaces null y by interpolation over `position`; trailing nulls repeat the last value, leading ones stay unless both_ends."""
    s = F.when(F.col(y).isNotNull(), F.struct(F.col(position).alias("t"), F.col(y).alias("y")))
    out = neighbours(df, keys, position, s, width)
    between = lerp(F.col(position), F.col("prev.t"), F.col("prev.y"), F.col("next.t"), F.col("next.y"))
    ends = F.coalesce("prev.y", "next.y") if both_ends else F.col("prev.y")
    value = F.when(F.col("prev").isNotNull() & F.col("next").isNotNull(), between).otherwise(ends)
    return out.withColumn(y, F.coalesce(F.col(y), value)).drop("prev", "next")


def fill_nearest_side(df: DataFrame, keys: Cols, position: str, y: str, width: float) -> DataFrame:
    """Replaces null y by the last value before it, and what comes before the first by that one."""
    out = neighbours(df, keys, position, F.col(y), width)
    return out.withColumn(y, F.coalesce("prev", "next")).drop("prev", "next")


def fill_between(df: DataFrame, keys: Cols, x: str, y: str, known: str, width: float) -> DataFrame:
    """Replaces y where `known` is false by interpolation over x between the known rows beside it; after the last known row its value holds.

    A session whose first row isn't known stays as it is. Between known rows of one x the first one's value holds.
    """
    first = F.min_by(known, x).over(Window.partitionBy(*keys))
    s = F.when(F.col(known), F.struct(F.col(x).alias("t"), F.col(y).alias("y")))
    out = neighbours(df.withColumn("__first", first), keys, x, s, width)
    value = F.when(F.col("next").isNull(), F.col("prev.y")).otherwise(lerp(F.col(x), F.col("prev.t"), F.col("prev.y"), F.col("next.t"), F.col("next.y")))
    return out.withColumn(y, F.when(F.col("__first") & ~F.col(known), value).otherwise(F.col(y))).drop("prev", "next", "__first")


def zscore_rows(df: DataFrame, keys: Cols, columns: Cols, limit: float = 3.0, scores: bool = False) -> DataFrame:
    """Rows whose values all lie within `limit` population deviations of their session's means; with `scores`, those as `z_<column>` too.

    A column of constant or no value isn't judged; a null in a judged one is an outlier.
    """
    w = Window.partitionBy(*keys)
    keep, added = F.lit(True), []
    for c in columns:
        df = df.withColumn(f"z_{c}", F.when(F.stddev_pop(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)))
        judged = F.coalesce(F.stddev_pop(c).over(w) > 0, F.lit(False))
        keep = keep & (~judged | F.coalesce(F.abs(f"z_{c}") < limit, F.lit(False)))
        added.append(f"z_{c}")
    out = df.withColumn("__keep", keep).filter("__keep").drop("__keep")
    return out if scores else out.drop(*added)


def global_z(keys: Cols, y: str) -> Column:
    """z-score over the whole session, by the population deviation; 0 where all values are equal."""
    w = Window.partitionBy(*keys)
    return (F.col(y) - F.avg(y).over(w)) / (F.stddev_pop(y).over(w) + 1e-12)


def gaps(df: DataFrame, keys: Cols, t: str, least: float) -> DataFrame:
    """(keys, start, end, seconds) of each gap of `least` seconds or more between samples."""
    out = df.withColumn("__g", gap_after(keys, t)).filter(F.col("__g") >= least)
    return out.select(*keys, F.col(t).alias("start"), (F.col(t) + F.col("__g")).alias("end"), F.col("__g").alias("seconds"))


def row_index(df: DataFrame, keys: Cols, order: Cols, name: str = "i") -> DataFrame:
    """Numbers a session's rows from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def count_windows(df: DataFrame, keys: Cols, i: str, size: int, step: int) -> DataFrame:
    """Each row once for every full window of `size` rows that holds it; adds `k`, the window's number, from 0.

    Window k has rows step * k to step * k + size - 1; rows are assigned by arithmetic, without a join.
    """
    n = F.floor((F.count("*").over(Window.partitionBy(*keys)) - size) / step) + 1
    first = F.greatest(F.lit(0), F.ceil((F.col(i) - (size - 1)) / step))
    last = F.least(F.floor(F.col(i) / step), n - 1)
    out = df.withColumn("__a", first.cast("long")).withColumn("__b", last.cast("long")).filter("__a <= __b")
    return out.withColumn("k", F.explode(F.sequence("__a", "__b"))).drop("__a", "__b")


def centred(keys: Cols, order: Cols, size: int):
    """Frame of `size` rows around each; an even size has one more before than after."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(size // 2), (size - 1) // 2)


def mad_outliers(df: DataFrame, keys: Cols, order: Cols, y: str, size: int, times: float, floor: float) -> DataFrame:
    """Adds `median`, `mad` and `outlier`: further from the centred rolling median than `times` the rolling median of such distances."""
    frame = centred(keys, order, size)
    out = df.withColumn("median", F.percentile(y, 0.5).over(frame))
    out = out.withColumn("__d", F.abs(F.col(y) - F.col("median")))
    out = out.withColumn("mad", F.greatest(F.percentile("__d", 0.5).over(frame), F.lit(floor)))
    return out.withColumn("outlier", F.coalesce(F.col("__d") > times * F.col("mad"), F.lit(False))).drop("__d")


def dilate(keys: Cols, order: Cols, mask: str, reach: int) -> Column:
    """Whether any row within `reach` rows is marked."""
    return F.max(mask).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach))


def capped(keys: Cols, mask: str, percent: float) -> Column:
    """The mask, or nothing where it would reject more than so many percent of the session."""
    share = F.avg(F.col(mask).cast("int")).over(Window.partitionBy(*keys))
    return F.col(mask) & (share * 100 <= percent)


def rolling_z(keys: Cols, order: Cols, y: str, size: int, least: int = 3) -> Column:
    """Centred rolling z-score with the population deviation; a deviation of 0 counts as 1; null below `least` values."""
    frame = centred(keys, order, size)
    std = F.stddev_pop(y).over(frame)
    z = (F.col(y) - F.avg(y).over(frame)) / F.when(std == 0, F.lit(1.0)).otherwise(std)
    return F.when(F.count(y).over(frame) >= least, z)


def smooth(keys: Cols, order: Cols, y: str, size: int) -> Column:
    """Centred rolling mean."""
    return F.avg(y).over(centred(keys, order, size))


def moving_average(df: DataFrame, keys: Cols, i: str, y: str, size: int, stride: int) -> DataFrame:
    """Means of `size` rows, without the first incomplete ones, every `stride`-th."""
    frame = Window.partitionBy(*keys).orderBy(i).rowsBetween(-(size - 1), 0)
    out = df.withColumn("mean", F.avg(y).over(frame)).filter(F.col(i) >= size - 1)
    return out.filter((F.col(i) - (size - 1)) % stride == 0)


def rank_slice_medians(keys: Cols, order: Cols, y: str, rows: int, low: tuple[float, float], high: tuple[float, float], least: int) -> list[Column]:
    """Medians of two rank slices of the last `rows` values; null until there are `least`."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)
    values = F.array_sort(F.collect_list(y).over(frame))
    n = F.size(values)

    def median(share: tuple[float, float]) -> Column:
        a = F.floor(n * share[0]).cast("int")
        size = F.greatest(F.lit(1), F.floor(n * share[1]).cast("int") - a)
        part = F.slice(values, a + 1, size)
        m = F.size(part)
        mid = (F.element_at(part, F.floor((m + 1) / 2).cast("int")) + F.element_at(part, F.floor(m / 2).cast("int") + 1)) / 2
        return F.when(n >= least, mid)

    return [median(low), median(high)]


def rebase_clock(df: DataFrame, keys: Cols, seq: str) -> DataFrame:
    """Event times to the recording's clock: t - pc + 1, pc the reference time of the last TIMESTAMP row, else of the first row.

    df has ts (double), name, value. A reference row holds the two clocks in either column order; pc is its first.
    """
    w = Window.partitionBy(*keys)
    is_ref = (F.col("name") == "TIMESTAMP") | (F.col("value") == "TIMESTAMP")
    ref = F.max_by(F.when(is_ref, F.col("ts")), F.when(is_ref, F.col(seq))).over(w)
    first = F.min_by("ts", seq).over(w)
    return df.withColumn("ts", F.col("ts") - F.coalesce(ref, first) + 1).filter(~F.coalesce(is_ref, F.lit(False)))
