"""Aggregates of signals, windows and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.timeseries import Cols

EPS = 1e-8


def rms(y: str) -> Column:
    return F.sqrt(F.avg(F.col(y) * F.col(y)))


def null_fraction(y: str) -> Column:
    return F.avg(F.col(y).isNull().cast("int"))


def bands_wide(df: DataFrame, keys: Cols, band: str, power: str, bands: Cols) -> DataFrame:
    """Mean power of each band, a column each; windows whose powers are all null stay, as rows of nulls."""
    return df.groupBy(*keys).pivot(band, bands).agg(F.avg(power))


def cognition(beta: Column, alpha: Column, theta: Column) -> dict[str, Column]:
    """Engagement, focus and load of mean band powers."""
    return {
        "engagement": beta / (alpha + theta + EPS),
        "focus": beta / (alpha + EPS),
        "cognitive_load": theta * beta / (alpha * alpha + EPS),
    }


def lateralization(left: Column, right: Column) -> Column:
    return F.ln(F.greatest(left, F.lit(1e-12))) - F.ln(F.greatest(right, F.lit(1e-12)))


def relative(bands: Cols) -> dict[str, Column]:
    """Each band's share of all bands' power."""
    whole = sum((F.col(b) for b in bands[1:]), F.col(bands[0]))
    return {f"rel_{b}": F.col(b) / (whole + 1e-12) for b in bands}


def epoch_causes(df: DataFrame, keys: Cols, i: str, y: str, size: int, max_null: float, peak: float, ptp: float) -> DataFrame:
    """(keys, epoch, n, cause): the first cause that rejects a full epoch of `size` rows, in the order nan, peak_amp, ptp."""
    e = df.withColumn("epoch", F.floor(F.col(i) / size)).groupBy(*keys, "epoch")
    e = e.agg(F.count("*").alias("n"), null_fraction(y).alias("f"), F.max(F.abs(y)).alias("p"), (F.max(y) - F.min(y)).alias("r"))
    cause = F.when(F.col("n") < size, None).when(F.col("f") > max_null, "nan").when(F.col("p") > peak, "peak_amp").when(F.col("r") > ptp, "ptp")
    return e.select(*keys, "epoch", "n", cause.alias("cause"))


def artefact_stats(epochs: DataFrame, keys: Cols, causes: Cols = ("nan", "peak_amp", "ptp", "emg_ratio")) -> DataFrame:
    """Counts and percentages (one decimal) of rejected epochs and flagged samples of each session."""
    bad = F.col("cause").isNotNull()
    flagged = F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0))
    return epochs.groupBy(*keys).agg(
        F.count("*").alias("n_epochs_total"),
        F.count_if(bad).alias("n_epochs_rejected"),
        F.round(100 * F.count_if(bad) / F.count("*"), 1).alias("pct_epochs_rejected"),
        *[F.count_if(F.col("cause") == c).alias(f"n_rejected_by_{c}") for c in causes],
        flagged.cast("long").alias("n_samples_flagged"),
        F.round(100 * flagged / F.sum("n"), 1).alias("pct_samples_flagged"),
    )


def hrv(ibi: str, delta: str) -> dict[str, Column]:
    """Heart-rate variability of a group of inter-beat intervals (ms) and their successive differences."""
    mean, sd = F.avg(ibi), F.stddev_samp(ibi)
    rmssd = F.sqrt(F.avg(F.col(delta) * F.col(delta)))
    return {
        "mean_hr": 60000 / mean,
        "mean_nn": mean,
        "sdnn": sd,
        "rmssd": rmssd,
        "pnn50": 100 * F.count_if(F.abs(delta) > 50) / F.count(delta),
        "cvsd": rmssd / mean,
        "cvnn": sd / mean,
    }


def rank_slice_baseline(df: DataFrame, keys: Cols, y: str, low=(0.02, 0.30), high=(0.30, 0.60)) -> DataFrame:
    """Medians of two rank slices of a session's values, and their difference, `scale`."""
    w = Window.partitionBy(*keys)
    ranked = df.filter(F.col(y).isNotNull()).withColumn("__r", F.row_number().over(w.orderBy(y)) - 1).withColumn("__n", F.count("*").over(w))

    def median(share):
        inside = (F.col("__r") >= F.floor(F.col("__n") * share[0])) & (F.col("__r") < F.floor(F.col("__n") * share[1]))
        return F.percentile(F.when(inside, F.col(y)), 0.5)

    out = ranked.groupBy(*keys).agg(median(low).alias("low"), median(high).alias("high"))
    return out.withColumn("scale", F.greatest(F.col("high") - F.col("low"), F.lit(EPS)))


def clipped_log_stats(df: DataFrame, keys: Cols, y: str, floor: float) -> DataFrame:
    """Mean and population variance of ln(y + eps), clipped to the 1st and 99th percentile; the variance floored."""
    logs = df.withColumn("__l", F.ln(F.col(y) + EPS))
    bounds = logs.groupBy(*keys).agg(F.percentile("__l", F.array(F.lit(0.01), F.lit(0.99))).alias("__b"))
    clipped = logs.join(bounds, keys).withColumn("__c", F.greatest(F.least(F.col("__l"), F.col("__b")[1]), F.col("__b")[0]))
    return clipped.groupBy(*keys).agg(F.avg("__c").alias("mean"), F.greatest(F.var_pop("__c"), F.lit(floor)).alias("variance"))


def five_numbers(y: str) -> Column:
    """Minimum, quartiles and maximum of finite values, by linear interpolation."""
    x = F.when(~F.isnan(y) & (F.abs(y) < float("inf")), F.col(y))
    return F.percentile(x, F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))


def errors(new: str, old: str) -> dict[str, Column]:
    """Mean absolute and root-mean-square difference, over rows with both."""
    d = F.col(new) - F.col(old)
    return {"mae": F.avg(F.abs(d)), "rmse": F.sqrt(F.avg(d * d))}


def session_duration(df: DataFrame, keys: Cols, t: str, order: str) -> DataFrame:
    """Last row's time less the first's, in seconds rounded to halves, ties to even."""
    span = F.max_by(t, order) - F.min_by(t, order)
    return df.groupBy(*keys).agg((F.rint(span * 2) / 2).alias("duration"))


def first_seen(df: DataFrame, what: Cols, seq: str) -> DataFrame:
    """Distinct rows with the place at which each is first seen."""
    return df.groupBy(*what).agg(F.min(seq).alias("first_seq"))


def table_summary(df: DataFrame, t: str, values: Cols, keys: Cols = ["session_id"]) -> DataFrame:
    """(keys, t_min, t_max, step, y_min, y_max) of each session's metric table: times, median step, and the range of finite values widened by 8 %."""
    steps = df.withColumn("__step", F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t)))
    finite = F.array(*[F.when(~F.isnan(v) & (F.abs(v) < float("inf")), F.col(v)) for v in values])
    out = steps.withColumn("__low", F.array_min(finite)).withColumn("__high", F.array_max(finite)).groupBy(*keys)
    out = out.agg(F.min(t).alias("t_min"), F.max(t).alias("t_max"), F.percentile("__step", 0.5).alias("step"), F.min("__low").alias("low"), F.max("__high").alias("high"))
    margin = 0.08 * (F.col("high") - F.col("low"))
    return out.select(*keys, "t_min", "t_max", "step", (F.col("low") - margin).alias("y_min"), (F.col("high") + margin).alias("y_max"))
