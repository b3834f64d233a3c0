"""Two-stage classification of muscle activity, with model parameters as data."""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections import deque
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import dsp, scalar
from pulsegrid.operators import joins
from pulsegrid.operators import timeseries as ts
from pulsegrid.operators.aggregates import EPS, rms
from pulsegrid.operators.timeseries import Cols

NEUTRAL = "Neutral"
#: Classes in output order, the gates of the packaged model versions, and the weights of the ensemble.
EMOTIONS = ["Happiness", "Anger", "Surprise", "Contempt", "Disgust", "Fear", "Sadness"]
GATES = {"v11": 14.689611, "v12": 14.678857}
FEATURES = ["HEAD_R_RMS", "HEAD_L_RMS", "CHEEK_R_RMS", "CHEEK_L_RMS", "EAR_R_RMS", "FOREHEAD_L_RMS", "BROW_RMS", "NOSE_RMS", "AVG_RMS"]
LDA_SHARE, KNN_SHARE, NEIGHBOURS = 0.6, 0.4, 7
RATE, WINDOW_ROWS, STEP_ROWS, BAND = 250.0, 250, 125, (15.0, 45.0)


@dataclass(frozen=True)
class Model:
    """Stage 1: a linear score of activity; stage 2: linear scores of the classes and nearest neighbours.

    precision: the inverse covariance of the neighbours' Mahalanobis distance; None is Euclidean. gate: largest mean RMS of a window that isn't an
    artefact, None for no gate; cooldown: windows gated after one.
    """

    active_coef: list[float]
    active_intercept: float
    class_coef: list[list[float]]
    class_intercept: list[float]
    classes: list[str] = field(default_factory=lambda: list(EMOTIONS))
    gate: float | None = GATES["v12"]
    cooldown: int = 0
    precision: list[list[float]] | None = None
    features: list[str] = field(default_factory=lambda: list(FEATURES))
    lda_share: float = LDA_SHARE
    knn_share: float = KNN_SHARE
    neighbours: int = NEIGHBOURS
    threshold: float = 0.5

    @property
    def all_classes(self) -> list[str]:
        """Neutral, then the classes."""
        return [NEUTRAL, *self.classes]

    @property
    def gated(self) -> bool:
        """Whether windows are gated at all."""
        return self.gate is not None


@dataclass(frozen=True)
class TrainingConfig:
    """How a model's training data are cut: trials, and windows side by side within them; and the labels recorded."""

    trial_seconds: float = 6.0
    window_seconds: float = 1.5
    unit_vectors: bool = True
    #: The labels as recorded.
    labels: tuple[str, ...] = (
        "NEUTRAL", "HAPPY", "ANGER", "SURPRISE", "CONTEMPT-L", "CONTEMPT-R", "DISGUST", "FEAR", "SADNESS", "BLINKS", "JAW_CLENCH", "HEAD_UP", "HEAD_DOWN",
    )

    @property
    def windows(self) -> int:
        """Windows of a trial."""
        return int(self.trial_seconds / self.window_seconds)


#: Files of a model's folder. parameters.json holds the linear scores and the precision matrix, neighbours.parquet the training
#: vectors (id, vector, label); the gate's file is optional, and without it nothing is gated.
MODEL_FILES = ("parameters.json", "feature_columns.json", "config.json")
GATE_FILE, NEIGHBOUR_TABLE = "artefact_config.json", "neighbours.parquet"


def _json_file(spark: SparkSession, path: str) -> dict | list | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def load_model(spark: SparkSession, folder: str, cooldown: int = 0, gate: float | None = None) -> tuple[Model, DataFrame | None]:
    """The model in a folder and its training vectors; a given `gate` replaces that of the folder where there is one. FileNotFoundError names a missing file.

    All are parameters as data; serialised objects of other libraries, which would run code as they are read, aren't.
    """
    found = {name: _json_file(spark, f"{folder}/{name}") for name in (*MODEL_FILES, GATE_FILE)}
    for name in MODEL_FILES:
        if found[name] is None:
            raise FileNotFoundError(f"{folder}/{name}")
    own, config, art = found["parameters.json"], found["config.json"], found[GATE_FILE]
    if art is None:
        limit = None
    else:
        limit = float(gate) if gate is not None else float(art["threshold"])
    model = Model(
        own["active_coef"], own["active_intercept"], own["class_coef"], own["class_intercept"], own.get("classes") or config["stage2_classes"], limit,
        max(0, int(cooldown)), own.get("precision"), found["feature_columns.json"], config.get("lda_ensemble_weight", LDA_SHARE),
        config.get("knn_ensemble_weight", KNN_SHARE), config.get("knn_k", NEIGHBOURS), config.get("theta", 0.5),
    )
    table = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{NEIGHBOUR_TABLE}")
    there = table.getFileSystem(spark._jsc.hadoopConfiguration()).exists(table)
    return model, spark.read.parquet(f"{folder}/{NEIGHBOUR_TABLE}") if there else None


def cooldown(keys: Cols, order: Cols, artefact: str, windows: int) -> Column:
    """Whether a window or any of the `windows` before it is an artefact."""
    if windows == 0:
        return F.col(artefact)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-windows, -1)
    return F.col(artefact) | F.coalesce(F.max(artefact).over(before), F.lit(False))


def causal_band(batches_key: Cols, order: str, channels: Cols):
    """A grouped function: 4th-order 15 to 45 Hz band-pass from the steady state of the first sample; missing samples count as 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        b, a = dsp.butter(4, BAND, RATE, "band")
        x = pdf[channels].fillna(0.0).to_numpy(float)
        y, _ = dsp.lfilter(b, a, x, dsp.steady_state(b, a)[:, None] * x[:1])
        return pdf.assign(**{c: y[:, j] for j, c in enumerate(channels)})

    return run


def window_features(df: DataFrame, keys: Cols, i: str, t: str, channels: Cols, max_null: float = 0.10) -> DataFrame:
    """(keys, k, t, channels): RMS of the filtered signal in windows of a second, every half second; null with too much missing."""
    missing = df.select(*keys, i, t, *[F.col(c).isNull().cast("double").alias(f"__m_{c}") for c in channels])
    clean = df.select(*keys, i, *channels)
    schema = clean.schema
    filtered = clean.groupBy(*keys).applyInPandas(causal_band(keys, i, channels), schema)
    both = filtered.join(missing, [*keys, i])
    w = ts.count_windows(both, keys, i, WINDOW_ROWS, STEP_ROWS).groupBy(*keys, "k")
    bad = sum((F.avg(f"__m_{c}") for c in channels[1:]), F.avg(f"__m_{channels[0]}")) / len(channels) > max_null
    return w.agg(F.percentile(t, 0.5).alias(t), *[F.when(~bad, rms(c)).alias(c) for c in channels])


def feature_vector(channels: Cols) -> Column:
    """Unit vector of the channels' RMS, and their mean."""
    return scalar.l2_with_mean(F.array(*channels))


def infer(df: DataFrame, keys: Cols, order: Cols, features: str, model: Model, knn: DataFrame | None = None, row_id: str | Cols = "k") -> DataFrame:
    """Adds gated, p_active, a probability for Neutral and each class, label and confidence. Null features give nulls.

    A gated window is Neutral for certain. Otherwise p_active comes from stage 1, and the classes' probabilities from the ensemble, times p_active;
    below the model's threshold the label is Neutral with the rest as confidence, else the likeliest class with the ensemble's own probability.
    knn: votes (row_id, label, share) of the nearest neighbours, as knn_vote() gives; absent classes count 0.
    """
    artefact = F.coalesce(F.element_at(features, -1) > model.gate, F.lit(False)) if model.gated else F.lit(False)
    df = df.withColumn("__art", artefact)
    df = df.withColumn("gated", cooldown(keys, order, "__art", model.cooldown)).drop("__art")
    return scored(df, features, model, knn, row_id)


def scored(df: DataFrame, features: str, model: Model, knn: DataFrame | None = None, row_id: str | Cols = "k") -> DataFrame:
    """infer() for rows that have `gated` already: expressions on single rows, so they run on streams too."""
    size, f = len(model.active_coef), F.col(features)
    checked = F.when(f.isNull() | (F.size(f) == size), f).otherwise(F.raise_error(F.lit(f"a feature vector needs {size} values")))
    df = df.withColumn("__f", checked)
    active = 1 / (1 + F.exp(-(scalar.dot(F.col("__f"), model.active_coef) + model.active_intercept)))
    lda = scalar.softmax([scalar.dot(F.col("__f"), c) + b for c, b in zip(model.class_coef, model.class_intercept)])
    if knn is not None:
        on = [row_id] if isinstance(row_id, str) else list(row_id)
        votes = knn.groupBy(*on).pivot("label", model.classes).agg(F.first("share"))
        df = df.join(votes.select(*on, *[F.col(f"`{c}`").alias(f"__k_{c}") for c in model.classes]), on, "left")
        ens = [model.lda_share * p + model.knn_share * F.coalesce(f"__k_{c}", F.lit(0.0)) for p, c in zip(lda, model.classes)]
    else:
        ens = lda
    df = df.withColumn("p_active", F.when(F.col("__f").isNull(), None).when(F.col("gated"), 0.0).otherwise(active)).withColumn("__e", F.array(*ens))
    quiet = F.col("gated") | (F.col("p_active") < model.threshold)
    best = F.array_max("__e")
    names = F.array(*[F.lit(c) for c in model.classes])
    out = df.withColumn(NEUTRAL, 1 - F.col("p_active"))
    for j, c in enumerate(model.classes):
        out = out.withColumn(c, F.col("p_active") * F.when(F.col("gated"), 0.0).otherwise(F.col("__e")[j]))
    label = F.when(quiet, F.lit(NEUTRAL)).otherwise(F.element_at(names, F.array_position("__e", best).cast("int")))
    out = out.withColumn("label", F.when(F.col("p_active").isNotNull(), label))
    out = out.withColumn("confidence", F.when(F.col("p_active").isNotNull(), F.when(quiet, 1 - F.col("p_active")).otherwise(best)))
    return out.drop("__f", "__e", *[f"__k_{c}" for c in model.classes])


def ensemble(df: DataFrame, keys: Cols, order: Cols, features: str, model: Model, training: DataFrame) -> DataFrame:
    """infer() with the votes of the nearest training vectors (id, vector, label), looked up here."""
    asked = df.select(F.struct(*keys, *order).alias("__q"), F.col(features).alias("vector")).filter("vector is not null")
    votes = joins.knn_vote(asked, training, "__q", "vector", "id", "label", model.neighbours, model.precision)
    votes = votes.select("__q.*", "label", "share")
    return infer(df, keys, order, features, model, votes, [*keys, *order])


def features_from_map(values: Column, names: Cols) -> Column:
    """A feature vector from a map of names; absent ones count as 0."""
    return F.array(*[F.coalesce(F.try_element_at(values, F.lit(n)), F.lit(0.0)) for n in names])


def rescored(rms_table: DataFrame, keys: Cols, t: str, channels: Cols, model: Model, training: DataFrame | None = None) -> DataFrame:
    """Inference on a stored RMS table, without its raw signal; windows with a missing channel give nulls and stay."""
    complete = F.col(channels[0]).isNotNull()
    for c in channels[1:]:
        complete = complete & F.col(c).isNotNull()
    df = rms_table.withColumn("features", F.when(complete, feature_vector(channels)))
    return infer(df, keys, [t], "features", model) if training is None else ensemble(df, keys, [t], "features", model, training)


def argmax_labels(df: DataFrame, keys: Cols, classes: Cols) -> DataFrame:
    """(keys, emotion, p, active): long form; every class with the row's largest probability is active."""
    top = F.greatest(*classes)
    pairs = F.array(*[F.struct(F.lit(c).alias("emotion"), F.col(c).alias("p")) for c in classes])
    return df.select(*keys, top.alias("__top"), F.explode(pairs).alias("x")).select(*keys, "x.emotion", "x.p", (F.col("x.p") == F.col("__top")).alias("active"))


def repair_channel(df: DataFrame, keys: Cols, i: str, target: str, coef: dict[str, float | Decimal], intercept: float, width: float) -> DataFrame:
    """One channel from the others by regression, values outside 0 to 30 filled linearly. A Decimal times a whole number is exact, as in SQL."""
    score = F.lit(intercept)
    for c, w in coef.items():
        score = score + F.col(c) * w
    return ts.fill_linear(df.withColumn(target, scalar.within(score)), keys, i, target, width)


def offline_calibrated(df: DataFrame, channels: Cols, stats: dict[str, dict[str, float]], low: float, scale: float) -> DataFrame:
    """Direction (a unit vector of standardised log RMS) and energy (a sigmoid) by fixed parameters of the session."""
    logs = {c: F.greatest(F.least(F.ln(F.col(c) + EPS), F.lit(stats[c]["high"])), F.lit(stats[c]["low"])) for c in channels}
    z = F.array(*[(logs[c] - stats[c]["mean"]) / (stats[c]["variance"] ** 0.5) for c in channels])
    norm = F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, x: s + x * x))
    energy = F.sqrt(sum((F.col(c) * F.col(c) for c in channels[1:]), F.col(channels[0]) * F.col(channels[0])))
    return df.withColumn("direction", F.transform(z, lambda x: x / (norm + EPS))).withColumn("energy", 1 / (1 + F.exp(-(energy - low) / scale)))


class OnlineCalibrator:
    """Running means and variances of log RMS that outliers don't move; unit direction, and energy against recent ranks."""

    def __init__(self, channels: int, rate_mean: float = 0.001, rate_var: float = 0.003, gate: float = 3.5, memory: int = 600, least: int = 30):
        self.mean, self.var = None, np.ones(channels)
        self.rates, self.gate, self.memory, self.least = (rate_mean, rate_var), gate, memory, least
        self.recent: deque[float] = deque()
        self.ranked: list[float] = []

    def push(self, values: np.ndarray) -> tuple[np.ndarray, float]:
        logs = np.log(values + EPS)
        self.mean = logs.copy() if self.mean is None else self.mean
        z = (logs - self.mean) / np.sqrt(self.var)
        ok = np.abs(z) <= self.gate
        gap = logs - self.mean
        self.mean = np.where(ok, self.mean + self.rates[0] * gap, self.mean)
        self.var = np.where(ok, (1 - self.rates[1]) * self.var + self.rates[1] * gap * gap, self.var)
        energy = float(np.sqrt((values**2).sum()))
        self.recent.append(energy)
        insort(self.ranked, energy)
        if len(self.recent) > self.memory:
            del self.ranked[bisect_left(self.ranked, self.recent.popleft())]
        n = len(self.ranked)
        if n < self.least:
            return z / (np.linalg.norm(z) + EPS), 0.5
        low, high = (self._median(int(n * a), max(int(n * a) + 1, int(n * b))) for a, b in ((0.02, 0.3), (0.3, 0.6)))
        return z / (np.linalg.norm(z) + EPS), float(1 / (1 + np.exp(-(energy - low) / max(high - low, EPS))))

    def _median(self, a: int, b: int) -> float:
        """Of the ranks a to b - 1."""
        return (self.ranked[(a + b - 1) // 2] + self.ranked[(a + b) // 2]) / 2


def calibrate_online(df: DataFrame, keys: Cols, order: str, channels: Cols) -> DataFrame:
    """Adds direction and energy of the online calibrator, row by row in each session's order."""
    schema = df.select("*", F.array(*[F.lit(0.0)] * 1).alias("direction"), F.lit(0.0).alias("energy")).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        cal = OnlineCalibrator(len(channels))
        found = [cal.push(x) for x in pdf[channels].to_numpy(float)]
        return pdf.assign(direction=[d.tolist() for d, _ in found], energy=[e for _, e in found])

    return df.groupBy(*keys).applyInPandas(run, schema)


def report(df: DataFrame, keys: Cols, channels: Cols) -> DataFrame:
    """Windows of each label, and each channel's median."""
    return df.filter("label is not null").groupBy(*keys, "label").agg(F.count("*").alias("windows"), *[F.percentile(c, 0.5).alias(c) for c in channels])


