"""The session pipeline: steps over all sessions at once, with a log of what is done.

A step reads the sessions' files and writes tables by session, under the names and columns that viewers know. Sessions that the log has as done for a step
are skipped, failed ones are tried again. Where a step fails for some sessions at once, it is tried again for either half of them, so that one bad session is logged
as failed and the others get their results; a step that fails for whatever it is given stops after a bounded number of tries.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import scalar
from pulsegrid.operators import aggregates as agg
from pulsegrid.operators import eda, eeg, events, heart, joins, position
from pulsegrid.operators import emotions as emo
from pulsegrid.operators import timeseries as ts
from pulsegrid.operators.emotions import Model
from pulsegrid.sources import sessions as src
from pulsegrid.sources.sinks import write_metric

LOG = "session_id string, step string, ok boolean, message string"
KEYS = ["session_id"]
TICK, GAP, BUCKET = 0.5, 5.0, 60.0

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Step:
    """A step's name and what makes its tables: one DataFrame, written under the step's name, or several by their names."""

    name: str
    build: Callable[[SparkSession, list[str]], DataFrame | Tables]


_kept: list[DataFrame] = []


def _keep(df: DataFrame) -> DataFrame:
    """A table that several others of a step are made of, on the executors' disks until the step is done; what an executor loses is made anew."""
    _kept.append(df.persist(StorageLevel.DISK_ONLY))
    return df


def _snapped(df: DataFrame, columns: list[str], t: str = "t") -> DataFrame:
    """(session_id, i, t, columns) on the metric grid: all columns in one pass, each a signal of its own."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*KEYS, t, F.explode(pairs).alias("x")).select(*KEYS, t, "x.c", "x.v")
    return ts.snap(long, [*KEYS, "c"], t, "v", TICK, 600.0).groupBy(*KEYS, "i", t).pivot("c", columns).agg(F.first("v"))


def _named(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """session_id and the columns under new names."""
    return df.select("session_id", *[F.col(c).alias(name) for c, name in columns.items()])


def _grid_tables(raw: DataFrame, grid: DataFrame, kind: str) -> Tables:
    """The resampled signal, a report of one row a session, and the list of its gaps."""
    return {
        f"{kind}_resampled": _named(grid, {"t": "Timestamp", "y": "Value"}),
        f"{kind}_resampling": ts.resample_stats(raw, grid, KEYS, "t", "y"),
        f"{kind}_gaps": ts.gaps(raw.filter("y is not null"), KEYS, "t", GAP),
    }


def pulse(spark: SparkSession, folders: list[str]) -> tuple[DataFrame, DataFrame]:
    """The raw pulse signal and its grid."""
    raw = ts.normalise_time(src.two_columns(spark, folders, src.PULSE), KEYS, "t", "seq")
    return raw, heart.resampled_pulse(raw, KEYS)


def heart_dynamics(spark: SparkSession, folders: list[str]) -> DataFrame:
    return heart.heart_dynamics(pulse(spark, folders)[1], KEYS)


METRIC_NAMES = {"t": "Timestamp"} | {c: c for c in ("mean_hr", "mean_nn", "sdnn", "rmssd", "pnn50", "cvsd", "cvnn", "n_beats")}


def heart_tables(spark: SparkSession, folders: list[str]) -> Tables:
    raw, grid = pulse(spark, folders)
    z = heart.normalised_pulse(grid, KEYS).join(grid.select(*KEYS, "i", "t"), [*KEYS, "i"])
    tables = {"HeartDynamics": _named(heart.heart_dynamics(grid, KEYS), METRIC_NAMES), "ppg_normalized": _named(z, {"t": "Timestamp", "z": "Value"})}
    return tables | _grid_tables(raw, grid, "ppg")


def pulse_refix(out: str) -> Callable[[SparkSession, list[str]], DataFrame]:
    """A step that makes heart dynamics anew from the resampled pulse of an earlier run, without masks."""

    def build(spark: SparkSession, folders: list[str]) -> DataFrame:
        names = [f.rstrip("/").rpartition("/")[2] for f in folders]
        grid = src.result(spark, out, "ppg_resampled")
        if grid is None:
            raise FileNotFoundError(f"{out}/ppg_resampled")
        grid = grid.filter(F.col("session_id").isin(names)).select("session_id", F.col("Timestamp").alias("t"), F.col("Value").alias("y"))
        return _named(heart.heart_dynamics(ts.row_index(grid, KEYS, ["t"]), KEYS, use_masks=False), METRIC_NAMES)

    return build


def _skin(spark: SparkSession, folders: list[str]) -> tuple[DataFrame, DataFrame]:
    raw = ts.normalise_time(src.two_columns(spark, folders, src.SKIN), KEYS, "t", "seq")
    return raw, ts.resample(raw, KEYS, "t", "y", 1 / eda.RATE, GAP, BUCKET)


def _components(grid: DataFrame) -> DataFrame:
    conductance = grid.withColumn("y", scalar.conductance(F.col("y")))
    return eda.arousal(eda.cleaned(conductance, KEYS, "y"), KEYS).withColumn("t", F.col("i") / eda.RATE)


def arousal(spark: SparkSession, folders: list[str]) -> DataFrame:
    return ts.bin_mean(_components(_skin(spark, folders)[1]), KEYS, "t", ["tonic", "phasic"], TICK)


def arousal_tables(spark: SparkSession, folders: list[str]) -> Tables:
    raw, grid = _skin(spark, folders)
    found = _keep(_components(grid))
    binned = ts.bin_mean(found, KEYS, "t", ["tonic", "phasic"], TICK).withColumn("t", F.col("bin") * TICK)
    return {
        "Arousal": _named(binned, {"t": "Timestamp", "tonic": "TonicEDA", "phasic": "PhasicEDA"}),
        "SCR_events": _named(eda.scr_events(found.select(*KEYS, "i", "phasic"), KEYS), {"t": "Timestamp", "amplitude": "Amplitude", "prominence": "Prominence"}),
    } | _grid_tables(raw, grid, "eda")


def _headset(spark: SparkSession, folders: list[str]) -> DataFrame:
    return ts.normalise_time(src.headset(spark, folders), KEYS, "t", "seq")


def _brain(spark: SparkSession, folders: list[str]) -> Tables:
    """Filtered derived channels, their artefact epochs, band powers and indices of each window."""
    raw = _headset(spark, folders)
    raw = raw.select(*KEYS, "seq", "t", *[scalar.unsaturated(F.col(c)).alias(c) for c in scalar.CHANNELS])
    derived = scalar.montage({c: F.col(c) for c in scalar.CHANNELS})
    wide = ts.row_index(raw.select(*KEYS, "seq", "t", *[v.alias(n) for n, v in derived.items()]), KEYS, ["seq"])
    names = list(derived)
    wide = wide.withColumn("invalid", eeg.hardware_invalid(wide, KEYS, "t", names))
    clean = _keep(eeg.filtered(wide, KEYS, "i", names))
    epochs = eeg.epoch_artefacts(clean, KEYS, "i", "invalid")
    judged = eeg.with_rejected(clean, KEYS, "i", "invalid", epochs)
    powers = _keep(eeg.band_powers(judged, KEYS, "i", "t", names, "invalid"))
    return {"epochs": epochs, "powers": powers, "indices": eeg.cognition(powers, KEYS, "t")}


INDICES = {"engagement": "Engagement", "focus": "Focus", "cognitive_load": "CognitiveLoad", "frontal": "Frontal", "lateralization": "Lateralization"}


def cognition(spark: SparkSession, folders: list[str]) -> DataFrame:
    return _snapped(_brain(spark, folders)["indices"], list(INDICES))


def cognition_tables(spark: SparkSession, folders: list[str]) -> Tables:
    found = _brain(spark, folders)
    bands = {"t": "Timestamp"} | {b: f"avg_{b}" for b in scalar.BANDS} | {"all_power": "all_power"} | {f"rel_{b}": f"rel_{b}" for b in scalar.BANDS}
    whole = sum((F.col(b) for b in list(scalar.BANDS)[1:]), F.col(list(scalar.BANDS)[0]))
    return {
        "powerBands": _named(found["powers"], {"t": "Timestamp", "channel": "channel", "band": "band", "power": "power"}),
        "artefactStats": agg.artefact_stats(found["epochs"], KEYS),
        "temporalBandPowers": _named(found["indices"].withColumn("all_power", whole), bands),
        "Cognition": _named(_snapped(found["indices"], list(INDICES)), {"t": "Timestamp"} | INDICES),
    }


def gps(spark: SparkSession, folders: list[str]) -> DataFrame:
    return position.gps_grid(src.fixes(spark, folders), KEYS)


def gps_table(spark: SparkSession, folders: list[str]) -> Tables:
    return {"gpsDf": _named(gps(spark, folders), {"t": "Timestamp", "latitude": "Latitude", "longitude": "Longitude"})}


def _frames(spark: SparkSession, folders: list[str]) -> DataFrame:
    return src.ranging_frames(src.chosen_lines(spark, folders, dict.fromkeys(src.RANGING, 1)))


def ranging(spark: SparkSession, folders: list[str]) -> DataFrame:
    return position.positions(_frames(spark, folders), KEYS, "t")


def position_tables(zones: DataFrame | None = None, floors: list[tuple[list[str], float]] = ()) -> Callable[[SparkSession, list[str]], Tables]:
    """A step of positions and antennas, and with `zones` (seq, label, x, y, w, h) of the zone of each position."""

    def build(spark: SparkSession, folders: list[str]) -> Tables:
        frames = _frames(spark, folders)
        found = _keep(position.positions(frames, KEYS, "t", floors))
        out = {"positions": _named(found, {"t": "Timestamp", "x": "x", "y": "y", "z": "z"}), "antennas": position.antennas(frames, KEYS, "t").drop("first_t")}
        if zones is not None:
            out["zones"] = _named(joins.containment_last_wins(found, zones, "seq", "label"), {"t": "Timestamp", "label": "ROI"})
        return out

    return build


def _raw_events(spark: SparkSession, folders: list[str]) -> DataFrame:
    return src.raw_events(src.chosen_lines(spark, folders, dict.fromkeys(src.EVENTS, 1)))


def event_outputs(spark: SparkSession, folders: list[str]) -> DataFrame:
    return events.split_events(_raw_events(spark, folders), "name", "value")


def event_tables(spark: SparkSession, folders: list[str]) -> Tables:
    routed = event_outputs(spark, folders)
    done = events.processed(routed, ["session_id", "seq", "output"])
    return {"Events": routed, **{f"{kind}_events": done.filter(F.col("output") == kind).drop("output") for kind in ("web", "feature")}}


def annotations(spark: SparkSession, folders: list[str]) -> DataFrame:
    """One document of playback annotations a session, made once: a session that has one is done."""
    rows = src.simple_events(src.chosen_lines(spark, folders, dict.fromkeys(src.SIMPLE_EVENTS, 1)))
    return events.annotation_documents(events.seed_annotations(rows, KEYS, "seq"), KEYS, "seq")


def _windows(spark: SparkSession, folders: list[str]) -> DataFrame:
    raw = _headset(spark, folders)
    raw = raw.select(*KEYS, "seq", "t", *[scalar.connected(F.col(c)).alias(c) for c in scalar.CHANNELS])
    return emo.window_features(ts.row_index(raw, KEYS, ["seq"]), KEYS, "i", "t", scalar.CHANNELS)


def emotions(model: Model, training: DataFrame | None = None) -> Callable[[SparkSession, list[str]], DataFrame]:
    """A step with a model's parameters: filtered windows, inference, and the probabilities on the metric grid."""

    def build(spark: SparkSession, folders: list[str]) -> DataFrame:
        found = emo.rescored(_windows(spark, folders), KEYS, "t", scalar.CHANNELS, model, training)
        return _snapped(found, model.all_classes)

    return build


def emotion_tables(model: Model, training: DataFrame | None = None) -> Callable[[SparkSession, list[str]], Tables]:
    """The same with the windows' RMS, and the classifier's inputs with label and confidence (without windows of too many missing samples)."""

    def build(spark: SparkSession, folders: list[str]) -> Tables:
        windows = _keep(_windows(spark, folders))
        found = _keep(emo.rescored(windows, KEYS, "t", scalar.CHANNELS, model, training))
        inputs = [F.col("features")[j].alias(n) for j, n in enumerate(model.features)]
        return {
            "rmsSignals": _named(windows, {"t": "Timestamp"} | {c: c for c in scalar.CHANNELS}),
            "emotionClassifierInputs": found.filter("label is not null").select(
                "session_id", F.col("t").alias("Timestamp"), *inputs, F.col("label").alias("PredictedLabel"), F.col("confidence").alias("PredictedConfidence")
            ),
            "Emotions": _named(_snapped(found, model.all_classes), {"t": "Timestamp"} | {c: c for c in model.all_classes}),
        }

    return build


def meta_info(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Each session's duration, the longest of its signals', and whether any could be read."""
    parts = [ts.normalise_time(src.two_columns(spark, folders, src.PULSE), KEYS, "t", "seq").select(*KEYS, "seq", "t")]
    parts.append(_headset(spark, folders).select(*KEYS, "seq", "t"))
    spans = [agg.session_duration(p, KEYS, "t", "seq") for p in parts]
    out = spans[0].unionByName(spans[1]).groupBy(*KEYS).agg(F.max("duration").alias("duration"))
    every = spark.createDataFrame([(f.rstrip("/").rpartition("/")[2],) for f in folders], "session_id string")
    return every.join(out, KEYS, "left").withColumn("readable", F.col("duration").isNotNull())


def fused(out: str, tables: tuple[str, ...] = ("HeartDynamics", "Arousal", "Cognition", "Emotions")) -> Callable[[SparkSession, list[str]], Tables]:
    """A step of one wide table of the results on their grid, those there are, tagged with the event in whose interval a row lies; and of long emotions.

    An event's interval reaches to the next event of its session; NULL and INVALID tag nothing.
    """

    def build(spark: SparkSession, folders: list[str]) -> Tables:
        names = [f.rstrip("/").rpartition("/")[2] for f in folders]
        own = lambda df: df.filter(F.col("session_id").isin(names))
        found = {n: own(df) for n in tables if (df := src.result(spark, out, n)) is not None}
        if not found:
            raise FileNotFoundError(f"no results in {out}")
        wide = joins.fuse(list(found.values()), KEYS, "Timestamp", TICK)
        marks = src.result(spark, out, "Events")
        if marks is not None:
            w = F.lead("ts").over(ts.Window.partitionBy("session_id").orderBy("ts", "seq"))
            spans = own(marks).dropDuplicates(["session_id", "seq"]).withColumn("end", F.coalesce(w, F.lit(float("inf"))))
            last = wide.groupBy("session_id").agg(F.max("Timestamp").alias("__last"))
            spans = spans.join(last, KEYS).withColumn("end", F.least("end", "__last")).filter("name not in ('NULL', 'INVALID')")
            wide = joins.interval_last_wins(wide, spans.withColumnRenamed("name", "Tag"), KEYS, "Timestamp", "ts", "end", "seq", "Tag", 600.0)
        done = {"Dataframe": wide}
        if "Emotions" in found:
            classes = [c for c in found["Emotions"].columns if c not in ("session_id", "Timestamp")]
            done["emotionsDataframe"] = emo.argmax_labels(found["Emotions"], ["session_id", "Timestamp"], classes)
        return done

    return build


DEFAULT = [
    Step("MetaInfo", meta_info),
    Step("HeartDynamics", heart_tables),
    Step("Arousal", arousal_tables),
    Step("Cognition", cognition_tables),
    Step("Events", event_tables),
    Step("Annotations", annotations),
    Step("Positions", position_tables()),
    Step("Gps", gps_table),
]


def default_steps(out: str, model: Model | None = None, training: DataFrame | None = None, zones: DataFrame | None = None) -> list[Step]:
    """All steps: those of DEFAULT, emotions where there is a model, zones where there are regions, and the fused table of the results."""
    steps = [Step("Positions", position_tables(zones)) if s.name == "Positions" else s for s in DEFAULT]
    if model is not None:
        steps.append(Step("Emotions", emotion_tables(model, training)))
    return [*steps, Step("Dataframe", fused(out))]


def run(spark: SparkSession, root: str, out: str, steps: list[Step] | None = None) -> DataFrame:
    """Runs the steps over the sessions below root that lack them, writes tables to out, and gives the log."""
    folders = {f.rstrip("/").rpartition("/")[2]: f for f in src.sessions(spark, root)}
    log = f"{out}/step_log"
    for step in steps or default_steps(out):
        done = {r[0] for r in _log(spark, log).filter((F.col("step") == step.name) & F.col("ok")).select("session_id").collect()}
        todo = sorted(set(folders) - done)
        if not todo:
            continue
        rows = [(s, step.name, message is None, message or "") for s, message in _tried(spark, step, folders, todo, out).items()]
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(log)
    return _log(spark, log)


def _tried(spark: SparkSession, step: Step, folders: dict[str, str], todo: list[str], out: str) -> dict[str, str | None]:
    """What went wrong for each session, or None."""
    left = 8 + 4 * math.ceil(math.log2(len(todo) + 1))  # failures that are looked into
    found: dict[str, str | None] = {}
    parts = [todo]
    while parts:
        part = parts.pop()
        try:
            _write(step.build(spark, [folders[s] for s in part]), out, step.name)
            found |= dict.fromkeys(part)
        except Exception as error:  # noqa: BLE001  the sessions' failure is logged, and the others go on
            left -= 1
            if len(part) == 1 or left <= 0:
                found |= dict.fromkeys(part, str(error)[:500])
            else:
                parts += [part[: len(part) // 2], part[len(part) // 2 :]]
        finally:
            while _kept:
                _kept.pop().unpersist()
    return found


def _write(tables: DataFrame | Tables, out: str, name: str) -> None:
    for table, df in (tables if isinstance(tables, dict) else {name: tables}).items():
        write_metric(df, out, table)


def _log(spark: SparkSession, path: str) -> DataFrame:
    fs, p = src._fs(spark, path)
    return spark.read.schema(LOG).parquet(path) if fs.exists(p) else spark.createDataFrame([], LOG)
