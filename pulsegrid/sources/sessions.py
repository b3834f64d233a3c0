"""Sessions in a folder: finding them, choosing their files, and reading these with fixed schemas.

A session is a folder with rawData/. All sessions are read by one scan per kind of file; session_id is the folder's name. Which of a session's
candidate files is used is decided in the data, so the driver asks the file system for nothing but the list of sessions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalar import ALIASES, CHANNELS, re_reference
from pulsegrid.operators.timeseries import rebase_clock

#: Candidate files of each signal, best first, with the columns that they hold.
PULSE = {"shimmer.csv": (0, 5), "rawShimmer_0.csv": (0, 5), "ppg.tmp": (0, 1), "ppg.csv": (0, 1)}
SKIN = {"shimmer.csv": (0, 4), "rawShimmer_0.csv": (0, 4), "gsr.tmp": (0, 1), "gsr.csv": (0, 1)}
HEADSET = ["rawEEG_0.csv", "eeg.tmp", "eeg.csv", "eegRec_0.csv"]
SATELLITE, RANGING, EVENTS = ["gps.csv", "gps.tmp"], ["uwb_0.csv", "uwb.tmp"], ["rawEvents.csv", "events_0.csv"]
SIMPLE_EVENTS = ["event.csv"]
STANDARD = {"rawData", "features", "results", "meta", "experimentConfigs"}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def sessions(spark: SparkSession, root: str) -> list[str]:
    """Session folders below root: those with rawData, and leaf folders, but for the standard subfolders."""
    fs, top = _fs(spark, root)
    found, todo = [], [top]
    while todo:
        folder = todo.pop()
        own = [s for s in fs.listStatus(folder) if s.isDirectory()]
        names = {s.getPath().getName() for s in own}
        if "rawData" in names or (not names and folder.getName() not in STANDARD):
            found.append(folder.toString())
        todo += [s.getPath() for s in own if s.getPath().getName() not in STANDARD]
    return sorted(found)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(session_id, path, seq, line) in the order of each file; a file is numbered by the place of its lines."""
    return _numbered(spark.read.text(paths))


def _numbered(text: DataFrame) -> DataFrame:
    text = text.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    text = text.withColumn("seq", F.monotonically_increasing_id())
    folder = F.element_at(F.split("path", "/"), -3)
    order = Window.partitionBy("path").orderBy("block", "seq")
    return text.select(F.url_decode(folder).alias("session_id"), "path", (F.row_number().over(order) - 1).cast("long").alias("seq"), "line")


def chosen_lines(spark: SparkSession, folders: list[str], files: dict[str, int]) -> DataFrame:
    """(session_id, seq, line, name): of each session the lines of its first usable file among `files`, a width (columns that are read) for each name, best first.

    A file can be used if its first line has that many fields and no later line has more fields than the first; an empty, too narrow or ragged one is passed over for the
    next. A width of 1 takes any file with a line, whatever the fields.
    """
    none = "session_id string, seq long, line string, name string"
    if not folders:
        return spark.createDataFrame([], none)
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(files) + "}")
    lines = _numbered(reader.text(folders))
    parts = F.split("path", "/")
    lines = lines.withColumn("name", F.element_at(parts, -1)).filter(F.element_at(parts, -2) == "rawData")
    fields = F.size(F.split("line", ","))
    shape = lines.groupBy("session_id", "path", "name").agg(F.min_by(fields, "seq").alias("first"), F.max(fields).alias("most"))
    width, rank = (F.element_at(F.create_map(*[F.lit(x) for i, (n, w) in enumerate(files.items()) for x in (n, (w, i)[k])]), F.col("name")) for k in (0, 1))
    usable = shape.filter((width == 1) | ((F.col("first") >= width) & (F.col("most") <= F.col("first"))))
    best = usable.groupBy("session_id").agg(F.min_by("path", rank).alias("path"))
    return lines.join(best, ["session_id", "path"]).select("session_id", "seq", "line", "name")


def numeric_rows(lines: DataFrame, width: int, strict: bool = False) -> DataFrame:
    """(session_id, seq, x): the numbers of each line. A first line that isn't numeric is a header and a last one that isn't whole is torn: both are left out.

    Any other line without `width` numbers is an error; with `strict` the first and last ones, too. Text NULL, empty fields and NaN are null.
    """
    parts = F.transform(F.split("line", ","), lambda s: F.trim(s))
    x = F.transform(parts, lambda s: F.when(~F.upper(s).isin("NULL", "", "NAN"), s.try_cast("double")))
    bad = (F.size(parts) < width) | F.exists(parts, lambda s: s.try_cast("double").isNull() & ~F.upper(s).isin("NULL", "", "NAN"))
    w = Window.partitionBy("session_id")
    out = lines.filter(F.trim("line") != "").withColumn("x", x).withColumn("__bad", bad)
    if not strict:
        out = out.withColumn("__end", (F.col("seq") == F.min("seq").over(w)) | (F.col("seq") == F.max("seq").over(w)))
        out = out.filter(~(F.col("__bad") & F.col("__end")))
    checked = F.when(F.col("__bad"), F.raise_error(F.concat(F.lit("malformed line "), F.col("seq").cast("string")))).otherwise(F.col("x"))
    return out.select("session_id", "seq", checked.alias("x"))


def strict_numbers(spark: SparkSession, paths: list[str], header: bool = False) -> DataFrame:
    """(session_id, seq, x) of files of numbers alone, but for a header that is left out; anything else is an error."""
    lines = _lines(spark, paths).select("session_id", "seq", "line")
    return numeric_rows(lines.filter("seq > 0") if header else lines, 1, strict=True)


def two_columns(spark: SparkSession, folders: list[str], files: dict[str, tuple[int, int]]) -> DataFrame:
    """(session_id, seq, t, y) of a signal, from each session's first usable file."""
    lines = chosen_lines(spark, folders, {name: max(columns) + 1 for name, columns in files.items()})
    out = None
    for t, y in dict.fromkeys(files.values()):
        names = [n for n, columns in files.items() if columns == (t, y)]
        one = numeric_rows(lines.filter(F.col("name").isin(names)), max(t, y) + 1).select("session_id", "seq", F.col("x")[t].alias("t"), F.col("x")[y].alias("y"))
        out = one if out is None else out.unionByName(one)
    return out


def headset(spark: SparkSession, folders: list[str], referenced: bool = False) -> DataFrame:
    """(session_id, seq, t, channels) of the headset; referenced subtracts half the ear channel from all."""
    return _channels(numeric_rows(chosen_lines(spark, folders, dict.fromkeys(HEADSET, 9)), 9), referenced)


def legacy_headset(spark: SparkSession, folders: list[str], referenced: bool = True) -> DataFrame:
    """headset() as older callers have it: referenced unless told otherwise."""
    return headset(spark, folders, referenced)


def _channels(rows: DataFrame, referenced: bool) -> DataFrame:
    raw = {c: F.col("x")[j + 1] for j, c in enumerate(CHANNELS)}
    named = re_reference(raw) if referenced else raw
    return rows.select("session_id", "seq", F.col("x")[0].alias("t"), *[v.alias(c) for c, v in named.items()])


def demo_rows(lines: DataFrame) -> DataFrame:
    """(session_id, seq, channels) of a demonstration feed: the second to ninth fields; lines with fewer, or others than numbers there, are left out."""
    x = F.transform(F.slice(F.split(F.trim("line"), ","), 2, 8), lambda s: F.trim(s).try_cast("double"))
    whole = lines.withColumn("x", x).filter((F.size("x") == 8) & ~F.exists("x", lambda v: v.isNull()))
    return whole.select("session_id", "seq", *[F.col("x")[j].alias(c) for j, c in enumerate(CHANNELS)])


def fixes(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(session_id, t, latitude, longitude) of sessions with two fixes or more."""
    rows = numeric_rows(chosen_lines(spark, folders, dict.fromkeys(SATELLITE, 3)), 3)
    rows = rows.select("session_id", *[F.col("x")[j].alias(n) for j, n in enumerate(("t", "latitude", "longitude"))])
    return from_first_fix(rows)


def from_first_fix(rows: DataFrame) -> DataFrame:
    """Fixes with times from each session's first; sessions with one fix are left out."""
    w = Window.partitionBy("session_id")
    rows = rows.withColumn("t", F.col("t") - F.min("t").over(w)).withColumn("__n", F.count("*").over(w))
    return rows.filter("__n >= 2").drop("__n")


def regions(spark: SparkSession, path: str) -> DataFrame:
    """(seq, label, x, y, w, h): rectangles of a file with a header, in its order."""
    lines = _lines(spark, [path]).select("session_id", "seq", "line")
    return region_rows(lines)


def region_rows(lines: DataFrame) -> DataFrame:
    """Rectangles of lines whose first one names the columns, in any order."""
    f = F.transform(F.split("line", ","), lambda s: F.trim(s))
    first = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("f", f).withColumn("names", F.first("f").over(first)).filter((F.col("seq") > 0) & (F.trim("line") != ""))
    value = lambda n: F.get("f", F.array_position("names", n).cast("int") - 1)
    return named.select("seq", value("label").alias("label"), *[value(n).try_cast("double").alias(n) for n in ("x", "y", "w", "h")])


def ranging_frames(lines: DataFrame) -> DataFrame:
    """(session_id, seq, t, ants) of ranging lines; times in seconds from the first physical line, whatever it holds."""
    fields = F.split(F.regexp_replace("line", '[" ]', ""), ",")
    w = Window.partitionBy("session_id")
    out = lines.withColumn("f", fields).withColumn("__t0", F.min_by(F.col("f")[0].try_cast("double"), "seq").over(w))
    out = out.filter(F.contains("line", F.lit("DIST")))
    n = F.least(F.coalesce(F.get("f", F.lit(2)).try_cast("int"), F.lit(0)), F.floor((F.size("f") - 3) / 6).cast("int"))
    at = lambda i, k: F.get("f", 3 + 6 * i + k)
    ant = lambda i: F.struct(
        at(i, 0).alias("num"), at(i, 1).alias("id"), *[at(i, k).try_cast("double").alias(name) for k, name in ((2, "x"), (3, "y"), (4, "z"), (5, "dist"))]
    )
    none = F.array().cast("array<struct<num:string,id:string,x:double,y:double,z:double,dist:double>>")
    ants = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), ant)).otherwise(none)
    return out.select("session_id", "seq", ((F.col("f")[0].try_cast("double") - F.col("__t0")) / 1000).alias("t"), ants.alias("ants"))


def raw_events(lines: DataFrame) -> DataFrame:
    """(session_id, seq, ts, name, value): quotes and blanks stripped, commas of the payload kept, on the recording's clock."""
    f = F.transform(F.split("line", ","), lambda s: F.trim(F.replace(s, F.lit("'"), F.lit(""))))
    out = lines.withColumn("f", f).filter(F.size("f") >= 2)
    # the reference row has TIMESTAMP in its second or third column
    value = F.array_join(F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0))), ",")
    out = out.select("session_id", "seq", F.col("f")[0].try_cast("double").alias("ts"), F.col("f")[1].alias("name"), value.alias("value"))
    return rebase_clock(out.filter("ts is not null"), ["session_id"], "seq")


def simple_events(lines: DataFrame) -> DataFrame:
    """(session_id, seq, ts, name) of the first two fields; short and non-numeric lines are left out."""
    f = F.split("line", ",")
    out = lines.select("session_id", "seq", F.get(f, F.lit(0)).try_cast("double").alias("ts"), F.trim(F.get(f, F.lit(1))).alias("name"))
    return out.filter("ts is not null and name is not null")


def labelled_intervals(df: DataFrame, milliseconds: bool = False) -> DataFrame:
    """EventName, Start, End, Value with times from the OFFSET row's start; brackets stripped, OFFSET and FIN left out."""
    base = F.lit(df.filter("EventName = 'OFFSET'").agg(F.min("Start")).first()[0] or 0.0)  # one number
    scale = 1000.0 if milliseconds else 1.0
    out = df.select("EventName", ((F.col("Start") - base) / scale).alias("Start"), ((F.col("End") - base) / scale).alias("End"), F.translate("Value", "[]", "").alias("Value"))
    return out.filter(~F.col("EventName").isin("OFFSET", "FIN"))


def expression_events(df: DataFrame) -> DataFrame:
    """(t, emotion) of EXPRESSION rows of (timestamp, tag, values), from the first timestamp."""
    from pulsegrid.operators.events import json_field

    start = df.agg(F.min("timestamp")).first()[0]  # one number
    return df.withColumn("t", F.col("timestamp") - F.lit(start)).filter("tag = 'EXPRESSION'").select("t", json_field(F.col("values"), "emotion").alias("emotion"))


def bracketed_positions(lines: DataFrame) -> DataFrame:
    """x, y, z of lines with bracketed vectors; lines with None are left out."""
    f = F.split(F.trim(F.regexp_replace("line", r"[\[\](),;]", " ")), r"\s+")
    x = F.transform(f, lambda s: s.try_cast("double"))
    return lines.filter(~F.contains("line", F.lit("None"))).select("session_id", "seq", *[F.get(x, F.lit(j)).alias(n) for j, n in enumerate("xyz")])


def canonical_columns(df: DataFrame, time_names: tuple[str, ...] = ("Timestamp", "timestamp", "t", "time")) -> DataFrame:
    """An RMS table with its columns under canonical names, in fixed order; unknown, ambiguous or missing columns are errors."""
    names = [c for c in df.columns if not c.startswith("Unnamed")]
    time = [c for c in names if c in time_names]
    if len(time) != 1:
        raise ValueError(f"one time column is needed, not {time}")
    found: dict[str, str] = {}
    for c in names:
        if c in time:
            continue
        base = c.removesuffix("_RMS")
        target = ALIASES.get(base, base)
        if target not in CHANNELS:
            raise ValueError(f"unknown column {c}")
        if target in found:
            raise ValueError(f"{c} and {found[target]} are both {target}")
        found[target] = c
    if len(found) != len(CHANNELS):
        raise ValueError(f"missing columns: {sorted(set(CHANNELS) - set(found))}")
    return df.select(F.col(f"`{time[0]}`").alias("Timestamp"), *[F.col(f"`{found[c]}`").cast("double").alias(c) for c in CHANNELS])


def has_bands(spark: SparkSession, path: str, columns: set[str], channels: set[str]) -> bool:
    """Whether a cached band table can be used: it is there, has the columns, and holds the channels."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return False
    df = spark.read.parquet(path)
    return columns <= set(df.columns) and df.filter(F.col("channel").isin(list(channels))).select("channel").distinct().count() == len(channels)


@dataclass(frozen=True)
class Metric:
    """A result table as a viewer shows it."""

    table: str
    label: str
    y_label: str
    y_range: tuple[float, float] | None = None
    filled: bool = False


#: The result tables in the order in which they are shown.
METRICS = {
    "emotions": Metric("Emotions", "Emotions", "Probability", (0.0, 1.0), True),
    "arousal": Metric("Arousal", "Arousal", "EDA (z-score)"),
    "cognition": Metric("Cognition", "Cognition", "Index"),
    "heartdynamics": Metric("HeartDynamics", "Heart Dynamics", "HRV Metrics"),
}


def result(spark: SparkSession, out: str, table: str, session: str | None = None) -> DataFrame | None:
    """A result table, or a session's part of it; None where there is none, or none with a row."""
    fs, p = _fs(spark, f"{out}/{table}")
    if not fs.exists(p) or not any(s.isDirectory() and s.getPath().getName().startswith("session_id=") for s in fs.listStatus(p)):
        return None
    df = spark.read.parquet(f"{out}/{table}")
    if session is None:
        return df
    own = df.filter(F.col("session_id") == session)
    return None if own.isEmpty() else own


def available_metrics(spark: SparkSession, out: str, session: str) -> list[str]:
    """The metrics that a session has results of, in the order in which they are shown."""
    return [key for key, m in METRICS.items() if result(spark, out, m.table, session) is not None]


def ensure_layout(spark: SparkSession, folder: str) -> None:
    """Moves a session's files into rawData/ if it has none, but for the standard subfolders, and makes these; a second call changes nothing."""
    fs, top = _fs(spark, folder)
    new = spark._jvm.org.apache.hadoop.fs.Path
    raw = new(f"{folder}/rawData")
    if not fs.exists(raw):
        entries = [s.getPath() for s in fs.listStatus(top)]
        fs.mkdirs(raw)
        for path in entries:
            if path.getName() not in STANDARD:
                fs.rename(path, new(f"{folder}/rawData/{path.getName()}"))
    for name in sorted(STANDARD):
        fs.mkdirs(new(f"{folder}/{name}"))


def preflight(spark: SparkSession, folder: str, needs: str | None = None) -> str | None:
    """What keeps a session from being processed, or None. needs: a file below the folder that an earlier run has made, such as features/ppg/ppg_resampled.csv."""
    if not folder:
        return "No session folder is given."
    fs, top = _fs(spark, folder)
    if not fs.exists(top) or not fs.getFileStatus(top).isDirectory():
        return "The session path isn't a folder."
    if needs is not None:
        there = fs.exists(_fs(spark, f"{folder}/{needs}")[1])
        return None if there else f"{needs} is missing: process the session first."
    ensure_layout(spark, folder)
    if not fs.listStatus(_fs(spark, f"{folder}/rawData")[1]):
        return "rawData is empty."
    return None


@dataclass(frozen=True)
class Settings:
    data_root: str | None = None
    ffmpeg_dir: str | None = None
    screen_id: str | None = None


def settings(*layers: dict | str | None) -> Settings:
    """Settings from layers, weakest first: dictionaries or JSON texts; blanks and absent keys leave what is there."""
    out: dict[str, str] = {}
    names = {"pov_data_root": "data_root", "data_root": "data_root", "ffmpeg_dir": "ffmpeg_dir", "screen_id": "screen_id"}
    for layer in layers:
        values = json.loads(layer) if isinstance(layer, str) else layer or {}
        for key, value in values.items():
            if key in names and value is not None and str(value).strip():
                out[names[key]] = str(value).strip()
    return Settings(**out)
