"""Event logs: routing to outputs, filters, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.timeseries import Cols

#: Event types by output, and those that are dropped.
WEB = ["WEB_SCROLL", "WEB_TAB_UPDATE", "WEB_INITIAL_SCROLL_POSITION"]
BOTH = ["WEB_TAB_UPDATE"]
BOTH_IF = "complete"
DROPPED = ["NO_KEYPRESS", "KEYPRESS", "ANSWER"]
ONSET = "RECORDING_ONSET"
ADMINISTRATIVE = ["RECORDING_ONSET", "RECIPE_CONFIG", "SYSTEM_CONFIG", "CONSENT_INFO"]
LABEL_EVENT, LABEL_ZONE = "Event", "Zone"
#: Zones shorter than this (seconds) are dropped on reading, and aren't drawn.
SHORTEST_ZONE, SHORTEST_DRAWN = 1e-9, 1e-6
ANNOTATION_VERSION = 1


def split_events(
    df: DataFrame, name: str, payload: str, web: Cols = WEB, both: Cols = BOTH, both_if: str = BOTH_IF, dropped: Cols = DROPPED
) -> DataFrame:
    """Each event once for each output that it goes to (`output`: web, feature); dropped types go to none."""
    is_web = F.col(name).isin(web)
    is_both = F.col(name).isin(both) & F.coalesce(F.contains(F.col(payload), F.lit(both_if)), F.lit(False))
    outputs = F.when(is_both, F.array(F.lit("web"), F.lit("feature"))).when(is_web, F.array(F.lit("web")))
    outputs = outputs.when(F.col(name).isin(dropped), F.array().cast("array<string>")).otherwise(F.array(F.lit("feature")))
    return df.withColumn("output", F.explode(outputs))


def of_types(df: DataFrame, name: str, wanted: Cols) -> DataFrame:
    return df.filter(F.col(name).isin(wanted))


def processed(df: DataFrame, keep: Cols = ()) -> DataFrame:
    """The processed layout: name, PROCESSED, milliseconds, empty, value without quotes; `[]` and null are empty. Columns in `keep` come first."""
    value = F.regexp_replace(F.coalesce("value", F.lit("")), '"', "")
    return df.select(
        *keep, "name", F.lit("PROCESSED").alias("state"), (F.col("ts") * 1000).cast("string").alias("ms"), F.lit("").alias("extra"),
        F.when(value == "[]", "").otherwise(value).alias("value"),
    )


def seed_annotations(df: DataFrame, keys: Cols, seq: str, onset: str = ONSET, admin: Cols = ADMINISTRATIVE) -> DataFrame:
    """Events as annotation points from the session's first onset, administrative types left out; none without an onset.

    A point's id follows from the session, the event's place and its name, so that a repeated run gives the same ids.
    """
    start = F.min_by(F.when(F.col("name") == onset, F.col("ts")), F.when(F.col("name") == onset, F.col(seq))).over(Window.partitionBy(*keys))
    out = df.withColumn("t", F.bround(F.col("ts") - start, 6)).filter(F.col("t").isNotNull() & ~F.col("name").isin(list(admin)))
    digest = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in (*keys, seq, "name")]))
    return out.withColumn("id", F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).withColumn("label", F.col("name")).withColumn("visible", F.lit(True))


def annotation_documents(seeded: DataFrame, keys: Cols, seq: str) -> DataFrame:
    """(keys, annotations): one JSON document a session, its points in the events' order and no zones."""
    points = F.array_sort(F.collect_list(F.struct(seq, "id", "t", "label", "visible")))
    points = F.transform(points, lambda p: F.struct(*[p[n].alias(n) for n in ("id", "t", "label", "visible")]))
    zones = F.array().cast("array<struct<id:string,t0:double,t1:double,label:string,visible:boolean>>")
    document = F.struct(F.lit(ANNOTATION_VERSION).alias("version"), points.alias("points"), zones.alias("zones"))
    return seeded.groupBy(*keys).agg(F.to_json(document, {"pretty": "true"}).alias("annotations"))


ANNOTATIONS = (
    "struct<version: int, points: array<struct<id: string, t: double, label: string, visible: boolean>>, "
    "zones: array<struct<id: string, t0: double, t1: double, label: string, visible: boolean>>>"
)


def read_annotations(text: Column, t_min: Column, t_max: Column) -> Column:
    """Parsed annotations: times clamped to the table's, swapped zones put right, empty zones dropped, defaults filled in."""
    a = F.from_json(text, ANNOTATIONS)
    clamp = lambda t: F.least(F.greatest(t, t_min), t_max)
    points = F.transform(
        F.filter(a["points"], lambda p: p["t"].isNotNull()),
        lambda p: F.struct(p["id"].alias("id"), clamp(p["t"]).alias("t"), F.coalesce(p["label"], F.lit(LABEL_EVENT)).alias("label"), F.coalesce(p["visible"], F.lit(True)).alias("visible")),
    )
    zones = F.transform(
        F.filter(a["zones"], lambda z: z["t0"].isNotNull() & z["t1"].isNotNull()),
        lambda z: F.struct(
            z["id"].alias("id"), clamp(F.least(z["t0"], z["t1"])).alias("t0"), clamp(F.greatest(z["t0"], z["t1"])).alias("t1"),
            F.coalesce(z["label"], F.lit(LABEL_ZONE)).alias("label"), F.coalesce(z["visible"], F.lit(True)).alias("visible"),
        ),
    )
    zones = F.filter(zones, lambda z: z["t1"] - z["t0"] >= SHORTEST_ZONE)
    return F.struct(F.coalesce(a["version"], F.lit(1)).alias("version"), points.alias("points"), zones.alias("zones"))


def without(annotations: Column, item: str) -> Column:
    """Annotations without the point or zone of that id."""
    return F.struct(
        annotations["version"].alias("version"),
        F.filter(annotations["points"], lambda p: p["id"] != item).alias("points"),
        F.filter(annotations["zones"], lambda z: z["id"] != item).alias("zones"),
    )


def with_point(annotations: Column, item: str, t: Column, t_min: Column, t_max: Column, label: str | None = None) -> Column:
    """Annotations with one more point; its default label counts the points."""
    name = F.lit(label) if label else F.concat(F.lit("Event "), (F.size(annotations["points"]) + 1).cast("string"))
    point = F.struct(F.lit(item).alias("id"), F.least(F.greatest(t, t_min), t_max).alias("t"), name.alias("label"), F.lit(True).alias("visible"))
    return F.struct(annotations["version"].alias("version"), F.concat(annotations["points"], F.array(point)).alias("points"), annotations["zones"].alias("zones"))


def _span(t0: Column, t1: Column, t_min: Column, t_max: Column) -> tuple[Column, Column]:
    """Both ends within the table's times, the earlier first."""
    a, b = (F.least(F.greatest(t, t_min), t_max) for t in (t0, t1))
    return F.least(a, b), F.greatest(a, b)


def with_zone(annotations: Column, item: str, t0: Column, t1: Column, t_min: Column, t_max: Column, label: str | None = None) -> Column:
    """Annotations with one more zone, unless it would be too short; its default label counts the zones."""
    a, b = _span(t0, t1, t_min, t_max)
    name = F.lit(label) if label else F.concat(F.lit("Zone "), (F.size(annotations["zones"]) + 1).cast("string"))
    zone = F.struct(F.lit(item).alias("id"), a.alias("t0"), b.alias("t1"), name.alias("label"), F.lit(True).alias("visible"))
    zones = F.when(b - a < SHORTEST_DRAWN, annotations["zones"]).otherwise(F.concat(annotations["zones"], F.array(zone)))
    return F.struct(annotations["version"].alias("version"), annotations["points"].alias("points"), zones.alias("zones"))


def _changed(annotations: Column, item: str, point: dict[str, Column], zone: dict[str, Column]) -> Column:
    """Annotations with some fields of the point or zone of that id replaced."""

    def fields(names: Cols, new: dict[str, Column]):
        return lambda x: F.when(x["id"] == item, F.struct(*[new.get(n, x[n]).alias(n) for n in names])).otherwise(x)

    return F.struct(
        annotations["version"].alias("version"),
        F.transform(annotations["points"], fields(["id", "t", "label", "visible"], point)).alias("points"),
        F.transform(annotations["zones"], fields(["id", "t0", "t1", "label", "visible"], zone)).alias("zones"),
    )


def moved_point(annotations: Column, item: str, t: Column, t_min: Column, t_max: Column) -> Column:
    """Annotations with the point of that id at another time, within the table's."""
    return _changed(annotations, item, {"t": F.least(F.greatest(t, t_min), t_max)}, {})


def moved_zone(annotations: Column, item: str, t0: Column, t1: Column, t_min: Column, t_max: Column) -> Column:
    """Annotations with the zone of that id between other times, swapped ones put right."""
    a, b = _span(t0, t1, t_min, t_max)
    return _changed(annotations, item, {}, {"t0": a, "t1": b})


def labelled(annotations: Column, item: str, label: str) -> Column:
    """Annotations with another label of the point or zone of that id."""
    return _changed(annotations, item, {"label": F.lit(label)}, {"label": F.lit(label)})


def listed(df: DataFrame, annotations: str) -> DataFrame:
    """(kind, id, t, t1, label): points by time, then zones by their beginning, as a table."""
    p = df.select(F.lit(0).alias("kind"), F.explode(f"{annotations}.points").alias("x")).select("kind", "x.id", "x.t", F.lit(None).cast("double").alias("t1"), "x.label")
    z = df.select(F.lit(1).alias("kind"), F.explode(f"{annotations}.zones").alias("x")).select("kind", "x.id", F.col("x.t0").alias("t"), "x.t1", "x.label")
    return p.unionByName(z).orderBy("kind", "t")


def json_field(payload: Column, field: str) -> Column:
    """A field of a JSON payload; if it can't be read, once more with doubled quotes made single."""
    return F.coalesce(F.get_json_object(payload, f"$.{field}"), F.get_json_object(F.replace(payload, F.lit('""'), F.lit('"')), f"$.{field}"))
