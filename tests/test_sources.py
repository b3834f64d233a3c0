"""Files of sessions: headers, torn lines, events, ranging, settings, snapshots, and the pipeline over them."""

import json

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import events, position
from pulsegrid.plans import pipeline
from pulsegrid.sources import sessions as src
from pulsegrid.sources import sinks


def lines(spark, *texts):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "session_id string, seq long, line string")


@pytest.fixture
def root(tmp_path):
    for name, offset in (("a", 0), ("b c", 1.7e12)):
        raw = tmp_path / name / "rawData"
        raw.mkdir(parents=True)
        scale = 1000 if offset else 1
        raw.joinpath("gps.csv").write_text("".join(f"{offset + i * scale},{45 + i / 1000},{7 + i / 1000}\n" for i in range(0, 20, 2)))
        raw.joinpath("ppg.csv").write_text("t,v\n" + "".join(f"{offset + i * scale / 50},{i % 50}\n" for i in range(500)) + "12")
        raw.joinpath("rawEvents.csv").write_text("1000,TIMESTAMP,5\n1001,RECORDING_ONSET,'x'\n1002,WEB_TAB_UPDATE,complete,y\n1003,KEYPRESS,z\n")
    return str(tmp_path)


def test_sessions_and_their_files(spark, root):
    found = src.sessions(spark, root)
    assert [f.rpartition("/")[2] for f in found] == ["a", "b c"]
    rows = src.two_columns(spark, found, src.PULSE).groupBy("session_id").count().collect()
    assert {r.session_id: r["count"] for r in rows} == {"a": 500, "b c": 500}
    assert src.headset(spark, found).count() == 0 and src.two_columns(spark, [], src.PULSE).count() == 0


def test_the_first_usable_file_is_read(spark, tmp_path):
    raw = tmp_path / "s" / "rawData"
    raw.mkdir(parents=True)
    raw.joinpath("shimmer.csv").write_text("")
    raw.joinpath("rawShimmer_0.csv").write_text("1,2,3\n4,5,6\n")  # too narrow
    raw.joinpath("ppg.tmp").write_text("1,2\n3,4,5,6\n")  # ragged
    raw.joinpath("ppg.csv").write_text("1,7\n2,8\n3,9\n")
    (tmp_path / "t" / "rawData").mkdir(parents=True)
    (tmp_path / "t" / "rawData" / "shimmer.csv").write_text("1,0,0,0,5,6\n2,0,0,0,5,7\n")
    found = src.sessions(spark, str(tmp_path))
    rows = src.two_columns(spark, found, src.PULSE).orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.t, r.y) for r in rows] == [("s", 1, 7), ("s", 2, 8), ("s", 3, 9), ("t", 1, 6), ("t", 2, 7)]
    assert {r.session_id for r in src.two_columns(spark, found, src.SKIN).collect()} == {"t"}


def test_strict_numbers(spark, tmp_path):
    path = tmp_path / "s" / "rawData"
    path.mkdir(parents=True)
    path.joinpath("x.csv").write_text("a,b\n1,2\n3,4\n")
    assert [r.x for r in src.strict_numbers(spark, [str(path / "x.csv")], header=True).orderBy("seq").collect()] == [[1, 2], [3, 4]]
    with pytest.raises(Exception, match="malformed line 0"):
        src.strict_numbers(spark, [str(path / "x.csv")]).collect()


def test_layout_preflight_and_metrics(spark, tmp_path):
    folder = tmp_path / "s"
    assert src.preflight(spark, "") and src.preflight(spark, str(folder))
    folder.mkdir()
    (folder / "ppg.csv").write_text("1,2\n")
    (folder / "features").mkdir()
    assert src.preflight(spark, str(folder)) is None and (folder / "rawData" / "ppg.csv").exists() and (folder / "results").is_dir()
    assert src.preflight(spark, str(folder), "features/ppg/ppg_resampled.csv")
    (folder / "rawData" / "ppg.csv").unlink()
    (folder / "rawData" / ".ppg.csv.crc").unlink(missing_ok=True)
    assert src.preflight(spark, str(folder)) == "rawData is empty."
    out = str(tmp_path / "out")
    spark.createDataFrame([("s", 1.0)], "session_id string, Timestamp double").write.parquet(f"{out}/Arousal")
    assert src.available_metrics(spark, out, "s") == ["arousal"] and src.available_metrics(spark, out, "t") == []
    assert src.result(spark, out, "Cognition") is None and src.result(spark, out, "Arousal", "s").count() == 1
    bands = spark.createDataFrame([("T9", 1.0), ("T10", 2.0)], "channel string, power double")
    bands.write.parquet(f"{out}/bands")
    assert src.has_bands(spark, f"{out}/bands", {"channel", "power"}, {"T9", "T10"}) and not src.has_bands(spark, f"{out}/bands", {"channel"}, {"T9", "AF7"})


def test_numeric_rows(spark):
    whole = src.numeric_rows(lines(spark, "t,a", "1,2", "3,NULL", "5,"), 2).orderBy("seq").collect()
    assert [r.x for r in whole] == [[1, 2], [3, None], [5, None]]
    torn = src.numeric_rows(lines(spark, "1,2", "3,4", "5"), 2).collect()
    assert len(torn) == 2
    with pytest.raises(Exception, match="malformed line 1"):
        src.numeric_rows(lines(spark, "1,2", "x,4", "5,6"), 2).collect()


def test_raw_events(spark):
    out = src.raw_events(lines(spark, "10,START,a", "12,TIMESTAMP,99", "13,'CLICK',b,c", "short")).orderBy("seq").collect()
    assert [(r.ts, r.name, r.value) for r in out] == [(-1.0, "START", "a"), (2.0, "CLICK", "b,c")]
    none = src.raw_events(lines(spark, "10,START,a", "11,END,")).orderBy("seq").collect()
    assert [r.ts for r in none] == [1.0, 2.0]
    assert [r.name for r in src.simple_events(lines(spark, "1, a ,x", "x,b", "2")).collect()] == ["a"]


def test_event_routing_and_annotations(spark):
    df = spark.createDataFrame([("s", 1, 5.0, "RECORDING_ONSET", None), ("s", 2, 6.0, "WEB_TAB_UPDATE", "complete"), ("s", 3, 7.0, "KEYPRESS", ""), ("s", 4, 8.0, "MARK", '"[]"')], "session_id string, seq long, ts double, name string, value string")
    out = events.split_events(df, "name", "value").select("name", "output").collect()
    assert sorted(map(tuple, out)) == [("MARK", "feature"), ("RECORDING_ONSET", "feature"), ("WEB_TAB_UPDATE", "feature"), ("WEB_TAB_UPDATE", "web")]
    more = df.unionByName(spark.createDataFrame([("s", i, 9.0, n, "") for i, n in enumerate(("RECIPE_CONFIG", "SYSTEM_CONFIG", "CONSENT_INFO"), 5)], df.schema))
    seeded = events.seed_annotations(more, ["session_id"], "seq")
    assert {(r.label, r.t) for r in seeded.collect()} == {("WEB_TAB_UPDATE", 1.0), ("KEYPRESS", 2.0), ("MARK", 3.0)}
    document = json.loads(events.annotation_documents(seeded, ["session_id"], "seq").first().annotations)
    assert [p["label"] for p in document["points"]] == ["WEB_TAB_UPDATE", "KEYPRESS", "MARK"] and document["zones"] == [] and document["version"] == 1
    assert len({p["id"] for p in document["points"]}) == 3 and all(len(p["id"]) == 36 for p in document["points"])
    assert [r.value for r in events.processed(df.filter("seq = 4")).collect()] == [""]
    text = json.dumps({"points": [{"id": "p", "t": 99}, {"id": "q"}], "zones": [{"id": "z", "t0": 5, "t1": 2, "visible": False}, {"id": "e", "t0": 1, "t1": 1}]})
    a = spark.createDataFrame([(text,)], "x string").select(events.read_annotations(F.col("x"), F.lit(0.0), F.lit(10.0)).alias("a"))
    row = a.first().a
    assert [(p.id, p.t, p.label, p.visible) for p in row.points] == [("p", 10.0, "Event", True)]
    assert [(z.id, z.t0, z.t1, z.label, z.visible) for z in row.zones] == [("z", 2.0, 5.0, "Zone", False)]
    more = a.select(events.with_point(F.col("a"), "n", F.lit(-1.0), F.lit(0.0), F.lit(10.0)).alias("a"))
    assert [(r.kind, r.id) for r in events.listed(more.select(events.without(F.col("a"), "p").alias("a")), "a").collect()] == [(0, "n"), (1, "z")]


def test_ranging(spark):
    frames = src.ranging_frames(lines(
        spark, "1000,HELLO", '1500,DIST,4,0,"A",0,0,0,5,1,B,6,0,0,5,2,C,0,8,0,5,3,D,6,8,0,5', "2000,DIST,2,0,A,0,0,0,5,1,B,6,0,0,5", "2500,DIST,1,0,A,0,0,0,2.5", "2600,DIST,0", "2700,DIST,3,0,A,0",
    ))
    out = {r.t: (r.x, r.y) for r in position.positions(frames, ["session_id"], "t").collect()}
    assert set(out) == {0.5, 1.0, 1.5} and out[0.5] == pytest.approx((3, 4), abs=1e-3) and out[1.0] == pytest.approx((3, 4), abs=1e-2)
    assert out[1.5] == pytest.approx((1.5, 2.0), abs=1e-2)
    assert position.antennas(frames, ["session_id"], "t").count() == 4


def test_columns_and_settings(spark):
    names = ["Unnamed: 0", "timestamp", "HEAD_R", "AF7_RMS", "CHEEK_R", "CHEEK_L", "EAR_R", "FOREHEAD_L", "BROW", "NOSE"]
    df = spark.createDataFrame([tuple(float(i) for i in range(10))], names)
    assert src.canonical_columns(df).columns == ["Timestamp", "AF8", "AF7", "CHEEK_R", "CHEEK_L", "EAR_R", "AFz", "BROW_L", "NOSE"]
    with pytest.raises(ValueError, match="both AF8"):
        src.canonical_columns(df.withColumn("AF8", F.lit(1)))
    with pytest.raises(ValueError, match="missing"):
        src.canonical_columns(df.drop("NOSE"))
    assert src.settings({"data_root": "a", "screen_id": "s"}, '{"data_root": "b"}', {"data_root": " "}) == src.Settings("b", None, "s")


def test_snapshots(spark, tmp_path):
    path = f"{tmp_path}/rms"
    with pytest.raises(FileNotFoundError):
        sinks.revert(spark, path)
    spark.range(3).write.parquet(path)
    assert sinks.snapshot_once(spark, path) and not sinks.snapshot_once(spark, path)
    spark.range(9).write.mode("overwrite").parquet(path)
    sinks.revert(spark, path, f"{tmp_path}/log")
    assert spark.read.parquet(path).count() == 3 and sinks.last_lines(spark, f"{tmp_path}/log").count() == 1


def test_pipeline_runs_skips_and_goes_on_after_a_failure(spark, root, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    broken = pipeline.Step("Broken", lambda s, f: s.table("nowhere"))
    steps = [broken, pipeline.Step("Gps", pipeline.gps), pipeline.Step("Events", pipeline.event_outputs)]
    log = {(r.session_id, r.step): r.ok for r in pipeline.run(spark, root, out, steps).collect()}
    assert log == {(s, n): n != "Broken" for s in ("a", "b c") for n in ("Broken", "Gps", "Events")}
    gps = spark.read.parquet(f"{out}/Gps").filter("session_id = 'a'").orderBy("i").collect()
    assert len(gps) == 37 and gps[5].t == 2.5 and abs(gps[5].latitude - 45.0025) < 1e-9
    assert pipeline.run(spark, root, out, steps[1:]).count() == 6


def test_one_bad_session_doesn_t_stop_the_others(spark, root, tmp_path):
    import os

    os.makedirs(f"{root}/bad/rawData")
    with open(f"{root}/bad/rawData/gps.csv", "w") as f:
        f.write("0,45,7\n1,no,7\n2,45,7\n3,45,7\n")
    log = pipeline.run(spark, root, str(tmp_path / "out"), [pipeline.Step("Gps", pipeline.gps_table)]).collect()
    assert {r.session_id: r.ok for r in log} == {"a": True, "b c": True, "bad": False}
    assert "malformed line 1" in next(r.message for r in log if not r.ok)
    assert set(spark.read.parquet(f"{tmp_path}/out/gpsDf").columns) == {"session_id", "Timestamp", "Latitude", "Longitude"}


def test_heart_step(spark, root):
    found = pipeline.heart_dynamics(spark, src.sessions(spark, root)).toPandas()
    assert set(found.session_id) <= {"a", "b c"}


def test_interval_tables(spark):
    df = spark.createDataFrame([("OFFSET", 10.0, 11.0, ""), ("a", 12.0, 15.0, "[x]"), ("FIN", 20.0, 21.0, "")], "EventName string, Start double, End double, Value string")
    assert [tuple(r) for r in src.labelled_intervals(df).collect()] == [("a", 2.0, 5.0, "x")]
    ev = spark.createDataFrame([(5.0, "X", ""), (7.0, "EXPRESSION", '{"emotion":"Joy"}'), (8.0, "EXPRESSION", '{""emotion"":""Fear""}')], "timestamp double, tag string, values string")
    assert [tuple(r) for r in src.expression_events(ev).collect()] == [(2.0, "Joy"), (3.0, "Fear")]
    at = src.bracketed_positions(lines(spark, "[1.5 2 3]", "None", "[4, 5, 6]")).orderBy("seq").collect()
    assert [(r.x, r.y, r.z) for r in at] == [(1.5, 2.0, 3.0), (4.0, 5.0, 6.0)]


def test_many_zones_by_cells_equal_few(spark, monkeypatch):
    from pulsegrid.operators import joins

    zones = spark.createDataFrame([(i, f"z{i}", float(i % 5), float(i // 5), 1.5, 0.5 + i % 3) for i in range(20)], "seq int, label string, x double, y double, w double, h double")
    points = spark.createDataFrame([(x / 3, y / 3) for x in range(20) for y in range(20)], "x double, y double")
    for y_only in (False, True):
        few = sorted(map(str, joins.containment_last_wins(points, zones, "seq", "label", y_only).collect()))
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
        many = sorted(map(str, joins.containment_last_wins(points, zones, "seq", "label", y_only).collect()))
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 10_000)
        assert few == many


def test_legacy_headset_is_referenced(spark, tmp_path):
    raw = tmp_path / "s" / "rawData"
    raw.mkdir(parents=True)
    raw.joinpath("eeg.csv").write_text("t,a,b,c,d,e,f,g,h\n0,1,2,3,4,10,6,7,8\n4,1,2,3,4,20,6,7,NULL\n")
    found = src.sessions(spark, str(tmp_path))
    plain, referenced = (f(spark, found).orderBy("seq").collect() for f in (src.headset, src.legacy_headset))
    assert [(r.t, r.AF8, r.EAR_R, r.NOSE) for r in plain] == [(0, 1, 10, 8), (4, 1, 20, None)]
    assert [(r.t, r.AF8, r.EAR_R, r.NOSE) for r in referenced] == [(0, -4, 5, 3), (4, -9, 10, None)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(0.5, 45.123456789, None), (1.0, None, 7.1)], "Timestamp double, Latitude double, Longitude double")
    sinks.export_csv(df.coalesce(1).orderBy("Timestamp"), f"{tmp_path}/gps", "gpsDf")
    text = next((tmp_path / "gps").glob("part-*.csv")).read_text().split()
    assert text == ["Timestamp,Latitude,Longitude", "0.5,45.1234568,NULL", "1.0,NULL,7.1000000"]
    rows = spark.createDataFrame([("s", 1, 5.0, "MARK", 'say "x"'), ("s", 2, 6.5, "END", "[]")], "session_id string, seq long, ts double, name string, value string")
    done = events.processed(rows, ["seq"]).coalesce(1).orderBy("seq")
    sinks.write_headerless(done, f"{tmp_path}/events", ["name", "state", "ms", "extra", "value"])
    lines_ = next((tmp_path / "events").glob("part-*.csv")).read_text().splitlines()
    assert lines_ == ["MARK,PROCESSED,5000.0,,say x", "END,PROCESSED,6500.0,,"]
