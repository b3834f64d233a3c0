"""Live operators on file streams give the tables' rows."""

import numpy as np
import pytest

from pulsegrid.functions import scalar
from pulsegrid.streaming import live, packets


def packet(seq, rows=10, value=1):
    return bytes([seq]) + b"".join((value + c).to_bytes(3, "big", signed=True) for _ in range(rows) for c in range(8)) + b"\x01"


def run_stream(spark, df, build, tmp_path, name, parts=3):
    """The stream's result over the rows in files, written one after the other and read one at a time."""
    src, key = f"{tmp_path}/{name}", "n" if "n" in df.columns else "arrived"
    step = -(-(df.agg({key: "max"}).first()[0] + 1) // parts)
    for k in range(parts):
        df.filter(f"{key} >= {k * step} and {key} < {(k + 1) * step}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append")
    q.option("checkpointLocation", f"{tmp_path}/{name}_cp").trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name)


def sent(spark, seqs):
    return spark.createDataFrame([("d", i, packet(s, value=i)) for i, s in enumerate(seqs)], "device_id string, arrived long, packet binary")


def places(rows):
    """Each packet of ten rows as the value of its first channel, None where it was lost."""
    unit = 2 * 4.5e6 / (12 * 2**24)
    return [None if rows.AF8.isna()[k] else round(rows.AF8[k] / unit) for k in range(0, len(rows), 10)]


def test_losses_late_packets_and_duplicates(spark):
    out = packets.batch_rows(sent(spark, [126, 127, 0, 3, 2, 3, 4])).orderBy("n").toPandas()
    assert out.n.tolist() == list(range(70)) and places(out) == [0, 1, 2, None, 4, 3, 6]  # 1 is lost, the late 2 takes its place, the second 3 is left out
    assert packets.distance(127, 0) == 1 and packets.distance(0, 127) == -1 and packets.distance(5, 5) == 0
    held = packets.batch_rows(sent(spark, [126, 127, 0, 3, 2, 3, 4]), flush=False).orderBy("n").toPandas()
    assert places(held) == [0, 1, 2]  # 1 may still come
    late = packets.batch_rows(sent(spark, [0, *range(2, 13), 1, 13])).orderBy("n").toPandas()
    assert places(late) == [0, None, *range(1, 12), 13]  # 1 comes after ten others and is left out


def test_stream_of_packets_is_the_table(spark, tmp_path):
    df = sent(spark, [1, 2, 4, 5, 3, 9, *range(10, 22), 6])
    got = run_stream(spark, df, packets.live_rows, tmp_path, "packets").orderBy("n").toPandas()
    want = packets.batch_rows(df, flush=False).orderBy("n").toPandas()
    assert got.equals(want) and places(want)[:9] == [0, 1, 4, 2, 3, None, None, None, 5]


def test_a_full_queue_drops_the_oldest(spark, tmp_path):
    got = run_stream(spark, sent(spark, range(30)), lambda s: packets.live_rows(s, hold=0, queue=4), tmp_path, "queue", parts=3).orderBy("n").toPandas()
    assert [p for p in places(got) if p is not None] == [6, 7, 8, 9, 16, 17, 18, 19, 26, 27, 28, 29] and places(got)[4:10] == [None] * 6


def test_packets_from_a_landing_folder(spark, tmp_path):
    for number, seqs in ((0, [1, 2]), (1, [3])):
        framed = b"".join(len(packet(s)).to_bytes(2, "little") + packet(s, value=s) for s in seqs)
        (tmp_path / f"dev-{number}.bin").write_bytes(framed + b"\x09\x00torn")
    q = packets.packet_source(spark, str(tmp_path), 1).writeStream.format("memory").queryName("landed").option("checkpointLocation", f"{tmp_path}_cp")
    q.trigger(availableNow=True).start().awaitTermination(120)
    rows = spark.table("landed").orderBy("arrived").collect()
    assert [(r.device_id, r.arrived, r.packet[0]) for r in rows] == [("dev", 0, 1), ("dev", 1, 2), ("dev", 1 << 32, 3)]


def test_commands(spark):
    out = packets.commands(spark.createDataFrame([("a",), ("b",)], "id string"), "START").orderBy("topic").collect()
    assert [(r.topic, r.message) for r in out] == [("devices/a/command", '{"command":"START"}'), ("devices/b/command", '{"command":"START"}')]
    with pytest.raises(ValueError):
        packets.commands(spark.createDataFrame([("a",)], "id string"), "JUMP")


def test_live_scores_are_the_tables(spark, tmp_path):
    from pulsegrid.operators.emotions import Model, infer

    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 2)) * np.where(np.arange(2000)[:, None] // 300 == 2, 40.0, 3.0)
    df = spark.createDataFrame([("d", i, float(a), float(b)) for i, (a, b) in enumerate(x)], "device_id string, n long, a double, b double")
    model = Model([1.0, -1.0, 0.3], 0.1, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], [0.0, 0.2], ["A", "B"], gate=6.0, cooldown=2)
    windows = live.batch_windows(df, ["a", "b"])
    want = live.live_scores(windows, model).orderBy("k").toPandas()
    got = run_stream(spark, df, lambda s: live.live_windows(s, ["a", "b"]), tmp_path, "scored_windows").orderBy("k")
    assert got.count() == windows.count()
    streamed = run_stream(spark, windows.withColumnRenamed("n_last", "n"), lambda s: live.live_scores(s.withColumnRenamed("n", "n_last"), model), tmp_path, "scores").orderBy("k").toPandas()
    from pulsegrid.functions import scalar
    from pyspark.sql import functions as F

    table = infer(windows.withColumn("x", scalar.l2_with_mean(F.col("rms"))), ["device_id"], ["k"], "x", model).orderBy("k").toPandas()
    assert want.gated.tolist() == streamed.gated.tolist() == table.gated.tolist() and 3 < want.gated.sum() < len(want)
    assert want.label.tolist() == streamed.label.tolist() == table.label.tolist() and np.allclose(want.confidence, table.confidence)
    assert want.time_sec.tolist() == [(250 + 125 * k) / 250 for k in want.k]


def test_live_filter_and_scroll_buffer(spark, tmp_path):
    from pulsegrid.functions import dsp

    x = np.random.default_rng(9).normal(size=(300, 2))
    df = spark.createDataFrame([("d", i, float(a), float(b)) for i, (a, b) in enumerate(x)], "device_id string, n long, y double, ear double")
    got = run_stream(spark, df, lambda s: live.live_filter(s, ["y"], reference="ear"), tmp_path, "filtered").orderBy("n").toPandas()
    b, a = dsp.butter(2, (15.0, 30.0), 250.0, "band")
    assert np.allclose(got.y, dsp.lfilter(b, a, x[:, 0] - x[:, 1] / 2)[0])
    src = f"{tmp_path}/scroll"
    df.coalesce(1).write.parquet(src)
    q = live.scroll_buffer(spark.readStream.schema(df.schema).parquet(src), ["y"], 50).writeStream.format("memory").queryName("scroll").outputMode("update")
    q.option("checkpointLocation", f"{tmp_path}/scroll_cp").trigger(availableNow=True).start().awaitTermination(120)
    last = spark.table("scroll").orderBy("n_last").collect()[-1]
    assert last.n_last == 299 and np.allclose(last.y, x[-50:, 0])


def test_soft_clipped_windows(spark):
    from pulsegrid.functions import dsp

    x = np.random.default_rng(4).normal(size=700) * 200
    df = spark.createDataFrame([("d", i, float(v)) for i, v in enumerate(x)], "device_id string, n long, y double")
    out = live.batch_windows(df, ["y"], size=500, step=125, clip=80.0).orderBy("k").collect()
    b, a = dsp.butter(4, (15.0, 45.0), 250.0, "band")
    y = 80 * np.tanh(dsp.lfilter(b, a, x[:, None], dsp.steady_state(b, a)[:, None] * x[:1])[0][:, 0] / 80)
    assert [r.n_last for r in out] == [499, 624] and np.allclose([r.rms[0] for r in out], [np.sqrt((y[k : k + 500] ** 2).mean()) for k in (0, 125)])


def test_stream_of_windows_is_the_table(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=900)
    df = spark.createDataFrame([(d, i, float(v)) for d in "ab" for i, v in enumerate(x)], "device_id string, n long, y double")
    got = run_stream(spark, df, lambda s: live.live_windows(s, ["y"]), tmp_path, "windows").orderBy("device_id", "k").toPandas()
    want = live.batch_windows(df, ["y"]).orderBy("device_id", "k").toPandas()
    assert len(got) == len(want) == 2 * 6 and got.n_last.tolist() == want.n_last.tolist()
    assert np.allclose([r[0] for r in got.rms], [r[0] for r in want.rms])


def test_device_status(spark):
    rows = [('{"id": "a", "recording": true, "battery": 50}', 1), ('{"id": "a", "battery": 40}', 2), ("{}", 3)]
    df = spark.createDataFrame(rows, "value string, timestamp long")
    out = {r.id: (r.recording, r.battery, r.last_seen) for r in packets.device_status(df).collect()}
    assert out == {"a": (False, 40, 2), "device": (False, -1, 3)}


def test_decoders(spark):
    from pyspark.sql import functions as F

    raw = spark.createDataFrame([(bytearray(b"\xff\xff\xfe\x01\x02"),)], "p binary")
    r = raw.select(scalar.int24(F.col("p"), 0).alias("a"), scalar.int16_little(F.col("p"), 3).alias("b"), scalar.int16_little(F.col("p"), 0).alias("c")).first()
    assert (r.a, r.b, r.c) == (-2, 513, -1)
    frame = b"\0" * 4 + b"".join(v.to_bytes(2, "little") for v in (1, 2, 3, 4095, 0x4000 | 2000))
    w = packets.wristband_rows(spark.createDataFrame([("d", 1, bytearray(frame)), ("d", 2, bytearray(b"x"))], "device_id string, t long, frame binary")).collect()
    assert len(w) == 1 and w[0].ppg_mv == pytest.approx(3000) and w[0].eda_kohm == pytest.approx(287 / (2000 * 3 / 4095 / 0.5 - 1))
    m = packets.motion_rows(spark.createDataFrame([("d", bytearray((1000).to_bytes(2, "little") * 9))], "device_id string, packet binary")).first()
    assert m.acc_x == pytest.approx(0.061 * 1000 / 1000)


def test_recorded_rows_and_recordings(spark, tmp_path):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("d", start + datetime.timedelta(seconds=s), s) for s in (0, 1, 2, 20, 21, 60)], "device_id string, at timestamp, n long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = packets.record(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    q = live.recordings(stream, "at").writeStream.format("memory").queryName("cut").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp2")
    q.trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.n for r in spark.table("cut").collect()) == [2, 3]  # the last recording is still open
