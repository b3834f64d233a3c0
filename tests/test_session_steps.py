"""Whole steps over files of a synthetic session with known answers."""

import numpy as np
import pytest

from pulsegrid.operators.emotions import EMOTIONS, Model
from pulsegrid.plans import pipeline
from pulsegrid.sources import sessions as src


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sessions")
    raw = root / "s1" / "rawData"
    raw.mkdir(parents=True)
    t = np.arange(5000) / 250
    rng = np.random.default_rng(7)
    x = 20 * np.sin(2 * np.pi * 10 * t)[:, None] + rng.normal(size=(5000, 8))
    x[:, 4] = 30 * np.sin(2 * np.pi * 18 * t) + rng.normal(size=5000)  # the ear channel makes T9 and T10
    raw.joinpath("rawEEG_0.csv").write_text("\n".join(",".join(map(str, [a, *b])) for a, b in zip((t * 1000 + 1.7e12).tolist(), x.round(4).tolist())))
    s = np.arange(int(60 * 51.2)) / 51.2
    beats = sum(np.exp(-(((s - b) / 0.08) ** 2)) for b in np.arange(0.5, 59.5, 60 / 66))
    skin = 1000 / (5 + np.where(s > 30, 2 * (np.exp(-(s - 30) / 2) - np.exp(-(s - 30) / 0.7)), 0))
    raw.joinpath("shimmer.csv").write_text("\n".join(f"{a},0,0,0,{k},{p}" for a, k, p in zip(s.tolist(), skin.tolist(), beats.tolist())))
    return src.sessions(spark, str(root))


def test_cognition_step(spark, folders):
    out = pipeline.cognition(spark, folders).toPandas()
    inner = out[(out.t > 2) & (out.t < 17)]
    assert len(out) >= 38 and inner.engagement.min() > 3 and inner.focus.notna().all()  # beta dominates T9 and T10


def test_artefacts_leave_no_index(spark, folders, tmp_path):
    from pathlib import Path

    rows = [line.split(",") for line in (Path(folders[0].removeprefix("file:")) / "rawData" / "rawEEG_0.csv").read_text().splitlines()]
    raw = tmp_path / "loud" / "rawData"
    raw.mkdir(parents=True)
    for i in range(2000, 2750):  # 8 s to 11 s: the ear channel is four times as loud
        rows[i][5] = str(4 * float(rows[i][5]))
    (raw / "rawEEG_0.csv").write_text("\n".join(map(",".join, rows)))
    loud = pipeline.cognition_tables(spark, src.sessions(spark, str(tmp_path)))
    stats = loud["artefactStats"].first()
    assert stats.n_epochs_total == 20 and stats.n_epochs_rejected == stats.n_rejected_by_ptp + stats.n_rejected_by_peak_amp == 3 and stats.pct_samples_flagged == 15.0
    out = loud["Cognition"].toPandas().set_index("Timestamp").sort_index()
    assert out.Engagement.loc[9.0:10.0].isna().all() and out.Engagement.loc[2.0:6.5].notna().all() and out.Engagement.loc[13.0:17.0].notna().all()
    bands = loud["powerBands"].filter("channel = 'T9' and band = 'beta'").toPandas()
    assert bands.power.isna().sum() == 7 and len(bands) == 37  # windows with more than a quarter in those seconds
    assert set(loud["temporalBandPowers"].columns) >= {"avg_beta", "all_power", "rel_gamma"}


def test_every_step_and_its_tables(spark, folders, tmp_path):
    from pathlib import Path

    root = Path(folders[0].removeprefix("file:")).parent
    raw = root / "s1" / "rawData"
    raw.joinpath("gps.csv").write_text("".join(f"{i},45,{7 + i / 1000}\n" for i in range(0, 20, 2)))
    raw.joinpath("uwb_0.csv").write_text("1000,HELLO\n1500,DIST,4,0,A,0,0,0,5,1,B,6,0,0,5,2,C,0,8,0,5,3,D,6,8,0,5\n")
    raw.joinpath("rawEvents.csv").write_text("1000,TIMESTAMP,5\n1001,RECORDING_ONSET,'x'\n1010,MARK,y\n1020,NULL,z\n")
    raw.joinpath("event.csv").write_text("1001,RECORDING_ONSET\n1010,MARK\n")
    coef = [[1.0 if j == i else 0.0 for j in range(9)] for i in range(7)]
    model = Model([0.0] * 9, 2.0, coef, [0.0] * 7, gate=None)
    zones = spark.createDataFrame([(1, "room", 0.0, 0.0, 5.0, 5.0)], "seq int, label string, x double, y double, w double, h double")
    out = str(tmp_path / "out")
    steps = pipeline.default_steps(out, model, None, zones)
    log = pipeline.run(spark, str(root), out, steps).collect()
    assert all(r.ok for r in log), [(r.step, r.message) for r in log if not r.ok]
    columns = {
        "HeartDynamics": {"Timestamp", "mean_hr", "n_beats"}, "ppg_normalized": {"Timestamp", "Value"}, "ppg_resampled": {"Timestamp", "Value"},
        "ppg_resampling": {"n_raw", "n_grid", "n_added"}, "Arousal": {"Timestamp", "TonicEDA", "PhasicEDA"},
        "SCR_events": {"Timestamp", "Amplitude", "Prominence"}, "Cognition": {"Timestamp", "Engagement", "Focus", "CognitiveLoad", "Frontal", "Lateralization"},
        "powerBands": {"Timestamp", "channel", "band", "power"}, "artefactStats": {"n_epochs_total", "n_rejected_by_emg_ratio"}, "Events": {"ts", "output"},
        "feature_events": {"name", "state", "ms", "extra", "value"}, "Annotations": {"annotations"}, "positions": {"Timestamp", "x", "y", "z"}, "antennas": {"id", "x"},
        "zones": {"Timestamp", "ROI"}, "gpsDf": {"Timestamp", "Latitude", "Longitude"}, "rmsSignals": {"Timestamp", "AF8"},
        "emotionClassifierInputs": {"Timestamp", "AVG_RMS", "PredictedLabel", "PredictedConfidence"}, "Emotions": {"Timestamp", "Neutral", *EMOTIONS},
        "Dataframe": {"Timestamp", "TonicEDA", "Happiness", "Tag"}, "emotionsDataframe": {"emotion", "active"}, "MetaInfo": {"duration", "readable"},
    }
    for name, expected in columns.items():
        assert expected <= set(src.result(spark, out, name).columns), name
    assert src.result(spark, out, "eda_gaps") is None and src.result(spark, out, "web_events") is None  # there were none
    wide = spark.read.parquet(f"{out}/Dataframe").toPandas().set_index("Timestamp").sort_index()
    assert wide.Tag.loc[2.0:10.5].eq("RECORDING_ONSET").all() and wide.Tag.loc[11.0:21.0].eq("MARK").all() and wide.Tag.loc[21.5:].isna().all() and wide.Tag.loc[:1.5].isna().all()
    assert spark.read.parquet(f"{out}/zones").first().ROI == "room" and spark.read.parquet(f"{out}/SCR_events").count() >= 1
    assert src.available_metrics(spark, out, "s1") == ["emotions", "arousal", "cognition", "heartdynamics"]
    assert pipeline.run(spark, str(root), out, steps).count() == len(log)  # nothing is done twice
    fixed = pipeline.run(spark, str(root), out, [pipeline.Step("HeartRefixed", pipeline.pulse_refix(out))])
    assert fixed.filter("step = 'HeartRefixed' and ok").count() == 1 and abs(spark.read.parquet(f"{out}/HeartRefixed").toPandas().mean_hr.median() - 66) < 2


def test_a_model_in_a_folder(spark, tmp_path):
    import json

    from pulsegrid.operators import emotions as emo

    with pytest.raises(FileNotFoundError, match="parameters.json"):
        emo.load_model(spark, str(tmp_path))
    coef = [[float(i == j) for j in range(9)] for i in range(7)]
    for name, content in (
        ("parameters.json", {"active_coef": [0.0] * 9, "active_intercept": 1.0, "class_coef": coef, "class_intercept": [0.0] * 7, "precision": np.eye(9).tolist()}),
        ("feature_columns.json", emo.FEATURES), ("config.json", {"stage2_classes": sorted(EMOTIONS), "knn_k": 3, "lda_ensemble_weight": 0.5, "knn_ensemble_weight": 0.5, "theta": 0.4}),
    ):
        (tmp_path / name).write_text(json.dumps(content))
    model, training = emo.load_model(spark, str(tmp_path))
    assert training is None and not model.gated and model.all_classes == ["Neutral", *sorted(EMOTIONS)] and (model.neighbours, model.threshold) == (3, 0.4)
    (tmp_path / "artefact_config.json").write_text(json.dumps({"threshold": 14.5}))
    vectors = [(i, [float(i == j) for j in range(9)], sorted(EMOTIONS)[i % 7]) for i in range(9)]
    spark.createDataFrame(vectors, "id long, vector array<double>, label string").write.parquet(f"{tmp_path}/neighbours.parquet")
    model, training = emo.load_model(spark, str(tmp_path), cooldown=1, gate=35.0)
    assert model.gate == 35.0 and model.cooldown == 1 and emo.load_model(spark, str(tmp_path))[0].gate == 14.5
    rows = [("s", k, [float(j == 2) for j in range(9)]) for k in range(3)] + [("t", 0, None), ("t", 1, [0.0] * 8 + [99.0])]
    df = spark.createDataFrame(rows, "session_id string, k int, x array<double>")
    out = {(r.session_id, r.k): r for r in emo.ensemble(df, ["session_id"], ["k"], "x", model, training).collect()}
    assert len(out) == 5 and out["s", 1].label == sorted(EMOTIONS)[2] and out["t", 0].label is None and out["t", 1].gated and out["t", 1].Neutral == 1
    votes = np.zeros(7)
    votes[[2, 0, 1]] = 1 / 3  # itself, then equally far ones by id
    lda = np.exp(np.eye(7)[2]) / np.exp(np.eye(7)[2]).sum()
    assert abs(out["s", 0].confidence - (0.5 * lda + 0.5 * votes).max()) < 1e-9
    assert emo.TrainingConfig().windows == 4


def test_heart_step(spark, folders):
    out = pipeline.heart_dynamics(spark, folders).toPandas()
    assert abs(out.mean_hr.median() - 66) < 2 and out.mean_hr[:5].isna().all() and out.n_beats.max() >= 30


def test_arousal_step(spark, folders):
    out = pipeline.arousal(spark, folders).toPandas().sort_values("bin")
    assert len(out) == 120 and out.tonic.between(4, 7.5).all()
    assert out.phasic[out.bin.between(61, 70)].max() > 3 * out.phasic[out.bin.between(10, 50)].abs().max()


def test_emotion_step_and_meta(spark, folders):
    coef = [[1.0 if j == i else 0.0 for j in range(9)] for i in range(7)]
    model = Model([0.0] * 9, 2.0, coef, [0.0] * 7, gate=None)
    out = pipeline.emotions(model)(spark, folders).toPandas()
    inner = out[(out.t > 1) & (out.t < 18)]
    assert np.allclose(inner[EMOTIONS].sum(1) + inner.Neutral, 1) and np.allclose(inner.Neutral, 1 - 1 / (1 + np.exp(-2)))
    assert (inner[EMOTIONS].idxmax(1) == EMOTIONS[4]).all()  # the ear channel is the loudest within 15 to 45 Hz
    meta = pipeline.meta_info(spark, folders).first()
    assert meta.readable and meta.duration == 60.0


def test_inference_rules(spark):
    from pulsegrid.operators.emotions import NEUTRAL, infer

    model = Model([1.0, 0.0], 0.0, [[0.0, 0.0], [1.0, 0.0]], [0.0, 0.0], ["A", "B"], gate=10.0, cooldown=1)
    rows = [("s", 0, [2.0, 1.0]), ("s", 1, [2.0, 11.0]), ("s", 2, [2.0, 10.0]), ("s", 3, [-1.0, 0.0]), ("s", 4, None), ("s", 5, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "session_id string, k int, x array<double>")
    votes = spark.createDataFrame([(0, "A", 1.0), (5, "B", 1.0)], "k int, label string, share double")
    out = {r.k: r for r in infer(df, ["session_id"], ["k"], "x", model, votes).collect()}
    active, b = 1 / (1 + np.exp(-2)), 1 / (1 + np.exp(-2))
    assert out[0].label == "B" and abs(out[0].confidence - 0.6 * b) < 1e-9 and abs(out[0].A - active * (0.6 * (1 - b) + 0.4)) < 1e-9
    assert [out[k].gated for k in range(4)] == [False, True, True, False]  # equality with the gate passes; the next window is cooled down
    assert out[1].label == NEUTRAL and out[1].Neutral == 1 and out[1].confidence == 1 and out[1].A == 0
    assert out[3].label == NEUTRAL and out[3].confidence == 1 - out[3].p_active and out[4].label is None and out[4].Neutral is None
    with pytest.raises(Exception, match="needs 2 values"):
        infer(spark.createDataFrame([("s", 0, [1.0])], df.schema), ["session_id"], ["k"], "x", model).collect()
