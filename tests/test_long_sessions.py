"""Queries over sessions longer than those of the small tables, against their SQL without tolerance."""

import duckdb
import numpy as np
import pytest

from pulsegrid.functions import dsp
from pulsegrid.plans import catalogue


def differences(spark, sf, name) -> int:
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    theirs = con.sql(catalogue.oracle_sql()[name]).df()
    mine = catalogue.queries()[name](spark, sf).toPandas()[list(theirs.columns)]
    con.register("mine", mine)
    con.register("theirs", theirs)
    assert len(mine) == len(theirs) > 0
    return len(con.sql("(FROM mine EXCEPT ALL FROM theirs) UNION ALL (FROM theirs EXCEPT ALL FROM mine)").fetchall())


@pytest.fixture(scope="module")
def long_events(tmp_path_factory):
    """Six copies of each session, one after the other, and one of 9 rows with halves to be rounded."""
    path = tmp_path_factory.mktemp("long")
    events = "'/root/testdata/sf0.01/events.parquet'"
    duckdb.sql(f"""COPY (SELECT event_id + 1000000 * k AS event_id, ts + to_days((30 * k)::INT) AS ts, user_id, event_type, value, props FROM {events}, range(6) t(k)
     UNION ALL SELECT -event_id - 1, ts, -1, event_type, floor(value) + 0.25, props FROM {events} WHERE event_id < 9) TO '{path}/events.parquet'""")
    return str(path)


@pytest.mark.parametrize("name", ["butter_filtfilt", "channel_repair_filled"])
def test_long_sessions_equal_their_sql(spark, long_events, name):
    assert differences(spark, long_events, name) == 0


def test_long_signals_are_filtered_precisely():
    b, a = dsp.butter(4, (0.5, 45.0), 250.0, "band")
    x = np.random.default_rng(1).normal(50, 40, 1000)
    y, _ = dsp.lfilter(b, a, x[:, None])
    z, exact = [np.longdouble(0)] * 8, []
    for e in x.astype(np.longdouble):
        exact.append(b[0] * e + z[0])
        z = [p * e - q * exact[-1] + r for p, q, r in zip(b[1:], a[1:], [*z[1:], 0])]
    assert np.abs(y[:, 0] - np.array(exact, float)).max() < 1e-6


def test_grids_of_fixes_are_not_joined(spark):
    from pulsegrid.operators import position
    from pulsegrid.operators import timeseries as ts

    rows = [("a", 0.0, 1.0, None), ("a", 0.6, None, 5.0), ("a", 1.7, 3.0, 6.0), ("a", 2.0, 2.0, None), ("b", 0.0, 1.0, 1.0), ("b", 0.5, 2.0, 4.0), ("c", 0.0, None, 1.0)]
    fixes = spark.createDataFrame(rows, "session_id string, t double, latitude double, longitude double")
    out = position.gps_grid(fixes, ["session_id"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # of edges of buckets
    one, other = (
        {(r.session_id, r.i): (r.t, r[c]) for r in ts.resample(fixes, ["session_id"], "t", c, 0.5, None, 600.0, inclusive=True).collect()} for c in ("latitude", "longitude")
    )
    assert {(r.session_id, r.i): (r.t, r.latitude, r.longitude) for r in out.collect()} == {k: (*one[k], other[k][1]) for k in one if k in other}
