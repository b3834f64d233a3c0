"""The query catalogue: the analytics operators over the driver's tables, each with the SQL that gives the same rows.

Here are the relational operators; `row_queries` has those on single rows and on lines of files, `signal_queries` the signal kernels. Grids are hours and
gaps are days, as events of a user are hours apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import scalar
from pulsegrid.operators import aggregates as agg
from pulsegrid.operators import joins
from pulsegrid.operators import timeseries as ts
from pulsegrid.plans import row_queries, signal_queries
from pulsegrid.plans.registry import BUCKET, DAY, HOUR, KEYS, Register, seconds, signal, table
from pulsegrid.plans.registry import IDX as _IDX
from pulsegrid.plans.registry import indexed as _indexed

#: What lies between the orders' times and the events', so that the ones are among the others.
SHIFT = 26 * 365 * DAY
_register = Register()


def _query(sql: str):
    own = sql.lstrip().startswith("WITH RECURSIVE") or "--own" in sql
    return _register.query(sql, signal=not own)


@_query("SELECT session_id, event_id, round(t - first_value(t) OVER (PARTITION BY session_id ORDER BY t, event_id), 3) AS t FROM sig")
def ts_normalise(spark, sf):
    """Epoch times to seconds from the start of the recording."""
    df = signal(spark, sf).withColumn("ms", F.col("t") * 1000)
    return ts.normalise_time(df, KEYS, "ms", "t").select("session_id", "event_id", F.round("ms", 3).alias("t"))


@_query(f"""SELECT session_id, event_id, round(g, 3) AS gap FROM
  (SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY t) - t AS g FROM sig) WHERE g >= {DAY}""")
def gap_detect(spark, sf):
    """Samples that a gap follows."""
    df = signal(spark, sf).withColumn("g", ts.gap_after(KEYS, "t"))
    return df.filter(F.col("g") >= DAY).select("session_id", "event_id", F.round("g", 3).alias("gap"))


_GRID = f""", span AS (SELECT session_id, min(t) AS t0, max(t) AS t1 FROM sig GROUP BY 1),
 grid AS (SELECT session_id, i::INT AS i, t0 + i * {HOUR} AS t FROM (SELECT *, unnest(range(0, ceil((t1 - t0) / {HOUR})::BIGINT)) AS i FROM span)),
 smp AS (SELECT session_id, t, y, t - lag(t) OVER w AS before, lead(t) OVER w - t AS after FROM sig WINDOW w AS (PARTITION BY session_id ORDER BY t)),
 near AS (SELECT g.session_id, g.i, g.t, p.t AS pt, p.y AS py, p.after AS pa, n.t AS nt, n.y AS ny, n.before AS nb
  FROM grid g ASOF LEFT JOIN smp p ON g.session_id = p.session_id AND g.t >= p.t
  ASOF LEFT JOIN smp n ON g.session_id = n.session_id AND g.t <= n.t),
 res AS (SELECT session_id, i, t, coalesce(pa >= {DAY} OR (nt = t AND nb >= {DAY}), false) AS in_gap,
  CASE WHEN nt > pt THEN py + (ny - py) * (t - pt) / (nt - pt) ELSE py END AS y FROM near)
"""


@_query(_GRID + "SELECT session_id, i, in_gap, round(CASE WHEN NOT in_gap THEN y END, 4) AS y FROM res")
def grid_interp(spark, sf):
    """Gap-aware resampling to the hour grid."""
    out = ts.resample(signal(spark, sf), KEYS, "t", "y", HOUR, DAY, BUCKET)
    return out.select("session_id", "i", "in_gap", F.round("y", 4).alias("y"))


@_query(_GRID + """, raw AS (SELECT session_id, count(*) AS n_raw, max(t) - min(t) AS duration FROM sig GROUP BY 1)
 SELECT session_id, n_raw, round(duration, 3) AS duration, round(CASE WHEN duration <> 0 THEN (n_raw - 1) / duration END, 9) AS effective_fs,
 count(*) AS n_grid, count(*) FILTER (in_gap) AS n_nan, greatest(0, count(*) - n_raw - count(*) FILTER (in_gap))::BIGINT AS n_added
 FROM res JOIN raw USING (session_id) GROUP BY session_id, n_raw, duration""")
def gap_stats(spark, sf):
    """Report of a resampling."""
    df = signal(spark, sf)
    out = ts.resample_stats(df, ts.resample(df, KEYS, "t", "y", HOUR, DAY, BUCKET), KEYS, "t", "y")
    return out.withColumn("duration", F.round("duration", 3)).withColumn("effective_fs", F.round("effective_fs", 9))


@_query(f""", rel AS (SELECT session_id, event_id, t - min(t) OVER (PARTITION BY session_id) AS t, v FROM sig),
 lst AS (SELECT session_id, max(t) AS t1 FROM rel GROUP BY 1),
 grid AS (SELECT session_id, i::INT AS i, i * {6 * HOUR} AS t FROM (SELECT *, unnest(range(0, ceil((t1 + {6 * HOUR}) / {6 * HOUR})::BIGINT)) AS i FROM lst)),
 val AS (SELECT session_id, t, v, lead(t) OVER (PARTITION BY session_id ORDER BY t) - t AS after FROM rel WHERE v IS NOT NULL),
 near AS (SELECT g.session_id, g.i, g.t, p.t AS pt, p.v AS py, p.after AS pa, n.t AS nt, n.v AS ny
  FROM grid g ASOF LEFT JOIN val p ON g.session_id = p.session_id AND g.t >= p.t
  ASOF LEFT JOIN val n ON g.session_id = n.session_id AND g.t <= n.t)
 SELECT session_id, i, round(CASE WHEN pt IS NOT NULL AND nt IS NOT NULL AND NOT coalesce(pa > {12 * HOUR}, false)
  THEN CASE WHEN nt > pt THEN py + (ny - py) * (t - pt) / (nt - pt) ELSE py END END, 4) AS v FROM near""")
def snap_resample(spark, sf):
    """Snapping to the metric grid, without bridging long gaps."""
    df = signal(spark, sf).withColumn("t", F.col("t") - F.min("t").over(Window.partitionBy("session_id")))
    return ts.snap(df, KEYS, "t", "v", 6 * HOUR, BUCKET).select("session_id", "i", F.round("v", 4).alias("v"))


@_query(f""", b AS (SELECT session_id, floor(t / {DAY})::BIGINT AS bin, avg(v) AS v FROM sig GROUP BY 1, 2),
 s AS (SELECT session_id, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY 1)
 SELECT session_id, bin, round(v, 4) AS v FROM s LEFT JOIN b USING (session_id, bin)""")
def bin_mean(spark, sf):
    """Means of fixed bins, empty ones included."""
    return ts.bin_mean(signal(spark, sf), KEYS, "t", ["v"], DAY).select("session_id", "bin", F.round("v", 4).alias("v"))


@_query(_IDX + """SELECT session_id, event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING),
 first_value(v IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM idx""")
def ffill_bfill(spark, sf):
    """Forward, then backward fill."""
    return ts.fill_nearest_side(_indexed(spark, sf), KEYS, "i", "v", 1000).select("session_id", "event_id", "v")


_LINEAR = _IDX + """, nb AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi, last_value(v IGNORE NULLS) OVER a AS pv,
 first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ni, first_value(v IGNORE NULLS) OVER b AS nv FROM idx
 WINDOW a AS (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT session_id, event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN pi IS NOT NULL AND ni IS NOT NULL THEN pv + (nv - pv) * (i - pi)::DOUBLE / (ni - pi) ELSE {ends} END, 4) AS v FROM nb"""


@_query(_LINEAR.format(ends="pv"))
def linear_fill(spark, sf):
    """Linear fill; leading nulls stay, trailing ones repeat."""
    return ts.fill_linear(_indexed(spark, sf), KEYS, "i", "v", 1000).select("session_id", "event_id", F.round("v", 4).alias("v"))


@_query(_LINEAR.format(ends="coalesce(pv, nv)"))
def linear_fill_both(spark, sf):
    """Linear fill; both ends take the nearest value."""
    out = ts.fill_linear(_indexed(spark, sf), KEYS, "i", "v", 1000, both_ends=True)
    return out.select("session_id", "event_id", F.round("v", 4).alias("v"))


@_query(_IDX + """, m AS (SELECT *, quantile_cont(v, 0.5) OVER w AS med FROM idx WINDOW w AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING)),
 d AS (SELECT *, abs(v - med) AS dev FROM m),
 e AS (SELECT *, greatest(quantile_cont(dev, 0.5) OVER w, 0.05) AS mad FROM d WINDOW w AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING)),
 o AS (SELECT *, coalesce(dev > 2.5 * mad, false) AS outlier FROM e)
 SELECT session_id, event_id, round(med, 4) AS median, round(mad, 4) AS mad, outlier,
  max(outlier) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS dilated FROM o""")
def rolling_mad_mask(spark, sf):
    """Rolling median and MAD outliers, dilated."""
    out = ts.mad_outliers(_indexed(spark, sf), KEYS, ["i"], "v", 16, 2.5, 0.05)
    out = out.withColumn("dilated", ts.dilate(KEYS, ["i"], "outlier", 2))
    return out.select("session_id", "event_id", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"), "outlier", "dilated")


@_query("""SELECT session_id, event_id, (v IS NULL) AND avg((v IS NULL)::INT) OVER (PARTITION BY session_id) * 100 <= 20 AS rejected FROM sig""")
def reject_cap(spark, sf):
    """A mask that is dropped where it would reject too much of a session."""
    df = signal(spark, sf).withColumn("m", F.col("v").isNull())
    return df.select("session_id", "event_id", ts.capped(KEYS, "m", 20).alias("rejected"))


@_query(_IDX + """, r AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s, count(v) OVER w AS n FROM idx
 WINDOW w AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING))
 SELECT session_id, event_id, round(CASE WHEN n >= 3 THEN (v - m) / CASE WHEN s = 0 THEN 1 ELSE s END END, 4) AS z FROM r""")
def rolling_zscore(spark, sf):
    """Centred rolling z-score."""
    return _indexed(spark, sf).select("session_id", "event_id", F.round(ts.rolling_z(KEYS, ["i"], "v", 8), 4).alias("z"))


@_query(_IDX + """SELECT session_id, event_id, round(avg(v) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS v FROM idx""")
def smooth_k(spark, sf):
    """Centred rolling mean."""
    return _indexed(spark, sf).select("session_id", "event_id", F.round(ts.smooth(KEYS, ["i"], "v", 5), 4).alias("v"))


@_query(_IDX + """SELECT session_id, i, round(m, 4) AS mean FROM (SELECT *, avg(y) OVER (PARTITION BY session_id ORDER BY i ROWS 4 PRECEDING) AS m FROM idx)
 WHERE i >= 4 AND (i - 4) % 3 = 0""")
def moving_average(spark, sf):
    """Moving average with a stride."""
    out = ts.moving_average(_indexed(spark, sf), KEYS, "i", "y", 5, 3)
    return out.select("session_id", "i", F.round("mean", 4).alias("mean"))


_WINDOWS = _IDX + """, n AS (SELECT session_id, count(*) AS n FROM idx GROUP BY 1),
 win AS (SELECT session_id, unnest(range(0, (n - 16) // 4 + 1)) AS k FROM n WHERE n >= 16),
 mem AS (SELECT w.session_id, w.k, idx.t, idx.y, idx.v FROM win w JOIN idx ON w.session_id = idx.session_id AND idx.i >= 4 * w.k AND idx.i < 4 * w.k + 16)
"""


@_query(_WINDOWS + """SELECT session_id, k, round(quantile_cont(t, 0.5), 3) AS t, round(sqrt(avg(y * y)), 4) AS rms, count(*) AS n FROM mem GROUP BY 1, 2""")
def count_windows_rms(spark, sf):
    """Overlapping count windows: median time and RMS."""
    out = ts.count_windows(_indexed(spark, sf), KEYS, "i", 16, 4).groupBy("session_id", "k")
    return out.agg(F.round(F.percentile("t", 0.5), 3).alias("t"), F.round(agg.rms("y"), 4).alias("rms"), F.count("*").alias("n"))


@_query(_WINDOWS + """SELECT session_id, k, round(avg((v IS NULL)::INT), 6) AS null_fraction, avg((v IS NULL)::INT) > 0.25 AS rejected FROM mem GROUP BY 1, 2""")
def null_fraction_windows(spark, sf):
    """Share of missing values of overlapping windows."""
    out = ts.count_windows(_indexed(spark, sf), KEYS, "i", 16, 4).groupBy("session_id", "k").agg(agg.null_fraction("v").alias("f"))
    return out.select("session_id", "k", F.round("f", 6).alias("null_fraction"), (F.col("f") > 0.25).alias("rejected"))


_EPOCHS = _IDX + """, e AS (SELECT session_id, (i // 10)::BIGINT AS epoch, count(*) AS n, avg((v IS NULL)::INT) AS f, max(abs(v)) AS p, max(v) - min(v) AS r FROM idx GROUP BY 1, 2),
 c AS (SELECT session_id, epoch, n, CASE WHEN n < 10 THEN NULL WHEN f > 0.3 THEN 'nan' WHEN p > 250 THEN 'peak_amp' WHEN r > 150 THEN 'ptp' END AS cause FROM e)
"""


@_query(_EPOCHS + "SELECT session_id, epoch, n, cause FROM c")
def tumbling_epoch_reject(spark, sf):
    """Rejection of full epochs by the first cause."""
    return agg.epoch_causes(_indexed(spark, sf), KEYS, "i", "v", 10, 0.3, 250, 150)


@_query(_EPOCHS + """SELECT session_id, count(*) AS n_epochs_total, count(cause) AS n_epochs_rejected, round(100.0::DOUBLE * count(cause) / count(*), 1) AS pct_epochs_rejected,
 count(*) FILTER (cause = 'nan') AS n_rejected_by_nan, count(*) FILTER (cause = 'peak_amp') AS n_rejected_by_peak_amp, count(*) FILTER (cause = 'ptp') AS n_rejected_by_ptp,
 coalesce(sum(n) FILTER (cause IS NOT NULL), 0)::BIGINT AS n_samples_flagged, round(100.0::DOUBLE * coalesce(sum(n) FILTER (cause IS NOT NULL), 0)::BIGINT / sum(n)::BIGINT, 1) AS pct_samples_flagged FROM c GROUP BY 1""")
def artefact_stats(spark, sf):
    """Counts of rejected epochs by cause."""
    epochs = agg.epoch_causes(_indexed(spark, sf), KEYS, "i", "v", 10, 0.3, 250, 150)
    return agg.artefact_stats(epochs, KEYS, ("nan", "peak_amp", "ptp"))


@_query(f""", p AS (SELECT session_id, floor(t / {7 * DAY})::BIGINT AS week, avg(y) FILTER (kind = 'click') AS b, avg(y) FILTER (kind = 'view') AS a,
 avg(y) FILTER (kind = 'purchase') AS th, avg(y) FILTER (kind = 'signup') AS d, avg(y) FILTER (kind = 'error') AS g FROM sig GROUP BY 1, 2)
 SELECT session_id, week, round(b / (a + th + 1e-8), 6) AS engagement, round(b / (a + 1e-8), 6) AS focus, round(th * b / (a * a + 1e-8), 6) AS cognitive_load,
 round(b / (b + a + th + d + g + 1e-12), 6) AS rel_click, round(ln(greatest(a, 1e-12)) - ln(greatest(b, 1e-12)), 6) AS lateralization FROM p""")
def pivot_band_indices(spark, sf):
    """Band powers pivoted to columns, and the indices made of them."""
    df = signal(spark, sf).withColumn("week", F.floor(F.col("t") / (7 * DAY)))
    bands = ["click", "view", "purchase", "signup", "error"]
    wide = agg.bands_wide(df, ["session_id", "week"], "kind", "y", bands)
    found = agg.cognition(F.col("click"), F.col("view"), F.col("purchase"))
    found |= {"rel_click": agg.relative(bands)["rel_click"], "lateralization": agg.lateralization(F.col("view"), F.col("click"))}
    return wide.select("session_id", "week", *[F.round(c, 6).alias(n) for n, c in found.items()])


@_query(f""", b AS (SELECT session_id, t, t - lag(t) OVER (PARTITION BY session_id ORDER BY t) AS ibi FROM sig),
 d AS (SELECT *, ibi - lag(ibi) OVER (PARTITION BY session_id ORDER BY t) AS delta FROM b),
 k AS (SELECT session_id, unnest(range(ceil(min(t) / {7 * DAY})::BIGINT, floor(max(t) / {7 * DAY})::BIGINT + 1)) * {7 * DAY}::DOUBLE AS tick FROM sig GROUP BY 1)
 SELECT k.session_id, tick, count(*) AS n_beats, round(avg(ibi), 3) AS mean_nn, round(stddev_samp(ibi), 3) AS sdnn, round(sqrt(avg(delta * delta)), 3) AS rmssd,
  round(60000 / avg(ibi), 6) AS mean_hr, round(100.0::DOUBLE * count(*) FILTER (abs(delta) > 50) / nullif(count(delta), 0), 4) AS pnn50
 FROM k JOIN d ON k.session_id = d.session_id AND d.t <= tick AND d.t >= tick - {10 * DAY} GROUP BY 1, 2""")
def hrv_lookback(spark, sf):
    """Heart-rate variability of a look-back window at each tick."""
    w = Window.partitionBy("session_id").orderBy("t")
    beats = signal(spark, sf).select("session_id", F.col("t").alias("p")).withColumn("ibi", F.col("p") - F.lag("p").over(w.orderBy("p")))
    beats = beats.withColumn("delta", F.col("ibi") - F.lag("ibi").over(w.orderBy("p")))
    week = 7 * DAY
    span = beats.groupBy("session_id").agg(F.ceil(F.min("p") / week).alias("a"), F.floor(F.max("p") / week).alias("b")).filter("a <= b")
    ticks = span.select("session_id", F.explode(F.sequence("a", "b")).alias("k")).select("session_id", (F.col("k") * week).alias("tick"))
    found = joins.look_back_windows(ticks, beats, KEYS, "tick", "p", 10 * DAY).groupBy("session_id", "tick")
    m = agg.hrv("ibi", "delta")
    digits = {"mean_nn": 3, "sdnn": 3, "rmssd": 3, "mean_hr": 6, "pnn50": 4}
    m["pnn50"] = F.try_divide(100.0 * F.count_if(F.abs("delta") > 50), F.count("delta"))
    return found.agg(F.count("*").alias("n_beats"), *[F.round(m[k], d).alias(k) for k, d in digits.items()])


@_query("""WITH RECURSIVE sig AS (SELECT user_id AS session_id, epoch_us(ts) / 1e6 AS t FROM events),
 kept AS (SELECT session_id, min(t) AS t FROM sig GROUP BY 1
  UNION ALL SELECT k.session_id, (SELECT min(s.t) FROM sig s WHERE s.session_id = k.session_id AND s.t >= k.t + 43200) FROM kept k WHERE k.t IS NOT NULL)
 SELECT session_id, round(t, 3) AS t FROM kept WHERE t IS NOT NULL""")
def ibi_filter(spark, sf):
    """Drops beats too soon after the last one kept, greedily."""
    from pulsegrid.operators.heart import refractory

    beats = signal(spark, sf).groupBy("session_id").agg(F.array_sort(F.collect_list("t")).alias("peaks"))
    return beats.select("session_id", F.explode(refractory(F.col("peaks"), 43200.0)).alias("t")).withColumn("t", F.round("t", 3))


@_query(_IDX + """SELECT session_id, event_id, (v IS NULL) OR coalesce(max((v IS NULL)::INT) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) = 1 AS gated FROM idx""")
def artefact_cooldown(spark, sf):
    """An artefact gates itself and the windows after it."""
    from pulsegrid.operators.emotions import cooldown

    df = _indexed(spark, sf).withColumn("a", F.col("v").isNull())
    return df.select("session_id", "event_id", cooldown(KEYS, ["i"], "a", 2).alias("gated"))


@_query(""", r AS (SELECT *, max(event_id) FILTER (kind = 'signup') OVER (PARTITION BY session_id) AS ref, min(event_id) OVER (PARTITION BY session_id) AS first FROM sig)
 SELECT r.session_id, r.event_id, round(r.t - s.t + 1, 3) AS t FROM r JOIN sig s ON s.event_id = coalesce(r.ref, r.first) WHERE r.kind <> 'signup'""")
def event_rebase(spark, sf):
    """Events on the recording's clock; sign-ups serve as clock references."""
    df = signal(spark, sf).select("session_id", "event_id", F.col("t").alias("ts"), F.when(F.col("kind") == "signup", "TIMESTAMP").otherwise(F.col("kind")).alias("name"), F.lit("").alias("value"))
    out = ts.rebase_clock(df, KEYS, "event_id")
    return out.select("session_id", "event_id", F.round("ts", 3).alias("t"))


@_query("""SELECT event_id, 'web' AS output FROM sig WHERE kind IN ('view', 'click') UNION ALL
 SELECT event_id, 'feature' AS output FROM sig WHERE (kind = 'click' AND contains(props, '1')) OR kind NOT IN ('view', 'click', 'error')""")
def event_split(spark, sf):
    """Events to web and feature outputs; some to both, some to none."""
    from pulsegrid.operators.events import split_events

    return split_events(signal(spark, sf), "kind", "props", ["view", "click"], ["click"], "1", ["error"]).select("event_id", "output")


@_query(""", onset AS (SELECT session_id, min(t) AS t0 FROM sig WHERE kind = 'signup' GROUP BY 1)
 SELECT session_id, event_id, kind AS label, round(t - t0, 6) AS t, true AS visible FROM sig JOIN onset USING (session_id) WHERE kind NOT IN ('signup', 'error')""")
def annotation_seed(spark, sf):
    """Events as playback annotations, from the first onset."""
    from pulsegrid.operators.events import seed_annotations

    df = signal(spark, sf).select("session_id", "event_id", F.col("t").alias("ts"), F.col("kind").alias("name"))
    out = seed_annotations(df, KEYS, "event_id", "signup", ["signup", "error"])
    return out.select("session_id", "event_id", "label", F.round("t", 6).alias("t"), "visible")


@_query(f""", ev AS (SELECT o_custkey AS session_id, o_orderkey AS q, epoch_us(o_orderdate) / 1e6 AS s, epoch_us(o_orderdate) / 1e6 + {90 * DAY} AS e, o_orderpriority AS tag FROM orders),
 h AS (SELECT sig.session_id, event_id, tag, row_number() OVER (PARTITION BY event_id ORDER BY q DESC NULLS LAST) AS r FROM sig LEFT JOIN ev ON sig.session_id = ev.session_id AND t + {-SHIFT} BETWEEN s AND e)
 SELECT session_id, event_id, tag FROM h WHERE r = 1""")
def interval_tag_last_wins(spark, sf):
    """Rows tagged by the last event whose interval holds them."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("q"), seconds("o_orderdate").alias("s"), F.col("o_orderpriority").alias("tag"))
    o = o.withColumn("e", F.col("s") + 90 * DAY)
    rows = signal(spark, sf).withColumn("t", F.col("t") - SHIFT)
    return joins.interval_last_wins(rows, o, KEYS, "t", "s", "e", "q", "tag", 30 * DAY).select("session_id", "event_id", "tag")


@_query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 20 AND 40 AND p_retailprice BETWEEN 950 AND 1350 THEN 'B' WHEN p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 900 AND 1200 THEN 'A' END AS label FROM part""")
def zone_containment(spark, sf):
    """Points in rectangles; the last rectangle wins."""
    zones = spark.createDataFrame([(1, "A", 10.0, 900.0, 20.0, 300.0), (2, "B", 20.0, 950.0, 20.0, 400.0)], "seq int, label string, x double, y double, w double, h double")
    points = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return joins.containment_last_wins(points, zones, "seq", "label").select("p_partkey", "label")


@_query(f""", o AS (SELECT o_custkey AS session_id, epoch_us(o_orderdate) / 1e6 + {SHIFT} AS t, max(o_orderkey) AS v FROM orders GROUP BY 1, 2),
 p AS (SELECT sig.session_id, event_id, sig.t, o.t AS pt, o.v AS pv FROM sig ASOF LEFT JOIN o ON sig.session_id = o.session_id AND sig.t >= o.t),
 n AS (SELECT sig.event_id, o.t AS nt, o.v AS nv FROM sig ASOF LEFT JOIN o ON sig.session_id = o.session_id AND sig.t <= o.t)
 SELECT session_id, event_id, pv AS prev_value, nv AS next_value, CASE WHEN nt IS NULL OR t - pt < nt - t THEN pv ELSE nv END AS nearest_value FROM p JOIN n USING (event_id)""")
def asof_prev_next_nearest(spark, sf):
    """As-of lookups in either direction, and the nearer of both."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), (seconds("o_orderdate") + SHIFT).alias("t"), "o_orderkey")
    o = o.groupBy("session_id", "t").agg(F.max("o_orderkey").alias("o_orderkey"))
    out = joins.as_of(signal(spark, sf).select("session_id", "event_id", "t"), o, KEYS, "t", F.col("o_orderkey"), 365 * DAY)
    return out.select("session_id", "event_id", "prev_value", "next_value", "nearest_value")


@_query("SELECT session_id, event_id FROM sig WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = session_id AND o_orderpriority = '1-URGENT')")
def anti_masked(spark, sf):
    """Rows outside masked sessions."""
    o = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("session_id")).distinct()
    return joins.outside_masked(signal(spark, sf), o, KEYS).select("session_id", "event_id")


@_query(""", a AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS n FROM sig),
 b AS (SELECT o_custkey AS session_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
 SELECT session_id, n::INT AS n, event_id, o_orderkey FROM a FULL JOIN b USING (session_id, n)""")
def positional_join(spark, sf):
    """Tables side by side by row number."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), "o_orderkey")
    return joins.positional(signal(spark, sf).select("session_id", "event_id"), o, KEYS, ["event_id"], ["o_orderkey"])


@_query(f""", a AS (SELECT session_id, rint(t / {DAY})::BIGINT AS k, avg(y) AS y FROM sig WHERE kind = 'view' GROUP BY 1, 2),
 b AS (SELECT session_id, rint(t / {DAY})::BIGINT AS k, max(y) AS z FROM sig WHERE kind = 'click' GROUP BY 1, 2)
 SELECT session_id, k * {DAY}::DOUBLE AS t, round(y, 4) AS y, z FROM a FULL JOIN b USING (session_id, k)""".replace("rint", "round_even_"))
def fuse_on_grid(spark, sf):
    """Metric tables fused on their grid."""
    day = (F.rint(F.col("t") / DAY) * DAY).alias("t")
    a = signal(spark, sf).filter("kind = 'view'").groupBy("session_id", day).agg(F.round(F.avg("y"), 4).alias("y"))
    b = signal(spark, sf).filter("kind = 'click'").groupBy("session_id", day).agg(F.max("y").alias("z"))
    return joins.fuse([a, b], KEYS, "t", DAY).select("session_id", "t", "y", "z")


_register.oracles["fuse_on_grid"] = _register.oracles["fuse_on_grid"].replace(f"round_even_(t / {DAY})", f"round_even(t / {DAY}, 0)")


@_query("""--own
SELECT vec_id, round(list_aggregate(list_transform(embedding, lambda x: x::DOUBLE), 'avg'), 6) AS avg_rms,
 round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings""")
def l2_normalise(spark, sf):
    """Unit vectors with the mean appended."""
    f = scalar.l2_with_mean(F.col("embedding"))
    out = table(spark, sf, "embeddings").withColumn("f", f)
    return out.select("vec_id", F.round(F.element_at("f", -1), 6).alias("avg_rms"), F.round(F.element_at("f", 1), 6).alias("first"))


@_query("""--own
WITH c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
 m AS (SELECT label, list(m ORDER BY i) AS v FROM c GROUP BY 1),
 d AS (SELECT e.vec_id, m.label, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_sum(list_transform(list_zip(e.embedding, m.v), lambda p: (p[1]::DOUBLE - p[2]) ** 2)), m.label) AS r FROM embeddings e, m)
 SELECT vec_id, label, count(*) / 3.0::DOUBLE AS share FROM d WHERE r <= 3 GROUP BY 1, 2""")
def knn_topk(spark, sf):
    """Votes of the three nearest training vectors, here the labels' means."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    means = means.withColumn("vec_id", F.col("label"))
    return joins.knn_vote(e.drop("label"), means, "vec_id", "embedding", "vec_id", "label", 3)


@_query("""--own
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 d AS (SELECT q.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.v, t.v), lambda p: (p[1] - p[2]) ** 2)), t.vec_id) AS r
  FROM e q, e t WHERE q.vec_id % 100 = 0)
 SELECT vec_id, label, count(*) / 3.0::DOUBLE AS share FROM d WHERE r <= 3 GROUP BY 1, 2""")
def knn_vectors(spark, sf):
    """Votes of the three nearest of all vectors, for each hundredth vector; a vector is its own nearest."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return joins.knn_vote(e.filter("vec_id % 100 = 0").drop("label"), e, "vec_id", "embedding", "vec_id", "label", 3)


@_query("""--own
WITH s AS (SELECT vec_id, list_sum(list_transform(embedding[1:9], lambda x: x::DOUBLE)) AS a, 2 * embedding[1]::DOUBLE - embedding[2]::DOUBLE AS b FROM embeddings)
 SELECT vec_id, round(exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS p FROM s""")
def linear_score_softmax(spark, sf):
    """Posterior of a linear model."""
    x = F.transform(F.slice("embedding", 1, 9), lambda v: v.cast("double"))
    p = scalar.softmax([scalar.dot(x, [1.0] * 9), scalar.dot(x, [2.0, -1.0] + [0.0] * 7)])
    return table(spark, sf, "embeddings").select("vec_id", F.round(p[0], 6).alias("p"))


@_query("""--own
WITH r AS (SELECT vec_id, 10 + 40 * (0.5 * embedding[1]::DOUBLE + 0.25 * embedding[2]::DOUBLE) AS x FROM embeddings)
 SELECT vec_id, round(CASE WHEN x BETWEEN 0 AND 13 THEN x END, 6) AS repaired FROM r""")
def channel_repair(spark, sf):
    """One channel from the others, by regression; values out of range are missing."""
    x = F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(scalar.within(10 + 40 * scalar.dot(x, [0.5, 0.25]), 0.0, 13.0), 6).alias("repaired"))


@_query("""--own
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.0), 4) AS q0, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS q2,
 round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, round(quantile_cont(l_extendedprice, 1.0), 4) AS q4 FROM lineitem GROUP BY 1""")
def quartiles(spark, sf):
    """Five-number summary."""
    out = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(agg.five_numbers("l_extendedprice").alias("q"))
    return out.select("l_returnflag", *[F.round(F.col("q")[i], 4).alias(f"q{i}") for i in range(5)])


@_query("SELECT kind AS label, count(*) AS n, round(quantile_cont(y, 0.5), 4) AS median FROM sig GROUP BY 1")
def label_distribution(spark, sf):
    """Rows and median of each label."""
    return signal(spark, sf).groupBy(F.col("kind").alias("label")).agg(F.count("*").alias("n"), F.round(F.percentile("y", 0.5), 4).alias("median"))


@_query("""--own
SELECT l_returnflag, round(avg(abs(l_extendedprice * (1 - l_discount) - l_extendedprice)), 4) AS mae, round(sqrt(avg((l_extendedprice * (1 - l_discount) - l_extendedprice) ** 2)), 4) AS rmse FROM lineitem GROUP BY 1""")
def mae_rmse(spark, sf):
    """Errors of a repaired channel."""
    df = table(spark, sf, "lineitem").withColumn("new", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return df.groupBy("l_returnflag").agg(*[F.round(c, 4).alias(n) for n, c in agg.errors("new", "l_extendedprice").items()])


@_query(f""", p AS (SELECT session_id, floor(t / {7 * DAY})::BIGINT AS week, kind, avg(y) AS y FROM sig GROUP BY 1, 2, 3)
 SELECT session_id, week, kind AS emotion, y = max(y) OVER (PARTITION BY session_id, week) AS active FROM p""")
def emotion_unpivot_argmax(spark, sf):
    """Long form of probabilities, with the largest marked; ties mark several."""
    from pulsegrid.operators.emotions import argmax_labels

    kinds = ["view", "signup", "error", "click", "purchase"]
    wide = agg.bands_wide(signal(spark, sf).withColumn("week", F.floor(F.col("t") / (7 * DAY))), ["session_id", "week"], "kind", "y", kinds)
    return argmax_labels(wide, ["session_id", "week"], kinds).filter("p is not null").select("session_id", "week", "emotion", "active")


@_query(""", r AS (SELECT session_id, y, row_number() OVER (PARTITION BY session_id ORDER BY y) - 1 AS r, count(*) OVER (PARTITION BY session_id) AS n FROM sig),
 b AS (SELECT session_id, quantile_cont(y, 0.5) FILTER (r >= floor(n * 0.02) AND r < floor(n * 0.3)) AS low, quantile_cont(y, 0.5) FILTER (r >= floor(n * 0.3) AND r < floor(n * 0.6)) AS high FROM r GROUP BY 1)
 SELECT session_id, round(low, 4) AS low, round(high, 4) AS high, round(greatest(high - low, 1e-8), 4) AS scale FROM b""")
def rank_slice_baseline(spark, sf):
    """Baselines from rank slices."""
    out = agg.rank_slice_baseline(signal(spark, sf), KEYS, "y")
    return out.select("session_id", *[F.round(c, 4).alias(c) for c in ("low", "high", "scale")])


@_query(""", l AS (SELECT session_id, ln(y + 1e-8) AS l FROM sig), b AS (SELECT session_id, quantile_cont(l, 0.01) AS a, quantile_cont(l, 0.99) AS z FROM l GROUP BY 1)
 SELECT session_id, round(avg(greatest(least(l, z), a)), 5) AS mean, round(greatest(var_pop(greatest(least(l, z), a)), 1e-3), 5) AS variance FROM l JOIN b USING (session_id) GROUP BY 1""")
def clip_percentile_stats(spark, sf):
    """Mean and variance of clipped logarithms."""
    out = agg.clipped_log_stats(signal(spark, sf), KEYS, "y", 1e-3)
    return out.select("session_id", F.round("mean", 5).alias("mean"), F.round("variance", 5).alias("variance"))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM sig")
def json_extract(spark, sf):
    """A field of a JSON payload, doubled quotes repaired."""
    from pulsegrid.operators.events import json_field

    return signal(spark, sf).select("event_id", json_field(F.col("props"), "k").alias("k"))


@_query("SELECT session_id, kind, min(event_id) AS first_seq FROM sig GROUP BY 1, 2")
def distinct_first_seen(spark, sf):
    """Distinct rows with the place of the first."""
    return agg.first_seen(signal(spark, sf), ["session_id", "kind"], "event_id")


@_query("SELECT session_id, round_even((arg_max(t, event_id) - arg_min(t, event_id)) * 2, 0) / 2 AS duration FROM sig GROUP BY 1")
def session_duration(spark, sf):
    """Duration between a session's first and last rows."""
    return agg.session_duration(signal(spark, sf), KEYS, "t", "event_id")


@_query(_IDX + """, w AS (SELECT session_id, i, list_sort(list(y) OVER (PARTITION BY session_id ORDER BY i ROWS 29 PRECEDING)) AS s FROM idx),
 c AS (SELECT *, len(s) AS n FROM w)
 SELECT session_id, i, round(CASE WHEN n >= 10 THEN list_aggregate(s[floor(n * 0.02)::INT + 1 : greatest(floor(n * 0.02)::INT + 1, floor(n * 0.3)::INT)], 'median') END, 4) AS low FROM c""")
def rolling_rank_slices(spark, sf):
    """Median of a rank slice of the latest rows."""
    low, _ = ts.rank_slice_medians(KEYS, ["i"], "y", 30, (0.02, 0.3), (0.3, 0.6), 10)
    return _indexed(spark, sf).withColumn("low", low).select("session_id", "i", F.round("low", 4).alias("low"))


@_query(""", m AS (SELECT session_id, avg(y) AS m, stddev_pop(y) AS s FROM sig GROUP BY 1)
 SELECT session_id, event_id, round(CASE WHEN s > 0 THEN (y - m) / s END, 4) AS z FROM sig JOIN m USING (session_id) WHERE s = 0 OR abs((y - m) / s) < 2""")
def zscore_outlier_rows(spark, sf):
    """Rows without outlying values; channels of constant value are not judged."""
    out = ts.zscore_rows(signal(spark, sf), KEYS, ["y"], limit=2.0, scores=True)
    return out.select("session_id", "event_id", F.round("z_y", 4).alias("z"))


@_query(f""", s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session_id ORDER BY t) < {DAY} THEN 0 ELSE 1 END AS opens FROM sig),
 g AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY t) AS g FROM s)
 SELECT session_id, round(min(t), 3) AS start, count(*) AS n FROM g GROUP BY session_id, g.g""")
def gap_sessions(spark, sf):
    """Recordings cut at gaps, by session windows."""
    df = signal(spark, sf).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    out = df.groupBy("session_id", F.session_window("ts", f"{int(DAY)} seconds")).agg(F.round(F.min("t"), 3).alias("start"), F.count("*").alias("n"))
    return out.select("session_id", "start", "n")


_PARTS = (_register, row_queries.REGISTER, signal_queries.REGISTER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.oracles.items()}
