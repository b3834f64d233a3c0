"""Queries of operators on single rows, on lines of files, on masks and models, over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import scalar
from pulsegrid.operators import aggregates as agg
from pulsegrid.operators import emotions as emo
from pulsegrid.operators import events, joins, position
from pulsegrid.operators import timeseries as ts
from pulsegrid.plans.registry import DAY, HOUR, IDX, KEYS, Register, indexed, rounded, signal, table
from pulsegrid.sources import sessions as src
from pulsegrid.streaming import packets

REGISTER = Register()
_query = REGISTER.query


def _own(sql: str):
    return _query(sql, signal=False)


# --- sensors ---


def _raw_channels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[j].cast("double").alias(c) for j, c in enumerate(scalar.CHANNELS)])


_RAW = "WITH c AS (SELECT vec_id, " + ", ".join(f"embedding[{j + 1}]::DOUBLE AS c{j + 1}" for j in range(8)) + " FROM embeddings)\n"


@_own(_RAW + """SELECT vec_id, round(c2 - c5 / 2, 9) AS "AF7", round(c1 - c5 / 2, 9) AS "AF8", round(-c5 / 2, 9) AS "T9", round(c5 / 2, 9) AS "T10",
 round(c2, 9) AS "LeftHemi", round(c1 - c5, 9) AS "RightHemi" FROM c""")
def montage(spark, sf):
    """Derived channels of the headset's raw ones."""
    found = scalar.montage({c: F.col(c) for c in scalar.CHANNELS})
    return _raw_channels(spark, sf).select("vec_id", *[F.round(v, 9).alias(n) for n, v in found.items()])


@_own(_RAW + "SELECT vec_id, " + ", ".join(f'round(c{j + 1} - c5 / 2, 9) AS "{c}"' for j, c in enumerate(scalar.CHANNELS)) + " FROM c")
def re_reference(spark, sf):
    """Channels less half the ear channel."""
    found = scalar.re_reference({c: F.col(c) for c in scalar.CHANNELS})
    return _raw_channels(spark, sf).select("vec_id", *[F.round(v, 9).alias(n) for n, v in found.items()])


@_own("""WITH r AS (SELECT l_orderkey, l_linenumber, (l_linenumber - 4) * 62500.0::DOUBLE + l_quantity / 10 AS x FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE WHEN abs(abs(x) - 187500) >= 0.1 THEN round(x, 6) END AS unsaturated,
  CASE WHEN abs(abs(x) - 187500) > 2.875 AND abs(x) > 1 THEN round(x, 6) END AS connected FROM r""")
def converter_limits(spark, sf):
    """Values at the converter's limit, and of a lost electrode, as missing."""
    df = table(spark, sf, "lineitem").withColumn("x", (F.col("l_linenumber") - 4) * 62500.0 + F.col("l_quantity") / 10)
    return df.select(
        "l_orderkey", "l_linenumber", F.round(scalar.unsaturated(F.col("x")), 6).alias("unsaturated"), F.round(scalar.connected(F.col("x")), 6).alias("connected")
    )


@_own("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount <> 0 THEN 1000 / l_discount END, 6) AS siemens, round(80 * tanh(l_quantity * 4 / 80), 9) AS clipped,
 round(l_extendedprice * 1.25 - 3, 6) AS scaled, CASE WHEN l_quantity BETWEEN 0 AND 30 THEN l_quantity END AS within FROM lineitem""")
def scaling(spark, sf):
    """Conductance, soft clip, gain and zero, values out of range as missing."""
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(scalar.conductance(F.col("l_discount")), 6).alias("siemens"), F.round(scalar.soft_clip(q * 4), 9).alias("clipped"),
        F.round(scalar.gain_zero(F.col("l_extendedprice"), 1.25, -3.0), 6).alias("scaled"), scalar.within(q).alias("within"),
    )


_SIGNED = "CASE WHEN {x} >= {half} THEN {x} - 2 * {half} ELSE {x} END"


def _byte(k: int) -> str:
    return f"('0x' || substr(h, {2 * k + 1}, 2))::BIGINT"


_BIG24 = f"({_byte(0)} * 65536 + {_byte(1)} * 256 + {_byte(2)})"
_LITTLE = f"({_byte(4)} * 256 + {_byte(3)})"
_PLAIN = f"({_byte(6)} * 256 + {_byte(5)})"


@_own(f"""WITH p AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS h FROM orders),
 n AS (SELECT o_orderkey, {_SIGNED.format(x=_BIG24, half=1 << 23)} AS a, {_SIGNED.format(x=_LITTLE, half=1 << 15)} AS b, {_PLAIN} AS raw FROM p)
 SELECT o_orderkey, a AS int24, round(a * (2 * 4.5e6 / (12 * 16777216.0::DOUBLE)), 4) AS microvolts, b AS int16, round(b * 0.061 / 1000, 9) AS acceleration,
  round(b * 8.75 / 1000, 9) AS rotation, round(b * 0.14 / 1000, 9) AS field, round(raw * 3000.0::DOUBLE / 4095, 6) AS pulse_mv,
  round(CASE WHEN abs((raw & 16383) * 3.0::DOUBLE / 4095 / 0.5 - 1) >= 1e-9
   THEN CASE raw >> 14 WHEN 0 THEN 40.2 WHEN 1 THEN 287 WHEN 2 THEN 1000 ELSE 3300 END::DOUBLE / ((raw & 16383) * 3.0::DOUBLE / 4095 / 0.5 - 1) END, 4) AS kilo_ohm FROM n""")
def sensor_decoding(spark, sf):
    """Numbers in binary packets, in physical units."""
    packet = F.unhex(F.md5(F.col("o_orderkey").cast("string")))
    df = table(spark, sf, "orders").select("o_orderkey", packet.alias("p"))
    a, b, raw = scalar.int24(F.col("p"), 0), scalar.int16_little(F.col("p"), 3), scalar.int16_little(F.col("p"), 5, signed=False)
    moved = [F.round(scalar.motion(b, k), 9).alias(n) for k, n in (("acc", "acceleration"), ("gyro", "rotation"), ("mag", "field"))]
    return df.select(
        "o_orderkey", a.alias("int24"), F.round(scalar.microvolts(a), 4).alias("microvolts"), b.alias("int16"), *moved,
        F.round(scalar.pulse_millivolts(raw), 6).alias("pulse_mv"), F.round(scalar.skin_resistance(raw), 4).alias("kilo_ohm"),
    )


@_own("""WITH f AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS h FROM orders),
 n AS (SELECT o_orderkey, """ + ", ".join(f"('0x' || substr(h, {8 + 4 * j + 3}, 2) || substr(h, {8 + 4 * j + 1}, 2))::BIGINT AS r{j}" for j in range(5)) + """ FROM f WHERE o_orderkey % 3 <> 0)
 SELECT 'd' || (o_orderkey % 7) AS device_id, o_orderkey AS t, r0 AS x, r1 AS y, r2 AS z, round(r3 * 3000.0::DOUBLE / 4095, 6) AS ppg_mv,
  round(CASE WHEN abs((r4 & 16383) * 3.0::DOUBLE / 4095 / 0.5 - 1) >= 1e-9
   THEN CASE r4 >> 14 WHEN 0 THEN 40.2 WHEN 1 THEN 287 WHEN 2 THEN 1000 ELSE 3300 END::DOUBLE / ((r4 & 16383) * 3.0::DOUBLE / 4095 / 0.5 - 1) END, 4) AS eda_kohm FROM n""")
def wristband_frames(spark, sf):
    """Frames of a wristband; torn ones are left out."""
    whole = F.unhex(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 28))
    torn = F.when(F.col("o_orderkey") % 3 == 0, F.unhex(F.lit("00ff"))).otherwise(whole)
    df = table(spark, sf, "orders").select(F.concat(F.lit("d"), F.col("o_orderkey") % 7).alias("device_id"), F.col("o_orderkey").alias("t"), torn.alias("frame"))
    return packets.wristband_rows(df).withColumn("ppg_mv", F.round("ppg_mv", 6)).withColumn("eda_kohm", F.round("eda_kohm", 4))


@_own("""WITH f AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR) || md5('x' || o_orderkey) AS h FROM orders),
 n AS (SELECT o_orderkey, """ + ", ".join(f"('0x' || substr(h, {4 * j + 3}, 2) || substr(h, {4 * j + 1}, 2))::BIGINT AS r{j}" for j in range(9)) + """ FROM f)
 SELECT o_orderkey::VARCHAR AS device_id, """ + ", ".join(
    f"round({_SIGNED.format(x=f'r{j}', half=1 << 15)} * {('0.061', '8.75', '0.14')[j // 3]} / 1000, 9) AS {('acc', 'gyro', 'mag')[j // 3]}_{'xyz'[j % 3]}" for j in range(9)
) + " FROM n")
def motion_packets(spark, sf):
    """Nine axes of a movement packet."""
    key = F.col("o_orderkey").cast("string")
    df = table(spark, sf, "orders").select(key.alias("device_id"), F.unhex(F.concat(F.md5(key), F.md5(F.concat(F.lit("x"), key)))).alias("packet"))
    out = packets.motion_rows(df)
    return out.select("device_id", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@_own("""WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders),
 k AS (SELECT * FROM s WHERE r % 5 <> 3), m AS (SELECT o_custkey, max(r) AS last FROM k GROUP BY 1),
 p AS (SELECT o_custkey, unnest(range(0, last + 1)) AS r FROM m)
 SELECT o_custkey::VARCHAR AS device_id, p.r * 10 + j AS n, round((o_orderkey % 1000) * (2 * 4.5e6 / (12 * 16777216.0::DOUBLE)), 9) AS "AF8"
 FROM p LEFT JOIN k USING (o_custkey, r), (SELECT unnest(range(10)) AS j)""")
def packet_losses(spark, sf):
    """Packets with every fifth one lost: ten rows of nulls each, once the newest is ten ahead or the recording ends."""
    w = F.row_number().over(ts.Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    df = table(spark, sf, "orders").select("o_custkey", "o_orderkey").withColumn("r", w).filter("r % 5 <> 3")
    frame = F.concat(F.lpad(F.lower(F.hex(F.col("o_orderkey") % 1000)), 6, "0"), F.lit("0" * 42))
    body = F.unhex(F.concat(F.lpad(F.lower(F.hex(F.col("r") % 128)), 2, "0"), F.repeat(frame, F.lit(10))))
    sent = df.select(F.col("o_custkey").cast("string").alias("device_id"), F.col("r").cast("long").alias("arrived"), body.alias("packet"))
    return packets.batch_rows(sent).select("device_id", "n", F.round("AF8", 9).alias("AF8"))


@_own("""SELECT p_partkey, round(cx + CASE WHEN d <> 0 THEN (gx - cx) * r / d END, 6) AS x, round(cy + CASE WHEN d <> 0 THEN (gy - cy) * r / d END, 6) AS y,
 CASE WHEN p_partkey % 4 = 0 THEN 2.4 WHEN p_partkey % 4 IN (1, 2) THEN 70 ELSE p_size END::DOUBLE AS z
 FROM (SELECT p_partkey, p_size, p_size::DOUBLE AS gx, p_size % 7 * 1.0::DOUBLE AS gy, 5.0::DOUBLE AS cx, 5.0::DOUBLE AS cy, p_retailprice / 100 AS r,
  sqrt((p_size - 5.0::DOUBLE) ** 2 + (p_size % 7 - 5.0::DOUBLE) ** 2) AS d FROM part)""")
def circle_and_floor(spark, sf):
    """The nearest point of a circle, and the height of the first floor whose antenna is seen."""
    size = F.col("p_size")
    x, y = scalar.project_to_circle(size.cast("double"), (size % 7).cast("double"), F.lit(5.0), F.lit(5.0), F.col("p_retailprice") / 100)
    ids = F.array(F.concat(F.lit("a"), F.col("p_partkey") % 4))
    z = scalar.floor_height(ids, [(["a0", "a9"], 2.4), (["a0", "a1", "a2"], 70.0)], size.cast("double"))
    return table(spark, sf, "part").select("p_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), z.alias("z"))


@_own("""SELECT l_orderkey, l_linenumber, round_even(l_tax * 2 / 0.05, 0) * 0.05 AS stepped, least(greatest(l_quantity, 5), 25) AS clamped,
 (l_suppkey * 977 // 60000) || ':' || lpad((l_suppkey * 977 // 1000 % 60)::VARCHAR, 2, '0') AS clock,
 regexp_matches(CASE WHEN l_suppkey % 2 = 0 THEN '00:1A:2b:3C:4d:5E' WHEN l_suppkey % 3 = 0 THEN '00-1A-2b-3C-4d-5E' ELSE '00:1A:2b:3C:4d:' || l_suppkey END, '^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$') AS mac
 FROM lineitem""")
def rounding_and_texts(spark, sf):
    """Multiples of a step, clamped values, times as text, hardware addresses."""
    key = F.col("l_suppkey")
    mac = F.when(key % 2 == 0, "00:1A:2b:3C:4d:5E").when(key % 3 == 0, "00-1A-2b-3C-4d-5E").otherwise(F.concat(F.lit("00:1A:2b:3C:4d:"), key))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", scalar.to_step(F.col("l_tax") * 2, 0.05).alias("stepped"),
        scalar.clamp(F.col("l_quantity"), F.lit(5.0), F.lit(25.0)).alias("clamped"), scalar.minutes_seconds(key * 977).alias("clock"), scalar.is_mac(mac).alias("mac"),
    )


# --- lines of files ---


def _lines(spark: SparkSession, sf: str, line) -> DataFrame:
    """A file of a line for each event of a user."""
    return indexed(spark, sf).select(F.col("session_id").cast("string").alias("session_id"), F.col("i").alias("seq"), line.alias("line"))


@_query(IDX + """, e AS (SELECT *, max(i) OVER (PARTITION BY session_id) AS last FROM idx)
 SELECT session_id::VARCHAR AS session_id, i AS seq, v AS y, round(y * 2, 4) AS z FROM e WHERE i > 0 AND i < last""")
def numeric_lines(spark, sf):
    """Lines of numbers with a header and a torn last line; NULL is missing."""
    value = F.when(F.col("v").isNull(), F.lit("NULL")).otherwise(F.col("v").cast("string"))
    last = F.max("i").over(ts.Window.partitionBy("session_id"))
    line = F.when(F.col("i") == 0, "value, double").when(F.col("i") == last, "12").otherwise(F.concat_ws(", ", value, F.round(F.col("y") * 2, 4).cast("string")))
    out = src.numeric_rows(_lines(spark, sf, line), 2)
    return out.select("session_id", "seq", F.col("x")[0].alias("y"), F.col("x")[1].alias("z"))


@_query(IDX + """, e AS (SELECT *, max(i) OVER (PARTITION BY session_id) AS last FROM idx)
 SELECT session_id::VARCHAR AS session_id, i AS seq, i::DOUBLE / 4 AS t, y AS "AF8", -y / 2 AS "AF7", 0.5::DOUBLE AS "EAR_R", v AS "NOSE" FROM e WHERE i > 0""")
def headset_lines(spark, sf):
    """Lines of the headset's nine columns."""
    value = F.when(F.col("v").isNull(), F.lit("nan")).otherwise(F.col("v").cast("string"))
    y, t = F.col("y").cast("string"), (F.col("i") / 4).cast("string")
    zero, half = F.lit("0"), F.lit("0.5")
    line = F.when(F.col("i") == 0, F.lit("Timestamp,a,b,c,d,e,f,g,h")).otherwise(F.concat_ws(",", t, y, (-F.col("y") / 2).cast("string"), zero, zero, half, zero, zero, value))
    out = src._channels(src.numeric_rows(_lines(spark, sf, line), 9), referenced=False)
    return out.select("session_id", "seq", "t", "AF8", "AF7", "EAR_R", "NOSE")


@_query(IDX + """SELECT session_id::VARCHAR AS session_id, i AS seq, y AS "AF8", i::DOUBLE AS "NOSE" FROM idx WHERE kind NOT IN ('error', 'signup')""")
def demo_lines(spark, sf):
    """A demonstration feed; short lines and lines with words are left out."""
    y, i = F.col("y").cast("string"), F.col("i").cast("string")
    line = F.when(F.col("kind") == "error", F.concat_ws(",", F.lit("0"), y, i)).when(F.col("kind") == "signup", F.lit("0,a,b,c,d,e,f,g,h"))
    line = line.otherwise(F.concat_ws(",", F.lit("0"), y, *[F.lit(" 1 ")] * 6, i, F.lit("more")))
    return src.demo_rows(_lines(spark, sf, line)).select("session_id", "seq", "AF8", "NOSE")


@_query(IDX + """, c AS (SELECT session_id, coalesce(max(i) FILTER (kind = 'signup'), 0) AS ref FROM idx GROUP BY 1),
 r AS (SELECT idx.*, x.i * 10.0::DOUBLE AS pc FROM idx JOIN c USING (session_id) JOIN idx x ON x.session_id = c.session_id AND x.i = c.ref)
 SELECT session_id::VARCHAR AS session_id, i AS seq, i * 10.0::DOUBLE - pc + 1 AS ts, kind AS name, CASE WHEN kind = 'view' THEN 'a,b ' || event_id ELSE '' END AS value FROM r WHERE kind <> 'signup'""")
def event_lines(spark, sf):
    """Raw event lines: quotes stripped, commas of a payload kept, times on the recording's clock."""
    at = (F.col("i") * 10).cast("string")
    line = F.when(F.col("kind") == "signup", F.concat_ws(",", at, F.lit("TIMESTAMP"), F.lit("99")))
    line = line.when(F.col("kind") == "view", F.concat(at, F.lit(", 'view' ,a,b "), F.col("event_id"), F.lit("'"))).otherwise(F.concat_ws(",", at, "kind", F.lit("")))
    return src.raw_events(_lines(spark, sf, line))


@_query(IDX + "SELECT session_id::VARCHAR AS session_id, i AS seq, y AS ts, kind AS name FROM idx WHERE kind NOT IN ('error', 'signup')")
def simple_event_lines(spark, sf):
    """Time and name of event lines; short and non-numeric lines are left out."""
    line = F.when(F.col("kind") == "error", F.col("y").cast("string")).when(F.col("kind") == "signup", F.lit("x,y")).otherwise(F.concat_ws(", ", F.col("y").cast("string"), "kind", "props"))
    return src.simple_events(_lines(spark, sf, line))


@_query(IDX + """, a AS (SELECT session_id, i, kind, y, least(CASE kind WHEN 'view' THEN 3 WHEN 'click' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END, 3) AS n FROM idx)
 SELECT session_id::VARCHAR AS session_id, i AS seq, i * 5 / 10.0::DOUBLE AS t, n AS n_antennas, CASE WHEN n > 0 THEN 'A0' END AS first_id, CASE WHEN n > 0 THEN n - 1 + y END AS last_dist
 FROM a WHERE kind <> 'error'""")
def ranging_lines(spark, sf):
    """Ranging lines with up to three antennas, times from the first physical line."""
    n = F.when(F.col("kind") == "view", 3).when(F.col("kind") == "click", 2).when(F.col("kind") == "purchase", 1).otherwise(0)
    one = lambda j: F.concat(F.lit(f',{j},"A{j}", {j},{j + 1},0,'), (F.col("y") + j).cast("string"))
    heard = F.concat(*[F.when(n > j, one(j)).otherwise(F.lit("")) for j in range(3)])
    at = (F.col("i") * 500 + 7000).cast("string")
    line = F.when(F.col("kind") == "error", F.concat(at, F.lit(",HELLO"))).otherwise(F.concat(at, F.lit(",DIST,"), n.cast("string"), heard))
    out = src.ranging_frames(_lines(spark, sf, line))
    return out.select("session_id", "seq", "t", F.size("ants").alias("n_antennas"), F.get("ants", F.lit(0))["id"].alias("first_id"), F.try_element_at("ants", F.lit(-1))["dist"].alias("last_dist"))


@_query(IDX + """, n AS (SELECT session_id, i, kind, y FROM idx WHERE kind IN ('view', 'click', 'purchase')),
 a AS (SELECT session_id, i, unnest(range(0, CASE kind WHEN 'view' THEN 3 WHEN 'click' THEN 2 ELSE 1 END)) AS j FROM n WHERE kind = 'view')
 SELECT session_id::VARCHAR AS session_id, 'A' || j AS id, j::DOUBLE AS x, j + 1.0::DOUBLE AS y, 0.0::DOUBLE AS z, min(i) * 0.5::DOUBLE AS first_t FROM a GROUP BY session_id, j""")
def antenna_list(spark, sf):
    """Distinct antennas of frames with three, with the time at which each is first heard."""
    n = F.when(F.col("kind") == "view", 3).when(F.col("kind") == "click", 2).when(F.col("kind") == "purchase", 1).otherwise(0)
    heard = F.concat(*[F.when(n > j, F.lit(f",{j},A{j},{j},{j + 1},0,1")).otherwise(F.lit("")) for j in range(3)])
    frames = src.ranging_frames(_lines(spark, sf, F.concat((F.col("i") * 500).cast("string"), F.lit(",DIST,"), n.cast("string"), heard)))
    return position.antennas(frames, KEYS, "t")


@_query(IDX + "SELECT session_id::VARCHAR AS session_id, i AS seq, y AS x, i::DOUBLE AS y, 1.5::DOUBLE AS z FROM idx WHERE kind <> 'error'")
def bracketed_lines(spark, sf):
    """Positions as bracketed vectors; lines with None are left out."""
    line = F.when(F.col("kind") == "error", F.lit("[None]")).otherwise(F.concat(F.lit("["), F.col("y").cast("string"), F.lit("  "), F.col("i").cast("string"), F.lit(", 1.5]")))
    return src.bracketed_positions(_lines(spark, sf, line))


@_own("""SELECT row_number() OVER (ORDER BY p_partkey) AS seq, p_brand AS label, p_size::DOUBLE AS x, p_partkey::DOUBLE AS y, 2.5::DOUBLE AS w, p_retailprice AS h FROM part""")
def region_lines(spark, sf):
    """Rectangles of a file with a header, its columns in any order."""
    p = table(spark, sf, "part").withColumn("seq", F.row_number().over(ts.Window.partitionBy(F.lit("s")).orderBy("p_partkey")))
    rows = p.select(F.lit("s").alias("session_id"), F.col("seq").cast("long").alias("seq"), F.concat_ws(",", "p_size", F.lit("2.5"), "p_brand", F.col("p_partkey").cast("string"), F.col("p_retailprice").cast("string")).alias("line"))
    head = spark.createDataFrame([("s", 0, "x,w,label,y,h")], rows.schema)
    return src.region_rows(head.unionByName(rows))


@_query(""", b AS (SELECT min(y) AS base FROM sig WHERE kind = 'signup')
 SELECT event_id, kind AS name, round((y - base) / 1000, 9) AS start, round((y + 5 - base) / 1000, 9) AS stop, 'k' || event_id AS value FROM sig, b WHERE kind NOT IN ('signup', 'error')""")
def interval_table(spark, sf):
    """Labelled intervals from the offset row's start, in seconds."""
    kind = F.when(F.col("kind") == "signup", "OFFSET").when(F.col("kind") == "error", "FIN").otherwise(F.col("kind"))
    df = signal(spark, sf).select("event_id", kind.alias("EventName"), F.col("y").alias("Start"), (F.col("y") + 5).alias("End"), F.concat(F.lit("[k"), "event_id", F.lit("]")).alias("Value"))
    out = src.labelled_intervals(df, milliseconds=True)
    key = F.regexp_extract("Value", "[0-9]+", 0).cast("long")
    return out.select(key.alias("event_id"), F.col("EventName").alias("name"), F.round("Start", 9).alias("start"), F.round("End", 9).alias("stop"), F.col("Value").alias("value"))


@_query(""", b AS (SELECT min(t) AS t0 FROM sig)
 SELECT round(t - t0, 3) AS t, (event_id % 5)::VARCHAR AS emotion FROM sig, b WHERE kind = 'view'""")
def expression_table(spark, sf):
    """Times and emotions of expression rows, from the first row's time; doubled quotes are repaired."""
    good, doubled = F.concat(F.lit('{"emotion":"'), F.col("event_id") % 5, F.lit('"}')), F.concat(F.lit('{""emotion"":""'), F.col("event_id") % 5, F.lit('""}'))
    df = signal(spark, sf).select(F.col("t").alias("timestamp"), F.when(F.col("kind") == "view", "EXPRESSION").otherwise("X").alias("tag"), F.when(F.col("event_id") % 2 == 0, good).otherwise(doubled).alias("values"))
    return src.expression_events(df).select(F.round("t", 3).alias("t"), "emotion")


@_own('SELECT vec_id::DOUBLE AS "Timestamp", ' + ", ".join(f'embedding[{j}]::DOUBLE AS "{c}"' for c, j in zip(scalar.CHANNELS, (2, 1, 3, 4, 5, 6, 7, 8))) + " FROM embeddings")
def column_names(spark, sf):
    """A table under older column names, in another order, with its columns put right."""
    e = F.col("embedding")
    given = ["AF7_RMS", "HEAD_R", "CHEEK_R", "CHEEK_L_RMS", "EAR_R", "FOREHEAD_L_RMS", "BROW", "NOSE"]
    df = table(spark, sf, "embeddings").select(F.lit(0).alias("Unnamed: 0"), *[e[j].alias(n) for j, n in enumerate(given)], F.col("vec_id").cast("double").alias("time"))
    return src.canonical_columns(df)


# --- events and annotations ---


@_query("""SELECT event_id, kind AS name, 'PROCESSED' AS state, round(t * 1000, 0) AS ms, '' AS extra, CASE WHEN event_id % 3 = 0 THEN '' ELSE replace(props, '"', '') END AS value FROM sig""")
def processed_events(spark, sf):
    """The processed layout of events."""
    df = signal(spark, sf).select("event_id", F.col("kind").alias("name"), F.col("t").alias("ts"), F.when(F.col("event_id") % 3 == 0, F.lit('"[]"')).otherwise(F.col("props")).alias("value"))
    return events.processed(df, ["event_id"]).withColumn("ms", F.round(F.col("ms").cast("double"), 0))


@_query(""", onset AS (SELECT session_id, arg_min(t, event_id) AS t0 FROM sig WHERE kind = 'signup' GROUP BY 1),
 d AS (SELECT session_id, md5(session_id || ':' || event_id || ':' || CASE kind WHEN 'click' THEN 'CONSENT_INFO' ELSE kind END) AS h, event_id, kind, t - t0 AS t FROM sig JOIN onset USING (session_id))
 SELECT session_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id, round(round_even(t, 6), 3) AS t, kind AS label
 FROM d WHERE kind NOT IN ('signup', 'click')""")
def annotation_documents(spark, sf):
    """Seeded annotations as documents, read back: administrative events have no point, ids are the same at every run."""
    name = F.when(F.col("kind") == "signup", events.ONSET).when(F.col("kind") == "click", "CONSENT_INFO").otherwise(F.col("kind"))
    df = signal(spark, sf).select("session_id", "event_id", F.col("t").alias("ts"), name.alias("name"))
    made = events.annotation_documents(events.seed_annotations(df, KEYS, "event_id"), KEYS, "event_id")
    read = made.withColumn("a", events.read_annotations(F.col("annotations"), F.lit(float("-inf")), F.lit(float("inf"))))
    return read.select("session_id", F.inline("a.points")).select("session_id", "id", F.round("t", 3).alias("t"), "label")


_BOUNDS = "least(greatest({x}, 10), 200)"
_A, _B = (_BOUNDS.format(x=x) for x in ("least(y, y2)", "greatest(y, y2)"))


@_query(f""", z AS (SELECT event_id, y, CASE WHEN kind = 'error' THEN y ELSE 100 - y END AS y2, kind FROM sig)
 SELECT event_id, 0 AS kind, 'p' AS id, {_BOUNDS.format(x="y")} AS t, NULL::DOUBLE AS t1, CASE WHEN kind = 'view' THEN 'Event' ELSE kind END AS label FROM z
 UNION ALL SELECT event_id, 1, 'z', {_A}, {_B}, 'Zone' FROM z WHERE {_B} - {_A} >= 1e-9""")
def annotations_read(spark, sf):
    """Annotation documents: times clamped, swapped zones put right, empty zones dropped, defaults filled in."""
    other = F.when(F.col("kind") == "error", F.col("y")).otherwise(100 - F.col("y"))
    label = F.when(F.col("kind") == "view", F.lit(None)).otherwise(F.col("kind"))
    point = F.struct(F.lit("p").alias("id"), F.col("y").alias("t"), label.alias("label"))
    zone = F.struct(F.lit("z").alias("id"), F.col("y").alias("t0"), other.alias("t1"), F.lit(False).alias("visible"))
    bare = F.struct(F.lit("q").alias("id"), F.lit(None).cast("double").alias("t"), F.lit("no time").alias("label"))
    text = F.to_json(F.struct(F.array(point, bare).alias("points"), F.array(zone).alias("zones")))
    df = signal(spark, sf).select("event_id", events.read_annotations(text, F.lit(10.0), F.lit(200.0)).alias("a"))
    p = df.select("event_id", F.lit(0).alias("kind"), F.explode("a.points").alias("x")).select("event_id", "kind", "x.id", "x.t", F.lit(None).cast("double").alias("t1"), "x.label")
    z = df.select("event_id", F.lit(1).alias("kind"), F.explode("a.zones").alias("x")).select("event_id", "kind", "x.id", F.col("x.t0").alias("t"), "x.t1", "x.label")
    return p.unionByName(z)


_POINT, _ZONE = "array<struct<id:string,t:double,label:string,visible:boolean>>", "array<struct<id:string,t0:double,t1:double,label:string,visible:boolean>>"


def _blank(spark: SparkSession, sf: str) -> DataFrame:
    """Events, each with a document without points and zones."""
    return signal(spark, sf).withColumn("a", F.struct(F.lit(1).alias("version"), F.array().cast(_POINT).alias("points"), F.array().cast(_ZONE).alias("zones")))


@_query(f"""SELECT event_id, {_BOUNDS.format(x="y + 1")} AS t, 'mark' AS label, 'Event 2' AS other FROM sig""")
def annotation_points(spark, sf):
    """Points added, moved, labelled and deleted."""
    low, high, a = F.lit(10.0), F.lit(200.0), F.col("a")
    df = _blank(spark, sf).withColumn("a", events.with_point(events.with_point(a, "p", F.lit(5.0), low, high), "other", F.col("y"), low, high))
    df = df.withColumn("other", a["points"][1]["label"]).withColumn("a", events.without(events.labelled(events.moved_point(a, "p", F.col("y") + 1, low, high), "p", "mark"), "other"))
    return df.filter(F.size("a.points") == 1).select("event_id", a["points"][0]["t"].alias("t"), a["points"][0]["label"].alias("label"), "other")


@_query(f"""SELECT event_id, {_BOUNDS.format(x="least(y, 90)")} AS t0, {_BOUNDS.format(x="greatest(y, 90)")} AS t1, 'Zone 1' AS label FROM sig WHERE abs({_BOUNDS.format(x="y")} - 90) >= 1e-6""")
def annotation_zones(spark, sf):
    """Zones added, unless too short, and moved."""
    low, high, a = F.lit(10.0), F.lit(200.0), F.col("a")
    df = _blank(spark, sf).withColumn("a", events.with_zone(events.with_zone(a, "none", F.lit(20.0), F.lit(20.0), low, high), "z", F.col("y"), F.lit(90.0), low, high))
    df = df.withColumn("a", events.moved_zone(a, "z", F.lit(90.0), F.col("y"), low, high)).filter(F.size("a.zones") == 1)
    return df.select("event_id", *[a["zones"][0][n].alias(n) for n in ("t0", "t1", "label")])


# --- grids, masks, statistics ---


_FIXES = f""", f AS (SELECT session_id, t / {HOUR} - min(t / {HOUR}) OVER (PARTITION BY session_id) AS t, y AS lat FROM sig),
 span AS (SELECT session_id, max(t) AS t1 FROM f GROUP BY 1 HAVING count(*) > 1),
 grid AS (SELECT session_id, i::INT AS i, i * 0.5::DOUBLE AS t FROM (SELECT *, unnest(range(0, ceil((t1 + 0.5) / 0.5)::BIGINT)) AS i FROM span)),
 near AS (SELECT g.session_id, g.i, g.t, p.t AS pt, p.lat AS py, n.t AS nt, n.lat AS ny FROM grid g ASOF LEFT JOIN f p ON g.session_id = p.session_id AND g.t >= p.t
  ASOF LEFT JOIN f n ON g.session_id = n.session_id AND g.t <= n.t)
"""


@_query(_FIXES + """SELECT session_id, i, t, round(CASE WHEN nt IS NULL THEN NULL WHEN nt > pt THEN py + (ny - py) * (t - pt) / (nt - pt) ELSE py END, 5) AS latitude,
 round(CASE WHEN nt IS NULL THEN NULL WHEN nt > pt THEN 2 * py + (2 * ny - 2 * py) * (t - pt) / (nt - pt) ELSE 2 * py END, 5) AS longitude FROM near""")
def fixes_on_grid(spark, sf):
    """Satellite fixes every half second from the first, without a gap rule; hours serve as seconds."""
    df = signal(spark, sf).select("session_id", (F.col("t") / HOUR).alias("t"), F.col("y").alias("latitude"), (F.col("y") * 2).alias("longitude"))
    out = position.gps_grid(src.from_first_fix(df), KEYS)
    return out.select("session_id", "i", "t", F.round("latitude", 5).alias("latitude"), F.round("longitude", 5).alias("longitude"))


@_query(IDX + """, k AS (SELECT *, kind <> 'error' AS known, first_value(kind <> 'error') OVER (PARTITION BY session_id ORDER BY i) AS ok FROM idx),
 n AS (SELECT *, max(CASE WHEN known THEN i END) OVER (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS pi,
  min(CASE WHEN known THEN i END) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM k)
 SELECT n.session_id, n.event_id, round(CASE WHEN n.known OR NOT n.ok THEN n.y WHEN n.ni IS NULL THEN p.y ELSE p.y + (q.y - p.y) * (n.i - n.pi)::DOUBLE / (n.ni - n.pi) END, 6) AS y
 FROM n LEFT JOIN idx p ON p.session_id = n.session_id AND p.i = n.pi LEFT JOIN idx q ON q.session_id = n.session_id AND q.i = n.ni""")
def known_between(spark, sf):
    """Interpolation between known samples; the last one's value holds to the end."""
    df = indexed(spark, sf).withColumn("known", F.col("kind") != "error")
    return ts.fill_between(df, KEYS, "i", "y", "known", 1000).select("session_id", "event_id", F.round("y", 6).alias("y"))


@_query(IDX + """, w AS (SELECT session_id, unnest(range(0, max(i) + 8)) AS k FROM idx GROUP BY 1)
 SELECT w.session_id, k, count(idx.i) FILTER (v IS NULL) AS n_masked FROM w LEFT JOIN idx ON idx.session_id = w.session_id AND idx.i BETWEEN k - 7 AND k GROUP BY 1, 2""")
def masked_windows(spark, sf):
    """Masked samples of look-back windows that reach over the session's ends."""
    df = indexed(spark, sf).withColumn("m", F.col("v").isNull())
    last = df.groupBy("session_id").agg(F.max("i").alias("last"))
    windows = last.select("session_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") + 7)).alias("k")).withColumn("a", F.col("k") - 7)
    return joins.masked_in_windows(windows, df, KEYS, "i", "m", "a", "k").select("session_id", "k", "n_masked")


@_query(IDX + """SELECT session_id, event_id FROM idx a WHERE y > 60 AND NOT EXISTS (SELECT 1 FROM idx b WHERE b.session_id = a.session_id AND b.v IS NULL AND abs(a.i - b.i) <= 2)""")
def peaks_outside_mask(spark, sf):
    """Peaks that aren't within masked spans, two samples around each missing one."""
    df = indexed(spark, sf).withColumn("m", F.col("v").isNull())
    wide = df.withColumn("w", ts.dilate(KEYS, ["i"], "m", 2)).filter("w")
    return joins.outside_masked(df.filter("y > 60"), wide, [*KEYS, "i"]).select("session_id", "event_id")


@_query("""SELECT session_id, event_id, round((y - avg(y) OVER w) / (stddev_pop(y) OVER w + 1e-12), 6) AS z FROM sig WINDOW w AS (PARTITION BY session_id)""")
def global_zscore(spark, sf):
    """z-scores over whole sessions."""
    return signal(spark, sf).select("session_id", "event_id", F.round(ts.global_z(KEYS, "y"), 6).alias("z"))


@_query(f"""SELECT session_id, round(t, 3) AS start, round(t + g, 3) AS stop, round(g, 3) AS seconds FROM
 (SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY t) - t AS g FROM sig) WHERE g >= {DAY}""")
def gap_list(spark, sf):
    """The gaps of a signal."""
    out = ts.gaps(signal(spark, sf), KEYS, "t", DAY)
    return out.select("session_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("stop"), F.round("seconds", 3).alias("seconds"))


@_query(""", s AS (SELECT *, t - lag(t) OVER (PARTITION BY session_id ORDER BY t) AS step FROM sig),
 a AS (SELECT session_id, min(t) AS a, max(t) AS b, quantile_cont(step, 0.5) AS step, least(min(y), min(v)) AS low, greatest(max(y), max(v)) AS high FROM s GROUP BY 1)
 SELECT session_id, round(a, 3) AS t_min, round(b, 3) AS t_max, round(step, 3) AS step, round(low - 0.08 * (high - low), 6) AS y_min, round(high + 0.08 * (high - low), 6) AS y_max FROM a""")
def metric_summary(spark, sf):
    """Times, median step and range of each session's table."""
    out = agg.table_summary(signal(spark, sf), "t", ["y", "v"])
    return out.select("session_id", *[F.round(c, 3).alias(c) for c in ("t_min", "t_max", "step")], *[F.round(c, 6).alias(c) for c in ("y_min", "y_max")])


@_query(IDX + """, h AS (SELECT *, v IS NULL OR coalesce(t - lag(t) OVER (PARTITION BY session_id ORDER BY t) >= 86400, false) AS invalid FROM idx)
 SELECT session_id, event_id, invalid FROM h""")
def hardware_invalid(spark, sf):
    """Samples with a missing channel, or first after a gap."""
    from pulsegrid.operators import eeg

    df = signal(spark, sf)
    return df.withColumn("invalid", eeg.hardware_invalid(df, KEYS, "t", ["y", "v"], gap=DAY)).select("session_id", "event_id", "invalid")


@_query("""SELECT session_id, round(t, 3) AS t, event_id, tag FROM (SELECT sig.session_id, t, event_id, o_orderstatus AS tag,
 row_number() OVER (PARTITION BY event_id ORDER BY o_orderkey DESC) AS r FROM sig JOIN orders ON o_custkey = sig.session_id
 WHERE t - 26 * 365 * 86400.0::DOUBLE BETWEEN epoch_us(o_orderdate) / 1e6 AND epoch_us(o_orderdate) / 1e6 + 60 * 86400.0::DOUBLE) WHERE r = 1 AND tag <> 'F'""")
def interval_tags_kept(spark, sf):
    """Rows tagged by the last event whose interval holds them, without untagged rows and excluded tags."""
    from pulsegrid.plans.registry import seconds

    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("q"), seconds("o_orderdate").alias("s"), F.col("o_orderstatus").alias("tag"))
    rows = signal(spark, sf).withColumn("at", F.col("t") - 26 * 365 * DAY)
    out = joins.interval_last_wins(rows, o.withColumn("e", F.col("s") + 60 * DAY), KEYS, "at", "s", "e", "q", "tag", 30 * DAY, excluded=["F"])
    return out.select("session_id", F.round("t", 3).alias("t"), "event_id", "tag")


# --- models ---

#: A symmetric positive definite matrix for the first nine components.
PRECISION = [[2.0 if i == j else 0.5 if abs(i - j) == 1 else 0.0 for j in range(9)] for i in range(9)]
_MATRIX = "[" + ", ".join("[" + ", ".join(f"{x}::DOUBLE" for x in row) + "]" for row in PRECISION) + "]"
_NINE = "list_transform(embedding[1:9], lambda x: x::DOUBLE)"
_VOTES = f"""e AS (SELECT vec_id, label, {_NINE} AS v FROM embeddings),
 g AS (SELECT q.vec_id, t.label, t.vec_id AS id, list_transform(range(1, 10), lambda j: q.v[j] - t.v[j]) AS d FROM e q, e t WHERE q.vec_id % 10 = 0 AND t.vec_id % 10 <> 0),
 m AS (SELECT *, list_sum(list_transform(range(1, 10), lambda i: d[i] * list_sum(list_transform(range(1, 10), lambda j: {_MATRIX}[i][j] * d[j])))) AS far FROM g),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(far, 9), id) AS r FROM m),
 votes AS (SELECT vec_id, label, count(*) / 7.0::DOUBLE AS share FROM r WHERE r <= 7 GROUP BY 1, 2)"""


def _nine(spark: SparkSession, sf: str) -> DataFrame:
    x = F.transform(F.slice("embedding", 1, 9), lambda v: v.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), x.alias("vector"))


@_own(f"WITH {_VOTES} SELECT vec_id, label::VARCHAR AS label, share FROM votes")
def knn_mahalanobis(spark, sf):
    """Votes of the seven nearest training vectors by the Mahalanobis distance."""
    e = _nine(spark, sf)
    return joins.knn_vote(e.filter("vec_id % 10 = 0").drop("label"), e.filter("vec_id % 10 <> 0"), "vec_id", "vector", "vec_id", "label", 7, PRECISION)


#: A made-up model of the ten labels, whose scores are simple enough for SQL.
CLASSES = [str(c) for c in range(10)]
MODEL = emo.Model(
    [1.0, -1.0, 2.0, 0.5, 0.0, 1.0, -0.5, 0.25, 0.1], 0.2, [[float((7 * i + 3 * j) % 5 - 2) for j in range(9)] for i in range(10)], [0.1 * i for i in range(10)],
    CLASSES, gate=0.12, cooldown=1, precision=PRECISION,
)


def _scores(model: emo.Model, gated: str, votes: bool, x: str = "v") -> str:
    """SQL from rows (q, x list `v`, gated) named `given` to p_active, label, confidence; classes are compared by 9 decimals."""
    dot = lambda w: " + ".join(f"{c}::DOUBLE * {x}[{j + 1}]" for j, c in enumerate(w))
    scores = "[" + ", ".join(f"{dot(c)} + {b}::DOUBLE" for c, b in zip(model.class_coef, model.class_intercept)) + "]"
    names = "[" + ", ".join(f"'{c}'" for c in model.classes) + "]"
    share = f"{model.lda_share}::DOUBLE * p[i] + {model.knn_share}::DOUBLE * coalesce(k[{names}[i]], 0)" if votes else "p[i]"
    return f"""scores AS (SELECT *, 1 / (1 + exp(-({dot(model.active_coef)} + {model.active_intercept}::DOUBLE))) AS active, {scores} AS s FROM given),
 soft AS (SELECT *, list_transform(s, lambda a: exp(a - list_max(s)) / list_sum(list_transform(s, lambda b: exp(b - list_max(s))))) AS p FROM scores),
 ens AS (SELECT *, list_transform(range(1, {len(model.classes) + 1}), lambda i: {share}) AS e, CASE WHEN {x} IS NULL THEN NULL WHEN gated THEN 0 ELSE active END AS p_active FROM soft),
 done AS (SELECT *, gated OR p_active < {model.threshold} AS quiet, {names}[list_position(list_transform(e, lambda a: round(a, 9)), round(list_max(e), 9))] AS best FROM ens)"""


_GATED = f"""v AS (SELECT vec_id, label, {_NINE} AS v FROM embeddings),
 gates AS (SELECT *, coalesce(v[9] > 0.12, false) AS art FROM v),
 cooled AS (SELECT *, art OR coalesce(max(art) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), false) AS gated FROM gates)"""


@_own(f"""WITH {_VOTES}, {_GATED},
 given AS (SELECT cooled.*, (SELECT map_from_entries(list((votes.label::VARCHAR, share))) FROM votes WHERE votes.vec_id = cooled.vec_id) AS k FROM cooled),
 {_scores(MODEL, "gated", True)}
 SELECT vec_id, gated, round(p_active, 6) AS p_active, CASE WHEN quiet THEN 'Neutral' ELSE best END AS label, round(CASE WHEN quiet THEN 1 - p_active ELSE list_max(e) END, 6) AS confidence FROM done WHERE vec_id % 10 = 0""")
def ensemble_scores(spark, sf):
    """Two-stage inference with the nearest training vectors' votes, gate and cooldown; each label's vectors are a session."""
    e = _nine(spark, sf)
    asked = e.withColumnRenamed("label", "session_id")
    votes = joins.knn_vote(e.filter("vec_id % 10 = 0").drop("label"), e.filter("vec_id % 10 <> 0"), "vec_id", "vector", "vec_id", "label", 7, PRECISION)
    out = emo.infer(asked, KEYS, ["vec_id"], "vector", MODEL, votes, "vec_id").filter("vec_id % 10 = 0")
    return out.select("vec_id", "gated", F.round("p_active", 6).alias("p_active"), "label", F.round("confidence", 6).alias("confidence"))


@_query(f""", c AS (SELECT session_id, event_id, CASE WHEN v IS NOT NULL THEN [v, y / 2 + 1, 3.0::DOUBLE] END AS r FROM sig),
 f AS (SELECT *, sqrt(list_sum(list_transform(r, lambda x: x * x))) AS n, list_sum(r) / 3 AS mean FROM c),
 given AS (SELECT session_id, event_id, list_append(list_transform(r, lambda x: x / n), mean) AS v, coalesce(mean > 30, false) AS gated FROM f),
 {_scores(emo.Model([1.0, -1.0, 0.5, 0.01], -0.1, [[1.0, 0.0, 0.0, 0.0], [0.0, 1.5, 0.0, 0.0], [0.0, 0.0, 9.0, -0.01]], [0.0, 0.1, 0.0], ["A", "B", "C"], gate=30.0), "gated", False)}
 SELECT session_id, event_id, round(1 - p_active, 6) AS neutral, round(p_active * CASE WHEN gated THEN 0 ELSE e[2] END, 6) AS b, CASE WHEN p_active IS NULL THEN NULL WHEN quiet THEN 'Neutral' ELSE best END AS label FROM done""")
def rms_rescoring(spark, sf):
    """Inference on stored RMS windows; windows with a missing channel stay, as nulls."""
    model = emo.Model([1.0, -1.0, 0.5, 0.01], -0.1, [[1.0, 0.0, 0.0, 0.0], [0.0, 1.5, 0.0, 0.0], [0.0, 0.0, 9.0, -0.01]], [0.0, 0.1, 0.0], ["A", "B", "C"], gate=30.0)
    df = signal(spark, sf).select("session_id", "event_id", F.col("v").alias("a"), (F.col("y") / 2 + 1).alias("b"), F.lit(3.0).alias("c"))
    out = emo.rescored(df, KEYS, "event_id", ["a", "b", "c"], model)
    return out.select("session_id", "event_id", F.round("Neutral", 6).alias("neutral"), F.round("B", 6).alias("b"), "label")


@_query("""SELECT event_id, CASE WHEN kind = 'view' THEN y ELSE 0 END AS view, CASE WHEN kind = 'click' THEN y ELSE 0 END AS click, 0.0::DOUBLE AS none FROM sig""")
def features_by_name(spark, sf):
    """A feature vector from a map of names; absent ones count as 0."""
    x = emo.features_from_map(F.create_map("kind", "y"), ["view", "click", "none"])
    return signal(spark, sf).select("event_id", *[x[j].alias(n) for j, n in enumerate(("view", "click", "none"))])


_STATS = {"y": {"low": 0.5, "high": 4.5, "mean": 3.0, "variance": 0.8}, "b": {"low": 0.1, "high": 4.0, "mean": 2.5, "variance": 0.5}}


@_query(""", l AS (SELECT event_id, y, y / 2 + 1 AS b, (least(greatest(ln(y + 1e-8), 0.5), 4.5) - 3) / sqrt(0.8) AS z1, (least(greatest(ln(y / 2 + 1 + 1e-8), 0.1), 4) - 2.5) / sqrt(0.5) AS z2 FROM sig)
 SELECT event_id, round(z1 / (sqrt(z1 * z1 + z2 * z2) + 1e-8), 6) AS first, round(z2 / (sqrt(z1 * z1 + z2 * z2) + 1e-8), 6) AS second, round(1 / (1 + exp(-(sqrt(y * y + b * b) - 20) / 15)), 6) AS energy FROM l""")
def offline_calibration(spark, sf):
    """Direction and energy by a session's fixed parameters."""
    df = signal(spark, sf).select("event_id", "y", (F.col("y") / 2 + 1).alias("b"))
    out = emo.offline_calibrated(df, ["y", "b"], _STATS, 20.0, 15.0)
    return out.select("event_id", F.round(F.col("direction")[0], 6).alias("first"), F.round(F.col("direction")[1], 6).alias("second"), F.round("energy", 6).alias("energy"))


@_query(IDX + """, r AS (SELECT session_id, event_id, i, CASE WHEN 0.2 * y + 0.1 * i BETWEEN 0 AND 30 THEN 0.2 * y + 0.1 * i END AS x FROM idx),
 n AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS pi,
  min(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM r)
 SELECT n.session_id, n.event_id, round(CASE WHEN n.x IS NOT NULL THEN n.x WHEN p.x IS NULL THEN NULL WHEN q.x IS NULL THEN p.x ELSE p.x + (q.x - p.x) * (n.i - n.pi)::DOUBLE / (n.ni - n.pi) END, 6) AS target
 FROM n LEFT JOIN r p ON p.session_id = n.session_id AND p.i = n.pi LEFT JOIN r q ON q.session_id = n.session_id AND q.i = n.ni""")
def channel_repair_filled(spark, sf):
    """One channel from others by regression, values out of range filled in."""
    df = indexed(spark, sf).select("session_id", "event_id", "i", F.col("y").alias("a"), F.col("i").alias("b"))
    out = emo.repair_channel(df, KEYS, "i", "target", {"a": 0.2, "b": Decimal("0.1")}, 0.0, 1000)
    return out.select("session_id", "event_id", rounded(F.col("target"), 6).alias("target"))


@_own("""WITH s AS (SELECT vec_id, label, list_transform(embedding[1:8], lambda x: abs(x::DOUBLE)) AS r FROM embeddings)
 SELECT label, count(*) AS windows, """ + ", ".join(f'round(quantile_cont(r[{j + 1}], 0.5), 6) AS "{c}"' for j, c in enumerate(scalar.CHANNELS)) + " FROM s GROUP BY 1")
def label_report(spark, sf):
    """Windows of each label, and each channel's median."""
    df = table(spark, sf, "embeddings").select(F.lit(1).alias("one"), "label", *[F.abs(F.col("embedding")[j].cast("double")).alias(c) for j, c in enumerate(scalar.CHANNELS)])
    out = emo.report(df, ["one"], scalar.CHANNELS)
    return out.select("label", "windows", *[F.round(c, 6).alias(c) for c in scalar.CHANNELS])


@_own("""SELECT 'd' || (o_orderkey % 7) AS id, arg_max(o_orderkey % 2 = 0, o_orderkey) AS recording, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey % 100 END, o_orderkey)::INT AS battery, max(o_orderkey) AS last_seen
 FROM orders GROUP BY 1""")
def device_table(spark, sf):
    """The latest status of each device; absent fields have defaults."""
    k = F.col("o_orderkey")
    battery = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(', "battery": '), k % 100))
    text = F.concat(F.lit('{"id": "d'), k % 7, F.lit('", "recording": '), F.when(k % 2 == 0, "true").otherwise("false"), battery, F.lit("}"))
    return packets.device_status(table(spark, sf, "orders").select(text.alias("value"), k.alias("timestamp")))


@_own("""SELECT 'devices/' || c_custkey || '/command' AS topic, '{"command":"TAG","payload":"p"}' AS message FROM customer""")
def device_commands(spark, sf):
    """A command for each device."""
    return packets.commands(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id")), "TAG", "p")
