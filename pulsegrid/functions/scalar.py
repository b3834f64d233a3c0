"""Expressions on single rows: sensor decoding, masks and scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = ["AF8", "AF7", "CHEEK_R", "CHEEK_L", "EAR_R", "AFz", "BROW_L", "NOSE"]
#: Older channel names.
ALIASES = {"HEAD_R": "AF8", "HEAD_L": "AF7", "FOREHEAD_L": "AFz", "BROW": "BROW_L"}
#: Band edges in Hz, both included; 22 to 30 is covered by none.
BANDS = {"delta": (0, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 22), "gamma": (30, 50)}
SATURATION = 187500.0


def to_null(x: Column) -> Column:
    """NaN to null."""
    return F.when(~F.isnan(x), x)


def unsaturated(x: Column) -> Column:
    """Null at the converter's limit."""
    return F.when(F.abs(F.abs(x) - SATURATION) >= 0.1, x)


def connected(x: Column) -> Column:
    """Null at the converter's limit and at zero, within the relative tolerance that goes with the size."""
    return F.when((F.abs(F.abs(x) - SATURATION) > 1 + 1e-5 * SATURATION) & (F.abs(x) > 1), x)


def montage(c: dict[str, Column]) -> dict[str, Column]:
    """Derived EEG channels of the headset's raw ones."""
    af8, af7, ear = c["AF8"], c["AF7"], c["EAR_R"]
    return {"AF7": af7 - ear / 2, "AF8": af8 - ear / 2, "T9": -ear / 2, "T10": ear / 2, "LeftHemi": af7, "RightHemi": af8 - ear}


def re_reference(c: dict[str, Column]) -> dict[str, Column]:
    """All channels less half the ear channel, itself included."""
    return {name: x - c["EAR_R"] / 2 for name, x in c.items()}


def conductance(kilo_ohm: Column) -> Column:
    return F.try_divide(F.lit(1000.0), kilo_ohm)


def soft_clip(x: Column, limit: float = 80.0) -> Column:
    return limit * F.tanh(x / limit)


def gain_zero(x: Column, gain: float, zero: float) -> Column:
    return x * gain + zero


def within(x: Column, low: float = 0.0, high: float = 30.0) -> Column:
    """Null outside the closed range."""
    return F.when(x.between(low, high), x)


def microvolts(raw: Column) -> Column:
    """A 24-bit converter value, gain 12, reference 4.5 V."""
    return raw * (2 * 4.5e6 / (12 * (1 << 24)))


def int24(packet: Column, offset: Column | int) -> Column:
    """A big-endian signed 24-bit number at a byte offset (from 0) of a binary column."""
    raw = F.conv(F.hex(F.substr(packet, F.lit(offset) + 1, F.lit(3))), 16, 10).cast("long")
    return F.when(raw >= 1 << 23, raw - (1 << 24)).otherwise(raw)


def int16_little(packet: Column, offset: Column | int, signed: bool = True) -> Column:
    low = F.conv(F.hex(F.substr(packet, F.lit(offset) + 1, F.lit(1))), 16, 10).cast("long")
    high = F.conv(F.hex(F.substr(packet, F.lit(offset) + 2, F.lit(1))), 16, 10).cast("long")
    raw = high * 256 + low
    return F.when(raw >= 1 << 15, raw - (1 << 16)).otherwise(raw) if signed else raw


def motion(raw: Column, kind: str) -> Column:
    """Accelerometer (g), gyroscope (degrees a second) and magnetometer (gauss) from raw counts."""
    return raw * ({"acc": 0.061, "gyro": 8.75, "mag": 0.14}[kind] / 1000)


def skin_resistance(raw: Column) -> Column:
    """Kilo-ohm of a wristband value: the upper two bits choose the feedback resistor; null where the divider has no solution."""
    feedback = F.array(*[F.lit(r) for r in (40.2, 287.0, 1000.0, 3300.0)])
    rf = F.element_at(feedback, (F.shiftright(raw, 14).bitwiseAND(3) + 1).cast("int"))
    den = raw.bitwiseAND(0x3FFF) * (3.0 / 4095) / 0.5 - 1
    return F.when(F.abs(den) >= 1e-9, rf / den)


def pulse_millivolts(raw: Column) -> Column:
    return raw * (3000.0 / 4095)


def l2_with_mean(values: Column) -> Column:
    """The unit vector (a zero vector unchanged) followed by the mean of the values themselves."""
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform(values, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x.cast("double") / norm))
    return F.concat(unit, F.array(total / F.size(values)))


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - top) for s in scores]
    whole = reduce(lambda a, b: a + b, parts)
    return [p / whole for p in parts]


def dot(values: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def project_to_circle(gx: Column, gy: Column, x: Column, y: Column, r: Column) -> tuple[Column, Column]:
    """The point of a circle nearest to a guess; null where the guess is its centre."""
    d = F.sqrt((gx - x) * (gx - x) + (gy - y) * (gy - y))
    return x + F.try_divide((gx - x) * r, d), y + F.try_divide((gy - y) * r, d)


def floor_height(ids: Column, floors: list[tuple[list[str], float]], otherwise: Column) -> Column:
    """The height of the first floor of which any antenna is seen."""
    out = otherwise
    for names, z in reversed(floors):
        out = F.when(F.arrays_overlap(ids, F.array(*[F.lit(n) for n in names])), F.lit(float(z))).otherwise(out)
    return out


def to_step(x: Column, base: float) -> Column:
    """To a multiple of base, ties to even."""
    return F.rint(x / base) * base


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def minutes_seconds(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), (s % 60).cast("long"))


def is_mac(x: Column) -> Column:
    return x.rlike("^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$")
