"""Live packets of headsets: losses, late packets and duplicates by sequence number, with state for each device.

Sequence numbers count modulo 128; the signed distance to the newest number gives a packet its place. Packets leave in the order of their places. A
missing one is waited for until the newest is HOLD places ahead of it; if it comes by then it takes its place, else it is lost, and is ten rows of nulls. A
duplicate, and a packet whose place has left, are left out. The same function runs on a table and on a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.functions import scalar

MODULUS, ROWS_PER_PACKET, FRAME = 128, 10, 24
#: Places that a missing packet is waited for, and the packets and movement samples that may queue.
HOLD, PACKET_QUEUE, MOTION_QUEUE = 10, 256, 128
ROWS = "device_id string, n long, " + ", ".join(f"{c} double" for c in scalar.CHANNELS)


def decode_headset(packet: bytes) -> list[list[float]]:
    """Microvolts of each whole frame of eight big-endian 24-bit numbers after the sequence byte; a torn frame is dropped."""
    frames = (len(packet) - 1) // FRAME
    unit = 2 * 4.5e6 / (12 * (1 << 24))
    return [
        [int.from_bytes(packet[1 + FRAME * f + 3 * c : 4 + FRAME * f + 3 * c], "big", signed=True) * unit for c in range(8)] for f in range(frames)
    ]


def distance(last: int, now: int) -> int:
    """Signed distance of sequence numbers, -64 to 63."""
    return (now - last + MODULUS // 2) % MODULUS - MODULUS // 2


class Order:
    """The packets of a device on their way out: places from `head` on wait in `held`; `newest` is the largest place so far, `n` the next row's number."""

    def __init__(self, head: int = 0, newest: int = -1, last: int = -1, n: int = 0, held: dict[int, bytes] | None = None) -> None:
        self.head, self.newest, self.last, self.n, self.held = head, newest, last, n, held or {}

    def push(self, packet: bytes, hold: int) -> list[list[float] | None]:
        """Rows that a packet sets free; None is a row of nulls."""
        seq = packet[0] % MODULUS
        place = self.newest + (distance(self.last, seq) if self.newest >= 0 else 1)
        if place < self.head or place in self.held:
            return []
        self.held[place] = packet
        if place > self.newest:
            self.newest, self.last = place, seq
        return self._free(hold)

    def flush(self) -> list[list[float] | None]:
        """What is left, as at the end of a recording."""
        return self._free(0)

    def _free(self, hold: int) -> list[list[float] | None]:
        rows: list[list[float] | None] = []
        while self.head <= self.newest and (self.head in self.held or self.newest - self.head >= hold):
            rows += decode_headset(self.held.pop(self.head)) if self.head in self.held else [None] * ROWS_PER_PACKET
            self.head += 1
        return rows

    def numbered(self, device: str, rows: list[list[float] | None]) -> list[tuple]:
        out = [(device, self.n + j, *(values or [None] * 8)) for j, values in enumerate(rows)]
        self.n += len(rows)
        return out


def live_rows(packets: DataFrame, hold: int = HOLD, queue: int | None = None) -> DataFrame:
    """Rows of a stream of (device_id, arrived, packet), numbered for each device, nulls where packets were lost.

    queue: of a batch's packets of a device only so many, the newest, are taken, and the dropped ones count as lost; None takes all.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            head, newest, last, n, places, kept = state.get
            own = Order(head, newest, last, n, dict(zip(places, map(bytes, kept))))
        else:
            own = Order()
        packets = pd.concat(list(batches)).sort_values("arrived", kind="stable")
        packets = packets if queue is None else packets.tail(queue)
        rows = [r for p in packets["packet"] for r in own.numbered(key[0], own.push(bytes(p), hold))]
        state.update((own.head, own.newest, own.last, own.n, list(own.held), list(own.held.values())))
        yield pd.DataFrame(rows, columns=["device_id", "n", *scalar.CHANNELS])

    kept = "head long, newest long, last int, n long, places array<long>, held array<binary>"
    return packets.groupBy("device_id").applyInPandasWithState(step, ROWS, kept, "append", GroupStateTimeout.NoTimeout)


def batch_rows(packets: DataFrame, hold: int = HOLD, flush: bool = True) -> DataFrame:
    """The same rows of a table; without `flush` what a stream would still hold at its end is left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        device, own = pdf.device_id.iloc[0], Order()
        rows = [r for p in pdf.sort_values("arrived", kind="stable").packet for r in own.numbered(device, own.push(bytes(p), hold))]
        rows += own.numbered(device, own.flush()) if flush else []
        return pd.DataFrame(rows, columns=["device_id", "n", *scalar.CHANNELS])

    return packets.groupBy("device_id").applyInPandas(run, ROWS)


LANDED = "device_id string, arrived long, packet binary"


def landed_packets(files: DataFrame) -> DataFrame:
    """(device_id, arrived, packet) of files (path, content) in a landing folder, named device-number: packets with a 16-bit little-endian length before each.

    arrived: the file's number times 2^32, plus the packet's place in it. A torn packet at a file's end is left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content):
                device, _, number = path.rpartition("/")[2].partition(".")[0].rpartition("-")
                at, place = 0, int(number) << 32
                while at + 2 <= len(content):
                    end = at + 2 + int.from_bytes(content[at : at + 2], "little")
                    if end > len(content):
                        break
                    rows.append((device, place, bytes(content[at + 2 : end])))
                    at, place = end, place + 1
            yield pd.DataFrame(rows, columns=["device_id", "arrived", "packet"])

    return files.select("path", "content").mapInPandas(run, LANDED)


def packet_source(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """The stream of packets that land as files in a folder; files_per_batch bounds what a batch takes, so a backlog waits in the folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return landed_packets(files.option("maxFilesPerTrigger", files_per_batch).load(folder))


def commands(devices: DataFrame, kind: str, payload: str | None = None) -> DataFrame:
    """(topic, message): a START, STOP or TAG for each device (id), as JSON; a TAG carries its payload."""
    if kind not in ("START", "STOP", "TAG"):
        raise ValueError(f"{kind} isn't a command")
    fields = [F.lit(kind).alias("command"), *([F.lit(payload).alias("payload")] if payload is not None else [])]
    return devices.select(F.concat(F.lit("devices/"), F.col("id"), F.lit("/command")).alias("topic"), F.to_json(F.struct(*fields)).alias("message"))


def motion_rows(packets: DataFrame) -> DataFrame:
    """Nine axes of (device_id, packet) with little-endian 16-bit numbers."""
    kinds = [("acc", a) for a in "xyz"] + [("gyro", a) for a in "xyz"] + [("mag", a) for a in "xyz"]
    return packets.select("device_id", *[scalar.motion(scalar.int16_little(F.col("packet"), 2 * j), k).alias(f"{k}_{a}") for j, (k, a) in enumerate(kinds)])


def wristband_rows(frames: DataFrame) -> DataFrame:
    """t (ms), acceleration, skin resistance (kilo-ohm) and pulse (mV) of (device_id, t, frame): 14 bytes, five numbers after the first four."""
    raw = [scalar.int16_little(F.col("frame"), 4 + 2 * j, signed=False) for j in range(5)]
    whole = frames.filter(F.octet_length("frame") == 14)
    return whole.select("device_id", "t", raw[0].alias("x"), raw[1].alias("y"), raw[2].alias("z"), scalar.skin_resistance(raw[4]).alias("eda_kohm"), scalar.pulse_millivolts(raw[3]).alias("ppg_mv"))


def device_status(messages: DataFrame) -> DataFrame:
    """The latest status of each device of (value, timestamp) messages in JSON; absent fields have defaults. For update mode."""
    s = F.from_json("value", "id string, recording boolean, battery int")
    named = messages.select(F.coalesce(s["id"], F.lit("device")).alias("id"), F.coalesce(s["recording"], F.lit(False)).alias("recording"), F.coalesce(s["battery"], F.lit(-1)).alias("battery"), "timestamp")
    last = F.max_by(F.struct("recording", "battery"), "timestamp")
    return named.groupBy("id").agg(last.alias("s"), F.max("timestamp").alias("last_seen")).select("id", "s.recording", "s.battery", "last_seen")


def record(rows: DataFrame, path: str, checkpoint: str, seconds: int = 1):
    """Writes a stream's rows as parquet, exactly once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
