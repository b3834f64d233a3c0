"""Documents to shards of nearly equal bytes by Karmarkar-Karp differencing; documents with equal texts stay together.

Method. A partial partition is a tuple of bin sizes. A group of equal texts begins as one with a single filled bin; repeatedly the two partial
partitions with the largest spread are combined in opposite order, the largest bin of one with the smallest of the other.

That order matters: large groups must meet before small ones level them, so the small ones may not be levelled by themselves before. Groups of over
1/LARGE of a shard, at most LARGE a shard by arithmetic, therefore wait for the last step. The small ones are dealt by a hash to SCALES scales, each with half the bytes of the one
before, and within a scale to buckets of bounded size; a bucket's groups are combined to FINE bins a shard, each in one task, and a scale's buckets in the same way, FAN at a time,
until one partial partition of the scale is left. In the last step the scales' bins, whose sizes fall from a quarter of a shard to less than a
thousandth, and the large groups are combined one by one: the spread left is about that of the smallest bins. No task sees more than a bucket, or what
the last step has by arithmetic.

A group is indivisible: one larger than a shard's share makes a shard of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.shared import join_unique, save

GROUPS_PER_BUCKET = 20_000
FAN = 500
LARGE, SCALES, FINE = 500, 12, 2
ROWS_PER_SLOT_RANGE = 5_000


def differencing(partials: list[list[int]], bins: int) -> list[list[int]]:
    """The final bin of each bin of each partial partition (lists of at most `bins` sizes); bin 0 has the most bytes."""
    parent: list[int] = []
    names = []
    heap = []
    for i, sizes in enumerate(partials):
        own = []
        for size in sizes:
            own.append((size, len(parent)))
            parent.append(-1)
        names.append([n for _, n in own])
        own = sorted((s, n) for s, n in own if s)[::-1]
        heap.append((_minus_spread(own, bins), i, own))
    heapq.heapify(heap)
    serial = len(partials)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = a + b
        if len(both) > bins:  # bin j of one meets bin `bins - 1 - j` of the other; with fewer, each meets an empty bin
            meet = len(both) - bins
            both = a[: len(a) - meet] + b[: len(b) - meet]
            for (s, n), (t, m) in zip(a[len(a) - meet :], reversed(b[len(b) - meet :])):
                parent[n] = parent[m] = len(parent)
                both.append((s + t, len(parent)))
                parent.append(-1)
        both.sort(reverse=True)
        heapq.heappush(heap, (_minus_spread(both, bins), serial, both))
        serial += 1
    label = [0] * len(parent)
    for j, (_, n) in enumerate(heap[0][2] if heap else []):
        label[n] = j
    for n in range(len(parent) - 1, -1, -1):
        if parent[n] >= 0:
            label[n] = label[parent[n]]
    return [[label[n] for n in own] for own in names]


def _minus_spread(own: list[tuple[int, int]], bins: int) -> int:
    return 0 if not own else (own[-1][0] if len(own) == bins else 0) - own[0][0]


def _bucket(bins: int) -> Callable[[pa.Table], pa.Table]:
    """Groups of a bucket to its bins."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("bytes", "descending"), ("name", "ascending")])
        found = differencing([[b] for b in group.column("bytes").to_pylist()], bins)
        return group.append_column("bin", pa.array([f[0] for f in found], pa.int32()))

    return run


def _combine(bins: int) -> Callable[[pa.Table], pa.Table]:
    """Bins of some buckets to those of their parent."""

    def run(group: pa.Table) -> pa.Table:
        bucket, bin_, size = (group.column(c).to_numpy() for c in ("bucket", "bin", "bytes"))
        order = np.lexsort((bin_, bucket))
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        parts = np.split(order, cut)
        found = differencing([size[p].tolist() for p in parts], bins)
        target = np.zeros(len(bucket), np.int32)
        for part, own in zip(parts, found):
            target[part] = own
        return group.append_column("target", pa.array(target))

    return run


def _last(bins: int) -> Callable[[pa.Table], pa.Table]:
    """Bins of the scales and large groups to the shards."""

    def run(items: pa.Table) -> pa.Table:
        items = items.sort_by([("bytes", "descending"), ("scale", "ascending"), ("bin", "ascending"), ("name", "ascending")])
        found = differencing([[b] for b in items.column("bytes").to_pylist()], bins)
        return items.append_column("shard", pa.array([f[0] for f in found], pa.int32()))

    return run


def shard_by_bytes(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs(doc_id, text).

    size: UTF-8 bytes of the text plus 8 (null: 8). text_crc32: unsigned, of the UTF-8 bytes (null: 0, as an empty text). law is `bytes`: shards 0 to
    shards - 1 have nearly equal sizes; equal texts share a shard, all nulls being one group apart from the empty text. slot numbers a shard's rows
    from 0 without gaps by ranges of a hash of doc_id and text, then doc_id; rows that are equal throughout get neighbouring slots. grown_shard is null under this law. Null doc_ids are rows
    like others; more columns are ignored; an empty table gives an empty result; there may be fewer groups than shards.
    """
    rows = save(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64("text").alias("name"),
        ),
        "rows",
    )
    total, everything = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bins, bar = FINE * shards, max(1, everything // (shards * LARGE))
    groups = save(rows.groupBy("name").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")), "groups")
    # scale j has about 2^-(j + 1) of the small groups
    zeros = F.lit(63) - F.floor(F.log2(F.greatest(F.lit(1.0), F.pmod(F.xxhash64("name", F.lit(2)), F.lit(1 << 62)).cast("double") * 2)))
    wide = [max(1, -(-total // (GROUPS_PER_BUCKET << (j + 1)))) for j in range(SCALES)]
    small = groups.filter(F.col("bytes") <= bar).withColumn("scale", F.least(zeros, F.lit(SCALES - 1)).cast("int"))
    buckets = F.element_at(F.array(*[F.lit(w) for w in wide]), F.col("scale") + 1)
    small = small.withColumn("bucket", F.pmod(F.xxhash64("name", F.lit(1)), buckets))
    placed = small.groupBy("scale", "bucket").applyInArrow(_bucket(bins), "name long, bytes long, copies long, scale int, bucket long, bin int")
    placed = save(placed, "placed")
    sums = placed.groupBy("scale", "bucket", "bin").agg(F.sum("bytes").alias("bytes"))
    where = sums.select("scale", "bucket", "bin", F.col("bucket").alias("now"), F.col("bin").alias("at"))
    left = max(wide)
    while left > 1:
        up = sums.withColumn("parent", F.floor(F.col("bucket") / FAN))
        up = up.groupBy("scale", "parent").applyInArrow(_combine(bins), "scale int, bucket long, bin int, bytes long, parent long, target int")
        up = save(up, "level")
        step = up.select("scale", F.col("bucket").alias("now"), F.col("bin").alias("at"), F.col("parent"), F.col("target"))
        where = where.join(step, ["scale", "now", "at"]).select("scale", "bucket", "bin", F.col("parent").alias("now"), F.col("target").alias("at"))
        sums = up.groupBy("scale", F.col("parent").alias("bucket"), F.col("target").alias("bin")).agg(F.sum("bytes").alias("bytes"))
        left = -(-left // FAN)
    large = groups.filter(F.col("bytes") > bar)
    last = sums.select("scale", "bin", F.lit(None).cast("long").alias("name"), "bytes")
    last = last.unionByName(large.select(F.lit(None).cast("int").alias("scale"), F.lit(None).cast("int").alias("bin"), "name", "bytes"))
    last = save(last.groupBy().applyInArrow(_last(shards), "scale int, bin int, name long, bytes long, shard int"), "last")
    of_bin = last.filter("scale is not null").select("scale", F.col("bin").alias("at"), "shard")
    named = placed.join(where.select("scale", "bucket", "bin", "at"), ["scale", "bucket", "bin"]).join(F.broadcast(of_bin), ["scale", "at"]).select("name", "copies", "shard")
    named = named.unionByName(large.select("name", "copies").join(F.broadcast(last.filter("scale is null").select("name", "shard")), "name"))
    out = join_unique(rows, save(named, "named"), "name", "copies", "inner")

    ranges = max(1, -(-total // (shards * ROWS_PER_SLOT_RANGE)))
    out = out.withColumn("range", F.pmod(F.xxhash64("doc_id", "name"), F.lit(ranges)))
    out = save(out, "sharded")
    bases = out.groupBy("shard", "range").count()
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select("shard", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard", "range").orderBy("doc_id", "name")
    out = out.withColumn("at", F.row_number().over(inner)).join(bases, ["shard", "range"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("base") + F.col("at") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
