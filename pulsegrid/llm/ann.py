"""Approximate nearest neighbours with balanced posting lists.

Method. A bounded sample is bisected again and again by 2-means with a cut at the median, until the pieces are small; their means are the
centroids of equally long posting lists. Every vector joins the list of its nearest centroid, and a vector near a boundary also those
of further centroids at most CLOSURE times as far, unless one that it joined already lies closer to such a centroid than it does (then it adds
nothing). Centroids are searched through a neighbour graph in memory. A query visits the lists whose centroids are at most
``reach`` times as far as its nearest one, however many these are, so a query within a tight cluster visits few lists and one in open space many. Candidates of
those lists are compared exactly, in double precision, on the original vectors.

All rows are indexed; only the centroids come from a sample. Lists longer than CHUNK rows are dealt to several tasks, each of which gives its best few
for a query, so a list that holds a third of all rows isn't one task's work. The number of centroids is bounded by the sample, so the broadcast graph is, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.shared import save

SAMPLE = 20_000
LIST_ROWS = 200
LIST_SAMPLES = 8
REPLICAS = 4
CLOSURE = 1.15
REACH = 1.3
DEGREE = 24
CHUNK = 4_000


def bisected(vectors: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """`lists` centroids of equally large pieces of the sample (unit vectors), by balanced bisection."""
    todo, done = [(np.arange(len(vectors)), lists)], []
    while todo:
        rows, n = todo.pop()
        if n <= 1 or len(rows) < 2:
            done.append(vectors[rows].mean(0))
            continue
        own = vectors[rows]
        # two far points to begin with
        a = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
        b = own[np.argmax(((own - a) ** 2).sum(1))]
        for _ in range(rounds):
            side = own @ (a - b) > (a @ a - b @ b) / 2
            if side.all() or not side.any():
                break
            a, b = own[side].mean(0), own[~side].mean(0)
        cut = len(rows) * (n // 2) // n
        order = np.argsort(own @ (a - b), kind="stable")
        todo += [(rows[order[:cut]], n // 2), (rows[order[cut:]], n - n // 2)]
    centroids = np.array(done)
    return centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)


@dataclass
class Graph:
    """Centroids and the nearest DEGREE others of each, with some spread links so that no part is cut off."""

    centroids: np.ndarray
    links: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Graph:
        n = len(centroids)
        near = min(DEGREE, n - 1)
        links = np.zeros((n, near + 2), np.int64)
        for begin in range(0, n, 1024):
            close = centroids[begin : begin + 1024] @ centroids.T
            close[np.arange(len(close)), np.arange(begin, begin + len(close))] = -np.inf
            links[begin : begin + 1024, :near] = np.argsort(-close, axis=1)[:, :near]
        links[:, near] = (np.arange(n) + 1) % n
        links[:, near + 1] = (np.arange(n) * 2 + n // 2) % n
        return cls(centroids, links)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest centroids found for each query by a best-first walk, and their distances, nearest first."""
        n, width = len(self.centroids), min(width, len(self.centroids))
        count = len(queries)
        seen = np.zeros((count, n), bool)
        entry = np.linspace(0, n - 1, min(n, 16)).astype(np.int64)
        found = np.full((count, width), -1, np.int64)
        away = np.full((count, width), np.inf)
        open_ = np.zeros((count, width), bool)
        self._admit(queries, np.tile(entry, (count, 1)), seen, found, away, open_)
        alive = np.arange(count)
        while len(alive):
            best = np.argmin(np.where(open_[alive], away[alive], np.inf), axis=1)
            has = open_[alive, best]
            alive, best = alive[has], best[has]
            if not len(alive):
                break
            open_[alive, best] = False
            part = [x[alive] for x in (seen, found, away, open_)]
            self._admit(queries[alive], self.links[found[alive, best]], *part)
            seen[alive], found[alive], away[alive], open_[alive] = part
        return found, away

    def _admit(self, queries, ids, seen, found, away, open_) -> None:
        """Merges centroids `ids` into each query's nearest ones; those already seen are left out."""
        rows = np.arange(len(queries))[:, None]
        ids = np.where(seen[rows, ids], -1, ids)
        order = np.sort(ids, axis=1)
        ids = np.where(np.concatenate([np.zeros((len(ids), 1), bool), order[:, 1:] == order[:, :-1]], 1), -1, order)
        distance = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("qd,qkd->qk", queries, self.centroids[ids])))
        distance[ids < 0] = np.inf
        row, at = np.nonzero(ids >= 0)
        seen[row, ids[row, at]] = True
        every, far, fresh = np.concatenate([found, ids], 1), np.concatenate([away, distance], 1), np.concatenate([open_, ids >= 0], 1)
        keep = np.argsort(far, axis=1, kind="stable")[:, : found.shape[1]]
        found[:], away[:], open_[:] = every[rows, keep], far[rows, keep], fresh[rows, keep] & np.isfinite(far[rows, keep])


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square over- or underflows."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _assign(shared):
    """(list, rid, vec_id, embedding): each vector in the lists that it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                unit = _unit(_vectors(batch.column("embedding")))
                found, away = graph.search(unit, 4 * REPLICAS)
                rows, lists = [], []
                for i in range(len(unit)):
                    own = [int(found[i, 0])]
                    for c, d in zip(found[i, 1:].tolist(), away[i, 1:].tolist()):
                        if c < 0 or d > CLOSURE * max(away[i, 0], 1e-9) or len(own) >= REPLICAS:
                            break
                        between = np.sqrt(np.maximum(0, 2 - 2 * graph.centroids[own] @ graph.centroids[c]))
                        if (between > d).all():
                            own.append(c)
                    rows += [i] * len(own)
                    lists += own
                out = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), *out.columns], ["list", *out.schema.names])

    return run


def _route(shared, reach: float, width: int):
    """(list, rid, vec_id, embedding) of queries: one row for each list that a query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                unit = _unit(_vectors(batch.column("embedding")))
                found, away = graph.search(unit, width)
                bar = reach * np.maximum(away[:, :1], 1e-9) + 1e-12
                rows, at = np.nonzero((found >= 0) & (away <= bar))
                lists = found[rows, at]
                # where the last list found is within reach, further ones may be: all centroids are compared
                more = np.flatnonzero((found[:, -1] >= 0) & (away[:, -1] <= bar[:, 0]))
                if len(more) and found.shape[1] < len(graph.centroids):
                    every = np.sqrt(np.maximum(0, 2 - 2 * unit[more] @ graph.centroids.T)) <= bar[more]
                    every[np.arange(len(more))[:, None], found[more]] = False
                    i, far = np.nonzero(every)
                    rows, lists = np.concatenate([rows, more[i]]), np.concatenate([lists, far])
                out = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(lists), *out.columns], ["list", *out.schema.names])

    return run


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, in an order of summation that doesn't depend on the number of rows."""
    q, v = q / np.abs(q).max(), v / np.abs(v).max(1, keepdims=True)
    return (q * v).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum(1)))


def best(q: np.ndarray, own: int, rid: np.ndarray, vec_id: np.ndarray, v: np.ndarray, rough: np.ndarray, k: int):
    """Rows and scores of the k nearest: those that may be among them by the rough cosines are compared exactly."""
    rough = np.where(rid == own, -np.inf, rough)
    live = int((rid != own).sum())
    if not live:
        return np.zeros(0, np.int64), np.zeros(0)
    bar = np.partition(rough, -min(k, live))[-min(k, live)]
    may = np.flatnonzero(rough >= bar - 1e-9)
    may = may[rid[may] != own]
    score = cosine(q, v[may])
    order = np.lexsort((vec_id[may], -score))[:k]
    return may[order], score[order]


def _compare(k: int):
    def run(lists: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_rid": [], "query_id": [], "rid": [], "vec_id": [], "score": []}
        if lists.num_rows and queries.num_rows:
            v = _vectors(lists.column("embedding").combine_chunks())
            q = _vectors(queries.column("embedding").combine_chunks())
            rid, vec_id = lists.column("rid").to_numpy(), lists.column("vec_id").to_numpy()
            unit = _unit(v).T
            for begin in range(0, len(q), 256):
                rough = _unit(q[begin : begin + 256]) @ unit
                for i, row in enumerate(rough):
                    own = queries.column("rid")[begin + i].as_py()
                    at, score = best(q[begin + i], own, rid, vec_id, v, row, k)
                    out["query_rid"] += [own] * len(at)
                    out["query_id"] += [queries.column("vec_id")[begin + i].as_py()] * len(at)
                    out["rid"] += rid[at].tolist()
                    out["vec_id"] += vec_id[at].tolist()
                    out["score"] += score.tolist()
        return pa.table(out, pa.schema([("query_rid", pa.int64()), ("query_id", pa.int64()), ("rid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return run


def nearest(vectors: DataFrame, queries: str, k: int = 5, reach: float = REACH, width: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors(vec_id, embedding) that meets the condition `queries`, the k nearest other rows found.

    Nearness is the cosine, in double precision; rank from 1, ties to the smaller vec_id. Rows with a null vec_id, and vectors that are null, zero,
    hold null or non-finite components or haven't the length that most vectors have (ties: the shortest), take no part. Repeated rows are rows:
    equal vectors are each other's nearest. A query whose lists hold fewer than k others visits all lists; fewer rows than k give what there is; more columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    doubles = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = doubles.filter(
        "vec_id is not null and embedding is not null and size(embedding) > 0 "
        "and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    )
    lengths = sound.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    usual = lengths[0].n if lengths else 0
    rows = save(sound.filter(F.size("embedding") == usual).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    total = rows.count()
    schema = "list long, vec_id long, embedding array<double>, rid long"
    sample = rows.orderBy(F.xxhash64("vec_id", "rid"), "rid").select("embedding").limit(SAMPLE).toArrow().column("embedding")
    if total:
        unit = _unit(_vectors(sample.combine_chunks()))
        lists = max(1, min(total // LIST_ROWS, len(unit) // LIST_SAMPLES))
        graph = Graph.of(bisected(unit, lists))
    else:
        graph = Graph(np.zeros((1, 1)), np.zeros((1, 1), np.int64))
    shared = spark.sparkContext.broadcast(graph)
    posted = rows.mapInArrow(_assign(shared), schema)
    lengths = posted.groupBy("list").count().select("list", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    lengths = save(lengths, "lists")  # a row for each centroid
    posted = posted.join(F.broadcast(lengths), "list").withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
    columns = ["list", "chunk", "vec_id", "embedding", "rid"]

    def compared(asked: DataFrame) -> DataFrame:
        """The k nearest rows of each (list, chunk) that a query visits."""
        asked = asked.join(F.broadcast(lengths), "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        both = posted.select(*columns).groupBy("list", "chunk").cogroup(asked.select(*columns).groupBy("list", "chunk"))
        return both.applyInArrow(_compare(k), "query_rid long, query_id long, rid long, vec_id long, score double")

    queried = rows.filter(queries)
    found = save(compared(queried.mapInArrow(_route(shared, reach, width), schema)).dropDuplicates(["query_rid", "rid"]), "found")
    enough = found.groupBy("query_rid").count().filter(F.col("count") >= min(k, total - 1)).select(F.col("query_rid").alias("rid"))
    short = save(queried.join(enough, "rid", "left_anti").select("vec_id", "embedding", "rid"), "short")
    if total > 1 and not short.isEmpty():  # their lists hold too few others: they visit all lists
        every = short.withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(graph.centroids) - 1).cast("long"))))
        found = found.join(short.select(F.col("rid").alias("query_rid")), "query_rid", "left_anti").unionByName(compared(every).dropDuplicates(["query_rid", "rid"]))
    by_query = Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id", "rid")
    found = found.withColumn("rank", F.row_number().over(by_query))
    return found.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
