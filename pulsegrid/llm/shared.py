"""What the operators of this subpackage share: tables in the shared folder, joins on hot keys, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own: dict[str, str] = {}
_tables: list[str] = []


def fresh(name: str, taken: list[str]) -> str:
    """The name, with underscores before it until no column in `taken` has it in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """A new run folder in the folder that the cluster names in spark.checkpoint.dir.

    Where that setting is absent a temporary folder serves, but in local mode only: on a cluster the machines do not
    see each other's disks, so the operators refuse to run there without the setting.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not conf.get("spark.master", "local").startswith("local") or "cluster" in conf.get("spark.master", ""):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="pulsegrid-"))
    run = f"{root.rstrip('/')}/pulsegrid-{app}"
    if run not in _own:
        _own[run] = run
        atexit.register(_remove, spark, run)
    return f"{run}/{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, run: str) -> None:
    """Deletes a run's tables as the driver ends; results are lazy and may read them until then."""
    if spark.sparkContext._jsc is None:
        return
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    path = spark._jvm.org.apache.hadoop.fs.Path(run)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: With it Spark removes the shuffle files of a query as that ends, and not at some later collection of garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and lost executors lose nothing. Nothing is left of its shuffles."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Buckets of a table at most; Spark refuses more than 100,000. Beyond that a bucket holds several keys' groups, which are handled one after the other.
MAX_BUCKETS = 50_000


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like save(), bucketed by a key: a later step that needs the key's rows together reads them so, without a shuffle. The table's entry in the catalogue goes with its files."""
    spark = df.sparkSession
    path = shared_dir(spark)
    table = f"pulsegrid_{name}_{path.rpartition('/')[2]}"
    _tables.append(table)
    writer = df.write.bucketBy(min(buckets, MAX_BUCKETS), key).option("compression", "zstd").option("path", f"{path}/{name}")
    writer.saveAsTable(table)
    return spark.table(table)


#: A key with more than one in so many rows is hot, and with more than HOT_LEAST; so there are at most this many hot keys.
HOT_KEYS, HOT_LEAST = 1000, 1000


def join_unique(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """Joins left to right on `key`; right has one row for each key, with the number of its rows on the left in `count`.

    Keys with over 1/HOT_KEYS of left's rows, HOT_KEYS at most by arithmetic, are joined by broadcast, so that no task
    gathers a hot key's rows; the others by a shuffle. Left should be cheap to read twice (a saved table).
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    bar = max(HOT_LEAST, total // HOT_KEYS)
    if total <= bar:
        return left.join(right.drop(count), key, how)
    hot = right.filter(F.col(count) > bar).drop(count)
    keys = hot.select(key, F.lit(True).alias("__hot"))
    marked = left.join(F.broadcast(keys), key, "left")
    warm = marked.filter(F.col("__hot")).drop("__hot").join(F.broadcast(hot), key, how)
    cold = marked.filter(F.col("__hot").isNull()).drop("__hot").join(right.filter(F.col(count) <= bar).drop(count), key, how)
    return warm.unionByName(cold)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `edges` (a, b: long): root is the smallest node that can be reached.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is one pass over edges, never
    more edges than before, about log(nodes) rounds; each round is a table in the shared folder, of which the last two are kept. A hub's edges, a third
    of all perhaps, stay where they are: its least neighbour, found by partial aggregation, comes to them by broadcast (join_unique). Nodes of no edge, and
    self-loops, have no row. An empty table gives an empty result.
    """
    now = save(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen, before = None, None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: a node's larger neighbours go to the least of it and its neighbours
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        first = save(least.filter("n > 0"), "least")
        large = join_unique(both.filter("b > a"), first, "a", "n", "inner")
        large = save(large.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), "large")
        # small star: a node and its smaller neighbours go to the least of these
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        second = save(least, "least")
        small = join_unique(large, second, "a", "n", "inner")
        pairs = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        after = save(small.select(F.explode(pairs).alias("e")).select("e.*").filter("a <> b").distinct(), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        for done in (first, large, second, *([] if before is None else [before])):
            discard(done)
        before, now = now, after
        if tuple(mark) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(mark)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def discard(saved: DataFrame) -> None:
    """Deletes a table of save() that nothing will read again."""
    spark = saved.sparkSession
    for name in {f.rpartition("/")[0] for f in saved.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
