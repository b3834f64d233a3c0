"""Result tables: parquet by session, CSV exports with fixed formats, snapshots, and logs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Decimals of exported columns, and the text of missing values.
DECIMALS = {"gpsDf": 7, "positions": 2}
MISSING = {"Emotions": "NULL", "gpsDf": "NULL", "positions": "NULL"}


def write_metric(df: DataFrame, root: str, name: str) -> None:
    """A metric table by session; sessions written again replace their own part only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(f"{root}/{name}")


def write_headerless(df: DataFrame, path: str, columns: list[str]) -> None:
    """Rows of some columns as files without a header, as processed events are kept."""
    df.select(*columns).write.mode("overwrite").option("header", False).option("emptyValue", "").csv(path)


def export_csv(df: DataFrame, path: str, name: str, header: bool = True) -> None:
    """A result table as text, with the decimals and the text for missing values that its name has."""
    digits = DECIMALS.get(name)
    if digits is not None:
        df = df.select(*[F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", c)).alias(c) if t == "double" and c not in ("Timestamp", "t") else F.col(c) for c, t in df.dtypes])
    df.write.mode("overwrite").option("header", header).option("nullValue", MISSING.get(name, "")).csv(path)


def snapshot_once(spark: SparkSession, path: str) -> bool:
    """Keeps the first version of a table beside it; never overwrites it. Whether it was made now."""
    return _copy(spark, path, f"{path}.original", replace=False)


def revert(spark: SparkSession, path: str, log: str | None = None) -> None:
    """Brings the first version back; an error if there is none."""
    fs, p = _at(spark, f"{path}.original")
    if not fs.exists(p):
        raise FileNotFoundError(f"{path}.original")
    _copy(spark, f"{path}.original", path, replace=True)
    if log:
        append_log(spark, log, f"reverted {path}")


def append_log(spark: SparkSession, path: str, message: str) -> None:
    """Adds a row of UTC time and message to an append-only log table."""
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    spark.createDataFrame([(now, message)], "at string, message string").coalesce(1).write.mode("append").parquet(path)


def last_lines(spark: SparkSession, path: str, n: int = 80) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("at")).limit(n)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _copy(spark: SparkSession, source: str, target: str, replace: bool) -> bool:
    fs, a = _at(spark, source)
    _, b = _at(spark, target)
    if fs.exists(b):
        if not replace:
            return False
        fs.delete(b, True)
    return spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, fs, b, False, spark._jsc.hadoopConfiguration())
