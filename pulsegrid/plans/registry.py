"""What the modules of queries share: the driver's tables as signals, and the register of queries and their SQL.

Sessions are users, times event times in seconds since 1970, signals event values, channels and event names event types; values of `error` events
count as missing where an operator is about missing values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import timeseries as ts

HOUR, DAY, BUCKET = 3600.0, 86400.0, 30 * 86400.0
KEYS = ["session_id"]

#: Events as a signal; `v` is the value, null for errors.
SIG = """WITH sig AS (SELECT user_id AS session_id, event_id, epoch_us(ts) / 1e6 AS t, value AS y,
  CASE WHEN event_type <> 'error' THEN value END AS v, event_type AS kind, props FROM events)
"""
#: The same, numbered in the order of time.
IDX = """, idx AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) - 1 AS i FROM sig)
"""
#: A session's values as a list in the order of time.
LISTS = """, lists AS (SELECT session_id, list(y ORDER BY t, event_id) AS x FROM sig GROUP BY 1)
"""


class Register:
    """Queries by their functions' names, and the SQL that gives the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, signal: bool = True):
        """Registers a function; with `signal` its SQL goes on after that of the signal."""

        def register(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = SIG + sql if signal else sql
            return f

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))") / 1e6


def rounded(x: Column, digits: int) -> Column:
    """Rounded as SQL does, by the scaled number itself; F.round goes by its shortest decimal form."""
    return F.round(x * 10.0**digits) / 10.0**digits


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        "event_id",
        seconds("ts").alias("t"),
        F.col("value").alias("y"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("v"),
        F.col("event_type").alias("kind"),
        "props",
    )


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.row_index(signal(spark, sf_dir), KEYS, ["t", "event_id"])
