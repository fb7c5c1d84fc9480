"""Replay of write-ahead logs up to the first damage.

What counts is the part before the first bad record in order of (wal_id, seq).  That place is one
aggregate; no window over the whole log is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataCorrupted

INSERT_TAG, DELETE_TAG = 4, 2


def first_damage(wal: DataFrame, bad: Column) -> DataFrame:
    """One row: the place of the first bad record (null if there is none)."""
    return wal.agg(F.min(F.when(bad, F.struct("wal_id", "seq"))).alias("cut"))


def point_in_time(wal: DataFrame, bad: Column) -> DataFrame:
    """The records before the first damage; later logs don't count either."""
    cut = F.broadcast(first_damage(wal, bad))
    return wal.join(cut, F.col("cut").isNull() | (F.struct("wal_id", "seq") < F.col("cut"))).drop("cut")


def absolute(wal: DataFrame, bad: Column) -> DataFrame:
    """All records, or DataCorrupted if any is bad."""
    cut = first_damage(wal, bad).first()["cut"]
    if cut is not None:
        raise DataCorrupted(f"record {cut['seq']} of log {cut['wal_id']}")
    return wal


def damage_report(wal: DataFrame, bad: Column) -> DataFrame:
    """Records and bad records of each log."""
    return wal.groupBy("wal_id").agg(F.count("*").alias("records"), F.sum(bad.cast("long")).alias("bad"))


def replay(wal: DataFrame, bad: Column, mode: str = "point_in_time") -> DataFrame:
    return point_in_time(wal, bad) if mode == "point_in_time" else absolute(wal, bad)


def published_prefix(flushes: DataFrame) -> DataFrame:
    """Flushes (id, finished) that may be retired: those before the first unfinished one."""
    first = F.broadcast(flushes.agg(F.min(F.when(~F.col("finished"), F.col("id"))).alias("first")))
    return flushes.join(first, F.col("first").isNull() | (F.col("id") < F.col("first"))).select("id")


def restarts(wal: DataFrame) -> DataFrame:
    """The last stamp of each log: where the clock must go on from."""
    return wal.groupBy("wal_id").agg(F.max("hlc").alias("max_hlc"))


def prefix_by_window(wal: DataFrame, bad: Column) -> DataFrame:
    """The same prefix log by log, where each log stands for itself."""
    before = Window.partitionBy("wal_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return wal.withColumn("_bad", F.sum(bad.cast("int")).over(before)).where("_bad = 0").drop("_bad")
