"""The manifest: a log of edits that folds to the live files of each level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LEVELS

ADD, DELETE, MIN_LIVE_WAL = "ADD", "DELETE", "MIN_LIVE_WAL"


def live_files(edits: DataFrame) -> DataFrame:
    """level and id of the files whose last edit adds them."""
    files = edits.where(F.col("tag") != MIN_LIVE_WAL)
    last = files.groupBy("level", "id").agg(F.max_by("tag", "edit_seq").alias("tag"))
    return last.where(F.col("tag") == ADD).select("level", "id")


def min_live_wal(edits: DataFrame) -> DataFrame:
    """The oldest write-ahead log that still counts (0 if none was named)."""
    return edits.where(F.col("tag") == MIN_LIVE_WAL).agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("min_live_wal"))


def live_wals(wals: DataFrame, edits: DataFrame) -> DataFrame:
    """The logs to replay; the bound is a single row."""
    return wals.join(F.broadcast(min_live_wal(edits)), F.col("wal_id") >= F.col("min_live_wal")).select(wals.columns)


def listed_but_missing(live: DataFrame, directory: DataFrame) -> DataFrame:
    """Files that the manifest lists and the directory lacks: must be none."""
    return live.join(directory.select("id"), "id", "left_anti")


def obsolete(directory: DataFrame, live: DataFrame) -> DataFrame:
    """Files that are there and not listed: to be deleted."""
    return directory.join(live.select("id"), "id", "left_anti")


def violations(edits: DataFrame) -> DataFrame:
    """Edits that don't fit the state before them: edit_seq and reason.

    bad_level: there is no such level.  duplicate_add: the file is live, on whichever level.
    missing_delete: the file isn't live on that level.  wal_regress: the bound goes back.
    Every edit is taken to have been applied, right or wrong.  States are kept by file, so the
    windows are as small as a file's history; that of the bound is reduced to its records first.
    """
    files = edits.where(F.col("tag") != MIN_LIVE_WAL)
    history = Window.partitionBy("id").orderBy("edit_seq")
    was = files.withColumn("_tag", F.lag("tag").over(history)).withColumn("_level", F.lag("level").over(history))
    live = F.coalesce(F.col("_tag") == ADD, F.lit(False))
    reason = (
        F.when(~F.col("level").between(0, LEVELS - 1), "bad_level")
        .when((F.col("tag") == ADD) & live, "duplicate_add")
        .when((F.col("tag") == DELETE) & ~(live & (F.col("_level") == F.col("level"))), "missing_delete")
    )
    wrong = was.select("edit_seq", reason.alias("reason")).where("reason IS NOT NULL")
    bounds = edits.where(F.col("tag") == MIN_LIVE_WAL).select("edit_seq", "id")
    before = Window.orderBy("edit_seq").rowsBetween(Window.unboundedPreceding, -1)
    back = bounds.withColumn("_max", F.max("id").over(before)).where("id < _max").select("edit_seq", F.lit("wal_regress").alias("reason"))
    return wrong.unionByName(back)
