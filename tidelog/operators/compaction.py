"""What to merge next, and the merge: scores of levels, choice of files, newest versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import Options
from ..schema import LEVELS
from . import resolve
from .oplog import union
from .segments import overlap_sums, overlaps

BOTTOM = LEVELS - 1


def scores(stats: DataFrame, options: Options) -> DataFrame:
    """level and score: files over the trigger for level 0, bytes over the limit for others; the bottom has none."""
    score = F.when(F.col("level") == 0, F.col("files") / F.lit(float(options.l0_trigger)))
    for level in range(1, BOTTOM):
        score = score.when(F.col("level") == level, F.col("bytes") / F.lit(float(options.level_limit(level))))
    return stats.select("level", score.alias("score")).where("score IS NOT NULL")


def pick_level(stats: DataFrame, options: Options) -> DataFrame:
    """The level of the highest score of 1 or more; of equals the shallower."""
    return scores(stats, options).where("score >= 1").orderBy(F.desc("score"), "level").limit(1)


def level0_inputs(segments: DataFrame) -> DataFrame:
    """Level 0's files, and those of level 1 that meet the range of all of them."""
    zero = segments.where("level = 0")
    span = zero.agg(F.min("min_key").alias("_low"), F.max("max_key").alias("_high"))
    one = segments.where("level = 1").join(F.broadcast(span), F.expr("min_key <= _high AND _low <= max_key"))
    return zero.unionByName(one.drop("_low", "_high"))


def overlap_ratios(segments: DataFrame, level: int) -> DataFrame:
    """Each file of a level with the files and bytes of the next that it meets, and their ratio to its own bytes."""
    own, below = segments.where(F.col("level") == level), segments.where(F.col("level") == level + 1)
    met = overlap_sums(own, below)
    joined = own.join(met, own["seg_id"] == met["a_seg_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("seg_id", "bytes", zero("met_files"), zero("met_bytes")).withColumn("ratio", F.col("met_bytes") / F.col("bytes"))


def pick_file(segments: DataFrame, level: int) -> DataFrame:
    """The file that is cheapest to merge down; of equals that of the greatest id."""
    return overlap_ratios(segments, level).orderBy("ratio", F.desc("seg_id")).limit(1)


def merge(runs: list[DataFrame], keys: list[str], output_level: int, version: str = "hlc", keep_tombstones: bool = False) -> DataFrame:
    """The newest version of each key of all runs.  Tombstones stay, to hide older versions
    further down, but at the bottom, where nothing older is left (there too with ``keep_tombstones``)."""
    out = resolve.newest(union(runs), keys, version)
    return out.where(~F.col("deleted")) if output_level >= BOTTOM and not keep_tombstones else out


def disjoint(segments: DataFrame) -> DataFrame:
    """Pairs of files of one level from 1 on with common keys: must be none."""
    deep = segments.where("level >= 1")
    return overlaps(deep, deep).where("a_level = b_level AND a_seg_id < b_seg_id")
