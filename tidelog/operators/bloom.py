"""Bloom filters of segments as tables: built and asked with joins and aggregates alone.

A filter is rows of 64-bit words (seg_id, word, bits), so the filters of any number of segments are
one table, and no filter is a task's or the driver's to hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checks


def sizes(keys: DataFrame) -> DataFrame:
    """seg_id, n_bits: the bits of each segment's filter, whole words, for distinct keys (seg_id, key)."""
    return keys.groupBy("seg_id").agg((F.ceil(F.count("*") * checks.BITS_PER_KEY / 64) * 64).alias("n_bits"))


def _places(keys: DataFrame, sized: DataFrame) -> DataFrame:
    """A row for each key and probe: seg_id, key, word, bit."""
    at = F.explode(F.array_distinct(checks.bloom_positions(F.col("key"), F.col("n_bits")))).alias("at")
    return keys.join(sized, "seg_id").select("seg_id", "key", at).select("seg_id", "key", F.expr("at DIV 64").alias("word"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("bit"))


def build(keys: DataFrame, sized: DataFrame) -> DataFrame:
    """seg_id, word, bits: the words of all filters that hold a bit."""
    return _places(keys, sized).groupBy("seg_id", "word").agg(F.bit_or("bit").alias("bits"))


def may_hold(probes: DataFrame, words: DataFrame, sized: DataFrame) -> DataFrame:
    """The probes (seg_id, key) whose bits are all set: every key of the segment, and about one other in a hundred."""
    asked = _places(probes.distinct(), sized).join(words, ["seg_id", "word"], "left")
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    return asked.groupBy("seg_id", "key").agg(F.min(hit).alias("all")).where("all").select("seg_id", "key")
