"""Hybrid logical clock stamps: microseconds since the epoch in the upper bits, a counter in the lower twelve.

A tick is ``max(previous + 1, floor + 1, now << 12)``.  Over a log in order of n = 1, 2, ... that
is ``n + max(h0, max over i <= n of ((now_i << 12) - i))``: one running maximum.  It is computed in two
levels, within buckets of the order and over bucket maxima, so no task sees the whole log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CLOCK_BITS

#: Rows that a bucket of the order holds, about.
BUCKET_ROWS = 1 << 20


def stamp(micros: Column, counter: Column) -> Column:
    return F.shiftleft(micros.cast("long"), CLOCK_BITS).bitwiseOR(counter.cast("long"))


def micros_of(hlc: Column) -> Column:
    return F.shiftrightunsigned(hlc, CLOCK_BITS)


def counter_of(hlc: Column) -> Column:
    return hlc.bitwiseAND(F.lit((1 << CLOCK_BITS) - 1))


def tick(previous: int, now_micros: int, floor: int = 0) -> int:
    """One step on the driver, for single writes."""
    return max(previous + 1, floor + 1, now_micros << CLOCK_BITS)


def assign(log: DataFrame, order: str, now_micros: str, start: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``log`` with a column hlc: stamps in order of the whole number ``order`` (unique), after ``start``."""
    span = log.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n")).first()
    if not span["n"]:
        return log.withColumn("hlc", F.lit(None).cast("long"))
    width = max(1, -(-(span["high"] - span["low"] + 1) * bucket_rows // span["n"]))
    bucketed = log.withColumn("_bucket", F.expr(f"(`{order}` - {span['low']}) div {width}"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(order)
    placed = bucketed.join(sizes, "_bucket").withColumn("_at", F.row_number().over(inside) + F.col("_before"))
    placed = placed.withColumn("_lead", F.shiftleft(F.col(now_micros).cast("long"), CLOCK_BITS) - F.col("_at"))
    peaks = placed.groupBy("_bucket").agg(F.max("_lead").alias("_peak"))
    peaks = peaks.select("_bucket", F.coalesce(F.max("_peak").over(before), F.lit(start)).alias("_peak"))
    running = F.max("_lead").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = placed.join(peaks, "_bucket").withColumn("hlc", F.col("_at") + F.greatest(running, "_peak", F.lit(start)))
    return out.drop("_bucket", "_before", "_at", "_lead", "_peak")
