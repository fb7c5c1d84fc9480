"""Any table as a log of puts and deletes: key columns, value columns, deleted, hlc."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..schema import CLOCK_BITS


def as_log(rows: DataFrame, keys: list[str], values: list[str], hlc: Column, deleted: Column) -> DataFrame:
    """Declare what is key, value, version and tombstone; nothing else is read from ``rows``."""
    return rows.select(*keys, *values, deleted.alias("deleted"), hlc.alias("hlc"))


def puts(rows: DataFrame, keys: list[str], values: list[str], hlc: Column) -> DataFrame:
    return as_log(rows, keys, values, hlc, F.lit(False))


def deletes(rows: DataFrame, keys: list[str], values: list[str], hlc: Column) -> DataFrame:
    """Tombstones for keys, written or not; they hold no value."""
    empty = rows.select(*keys, *(F.lit(None).cast(dict(rows.dtypes)[v]).alias(v) for v in values), hlc.alias("_h"))
    return empty.select(*keys, *values, F.lit(True).alias("deleted"), F.col("_h").alias("hlc"))


def union(logs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), logs)


def oversized(log: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Records beyond the size limits, which must not be written."""
    return log.where(~checks.fits(F.col(key), F.col(value)))


# Change logs of common tables.


def events_log(events: DataFrame) -> DataFrame:
    """user_id -> value at its latest event; an error deletes."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return as_log(events, ["user_id"], ["value"], F.shiftleft(micros, CLOCK_BITS), F.col("event_type") == "error")


def lineitem_log(lineitem: DataFrame) -> DataFrame:
    """(l_orderkey, l_linenumber) -> price and quantity of its latest shipment; a return deletes."""
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    hlc = F.shiftleft(days, 32) + F.shiftleft(F.col("l_partkey"), 11) + F.col("l_suppkey")
    return as_log(lineitem, ["l_orderkey", "l_linenumber"], ["l_extendedprice", "l_quantity"], hlc, F.col("l_returnflag") == "R")


def conversations_log(conversations: DataFrame) -> DataFrame:
    """conv_id -> text of its last turn; nothing deletes."""
    return as_log(conversations, ["conv_id"], ["text"], F.col("turn"), F.lit(False))
