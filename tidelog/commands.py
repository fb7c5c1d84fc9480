"""A log of text commands: ``put <key> <value...>``, ``get``, ``del``/``delete``, ``stats``, ``exit``/``quit``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLANK = r"^\s+|\s+$"


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with command, key, value and error.

    The command's case doesn't matter; a value is the rest of its line.  A key holds no white
    space and isn't empty.  error is ``bad_put``, ``bad_key``, ``unknown`` or null.
    """
    text = F.regexp_replace(F.col(line), _BLANK, "")
    word = F.lower(F.regexp_extract(text, r"^(\S*)", 1))
    rest = F.regexp_extract(text, r"^\S*\s*(.*)$", 1)
    command = F.when(word == "delete", "del").when(word == "quit", "exit").otherwise(word)
    out = lines.withColumn("_rest", rest).withColumn("command", command)
    is_put, keyed = F.col("command") == "put", F.col("command").isin("get", "del")
    error = (
        F.when(is_put & ~F.col("_rest").rlike(r"^\S+\s"), "bad_put")
        .when(keyed & ~F.col("_rest").rlike(r"^\S+$"), "bad_key")
        .when(~F.col("command").isin("put", "get", "del", "stats", "exit"), "unknown")
    )
    out = out.withColumn("error", error)
    ok = F.col("error").isNull()
    key = F.when(ok & (is_put | keyed), F.regexp_extract("_rest", r"^(\S+)", 1))
    value = F.when(ok & is_put, F.regexp_extract("_rest", r"^\S+\s+(.*)$", 1))
    return out.withColumn("key", key).withColumn("value", value).drop("_rest")


def to_log(parsed: DataFrame, hlc: str) -> DataFrame:
    """The op log of parsed commands: key, value, deleted, hlc."""
    writes = parsed.where("error IS NULL AND command IN ('put', 'del')")
    return writes.select(F.encode("key", "utf-8").alias("key"), F.encode("value", "utf-8").alias("value"), (F.col("command") == "del").alias("deleted"), F.col(hlc).alias("hlc"))
