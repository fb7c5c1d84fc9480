"""Extendible hashing: shards are the leaves of a directory over the bits of a hash of the key.

A bucket that is larger than the byte limit splits on the next bit; no other bucket does.  So a
row's shard is the shortest prefix of its hash whose rows fit the limit.  Sizes are summed
once for cells some bits finer than the mean shard, and the directory is made from these sums;
only cells that are too large themselves are looked at again, on further bits.  Rows that
share all bits (a key with very many rows) split on the bits of a second, salted hash.

Everything is DataFrame operations; the driver sees only single numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

#: Bits of the hash: fifteen hexadecimal digits of an MD5.
BITS = 60
#: Bits by which cells are finer than the mean shard, and bits that a further round adds.
FINER, FURTHER = 5, 20
SHARD_BYTES = 16 << 20


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key's text (null: of the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _directory(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For each (root, cell of ``high`` bits) the depth at which its bucket fits, high + 1 if it doesn't,
    and the bucket's bytes.  Buckets of fewer than ``low`` bits are known not to fit."""
    cells = materialise(rows.groupBy("root", F.shiftright("h", BITS - high).alias("cell")).agg(F.sum("bytes").alias("bytes")), "cells")

    def ancestors(base: int) -> DataFrame:
        every = cells.select("root", "cell", "bytes", F.explode(F.sequence(F.lit(base), F.lit(high))).alias("d"))
        return every.withColumn("p", F.expr(f"shiftright(cell, {high} - d)"))

    large = materialise(ancestors(low).groupBy("root", "d", "p").agg(F.sum("bytes").alias("b")).where(F.col("b") > limit), "large")
    # Depths at which every possible bucket is too large needn't be joined.
    whole = {r["d"] for r in large.groupBy("d").agg(F.count("*").alias("n")).where("n = shiftleft(1L, d)").collect()} if low == 0 else set()
    base = next((d for d in range(low, high + 1) if d not in whole), high + 1)
    if base > high:
        depth = cells.select("root", "cell", "bytes", F.lit(high + 1).alias("depth"))
    else:
        hit = ancestors(base).join(large.select("root", "d", "p", F.lit(1).alias("split")), ["root", "d", "p"], "left")
        depth = hit.groupBy("root", "cell").agg(F.first("bytes").alias("bytes"), (F.coalesce(F.max(F.when(F.col("split") == 1, F.col("d"))), F.lit(base - 1)) + 1).cast("int").alias("depth"))
    depth = materialise(depth.withColumn("prefix", F.expr(f"shiftright(cell, {high} - least(depth, {high}))")), "depths")
    sizes = depth.groupBy("root", "depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"))
    return depth.drop("bytes").join(sizes, ["root", "depth", "prefix"])


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES, carry: list[str] | None = None) -> DataFrame:
    """A row for each row of ``docs``: the columns of ``carry`` (the key), bytes, and its shard:
    depth and prefix (its leading bits of the key's hash), overflow and shard_bytes.

    bytes are those of the text in UTF-8 (null: 0).  overflow is empty but for rows whose whole
    hash is shared by more than ``limit`` bytes: there it names the bucket of a second hash, of the key
    and a number of the row.  A single row above the limit is a shard of its own.  Rows with a null key are
    hashed as the empty text.  An empty table has no shards.
    """
    carry = carry if carry is not None else [key]
    rows = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), hash_bits(F.col(key)).alias("h"))
    rows = materialise(rows.withColumn("root", F.lit("")), "sized")
    total = rows.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    high = min(BITS, max(0, math.ceil(math.log2(max(total / limit, 1)))) + FINER)
    low, salted, done = 0, False, []
    kept = [f"_c{i}" for i in range(len(carry))]
    while True:
        cell = F.shiftright("h", BITS - high).alias("cell")
        known = materialise(_directory(rows, low, high, limit), "directory")
        joined = rows.withColumn("cell", cell).join(known, ["root", "cell"])
        last = salted and high == BITS
        fits = joined if last else joined.where(F.col("depth") <= high)
        if salted:
            first = F.split("root", ":")
            out = fits.select(*kept, "bytes", first[0].cast("int").alias("depth"), first[1].cast("long").alias("prefix"), F.concat_ws(":", F.least("depth", F.lit(BITS)), "prefix").alias("overflow"), "shard_bytes")
        else:
            out = fits.select(*kept, "bytes", F.col("depth").cast("int"), "prefix", F.lit("").alias("overflow"), "shard_bytes")
        done.append(out)
        if last or not known.where(F.col("depth") > high).limit(1).count():
            break
        rest = joined.where(F.col("depth") > high).select(*kept, "bytes", "h", "root")
        low = high + 1
        if high < BITS:
            rows, high = materialise(rest, "further"), min(BITS, high + FURTHER)
        else:
            # Rows of one key: numbered once, in a table, so that the salt stays the same ever after.
            rest = materialise(rest.withColumn("nth", F.monotonically_increasing_id()), "numbered")
            salt = F.concat_ws("/", "h", "nth")
            rows = materialise(rest.select(*kept, "bytes", hash_bits(salt).alias("h"), F.concat(F.lit(f"{BITS}:"), F.col("h")).alias("root")), "salted")
            largest = rows.groupBy("root").agg(F.sum("bytes").alias("n")).agg(F.max("n").alias("n")).first()["n"]
            low, high, salted = 0, min(BITS, math.ceil(math.log2(largest / limit)) + FINER), True
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.withColumnsRenamed({f"_c{i}": c for i, c in enumerate(carry)})


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """Write ``docs`` as Parquet, a folder for each shard, and return the shards: depth, prefix, overflow, shard_bytes, rows."""
    placed = materialise(assign_shards(docs, key, text, limit, docs.columns), "placed")
    name = F.concat_ws("-", F.col("depth"), F.col("prefix"), F.col("overflow"))
    placed.select(*docs.columns, name.alias("shard")).repartition("shard").write.partitionBy("shard").parquet(path)
    return placed.groupBy("depth", "prefix", "overflow", "shard_bytes").agg(F.count("*").alias("rows"))


def oracle_sql(limit: int = SHARD_BYTES) -> str:
    return f"""
WITH hashed AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
buckets AS (
  SELECT d.d, h >> (60 - d.d) AS p, sum(bytes) AS b
  FROM hashed, (SELECT unnest(range(0, 61)) AS d) d GROUP BY 1, 2),
leaves AS (
  SELECT h, min(d) AS depth FROM (SELECT DISTINCT h FROM hashed) k, buckets
  WHERE p = h >> (60 - d) AND b <= {limit} GROUP BY h)
SELECT doc_id, bytes, CAST(depth AS INT) AS depth, p AS prefix, '' AS overflow, CAST(b AS BIGINT) AS shard_bytes
FROM hashed JOIN leaves USING (h) JOIN buckets ON d = depth AND p = h >> (60 - d)
"""
