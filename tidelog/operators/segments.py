"""Segments: sorted runs of records with key bounds, sparse indexes and block layouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BLOCK_BYTES


def describe(rows: DataFrame, key: str, size: Column, by: list[str] | None = None) -> DataFrame:
    """seg_id (and ``by``), key bounds, number of records and bytes of each segment."""
    return rows.groupBy("seg_id", *(by or [])).agg(
        F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("n_records"), F.sum(size).alias("bytes")
    )


def stats(segments: DataFrame) -> DataFrame:
    """Files, records and bytes of each level."""
    return segments.groupBy("level").agg(F.count("*").alias("files"), F.sum("n_records").alias("n_records"), F.sum("bytes").alias("bytes"))


def candidates(probes: DataFrame, segments: DataFrame, key: str, slices: int = 64) -> DataFrame:
    """Segments whose bounds contain each probe's key (a whole number).

    Keys and bounds meet on slices of the key space, so this is an equi-join, not a nested loop:
    the space is cut where the segments are, and a segment is listed with each slice it reaches into.
    """
    span = segments.agg(F.min("min_key").alias("low"), F.max("max_key").alias("high"), F.count("*").alias("n")).first()
    if not span["n"]:
        return probes.select(key).join(segments.select("seg_id"), F.lit(False))
    width = max(1, -(-(span["high"] - span["low"] + 1) // max(slices, span["n"])))
    at = lambda c: F.expr(f"CAST(floor((CAST(`{c}` AS DECIMAL(20)) - {span['low']}) / {width}) AS BIGINT)")  # noqa: E731  below zero too, without rounding
    reach = segments.withColumn("_slice", F.explode(F.sequence(at("min_key"), at("max_key"))))
    met = probes.withColumn("_slice", at(key)).join(reach, "_slice")
    return met.where(F.col(key).between(F.col("min_key"), F.col("max_key"))).select(key, "seg_id")


def sparse_index(rows: DataFrame, key: str, block_rows: int) -> DataFrame:
    """seg_id, block_id and first key of blocks of ``block_rows`` records in key order."""
    nth = F.row_number().over(Window.partitionBy("seg_id").orderBy(key)) - 1
    blocks = rows.withColumn("block_id", F.floor(nth / F.lit(block_rows)).cast("int"))
    return blocks.groupBy("seg_id", "block_id").agg(F.min(key).alias("first_key"))


def block_of(probes: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """The block of each (seg_id, key): that of the greatest first key that isn't greater (none before the first).

    An as-of lookup in one shuffle: probes and index entries of a segment are ordered together, and
    each probe takes the last entry before it.
    """
    entries = index.select("seg_id", F.col("first_key").alias("_k"), "block_id", "first_key", F.lit(0).alias("_probe"))
    asked = probes.select("seg_id", F.col(key).alias("_k"), F.lit(None).cast("int").alias("block_id"), F.lit(None).cast(dict(index.dtypes)["first_key"]).alias("first_key"), F.lit(1).alias("_probe"))
    before = Window.partitionBy("seg_id").orderBy("_k", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(before).alias(c)
    both = entries.unionByName(asked).select("seg_id", F.col("_k").alias(key), "_probe", last("block_id"), last("first_key"))
    return both.where("_probe = 1").drop("_probe")


#: Rows of the right side at a node of the key space beyond which they are dealt to several tasks.
CROWD = 1024
_NODE = ["_side", "_level", "_place"]


def _at_nodes(rows: DataFrame, low: int, levels: int, left: bool) -> DataFrame:
    """Each row once for every node (_side, _level, _place) at which it meets rows of the other side.

    Closed intervals have common keys if the right one begins in the left one (side 0), or the left one
    in the right one behind its first key (side 1): never both.  A node of level k spans 2**k keys.  A
    begin is listed with the nodes above it, an interval with nodes that make it up and share no key, at
    most two of a level.  So a pair meets at one node, and rows that meet are a pair.
    """
    # Places are unsigned numbers of 64 bits from the lowest key on.
    place = lambda c: f"CAST(CAST({c} AS DECIMAL(20)) - ({low + (1 << 63)}) AS BIGINT) ^ shiftleft(1L, 63)"
    first = "min_key" if left else "CASE WHEN min_key < max_key THEN CAST(min_key AS DECIMAL(20)) + 1 END"
    rows = rows.where("min_key <= max_key").withColumns({"_begin": F.expr(place("min_key")), "_from": F.expr(place(first)), "_to": F.expr(place("max_key"))})
    node = lambda side, level, at: f"named_struct('_side', {side}, '_level', {level}, '_place', {at})"
    above = f"transform(sequence(0, {levels}), k -> {node(int(left), 'k', 'shiftrightunsigned(_begin, k)')})"
    # The two ends, and below the node where their ways part the neighbours on the inner side of each way.
    inner = lambda c, bit: f"""transform(filter(sequence(0, {levels}), k -> shiftrightunsigned(_from ^ _to, k) NOT IN (0, 1) AND shiftrightunsigned({c}, k) & 1 = {bit}),
      k -> {node(int(not left), 'k', f'shiftrightunsigned({c}, k) ^ 1')})"""  # noqa: E731
    ends = f"transform(array_distinct(array(_from, _to)), c -> {node(int(not left), 0, 'c')})"
    within = f"CASE WHEN _from IS NULL THEN array() ELSE concat({ends}, {inner('_from', 0)}, {inner('_to', 1)}) END"
    return rows.select("*", F.expr(f"inline(concat({above}, {within}))")).drop("_begin", "_from", "_to")


def _meeting(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Both at their nodes; None if no row has bounds."""
    both = left.select("min_key", "max_key").union(right.select("min_key", "max_key")).where("min_key <= max_key")
    span = both.agg(F.min("min_key").alias("low"), F.expr("max(CAST(max_key AS DECIMAL(20)) - min_key)").alias("reach")).first()
    if span["low"] is None:
        return None
    # No interval holds a node of a higher level.
    levels = min((int(span["reach"]) + 1).bit_length() - 1, 62)
    return _at_nodes(left, int(span["low"]), levels, True), _at_nodes(right, int(span["low"]), levels, False)


def overlaps(left: DataFrame, right: DataFrame, slices: int = 64) -> DataFrame:
    """Pairs (a, b) of segments with common keys: closed intervals, an equi-join on nodes of the key space.

    Every row of the join is a pair, and each pair comes once.  The right side's rows at a crowded node
    are dealt to several tasks, ``slices`` at most."""
    own = lambda df, side: [F.col(c).alias(f"{side}_{c}") for c in df.columns]
    if (met := _meeting(left, right)) is None:
        return left.select(own(left, "a")).join(right.select(own(right, "b")), F.lit(False))
    a, b = met[0].select(*own(left, "a"), *_NODE), met[1].select(*own(right, "b"), *_NODE)
    crowds = b.groupBy(_NODE).agg(F.least(F.lit(slices), F.floor(F.count("*") / CROWD) + 1).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    a = a.join(crowds, _NODE, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    b = b.join(crowds, _NODE, "left").withColumn("_part", F.pmod(F.xxhash64(*(f"b_{c}" for c in right.columns)), parts).cast("int")).drop("_parts")
    return a.join(b.hint("merge"), [*_NODE, "_part"]).drop(*_NODE, "_part")


def overlap_sums(left: DataFrame, right: DataFrame) -> DataFrame:
    """a_seg_id, met_files and met_bytes: how many segments of the right side each of the left meets, and their bytes.

    The right side is added up at each node before the join, so no pairs are made; left segments that meet none are missing."""
    if (met := _meeting(left, right)) is None:
        return left.select(F.col("seg_id").alias("a_seg_id"), F.lit(0).cast("long").alias("met_files"), F.lit(0).cast("long").alias("met_bytes")).where(F.lit(False))
    sums = met[1].groupBy(_NODE).agg(F.count("*").alias("met_files"), F.sum("bytes").alias("met_bytes"))
    found = met[0].select(F.col("seg_id").alias("a_seg_id"), *_NODE).join(sums.hint("merge"), _NODE)
    return found.groupBy("a_seg_id").agg(F.sum("met_files").alias("met_files"), F.sum("met_bytes").alias("met_bytes"))


def running_blocks(rows: DataFrame, order: str, size: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks by the running sum of bytes within a segment: an approximation in one window."""
    before = Window.partitionBy("seg_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum(size).over(before), F.lit(0))
    return rows.withColumn("block_id", F.floor(running / F.lit(block_bytes)).cast("int"))


def exact_blocks(rows: DataFrame, order: str, size: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks as a writer makes them: one is closed once it holds more than ``block_bytes``.

    The sum begins anew with each block, which no window expresses.  A segment's size is bounded, so a
    segment is one group.
    """
    schema = rows.select("seg_id", order, size.cast("long").alias("bytes"), F.lit(0).alias("block_id"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        block, held, out = 0, 0, []
        for n in frame["bytes"]:
            if held > block_bytes:
                block, held = block + 1, 0
            held += n
            out.append(block)
        return frame.assign(block_id=pd.array(out, "int32"))

    return schema.groupBy("seg_id").applyInPandas(pack, schema.schema)


def split_runs(rows: DataFrame, order: str, size: Column, limit: int) -> DataFrame:
    """A column file_id for one sorted run cut at about ``limit`` bytes: ranges of keys, sized by a sample."""
    total = rows.agg(F.sum(size).alias("n")).first()["n"] or 0
    files = max(1, -(-total // limit))
    return rows.repartitionByRange(files, order).sortWithinPartitions(order).withColumn("file_id", F.spark_partition_id())


def iterate_sorted(rows: DataFrame, order: str) -> Iterator:
    """Rows in key order, a partition at a time."""
    return rows.orderBy(order).toLocalIterator()
