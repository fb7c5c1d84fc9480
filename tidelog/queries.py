"""The queries over common tables, by name, and for each the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commands, store_queries
from .functions import checks, clock
from .operators import compaction, manifest, oplog, recovery, resolve, segments
from .options import Options


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.events_log(_table(spark, sf, "events"))


def _lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.lineitem_log(_table(spark, sf, "lineitem"))


_EV = "ev AS (SELECT user_id, value, event_type = 'error' AS deleted, epoch_us(ts) * 4096 AS hlc, event_id FROM events)"
_EVN = f"{_EV}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hlc DESC) AS rn FROM ev) WHERE rn = 1)"
_LI = """li AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_returnflag = 'R' AS deleted,
  CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 4294967296 + l_partkey * 2048 + l_suppkey AS hlc FROM lineitem)"""
#: Segments of 500 events each; levels in turn.  A record's bytes: header, key and value of eight.
_SEG = """seg AS (SELECT event_id // 500 AS seg_id, (event_id // 500) % 4 AS level, min(user_id + 1000 * ((event_id // 500) % 7)) AS min_key,
  max(user_id + 1000 * ((event_id // 500) % 7)) AS max_key, count(*) AS n_records, count(*) * 41 AS bytes FROM events GROUP BY 1, 2)"""


def _segment_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "events").withColumn("seg_id", F.floor(F.col("event_id") / 500))
    return rows.withColumn("level", F.col("seg_id") % 4).withColumn("key", F.col("user_id") + 1000 * (F.col("seg_id") % 7))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return segments.describe(_segment_rows(spark, sf), "key", F.lit(41), ["level"])


def q01_snapshot_latest(spark, sf):
    return resolve.snapshot(_events(spark, sf), ["user_id"])


def q01b_snapshot_lineitem(spark, sf):
    return resolve.snapshot(_lineitem(spark, sf), ["l_orderkey", "l_linenumber"])


def q01c_snapshot_conversations(spark, sf):
    return resolve.snapshot(oplog.conversations_log(_table(spark, sf, "conversations")), ["conv_id"])


def q02_point_get(spark, sf):
    return resolve.newest(_events(spark, sf).where("user_id = 7"), ["user_id"]).where("NOT deleted").select("user_id", "value", "hlc")


def _probes(spark, sf):
    return _table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).where("user_id % 3 = 0")


def q03_multi_get_status(spark, sf):
    return resolve.lookup(_events(spark, sf), _probes(spark, sf), ["user_id"], ["value"]).select("user_id", "status", "value")


def q03b_multi_get_lineitem(spark, sf):
    probes = _table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return resolve.lookup(_lineitem(spark, sf), probes, ["l_orderkey", "l_linenumber"], ["l_quantity"]).select("l_orderkey", "status", "l_quantity")


def q03c_multi_get_all_customers(spark, sf):
    """Q03 for every customer."""
    probes = _table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return resolve.lookup(_events(spark, sf), probes, ["user_id"], ["value"]).select("user_id", "status", "value")


def q03d_multi_get_all_orders(spark, sf):
    """Q03b for every order."""
    probes = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return resolve.lookup(_lineitem(spark, sf), probes, ["l_orderkey", "l_linenumber"], ["l_quantity"]).select("l_orderkey", "status", "l_quantity")


def q04_range_scan(spark, sf):
    return resolve.snapshot(_events(spark, sf).where("user_id BETWEEN 20 AND 60"), ["user_id"])


def _runs(spark, sf, n=4):
    log = oplog.as_log(_table(spark, sf, "events"), ["user_id"], ["value", "event_id"], F.shiftleft(F.unix_micros(F.col("ts").cast("timestamp")), 12), F.col("event_type") == "error")
    return [log.where(F.col("event_id") % n == k).drop("event_id") for k in range(n)]


def q05_merge_keep_tombstones(spark, sf):
    return compaction.merge(_runs(spark, sf), ["user_id"], output_level=1)


def q06_merge_bottom_level(spark, sf):
    return compaction.merge(_runs(spark, sf), ["user_id"], output_level=compaction.BOTTOM).drop("deleted")


def _tiered(spark, sf):
    rows = _table(spark, sf, "events")
    span = F.broadcast(rows.agg(F.max("event_id").alias("top")))
    rows = rows.join(span).withColumn("tier", F.floor((F.col("top") - F.col("event_id")) * 4 / (F.col("top") + 1)).cast("int"))
    micros = F.shiftleft(F.unix_micros(F.col("ts").cast("timestamp")), 12)
    return rows.select("user_id", "value", "tier", (F.col("event_type") == "error").alias("deleted"), micros.alias("hlc"))


_TIERED = "tiered AS (SELECT *, CAST(floor((max(event_id) OVER () - event_id) * 4.0 / (max(event_id) OVER () + 1)) AS INT) AS tier FROM ev)"


def q07_locate_tier(spark, sf):
    return resolve.locate(_tiered(spark, sf), ["user_id"])


def q07b_first_hit_by_tier(spark, sf):
    return resolve.first_hit(_tiered(spark, sf), ["user_id"], ["value"]).where("NOT deleted").select("user_id", "value", "hlc")


def q08_segment_min_max(spark, sf):
    return _segments(spark, sf)


def q09_candidate_segments(spark, sf):
    probes = _table(spark, sf, "customer").select((F.col("c_custkey") * 7).alias("key"))
    return segments.candidates(probes, _segments(spark, sf), "key")


def q10_engine_stats(spark, sf):
    return segments.stats(_segments(spark, sf))


def q11_l0_inputs(spark, sf):
    return compaction.level0_inputs(_segments(spark, sf)).select("seg_id", "level")


_OPTIONS = Options.demo()


def q12_level_score_pick(spark, sf):
    return compaction.pick_level(segments.stats(_segments(spark, sf)).withColumn("bytes", F.col("bytes") * 500), _OPTIONS)


def q12b_level_scores(spark, sf):
    return compaction.scores(segments.stats(_segments(spark, sf)).withColumn("bytes", F.col("bytes") * 500), _OPTIONS)


def q13_file_pick_min_ratio(spark, sf):
    return compaction.pick_file(_segments(spark, sf), 1)


def q13b_overlap_ratios(spark, sf):
    return compaction.overlap_ratios(_segments(spark, sf), 1)


def q14_asof_block_lookup(spark, sf):
    rows = _segment_rows(spark, sf).select("seg_id", F.col("event_id").alias("key"))
    index = segments.sparse_index(rows, "key", 37)
    probes = rows.where("key % 11 = 0").select("seg_id", (F.col("key") - 5).alias("key"))
    found = segments.block_of(probes, index, "key")
    return found.select("seg_id", "key", F.coalesce("block_id", F.lit(-1)).alias("block_id"), F.coalesce("first_key", F.lit(-1)).alias("first_key"))


def q14b_asof_block_all_events(spark, sf):
    """Q14 with a probe for every event."""
    rows = _segment_rows(spark, sf).select("seg_id", F.col("event_id").alias("key"))
    probes = rows.select("seg_id", (F.col("key") - 5).alias("key"))
    found = segments.block_of(probes, segments.sparse_index(rows, "key", 37), "key")
    return found.select("seg_id", "key", F.coalesce("block_id", F.lit(-1)).alias("block_id"), F.coalesce("first_key", F.lit(-1)).alias("first_key"))


def q15_segment_overlap_pairs(spark, sf):
    return segments.overlaps(_segments(spark, sf), _segments(spark, sf)).where("a_seg_id < b_seg_id").select(F.col("a_seg_id").alias("a"), F.col("b_seg_id").alias("b"))


def q15b_level_invariant(spark, sf):
    return compaction.disjoint(_segments(spark, sf)).select(F.col("a_seg_id").alias("a"), F.col("b_seg_id").alias("b"), F.col("a_level").alias("level"))


def q16_hlc_encode_decode(spark, sf):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = _table(spark, sf, "events").select("event_id", clock.stamp(micros, F.col("event_id") % 4096).alias("hlc"))
    return rows.select("event_id", "hlc", clock.micros_of(F.col("hlc")).alias("micros"), clock.counter_of(F.col("hlc")).alias("counter"))


def q17_hlc_assign(spark, sf):
    """Clocks that stall and run backwards."""
    rows = _table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") * 7919 % 100003 / 50).alias("now"))
    return clock.assign(rows, "event_id", "now", start=5000, bucket_rows=1 << 12).select("event_id", "hlc")


def _wal(spark, sf):
    rows = _table(spark, sf, "events")
    micros = F.shiftleft(F.unix_micros(F.col("ts").cast("timestamp")), 12)
    return rows.select(F.floor(F.col("event_id") / 200).alias("wal_id"), F.col("event_id").alias("seq"), "user_id", "value", (F.col("event_type") == "error").alias("deleted"), micros.alias("hlc"), (F.col("event_id") % 997 == 700).alias("bad"))


def q18_wal_replay_point_in_time(spark, sf):
    good = recovery.point_in_time(_wal(spark, sf), F.col("bad"))
    return resolve.snapshot(good.select("user_id", "value", "deleted", "hlc"), ["user_id"])


def q19_wal_damage_report(spark, sf):
    return recovery.damage_report(_wal(spark, sf), F.col("bad"))


def q19b_wal_prefix_each(spark, sf):
    return recovery.prefix_by_window(_wal(spark, sf), F.col("bad")).groupBy("wal_id").agg(F.count("*").alias("kept"), F.max("hlc").alias("max_hlc"))


def _edits(spark, sf):
    e = F.col("event_id")
    tag = F.when(e % 13 == 0, manifest.MIN_LIVE_WAL).when(e % 3 == 0, manifest.DELETE).otherwise(manifest.ADD)
    ident = F.when(e % 13 == 0, F.floor(e / 2) - F.when(e % 5 == 0, 40).otherwise(0)).otherwise(e * 31 % 211)
    return _table(spark, sf, "events").select(e.alias("edit_seq"), tag.alias("tag"), (e * 31 % 211 % 5).alias("level"), ident.alias("id"))


_EDITS = """edits AS (SELECT event_id AS edit_seq, CASE WHEN event_id % 13 = 0 THEN 'MIN_LIVE_WAL' WHEN event_id % 3 = 0 THEN 'DELETE' ELSE 'ADD' END AS tag,
  event_id * 31 % 211 % 5 AS level, CASE WHEN event_id % 13 = 0 THEN event_id // 2 - CASE WHEN event_id % 5 = 0 THEN 40 ELSE 0 END ELSE event_id * 31 % 211 END AS id FROM events)"""


def q20_manifest_live_files(spark, sf):
    return manifest.live_files(_edits(spark, sf))


def q20b_directory_against_manifest(spark, sf):
    """A directory that lacks some live files and holds some that aren't live."""
    live = manifest.live_files(_edits(spark, sf)).select("id")
    there = _table(spark, sf, "events").select((F.col("event_id") * 17 % 260).alias("id")).where("id % 7 <> 3").distinct()
    kind = lambda df, what: df.select("id", F.lit(what).alias("state"))
    return kind(manifest.listed_but_missing(live, there), "missing").unionByName(kind(manifest.obsolete(there, live), "obsolete"))


def q21_live_wals(spark, sf):
    wals = _table(spark, sf, "events").select(F.floor(F.col("event_id") / 20).alias("wal_id")).distinct()
    bound = _edits(spark, sf).where("tag <> 'MIN_LIVE_WAL' OR edit_seq < 900").withColumn("id", F.when(F.col("tag") == "MIN_LIVE_WAL", F.floor(F.col("id") / 20)).otherwise(F.col("id")))
    return manifest.live_wals(wals, bound)


def q21b_live_wals_all_edits(spark, sf):
    """Q21 over every edit, not the first ones alone."""
    wals = _table(spark, sf, "events").select(F.floor(F.col("event_id") / 20).alias("wal_id")).distinct()
    edits = _edits(spark, sf).withColumn("id", F.when(F.col("tag") == "MIN_LIVE_WAL", F.floor(F.col("id") / 20)).otherwise(F.col("id")))
    return manifest.live_wals(wals, edits)


def q22_block_layout(spark, sf):
    rows = _segment_rows(spark, sf).withColumn("bytes", F.octet_length("props") + 33)
    out = segments.running_blocks(rows, "event_id", F.col("bytes"))
    return out.groupBy("seg_id", "block_id").agg(F.min("event_id").alias("first_key"), F.count("*").alias("n"), F.sum("bytes").cast("long").alias("bytes"))


def q22b_block_layout_exact(spark, sf):
    rows = _segment_rows(spark, sf)
    out = segments.exact_blocks(rows, "event_id", F.octet_length("props") + 33, 1024)
    return out.groupBy("seg_id", "block_id").agg(F.min("event_id").alias("first_key"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def q23_crc_check(spark, sf):
    rows = _table(spark, sf, "events").select("event_id", F.encode("props", "utf-8").alias("payload"))
    rows = rows.withColumn("crc", F.crc32("payload"))
    stored = F.when(F.col("event_id") % 50 == 0, F.concat("payload", F.lit(b"\x00"))).otherwise(F.col("payload"))
    return rows.select("event_id", "crc", checks.checksum_ok(stored, F.col("crc")).alias("ok"))


def q24_command_log_parse(spark, sf):
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    line = (
        F.when(e % 7 == 0, F.concat(F.lit("  PUT  key"), user, F.lit("  a value of "), user, F.lit(" ")))
        .when(e % 7 == 1, F.concat(F.lit("put key"), user)).when(e % 7 == 2, F.concat(F.lit("Delete key"), user))
        .when(e % 7 == 3, F.concat(F.lit("get key"), user, F.lit(" more"))).when(e % 7 == 4, F.lit("Stats"))
        .when(e % 7 == 5, F.concat(F.lit("scan key"), user)).otherwise(F.lit("quit"))
    )
    parsed = commands.parse(_table(spark, sf, "events").select("event_id", line.alias("line")))
    return parsed.select("event_id", "command", "key", "value", "error")


def q25_streaming_latest(spark, sf):
    from .streaming import ingest

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    target = ingest.run_available(spark, f"{sf}/events.parquet", store_queries.shared_folder(spark, "ingest"))
    return resolve.snapshot(target, ["user_id"])


def q26_manifest_edit_violations(spark, sf):
    return manifest.violations(_edits(spark, sf))


def q27_size_guard(spark, sf):
    rows = _table(spark, sf, "documents").select("doc_id", F.expr("substr(text, 1, doc_id * 97 % 20000)").cast("binary").alias("key"), F.repeat("text", 40).cast("binary").alias("value"))
    return oplog.oversized(rows).select("doc_id", F.octet_length("key").cast("long").alias("key_bytes"), F.octet_length("value").cast("long").alias("value_bytes"))


def q27b_size_guard_whole_texts(spark, sf):
    """Q27 with whole texts as keys."""
    rows = _table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("key"), F.repeat("text", 40).cast("binary").alias("value"))
    return oplog.oversized(rows).select("doc_id", F.octet_length("key").cast("long").alias("key_bytes"), F.octet_length("value").cast("long").alias("value_bytes"))


def q28_published_prefix(spark, sf):
    flushes = _table(spark, sf, "events").select(F.col("event_id").alias("id"), (~((F.col("event_id") % 613 == 612))).alias("finished"))
    return recovery.published_prefix(flushes)


def q29_latency_percentiles(spark, sf):
    out = _table(spark, sf, "events").groupBy("event_type").agg(F.percentile("value", [0.5, 0.99, 0.999]).alias("p"), F.count("*").alias("n"))
    return out.select("event_type", "n", *(F.round(F.col("p")[k], 6).alias(c) for k, c in enumerate(("p50", "p99", "p999"))))


def q30_restart_clock(spark, sf):
    return recovery.restarts(_wal(spark, sf))


def q31_stored_sizes(spark, sf):
    """Live keys and bytes as a table in memory counts them."""
    live = resolve.newest(_events(spark, sf), ["user_id"])
    size = F.lit(25 + 8) + F.when(F.col("deleted"), 0).otherwise(8)
    return live.agg(F.count("*").alias("records"), F.sum(size).cast("long").alias("bytes"), F.sum(F.col("deleted").cast("long")).alias("tombstones"))


_NAMES = [n for n in dir() if n[0] == "q" and n[1:3].isdigit()]
QUERIES = {n: globals()[n] for n in sorted(_NAMES)} | store_queries.QUERIES

ORACLE_SQL = {
    "q01_snapshot_latest": f"WITH {_EVN} SELECT user_id, value, hlc FROM newest WHERE NOT deleted",
    "q01b_snapshot_lineitem": f"""WITH {_LI} SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, hlc FROM
      (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY hlc DESC) AS rn FROM li) WHERE rn = 1 AND NOT deleted""",
    "q01c_snapshot_conversations": "SELECT conv_id, text, turn AS hlc FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1",
    "q02_point_get": f"WITH {_EVN} SELECT user_id, value, hlc FROM newest WHERE NOT deleted AND user_id = 7",
    "q03_multi_get_status": f"""WITH {_EVN} SELECT c_custkey AS user_id,
      CASE WHEN n.user_id IS NULL THEN 'ABSENT' WHEN deleted THEN 'DELETED' ELSE 'FOUND' END AS status, CASE WHEN NOT deleted THEN value END AS value
      FROM customer LEFT JOIN newest n ON n.user_id = c_custkey WHERE c_custkey % 3 = 0""",
    "q03b_multi_get_lineitem": f"""WITH {_LI}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY hlc DESC) AS rn FROM li WHERE l_linenumber = 1) WHERE rn = 1)
      SELECT o_orderkey AS l_orderkey, CASE WHEN n.l_orderkey IS NULL THEN 'ABSENT' WHEN deleted THEN 'DELETED' ELSE 'FOUND' END AS status, CASE WHEN NOT deleted THEN l_quantity END AS l_quantity
      FROM orders LEFT JOIN n ON n.l_orderkey = o_orderkey WHERE o_orderkey % 5 = 0""",
    "q03c_multi_get_all_customers": f"""WITH {_EVN} SELECT c_custkey AS user_id,
      CASE WHEN n.user_id IS NULL THEN 'ABSENT' WHEN deleted THEN 'DELETED' ELSE 'FOUND' END AS status, CASE WHEN NOT deleted THEN value END AS value
      FROM customer LEFT JOIN newest n ON n.user_id = c_custkey""",
    "q03d_multi_get_all_orders": f"""WITH {_LI}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY hlc DESC) AS rn FROM li WHERE l_linenumber = 1) WHERE rn = 1)
      SELECT o_orderkey AS l_orderkey, CASE WHEN n.l_orderkey IS NULL THEN 'ABSENT' WHEN deleted THEN 'DELETED' ELSE 'FOUND' END AS status, CASE WHEN NOT deleted THEN l_quantity END AS l_quantity
      FROM orders LEFT JOIN n ON n.l_orderkey = o_orderkey""",
    "q04_range_scan": f"WITH {_EVN} SELECT user_id, value, hlc FROM newest WHERE NOT deleted AND user_id BETWEEN 20 AND 60",
    "q05_merge_keep_tombstones": f"WITH {_EVN} SELECT user_id, value, deleted, hlc FROM newest",
    "q06_merge_bottom_level": f"WITH {_EVN} SELECT user_id, value, hlc FROM newest WHERE NOT deleted",
    "q07_locate_tier": f"WITH {_EV}, {_TIERED} SELECT user_id, arg_max(tier, hlc) AS tier FROM tiered GROUP BY user_id",
    "q07b_first_hit_by_tier": f"""WITH {_EV}, {_TIERED} SELECT user_id, value, hlc FROM
      (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, hlc DESC) AS rn FROM tiered) WHERE rn = 1 AND NOT deleted""",
    "q08_segment_min_max": f"WITH {_SEG} SELECT * FROM seg",
    "q09_candidate_segments": f"WITH {_SEG} SELECT c_custkey * 7 AS key, seg_id FROM customer JOIN seg ON c_custkey * 7 BETWEEN min_key AND max_key",
    "q10_engine_stats": f"WITH {_SEG} SELECT level, count(*) AS files, CAST(sum(n_records) AS BIGINT) AS n_records, CAST(sum(bytes) AS BIGINT) AS bytes FROM seg GROUP BY level",
    "q11_l0_inputs": f"""WITH {_SEG} SELECT seg_id, level FROM seg WHERE level = 0 OR level = 1
      AND min_key <= (SELECT max(max_key) FROM seg WHERE level = 0) AND max_key >= (SELECT min(min_key) FROM seg WHERE level = 0)""",
    "q12_level_score_pick": f"""WITH {_SEG}, s AS (SELECT level, CASE level WHEN 0 THEN count(*) / 4.0::DOUBLE WHEN 1 THEN sum(bytes) * 500 / 524288.0::DOUBLE ELSE sum(bytes) * 500 / 2097152.0::DOUBLE END AS score
      FROM seg WHERE level < 3 GROUP BY level) SELECT level, score FROM s WHERE score >= 1 ORDER BY score DESC, level LIMIT 1""",
    "q12b_level_scores": f"""WITH {_SEG} SELECT level, CASE level WHEN 0 THEN count(*) / 4.0::DOUBLE WHEN 1 THEN sum(bytes) * 500 / 524288.0::DOUBLE ELSE sum(bytes) * 500 / 2097152.0::DOUBLE END AS score
      FROM seg WHERE level < 3 GROUP BY level""",
    "q13b_overlap_ratios": f"""WITH {_SEG} SELECT a.seg_id, any_value(a.bytes) AS bytes, count(b.seg_id) AS met_files, CAST(coalesce(sum(b.bytes), 0) AS BIGINT) AS met_bytes,
      coalesce(sum(b.bytes), 0)::DOUBLE / any_value(a.bytes) AS ratio
      FROM seg a LEFT JOIN seg b ON b.level = 2 AND a.min_key <= b.max_key AND b.min_key <= a.max_key WHERE a.level = 1 GROUP BY a.seg_id""",
    "q14_asof_block_lookup": """WITH rows AS (SELECT event_id // 500 AS seg_id, event_id AS key FROM events),
      blocks AS (SELECT seg_id, CAST((row_number() OVER (PARTITION BY seg_id ORDER BY key) - 1) // 37 AS INT) AS block_id, key FROM rows),
      idx AS (SELECT seg_id, block_id, min(key) AS first_key FROM blocks GROUP BY 1, 2),
      probes AS (SELECT seg_id, key - 5 AS key FROM rows WHERE key % 11 = 0)
      SELECT p.seg_id, p.key, coalesce(i.block_id, -1) AS block_id, coalesce(i.first_key, -1) AS first_key FROM probes p ASOF LEFT JOIN idx i ON p.seg_id = i.seg_id AND p.key >= i.first_key""",
    "q14b_asof_block_all_events": """WITH rows AS (SELECT event_id // 500 AS seg_id, event_id AS key FROM events),
      blocks AS (SELECT seg_id, CAST((row_number() OVER (PARTITION BY seg_id ORDER BY key) - 1) // 37 AS INT) AS block_id, key FROM rows),
      idx AS (SELECT seg_id, block_id, min(key) AS first_key FROM blocks GROUP BY 1, 2),
      probes AS (SELECT seg_id, key - 5 AS key FROM rows)
      SELECT p.seg_id, p.key, coalesce(i.block_id, -1) AS block_id, coalesce(i.first_key, -1) AS first_key FROM probes p ASOF LEFT JOIN idx i ON p.seg_id = i.seg_id AND p.key >= i.first_key""",
    "q15_segment_overlap_pairs": f"WITH {_SEG} SELECT a.seg_id AS a, b.seg_id AS b FROM seg a JOIN seg b ON a.seg_id < b.seg_id AND a.min_key <= b.max_key AND b.min_key <= a.max_key",
    "q15b_level_invariant": f"""WITH {_SEG} SELECT a.seg_id AS a, b.seg_id AS b, a.level FROM seg a JOIN seg b
      ON a.seg_id < b.seg_id AND a.level = b.level AND a.level >= 1 AND a.min_key <= b.max_key AND b.min_key <= a.max_key""",
    "q16_hlc_encode_decode": "SELECT event_id, hlc, hlc >> 12 AS micros, hlc & 4095 AS counter FROM (SELECT event_id, (epoch_us(ts) << 12) | (event_id % 4096) AS hlc FROM events)",
    "q17_hlc_assign": """WITH r AS (SELECT event_id, CAST(floor(event_id * 7919 % 100003 / 50.0) AS BIGINT) AS now, row_number() OVER (ORDER BY event_id) AS n FROM events)
      SELECT event_id, n + greatest(5000, max((now << 12) - n) OVER (ORDER BY n)) AS hlc FROM r""",
    "q18_wal_replay_point_in_time": f"""WITH {_EV}, good AS (SELECT * FROM (SELECT *, sum(CASE WHEN event_id % 997 = 700 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS bad FROM ev) WHERE bad = 0)
      SELECT user_id, value, hlc FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hlc DESC) AS rn FROM good) WHERE rn = 1 AND NOT deleted""",
    "q19_wal_damage_report": "SELECT event_id // 200 AS wal_id, count(*) AS records, count(*) FILTER (WHERE event_id % 997 = 700) AS bad FROM events GROUP BY 1",
    "q19b_wal_prefix_each": """SELECT wal_id, count(*) AS kept, max(hlc) AS max_hlc FROM (SELECT event_id // 200 AS wal_id, epoch_us(ts) * 4096 AS hlc,
      sum(CASE WHEN event_id % 997 = 700 THEN 1 ELSE 0 END) OVER (PARTITION BY event_id // 200 ORDER BY event_id) AS bad FROM events) WHERE bad = 0 GROUP BY wal_id""",
    "q20_manifest_live_files": f"WITH {_EDITS} SELECT level, id FROM edits WHERE tag <> 'MIN_LIVE_WAL' GROUP BY level, id HAVING arg_max(tag, edit_seq) = 'ADD'",
    "q20b_directory_against_manifest": f"""WITH {_EDITS}, live AS (SELECT id FROM edits WHERE tag <> 'MIN_LIVE_WAL' GROUP BY level, id HAVING arg_max(tag, edit_seq) = 'ADD'),
      dir AS (SELECT DISTINCT event_id * 17 % 260 AS id FROM events WHERE event_id * 17 % 260 % 7 <> 3)
      SELECT id, 'missing' AS state FROM live WHERE id NOT IN (SELECT id FROM dir) UNION ALL SELECT id, 'obsolete' FROM dir WHERE id NOT IN (SELECT id FROM live)""",
    "q21_live_wals": f"""WITH {_EDITS} SELECT DISTINCT event_id // 20 AS wal_id FROM events
      WHERE event_id // 20 >= (SELECT coalesce(max(id // 20), 0) FROM edits WHERE tag = 'MIN_LIVE_WAL' AND edit_seq < 900)""",
    "q21b_live_wals_all_edits": f"""WITH {_EDITS} SELECT DISTINCT event_id // 20 AS wal_id FROM events
      WHERE event_id // 20 >= (SELECT coalesce(max(id // 20), 0) FROM edits WHERE tag = 'MIN_LIVE_WAL')""",
    "q22_block_layout": """WITH r AS (SELECT event_id // 500 AS seg_id, event_id, strlen(props) + 33 AS bytes FROM events),
      b AS (SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY seg_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 8192 AS INT) AS block_id FROM r)
      SELECT seg_id, block_id, min(event_id) AS first_key, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM b GROUP BY 1, 2""",
    "q22b_block_layout_exact": """WITH RECURSIVE r AS (SELECT event_id // 500 AS seg_id, event_id, strlen(props) + 33 AS bytes, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS n FROM events),
      w AS (SELECT seg_id, event_id, bytes, n, 0 AS block_id, bytes AS held FROM r WHERE n = 1
        UNION ALL SELECT r.seg_id, r.event_id, r.bytes, r.n, CASE WHEN w.held > 1024 THEN w.block_id + 1 ELSE w.block_id END, CASE WHEN w.held > 1024 THEN r.bytes ELSE w.held + r.bytes END
        FROM w JOIN r ON r.seg_id = w.seg_id AND r.n = w.n + 1)
      SELECT seg_id, block_id, min(event_id) AS first_key, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM w GROUP BY 1, 2""",
    "q23_crc_check": """SELECT event_id, crc, event_id % 50 <> 0 AS ok FROM (SELECT event_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(props, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc FROM events)""",
    "q24_command_log_parse": """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'put' WHEN 1 THEN 'put' WHEN 2 THEN 'del' WHEN 3 THEN 'get' WHEN 4 THEN 'stats' WHEN 5 THEN 'scan' ELSE 'exit' END AS command,
      CASE WHEN event_id % 7 IN (0, 2) THEN 'key' || user_id END AS key, CASE WHEN event_id % 7 = 0 THEN 'a value of ' || user_id END AS value,
      CASE event_id % 7 WHEN 1 THEN 'bad_put' WHEN 3 THEN 'bad_key' WHEN 5 THEN 'unknown' END AS error FROM events""",
    "q25_streaming_latest": f"WITH {_EVN} SELECT user_id, value, hlc FROM newest WHERE NOT deleted",
    "q26_manifest_edit_violations": f"""WITH {_EDITS}, f AS (SELECT *, lag(tag) OVER (PARTITION BY id ORDER BY edit_seq) AS pt, lag(level) OVER (PARTITION BY id ORDER BY edit_seq) AS pl FROM edits WHERE tag <> 'MIN_LIVE_WAL'),
      w AS (SELECT edit_seq, id, max(id) OVER (ORDER BY edit_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM edits WHERE tag = 'MIN_LIVE_WAL')
      SELECT * FROM (SELECT edit_seq, CASE WHEN level NOT BETWEEN 0 AND 3 THEN 'bad_level' WHEN tag = 'ADD' AND coalesce(pt, '') = 'ADD' THEN 'duplicate_add'
        WHEN tag = 'DELETE' AND NOT (coalesce(pt, '') = 'ADD' AND pl = level) THEN 'missing_delete' END AS reason FROM f) WHERE reason IS NOT NULL
      UNION ALL SELECT edit_seq, 'wal_regress' FROM w WHERE id < top""",
    "q27_size_guard": """SELECT * FROM (SELECT doc_id, strlen(substr(text, 1, CAST(doc_id * 97 % 20000 AS INT))) AS key_bytes, strlen(text) * 40 AS value_bytes FROM documents)
      WHERE key_bytes > 16384 OR value_bytes > 131072""",
    "q27b_size_guard_whole_texts": """SELECT doc_id, strlen(text) AS key_bytes, strlen(text) * 40 AS value_bytes FROM documents
      WHERE strlen(text) > 16384 OR strlen(text) * 40 > 131072""",
    "q28_published_prefix": "SELECT event_id AS id FROM events WHERE event_id < coalesce((SELECT min(event_id) FROM events WHERE event_id % 613 = 612), 9223372036854775807)",
    "q29_latency_percentiles": """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.999), 6) AS p999
      FROM events GROUP BY event_type""",
    "q30_restart_clock": "SELECT event_id // 200 AS wal_id, max(epoch_us(ts) * 4096) AS max_hlc FROM events GROUP BY 1",
    "q31_stored_sizes": f"WITH {_EVN} SELECT count(*) AS records, CAST(sum(33 + CASE WHEN deleted THEN 0 ELSE 8 END) AS BIGINT) AS bytes, count(*) FILTER (WHERE deleted) AS tombstones FROM newest",
}
ORACLE_SQL["q13_file_pick_min_ratio"] = ORACLE_SQL["q13b_overlap_ratios"] + " ORDER BY ratio, seg_id DESC LIMIT 1"
ORACLE_SQL |= store_queries.ORACLE_SQL
