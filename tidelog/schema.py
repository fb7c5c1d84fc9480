"""Schemas and limits that all parts share."""

from pyspark.sql import types as T

# Limits of the data model.
MAX_KEY_BYTES = 16 * 1024
MAX_VALUE_BYTES = 128 * 1024
BLOCK_BYTES = 8 * 1024
RECORD_HEADER_BYTES = 25
LEVELS = 4
CLOCK_BITS = 12

OP_LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType()),
        T.StructField("deleted", T.BooleanType(), False),
        T.StructField("hlc", T.LongType(), False),
    ]
)
SEGMENTS = "seg_id long, level tinyint, file_size long, n_records long, min_key binary, max_key binary"
SPARSE_INDEX = "seg_id long, block_id int, first_key binary, offset long, len long"
MANIFEST = "edit_seq long, tag string, level tinyint, id long"
WAL_ROWS = "wal_id long, seq long, tag tinyint, hlc long, key binary, value binary, crc long, crc_ok boolean, reason string, offset long"
