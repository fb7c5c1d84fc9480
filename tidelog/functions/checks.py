"""Checksums and size limits of records, and Bloom filter positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_KEY_BYTES, MAX_VALUE_BYTES, RECORD_HEADER_BYTES

# Bits for each key, and probes.
BITS_PER_KEY, PROBES = 10, 7


def checksum_ok(payload: Column, crc: Column) -> Column:
    """Whether bytes have the CRC-32 that was stored with them."""
    return F.crc32(payload) == crc


def fits(key: Column, value: Column) -> Column:
    """Whether a record's key and value are within their limits (a null value is a deletion)."""
    return (F.octet_length(key) <= MAX_KEY_BYTES) & (F.coalesce(F.octet_length(value), F.lit(0)) <= MAX_VALUE_BYTES)


def record_bytes(key: Column, value: Column) -> Column:
    return F.lit(RECORD_HEADER_BYTES) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))


def bloom_positions(key: Column, bits: Column) -> Column:
    """The bits of a key, by double hashing with two seeds."""
    # 40 bits of each hash, so that sums stay within 64.
    one, two = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) for seed in (1, 2))
    return F.array(*(F.pmod(one + F.lit(i) * two, bits) for i in range(PROBES)))
