"""Removal of lines that many documents share, found through two Bloom filters.

One filter holds the hashes of lines seen once, the other of lines seen twice.  Both are divided
into chunks by hash, and each chunk has one owner that receives every task's distinct hashes of it:
there they go into the first filter, into the second if the first knows them, and are at last
tested with the second.  So no filter is larger than a chunk, whatever the input, and none is sent
around.  Only lines that the second filter knows are suspected repeats; these alone are shuffled
further, known by 128 bits, and counted exactly.  Then every repeat keeps its line in the document
of the largest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, join_counted, materialise, with_fields
from .text import mix

_BLANK = b" \t\n\r\x0b\x0c"
#: Bits for each line, hashes of a line, and bits of a chunk of a filter.
BITS_PER_LINE, PROBES, CHUNK = 12, 4, 1 << 18
#: Lines after which a task hands on what it has.
TASK_LINES = 500_000
#: Repeats that are broadcast (24 bytes each); more are joined to their documents.
BROADCAST_KEYS = 500_000
_LEAST = -(1 << 63)


def key_of(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return line.strip(_BLANK).lower()


def long_key(line: bytes, least: int) -> bytes | None:
    """The key of a line if it has at least ``least`` code points."""
    if len(line) >= least:
        key = key_of(line)
        if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
            return key
    return None


def probes(hashes: np.ndarray, chunk: int) -> np.ndarray:
    """The positions of each hash in a chunk of so many bits (a power of two), a row for each hash."""
    again = mix(hashes)
    step = (again >> np.uint64(32)) | np.uint64(1)
    return np.stack([((again + np.uint64(k) * step) & np.uint64(chunk - 1)).astype(np.int64) for k in range(PROBES)], 1)


def seen_twice(parts: list[tuple[np.ndarray, np.ndarray]], chunk: int) -> np.ndarray:
    """Which hashes the filter of those seen twice knows, for parts of (distinct hashes, how often each) one after another."""
    once, twice = np.zeros(chunk, bool), np.zeros(chunk, bool)
    for hashes, n in parts:
        at = probes(hashes, chunk)
        twice[at[(n > 1) | once[at].all(1)]] = True
        once[at] = True
    every = np.unique(np.concatenate([h for h, _ in parts]))
    return every[twice[probes(every, chunk)].all(1)]


def long_lines(docs: DataFrame, least: int) -> DataFrame:
    """doc_id (null: the least number) and both halves (low, high) of the hash of each distinct long key of each row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, count = [], []
            for text in batch.column(1):
                own = {xxhash.xxh3_128_digest(k) for line in text.as_py().split(b"\n") if (k := long_key(line, least)) is not None}
                digests += own
                count.append(len(own))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            ids = np.repeat(batch.column(0).to_numpy(), count)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["doc_id", "low", "high"])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(emit, "doc_id long, low long, high long")


def suspects(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """low, n: hashes that the filter of those seen twice knows, and how many of ``lines`` have them."""
    chunks = 1 << int(np.ceil(np.log2(max(lines.count() * BITS_PER_LINE / chunk, 1))))

    def hand_on(hashes: np.ndarray) -> pa.RecordBatch:
        own, n = np.unique(hashes, return_counts=True)
        owner = (own >> np.uint64(20)).astype(np.int64) & (chunks - 1)
        order = np.argsort(owner, kind="stable")
        ids, first = np.unique(owner[order], return_index=True)
        own, n = own[order], n[order].astype("<u4")
        ends = [*first[1:].tolist(), len(own)]
        cut = [(own[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(first.tolist(), ends)]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary())], ["chunk", "hashes", "n"])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            if sum(map(len, held)) >= TASK_LINES:
                yield hand_on(np.concatenate(held))
                held = []
        if held:
            yield hand_on(np.concatenate(held))

    def own(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.frombuffer(h, "<u8"), np.frombuffer(n, "<u4")) for batch in rows for h, n in zip(batch.column("hashes").to_pylist(), batch.column("n").to_pylist())]
        found = seen_twice(parts, chunk)
        count = np.zeros(len(found), np.int64)
        for hashes, n in parts:
            at = np.minimum(np.searchsorted(found, hashes), max(len(found) - 1, 0))
            hit = found[at] == hashes if len(found) else np.zeros(len(hashes), bool)
            count[at[hit]] += n[hit]
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count)], ["low", "n"])

    dealt = lines.select("low").mapInArrow(of_task, "chunk long, hashes binary, n binary")
    return dealt.groupBy("chunk").applyInArrow(own, "low long, n long")


class Repeats:
    """Hashes of repeats and the documents that keep them, as sorted arrays."""

    def __init__(self, rows: list):
        self.low, self.high, self.keeper = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        order = np.argsort(self.low, kind="stable")
        self.low, self.high, self.keeper = self.low[order], self.high[order], self.keeper[order]

    def goes(self, halves: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each line (low, high) of a document is a repeat that another document keeps."""
        if not len(self.low):
            return np.zeros(len(ids), bool)
        out = np.zeros(len(ids), bool)
        first = np.searchsorted(self.low, halves[:, 0])
        for k in range(int(np.unique(self.low, return_counts=True)[1].max())):  # one, but for keys that share half their hash
            at = np.minimum(first + k, len(self.low) - 1)
            out |= (self.low[at] == halves[:, 0]) & (self.high[at] == halves[:, 1]) & (self.keeper[at] != ids)
        return out


def dedup_lines(docs: DataFrame, least: int = 40, documents: int = 5, chunk: int = CHUNK, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and columns n_lines (before), n_dropped.

    A repeat is a key of ``least`` code points or more that ``documents`` documents or more hold; its
    lines go, but for those of the largest doc_id that holds it.  A null text is one empty line
    and becomes empty.  Rows of one doc_id are one document, those without one are the smallest.
    Other columns stay as they are, apart from n_lines and n_dropped, which are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    lines = materialise(long_lines(docs, least), "lines")
    found = join_counted(lines, materialise(suspects(lines, chunk), "suspects"), ["low"])
    repeats = found.groupBy("low", "high").agg(F.count_distinct("doc_id").alias("documents"), F.max("doc_id").alias("keeper"), F.count("*").alias("n"))
    repeats = materialise(repeats.where(F.col("documents") >= documents).select("low", "high", "keeper", "n"), "repeats")
    names, schema = docs.columns, with_fields(docs, "n_lines long", "n_dropped long")

    def rewritten(batch: pa.RecordBatch, goes) -> pa.RecordBatch:
        texts = [t.as_py() for t in pa.compute.fill_null(batch.column("text"), "").cast(pa.binary())]
        digests, place, count = [], [], []
        for row, text in enumerate(texts):
            parts = text.split(b"\n")
            count.append(len(parts))
            for k, line in enumerate(parts):
                if len(line) >= least:
                    digests.append(xxhash.xxh3_128_digest(key_of(line)))
                    place.append((row, k))
        gone: dict[int, set[int]] = {}
        if digests:
            hit = goes(np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2), np.array([r for r, _ in place]))
            for i in np.flatnonzero(hit).tolist():
                gone.setdefault(place[i][0], set()).add(place[i][1])
        for row, out in gone.items():
            texts[row] = b"\n".join(x for k, x in enumerate(texts[row].split(b"\n")) if k not in out)
        columns = {n: batch.column(n) for n in names}
        columns["text"] = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
        columns |= {"n_lines": pa.array(count, pa.int64()), "n_dropped": pa.array([len(gone.get(r, ())) for r in range(len(texts))], pa.int64())}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    if repeats.count() <= broadcast_keys:
        shared = docs.sparkSession.sparkContext.broadcast(Repeats(list(repeats.select("low", "high", "keeper").toLocalIterator())))
        drop(lines)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = np.array([_LEAST if d is None else d for d in batch.column("doc_id").to_pylist()], np.int64)
                yield rewritten(batch, lambda halves, row, ids=ids: shared.value.goes(halves, ids[row]))

        return docs.mapInArrow(apply, schema)

    goes = join_counted(found, repeats, ["low", "high"]).where(F.col("doc_id") != F.col("keeper"))
    goes = goes.groupBy(F.col("doc_id").alias("_tidelog_doc")).agg(F.collect_set(F.struct("low", "high")).alias("_tidelog_gone"))
    joined = docs.withColumn("_tidelog_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))).join(goes, "_tidelog_doc", "left")

    def apply_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [{(x["low"], x["high"]) for x in g or ()} for g in batch.column("_tidelog_gone").to_pylist()]
            yield rewritten(batch, lambda halves, row, sets=sets: np.array([(a, b) in sets[r] for (a, b), r in zip(halves.tolist(), row.tolist())], bool))

    return joined.select(*names, "_tidelog_gone").mapInArrow(apply_joined, schema)


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeats AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN repeats r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
