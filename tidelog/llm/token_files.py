"""Files of token ids: documents in ascending order of id, Simple-8b coded.

A file is ``header | words | block offsets | exceptions | doc ids | doc lengths | trailer``,
little-endian.  Block offsets say at which word each block of 1,024 ids begins, so a reader
decodes any run of blocks at once and skips the rest.  Files close at a bounded number of ids;
their names sort as their documents do.  Each is written under a name of the attempt and then
renamed, so a task that runs again replaces its files by equal ones.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simple8b
from .encoder import encoder
from .scratch import materialise, scratch_path

MAGIC = b"TIDES8B1"
#: magic, ids, blocks, words, exceptions, documents, crc32 of all before.
TRAILER = struct.Struct("<8s5QI")
#: Ids after which a file is closed at the next end of a document; documents likewise.
FILE_IDS = 32 << 20
FILE_DOCS = 2 << 20
#: Ids that are coded or decoded together.
GROUP_IDS = 512 * simple8b.BLOCK
_NULL = 1 << 62

MANIFEST = "part int, roll int, path string, docs long, ids long"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenFile:
    """Writes one file; ids are coded as soon as a group of blocks is full."""

    def __init__(self, folder: str, name: str):
        self.fs, at = filesystem(folder)
        self.fs.create_dir(at, recursive=True)
        self.path, self.temporary = f"{at}/{name}", f"{at}/_{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.crc = 0
        self.held: list[np.ndarray] = []
        self.n_held = self.ids = self.words = 0
        self.blocks: list[np.ndarray] = []
        self.exceptions: list[np.ndarray] = []
        self.doc_ids: list[int] = []
        self.lengths: list[int] = []
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.out.write(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.lengths.append(len(ids) | (_NULL if doc_id is None else 0))
        self.ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= GROUP_IDS:
            self._code(self.n_held // GROUP_IDS * GROUP_IDS)

    def _code(self, upto: int) -> None:
        joined = np.concatenate(self.held)
        self.held, self.n_held = [joined[upto:]], len(joined) - upto
        for at in range(0, upto, GROUP_IDS):
            words, starts, odd = simple8b.encode(joined[at : min(at + GROUP_IDS, upto)])
            if len(odd):  # an escape's payload counts from the file's first exception
                own = np.flatnonzero((words & np.uint64(15)) == simple8b.ESCAPE)
                words[own] += np.uint64(sum(map(len, self.exceptions)) << 4)
            self.blocks.append(starts + self.words)
            self.exceptions.append(odd)
            self.words += len(words)
            self._write(words.astype("<u8").tobytes())

    def close(self) -> str:
        if self.n_held:
            self._code(self.n_held)
        blocks = np.concatenate(self.blocks) if self.blocks else np.zeros(0, np.int64)
        odd = np.concatenate(self.exceptions) if self.exceptions else np.zeros(0, np.uint64)
        for part in (blocks.astype("<u8"), odd.astype("<u8"), np.array(self.doc_ids, "<i8"), np.array(self.lengths, "<i8")):
            self._write(part.tobytes())
        self.out.write(TRAILER.pack(MAGIC, self.ids, len(blocks), self.words, len(odd), len(self.doc_ids), self.crc))
        self.out.close()
        from pyarrow.fs import FileType

        if self.fs.get_file_info(self.path).type != FileType.NotFound:
            self.fs.delete_file(self.path)
        self.fs.move(self.temporary, self.path)
        return self.path


class TokenReader:
    """Reads one file: its index at once, its ids by groups of blocks.  Damage is found before any id is handed on."""

    def __init__(self, folder: str, path: str):
        self.file = filesystem(folder)[0].open_input_file(path)
        size = self.file.size()
        magic, self.ids, blocks, self.words, odd, docs, self.crc = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        at = 8 + 8 * self.words
        found = 0
        for begin in range(0, size - TRAILER.size, 4 << 20):
            found = zlib.crc32(self.file.read_at(min(4 << 20, size - TRAILER.size - begin), begin), found)
        if found != self.crc or size != at + 8 * (blocks + odd + 2 * docs) + TRAILER.size:
            raise ValueError(f"{path} is damaged")
        index = np.frombuffer(self.file.read_at(8 * (blocks + odd + 2 * docs), at), "<i8")
        self.blocks, self.exceptions, self.doc_ids, lengths = np.split(index, np.cumsum([blocks, odd, docs]))
        self.exceptions = self.exceptions.view("<u8")
        self.null, self.lengths = lengths & _NULL != 0, lengths & (_NULL - 1)
        if self.lengths.sum() != self.ids:
            raise ValueError(f"{path} is damaged")

    def groups(self) -> Iterator[np.ndarray]:
        step = GROUP_IDS // simple8b.BLOCK
        for k in range(0, len(self.blocks), step):
            own = self.blocks[k : k + step]
            end = self.blocks[k + step] if k + step < len(self.blocks) else self.words
            words = np.frombuffer(self.file.read_at(8 * int(end - own[0]), 8 + 8 * int(own[0])), "<u8")
            total = min(len(own) * simple8b.BLOCK, self.ids - k * simple8b.BLOCK)
            yield simple8b.decode(words, own - own[0], total, self.exceptions)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and ids; holds a group and the longest document."""
        groups, held = self.groups(), np.zeros(0, np.uint64)
        for doc, n, null in zip(self.doc_ids.tolist(), self.lengths.tolist(), self.null.tolist()):
            if len(held) < n:
                parts = [held]
                while sum(map(len, parts)) < n:
                    parts.append(next(groups))
                held = np.concatenate(parts)
            yield None if null else doc, held[:n].astype("<u4")
            held = held[n:]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode ``docs`` (doc_id, text; null text: empty), append ``end_id`` to each, and write files.

    Returns the manifest, one row per file in order of ``part, roll``, written before this
    returns.  Rows with one doc_id are separate documents, in order of a hash of their text,
    then of the text; a null doc_id comes first.  An empty table makes no files.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, roll, file = TaskContext.get().partitionId(), 0, None
        coder, last = encoder(tokenizer), np.array([end_id], "<u4")

        def done():
            path = file.close()
            rows = [[part], [roll], [path], [len(file.doc_ids)], [file.ids]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()])], ["part", "roll", "path", "docs", "ids"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(x.as_py() for x in batch.column(1))):
                if file is None:
                    file = TokenFile(folder, f"part-{part:06d}-{roll:04d}.s8b")
                file.add(doc_id, np.concatenate([ids, last]))
                if file.ids >= FILE_IDS or len(file.doc_ids) >= FILE_DOCS:
                    yield done()
                    roll, file = roll + 1, None
        if file is not None:
            yield done()

    return materialise(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str, digest: bool = True) -> DataFrame:
    """Read files back: per document its place in the whole sequence of ids and their digest,
    or (``digest=False``) the ids themselves."""
    order = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("ids").over(order), F.lit(0)))
    columns = DIGEST if digest else "doc_id long, start long, ids array<long>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                out: list[tuple] = []
                size = 0
                for doc_id, ids in TokenReader(folder, path).documents():
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())) if digest else (doc_id, start, ids.tolist()))
                    start += len(ids)
                    size += 1 if digest else len(ids)
                    if size >= 200_000:
                        yield _rows(out, digest)
                        out, size = [], 0
                if out:
                    yield _rows(out, digest)

    return files.select("path", "start").repartition(min(max(manifest.count(), 1), 10_000)).mapInArrow(read, columns)


def _rows(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    types = [pa.int64()] * 4 if digest else [pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] if digest else ["doc_id", "start", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def token_folder(docs: DataFrame) -> str:
    return scratch_path(docs.sparkSession, "token-files")
