"""Packing documents into training sequences by bin completion.

Only lengths matter to a packing, and there are at most ``capacity`` of them,
so the search runs on a histogram of lengths, whose size no input exceeds.  A
node of the search takes the largest length left and enumerates the undominated
fillings of the rest of its sequence; a filling is used as often as the counts
allow, or once.  Best-fit decreasing gives the first incumbent, and a branch
ends where its waste leaves no better solution.  The result is a bounded list of
patterns, each with a number of sequences.  Pieces find their place in it by
their rank among the pieces of their length, which is counted in buckets.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoder import encoder
from .scratch import materialise, with_fields

#: Nodes that the search visits at most before it returns its incumbent.
NODES = 20_000
#: Sets of lengths that one node looks at, and fillings it keeps.
SETS, FILLINGS = 2_000, 12

Pattern = tuple[tuple[int, int], ...]  # (length, how often in one sequence), descending


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the sum bound and the bound by items over half (Martello and Toth's L2)."""
    best = -(-sum(l * n for l, n in counts.items()) // capacity)
    lengths = sorted(counts)
    for small in [0, *[l for l in lengths if l <= capacity // 2]]:
        above = sum(n for l, n in counts.items() if l > capacity - small)
        middle = {l: n for l, n in counts.items() if capacity // 2 < l <= capacity - small}
        low = sum(l * n for l, n in counts.items() if small <= l <= capacity // 2)
        room = capacity * sum(middle.values()) - sum(l * n for l, n in middle.items())
        best = max(best, above + sum(middle.values()) + max(0, -(-(low - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over a histogram: sequences with one content are kept as one group."""
    open_: list[tuple[int, int]] = []  # (room, group), ascending
    groups: list[list] = []  # [pattern, number]

    def put(pattern: Pattern, number: int) -> None:
        room = capacity - sum(l * u for l, u in pattern)
        groups.append([pattern, number])
        insort(open_, (room, len(groups) - 1))

    def plus(pattern: Pattern, length: int, uses: int) -> Pattern:
        old = dict(pattern)
        old[length] = old.get(length, 0) + uses
        return tuple(sorted(old.items(), reverse=True))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(open_, (length, -1))
            if k < len(open_):
                room, g = open_[k]
                pattern, number = groups[g]
                uses = room // length
                whole = min(number, left // uses)
                if whole:
                    left -= whole * uses
                    groups[g][1] -= whole
                    put(plus(pattern, length, uses), whole)
                else:
                    groups[g][1] -= 1
                    put(plus(pattern, length, left), 1)
                    left = 0
                if not groups[g][1]:
                    open_.remove((room, g))
            else:
                uses = capacity // length
                if left >= uses:
                    put(((length, uses),), left // uses)
                    left %= uses
                if left:
                    put(((length, left),), 1)
                    left = 0
    return [(p, n) for p, n in groups if n]


def dominated(filling: tuple[int, ...], by: tuple[int, ...]) -> bool:
    """Whether the items of ``filling`` can be dealt into bins of the sizes of ``by``."""
    if len(filling) < len(by) and sum(filling) > sum(by) or len(filling) > 8:
        return False
    rooms = list(by)

    def place(k: int) -> bool:
        if k == len(filling):
            return True
        tried = set()
        for j, room in enumerate(rooms):
            if room >= filling[k] and room not in tried:
                tried.add(room)
                rooms[j] -= filling[k]
                if place(k + 1):
                    return True
                rooms[j] += filling[k]
        return False

    return place(0)


class BinCompletion:
    """Branch and bound over fillings of the sequence that holds the largest length left."""

    def __init__(self, counts: dict[int, int], capacity: int, nodes: int = NODES):
        self.capacity, self.nodes = capacity, nodes
        self.counts = {l: n for l, n in counts.items() if n}
        if any(not 0 < l <= capacity for l in self.counts):
            raise ValueError("lengths lie between 1 and the capacity")
        self.total = sum(l * n for l, n in self.counts.items())
        self.bound = lower_bound(self.counts, capacity)
        self.best = best_fit(self.counts, capacity)
        self.least = sum(n for _, n in self.best)

    def fillings(self, left: dict[int, int], lengths: list[int], room: int, slack: int) -> list[tuple[int, ...]]:
        """Undominated maximal sets that fit into ``room`` and leave at most ``slack``, the fullest first."""
        found: list[tuple[int, ...]] = []
        steps = 0
        full = 0

        def extend(chosen: list[int], room: int, upto: int) -> None:
            nonlocal steps, full
            k = bisect_left(lengths, min(room, upto) + 1) - 1
            grown = False
            while k >= 0 and steps < SETS and full < FILLINGS:
                x = lengths[k]
                k -= 1
                if left[x] <= chosen.count(x):
                    continue
                grown = True
                steps += 1
                chosen.append(x)
                extend(chosen, room - x, x)
                chosen.pop()
            if not grown and room <= slack:
                if not any(left[x] > chosen.count(x) for x in lengths[: bisect_left(lengths, room + 1)]):
                    found.append(tuple(chosen))
                    full += room == 0

        extend([], room, room)
        found.sort(key=lambda f: (-sum(f), len(f), [-x for x in f]))
        kept: list[tuple[int, ...]] = []
        for f in found:
            if len(kept) < FILLINGS and not any(dominated(f, g) for g in kept):
                kept.append(f)
        return kept

    def solve(self) -> list[tuple[Pattern, int]]:
        left, lengths = dict(self.counts), sorted(self.counts)
        used: list[tuple[Pattern, int]] = []
        bins = waste = visited = 0

        def children() -> Iterator[tuple[Pattern, int]]:
            top = lengths[-1]
            left[top] -= 1
            found = self.fillings(left, lengths, self.capacity - top, (self.least - 1) * self.capacity - self.total - waste)
            left[top] += 1
            for f in found:
                content = [top, *f]
                pattern = tuple((l, content.count(l)) for l in sorted(set(content), reverse=True))
                most = min(left[l] // u for l, u in pattern)
                yield pattern, most
                if most > 1:
                    yield pattern, 1

        def apply(pattern: Pattern, number: int, sign: int) -> None:
            for l, u in pattern:
                old = left[l]
                left[l] = old - sign * u * number
                if sign > 0 and not left[l]:
                    del lengths[bisect_left(lengths, l)]
                elif sign < 0 and not old:
                    insort(lengths, l)

        stack = []
        if self.least > self.bound:
            stack.append((children(), None))
        while stack and self.least > self.bound and visited < self.nodes:
            step = next(stack[-1][0], None)
            if step is None:
                _, done = stack.pop()
                if done:
                    pattern, number = used.pop()
                    apply(pattern, number, -1)
                    bins -= number
                    waste -= number * (self.capacity - sum(l * u for l, u in pattern))
                continue
            pattern, number = step
            more = number * (self.capacity - sum(l * u for l, u in pattern))
            if waste + more > (self.least - 1) * self.capacity - self.total:
                continue
            visited += 1
            apply(pattern, number, 1)
            used.append(step)
            bins += number
            waste += more
            if lengths:
                stack.append((children(), step))
            else:
                self.best, self.least = list(used), bins
                stack.append((iter(()), step))
        return self.best


def slots(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: from which rank on, how many to a sequence, which
    sequences, and at which offset.  Sorted by length and rank."""
    rows, base, ranks = [], 0, {}
    for pattern, number in patterns:
        offset = 0
        for length, uses in pattern:
            rows.append((length, ranks.get(length, 0), uses, base, offset))
            ranks[length] = ranks.get(length, 0) + uses * number
            offset += length * uses
        base += number
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "uses", "base", "offset"), table.T))


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Encode documents (doc_id, text; null text: empty), append ``end_id``, and cut those longer
    than ``capacity`` into pieces: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = encoder(tokenizer), np.array([end_id], "<u4")
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(x.as_py() for x in batch.column(1))):
                ids = np.concatenate([ids, last])
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 2048, nodes: int = NODES) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...) so that they fill as few
    sequences of ``capacity`` as the search finds.  ``pieces`` is read twice and should be a table.

    Lengths lie in 1..capacity.  Rows that are equal in doc_id and piece are different pieces;
    null ids are pieces like others; an empty table gives none.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    place = slots(BinCompletion(histogram, capacity, nodes).solve())
    # Ranks within a length are counted within buckets, so that a frequent length is many tasks' work.
    buckets = max(64, 1 << (sum(histogram.values()) >> 20).bit_length())
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1
    ranked = bucketed.withColumn("_within", within).join(sizes, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_within") + F.col("_before"))
    key = place["length"] << 44 | place["rank"]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            nth = rank - place["rank"][at]
            sequence = place["base"][at] + nth // place["uses"][at]
            offset = place["offset"][at] + nth % place["uses"][at] * length
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    columns = pieces.columns
    return ranked.select(*columns, "_rank").mapInArrow(seat, with_fields(pieces, "sequence_id long", "offset long"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Encode, cut and pack documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Extra columns are ignored.  The pieces are written to the shared folder, so texts are
    encoded once, and a lost executor costs neither the encoding nor a changed packing.
    """
    return pack(materialise(cut_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
