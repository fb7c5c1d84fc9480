"""N-best segmentation with the pieces and scores of a SentencePiece model.

Spaces become U+2581, one is put in front of a text that isn't empty, and a piece holds that
mark only at its beginning.  So the lattice of a text is a chain of the lattices of its units
(spaces and what follows up to the next space), and a segmentation's score is the sum of its
units' scores.  Units are solved many at a time in numpy: a forward Viterbi pass gives the best
segmentation; with a backward one it gives each unit's loss for its second best.  The N best of a text
differ from its best only in the N - 1 units of least loss; for these a backward A-star search,
for which the forward scores are an exact heuristic, lists the N best, and the lists are merged one
after another.

A character that no piece covers costs ten less than the lowest score and is written as its bytes.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

MARK = 0x2581
#: Stands for a mark that is itself in the text; no piece holds it.
_LITERAL = 0x110000
#: Pieces of a lower score are made by the model's authors for display only and cost what they say.
_SENTINEL = -1e8
CACHE_UNITS, CACHE_LISTS = 1_000_000, 100_000
_MODELS: dict[str, "PieceModel"] = {}


class _Run(tx.Pages):
    """Texts one after another, a space before each that isn't empty."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"".join([*(b" " + t if t else t for t in texts), b" " * 16])
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) + bool(t) for t in texts], dtype=np.int64)])

    def units(self) -> tuple[np.ndarray, np.ndarray]:
        total = int(self.starts[-1])
        space = self.bytes[:total] == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[self.starts[:-1][self.starts[:-1] < total]] = True
        starts = np.flatnonzero(begins)
        return starts, np.append(starts[1:], total)


def merged(lists: list[tuple], n: int) -> list[tuple[float, tuple]]:
    """The n least sums of one entry of each list, of entries (cost, ids) by ascending cost, with the entries.

    List by list: of the n best so far and a list, the k-th with the j-th can only count if k * j <= n."""
    ways: list[tuple[float, tuple]] = [(0.0, ())]
    for entries in lists:
        both = [(cost + x[0], (*way, x)) for k, (cost, way) in enumerate(ways, 1) for x in entries[: n // k]]
        ways = sorted(both, key=lambda w: w[0])[:n]
    return ways


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = sp.get_piece_size()
        self.score = np.array([sp.get_score(i) for i in range(count)])
        self.pieces = [sp.id_to_piece(i) for i in range(count)]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        normal = [i for i in range(count) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any("▁" in self.pieces[i].lstrip("▁") for i in normal):
            raise ValueError("a piece holds the space mark after another character")
        self.unknown = self.score[[i for i in normal if self.score[i] > _SENTINEL]].min() - 10
        prefixes: dict[str, int] = {}
        for i in normal:
            for n in range(1, len(self.pieces[i])):
                prefixes.setdefault(self.pieces[i][:n], -1)
        for i in normal:
            prefixes[self.pieces[i]] = i
        keys = np.zeros(len(prefixes), np.uint64)
        for k, p in enumerate(prefixes):
            h = np.zeros(1, np.uint64)
            for c in p:
                h = tx.mix(h * tx.GOLD + np.uint64(ord(c)))
            keys[k] = h[0]
        if len(np.unique(keys)) != len(keys):
            raise ArithmeticError("two prefixes share a key")
        size = 1 << 20
        self.mask, self.slot_key, self.slot_id = np.uint64(size - 1), np.zeros(size, np.uint64), np.full(size, -2, np.int32)
        left = np.arange(len(keys))
        values = np.fromiter(prefixes.values(), np.int32, len(keys))
        for self.probes in range(1, 64):  # entries that find their slot taken go one further
            at = ((keys[left] + np.uint64(self.probes - 1)) & self.mask).astype(np.int64)
            free = self.slot_id[at] == -2
            _, first = np.unique(at, return_index=True)
            mine = np.intersect1d(first, np.flatnonzero(free))
            self.slot_key[at[mine]], self.slot_id[at[mine]] = keys[left[mine]], values[left[mine]]
            left = np.delete(left, mine)
            if not len(left):
                break
        spelled = [bytes([int(p[3:5], 16)]) if i in set(self.byte_ids.tolist()) else b"" if sp.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_n = np.array([len(s) for s in spelled])
        self.spelled_at = np.cumsum(self.spelled_n) - self.spelled_n
        self.lists: dict[bytes, tuple] = {}
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first, self.last = np.zeros((3, 0), np.uint64)
        self.at, self.n = np.zeros((2, 0), np.int64)
        self.best, self.loss = np.zeros((2, 0))
        self.pool = np.zeros(0, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """-2: no prefix of a piece, -1: only a prefix, else the piece's id."""
        out = np.full(len(h), -2, np.int32)
        left = np.arange(len(h))
        for k in range(self.probes):
            at = ((h[left] + np.uint64(k)) & self.mask).astype(np.int64)
            hit = self.slot_key[at] == h[left]
            out[left[hit]] = self.slot_id[at[hit]]
            left = left[~hit & (self.slot_id[at] != -2)]
            if not len(left):
                break
        return out

    def lattice(self, units: list[bytes]):
        """Characters, each unit's first character, and edges (first character, length, id or -1, score)."""
        texts = [u.decode("utf-8", "replace") for u in units]
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        chars = np.where(chars == MARK, _LITERAL, np.where(chars == 32, MARK, chars)).astype(np.uint64)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(length) - length
        end = np.repeat(first + length, length)
        at, h = np.arange(len(chars)), tx.mix(chars)
        found, n = [], 1
        while len(at):
            piece = self._find(h)
            is_piece = piece >= 0
            if n == 1:
                found.append((at[~is_piece], 1, np.full((~is_piece).sum(), -1, np.int32)))
            found.append((at[is_piece], n, piece[is_piece]))
            on = (piece > -2) & (at + n < end[at])
            at = at[on]
            h = tx.mix(h[on] * tx.GOLD + chars[at + n])
            n += 1
        start = np.concatenate([f[0] for f in found])
        size = np.concatenate([np.full(len(f[0]), f[1]) for f in found])
        ids = np.concatenate([f[2] for f in found])
        return chars, first, length, start, size, ids, np.where(ids < 0, self.unknown, self.score[ids])

    def solve(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each unit its best ids (one after another) and their number, its score, and the loss of its second best."""
        chars, first, length, start, size, ids, score = self.lattice(units)
        unit = np.repeat(np.arange(len(units)), length)
        node = start + unit[start]  # a unit has one node more than characters
        goal = node + size
        root, final = first + np.arange(len(units)), first + np.arange(len(units)) + length
        forward = np.full(len(chars) + len(units), -np.inf)
        backward = forward.copy()
        forward[root], backward[final] = 0, 0
        via = np.full(len(forward), -1)
        reach = start - first[unit[start]] + size
        order = np.lexsort((size, reach))
        cuts = np.searchsorted(reach[order], np.arange(1, (length.max() if len(length) else 0) + 2))
        for a, b in zip(cuts, cuts[1:]):
            e = order[a:b]
            value = forward[node[e]] + score[e]
            np.maximum.at(forward, goal[e], value)
            e = e[value == forward[goal[e]]]
            via[goal[e]] = e  # of equals the last, which is the longest, stays
        left = length[unit[start]] - (start - first[unit[start]])
        order = np.argsort(left, kind="stable")
        cuts = np.searchsorted(left[order], np.arange(1, (length.max() if len(length) else 0) + 2))
        for a, b in zip(cuts, cuts[1:]):
            e = order[a:b]
            np.maximum.at(backward, node[e], score[e] + backward[goal[e]])
        on = np.zeros(len(start), bool)
        here, own = final.copy(), np.arange(len(units))
        while len(own):
            live = here > root[own]
            here, own = here[live], own[live]
            e = via[here]
            on[e] = True
            here = node[e]
        slack = forward[final][unit[start]] - (forward[node] + score + backward[goal])
        loss = np.full(len(units), np.inf)
        off = np.flatnonzero(~on)
        np.minimum.at(loss, unit[start[off]], slack[off])
        path = np.flatnonzero(on)
        path = path[np.argsort(start[path])]
        out, count = self._spell(ids[path], chars[start[path]])
        per = np.bincount(unit[start[path]], count, len(units)).astype(np.int64)
        return out, per, forward[final], loss

    def _spell(self, ids: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the bytes of unknown characters in their place, and how many each gave."""
        unknown = np.flatnonzero(ids < 0)
        count = np.ones(len(ids), np.int64)
        raw = [(chr(c) if c != _LITERAL else chr(MARK)).encode("utf-8", "surrogatepass") for c in chars[unknown].tolist()]
        count[unknown] = [len(r) for r in raw]
        out = np.repeat(ids, count)
        if len(unknown):
            begin = (np.cumsum(count) - count)[unknown]
            n = count[unknown]
            place = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out[place] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return out, count

    def unit_list(self, unit: bytes, n: int) -> tuple[tuple[float, tuple[int, ...]], ...]:
        """The n best segmentations of a unit, by A-star from its end: (loss against the best, ids).

        Of equal costs the path that has less before it goes on, so ties are finished one by one, not side by
        side; and a node needs only the n best of the paths that reach it, so no node is left more than n times."""
        known = self.lists.get(unit)
        if known is not None and known[0] >= n:
            return known[1][:n]
        chars, _, length, start, size, ids, score = self.lattice([unit])
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(len(chars) + 1)]
        for s, z, i, v in zip(start.tolist(), size.tolist(), ids.tolist(), score.tolist()):
            into[s + z].append((s, i, v))
        best = [0.0] + [-np.inf] * len(chars)
        for e in range(1, len(chars) + 1):
            best[e] = max(best[s] + v for s, _, v in into[e])
        found, turn = [], 0
        agenda = [(-best[-1], len(chars), 0, 0.0, None)]
        left = [n] * (len(chars) + 1)
        while agenda and len(found) < n:
            cost, at, _, behind, tail = heapq.heappop(agenda)
            left[at] -= 1
            if left[at] < 0:
                continue
            if at == 0:
                path = []
                while tail:
                    path.append(tail[0])
                    tail = tail[1]
                at, spelled = 0, []
                for i, z in path:
                    spelled += self._spell(np.array([i]), chars[at : at + 1])[0].tolist()
                    at += z
                found.append((cost + best[-1], tuple(spelled)))
                continue
            for s, i, v in into[at]:
                turn += 1
                if left[s] > 0:
                    heapq.heappush(agenda, (-(best[s] + v + behind), s, turn, behind + v, ((i, at - s), tail)))
        if len(self.lists) >= CACHE_LISTS:
            self.lists.clear()
        if len(unit) <= 64:
            self.lists[unit] = (n, tuple(found))
        return tuple(found)

    def _look_up(self, run: _Run, starts: np.ndarray, ends: np.ndarray):
        """Place and number of ids in the pool, score and loss of each unit; the pool."""
        first, last = tx.ends_of(run, starts, ends)
        key = tx.word_keys(run, starts, ends)
        code, distinct = pd.factorize(key)
        one = np.empty(len(distinct), np.int64)
        one[code] = np.arange(len(code))
        # Units that only share a key with another stand alone and aren't kept for later.
        size = ends - starts
        odd = (first != first[one][code]) | (last != last[one][code]) | (size != size[one][code])
        for k in np.flatnonzero(~odd & (size > 16)).tolist():
            o = one[code[k]]
            odd[k] = k != o and run.raw[starts[k] : ends[k]] != run.raw[starts[o] : ends[o]]
        alone = np.flatnonzero(odd)
        shared = np.isin(np.arange(len(distinct)), code[alone])
        code[alone] = len(distinct) + np.arange(len(alone))
        distinct, one = np.append(distinct, key[alone]), np.append(one, alone)
        f, l, short = first[one], last[one], (size[one] <= 16) & ~np.append(shared, np.ones(len(alone), bool))
        where = np.searchsorted(self.keys, distinct)
        near = np.minimum(where, max(len(self.keys) - 1, 0))
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            known = (self.keys[near] == distinct) & (self.first[near] == f) & (self.last[near] == l) & short
        at, n = np.empty((2, len(distinct)), np.int64)
        best, loss = np.empty((2, len(distinct)))
        at[known], n[known], best[known], loss[known] = (x[near[known]] for x in (self.at, self.n, self.best, self.loss))
        pool = self.pool
        new = np.flatnonzero(~known)
        if len(new):
            ids, n[new], best[new], loss[new] = self.solve([run.raw[a:b] for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist())])
            at[new] = len(pool) + np.cumsum(n[new]) - n[new]
            pool = np.concatenate([pool, ids])
            keep = new[short[new]]
            keep = keep[np.argsort(distinct[keep])]
            put = np.searchsorted(self.keys, distinct[keep])
            fresh = (self.keys[np.minimum(put, max(len(self.keys) - 1, 0))] != distinct[keep]) if len(self.keys) else np.ones(len(keep), bool)
            keep, put = keep[fresh], put[fresh]
            if len(self.keys) + len(keep) <= CACHE_UNITS:
                self.pool = pool
                for name, x in (("keys", distinct), ("first", f), ("last", l), ("at", at), ("n", n), ("best", best), ("loss", loss)):
                    setattr(self, name, np.insert(getattr(self, name), put, x[keep]))
            else:
                self._forget()
        return at[code], n[code], best[code], loss[code], pool

    def nbest(self, texts: list[bytes], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the ids of its best segmentation and the scores of the n best, descending."""
        for ids, scores, _ in self._texts(texts, n):
            yield ids, scores

    def segmentations(self, text: bytes, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of one text: score and ids."""
        return next(self._texts([text], n, True))[2]

    def _texts(self, texts: list[bytes], n: int, whole: bool = False):
        run = _Run(texts)
        starts, ends = run.units()
        if len(starts):
            at, count, best, loss, pool = self._look_up(run, starts, ends)
            done = np.concatenate([[0], np.cumsum(count)])
            ids = pool[np.repeat(at - done[:-1], count) + np.arange(done[-1])]
        else:
            best = loss = np.zeros(0)
            done, ids = np.zeros(1, np.int64), np.zeros(0, np.int32)
        bounds = np.searchsorted(starts, run.starts)
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            total = best[a:b].sum()
            least = np.arange(b - a) if b - a < n else np.argpartition(loss[a:b], n - 2)[: n - 1] if n > 1 else np.zeros(0, np.int64)
            least = sorted(k for k in least.tolist() if np.isfinite(loss[a + k]))
            lists = [self.unit_list(run.raw[starts[a + k] : ends[a + k]], n) for k in least]
            ways = merged(lists, n)
            own = ids[done[a] : done[b]]
            full = []
            if whole:
                for cost, way in ways:
                    parts = [own[done[k] - done[a] : done[k + 1] - done[a]].tolist() for k in range(a, b)]
                    if cost or any(x is not y[0] for x, y in zip(way, lists)):
                        for k, x in zip(least, way):
                            parts[k] = list(x[1])
                    full.append((total - cost, [i for p in parts for i in p]))
            yield own, np.array([total - w[0] for w in ways]), full

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids: pieces and bytes joined, marks as spaces, without the space put in front."""
        n = self.spelled_n[ids]
        out = self.spelled[np.repeat(self.spelled_at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        return out[1:] if out[:1] == b" " else out


def model(path: str) -> PieceModel:
    """The worker's model for a file; it stays for later tasks."""
    if path not in _MODELS:
        _MODELS.clear()
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _slices(texts: Iterable[bytes | None]) -> Iterator[list[bytes]]:
    return tx.in_slices(texts, 1 << 20)


def encode_digest(docs: DataFrame, path: str, n: int = 4) -> DataFrame:
    """Per document: doc_id, n_pieces and ids_crc32 (little-endian uint32 ids) of its best
    segmentation, score, scores of its ``n`` best (fewer if it has fewer), and whether decoding gives the
    text.  A null text is empty: no piece, score 0.  Extra columns are ignored; rows are independent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            rows = []
            for some in _slices(t.as_py() for t in batch.column(1)):
                for text, (ids, scores) in zip(some, m.nbest(some, n)):
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), float(scores[0]), scores.tolist(), m.decode(ids) == text))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_pieces", "ids_crc32", "score", "scores", "round_trip"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, score double, scores array<double>, round_trip boolean")


def encode_nbest(docs: DataFrame, path: str, n: int = 4) -> DataFrame:
    """A row for each of the ``n`` best segmentations of each document: doc_id, rank (from 1), score, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = m.segmentations(text.as_py() or b"", n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * len(found), pa.int64()), pa.array(range(1, len(found) + 1), pa.int32()), pa.array([s for s, _ in found], pa.float64()), pa.array([i for _, i in found], pa.list_(pa.int32()))],
                    ["doc_id", "rank", "score", "ids"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, rank int, score double, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (with a column ids) with a column text, decoded; null ids give null."""
    rest = [c for c in encoded.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [None if i is None else m.decode(np.array(i, np.int64)).decode("utf-8", "replace") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, "text"])

    from .scratch import with_fields

    source = encoded.select(rest)
    return source.mapInArrow(run, with_fields(source, "text string"))
