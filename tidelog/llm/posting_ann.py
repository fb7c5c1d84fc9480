"""Approximate nearest neighbours over balanced posting lists.

Centroids come from balanced k-means on a bounded sample: clusters that are too large are split,
and tiny ones joined with their neighbours, so no list holds much more than its share.  Every vector is then listed with its
nearest centroid and, near a boundary, with a few that are hardly farther.  A query walks best first
over an in-memory graph of centroids, keeps those whose distance is within a ratio of the
nearest, and is compared exactly with what they list.  The ratio is the one at which, within the
sample, a wanted share of true neighbours is found.  Where the lists within it hold too few vectors,
it counts from the distance at which the lists hold enough, so no query is left short.

Lists are dealt in blocks of bounded size, so that a list of very many copies is many tasks' work;
every block hands on its ten nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

#: The most centroids, as the driver fits them and every worker walks their graph (at 64 numbers a vector 8 MB, its links 5 MB);
#: vectors that they are fitted on: some for each, but not fewer than the first number.
MOST_CENTROIDS, SAMPLE, SAMPLE_EACH = 16_384, 20_000, 8
#: Clusters of more than this many times the mean are split, of less than this part of it are given up.
LARGE, TINY = 2.0, 0.25
#: Vectors to a centroid that are aimed at, and the most in a block.
PER_LIST, BLOCK = 64, 512
#: Lists of a vector, and how much farther than the nearest a further one may be.
REPLICAS, CLOSURE = 4, 1.15
#: Share of true neighbours within the sample that the ratio for a query's lists is set for, and queries it is set on.
TARGET, TRIALS = 0.95, 400
#: Neighbours of a centroid in the graph, and width of the walk.
LINKS, WIDTH = 24, 64
ROUNDS = 12


def usable(vector: np.ndarray | None, size: int | None = None) -> bool:
    """Whether a vector takes part: of the right size, without nulls, finite and not zero."""
    if vector is None or len(vector) == 0 or (size is not None and len(vector) != size):
        return False
    return bool(np.isfinite(vector).all() and (vector != 0).any())


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, for search only."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def _nearest(x: np.ndarray, centres: np.ndarray, penalty: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The centre of each row, by distance and penalty, and the squared distance from the nearest."""
    own, near = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), 512):
        d = distances(x[at : at + 512], centres)
        own[at : at + 512] = np.argmin(d + penalty, 1)
        near[at : at + 512] = d.min(1)
    return own, near


def _means(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The mean of each of k clusters, none of which is empty."""
    order = np.argsort(own, kind="stable")
    first = np.searchsorted(own[order], np.arange(k))
    return np.add.reduceat(x[order], first, axis=0) / np.bincount(own, minlength=k)[:, None]


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Centroids of about k clusters of about equal size: a cluster's excess over the mean is a penalty on joining it.

    After each round tiny clusters are given up, and of a large one, whose members may be nearest to a single centre,
    two members become centres.  The last rounds do so by plain distance, as vectors are listed.  Equal vectors count
    once, so copies don't take centroids."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    penalty: np.ndarray | float = 0.0
    for turn in range(rounds):
        own, near = _nearest(x, centres, penalty)
        count = np.bincount(own, minlength=len(centres))
        mean = len(x) / k
        stay = count >= max(1.0, TINY * mean) if len(centres) > 1 else count > 0
        if not stay.any():
            stay = count == count.max()
        if not stay.all():
            centres = centres[stay]
            own, near = _nearest(x, centres)
            count = np.bincount(own, minlength=len(centres))
            full = count > 0
            own, centres, count = np.cumsum(full)[own] - 1, centres[full], count[full]
        centres = _means(x, own, len(centres))
        if turn == rounds - 1:
            break
        large = np.flatnonzero(count > LARGE * mean)
        if len(large):
            more = []
            for c in large.tolist():
                members = np.flatnonzero(own == c)
                more.append(x[rng.choice(members, min(len(members), int(np.ceil(count[c] / mean))), replace=False)])
            centres = np.concatenate([np.delete(centres, large, 0), *more])
        penalty = 0.0
        if turn < rounds - 4:
            own, near = _nearest(x, centres)
            count = np.bincount(own, minlength=len(centres))
            penalty = 0.15 * near.mean() * np.clip(count * k / len(x) - 1, -0.5, 3)
    return centres


class CentroidGraph:
    """Centroids, each linked with its nearest and with some far ones; walked best first."""

    def __init__(self, centres: np.ndarray, seed: int = 5):
        self.centres = centres
        k = len(centres)
        n = min(LINKS, k - 1)
        links = np.empty((k, n), np.int64)
        for at in range(0, k, 512):
            d = distances(centres[at : at + 512], centres)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            links[at : at + 512] = np.argpartition(d, n - 1, 1)[:, :n] if n else links[at : at + 512]
        rng = np.random.default_rng(seed)
        far = rng.integers(0, k, (k, 4))
        back: list[set] = [set(r) for r in np.concatenate([links, far], 1).tolist()]
        for i, row in enumerate(links.tolist()):
            for j in row:
                back[j].add(i)
        self.links = [np.array(sorted(s - {i}), np.int64) for i, s in enumerate(back)]
        self.entry = rng.choice(k, min(16, k), replace=False)
        #: The middle distance of sampled vectors from their nearest centroid; the ratio for a query's lists.
        self.usual, self.ratio = 0.0, 1.0
        #: Distinct vectors of each list, every one counted in one list only; how many a query's lists have to hold.
        self.held, self.wanted = np.zeros(k, np.int64), 0

    def within(self, q: np.ndarray, ratio: float) -> np.ndarray:
        """Centroids that the walk finds no farther than ``ratio`` times the nearest (or the usual nearest, if that is more)."""
        dist = lambda ids: np.sqrt(((self.centres[ids] - q) ** 2).sum(1))
        seen = np.zeros(len(self.centres), bool)
        seen[self.entry] = True
        agenda = list(zip(dist(self.entry).tolist(), self.entry.tolist()))
        heapq.heapify(agenda)
        beam: list[float] = []  # the WIDTH least distances, negated
        walked: list[tuple[float, int]] = []
        best = agenda[0][0]
        while agenda:
            d, i = heapq.heappop(agenda)
            best = min(best, d)
            if len(beam) >= WIDTH and d > max(-beam[0], ratio * max(best, self.usual)):
                break
            walked.append((d, i))
            heapq.heappush(beam, -d)
            if len(beam) > WIDTH:
                heapq.heappop(beam)
            new = self.links[i][~seen[self.links[i]]]
            seen[new] = True
            for pair in zip(dist(new).tolist(), new.tolist()):
                heapq.heappush(agenda, pair)
        near = np.array([i for d, i in walked if d <= ratio * max(best, self.usual)], np.int64)
        return near if self.held[near].sum() >= self.wanted else self.filled(q, ratio)

    def filled(self, q: np.ndarray, ratio: float) -> np.ndarray:
        """Centroids no farther than ``ratio`` times the least distance within which lists hold the wanted number; all, if none do."""
        d = np.sqrt(((self.centres - q) ** 2).sum(1))
        order = np.argsort(d, kind="stable")
        enough = int(np.searchsorted(np.cumsum(self.held[order]), self.wanted))
        if enough == len(order):
            return order
        return order[d[order] <= max(ratio, 1.0) * max(d[order[enough]], self.usual)]

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and centroid of every entry: the nearest centroid of each row, first, and further ones within the closure."""
        rows, lists = [], []
        n = min(REPLICAS, len(self.centres))
        for at in range(0, len(x), 512):
            d = np.sqrt(distances(x[at : at + 512], self.centres))
            order = np.argpartition(d, n - 1, 1)[:, :n]
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(d, order, 1), 1, kind="stable"), 1)
            near = np.take_along_axis(d, order, 1)
            least = near.min(1, keepdims=True)
            r, c = np.nonzero((near <= CLOSURE * np.maximum(least, self.usual)) | (near == least))
            rows.append(r + at)
            lists.append(order[r, c])
        return (np.concatenate(rows), np.concatenate(lists)) if rows else (np.zeros(0, np.int64),) * 2

    def probes_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and centroid of every list that is searched for each row."""
        found = [self.within(q, self.ratio) for q in x]
        if not found:
            return (np.zeros(0, np.int64),) * 2
        return np.repeat(np.arange(len(x)), [len(f) for f in found]), np.concatenate(found)

    def calibrate(self, sample: np.ndarray, k: int) -> None:
        """Set the ratio at which TARGET of the k nearest in the sample are in a list that is searched."""
        sample = np.unique(sample, axis=0)
        rng = np.random.default_rng(1)
        trial = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
        rows, lists = self.lists_of(sample)
        begin = np.searchsorted(rows, np.arange(len(sample) + 1))
        need = []
        for i in trial.tolist():
            d = distances(sample[i][None], sample)[0]
            d[i] = np.inf
            true = np.argsort(d)[: min(k, len(sample) - 1)]
            to = np.sqrt(distances(sample[i][None], self.centres)[0])
            least = max(to.min(), self.usual)
            need += [to[lists[begin[j] : begin[j + 1]]].min() / least for j in true.tolist()]
        self.ratio = max(1.0, float(np.quantile(need, TARGET))) * (1 + 1e-9) if need else 1.0


def _vectors(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a batch whose vector takes part, their ids and vectors."""
    keep, out = [], []
    for i, v in enumerate(batch.column("embedding").to_pylist()):
        v = None if v is None or any(x is None for x in v) else np.array(v, np.float64)
        if usable(v, size) and batch.column("vec_id")[i].is_valid:
            keep.append(i)
            out.append(v)
    ids = batch.column("vec_id").take(pa.array(keep, pa.int64())).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.array(keep, np.int64), ids, np.stack(out) if out else np.zeros((0, size))


def _top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The k nearest of ``ids`` for each query but itself, by exact distance, then id."""
    for query, v in zip(q_ids.tolist(), q):
        d = np.sqrt(((x - v) ** 2).sum(1))
        d[ids == query] = np.inf
        if len(d) > k:
            edge = np.partition(d, k - 1)[k - 1]
            near = np.flatnonzero(d <= edge)
        else:
            near = np.arange(len(d))
        near = near[np.isfinite(d[near])]
        near = near[np.lexsort((ids[near], d[near]))][:k]
        yield from zip([query] * len(near), ids[near].tolist(), d[near].tolist())


def fit_graph(x: np.ndarray, count: int, k: int) -> CentroidGraph:
    """The graph for ``count`` vectors, of which ``x`` is a sample."""
    graph = CentroidGraph(balanced_kmeans(x, int(min(MOST_CENTROIDS, max(1, count // PER_LIST), max(1, len(x) // 4)))))
    some = x[:: max(1, len(x) // 2000)]
    graph.usual = float(np.sqrt(np.median(distances(some, graph.centres).min(1))))
    graph.calibrate(x, k)
    return graph


def fit(vectors: DataFrame, k: int, sample: int = SAMPLE) -> CentroidGraph | None:
    """A graph on a random sample of about ``sample`` vectors, or ``SAMPLE_EACH`` for each centroid, if that is more; None if none takes part.

    Rows are drawn one by one, so neither a repeated vec_id nor repeated vectors make the sample larger."""
    vectors = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL)")
    count = vectors.count()
    sample = max(sample, SAMPLE_EACH * min(MOST_CENTROIDS, count // PER_LIST))
    share = min(1.0, sample / max(count, 1))
    rows = [np.array(r["embedding"], np.float64) for r in vectors.select("embedding").where(F.rand(5) < share).limit(2 * sample).toLocalIterator()]
    rows = [v for v in rows if usable(v)]
    if not rows:
        return None
    sizes = np.bincount([len(v) for v in rows])
    x = np.stack([v for v in rows if len(v) == sizes.argmax()])
    return fit_graph(x, count, k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest of ``vectors`` (vec_id, embedding) to each of ``queries`` (the same columns),
    but itself: query_id, rank (from 1), vec_id, score, the Euclidean distance in double precision.

    Ties go to the smaller vec_id.  A query gets fewer rows only where ``vectors`` has fewer
    candidates.  Vectors that are null, zero, of another size than most, or hold null or
    non-finite components take no part, nor do null ids.  Rows of one vec_id are one vector; if they
    differ, any of them may be meant.  Extra columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    # Single precision is kept where it is given: the same numbers in half the room.
    single = all(dict(d.dtypes)["embedding"] == "array<float>" for d in (vectors, queries))
    kind = np.dtype("<f4" if single else "<f8")
    vectors, queries = (d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding")) for d in (vectors, queries))
    fitted = fit(vectors, k, sample)
    if fitted is None:
        return spark.createDataFrame([], schema)
    size = fitted.centres.shape[1]

    def route(of: str):
        graph = spark.sparkContext.broadcast(fitted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    _, ids, x = _vectors(batch.slice(at, 2048), size)
                    rows, lists = getattr(graph.value, of)(x)
                    raw = [v.tobytes() for v in x.astype(kind)]
                    first = lists[np.searchsorted(rows, rows)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lists.astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(ids[rows]), pa.array([raw[r] for r in rows], pa.binary())], ["list", "first", "id", "raw"]
                    )

        return run

    entry = "list int, first int, id long, raw binary"
    listed = materialise(vectors.mapInArrow(route("lists_of"), entry), "postings")
    # At most one row for each centroid.  A query may be among the vectors itself.
    for row in listed.groupBy("id").agg(F.min("first").alias("first")).groupBy("first").count().collect():
        fitted.held[row["first"]] = row["count"]
    fitted.wanted = k + 1
    probes = materialise(queries.mapInArrow(route("probes_of"), entry), "probes")
    # Blocks of vectors and of queries: as many to a list as it needs; at most one row for each centroid.
    blocks = lambda of, name: of.groupBy("list").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias(name))
    sizes = F.broadcast(blocks(listed, "blocks").join(blocks(probes, "turns"), "list"))

    def dealt(of: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        """Each row in one block of its own side, and with every block of the other."""
        out = of.join(sizes, "list").withColumn(own, F.pmod(F.xxhash64("id"), F.col(own_n)).cast("int"))
        out = out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
        return out.select("list", "block", "turn", "id", "raw").groupBy("list", "block", "turn")

    def unpack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(rows.column("raw").to_pylist())
        ids, once = np.unique(rows.column("id").to_numpy(), return_index=True)
        return ids, np.frombuffer(raw, kind).reshape(-1, size)[once].astype(np.float64)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(_top(*unpack(right), *unpack(left), k)) if left.num_rows and right.num_rows else []
        columns = list(zip(*found)) if found else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    left, right = dealt(listed, "block", "blocks", "turn", "turns"), dealt(probes, "turn", "turns", "block", "blocks")
    near = left.cogroup(right).applyInArrow(compare, "query_id long, vec_id long, score double")
    # A vector of several lists is found several times, each time at the same distance.
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int = 10) -> dict[int, list[int]]:
    """Brute force, to measure recall against."""
    out: dict[int, list[int]] = {}
    for q in queries.tolist():
        for query, vec, _ in _top(np.array([q]), vectors[ids == q][:1], ids, vectors, k):
            out.setdefault(query, []).append(vec)
    return out
