"""Near-duplicate classes by BagMinHash signatures of weighted word shingles.

A document is the multiset of its runs of five words.  Each shingle carries Poisson processes,
one for each dyadic shell of weights ([0,1), [1,2), [2,4), ...), whose points fall on the
components of the signature; a shingle of weight w owns the points of levels below w, so that
two documents agree on a component with probability sum(min) / sum(max).  Points are drawn in
ascending order and only up to a bound at which all components are filled, so a document
costs its length plus some ``m log m`` points, not their product.

Signatures are cut into bands.  The members of a band key are compared with a leader, the one
that meets the most documents; then, where a key still holds several classes, every member outside
its largest class is compared with all others that it may be linked with.  Which these are follows
from their items: pairs that share items which few documents have are counted by these, and
all others are bounded, mostly unseen, by profiles of what else they have.
A pair is linked if the overlap of its multisets, counted exactly, reaches the threshold.  No link
between two documents of a key is lost, though large groups of near copies are not expanded into
pairs.  Equal texts are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .graph import components
from .scratch import drop, join_counted, materialise

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
#: An item is rare if at most so many of the nodes in question have it.
RARE = 16
#: Pairs of one document, and members of one key, that one task looks at together; more are dealt to several.
BLOCK = 256
#: Numbers in the profile of a node's items: a power of two.
PROFILE = 64


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all shingles of all texts and the text each is of.  A text of fewer words is one shingle."""
    pages = tx.Pages(texts)
    starts, ends = pages.words()
    bounds = pages.text_of(starts)
    n = np.diff(bounds)
    key = tx.word_keys(pages, starts, ends)
    run = key.copy()
    for k in range(1, words):
        left = max(len(key) - k, 0)
        run[:left] = tx.mix(run[:left] * tx.GOLD + key[k:])
    owner = np.repeat(np.arange(len(texts)), n)
    inside = np.flatnonzero(owner[: len(key) - words + 1] == owner[words - 1 :]) if len(key) >= words else np.zeros(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < words))
    if len(few):
        own = [xxhash.xxh3_64_intdigest(b" ".join(texts[k].split())) for k in few]
        return np.concatenate([run[inside], np.array(own, np.uint64)]), np.concatenate([owner[inside], few])
    return run[inside], owner[inside]


def weights(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, owner) and how often each occurs."""
    code, found = pd.factorize(tx.mix(key + (owner.astype(np.uint64) + np.uint64(1)) * tx.GOLD))
    one = np.empty(len(found), np.int64)
    one[code] = np.arange(len(code))
    return key[one], owner[one], np.bincount(code, minlength=len(found))


def signatures(key: np.ndarray, owner: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """BagMinHash signatures, a row for each document; rows of documents without shingles are infinite."""
    out = np.full((docs, m), np.inf)
    total = np.bincount(owner, weight, docs)
    reach = np.divide(m * (np.log(m) + 5), total, out=np.zeros(docs), where=total > 0)
    # A process for each shell that the weight reaches into: seed, rate, lowest level.
    parts = [(key, owner, weight, np.zeros(len(key), np.int64), np.ones(len(key), np.int64))]
    low, shell = 1, 1
    while (big := np.flatnonzero(weight > low)).size:
        parts.append((tx.mix(key[big] + np.uint64(shell * int(tx.GOLD) & (2**64 - 1))), owner[big], weight[big], np.full(len(big), low), np.full(len(big), low)))
        low, shell = 2 * low, shell + 1
    seed, owner, weight, lowest, rate = (np.concatenate(x) for x in zip(*parts))
    begun = np.zeros(docs)
    todo = np.ones(docs, bool)
    while True:
        on = np.flatnonzero(todo[owner])
        s, d, w, lo, r = seed[on], owner[on], weight[on], lowest[on], rate[on]
        x, i = np.zeros(len(s)), 0
        while len(s):
            i += 1
            draw = tx.mix(s + np.uint64((2 * i * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            x = x - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / r
            near = np.flatnonzero(x <= reach[d])
            s, d, w, lo, r, x = s[near], d[near], w[near], lo[near], r[near], x[near]
            place = tx.mix(draw[near] ^ np.uint64(0xC2B2AE3D27D4EB4F))
            level = lo + (place & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * r
            mine = np.flatnonzero((level < w) & (x > begun[d]))
            slot = (place[mine] >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
            np.minimum.at(out.reshape(-1), d[mine] * m + slot.astype(np.int64), x[mine])
        todo = (total > 0) & np.isinf(out).any(1)
        if not todo.any():
            return out
        begun = np.where(todo, reach, begun)
        reach = reach * 2


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, a digest of its words (null: none), keys of its bands."""
    m = BANDS * ROWS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in tx.in_slices((t.as_py() for t in batch.column(1)), 2 << 20):
                key, owner = shingles(texts)
                signed = signatures(*weights(key, owner), len(texts), m)
                # The upper bits, so that a last bit that depends on a machine's logarithm does no harm.
                bits = signed.view(np.uint64) >> np.uint64(20)
                band = np.zeros((len(texts), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for k in range(ROWS):
                    band = tx.mix(band * tx.GOLD + bits[:, k::ROWS])
                full = np.isfinite(signed[:, 0]).tolist()
                words = [xxhash.xxh3_128_digest(b" ".join(t.split())) if f else None for t, f in zip(texts, full)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(words, pa.binary()),
                        pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * BANDS, pa.array(band.view(np.int64).reshape(-1))),
                    ],
                    ["doc_id", "words", "bands"],
                )
                at += len(texts)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(sign, "doc_id long, words binary, bands array<long>")


def multisets(docs: DataFrame) -> DataFrame:
    """node, bag: the sorted 64-bit keys of (shingle, which occurrence) of each document."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in tx.in_slices((t.as_py() for t in batch.column(1)), 2 << 20):
                key, owner = shingles(texts)
                order = np.lexsort((key, owner))
                key, owner = key[order], owner[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]) if len(key) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                nth = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
                item = tx.mix(key + nth.astype(np.uint64) * tx.GOLD)
                item = item[np.lexsort((item, owner))]
                bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
                bags = [item[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(bags, pa.binary())], ["node", "bag"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("text")).mapInArrow(expand, "node long, bag binary")


def common_items(a: np.ndarray, b: np.ndarray) -> int:
    """sum(min) of two multisets, given as sorted keys of their items."""
    if not len(a) or not len(b):
        return 0
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def _with_bags(pairs: DataFrame, bags: DataFrame, of: str, other: str) -> DataFrame:
    """``pairs`` with the bag of ``of``; a document with very many pairs is dealt to several tasks, each with a copy of its bag."""
    counted = pairs.groupBy(of).agg(F.count("*").alias("n"))
    counted = materialise(counted.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "pairs-of")
    dealt = join_counted(pairs, counted, [of]).withColumn("block", F.pmod(F.xxhash64(other), F.col("blocks")).cast("int")).drop("blocks")
    own = bags.toDF(of, f"bag_{of}").join(counted.select(of, "blocks"), of)
    own = own.select(of, f"bag_{of}", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return dealt.join(own, [of, "block"]).drop("block")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [[np.frombuffer(x.as_buffer(), np.uint64) for x in row] for row in zip(batch.column("bag_a"), batch.column("bag_b"))]
        columns = [[common_items(x, y) for x, y in pairs], [len(x) for x, _ in pairs], [len(y) for _, y in pairs]]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c, pa.int64()) for c in columns)], ["a", "b", "both", "na", "nb"])


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, class_id, the least doc_id of its class.

    Documents are in one class if links (equal words, or overlap of ``threshold`` or more) connect
    them.  A text without words is in a class of its own; a row without doc_id has no class
    (null).  Rows of one doc_id count as one document.  Extra columns are ignored.
    """
    signed = materialise(fingerprints(docs), "signatures")
    worded = signed.where("doc_id IS NOT NULL AND words IS NOT NULL")
    nodes = materialise(worded.groupBy("words").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(keyed.join(shared, "key").select("key", "node", "n"), "members")
    # How many documents a node meets: an original meets more than its copies meet each other.
    met = materialise(members.groupBy("node").agg(F.sum("n").alias("met")), "met")
    bags = materialise(multisets(docs.join(met.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")), "bags")

    def measured(pairs: DataFrame) -> DataFrame:
        """a, b, how many items both have, and how many each."""
        own = _with_bags(pairs, bags, "a", "b")
        own = _with_bags(own, bags, "b", "a")
        return materialise(own.select("a", "b", "bag_a", "bag_b").mapInArrow(_measure, "a long, b long, both long, na long, nb long"), "measured")

    def fits(shared, n, m):
        """Whether multisets of sizes n and m that share so many items reach the threshold."""
        return shared / F.greatest(n + m - shared, F.lit(1)) >= threshold

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.where(fits(F.col("both"), F.col("na"), F.col("nb")) & (F.col("both") > 0)).select("a", "b")

    def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
        """Labels after the labels of each edge (a, b) have become one."""
        least = components(edges).toDF("_label", "_least")
        after = labels.join(least, labels["label"] == least["_label"], "left")
        return materialise(after.select("node", F.coalesce("_least", "label").alias("label")), "labels")

    pair = F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")
    leaders = members.join(met, "node").groupBy("key").agg(F.max_by("node", F.struct("met", -F.col("node"))).alias("leader"))
    led = join_counted(members, leaders.join(shared, "key"), ["key"])
    tested = measured(led.where("node <> leader").select(*pair).distinct())
    labels = merged(met.select("node", F.col("node").alias("label")), linked(tested))

    # What is left of each key: its members, if they are in several classes, but for the largest class.
    known = members.select("key", "node").join(labels, "node")
    sizes = known.groupBy("key", "label").agg(F.count("*").alias("n"))
    found = sizes.groupBy("key").agg(F.count("*").alias("labels"), F.max_by("label", "n").alias("largest")).where("labels > 1")
    open_ = materialise(known.join(found, "key").select("key", "node", "label", "largest"), "open")
    rare = materialise(_rare_items(bags, open_.select("node", "label").distinct()), "rare")
    # Of each node: how many items it has, how many that aren't rare, and these by the last bits of their keys.
    mine = F.col("item").bitwiseAND(PROFILE - 1)
    rare_by = rare.groupBy("node").agg(F.count("*").alias("rare"), F.array(*(F.count_if(mine == k) for k in range(PROFILE))).alias("rare_profile"))
    room = bags.join(open_.select("node").distinct(), "node", "left_semi").select("node", "bag").mapInArrow(_profiles, "node long, size long, every array<long>")
    room = room.groupBy("node").agg(F.max("size").alias("size"), F.max("every").alias("every")).join(rare_by, "node", "left")
    rest = F.when(F.col("rare").isNull(), F.col("every")).otherwise(F.zip_with("every", "rare_profile", lambda x, y: x - y))
    room = materialise(room.select("node", "size", (F.col("size") - F.coalesce("rare", F.lit(0))).alias("common"), rest.alias("profile")), "room")

    # Pairs that share rare items, and how many; with these they may reach the threshold.
    twin = rare.where("n > 1")
    met_by = twin.toDF("item", "a", "la", "n").drop("n").join(twin.toDF("item", "b", "lb", "n").drop("n"), "item").where("a < b AND la <> lb")
    met_by = met_by.groupBy("a", "b").agg(F.count("*").alias("rare"))
    met_by = met_by.join(room.select("node", "size", "common").toDF("a", "na", "ca"), "a").join(room.select("node", "size", "common").toDF("b", "nb", "cb"), "b")
    by_rare = met_by.where(fits(F.col("rare") + F.least("ca", "cb"), F.col("na"), F.col("nb"))).select("a", "b")
    # Pairs of one key that share no rare item: of the others at most the lesser number for each ending of the keys.
    before = open_
    open_ = materialise(open_.join(room, "node").select("key", "node", "label", "largest", "size", "common", "profile"), "open")
    smallest = open_.groupBy("key").agg(F.min("size").alias("smallest"))
    others = open_.where("label <> largest").join(smallest, "key")
    others = others.where(fits(F.col("common"), F.col("size"), F.greatest("smallest", threshold * F.col("size"))))
    others = others.select("key", F.col("node").alias("leader"), *(F.col(c).alias(f"_{c}") for c in ("label", "size", "common", "profile")))
    shared = F.aggregate(F.zip_with("profile", "_profile", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda a, x: a + x)
    may = (F.col("label") != F.col("_label")) & fits(F.least("common", "_common"), F.col("size"), F.col("_size")) & fits(shared, F.col("size"), F.col("_size"))
    # A key's members and those it holds outside its largest class meet in blocks, each of the one with each of the other.
    sizes = open_.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("largest")).alias("m"))
    sizes = materialise(sizes.select("key", "n", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(f"of_{c}") for c in "nm")), "sizes")
    part = lambda node, n: F.pmod(F.xxhash64(node), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = join_counted(open_, sizes, ["key"]).withColumn("block", part("node", "of_n")).withColumn("turn", every("of_m"))
    right = join_counted(others, sizes, ["key"]).withColumn("turn", part("leader", "of_m")).withColumn("block", every("of_n"))
    by_key = left.join(right.drop("of_n", "of_m"), ["key", "block", "turn"]).where(may).select(*pair)
    pairs = materialise(by_rare.union(by_key).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    drop(members, met, before, open_, rare, room, sizes, tested)
    if pairs.limit(1).count():
        ends = linked(measured(pairs)).join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b")
        labels = merged(labels, ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    classed = nodes.select("words", "node").join(labels, "node", "left").select("words", F.coalesce("label", "node").alias("class_id"))
    drop(bags, pairs)
    out = signed.select("doc_id", "words").join(classed, "words", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each multiset its size and how many of its items have each ending."""
    for batch in batches:
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("bag")]
        ends = [np.bincount((x & np.uint64(PROFILE - 1)).astype(np.int64), minlength=PROFILE).tolist() for x in own]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(x) for x in own], pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["node", "size", "every"])


def _rare_items(bags: DataFrame, nodes: DataFrame) -> DataFrame:
    """item, node, label, n: items that at most RARE of the nodes (node, label) have, and how many do."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("bag")]
            row = np.repeat(np.arange(len(own)), [len(x) for x in own])
            flat = np.concatenate(own) if own else np.zeros(0, np.int64)
            for at in range(0, len(flat), 100_000):
                part = pa.array(row[at : at + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(flat[at : at + 100_000]), batch.column("node").take(part), batch.column("label").take(part)], ["item", "node", "label"])

    every = bags.join(nodes, "node").select("node", "label", "bag").mapInArrow(items, "item long, node long, label long")
    count = every.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") <= RARE)
    return every.join(count, "item").select("item", "node", "label", "n")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose id is that of their class; rows without doc_id stay.

    Rows of one doc_id are one document; where they differ in words, all of them are in one class and stay.
    """
    found = classes(docs, threshold).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
