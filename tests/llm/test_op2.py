import random
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import near_dedup
from tidelog.llm.scratch import ship


def bag(text):
    w = (text or "").encode().split()
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1)))


def share(a, b):
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def brute(rows):
    """The class of each doc_id by all pairs."""
    bags = {}
    for d, t in rows:
        if d is not None:
            bags.setdefault(d, []).append(bag(t))
    up = {d: d for d in bags}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and share(x, y) >= 0.8 for x in bags[a] for y in bags[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {d: root(d) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows, doc = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.randint(1, 250))]
        for _ in range(rng.randint(1, 6)):
            new = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                new[rng.randrange(len(new))] = word()
            rows.append((doc, " ".join(new)))
            doc += 1
    chain = [word() for _ in range(300)]
    for _ in range(30):  # each near the one before, the ends far apart
        at = rng.randrange(280)
        chain = chain[:at] + [word() for _ in range(20)] + chain[at + 20 :]
        rows.append((doc, " ".join(chain)))
        doc += 1
    hot = [word() for _ in range(120)]
    for k in range(60):
        new = list(hot)
        new[rng.randrange(120)] = f"w{k}"
        rows.append((doc, " ".join(new)))
        doc += 1
    rows += [(doc + i, t) for i, t in enumerate([None, "", " \n", "one", "one", "one  two", "one two", "a b c d", "echo " * 500, "echo " * 480, "echo " * 300])]
    rows += [(None, rows[0][1]), (None, "one"), (3, rows[3][1]), (3, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_all_pairs(spark, seed):
    ship(spark)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, class_id string")
    got = near_dedup.classes(docs).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert all(r.class_id is None for r in got if r.doc_id is None)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in rows if d is None or want[d] == d)


def test_empty_table(spark):
    ship(spark)
    assert near_dedup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    key = rng.integers(0, 2**63, 400).astype(np.uint64)
    wa, wb = rng.integers(1, 40, 400), rng.integers(1, 40, 400)
    m = 4096
    both = near_dedup.signatures(np.concatenate([key, key]), np.repeat([0, 1], 400), np.concatenate([wa, wb]), 2, m)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((both[0] == both[1]).mean() - true) < 4 * (true * (1 - true) / m) ** 0.5
    alone = near_dedup.signatures(key, np.zeros(400, np.int64), wa, 1, m)
    assert (alone[0] == both[0]).all()
