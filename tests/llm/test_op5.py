import zlib

import numpy as np
import pandas as pd

from tests.llm.common import SF
from tidelog.llm import queries, toxicity
from tidelog.llm.scratch import ship


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((40, net.INPUT))
    size = np.array([64, 1, 30])
    at = rng.integers(0, 40, (toxicity.WINDOW, 3))
    y = np.array([1.0, 0.0, 1.0])
    g, dx, _ = net.gradients(x, at, size, y)

    def loss():
        return net.gradients(x, at, size, y)[2]

    eps = 1e-2
    for target, grad in [(x, dx), *((net.p[k], g[k]) for k in g)]:
        flat, gflat = target.reshape(-1), grad.reshape(-1)
        for k in np.argsort(-np.abs(gflat))[:2]:
            old = flat[k]
            flat[k] = old + eps
            up = loss()
            flat[k] = old - eps
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * eps) - gflat[k]) < 2e-3 + 0.05 * abs(gflat[k])


def test_windows_cover_every_word_and_overlap():
    first, size, owner = toxicity.windows(np.array([0, 0, 5, 69, 134, 1134]))
    seen = set()
    for f, s in zip(first, size):
        seen |= set(range(f, f + s))
    assert seen == set(range(1134))
    assert owner.tolist()[:4] == [1, 2, 3, 3]


def test_held_out_accuracy(spark):
    got = queries.op5_toxicity(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in got.held_out.items())
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").toxic
    own = got.loc[labels.index]
    own = own[own.held_out]
    assert ((own.predicted == labels[own.index]).mean()) > 0.9


def test_edges(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "12 !! ?", 5), (None, "you idiot", 5), (4, "word " * 9000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(4, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(docs, labels) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    net = toxicity.train([b"you idiot fool here", b"a kind word"] * 40, np.array([True, False] * 40))
    rows = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    assert rows[1] == rows[2] == rows[3] == 0.0 and rows[None] > 0.5 and 0 <= rows[4] < 0.5
    assert toxicity.score(docs.limit(0), net).count() == 0
