import numpy as np
import pandas as pd
import pytest

from tests.llm.common import SF
from tidelog.llm import posting_ann, queries
from tidelog.llm.scratch import ship


def recall(got, x, ids, asked, k=10):
    want = posting_ann.exact(x, ids, asked, k)
    found = got.groupby("query_id").vec_id.apply(set).to_dict()
    return np.mean([len(found.get(q, set()) & set(w)) / len(w) for q, w in want.items()])


def check(got, x, ids, asked, k=10):
    at = {i: n for n, i in enumerate(ids.tolist())}
    for q, rows in got.sort_values("rank").groupby("query_id"):
        assert rows["rank"].tolist() == list(range(1, len(rows) + 1)) and len(rows) <= k
        want = np.sqrt(((x[[at[v] for v in rows.vec_id]] - x[at[q]]) ** 2).sum(1))
        assert (rows.score.to_numpy() == want).all() and q not in set(rows.vec_id)
        assert list(zip(rows.score, rows.vec_id)) == sorted(zip(rows.score, rows.vec_id))
        assert not rows.vec_id.duplicated().any()


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_query(spark, sf):
    df = pd.read_parquet(f"{sf}/embeddings.parquet")
    x, ids = np.stack(df.embedding).astype(np.float64), df.vec_id.to_numpy()
    asked = ids[ids % 100 == 0]
    got = queries.op8_nearest(spark, sf).toPandas()
    assert len(got) == 10 * len(asked)
    check(got, x, ids, asked)
    assert recall(got, x, ids, asked) >= 0.9


def test_copies_and_clusters(spark, monkeypatch):
    ship(spark)
    rng = np.random.default_rng(1)
    x = np.concatenate([c + 0.1 * rng.standard_normal((100, 16)) for c in rng.standard_normal((40, 16))] + [np.repeat(rng.standard_normal((1, 16)), 1500, 0)])
    ids = rng.permutation(len(x)).astype(np.int64)
    docs = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, score int")
    asked = ids[ids % 50 == 0]
    got = posting_ann.search(docs, docs.where("vec_id % 50 = 0")).toPandas()
    check(got, x, ids, asked)
    assert recall(got, x, ids, asked) >= 0.95
    copies = set(ids[-1500:].tolist())
    for q, rows in got.groupby("query_id"):
        if q in copies:
            assert sorted(rows.vec_id) == sorted(copies - {q})[:10] and (rows.score == 0).all()


def test_edges(spark):
    ship(spark)
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [0.0, 1.0]), (8, [1.0]), (None, [1.0, 0.0]), (9, []), (10, [1.0, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in posting_ann.search(docs, docs).collect()}
    assert got == {(1, 1): (10, 0.0), (1, 2): (7, 2**0.5), (7, 1): (1, 2**0.5), (7, 2): (10, 2**0.5), (10, 1): (1, 0.0), (10, 2): (7, 2**0.5)}
    assert posting_ann.search(docs.limit(0), docs).count() == 0
    assert posting_ann.search(docs.where("vec_id = 1"), docs.where("vec_id = 1")).count() == 0


def test_far_groups_and_outliers(spark):
    """Groups with fewer than k others far from all else, a lone outlier, and rows repeated under one vec_id."""
    ship(spark)
    rng = np.random.default_rng(3)
    blob, group, lone = rng.standard_normal((1990, 16)), 200 + 0.01 * rng.standard_normal((8, 16)), np.full((1, 16), -900.0)
    x = np.concatenate([blob, group, lone, 500 + 0.01 * rng.standard_normal((1, 16))])
    ids = rng.permutation(len(x)).astype(np.int64)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    docs = spark.createDataFrame(rows + 30 * rows[-1:], "vec_id long, embedding array<double>")
    asked = np.concatenate([ids[-10:], ids[:1990:50]])
    got = posting_ann.search(docs, spark.createDataFrame([(int(i),) for i in asked], "vec_id long").join(docs.dropDuplicates(["vec_id"]), "vec_id")).toPandas()
    check(got, x, ids, asked)
    assert got.groupby("query_id").size().to_dict() == {int(q): 10 for q in asked}
    far = ids[-10:]
    assert recall(got[got.query_id.isin(far)], x, ids, far) == 1
    few = spark.createDataFrame(rows[-5:], "vec_id long, embedding array<double>")
    assert posting_ann.search(few, few).count() == 20


def blobs(rng, groups, size, width=16):
    return np.concatenate([c + 0.05 * rng.standard_normal((size, width)) for c in rng.standard_normal((groups, width))])


def compared(x, k=10):
    """Lists of all vectors, and the share of the table that a query is compared with."""
    graph = posting_ann.fit_graph(x, len(x), k)
    rows, lists = graph.lists_of(x)
    size = np.bincount(lists, minlength=len(graph.centres))
    asked, probed = graph.probes_of(x[::20])
    member = [np.unique(rows[lists == c]) for c in range(len(graph.centres))]
    share = [len(np.unique(np.concatenate([member[c] for c in probed[asked == q]]))) / len(x) for q in range(len(x[::20]))]
    return graph, size, np.mean(share)


def test_lists_are_balanced():
    """No list is much longer than the mean, with outliers and one very dense region too; clustered vectors are compared with few others."""
    rng = np.random.default_rng(2)
    uneven = np.concatenate([blobs(rng, 60, 50), 0.3 + 0.05 * rng.standard_normal((3000, 16)), 50 * rng.standard_normal((5, 16))])
    uniform = rng.standard_normal((4000, 64))
    uniform /= np.linalg.norm(uniform, axis=1)[:, None]
    for name, x in (("clusters", blobs(rng, 80, 50)), ("uneven", uneven), ("uniform", uniform)):
        graph, size, share = compared(x)
        plain = np.bincount(posting_ann._nearest(x, graph.centres)[0], minlength=len(graph.centres))
        assert len(graph.centres) > 0.5 * len(x) / posting_ann.PER_LIST, name
        assert plain.max() <= 3 * plain.mean() and size.max() <= 4 * size.mean(), (name, plain.max(), plain.mean(), size.max(), size.mean())
        if name == "clusters":
            assert share < 0.2, share


def test_sample_is_bounded(spark):
    """Null ids and one much repeated id neither fill the sample nor the driver."""
    ship(spark)
    rng = np.random.default_rng(1)
    rows = [(None if i < 2000 else 7 if i < 4000 else i, v.tolist()) for i, v in enumerate(rng.standard_normal((6000, 8)))]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = []
    fit_graph = posting_ann.fit_graph
    try:
        posting_ann.fit_graph = lambda x, count, k: seen.append((len(x), count)) or fit_graph(x, count, k)
        posting_ann.fit(docs, 10, sample=600)
    finally:
        posting_ann.fit_graph = fit_graph
    assert seen[0][1] == 4000 and 480 < seen[0][0] < 720
