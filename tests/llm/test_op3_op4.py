import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tests.llm.common import SF, same
from tidelog.llm import line_dedup, quality, queries, trees
from tidelog.llm.scratch import materialise, ship

L = "This line is long enough to be looked at by the operator, %d."


def test_op3_against_sql(spark):
    assert same(queries.op3_line_dedup(spark, SF), queries.ORACLE_SQL["op3_line_dedup"]) == 1000


@pytest.fixture(scope="module")
def lines(spark):
    ship(spark)
    rows = [(i, "\n".join([L % 1, f"own {i}", (L % 2).upper() + " \t", "short", "short"])) for i in range(6)]
    rows += [(10, L % 2 + "\n\n" + L % 3), (11, L % 3), (12, None), (13, ""), (14, "ü" * 39 + "\n" + "ü" * 40)]
    rows += [(20 + i, "ü" * 40 + "\n" + "é" * 39 + "\n" + (L % 1).lower()) for i in range(4)]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_lines string")


@pytest.mark.parametrize("way", [{}, {"chunk": 256}, {"broadcast_keys": 0}, {"chunk": 64, "broadcast_keys": 0}])
def test_op3_ways(spark, lines, way):
    from pyspark.sql import functions as F

    out = line_dedup.dedup_lines(lines, **way)
    digest = out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    assert same(digest, line_dedup.ORACLE_SQL, documents=lines.toPandas()) == 15
    assert out.where("doc_id = 0").first().text == "own 0\nshort\nshort"


@pytest.mark.parametrize("way", [{}, {"broadcast_keys": 0}])
def test_op3_repeated_and_null_rows(spark, way):
    """Rows of one doc_id are one document, and those without one are the smallest."""
    ship(spark)
    rows = [(7, L % 1)] * 3 + [(None, L % 1)] * 2 + [(k, L % 1) for k in (1, 2, 3)] + [(None, "x" * 50)] * 5 + [(8, "y" * 50)] * 5 + [(1, "z " * 1_000_000)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), **way).collect()
    assert sorted((str(r.doc_id), r.n_dropped) for r in out) == sorted([("7", 0)] * 3 + [("None", 1)] * 2 + [(k, 1) for k in "123"] + [("None", 0)] * 5 + [("8", 0)] * 5 + [("1", 0)])
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string"), **way).count() == 0


def test_op3_filters_of_small_chunks(spark):
    """A thousandth of a chunk: many owners, and all rows as by SQL."""
    got = line_dedup.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet"), chunk=256)
    digest = got.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(CAST(text AS BINARY), 256) AS kept_sha256")
    assert same(digest, line_dedup.ORACLE_SQL) == 1000
    lines = materialise(line_dedup.long_lines(spark.read.parquet(f"{SF}/documents.parquet"), 40), "lines")
    of = lines.groupBy("low").count()
    known = line_dedup.suspects(lines)
    assert known.join(of, "low").where("n <> count").count() == 0 and known.count() == known.select("low").distinct().count()
    assert of.where("count > 1").join(known, "low", "left_anti").count() == 0 and known.join(of, "low").where("count = 1").count() < 0.05 * of.count()


def test_op3_seen_twice():
    rng = np.random.default_rng(1)
    every = rng.integers(0, 2**63, 1000).astype(np.uint64)
    parts = [(every[:600], np.where(np.arange(600) < 50, 2, 1)), (every[500:], np.ones(500, int))]
    found = set(line_dedup.seen_twice(parts, 1 << 14).tolist())
    true = set(every[:50].tolist()) | set(every[500:600].tolist())
    assert true <= found and len(found - true) < 20


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(zip(words, words[1:], words[2:]))
    cover = {i + k for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)]


EDGE = [None, "", " \n\t", "a b c a b c", "é é é é é", "x" * 40 + " y\n\n" + "x" * 40 + " y", "a\x0bb\x0cc\x1cd e", "l\nl\n l\nl", "#*$%&|<> 日本 語", "abc " * 3000]


def test_op4_statistics():
    counts, features = quality.all_statistics([None if t is None else t.encode() for t in EDGE])
    assert counts.tolist() == [brute(t) for t in EDGE]
    assert np.isfinite(features).all()


def test_op4_query(spark):
    got = queries.op4_quality_rules(spark, SF).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    for d, r in got.iterrows():
        want = brute(docs.text[d])
        assert r[quality.COUNTS].tolist() == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").quality
    judged = got.loc[labels.index]
    judged = judged[~judged.base_failed]
    assert ((judged.kept == (labels[judged.index] == 1)).mean()) > 0.95


def test_op4_edges(spark):
    ship(spark)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(EDGE)] + [(None, "x", 1)], "doc_id long, text string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit_quality(docs, none) is None
    rows = quality.judge(docs, None).collect()
    assert len(rows) == len(EDGE) + 1 and not any(r.kept for r in rows)
    assert quality.judge(docs.limit(0), None).count() == 0


def test_trees_are_monotonic_and_fit():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(20 * x[:, 1]) + 0.1 * rng.standard_normal(3000)) > 0.5).astype(float)
    f = trees.fit(x, y, np.array([1, 0, -1]))
    assert ((f.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    grid = np.linspace(0, 1, 200)
    for row in x[:50]:
        for k, sign in ((0, 1), (2, -1)):
            probe = np.repeat(row[None], 200, 0)
            probe[:, k] = grid
            assert (sign * np.diff(f.score(probe)) >= -1e-12).all()
