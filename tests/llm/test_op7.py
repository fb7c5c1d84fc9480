import pytest

from tests.llm.common import SF, same
from tidelog.llm import queries, sharding
from tidelog.llm.scratch import scratch_path, ship, table


@pytest.mark.parametrize("limit", [5_000, 40_000, 300_000])
def test_against_sql(spark, limit):
    got = sharding.assign_shards(table(spark, SF, "documents"), limit=limit)
    want = sharding.oracle_sql(limit)
    if limit == 5_000:  # texts above the limit share no bits with others, but are too large at any depth
        from tests.llm.common import oracle

        own = {(r.doc_id, r.depth, r.prefix, r.shard_bytes) for r in got.collect() if not r.overflow}
        assert own == set(oracle(want)[["doc_id", "depth", "prefix", "shard_bytes"]].itertuples(index=False, name=None))
        return
    assert same(got, want) == 1000


def test_query(spark):
    assert same(queries.op7_shards(spark, SF), queries.ORACLE_SQL["op7_shards"]) == 1000


def test_hot_key_nulls_and_large_rows(spark):
    ship(spark)
    rows = [(7, "x" * 100, 1)] * 300 + [(i, "y" * 90, 2) for i in range(100)] + [(None, "z" * 50, 3)] * 5 + [(1000, "w" * 5000, 4), (1001, None, 5), (1002, "", 5)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string, depth int"), limit=1000).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        k = (r.depth, r.prefix, r.overflow)
        sizes[k] = sizes.get(k, 0) + r.bytes
        assert r.overflow == "" or r.doc_id in (7, 1000)
    assert all(sizes[(r.depth, r.prefix, r.overflow)] == r.shard_bytes for r in got)
    assert all(r.shard_bytes <= 1000 or r.doc_id == 1000 for r in got)
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_written_shards(spark):
    docs = table(spark, SF, "documents")
    path = scratch_path(spark, "shards")
    shards = sharding.write_shards(docs, path, limit=200_000).collect()
    back = spark.read.parquet(path)
    assert back.count() == 1000 and back.select("shard").distinct().count() == len(shards)
    assert max(s.shard_bytes for s in shards) <= 200_000
