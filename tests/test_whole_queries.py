"""Queries that take every row of their tables: the numbers of rows, without their SQL."""

from tests.oracle import SF, oracle
from tidelog import queries


def test_live_wals_fold_all_edits(spark):
    bound = oracle("SELECT max(event_id // 2 - CASE WHEN event_id % 5 = 0 THEN 40 ELSE 0 END) // 20 AS b FROM events WHERE event_id % 13 = 0").b[0]
    last = oracle("SELECT max(event_id) // 20 AS l FROM events")["l"][0]
    got = sorted(r.wal_id for r in queries.QUERIES["q21b_live_wals_all_edits"](spark, SF).collect())
    assert got == list(range(bound, last + 1)) and 0 < bound < last


def test_every_probe_is_looked_up(spark):
    rows = oracle("SELECT (SELECT count(*) FROM customer) AS q03c_multi_get_all_customers, (SELECT count(*) FROM orders) AS q03d_multi_get_all_orders, (SELECT count(*) FROM events) AS q14b_asof_block_all_events")
    for name in rows:
        assert queries.QUERIES[name](spark, SF).count() == rows[name][0]


def test_whole_texts_are_measured(spark):
    got = {r.doc_id: (r.key_bytes, r.value_bytes) for r in queries.QUERIES["q27b_size_guard_whole_texts"](spark, SF).collect()}
    texts = oracle("SELECT doc_id, strlen(text) AS n FROM documents WHERE strlen(text) > 16384 OR strlen(text) * 40 > 131072")
    assert got == {int(d): (int(n), int(n) * 40) for d, n in zip(texts.doc_id, texts.n)} and any(n > 16384 for n in texts.n)
