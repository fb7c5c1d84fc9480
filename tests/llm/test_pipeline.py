import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.common import SF
from tests.llm.test_op2 import brute as classes_of
from tidelog.llm import quality, surrogates
from tidelog.llm.queries import WORD_BPE
from tidelog.llm.scratch import materialise, ship


def lines_of(rows):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for d, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 40:
                holders.setdefault(k, []).append(d)
    keep = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    return [(d, "\n".join(x for x in t.split("\n") if keep.get(key(x), d) == d)) for d, t in rows]


@pytest.fixture
def key(spark):
    spark.conf.set(surrogates.KEY_SETTING, "a key")
    yield
    spark.conf.unset(surrogates.KEY_SETTING)


def test_stages_against_a_plain_version(spark, key):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "minhash_near_dedup", "pii_surrogates", "best_fit_packing"]

    good = materialise(stages["quality_rules"](spark, docs, SF), "t")
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").quality
    kept = set(good.toPandas().doc_id)
    own = [(labels[d] == 1) == (d in kept) for d in labels.index]
    forest = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept == {r.doc_id for r in quality.judge(docs, forest).where("kept").collect()} and np.mean(own) > 0.85

    lined = materialise(stages["line_dedup"](spark, good, SF), "t")
    rows = [(r.doc_id, r.text) for r in good.collect()]
    plain = lines_of(rows)
    assert sorted((r.doc_id, r.text) for r in lined.collect()) == sorted(plain)

    near = materialise(stages["minhash_near_dedup"](spark, lined, SF), "t")
    short = [(d, t) for d, t in plain if len(t) < 4000]  # all pairs of the shorter texts
    want = classes_of(short)
    left = {r.doc_id for r in near.collect()}
    # A class may reach into the longer texts at the edge of this selection, once at most here.
    assert len([d for d, c in want.items() if (c == d) != (d in left)]) <= 1

    safe = materialise(stages["pii_surrogates"](spark, near, SF), "t")
    assert {r.doc_id for r in safe.collect()} == left
    for df in (good, lined, near, safe):
        assert df.columns == names and dict(df.dtypes) == dict(docs.dtypes)
    assert safe.where("n_chars <> length(text)").count() == 0

    packed = stages["best_fit_packing"](spark, safe, SF).collect()
    coder = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for r in safe.collect():
        ids = [*coder.encode(r.text, add_special_tokens=False).ids, 0]
        want.update((r.doc_id, p, a, zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in packed) == want
    whole = Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert whole == want


def test_null_and_repeated_rows_pass_every_stage(spark, tmp_path):
    ship(spark)
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text, None, None, None), (None, text, "en", "s", 5), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == {1: 2, None: 1}
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
