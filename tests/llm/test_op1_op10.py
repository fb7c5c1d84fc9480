import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelog.llm import packing, simple8b, token_files
from tidelog.llm.encoder import WordEncoder
from tidelog.llm.queries import WORD_BPE
from tidelog.llm.scratch import ship

TEXTS = [
    "The cat sat, didn't it?\nThe  cat\tagain. Über-größe naïve 1234 12.5% <|endoftext|> a<|endoftext|>b x\x1cy  z w été",
    "",
    None,
    "antidisestablishmentarianism pneumonoultramicroscopicsilicovolcanoconiosis " * 40,
    "I'LL we're İstanbul ΣΟΦΟΣ ﬁne 日本語テキスト 🙂🙂 " * 5,
    "word " * 5000,
    "   \n\t ",
]


def plain(text):
    return Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    coder = WordEncoder(WORD_BPE)
    for _ in range(2):
        got = list(coder.encode([None if t is None else t.encode() for t in TEXTS]))
        assert [g.tolist() for g in got] == [plain(t) for t in TEXTS]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_encoder_on_any_text(texts):
    coder = WordEncoder(WORD_BPE)
    assert [g.tolist() for g in coder.encode([t.encode() for t in texts])] == [plain(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3) | st.integers(0, 70000), max_size=3000))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, starts, odd = simple8b.encode(v)
    assert (simple8b.decode(words, starts, len(v), odd) == v).all()


def test_simple8b_blocks_and_density():
    v = np.random.default_rng(1).integers(0, 2, 5000).astype(np.uint64)
    words, starts, odd = simple8b.encode(v)
    assert len(starts) == 5 and len(words) <= 5 * 18 and not len(odd)


def fewest(lengths, cap):
    best = len(lengths)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[k] <= cap:
                go(k + 1, [*bins[:j], bins[j] + lengths[k], *bins[j + 1 :]])
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_instances():
    rng = random.Random(3)
    for _ in range(150):
        cap = rng.choice([10, 20, 50])
        lengths = sorted((rng.randint(1, cap) for _ in range(rng.randint(1, 10))), reverse=True)
        counts = {l: lengths.count(l) for l in lengths}
        solver = packing.BinCompletion(counts, cap)
        patterns = solver.solve()
        used = {}
        for p, n in patterns:
            assert sum(l * u for l, u in p) <= cap
            for l, u in p:
                used[l] = used.get(l, 0) + u * n
        assert used == counts
        assert sum(n for _, n in patterns) == fewest(lengths, cap) >= solver.bound


def test_bin_completion_is_no_worse_than_best_fit():
    rng = random.Random(5)
    better = 0
    for _ in range(60):
        counts = {rng.randint(15, 60): rng.randint(1, 6) for _ in range(8)}
        first = sum(n for _, n in packing.best_fit(counts, 100))
        found = sum(n for _, n in packing.BinCompletion(counts, 100, nodes=3000).solve())
        assert packing.lower_bound(counts, 100) <= found <= first
        better += found < first
    assert better


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "again again", "y"), (None, "no id", None), (3, "again again", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")


def test_pack_documents(spark, docs):
    rows = packing.pack_documents(docs, WORD_BPE, capacity=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in enumerate(TEXTS):
        if i == 3:
            continue
        ids = [*plain(t), 0]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in mine] == list(range(0, len(ids), 64))
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + 64], "<u4").tobytes())
    assert len(by) >= packing.lower_bound({l: sum(r.length == l for r in rows) for l in {r.length for r in rows}}, 64)
    assert packing.pack_documents(docs.limit(0), WORD_BPE).count() == 0


def test_token_files(spark, docs):
    folder = token_files.token_folder(docs)
    manifest = token_files.write_token_files(docs, folder, WORD_BPE)
    got = sorted(token_files.read_token_files(manifest, folder).collect(), key=lambda r: r.start)
    ids = {i: [*plain(t), 2] for i, t in enumerate(TEXTS)}
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: -1 if x is None else x)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id not in (3, None):
            assert (r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
    whole = {r.doc_id: r.ids for r in token_files.read_token_files(manifest, folder, digest=False).collect()}
    assert whole[0] == ids[0]
    empty = token_files.token_folder(docs)
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), empty, WORD_BPE), empty).count() == 0


def test_damaged_token_files(tmp_path):
    """Any flipped byte, and any cut, is found before an id is read."""
    folder = f"file://{tmp_path}"
    file = token_files.TokenFile(folder, "a.s8b")
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in (0, 5, 300, 1)]
    for k, ids in enumerate(docs):
        file.add(None if k == 3 else k, ids)
    path = file.close()
    back = list(token_files.TokenReader(folder, path).documents())
    assert [d for d, _ in back] == [0, 1, 2, None] and all((a == b).all() for (_, a), b in zip(back, docs))
    whole = open(path, "rb").read()
    for at in [*range(0, len(whole), 13), len(whole) - 1]:
        open(path, "wb").write(whole[:at] + bytes([whole[at] ^ 4]) + whole[at + 1 :])
        with pytest.raises((ValueError, OSError)):
            token_files.TokenReader(folder, path)
    open(path, "wb").write(whole[:-9])
    with pytest.raises((ValueError, OSError)):
        token_files.TokenReader(folder, path)
