import random
import time
import zlib
from itertools import product

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.common import SF
from tidelog.llm import nbest, queries
from tidelog.llm.scratch import ship

PATH = public_tokenizers.path("piece_bpe_32k.model")
M = nbest.PieceModel(PATH)


def brute(text):
    """All segmentations of a short text, best first: (score, ids)."""
    if not text:
        return [(0.0, [])]
    s = " " + text
    s = "".join("\0" if c == "▁" else "▁" if c == " " else c for c in s)
    ids = {p: i for i, p in enumerate(M.pieces) if i > 258}
    out = []

    def go(at, score, path):
        if at == len(s):
            out.append((score, path))
            return
        for n in range(1, 17):
            if at + n <= len(s) and (i := ids.get(s[at : at + n])) is not None:
                go(at + n, score + M.score[i], [*path, i])
        if s[at] not in ids:
            raw = ("▁" if s[at] == "\0" else s[at]).encode()
            go(at + 1, score + M.unknown, [*path, *(M.byte_ids[b] for b in raw)])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def check(text, n):
    want = brute(text)
    got = M.segmentations(text.encode(), n)
    assert np.allclose([g[0] for g in got], [w[0] for w in want[:n]], rtol=1e-12)
    every = [(w[0], list(w[1])) for w in want]
    seen = []
    for score, ids in got:
        assert any(abs(score - s) < 1e-3 and ids == i for s, i in every)
        assert ids not in seen
        seen.append(ids)
        assert M.decode(np.array(ids, np.int64)).decode() == text
    ids, scores = next(M.nbest([text.encode()], n))
    assert ids.tolist() == got[0][1] and np.allclose(scores, [g[0] for g in got])


def test_against_all_segmentations():
    rng = random.Random(2)
    for text in ["", "a", "the cat", "  two  spaces ", "in\nto\tit", "été ▁ x", "日本🙂 the", "   ", "walking in on it"]:
        for n in (1, 2, 5, 9):
            check(text, n)
    for _ in range(60):
        check("".join(rng.choice("theinron  ▁é\n") for _ in range(rng.randint(1, 11))), rng.randint(1, 7))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_round_trip(texts):
    raw = [t.encode() for t in texts]
    for r, (ids, scores) in zip(raw, M.nbest(raw, 3)):
        assert M.decode(ids) == r
        assert (np.diff(scores) <= 0).all()


def test_cache_changes_nothing(monkeypatch):
    texts = [b"the quick brown fox jumps over the lazy dog " * 3, b"and again the fox", b"extraordinarily-long-unit-without-spaces " * 2] * 2
    want = [i.tolist() for i, _ in nbest.PieceModel(PATH).nbest(texts, 2)]
    monkeypatch.setattr(nbest, "CACHE_UNITS", 3)
    small = nbest.PieceModel(PATH)
    for _ in range(3):
        assert [i.tolist() for i, _ in small.nbest(texts, 2)] == want


def test_query_and_edges(spark):
    got = queries.op9_sentencepiece_nbest(spark, SF).collect()
    assert len(got) == 1000 and all(r.round_trip for r in got)
    assert all(len(r.scores) <= 4 and r.scores == sorted(r.scores, reverse=True) and r.scores[0] == r.score for r in got)
    ship(spark)
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "x y", 1), (3, "long " * 20000, 1)], "doc_id long, text string, score int")
    rows = {r.doc_id: r for r in nbest.encode_digest(docs, PATH).collect()}
    assert rows[1].n_pieces == 0 and rows[1].score == 0 and rows[1].ids_crc32 == zlib.crc32(b"") and rows[3].n_pieces > 20000 and rows[3].round_trip
    back = nbest.decode(nbest.encode_nbest(docs.where("doc_id IS NULL OR doc_id < 3"), PATH, 2), PATH).collect()
    assert {(r.doc_id, r.text) for r in back} == {(1, ""), (2, ""), (None, "x y")}
    assert nbest.encode_digest(docs.limit(0), PATH).count() == 0


def test_runs_of_one_character():
    """Runs whose segmentations tie by the thousand: against all of them where these can be listed, and in time where not."""
    for c in " a0=-.\n_é日":
        for n in range(1, 13):
            check(c * n, 5)
    begun = time.time()
    for c in " a0=-.\n_é日":
        for n in [*range(13, 60, 9), 300, 420, 1001, 2000]:
            text = "some words" + c * n + "x and more"
            (ids, scores), (wide, _) = next(M.nbest([text.encode()], 4)), next(M.nbest([text.encode()], 32))
            assert M.decode(ids).decode() == text and len(scores) == 4 and (np.diff(scores) <= 0).all() and ids.tolist() == wide.tolist()
    assert time.time() - begun < 100
    got = M.segmentations(b"some words" + b" " * 420 + b"x and more", 16)
    assert len({tuple(i) for _, i in got}) == 16 and all(M.decode(np.array(i, np.int64)) == b"some words" + b" " * 420 + b"x and more" for _, i in got)


def test_merging_lists():
    rng = random.Random(1)
    for _ in range(300):
        lists = [tuple((c, k) for k, c in enumerate(sorted(rng.choice([0.0, 1.0, rng.random()]) for _ in range(rng.randint(1, 6))))) for _ in range(rng.randint(0, 4))]
        n = rng.randint(1, 12)
        want = sorted(sum(x[0] for x in way) for way in product(*lists))[:n]
        got = nbest.merged(lists, n)
        assert np.allclose([w[0] for w in got], want) and len({w[1] for w in got}) == len(want)
    begun = time.time()
    assert len(nbest.merged([tuple((float(k), k) for k in range(32))] * 31, 32)) == 32 and time.time() - begun < 1


def test_units_that_share_a_key(monkeypatch):
    texts = [b"the quick brown fox jumps", b"an extraordinarily long unit", b"another-extraordinarily-long unit"]
    want = [i.tolist() for i, _ in nbest.PieceModel(PATH).nbest(texts, 2)]
    monkeypatch.setattr(nbest.tx, "word_keys", lambda run, starts, ends: ((ends - starts) % 3).astype(np.uint64))
    model = nbest.PieceModel(PATH)
    for _ in range(2):
        assert [i.tolist() for i, _ in model.nbest(texts, 2)] == want
