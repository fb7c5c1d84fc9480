"""Toxicity by a bidirectional gated recurrent network over overlapping windows of words.

A word enters as a learned vector and as the log odds of the training documents that hold it;
its characters enter as learned vectors of its beginnings and endings and as the largest of
their log odds.  The network reads a window both ways, attention pools its states, and the
score of a document is that of its most toxic window.  All is trained in numpy on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import with_fields

#: Text that the network is trained on, at most (chosen by a hash of doc_id), and the longest text used for it.
TRAIN_BYTES, TRAIN_TEXT_BYTES = 24 << 20, 1 << 20
WINDOW, STRIDE = 64, 32
HIDDEN, EMBED, ATTEND = 8, 4, 8
ODDS_BUCKETS, EMBED_BUCKETS = 1 << 18, 1 << 13
EPOCHS, BATCH = 4, 256
#: Lengths in bytes of the beginnings and endings that stand for a word's characters.
BEGINNINGS, ENDINGS = (3, 4, 5, 6), (3, 4)

_LOWER = np.full(256, 32, np.uint8)
_LOWER[128:] = np.arange(128, 256)
for _a in range(26):
    _LOWER[65 + _a] = _LOWER[97 + _a] = 97 + _a
_FOLD = _LOWER.tobytes()


def folded(texts: list[bytes]) -> tx.Pages:
    """Texts in which all but letters (and bytes beyond ASCII) is blank and A-Z are in lower case."""
    return tx.Pages([t.translate(_FOLD) for t in texts])


class Words:
    """The distinct words of some texts: keys of each word and of its characters, and who uses them."""

    def __init__(self, texts: list[bytes]):
        pages = folded(texts)
        starts, ends = pages.words()
        self.bounds = pages.text_of(starts)
        key = tx.word_keys(pages, starts, ends)
        self.code, found = pd.factorize(key)
        one = np.empty(len(found), np.int64)
        one[self.code] = np.arange(len(key))
        first, last = tx.ends_of(pages, starts[one], ends[one])
        size = np.minimum(ends[one] - starts[one], 8)
        grams = [tx.mix((first & tx._MASK[np.minimum(size, n)]) + np.uint64(n * int(tx.GOLD) & (2**64 - 1))) for n in BEGINNINGS] if len(found) else []
        if len(found):
            grams += [tx.mix((last >> (np.maximum(size - n, 0) * 8).astype(np.uint64)) ^ np.uint64(n << 57 | 1)) for n in ENDINGS]
        self.key = found
        self.grams = np.stack(grams, 1) if len(found) else np.zeros((0, len(BEGINNINGS) + len(ENDINGS)), np.uint64)


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of each window, and the text it is of; a text of few words has one."""
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
    owner = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[owner] + nth * STRIDE
    return first, np.minimum(WINDOW, bounds[owner + 1] - first), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Parameters, forward pass and gradients.  The input of a word is (odds, vectors)."""

    INPUT = 2 + 2 * EMBED

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p: dict[str, np.ndarray] = {"word": init(EMBED_BUCKETS, EMBED) * 3, "gram": init(EMBED_BUCKETS, EMBED) * 3}
        for way in "fb":
            self.p |= {f"W{way}": init(self.INPUT, 3 * HIDDEN), f"U{way}": init(HIDDEN, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": init(2 * HIDDEN, ATTEND), "v": init(ATTEND, 1), "o": init(2 * HIDDEN, 1), "d": np.full(1, -1, np.float32)}
        self.word_odds, self.gram_odds = np.zeros((2, ODDS_BUCKETS), np.float32)

    def inputs(self, words: Words) -> np.ndarray:
        """The input of each distinct word."""
        odds, vectors = np.uint64(ODDS_BUCKETS - 1), np.uint64(EMBED_BUCKETS - 1)
        up = np.uint64(24)
        return np.concatenate(
            [
                self.word_odds[words.key & odds][:, None],
                self.gram_odds[words.grams & odds].max(1, initial=-9)[:, None] if len(words.key) else np.zeros((0, 1), np.float32),
                self.p["word"][words.key >> up & vectors],
                self.p["gram"][words.grams >> up & vectors].mean(1),
            ],
            1,
        ).astype(np.float32)

    def _read(self, way: str, projected: np.ndarray, at: np.ndarray, size: np.ndarray, keep: list | None):
        """States (time, window, hidden) of one direction; steps past a window's end leave the state."""
        U, h = self.p[f"U{way}"], np.zeros((at.shape[1], HIDDEN), np.float32)
        states = np.zeros((WINDOW, at.shape[1], HIDDEN), np.float32)
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            x, u = projected[at[t]], h @ U
            gates = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            on = (t < size)[:, None]
            new = np.where(on, n + z * (h - n), h)
            if keep is not None:
                keep.append((t, h, z, r, n, u[:, 2 * HIDDEN :], on))
            h = states[t] = new
        return states

    def forward(self, x: np.ndarray, at: np.ndarray, size: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows.  ``at`` (time, window) says which row of ``x`` is read."""
        kept = {"f": [], "b": []}
        h = np.concatenate([self._read(w, x @ self.p[f"W{w}"] + self.p[f"c{w}"], at, size, kept[w] if keep is not None else None) for w in "fb"], 2)
        a = np.tanh(h @ self.p["A"])
        e = (a @ self.p["v"])[..., 0]
        e = np.where(np.arange(WINDOW)[:, None] < size, e, -1e9)
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0)
        pooled = (weight[..., None] * h).sum(0)
        if keep is not None:
            keep.update(kept, h=h, a=a, weight=weight, pooled=pooled)
        return (pooled @ self.p["o"])[:, 0] + self.p["d"]

    def gradients(self, x: np.ndarray, at: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the mean log loss: of the parameters, and of ``x``."""
        k: dict = {}
        logit = self.forward(x, at, size, k)
        p = self.p
        score = _sigmoid(logit)
        loss = float(-np.mean(np.log(np.where(y > 0, score, 1 - score) + 1e-7)))
        d = ((score - y) / len(y)).astype(np.float32)
        g = {"d": d.sum(keepdims=True), "o": k["pooled"].T @ d[:, None]}
        dpool = d[:, None] * p["o"][:, 0]
        dh = k["weight"][..., None] * dpool
        dw = (k["h"] * dpool).sum(2)
        de = k["weight"] * (dw - (k["weight"] * dw).sum(0))
        da = de[..., None] * p["v"][:, 0] * (1 - k["a"] ** 2)
        g["v"] = np.einsum("tba,tb->a", k["a"], de)[:, None]
        g["A"] = np.einsum("tbh,tba->ha", k["h"], da)
        dh = dh + da @ p["A"].T
        dx = np.zeros_like(x)
        for way, own in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            U, W = p[f"U{way}"], p[f"W{way}"]
            gU, gproj, carry = np.zeros_like(U), np.zeros((len(x), 3 * HIDDEN), np.float32), 0
            for t, h, z, r, n, un, on in reversed(k[way]):
                total = dh[t][:, own] + carry
                live = np.where(on, total, 0)
                dn = live * (1 - z) * (1 - n * n)
                dz = live * (h - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                du = np.concatenate([dz, dr, dn * r], 1)
                gU += h.T @ du
                np.add.at(gproj, at[t], np.concatenate([dz, dr, dn], 1))
                carry = np.where(on, live * z, total) + du @ U.T
            g[f"U{way}"], g[f"W{way}"], g[f"c{way}"] = gU, x.T @ gproj, gproj.sum(0)
            dx += gproj @ W.T
        return g, dx, loss

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The score of each text: of its most toxic window; without words 0."""
        words = Words(texts)
        out = np.zeros(len(texts))
        first, size, owner = windows(words.bounds)
        if len(first):
            x = self.inputs(words)
            for k in range(0, len(first), 8192):
                f, s = first[k : k + 8192], size[k : k + 8192]
                logit = self.forward(x, _rows(words.code, f, s), s)
                np.maximum.at(out, owner[k : k + 8192], _sigmoid(logit).astype(np.float64))
        return out


def _rows(code: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = first[None] + np.minimum(np.arange(WINDOW)[:, None], size - 1)
    return code[at]


def _odds(words: Words, toxic: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shrunk log odds by bucket, from which of ``docs`` hold it; a rare word's stay near 0.
    Documents are counted some at a time, so that the room this takes doesn't depend on their number."""
    hit = np.zeros((2, 2, ODDS_BUCKETS), np.int64)  # toxic or not, of words or of their characters
    mask, bounds = np.uint64(ODDS_BUCKETS - 1), words.bounds
    first = 0
    while first < len(toxic):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + 300_000, "right")) - 1)
        owner = np.repeat(np.arange(first, last), np.diff(bounds[first : last + 1]))
        code = words.code[bounds[first] : bounds[last]]
        use = docs[owner]
        pair = np.unique(owner[use] * len(words.key) + code[use])
        doc, code = pair // max(len(words.key), 1), pair % max(len(words.key), 1)
        for y in (0, 1):
            own = code[toxic[doc] == bool(y)]
            for of, keys in enumerate((words.key[own], words.grams[own])):
                hit[y, of] += np.bincount((keys & mask).astype(np.int64).ravel(), minlength=ODDS_BUCKETS)
        first = last
    ratio = (toxic & docs).sum() / max((~toxic & docs).sum(), 1)
    odds = np.clip(np.log((hit[1] + 1) / (hit[0] * ratio + 1)), -2, 5).astype(np.float32)
    return odds[0], odds[1]


def train(texts: list[bytes], toxic: np.ndarray, seed: int = 7) -> Network:
    """Odds come from one half of the documents while the network learns on the other, so that it
    learns what odds mean for words it meets anew; at last they come from all.  From a toxic
    document the windows of the largest odds are taken, from others these and random ones."""
    net, rng = Network(seed), np.random.default_rng(seed)
    words = Words(texts)
    order = rng.permutation(len(texts))
    half = np.zeros(len(texts), bool)
    for y in (True, False):
        mine = order[toxic[order] == y]
        half[mine[::2]] = True
    net.word_odds, net.gram_odds = _odds(words, toxic, half)
    first, size, owner = windows(words.bounds)
    strength = np.concatenate([[0], np.cumsum(np.maximum(net.inputs(words)[words.code, :2].sum(1), 0))])
    strength = strength[first + size] - strength[first] + rng.random(len(first)) * 1e-3
    rank = np.empty(len(first), np.int64)
    by = np.lexsort((-strength, owner))
    rank[by] = np.arange(len(by)) - np.searchsorted(owner[by], owner[by])
    use = ~half[owner] & np.where(toxic[owner], rank < 1, (rank < 2) | (rng.random(len(first)) < 0.1))
    use = np.flatnonzero(use)
    y_all = toxic[owner].astype(np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    up, vectors = np.uint64(24), np.uint64(EMBED_BUCKETS - 1)
    base = net.inputs(words)
    # At least so many steps as a small table needs.
    epochs = max(EPOCHS, -(-240 * BATCH // max(len(use), 1)) if len(use) else 0)
    for _ in range(min(epochs, 60)):
        use = use[rng.permutation(len(use))]
        for k in range(0, len(use), BATCH):
            step += 1
            some = use[k : k + BATCH]
            at, back = np.unique(_rows(words.code, first[some], size[some]), return_inverse=True)
            x = base[at]
            x[:, 2 : 2 + EMBED] = net.p["word"][words.key[at] >> up & vectors]
            x[:, 2 + EMBED :] = net.p["gram"][words.grams[at] >> up & vectors].mean(1)
            g, dx, _ = net.gradients(x, back.reshape(WINDOW, len(some)), size[some], y_all[some])
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(g["word"], (words.key[at] >> up & vectors).astype(np.int64), dx[:, 2 : 2 + EMBED])
            grams = (words.grams[at] >> up & vectors).astype(np.int64)
            np.add.at(g["gram"], grams, (dx[:, None, 2 + EMBED :] / grams.shape[1]).repeat(grams.shape[1], 1))
            for name, grad in g.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                net.p[name] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    net.word_odds, net.gram_odds = _odds(words, toxic, np.ones(len(texts), bool))
    return net


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_bytes: int = TRAIN_BYTES) -> Network | None:
    """A network trained on labelled documents (labels: doc_id, toxic 1 or 0; the larger of several
    counts) whose crc32(doc_id) mod 5 isn't 0.  None if they don't hold both classes."""
    known = labels.select(F.col("doc_id").alias("_doc"), "toxic").dropna().where(~held_out("_doc"))
    known = known.groupBy("_doc").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("binary").alias("text"))
    texts = texts.where(F.octet_length("text").between(1, TRAIN_TEXT_BYTES))
    chance = F.pmod(F.xxhash64("_doc"), F.lit(1 << 20))
    # The bytes of all labelled texts are estimated from the mean length and the number of labels.
    mean = docs.agg(F.avg(F.octet_length("text")).alias("n")).first()["n"] or 1
    share = min(1.0, 0.9 * train_bytes / max(known.count() * mean, 1))
    known = known.where(chance < int(share * (1 << 20)))
    rows = [(r["_doc"], bytes(r["text"]), r["toxic"] > 0) for r in texts.join(known, "_doc").select("_doc", "text", "toxic").toLocalIterator()]
    rows.sort()
    toxic = np.array([r[2] for r in rows], bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return None
    return train([r[1] for r in rows], toxic)


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted.  A text without words, or null, scores 0; so does
    every text without a network.  Columns of these names are replaced, others stay."""
    docs = docs.drop("score", "predicted")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text").cast(pa.binary()))
            parts = [np.zeros(len(some)) if net is None else net.scores(some) for some in tx.in_slices(texts, 1 << 20)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*names, "score", "predicted"]
            )

    return docs.mapInArrow(run, with_fields(docs, "score double", "predicted int"))
