"""Quality rules: two fixed rules and boosted trees over statistics of whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import with_fields
from .trees import Forest, fit

#: Labelled rows that the trees are fitted on, at most.
SAMPLE_ROWS = 20_000
#: Documents whose score is lower go.
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the trees see, and how the verdict may depend on it: -1 for features of which more is never better.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": 0, "digit_share": -1, "mark_share": 0, "shout_share": -1, "distinct_share": 0, "words_per_line": 0, "high_share": 0,
}

_CLASS = np.zeros((6, 256), bool)
_CLASS[0, list(b"#*$%&|<>")] = True
_CLASS[1, list(range(65, 91))] = True
_CLASS[2, list(range(48, 58))] = True
_CLASS[3, list(b".,;:")] = True
_CLASS[4, list(b"!?")] = True
_CLASS[5, list(range(192, 256))] = True
_STRIP = b" \t\n\r\x0b\x0c"


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between successive bounds."""
    at = np.flatnonzero(flags)
    return np.diff(np.searchsorted(at, bounds))


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the counts of COUNTS and the values of FEATURES."""
    pages = tx.Pages(texts)
    starts, ends = pages.words()
    bounds = pages.text_of(starts)
    n_words = np.diff(bounds)
    raw = pages.bytes
    points = _sums((raw & 0xC0) != 0x80, pages.starts)
    blanks = _sums(tx._BLANK[raw], pages.starts)
    word_chars = points - blanks
    classes = [_sums(c[raw], pages.starts) for c in _CLASS]
    n_dup, n_lines = np.zeros((2, len(texts)), np.int64)
    for k, text in enumerate(texts):
        lines = text.split(b"\n")
        n_lines[k] = len(lines)
        if len(lines) > 1:
            full = [x for x in lines if x.strip(_STRIP)]
            n_dup[k] = len(full) - len(set(full))
    n_repeat, distinct = np.zeros((2, len(texts)), np.int64)
    if len(starts):
        owner = np.repeat(np.arange(len(texts)), n_words).astype(np.uint64)
        key = tx.mix(tx.word_keys(pages, starts, ends) + owner * tx.GOLD)
        code, found = pd.factorize(key)
        seen = np.zeros(len(found), np.int64)
        seen[code] = owner  # a key belongs to one text
        distinct = np.bincount(seen, minlength=len(texts))
        if len(key) > 2:
            window = tx.mix(tx.mix(key[:-2] * tx.GOLD + key[1:-1]) * tx.GOLD + key[2:])
            inside = np.flatnonzero(owner[:-2] == owner[2:])
            code, _ = pd.factorize(window[inside])
            often = inside[np.bincount(code)[code] > 1] if len(inside) else inside
            covered = np.zeros(len(key), bool)
            for k in range(3):
                covered[often + k] = True
            n_repeat = _sums(covered, bounds)
    counts = np.stack([n_words, word_chars, classes[0], n_dup, n_repeat], 1)
    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    features = np.stack(
        [np.log1p(n_words), word_chars / w, classes[0] / w, n_dup / n_lines, n_repeat / w, classes[1] / c, classes[2] / c, classes[3] / w, classes[4] / w, distinct / w, n_words / n_lines, classes[5] / c],
        1,
    )
    return counts, features


def all_statistics(texts) -> tuple[np.ndarray, np.ndarray]:
    """The same for any number of texts (null: empty), in slices of bounded size."""
    parts = [statistics(some) for some in tx.in_slices(texts)]
    if not parts:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(FEATURES)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest | None:
    """Trees on labelled documents (labels: doc_id, quality 1 or 0; the lower of several counts).

    At most about ``sample_rows`` labels are used, taken by a hash of doc_id.  None if the
    labels don't hold both classes; every document then passes this part.
    """
    known = labels.select(F.col("doc_id").alias("_doc"), "quality").dropna()
    share = min(1.0, sample_rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("_doc"), F.lit(1 << 20)) < int(share * (1 << 20)))
    chosen = chosen.groupBy("_doc").agg(F.min("quality").alias("quality"))
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("binary").alias("text"))
    joined = texts.join(F.broadcast(chosen), "_doc").select("quality", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = all_statistics(t.as_py() for t in batch.column(1))[1]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["quality", "x"])

    rows = joined.mapInArrow(measure, "quality int, x array<double>").toPandas()
    y = rows["quality"].to_numpy() > 0
    if not len(y) or y.all() or not y.any():
        return None
    x = np.stack(rows["x"].to_numpy())
    order = np.lexsort([*x.T, y])  # the same trees whatever the order of rows
    return fit(x[order], y[order].astype(float), np.array(list(FEATURES.values())))


def judge(docs: DataFrame, forest: Forest | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the counts of COUNTS, base_failed, score and kept.

    A null text has no words and fails.  Columns of these names are replaced, others stay.
    """
    new = [*COUNTS, "base_failed", "score", "kept"]
    docs = docs.drop(*new)
    names = docs.columns
    schema = with_fields(docs, *(f"{c} long" for c in COUNTS), "base_failed boolean", "score double", "kept boolean")
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            counts, x = all_statistics(t.as_py() for t in batch.column("text").cast(pa.binary()))
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
            score = forest.score(x) if forest is not None else np.ones(len(x))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))],
                [*names, *new],
            )

    return docs.mapInArrow(mark, schema)
