"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level in numpy from a bounded sample of labelled rows and flattened into arrays in heap order; scoring walks all rows of a
batch down one tree at a time with array look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotated, buffer_of, pick, slices, texts, word_hashes

#: Classes of bytes whose shares are statistics.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "|", "#$%&*@^~+=", "<>_/\\{}[]", "\"'`()-:;"]
_CLASS_OF = np.full(256, len(_CLASSES) + 1, np.int64)
_CLASS_OF[:128] = len(_CLASSES)
for _i, _s in enumerate(_CLASSES):
    _CLASS_OF[[ord(c) for c in _s]] = _i
_K = len(_CLASSES) + 2
FEATURES = _K + 12


def _per(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, weights=values, minlength=n)[:n]


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of statistics of each text; an empty text's are 0."""
    n, size = len(at) - 1, np.diff(at)
    out = np.zeros((n, FEATURES))
    if not len(raw):
        return out
    doc = np.repeat(np.arange(n), size)
    least = np.maximum(size, 1)
    out[:, :_K] = np.bincount(doc * _K + _CLASS_OF[raw], minlength=n * _K).reshape(n, _K) / least[:, None]
    hashes, first = word_hashes(raw, at)
    words = np.diff(first)
    most = np.maximum(words, 1)
    of = np.repeat(np.arange(n), words)
    out[:, _K] = np.log1p(size)
    out[:, _K + 1] = np.log1p(words)
    out[:, _K + 2] = size / most
    if len(hashes):
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        out[:, _K + 3] = _per(same, of, n) / most
        _, where, count = np.unique(hashes ^ (of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True, return_counts=True)
        own = of[where]
        out[:, _K + 4] = np.bincount(own, minlength=n) / most
        top = np.zeros(n)
        np.maximum.at(top, own, count)
        out[:, _K + 5] = top / most
        out[:, _K + 6] = _per(count == 1, own, n) / most
    line = raw == 10
    lines = _per(line, doc, n) + 1
    out[:, _K + 7] = np.log1p(lines)
    out[:, _K + 8] = size / lines
    kind = _CLASS_OF[raw]
    mark = (kind >= 5) & (kind <= 11)
    twice = np.zeros(len(raw), bool)
    twice[1:] = mark[1:] & mark[:-1]
    out[:, _K + 9] = _per(twice, doc, n) / most
    upper = kind == 1
    twice[1:] = upper[1:] & upper[:-1]
    out[:, _K + 10] = _per(twice, doc, n) / most
    lone = np.zeros(len(raw), bool)
    lone[1:-1] = (kind[:-2] == 3) & (kind[2:] == 3) & mark[1:-1]
    out[:, _K + 11] = _per(lone, doc, n) / most
    return out


@dataclass
class Trees:
    """feature, threshold (trees, 2 ** depth - 1) and value (trees, 2 ** depth) in heap order; base is the log-odds before any tree."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, penalty: float = 1.0, least: float = 1.0) -> Trees:
    """Boosts trees on logistic loss. Without rows of both labels there are no trees: the score is the labels' share (0.5 without rows)."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1)), base)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    column = codes + np.arange(width) * bins
    inner = (1 << depth) - 1
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * (width * bins) + column).ravel()
            sums = [np.bincount(cell, weights=np.repeat(v, width), minlength=many * width * bins).reshape(many, width, bins).cumsum(2) for v in (g, h)]
            left_g, left_h = sums[0][:, :, :-1], sums[1][:, :, :-1]
            all_g, all_h = sums[0][:, :1, -1:], sums[1][:, :1, -1:]
            gain = left_g**2 / (left_h + penalty) + (all_g - left_g) ** 2 / (all_h - left_h + penalty) - all_g**2 / (all_h + penalty)
            gain[(left_h < least) | (all_h - left_h < least)] = -np.inf
            for f, c in enumerate(cuts):
                gain[:, f, len(c) :] = -np.inf
            best = gain.reshape(many, -1).argmax(1)
            good = gain.reshape(many, -1)[np.arange(many), best] > 1e-6
            f, b = best // (bins - 1), best % (bins - 1)
            feature[t, first : first + many] = np.where(good, f, 0)
            threshold[t, first : first + many] = [cuts[j][k] if ok else np.inf for j, k, ok in zip(f, b, good)]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        sum_g, sum_h = np.bincount(leaf, weights=g, minlength=inner + 1), np.bincount(leaf, weights=h, minlength=inner + 1)
        value[t] = -rate * sum_g / (sum_h + penalty)
        total += value[t][leaf]
    return Trees(feature, threshold, value, base)


def _measure(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            x = statistics(*buffer_of(batch.column("text")))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "mark", "label")], rows], names=["doc_id", "mark", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 20_000, learns=None, **how) -> Trees:
    """Trees for the label of the rows of labels.

    The fit takes at most most_rows labelled documents: those whose doc_id has the smallest hash. learns says of a doc_id column which may be learned
    from (all by default). Null ids and labels don't count; a document with several labels has their mean, rounded up. Rows that repeat a doc_id count each
    with its label, up to most_rows in all; null texts are empty. Without rows every text gets the same score.
    """
    rows = pick(labels, "doc_id", label).toDF("doc_id", "label").where("doc_id IS NOT NULL AND label IS NOT NULL")
    if learns is not None:
        rows = rows.where(learns(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    found = texts(docs).join(F.broadcast(rows), "doc_id").select("doc_id", F.xxhash64("text").alias("mark"), "label", "text")  # at most most_rows ids are broadcast
    measured = found.mapInArrow(_measure, "doc_id long, mark long, label double, x array<double>")
    got = measured.orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(most_rows).select("label", "x").collect()  # an id may have many rows
    got.sort(key=lambda r: (r.label, r.x))
    return grow(np.array([r.x for r in got]).reshape(-1, FEATURES), np.array([r.label for r in got]), **how)


def scored(docs: DataFrame, trees: Trees, name: str = "score") -> DataFrame:
    """docs with every column, and at the end the score (0 to 1, higher: label 1 likelier) of each whole text, also where docs has a column of that name.

    A null text counts as empty; empty texts have a score too. Rows that repeat are scored each; an empty table gives no rows.
    """

    def score(batch: pa.RecordBatch, text: pa.Array) -> np.ndarray:
        return trees.score(statistics(*buffer_of(text)))

    return annotated(docs, "text", score, name, "double")
