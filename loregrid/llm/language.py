"""Language identification by nearest centroids.

A text is the normalised TF-IDF vector of its hashed byte n-grams (1 to 3 bytes, A-Z lower-cased, other ASCII as spaces). Each language has several centroids, found by
spherical k-means; a text's language is that of the centroid with the largest cosine, and it is marked rejected when it lies farther from it than
nearly all texts that the language was learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import annotated, buffer_of, pick, slices

BINS = 2048
_SHIFT = np.uint32(32 - 11)
_FOLD = np.full(256, 32, np.uint32)  # letters and bytes beyond ASCII stay; all else is as a space
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def profile(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams of each text; none crosses texts. Runs of what isn't a letter count as one space."""
    n, out = len(at) - 1, np.zeros((len(at) - 1) * BINS, np.float32)
    folded = _FOLD[raw]
    kept = np.ones(len(raw), bool)
    kept[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    at, raw, folded = np.concatenate([[0], np.cumsum(kept)])[at], raw[kept], folded[kept]
    size = np.diff(at)
    if len(raw):
        doc = np.repeat(np.arange(n, dtype=np.int64) * BINS, size)
        left = np.repeat(at[1:], size) - np.arange(len(raw))  # bytes to the text's end
        code = np.zeros(len(raw), np.uint32)
        for width in (1, 2, 3):
            code = code[: len(raw) - width + 1] * np.uint32(257) + folded[width - 1 :] + np.uint32(1)
            inside = left[: len(code)] >= width
            bins = ((code * np.uint32(0x9E3779B1)) >> _SHIFT).astype(np.int64)
            out += np.bincount((doc[: len(code)] + bins)[inside], minlength=n * BINS).astype(np.float32)
            if len(code) <= 1:
                break
    return out.reshape(n, BINS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    """languages: learned values; of: language of each centroid; least: the cosine below which a text is rejected, by language."""

    languages: list[str]
    weight: np.ndarray
    centre: np.ndarray
    of: np.ndarray
    least: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine and whether the distance rejects, of each row."""
        if not self.languages:
            return np.full(len(counts), -1), np.zeros(len(counts)), np.ones(len(counts), bool)
        near = _unit(np.log1p(counts) * self.weight) @ self.centre.T
        best = near.argmax(1)
        cosine = near[np.arange(len(near)), best]
        return self.of[best], np.clip(cosine, 0, 1).astype(float), cosine < self.least[self.of[best]]


def cluster(x: np.ndarray, most: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; first centres are each farthest from those before."""
    centre = [_unit(x.mean(0, keepdims=True))[0]]
    near = x @ centre[0]
    while len(centre) < min(most, len(x)):
        centre.append(x[near.argmin()])
        near = np.maximum(near, x @ centre[-1])
    c = np.array(centre)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = _unit(np.array([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(len(c))]))
    return c


def learn(counts: np.ndarray, langs: list[str], centroids: int = 4, quantile: float = 0.001) -> Centroids:
    if not len(langs):
        return Centroids([], np.zeros(BINS), np.zeros((0, BINS)), np.zeros(0, np.int64), np.zeros(0))
    weight = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x, names, langs = _unit(np.log1p(counts) * weight), sorted(set(langs)), np.array(langs)
    centre, of, least = [], [], []
    for k, name in enumerate(names):
        own = x[langs == name]
        c = cluster(own, centroids)
        centre.append(c)
        of += [k] * len(c)
        least.append(float(np.quantile((own @ c.T).max(1), quantile)) * 0.9)
    return Centroids(names, weight, np.concatenate(centre).astype(np.float32), np.array(of), np.array(least))


def _count(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            x = np.minimum(profile(*buffer_of(batch.column("text"))), 65535).astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])


def fit(docs: DataFrame, most_rows: int = 6_000, learns=None, centroids: int = 4, most_languages: int = 400) -> Centroids:
    """Centroids from a sample of documents with text and lang, of the most_languages most frequent languages: for each as many (most_rows by their number,
    50 at least), those whose doc_id has the smallest hash.

    learns says of a doc_id column which may be learned from (all by default). Null ids, texts and languages don't count; rows that repeat a doc_id, text
    and lang count once. Without rows nothing is learned, and every text is `und`.
    """
    rows = pick(docs, "doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    if learns is not None:
        rows = rows.where(learns(F.col("doc_id")))
    known = rows.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    each = max(50, most_rows // max(1, len(known)))
    if not known:
        return learn(np.zeros((0, BINS), np.float32), [], centroids)
    # of the ids' uniform hash: about twice as many ids as are taken, and 50 more, go on from a language of any size, however often its ids repeat
    limits = rows.sparkSession.createDataFrame([(r.lang, min(2.0**63, 2.0**63 * (2 * each + 50) / max(1, r.ids))) for r in known], "lang string, most double")
    near = rows.withColumn("hash", F.xxhash64("doc_id").bitwiseAND(F.lit(2**63 - 1))).join(F.broadcast(limits), "lang").where(F.col("hash") <= F.col("most"))
    order = Window.partitionBy("lang").orderBy("hash", "mark")
    ids = near.select("lang", "hash", F.xxhash64("text").alias("mark")).distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= each)
    ids = ids.groupBy("lang").agg(F.max(F.struct("hash", "mark")).alias("last"))  # a row for each language
    chosen = near.withColumn("mark", F.xxhash64("text")).join(F.broadcast(ids), "lang").where(F.struct("hash", "mark") <= F.col("last"))
    chosen = chosen.select("lang", "hash", "mark", "text").dropDuplicates(["lang", "hash", "mark"]).select("lang", "text")  # each * languages at most
    got = sorted((r.lang, bytes(r.x)) for r in chosen.mapInArrow(_count, "lang string, x binary").collect())
    counts = np.array([np.frombuffer(x, "<u2") for _, x in got], np.float32).reshape(-1, BINS)
    return learn(counts, [lang for lang, _ in got], centroids)


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def lettered(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only those without one of a-z are decoded."""
    sums = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    out = sums[at[1:]] > sums[at[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") if c != "�")
    return out


def predicted(docs: DataFrame, model: Centroids) -> DataFrame:
    """docs with every column, and at the end language: struct<lang_pred string, score double, rejected boolean>, also where docs has a column of that name.

    A text is rejected if its cosine is below nine tenths of that of nearly all texts (all but one in a thousand) that its language was learned from: other
    languages and scripts, and texts that hardly are language, such as one word over and over. Rejected texts still have the nearest language. Rows that
    repeat are predicted each; an empty table gives no rows. score is the cosine to the nearest centroid. A text that is null or has no letter is `und` with score 0, rejected; so is every text when nothing was learned.
    """
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def made(batch, text):
        raw, at = buffer_of(text)
        out = []
        for i in range(0, len(text), 256):  # bounds the counts' memory
            j = min(len(text), i + 256)
            part, where = raw[at[i] : at[j]], at[i : j + 1] - at[i]
            k, cosine, far = model.predict(profile(part, where))
            seen = lettered(part, where) & (k >= 0)
            out += [{"lang_pred": model.languages[a] if ok else "und", "score": float(b) if ok else 0.0, "rejected": bool(c) or not ok} for a, b, c, ok in zip(k, cosine, far, seen)]
        return pa.array(out, kind)

    return annotated(docs, "text", made, "language", "struct<lang_pred: string, score: double, rejected: boolean>")
