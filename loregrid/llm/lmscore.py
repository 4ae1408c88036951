"""Language-model scores by masked pseudo-likelihood.

A small network predicts every word from the words on both sides, with the word itself masked; a document's score is the sum of its words' conditional
log-probabilities. The corpus' most frequent words are classes of their own; the others share hashed classes, and within its class each word has the share
that its own count in the corpus gives it. All counts are kept: the most frequent at hand, the rest in a table that is joined. Every partition trains the network on a part
of its words from common weights, the weights are averaged, and so for some rounds, until every word was a target: what is gathered grows with the corpus, what reaches the driver
does not. The output layer has two halves (row and column of the class), so its cost grows with the root of the number of classes.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, parts, slices, stored, texts, word_hashes

SIDE = 32
CLASSES = SIDE * SIDE
#: Classes: known words, shared by hash, and (never predicted) beyond a text's ends.
KNOWN, OUTSIDE = 768, CLASSES - 1
SHARED = OUTSIDE - KNOWN
#: So many words' counts are sent to the tasks; those of others are joined by exchange.
AT_HAND = 1 << 18


def classes(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The class of each word's hash; vocabulary: sorted hashes of known words."""
    out = (KNOWN + words % np.uint64(SHARED)).astype(np.int64)
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
        known = vocabulary[at] == words
        out[known] = at[known]
    return out


@dataclass
class Network:
    """context: (2 * window, CLASSES, width) embeddings by place; hidden: their biases; row, column: weights to the halves of the class; given: what a row says of columns."""

    context: np.ndarray
    hidden: np.ndarray
    row: np.ndarray
    row_bias: np.ndarray
    column: np.ndarray
    given: np.ndarray

    @classmethod
    def fresh(cls, counts: np.ndarray, window: int = 3, width: int = 32, seed: int = 7) -> Network:
        """Weights that predict the classes' shares of counts whatever the context."""
        r = np.random.default_rng(seed)
        share = (counts + 0.5).reshape(SIDE, SIDE)
        f = np.float32
        return cls(r.normal(0, 0.3, (2 * window, CLASSES, width)).astype(f), np.zeros(width, f), np.zeros((width, SIDE), f), np.log(share.sum(1) / share.sum()).astype(f), np.zeros((width, SIDE), f), np.log(share / share.sum(1, keepdims=True)).astype(f))

    def packed(self) -> bytes:
        return b"".join(np.ascontiguousarray(getattr(self, x.name), "<f4").tobytes() for x in fields(self))

    def unpacked(self, data: bytes) -> Network:
        """The weights in data, in this network's shapes."""
        out, at = [], 0
        for x in fields(self):
            shape = getattr(self, x.name).shape
            n = int(np.prod(shape))
            out.append(np.frombuffer(data, "<f4", n, at).reshape(shape).copy())
            at += 4 * n
        return Network(*out)

    @property
    def window(self) -> int:
        return len(self.context) // 2

    def _forward(self, around: np.ndarray, word: np.ndarray):
        """(hidden layer, scores of rows, of columns given the row; the largest of each is 0) for places' contexts."""
        h = self.context[0][around[0]]
        for k in range(1, len(around)):
            h += self.context[k][around[k]]
        h += self.hidden
        np.tanh(h, out=h)
        a = h @ self.row + self.row_bias
        a -= a.max(1, keepdims=True)
        b = h @ self.column + self.given[word // SIDE]
        b -= b.max(1, keepdims=True)
        return h, a, b

    def log_probability(self, around: np.ndarray, word: np.ndarray, step: int = 4_096) -> np.ndarray:
        """Of each word given its context (2 * window classes, those on the left first)."""
        out = np.empty(len(word))
        for i in range(0, len(word), step):
            w = word[i : i + step]
            _, a, b = self._forward(around[:, i : i + step], w)
            at = np.arange(len(w))
            out[i : i + step] = a[at, w // SIDE] + b[at, w % SIDE] - np.log(np.exp(a).sum(1)) - np.log(np.exp(b).sum(1))
        return out

    def train(self, around: np.ndarray, word: np.ndarray, rate: float, turn: int = 0) -> None:
        """A step down the gradient of the mean negative log-probability. Every word is a target; the embeddings of a third of the places move, in turn, by steps three times as long."""
        n, at = len(word), np.arange(len(word))
        h, ga, gb = self._forward(around, word)
        ones = np.ones(SIDE, np.float32)
        for g, half in ((ga, word // SIDE), (gb, word % SIDE)):
            np.exp(g, out=g)
            g *= (1 / (g @ ones))[:, None]
            g[at, half] -= 1
        gh = ga @ self.row.T + gb @ self.column.T
        gh *= 1 - h * h
        self.row -= rate / n * (h.T @ ga)
        self.column -= rate / n * (h.T @ gb)
        self.row_bias -= rate / n * ga.sum(0)
        which = np.zeros((SIDE, n), np.float32)
        which[word // SIDE, at] = 1
        self.given -= rate / n * (which @ gb)
        self.hidden -= rate / n * gh.sum(0)
        for k in range(turn % 3, len(self.context), 3):
            order = np.argsort(around[k].astype(np.int16), kind="stable")  # sorted by radix
            c = around[k][order]
            start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            # rare classes get longer steps: by the root of the batch's size instead of the size
            self.context[k][c[start]] -= 3 * rate / np.sqrt(n) / 8 * np.clip(np.add.reduceat(gh[order], start), -4, 4)


def contexts(word: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """(2 * window, words): the classes around each word of texts that start at first; OUTSIDE beyond a text's ends."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(word)) + window * (doc + 1)
    padded = np.full(len(word) + window * len(first), OUTSIDE, np.int64)
    padded[at] = word
    return np.stack([padded[at + k] for k in (*range(-window, 0), *range(1, window + 1))])


# ---------------------------------------------------------------- over a table


def _count(batches):
    held, many = [], 0

    def merged():
        words, counts = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(words, kind="stable")
        words, counts = words[order], counts[order]
        start = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(words[start].view(np.int64)), pa.array(np.add.reduceat(counts, start))], names=["word", "n"])

    for whole in batches:
        for batch in slices(whole, "text"):
            words, counts = np.unique(word_hashes(*buffer_of(batch.column("text")))[0], return_counts=True)
            if len(words):
                held.append((words, counts))
                many += len(words)
            if many > 1_500_000:
                yield merged()
                held, many = [], 0
    if held:
        yield merged()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (a hash), n: how often each word stands in all texts; added up within tasks first."""
    return texts(docs).select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _trained(network: Network, vocabulary: np.ndarray, every: int, turn: int, batch_size: int, rate: float):
    def run(batches):
        own, seen, held = network.unpacked(network.packed()), 0, []
        count = 0

        def steps(last: bool):
            nonlocal held, count, seen
            around, word = np.concatenate([x[0] for x in held], 1), np.concatenate([x[1] for x in held])
            end = len(word) if last else len(word) // batch_size * batch_size
            for i in range(0, end, batch_size):
                own.train(around[:, i : i + batch_size], word[i : i + batch_size], rate, (seen + i) // batch_size)
            seen += end
            held, count = ([], 0) if end == len(word) else ([(around[:, end:], word[end:])], len(word) - end)

        for whole in batches:
            for batch in slices(whole, "text"):
                words, first = word_hashes(*buffer_of(batch.column("text")))
                word = classes(words, vocabulary)
                around = contexts(word, first, own.window)
                mine = np.arange(turn, len(word), every)
                held.append((around[:, mine], word[mine]))
                count += len(mine)
                if count >= batch_size:
                    steps(False)
        if count:
            steps(True)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([own.packed()], pa.binary())], names=["n", "weights"])

    return run


def _averaged(batches):
    total, seen = None, 0
    for batch in batches:
        for n, w in zip(batch.column("n").to_pylist(), batch.column("weights").to_pylist()):
            x = np.frombuffer(w, "<f4").astype(float) * n
            total, seen = x if total is None else total + x, seen + n
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([(total / seen).astype("<f4").tobytes()], pa.binary())], names=["n", "weights"])


@dataclass
class Model:
    """vocabulary: sorted hashes of known words. held, held_log: sorted hashes of the most frequent words, and the logarithms of their counts.

    rest: word, n of the other words that stand more than once; None without such. A word in neither stands once. shared_log: of all words of each hashed class.
    """

    vocabulary: np.ndarray
    network: Network
    held: np.ndarray
    held_log: np.ndarray
    rest: DataFrame | None
    shared_log: np.ndarray


def fit(docs: DataFrame, rounds: int = 2, every: int = 2, batch_size: int = 2_048, rate: float = 0.5, window: int = 3) -> Model:
    """A model of all texts. Words are counted over all documents; in each of the rounds every partition trains on one word in `every`, all over its texts:
    with as many rounds, on every word once.

    The driver gets the counts of AT_HAND words and of the hashed classes, and weights averaged to 16 rows at most.
    """
    counted = stored(word_counts(docs), "words")
    top = counted.orderBy(F.desc("n"), "word").limit(AT_HAND).toArrow()
    held, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    vocabulary, counts = np.sort(held[:KNOWN]), np.zeros(CLASSES)
    counts[: len(vocabulary)] = n[:KNOWN][np.argsort(held[:KNOWN])]
    negative = F.when(F.col("word") < 0, F.lit(2**64 % SHARED)).otherwise(F.lit(0))  # hashes are unsigned
    shared = F.pmod(F.pmod(F.col("word"), F.lit(SHARED)) + negative, F.lit(SHARED))
    for r in counted.groupBy(shared.alias("k")).agg(F.sum("n").alias("n")).collect():
        counts[KNOWN + r.k] = r.n
    np.subtract.at(counts, classes(held[:KNOWN], vocabulary[:0]), n[:KNOWN])
    rest = None
    if len(held) == AT_HAND and n[-1] > 1:
        last = top.slice(AT_HAND - 1).to_pylist()[0]
        rest = counted.where((F.col("n") > 1) & ((F.col("n") < last["n"]) | (F.col("n") == last["n"]) & (F.col("word") > last["word"])))
    network = Network.fresh(counts, window)
    text = texts(docs).select("text")
    for turn in range(rounds):
        rows = text.mapInArrow(_trained(network, vocabulary, every, turn * every // rounds, batch_size, rate / (1 + turn)), "n long, weights binary")
        got = rows.repartition(min(16, parts(docs))).mapInArrow(_averaged, "n long, weights binary").collect()
        if got:
            seen = sum(r.n for r in got)
            mean = sum(np.frombuffer(r.weights, "<f4").astype(float) * (r.n / seen) for r in got)
            network = network.unpacked(mean.astype("<f4").tobytes())
    order = np.argsort(held)
    return Model(vocabulary, network, held[order], np.log(n[order]).astype(np.float32), rest, np.log(counts[KNOWN:OUTSIDE] + 1))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (the sum over all words), score (the mean, 0 without words) of each whole text.

    Words are runs of bytes beside white space, with A-Z lower-cased. A word that the corpus doesn't have counts as one that stands there once. Null and empty
    texts have no words. Rows that repeat are scored each; an empty table gives no rows; other columns are not read.
    """
    vocabulary, network, held, held_log, shared_log, joins = model.vocabulary, model.network, model.held, model.held_log, model.shared_log, model.rest is not None

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                words, first = word_hashes(*buffer_of(batch.column("text")))
                word = classes(words, vocabulary)
                p = network.log_probability(contexts(word, first, network.window), word)
                n = np.diff(first)
                doc = np.repeat(np.arange(len(n)), n)
                hashed = np.flatnonzero(word >= KNOWN)
                w = words[hashed]
                at = np.minimum(np.searchsorted(held, w), max(0, len(held) - 1))
                here = held[at] == w if len(held) else np.zeros(len(w), bool)
                p[hashed] -= shared_log[word[hashed] - KNOWN]
                p[hashed[here]] += held_log[at[here]]
                total = np.bincount(doc, weights=p, minlength=len(n))[: len(n)].astype(float)
                row = batch.column("row")
                yield pa.RecordBatch.from_arrays([row, batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(total), pa.nulls(len(n), pa.int64())], names=["row", "doc_id", "n_tokens", "log_likelihood", "word"])
                if joins:
                    far, of = w[~here].view(np.int64), row.to_numpy()[doc[hashed[~here]]]
                    for i in range(0, len(far), 50_000):
                        f, none = far[i : i + 50_000], len(far[i : i + 50_000])
                        yield pa.RecordBatch.from_arrays([pa.array(of[i : i + 50_000]), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.float64()), pa.array(f)], names=["row", "doc_id", "n_tokens", "log_likelihood", "word"])

    out = texts(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "row long, doc_id long, n_tokens long, log_likelihood double, word long")
    if joins:
        out = stored(out, "scored")
        more = out.where("n_tokens IS NULL").select("row", "word").join(model.rest, "word").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
        out = out.where("n_tokens IS NOT NULL").join(more, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "log_likelihood", (F.col("log_likelihood") / F.greatest("n_tokens", F.lit(1))).alias("score"))
