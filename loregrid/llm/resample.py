"""Importance resampling towards a target: documents weighed by hashed features, and an exact draw by Gumbel noise from sorted runs merged by tournament trees."""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, pick, small_batches, stored, texts

#: A-Z to a-z; of the other bytes below 0x80 only digits and letters are left, the rest is white space. Bytes from 0x80 on belong to words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Features whose buckets a worker holds at most; then it starts anew.
HELD = 1 << 20

#: Rows in a segment of a run, and rows that a range should have at most.
SEGMENT = 1_024
RANGE_ROWS = 1 << 20


def words(text: str) -> list[bytes]:
    """The words of a text: runs of lower-cased letters, digits and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Buckets(dict):
    """A feature's bucket: its bytes' CRC-32 modulo the number of buckets."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest = buckets, longest

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        self[feature] = out = zlib.crc32(feature) % self.buckets
        return out

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """How many words the text has, and the buckets of all runs of 1 to longest consecutive words."""
        held = words(text)
        features = held if self.longest == 1 else [b" ".join(held[i : i + n]) for n in range(1, self.longest + 1) for i in range(len(held) - n + 1)]
        return len(held), np.fromiter(map(self.__getitem__, features), np.int32, len(features))


def counts(rows: DataFrame, buckets: int = 10_000, longest: int = 1, text: str = "text") -> np.ndarray:
    """How many features of all texts each bucket holds. Null texts have none. A partition's counts are one row for each bucket it has, summed by groupBy; as many rows as buckets reach the driver."""
    small_batches(rows.sparkSession)

    def run(batches):
        total, of = np.zeros(buckets, np.int64), Buckets(buckets, longest)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += np.bincount(of.of(t)[1], minlength=buckets) if t else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "many"])

    out = np.zeros(buckets, np.int64)
    for r in pick(rows, text).mapInArrow(run, "bucket int, many long").groupBy("bucket").agg(F.sum("many").alias("many")).collect():
        out[r.bucket] = r.many
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket the logarithm of its smoothed share of the target over that of the raw features, in thousandths rounded down."""
    m = len(raw)
    s_all, t_all = int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + m) / ((s + 1) * (t_all + m)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def noise(seed: str, doc_id: int | None) -> int:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of the SHA-256 of `seed:doc_id`."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, seed: str, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document: the gains of its features, summed, and with noise."""

    def run(batches):
        of = Buckets(len(gain), longest)
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for i, t in zip(ids, batch.column("text").to_pylist()):
                n, at = of.of(t)
                weight = int(gain[at].sum())
                out.append((n, len(at), weight, weight + noise(seed, i)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in zip(*out)]], names=["doc_id", "n_words", "n_features", "weight", "score"]) if out else batch.schema.empty_table().to_batches()[0]

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


# ---------------------------------------------------------------- sorted runs, and their merging

#: Numbers of a row in a segment; the first three are its key.
_NUMBERS = ("fall", "doc_id", "place", "n_features", "weight")
#: Stands for a null doc_id, which so comes first among equal scores.
_NULL = -(1 << 63)


class Tournament:
    """A tree of matches between the heads of sorted runs. Each node holds the leaf that won below it, so a new head of any leaf plays along one path."""

    def __init__(self):
        self.size, self.heads, self.won, self.free = 1, [None], [0, 0], [0]

    def _first(self, a: int, b: int) -> int:
        x, y = self.heads[a], self.heads[b]
        return a if y is None or x is not None and x <= y else b

    def _double(self) -> None:
        self.free += range(2 * self.size - 1, self.size - 1, -1)
        self.heads += [None] * self.size
        self.size *= 2
        self.won = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            self.won[node] = self._first(self.won[2 * node], self.won[2 * node + 1])

    def place(self, leaf: int, head) -> None:
        """The leaf's run has this head now; None: it has ended, and the leaf is free."""
        self.heads[leaf] = head
        if head is None:
            self.free.append(leaf)
        node = (self.size + leaf) >> 1
        while node:
            self.won[node] = self._first(self.won[2 * node], self.won[2 * node + 1])
            node >>= 1

    def enter(self, head) -> int:
        """A free leaf for a run with this head."""
        if not self.free:
            self._double()
        leaf = self.free.pop()
        self.place(leaf, head)
        return leaf

    @property
    def best(self) -> int | None:
        """The leaf with the smallest head, None if all runs have ended."""
        leaf = self.won[1]
        return leaf if self.heads[leaf] is not None else None


def merged(segments):
    """The rows of sorted segments (lists of tuples) in order. Segments come by their first rows, so only those that overlap are held; each is a run of the tournament."""
    tree, runs = Tournament(), {}

    def take(leaf: int):
        rows, at = runs[leaf]
        if at + 1 < len(rows):
            runs[leaf] = rows, at + 1
            tree.place(leaf, rows[at + 1])
        else:
            del runs[leaf]
            tree.place(leaf, None)
        return rows[at]

    for rows in segments:
        while (leaf := tree.best) is not None and tree.heads[leaf] <= rows[0]:
            yield take(leaf)
        runs[tree.enter(rows[0])] = rows, 0
    while (leaf := tree.best) is not None:
        yield take(leaf)


def _ranges(fall: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, fall, side="right")


def _range_counts(bounds: np.ndarray):
    def run(batches):
        total = np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            total += np.bincount(_ranges(np.asarray(batch.column(0)), bounds), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["range", "many"])

    return run


def _segments(bounds: np.ndarray, last: int):
    """Rows of sorted runs to (range, fall, doc_id, place, rows): sorted pieces of a range each, with the first row's key and all rows' numbers. A step back in order starts another run."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = [np.asarray(batch.column(c)) for c in _NUMBERS]
            if not n:
                continue
            at = _ranges(x[0], bounds)
            a, b, c = x[:3]
            back = (a[1:] < a[:-1]) | (a[1:] == a[:-1]) & ((b[1:] < b[:-1]) | (b[1:] == b[:-1]) & (c[1:] < c[:-1]))
            edge = np.unique(np.concatenate([[0], 1 + np.flatnonzero(back | (at[1:] != at[:-1])), np.arange(0, n, SEGMENT), [n]]))
            rows = np.stack(x, 1)
            out = [(int(at[i]), *map(int, rows[i, :3]), rows[i:j].astype("<i8").tobytes()) for i, j in zip(edge[:-1], edge[1:]) if at[i] <= last]
            if out:
                r, a, b, c, held = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), *[pa.array(v, pa.int64()) for v in (a, b, c)], pa.array(held, pa.binary())], names=["range", "fall", "doc_id", "place", "rows"])

    return run


def _drawn(before: dict[int, int], draw: int):
    """Segments, sorted by range and first key, to the range's rows with their ranks, as far as the draw goes. before: the rows of the ranges above."""

    def run(batches):
        def segments():
            for batch in batches:
                for r, held in zip(batch.column("range").to_pylist(), batch.column("rows").to_pylist()):
                    yield r, list(map(tuple, np.frombuffer(held, "<i8").reshape(-1, len(_NUMBERS)).tolist()))

        out = []
        for r, group in itertools.groupby(segments(), key=lambda s: s[0]):
            rest = draw - before[r]
            for rank, row in enumerate(itertools.islice(merged(rows for _, rows in group), max(0, rest)), before[r] + 1):
                out.append((*row, rank))
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[*_NUMBERS, "rank"])
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[*_NUMBERS, "rank"])

    return run


def drawn(eligible: DataFrame, draw: int, rows: int) -> DataFrame:
    """fall (the negative score), doc_id, place, n_features, weight and rank of the first rows, as many as draw says, of so many eligible ones, by (fall, doc_id, place).

    Each partition's rows are sorted and stored as a run. Ranges of falls, cut at approximate quantiles, are counted exactly, so a range knows how many rows come before it;
    those behind the last one that is needed aren't read. A range's rows come as segments of the runs, by their first keys, and a tournament merges them and stops at the draw.
    """
    runs = stored(eligible.sortWithinPartitions("fall", "doc_id", "place").select(*_NUMBERS), "runs")
    many = max(1, min(-(-draw // SEGMENT), max(parts(eligible), -(-draw // RANGE_ROWS))))
    shares = [x / many * draw / rows for x in range(1, 2 * many + 1) if x * draw < many * rows]
    bounds = np.zeros(0, np.int64)
    if shares:
        bounds = np.unique(np.array(runs.agg(F.percentile_approx("fall", shares, max(10_000, 100 * many)).alias("x")).first().x, np.int64))
    held = {r.range: r.many for r in runs.select("fall").mapInArrow(_range_counts(bounds), "range int, many long").groupBy("range").agg(F.sum("many").alias("many")).collect()}  # a row for each range
    before = dict(zip(sorted(held), itertools.accumulate([0, *[held[r] for r in sorted(held)]])))
    last = max(r for r, n in before.items() if n < draw)
    wanted = runs.where(F.col("fall") < int(bounds[last])) if last < len(bounds) else runs
    key = ["range", "fall", "doc_id", "place"]
    cut = wanted.mapInArrow(_segments(bounds, last), "range int, fall long, doc_id long, place long, rows binary")
    return cut.repartition(parts(eligible), "range").sortWithinPartitions(*key).mapInArrow(_drawn(before, draw), ", ".join(f"{c} long" for c in (*_NUMBERS, "rank")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: str = "2024", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document: those with the highest scores, percent of the documents with least_words words, have ranks 1, 2, ...

    A feature is a run of 1 to longest words; its bucket's gain is the logarithm of the target's share over the documents'. A weight is the sum of gains, a score is that and Gumbel noise of the id, so that ranks are a draw
    without replacement in proportion to exp(weight / 1000). Ties go to the smaller doc_id, then to the row read first. Null texts have no words; no features weigh 0. A null doc_id
    has the noise of an empty one and goes first among ties (-2 ** 63 stands for it). Repeated rows count each; an empty table gives no rows; an empty target has even shares. Other columns are not read.

    Texts are read twice: for the buckets' counts and for the weights, which are stored. Counts (as many as buckets) and the ranges' sizes are all that reaches the driver.
    """
    gain = gains(counts(docs, buckets, longest), counts(target, buckets, longest, target_text))
    scored = stored(weighed(docs, gain, seed, longest).withColumn("place", F.monotonically_increasing_id()), "weighed")
    keyed = scored.select("*", (-F.col("score")).alias("fall"), F.coalesce("doc_id", F.lit(_NULL)).alias("id"))
    fits = keyed.where(F.col("n_words") >= least_words)
    rows = fits.count()
    draw = rows * percent // 100
    none = F.lit(None).cast("long").alias("rank")
    names = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return scored.select(*names, none)
    taken = stored(drawn(fits.select("fall", F.col("id").alias("doc_id"), "place", "n_features", "weight"), draw, rows), "drawn")
    end = taken.where(F.col("rank") == draw).first()
    behind = (F.col("fall") > end.fall) | (F.col("fall") == end.fall) & ((F.col("id") > end.doc_id) | (F.col("id") == end.doc_id) & (F.col("place") > end.place))
    rest = keyed.where((F.col("n_words") < least_words) | behind).select(*names, none)
    return taken.select(F.nullif("doc_id", F.lit(_NULL)).alias("doc_id"), "n_features", "weight", (-F.col("fall")).alias("score"), "rank").unionByName(rest)
