"""Removal of repeated passages by distributed prefix doubling.

Every byte of a string of `length` bytes that also starts anywhere else is removed. Ranks are made for marks instead of all positions: a text's start and end,
and its anchors, positions whose next few bytes have a hash of a given form. They depend on content alone, so equal passages have equal anchors.

* Round 0 ranks the segments from each mark to the end of the next one, by fingerprints of 96 bits.
* Round r ranks pairs of the ranks at marks j and j + 2 ** (r - 1), so equal ranks mean 2 ** r equal segments. Marks whose rank is unique go no further, and
  no run grows past what the threshold asks: the windows that start between two marks (a cell) lie in a run of some c segments, whose rank is that of the
  two runs of 2 ** r segments at its ends. If a cell's run is repeated, all its windows are.
* Of other cells only windows whose inner segments are repeated go on; they are sorted one by one by fingerprints of 128 bits of all their bytes, as are
  windows with fewer than two anchors. Of a repeated run, one cell's windows go along if its inner segments stand more often than the run.

Texts are ranked in chunks. A chunk sends each pair of a round once, to the bucket of its hash, so a passage that most documents share sends a pair from each
chunk; a bucket sorts its pairs and answers with the ranks of those that stand more than once. Of equal single windows of a task, one goes on for all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _B_INV, buffer_of, mixed, parts, powers, prefix_hash, sent, slices, small_batches, span_hash, stored

#: One position in so many is an anchor, where windows are long enough.
SPACING = 48
#: So often or more.
_MANY = 65535
#: Marks in a chunk, about.
CHUNK = 60_000
_MIX = np.random.default_rng(20250311).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _second_sums(raw: np.ndarray) -> np.ndarray:
    """As prefix_hash(), by another hash."""
    out = np.empty(len(raw) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_MIX[raw] * powers(len(raw), _BASE, "second"), out=out[1:])
    return out


def _second(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * powers(len(sums), _BASE_INV, "second inverse")[start] + (end - start).astype(np.uint64))


class Marks:
    """Marks of the texts of a slice. start, end: the bytes that a mark covers; doc: its text; first: each text's first mark (one more at the end).

    A mark j but a text's last begins the segment from start[j] to end[j + 1], and the cell of windows that start at start[j] .. last[j] (none if last is smaller).
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, sums: np.ndarray, length: int):
        k = max(1, min(32, length // 8))
        if len(raw) < k:
            spots = np.zeros(0, np.int64)
        else:
            code = (sums[k:] - sums[:-k]) * powers(len(sums), _B_INV, "inv")[: len(raw) - k + 1]
            code ^= code >> np.uint64(29)
            code *= np.uint64(0xBF58476D1CE4E5B9)
            spots = np.flatnonzero(code <= np.uint64((1 << 64) // max(1, min(SPACING, (length - k) // 8)) - 1))
        doc = np.searchsorted(at, spots, side="right") - 1
        inside = (spots + k <= at[doc + 1]) & (spots > at[doc])
        spots, doc = spots[inside], doc[inside]
        texts = np.arange(len(at) - 1)
        many = np.bincount(doc, minlength=len(texts)) + 2
        self.first = np.concatenate([[0], np.cumsum(many)])
        total = int(self.first[-1])
        self.doc = np.repeat(texts, many)
        self.start, self.end = np.empty(total, np.int64), np.empty(total, np.int64)
        place = np.arange(len(spots)) + 2 * doc + 1
        self.start[place], self.end[place] = spots, spots + k
        self.start[self.first[:-1]] = self.end[self.first[:-1]] = at[:-1]
        self.start[self.first[1:] - 1] = self.end[self.first[1:] - 1] = at[1:]
        self.segment = np.ones(total, bool)
        self.segment[self.first[1:] - 1] = False
        after = np.concatenate([self.start[1:], at[-1:]])
        self.last = np.where(self.segment, np.minimum(after - 1, at[self.doc + 1] - length), -1)
        self.last = np.where(self.last < self.start, -1, self.last)
        cell = np.flatnonzero(self.last >= 0)
        # segments that hold all of a cell's windows, and those between anchors in its first window: a text's end is no mark of the same bytes elsewhere
        self.run, self.inner = np.zeros(total, np.int64), np.zeros(total, np.int64)
        self.run[cell] = np.searchsorted(self.end, self.last[cell] + length, side="left") - cell
        reach = np.minimum(np.searchsorted(self.end, self.start[cell] + length, side="right") - 1, self.first[self.doc[cell] + 1] - 2)
        self.inner[cell] = reach - cell - 1


def _log2(x: np.ndarray) -> np.ndarray:
    """The largest r with 2 ** r <= x, for x of 1 or more."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64) - 1


def _fewest(deep: np.ndarray, j: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Whether the run of so many segments from mark j may be repeated: those of a power of two at its ends are. No segments may always be."""
    out = run <= 0
    some = np.flatnonzero(~out)
    r = _log2(run[some])
    out[some] = (deep[j[some]] > r) & (deep[j[some] + run[some] - (1 << r)] > r)
    return out


# ---------------------------------------------------------------- chunks and their rounds


class Chunk:
    """Marks of some texts, each text's last one left out.

    head: (doc, text) of each text; many: its marks. deep: rounds that a mark's rank was repeated in. most: how often a cell's inner segments
    stand at most. done: cells whose run is repeated; told: those of them whose windows go along. x: in round 0 with y the segments' names, then the ranks of
    marks with deep == level. A name is two 64-bit numbers.
    """

    def __init__(self, head, many, run, inner, deep, most, done, told, x, y, level):
        self.head, self.many, self.run, self.inner, self.deep, self.most, self.done, self.told, self.x, self.y, self.level = head, many, run, inner, deep, most, done, told, x, y, level

    def packed(self) -> bytes:
        small = np.array([len(self.head), len(self.run), len(self.x), self.level], "<i8")
        bits = np.concatenate([np.packbits(self.done), np.packbits(self.told)])
        x = np.ascontiguousarray(self.x, "<u8").view(np.uint8).reshape(-1, 8).T  # by bytes, which compresses ranks
        return b"".join(a.tobytes() for a in (small, self.head.astype("<i8"), self.many.astype("<i4"), self.run.astype("<u2"), self.inner.astype("<i2"), self.deep, self.most.astype("<u2"), bits, x, self.y.astype("<u4")))

    @classmethod
    def unpacked(cls, blob: bytes) -> Chunk:
        texts, n, names, level = np.frombuffer(blob, "<i8", 4).tolist()
        at = 32

        def take(kind: str, many: int):
            nonlocal at
            out = np.frombuffer(blob, kind, many, at)
            at += out.nbytes
            return out

        head, many, run, inner = take("<i8", 2 * texts).reshape(-1, 2), take("<i4", texts).astype(np.int64), take("<u2", n).astype(np.int64), take("<i2", n).astype(np.int64)
        deep, most = take("u1", n).copy(), take("<u2", n).astype(np.int64)
        done, told = (np.unpackbits(take("u1", -(-n // 8)), count=n).astype(bool) for _ in range(2))
        x = np.ascontiguousarray(take("u1", 8 * names).reshape(8, -1).T).view("<u8").ravel()
        return cls(head, many, run, inner, deep, most, done, told, x, take("<u4", names if level == 0 else 0).astype(np.uint64), level)

    def asked(self):
        """The round's names: (x, y, marks to rank, cells to judge); names of marks come first."""
        if self.level == 0:
            return self.x, self.y, np.arange(len(self.run)), np.zeros(0, np.int64)
        half = 1 << (self.level - 1)
        live = np.flatnonzero(self.deep == self.level)
        rank = np.zeros(len(self.run), np.uint64)
        rank[live] = self.x
        text = np.repeat(np.arange(len(self.many)), self.many)
        end = np.repeat(np.cumsum(self.many), self.many)
        longest = np.maximum.reduceat(self.run, np.cumsum(self.many) - self.many) if len(self.many) else np.zeros(0, np.int64)
        j = live[(live + half < end[live]) & (longest[text[live]] >= 2 * half)]
        j = j[rank[j + half] > 0]
        c = live[(self.run[live] > half) & (self.run[live] < 2 * half)]
        c = c[rank[c + self.run[c] - half] > 0]
        x = np.concatenate([rank[j], rank[c]])
        y = np.concatenate([rank[j + half], rank[c + self.run[c] - half] | (self.run[c].astype(np.uint64) << np.uint64(48))])
        return x, y, j, c

    def advance(self, j: np.ndarray, c: np.ndarray, rank: np.ndarray, often: np.ndarray, own: np.ndarray) -> None:
        """Takes the ranks (0: unique) of the names asked, how often they stand, and of which this is the one place that tells of all."""

        def judge(cell, repeated, often, own):
            self.done[cell[repeated]] = True
            self.told[cell[repeated & own & ((self.most[cell] > often) | (self.most[cell] == _MANY))]] = True

        n = len(j)
        judge(c, rank[n:] > 0, often[n:], own[n:])
        kept = rank[:n] > 0
        self.deep[j[kept]] = self.level + 1
        count = np.zeros(len(self.run), np.int64)
        count[j] = np.minimum(often[:n], _MANY)
        size = 1 << self.level
        cell = np.flatnonzero((self.inner >= size) & (self.inner < 2 * size))
        self.most[cell] = np.minimum(count[cell + 1], count[cell + 1 + self.inner[cell] - size])
        exact = self.run[j] == size  # the cell's run is just this one
        judge(j[exact], kept[exact], often[:n][exact], own[:n][exact])
        self.level += 1
        self.x, self.y = rank[:n][kept], np.zeros(0, np.uint64)


def _sorted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that has equal names together, and a hash of each name in it, which grows."""
    code = mixed(x ^ mixed(y))
    order = np.argsort(code)
    code, a, b = code[order], x[order], y[order]
    if ((code[1:] == code[:-1]) & ((a[1:] != a[:-1]) | (b[1:] != b[:-1]))).any():  # names with the same hash
        order = np.lexsort((y, x, mixed(x ^ mixed(y))))
    return order, code


def _dealt(x: np.ndarray, y: np.ndarray, buckets: int):
    """(order, first, often, bounds): an order by bucket and name, where each distinct name begins in it, how often it stands, and bounds of the buckets in the distinct names."""
    order, code = _sorted(x, y)
    a, b = x[order], y[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(x) else np.zeros(0, np.int64)
    often = np.diff(np.concatenate([first, [len(x)]]))
    bucket = (code[first] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return order, first, often, np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))


_SENT = "bucket int, chunk long, blob binary"
#: A rank is a bucket's number and a name's place in it; with a run beside it, 48 bits are all there are. Beyond them is an error: ranks must never meet.
BUCKET_BITS, PLACE_BITS = 20, 28
#: Names that a bucket should have at most: they are ranked together.
BUCKET_NAMES = 1 << 23
#: For a bucket: a chunk that has names to ask, and one that hasn't.
_ASKS, _ENDED = -1, -2


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "chunk", "blob"])


def _batched(rows, most: int = 1 << 18):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= most:
            yield _sent(held)
            held, size = [], 0
    if held:
        yield _sent(held)


def _names(buckets: int):
    """Chunks to their names of the round, by bucket, each once, and how often it stands there."""

    def rows(batches):
        for batch in batches:
            for number, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist()):
                chunk = Chunk.unpacked(blob)
                x, y, _, _ = chunk.asked()
                order, first, often, bounds = _dealt(x, y, buckets)
                at = order[first]
                a, b = x[at], y[at].astype("<u4" if chunk.level == 0 else "<u8")
                for k in np.flatnonzero(np.diff(bounds)).tolist():
                    i, j = bounds[k], bounds[k + 1]
                    yield k, number, b"".join((np.array([j - i, b.itemsize], "<i4").tobytes(), a[i:j].tobytes(), b[i:j].tobytes(), often[i:j].astype("<u4").tobytes()))

    return lambda batches: _batched(rows(batches))


def _ranks(batches):
    """Names sorted by bucket to each chunk's answers: which of its names stand more than once, which of those it tells of, their ranks, and how often they stand."""

    def rows():
        at, held = None, []
        for batch in batches:
            for bucket, number, blob in zip(*[batch.column(c).to_pylist() for c in ("bucket", "chunk", "blob")]):
                if bucket != at and held:
                    yield from answers(at, held)
                    held = []
                at = bucket
                held.append((number, blob))
        if held:
            yield from answers(at, held)

    def answers(bucket: int, held: list[tuple]):
        xs, ys, ws, ends = [], [], [], [0]
        for _, blob in held:
            n, wide = np.frombuffer(blob, "<i4", 2).tolist()
            xs.append(np.frombuffer(blob, "<u8", n, 8))
            ys.append(np.frombuffer(blob, f"<u{wide}", n, 8 + 8 * n).astype(np.uint64))
            ws.append(np.frombuffer(blob, "<u4", n, 8 + (8 + wide) * n))
            ends.append(ends[-1] + n)
        x, y, w = (np.concatenate(z) for z in (xs, ys, ws))
        order, _ = _sorted(x, y)
        a, b = x[order], y[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        group = np.cumsum(new) - 1
        if group[-1] + 1 >= 1 << PLACE_BITS:
            raise OverflowError(f"bucket {bucket} has {group[-1] + 1} names, more than its ranks can tell apart: ask for more partitions")
        total = np.bincount(group, weights=w[order]).astype(np.int64)
        rank, often, own = np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint32), np.zeros(len(x), bool)
        rank[order] = np.where(total[group] > 1, (np.uint64(bucket) << np.uint64(PLACE_BITS)) + group.astype(np.uint64) + np.uint64(1), np.uint64(0))
        often[order] = np.minimum(total, 2**32 - 1)[group]
        own[order[new]] = True
        for (number, _), i, j in zip(held, ends, ends[1:]):
            mine = rank[i:j]
            kept = mine > 0
            if kept.any():
                told = (np.packbits(kept), np.packbits(own[i:j][kept]), np.ascontiguousarray(mine[kept]).view(np.uint8).reshape(-1, 8).T, np.ascontiguousarray(often[i:j][kept]).view(np.uint8).reshape(-1, 4).T)
                yield bucket, number, b"".join(z.tobytes() for z in told)

    return _batched(rows())


def _advanced(buckets: int):
    """Chunks, each followed by its answers, to chunks of the next round."""

    def rows(batches):
        number, chunk = None, None

        def closed():
            size, rank, often, own = np.diff(np.concatenate([first, [len(x)]])), np.zeros(len(x), np.uint64), np.zeros(len(x), np.int64), np.zeros(len(x), bool)
            rank[order], often[order], own[order[first]] = np.repeat(told, size), np.repeat(counts, size), mine
            chunk.advance(j, c, rank, often, own)
            return _ASKS if len(chunk.asked()[0]) else _ENDED, number, chunk.packed()

        for batch in batches:
            for bucket, which, blob in zip(*[batch.column(c).to_pylist() for c in ("bucket", "chunk", "blob")]):
                if bucket < 0:
                    if chunk is not None:
                        yield closed()
                    number, chunk = which, Chunk.unpacked(blob)
                    x, y, j, c = chunk.asked()
                    order, first, _, bounds = _dealt(x, y, buckets)
                    told, counts, mine = np.zeros(len(first), np.uint64), np.zeros(len(first), np.int64), np.zeros(len(first), bool)
                else:
                    a, b = bounds[bucket], bounds[bucket + 1]
                    at = -(-(b - a) // 8)
                    kept = a + np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, at), count=b - a))
                    n = len(kept)
                    bits = -(-n // 8)
                    mine[kept] = np.unpackbits(np.frombuffer(blob, np.uint8, bits, at), count=n).astype(bool)
                    told[kept] = np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * n, at + bits).reshape(8, n).T).view("<u8").ravel()
                    counts[kept] = np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * n, at + bits + 8 * n).reshape(4, n).T).view("<u4").ravel()
        if chunk is not None:
            yield closed()

    return lambda batches: _batched(rows(batches))


def _chunked(length: int):
    """Rows of (doc, text_id, text) to chunks with the names of their segments."""

    def rows(batches):
        held, count, number = [], 0, TaskContext.get().partitionId() << 24

        def closed():
            return _ASKS, number, Chunk(*[np.concatenate(z) for z in zip(*held)], 0).packed()

        for whole in batches:
            for batch in slices(whole, "text"):
                raw, at = buffer_of(batch.column("text"))
                sums, other = prefix_hash(raw), _second_sums(raw)
                m = Marks(raw, at, sums, length)
                j = np.flatnonzero(m.segment)
                head = np.stack([np.asarray(batch.column(c)) for c in ("doc", "text_id")], 1)
                x, y = (f(s, m.start[j], m.end[j + 1]) for f, s in ((span_hash, sums), (_second, other)))
                held.append((head, np.diff(m.first) - 1, m.run[j], m.inner[j], np.zeros(len(j), np.uint8), np.full(len(j), _MANY), np.zeros(len(j), bool), np.zeros(len(j), bool), x, y & np.uint64(0xFFFFFFFF)))
                count += len(j)
                if count >= CHUNK:
                    yield closed()
                    held, count, number = [], 0, number + 1
        if held:
            yield closed()

    return lambda batches: _batched(rows(batches))


_TOLD = "doc long, text_id int, deep binary, done binary, told binary"


def _judged(batches):
    """Chunks after the last round to the texts that have repeated cells, or windows that may be repeated."""
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            chunk = Chunk.unpacked(blob)
            end, deep, rows = np.cumsum(chunk.many), np.concatenate([chunk.deep, [0]]), []
            cell = np.flatnonzero(chunk.run > 0)
            open_ = np.zeros(len(chunk.run), bool)
            open_[cell] = _fewest(deep, np.minimum(cell + 1, len(chunk.run)), chunk.inner[cell])
            open_ |= chunk.done
            some = np.add.reduceat(open_, end - chunk.many) > 0 if len(end) else []
            for k in np.flatnonzero(some).tolist():
                i, j = end[k] - chunk.many[k], end[k]
                rows.append((*chunk.head[k].tolist(), chunk.deep[i:j].tobytes(), np.packbits(chunk.done[i:j]).tobytes(), np.packbits(chunk.told[i:j]).tobytes()))
            for i in range(0, len(rows), 5_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 5_000]), (pa.int64(), pa.int32(), *[pa.binary()] * 3))], names=["doc", "text_id", "deep", "done", "told"])


def doubled(rows: DataFrame, length: int) -> DataFrame:
    """doc, text_id, deep, done, told of the texts (doc, text_id, text) that have repeated cells, or windows that may be repeated."""
    chunks, ended = stored(rows.mapInArrow(_chunked(length), _SENT), "chunks"), []
    buckets = max(parts(rows), -(-chunks.count() * CHUNK // BUCKET_NAMES))
    if buckets > 1 << BUCKET_BITS:
        raise OverflowError(f"{buckets} buckets are more than ranks can tell apart")
    while not (asking := chunks.where(F.col("bucket") == _ASKS)).isEmpty():  # some log2(length) rounds, as 2 ** rounds segments have more bytes than a window
        ended.append(chunks.where(F.col("bucket") == _ENDED))
        names = asking.mapInArrow(_names(buckets), _SENT).repartition(buckets, "bucket").sortWithinPartitions("bucket")
        both = asking.unionByName(names.mapInArrow(_ranks, _SENT)).repartition(buckets, "chunk").sortWithinPartitions("chunk", "bucket")
        chunks = stored(both.mapInArrow(_advanced(buckets), _SENT), "chunks")
    for more in ended:
        chunks = chunks.unionByName(more)
    return stored(chunks.mapInArrow(_judged, _TOLD).dropDuplicates(["doc", "text_id"]), "judged")  # equal rows tell the same


# ---------------------------------------------------------------- single windows

#: x, y: a window's fingerprint, but y's lowest two bits, which hold the weight. spot: the text's number (32 bits) and the window's start.
_ROW = np.dtype([("x", "<i8"), ("y", "<i8"), ("doc", "<i8"), ("spot", "<i8")])
_ROWS = "x long, y long, doc long, spot long"
#: Start of a window that only tells others: its own cell is known to be repeated.
_TELLS = 0xFFFFFFFF
#: Weight of a run of windows that are settled already, as others of their task are the same; y holds their number.
_DONE = 3


def _runs(rows: np.ndarray) -> np.ndarray:
    """Where runs of equal windows begin."""
    y = rows["y"] >> 2
    return np.flatnonzero(np.concatenate([[True], (rows["x"][1:] != rows["x"][:-1]) | (y[1:] != y[:-1])])) if len(rows) else np.zeros(0, np.int64)


def _record(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])) for c in rows.dtype.names], names=list(rows.dtype.names))


def _settled(rows: np.ndarray):
    """A task's windows: of equal ones, one goes on for all; the others are settled, and those side by side are one row."""
    rows = rows[np.lexsort((rows["y"], rows["x"]))]
    start = _runs(rows)
    again = np.ones(len(rows), bool)
    again[start] = False
    weight = np.minimum(2, np.add.reduceat(rows["y"] & 3, start))
    one, done = rows[start], rows[again]
    one["y"] += weight - (one["y"] & 3)
    done = done[done["spot"] & _TELLS != _TELLS]
    done = done[np.lexsort((done["spot"], done["doc"]))]
    if len(done):
        begin = np.flatnonzero(np.concatenate([[True], (done["doc"][1:] != done["doc"][:-1]) | (done["spot"][1:] != done["spot"][:-1] + 1)]))
        size = np.diff(np.concatenate([begin, [len(done)]]))
        done = done[begin]
        done["y"] = size << 2 | _DONE
        done["x"] = mixed(done["doc"].astype(np.uint64) + done["spot"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)  # not dealt by a window that most texts share
    for part in (one, done):
        for i in range(0, len(part), 20_000):
            yield _record(part[i : i + 20_000])


def _windows(length: int, most: int = 200_000):
    """Rows of (doc, text_id, text, deep, done, told) to rows of the windows that may be repeated and lie in no repeated cell, and of those that tell them."""

    def run(batches):
        held, count = [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, at = buffer_of(batch.column("text"))
                sums, other = prefix_hash(raw), _second_sums(raw)
                m = Marks(raw, at, sums, length)
                j = np.flatnonzero(m.segment)
                deep, done, tells = np.zeros(len(m.start) + 1, np.uint8), np.zeros(len(m.start), bool), np.zeros(len(m.start), bool)
                deep[j] = np.frombuffer(b"".join(batch.column("deep").to_pylist()), np.uint8)
                many = (np.diff(m.first) - 1).tolist()
                for bits, c in ((done, "done"), (tells, "told")):
                    bits[j] = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(batch.column(c).to_pylist(), many)])
                cell = np.flatnonzero((m.last >= 0) & (~done | tells))
                top, last = np.where(tells[cell], m.last[cell], -1), m.first[m.doc[cell] + 1] - 2
                live, inner = np.flatnonzero(~tells[cell]), m.inner[cell]
                while len(live):  # as many inner segments as may be repeated; windows that end before one more does
                    k = cell[live]
                    ok = _fewest(deep, k + 1, inner[live])
                    live, k = live[ok], k[ok]
                    beyond = k + 1 + np.maximum(inner[live], -1) + 1
                    end = np.where(beyond <= last[live], m.end[np.minimum(beyond, len(m.end) - 1)] - length - 1, m.last[k])
                    top[live] = np.maximum(top[live], np.minimum(m.last[k], end))
                    inner[live] += 1
                    live = live[top[live] < m.last[k]]
                n = np.maximum(0, top - m.start[cell] + 1)
                b = np.repeat(m.start[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                d, knows = np.repeat(m.doc[cell], n), np.repeat(tells[cell], n)
                doc, text = (np.asarray(batch.column(c)) for c in ("doc", "text_id"))
                for i in range(0, len(b), most):
                    s, e, known = b[i : i + most], d[i : i + most], knows[i : i + most]
                    rows = np.zeros(len(s), _ROW)
                    rows["x"], rows["y"] = span_hash(sums, s, s + length).view(np.int64), _second(other, s, s + length).view(np.int64) & ~3 | 1 + known
                    rows["doc"], rows["spot"] = doc[e], text[e].astype(np.int64) << 32 | np.where(known, _TELLS, s - at[e])
                    held.append(rows)
                    count += len(rows)
                    if count >= most:
                        yield from _settled(np.concatenate(held))
                        held, count = [], 0
        if count:
            yield from _settled(np.concatenate(held))

    return run


_FOUND = "doc long, text_id int, place int, many int"


def _compared(batches):
    """Sorted windows to those that are repeated: so many side by side from place on."""

    def told(rows: np.ndarray, many=None):
        mine = rows["spot"] & _TELLS != _TELLS
        rows, many = rows[mine], np.ones(int(mine.sum()), np.int32) if many is None else many[mine].astype(np.int32)
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            cols = (part["doc"], (part["spot"] >> 32).astype(np.int32), (part["spot"] & _TELLS).astype(np.int32), many[i : i + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["doc", "text_id", "place", "many"])

    def often(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        return rows[np.repeat(np.add.reduceat(rows["y"] & 3, start) > 1, np.diff(np.concatenate([start, [len(rows)]])))]

    kept = np.zeros(0, _ROW)
    for batch in batches:
        rows = np.zeros(batch.num_rows, _ROW)
        for c in _ROW.names:
            rows[c] = np.asarray(batch.column(c))
        done = rows["y"] & 3 == _DONE
        yield from told(rows[done], rows["y"][done] >> 2)
        rows = np.concatenate([kept, rows[~done]])
        if not len(rows):
            continue
        start = _runs(rows)
        if len(start) > 1:
            yield from told(often(rows[: start[-1]], start[:-1]))
        kept = rows[start[-1] :]
        if len(kept) > 100_000:  # one stands for those so far
            yield from told(kept[1:])
            kept = kept[:1].copy()
            kept["y"] = kept["y"] >> 2 << 2 | 2
    if len(kept):
        yield from told(often(kept, np.zeros(1, np.int64)))


# ---------------------------------------------------------------- removal


def _named(docs: DataFrame) -> DataFrame:
    """docs with _doc and _text (32 bits): what tells a row's text from others. Rows with the same doc_id and text share them; _doc is the id where it stands once."""
    again = stored(docs.groupBy(F.col("doc_id").cast("long").alias("_again")).count().where("count > 1").select("_again"), "again")
    own = F.xxhash64(F.col("doc_id").cast("long"), "text")
    named = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), own)).withColumn("_text", F.hash("text"))
    if again.isEmpty():
        return named
    return named.join(sent(again), F.col("doc_id").cast("long") == F.col("_again"), "left").withColumn("_doc", F.when(F.col("_again").isNull(), F.col("_doc")).otherwise(own)).drop("_again")


def repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """_doc, _text, done, places: a bit for each cell, and runs of single windows (place, many), that are repeated; of each text that has any. docs: doc_id, text, _doc, _text."""
    if not 2 <= length < 1 << 15:
        raise ValueError("length must be 2 to 32767")
    long = docs.where(F.octet_length("text") >= length).select(F.col("_doc").alias("doc"), F.col("_text").alias("text_id"), "text")
    key = ["doc", "text_id"]
    per = doubled(long, length)
    near = long.join(sent(per.select(*key)), key, "left_semi").join(per, key)
    single = near.select(*key, "text", "deep", "done", "told").mapInArrow(_windows(length), _ROWS)
    single = single.repartition(parts(docs), "x").sortWithinPartitions("x", "y").mapInArrow(_compared, _FOUND)
    single = single.groupBy(*key).agg(F.collect_set(F.struct("place", "many")).alias("places"))  # at most as many as a text has bytes
    both = per.join(single, key, "left").select(F.col("doc").alias("_doc"), F.col("text_id").alias("_text"), "done", F.coalesce("places", F.expr("CAST(array() AS array<struct<place: int, many: int>>)")).alias("places"))
    return stored(both.where("size(places) > 0 OR trim(LEADING '0' FROM hex(done)) <> ''"), "repeats")


def _spans(length: int, raw: np.ndarray, done: bytes, places: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs of one text."""
    m = Marks(raw, np.array([0, len(raw)]), prefix_hash(raw), length)
    cell = np.flatnonzero(np.unpackbits(np.frombuffer(done, np.uint8), count=len(m.start) - 1))
    cell = cell[m.last[cell] >= 0]
    place, many = (np.array([p[c] for p in places], np.int64) for c in ("place", "many"))
    start = np.concatenate([m.start[cell], place])
    end = np.concatenate([m.last[cell], place + many - 1]) + length
    step = np.bincount(start, minlength=len(raw) + 1)[: len(raw) + 1] - np.bincount(end, minlength=len(raw) + 1)[: len(raw) + 1]
    covered = np.cumsum(step)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def removed(docs: DataFrame, length: int = 400, whole_characters: bool = False) -> DataFrame:
    """docs with every column, and cut: struct<spans array<struct<start, length>>, kept binary>: the removed runs of bytes and what is left, concatenated.

    A byte is removed if it lies in a string of `length` bytes that also starts anywhere else, in the same text too; overlaps count, and strings are judged
    on the input. Texts are UTF-8 bytes; a null text is empty; no string crosses texts. With whole_characters, characters that a run cuts into go as well,
    so that kept is valid UTF-8. Repeated rows are copies of each other like any others. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    at, id_at = names.index("text"), names.index("doc_id")
    held = [f"_c{i}" for i in range(len(names))]
    plain = docs.toDF(*held)
    plain = plain.withColumn("doc_id", F.col(held[id_at])).withColumn("text", F.coalesce(F.col(held[at]), F.lit("")))
    plain = _named(plain)
    marks = repeats(plain.select("doc_id", "text", "_doc", "_text"), length)

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                out = []
                for text, done, places in zip(*[batch.column(c).to_pylist() for c in ("text", "done", "places")]):
                    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
                    start, end = _spans(length, raw, done, places)
                    if whole_characters:
                        inner = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
                        start, end = start.copy(), end.copy()
                        for j in range(len(start)):
                            while inner(start[j]):
                                start[j] -= 1
                            while inner(end[j]):
                                end[j] += 1
                    keep = np.ones(len(raw), bool)
                    for i, j in zip(start, end):
                        keep[i:j] = False
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], (~keep).astype(np.int8), [0]])))
                    spans = [{"start": int(i), "length": int(j - i)} for i, j in zip(edge[::2], edge[1::2])]
                    out.append({"spans": spans, "kept": raw[keep].tobytes()})
                kind = pa.struct([("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("kept", pa.binary())])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in held], pa.array(out, kind)], names=[*held, "cut"])

    kind = "struct<spans: array<struct<start: bigint, length: bigint>>, kept: binary>"
    schema = T.StructType([*[plain.schema[c] for c in held], T.StructField("cut", T._parse_datatype_string(kind))])
    ids = sent(marks.select("_doc", "_text"))
    near = plain.join(ids, ["_doc", "_text"], "left_semi").join(marks, ["_doc", "_text"]).select(*held, "text", "done", "places")
    far = plain.join(ids, ["_doc", "_text"], "left_anti")
    none = F.struct(F.expr("CAST(array() AS array<struct<start: bigint, length: bigint>>)").alias("spans"), F.col("text").cast("binary").alias("kept"))
    return near.mapInArrow(cut, schema).unionByName(far.select(*held, none.alias("cut"))).toDF(*names, "cut")
