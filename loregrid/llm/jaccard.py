"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles, as 64-bit hashes. In a parity sketch every shingle flips one bit, so the Hamming distance of two
sketches is at most the size of the symmetric difference of the sets; sets with Jaccard similarity t or more differ in at most (1 - t) / (1 + t) of the
sum of their sizes. Pairs are banded by that sum. A band's sketch is cut into more parts than it may have differing bits, so linked sets agree on
several whole parts, and documents are joined by (band, part, bits of the part). Sketches are sparse: a part is the set of its odd bits.

* Sets with few shingles are joined by single bits: each odd bit is a part of its own.
* More parts than needed are made, so that a linked pair agrees on a given number of parts. Parts that are empty, or that very many documents share,
  may then be left out for documents that have few of them. Documents with many of them are joined by their rarest shingles instead.
* Groups of a few documents give all their pairs. Larger ones give each document's pair with the smallest. Groups that still span several components are
  cut into blocks; the sketches of two blocks are compared at once, and pairs across components that may be similar go on. Within a component no pair is
  left to check: links there can't change it.
* Candidates are checked on their texts' full sets.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffer_of, mixed, parts, sent, slices, stored, texts, word_hashes
from .graph import components

#: Groups up to this size give all their pairs at once.
SMALL = 8
#: Sets up to this size are joined by single bits.
FEW = 32
#: Bytes of sketches, by a bound, in a block of a large group's documents that meets others.
BLOCK = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PART = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(raw: np.ndarray, at: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes. A text with fewer words is one shingle; one without words has none."""
    words, first = word_hashes(raw, at)
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        runs = runs * _STEP + words[k : len(words) - width + 1 + k]
    runs, out = mixed(runs), []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        if j - i >= width:
            x = np.sort(runs[i : j - width + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif j > i:
            x = np.zeros(1, np.uint64)
            for w in words[i:j]:
                x = x * _STEP + w
            out.append(mixed(x + np.uint64(j - i)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Bands:
    """Bands of the sum of two sets' sizes, each with its number of parts and the numbers of agreeing parts that may be empty or crowded."""

    def __init__(self, threshold: Fraction):
        self.t = threshold
        self.share = (1 - threshold) / (1 + threshold)
        self.first = math.floor(FEW * (1 + 1 / threshold)) if threshold else 2 * FEW  # sums beyond need larger sets on both sides
        self.ratio = 1.25

    def of(self, total: float) -> int:
        return max(1, 1 + math.floor(math.log(max(total, 1) / self.first) / math.log(self.ratio) + 1e-9))

    def top(self, band: int) -> int:
        return math.ceil(self.first * self.ratio**band)

    def bands(self, n: int) -> range:
        """The bands in which a set of n may meet a linked one; band 0 holds the pairs of small sets."""
        low, high = math.ceil(n * (1 + self.t)), math.floor(n * (1 + 1 / self.t))
        out = range(self.of(low) - (1 if self.of(low) > 1 and low < self.top(self.of(low) - 1) else 0), self.of(high) + 1)
        return out

    def plan(self, band: int) -> tuple[int, int, int]:
        """Parts; empty parts from which on they are joined too; crowded parts from which on a document is joined by its rarest shingles."""
        differ = math.floor(self.share * self.top(band))
        empty, crowded = 2 + math.ceil(0.07 * differ), 1 + math.ceil(0.18 * differ)
        return differ + empty + crowded - 1, empty, crowded


def _keys(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each set's parts in its bands: (key, row of the set, band). Single bits have minus the set's size for a band."""
    out = [[], [], []]

    def put(key, row, band):
        out[0].append(key)
        out[1].append(row)
        out[2].append(np.full(len(key), band, np.int16))

    by: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        if len(s):
            if len(s) <= FEW:
                by.setdefault(0, []).append(i)
            if len(s) > bands.t * FEW:
                for band in bands.bands(len(s)):
                    by.setdefault(band, []).append(i)
    for band, rows in by.items():
        h = np.concatenate([sets[i] for i in rows])
        size = np.array([len(sets[i]) for i in rows])
        row = np.repeat(np.array(rows, np.int64), size)
        if band == 0:
            out[0].append(mixed(h ^ _PART))
            out[1].append(row)
            out[2].append(np.repeat(-size, size).astype(np.int16))
            continue
        n, empty, _ = bands.plan(band)
        mark = np.array([band], np.uint64) * _PART
        part = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)  # grows with h, so a set's parts are in order
        edge = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (row[1:] != row[:-1])]))
        odd = np.bitwise_xor.reduceat(mixed((h & np.uint64(0xFFFFFFF)) + _PART), edge)  # equal bits cancel: parity
        put(mixed(odd + part[edge] * _STEP + mark), row[edge], band)
        held = np.bincount(np.searchsorted(np.array(rows), row[edge]), minlength=len(rows))
        for k in np.flatnonzero(n - held >= empty):
            mine = part[edge][row[edge] == rows[k]]
            gone = np.setdiff1d(np.arange(n, dtype=np.uint64), mine)
            put(mixed(gone * _STEP + mark), np.full(len(gone), rows[k], np.int64), band)
    if not out[0]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int16)
    return tuple(np.concatenate(x) for x in out)


_SETS = "doc_id long, n_shingles long, digest_a long, digest_b long, sketch binary"


def sketch(s: np.ndarray) -> bytes:
    """The whole parity sketch, folded to the power of two of bits that is some four times the set's size."""
    bits = max(64, 1 << int(4 * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s >> np.uint64(7) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def distance(x: bytes, y: bytes) -> int:
    """Hamming distance of two sketches, the longer folded to the shorter: at most the size of the sets' symmetric difference."""
    a, b = (np.frombuffer(z, np.uint8) for z in (x, y))
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(z.reshape(-1, n), axis=0) for z in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _close(threshold: Fraction):
    """Pairs whose sketches allow the similarity."""
    share = (1 - threshold) / (1 + threshold)

    def run(batches):
        for batch in batches:
            rows = [(a, b) for a, b, n, m, x, y in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")]) if distance(x, y) * share.denominator <= share.numerator * (n + m)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b"])

    return run


def _digest(batches, width: int):
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = shingles(*buffer_of(batch.column("text")), width)
            a = [int(np.add.reduce(mixed(s))) if len(s) else 0 for s in sets]
            b = [int(np.bitwise_xor.reduce(mixed(s ^ _STEP))) if len(s) else 0 for s in sets]
            bits = pa.array([sketch(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], bits], names=["doc_id", "n_shingles", "digest_a", "digest_b", "sketch"])


# ---------------------------------------------------------------- groups by the sketches' parts


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts keys, and starts and sizes of runs of equal keys in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return order, start, np.diff(np.concatenate([start, [len(k)]]))


_ENTRY = np.dtype([("key", "<u8"), ("doc", "<i8"), ("band", "<i2")])


def _blobs(threshold: Fraction, width: int, buckets: int, most: int = 300_000):
    """Rows of (doc_id, text) to (bucket, kind, blob). kind 0: entries of a bucket of keys. kind 1: members of keys that are crowded within a task already; the bucket then gets some of them to tell."""

    def run(batches):
        bands, seen, held, count = Bands(threshold), set(), [], 0

        def flush():
            e = np.concatenate(held)
            order, start, size = _groups(e["key"])
            e = e[order]
            big = np.repeat(size > SMALL, size)
            rank = np.arange(len(e)) - np.repeat(start, size)
            out = [(0, e[~big | (rank <= SMALL)])] + ([(1, e[big & (rank > SMALL)])] if big.any() else [])
            for kind, x in out:
                bucket = (x["key"] % np.uint64(buckets)).astype(np.int64) if kind == 0 else np.arange(len(x)) % buckets
                order = np.argsort(bucket, kind="stable")
                x, bounds = x[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [(b, kind, _packed(x[i:j])) for b, (i, j) in enumerate(zip(bounds[:-1], bounds[1:])) if j > i]
                for k in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64]), (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "blob"])

        for whole in batches:
            for batch in slices(whole, "text"):
                ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
                sets = shingles(*buffer_of(batch.column("text")), width)
                for i, s in enumerate(sets):  # equal sets of a task: one stands for all
                    if len(s):
                        mark = (len(s), int(np.add.reduce(mixed(s))))
                        if mark in seen:
                            sets[i] = s[:0]
                        elif len(seen) < 1_000_000:
                            seen.add(mark)
                key, row, band = _keys(sets, bands)
                e = np.empty(len(key), _ENTRY)
                e["key"], e["doc"], e["band"] = key, ids[row], band
                held.append(e)
                count += len(e)
                if count >= most:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()

    return run


def _packed(e: np.ndarray) -> bytes:
    """Entries as columns: documents less the smallest, keys without their lowest byte, bands."""
    least = int(e["doc"].min())
    wide = int(e["doc"].max()) - least >= 1 << 32
    doc = (e["doc"].astype(np.uint64) - np.uint64(least % (1 << 64))).astype("<u8" if wide else "<u4")
    key = np.ascontiguousarray(e["key"]).view(np.uint8).reshape(-1, 8)[:, 1:]
    return np.array([len(e), least, wide], "<i8").tobytes() + doc.tobytes() + key.tobytes() + e["band"].astype("i1").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    n, least, wide = np.frombuffer(blob, "<i8", 3).tolist()
    at, width = 24, 8 if wide else 4
    e, raw = np.zeros(n, _ENTRY), np.zeros((n, 8), np.uint8)
    e["doc"] = (np.frombuffer(blob, f"<u{width}", n, at).astype(np.uint64) + np.uint64(least % (1 << 64))).astype(np.int64)
    raw[:, 1:] = np.frombuffer(blob, np.uint8, 7 * n, at + width * n).reshape(-1, 7)
    e["key"] = raw.view("<u8").ravel()
    e["band"] = np.frombuffer(blob, "i1", n, at + (width + 7) * n)
    return e


_FOUND = "kind int, a long, b long, band int"


def _meet(batches):
    """Blobs sorted by (kind, bucket) to pairs (kind 0: a < b) of small groups and members (kind 1: document b of band) of crowded ones; one bucket is held at a time."""
    held, at = [], None
    for batch in batches:
        for bucket, kind, blob in zip(*[batch.column(c).to_pylist() for c in ("bucket", "kind", "blob")]):
            if kind:
                e = _unpacked(blob)
                yield _rows(1, e["key"].view(np.int64), e["doc"], e["band"])
                continue
            if bucket != at and held:
                yield from _met(np.concatenate(held))
                held = []
            at = bucket
            held.append(_unpacked(blob))
    if held:
        yield from _met(np.concatenate(held))


def _met(e: np.ndarray):
    """What _meet() tells of one bucket's entries."""
    order, start, size = _groups(e["key"])
    e = e[order]
    big = np.repeat(size > SMALL, size)
    if big.any():
        x = e[big]
        yield _rows(1, x["key"].view(np.int64), x["doc"], x["band"])
    a, b = [], []
    for gap in range(1, SMALL):
        for first in range(SMALL - gap):
            i = start[(size <= SMALL) & (size > first + gap)] + first
            a.append(e["doc"][i])
            b.append(e["doc"][i + gap])
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
    if len(pairs):
        yield _rows(0, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int32))


def _rows(kind: int, a, b, band) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b)), pa.array(np.ascontiguousarray(band).astype(np.int32))], names=["kind", "a", "b", "band"])


# ---------------------------------------------------------------- checking


def _alike(x: np.ndarray, y: np.ndarray, threshold: Fraction) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and common * threshold.denominator >= threshold.numerator * (len(x) + len(y) - common)


def _check(threshold: Fraction, width: int):
    """Rows of (hub, salt, spoke, text) sorted so that a hub's own text (null spoke) comes first, to linked pairs."""

    def run(batches):
        at, own = None, []
        for whole in batches:
            for batch in slices(whole, "text"):
                sets, a, b = shingles(*buffer_of(batch.column("text")), width), [], []
                for hub, spoke, s in zip(batch.column("hub").to_pylist(), batch.column("spoke").to_pylist(), sets):
                    if spoke is None:
                        at, own = hub, own + [s] if at == hub else [s]
                    elif at == hub and any(_alike(o, s, threshold) for o in own):
                        a.append(hub)
                        b.append(spoke)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _linked(docs: DataFrame, sketches: DataFrame, pairs: DataFrame, threshold: Fraction, width: int) -> DataFrame:
    """The pairs (a, b), each once, whose sets are similar enough. Pairs whose whole sketches lie too far apart go first. A hub with many partners is dealt out, some hundred partners to a salt."""
    for end in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("doc_id").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}")), end)
    pairs = stored(pairs.mapInArrow(_close(threshold), "a long, b long").distinct(), "candidates")  # documents whose ids repeat have several sketches
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 128).alias("salts"))
    salted = pairs.join(salts, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.col("b").alias("spoke"))
    hubs = salted.select(F.col("hub").alias("doc_id"), "hub", "salt", F.lit(None).cast("long").alias("spoke")).distinct()
    roles = stored(salted.select(F.col("spoke").alias("doc_id"), "hub", "salt", "spoke").unionByName(hubs), "roles")
    rows = docs.join(sent(roles), "doc_id").select("hub", "salt", "spoke", "text")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("spoke").asc_nulls_first())
    return stored(rows.mapInArrow(_check(threshold, width), "a long, b long").distinct(), "links")


# ---------------------------------------------------------------- crowded groups


def _exploded(width: int):
    """Rows of (doc_id, text) to (key, doc, set, n): the shingles of each text; set tells a document's texts apart where its id repeats."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingles(*buffer_of(batch.column("text")), width)
                size = [len(s) for s in sets]
                if sum(size):
                    ids = np.repeat(np.array(batch.column("doc_id").to_pylist(), np.int64), size)
                    which = np.repeat(np.array([int(np.add.reduce(mixed(s))) if len(s) else 0 for s in sets], np.uint64), size)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(ids), pa.array(which.view(np.int64)), pa.array(np.repeat(size, size).astype(np.int64))], names=["key", "doc", "set", "n"])

    return run


def _rarest(docs: DataFrame, ids: DataFrame, threshold: Fraction, width: int) -> DataFrame:
    """key, class, doc, n, short, own: the rarest shingles of the documents of ids among those of all of ids.

    Of a linked pair the smaller set has 2t / (1 + t) of its shingles in common with the larger one at least, the larger one t of its own; so one of the few
    shingles that the smaller may lack, and one more, taken from the rarest (short), is among as many of the larger. Keys are parted by classes of size that
    differ by one at most for linked sets: a document is in its own class with all these, and with the short ones in the next class too (own is false).
    """
    t, p = threshold, 2 * threshold / (1 + threshold)
    rows = docs.join(sent(ids), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_exploded(width), "key long, doc long, set long, n long").distinct()
    often = rows.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    order = Window.partitionBy("doc", "set").orderBy("often", "key")
    kept = rows.join(often, "key", "left").withColumn("often", F.coalesce("often", F.lit(1))).withColumn("k", F.row_number().over(order))
    kept = kept.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * t.numerator / t.denominator) + 1).where("often > 1")
    short = F.col("k") <= F.col("n") - F.ceil(F.col("n") * p.numerator / p.denominator) + 1
    kept = kept.select("key", "doc", "n", short.alias("short"), F.floor(F.log("n") / math.log(1.01 / t)).cast("int").alias("class"))
    both = F.when(F.col("short"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    kept = kept.withColumn("own", F.explode(both)).withColumn("class", F.when(F.col("own"), F.col("class")).otherwise(F.col("class") + 1))
    return stored(kept.select("key", "class", "doc", "n", "short", "own"), "rarest")


def _meeting(threshold: Fraction):
    """Rows of two blocks of documents (x, y) to pairs of different labels that may be similar."""
    share = (1 - threshold) / (1 + threshold)

    def columns(block: list[dict]):
        by: dict[int, list[dict]] = {}
        for d in block:
            by.setdefault(len(d["sketch"]), []).append(d)
        for size, rows in by.items():
            yield size, {c: np.array([d[c] for d in rows]) for c in ("doc", "label", "n", "short", "own")}, np.array([np.frombuffer(d["sketch"], np.uint8) for d in rows])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (x,), (y,) = (batch.column(c).slice(i, 1).to_pylist() for c in ("x", "y"))
                found, ys = [], list(columns(y))
                for size, a, bits in columns(x):
                    for other, b, more in ys:
                        least = min(size, other)
                        p, q = (np.bitwise_xor.reduce(z.reshape(len(z), -1, least), axis=1) for z in (bits, more))
                        for k in range(len(p)):
                            n = a["n"][k]
                            near = (b["label"] != a["label"][k]) & (b["own"] | a["own"][k])
                            near &= (a["short"][k] & (n <= b["n"])) | (b["short"] & (b["n"] <= n))
                            near &= np.bitwise_count(q ^ p[k]).sum(1, dtype=np.int64) * share.denominator <= share.numerator * (b["n"] + n)
                            if near.any():
                                d, e = int(a["doc"][k]), b["doc"][near]
                                found.append(np.stack([np.minimum(d, e), np.maximum(d, e)]))
                if found:
                    found = np.unique(np.concatenate(found, 1), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(z)) for z in found], names=["a", "b"])

    return run


def _across(large: DataFrame, label: DataFrame, sketches: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs of different labels that share a key and class of large, and may be similar.

    Documents beside a key's largest label meet all of the key, in blocks whose sketches are compared at once; so the rows that are made are those of the blocks.
    """
    key = ["key", "class"]
    large = stored(large.join(sent(label), large.doc == label.node, "left").select(*key, "doc", "n", "short", "own", F.coalesce("label", "doc").alias("label")), "members")
    weight = F.sum(F.col("n") + 64)  # a sketch has fewer bytes than this
    part = large.groupBy(*key, "label").agg(weight.alias("weight"), F.max("short").alias("short"), F.max("own").alias("own"))
    whole = part.groupBy(*key).agg(F.count("*").alias("labels"), F.sum("weight").alias("weight"), F.max(F.struct("weight", "label")).alias("most"), F.max("short").alias("any_short"), F.max("own").alias("any_own"))
    open_ = stored(whole.where("labels > 1 AND any_short AND any_own").select(*key, "weight", "most"), "open")
    rows = large.join(sent(open_), key).withColumn("rest", F.col("label") != F.col("most.label"))
    blocks = F.ceil(F.when(F.col("rest"), F.col("weight") - F.col("most.weight")).otherwise(F.col("most.weight")) / BLOCK)
    rows = rows.select(*key, "rest", F.pmod(F.xxhash64("doc"), blocks).alias("block"), "doc", "label", "n", "short", "own")
    rows = rows.join(sketches.select(F.col("doc_id").alias("doc"), "n", "sketch"), ["doc", "n"])
    block = stored(rows.groupBy(*key, "rest", "block").agg(F.collect_list(F.struct("doc", "label", "n", "short", "own", "sketch")).alias("docs")), "blocks")
    x = block.where("rest").select(*key, F.col("block").alias("i"), F.col("docs").alias("x"))
    y = block.select(*key, F.col("block").alias("j"), "rest", F.col("docs").alias("y"))
    return x.join(y, key).where("NOT rest OR i <= j").select("x", "y").mapInArrow(_meeting(threshold), "a long, b long").distinct()


def similar(docs: DataFrame, threshold: Fraction = Fraction(4, 5), width: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, links, labels): doc_id, n_shingles, class_id of each row; checked links (a, b) between classes that connect every component; node, label of linked classes.

    Words are runs of bytes beside white space, with A-Z lower-cased; a class is the smallest doc_id of equal sets. Two documents link when the
    intersection of their sets is at least threshold times the union. Between classes of one component further links may exist that links doesn't list.
    Null texts count as empty; empty sets link with nothing and are classes of their own. Rows with a null doc_id get their set's size, a null class and no
    links; rows that repeat a doc_id are one document with the links of all its texts, whose classes are linked too. Empty tables give no rows; other columns are not read.
    """
    rows = texts(docs)
    sets = stored(rows.mapInArrow(lambda b: _digest(b, width), _SETS), "sets")
    same = ["n_shingles", "digest_a", "digest_b"]
    first = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows"))
    first = stored(first.where("rows > 1").drop("rows"), "classes")
    classed = sets.select("doc_id", *same).join(sent(first), same, "left")  # both sides are plain exchanges beyond a broadcast, so a large class is split
    classed = stored(classed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")), "classed")
    sketches = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", F.col("n_shingles").alias("n"), "sketch")
    rows = rows.where("doc_id IS NOT NULL")
    repeated = sent(stored(classed.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated"))
    # an id with several texts stands for itself, and its rows' classes are linked
    class_of = sent(stored(classed.where("doc_id <> class_id").join(repeated, "doc_id", "left_anti").select("doc_id", "class_id"), "class_of"))
    joined = classed.where("doc_id <> class_id").join(repeated, "doc_id", "left_semi").select(F.least("doc_id", "class_id").alias("a"), F.greatest("doc_id", "class_id").alias("b")).distinct()

    def by_class(pairs: DataFrame) -> DataFrame:
        """Distinct pairs of classes."""
        for end in ("a", "b"):
            pairs = pairs.join(class_of.select(F.col("doc_id").alias(end), F.col("class_id").alias("_c")), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
        return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    buckets, bands = 16 * parts(docs), Bands(threshold)
    blobs = rows.mapInArrow(_blobs(threshold, width, buckets), "bucket int, kind int, blob binary")
    placed = blobs.repartition(parts(docs), "bucket", "kind").sortWithinPartitions("kind", "bucket")
    found = stored(placed.mapInArrow(_meet, _FOUND), "found")
    pairs = by_class(found.where("kind = 0").select("a", "b"))
    crowded = found.where("kind = 1").groupBy("b", "band").count()
    top = found.where("kind = 1").agg(F.max("band")).first()[0]
    if top is None:
        links = _linked(rows, sketches, pairs, threshold, width).unionByName(joined)
        return classed, links, components(links)
    # a small set shares as many bits with a linked one as the threshold asks; of a larger one's parts, as many as its band's plan has
    many = F.ceil(-F.col("band") * F.lit(threshold.numerator) / F.lit(threshold.denominator))
    if top > 0:
        plans = F.create_map(*[F.lit(x) for band in range(1, top + 1) for x in (band, bands.plan(band)[2])])
        many = F.when(F.col("band") <= 0, many).otherwise(plans[F.col("band")])
    ids = crowded.where(F.col("count") >= many).select(F.col("b").alias("doc_id")).distinct()
    ids = stored(ids.join(class_of, "doc_id", "left").select(F.coalesce("class_id", "doc_id").alias("doc_id")).distinct(), "crowded")
    members, key = _rarest(rows, ids, threshold, width), ["key", "class"]
    size = members.groupBy(*key).agg(F.count("*").alias("size"), F.min("doc").alias("hub"), F.max("short").alias("s"), F.max("own").alias("o"))
    near = members.join(size.where("size > 1 AND s AND o"), key)
    small = near.where(F.col("size") <= SMALL).groupBy(*key).agg(F.sort_array(F.collect_list("doc")).alias("d"))
    small = small.select(F.explode(F.expr("flatten(transform(d, (x, i) -> transform(slice(d, i + 2, size(d)), y -> struct(x AS a, y AS b))))")).alias("p")).select("p.a", "p.b")
    large = near.where(F.col("size") > SMALL)
    star = large.where("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b"))
    links = _linked(rows, sketches, pairs.unionByName(small.where("a <> b")).unionByName(star).distinct(), threshold, width)
    more = _linked(rows, sketches, _across(large, components(links), sketches, threshold), threshold, width)
    links = links.unionByName(more).unionByName(joined)
    return classed, links, components(links)


def clusters(docs: DataFrame, threshold: Fraction = Fraction(4, 5), width: int = 5) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id (the smallest doc_id that links reach) of each row; see similar()."""
    classed, _, label = similar(docs, threshold, width)
    least = classed.join(label, classed.class_id == label.node, "left")
    return least.select("doc_id", "n_shingles", "class_id", F.coalesce("label", "class_id").alias("component_id"))
