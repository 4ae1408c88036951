"""Packing documents into windows by non-negative least squares.

Every document's token ids are cut into full windows and one tail. The histogram of tail lengths is matched by shallow combinations of lengths that
fill a window exactly (k times one length and one more): repeat counts are solved by non-negative least squares, rounded down, and tails are dealt to
the combinations by their rank within their length. What is left is packed greedily: laid end to end and cut at window bounds; the last partial
window is cut into powers of two. Only the histogram reaches the driver: at most (window - 1) * salts numbers.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, texts

_CACHED: dict = {}


def _alphabet() -> dict[str, int]:
    """Byte-level BPE's printable stand-ins: printable Latin-1 characters stand for themselves, other bytes for the characters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    """Ids of whole texts by a tokenizer file.

    Where the file is byte-level BPE with the public split pattern and its merges stand in the order of their tokens' ids, a merge loop over ranks gives
    the same ids in a fraction of the time and is used; texts with an added token, and any other file, go through the file's own library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = self._ranks(path)

    def _ranks(self, path: str):
        import public_tokenizers as public
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file.get("pre_tokenizer") or {}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if model.get("type", "BPE") != "BPE" or file.get("normalizer") or any(before.get(k) != v for k, v in plain.items()) or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        vocab, byte = model["vocab"], _alphabet()
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        singles = [vocab.get(c, -1) for c in byte]
        if made != sorted(made) or min(singles) < 0 or max(singles) > min(made, default=1 << 31):
            return None
        merged = {*made, *singles}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i in merged}
        return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.ranks is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.ranks.encode_to_numpy(text, disallowed_special=()), "<u4")


def ids_of(path: str) -> Ids:
    if path not in _CACHED:
        _CACHED[path] = Ids(path)
    return _CACHED[path]


def _cut(path: str, end_id: int, window: int):
    """Rows of (doc_id, text) to (doc_id, doc_tokens, windows, tail, tail_len, narrow); windows and tail hold unsigned 16-bit ids where all ids fit."""

    def run(batches):
        t = ids_of(path)
        narrow = t.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        end = np.array([end_id], "<u4")
        for whole in batches:
            for batch in slices(whole, "text"):
                out = [[] for _ in range(4)]
                for text in batch.column("text").to_pylist():
                    a = np.concatenate([t(text), end])
                    n, full = len(a), len(a) // window * window
                    a = a.astype("<u2") if narrow else a
                    for x, v in zip(out, (n, a[:full].tobytes(), a[full:].tobytes(), n - full)):
                        x.append(v)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int32()), pa.array([narrow] * len(out[0]))], names=["doc_id", "doc_tokens", "windows", "tail", "tail_len", "narrow"])

    return run


def solve_counts(histogram: np.ndarray, window: int, depth: int = 4, sweeps: int = 60) -> list[tuple[int, int, int, int]]:
    """Combinations (length, times, other length or 0, repeats) that fill a window and use each length at most as often as the histogram has it.

    Least squares over the histogram by non-negative coordinate descent: each combination touches two lengths at most, so a step is exact and cheap.
    """
    combos = []
    for a in range(1, window):
        for k in range(1, depth + 1):
            b = window - k * a
            if b < 0 or (k == 1 and b < a):
                break
            if b == a:
                combos.append((a, k + 1, 0))
            elif histogram[a] and (b == 0 or histogram[b]):
                combos.append((a, k, b))
    combos = sorted({c for c in combos if histogram[c[0]]})
    x, left = np.zeros(len(combos)), histogram.astype(float)
    norms = [k * k + (b > 0) for _, k, b in combos]
    for _ in range(sweeps):
        for j, (a, k, b) in enumerate(combos):
            step = max(-x[j], (k * left[a] + (left[b] if b else 0)) / norms[j])
            if step:
                x[j] += step
                left[a] -= k * step
                if b:
                    left[b] -= step
    rest, out = histogram.astype(np.int64).copy(), []
    for j in sorted(range(len(combos)), key=lambda j: -x[j]):
        a, k, b = combos[j]
        n = min(int(x[j]), int(rest[a]) // k, int(rest[b]) if b else 1 << 62)
        if n > 0:
            rest[a] -= k * n
            if b:
                rest[b] -= n
            out.append((a, k, b, n))
    return out


class _Plan:
    """Where the tail with some rank within its length goes."""

    def __init__(self, histogram: np.ndarray, window: int):
        self.window, spans, sequence = window, [[] for _ in range(window)], 0
        used = np.zeros(window, np.int64)
        for a, k, b, n in solve_counts(histogram, window):
            for length, times, offset in ((a, k, 0), (b, 1, k * a)) if b else ((a, k, 0),):
                spans[length].append((int(used[length]), n, sequence, offset))
                used[length] += times * n
            sequence += n
        self.spans = [np.array(s, np.int64).reshape(-1, 4) for s in spans]
        self.used, self.first_rest = used, sequence
        lengths = np.arange(window)
        rest = (histogram - used) * lengths
        self.base, total = np.concatenate([[0], np.cumsum(rest)[:-1]]), int(rest.sum())
        full = total // window
        bounds, at = [], full * window
        while at < total:  # powers of two, the largest first
            size = 1 << ((total - at).bit_length() - 1)
            bounds.append(at)
            at += size
        self.full, self.bounds = full, np.array([*bounds, total], np.int64)

    def place(self, length: int, rank: int):
        """Pieces (start, length, sequence, offset) of a tail."""
        if rank < self.used[length]:
            s = self.spans[length]
            lo, n, sequence, offset = s[np.searchsorted(s[:, 0], rank, side="right") - 1].tolist()
            slot, copy = divmod(rank - lo, n)
            return [(0, length, sequence + copy, offset + slot * length)]
        at, out, start = int(self.base[length] + (rank - self.used[length]) * length), [], 0
        while start < length:
            p = at + start
            if p < self.full * self.window:
                q, begin = divmod(p, self.window)
                room, sequence = self.window - begin, q
            else:
                q = int(np.searchsorted(self.bounds, p, side="right")) - 1
                begin, room, sequence = p - int(self.bounds[q]), int(self.bounds[q + 1]) - p, self.full + q
            n = min(room, length - start)
            out.append((start, n, self.first_rest + sequence, begin))
            start += n
        return out


_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_PIECE_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(zip(*rows))], names=_PIECE_NAMES)


def _windows(window: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "windows", 4 << 20):
                rows = []
                for i, n, raw, narrow in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "windows", "narrow")]):
                    a = np.frombuffer(raw, "<u2" if narrow else "<u4").astype("<u4")
                    rows += [(i, s, window, n, 0, 0, a[s : s + window].tobytes()) for s in range(0, len(a), window)]
                if rows:
                    yield _pieces(rows)

    return run


def _tails(plan: _Plan, before: dict):
    def run(batches):
        for batch in batches:
            rows = []
            for i, n, raw, length, salt, rank, narrow in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "tail", "tail_len", "salt", "rank", "narrow")]):
                a = np.frombuffer(raw, "<u2" if narrow else "<u4").astype("<u4")
                rows += [(i, n - length + s, size, n, q, o, a[s : s + size].tobytes()) for s, size, q, o in plan.place(length, before[length, salt] + rank)]
            if rows:
                yield _pieces(rows)

    return run


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of every document: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    A document's ids are those of the tokenizer file at path, then end_id; a null or empty text is end_id alone. Sequences are full windows, or powers of
    two at the very end, so nothing is padded. Rows that repeat a doc_id are packed each. An empty table gives no rows; other columns are not read.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    cut = stored(texts(docs).mapInArrow(_cut(path, end_id, window), "doc_id long, doc_tokens long, windows binary, tail binary, tail_len int, narrow boolean"), "cut")
    rows = cut.count()
    salts = min(1024, max(16, rows // 2_000_000))
    tails = cut.where("tail_len > 0").select("doc_id", "doc_tokens", "tail", "tail_len", "narrow", F.pmod(F.xxhash64("doc_id", "doc_tokens"), F.lit(salts)).cast("int").alias("salt"))
    histogram, before = np.zeros(window, np.int64), {}
    for length, salt, n in tails.groupBy("tail_len", "salt").count().sort("tail_len", "salt").collect():  # at most (window - 1) * salts rows
        before[length, salt] = int(histogram[length])
        histogram[length] += n
    plan = _Plan(histogram, window)
    ranked = tails.withColumn("rank", F.row_number().over(Window.partitionBy("tail_len", "salt").orderBy("doc_id", "doc_tokens", "tail")) - 1)
    full = cut.where(F.col("doc_tokens") >= window).mapInArrow(_windows(window), _PIECES)
    full = full.withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id())  # beyond all numbers of packed tails
    return full.unionByName(ranked.mapInArrow(_tails(plan, before), _PIECES))
