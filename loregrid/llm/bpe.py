"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string the last token of the prefix's encoding is unique: it is the one vocabulary token that ends the prefix and that the
merges leave unmerged behind the last token of what comes before it. A table of these last tokens gives a prefix's encoding by walking back, takes
appended bytes exactly, and after an edit needs new entries only until the old ones hold again.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Splitter, slices, texts


class Vocabulary:
    """Tokens and ranks of a rank file, and which tokens may follow which."""

    def __init__(self, ranks: dict[bytes, int], most: int = 1_000_000):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.most, self.pairs, self.own, self.splits = most, {}, {}, {}

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merged(self, data: bytes) -> list[int]:
        """Encoding by the definition: of all neighbours that form a token, the lowest rank (the first of equals) merges first."""
        bits = [data[i : i + 1] for i in range(len(data))]
        while len(bits) > 1:
            best = min(((r, i) for i in range(len(bits) - 1) if (r := self.ranks.get(bits[i] + bits[i + 1])) is not None), default=None)
            if best is None:
                break
            bits[best[1] : best[1] + 2] = [bits[best[1]] + bits[best[1] + 1]]
        return [self.ranks[b] for b in bits]

    def stands(self, token: int) -> bool:
        """Whether merges make the token from its own bytes."""
        if (known := self.own.get(token)) is None:
            known = self.own[token] = self.merged(self.tokens[token]) == [token]
        return known

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge joins to the token; None for one byte."""
        if token not in self.splits:
            data = self.tokens[token]
            bits = [data[i : i + 1] for i in range(len(data))]
            while len(bits) > 2:
                _, i = min((r, i) for i in range(len(bits) - 1) if (r := self.ranks.get(bits[i] + bits[i + 1])) is not None)
                bits[i : i + 2] = [bits[i] + bits[i + 1]]
            self.splits[token] = (self.ranks[bits[0]], self.ranks[bits[1]]) if len(bits) == 2 else None
        return self.splits[token]

    def follows(self, a: int, b: int) -> bool:
        """Whether merges leave a, b as they are.

        Only a merge across their border could undo them, and only one that ranks before the merges that have made the border's tokens; so both are taken
        apart along the border, the later merge first, and no pair met there may have an earlier rank.
        """
        key = a << 32 | b
        if (known := self.pairs.get(key)) is not None:
            return known
        if len(self.pairs) >= self.most:
            self.pairs.clear()
        self.pairs[key] = known = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        tokens, ranks, limit = self.tokens, self.ranks, 1 << 62
        while True:
            across = ranks.get(tokens[a] + tokens[b])
            if across is not None and across < limit:
                return False
            left, right = self.split(a), self.split(b)
            if left is None and right is None:
                return True
            if left is not None and (right is None or a > b):
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]  # at equal ranks the one on the left merges first


class PrefixTable:
    """The last token of every prefix of one byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _last(self, data: bytes, last: list[int], end: int) -> int:
        v = self.vocabulary
        get, follows = v.ranks.get, v.follows
        for start in range(max(0, end - v.longest), end):
            token = get(data[start:end])
            if token is not None and (v.stands(token) if not start else follows(last[start], token) and v.stands(token)):
                return token
        raise ValueError("a byte has no token")

    def append(self, more: bytes) -> None:
        data = self.data + more
        for end in range(len(self.data) + 1, len(data) + 1):
            self.last.append(self._last(data, self.last, end))
        self.data = data

    def edit(self, start: int, removed: int, new: bytes) -> int:
        """Replaces bytes; returns how many entries were computed. An entry depends on those of the longest token's length before it alone, so once as many in a row are as before, the rest stays."""
        old, shift = self.last, len(new) - removed
        data = self.data[:start] + new + self.data[start + removed :]
        last, done, alike = old[: start + 1], 0, 0
        for end in range(start + 1, len(data) + 1):
            last.append(self._last(data, last, end))
            done += 1
            behind = end - start - len(new)
            alike = alike + 1 if behind >= 0 and last[end] == old[end - shift] else 0
            if alike > self.vocabulary.longest and behind > self.vocabulary.longest:
                last += old[end - shift + 1 :]
                break
        self.data, self.last = data, last
        return done

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first end bytes (all by default)."""
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.tokens[self.last[at]])
        return out[::-1]


class Encoder:
    """Encodes texts piece by piece as the rank file's library does: a piece that is a token is that token; others go through a prefix table, and each piece's ids are then looked up."""

    def __init__(self, path: str, pattern: str, public: str, most: int = 500_000):
        self.vocabulary, self.split, self.most = Vocabulary.from_file(path), Splitter(pattern, public), most
        self.known, self.old = {}, {}
        size = max(self.vocabulary.tokens) + 1
        self.bytes_of = [self.vocabulary.tokens.get(i) for i in range(size)]

    def piece(self, text: str) -> bytes:
        data = text.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.ranks.get(data)
        return np.array([whole] if whole is not None else PrefixTable(self.vocabulary, data).tokens(), "<i4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        pieces = self.split(text)
        for p in set(pieces).difference(self.known):
            if len(self.known) >= self.most:  # two generations bound the memory
                self.old, self.known = self.known, {}
            self.known[p] = self.old[p] if p in self.old else self.piece(p)
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:  # a generation ended amid this text
            return b"".join(self.known.get(p) or self.old.get(p) or self.piece(p) for p in pieces)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_CACHED: dict = {}


def encoder_of(path: str, pattern: str) -> Encoder:
    import public_tokenizers as public

    if (path, pattern) not in _CACHED:
        _CACHED[path, pattern] = Encoder(path, pattern, public.PATTERN)
    return _CACHED[path, pattern]


def _both(path: str, pattern: str):
    def run(batches):
        encoder = encoder_of(path, pattern)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                ids, back = [], []
                for text in batch.column("text").to_pylist():
                    ids.append(np.frombuffer(encoder.encode(text), "<i4"))
                    back.append(encoder.decode(ids[-1]))
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(back, pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (the bytes that the ids give back) of every whole text.

    A null or empty text has no ids. Special tokens are ordinary text. Rows that repeat are encoded each; an empty table gives no rows; other columns
    are not read. Ids must be below 2 ** 31.
    """
    return texts(docs).mapInArrow(_both(path, pattern), "doc_id long, ids array<int>, decoded binary")
