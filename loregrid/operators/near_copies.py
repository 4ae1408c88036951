"""Near copies among texts: bounds on difflib's ratio, which lose no pair, and who may be near whom."""

from __future__ import annotations

import difflib
import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths of grams that are looked for; a text takes the first that tells enough of it.
GRAMS = (12, 8)
#: difflib leaves frequent characters out of texts from this length on.
FREQUENT_FROM = 200
#: Between texts that stand together; no character has this number.
BREAK = 0x110000
#: Characters that are hashed at once, and postings that are met at once.
CHUNK, MET = 1 << 20, 1 << 21


def places(text: str) -> dict[str, int]:
    """Where each character of text stands, as bits of a number."""
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes)}


def may_share(a: str, at: dict[str, int], size: int, least: int) -> bool:
    """Whether a and a text of that size, whose characters stand at, have a common subsequence of least characters; False is certain.

    Row by row of the table of longest common subsequences, a row as bits of a number. Behind p characters of a, a sequence that long has come to place p + size - least of the other text at most, so what
    they share up to there and the rest of a must be enough.
    """
    ends, step, row, reach = size - least, max(64, len(a) // 32), 0, 0
    for p in range(0, len(a), step):
        done = min(p + step, len(a))
        was, reach = reach, max(reach, min(size, done + ends))
        row |= (1 << reach) - (1 << was)  # zeros are steps of the sequence's length
        every = (1 << reach) - 1
        near = {c: m & every for c, m in at.items()}
        for c in a[p:done]:
            if m := row & near.get(c, 0):
                row = (row + m) | (row - m)
        row &= every
        if reach - row.bit_count() + len(a) - done < least:
            return False
    return True


def reaches(blocks: difflib.SequenceMatcher, ratio: float) -> bool:
    """Whether blocks.ratio() is that high; the blocks are found from large gaps to small ones, only until that is settled."""
    total = len(blocks.a) + len(blocks.b)
    matched, most = 0, min(len(blocks.a), len(blocks.b))
    gaps = [(-most, 0, len(blocks.a), 0, len(blocks.b))]
    while 2.0 * matched / total < ratio <= 2.0 * most / total and gaps:
        room, a_from, a_to, b_from, b_to = heapq.heappop(gaps)
        i, j, n = blocks.find_longest_match(a_from, a_to, b_from, b_to)
        matched, most = matched + n, most + room + n
        for gap in ((a_from, i, b_from, j), (i + n, a_to, j + n, b_to)) if n else ():
            if (room := min(gap[1] - gap[0], gap[3] - gap[2])) > 0:
                heapq.heappush(gaps, (-room, *gap))
                most += room
    return 2.0 * matched / total >= ratio


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def char_counts(c: np.ndarray) -> np.ndarray:
    """Counts of characters in 128 classes."""
    return np.bincount((c % 128).astype(np.int64), minlength=128).astype(np.int32)


def quads(c: np.ndarray) -> np.ndarray:
    """The sorted runs of four characters, numbered where they repeat."""
    c = c.astype(np.uint64)
    g = np.sort(((c[:-3] * 1_000_003 + c[1:-2]) * 1_000_003 + c[2:-1]) * 1_000_003 + c[3:]) if len(c) > 3 else c[:0]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    nth = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return np.sort(g * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64))


def least_matching(total, ratio: float):
    """Characters that must match for the ratio, of two texts of that many characters together."""
    return np.ceil(ratio * total / 2 - 1e-6).astype(np.int64)


def shortest(ratio: float) -> float:
    """The length of a text as a part of another's that it may be near."""
    return max(0.5, ratio / (2 - ratio))


def _pieces(c: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """Numbers of the grams that begin at these places."""
    h = np.zeros(len(at), np.uint64)
    for k in range(q):
        h = h * np.uint64(1_000_003) + c[at + k]
    return h


def _rolled(c: np.ndarray, q: int) -> np.ndarray:
    """_pieces() of all places, by doubling."""
    out, size, part, width = None, 0, c, 1
    while True:
        if q & width:
            if out is None:
                out = part
            else:
                n = len(c) - size - width + 1
                out = out[:n] * np.uint64(pow(1_000_003, width, 1 << 64)) + part[size : size + n]
            size += width
        if size == q:
            return out
        n = len(part) - width
        part = part[:n] * np.uint64(pow(1_000_003, width, 1 << 64)) + part[width:]
        width *= 2


class _Anchored:
    """Gaps of texts that a near text must mostly span.

    A matching block of difflib's either begins both texts or holds a character that isn't frequent in the second text (frequent: more than 1 % of 200 characters or more). So what lies between two such
    characters is matched from either end only, and beyond q - 2 characters only if the q characters at that end stand in the first text. A gap neither of whose ends stands there loses the rest.
    """

    def __init__(self, texts: list[np.ndarray], ratio: float):
        self.starts = np.cumsum([0] + [len(c) + 1 for c in texts])
        self.flat = np.full(self.starts[-1], BREAK, np.uint32)
        for s, c in zip(self.starts, texts):
            self.flat[s : s + len(c)] = c
        there = np.zeros(BREAK + 1, bool)
        there[self.flat] = True
        small = np.zeros(BREAK + 1, np.int32)
        small[there] = np.arange(there.sum())
        self.blocks = np.full(len(texts), np.iinfo(np.int32).max, np.int64)  # at most
        self.plain, gaps = [], {q: [] for q in GRAMS}
        for b, c in enumerate(texts):
            n = len(c)
            if n < FREQUENT_FROM:
                self.plain.append(b)
                continue
            s = small[c]
            p = np.flatnonzero((np.bincount(s) <= n // 100 + 1)[s])
            self.blocks[b] = len(p) + 1
            p = p if len(p) and p[0] == 0 else np.append(0, p)
            ends = np.append(p[1:], n)
            allowed = n - int(least_matching(n + math.floor(shortest(ratio) * n - 1e-6), ratio))
            for q in GRAMS:
                lost = ends - p - 1 - 2 * (q - 2)
                lost[-1] += q - 2  # the last has one end
                g = np.flatnonzero(lost > 0)
                if (total := int(lost[g].sum())) > allowed * 1.5 or q == GRAMS[-1] and total > allowed:
                    heads, tails = p[g], ends[g] - q + 1
                    tails[ends[g] == n] = heads[ends[g] == n]
                    gaps[q].append((np.full(len(g), b), lost[g], np.full(len(g), max(allowed, 0) * 1.5), self.starts[b] + heads, self.starts[b] + tails))
                    break
            else:
                self.plain.append(b)
        self.weight = np.zeros(len(texts), np.int64)  # of the gaps looked for
        self.by = {}
        for q, of in gaps.items():
            if of:
                b, lost, enough, heads, tails = (np.concatenate(x) for x in zip(*of))
                self.by[q] = self._rare(b, lost, enough, _pieces(self.flat, heads, q), _pieces(self.flat, tails, q))

    def _rare(self, b, lost, enough, head, tail):
        """(sorted numbers of grams, their gaps; gaps' texts and losses) of as few gaps of a text as lose enough, long ones with rare grams first."""
        _, place, count = np.unique(np.concatenate([head, tail]), return_inverse=True, return_counts=True)
        often = count[place[: len(b)]] + count[place[len(b) :]]
        order = np.lexsort((-lost / often, b))
        b, lost, enough, head, tail = (x[order] for x in (b, lost, enough, head, tail))
        so_far = np.cumsum(lost) - lost
        first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        so_far -= np.repeat(so_far[first], np.diff(np.append(first, len(b))))
        kept = so_far <= enough
        b, lost, head, tail = b[kept], lost[kept], head[kept], tail[kept]
        np.add.at(self.weight, b, lost)
        grams, gap = np.concatenate([head, tail]), np.tile(np.arange(len(b)), 2)
        order = np.argsort(grams, kind="stable")
        return grams[order], gap[order], b, lost

    def meetings(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays of first texts, second texts and the losses of the second's gaps of which an end stands in the first; a pair comes once."""
        last = len(self.starts) - 1
        for q, (grams, gap, of, lost) in self.by.items():
            bits = min(22, 6 + len(grams).bit_length())
            spots = np.zeros(1 << bits, bool)
            spots[_spot(grams, bits)] = True
            at = 0
            while at < last:
                end = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + CHUNK, "right")) - 1)
                h = _rolled(self.flat[self.starts[at] : self.starts[end]].astype(np.uint64), q)
                where = np.flatnonzero(spots[_spot(h, bits)])
                low = np.searchsorted(grams, h[where], "left")
                found = np.flatnonzero(grams[np.minimum(low, len(grams) - 1)] == h[where])
                text = np.searchsorted(self.starts, self.starts[at] + where[found], "right") - 1
                each = np.unique(text * len(grams) + low[found])
                yield from self._met(each // len(grams), each % len(grams), grams, gap, of, lost)
                at = end

    def _met(self, a, low, grams, gap, of, lost):
        many = np.searchsorted(grams, grams[low], "right") - low
        cuts = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a)) if len(a) else np.zeros(1, np.int64)
        total = np.append(0, np.cumsum(many))[cuts]
        at = 0
        while at < len(cuts) - 1:  # whole first texts, as many as may be met at once
            end = max(at + 1, int(np.searchsorted(total, total[at] + MET, "right")) - 1)
            some = slice(cuts[at], cuts[end])
            n = many[some]
            which = np.repeat(low[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            first, g = np.repeat(a[some], n), gap[which]
            later = first < of[g]
            pair = np.unique(first[later] * len(of) + g[later])
            first, g = pair // len(of), pair % len(of)
            second = of[g]
            if len(g):
                start = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
                yield first[start], second[start], np.add.reduceat(lost[g], start)
            at = end


def _spot(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def linked(texts: list[str], own: np.ndarray, ratio: float) -> list[tuple[int, int]]:
    """Links that connect each pair of these different texts, one of them at least own, of which the first is kept before the second and may have the ratio; some that don't may be linked too."""
    of = [codes(t) for t in texts]
    sizes = np.array([len(c) for c in of])
    anchored = _Anchored(of, ratio)
    parent, links = list(range(len(texts))), []
    counts: dict[int, np.ndarray] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def counted(x: int) -> np.ndarray:
        if x not in counts:
            counts[x] = char_counts(of[x])
        return counts[x]

    runs = functools.lru_cache(32)(lambda x: quads(of[x]))
    spots = functools.lru_cache(4)(lambda x: places(texts[x]))

    def fits(a, b):
        both = sizes[a] + sizes[b]
        return (own[a] | own[b]) & (2 * np.minimum(sizes[a], sizes[b]) >= ratio * both - 1e-6) & (sizes[a] <= 2 * sizes[b]) & (sizes[b] <= 2 * sizes[a])

    def link(a: int, b: int) -> None:
        x, y = find(a), find(b)
        if x == y:
            return
        total = int(sizes[a] + sizes[b])
        match = int(least_matching(np.int64(total), ratio))
        if np.minimum(counted(a), counted(b)).sum() < match:
            return
        # a block has three runs fewer than characters; there is at most one more than characters unmatched
        least = match - 3 * min(total - 2 * match + 1, int(anchored.blocks[b]))
        if least > 0 and len(np.intersect1d(runs(b), runs(a), assume_unique=True)) < least:
            return
        if may_share(texts[a], spots(b), int(sizes[b]), match):  # matching blocks are a common subsequence
            parent[max(x, y)] = min(x, y)
            links.append((a, b))

    for a, b, met in anchored.meetings():
        near = fits(a, b) & (met >= anchored.weight[b] - (sizes[b] - least_matching(sizes[a] + sizes[b], ratio)))
        a, b = a[near], b[near]
        order = np.lexsort((a, b))
        for x, y in zip(a[order].tolist(), b[order].tolist()):
            link(x, y)
    if anchored.plain and len(texts) > 1:
        chars = np.stack([counted(x) for x in range(len(texts))])
        for b in anchored.plain:
            a = np.flatnonzero(fits(np.arange(b), np.full(b, b)))
            a = a[np.minimum(chars[a], chars[b]).sum(1) >= least_matching(sizes[a] + sizes[b], ratio)]
            for x in a.tolist():
                link(x, b)
    return links


def _rows(pdf: pd.DataFrame, **numbers: list[int]) -> pd.DataFrame:
    """Rows of pdf's query."""
    n = len(next(iter(numbers.values())))
    return pd.DataFrame({"query_id": pd.Series([pdf["query_id"].iloc[0]] * n, dtype=object)} | {k: np.array(v, np.int64) for k, v in numbers.items()})


def _tile(ratio: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_s", "_ord", "content"], ascending=[False, True, True], kind="stable")
        first: dict[str, int] = {}
        keys, own, out = [], [], []
        for key, is_own, content in zip(pdf["_key"].tolist(), pdf["_own"].tolist(), pdf["content"]):
            text = content.lower()
            if (at := first.setdefault(text, len(first))) == len(keys):
                keys.append(key)
                own.append(is_own)
            elif is_own:
                out.append((keys[at], key))
        out += [(keys[a], keys[b]) for a, b in linked(list(first), np.array(own), ratio)]
        return _rows(pdf, _a=[a for a, _ in out], _b=[b for _, b in out])

    return run


def _parts(pdf: pd.DataFrame) -> pd.DataFrame:
    """A query's links to its rows' parts, by union and find; a part is named by one of its keys."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(pdf["_a"].tolist(), pdf["_b"].tolist()):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return _rows(pdf, _key=list(parent), _part=[find(x) for x in parent])


def parts(items: DataFrame, ratio: float) -> DataFrame:
    """query_id, _key, _part of those items (query_id, _key, content, score, ord) that may be near another of their query's; near ones are in one part.

    Texts are compared by classes of length: a near text is in the same class or in one beside it.
    """
    step = max(0.05, -math.log(shortest(ratio)) * 1.0001)
    size = F.length(F.replace("content", F.lit("İ"), F.lit("İİ")))  # in lower case it has two characters
    kind = F.floor(F.log(size) / step).cast("int")
    score = F.when(F.isnan("score"), 0.0).otherwise(F.coalesce("score", F.lit(0.0)))
    rows = items.where("content <> ''").select("query_id", "_key", "content", score.alias("_s"), F.col("ord").alias("_ord"), kind.alias("_kind"))
    rows = rows.withColumn("_tile", F.explode(F.array("_kind", F.col("_kind") - 1))).where("_tile >= 0").withColumn("_own", F.col("_kind") == F.col("_tile")).drop("_kind")
    query = items.schema["query_id"].dataType.simpleString()
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: tasks are long for their bytes, so they aren't to be joined
    links = rows.repartition(tasks, "query_id", "_tile").groupBy("query_id", "_tile").applyInPandas(_tile(ratio), f"query_id {query}, _a long, _b long")
    return links.groupBy("query_id").applyInPandas(_parts, f"query_id {query}, _key long, _part long")
