"""Exact deduplication by Patricia-trie owners.

Texts are compared without white space. Rows are dealt out by length and content hash; every partition inserts its texts' full bytes into a compressed radix
trie, whose branches are the texts' own bytes, so that texts with equal beginnings share them. A terminal node stores the best identifier and the number of
rows. Tries are built twice: on the map side, as a combiner (before anything is shuffled, so a group that holds a third of all rows sends a row from each task
at most a few times), and after the exchange. Beyond its memory limit a combiner's trie spills its heaviest subtree downstream; after the exchange rows come
in the order of length and hash, so a full trie's owners are complete between two of them, and leave.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, texts

#: The white space that is deleted before comparison.
WHITE = " \t\n\x0b\x0c\r"


class _Node:
    __slots__ = ("label", "children", "value", "weight")

    def __init__(self, label: bytes, value=None):
        self.label, self.children, self.value, self.weight = label, None, value, 0


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


#: Bytes that a node takes besides its label, with its value and its parent's entry (some 330 measured).
NODE_BYTES = 352


class PatriciaTrie:
    """A compressed radix trie from byte strings to values. size: its keys; held: bytes of its labels; nodes: how many there are below the root."""

    def __init__(self):
        self.root, self.size, self.held, self.nodes = _Node(b""), 0, 0, 0

    @property
    def memory(self) -> int:
        """About how many bytes it takes."""
        return self.held + self.nodes * NODE_BYTES

    def terminal(self, key: bytes) -> _Node:
        """The node at which key ends; made where there is none."""
        node, at = self.root, 0
        while at < len(key):
            if node.children is None:
                node.children = {}
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Node(key[at:])
                self.held += len(key) - at
                self.nodes += 1
                return child
            label = child.label
            if len(key) - at >= len(label) and key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = _shared(label, key[at : at + len(label)])
            middle = _Node(label[:n])
            self.nodes += 1
            child.label = label[n:]
            middle.children = {label[n]: child}
            node.children[key[at]] = middle
            node, at = middle, at + n
        return node

    def add(self, key: bytes, rank: tuple, count: int, told=None) -> bool:
        """Merges an identifier's rank (smaller is better) and a number of rows; told is kept of a key's first row. True for a new key."""
        node = self.terminal(key)
        if node.value is None:
            node.value = (rank, count, told)
            self.size += 1
            return True
        node.value = (min(node.value[0], rank), node.value[1] + count, node.value[2])
        return False

    def items(self, node: _Node | None = None, prefix: bytes = b""):
        """(key, value) of every terminal at or below node, without recursion."""
        stack = [(node or self.root, prefix)]
        while stack:
            here, so_far = stack.pop()
            so_far += here.label
            if here.value is not None:
                yield so_far, here.value
            stack += [(x, so_far) for x in (here.children or {}).values()]

    def spill(self):
        """Takes the heaviest subtree below the first fork out, and yields its terminals."""
        node, prefix, above = self.root, b"", None
        while node.value is None and node.children and len(node.children) == 1:
            above, prefix = (node, next(iter(node.children))), prefix + node.label
            node = node.children[above[1]]
        if node.value is None and node.children:
            above, prefix = (node, max(node.children, key=lambda b: self._memory(node.children[b]))), prefix + node.label
            node = node.children[above[1]]
        if above is None:
            out = list(self.items())
            self.root, self.size, self.held, self.nodes = _Node(b""), 0, 0, 0
            yield from out
            return
        labels, nodes = self._weight(node)
        self.held, self.nodes = max(0, self.held - labels), self.nodes - nodes
        del above[0].children[above[1]]
        for key, value in self.items(node, prefix):
            self.size -= 1
            yield key, value

    @staticmethod
    def _weight(node: _Node) -> tuple[int, int]:
        """Bytes of the labels at and below node, and how many nodes these are."""
        total, nodes, stack = 0, 0, [node]
        while stack:
            here = stack.pop()
            total += len(here.label)
            nodes += 1
            stack += (here.children or {}).values()
        return total, nodes

    def _memory(self, node: _Node) -> int:
        labels, nodes = self._weight(node)
        return labels + nodes * NODE_BYTES


_ROWS = "n_bytes long, content_hash binary, mark long, body binary, best_chars long, best_id long, n_rows long"
_NAMES = ["n_bytes", "content_hash", "mark", "body", "best_chars", "best_id", "n_rows"]
_TYPES = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
_OWNERS = "n_bytes long, content_hash binary, mark long, keep_id long, group_size long"
_LAST = 1 << 63  # where an identifier is null


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def _rows(items):
    """Batches of some MB of a trie's terminals."""
    rows, weight = [], 0
    for key, ((chars, at), count, (h, mark)) in items:
        rows.append((len(key), h, mark, key, -chars, None if at == _LAST else at, count))
        weight += len(key)
        if weight > 1 << 20 or len(rows) >= 4_000:
            yield _batch(rows)
            rows, weight = [], 0
    if rows:
        yield _batch(rows)


def _combine(most: int):
    """Map side: rows merged in one trie of bounded size."""

    def run(batches):
        trie = PatriciaTrie()
        for batch in batches:
            for _, h, mark, body, chars, i, count in zip(*[batch.column(c).to_pylist() for c in _NAMES]):
                trie.add(body, (-chars, _LAST if i is None else i), count, (h, mark))
            while trie.memory > most and trie.size:
                yield from _rows(trie.spill())
        yield from _rows(trie.items())

    return run


def _own(most: int):
    """After the exchange: rows sorted by length and hash, merged in tries that end between two of them; their terminals are the owners."""

    def run(batches):
        trie, at = PatriciaTrie(), None
        for batch in batches:
            for n, h, mark, body, chars, i, count in zip(*[batch.column(c).to_pylist() for c in _NAMES]):
                if (n, h) != at:
                    if trie.memory > most:
                        yield _owners(trie)
                        trie = PatriciaTrie()
                    at = (n, h)
                trie.add(body, (-chars, _LAST if i is None else i), count, (h, mark))
        if trie.size:
            yield _owners(trie)

    return run


def _owners(trie: PatriciaTrie) -> pa.RecordBatch:
    rows = [(len(key), h, mark, None if at == _LAST else at, count) for key, ((_, at), count, (h, mark)) in trie.items()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["n_bytes", "content_hash", "mark", "keep_id", "group_size"])


def exact_owners(docs: DataFrame, memory_mb: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, content_hash (SHA-256 of the text without white space) for each row.

    Of rows with equal texts, that with the most code points in its own text stays, then that with the smallest doc_id. A null text counts as empty;
    empty texts equal each other. A null doc_id ranks after all others. Rows that repeat a doc_id and a text count each and share their verdict.
    Texts are compared byte by byte; rows find their owners by length, SHA-256 and one more hash. An empty table gives no rows; other columns are not read.
    """
    key = ["n_bytes", "content_hash", "mark"]
    base = texts(docs).select("doc_id", F.length("text").cast("long").alias("chars"), F.translate("text", WHITE, "").cast("binary").alias("body"))
    base = base.select("doc_id", "chars", F.length("body").cast("long").alias("n_bytes"), F.unhex(F.sha2("body", 256)).alias("content_hash"), F.xxhash64("body").alias("mark"), "body")
    rows = base.select(*key, "body", F.col("chars").alias("best_chars"), F.col("doc_id").alias("best_id"), F.lit(1).cast("long").alias("n_rows"))
    local = rows.mapInArrow(_combine(memory_mb << 20), _ROWS)
    placed = local.repartition(parts(docs), "n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")
    owners = placed.mapInArrow(_own(memory_mb << 20), _OWNERS)
    members = base.select("doc_id", *key)
    return members.join(owners, key).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "content_hash")
