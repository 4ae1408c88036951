import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loregrid.llm import bpe, exact_dedup, packing
from loregrid.llm.queries import QUERIES

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "text string, kept string, doc_id long, ids int"
ODD = [("a b", "x", 1, 1), ("ab\n", None, 2, 2), (None, "x", 3, 3), ("", "y", None, 4), (" \t", "y", 5, 5), ("a  b", "x", 7, 6), ("a  b", "x", 7, 6), ("x" * 50_000 + " 'tis “ß” 你好 ​　 <|endoftext|> 😀", "z", 8, 7)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.from_file(RANKS)


def whole(pieces):
    """Checks that pieces cover each document once and sequences without gaps; returns ids by (doc_id, doc_tokens)."""
    docs, rows = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id, p.doc_tokens].append(p)
        rows[p.sequence_id].append(p)
    for s in rows.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or at & (at - 1) == 0 and at < 1024
    return docs


def test_packing_covers_every_id(spark, sf_dir):
    got = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), JSON).collect()
    t = Tokenizer.from_file(JSON)
    docs = whole(got)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(docs.pop((r.doc_id, len(ids))), key=lambda p: p.start)
        assert b"".join(p.ids for p in pieces) == np.array(ids, "<u4").tobytes()
        at = 0
        for p in pieces:
            assert p.start == at and len(p.ids) == 4 * p.length
            at += p.length
    assert not docs


def test_packing_odd_rows(spark, odd):
    got = packing.pack(odd, JSON).collect()
    docs, t = whole(got), Tokenizer.from_file(JSON)
    for text, _, i, _ in {r for r in ODD if r[2] != 7}:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert b"".join(p.ids for p in sorted(docs[i, len(ids)], key=lambda p: p.start)) == np.array(ids, "<u4").tobytes()
    assert sum(p.length for p in got if p.doc_id == 7) == 2 * len([*t.encode("a  b").ids, 0])
    assert packing.pack(odd.limit(0), JSON).count() == 0


def test_packing_query_digest(spark, sf_dir):
    rows = QUERIES["op1_packing"](spark, sf_dir).collect()
    assert {tuple(r) for r in rows} and all(0 <= r.ids_crc32 < 1 << 32 for r in rows)
    empty = [r for r in rows if r.doc_tokens == 1]
    assert all(r.ids_crc32 == zlib.crc32(bytes(4)) for r in empty)


@given(st.lists(st.integers(0, 40), min_size=64, max_size=64))
@settings(max_examples=25, deadline=None)
def test_counts_stay_within_the_histogram(h):
    h = np.array([0, *h[1:]], np.int64)
    used = Counter()
    for a, k, b, n in packing.solve_counts(h, 64):
        assert k * a + b == 64 and n > 0
        used[a] += k * n
        if b:
            used[b] += n
    assert all(used[a] <= h[a] for a in used)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_bpe_matches_the_library(library, text):
    e = bpe.encoder_of(RANKS, P.PATTERN)
    ids = np.frombuffer(e.encode(text), "<i4")
    assert ids.tolist() == library.encode_ordinary(text)
    assert e.decode(ids) == text.encode()


@given(st.text("aehnrt ing'sé", max_size=40), st.text("aehnrt ing'sé", max_size=9), st.integers(0, 60), st.integers(0, 9))
@settings(max_examples=200, deadline=None)
def test_prefix_table_appends_and_edits(vocabulary, text, new, at, removed):
    data, more = text.encode(), new.encode()
    table = bpe.PrefixTable(vocabulary, data)
    assert table.tokens() == vocabulary.merged(data)
    table.append(more)
    assert table.tokens() == vocabulary.merged(data + more)
    assert table.tokens(len(data)) == vocabulary.merged(data)
    at, data = min(at, len(data)), data + more
    removed = min(removed, len(data) - at)
    table.edit(at, removed, more)
    data = data[:at] + more + data[at + removed :]
    assert table.data == data and table.last == bpe.PrefixTable(vocabulary, data).last


def test_edit_computes_near_the_edit_only(vocabulary):
    data = b"the rain in spain stays mainly on the plain " * 60
    table = bpe.PrefixTable(vocabulary, data)
    assert table.edit(1000, 3, b"zz") < 600
    assert table.last == bpe.PrefixTable(vocabulary, data[:1000] + b"zz" + data[1003:]).last


def test_bpe_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op2_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_odd_rows(odd, library):
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in bpe.encode_documents(odd, RANKS, P.PATTERN).collect())
    assert got == Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for t, _, i, _ in ODD)
    assert bpe.encode_documents(odd.limit(0), RANKS, P.PATTERN).count() == 0


def owners(rows):
    """By brute force: (doc_id, keep_id, group_size, kept) of (text, doc_id)."""
    groups = defaultdict(list)
    for text, i in rows:
        text = text or ""
        groups["".join(c for c in text if c not in " \t\n\x0b\x0c\r")].append((-len(text), i is None, i or 0, i))
    out = Counter()
    for g in groups.values():
        keep = min(g)[3]
        out.update((i, keep, len(g), i == keep) for *_, i in g)
    return out


def test_owners(spark, odd, sf_dir):
    def got(df):
        return Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_owners(df).collect())

    assert got(odd) == owners([(t, i) for t, _, i, _ in ODD])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(docs) == owners([(r.text, r.doc_id) for r in docs.collect()])
    assert exact_dedup.exact_owners(odd.limit(0)).count() == 0


@given(st.lists(st.tuples(st.binary(max_size=12), st.integers(0, 9)), max_size=60))
@settings(max_examples=200, deadline=None)
def test_trie_and_spill(rows):
    trie, want = exact_dedup.PatriciaTrie(), {}
    for key, i in rows:
        trie.add(key, (i,), 1)
        rank, n, _ = want.get(key, ((i,), 0, None))
        want[key] = (min(rank, (i,)), n + 1, None)
    assert dict(trie.items()) == want and trie.size == len(want)
    out = []
    while trie.size:
        out += trie.spill()
    assert dict(out) == want and len(out) == len(want)


def test_trie_shares_beginnings():
    trie = exact_dedup.PatriciaTrie()
    for end in (b"", b"one", b"two", b"twice"):
        trie.add(b"a long beginning " * 50 + end, (1,), 1)
    assert trie.held <= 17 * 50 + 12


def test_equal_hashes_of_different_texts():
    """Texts whose length and hash are the same have owners each."""
    batch = exact_dedup._batch([(3, b"h", k, body, 3, i, 1) for i, (body, k) in enumerate([(b"abc", 1), (b"abd", 2), (b"abc", 1)])])
    (out,) = exact_dedup._own(1 << 20)([batch])
    assert sorted((r["mark"], r["keep_id"], r["group_size"]) for r in out.to_pylist()) == [(1, 0, 2), (2, 1, 1)]


def test_combiner_spills_without_loss(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small = Counter(map(tuple, exact_dedup.exact_owners(docs, memory_mb=0).collect()))
    assert small == Counter(map(tuple, exact_dedup.exact_owners(docs).collect()))


def test_neighbours_by_the_definition(vocabulary):
    """On random pairs, and on all pairs among tokens with shared ends, where merges across the border are likeliest."""
    import random

    r, ids = random.Random(4), sorted(vocabulary.tokens)
    near = [i for i in ids if vocabulary.tokens[i][:1] in b"aeth" and len(vocabulary.tokens[i]) < 5][:150]
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(5000)] + [(a, b) for a in near for b in near]
    assert all(vocabulary.follows(a, b) == (vocabulary.merged(vocabulary.tokens[a] + vocabulary.tokens[b]) == [a, b]) for a, b in pairs)


def test_trie_counts_its_nodes():
    """Short keys weigh as much as the objects that hold them."""
    trie = exact_dedup.PatriciaTrie()
    for i in range(20_000):
        trie.add(f"{i:05d}".encode(), (0, i), 1)
    assert 20_000 * exact_dedup.NODE_BYTES <= trie.memory < 24_000 * exact_dedup.NODE_BYTES
    before = trie.memory
    out = list(trie.spill())
    assert 0 < len(out) < 20_000 and trie.size == 20_000 - len(out) and trie.memory < before
    while trie.size:
        out += trie.spill()
    assert len(out) == 20_000 and trie.nodes <= 5  # a chain of empty inner nodes, no longer than a key
