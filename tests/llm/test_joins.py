import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loregrid.llm import graph, jaccard, topk
from loregrid.llm.queries import QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sets(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute(rows):
    s, parent = sets(rows), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    near = defaultdict(list)
    for i, a in s.items():
        for j in {j for x in a for j in near[x]}:
            n = len(a & s[j])
            if 100 * n >= 80 * (len(a) + len(s[j]) - n):
                a_, b_ = sorted((find(i), find(j)))
                parent[b_] = a_
        for x in a:
            near[x].append(i)
    return {i: (len(a), find(i)) for i, a in s.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    assert got(QUERIES["op4_jaccard"](spark, sf)) == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_crowds_and_common_passages(spark):
    """Groups of near copies far beyond a small group, passages that many documents share, chains of links, and sets around the limits."""
    r = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(3000)]
    say = lambda n: [vocab[k] for k in r.integers(0, len(vocab), n)]
    docs, passage, line = [], say(40), say(9)
    base = say(120)
    for _ in range(60):  # near copies, each with a word or two changed
        w = list(base)
        for k in r.integers(0, len(w), r.integers(0, 4)):
            w[k] = "edit%d" % r.integers(10**6)
        docs.append(w)
    for _ in range(50):  # half of each is a passage that all share
        docs.append(say(20) + passage + say(22))
    for _ in range(40):
        docs.append(say(int(r.integers(1, 60))) + line)
    chain = say(60)
    for _ in range(12):  # each near the one before, the ends far apart
        chain = chain[3:] + say(3)
        docs.append(list(chain))
    for n in (1, 2, 4, 5, 6, 8, 31, 32, 33, 36, 37, 41, 60, 90):
        w = say(n)
        docs += [w, w[:-1] + ["other"], w + ["more"], [x.upper() for x in w]]
    order = r.permutation(len(docs))
    rows = [(int(i), " ".join(docs[k])) for i, k in enumerate(order)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(jaccard.clusters(df)) == brute(rows)


def test_crowds_that_are_hardly_linked(spark, monkeypatch):
    """Texts made of the same few passages, near the threshold in many pairs and of many sizes, in groups of several blocks; ids that repeat with another text."""
    monkeypatch.setattr(jaccard, "BLOCK", 2_000)
    r = np.random.default_rng(11)
    say = lambda n: ["w%d" % k for k in r.integers(0, 5000, n)]
    passages, docs = [say(int(n)) for n in r.integers(8, 30, 6)], []
    for _ in range(180):
        held = [passages[k] for k in sorted(r.choice(6, int(r.integers(3, 7)), replace=False))]
        docs.append([w for p in held for w in p] + say(int(r.integers(0, 9))))
    docs += [say(2) + passages[0] + passages[1] + say(int(n)) for n in r.integers(5, 9, 60)]
    rows = [(int(i), " ".join(w)) for i, w in enumerate(docs)]
    assert got(jaccard.clusters(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))) == brute(rows)
    again = rows + [(i, " ".join(say(50))) for i in range(0, 40)]  # the first text's links stay those of the id
    parts = {r.doc_id: r.component_id for r in jaccard.clusters(spark.createDataFrame(again, "doc_id long, text string").repartition(7)).collect()}
    assert parts == {i: c for i, (_, c) in brute(rows).items()}


def test_odd_rows(spark):
    long = " ".join(str(k) for k in range(60_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", "b"), (4, "One two", "b"), (5, "one  TWO", None), (6, long, "c"), (7, long + " end", "c"), (7, long + " end", "c"), (None, "one two", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.clusters(df).collect()), key=str)
    assert out == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 59_996, 6), (7, 59_997, 6), (7, 59_997, 6), (None, 1, None)], key=str)
    assert jaccard.clusters(df.limit(0)).count() == 0


@given(st.sets(st.integers(0, 2**64 - 1), max_size=80), st.sets(st.integers(0, 2**64 - 1), max_size=80), st.sets(st.integers(0, 2**64 - 1), max_size=200))
@settings(max_examples=60, deadline=None)
def test_sketch_distance_is_a_lower_bound(a, b, both):
    a, b = np.array(sorted(a | both), np.uint64), np.array(sorted(b | both), np.uint64)
    assert jaccard.distance(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


@given(st.integers(1, 5000), st.data())
@settings(max_examples=200, deadline=None)
def test_linked_sizes_share_a_band(n, data):
    bands = jaccard.Bands(Fraction(4, 5))
    m = data.draw(st.integers(-(-4 * n // 5), n * 5 // 4))
    if n <= jaccard.FEW and m <= jaccard.FEW:
        return
    assert min(n, m) > bands.t * jaccard.FEW
    shared = [b for b in set(bands.bands(n)) & set(bands.bands(m)) if bands.share * bands.top(b) >= int(bands.share * (n + m))]
    assert shared


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(100, 101), (101, 102), (102, 100)], [(5, 5), (None, 3), (9, 8), (8, 9)]])
def test_components(spark, edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    for alone in (graph.ALONE, 0):
        got = [(r.node, r.label) for r in graph.components(df, alone).collect()]
        assert len(got) == len(set(got)) and set(got) == {(x, find(x)) for x in list(parent)}


def nearest(rows, asked, k):
    out = set()
    for q, v in set(asked):
        scored = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    return out


def test_top_k_query(spark, sf_dir):
    rows = [(r.vec_id, tuple(int(np.floor(256 * float(x))) for x in r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert {tuple(r) for r in QUERIES["op5_top_k"](spark, sf_dir).collect()} == nearest(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_top_k_odd_rows_many_trees_and_blocks(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), float(i % 3)], "x") for i in range(300)] + [(400, None, "x"), (401, [1.0, None], "x"), (402, [nan, 1.0], "x"), (403, [1.0, inf], "x"), (404, [], "x"), (None, [9.0, 9.0], "x"), (405, [1.0, 1.0, 1.0], None), (0, [5.0, 5.0], "x"), (0, [5.0, 5.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    good = [(i, tuple(int(256 * x) for x in e)) for i, e, _ in rows if i is not None and e and None not in e and all(np.isfinite(x) for x in e)]
    want = nearest(good, [g for g in good if g[0] % 50 == 0], 5)
    assert {tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5, tree_rows=64, block_rows=3).collect()} == want
    assert topk.top_k(df.limit(0), df, 5).count() == 0 and topk.top_k(df, df.limit(0), 5).count() == 0


def test_cells_with_limits_lose_nothing(spark):
    """Clustered vectors in many cells, one of them with a third of all: results equal a plain search."""
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 6))
    pick = np.concatenate([np.zeros(200, int), r.integers(0, 12, 400)])
    x = centres[pick] + r.normal(size=(600, 6)) * 0.05
    df = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    rows = [(i, tuple(int(np.floor(256 * z)) for z in v)) for i, v in enumerate(x)]
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 5, tree_rows=40, block_rows=7)
    assert {tuple(z) for z in got.collect()} == nearest(rows, [z for z in rows if z[0] % 20 == 0], 5)


def test_m_tree_avoids_products():
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 8)) * 400
    v = np.floor(np.concatenate([c + r.normal(size=(100, 8)) * 5 for c in centres])).astype(np.int64)
    tree = topk.MTree(np.arange(len(v)), v, page=16)
    for q in v[::97]:
        want = sorted(zip((-(v @ q)).tolist(), range(len(v))))[:5]
        assert tree.search(q, 5) == [(-s, i) for s, i in want]
    assert tree.products < 0.5 * len(v) * len(v[::97])


def test_blocks_hold_as_many_queries_as_they_may(spark):
    """Few queries are one block whatever the number of partitions; visits are counted by cell."""
    pivots, reach = {2: np.array([[1.0, 0.0], [0.0, 1.0]])}, {2: np.array([0.5, 0.5])}
    rows = [(i, 2, [256, 0] if i % 3 else [0, 256], None) for i in range(30)]
    asked = spark.createDataFrame(rows, "vec_id long, size int, numbers array<long>, limit double").coalesce(2)
    many = asked.mapInArrow(topk._visits(pivots, reach, True, counted=True), "cell int, size int, many long").groupBy("cell").sum("many").collect()
    assert {tuple(r) for r in many} == {(0, 20), (1, 10)}
    visits = asked.mapInArrow(topk._visits(pivots, reach, True), "vec_id long, size int, numbers array<long>, limit double, cell int").selectExpr("cell", "size", "0L AS asks", "vec_id", "numbers", "limit")
    blocks = visits.repartition(1).sortWithinPartitions("cell").mapInArrow(topk._blocks(16), "cell int, size int, asked binary").collect()
    assert sorted(r.cell for r in blocks) == [0, 0, 1]
