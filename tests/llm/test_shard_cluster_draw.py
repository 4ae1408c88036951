import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loregrid.llm import lloyd, resample, sharding
from loregrid.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, place string, shard string, `file` int, score string"


@pytest.mark.parametrize("name", ["op11_sharding", "op12_lloyd", "op13_resample"])
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    rel = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, rel.fetchall()))


# ---------------------------------------------------------------- sharding


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def seed(key):
    return int(hashlib.sha256(b"" if key is None else str(key).encode()).hexdigest()[:16], 16)


@pytest.mark.parametrize("shards", [1, 2, 24, 30, 31, 200])
def test_jumps_equal_the_loop(spark, shards):
    got = sharding.assigned(spark.range(-500, 1500).withColumnRenamed("id", "doc_id"), shards).collect()
    assert [(r.shard, r.grown_shard) for r in got] == [(jump(seed(r.doc_id), shards), jump(seed(r.doc_id), shards + 1)) for r in got]


def test_growth_moves_only_into_the_new_shard(spark):
    docs = spark.range(20_000).selectExpr("concat('key-', id) AS doc_id", "id AS shard", "id AS grown_shard")
    moved = sharding.moves(docs, 24).toPandas()
    assert list(moved.columns) == ["doc_id", "shard", "grown_shard", "shard", "grown_shard"]
    assert set(moved.iloc[:, 4]) == {24} and 0.03 < len(moved) / 20_000 < 0.05
    sizes = sharding.assigned(docs.select("doc_id"), 24).groupBy("shard").count().toPandas()["count"]
    assert len(sizes) == 24 and sizes.min() > 700 and sizes.max() < 970


def test_slots_of_odd_rows(spark):
    """Nulls, empty and long texts, a third of all rows with one id (equal and different texts), columns with clashing names."""
    rows = [(i, f"text {i % 7}", "x", "y", i, None) for i in range(300)]
    rows += [(42, "same" if i % 3 else f"other {i}", None, None, None, None) for i in range(200)]
    rows += [(None, None, None, None, None, None)] * 3 + [(7, "", None, None, None, None), (8, "ä" * 50_000, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sharding.slots(docs, 24).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), jump(seed(i), 24), jump(seed(i), 25)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    for shard in {r.shard for r in got}:
        own = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        keys = [(r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in own]
        assert keys == sorted(keys)
    assert {r.law for r in got} == {"key"}
    assert sharding.slots(docs.where("doc_id = -1"), 24).collect() == []


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op11_sharding"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_written_shards_hold_every_row_once(spark, tmp_path):
    docs = spark.range(1000).selectExpr("id % 400 AS doc_id", "CAST(id AS STRING) AS text").repartition(6)
    back = sharding.written(docs, f"file://{tmp_path}/out", 5, most_rows=60).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i % 400, str(i)) for i in range(1000))
    assert all(r.shard == jump(seed(r.doc_id), 5) for r in back)
    with pytest.raises(ValueError):
        sharding.assigned(docs, 0)


# ---------------------------------------------------------------- centroids


def lloyd_brute(rows, k, rounds, size, scale=256):
    held = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    centre = [v for _, _, v in sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), np.array(v, "<i8").tobytes(), v) for i, v in held)[:k]]
    away = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        near = [away(v)[1] for _, v in held]
        for j in range(len(centre)):
            own = [v for (_, v), n in zip(held, near) if n == j]
            if own:
                centre[j] = [sum(c) // len(own) for c in zip(*own)]
    out = [(i, *reversed(away(v))) for i, v in held]
    return sorted((str(i), j, d, sum(e for _, m, e in out if m == j), sum(e for *_, e in out), hashlib.sha256(",".join(map(str, centre[j])).encode()).hexdigest()) for i, j, d in out)


VECTORS = "vec_id long, embedding array<float>, cluster string, distance string"


def test_rounds_equal_a_loop(spark):
    """Ties, repeated rows and ids, a null id, centroids that lose all vectors, vectors that take no part."""
    r = np.random.default_rng(5)
    rows = [(int(i % 90), [float(x) for x in np.round(r.normal(0, 1, 4), 1)]) for i in range(150)]
    rows += [(200, [0.5, 0.5, 0.5, 0.5])] * 40 + [(None, [1.0, 2.0, 3.0, 4.0]), (2**60 + 1, [-1.0, 0.0, 0.0, 0.25])]
    rows += [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0]), (303, [1.0, float("nan"), 1.0, 1.0]), (304, [1.0, float("inf"), 1.0, 1.0]), (305, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], VECTORS).repartition(4)
    got = sorted((str(x.vec_id), x.cluster, x.distance, x.cluster_inertia, x.inertia, x.centroid_sha256) for x in lloyd.clusters(df, k=30, rounds=5, size=4).collect())
    assert got == lloyd_brute(rows, 30, 5, 4)
    few = df.where("vec_id IN (200, 3)")
    assert {x.cluster for x in lloyd.clusters(few, k=60, rounds=2, size=4).collect()} <= set(range(60))
    assert lloyd.clusters(df.where("vec_id > 300 AND vec_id < 400"), k=3, size=4).collect() == []
    assert lloyd.clusters(df.where("false"), k=3, size=4).collect() == []


def test_components_too_large_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e20, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="after scaling"):
        lloyd.clusters(df, k=1, size=2).collect()
    with pytest.raises(ValueError):
        lloyd.clusters(df, size=1000)


# ---------------------------------------------------------------- resampling


def resample_brute(docs, target, percent, least, buckets, longest):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(t):
        w = word.findall((t or "").translate(lower))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    raw, want = Counter(), Counter()
    for _, t in docs:
        raw.update(features(t)[1])
    for t in target:
        want.update(features(t)[1])
    s, t = sum(raw.values()), sum(want.values())
    out = []
    for i, text in docs:
        n, f = features(text)
        w = sum(math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((n, i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((-x[4], x[1] is not None, x[1] or 0, k) for k, x in enumerate(out) if x[0] >= least)
    rank = {k: r for r, (*_, k) in enumerate(fit[: len(fit) * percent // 100], 1)}
    return [(x[1], x[2], x[3], x[4], rank.get(k)) for k, x in enumerate(out)]


def as_sorted(rows):
    return sorted(repr(tuple(x)) for x in rows)


@pytest.mark.parametrize(("longest", "percent", "n"), [(1, 10, 30_000), (2, 35, 2_000)])
def test_draw_equals_sorting(spark, longest, percent, n):
    r = np.random.default_rng(n)
    vocab = [f"W{i}" if i % 3 else f"wörd{i}" for i in range(400)]
    docs = [(int(i), " ".join(vocab[k] for k in r.zipf(1.4, int(r.integers(0, 40))) % 400)) for i in range(n)]
    docs += [(n + i, "the very same text, " * 10) for i in range(n // 3)]  # a third of the rows have one text
    docs += [(5, "same id " * 15)] * 60 + [(None, "no id at all " * 10)] * 3 + [(n * 3, None), (n * 3 + 1, ""), (n * 3 + 2, "日本 " * 4_000)]
    target = [" ".join(vocab[k] for k in r.integers(0, 60, 30)) for _ in range(50)] + [None, ""]
    df = spark.createDataFrame([(i, t, "p", "s", 1, "t") for i, t in docs], DOCS).repartition(7)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resampled(df, goal, percent=percent, least_words=20, buckets=1000, longest=longest).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert as_sorted(got) == as_sorted(resample_brute(docs, target, percent, 20, 1000, longest))


def test_draws_of_nothing(spark):
    docs = spark.createDataFrame([(1, "short", "a", "b", 1, "c"), (2, None, "a", "b", 1, "c")], DOCS)
    none = spark.createDataFrame([], "text string")
    assert [tuple(r) for r in resample.resampled(docs, none).select("doc_id", "n_features", "weight", "rank").orderBy("doc_id").collect()] == [(1, 1, math.floor(1000 * math.log(10001 / 2 / 10000)), None), (2, 0, 0, None)]
    assert resample.resampled(docs.where("false"), none).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=12), max_size=40))
def test_tournament_merges_runs(runs):
    rows = sorted([sorted((x, k, i) for i, x in enumerate(sorted(run))) for k, run in enumerate(runs) if run], key=lambda s: s[0])
    assert list(resample.merged(rows)) == sorted(x for s in rows for x in s)


def test_segments_break_where_order_does():
    fall, ids = np.array([1, 5, 9, 2, 3, 3, 8]), np.array([0, 0, 0, 0, 7, 6, 0])
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (fall, ids, np.arange(7), fall, fall)], names=list(resample._NUMBERS))
    (out,) = resample._segments(np.array([4]), 0)([batch])
    held = [np.frombuffer(b, "<i8").reshape(-1, 5)[:, 0].tolist() for b in out.column("rows").to_pylist()]
    assert held == [[1], [2, 3], [3]] and out.column("range").to_pylist() == [0, 0, 0]
