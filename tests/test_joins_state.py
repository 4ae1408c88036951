"""As-of and version joins beside plain loops, grants, state with time across restarts, and the trained vector index beside brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loregrid.operators import asof, knowledge, permissions, vector, vector_index, versions
from loregrid.plans.engine import Engine
from loregrid.queries import _all_vector_queries, _vectors
from loregrid.streaming import state


def values(df, *columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize(("exact", "most", "width"), [(True, None, None), (True, None, 5), (False, 4, 3), (True, 0, 7)])
def test_asof_equals_a_loop(spark, direction, exact, most, width):
    """A key with half of all rows, ties, nulls, repeated rows, ranges without a row of right, columns of the same names."""
    r = random.Random(1)
    left = [(r.choice(["hot", "hot", "a", "b", None]), r.choice([None, *range(40)]), i) for i in range(120)] + [("hot", 3, 5)] * 3
    right = [(r.choice(["hot", "hot", "a", "c", None]), r.choice([None, *range(0, 40, 3)]), r.randrange(50)) for _ in range(60)]
    sign = 1 if direction == "backward" else -1

    def near(k, t):
        some = [(sign * s, v, s) for key, s, v in right if None not in (k, t, key, s) and key == k and (sign * s < sign * t or exact and s == t) and (most is None or abs(t - s) <= most)]
        best = max(some, default=None)
        return (k, best[2], max(v for _, v, s in some if s == best[2])) if best else (None, None, None)

    want = sorted(map(repr, ((k, t, i, *near(k, t)) for k, t, i in left)))
    frame = lambda rows: spark.createDataFrame(rows, "k string, ts int, v int").repartition(3)
    got = asof.asof_join(frame(left), frame(right), ["k"], direction=direction, exact=exact, most=most, width=width)
    assert values(got, "k", "ts", "v", "r_k", "r_ts", "r_v") == want


def test_asof_of_nothing(spark):
    some = spark.createDataFrame([("a", dt.datetime(2024, 1, 1))], "k string, ts timestamp")
    assert values(asof.asof_join(some, some.limit(0), ["k"]), "k", "r_ts") == [repr(("a", None))]
    assert asof.asof_join(some.limit(0), some, ["k"]).count() == 0
    with pytest.raises(ValueError):
        asof.asof_join(some, some, ["k"], direction="sideways")


def test_versions_meet_as_the_plain_condition_says(spark):
    r = random.Random(2)
    v = [(r.choice(["x", "y", "z", None]), r.choice([f"{r.randrange(3)}.{r.randrange(3)}.{r.randrange(3)}", f"v{r.randrange(12)}", "1.2-rc1", "", None]), i) for i in range(150)]
    q = [(r.choice(["x", "y", "w", None]), r.choice([">=", "<=", ">", "<", "=", "~", "^", ""]) + r.choice([f"{r.randrange(3)}.{r.randrange(3)}", f"{r.randrange(12)}", "1.0.2", ""]), i) for i in range(80)] + [("x", None, 99)]
    left, right = spark.createDataFrame(v, "name string, version string, a int"), spark.createDataFrame(q, "name string, requirement string, b int")
    plain = left.join(right, "name").where(knowledge.satisfies(F.col("version"), F.col("requirement")))
    got = versions.matching(left, right)
    assert values(got, "a", "b") == values(plain, "a", "b") and got.count() > 300
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        versions.matching(left, right.withColumn("a", F.lit(1)))


def test_versions_meet_once_for_each_class_and_rows_are_dealt(spark):
    """Copies of a version and of a requirement are not compared again, and the rows they give are made in as many tasks as the session has partitions."""
    left = spark.range(3000).select(F.lit("n").alias("name"), F.concat(F.lit("1."), (F.col("id") % 20).cast("string")).alias("version"), F.col("id").alias("a"))
    right = spark.range(200).select(F.lit("n").alias("name"), F.concat(F.lit(">=1."), (F.col("id") % 20).cast("string")).alias("requirement"), F.col("id").alias("b"))
    got = versions.matching(left, right)
    assert got.count() == 3000 * 200 * 21 // 40
    spread = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) > 2 and max(r["count"] for r in spread) < 0.8 * 3000 * 200 * 21 // 40


def test_memberships_in_circles_end_and_grants_hold_in_search(spark):
    m = spark.createDataFrame([("u", "t1"), ("t1", "t2"), ("t2", "t3"), ("t3", "t1"), ("v", "t4"), (None, "t1"), ("w", None)], "member string, team string")
    assert values(permissions.closure(m), "member", "team") == sorted(map(repr, [(a, b) for a in ("u", "t1", "t2", "t3") for b in ("t1", "t2", "t3")] + [("v", "t4")]))
    grants = spark.createDataFrame([("t3", "m1"), ("v", "m2")], "team string, module string")
    users = spark.createDataFrame([("q1", "u"), ("q2", "v"), ("q3", "nobody")], "query_id string, user string")
    allowed = permissions.allowed(users, m, grants)
    assert values(allowed, "query_id", "module") == sorted(map(repr, [("q1", "m1"), ("q2", "m2")]))
    rows = [(str(i), "api", "alpha beta", "t", "m2" if i % 10 else "m1") for i in range(60)]
    c = spark.createDataFrame(rows, "id string, type string, content string, title string, module string").withColumns({"meta_json": F.lit("{}"), "source_path": F.lit("x"), "tokens": F.lit(1)})
    q = spark.createDataFrame([("q1", "alpha"), ("q2", "alpha"), ("q3", "alpha")], "query_id string, query string")
    from loregrid.operators import fts_index, gram_index, graph
    from loregrid.queries import _index_root

    root = _index_root(spark)
    fts_index.write(c, root)
    gram_index.write(graph.nodes(c), root)
    legs = {"bm25": lambda q, k, allowed=None: fts_index.top(root, q, k, c, allowed=allowed), "graph": lambda q, k, allowed=None: gram_index.substring(spark, root, q, k, None, c, allowed)}
    found = Engine(c, legs=legs).search(q, min_score=0.0, allowed=allowed)
    assert {(r.query_id, r.module) for r in found.collect()} == {("q1", "m1"), ("q2", "m2")} and found.where("query_id = 'q1'").count() == 5


# ---------------------------------------------------------------- state with time

EVENTS = "id string, action string, ts timestamp"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_decayed_weights_stream_over_a_restart(spark, tmp_path):
    """Two runs from one checkpoint equal the batch; rows behind the watermark are left out; idle keys are forgotten."""
    r = random.Random(3)
    rows = [(r.choice("abc"), r.choice(["accepted", "rejected", "modified", "ignored"]), at(r.randrange(8))) for _ in range(60)]
    seen = []

    def run(new):
        spark.createDataFrame(new, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.decaying(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), "id", half_life=120, idle=3600)
        stream.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    run(rows[:30])
    run(rows[30:])
    last = {r.id: (round(r.weight, 4), r.n, r["at"]) for r in seen if not r.forgotten}
    batch = state.decayed(spark.createDataFrame(rows, EVENTS), "id", 120)
    assert last == {r.id: (round(r.weight, 4), r.n, r["at"]) for r in batch.collect()}
    run([("a", "accepted", at(300))])
    run([("a", "accepted", at(1)), ("d", "accepted", at(310))])  # the first lies behind the watermark
    end = {r.id: r for r in seen if not r.forgotten}
    assert end["a"].n == last["a"][1] + 1 and end["d"].n == 1
    assert {r.id for r in seen if r.forgotten} >= {"b", "c"}


def test_conversations_carry_their_context(spark, tmp_path):
    rows = [(c, t, f"{c} says {t}" if t != 2 else None) for c in range(3) for t in range(6)]
    schema, seen = "conv_id long, turn long, text string", []
    for part in ([r for r in rows if r[1] < 3], [r for r in rows if r[1] >= 3]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.carried(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2)
        stream.writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = state.with_context(spark.createDataFrame(rows, schema), 2)
    assert sorted(map(repr, map(tuple, seen))) == sorted(map(repr, map(tuple, want.collect()))) and len(seen) == 18


# ---------------------------------------------------------------- vectors


def test_trained_cells_and_codes_find_nearly_all(spark, tmp_path):
    """On sf0.1, recall of five neighbours is at least 0.9, scores are exact, and the codes are a small part of the vectors' bytes."""
    sf, root = "/root/testdata/sf0.1", f"file://{tmp_path}/v"
    v, q = _vectors(spark, sf).select("id", "type", "embedding"), _all_vector_queries(spark, sf)
    book = vector_index.write(v, root, cells=16)
    assert book.cells.shape == (16, 64) and book.books.shape == (16, 256, 4)
    want = {(r.query_id, r.id): r.score for r in vector.top(v, q, 5).collect()}
    got = {(r.query_id, r.id): r.score for r in vector_index.search(spark, root, q, 5, probes=14, again=64).collect()}
    assert len(got) == len(want) and len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got.keys() & want.keys())


def test_odd_vectors(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    rows = [(str(i), [float(i % 5), float(i % 3), 0.0, 1.0]) for i in range(40)] + [("n", None), ("e", []), ("x", [1.0, None, 0.0, 0.0]), ("y", [float("nan")] * 4), (None, [1.0] * 4)]
    v = spark.createDataFrame(rows, "id string, embedding array<double>")
    vector_index.write(v, root, cells=3, size=4, parts=2)
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0, 0.0]), ("bad", [1.0])], "query_id string, embedding array<double>")
    got = vector_index.search(spark, root, q, 5, probes=3).orderBy("rank").collect()
    assert [r.score for r in got] == [4.0] * 5 and {r.query_id for r in got} == {"q"} and all(int(r.id) % 5 == 4 for r in got)
    none = f"file://{tmp_path}/none"
    vector_index.write(v.where("id = 'e'"), none, cells=3, size=4, parts=2)
    assert vector_index.search(spark, none, q, 5).collect() == []
    with pytest.raises(ValueError):
        vector_index.train(v, 4, 2, parts=3)
