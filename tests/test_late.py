"""Late interaction beside loops over signs, and what a search reads of the stored codes."""

import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from loregrid.operators import gram_index, graph, late
from loregrid.plans import ingest_run
from loregrid.queries import _asked, _chunks


def codes(text):
    folded = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    t = re.findall(r"[^\W_]+", folded)
    h = lambda x: hashlib.md5(x.encode()).hexdigest()
    at = lambda i: h(t[i]) if 0 <= i < len(t) else h("")
    return {int(h(x)[:8] + h(x[:4])[8:11] + at(i - 1)[11:13] + at(i + 1)[13:15], 16) for i, x in enumerate(t)}


def similar(query, text):
    q, d = codes(query), codes(text)
    return sum(max(60 - 2 * (a ^ b).bit_count() for b in d) for a in q) if d else 0


def test_rerank_equals_loops(spark, tmp_path):
    r = random.Random(3)
    words = ["alpha", "alphas", "beta", "Gamma", "delta", "x1", "ö"]
    made = lambda n: " ".join(r.choice(words) for _ in range(n))
    chunks = [(f"c{i:03d}", r.choice([made(r.randrange(1, 30)), "", None])) for i in range(60)] + [("long", made(5_000)), (None, "no id")]
    queries = [("q1", "alpha beta"), ("q2", "Gamma"), ("q3", ""), ("q4", "unseen words here"), ("q5", None)]
    late.write(spark.createDataFrame(chunks, "id string, content string").repartition(4), str(tmp_path))
    pairs = [(q, t, i, n) for q, t in queries for n, i in enumerate(r.sample([c for c, _ in chunks if c] + ["gone"], 20))]
    items = spark.createDataFrame(pairs, "query_id string, query string, id string, place int")
    texts = dict(chunks)
    want = {}
    for q in dict(queries):
        ranked = sorted((-similar(t, texts.get(i)), n, i) for k, t, i, n in pairs if k == q)
        want |= {(q, i): (-s, p) for p, (s, _, i) in enumerate(ranked, 1)}
    assert {(x.query_id, x.id): (x.late, x.place) for x in late.rerank(items, str(tmp_path)).collect()} == want
    assert late.rerank(items.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("named", [5, 1_000])
def test_codes_of_named_chunks_alone(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(late, "NAMED_IDS", named)
    late.write(spark.range(4_000).select(F.format_string("%05d", "id").alias("id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("content")), str(tmp_path))
    ids = spark.createDataFrame([(f"{i:05d}",) for i in range(0, 4_000, 300)] + [("99999",), (None,)], "id string")
    got = late.codes_of(spark, str(tmp_path), ids)
    assert {x.id for x in got.collect()} == {f"{i:05d}" for i in range(0, 4_000, 300)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("Join" in plan) == (named == 5) and ("In(id" in plan) == (named > 5)


def test_codes_and_searches_exchange_no_texts(spark, sf_dir, tmp_path):
    """What is exchanged is figures of files and a batch's candidates, not the texts: neither when codes are written nor when nodes are searched."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def exchanged():
        stages = store.stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    c = _chunks(spark, sf_dir)
    size = c.agg(F.sum(F.length("content"))).first()[0]
    gram_index.write(graph.nodes(c), str(tmp_path))
    before = exchanged()
    late.write(c, str(tmp_path))
    assert exchanged() - before < size / 50
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = exchanged()
        gram_index.substring(spark, str(tmp_path), _asked(spark)).collect()
        assert exchanged() - before < size / 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_candidates_are_made_once(spark, tmp_path):
    """A batch's candidates are what the legs found: to make them again is to search again."""
    late.write(spark.createDataFrame([("1", "alpha"), ("2", "beta")], "id string, content string"), str(tmp_path))
    items = spark.range(1, 4).select(F.lit("q").alias("query_id"), F.lit("beta").alias("query"), F.col("id").cast("string").alias("id"), F.col("id").cast("int").alias("place"))
    got = late.rerank(items, str(tmp_path))
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [x.id for x in got.orderBy("place").collect()][0] == "2" and got.count() == 3


def test_no_codes(spark, tmp_path):
    late.write(spark.createDataFrame([], "id string, content string"), str(tmp_path))
    items = spark.createDataFrame([("q", "a", "c", 1)], "query_id string, query string, id string, place int")
    assert [(x.late, x.place) for x in late.rerank(items, str(tmp_path)).collect()] == [(0, 1)]


def test_second_stage_of_a_stored_engine(spark, sf_dir, tmp_path):
    c = _chunks(spark, sf_dir)
    ingest_run.index(c, str(tmp_path))
    plain = ingest_run.stored_engine(spark, str(tmp_path), c).search(_asked(spark), top_k=10, min_score=0.0).collect()
    again = ingest_run.stored_engine(spark, str(tmp_path), c, late_interaction=True).search(_asked(spark), top_k=10, min_score=0.0).collect()
    assert len(again) == len(plain)
    texts, asked = {r.id: r.content for r in c.collect()}, {r.query_id: r.query for r in _asked(spark).collect()}
    for q in asked:
        got = [similar(asked[q], texts[r.id]) for r in sorted((r for r in again if r.query_id == q), key=lambda r: r.place)]
        assert got == sorted(got, reverse=True)
