"""The match grammar beside an engine that has it built in, the stored indexes beside scans of the texts, and index tables kept as segments."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from loregrid.operators import fts, fts_index, gram_index, graph, match
from loregrid.queries import _asked, _chunks
from loregrid.sources import segments
from loregrid.streaming import feedback

WORDS = ["a", "b", "c", "de", "def", "anh"]
SAID = ["a", "b", "c", "de", "def", "ảnh", "Ä", "éa", "a_b", "b-c", "!", "DEF."]


def notes(n=60, seed=3):
    r = random.Random(seed)
    say = lambda most: " ".join(r.choice(SAID) for _ in range(r.randrange(most)))
    return [(str(i), say(5), say(14)) for i in range(n)]


def asked(n=200, seed=11):
    r = random.Random(seed)
    word = lambda: r.choice([*WORDS, "ä", "ea", '"a b"', '"b ""c"" de"', "a_b", '"!"', '"" '])

    def phrase():
        out = word() + r.choice(["", "", "", "*", " *"])
        return out + (" + " + phrase() if r.random() < 0.2 else "")

    def near():
        return "NEAR(" + " ".join(phrase() for _ in range(r.randrange(1, 4))) + r.choice(["", f", {r.randrange(4)}"]) + ")"

    def column():
        return r.choice(["title:", "content :", "-title:", "{title content}:", "- {content} :"])

    def leaf():
        out = near() if r.random() < 0.25 else r.choice(["", "", "", "^"]) + phrase()
        return (column() + " " if r.random() < 0.25 else "") + out

    def side_by_side():
        return " ".join(leaf() for _ in range(r.choice([1, 1, 2, 3])))

    def any_of(depth=0):
        if depth < 3 and r.random() < 0.6:
            return f"{any_of(depth + 1)} {r.choice(['AND', 'OR', 'NOT'])} {any_of(depth + 1)}"
        if depth < 3 and r.random() < 0.3:
            return r.choice(["", "", column()]) + f"({any_of(depth + 1)})"
        return side_by_side()

    wrong = ["", "AND", "a (b)", "(a) b", "NEAR()", "a.b", "^NEAR(a b)", "none: a", "title: NOT", "{}: a", '"a', "a AND", "NEAR(a, x)"]
    return [any_of() for _ in range(n - len(wrong))] + wrong


def by_fts5(rows, queries):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, title, content)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    out = []
    for q in queries:
        try:
            out.append({r[0] for r in con.execute("SELECT id FROM t WHERE t MATCH ?", (q,))})
        except sqlite3.OperationalError:
            out.append(set())
    return out


def test_matching_equals_fts5(spark):
    """200 generated queries over two columns: each finds what the engine with the grammar finds, and queries that it refuses find nothing."""
    rows, queries = notes(), asked()
    want = by_fts5(rows, queries)
    assert 60 < sum(0 < len(w) < len(rows) for w in want)
    c = spark.createDataFrame(rows, "id string, title string, content string").coalesce(2)
    got = [set() for _ in queries]
    for i in range(0, len(queries), 25):
        part = range(i, min(i + 25, len(queries)))
        for r in c.select("id", *[match.condition(queries[k], ("title", "content")).alias(f"q{k}") for k in part]).collect():
            for k in part:
                if r[f"q{k}"]:
                    got[k].add(r.id)
    assert [(q, g) for q, g in zip(queries, got)] == [(q, w) for q, w in zip(queries, want)]


@pytest.fixture(scope="module")
def small_index(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('index')}"
    c = spark.createDataFrame([(*r, "m") for r in notes()], "id string, title string, content string, module string").repartition(3)
    fts_index.write(c, root)
    return root


def test_stored_positions_equal_fts5(spark, small_index):
    rows = notes()
    queries = [q for q, w in zip(asked(), by_fts5(rows, asked())) if w][::6] + ["NEAR(a b c, 2)", "a NOT b c", "title : (b OR de)", "a +", "missing", "missing OR a", "de* NOT def"]
    for q, want in zip(queries, by_fts5(rows, queries)):
        found = fts_index.match(spark, small_index, q, ("title", "content"))
        assert {r.id for r in found.collect()} == want, q
    plan = fts_index.match(spark, small_index, "a NOT b", ("content",))._jdf.queryExecution().executedPlan().toString()
    assert "content" in plan and "StringStartsWith" not in plan and "title" not in plan.partition("ReadSchema")[2].partition("content")[0]


@pytest.fixture(scope="module")
def large_index(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('large')}"
    fts_index.write(_chunks(spark, "/root/testdata/sf0.1"), root)
    return root


def test_ranking_reads_a_part_of_the_postings(spark, large_index):
    """Equal to the scan row by row, by less than a third of the terms' postings."""
    sf = "/root/testdata/sf0.1"
    chunks, q = _chunks(spark, sf), _asked(spark)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "raw", "score", "rank").collect()))
    assert rows(fts_index.top(large_index, q, 10)) == rows(fts.bm25(chunks, q, "ranked", 10))
    kept = {"types": ["term", "spec"], "module": "src3"}
    assert rows(fts_index.top(large_index, q, 5, chunks, **kept)) == rows(fts.bm25(chunks, q, "ranked", 5, **kept))
    effort = fts_index.effort(large_index, q, 10).agg(F.sum("postings"), F.sum("postings_read")).first()
    assert 0 < effort[1] < effort[0] / 3
    assert fts_index.top(large_index, spark.createDataFrame([("x", "nosuchword"), ("y", "")], "query_id string, query string"), 5).count() == 0


def test_scans_skip_what_a_condition_on_tiles_leaves_out(spark, large_index):
    """Pages hold a few blocks: a scan with a condition on neighbouring tiles reads few more rows than it returns."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    read = lambda: sum(s.inputRecords() for s in iterate(store.stageList(None, False, False, none, spark._jvm.java.util.ArrayList())))

    def iterate(seq):
        return [seq.apply(i) for i in range(seq.size())]

    blocks = fts_index.of_terms(spark, large_index, "blocks", ["the"])
    tiles = sorted(r.tile for r in blocks.select("tile").collect())
    asked = spark.createDataFrame([(t,) for t in tiles[:5]], "tile long")
    before = read()
    got = blocks.where(fts_index.tile_ranges(asked)).select("hits").collect()
    assert len(got) == 5 and len(tiles) > 100 and read() - before < len(tiles) / 3


def test_ids_stand_once_in_the_ranking_index(spark, sf_dir, tmp_path):
    """A posting is a number, of which the tile's row gives the id and length; it was an id, a length and a frequency."""
    c = _chunks(spark, sf_dir).repartition(3).localCheckpoint()
    fts_index.write_ranking(c, str(tmp_path))
    tiles, blocks = (segments.read(spark, str(tmp_path), n) for n in ("tiles", "blocks"))
    assert dict(blocks.dtypes)["hits"] == "array<bigint>"
    assert sorted(r.id for r in tiles.select(F.explode("ids").alias("id")).collect()) == sorted(r.id for r in c.collect())
    held = {r.tile: list(zip(r.ids, r.dl)) for r in tiles.collect()}
    got = {(r.term, held[r.tile][h & 63][0]): h >> 6 for r in blocks.collect() for h in r.hits}
    want = fts.postings(c, fts_index.COLUMNS).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
    assert got == {(r.term, r.doc_id): r.tf for r in want.collect()}


def test_indexes_are_written_without_an_exchange(spark, tmp_path):
    """A task writes the tiles of its own chunks: what is exchanged is figures and common terms, here 1.0 MB for 0.5 MB of text where it was 7.2, and not the postings; terms and trigrams of several runs and files are found."""
    from loregrid.operators import fts_index as index

    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def exchanged():
        stages = store.stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    root = f"file://{tmp_path}/index"
    c = _chunks(spark, "/root/testdata/sf0.001").repartition(3).localCheckpoint()
    many, size = c.agg(F.count("*"), F.sum(F.length("content"))).first()
    before = exchanged()
    index.write(c, root)
    gram_index.write(graph.nodes(c), root)
    assert exchanged() - before < 3 * size
    assert segments.read(spark, root, "figures").first().n == many
    word = index.match(spark, root, "the").count()
    assert word == match.match(c, "the").count() > 0


def test_substrings_by_trigrams(spark, tmp_path):
    root = f"file://{tmp_path}/grams"
    rows = [(f"id{i}", "api" if i % 2 else "spec", t) for i, t in enumerate(["Points Contract", "a points contract, twice: points contract", "poi", "pointscontract", "", None, "ÄÖ points", "日本語テキスト", "contract points"] * 9)]
    n = spark.createDataFrame(rows, "id string, type string, content string").repartition(3)
    gram_index.write(n, root)
    queries = spark.createDataFrame([("q1", "POINTS contract"), ("q2", "本語テ"), ("q3", "po"), ("q4", "id1"), ("q5", "äö "), ("q6", "nothing here"), ("q7", "")], "query_id string, query string")
    out = lambda df: sorted(map(str, df.select("query_id", "id", "type", "content", "score", "rank").collect()))
    want = graph.substring(n, queries, 7)
    assert out(gram_index.substring(spark, root, queries, 7)) == out(want) and want.count() > 30
    assert out(gram_index.substring(spark, root, queries, 7, ["spec"])) == out(graph.substring(n, queries, 7, ["spec"]))
    long = queries.where("length(query) > 2")
    plan = gram_index.substring(spark, root, long, 7)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


# ---------------------------------------------------------------- segments


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_segments_replace_add_delete_and_compact(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    table = lambda rows: spark.createDataFrame(rows, "id string, content string, dead boolean")
    base = table([(str(i), f"old {i}", False) for i in range(10)]).drop("dead")
    assert segments.replace(base, root, "t", "id").version == 1
    segments.apply(table([("3", "new 3", False), ("20", "added", False), ("4", None, True), (None, "no key", False)]), root, "t", deleted="dead")
    segments.delete(spark.createDataFrame([("5",), ("77",)], "id string"), root, "t")
    want = sorted([(str(i), f"old {i}") for i in (0, 1, 2, 6, 7, 8, 9)] + [("3", "new 3"), ("20", "added")])
    assert rows_of(segments.read(spark, root, "t"), "id", "content") == want
    assert rows_of(segments.read(spark, root, "t", 1), "id") == sorted((str(i),) for i in range(10))  # versions stay readable
    segments.apply(table([("5", "back", False)]), root, "t", deleted="dead")
    want = sorted([*want, ("5", "back")])
    assert rows_of(segments.read(spark, root, "t"), "id", "content") == want
    m = segments.compact(spark, root, "t")
    assert len(m.segments) == 1 and rows_of(segments.read(spark, root, "t"), "id", "content") == want
    assert segments.vacuum(spark, root, "t", keep=1) == 4 and rows_of(segments.read(spark, root, "t"), "id", "content") == want
    for i in range(segments.COMPACT_AT):
        m = segments.apply(table([("1", f"round {i}", False)]), root, "t", deleted="dead")
    assert len(m.segments) < segments.COMPACT_AT and ("1", f"round {i}") in rows_of(segments.read(spark, root, "t"), "id", "content")
    with pytest.raises(ValueError):
        segments.apply(table([("1", "x", False)]), root, "t", key="content")


def test_a_failure_before_the_switch_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/index"
    one = spark.createDataFrame([("1", "a")], "id string, content string")
    segments.replace(one, root, "t", "id")

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(segments, "_commit", fails)
        with pytest.raises(RuntimeError):
            segments.apply(spark.createDataFrame([("1", "b")], "id string, content string"), root, "t")
    assert rows_of(segments.read(spark, root, "t"), "id", "content") == [("1", "a")]
    (tmp_path / "index/t/manifest/000000000002.json").write_text("{")  # a manifest that a writer never finished
    assert rows_of(segments.read(spark, root, "t"), "id", "content") == [("1", "a")]
    assert segments.apply(spark.createDataFrame([("1", "c")], "id string, content string"), root, "t").version == 3
    stale = segments.manifest(spark, root, "t", 1)
    with pytest.raises(segments.VersionError):
        segments._commit(spark, root, "t", stale)
    assert rows_of(segments.read(spark, root, "t"), "id", "content") == [("1", "c")]


def test_a_stream_goes_on_after_a_batch_run(spark, tmp_path):
    """Batch 0 of a stream, and of another checkpoint, adds to what is there; a batch that comes again changes nothing."""
    root = f"file://{tmp_path}/index"
    segments.replace(spark.createDataFrame([(str(i), f"old {i}") for i in range(4)], "id string, content string"), root, "docs", "id")
    new = "id string, content string, dead boolean"
    for k, (checkpoint, rows) in enumerate([("a", [("1", "x", False), ("9", "y", False)]), ("a", [("2", None, True)]), ("b", [("3", "z", False)])]):
        spark.createDataFrame(rows, new).coalesce(1).write.mode("append").parquet(str(tmp_path / checkpoint))
        stream = spark.readStream.schema(new).parquet(str(tmp_path / checkpoint))
        feedback.ingest(stream, root, "docs", str(tmp_path / f"cp-{checkpoint}"), deleted="dead").awaitTermination()
        assert len(segments.versions(spark, root, "docs")) == k + 2
    assert rows_of(segments.read(spark, root, "docs"), "id", "content") == [("0", "old 0"), ("1", "x"), ("3", "z"), ("9", "y")]
    m = segments.apply(spark.createDataFrame([("0", "again", False)], new), root, "docs", deleted="dead", batch=(str(tmp_path / "cp-a"), 1))
    assert m.version == 4 and ("0", "old 0") in rows_of(segments.read(spark, root, "docs"), "id", "content")


def test_table_functions_equal_the_expressions(spark, sf_dir):
    from loregrid.operators import ingest, table_functions

    table_functions.register(spark)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("content"))
    d = d.unionByName(spark.createDataFrame([(-1, "intro\n\n## API\n### GET /a\nDoes a.\n### Empty\n#### post /b/c\n x "), (-2, ""), (-3, None), (-4, "one\n \ntwo " + "x" * 4000 + "\n\nthree")], "doc_id long, content string"))
    d.createOrReplaceTempView("some_documents")
    got = spark.sql("SELECT doc_id, p.ord, p.content FROM some_documents, LATERAL packed_paragraphs_of(content, r'\n\s*\n') p")
    assert rows_of(got, "doc_id", "ord", "content") == rows_of(d.select("doc_id", F.posexplode(ingest.packed_paragraphs(F.col("content"))).alias("ord", "content")), "doc_id", "ord", "content")
    got = spark.sql("SELECT doc_id, e.* FROM some_documents, LATERAL api_entries_of(content) e")
    names = ("doc_id", "entry_no", "entry_title", "entry", "http_method", "url_path")
    assert rows_of(got, *names) == rows_of(ingest.api_entries(d), *names) and got.count() == 2
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
