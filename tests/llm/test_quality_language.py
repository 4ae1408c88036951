import numpy as np
import pytest

from loregrid.llm import language, quality
from loregrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in QUERIES["op3_quality"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [(rows[i].predicted, q) for i, q in labels.items() if rows[i].held_out]
    assert sum(p == q for p, q in held) >= 0.95 * len(held) and len(held) > 50


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    learns = lambda i: F.crc32(i.cast("string")) % 3 != 1
    a = quality.fit(docs, labels, learns=learns, trees=5)
    b = quality.fit(docs.withColumn("lang", F.lit("x")), labels.withColumn("quality", F.when(learns(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality"))), learns=learns, trees=5)
    assert np.array_equal(a.feature, b.feature) and np.allclose(a.value, b.value)


def test_flattened_trees_match_a_walk():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    t = quality.grow(x, y, trees=20, depth=3)
    want = []
    for row in x:
        total = t.base
        for f, c, v in zip(t.feature, t.threshold, t.value):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += v[node - 7]
        want.append(1 / (1 + np.exp(-total)))
    got = t.score(x)
    assert np.allclose(got, want)
    assert ((got > 0.5) == y).mean() > 0.95


def test_quality_odd_rows(spark):
    rows = [(None, 1, "s"), ("", 2, "s"), ("\U0001f600" * 3, None, "s"), ("w " * 200_000, 4, None)]
    docs = spark.createDataFrame(rows, "text string, doc_id long, score string")
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1), (9, None, 1)], "doc_id long, quality int, toxic int")
    t = quality.fit(docs, labels)
    got = quality.scored(docs, t, "new")
    assert got.columns == ["text", "doc_id", "score", "new"] and got.count() == 4
    assert all(0 <= r.new <= 1 for r in got.collect())
    assert quality.scored(docs.limit(0), t).count() == 0
    few = quality.fit(docs.unionByName(docs), labels, most_rows=10)  # ids that repeat bring no more rows than that
    assert len(few.value) or few.base is not None
    none = quality.fit(docs, labels.limit(0))
    assert {r.new for r in quality.scored(docs, none, "new").collect()} == {0.5}


def test_language_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op10_language"](spark, SF).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(held) >= 0.98 * len(held) and len(held) > 100


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat and the dog ran", "en"), ("der Hund läuft über die Straße und schläft", "de")] * 20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_odd_rows(spark, texts):
    model = language.fit(texts)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !? \n", None), (4, "日本語", "x"), (5, "dog " * 100_000, "x"), (None, "die Straße", "x"), (5, "dog " * 100_000, "x")], "doc_id long, text string, score string")
    got = language.predicted(odd, model)
    assert got.columns == ["doc_id", "text", "score", "language"]
    rows = [(r.doc_id, r.language.lang_pred) for r in got.collect()]
    assert sorted(rows, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, rows[3][1]), (5, "en"), (None, "de"), (5, "en")], key=str) and rows[3][1] in ("en", "de")
    far = {r.doc_id: r.language.rejected for r in got.collect()}
    assert far[4] and far[1] and far[5]  # by the rule for rejection: one word over and over is far from all that was learned
    assert not any(r.language.rejected for r in language.predicted(texts, model).collect())
    assert language.predicted(odd.limit(0), model).count() == 0
    again = language.fit(texts.unionByName(texts))  # rows that repeat change nothing
    assert np.array_equal(again.centre, model.centre) and np.array_equal(again.least, model.least)
    nothing = language.fit(texts.limit(0))
    assert {r.language.lang_pred for r in language.predicted(texts, nothing).collect()} == {"und"}


def test_profile_matches_plain_counting():
    texts = ["Ab!!c", "", "é  x\ny"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *[len(t.encode()) for t in texts]])
    got = language.profile(raw, at)
    assert got.sum(1).tolist() == [9.0, 0.0, 15.0]  # "ab c" and "é x y" in bytes: grams of one, two and three
    assert np.array_equal(got[0], language.profile(np.frombuffer(b"AB c", np.uint8), np.array([0, 4]))[0])


def test_language_of_few_ids_that_repeat_often_is_learned(spark):
    rows = [(i, f"the cat number {i} sat on a mat", "en") for i in range(300)] + [(7_000_001 + i % 2, "der hund lief durch das haus", "de") for i in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for k in range(4):
        model = language.fit(docs.withColumn("doc_id", docs.doc_id + 1_000 * k), most_rows=100)
        assert model.languages == ["de", "en"]
