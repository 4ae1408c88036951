import hashlib
import inspect
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from loregrid.llm import common, lmscore, quality, suffix_dedup
from loregrid.llm.common import buffer_of, word_hashes
from loregrid.llm.packing import ids_of
from loregrid.llm.queries import QUERIES


def brute(texts, length):
    """(bytes, removed, runs, digest of the rest) of each text."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def found(df, length):
    rows = suffix_dedup.removed(df, length).collect()
    return Counter((r.doc_id, sum(s.length for s in r.cut.spans), len(r.cut.spans), hashlib.sha256(bytes(r.cut.kept)).hexdigest()) for r in rows)


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = {r.doc_id: w for r, w in zip(docs, brute([r.text for r in docs], 400))}
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_suffix_dedup"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize("length", [2, 9, 24, 60])
def test_passages_within_and_across(spark, length):
    r = np.random.default_rng(length)
    say = lambda n: "".join("abcdefgh "[k] for k in r.integers(0, 9, n))
    passage, texts = say(150), []
    for i in range(60):
        t = say(int(r.integers(0, 300)))
        if i % 2:
            k = int(r.integers(0, len(t) + 1))
            a, b = sorted(r.integers(0, 151, 2))
            t = t[:k] + passage[a:b] + t[k:]
        texts.append(t)
    texts += ["é" * 70, "aaaa" * 40, passage + "x" + passage, texts[5], texts[5], "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    assert found(df, length) == Counter((i, *w[1:]) for i, w in enumerate(brute(texts, length)))


def test_passage_odd_rows(spark):
    long = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(150_000))
    rows = [(1, "x", None), (1, "x", None), (None, "y", "no such thing " * 60), (3, None, "é" * 500), (4, "z", long), (4, "z", long), (5, "z", "short")]
    df = spark.createDataFrame(rows, "doc_id long, cut string, text string")
    out = suffix_dedup.removed(df.withColumnRenamed("cut", "spans"), 400)
    assert out.columns == ["doc_id", "spans", "text", "cut"]
    want = Counter((r[0], *w[1:]) for r, w in zip(rows, brute([r[2] for r in rows], 400)))
    assert found(df.drop("cut"), 400) == want
    assert suffix_dedup.removed(df.limit(0).drop("cut"), 400).count() == 0


def test_whole_characters(spark):
    texts = ["a" + "é" * 30 + "b", "c" + "é" * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = [bytes(r.cut.kept).decode() for r in suffix_dedup.removed(df, 21, whole_characters=True).orderBy("doc_id").collect()]
    assert kept == ["ab", "c"]


# ---------------------------------------------------------------- language model


def texts_of(*texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    return word_hashes(raw, np.cumsum([0, *[len(t.encode()) for t in texts]]))


def test_log_probabilities_by_plain_loops():
    r = np.random.default_rng(2)
    net = lmscore.Network.fresh(r.random(lmscore.CLASSES), window=2, width=4)
    net.row, net.column = r.normal(size=net.row.shape).astype("f"), r.normal(size=net.column.shape).astype("f")
    words, first = texts_of("a b c a", "", "d", "e f")
    word = lmscore.classes(words, np.sort(words[:3]))
    got = net.log_probability(lmscore.contexts(word, first, 2), word)
    want = []
    for i, j in zip(first[:-1], first[1:]):
        for k in range(i, j):
            h = net.hidden.astype(float).copy()
            for place, off in enumerate((-2, -1, 1, 2)):
                h += net.context[place][word[k + off] if i <= k + off < j else lmscore.OUTSIDE]
            h = np.tanh(h)
            a = h @ net.row + net.row_bias
            b = h @ net.column + net.given[word[k] // 32]
            want.append(a[word[k] // 32] - np.log(np.exp(a).sum()) + b[word[k] % 32] - np.log(np.exp(b).sum()))
    assert np.allclose(got, want, atol=1e-4) and len(want) == 7


def test_probabilities_sum_to_one():
    net = lmscore.Network.fresh(np.arange(lmscore.CLASSES), window=1, width=4)
    around = np.array([[3], [900]])
    assert abs(sum(np.exp(net.log_probability(around, np.array([w]))[0]) for w in range(lmscore.CLASSES)) - 1) < 1e-4


def test_training_learns_both_sides(spark):
    r = np.random.default_rng(0)
    lines = []
    for i in range(400):
        a, b = r.integers(0, 8, 2)
        lines.append((i, " ".join(f"l{a} m{(a + b) % 8} r{b}" for _ in range(30))))
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    model = lmscore.fit(docs, rounds=3, every=3, batch_size=128)
    odd = spark.createDataFrame([(1, lines[0][1]), (2, " ".join(reversed(lines[0][1].split()))), (3, None), (4, ""), (None, "l1"), (5, "x " * 100_000), (5, "x " * 100_000)], "doc_id long, text string")
    got = [r for r in lmscore.scored(odd, model).collect()]
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[1].n_tokens == 90 and by[3].n_tokens == by[4].n_tokens == 0 and by[3].log_likelihood == by[4].score == 0
    assert by[1].score > by[2].score + 0.1
    assert abs(by[1].log_likelihood - by[1].score * 90) < 1e-6 and by[5].n_tokens == 100_000
    assert lmscore.scored(odd.limit(0), model).count() == 0
    empty = lmscore.fit(docs.limit(0))
    assert lmscore.scored(odd, empty).count() == 7


def test_every_word_is_a_target():
    """The turns of fit() as it is called, on one partition: each word is trained on once."""
    default = {k: v.default for k, v in inspect.signature(lmscore.fit).parameters.items()}
    rounds, every = default["rounds"], default["every"]
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{k}" for k in range(n)) for n in (1, 5, 100, 0, 1_001)]})
    net, seen = lmscore.Network.fresh(np.ones(lmscore.CLASSES), width=4), 0
    for turn in range(rounds):
        run = lmscore._trained(net, np.zeros(0, np.uint64), every, turn * every // rounds, 64, 0.5)
        seen += sum(b.column("n").to_pylist()[0] for b in run(iter([batch])))
    assert seen == 1_107


@pytest.mark.parametrize("at_hand", [1 << 18, 800])
def test_words_of_a_class_keep_their_counts(spark, monkeypatch, at_hand):
    """Counts sent to the tasks, or joined: words of one hashed class differ by the logarithm of their counts."""
    monkeypatch.setattr(lmscore, "AT_HAND", at_hand)
    often = [f"o{k}" for k in range(900)]
    rare = [f"r{k}" for k in range(600)]
    lines = [" ".join(often)] * 9 + [" ".join(rare)] + [" ".join(rare[:300])] * 2
    model = lmscore.fit(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3), batch_size=128)
    hashes, _ = texts_of(" ".join(often + rare))
    at = lmscore.classes(hashes, model.vocabulary)
    n = {w: 9 for w in often} | {w: 3 if k < 300 else 1 for k, w in enumerate(rare)}
    groups = defaultdict(list)
    for w, c in zip(often + rare, at):
        if c >= lmscore.KNOWN:
            groups[c].append(w)
    words = [w for g in groups.values() if len({n[w] for w in g}) > 1 for w in g]
    got = {r.doc_id: r.log_likelihood for r in lmscore.scored(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), model).collect()}
    of = {w: got[i] for i, w in enumerate(words)}
    for g in groups.values():
        total = sum(n[w] for w in g)
        assert abs(model.shared_log[at[(often + rare).index(g[0])] - lmscore.KNOWN] - np.log(total + 1)) < 1e-9
        for w in g[1:] if g[0] in of else []:
            assert abs(of[w] - of[g[0]] - np.log(n[w] / n[g[0]])) < 1e-4
    assert len({n[w] for w in of}) == 3 and (model.rest is not None) == (at_hand == 800)


def test_lm_query_covers_all_words(spark, sf_dir):
    rows = {r.doc_id: r for r in QUERIES["op9_lm_score"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert rows[r.doc_id].n_tokens == len((r.text or "").encode().split())
        assert rows[r.doc_id].log_likelihood <= 0


# ---------------------------------------------------------------- pipeline


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string")


def rows_of(docs):
    return [(r.doc_id, r.text, "en", "s", len(r.text or ""), None) for r in docs]


def test_stages_by_brute_force(spark, sf_dir):
    """Each stage on what its predecessor kept; an extra column stays."""
    docs = table(spark, rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet").collect()))
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, sf_dir).cache()
    trees = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learns=corpus_pipeline._learns)
    want = {r.doc_id for r in quality.scored(docs, trees, "p").collect() if r.p >= 0.5}
    assert good.columns == names and {r.doc_id for r in good.collect()} == want and 0 < len(want) < docs.count()

    one = stages["exact_dedup"](spark, good, sf_dir).cache()
    groups = defaultdict(list)
    for r in good.collect():
        groups["".join(r.text.split(" ")).translate({k: None for k in range(9, 14)})].append((-len(r.text), r.doc_id))
    assert one.columns == names and sorted(r.doc_id for r in one.collect()) == sorted(min(g)[1] for g in groups.values())

    from test_joins import brute as near

    far = stages["jaccard"](spark, one, sf_dir).cache()
    of = near([(r.doc_id, r.text) for r in one.collect()])
    assert far.columns == names and sorted(r.doc_id for r in far.collect()) == sorted(i for i, (_, c) in of.items() if i == c)

    cut = stages["suffix_dedup"](spark, far, sf_dir).cache()
    was = {r.doc_id: r.text for r in far.collect()}
    removed = {i: w[1] for i, w in zip(was, brute(list(was.values()), corpus_pipeline.PASSAGE_BYTES))}
    assert cut.columns == names and len(was) == cut.count()
    for r in cut.collect():
        lost = len(was[r.doc_id].encode()) - len(r.text.encode())
        assert removed[r.doc_id] <= lost <= removed[r.doc_id] + 6 * (1 + removed[r.doc_id] // corpus_pipeline.PASSAGE_BYTES) and r.n_chars == len(r.text)
        assert removed[r.doc_id] or r.text == was[r.doc_id]

    pieces = stages["packing"](spark, cut, sf_dir).collect()
    import public_tokenizers as P

    t = ids_of(P.path("byte_bpe_50k.json"))
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    for r in cut.collect():
        assert b"".join(p.ids for p in sorted(by[r.doc_id], key=lambda p: p.start)) == t(r.text).tobytes() + bytes(4)


def test_stages_with_odd_rows(spark, sf_dir):
    body = " ".join(f"word{k}" for k in range(200))
    rows = [(1, body, "en", "s", 1, "a"), (1, body, "en", "s", 1, "a"), (2, None, None, None, None, None), (3, "", "en", "s", 0, "a"), (None, "alone here", "en", "s", 9, "b"), (5, body + " end", "en", "s", 2, "c"), (6, body.upper(), "en", "s", 3, "d")]
    docs = table(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    stages = dict(corpus_pipeline.STAGES)
    out = stages["exact_dedup"](spark, docs, sf_dir)
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 2, 5, 6, None]
    out = stages["jaccard"](spark, out, sf_dir)
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 2, None]
    assert [r.text for r in stages["suffix_dedup"](spark, out, sf_dir).where("doc_id = 2").collect()] == [None]
    assert stages["packing"](spark, out, sf_dir).count() >= 3


def test_stages_with_repeated_ids_ties_and_clashing_names(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    say = lambda *w: " ".join(str(x) for x in w)
    a, b = say(*range(100)), say(*range(1000, 1100))
    near = say(*range(99), "other")
    names = "doc_id long, text string, _score double, score string, _id string, _c0 long, component_id long, cut string"
    rows = [(1, a, 0.5, "x", "i", 3, None, "c"), (7, near, 0.5, "x", "j", 3, 2, "c"), (7, b, 0.5, "x", "k", 3, 2, "c"), (8, b + " ", 0.5, None, "l", 3, 2, "c"), (9, say(*range(5000, 5100)), None, "z", "m", None, None, None), (9, say(*range(5000, 5100)), None, "y", "n", None, None, None)]
    docs = spark.createDataFrame(rows, names)
    for name in ("quality", "suffix_dedup"):
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() <= docs.count()
    one = stages["exact_dedup"](spark, docs, sf_dir)
    assert one.columns == docs.columns
    assert sorted((r.doc_id, r._id) for r in one.collect()) == [(1, "i"), (7, "j"), (8, "l"), (9, "n")]  # b with a space is longer; of the ties "y" is before "z"
    far = stages["jaccard"](spark, docs, sf_dir)
    assert far.columns == docs.columns
    assert sorted((r.doc_id, r._id) for r in far.collect()) == [(1, "i"), (8, "l"), (9, "m"), (9, "n")]  # b stays as 8, whose id stands once
    apart = stages["jaccard"](spark, docs.where("doc_id <> 8"), sf_dir)
    assert sorted((r.doc_id, r._id) for r in apart.collect()) == [(1, "i"), (7, "k"), (9, "m"), (9, "n")]  # the other text of 7 is no copy


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    sequences = defaultdict(int)
    for p in rows:
        sequences[p.sequence_id] += p.length
    assert rows and all(n == 1024 or n & (n - 1) == 0 for n in sequences.values())


def test_ranks_never_meet(monkeypatch):
    """A bucket with more names than ranks can tell apart is an error, not a wrong result."""
    n = 8
    x = np.arange(1, n + 1, dtype="<u8")
    blob = np.array([n, 4], "<i4").tobytes() + x.tobytes() + np.zeros(n, "<u4").tobytes() + np.full(n, 2, "<u4").tobytes()
    batch = suffix_dedup._sent([(3, 0, blob)])
    assert sum(b.num_rows for b in suffix_dedup._ranks([batch])) == 1
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 3)
    with pytest.raises(OverflowError):
        list(suffix_dedup._ranks([batch]))


def test_powers_of_very_long_texts_are_not_kept(monkeypatch):
    monkeypatch.setattr(common, "POWERS_KEPT", 1 << 17)
    monkeypatch.setattr(common, "_POW", {})
    n = 200_000
    got = common.powers(n, np.uint64(3), "three")
    assert [int(got[i]) for i in (0, 1, 17, n - 1)] == [1, 3, 3**17, pow(3, n - 1, 1 << 64)] and not common._POW
    assert len(common.powers(5, np.uint64(3), "three")) == 5 and len(common._POW["three"]) == 1 << 16
