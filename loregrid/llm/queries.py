"""Queries that apply the training-data operators to their whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, jaccard, language, lloyd, lmscore, packing, quality, resample, sharding, suffix_dedup, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(_table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.clusters(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_owners(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("content_hash")).alias("text_sha256"))


def _held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 3 == 1


def _learns(doc_id):
    return ~_held_out(doc_id)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trees = quality.fit(docs, _table(spark, sf_dir, "labels"), learns=_learns)
    rows = quality.scored(docs.select("doc_id", "text"), trees)
    return rows.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.removed(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    gone = F.aggregate("cut.spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return rows.select("doc_id", (F.octet_length("cut.kept") + gone).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("cut.spans").cast("long").alias("n_spans"), F.sha2("cut.kept", 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(_table(spark, sf_dir, "pages"), least_bytes=0)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lmscore.scored(docs, lmscore.fit(docs))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = language.predicted(docs.select("doc_id", "text"), language.fit(docs, learns=_learns))
    return rows.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.slots(_table(spark, sf_dir, "documents"), shards=24)


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clusters(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, size=64, seed="2")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, least_words=20, buckets=10_000, longest=1, seed="2024")


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_bpe, op3_quality, op4_jaccard, op5_top_k, op6_exact_dedup, op7_suffix_dedup, op8_warc, op9_lm_score, op10_language,
        op11_sharding, op12_lloyd, op13_resample,
    )
}

#: The white space that is deleted before comparison.
_STRIPPED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

#: base32's letters, and four bits for each hexadecimal digit.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BITS = "0000000100100011010001010110011110001001101010111100110111101111"
_FIVE = " + ".join(f"{16 >> k} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INTEGER)" for k in range(5))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: SQL of the CRC-32 table by its rule, and of a text's CRC-32 over its bytes in hexadecimal digits.
_CRC_TABLE = "list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"


def _crc(hexed: str, table: str = "t") -> str:
    bytes_ = f"list_transform(regexp_extract_all({hexed}, '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(c >> 8, {table}[1 + xor(c & 255, b)]), 4294967295), 4294967295)"


def _lloyd_sql(k: int, rounds: int, size: int, seed: str) -> str:
    """Rounds written out: the nearest centroid of each vector, then new centroids from the old ones and the floors of means."""
    whole = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
    near = "SELECT v.i, v.vec_id, v.e, c.k, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN {c} c QUALIFY row_number() OVER (PARTITION BY v.i ORDER BY d, c.k) = 1"
    out = f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, {whole} AS e FROM embeddings
            WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY s) - 1 AS k, e FROM (SELECT sha256('{seed}:' || vec_id) AS s, e FROM v ORDER BY s LIMIT {k}))"""
    for r in range(rounds):
        out += f""",
        n{r} AS MATERIALIZED ({near.format(c=f"c{r}")}),
        m{r} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM n{r}) GROUP BY k, j),
        f{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS e FROM m{r} GROUP BY k),
        c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(f.e, c.e) AS e FROM c{r} c LEFT JOIN f{r} f ON f.k = c.k)"""
    return f"""{out},
        n AS MATERIALIZED ({near.format(c=f"c{rounds}")})
        SELECT vec_id, CAST(n.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY n.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM n JOIN c{rounds} c ON c.k = n.k"""


def _jump_sql(shards: int) -> str:
    """The jump loop, as list_reduce over as many steps as there are shards and more."""
    state = "(s.state::UHUGEINT * 2862933555777941757 + 1) % 18446744073709551616"
    to = f"CAST(floor((s.next + 1)::DOUBLE * (2147483648::DOUBLE / ((({state}) // 8589934592) + 1)::DOUBLE)) AS BIGINT)"
    step = f"CASE WHEN s.next > {shards} THEN s ELSE {{'state': ({state})::UBIGINT, 'before': s.at, 'at': s.next, 'next': {to}}} END"
    start = "{'state': CAST('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UBIGINT), 'before': CAST(-1 AS BIGINT), 'at': CAST(-1 AS BIGINT), 'next': CAST(0 AS BIGINT)}"
    steps = ", ".join([start] * (shards + 3))  # list_reduce takes elements of one type: only their count matters
    return f"list_reduce([{steps}], lambda s, _: {step})"


ORACLE_SQL = {
    "op11_sharding": f"""
        WITH t AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
        d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, {_jump_sql(24)} AS s FROM documents),
        r AS (SELECT doc_id, CAST(octet_length(b) + 8 AS BIGINT) AS size, CAST(CASE WHEN octet_length(b) = 0 THEN 0 ELSE {_crc("hex(b)")} END AS BIGINT) AS text_crc32,
            CAST(CASE WHEN s.at < 24 THEN s.at ELSE s.before END AS INTEGER) AS shard, CAST(s.at AS INTEGER) AS grown_shard FROM d, t)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM r""",
    "op12_lloyd": _lloyd_sql(40, 5, 64, "2"),
    "op13_resample": f"""
        WITH t AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
        w AS MATERIALIZED (SELECT 0 AS side, row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
            UNION ALL SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
        f AS MATERIALIZED (SELECT side, i, f, count(*) AS n FROM (SELECT side, i, unnest(w) AS f FROM w) GROUP BY side, i, f),
        b AS MATERIALIZED (SELECT f, CAST({_crc("hex(encode(f))")} % 10000 AS BIGINT) AS b FROM (SELECT DISTINCT f FROM f), t),
        c AS (SELECT b, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM f JOIN b USING (f) GROUP BY b),
        a AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM c),
        g AS (SELECT c.b, CAST(floor(1000 * ln(((c.t + 1) * (a.s + 10000))::DOUBLE / ((c.s + 1) * (a.t + 10000))::DOUBLE)) AS BIGINT) AS g FROM c, a),
        x AS (SELECT i, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * g) AS BIGINT) AS g FROM f JOIN b USING (f) JOIN g USING (b) WHERE side = 0 GROUP BY i),
        h AS (SELECT i, doc_id, coalesce(x.n, 0) AS n_features, coalesce(x.g, 0) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN x USING (i) WHERE side = 0),
        z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM h),
        r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS m FROM z)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * m // 100 THEN r END AS rank FROM r""",
    "op4_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op7_suffix_dedup": """
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        p AS (SELECT doc_id, x, unnest(range(0, greatest(0, length(x) // 2 - 399))) AS i FROM h),
        k AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS m FROM p),
        d AS (SELECT doc_id, i FROM k WHERE m IN (SELECT m FROM k GROUP BY m HAVING count(*) > 1)),
        g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM d)),
        r AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, s),
        z AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM r),
        y AS (SELECT h.doc_id, any_value(x) AS x, coalesce(sum(b - a), 0) AS gone, count(a) AS runs, coalesce(max(b), 0) AS after, coalesce(string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a), '') AS before FROM h LEFT JOIN z ON z.doc_id = h.doc_id GROUP BY h.doc_id)
        SELECT doc_id, length(x) // 2 AS n_bytes, CAST(gone AS BIGINT) AS n_removed, runs AS n_spans, sha256(unhex(before || substr(x, 2 * after + 1))) AS kept_sha256 FROM y""",
    "op8_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first FROM p),
        b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda j: substr('{_BITS}', 4 * strpos('0123456789abcdef', substr(s, j, 1)) - 3, 4)), '') AS bits FROM d)
        SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1 + {_FIVE}, 1)), '') AS payload_digest,
            CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM b""",
    "op5_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_exact_dedup": f"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, {_STRIPPED} AS body FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g""",
}
