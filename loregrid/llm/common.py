"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by position, so that no other column's name can clash with them."""
    held = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(held))])
    return plain.select(*[F.col(f"_c{held.index(n)}").alias(n) for n in names])


#: Rows in an Arrow batch of texts at most: texts may be long, and a batch is held several times over, in the JVM and in Python.
BATCH_ROWS = 1_000
BATCH_BYTES = "512k"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by rows and bytes; they tell nothing of results."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text with null as empty, and more columns."""
    small_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text", *more).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))})


_TOPS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder that the cluster names, removed when the session's process ends; in local mode, as in tests, a temporary one where none is named."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="loregrid-")
        spark.conf.set("spark.checkpoint.dir", top)
    app = spark.sparkContext.applicationId
    if (own := _TOPS.get(app + top)) is None:
        own = _TOPS[app + top] = f"{top.rstrip('/')}/loregrid-{app}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet in the shared folder and read from there: cuts the lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of some tens of bytes that may be broadcast.
SENT = 1 << 18


def sent(df: DataFrame, most: int = SENT) -> DataFrame:
    """df, a stored table, to be broadcast in a join if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def parts(df: DataFrame) -> int:
    """Partitions for an exchange."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- pieces of text before byte-pair merges

#: Letters, numbers and white space below U+0100, as Unicode has them.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
#: White space by its Unicode property, for texts beyond U+00FF.
_WHITE = r"\p{White_Space}"


class Splitter:
    """Splits a text into the matches of a pattern. For the public pattern, texts below U+0100 take an equal pattern of explicit ranges, which is several times as fast."""

    def __init__(self, pattern: str, public: str):
        self.general = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_WHITE}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)|\s+", rf"{_WHITE}+(?!\P{{White_Space}})|{_WHITE}+") if pattern == public else pattern)
        self.latin = _LATIN if pattern == public else None

    def __call__(self, text: str) -> list[str]:
        if self.latin is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.general.findall(text)
            return self.latin.findall(text)
        return self.general.findall(text)


# ---------------------------------------------------------------- words of many texts at once

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_WHITE_BYTES = np.zeros(256, bool)
_WHITE_BYTES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_POW: dict[str, np.ndarray] = {}
#: Powers that are kept at most, for each base: as many as a slice of texts has bytes, and more.
POWERS_KEPT = 1 << 19


def powers(n: int, base: np.uint64, name: str) -> np.ndarray:
    """base to the power of 0 .. n - 1, modulo 2 ** 64. A worker keeps those of common lengths alone: a very long text's go with it."""
    if (held := _POW.get(name)) is None or len(held) < n:
        size = 1 << max(16, int(n - 1).bit_length()) if n <= POWERS_KEPT else n
        out = np.full(size, base, np.uint64)
        out[0] = 1
        held = np.multiply.accumulate(out)
        if size <= POWERS_KEPT:
            _POW[name] = held
    return held[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and where each value starts (one more for the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Sums S with S[i] over the first i bytes, from which span_hash() takes any span's hash."""
    out = np.empty(len(raw) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_MIX[raw] * powers(len(raw), _B, "b"), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from start to end, by their content alone."""
    inverse = powers(len(sums), _B_INV, "inv")
    return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes beside white space, A-Z lower-cased) of each text, and where each text's words start."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    word = ~_WHITE_BYTES[raw]
    edge = np.zeros(n + 1, bool)  # a text's first byte: words don't cross it
    edge[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before &= ~edge[:-1]
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(word & ~after) + 1
    sums = prefix_hash(_LOWER[raw])
    return span_hash(sums, starts, ends), np.searchsorted(starts, at)


def slices(table: pa.RecordBatch, column: str, most: int = (1 << 18) - 64):
    """Parts of a batch with about so many bytes of text in one column each; one longer text is a part of its own."""
    _, at = buffer_of(table.column(column))
    i = 0
    while i < table.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield table.slice(i, j - i)
        i = j


def annotated(docs: DataFrame, column: str, made, name: str, kind: str) -> DataFrame:
    """docs with all columns as they are and one more at the end: made(batch, texts) gives its values (or an Arrow array) for a slice of rows; texts are the column's, null as empty."""
    small_batches(docs.sparkSession)
    held = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(held))])
    at = held.index(column)

    def run(batches):
        for whole in batches:
            text = whole.column(at)
            text = text.fill_null("") if text.null_count else text
            filled = pa.RecordBatch.from_arrays([text, pa.array(np.arange(whole.num_rows))], names=["text", "row"])
            for part in slices(filled, "text"):
                if part.num_rows:
                    rows = whole.slice(part.column(1)[0].as_py(), part.num_rows)
                    new = made(rows, part.column(0))
                    yield pa.RecordBatch.from_arrays([*rows.columns, new if isinstance(new, pa.Array) else pa.array(new)], names=[*rows.schema.names, "_new"])

    from pyspark.sql import types as T

    schema = T.StructType([*plain.schema.fields, T.StructField("_new", T._parse_datatype_string(kind))])
    return plain.mapInArrow(run, schema).toDF(*held, name)
