import io
import zipfile
from collections import Counter

import pytest

from loregrid.llm import warc
from loregrid.llm.queries import QUERIES


def brute(pages):
    first = {}
    for i, html in pages:
        if i is not None:
            p = html or ""
            first[p] = min(first.get(p, i), i)
    out = Counter()
    for i, html in pages:
        p = html or ""
        own = p not in first or first[p] == i
        out[i, len(p.encode()), warc.digest(p.encode()), "response" if own else "revisit", None if own else first[p]] += 1
    return out


def test_query(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op8_warc"](spark, sf_dir).collect())) == brute(pages)


def test_odd_pages(spark):
    rows = [(1, "u\r\n", None, "a"), (2, None, "", "b"), (3, "x", "é" * 300_000, "c"), (9, "x", "é" * 300_000, "c"), (4, "y", "\r\n\r\n", None), (4, "y", "\r\n\r\n", None), (None, "z", "own", "d"), (None, "z", "", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")
    got = warc.round_trip(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute([(r[0], r[2]) for r in rows])
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response" and r.page_id} == {1: "", 3: "é" * 300_000, 4: "\r\n\r\n"}
    assert {r.url for r in got if r.page_id == 1} == {"u%0D%0A"}
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert {r.record_type for r in warc.round_trip(pages, least_bytes=1 << 30).collect()} == {"response"}


@pytest.mark.parametrize("zip64", [False, True])
def test_directory(zip64):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open("a/b", "w", force_zip64=zip64) as f:
            f.write(b"0123456789")
        z.writestr(zipfile.ZipInfo("c"), b"xyz")
        z.writestr(zipfile.ZipInfo("d"), b"z" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    r = warc.PackageReader(out, len(out.getvalue()))
    assert list(r.members) == ["a/b", "c", "d"]
    assert r.read("a/b", 3, 4) == b"3456" and r.read("c") == b"xyz" and r.read("a/b", 8, 99) == b"89"
    with pytest.raises(ValueError):
        r.read("d")
    with pytest.raises(ValueError):
        warc.PackageReader(io.BytesIO(b"no zip" * 9), 54)


def test_zip64_end_record(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 40)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(5):
            z.writestr(zipfile.ZipInfo(f"m{i}"), bytes([i]) * (10 + 20 * i))
    data = out.getvalue()
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    r = warc.PackageReader(io.BytesIO(data), len(data))
    assert [r.read(f"m{i}") for i in range(5)] == [bytes([i]) * (10 + 20 * i) for i in range(5)]
