import gzip
import hashlib
from pathlib import Path

from tessera.llm import warc


def test_round_trip(spark, tmp_path):
    long, other = "é\r\n\r\nWARC/1.1\r\n" * 100, "y" * 1000
    rows = [(1, "http://a/", long), (2, "http://b/", long), (3, None, long), (4, "http://c/\r\nX: y", "short"), (5, "u", "short"), (6, "u", None), (None, "n", other), (7, "u", other), (7, "u", other), (8, "u", "z" * 999), (9, "u", "z" * 999)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, value string")
    path = str(tmp_path / "w")
    warc.write_archives(df, path, file_bytes=4000)
    got = sorted(((r.key, r.record_type, r.refers_to_key, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, path).collect()), key=repr)
    of = lambda t: (len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest())
    want = [(k, "revisit" if k in (1, 2, None) else "response", {1: 3, 2: 3, None: 7}.get(k), *of(t)) for k, _, t in rows]
    assert got == sorted(want, key=repr)
    files = list(Path(path).glob("*.gz"))
    assert len(files) > 1 and all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n") for f in files)
    revisit = next(r for r in warc.read_archives(spark, path).collect() if r.key == 1)
    assert revisit.payload is None and revisit.refers_to_id.startswith("<urn:uuid:")


def test_repeated_rows_keep_their_urls_and_large_payloads_come_back(spark, tmp_path):
    rows = [(7, "http://a/", "h" * 2000), (7, "http://b/", "h" * 2000), (8, "http://" + "c" * 100_000, "é" * 3_000_000)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path, file_bytes=1 << 20)
    got = sorted((r.key, r.url, bytes(r.payload).decode()) for r in warc.read_archives(spark, path).collect())
    assert got == rows


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0
