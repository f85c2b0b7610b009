import hashlib
import io
import zipfile

import duckdb
import pytest

from tidemark.llm import warc_zip as wz

SF = "/root/testdata/sf0.01"


def test_archives_are_zip_and_come_back(spark, tmp_path):
    big, rows = "ü" * 700, [(1, "http://a/", "x"), (2, None, None), (3, "u\r\nv", ""), (4, "u", "ü" * 700), (9, "u", "ü" * 700), (5, "u", "ü" * 700), (None, "n", "ü" * 700), (7, "t", "y" * 999), (8, "t", "y" * 999), (9, "u", "ü" * 700), (11, "l", "z " * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS key", "3 AS target")
    manifest = wz.write_archives(pages.repartition(2), folder=f"file://{tmp_path}/w", archive_bytes=2000)
    uris = [r.uri for r in manifest.collect()]
    assert len(uris) > 1
    with zipfile.ZipFile(uris[0].removeprefix("file://")) as z:
        assert set(z.namelist()) == {wz.DATA, wz.INDEX} and z.testzip() is None
    got = sorted(((r.key, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in wz.read_records(manifest, span=300).collect()), key=str)
    want = []
    for k, _, h in rows:
        raw = (h or "").encode()
        revisit = h == big and k != 9
        want.append((k, "revisit" if revisit else "response", 9 if revisit else None, len(raw), hashlib.sha1(raw).hexdigest(), None if revisit else raw))
    assert got == sorted(want, key=str)
    assert wz.read_records(wz.write_archives(pages.limit(0))).count() == 0


def test_zip64_directory():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(70_000):  # more members than the plain end record can count
            z.writestr(f"m{i}", str(i))
    raw = out.getvalue()
    found = wz.members(lambda at, n: raw[at : at + n], len(raw))
    assert len(found) == 70_000
    at, n = found["m69999"]
    assert raw[at : at + n] == b"69999"


def test_tables(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(map(tuple, wz.query(spark, SF).collect())) == sorted(c.sql(wz.ORACLE).fetchall())


def test_keys_of_any_text(spark):
    big = "x" * 1200
    rows = [("", big), (None, "n"), ("a\r\nWARC-Type: revisit", "y"), ("é: \"quoted\"", big), ("null", "z"), (" ", "s"), ("7", "t")]
    pages = spark.createDataFrame([(k, "u", h) for k, h in rows], "page_id string, url string, html string")
    got = {r.key: (r.record_type, r.refers_to, r.payload_bytes) for r in wz.read_records(wz.write_archives(pages), "string").collect()}
    want = {k: ("response", None, len(h)) for k, h in rows}
    assert got == {**want, "": ("revisit", "é: \"quoted\"", 1200)}
    with pytest.raises(ValueError, match="double"):
        wz.read_records(wz.write_archives(pages), "double")
