import base64
import hashlib
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from tillflow.llm import warc

PAGES = [
    (5, "http://a.example/1", "<p>same</p>"), (2, "http://a.example/2", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://b.example/é ?x\r\nEvil: 1", "Ünï\r\n\r\ncode 😀"),
    (3, "", None), (4, "http://c.example/", ""), (7, "http://d.example/", "WARC/1.1\r\nContent-Length: 9\r\n\r\n" * 3), (8, "u", "x" * 200_000),
    (8, "u", "x" * 200_000), (None, "n", "only null"), (None, "n", "<p>same</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1, "k") for p in PAGES], "page_id long, url string, html string, sha256 int, kind string")


def plain(min_bytes=0):
    first, out = {}, []
    order = sorted(range(len(PAGES)), key=lambda i: (PAGES[i][0] is None, PAGES[i][0] or 0, i))
    for i in order:
        page_id, _, html = PAGES[i]
        data = (html or "").encode()
        revisit = len(data) >= min_bytes and data in first
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[data] if revisit else None))
        first.setdefault(data, page_id)
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 11, 10 ** 6])
def test_records_say_what_was_stored(spark, pages, tmp_path, min_bytes):
    warc.write(pages, str(tmp_path), min_bytes=min_bytes)
    warc.export(warc.records(spark, str(tmp_path), revisited=False), f"{tmp_path}/files", per_file=3)
    rows = warc.read_back(warc.read_files(spark, f"{tmp_path}/files")).select("record", "payload_bytes", "payload_digest", "kind", "refers_to").collect()
    assert sorted(map(tuple, rows), key=str) == plain(min_bytes)
    stored = [bytes(r.payload) for r in spark.read.parquet(f"{tmp_path}/payloads").collect()]
    assert len(stored) == len(set(stored)) == len({p[2] or "" for p in PAGES})


def test_files_round_trip(spark, pages, tmp_path):
    warc.write(pages, f"{tmp_path}/archive")
    rows = warc.records(spark, f"{tmp_path}/archive")
    warc.export(rows, f"{tmp_path}/files", per_file=2)
    back = warc.read_files(spark, f"{tmp_path}/files").collect()
    want = [(r.warc_header, r.http_header, bytes(r.payload) if r.kind == "response" else b"") for r in rows.collect()]
    assert sorted((r.warc_header, r.http_header, bytes(r.body)) for r in back) == sorted(want)
    assert all("\r\nEvil" not in r.warc_header for r in back)
    assert len({warc_id for r in back for warc_id in [r.warc_header.split("WARC-Record-ID: ")[1].split("\r\n")[0]]}) == len(PAGES)


def test_addresses_keep_what_is_printable(spark):
    urls = ["https://a.example/é?q=1&r=%20+x", "http://b.example/é ?x\r\nEvil: 1", "http://c.example/😀/中", "plain", "", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(warc.address(F.col("url"))).collect()]
    assert got == [u if u is None else quote(u, safe="".join(map(chr, range(0x21, 0x7F)))) for u in urls]


def test_a_changed_file_is_noticed(spark, pages, tmp_path):
    warc.write(pages, f"{tmp_path}/a")
    warc.export(warc.records(spark, f"{tmp_path}/a", revisited=False), f"{tmp_path}/files")
    files = warc.read_files(spark, f"{tmp_path}/files")
    changed = files.withColumn("body", F.when(F.octet_length("body") == 11, F.lit(b"<p>Same</p>")).otherwise(F.col("body")))
    with pytest.raises(Exception, match="does not fit its header"):
        warc.read_back(changed).collect()
    with pytest.raises(Exception, match="does not fit its header"):
        warc.read_back(files.filter("warc_header like '%revisit%'")).collect()


def test_a_changed_payload_is_noticed(spark, pages, tmp_path):
    warc.write(pages, f"{tmp_path}/a")
    spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("payload", F.lit(b"changed")).write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/headers").write.parquet(f"{tmp_path}/b/headers")
    with pytest.raises(Exception, match="does not fit its digest"):
        warc.records(spark, f"{tmp_path}/b").collect()


def test_empty(spark, pages, tmp_path):
    warc.write(pages.limit(0), str(tmp_path))
    warc.export(warc.records(spark, str(tmp_path), revisited=False), f"{tmp_path}/files")
    assert warc.read_back(warc.read_files(spark, f"{tmp_path}/files")).count() == 0
