import base64
import hashlib
import re

import pytest
from pyspark.sql import functions as F
from spanwright.llm import warc

RECORD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:spanwright:999:X>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
SCHEMA = "page_id long, url string, html string"


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def wanted(rows, least=0):
    first = {}
    for page, _, html in rows:
        if page is not None:
            key = (html or "").encode()
            first[key] = min(first.get(key, page), page)
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        to = first.get(payload)
        revisits = len(payload) >= least and to is not None and to != page
        out.append((page, len(payload), sha(payload), "revisit" if revisits else "response", to if revisits else None))
    return sorted(out, key=repr)


def found(spark, path):
    page = lambda c: F.regexp_extract(c, "^<urn:spanwright:(-?[0-9]*):", 1).try_cast("long")
    rows = warc.read_archives(spark, path)
    return sorted(map(tuple, rows.select(page(F.col("record_id")), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to"))).collect()), key=repr)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


ODD = [
    (1, "http://a/", RECORD * 3),
    (2, "http://x/WARC/1.1/WARC/1.0", "plain"),
    (3, None, None),
    (4, "u\r\nWARC/1.1\r\nContent-Length: 3", "WARC/1.1\r\n" * 50),
    (5, "b", RECORD * 3),
    (None, "n", ""),
    (None, "n", "only null"),
    (6, "b", "x" * 9000 + RECORD),
    (7, "c", "WARC/1."),
    (7, "c", "WARC/1."),
    (8, "d", "WARC/1."),
    (9, "é ü", "ñ漢字WARC/1.漢\r\n\r\n"),
    (10, "z", "\r\n\r\n"),
    (-5, "y", "plain"),
    (11, "k", "\r\nContent-Length: 1\r\n\r\nWARC/1.0\r\n\r\n\r\n"),
    *((100 + k, f"http://p/{k}", f"some text {k} " * (k % 37) + (RECORD if k % 3 == 0 else "")) for k in range(80)),
]


def test_records_inside_payloads_are_rejected(spark, small_splits, tmp_path):
    df = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "'clash' AS value", "1 AS key", "2 AS digest", "3 AS file", "4 AS offset").repartition(2)
    path = f"{tmp_path}/archives"
    warc.write_archives(df, path)
    assert found(spark, path) == wanted(ODD)


def test_archives_are_warc_files(spark, tmp_path):
    """A plain sequential reader gets the records that were written, and the same ones as the job."""
    path = f"{tmp_path}/archives"
    warc.write_archives(spark.createDataFrame(ODD, SCHEMA), path, least=6, date="2021-02-03T04:05:06Z")
    out, uris = [], set()
    for file in tmp_path.glob("archives/part-*"):
        data, at = file.read_bytes(), 0
        while at < len(data):
            head = re.match(rb"WARC/1\.1\r\n((?:[^\r\n]+\r\n)+)\r\n", data[at:])
            fields = dict(line.split(": ", 1) for line in head[1].decode().splitlines())
            start, end = at + head.end(), at + head.end() + int(fields["Content-Length"])
            assert data[end : end + 4] == b"\r\n\r\n" and fields["WARC-Date"] == "2021-02-03T04:05:06Z"
            http, payload = data[start:end].split(b"\r\n\r\n", 1)
            page = lambda x: int(i) if (i := x.split(":")[2]) else None
            revisits = fields["WARC-Type"] == "revisit"
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            assert payload == b"" if revisits else "sha1:" + sha(payload) == fields["WARC-Payload-Digest"]
            out.append((page(fields["WARC-Record-ID"]), size, fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], page(fields["WARC-Refers-To"]) if revisits else None))
            uris.add(fields.get("WARC-Target-URI"))
            at = end + 4
    assert sorted(out, key=repr) == wanted(ODD, least=6) == found(spark, path)
    assert "u%0D%0AWARC/1.1%0D%0AContent-Length:%203" in uris and None in uris


def test_other_archives(spark, small_splits, tmp_path):
    """Versions and payloads of other kinds, a header over two splits, a damaged boundary, and a revisit of what is elsewhere."""
    folder = tmp_path / "given"
    folder.mkdir()
    plain = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:a>\r\ncontent-length:  4 \r\nX-Long: " + b"y" * 5000 + b"\r\n\r\nbody\r\n\r\n"
    away = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:b>\r\nWARC-Refers-To: <urn:gone>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (folder / "one.warc").write_bytes(plain + away)
    (folder / "two.warc").write_bytes(away + b"junk" + plain)
    (folder / "none.warc").write_bytes(b"")
    rows = warc.read_archives(spark, str(folder)).collect()
    assert sorted((r.file[-8:], r.record_id, r.record_type, r.payload_bytes, r.payload_digest) for r in rows) == [
        ("one.warc", "<urn:a>", "resource", 4, sha(b"body")),
        ("one.warc", "<urn:b>", "revisit", None, None),
        ("two.warc", "<urn:b>", "revisit", None, None),
    ]


def test_chain_over_many_splits(spark):
    """Pointers jump over splits; candidates off the chain stay out, also where theirs runs beside it."""
    true = [(10 * k, 10 * k + 10) for k in range(500)]
    false = [(10 * k + 3, 10 * k + 13) for k in range(500)] + [(10 * k + 5, 10 * k + 20) for k in range(400)]
    rows = [(f, o // 70 * 70, o, n) for f in ("a", "b") for o, n in true + false]
    got = warc.reachable(spark.createDataFrame(rows, "file string, split long, offset long, follow long")).collect()
    assert sorted((r.file, r.offset) for r in got) == sorted((f, o) for f in ("a", "b") for o, _ in true)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op13(spark, str(tmp_path)).count() == 0
