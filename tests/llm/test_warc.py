import gzip
import hashlib

from pyspark.sql import functions as F

from docspark.llm import warc


def pages():
    big = "x" * 999 + "é"
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (7, None, big), (3, "u\r\nv", "s" * 999), (4, "u", "s" * 999)]
    rows += [(5, "u", None), (6, "u", ""), (8, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 50), (9, "u", "é" * 500), (10, "u", "é" * 500)]
    return [*rows, (None, "u", big), (11, "u", "y" * 3_000_000)]


def want(rows):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if g == h and j is not None and len(b) >= 1000]
        to = max(same) if same and i != max(same) else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == want(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_filters_are_pushed_and_payloads_come_back(spark, tmp_path):
    rows = pages()
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/a")
    r = warc.read_archives(spark, f"file://{tmp_path}/a", "bytes")
    got = r.where("record_type = 'revisit'").collect()
    assert sorted(x.record_id for x in got) == ["urn:page:", "urn:page:1", "urn:page:2", "urn:page:9"]
    one = r.where(F.col("target_uri").startswith("http://a/") & (F.col("record_type") == "revisit"))
    assert one.count() == 2
    back = {x.record_id: bytes(x.payload) for x in r.where("record_type = 'response'").collect()}
    assert back["urn:page:11"] == b"y" * 3_000_000 and back["urn:page:5"] == b"" and back["urn:page:7"].decode() == rows[0][2]


def test_reads_gzip_and_skips_payloads(spark, tmp_path):
    rec = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(rec % i) for i in range(3)))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [x.record_id for x in got] == ["urn:page:0", "urn:page:1", "urn:page:2"] and got[0].payload is None


def test_reader_takes_header_filters_only():
    from pyspark.sql import datasource as D

    r = warc.WarcReader({"path": "/x"})
    left = list(r.pushFilters([D.EqualTo(("record_type",), "revisit"), D.EqualTo(("payload_sha1",), "x"), D.In(("payload_length",), (1, 2))]))
    assert [f.attribute for f in left] == [("payload_sha1",)] and len(r.filters) == 2
