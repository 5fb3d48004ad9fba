import base64
import gzip
import hashlib

import pytest

from quarry.llm import op3_warc, scratch

SCHEMA = "page_id long, url string, html string"


def through(spark, rows, schema=SCHEMA, files=3):
    arc, warc = scratch.place(spark, "arc"), scratch.place(spark, "warc")
    op3_warc.write_arc(spark.createDataFrame(rows, schema).repartition(files), arc)
    op3_warc.convert(spark, arc, warc)
    return op3_warc.read_warc(spark, warc).collect()


def expected(rows):
    first, out = {}, {}
    for page, _, html in rows:
        body = (html or "").encode()
        first[body] = min(first.get(body, page), page)
    for page, _, html in rows:
        body = (html or "").encode()
        again = first[body] != page
        out[page] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[body] if again else None)
    return out


def got(records):
    return {r.key: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_key) for r in records}


def test_cases(spark):
    rows = [(3, "http://a b", "x\r\n\r\ny\n"), (1, None, None), (2, "", ""), (9, "u", "é€😀\nHTTP/1.1 200\r\n\r\n"), (-4, "u", "z"), (2**62, "u", "z"), (8, "u", "z"), (11, "u", "\n\n"), (12, "u", "WARC/1.0\r\n" * 5)]
    assert got(through(spark, rows)) == expected(rows)


def test_nulls_repeats_and_other_columns(spark):
    records = through(spark, [(None, "a", "q"), (None, "b", "q"), (5, "c", "r"), (5, "c", "r"), (None, "d", "r")], files=1)
    kinds = sorted((r.key is None, r.record_type, r.refers_to_key or 0) for r in records)
    assert kinds == [(False, "response", 0), (False, "revisit", 5), (True, "response", 0), (True, "revisit", 0), (True, "revisit", 5)]
    assert through(spark, [(1, "u", "h", 7)], SCHEMA + ", key int")[0].key == 1
    assert through(spark, []) == []


def test_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    records = op3_warc.query(spark, "/root/testdata/sf0.001").collect()
    assert {r.page_id: tuple(r)[1:] for r in records} == expected(rows)


@pytest.mark.parametrize("version", [1, 2])
def test_versions_and_members(version):
    fields = op3_warc.ARC1 if version == 1 else op3_warc.ARC2
    rest = f"{version} 0 x\n{fields}\n".encode()
    middle = b"" if version == 1 else b"200 - - 0 f "
    opening = b"filedesc://f 0.0.0.0 19990101000000 text/plain " + middle + str(len(rest)).encode() + b"\n" + rest + b"\n"
    record = b"http://x 1.2.3.4 19990203040506 text/html " + middle + b"7\nab\n\ncd\n\n"
    for content in (opening + record * 2, gzip.compress(opening) + gzip.compress(record) * 2):
        found = list(op3_warc.arc_records(content))
        assert [(f[0], f[-1], b) for _, f, b in found] == [("http://x", "7", b"ab\n\ncd\n")] * 2
    assert op3_warc.iso("19990203040506") == "1999-02-03T04:05:06Z" and op3_warc.iso("1999") == "1999-01-01T00:00:00Z"


OPENING = b"filedesc://f 0.0.0.0 19990101000000 text/plain 4\n1 0\n\n"


def test_malformed_archives():
    good = b"http://x 1.2.3.4 19990203040506 text/html 2\nab\n"
    records = lambda content: [(f[0], b) for _, f, b in op3_warc.arc_records(content)]
    assert records(OPENING + b"http://x/a b 1.2.3.4 19990203040506 text/html 2\nab\n" + good) == [("http://x/a b", b"ab"), ("http://x", b"ab")]
    assert records(OPENING + b"not a record line\nhttp://y 1.2.3.4 19990203040506 text/html two\n" + good) == [("http://x", b"ab")]
    assert records(OPENING + good + b"http://z 1.2.3.4 19990203040506 text/html 99\nshort") == [("http://x", b"ab")]
    assert records(b"filedesc://f 0 0 t 36\n9 0\nURL IP Date Type Length Unknown\n\nu: i d t l 2\nab") == [("u:", b"ab")]
    assert records(b"") == [] and records(b"\n\n") == []


def test_types_addresses_and_digests(spark, tmp_path):
    dns, page = b"20060301 example 127.0.0.1\n", b"HTTP/1.0 200 OK\r\n\r\nhi"
    rows = [(b"dns:example.org", b"text/dns", dns), (b"http://e.org/", b"text/html", page), (b"http://e.org/b", b"text/html", page)]
    content = OPENING + b"".join(u + b" 5.6.7.8 20060301000000 " + m + b" " + str(len(b)).encode() + b"\n" + b + b"\n" for u, m, b in rows)
    arc, warc = tmp_path / "arc", tmp_path / "warc"
    arc.mkdir()
    (arc / "part-0.arc").write_bytes(content)
    op3_warc.convert(spark, str(arc), str(warc))
    found = [x for f in warc.glob("part-*") for x in op3_warc.warc_records(f.read_bytes())]
    assert [h["warc-type"] for h, _ in found].count("warcinfo") == len([f for f in warc.glob("part-*") if op3_warc.Stream(f.read_bytes()).line()])
    by = {h.get("warc-target-uri"): (h, b) for h, b in found}
    assert by["dns:example.org"][0]["warc-type"] == "resource" and by["dns:example.org"][0]["content-type"] == "text/dns" and by["dns:example.org"][1] == dns
    assert {by[u][0]["warc-type"] for u in ("http://e.org/", "http://e.org/b")} == {"response", "revisit"}
    assert by["http://e.org/"][0]["warc-ip-address"] == "5.6.7.8" and by["http://e.org/"][0]["content-type"] == op3_warc.HTTP
    assert all(h["warc-block-digest"] == op3_warc.sha1(b) for h, b in found)


@pytest.mark.parametrize("key", [0, 1, -1, 2**63 - 1, -(2**63), 123456789012])
def test_identifiers(key):
    assert op3_warc.key_of(op3_warc.record_id(key, "f", 0)) == key
    assert op3_warc.key_of(op3_warc.record_id(None, "f", key)) is None
