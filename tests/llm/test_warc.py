import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tangentia.llm import warc

BIG = "<p>" + "words and words " * 100


def _pages(spark):
    rows = [
        (1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, "http://a/9", BIG), (3, "http://a/3", "short"), (4, "http://a/4", "short"),
        (5, None, None), (6, "", ""), (7, "http://a/\r\nX: y", "é" * 600), (8, "http://a/8", "é" * 600), (None, "http://a/n", BIG), (10, "http://a/10", "x" * 3_000_000),
        (8, "http://a/8", "é" * 600), (11, "http://a/11", "WARC/1.1\r\n\r\n" * 90),
    ]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))


def test_round_trip(spark):
    rows, pages = _pages(spark)
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=repr)
    best: dict = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            best[data] = max(i, best.get(data, i))
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        kept = best.get(data)
        again = i is not None and kept is not None and i < kept
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", kept if again else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(pages.where("page_id < 0")).count() == 0


@pytest.mark.parametrize("packed", ["true", "false"])
def test_reader_prunes_and_filters(spark, tmp_path, packed):
    rows, pages = _pages(spark)
    warc.archive_pages(pages.repartition(3), str(tmp_path), gzip=packed, rotate_bytes="300")
    files = sorted(p for p in tmp_path.iterdir() if "warc" in p.name)
    assert len(files) > 3
    back = warc.read_archives(spark, str(tmp_path))
    assert back.count() == len(rows)
    assert {r["page_id"] for r in back.where("record_type = 'revisit'").collect()} == {1, 2, 7}
    assert back.where("page_id in (3, 4) and refers_to is null").count() == 2
    small = spark.read.format("warc").schema("page_id long, payload_bytes long").option("path", str(tmp_path)).load()
    assert small.agg(F.max("payload_bytes")).first()[0] == 3_000_000
    data = b"".join(gzip.decompress(p.read_bytes()) if packed == "true" else p.read_bytes() for p in files)
    assert data.count(b"WARC-Type: response") == len(rows) - 3
    assert b"\r\nX: y" not in data
    one = spark.read.format("warc").option("path", str(files[0])).load()
    assert 0 < one.count() < len(rows)


def test_pushed_predicates_skip_blocks():
    reader = warc.WarcReader({"path": "/x"}, ["page_id"])

    class Other:
        pass

    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull

    rest = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("page_id",), (1, 2)), IsNull(("refers_to",)), GreaterThan(("page_id",), 1)]))
    assert [type(f).__name__ for f in rest] == ["GreaterThan"]
    assert reader.passes({"record_type": "response", "page_id": 2, "refers_to": None})
    assert not reader.passes({"record_type": "revisit", "page_id": 2, "refers_to": None})


def test_broken_archives_are_errors():
    import io

    good = warc.record_bytes({"WARC-Type": "response"}, b"abc")
    assert [(h["warc-type"], b()) for h, b in warc.records(io.BytesIO(good * 2))] == [("response", b"abc")] * 2
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"junk\r\n")))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(good[:-6])))
    for cut in (1, 3, 6, 20, len(good) - 5):
        for packed in (False, True):
            data = gzip.compress(good)[:-cut] if packed and cut > 8 else good[: len(good) - cut - 4]
            stream = warc._members(io.BytesIO(data)) if packed and cut > 8 else io.BytesIO(data)
            with pytest.raises((ValueError, EOFError)):
                for _, block in warc.records(stream):
                    block()


def test_second_write_and_overwrite(spark, tmp_path):
    _, pages = _pages(spark)
    path = str(tmp_path / "a")
    warc.archive_pages(pages.where("page_id in (3, 4)"), path)
    warc.archive_pages(pages.where("page_id = 10"), path)
    assert sorted(r["page_id"] for r in warc.read_archives(spark, path).select("page_id").collect()) == [3, 4, 10]
    (tmp_path / "a" / "part-0.warc").write_bytes(b"left by a job that died")
    assert warc.read_archives(spark, path).count() == 3
    row = spark.createDataFrame([(7, "u", "response", None, "00" * 20, b"z")], "page_id long, url string, record_type string, refers_to long, digest string, payload binary")
    row.write.format("warc").mode("overwrite").option("path", path).save()
    assert [r["page_id"] for r in warc.read_archives(spark, path).collect()] == [7]
    assert len([p for p in (tmp_path / "a").iterdir() if "warc" in p.name and not p.name.startswith(".")]) == 1


def test_revisits_name_their_response(spark, tmp_path):
    _, pages = _pages(spark)
    warc.archive_pages(pages, str(tmp_path), gzip="false")
    named, ids = [], set()
    for p in tmp_path.iterdir():
        if p.suffix == ".warc":
            with p.open("rb") as f:
                for h, _ in warc.records(f):
                    if h["warc-type"] == "revisit":
                        named.append((h["warc-refers-to"], h["refers-to-page-id"]))
                    else:
                        ids.add((h["warc-record-id"], h.get("page-id")))
    assert len(named) == 3 and set(named) <= ids


def test_archives_of_others(spark, tmp_path):
    """Digests in hex or of other kinds, headers that aren't UTF-8, and records other than responses."""
    sha = hashlib.sha1(b"abc").hexdigest()
    parts = [
        warc.record_bytes({"WARC-Type": "resource", "WARC-Payload-Digest": f"SHA1:{sha.upper()}"}, b"abc"),
        warc.record_bytes({"WARC-Type": "conversion", "WARC-Payload-Digest": "md5:zzz", "Page-ID": "x"}, b"def"),
        b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\xe9\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n",
        warc.record_bytes({"WARC-Type": "metadata", "WARC-Payload-Digest": "sha1:???"}, b""),
    ]
    (tmp_path / "x.warc").write_bytes(b"".join(parts))
    got = {r["record_type"]: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got["resource"]["payload_digest"] == sha and bytes(got["resource"]["payload"]) == b"abc"
    assert got["conversion"]["payload_digest"] is None and got["conversion"]["page_id"] is None
    assert bytes(got["conversion"]["payload"]) == b"def" and bytes(got["response"]["payload"]) == b"hi"
    assert got["response"]["target_uri"].startswith("http://a/") and got["metadata"]["payload_digest"] is None


def test_bodies_of_http_messages(spark, tmp_path):
    """The head is split off, chunks are joined, and what is no message stays; lengths are known where a header tells them."""
    http = {"WARC-Type": "response", "Content-Type": "application/http; msgtype=response"}
    plain = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>a\r\n\r\nb</p>"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip, Chunked\r\n\r\n3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n"
    broken = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nnot chunks"
    request = b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"
    blocks = {"a": plain, "b": chunked, "c": broken, "d": request, "e": b"no head", "f": b""}
    parts = [warc.record_bytes(http | {"WARC-Target-URI": k}, v) for k, v in blocks.items()]
    parts.append(warc.record_bytes({"WARC-Type": "response", "WARC-Target-URI": "g", "Content-Type": "text/html"}, plain))
    (tmp_path / "x.warc").write_bytes(b"".join(parts))
    got = {r["target_uri"]: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    want = {"a": b"<p>a\r\n\r\nb</p>", "b": b"abcde", "c": b"not chunks", "d": b"", "e": b"no head", "f": b"", "g": plain}
    assert {k: bytes(r["payload"]) for k, r in got.items()} == want
    assert {k: r["payload_bytes"] for k, r in got.items()} == dict.fromkeys("abcdef") | {"g": len(plain)}
    assert [r["target_uri"] for r in warc.read_archives(spark, str(tmp_path)).where(f"payload_bytes = {len(plain)}").collect()] == ["g"]


def test_a_payload_of_most_pages(spark, monkeypatch):
    """Nothing is broadcast unasked, and the copies' digest is a frequent one: the same result, with their rows dealt by id."""
    monkeypatch.setattr(warc, "COPIES", 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = "x" * 2000
        pages = spark.createDataFrame([(k, "u", text if k % 3 else text + str(k % 4)) for k in range(60)], "page_id long, url string, html string")
        got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    last = {}
    for k in range(60):
        last[text if k % 3 else text + str(k % 4)] = k
    for k in range(60):
        kept = last[text if k % 3 else text + str(k % 4)]
        assert got[k] == (("response", None) if kept == k else ("revisit", kept))
