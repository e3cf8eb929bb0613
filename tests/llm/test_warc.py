"""op8: records written and read back, look-ups by the index, against plain Python."""

import base64
import hashlib
import random

import pytest

from tests.llm.helpers import clashing, table_at
from tidelog.llm import op08_warc as op

PAGES = "page_id long, url string, html string"


def rows(n=300):
    rng = random.Random(6)
    bodies = ["", "<p>same</p>", "é☃" * 50, *("<html>" + str(rng.random()) * rng.randrange(1, 80) for _ in range(40)), "x" * 300_000]
    out = [(i, rng.choice(["http://hot.example.com/", f"https://h{i % 9}.Example.org/p{i}?q={i % 3}#f", None, "no scheme", 'http://q.org/"\n é']), rng.choice([*bodies, None])) for i in range(n)]
    return [*out, (n - 1, out[-1][1], out[-1][2]), (None, "http://null.id/", "only here"), (None, None, "<p>same</p>")]


def brute(data):
    best = {}
    for k, _, h in data:
        if k is not None:
            best[h or ""] = max(best.get(h or "", k), k)
    out = []
    for k, _, h in data:
        raw, b = (h or "").encode(), best.get(h or "")
        first = b is None or k == b
        out.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else b))
    return sorted(map(str, out))


def test_round_trip(spark, tmp_path):
    data = rows()
    d = table_at(spark, tmp_path, pages=clashing(spark.createDataFrame(data, PAGES).repartition(3)))
    got = op.op8_warc(spark, d).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(data)


def test_empty(spark, tmp_path):
    assert op.op8_warc(spark, table_at(spark, tmp_path, pages=spark.createDataFrame([], PAGES))).count() == 0


def test_look_up_reads_by_range(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_LINES", 7)
    data = [(i, f"http://h{i % 50}.org/{i % 5}", f"body {i}") for i in range(200)]
    a = op.write(spark.createDataFrame(data, PAGES))
    for u in ("http://h3.org/3", "http://H49.org/4", "http://missing.org/", "http://h0.org/0"):
        want = sorted((k, h) for k, x, h in data if x == u.lower())
        assert sorted((r["page_id"], r["payload"].decode()) for r in op.look_up(a, [u])) == want
    r = op.look_up(a, ["http://h3.org/3"])[0]
    assert r["kind"] == "response" and r["url"] == "http://h3.org/3"
    read = []
    monkeypatch.setattr(op, "_ranges", lambda fs, base, file, spans, was=op._ranges: read.append((file.split(".", 1)[1], len(spans))) or was(fs, base, file, spans))
    assert op.look_up(a, ["http://h3.org/3"]) and len(read) <= 2 + len([1 for i in range(200) if i % 50 == 3]) and ("cdx.gz", 1) in read


def test_least_bytes(spark):
    data = [(1, "u", "short"), (2, "u", "short"), (3, "u", "long enough" * 9), (4, "u", "long enough" * 9)]
    pages = spark.createDataFrame(data, PAGES)
    got = {r.page_id: (r.kind, r.refers_to) for r in op.records_of(op.write(pages, least=20), pages).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_a_hot_url_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_LINES", 5)
    pages = spark.createDataFrame([*((i, "http://hot.org/", str(i % 9)) for i in range(300)), (None, "http://hot.org/", "n"), (7, "http://HOT.org/", "7")], PAGES).repartition(4)
    a = op.write(pages)
    assert sorted(str(r.page_id) for r in op.records_of(a, pages).collect()) == sorted(str(r.page_id) for r in pages.collect())
    some = pages.filter("page_id % 50 = 0")
    assert sorted(r.page_id for r in op.records_of(a, some).collect()) == [0, 50, 100, 150, 200, 250]
    assert len(op.look_up(a, ["http://hot.org/"])) == 302


def test_target_uris_are_plain():
    import zlib

    raw = zlib.decompress(op.record(1, "http://a/b c\r\nX: y", b"", op.base32_sha1(b""), "response", None), 31)
    assert b"\r\nWARC-Target-URI: http://a/b c%0D%0AX: y\r\n" in raw


def test_broken_records_are_found():
    r = op.record(1, "http://a/", b"payload", op.base32_sha1(b"other"), "response", None)
    with pytest.raises(ValueError):
        op.parse(r)


def test_keys():
    assert op.host_key("http://www.Example.com/a?b#c") == "com,example,www)/a?b#c"
    assert op.host_key(None) == ")"
