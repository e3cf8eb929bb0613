"""op3 against a plain loop over the sorted table."""

import hashlib

from tests.llm.helpers import DOCS, clashing, odd_docs, table_at
from tidelog.llm import op03_chunks as op

SF = "/root/testdata/sf0.001"


def gear_cuts(data):
    """Byte by byte: the hash of the last 64 bytes is a sum of shifted values."""
    g = [int.from_bytes(hashlib.sha256(b"gear%d" % i).digest()[:8], "little") for i in range(256)]
    out, s, n = [], 0, len(data)
    while n - s > op.LEAST:
        e = n
        for e in range(s + op.LEAST, min(n, s + op.MOST) + 1):
            h = sum(g[data[e - 1 - j]] << j for j in range(min(64, e))) & (2**64 - 1)
            if h & int(op.STRICT if e - s <= op.NORMAL and e < s + op.NORMAL else op.LOOSE) == 0:
                break
        out.append(e)
        s = e
    return out + [n] * (s < n)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (k, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = (op.chunk_set(x.encode()) for x in (t, e, nxt))
        like = lambda x, y: 1.0 if not x and not y else 0.0 if not x or not y else sum(x[d] for d in x.keys() & y.keys()) / min(sum(x.values()), sum(y.values()))
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(a, b), 12), round(like(a, c), 12)))
    return sorted(map(str, out))


def got(spark, d):
    rows = op.op3_chunks(spark, d).collect()
    assert len({r.fingerprint for r in rows}) <= len(rows)
    return sorted(str((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12))) for r in rows)


def test_whole_table(spark):
    assert got(spark, SF) == brute([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_odd_rows(spark, tmp_path):
    docs = odd_docs()
    d = table_at(spark, tmp_path, documents=clashing(spark.createDataFrame(docs, DOCS).repartition(5)))
    assert got(spark, d) == brute(docs)


def test_one_row_and_none(spark, tmp_path):
    one = [(7, "abc def", "en", "web", 7)]
    assert got(spark, table_at(spark, tmp_path / "a", documents=spark.createDataFrame(one, DOCS))) == brute(one)
    assert got(spark, table_at(spark, tmp_path / "b", documents=spark.createDataFrame([], DOCS))) == []


def test_cuts():
    import random

    rng = random.Random(2)
    text = " ".join(str(rng.random()) for _ in range(200)).encode()
    assert op.cuts(text) == gear_cuts(text)
    assert op.cuts(b"") == [] and op.cuts(b"abc") == [3] and op.cuts(b"z" * 1000)[-1] == 1000
    # an insertion moves the cuts near it only
    a, b = op.chunk_set(text), op.chunk_set(text[:900] + b"INSERTED" + text[900:])
    assert op.containment(a, b) > 0.85
    assert op.parsed(op.shown(a)) == a
    assert op.containment(a, op.chunk_set(text[: len(text) // 2])) > 0.9  # containment: a part is like the whole
