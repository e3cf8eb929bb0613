"""op1 against all substrings of all texts."""

import pytest

from tests.llm.helpers import DOCS, clashing, odd_docs, prose, removed_bytes, table_at
from tidelog.llm import op01_suffixes as op

SF = "/root/testdata/sf0.001"


def check(got, docs):
    want = sorted(((i, *r) for (i, *_), r in zip(docs, removed_bytes([d[1] for d in docs], 400), strict=True)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    return want


def run(spark, d):
    return op.op1_suffixes(spark, d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert any(r[2] for r in check(run(spark, SF), docs))


def test_odd_rows(spark, tmp_path):
    docs = odd_docs()
    d = table_at(spark, tmp_path, documents=clashing(spark.createDataFrame(docs, DOCS)))
    assert any(r[2] for r in check(run(spark, d), docs))


@pytest.mark.parametrize(("hot", "look"), [(3, 1), (10, 2), (7, 64)])
def test_hot_passages(spark, tmp_path, monkeypatch, hot, look):
    """A passage in many documents with other neighbours each time: its grams' runs go to several buckets."""
    import random

    for k, v in (("HOT", hot), ("HOT_ROWS", 4), ("LOOK", look), ("MATCH_CHUNK", 5), ("CHUNK", 5)):
        monkeypatch.setattr(op, k, v)
    rng = random.Random(1)
    p, q = prose(rng, 150, 9999), prose(rng, 90, 9999)
    docs = [(i, " ".join([prose(rng, 3, 9999), *([p] if i % 3 else []), prose(rng, 5, 9999), q[i % 7 :], prose(rng, 4, 9999)])) for i in range(60)]
    d = table_at(spark, tmp_path, documents=spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    check(run(spark, d), docs)


def test_runs_of_one_byte_and_periods(spark, tmp_path):
    docs = [(0, "z" * 399), (1, "z" * 400), (2, "z" * 2000), (3, "abc" * 500), (4, "q" + "abc" * 133), (5, "y" * 400), (6, "k" * 401)]
    d = table_at(spark, tmp_path, documents=spark.createDataFrame(docs, "doc_id long, text string"))
    check(run(spark, d), docs)


def test_empty_table(spark, tmp_path):
    assert run(spark, table_at(spark, tmp_path, documents=spark.createDataFrame([], DOCS))) == []


def test_filter_keeps_columns(spark):
    docs = spark.createDataFrame(odd_docs(), DOCS)
    out = op.filter_repeats(clashing(docs))
    assert out.columns == clashing(docs).columns and out.count() == docs.count()
    want = {(d[0], d[1]): r for d, r in zip(odd_docs(), removed_bytes([d[1] for d in odd_docs()], 400), strict=True)}
    import hashlib

    rest = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in out.filter("doc_id BETWEEN 7 AND 25").collect())
    assert rest == sorted(want[k][3] for k in [(d[0], d[1]) for d in odd_docs() if d[0] is not None and 7 <= d[0] <= 25])
    was = {(d[0], d[1]) for d in odd_docs()}
    cut = [r for r in out.collect() if (r.doc_id, r.text) not in was]
    assert cut and all(r.n_chars == len(r.text) for r in cut)


def test_sums_that_collide_are_no_repeats(spark, tmp_path):
    """Blocks in Thue-Morse order and its complement, after 200 common bytes: polynomial sums modulo 2**64 are equal."""
    c = "flint thorn larch inlet larch jetty grove ember amber heath basin delta ridge notch plume larch thorn inlet heath orbit stone delta cedar basin jetty flint orbit basin marsh plume delta larch knoll am"
    odd = [bin(i).count("1") % 2 for i in range(64)]
    docs = [(1, c + "".join("1kjC" if t else "Dz0s" for t in odd)), (2, c + "".join("Dz0s" if t else "1kjC" for t in odd))]
    got = run(spark, table_at(spark, tmp_path, documents=spark.createDataFrame(docs, "doc_id long, text string")))
    assert [(r.n_bytes, r.n_removed) for r in got] == [(456, 0), (456, 0)]
    check(got, docs)


def test_long_texts_are_cut_into_segments(spark, tmp_path, monkeypatch):
    import random

    monkeypatch.setattr(op, "SEGMENT", 300)
    rng = random.Random(4)
    p = prose(rng, 300, 9999)
    docs = [(0, p + " a " + prose(rng, 50, 9999)), (1, prose(rng, 77, 9999) + " " + p[100:]), (2, "x" * 1500), (3, p[:399]), (4, "b" + p[7:450])]
    check(run(spark, table_at(spark, tmp_path, documents=spark.createDataFrame(docs, "doc_id long, text string"))), docs)


def test_passages_of_over_fifty_words(spark, tmp_path):
    import random

    rng = random.Random(9)
    short, few = " ".join(f"{a:04d}" for a in range(100, 155)), "w" * 90 + " " + "v" * 160
    assert len(short) < 400 and len(few) >= 200
    docs = [(0, prose(rng, 40, 9999) + " " + short + " " + prose(rng, 40, 9999)), (1, short), (2, prose(rng, 60, 9999)), (3, few + " " + prose(rng, 60, 9999)), (4, "z " + few), (5, None)]
    got = {r.doc_id: r for r in op.op1_suffixes(spark, table_at(spark, tmp_path, documents=spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    assert {i: r.n_passages for i, r in got.items()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0}
    assert not any(r.n_removed for r in got.values())


def test_bad_sizes(spark):
    with pytest.raises(ValueError):
        op.repeated(spark.createDataFrame([], DOCS), size=401)
