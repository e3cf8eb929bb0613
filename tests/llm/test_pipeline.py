"""The stages in order, each against its own definition by plain Python on its own input."""

import re
from collections import Counter, defaultdict

from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.helpers import DOCS, clashing, components, odd_docs, table_at
from tests.llm.test_quality import base
from tests.llm.test_simhash import shingles
from tidelog.llm.common import stored, table
from tidelog.llm.op04_packing import tokenizer_path

SF = "/root/testdata/sf0.001"


def without_passages(texts):
    """Runs of over 50 words of bytes that are covered by strings of REPEAT_BYTES that start elsewhere, too, are cut."""
    size, data = cp.REPEAT_BYTES, [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        for m in re.finditer(b"\1+", bytes(gone)):
            if len(d[m.start() : m.end()].split()) <= 50:
                gone[m.start() : m.end()] = bytes(m.end() - m.start())
        out.append(bytes(c for c, g in zip(d, gone, strict=True) if not g).decode(errors="ignore"))
    return out


def test_stages(spark):
    assert [k for k, _ in cp.STAGES] == ["quality rules", "toxicity", "SimHash near-dedup", "suffix-array dedup", "packing"]
    docs = table(spark, SF, "documents")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for _, f in cp.STAGES[:4]:
        out = stored(f(spark, docs, SF), "test")
        assert out.columns == docs.columns
        docs = out
        seen.append({r.doc_id: r.text for r in docs.collect()})
    first, good, clean, single, cut = seen
    assert set(first) >= set(good) >= set(clean) >= set(single) == set(cut)
    assert not any(base(t)[5] for t in good.values()) and any(base(t)[5] for t in first.values())
    assert all(first[k] == single[k] for k in single)
    # near-duplicates: one of each component of pairs at 0.8 stays, the one with the least id
    ids = sorted(clean)
    sets = [shingles(clean[k]) for k in ids]
    root = components(len(ids), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert sorted(single) == sorted({ids[r] for r in root})
    # repeats
    ids = sorted(single)
    want = dict(zip(ids, without_passages([single[k] for k in ids]), strict=True))
    assert cut == want and want != single
    # packing: every token of what is left, once
    tok, n = Tokenizer.from_file(tokenizer_path()), defaultdict(int)
    for r in cp.STAGES[4][1](spark, docs, SF).collect():
        n[r.doc_id] += r.length
    assert n == {k: len(tok.encode(t, add_special_tokens=False).ids) + 1 for k, t in cut.items()}


def test_clean_documents_stay(spark):
    """On the table with some 400 labels; with the 87 of the smallest one, 3 of 64 clean documents go."""
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in table(spark, d, "labels").collect()}
    stay = {r.doc_id for r in cp.STAGES[1][1](spark, table(spark, d, "documents"), d).select("doc_id").collect()}
    clean, toxic = [k for k, y in labels.items() if not y], [k for k, y in labels.items() if y]
    assert sum(k in stay for k in clean) >= 0.97 * len(clean)
    assert sum(k in stay for k in toxic) <= 0.2 * len(toxic)


def test_run(spark):
    assert cp.run(spark, SF).count() > 0 and cp.ORACLE_SQL is None


def test_odd_rows_and_an_empty_table(spark, tmp_path):
    rows = [*odd_docs(), *((100 + i, t, "en", "web", 9) for i, t in enumerate([None, "", "word " * 30000]))]
    labels = spark.createDataFrame([(None, None, 1), (3, 1, None), *((i, 1, i % 2) for i in range(10, 25))], "doc_id long, quality int, toxic int")
    docs = clashing(spark.createDataFrame(rows, DOCS))
    d = table_at(spark, tmp_path / "a", documents=docs, labels=clashing(labels))
    for _, f in cp.STAGES[:4]:
        docs = stored(f(spark, docs, d), "test")
        assert docs.columns[:5] == DOCS.replace(" long", "").replace(" string", "").split(", ") and len(docs.columns) == 24
    left, packed = {r.doc_id for r in docs.collect()}, cp.run(spark, d).collect()
    assert {r.doc_id for r in packed} == left and left
    d = table_at(spark, tmp_path / "b", documents=spark.createDataFrame([], DOCS), labels=labels)
    assert cp.run(spark, d).count() == 0
