"""op4 against the tokenizers library and the definition of a packing."""

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tests.llm.helpers import DOCS, clashing, odd_docs, table_at
from tidelog.llm import op04_packing as op

SF = "/root/testdata/sf0.001"


def check(spark, d, docs):
    tok = Tokenizer.from_file(op.tokenizer_path())
    want = [(k, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for k, t in docs]
    rows = op.op4_packing(spark, d).collect()
    seqs = defaultdict(list)
    for r in rows:
        assert 0 < r.length <= 2048
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(len(w) for _, w in want)
    assert len(seqs) == -(-total // 2048)
    pieces = defaultdict(int)
    for r in rows:
        pieces[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    # the pieces' documents: each row's ids, cut at the pieces' starts, give the pieces' checksums
    left = dict(pieces)
    by = defaultdict(list)
    for k, s, n, c, t in pieces.elements() if hasattr(pieces, "elements") else [p for p, m in pieces.items() for _ in range(m)]:
        by[k, t].append((s, n, c))
    for k, ids in want:
        at = 0
        raw = np.array(ids, dtype="<u4")
        while at < len(ids):
            fit = [(s, n, c) for s, n, c in by[k, len(ids)] if s == at and zlib.crc32(raw[s : s + n].tobytes()) == c]
            assert fit, (k, at)
            by[k, len(ids)].remove(fit[0])
            at += fit[0][1]
        assert at == len(ids)
    assert not any(by.values()) and left


def test_whole_table(spark):
    check(spark, SF, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])


def test_odd_rows(spark, tmp_path):
    docs = odd_docs()
    check(spark, table_at(spark, tmp_path, documents=clashing(spark.createDataFrame(docs, DOCS).repartition(3))), [d[:2] for d in docs])


def test_with_ids_and_empty(spark):
    docs = spark.createDataFrame(odd_docs(), DOCS)
    for r in op.pack(docs, with_ids=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
    assert op.pack(docs.limit(0)).count() == 0
