"""op9, and both tokenizers, against the tokenizers library; the transducer against plain merging."""

import hashlib
import random

import pyarrow as pa
from tokenizers import Tokenizer

from tests.llm.helpers import DOCS, clashing, odd_docs, table_at
from tidelog.llm import bpe
from tidelog.llm import op09_bpe as op
from tidelog.llm.op04_packing import tokenizer_path as byte_path

SF = "/root/testdata/sf0.001"


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def brute(docs):
    t = library(op.tokenizer_path())
    out = []
    for k, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(map(str, out))


def got(spark, d):
    return sorted(str(tuple(r)) for r in op.op9_bpe(spark, d).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())


def test_whole_table(spark):
    assert got(spark, SF) == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])


def test_odd_rows(spark, tmp_path):
    docs = odd_docs()
    assert got(spark, table_at(spark, tmp_path, documents=clashing(spark.createDataFrame(docs, DOCS)))) == brute([d[:2] for d in docs])
    assert got(spark, table_at(spark, tmp_path / "none", documents=spark.createDataFrame([], DOCS))) == []


SIGNS = ["a", "e", "th", "ing", "Z", "É", "é", "e\u0301", "ß", "ΑΣ", "Σ", "İ", "1", "23", "٣", " ", "  ", "\n", "\t", "\r", "\u00a0", "\u2028", "\u3000", "\x1c", "\x85", ".", ",", "'s", "'S", "'re", "!!", "--", "☃", "🎉", "👩\u200d💻", "日本", "ا", "\u200b", "\x00", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "ﬁ", "ǅ", "\u0345", "²", "Ⅷ", "\ufeff", "_"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def test_word_tokenizer_on_random_signs():
    own, lib = bpe.WordTokenizer(op.tokenizer_path()), library(op.tokenizer_path())
    texts = random_texts(6000, 1)
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(t) == e.ids, repr(t)
        assert own.decode(e.ids) == lib.decode(e.ids, skip_special_tokens=False), repr(t)
    n, ids, decoded = own.summaries(pa.array(texts))
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want]
    assert ids.to_pylist() == [" ".join(map(str, x)) for x in want]
    assert decoded.to_pylist() == [lib.decode(x, skip_special_tokens=False) for x in want]


def test_byte_tokenizer_on_random_signs():
    import numpy as np

    own, lib = bpe.ByteTokenizer(byte_path()), library(byte_path())
    texts = random_texts(6000, 2)
    for t, b, e in zip(texts, own.encode_batch(pa.array(texts)), lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(b, dtype=own.kind).tolist() == e.ids, repr(t)


def test_transducer_equals_merging_and_has_bounded_memory():
    own = bpe.WordTokenizer(op.tokenizer_path())
    rng = random.Random(4)
    for n in (1, 2, 49, 200, 3000):
        for letters in ("a", "ab", "the ", "abcdefghijklmnopqrstuvwxyz"):
            w = "".join(rng.choice(letters.strip()) for _ in range(n)).encode()
            t = bpe.Transducer(own.merges)
            assert list(t.encode(own.merges.symbols(w))) == own.merges.merged(own.merges.symbols(w))
            assert t.most_kept <= 4 * t.lookahead


def test_decoder_is_incremental():
    lib = library(byte_path())
    own = bpe.ByteTokenizer(byte_path())
    for t in ["naïve ☃ 🎉 日本", "plain"]:
        ids = lib.encode(t, add_special_tokens=False).ids
        d = bpe.Decoder(own.merges)
        assert "".join([*(d.feed([i]) for i in ids), d.end()]) == t
    d = bpe.Decoder(own.merges)  # a broken end
    assert d.feed(lib.encode("🎉", add_special_tokens=False).ids[:1]) + d.end() == "\ufffd"


def test_every_word_goes_through_the_transducer_and_the_decoder(monkeypatch):
    own, fed = bpe.WordTokenizer(op.tokenizer_path()), []
    feed = bpe.Decoder.feed
    monkeypatch.setattr(bpe.Decoder, "feed", lambda self, ids: fed.append(list(ids)) or feed(self, fed[-1]))
    n, ids, decoded = own.summaries(pa.array(["alpha beta gamma beta", "beta unlikelyword" + "q" * 300, ""]))
    assert own.merges._transducer.words == 4 and len(fed) >= 4
    assert [len(x.split()) for x in ids.to_pylist()] == n.tolist()


def test_pairs_that_stay_apart():
    """The rule of the boundary against merging both tokens' symbols."""
    own, rng = bpe.WordTokenizer(op.tokenizer_path()), random.Random(3)
    own.merges.word(b"a")
    t = own.merges._transducer
    ids = [i for i in sorted(t.parts)[:3000] if t.whole(i) and not t.m.text[i].endswith("</w>")]
    for _ in range(4000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert t._stay_apart(a, b) == (t.m.merged([*t.parts[a], *t.parts[b]]) == [a, b])
