"""op7 against all pairs; the near-duplicate stage against all pairs of shingle sets."""

import random

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import DOCS, clashing, components, odd_docs, prose, table_at, words
from tidelog.llm import op07_simhash as op

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    w = words(text)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs):
    fps = [fingerprint(t) for _, t in docs]
    root = components(len(docs), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    least = {}
    for (k, _), r in zip(docs, root, strict=True):
        least[r] = min([x for x in (least.get(r), k) if x is not None], default=None)
    return sorted(str((k, f"{f:016x}", least[r])) for (k, _), f, r in zip(docs, fps, root, strict=True))


def got(spark, d):
    return sorted(str(tuple(r)) for r in op.op7_simhash(spark, d).select("doc_id", "fingerprint", "component_id").collect())


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert got(spark, SF) == want


def test_odd_rows(spark, tmp_path):
    docs = odd_docs()
    assert got(spark, table_at(spark, tmp_path, documents=clashing(spark.createDataFrame(docs, DOCS)))) == brute([d[:2] for d in docs])
    assert got(spark, table_at(spark, tmp_path / "none", documents=spark.createDataFrame([], DOCS))) == []


@pytest.mark.parametrize("split", [20_000, 30])
@pytest.mark.parametrize("size", [3, 4, 5])
def test_links_of_many_fingerprints(spark, monkeypatch, size, split):
    """Chains and stars of near fingerprints, and lists far over the split."""
    rng = random.Random(size)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(500):
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    monkeypatch.setattr(op, "set_size", lambda n: size)
    monkeypatch.setattr(op, "SPLIT", split)
    reps = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    e = [(r.u, r.v) for r in op.links(reps, len(fps)).collect()]
    assert all((fps[u] ^ fps[v]).bit_count() <= 3 for u, v in e)
    near = {}
    for u, v in e:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    assert components(len(fps), lambda a, b: b in near.get(a, ())) == components(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)


def test_families_cover():
    from itertools import combinations

    for size in (3, 4, 5):
        assert all(any(set(s) <= set(five) for s in op.family(size)) for five in combinations(range(8), 5))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_filter_near(spark):
    """One document of each component of pairs at 0.8 or more stays; far ones stay."""
    rng = random.Random(8)
    docs = []
    for g in range(25):
        base = prose(rng, rng.randrange(40, 300), 3000).split()
        docs.append(" ".join(base))
        for _ in range(rng.randrange(0, 6)):
            w = list(base)
            for _ in range(len(w) // 60):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
            docs.append(" ".join(w))
        half = base[: len(base) // 2]  # under 0.8: another document
        docs.append(" ".join(half))
    rows = [(i, t, None, None, len(t)) for i, t in enumerate(docs)] + [(900 + i, t, None, None, 0) for i, t in enumerate([None, "", "  \n", docs[0].upper()])] + [(None, docs[3], None, None, 0)]
    sets = [shingles(r[1]) for r in rows]
    like = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = components(len(rows), like)
    want = sorted({min(((rows[i][0] is None, rows[i][0] or 0)) for i in range(len(rows)) if root[i] == r)[1] for r in root})
    df = clashing(spark.createDataFrame(rows, DOCS).repartition(4))
    out = op.filter_near(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == want
    assert op.filter_near(spark.createDataFrame([], DOCS)).count() == 0
