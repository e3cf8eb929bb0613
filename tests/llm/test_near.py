"""The near-duplicate stage on groups that have pairs on both sides of 0.8, against all pairs."""

import random

import pytest

from tests.llm.helpers import DOCS, components, prose
from tests.llm.test_simhash import fingerprint, shingles
from tidelog.llm import op07_simhash as op


def kept(spark, texts):
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    return sorted(r.doc_id for r in op.filter_near(spark.createDataFrame(rows, DOCS).repartition(4)).collect())


def brute(texts):
    sets = [shingles(t) for t in texts]
    return sorted(set(components(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))))


def copies(rng, bases, n, changes):
    out = []
    for _ in range(bases):
        base = prose(rng, 150, 3000).split()
        for _ in range(n):
            w = list(base)
            for i in rng.sample(range(len(w)), rng.choice(changes)):
                w[i] = f"x{rng.randrange(10**9)}"
            out.append(" ".join(w))
    return out


def test_pairs_off_the_forest(spark):
    """Pairs of 0.8 whose path in a list's forest has steps below 0.8."""
    texts = copies(random.Random(1), 20, 30, (2, 3, 4))
    assert kept(spark, texts) == brute(texts)


def test_long_lists(spark, monkeypatch):
    texts = copies(random.Random(2), 2, 300, (2, 3, 4))
    monkeypatch.setattr(op, "MOST_EXACT", 20)
    monkeypatch.setattr(op, "BLOCK", 30, raising=False)
    assert kept(spark, texts) == brute(texts)


@pytest.mark.parametrize("changed", [66, 68])
def test_long_texts(spark, changed):
    """Pairs of 3,000 words close to 0.8, on either side, are told apart by their whole sets."""
    rng, texts = random.Random(changed), []
    for _ in range(30):
        w = prose(rng, 3000, 10**6).split()
        texts.append(" ".join(w))
        for i in range(0, changed * 44, 44):
            w[i + 4] = "other"
        texts.append(" ".join(w))
    want = brute(texts)
    assert len(want) == (30 if changed == 66 else 60)
    assert kept(spark, texts) == want


def test_links_of_the_index(spark, monkeypatch):
    """The stage takes the links of op7's byte-position index: they join all fingerprints at 3 bits or fewer."""
    texts = sorted(set(copies(random.Random(3), 12, 6, (0, 1))))
    taken, by_index = [], getattr(op, "by_index", None)

    def watched(reps):
        fps = {r.row: r.sh & (1 << 64) - 1 for r in reps.collect()}
        out = by_index(reps)
        taken.append((fps, {(r.u, r.v) for r in out.collect()}))
        return out

    monkeypatch.setattr(op, "by_index", watched, raising=False)
    assert kept(spark, texts) == brute(texts)
    assert len(taken) == 1
    (fps, edges), at = taken[0], sorted(taken[0][0])
    assert sorted(fps.values()) == sorted(map(fingerprint, texts))
    near = {(a, b) for a in at for b in at if a < b and (fps[a] ^ fps[b]).bit_count() <= 3}
    linked = lambda e: components(len(at), lambda a, b: (at[min(a, b)], at[max(a, b)]) in e)
    assert edges <= near and linked(edges) == linked(near) and len(set(linked(near))) < len(at)
