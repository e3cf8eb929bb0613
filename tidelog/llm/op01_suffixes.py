"""Exact substring deduplication by a sparse, distributed suffix array.

Every string of SIZE bytes that starts at two places or more is found, without sorting the suffixes of all
places. In each window of SIZE bytes an anchor is chosen by content: the leftmost of the GRAM-byte strings with
the least hash. Equal windows have equal anchors at equal offsets, so only suffixes at anchors, about one in 137,
need to be looked at, each with the run of windows that chose it.

1. Anchors, per document: hash of the gram, digest (128 bits of BLAKE2b) of all bytes that the run's windows cover.
   Within a batch, runs with equal digests are settled (repeated) at once, and one of them goes on.
2. By gram hash: runs of unique grams go; runs with equal digests are settled, so that copies are not sorted again
   and again; what has a gram in common but not the whole is open. Grams with HOT_ROWS anchors or so (by a sample
   of the anchors) are dealt out by digest as well, and all that is left of them is open.
3. Open runs get their bytes. Their suffixes are partitioned by range of their leading bytes (splitters are
   sampled) and sorted in their buckets by multikey quicksort, 8 bytes to a character: a group's suffixes stay
   together as long as their characters agree, and those that agree on all SIZE bytes are repeated.
4. A gram with more than HOT runs is cut into several buckets. Such buckets announce digests of their distinct
   windows, packed by digest, and windows that two buckets announce are repeated, too.
5. Repeated intervals are united by document and cut from its bytes.

Shuffled are anchors (about 0.4 bytes per byte of text), texts twice (for the open runs' bytes and for the cut),
and bytes of open runs. Stored tables go as soon as the next one is written.

Defined results: null text is empty; texts below SIZE bytes lose nothing; repeated rows are copies of each other,
and lose all if they have SIZE bytes; of equal strings (ties) all go, the first as well; a null doc_id is an id like
others; nulls in other columns and extra columns of any name change nothing; texts of any length are looked at
whole, SEGMENT windows at a time; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import by_group, forget, mapped, stored, table, text_of

SIZE, GRAM, HOT, CHUNK = 400, 128, 1000, 4000
#: Passages of over 50 words may have fewer bytes than SIZE; short words, 200.
PASSAGE, PASSAGE_GRAM, PASSAGE_WORDS = 200, 64, 50
#: Anchors of one gram that make it hot, and the part of the anchors that is looked at for that.
HOT_ROWS, LOOK, MATCH_CHUNK, MAX_SENT = 64_000, 64, 200_000, 100_000
#: Windows of a text that are looked at in one go, for memory.
SEGMENT = 1 << 19
U = np.uint64
_RNG = np.random.default_rng(20240101)
_BYTES = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_POW: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POW or len(_POW[0]) < n:
        n = max(1 << 16, n)
        _POW.clear()
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, b, dtype=U)
            p[0] = 1
            _POW.append(np.multiply.accumulate(p))
    return _POW


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def anchors(data: bytes, size: int = SIZE, gram: int = GRAM):
    """(place of the anchor, first and last window that chose it, gram hash, two halves of the digest). Gram hashes
    only choose anchors and bring runs together; what is equal is said by the digest of the run's bytes and of the
    anchor's place in them (128 bits of BLAKE2b)."""
    got = [_anchors(data[k : k + SEGMENT + size - 1], size, gram, k) for k in range(0, len(data) - size + 1, SEGMENT)]
    if not got:
        return None
    a, lo, hi, g = (np.concatenate(x) for x in zip(*got, strict=True))
    digest = hashlib.blake2b
    both = b"".join([digest(data[x : y + size], digest_size=16, salt=(p - x).to_bytes(8, "little")).digest() for p, x, y in zip(a.tolist(), lo.tolist(), hi.tolist(), strict=True)])
    c = np.frombuffer(both, dtype="<u8").reshape(-1, 2)
    return a, lo, hi, g, c[:, 0].copy(), c[:, 1].copy()


def _anchors(data: bytes, size: int, gram: int, base: int):
    """Of the windows that start in a segment of a text, which begins at base."""
    n = len(data)
    b = np.frombuffer(data, dtype=np.uint8)
    p, inverse = _powers(n + 1)
    s = np.zeros(n + 1, dtype=U)
    np.cumsum(_BYTES[b] * p[:n], out=s[1:])
    g = _mixed((s[gram:] - s[:-gram]) * inverse[: n - gram + 1])
    key = (g & U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=U)
    w = size - gram + 1  # least of each w keys in a row, by blocks
    m = -(-len(key) // w) * w
    blocks = np.full(m, 0xFFFFFFFFFFFFFFFF, dtype=U)
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - size + 1
    at = (np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & U(0xFFFFFFFF)).astype(np.int64)
    lo = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    hi = np.concatenate([lo[1:] - 1, [count - 1]])
    a = at[lo]
    return a + base, lo + base, hi + base, g[a]


def united(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of half-open intervals."""
    if not len(lo):
        return lo, hi
    o = np.argsort(lo, kind="stable")
    lo, top = lo[o], np.maximum.accumulate(hi[o])
    new = np.concatenate([[True], lo[1:] > top[:-1]])
    first = np.flatnonzero(new)
    return lo[first], top[np.concatenate([first[1:] - 1, [len(lo) - 1]])]


ROW = "kind int, doc_id long, h long, a long, lo long, hi long, settled boolean, g long, c1 long, c2 long"
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]


def _rows(kind, ids, h, a, lo, hi, settled, g=None, c1=None, c2=None) -> pa.RecordBatch:
    """ids: a pyarrow array, for nulls."""
    z = np.zeros(len(lo), dtype=np.int64)
    cols = [np.full(len(lo), kind, dtype=np.int32), ids, h, a, lo, hi, settled, *(z if x is None else x.view(np.int64) for x in (g, c1, c2))]
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], [x.split()[0] for x in ROW.split(", ")])


def _scan(batches: Iterator[pa.RecordBatch], size: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Step 1. In: doc_id, h, text."""
    for b in batches:
        got, doc = [], []
        for i, t in enumerate(b.column(2)):
            x = anchors(t.as_py().encode(), size, gram)
            if x is not None:
                got.append(x)
                doc.append(np.full(len(x[0]), i, dtype=np.int64))
        if not got:
            continue
        a, lo, hi, g, c1, c2 = (np.concatenate(x) for x in zip(*got, strict=True))
        doc = np.concatenate(doc)
        h = b.column(1).to_numpy()
        o = np.lexsort((c2, c1))
        new = np.concatenate([[True], (c1[o][1:] != c1[o][:-1]) | (c2[o][1:] != c2[o][:-1])])
        many = np.diff(np.concatenate([np.flatnonzero(new), [len(o)]]))
        twice = np.repeat(many > 1, many)
        keep = o[new]
        yield _rows(1, b.column(0).take(pa.array(doc[keep])), h[doc[keep]], a[keep], lo[keep], hi[keep], many > 1, g[keep], c1[keep], c2[keep])
        s = np.sort(o[twice])  # settled here; one interval for each run of neighbours
        base = (doc[s].astype(np.int64)) << 40
        x, y = united(base + lo[s], base + hi[s] + size)
        d = x >> 40
        yield _rows(0, b.column(0).take(pa.array(d)), h[d], x & ((1 << 40) - 1), x & ((1 << 40) - 1), y - (d << 40), np.ones(len(d), dtype=bool))


def _match(size: int):
    """Step 2. In: ROW, hot, salt; all of a gram hash and salt together, sorted by g, salt, c1, c2."""

    def chunk(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {n: t[n].combine_chunks() for n in t.column_names}
        g, salt, c1, c2 = (c[n].to_numpy() for n in ("g", "salt", "c1", "c2"))
        new_g = np.concatenate([[True], (g[1:] != g[:-1]) | (salt[1:] != salt[:-1])])
        new_c = new_g | np.concatenate([[True], (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])])
        first = np.flatnonzero(new_c)
        rows_of_c = np.diff(np.concatenate([first, [len(g)]]))
        contexts_of_g = np.add.reduceat(new_c.astype(np.int64), np.flatnonzero(new_g))
        several = np.repeat(contexts_of_g > 1, np.diff(np.concatenate([np.flatnonzero(new_g), [len(g)]]))) | c["hot"].to_numpy(zero_copy_only=False)
        done = c["settled"].to_numpy(zero_copy_only=False)
        copied = np.repeat(rows_of_c > 1, rows_of_c)
        settled = np.flatnonzero(copied & ~done)
        # rows that were settled in their batch have their interval already
        take = lambda n, i: c[n].take(pa.array(i))
        lo, hi = c["lo"].to_numpy(), c["hi"].to_numpy()
        yield _rows(0, take("doc_id", settled), c["h"].to_numpy()[settled], lo[settled], lo[settled], hi[settled] + size, np.ones(len(settled), dtype=bool))
        any_done = np.logical_or.reduceat(done | copied, first)
        opened = first[several[first]]
        yield _rows(1, take("doc_id", opened), c["h"].to_numpy()[opened], c["a"].to_numpy()[opened], lo[opened], hi[opened], any_done[several[first]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ("g", "salt"), MATCH_CHUNK):
            yield from chunk(t)

    return run


SPAN = "doc_id long, h long, lo long, off int, n int, settled boolean, gram binary, span binary"


def _spans(batches: Iterator[pa.RecordBatch], size: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Step 3. In: doc_id, h, text, entries (a, lo, hi, settled)."""
    for b in batches:
        rows = []
        for i, (t, entries) in enumerate(zip(b.column(2), b.column(3).to_pylist(), strict=True)):
            data = t.as_py().encode()
            rows += [(i, e["lo"], e["a"] - e["lo"], e["hi"] - e["lo"] + 1, e["settled"], data[e["a"] : e["a"] + gram], data[e["lo"] : e["hi"] + size]) for e in entries]
        x = list(zip(*rows, strict=True)) or [[]] * 7
        take = pa.array(x[0], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(x[1], pa.int64()), pa.array(x[2], pa.int32()), pa.array(x[3], pa.int32()), pa.array(x[4], pa.bool_()), pa.array(x[5], pa.binary()), pa.array(x[6], pa.binary())], [y.split()[0] for y in SPAN.split(", ")])


def multikey(words: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int = SIZE // 8) -> np.ndarray:
    """Suffixes that start at `at`, in groups of equal numbers (sorted): the group number of those that agree
    with another one on `depth` 8-byte characters, -1 of others. words[i]: the 8 bytes from i."""
    out = np.full(len(at), -1, dtype=np.int64)
    live = np.arange(len(at))
    for k in range(depth):
        if not len(live):
            return out
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([first, [len(live)]]))
        c = words[at[live] + 8 * k]
        alike = np.minimum.reduceat(c, first) == np.maximum.reduceat(c, first)
        if not alike.all():  # the parts less than, like and greater than their pivots, for all groups at once
            rows = np.flatnonzero(np.repeat(~alike, size))
            o = rows[np.lexsort((c[rows], group[rows]))]
            live[rows], c[rows] = live[o], c[o]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (c[1:] != c[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(live)]]))
        keep = np.repeat(size > 1, size)
        live, group = live[keep], np.repeat(np.arange(len(size)), size)[keep]
    out[live] = group
    return out


OUT = "kind int, doc_id long, h long, lo long, hi long, part int, blob binary"
_NOTE = np.dtype([("d", "<u8"), ("e", "<u8"), ("row", "<i4"), ("s", "<i4"), ("open", "?")])


def _found(ids, h, lo, hi) -> pa.RecordBatch:
    n = len(lo)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, dtype=np.int32)), ids, pa.array(h), pa.array(lo), pa.array(hi), pa.array(np.zeros(n, dtype=np.int32)), pa.nulls(n, pa.binary())], [x.split()[0] for x in OUT.split(", ")])


def _sorter(parts: int, size: int):
    """Steps 3 and 4. In: SPAN, hot and salt, sorted by gram and salt."""

    def chunk(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {n: t[n].combine_chunks() for n in t.column_names}
        spans = [bytes(x) for x in c["span"].to_pylist()]
        data = b"".join(spans) + bytes(8)
        start = np.cumsum([0, *map(len, spans)])[:-1].astype(np.int64)
        words = np.lib.stride_tricks.as_strided(np.frombuffer(data, dtype=">u8", count=1), shape=(len(data) - 7,), strides=(1,))
        n = c["n"].to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        s = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        grams = c["gram"].dictionary_encode().indices.to_numpy().astype(np.int64)
        # equal windows have their anchor at the same offset
        off = c["off"].to_numpy().astype(np.int64)[row] - s
        first = grams[row] << 20 | off
        o = np.argsort(first, kind="stable")
        agreed = np.full(len(row), -1, dtype=np.int64)
        agreed[o] = multikey(words, start[row[o]] + s[o], first[o], size // 8)
        hit = agreed >= 0
        settled = c["settled"].to_numpy(zero_copy_only=False)
        lo, h = c["lo"].to_numpy(), c["h"].to_numpy()
        got = np.flatnonzero(hit & ~settled[row])
        base = row[got].astype(np.int64) << 40
        x, y = united(base + lo[row[got]] + s[got], base + lo[row[got]] + s[got] + size)
        r = x >> 40
        yield _found(c["doc_id"].take(pa.array(r)), h[r], x & ((1 << 40) - 1), y - (r << 40))
        hot = c["hot"].to_numpy(zero_copy_only=False)
        if hot.any():  # one note for each distinct window, and one for each that nothing here repeats
            mine = np.flatnonzero(hot[row])
            rep = np.ones(len(mine), dtype=bool)
            _, at = np.unique(agreed[mine], return_index=True)
            rep[hit[mine]] = False
            rep[at] = True
            mine = mine[rep]
            notes = np.zeros(len(mine), dtype=_NOTE)
            for j, i in enumerate(mine.tolist()):
                p = int(start[row[i]] + s[i])
                notes["d"][j], notes["e"][j] = np.frombuffer(hashlib.blake2b(data[p : p + size], digest_size=16).digest(), dtype="<u8")
            notes["row"], notes["s"], notes["open"] = row[mine], lo[row[mine]] + s[mine], ~(hit[mine] | settled[row[mine]])
            part = (notes["d"] % U(parts)).astype(np.int64)
            o = np.argsort(part, kind="stable")
            ids = c["doc_id"].to_pylist()
            for q in np.split(o, np.flatnonzero(np.diff(part[o])) + 1) if len(o) else []:
                x = notes[q]
                used, back = np.unique(x["row"], return_inverse=True)
                x["row"] = back
                head = np.array([len(used)], dtype="<i8").tobytes() + np.array([[ids[i] is not None, ids[i] or 0, h[i]] for i in used], dtype="<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([int(part[q[0]])], pa.int32()), pa.array([head + x.tobytes()], pa.binary())], [y.split()[0] for y in OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ("gram", "salt"), CHUNK):
            yield from chunk(t)

    return run


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Step 4. In: part, blob; all of a part together."""
    owners, notes, at = [], [], 0
    for b in batches:
        for x in b.column(1):
            raw = x.as_py()
            k = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
            owners.append(np.frombuffer(raw, dtype="<i8", count=3 * k, offset=8).reshape(k, 3))
            v = np.frombuffer(raw, dtype=_NOTE, offset=8 + 24 * k).copy()
            v["row"] += at
            notes.append(v)
            at += k
    if not notes:
        return
    own, v = np.concatenate(owners), np.concatenate(notes)
    v = v[np.lexsort((v["e"], v["d"]))]
    new = np.concatenate([[True], (v["d"][1:] != v["d"][:-1]) | (v["e"][1:] != v["e"][:-1])])
    size = np.diff(np.concatenate([np.flatnonzero(new), [len(v)]]))
    v = v[np.repeat(size > 1, size) & v["open"]]
    o = own[v["row"]]
    yield _found(pa.array(o[:, 1], pa.int64(), mask=o[:, 0] == 0), np.ascontiguousarray(o[:, 2]), v["s"].astype(np.int64), v["s"].astype(np.int64) + length)


def _runs(data: bytes, spans: pa.Scalar, words: int = 0) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the intervals cover, those of over `words` words."""
    if not spans.is_valid or not len(spans):
        return []
    lo, hi = united(spans.values.field("lo").to_numpy(), spans.values.field("hi").to_numpy())
    return [(x, y) for x, y in zip(lo.tolist(), hi.tolist(), strict=True) if not words or len(data[x:y].split()) > words]


def _without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for x, y in runs:
        parts.append(data[at:x])
        at = y
    return b"".join([*parts, data[at:]])


def _cut(words: int):
    """Step 5. In: a struct that goes through, text, spans (lo, hi) or null. Out: beside the struct, the number of runs,
    and what is left of the text (null where nothing is cut)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rest = [], []
            for t, spans in zip(b.column(1), b.column(2), strict=True):
                runs = _runs(data := t.as_py().encode(), spans, words)
                n.append(len(runs))
                rest.append(_without(data, runs).decode(errors="ignore") if runs else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(rest, pa.string())], ["doc", "n_spans", "text"])

    return run


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: doc_id, text, spans, passages."""
    for b in batches:
        rows = []
        for t, spans, passages in zip(b.column(1), b.column(2), b.column(3), strict=True):
            rest = _without(data := t.as_py().encode(), runs := _runs(data, spans))
            rows.append((len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), len(_runs(data, passages, PASSAGE_WORDS))))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(cols))], [x.split()[0] for x in REPORT.split(", ")])


def repeated(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """docs: doc_id, text. (doc_id, h, spans): the intervals of bytes (lo, hi), overlapping, that repeated strings of
    `size` bytes cover; a row for each doc_id and text (h: xxhash64 of the text) that has any. size: a multiple
    of 8; gram: bytes of an anchor's string."""
    if size % 8 or not 0 < gram <= size // 2:
        raise ValueError("size must be a multiple of 8, and gram at most its half")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("h"), text_of().alias("text"))
    scan = stored(base.transform(mapped, partial(_scan, size=size, gram=gram), ROW), "anchors")
    runs = scan.filter("kind = 1")
    hot = runs.select("g").sample(1 / LOOK, 1).groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") >= max(2, HOT_ROWS // LOOK)).select(F.col("g").alias("_g"))
    hot = stored(hot, "hot")
    if n := hot.count():
        runs = runs.join(F.broadcast(hot) if n <= MAX_SENT else hot, F.col("g") == F.col("_g"), "left").withColumn("hot", F.col("_g").isNotNull()).withColumn("salt", F.when(F.col("hot"), F.pmod(F.col("c1"), F.lit(parts))).otherwise(F.lit(0)).cast("long")).drop("_g")
    else:
        runs = runs.withColumn("hot", F.lit(False)).withColumn("salt", F.lit(0).cast("long"))
    grams = runs.repartition(parts, "g", "salt").sortWithinPartitions("g", "salt", "c1", "c2")
    matched = stored(grams.transform(mapped, _match(size), ROW), "matched")
    spans_of = lambda t: t.filter("kind = 0").select("doc_id", "h", "lo", "hi")
    settled = stored(spans_of(scan).unionAll(spans_of(matched)), "settled")
    forget(scan, hot)
    entry = F.struct("a", "lo", "hi", "settled")
    per = matched.filter("kind = 1").groupBy("doc_id", "h").agg(F.collect_list(entry).alias("entries")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "entries")
    same = F.col("h").eqNullSafe(F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    opened = base.join(per.hint("shuffle_merge"), same).select("doc_id", "h", "text", "entries")
    spans = stored(opened.transform(mapped, partial(_spans, size=size, gram=gram), SPAN), "spans")
    forget(matched)
    counts = stored(spans.groupBy(F.xxhash64("gram").alias("_g")).agg(F.count("*").alias("c")).filter(F.col("c") > HOT), "counts")
    if n := counts.count():
        spread = spans.join(F.broadcast(counts) if n <= MAX_SENT else counts, F.xxhash64("gram") == F.col("_g"), "left")
        spread = spread.withColumn("salt", F.when(F.col("c").isNotNull(), F.pmod(F.xxhash64("doc_id", "lo"), F.ceil(F.col("c") / HOT))).otherwise(F.lit(0).cast("long"))).withColumn("hot", F.col("c").isNotNull())
    else:
        spread = spans.withColumn("salt", F.lit(0).cast("long")).withColumn("hot", F.lit(False))
    ordered = spread.repartitionByRange(parts, "gram", "salt").sortWithinPartitions("gram", "salt").select(*[x.split()[0] for x in SPAN.split(", ")], "hot", "salt")
    found = stored(ordered.transform(mapped, _sorter(parts, size), OUT), "found")
    forget(spans, counts)
    across = found.filter("kind = 2").select("part", "blob").repartition(parts, "part").transform(mapped, partial(_compare, length=size), OUT)
    every = settled.unionAll(spans_of(found.unionAll(across)))
    out = stored(every.groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "repeats")
    forget(settled, found)
    return out


def with_spans(docs: DataFrame, doc, spans: DataFrame) -> DataFrame:
    """doc: a column of docs that goes through. Beside it _text (null: empty) and the columns of spans, joined by doc_id
    and the hash of the text."""
    spans = spans.withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    whole = docs.select(doc.alias("doc"), F.col("doc_id").cast("long").alias("_doc_id"), F.xxhash64(text_of()).alias("_text_h"), text_of().alias("_text"))
    on = F.col("_text_h").eqNullSafe(F.col("_h")) & F.col("_doc_id").eqNullSafe(F.col("_id"))
    return whole.join(spans.hint("shuffle_merge"), on, "left").drop("_doc_id", "_text_h", "_id", "_h")


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of SIZE bytes as the contract has them; besides, n_passages: maximal runs of over PASSAGE_WORDS words
    that are covered by strings of PASSAGE bytes which start elsewhere, too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    none = F.lit(None).cast("array<struct<lo:long,hi:long>>")
    # texts meet both sets of intervals in one join
    either = repeated(docs).withColumn("passages", none).unionByName(repeated(docs, PASSAGE, PASSAGE_GRAM).select("doc_id", "h", none.alias("spans"), F.col("spans").alias("passages")))
    both = either.groupBy("doc_id", "h").agg(F.first("spans", True).alias("spans"), F.first("passages", True).alias("passages"))
    rows = with_spans(docs, F.col("doc_id").cast("long"), both).select("doc", "_text", "spans", "passages")
    return rows.transform(mapped, _report, REPORT)


def filter_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, words: int = 0) -> DataFrame:
    """docs with repeated passages (of over `words` words) cut from text, n_chars of cut texts made to fit; what is left
    of a cut character's bytes goes. All other columns stay."""
    rows = with_spans(docs, F.struct("*"), repeated(docs, size, gram)).select("doc", "_text", "spans")
    out, is_cut = rows.transform(mapped, _cut(words), f"doc {rows.schema['doc'].dataType.simpleString()}, n_spans long, text string"), F.col("n_spans") > 0
    changed = {"text": F.when(is_cut, F.col("text")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(is_cut, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return out.select(*[changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


QUERIES, ORACLE = {"op1_suffixes": op1_suffixes}, {}
