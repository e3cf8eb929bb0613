"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has 8 bytes; two that differ in at most 3 bits share at least 5 bytes at their positions. An
index of single bytes would have lists of 1/256 of all documents, so posting lists are those of byte sets: a
family of position sets such that any 5 positions contain one of them. 8 sets of 3 positions do; 20 or so of 4,
and all 56 of 5, have shorter lists for larger corpora, with the same result. Within a list, the shared
positional bytes of pairs are tallied (by word arithmetic), pairs with fewer than 5 go, the rest are verified
by their bits. Lists hold distinct fingerprints only, whatever number of documents has them, and give not
their pairs but a spanning forest of their links: at most one link per row. Lists of over `SPLIT` rows are cut by
two more of their bytes, which pairs of 5 shared bytes must share as well.

Defined results: null text is empty; a text without words has fingerprint 0 and is linked like any other; null
doc_ids are in their fingerprint's component, which is null if it has no other id; repeated rows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import by_group, forget, mapped, stored, table, text_of
from tidelog.llm.graph import components

BITS, SPLIT = 3, 20_000
U = np.uint64


def simhash(text: str, width: int = 3) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=U)
    else:
        joined, size = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        ends = np.cumsum(size) - 1
        starts = ends - size + 1
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[a:e], 42) for a, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], dtype=U)
    if len(h) < 255:
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t.as_py(), width) for t in b.column(1)], dtype=U)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).transform(mapped, run, "doc_id long, fp long")


def family(size: int) -> list[tuple[int, ...]]:
    """Position sets such that any 5 of 8 positions contain one."""
    if size == 3:
        return [s for half in (range(4), range(4, 8)) for s in combinations(half, 3)]
    if size == 5:
        return list(combinations(range(8), 5))
    left, out = set(combinations(range(8), 5)), []
    while left:
        best = max(combinations(range(8), size), key=lambda s: sum(set(s) <= set(x) for x in left))
        out.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return out


def set_size(n: int) -> int:
    """For lists of a few hundred rows at most, were fingerprints random."""
    return 3 if n < 1 << 31 else 4 if n < 1 << 39 else 5


def linked(a: np.ndarray, x: np.uint64) -> np.ndarray:
    d = a ^ x
    low = U(0x7F7F7F7F7F7F7F7F)
    differing = np.bitwise_count((((d & low) + low) | d) & ~low)  # bytes
    ok = differing <= 8 - 5
    ok[ok] = np.bitwise_count(d[ok]) <= BITS
    return ok


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Places of linked fingerprints that span each of the list's components."""
    left, out = np.arange(1, len(fps)), []
    todo = [0]
    while True:
        while todo and len(left):
            i = todo.pop()
            ok = linked(fps[left], fps[i])
            if ok.any():
                near = left[ok].tolist()
                out += [(i, j) for j in near]
                todo += near
                left = left[~ok]
        if not len(left):
            return out
        todo, left = [int(left[0])], left[1:]


def split_forest(fps: np.ndarray, positions: tuple[int, ...]) -> list[tuple[int, int]]:
    """The same for a long list: by each two of the other bytes."""
    if len(fps) <= SPLIT or len(positions) >= 5:
        return forest(fps)
    out, b = set(), fps.view(np.uint8).reshape(-1, 8)
    for p, q in combinations([i for i in range(8) if i not in positions], 2):
        k = b[:, p].astype(np.int64) << 8 | b[:, q]
        order = np.argsort(k, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(k[order])) + 1):
            if len(part) > 1:
                out |= {(int(part[i]), int(part[j])) for i, j in split_forest(np.ascontiguousarray(fps[part]), (*positions, p, q))}
    return list(out)


def links(reps: DataFrame, n: int) -> DataFrame:
    """reps: fp (distinct), rep. Edges u, v between reps."""
    sets = family(set_size(n))
    byte = lambda p: F.call_function("shiftright", F.col("fp"), F.lit(8 * p)).bitwiseAND(F.lit(255).cast("long"))

    def key(i, s):
        out = F.lit(i).cast("long")
        for p in s:
            out = F.call_function("shiftleft", out, F.lit(8)).bitwiseOR(byte(p))
        return out

    rows = reps.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("s"), key(i, s).alias("k")) for i, s in enumerate(sets)])).alias("x")).select("x.s", "x.k", "fp", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, fps, reps):
            if len(fps) < 2:
                return []
            a = np.array(fps, dtype=np.int64).view(U)
            return [(reps[i], reps[j]) for i, j in split_forest(a, sets[key[0]])]

        last, fps, reps, out = None, [], [], []
        for b in batches:
            for s, k, fp, rep in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (s, k) != last:
                    out += done(last, fps, reps)
                    last, fps, reps = (s, k), [], []
                fps.append(fp)
                reps.append(rep)
            if out:
                yield _edges(out)
                out = []
        if out := done(last, fps, reps):
            yield _edges(out)

    return rows.repartition("s", "k").sortWithinPartitions("s", "k").transform(mapped, run, "u long, v long")


def _edges(out):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["u", "v"])


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp, component_id."""
    fps = stored(fingerprinted(docs, width), "simhash")
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    e = links(reps.filter("rep IS NOT NULL"), reps.count())
    roots = components(e)
    ids = reps.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "rep").alias("component_id"))
    return fps.join(ids, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


# Texts whose sets of shingles are alike. First come the links of op7's fingerprints by the index above. At a similarity
# of 0.8, 64-bit fingerprints differ in 10 bits or so, where bytes have little in common: for these pairs there are wider
# fingerprints in lists of min-wise keys. All links are verified by whole sets. The forest of a list by fingerprints finds most components; then every pair of a list that is still in
# two components is compared.

SHINGLE, ALIKE, FAR, WIDE, BANDS, ROWS = 5, 0.8, 80, 4, 14, 4
_SEEDS = np.random.default_rng(77).integers(0, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64) * U(2) + U(1)
_MIX = np.random.default_rng(78).integers(0, 1 << 63, size=WIDE, dtype=np.uint64)
#: Longer lists have a quicker forest. It only saves comparisons: what it misses, unlinked() finds.
MOST_EXACT = 6000
#: Rows of either side that one task compares.
BLOCK = 2000
#: A pair at ALIKE differs in at most this share of its two sizes. Parities of hash buckets (MOST_BITS at most) differ
#: in no more places than the sets do, which rules pairs out for certain.
APART, LEAST_BITS, MOST_BITS = (1 - ALIKE) / (1 + ALIKE) + 1e-9, 64, 4096


def _scramble(x):
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def shingle_set(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of all words where there are fewer; none without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=U)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))], dtype=U))


def summary(h: np.ndarray) -> tuple[bytes, list[int], np.ndarray]:
    """(fingerprint, band keys, the upper halves of all hashes) of a shingle set."""
    ones, least = np.zeros((WIDE, 64), dtype=np.int64), np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, dtype=U)
    for i in range(0, len(h), 4096):
        x = h[i : i + 4096]
        for k in range(WIDE):
            ones[k] += np.unpackbits(_scramble(x ^ _MIX[k]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        y = x[:, None] * _SEEDS[0] + _SEEDS[1]
        least = np.minimum(least, (y ^ (y >> U(29))).min(axis=0))
    keys = np.zeros(BANDS, dtype=U)
    for r in range(ROWS):
        keys = _scramble(keys ^ least[r::ROWS])
    return np.packbits((2 * ones > len(h)).astype(np.uint8), axis=1, bitorder="little").tobytes(), keys.view(np.int64).tolist(), np.unique((h >> U(32)).astype("<u4"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two whole sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """fps: (n, WIDE). A least spanning forest by differing bits, without edges of over FAR bits: the path in it
    between two fingerprints has no step longer than their distance. Longer lists go to the nearest of leaders, and may miss edges."""
    n, out = len(fps), []
    if n <= MOST_EXACT:
        left = np.arange(1, n)
        best, frm, at = np.full(n - 1, 999), np.zeros(n - 1, dtype=np.int64), 0
        while len(left):
            d = np.bitwise_count(fps[left] ^ fps[at]).sum(axis=1, dtype=np.int64)
            nearer = d < best
            best[nearer], frm[nearer] = d[nearer], at
            j = int(best.argmin())
            at = int(left[j])
            if best[j] <= FAR:
                out.append((int(frm[j]), at))
            keep = np.arange(len(left)) != j
            left, best, frm = left[keep], best[keep], frm[keep]
        return out
    for a, b in ((a, min(a + MOST_EXACT // 2, n)) for a in range(0, n, MOST_EXACT // 2)):
        out += [(a + i, a + j) for i, j in spanning(fps[a:b])]
    heads = np.unique(np.linspace(0, n - 1, MOST_EXACT // 2).astype(np.int64))
    for i in range(n):
        d = np.bitwise_count(fps[heads] ^ fps[i]).sum(axis=1, dtype=np.int64)
        for j in np.argsort(d, kind="stable")[:2]:
            if heads[j] != i and d[j] <= FAR:
                out.append((int(heads[j]), i))
    return out


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether the hashes in each bucket are odd in number; some 1.5 buckets or more a hash."""
    d = LEAST_BITS
    while d < min(1.5 * len(hashes), MOST_BITS):
        d *= 2
    odd = np.bincount(hashes & np.uint32(d - 1), minlength=d) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def _fold(p: np.ndarray, words: int) -> np.ndarray:
    while p.shape[-1] > words:
        h = p.shape[-1] // 2
        p = p[..., :h] ^ p[..., h:]
    return p


class Others:
    """Rows of a list to be compared with: those that may be at ALIKE with a row, by sizes and parities."""

    def __init__(self, sizes: np.ndarray, odd: list[np.ndarray]):
        words = np.array([len(x) for x in odd])
        self.parts = []
        for w in np.unique(words).tolist():
            at = np.flatnonzero(words == w)
            at = at[np.argsort(sizes[at], kind="stable")]
            self.parts.append((w, at, sizes[at], np.stack([odd[i] for i in at])))

    def near(self, size: int, odd: np.ndarray) -> np.ndarray:
        """Places, the nearest first."""
        found, far = [], []
        for w, at, sizes, p in self.parts:
            a, e = np.searchsorted(sizes, [ALIKE * size - 1e-6, size / ALIKE + 1e-6])
            if a < e:
                k = min(w, len(odd))
                d = np.bitwise_count(_fold(p[a:e], k) ^ _fold(odd, k)).sum(axis=1, dtype=np.int64)
                ok = d <= APART * (sizes[a:e] + size)
                found.append(at[a:e][ok])
                far.append(d[ok] / (sizes[a:e][ok] + size))
        if not found:
            return np.zeros(0, dtype=np.int64)
        return np.concatenate(found)[np.argsort(np.concatenate(far), kind="stable")]


def unlinked(lists: DataFrame, roots: DataFrame, made: DataFrame) -> DataFrame:
    """Edges u, v of 0.8 that link all pairs of 0.8 in the same list (band, key, row) but in different components.

    Rows of a list's largest component need not be compared with each other; all other pairs of different components
    are. Two steps: rows with a partner that sizes and parities do not rule out, then those rows' whole sets."""
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(lists.join(roots.select(F.col("node").alias("row"), "root"), "row", "left").select("band", "key", "row", F.coalesce("root", "row").alias("root")), "placed")
    sizes = placed.groupBy("band", "key", "root").agg(F.count("*").alias("n")).groupBy("band", "key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top")).filter("n > top.n")
    sizes = stored(sizes.select("band", "key", "n", F.col("top.root").alias("top"), (F.col("n") - F.col("top.n")).alias("rest")), "sizes")
    mixed = placed.join(sizes, ["band", "key"]).withColumn("few", F.col("root") != F.col("top"))
    told = dealt(mixed.join(made.select("row", "size", "odd"), "row")).repartition(parts, "band", "key", "s", "t").sortWithinPartitions("band", "key", "s", "t")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, rows in _lists(batches):
            left = [i for i, r in enumerate(rows) if r["side"] == 0]
            right = [i for i, r in enumerate(rows) if r["side"] == 1]
            if not left or not right:
                continue
            root, ids, few = (np.array([rows[i][k] for i in right]) for k in ("root", "row", "few"))
            others = Others(np.array([rows[i]["size"] for i in right]), [np.frombuffer(rows[i]["odd"], dtype="<u8") for i in right])
            met = set()
            for i in left:
                x = rows[i]
                at = others.near(x["size"], np.frombuffer(x["odd"], dtype="<u8"))
                at = at[(root[at] != x["root"]) & (~few[at] | (ids[at] > x["row"]))]
                if len(at):
                    met.add(i)
                    met.update(right[j] for j in at.tolist())
            out += [dict(zip(("band", "key", "s", "t"), key, strict=True)) | {k: rows[i][k] for k in ("row", "root", "few", "side")} for i in sorted(met)]
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema=kept)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kept)

    kept = pa.schema([("band", pa.int32()), ("key", pa.int64()), ("s", pa.int64()), ("t", pa.int64()), ("row", pa.int64()), ("root", pa.int64()), ("few", pa.bool_()), ("side", pa.int32())])
    open_ = stored(told.transform(mapped, search, "band int, key long, s long, t long, row long, root long, few boolean, side int"), "open")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, rows in _lists(batches):
            to = {}

            def find(x, to=to):
                while to.get(x, x) != x:
                    to[x] = to.get(to[x], to[x])
                    x = to[x]
                return x

            right = [r for r in rows if r["side"] == 1]
            sets = [np.frombuffer(r["hashes"], dtype="<u4") for r in right]
            others = Others(np.array([len(h) for h in sets]), [parities(h) for h in sets])
            for x in rows:
                if x["side"] == 0:
                    h = np.frombuffer(x["hashes"], dtype="<u4")
                    for j in others.near(len(h), parities(h)).tolist():
                        y = right[j]
                        if (not y["few"] or y["row"] > x["row"]) and find(x["root"]) != find(y["root"]) and jaccard(h, sets[j]) >= ALIKE:
                            to[find(x["root"])] = find(y["root"])
                            out.append((x["row"], y["row"]))
        if out:
            yield _edges(out)

    whole = open_.join(made.select("row", "hashes"), "row").repartition(parts, "band", "key", "s", "t").sortWithinPartitions("band", "key", "s", "t")
    out = stored(whole.transform(mapped, verify, "u long, v long").distinct(), "links")
    forget(placed, sizes, open_)
    return out


def dealt(mixed: DataFrame) -> DataFrame:
    """s, t: the tasks of a list's rows, where blocks of `BLOCK` rows meet. Side 0 (rows outside the largest component,
    `rest` in number) is compared with side 1 (all n rows): each block of one with each block of the other."""
    count = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("long")
    block = lambda c, salt: F.pmod(F.xxhash64("row", F.lit(salt)), count(c))
    place = lambda s, t, side: F.struct(s.alias("s"), t.alias("t"), F.lit(side).alias("side"))
    each = lambda c: F.sequence(F.lit(0).cast("long"), count(c) - 1)
    left = F.transform(F.when(F.col("few"), each("n")).otherwise(F.array().cast("array<long>")), lambda t: place(block("rest", 1), t, 0))
    right = F.transform(each("rest"), lambda s: place(s, block("n", 2), 1))
    return mixed.withColumn("at", F.explode(F.concat(left, right))).select("band", "key", "row", "root", "few", "size", "odd", "at.*")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((band, key, s, t), rows) of sorted batches."""
    for t in by_group(batches, ("band", "key", "s", "t"), 1):
        last, rows = None, []
        for r in t.to_pylist():
            key = (r["band"], r["key"], r["s"], r["t"])
            if key != last and rows:
                yield last, rows
                rows = []
            last = key
            rows.append(r)
        if rows:
            yield last, rows


def by_index(reps: DataFrame) -> DataFrame:
    """reps: row, sh (op7's fingerprint). Edges u, v, stored, that link all rows whose fingerprints link: by the byte-position
    index, of distinct fingerprints' least rows; other rows of a fingerprint go to that."""
    least = stored(reps.groupBy(F.col("sh").alias("fp")).agg(F.min("row").alias("rep")), "reps")
    same = reps.select("sh", "row").join(least, F.col("sh") == F.col("fp")).filter("row <> rep").select(F.col("rep").alias("u"), F.col("row").alias("v"))
    out = stored(links(least, least.count()).unionAll(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "index")
    forget(least)
    return out


def filter_near(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id (a null is larger than all;
    then any). Groups are components of pairs whose sets of five-word shingles have a similarity of 0.8 or more; candidates
    are the links of op7's byte-position index, and min-wise lists for pairs that its 3 bits do not reach.
    All columns stay. Documents without words are copies of each other."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            texts = b.column(1).to_pylist()
            sets = [shingle_set(t) for t in texts]
            sh = np.array([simhash(t) for t in texts], dtype=U).view(np.int64)
            got = [summary(h) for h in sets]
            both = [xxhash.xxh3_128_intdigest(h.tobytes()) for h in sets]
            half = lambda k: pa.array(np.array([x >> k & 0xFFFFFFFFFFFFFFFF for x in both], dtype=U).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(row + np.arange(len(got))), half(0), half(64), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2].tobytes() for g in got], pa.binary()), pa.array([len(g[2]) for g in got], pa.int32()), pa.array([parities(g[2]).tobytes() for g in got], pa.binary()), pa.array(sh)], ["doc", "row", "s1", "s2", "fp", "keys", "hashes", "size", "odd", "sh"])
            row += len(got)

    whole = docs.select(F.struct("*").alias("doc"), text_of().alias("text"))
    kind = whole.schema["doc"].dataType.simpleString()
    made = stored(whole.transform(mapped, run, f"doc {kind}, row long, s1 long, s2 long, fp binary, keys array<long>, hashes binary, size int, odd binary, sh long"), "near")
    rank = F.struct(F.col("doc.doc_id").isNull().alias("null_id"), F.col("doc.doc_id").alias("id"), F.col("row").alias("row"))
    # copies: one row of each set goes on
    sets = made.select("s1", "s2", rank.alias("k")).groupBy("s1", "s2").agg(F.min("k").alias("k"))
    copies = made.select("s1", "s2", "row").join(sets.select("s1", "s2", F.col("k.row").alias("rep")), ["s1", "s2"]).filter("row <> rep").select("row")
    first = sets.select(F.col("k.row").alias("row"), "k")
    reps = stored(made.select("row", "fp", "keys", "sh").join(first, "row"), "sets")
    indexed = by_index(reps)
    rows = reps.select(F.posexplode("keys").alias("band", "key"), "row", "fp").filter(F.length("fp") > 0)

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(at, ids, fps):
            if len(ids) < 2:
                return []
            e = spanning(np.frombuffer(b"".join(fps), dtype="<u8").reshape(-1, WIDE))
            return [(*at, i, None) for i in ids] + [(*at, min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in e]

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["band", "key", "u", "v"])

        last, ids, fps = None, [], []
        for b in batches:
            out = []
            for band, key, row, fp in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (band, key) != last:
                    out += done(last, ids, fps)
                    last, ids, fps = (band, key), [], []
                ids.append(row)
                fps.append(fp)
            if out:
                yield batch(out)
        if out := done(last, ids, fps):
            yield batch(out)

    # lists of two rows or more: the rows, and the forest's edges
    found = stored(rows.repartition(parts, "band", "key").sortWithinPartitions("band", "key", "row").transform(mapped, forests, "band int, key long, u long, v long"), "lists")
    forget(reps)
    near = found.filter("v IS NOT NULL").select("u", "v").unionAll(indexed).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [jaccard(np.frombuffer(x.as_buffer(), dtype="<u4"), np.frombuffer(y.as_buffer(), dtype="<u4")) >= ALIKE for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    whole_sets = made.select(F.col("row").alias("_r"), "hashes")
    pairs = near.join(whole_sets.withColumnsRenamed({"_r": "u", "hashes": "a"}), "u").join(whole_sets.withColumnsRenamed({"_r": "v", "hashes": "b"}), "v").select("u", "v", "a", "b")
    roots = components(pairs.transform(mapped, verify, "u long, v long"))
    # pairs of 0.8 that no path of such edges joins yet
    more = unlinked(found.filter("v IS NULL").select("band", "key", F.col("u").alias("row")), roots, made)
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(more))
    forget(found, indexed)
    # a component's root is its least row; the one that stays has the least doc_id
    group = roots.select("node", "root").unionAll(roots.select(F.col("root").alias("node"), "root").distinct()).join(first, F.col("node") == F.col("row"))
    stays = group.groupBy("root").agg(F.min("k").alias("best"))
    gone = group.select("row").join(stays.select(F.col("best.row").alias("row")), "row", "left_anti")
    out = stored(made.join(copies.unionAll(gone), "row", "left_anti").select("doc.*"), "single")
    forget(made)  # texts with their sets; the result has no use of these
    return out


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES, ORACLE = {"op7_simhash": op7_simhash}, {}
