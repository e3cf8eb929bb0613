"""Language-model scoring: causal self-attention, trained in numpy, over subword ids.

Units. A text is its words and an end. Every word enters the model by its first subword id (of a public
tokenizer file). The model gives the next word's class; a word's probability is its class's times its share of
the class's count. Classes are clusters of the `TOP_WORDS` most frequent words by the documents that they occur in
(subspace iteration, then k-means). All other words of the training rows are one class, shared by their counts;
a word that the training rows have not is a class of its own, which stands for all such words (as in the base), and
which is learned from words with a count of 1; the end is a class of its own, too.

What is gathered, always of all training rows. Texts are split once, into stored lists of distinct words and places
in them. Counts are by one shuffle; the most frequent ones, a bounded number, go to all executors, and the rest of
the words meet their counts in a join. Then each row's words get their places among the most frequent ones and their
first subwords, once for all passes after that. Classes: every pass of the subspace iteration goes over all training documents,
tasks give sums. Weights: each training document is trained on in one of the `ROUNDS`, which share all documents out;
a round's tasks start from the same weights, and the next round from the mean of theirs. Small tables are gone over
until the network has had STEPS batches. Where there are words beyond the most frequent ones, a place of such a word
is, in training, one of an unseen word by the share that words with a count of 1 have in all such places.

Scoring. Windows of 2 * HOP tokens overlap by half: each token is scored once, in the window where at
least HOP tokens stand before it (or its text begins), with masked attention over batches of windows.

Defined results: null or empty text is one end; repeated rows are scored alike and count as often as they stand; a
null doc_id is never held out (its text has no remainder) and trains; without training tokens base_score is that of
counts of zero, and score is the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe
from tidelog.llm.common import forget, mapped, stored, table, text_of
from tidelog.llm.op09_bpe import tokenizer_path

TOP_WORDS, CLASSES, WIDTH, HOP, STEPS, BATCH = 150_000, 32, 16, 32, 400, 96
START = 49406
#: Texts that are kept, and looked at, in one go, and distinct words that a task counts, for memory.
ROWS, COUNTED = 200, 200_000
#: Passes and width of the subspace iteration, words of one row of its sums.
PASSES, SKETCH, CHUNK = 3, 16, 4096
#: The parts of all documents (in PIECES) that the rounds of training end at, and their first rates.
PIECES, ROUNDS, RATE = 16, ((2, 0.02), (6, 0.015), (16, 0.01)), 0.02
#: Classes after the clusters: other words of the training rows, the end, unseen words.
RARE, END, UNSEEN = CLASSES, CLASSES + 1, CLASSES + 2


def held_out(c):
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(places in the list of distinct words, that list, each text's first word and the end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(some)])[np.concatenate([[0], np.cumsum(n)])]
    coded = flat.filter(pa.array(some)).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, bounds


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS))


CODED = "row long, ids array<long>, held array<boolean>, words string, at binary, bounds binary, learned long, windows long"


def coded(docs: DataFrame, held) -> DataFrame:
    """ROWS texts in a row: their ids, whether they are held out, their distinct words, and each text's places in these;
    texts to learn from, and their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in sliced(batches):
            at, words, bounds = words_of(b.column(2))
            learned = ~b.column(1).to_numpy(zero_copy_only=False)
            windows = int((-(-(np.diff(bounds) + 1) // HOP))[learned].sum())
            whole = lambda c: pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), c)  # noqa: E731, B023
            names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")
            values = [[row], whole(b.column(0)), whole(b.column(1)), names, [at.astype("<i4").tobytes()], [bounds.astype("<i8").tobytes()], [int(learned.sum())], [windows]]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values], [c.split()[0] for c in CODED.split(", ")])
            row += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), text_of().alias("text")).transform(mapped, run, CODED)


def counted(codes: DataFrame) -> DataFrame:
    """word, c: of all training words. A task counts COUNTED distinct words before it sends them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back, rows = [], 0

        def out():
            t = pa.concat_tables(held_back).group_by("word").aggregate([("n", "sum")])
            return t.select(["word", "n_sum"]).rename_columns(["word", "n"])

        for b in batches:
            lists = pc.split_pattern(b.column("words"), " ")
            for i in range(b.num_rows):
                at, bounds = (np.frombuffer(b.column(c)[i].as_buffer(), dtype=t) for c, t in (("at", "<i4"), ("bounds", "<i8")))
                learned = np.repeat(~b.column("held")[i].values.to_numpy(zero_copy_only=False), np.diff(bounds))
                words = lists[i].values  # [""] where there are none
                times = np.bincount(at[learned], minlength=len(words))
                seen = pa.array(times > 0)
                held_back.append(pa.table({"word": words.filter(seen), "n": pa.array(times).filter(seen)}))
                rows += len(held_back[-1])
                if rows >= 2 * COUNTED:
                    held_back = [out()]
                    if (rows := len(held_back[0])) >= COUNTED:
                        yield from held_back[0].to_batches()
                        held_back, rows = [], 0
        if held_back:
            yield from out().to_batches()

    return codes.select("held", "words", "at", "bounds").transform(mapped, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def word_counts(train: DataFrame) -> DataFrame:
    return counted(coded(train, F.lit(False)))


@dataclass
class Model:
    n_tokens: int  # training tokens, ends included
    n_types: int
    ends: int
    index: dict[str, int]  # top words
    count: np.ndarray
    cls: np.ndarray
    enters: np.ndarray  # first subword id
    share: np.ndarray  # log of the word's share of its class
    net: dict[str, np.ndarray]
    tokenizer: str


class FirstIds:
    """Words' first subword ids, by the library's model of the file (words are not normalised or split further)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.chars = self.tokenizer.model, bpe.byte_chars()

    def __call__(self, words: list[str]) -> list[int]:
        parts, whole = self.model.tokenize, "".join(words)
        if not (whole.isascii() and whole.isprintable()):
            words = [w if w.isascii() and w.isprintable() else "".join([self.chars[b] for b in w.encode()]) for w in words]
        return [got[0].id if (got := parts(w)) else 0 for w in words]


@cache
def first_ids(path: str) -> FirstIds:
    """Read once by a worker."""
    return FirstIds(path)


PLACED = "row long, ids array<long>, held array<boolean>, at binary, bounds binary, place binary, sub binary, rare string"


def placed(codes: DataFrame, sent) -> DataFrame:
    """The coded rows, whose distinct words are looked up once for all passes after it: each one's place among the top words (-1:
    it has none) and first subword, and the words that have no place. sent: broadcast (top words, their subwords,
    tokenizer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, enters, tokenizer = sent.value
        first = first_ids(tokenizer)
        for b in batches:
            lists = pc.split_pattern(b.column("words"), " ")  # [""] where there are none
            words, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            place = pc.fill_null(pc.index_in(words, value_set=top), -1).to_numpy()
            other = place < 0
            rare = words.filter(pa.array(other))
            sub = enters[place] if len(enters) else np.zeros(len(place), dtype="<i4")
            sub[other] = first(rare.to_pylist())
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(other)])[ends], pa.int32()), rare)
            each = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "ids", "held", "at", "bounds")), each(place), each(sub), pc.binary_join(rare, " ")], [c.split()[0] for c in PLACED.split(", ")])

    return codes.transform(mapped, run, PLACED)


def parts_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """(held, at, bounds, place) of each row of a placed table, and the columns named besides, as they are."""
    for b in batches:
        for i in range(b.num_rows):
            at, bounds, place = (np.frombuffer(b.column(c)[i].as_buffer(), dtype=t) for c, t in (("at", "<i4"), ("bounds", "<i8"), ("place", "<i4")))
            yield b.column("held")[i].values.to_numpy(zero_copy_only=False), at, bounds, place, *(b.column(c)[i] for c in names)


def summed(codes: DataFrame, run) -> dict[int, np.ndarray]:
    """run: coded rows to (key, vector) of a task; each key's sum over all tasks. There are as many tasks as cores, twice,
    whatever the input, so that what they send does not grow with it."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, v in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.astype("<f4").tobytes()], pa.binary())], ["k", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(v.as_buffer(), dtype="<f4")
                out[k] = out[k] + x if k in out else x.astype(np.float64)
        for k, x in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype("<f4").tobytes()], pa.binary())], ["k", "v"])

    cores = codes.sparkSession.sparkContext.defaultParallelism
    sums = codes.coalesce(2 * cores).transform(mapped, part, "k int, v binary").repartition(cores, "k").transform(mapped, add, "k int, v binary")
    return {r.k: np.frombuffer(r.v, dtype="<f4") for r in sums.collect()}  # some 10 MB


def _clusters(rows: DataFrame, count: np.ndarray) -> np.ndarray:
    """A class for each top word, by the training documents that it occurs in. rows: placed."""
    rng, n, rows = np.random.default_rng(1), len(count), rows.select("held", "at", "bounds", "place")
    x, df = rng.standard_normal((n, SKETCH)), count.astype(np.float64)
    for _ in range(PASSES):
        sent = rows.sparkSession.sparkContext.broadcast((x / np.sqrt(df + 1)[:, None]).astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[tuple]:
            z, out, df = sent.value, np.zeros((n, SKETCH), dtype=np.float32), np.zeros(n, dtype=np.float32)
            kept = np.dtype((np.void, 4 * SKETCH))  # rows as one item each, which numpy copies faster
            out_rows = out.view(kept)[:, 0]
            for held, at, bounds, place in parts_of(batches):
                size, many = np.diff(bounds), len(place)
                kind = np.int32 if len(size) * many < 1 << 31 else np.int64
                pair = np.repeat(np.arange(len(size), dtype=kind) * kind(many), size)
                pair += at
                pair.sort()
                pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
                d = np.repeat(np.arange(len(size)), np.diff(np.searchsorted(pair, np.arange(len(size) + 1, dtype=np.int64) * many)))
                w = pair - d * many
                ok = np.flatnonzero((place >= 0).take(w) & ~held.take(d))
                if not len(ok):
                    continue
                d, w = d.take(ok), w.take(ok)
                degree = np.bincount(d, minlength=len(size))
                some = degree > 0
                y = np.zeros((len(size), SKETCH), dtype=np.float32)
                y[some] = np.add.reduceat(z.take(place.take(w), axis=0), (np.cumsum(degree) - degree)[some], axis=0)
                y /= (degree + 1).astype(np.float32)[:, None]
                # numpy sorts 16 bits by counting
                order = np.argsort(w.astype(np.uint16) if many <= 1 << 16 else w, kind="stable")
                d, w = d.take(order), w.take(order)
                first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                # the words in most texts come first: all words' first texts, then the second ones of those that have them, ...
                times = np.diff(first, append=len(w))
                order = np.argsort(-times, kind="stable")
                first, times = first.take(order), times.take(order)
                sums = y.take(d.take(first), axis=0)
                for j, k in enumerate(np.searchsorted(-times, -np.arange(1, times[0])).tolist(), 1):
                    sums[:k] += y.take(d.take(first[:k] + j), axis=0)
                to = place.take(w.take(first))  # a word stands once in a row's list
                sums += out.take(to, axis=0)
                out_rows[to] = sums.view(kept)[:, 0]
                df[to] += times
            for k in range(0, n, CHUNK):
                if df[k : k + CHUNK].any():
                    yield k // CHUNK, np.column_stack([out[k : k + CHUNK], df[k : k + CHUNK]]).ravel()

        sums = np.zeros((n, SKETCH + 1))
        for k, v in summed(rows, run).items():
            sums[k * CHUNK : (k + 1) * CHUNK] = v.reshape(-1, SKETCH + 1)
        sent.unpersist()
        df = sums[:, SKETCH]
        x = sums[:, :SKETCH] / np.sqrt(df + 1)[:, None]
        last, x = x, np.linalg.qr(x)[0] if n >= SKETCH else x
    x = last / (np.linalg.norm(last, axis=1, keepdims=True) + 1e-12)
    c = x[rng.choice(n, min(CLASSES, n), replace=False)]
    for _ in range(15):
        best = (x @ c.T).argmax(1)
        c = np.column_stack([np.bincount(best, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])])
        c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-12
    return best


def _windows(n: int) -> np.ndarray:
    """First place of each window of a text of n tokens; the last HOP places are scored."""
    return np.arange(0, n, HOP) - HOP


def _forward(net, x, ok):
    """x: (B, 2 HOP) subword ids that stand before each place, ok: places inside the text. Logits of the last HOP."""
    return _logits(net, x, ok)[0].reshape(-1, len(x), HOP).transpose(1, 2, 0)


def _logits(net, x, ok):
    """The same with a row for each class, and what the gradients need."""
    n = len(x)
    h = net["E"].take(x, axis=0)
    h += net["P"]
    here = np.ascontiguousarray(h[:, HOP:]).reshape(-1, WIDTH)
    q = (here @ (net["Q"] * np.float32(WIDTH**-0.5))).reshape(n, HOP, WIDTH)
    kv = (h.reshape(-1, WIDTH) @ np.concatenate([net["K"], net["V"]], axis=1)).reshape(n, 2 * HOP, 2 * WIDTH)
    s, total, a = _attended(q, kv, ok[:, :HOP])
    z, y = _classes(net, here, a)
    return z, (h, here, q, kv, s, total, a, y)


def _hops(net, x, begins):
    """The same logits of hops of HOP places, each looked at after the one before it but where a text begins: so a place is looked up,
    and multiplied, once for both windows that have it. x: subword ids of a hop before the first, and of the hops."""
    n, scaled = len(x) - 1, net["Q"] * np.float32(WIDTH**-0.5)
    e, to = net["E"].take(x, axis=0), np.concatenate([net["K"], net["V"], scaled], axis=1)
    each, place = (e.reshape(-1, WIDTH) @ to).reshape(n + 1, HOP, 3 * WIDTH), net["P"] @ to
    kv, w = np.empty((n, 2 * HOP, 2 * WIDTH), dtype=np.float32), 2 * WIDTH
    np.add(each[:-1, :, :w], place[:HOP, :w], out=kv[:, :HOP])
    np.add(each[1:, :, :w], place[HOP:, :w], out=kv[:, HOP:])
    _, _, a = _attended(each[1:, :, w:] + place[HOP:, w:], kv, np.broadcast_to(~begins[:, None], (n, HOP)))
    return _classes(net, (e[1:] + net["P"][HOP:]).reshape(-1, WIDTH), a)[0]


def _classes(net, here, a):
    y = here + a.reshape(-1, WIDTH) @ net["O"]
    z = net["W"].T @ y.T
    z += net["b"][:, None]
    return z, y


def _attended(q, kv, before):
    """Attention, with a row for each place that is looked at: so its sums go by whole rows. (weights before they are divided by
    their sum, that sum, the means of values). before: which places of the first HOP are inside the text."""
    k, v = kv[:, :, :WIDTH], kv[:, :, WIDTH:]
    s = k @ np.ascontiguousarray(q.transpose(0, 2, 1))
    # what is after a text's end is after all its places, too; what is before its beginning is not
    early = np.flatnonzero(~before.all(1))
    if max(s.max(), -s.min()) > SAFE:
        seen = np.broadcast_to(BEFORE, s.shape).copy()
        seen[early, :HOP] *= before[early, :, None]
        s -= np.where(seen > 0, s, -np.inf).max(1, keepdims=True)
        np.minimum(s, 0, out=s)  # of places that are not looked at
    np.exp(s, out=s)
    s[:, HOP:] *= BEFORE[:, HOP:]
    s[early, :HOP] *= before[early, :, None]
    total = (np.ones((1, 2 * HOP), dtype=np.float32) @ s).reshape(-1, HOP, 1)
    a = s.transpose(0, 2, 1) @ v
    a /= total
    return s, total, a


#: 1 for what a place may look at: not those after it. Up to SAFE, exponentials need no maximum taken off.
BEFORE, SAFE = (np.arange(2 * HOP)[None, :, None] <= np.arange(HOP, 2 * HOP)[None, None, :]).astype(np.float32), 60


def _fresh(n_sub: int, log_share: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(2)
    init = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
    net = {"E": init(n_sub, WIDTH), "P": init(2 * HOP, WIDTH), "Q": init(WIDTH, WIDTH), "K": init(WIDTH, WIDTH), "V": init(WIDTH, WIDTH), "O": init(WIDTH, WIDTH), "W": init(WIDTH, len(log_share))}
    return net | {"b": log_share.astype(np.float32)}


class Adam:
    """Steps on cross-entropy. y: (B, HOP) classes, -1 outside. A place of class RARE is one of UNSEEN by `unseen`."""

    def __init__(self, net: dict[str, np.ndarray], unseen: float = 0.0):
        self.net, self.unseen, self.steps = net, unseen, 0
        self.m, self.r = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))

    def step(self, x, ok, y, rate: float) -> None:
        net, m, r = self.net, self.m, self.r
        g, dh = self._gradients(x, ok, y)
        flat = x.ravel()
        order = np.argsort(flat.astype(np.uint16) if len(net["E"]) <= 1 << 16 else flat, kind="stable")
        ids = flat[order]
        new = np.concatenate([[True], ids[1:] != ids[:-1]])
        ids, rank = ids[new], np.empty(len(flat), dtype=np.int64)
        rank[order] = (np.cumsum(new) - 1) * WIDTH
        ge = np.bincount((rank[:, None] + np.arange(WIDTH)).ravel(), weights=dh.ravel(), minlength=len(ids) * WIDTH)
        ge = ge.astype(np.float32).reshape(-1, WIDTH)
        self.steps += 1
        rate *= min(1, self.steps / 20)
        for p in net:
            gn, mp, rp = (ge, m[p].take(ids, axis=0), r[p].take(ids, axis=0)) if p == "E" else (g[p], m[p], r[p])
            mp *= 0.9
            mp += 0.1 * gn
            rp *= 0.99
            rp += 0.01 * gn * gn
            by = np.float32(rate) * mp / (np.sqrt(rp) + 1e-7)
            if p == "E":
                m[p][ids], r[p][ids] = mp, rp
                net[p][ids] = net[p].take(ids, axis=0) - by
            else:
                net[p] -= by

    def _gradients(self, x, ok, y) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Those of all weights but E, and of the inputs."""
        net, n = self.net, len(x)
        d, (h, last, q, kv, s, total, a, out) = _logits(net, x, ok)
        d -= d.max(0)
        np.exp(d, out=d)
        flat = y.ravel()
        here = np.flatnonzero(flat >= 0)
        each = ((flat >= 0) / np.float32(max(1, len(here)))).astype(np.float32)  # what a place counts
        d *= each / d.sum(0)
        d[flat[here], here] -= each[here]
        if self.unseen:
            rare = np.flatnonzero(flat == RARE)
            d[RARE, rare] += each[rare] * np.float32(self.unseen)
            d[UNSEEN, rare] -= each[rare] * np.float32(self.unseen)
        dy = d.T @ net["W"].T
        da = (dy @ net["O"].T).reshape(n, HOP, WIDTH)
        da /= total
        dkv = np.empty_like(kv)
        np.matmul(s, da, out=dkv[:, :, WIDTH:])
        ds = kv[:, :, WIDTH:] @ np.ascontiguousarray(da.transpose(0, 2, 1))
        ds -= np.einsum("ijk,ijk->ij", da, a)[:, None, :]
        ds *= s
        # q is scaled already
        np.matmul(ds, q, out=dkv[:, :, :WIDTH])
        dq = (ds.transpose(0, 2, 1) @ kv[:, :, :WIDTH]).reshape(-1, WIDTH) * np.float32(WIDTH**-0.5)
        dkv = dkv.reshape(-1, 2 * WIDTH)
        dh = (dkv @ np.concatenate([net["K"], net["V"]], axis=1).T).reshape(n, 2 * HOP, WIDTH)
        g = {"O": a.reshape(-1, WIDTH).T @ dy, "W": (d @ out).T, "b": d.sum(1), "Q": last.T @ dq}
        both = (h.transpose(0, 2, 1) @ dkv.reshape(n, 2 * HOP, 2 * WIDTH)).sum(0)
        g["K"], g["V"] = both[:, :WIDTH], both[:, WIDTH:]
        dh[:, HOP:] += (dy + dq @ net["Q"].T).reshape(n, HOP, WIDTH)
        return g | {"P": dh.sum(0)}, dh


def _train(xs: np.ndarray, oks: np.ndarray, ys: np.ndarray, n_sub: int, n_out: int) -> dict[str, np.ndarray]:
    """STEPS of Adam on windows at hand."""
    f = np.bincount(ys[ys >= 0], minlength=n_out) + 1.0
    rng, adam = np.random.default_rng(3), Adam(_fresh(n_sub, np.log(f / f.sum())))
    for step in range(STEPS):
        i = rng.choice(len(xs), min(BATCH, len(xs)), replace=False)
        adam.step(xs[i], oks[i], ys[i], RATE * (1 - (step + 1) / (STEPS + 1)))
    return adam.net


DENSE = ("P", "Q", "K", "V", "O", "W", "b")


def _round(rows: DataFrame, sent, net: dict[str, np.ndarray], lo: int, hi: int, n_windows: int, rates: tuple[float, float], unseen: float) -> dict[str, np.ndarray]:
    """The mean of the weights that tasks reach from `net` on their documents of pieces lo to hi, by their places; a subword's
    vector is the mean by its places. sent: broadcast target class of each top word. rows: placed."""
    spark = rows.sparkSession
    start = spark.sparkContext.broadcast(net)
    # few windows: one task, which goes over them more than once
    tasks = min(2 * spark.sparkContext.defaultParallelism, max(1, n_windows // (STEPS * BATCH)))
    expected = max(1, n_windows * (hi - lo) // PIECES)
    epochs = max(1, math.ceil(STEPS * BATCH * (hi - lo) / PIECES / expected))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        target = np.append(sent.value, RARE)  # that of place -1 comes last
        adam = Adam({k: v.copy() for k, v in start.value.items()}, unseen)
        uses = np.zeros(len(adam.net["E"]), dtype=np.float64)
        rng, held_back, steps = np.random.default_rng(4), [], max(1, expected * epochs // (tasks * BATCH))

        def learn(parts: list, whole: bool) -> list:
            x, ok, y = (np.concatenate(c) for c in zip(*parts, strict=True))
            i = rng.permutation(len(x))
            n = len(i) if whole else len(i) // BATCH * BATCH
            for k in range(0, n, BATCH):
                j = i[k : k + BATCH]
                adam.step(x[j], ok[j], y[j], rates[0] + (rates[1] - rates[0]) * min(1.0, adam.steps / steps))
            uses[:] += np.bincount(x[i[:n]].ravel(), minlength=len(uses))
            return [(x[i[n:]], ok[i[n:]], y[i[n:]])] if n < len(i) else []

        for held, at, bounds, place, row, sub in parts_of(batches, "row", "sub"):
            size = np.diff(bounds)
            piece = (((row.as_py() + np.arange(len(size)) * 1_000_003 + 12345) * 2_654_435_761) >> 16) % PIECES
            mine = ~held & (piece >= lo) & (piece < hi)
            if not mine.any():
                continue
            used = at[np.repeat(mine, size)]
            part = _windowed(np.frombuffer(sub.as_buffer(), dtype="<i4")[used], target[place[used]], size[mine])
            for _ in range(epochs - 1):
                learn([part], True)
            held_back.append(part)
            if sum(len(p[0]) for p in held_back) >= 20 * BATCH:
                held_back = learn(held_back, False)
        if held_back:
            learn(held_back, True)
        if adam.steps:
            yield -1, np.concatenate([*(adam.net[k].ravel() for k in DENSE), [1]]) * uses.sum()
            both = np.column_stack([adam.net["E"] * uses[:, None], uses])
            for k in range(0, len(both), CHUNK):
                if uses[k : k + CHUNK].any():
                    yield k // CHUNK, both[k : k + CHUNK].ravel()

    got = summed(rows.select("held", "at", "bounds", "place", "row", "sub").coalesce(tasks), run)
    start.unpersist()
    out = {k: v.copy() for k, v in net.items()}
    if -1 in got:
        mean, n = got[-1][:-1] / got[-1][-1], 0
        for k in DENSE:
            out[k] = mean[n : n + net[k].size].reshape(net[k].shape).astype(np.float32)
            n += net[k].size
    for k, v in got.items():
        if k >= 0:
            v = v.reshape(-1, WIDTH + 1)
            used = np.flatnonzero(v[:, WIDTH])
            out["E"][k * CHUNK + used] = v[used, :WIDTH] / v[used, WIDTH:]
    return out


def top_words(counts: DataFrame) -> list:
    """The words whose counts are in the highest buckets (of a count's three leading bits) that hold at most TOP_WORDS
    words together. A sort's limit would send as many rows from each partition to the driver."""
    low = F.greatest(F.length(F.bin("c")) - 3, F.lit(0))
    bucket = F.call_function("shiftleft", F.call_function("shiftright", F.col("c"), low), low)
    left, least = TOP_WORDS, None
    for r in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy(F.col("b").desc()).collect():  # some 200 buckets
        left -= r.n
        if left < 0:
            break
        least = r.b
    top = counts.filter(F.col("c") >= least).collect() if least is not None else []
    return sorted(top, key=lambda r: (-r.c, r.word))


def train(docs: DataFrame, counts: DataFrame, tokenizer: str, codes: DataFrame | None = None) -> Model:
    """docs: training documents; counts: stored; codes: the coded table that has them, stored, if there is one."""
    model, rows = fitted(codes or stored(coded(docs, F.lit(False)), "codes"), counts, tokenizer)
    forget(rows)
    return model


def fitted(codes: DataFrame, counts: DataFrame, tokenizer: str) -> tuple[Model, DataFrame]:
    """The model, and the placed table, stored, that it was fitted on."""
    spark = codes.sparkSession
    all_ = codes.agg(F.sum("learned").alias("docs"), F.sum("windows").alias("windows")).first()
    n_docs, n_windows = int(all_.docs or 0), int(all_.windows or 0)
    t = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("once")).first()
    top = top_words(counts)
    index = {r.word: i for i, r in enumerate(top)}
    first = first_ids(tokenizer)
    enters = np.array(first([r.word for r in top]), dtype=np.int64)
    n_sub = first.tokenizer.get_vocab_size() + 1
    count = np.array([r.c for r in top], dtype=np.int64)
    sent = spark.sparkContext.broadcast((pa.array(list(index), pa.string()), enters.astype("<i4"), tokenizer))  # TOP_WORDS words at most
    rows = stored(placed(codes, sent), "placed")
    sent.unpersist()
    cls = _clusters(rows, count) if len(top) else np.zeros(0, dtype=np.int64)
    total = np.bincount(cls, weights=count + 0.1, minlength=CLASSES) if len(cls) else np.zeros(CLASSES)
    share = np.log((count + 0.1) / total[cls]) if len(cls) else np.zeros(0)
    # what each word would be if it were not there itself
    target = np.where(count > 1, cls, UNSEEN)
    beyond = int(t.n or 0) - int(count.sum())
    unseen = int(t.once or 0) / beyond if beyond else 0.0  # words with a count of 1 are all among the top ones, or none
    net = {}
    if n_docs:
        f = np.bincount(target, weights=count, minlength=CLASSES + 3) + 1.0
        f[END] += n_docs
        f[RARE], f[UNSEEN] = f[RARE] + beyond * (1 - unseen), f[UNSEEN] + beyond * unseen
        net = _fresh(n_sub, np.log(f / f.sum()))
        sent, lo = spark.sparkContext.broadcast(target), 0
        for i, (hi, rate) in enumerate(ROUNDS):
            net = _round(rows, sent, net, lo, hi, n_windows, (rate, ROUNDS[i + 1][1] if i + 1 < len(ROUNDS) else 0.0), unseen)
            lo = hi
        sent.unpersist()
    return Model(int(t.n or 0) + n_docs, t.v + (n_docs > 0), n_docs, index, count, cls.astype(np.int16), enters.astype(np.int32), share, net, tokenizer), rows


def _laid(x: np.ndarray, y: np.ndarray):
    """Windows of a text: inputs, which are inside, targets of the last HOP places."""
    i = _windows(len(x))[:, None] + np.arange(2 * HOP)[None, :]
    ok = (i >= 0) & (i < len(x))
    i = np.where(ok, i, 0)
    return x[i].astype(np.int32), ok, np.where(ok[:, HOP:], y[i[:, HOP:]], -1).astype(np.int32)


def _joined(sub: np.ndarray, cls: np.ndarray, sizes: np.ndarray):
    """Texts one after the other, each with its end, of the subwords and classes of their words: what stands before each
    place, its target, the words' places; each text's first place and length, each window's text and first place in it."""
    n, size = len(sizes), sizes + 1
    first = np.cumsum(size) - size
    x, y = np.full(size.sum(), START, dtype=np.int32), np.full(size.sum(), END, dtype=np.int32)
    where = np.arange(len(sub)) + np.repeat(np.arange(n), sizes)
    x[where + 1], y[where] = sub, cls
    per = -(-size // HOP)
    doc = np.repeat(np.arange(n), per)
    return x, y, where, first, size, doc, (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * HOP - HOP


def _windowed(sub: np.ndarray, cls: np.ndarray, sizes: np.ndarray):
    """What _laid gives, for texts one after the other, of words alone: their subwords and classes."""
    x, y, _, first, size, doc, start = _joined(sub, cls, sizes)
    i = start[:, None] + np.arange(2 * HOP)[None, :]
    ok = (i >= 0) & (i < size[doc][:, None])
    i = np.where(ok, i, 0) + first[doc][:, None]
    return x[i], ok, np.where(ok[:, HOP:], y[i[:, HOP:]], -1)


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<struct<word:string,n:long,rare:double,unseen:double>>"


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """One pass over the placed table: the model's score and the base score but for rare words, which are listed: how often each occurs,
    and the log probabilities at its places of the two classes that it may have."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # TOP_WORDS words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = sent.value
        row = TaskContext.get().partitionId() << 40
        den = math.log10(m.n_tokens + 0.1 * (m.n_types + 1))
        log_c = np.log10(m.count + 0.1)
        end_base = math.log10(m.ends + 0.1) - den
        for held, at, bounds, place, ids, sub, rare in parts_of(batches, "ids", "sub", "rare"):
            n, top = len(bounds) - 1, place >= 0
            logp, cls, base = np.zeros(len(place)), np.full(len(place), RARE), np.zeros(len(place))
            logp[top], cls[top], base[top] = m.share[place[top]], m.cls[place[top]], log_c[place[top]] - den
            doc = np.repeat(np.arange(n), np.diff(bounds))
            bases = np.bincount(doc, weights=base[at], minlength=n) + end_base
            known = np.bincount(doc, weights=top[at], minlength=n).astype(np.int64) + (m.ends > 0)
            x, y, where, first, size, wd, ws = _joined(np.frombuffer(sub.as_buffer(), dtype="<i4")[at], cls[at], np.diff(bounds))
            own, unseen = np.zeros(len(x)), np.zeros(len(x))
            if m.net:
                for k in range(0, len(wd), BATCH):
                    d, begins = wd[max(0, k - 1) : k + BATCH], ws[k : k + BATCH] < 0
                    i = ws[max(0, k - 1) : k + BATCH, None] + np.arange(HOP, 2 * HOP)
                    ok = i < size[d][:, None]
                    i = np.minimum(i + first[d][:, None], len(x) - 1)  # what is after a text's end is after all its places
                    z = _hops(m.net, x[i if k else np.concatenate([i[:1], i])], begins)
                    i, here = i[-len(begins) :].ravel(), np.flatnonzero(ok[-len(begins) :])
                    z -= z.max(0)
                    it, new = z[y[i], np.arange(len(i))], z[UNSEEN].copy()
                    total = np.log(np.exp(z, out=z).sum(0))
                    own[i[here]], unseen[i[here]] = (it - total)[here], (new - total)[here]
            # rare words of each text
            is_rare = ~top[at]
            pair, back, times = np.unique(doc[is_rare].astype(np.int64) << 32 | at[is_rare], return_inverse=True, return_counts=True)
            sums = [np.bincount(back, weights=v[where[is_rare]], minlength=len(pair)) / math.log(10) for v in (own, unseen)]
            own[where[is_rare]] = 0
            scores = np.bincount(np.repeat(np.arange(n), size), weights=own, minlength=n) + np.bincount(doc, weights=logp[at], minlength=n)
            words = pa.array((rare.as_py() or "").split(" "), pa.string())
            names = words.take(pa.array((np.cumsum(~top) - 1)[pair & 0xFFFFFFFF]))
            offsets = np.searchsorted(pair >> 32, np.arange(n + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([names, pa.array(times, pa.int64()), *map(pa.array, sums)], ["word", "n", "rare", "unseen"]))
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), ids.values, pa.array(held), pa.array(size), pa.array(known), pa.array(bases), pa.array(scores / math.log(10)), lists], [c.split()[0] for c in SCORED.split(", ")[:7]] + ["rare"])
            row += n

    return rows.transform(mapped, run, SCORED)


def score(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    codes = stored(coded(docs, held_out(F.col("doc_id"))), "codes")
    counts = stored(counted(codes), "counts")
    model, places = fitted(codes, counts, tokenizer or tokenizer_path())
    forget(codes)
    rows = stored(scored(places, model), "scored")
    forget(places)
    den = math.log10(model.n_tokens + 0.1 * (model.n_types + 1))
    # the counts of all words but the top ones
    rest = math.log10(max(1e-9, model.n_tokens - model.ends - int(model.count.sum()) + 0.1 * (model.n_types - (model.ends > 0) - len(model.count))))
    known = F.col("c") > 0
    rare = rows.select("row", F.explode("rare").alias("x")).select("row", "x.*").join(counts, "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 0.1) - den)).alias("more"),
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("seen"),
        F.sum(F.when(known, F.col("rare") + F.col("n") * (F.log10(F.col("c") + 0.1) - rest)).otherwise(F.col("unseen"))).alias("own"),
    )
    out = rows.drop("rare").join(rare, "row", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("own", F.lit(0.0)) if model.net else base).alias("score"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES, ORACLE = {"op5_lm": op5_lm}, {}
