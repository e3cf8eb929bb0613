"""Erasure coding of equally long blocks: none, XOR, or systematic Reed-Solomon over GF(256)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F


def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(512, dtype=np.int32), np.zeros(256, dtype=np.int32), 1
    for i in range(255):
        exp[i], log[x] = x, i
        x = (x << 1) ^ (0x11D if x & 0x80 else 0)
    exp[255:510] = exp[:255]
    return exp, log


EXP, LOG = _tables()


def gmul(a, b):
    a, b = np.asarray(a), np.asarray(b)
    return np.where((a == 0) | (b == 0), 0, EXP[LOG[a] + LOG[b]]).astype(np.uint8)


def ginv(a: int) -> int:
    return int(EXP[255 - LOG[a]])


#: All products: a row for each factor.
PRODUCT = gmul(np.arange(256)[:, None], np.arange(256)[None, :])


class Coder:
    """k data lanes, m parity lanes. Cauchy rows: any k of the k + m lanes give the rest back."""

    def __init__(self, k: int, m: int):
        if k < 1 or m < 0 or k + m > 255:
            raise ValueError("k >= 1, m >= 0 and k + m <= 255 are required")
        self.k, self.m = k, m
        if m == 1:
            self.rows = np.ones((1, k), dtype=np.uint8)
        else:
            self.rows = np.array([[ginv((k + j) ^ i) for i in range(k)] for j in range(m)], dtype=np.uint8).reshape(m, k)

    def encode(self, data: list[bytes]) -> list[bytes]:
        return [b.tobytes() for b in self._apply(self.rows, [np.frombuffer(d, dtype=np.uint8) for d in data])]

    @staticmethod
    def _apply(rows, lanes):
        """Each row's sum of the lanes; a lane is one block or equally long blocks of many stripes."""
        out = []
        for r in rows:
            acc = np.zeros_like(lanes[0])
            for c, d in zip(r, lanes, strict=True):
                if c:
                    acc ^= d if c == 1 else PRODUCT[c][d]
            out.append(acc)
        return out

    def inverse(self, have: list[int]) -> np.ndarray:
        """The rows that give the data lanes from these k lanes."""
        full = np.vstack([np.eye(self.k, dtype=np.uint8), self.rows]) if self.m else np.eye(self.k, dtype=np.uint8)
        a, b = full[have].copy(), np.eye(self.k, dtype=np.uint8)
        for i in range(self.k):  # Gauss-Jordan
            p = next(r for r in range(i, self.k) if a[r, i])
            a[[i, p]], b[[i, p]] = a[[p, i]], b[[p, i]]
            f = ginv(int(a[i, i]))
            a[i], b[i] = gmul(a[i], f), gmul(b[i], f)
            for r in range(self.k):
                if r != i and (c := int(a[r, i])):
                    a[r] ^= gmul(a[i], c)
                    b[r] ^= gmul(b[i], c)
        return b

    def lost(self, n: int) -> ValueError:
        return ValueError(f"{n} lanes are lost; {self.m} is the most")

    def reconstruct(self, lanes: list[bytes | None]) -> list[bytes]:
        """All k + m lanes; None marks a lost one."""
        have = [i for i, x in enumerate(lanes) if x is not None]
        if len(have) < self.k:
            raise self.lost(len(lanes) - len(have))
        have = have[: self.k]
        data = [d.tobytes() for d in self._apply(self.inverse(have), [np.frombuffer(lanes[i], dtype=np.uint8) for i in have])]
        return data + self.encode(data)


#: Bytes of the stripes that are computed at once, where one stripe does not have more.
PART_BYTES = 8 << 20


def _whole_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches sorted by stripe, cut between stripes, each with its stripes' numbers of rows."""
    held = None
    for b in batches:
        if b.num_rows:
            b = b if held is None else pa.concat_batches([held, b])
            starts = _starts(b)
            if last := int(starts[-1]):
                yield b.slice(0, last), np.diff(starts)
            held = b.slice(last)
    if held is not None:
        yield held, np.array([held.num_rows])


def _starts(b: pa.RecordBatch) -> np.ndarray:
    of = b.column("stripe").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])


def _lengths(blocks: pa.Array) -> np.ndarray:
    return pc.binary_length(blocks).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _to_bytes(blocks: pa.Array, width: int) -> np.ndarray:
    """A row of bytes for each block, zeros at its end."""
    blocks = blocks.cast(pa.large_binary())
    ends = np.frombuffer(blocks.buffers()[1], dtype=np.int64)[blocks.offset : blocks.offset + len(blocks) + 1]
    flat = np.frombuffer(blocks.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    out = np.zeros((len(blocks), width), dtype=np.uint8)
    out[np.arange(width) < np.diff(ends)[:, None]] = flat
    return out


def _to_blocks(rows: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = rows[np.arange(rows.shape[1]) < lengths[:, None]]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).cast(kind)


def _parts(widths: np.ndarray, lanes: int) -> Iterator[np.ndarray]:
    """The numbers of stripes that are computed together: widths within a factor of two, PART_BYTES."""
    size = np.ceil(np.log2(np.maximum(widths, 1)))
    for c in np.unique(size):
        ids = np.flatnonzero(size == c)
        step = max(1, PART_BYTES // (lanes << int(c)))
        for i in range(0, len(ids), step):
            yield ids[i : i + step]


def _by_stripe(df, run, schema: str):
    """Each task has whole stripes, sorted, and computes many at once: no call, and no group of Spark's, for each."""
    return df.repartition("stripe").sortWithinPartitions("stripe", F.col("lane").asc_nulls_last()).mapInArrow(run, schema)


def _rows(stripe: pa.Array, ids: np.ndarray, lanes: np.ndarray, widths: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """Lanes (stripes, lanes, bytes) as rows stripe, lane, block."""
    n, of, w = lanes.shape
    out = [stripe.take(pa.array(np.repeat(ids, of))), pa.array(np.tile(np.arange(of, dtype=np.int32), n)), _to_blocks(lanes.reshape(n * of, w), np.repeat(widths, of), kind)]
    return pa.RecordBatch.from_arrays(out, ["stripe", "lane", "block"])


def encode_stripes(df, k: int, m: int):
    """Rows (stripe, lane int, block binary) to the same with m parity lanes more, and each block's CRC32."""
    coder, kind = Coder(k, m), df.schema["stripe"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, counts in _whole_stripes(batches):
            blocks, first = b.column("block"), np.cumsum(counts) - counts
            if blocks.null_count or counts.max() > k:
                raise ValueError(f"a stripe has {k} blocks at most, and none is null")
            stripe, place = b.column("stripe").take(pa.array(first)), np.arange(b.num_rows) - np.repeat(first, counts)
            widths = np.maximum.reduceat(_lengths(blocks), first)
            for ids in _parts(widths, k + m):
                w, n = int(widths[ids].max()), counts[ids]
                at = np.repeat(first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                lanes = np.zeros((len(ids), k + m, w), dtype=np.uint8)
                lanes[np.repeat(np.arange(len(ids)), n), place[at]] = _to_bytes(blocks.take(pa.array(at)), w)
                for j, p in enumerate(coder._apply(coder.rows, [lanes[:, i] for i in range(k)])):
                    lanes[:, k + j] = p
                yield _rows(stripe, ids, lanes, widths[ids], blocks.type)

    return _by_stripe(df.select("stripe", "lane", "block"), run, f"stripe {kind}, lane int, block binary").withColumn("crc", F.crc32("block"))


def recover_stripes(df, k: int, m: int):
    """Rows (stripe, lane, block, crc) to all data lanes. Lanes that are missing, null, or that do not have their CRC32
    (where there is one) are erasures; more than m of them in a stripe are an error."""
    coder, kind = Coder(k, m), df.schema["stripe"].dataType.simpleString()
    whole = F.col("crc").isNull() | (F.crc32("block") == F.col("crc")) if "crc" in df.columns else F.lit(True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, counts in _whole_stripes(batches):
            stripe = b.column("stripe").take(pa.array(np.cumsum(counts) - counts))
            lane, of = b.column("lane").to_numpy(zero_copy_only=False), np.repeat(np.arange(len(counts)), counts)
            if b.column("lane").null_count or lane.min() < 0 or lane.max() >= k + m:
                raise ValueError(f"lanes are 0 to {k + m - 1}")
            there = np.flatnonzero(b.column("block").is_valid().to_numpy(zero_copy_only=False))
            have = np.zeros((len(counts), k + m), dtype=bool)
            have[of[there], lane[there]] = True
            if (n := have.sum(axis=1).min()) < k:
                raise coder.lost(k + m - n)
            # the first k lanes of a stripe give all
            used = np.sort(np.argsort(~have, axis=1, kind="stable")[:, :k], axis=1).astype(np.uint8)
            have &= np.cumsum(have, axis=1) <= k
            there = there[have[of[there], lane[there]]]
            blocks, lane, of = b.column("block").take(pa.array(there)), lane[there], of[there]
            n = np.bincount(of)
            first, lengths = np.cumsum(n) - n, _lengths(blocks)
            widths = np.maximum.reduceat(lengths, first)
            if (lengths != widths[of]).any():
                raise ValueError("the blocks of a stripe have different lengths")
            for ids in _parts(widths, k + m):
                w, c = int(widths[ids].max()), n[ids]
                at = np.repeat(first[ids] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                lanes = np.zeros((len(ids), k + m, w), dtype=np.uint8)
                lanes[np.repeat(np.arange(len(ids)), c), lane[at]] = _to_bytes(blocks.take(pa.array(at)), w)
                data = np.empty((len(ids), k, w), dtype=np.uint8)
                kinds, which = np.unique(used[ids], axis=0, return_inverse=True)
                for i, h in enumerate(kinds):
                    same = np.flatnonzero(which.ravel() == i)
                    data[same] = np.stack(coder._apply(coder.inverse(list(h)), [lanes[same, j] for j in h]), axis=1)
                yield _rows(stripe, ids, data, widths[ids], blocks.type)

    return _by_stripe(df.select("stripe", F.col("lane").cast("int").alias("lane"), F.when(whole, F.col("block")).alias("block")), run, f"stripe {kind}, lane int, block binary")
