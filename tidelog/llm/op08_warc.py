"""WARC archives with a two-level capture index.

Archives: one file per partition of the writing job, one gzip member per record. Records with equal payloads
(of at least `least` bytes) are one response, that with the largest page_id, and revisits that refer to it.
Index: capture lines sorted by the reversed-host key of their url and by page_id, `BLOCK_LINES` of them to a compressed
block. Each task that writes blocks has a range of keys, and beside its blocks a sparse directory: each block's first
key and byte range. A table with one row for each task names the directories. A look-up bisects the tasks, bisects
the one directory that it needs, reads one block or more by range, and then the record's range of its archive. The
query looks up every page in this way: its look-ups are dealt by key, so that a task reads each block once.

Files go to the shared folder under names of their own for each attempt; the tables name only files of tasks
that were committed, so a lost executor or a second attempt leaves, at worst, a file that nothing names.

Defined results: null html is an empty payload; null urls sort first; null page_ids count as smaller than all,
and one of them is a response only among records that all have none; rows that repeat the largest page_id (ties) are
all responses, and have one record id; nulls in other columns and extra columns of any name change nothing; a payload
of any length is one record, in memory alone; an empty table has an empty archive.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import fresh, mapped, open_fs, stored, table

BLOCK_LINES, LEAST_BYTES, NO_PAGE = 1000, 0, -(1 << 63)
PIECE = 64 << 20  # bytes of an archive whose records one task reads
CAPTURE = "key string, page_id long, kind string, refers_to long, digest string, bytes long, file string, at long, size long"


@dataclass
class Archive:
    root: str
    captures: DataFrame  # stored
    tasks: DataFrame  # stored: first and last (key, page_id) of each task that wrote blocks, and its files' name


def host_key(url: str | None) -> str:
    """Reversed host, then path and query: ``com,example,www)/a?b``."""
    rest = (url or "").partition("://")[2] or (url or "")
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def uri(url: str) -> str:
    """What would end a header's line, percent-encoded."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", *([] if url is None else [f"WARC-Target-URI: {uri(url)}"]), f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> dict:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda s: int(s) if (s := h.get(s, "").removeprefix("<urn:page:").removesuffix(">")) else None
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {h['WARC-Record-ID']} is broken")
    return {"page_id": number("WARC-Record-ID"), "url": h.get("WARC-Target-URI"), "kind": h["WARC-Type"], "refers_to": number("WARC-Refers-To"), "digest": digest, "bytes": size, "payload": payload}


def base32_sha1(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def planned(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html and for revisits refers_to. The plan is made of ids and digests alone; html is
    shuffled once, by page_id, so that no group of equal payloads meets in one task."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    digests = base.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("n")).filter(F.col("n") >= least)
    groups = digests.groupBy("sha").agg(F.max("page_id").alias("best"), F.count("*").alias("k")).filter("k > 1").select("sha", "best")
    plan = digests.join(groups, "sha").filter("best IS NOT NULL AND NOT page_id <=> best").select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "best").distinct()
    on = F.col("page_id").eqNullSafe(F.col("_id")) & (F.sha1(F.col("html").cast("binary")) == F.col("_sha"))
    return base.join(plan.hint("shuffle_merge"), on, "left").select("page_id", "url", "html", F.col("best").alias("refers_to"))


def _capture_batch(rows) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in CAPTURE.split(", ")])


def write(pages: DataFrame, least: int = LEAST_BYTES) -> Archive:
    spark = pages.sparkSession
    root = fresh(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        fs.create_dir(base, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for b in batches:
                rows = []
                for page_id, url, html, ref in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                    payload = html.encode()
                    kind, digest = "response" if ref is None else "revisit", base32_sha1(payload)
                    r = record(page_id, url, payload, digest, kind, ref)
                    out.write(r)
                    rows.append((host_key(url), page_id, kind, ref, digest, len(payload), name, at, len(r)))
                    at += len(r)
                yield _capture_batch(rows)
        finally:
            if out:
                out.close()

    captures = stored(planned(pages, least).transform(mapped, run, CAPTURE), "captures")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        name, out, at, listed, held, last = uuid.uuid4().hex, None, 0, [], [], None

        def close_block():
            nonlocal out, at, held, last
            out = out or fs.open_output_stream(f"{base}/{name}.cdx.gz", compression=None)
            z = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
            out.write(z)
            listed.append((*_place(held[0]), at, len(z)))
            at, held, last = at + len(z), [], _place(held[-1])

        try:
            for b in batches:
                for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held.append(x)
                    if len(held) == BLOCK_LINES:
                        close_block()
            if held:
                close_block()
        finally:
            if out:
                out.close()
        if listed:
            with fs.open_output_stream(f"{base}/{name}.dir.gz", compression=None) as f:
                f.write(zlib.compress(json.dumps(listed).encode(), 6))
            yield pa.RecordBatch.from_pylist([{"key": listed[0][0], "page": listed[0][1], "last_key": last[0], "last_page": last[1], "file": name, "blocks": len(listed)}], schema=pa.schema([("key", pa.string()), ("page", pa.int64()), ("last_key", pa.string()), ("last_page", pa.int64()), ("file", pa.string()), ("blocks", pa.int64())]))

    # the row's place breaks ties: a hot host is cut by its paths, and a hot url by its records
    ordered = captures.repartitionByRange("key", "page_id", "file", "at").sortWithinPartitions("key", "page_id", "file", "at")
    tasks = stored(ordered.transform(mapped, blocks, "key string, page long, last_key string, last_page long, file string, blocks long"), "tasks")
    return Archive(root, captures, tasks)


def _place(capture) -> tuple[str, int]:
    """What captures are sorted by: the key, and the page_id, null before all."""
    return capture[0], NO_PAGE if capture[1] is None else capture[1]


class Index:
    """Look-ups by bisection: in the list of tasks, in a task's directory, in a block. It holds one directory and one
    block, so that look-ups in the order of keys read each of them once."""

    def __init__(self, root: str, tasks: list[tuple]):
        self.fs, self.base = open_fs(root)
        self.tasks = sorted(tasks)
        self.firsts = [t[:2] for t in self.tasks]
        self.held: dict[str, tuple] = {}

    def _directory(self, file: str) -> tuple[list, list]:
        if self.held.get("dir", (None,))[0] != file:
            with self.fs.open_input_file(f"{self.base}/{file}.dir.gz") as f:
                d = json.loads(zlib.decompress(f.read()))
            self.held["dir"] = file, (d, [tuple(x[:2]) for x in d])
        return self.held["dir"][1]

    def _block(self, file: str, at: int, size: int) -> tuple[list, list]:
        if self.held.get("block", (None,))[0] != (file, at):
            raw = zlib.decompress(next(_ranges(self.fs, self.base, f"{file}.cdx.gz", [(at, size)]))).decode()
            lines = [json.loads(x) for x in raw.split("\n")]
            self.held["block"] = (file, at), (lines, [_place(x) for x in lines])
        return self.held["block"][1]

    def captures(self, least: tuple[str, int], most: tuple[str, int]) -> Iterator[list]:
        """Capture lines from one place to another, both included."""
        t = max(0, bisect.bisect_left(self.firsts, least) - 1)
        for first, last, file in ((x[:2], x[2:4], x[4]) for x in self.tasks[t:]):
            if first > most:
                return
            if last < least:
                continue
            d, firsts = self._directory(file)
            for _, _, at, size in d[max(0, bisect.bisect_left(firsts, least) - 1) : bisect.bisect_right(firsts, most)]:
                lines, places = self._block(file, at, size)
                yield from lines[bisect.bisect_left(places, least) : bisect.bisect_right(places, most)]


def _ranges(fs, base, file, spans: list[tuple[int, int]]) -> Iterator[bytes]:
    with fs.open_input_file(f"{base}/{file}") as f:
        for at, size in spans:
            yield f.read_at(size, at)


def _tasks(archive: Archive) -> list[tuple]:
    """One row for each task that wrote blocks: as many as the range partitioning has parts."""
    return [tuple(r) for r in archive.tasks.select("key", "page", "last_key", "last_page", "file").collect()]


def records_of(archive: Archive, pages: DataFrame) -> DataFrame:
    """The records of the given pages (page_id, url), each by a look-up in the index and a range of its archive."""
    root, tasks = archive.root, _tasks(archive)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([host_key(u) for u in b.column(0).to_pylist()], pa.string()), b.column(1)], ["key", "page"])

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(root, tasks)
        for b in batches:
            got = [x for at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in index.captures(at, at)]
            if got:
                yield _capture_batch(got)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        kinds = {"page_id": pa.int64(), "bytes": pa.int64(), "digest": pa.string(), "kind": pa.string(), "refers_to": pa.int64(), "url": pa.string()}
        for b in batches:
            by: dict[str, list[tuple[int, int]]] = {}
            for f, at, size in zip(*(b.column(n).to_pylist() for n in ("file", "at", "size")), strict=True):
                by.setdefault(f, []).append((at, size))
            for f, spans in by.items():
                got = [{k: v for k, v in parse(m).items() if k != "payload"} for m in _ranges(fs, base, f, sorted(spans))]
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in kinds.items()], list(kinds))

    asked = pages.select("url", F.coalesce(F.col("page_id").cast("long"), F.lit(NO_PAGE)).alias("page")).transform(mapped, keyed, "key string, page long").distinct()
    found = asked.repartitionByRange("key", "page").sortWithinPartitions("key", "page").transform(mapped, seek, CAPTURE)
    # each archive's records together and in order: a task reads its files from front to back
    spread = found.repartition(F.col("file"), F.floor(F.col("at") / PIECE)).sortWithinPartitions("file", "at")
    return spread.transform(mapped, records, "page_id long, bytes long, digest string, kind string, refers_to long, url string")


def look_up(archive: Archive, urls: list[str]) -> list[dict]:
    """The records of a few urls, whichever page they are of, with their payloads."""
    index, out = Index(archive.root, _tasks(archive)), []
    for url in urls:
        for x in index.captures((host_key(url), NO_PAGE), (host_key(url), (1 << 63) - 1)):
            out += [parse(m) for m in _ranges(index.fs, index.base, x[6], [(x[7], x[8])])]
    return out


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    r = records_of(write(pages), pages)
    return r.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


_V = "CAST('0x' || substr(h, {}, 5) AS INTEGER)"
_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_V.format(5 * i + 1)} >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
QUERIES = {"op8_warc": op8_warc}
ORACLE = {
    "op8_warc": f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM p)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_B32} AS payload_digest, CASE WHEN best IS NULL OR page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to FROM q"""
}
