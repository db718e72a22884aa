"""WARC archives: write pages as records, and read archives by verified record boundaries.

Reading: archives are cut into blocks. A task finds the record magic anywhere in its block, also
inside payloads, and parses each candidate's header for where the next record must start. Candidates
of a block are linked to their successors and followed to the first offset beyond the block by
pointer jumping in the task; across blocks, pointer jumping on tables doubles the distance each
round, from the start of every file. Only offsets reached are records: each block is then read
from its verified entry. Magic inside a payload is never reached, since no chain from the file's
start leads to it.

Writing: one record per page; a payload of at least ``least`` bytes that equals that of a page with
a smaller page_id becomes a revisit of the smallest. Payloads that a bitmap shows to be unrepeated
are written where they are read. Of the others, digests and ids are joined without the payloads;
then only the payloads that are written move, one for a group of equal ones. Files are written under
a temporary name and moved, so that a task that runs again replaces its own output.

Edge cases: a null html is an empty payload; a null url has no target header; rows that share the
smallest page_id of a payload are all responses; a null page_id is a response only where no row with
its payload has an id; broken or truncated archives give the records before the break; an empty
table writes no file; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from itertools import takewhile
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, scratch, shared_root, split_by, task_id, written

BLOCK = 16 << 20
#: How much is read at first for a header; reads grow until its blank line is found.
HEADER = 64 << 10
LEAST = 100
BLANK = b"\r\n\r\n"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*\r\n", re.I)
_FIELD = re.compile(rb"\r\n([A-Za-z-]+):[ \t]*([^\r\n]*)")


# ---------------------------------------------------------------- writing


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, length: int | None = None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload, but its ``length``."""
    length = len(payload) if length is None else length
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~|"))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, n, refers_to: one row per page; a revisit (refers_to is not null) has no payload."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"),
        F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("n"),
    )
    none = F.lit(None).cast("long").alias("refers_to")
    same = rows.select("page_id", "digest", "n").filter(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k"))
    same = written(same.filter("k > 1").select("digest", "first"), "repeats")
    alone, others = split_by(rows, "digest", same.select("digest"))
    later = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    small = others.select("page_id", "url", "digest", "n").join(same, "digest", "left").withColumn("later", later)
    small = written(small, "roles")
    revisits = small.filter("later").select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "digest", "n", F.col("first").alias("refers_to"))
    # The payloads of the other rows: found by digest and page_id, those of revisits stay behind.
    key = lambda: F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("digest"))
    wanted = written(small.filter("not later").select(key().alias("key")).distinct(), "wanted")
    _, near = split_by(others.withColumn("key", key()), "key", wanted)
    firsts = near.join(wanted, "key", "left_semi")
    cols = ["page_id", "url", "payload", "digest", "n"]
    return alone.select(*cols, none).unionByName(revisits).unionByName(firsts.select(*cols, none))


def write_warc(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Write ``pages`` (page_id, url, html); returns (file, size) of the archives, below ``folder``."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    fs, base = filesystem(folder)
    fs.create_dir(base)
    rows = with_roles(pages, least)

    def write(batches):
        fs, base = filesystem(folder)
        name = f"part-{task_id():05d}.warc"
        out, size, temp = None, 0, f"{base}/.{name}-{uuid.uuid4().hex}"
        for b in batches:
            for i in range(b.num_rows):
                page, url, payload, digest, n, first = (b.column(k)[i].as_py() for k in range(6))
                out = out or fs.open_output_stream(temp, compression=None)
                x = record(page, url, payload, digest, first, first is not None, n)
                out.write(x)
                size += len(x)
        if out is not None:
            out.close()
            fs.move(temp, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size])], ["file", "size"])

    return written(rows.mapInArrow(write, "file string, size long"), "warc-files")


# ---------------------------------------------------------------- boundaries


def parse_header(data: bytes, at: int = 0) -> tuple[int, int] | None:
    """(length of the header with its blank line, length of the block) of the record at ``at``, or None."""
    return next(parse_headers(data, [at]))


def parse_headers(data: bytes, starts):
    """``parse_header`` of each of the ascending ``starts``; bytes that several headers share are searched once."""
    end, n = -1, None
    for at in starts:
        fresh = end < at
        if fresh:
            end = data.find(BLANK, at)
            if end < 0:
                end = len(data)  # no later header ends either
        if end == len(data):
            yield None
            continue
        if fresh or n and n.start() < at:
            n = _LENGTH.search(data, at, end + 2)
        yield (end + 4 - at, int(n[1])) if n else None


def read_headers(f, low: int, high: int, size: int) -> bytes:
    """The bytes from ``low`` to ``high`` and as many after them as the headers that begin before ``high`` need."""
    data, step = f.read_at(min(size, high + HEADER) - low, low), HEADER
    while low + len(data) < size:
        last = MAGIC.search(data, max(0, data.rfind(BLANK)))
        if not last or last.start() + low >= high:
            break
        step *= 2
        data += f.read_at(min(step, size - low - len(data)), low + len(data))
    return data


def block_exits(data: bytes, low: int, high: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate offsets in [low, high) and where the chain of each leaves the block (-1: it breaks).

    ``data`` are the archive's bytes from ``start`` on, enough for the headers that begin before ``high``.
    """
    offs, nexts = [], []
    found = list(takewhile(lambda k: k + start < high, (m.start() for m in MAGIC.finditer(data, low - start))))
    for k, got in zip(found, parse_headers(data, found)):
        if got:
            offs.append(k + start)
            nexts.append(k + start + got[0] + got[1] + 4)
    at, succ = np.array(offs, dtype=np.int64), np.array(nexts, dtype=np.int64)
    if not len(at):
        return at, succ
    k = np.minimum(np.searchsorted(at, succ), len(at) - 1)
    inside = (succ < high) & (at[k] == succ)
    jump = np.where(inside, k, np.arange(len(at)))
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    leave = np.where(succ >= high, succ, -1)
    return at, leave[jump]


def _open(uri: str):
    fs, path = filesystem(uri)
    return fs.open_input_file(path)


def entries(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, size, entry): the first record offset of each block that a chain from the file's start reaches."""

    def scan(batches):
        for b in batches:
            for file, size, k in zip(*[b.column(i).to_pylist() for i in range(3)]):
                low, high = k * block, min(size, (k + 1) * block)
                with _open(file) as f:
                    data = read_headers(f, low, high, size)
                at, to = block_exits(data, low, high, low)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(at), pa.string()), pa.array(at), pa.array(to)], ["file", "at", "to"])

    blocks = files.filter("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))).alias("block"))
    n, most = blocks.count(), blocks.agg(F.max("block")).first()[0] or 0
    jumps = blocks.repartition(max(1, min(n, 1 << 20))).mapInArrow(scan, "file string, at long, to long")
    jumps = written(jumps, "jumps")
    reach = jumps.filter("at = 0").select("file", "at")
    span = 1
    while span <= most:
        step = jumps.filter("to >= 0").select("file", "at", "to")
        landed = reach.join(step, ["file", "at"]).select("file", F.col("to").alias("at"))
        reach = written(reach.union(landed).distinct(), "reach")
        span *= 2
        if span <= most:
            twice = step.join(step.select("file", F.col("at").alias("to"), F.col("to").alias("far")), ["file", "to"])
            jumps = written(twice.select("file", "at", F.col("far").alias("to")), "jumps")
    return reach.withColumnRenamed("at", "entry").join(files, "file").filter("entry < size").select("file", "size", "entry")


def read_warc(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """Records of (file, size): page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset.

    Digest and length of a response are computed from its payload; a revisit states those of the
    payload it stands for. page_id and refers_to are null where the ids aren't ``urn:page:`` numbers.
    """
    starts = written(entries(files, block), "entries")
    n = max(1, starts.count())
    number = re.compile(rb"<urn:page:(-?\d+)>")

    def records(f, size, entry):
        at, high = entry, (entry // block + 1) * block
        while at < min(size, high):
            head = read_headers(f, at, at + 1, size)
            got = parse_header(head) if MAGIC.match(head) else None
            if not got or at + got[0] + got[1] + 4 > size:
                return
            fields = {k.lower(): v for k, v in _FIELD.findall(head, 0, got[0])}
            data = f.read_at(got[1], at + got[0]) if at + got[0] + got[1] > at + len(head) else head[got[0] : got[0] + got[1]]
            kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
            page, other = number.match(fields.get(b"warc-record-id", b"")), number.match(fields.get(b"warc-refers-to", b""))
            if kind == "revisit":
                size_of, digest = int(fields.get(b"x-payload-length", b"0")), fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha256:")
            else:
                body = data[data.find(b"\r\n\r\n") + 4 :] if data.startswith(b"HTTP/") else data
                size_of, digest = len(body), hashlib.sha256(body).hexdigest()
            yield int(page[1]) if page else None, size_of, digest, kind, int(other[1]) if other else None, at
            at += got[0] + got[1] + 4

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches):
        for b in batches:
            for file, size, entry in zip(*[b.column(i).to_pylist() for i in range(3)]):
                with _open(file) as f:
                    rows = [(*r[:5], file, r[5]) for r in records(f, size, entry)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return starts.repartition(n).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long")


def round_trip(pages: DataFrame, block: int = BLOCK) -> DataFrame:
    shared_root(pages.sparkSession)
    return read_warc(write_warc(pages), block).drop("file", "offset")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
             min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM p
"""
