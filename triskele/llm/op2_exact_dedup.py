"""Exact deduplication by Grace hashing.

Each task first combines the rows it reads in an open-addressing table that compares complete
contents, so a text leaves a task once however often it occurs there. The combined rows are dealt
out by digest and combined again. A table that outgrows ``limit`` bytes is flushed to spill files by
the next four bits of the content's hash, and every spill file is treated the same way, recursively,
until its distinct contents fit. Spill files lie in the shared folder and are removed at once.

Only (digest, keep_id, group_size) of texts that occur more than once go back to the documents, by
a join on the digest that adaptive execution may split where one digest is very frequent.

Edge cases: null counts as the empty text; the largest doc_id stays, a null doc_id only where its
text has no other; of rows that tie on text and doc_id exactly one is kept; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, scratch, written

#: Tied rows that one task deals out again.
CHUNK = 4096
LIMIT = 96 << 20
FAN = 16
_HEAD = struct.Struct("<qqqqI")
_NULL = -(1 << 63)


class ContentTable:
    """Open addressing with linear probing; entries compare complete contents."""

    def __init__(self):
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.top: list[int | None] = []
        self.ties: list[int] = []
        self.counts: list[int] = []
        self.held = 0

    def __len__(self):
        return len(self.hashes)

    def add(self, h: int, content: bytes, top: int | None, ties: int, count: int) -> None:
        slots, mask = self.slots, len(self.slots) - 1
        i = h & mask
        while (e := slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                self.counts[e] += count
                old = self.top[e]
                if top == old:
                    self.ties[e] += ties
                elif old is None or (top is not None and top > old):
                    self.top[e], self.ties[e] = top, ties
                return
            i = (i + 1) & mask
        slots[i] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.top.append(top)
        self.ties.append(ties)
        self.counts.append(count)
        self.held += len(content) + 200
        if 2 * len(self.hashes) > len(slots):
            self._grow()

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        slots = [-1] * (mask + 1)
        for e, h in enumerate(self.hashes):
            i = h & mask
            while slots[i] >= 0:
                i = (i + 1) & mask
            slots[i] = e
        self.slots = slots

    def entries(self):
        return zip(self.hashes, self.contents, self.top, self.ties, self.counts)


class Spill:
    """Up to FAN files of records, by four bits of the hash."""

    def __init__(self, folder: str):
        self.fs, self.folder = filesystem(folder)
        self.fs.create_dir(self.folder)
        self.name, self.files = uuid.uuid4().hex, {}

    def put(self, k: int, h, content, top, ties, count) -> None:
        if k not in self.files:
            self.files[k] = self.fs.open_output_stream(f"{self.folder}/{self.name}-{k}", compression=None)
        self.files[k].write(_HEAD.pack(h - (1 << 63), _NULL if top is None else top, ties, count, len(content)) + content)

    def read(self):
        """The records of each file in turn; a file goes once it is read."""
        for f in self.files.values():
            f.close()
        for k in self.files:
            yield self._records(f"{self.folder}/{self.name}-{k}")

    def _records(self, path: str):
        with self.fs.open_input_stream(path, compression=None) as f:
            while head := f.read(_HEAD.size):
                h, top, ties, count, n = _HEAD.unpack(head)
                yield h + (1 << 63), f.read(n), None if top == _NULL else top, ties, count
        self.fs.delete_file(path)


def grace(records, limit: int, folder: str, depth: int = 0):
    """(content, top, ties, count) of each distinct content of (hash, content, top, ties, count)."""
    table, spill = ContentTable(), None
    for r in records:
        table.add(*r)
        if table.held > limit and len(table) > 1 and depth < 16:
            spill = spill or Spill(folder)
            for e in table.entries():
                spill.put((e[0] >> (60 - 4 * depth)) & (FAN - 1), *e)
            table = ContentTable()
    if spill is None:
        for _, *e in table.entries():
            yield e
        return
    for e in table.entries():
        spill.put((e[0] >> (60 - 4 * depth)) & (FAN - 1), *e)
    table = None
    for part in spill.read():
        yield from grace(part, limit, folder, depth + 1)


_SCHEMA = "digest string, content binary, top long, ties long, n long"


def distinct_texts(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(digest, top, ties, n): every distinct text's sha256, largest doc_id, rows with that doc_id, and rows."""
    folder = scratch(docs.sparkSession, "grace")
    h = xxhash.xxh64_intdigest

    def local(batches):
        def rows():
            for b in batches:
                for d, c in zip(b.column(0).to_pylist(), b.column(1)):
                    c = c.as_py()
                    yield h(c), c, d, 1, 1

        yield from packed(grace(rows(), limit // 4, folder), True)

    def combine(batches):
        def rows():
            for b in batches:
                for c, *rest in zip(b.column(1), *[b.column(k).to_pylist() for k in (2, 3, 4)]):
                    c = c.as_py()
                    yield h(c), c, *rest

        yield from packed(grace(rows(), limit, folder), False)

    def packed(entries, whole: bool):
        names = ["digest", "content", "top", "ties", "n"] if whole else ["digest", "top", "ties", "n"]
        rows, held = [], 0

        def batch():
            digest, content, top, ties, n = zip(*rows)
            cols = [pa.array(digest, pa.string()), *([pa.array(content, pa.binary())] if whole else []), *[pa.array(x, pa.int64()) for x in (top, ties, n)]]
            return pa.RecordBatch.from_arrays(cols, names)

        for content, top, ties, n in entries:
            rows.append((hashlib.sha256(content).hexdigest(), content if whole else None, top, ties, n))
            held += len(content)
            if len(rows) >= 4096 or held > 4 << 20:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    partial = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("content")).mapInArrow(local, _SCHEMA)
    return partial.repartition(F.col("digest")).mapInArrow(combine, "digest string, top long, ties long, n long")


def exact_dedup(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document."""
    groups = written(distinct_texts(docs, limit).filter("n > 1"), "copies")
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("text_sha256")).join(
        groups.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left"
    )
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    out = out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "ties")
    if not groups.filter("ties > 1").isEmpty():
        # Rows alike in text and doc_id are alike in the result but for one: they are dealt out again from their count.
        step = F.lit(CHUNK).cast("long")
        chunks = groups.filter("ties > 1").select("digest", "top", "n", "ties", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ties") - 1, step)).alias("lo")).repartition("digest", "lo")
        each = chunks.select("*", F.explode(F.sequence("lo", F.least(F.col("lo") + step, F.col("ties")) - 1)).alias("i"))
        each = each.select(F.col("top").alias("doc_id"), F.col("top").alias("keep_id"), F.col("n").alias("group_size"), (F.col("i") == 0).alias("kept"), F.col("digest").alias("text_sha256"))
        tied = F.coalesce(F.col("kept") & (F.col("ties") > 1), F.lit(False))
        return out.filter(~tied).drop("ties").unionByName(each)
    return out.drop("ties")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
