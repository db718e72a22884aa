"""Token-ID output: flat files of unsigned integers with 64-bit document offsets.

Documents are range-sorted by doc_id; each task encodes its range and writes two files:

- ``tokens-NNNNN.bin``: the ids of its documents one after another, little-endian, 16 bits wide where
  the vocabulary allows it and 32 otherwise, each document closed by the end id;
- ``tokens-NNNNN.idx``: 64-bit little-endian integers: documents, documents whose doc_id is null
  (they come first), the n + 1 offsets of documents in ids from the start of the .bin file, then
  the n doc_ids (0 where null).

The manifest (a Parquet folder) has each part's documents and ids; prefix sums over it give each
part's base, so global offsets need no pass over the data. Files are written under a temporary name
and moved, so a task that runs again replaces its own output. Readers memory-map local files.

Encoding is split at blanks before which the vocabulary's pre-tokeniser always splits, and pieces
are memoised; both leave ids unchanged.

Edge cases: null counts as empty (just the end id); rows that repeat a doc_id are each written,
ordered by text; an empty table writes no part; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, scratch, shared_root, task_id

END_ID = 0
MEMO = 800_000
_BLANK = r"\s\x1c-\x1f\x85\u180e\u200b"
#: White space other than blanks and line feeds, and pairs that make a text go the general way.
_OTHER = [c for c in map(chr, [*range(0x09, 0x0A), *range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
_PAIRS = ["  ", " \n", "\n ", "\n\n"]
#: Boundaries in any text: before a blank that an ordinary character follows.
_SURE = re.compile(rf"(?= [^{_BLANK}])")


def odd(text: str) -> bool:
    """White space next to white space or to the text's ends, or other than blanks and line feeds."""
    return text[:1] in ("", " ", "\n") or text[-1] in " \n" or any(x in text for x in _PAIRS) or any(x in text for x in _OTHER)


class Encoder:
    """Ids of whole texts as bytes of the given dtype, for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        kind = type(self.tok.pre_tokenizer).__name__
        self.splits = kind == "ByteLevel" and self.tok.normalizer is None and "add_prefix_space=False" in repr(self.tok.pre_tokenizer)
        self.dtype = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        #: Bytes of text each id stands for: one per character of its byte-level name.
        self.bytes = np.zeros(self.tok.get_vocab_size(), dtype=np.int64)
        for token, k in self.tok.get_vocab().items():
            self.bytes[k] = len(token)
        #: Ids of pieces as they stand, and of pieces after a blank (the key is without it).
        self.plain: dict[str, bytes] = {}
        self.after: dict[str, bytes] = {}
        self.end = np.array([END_ID], dtype=self.dtype).tobytes()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, memo: dict[str, bytes], pieces: set[str], before: str) -> None:
        """Encode what is new. After a blank, many pieces go as one text, which is cut again where their bytes end."""
        new = list(pieces.difference(memo))
        for lo in range(0, len(new) if not before else 0, 4096):
            some = new[lo : lo + 4096]
            memo.update(zip(some, self._ids(some)))
        for lo in range(0, len(new) if before else 0, 8192):
            some = new[lo : lo + 8192]
            joined = [before + before.join(some[i : i + 128]) for i in range(0, len(some), 128)]
            ids = np.concatenate([np.array(e.ids, dtype=np.int64) for e in self.tok.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.cumsum(np.fromiter((len(x.encode()) + len(before) for x in some), np.int64, len(some)))
            cuts = (np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1) * len(self.end)
            data, at = ids.astype(self.dtype).tobytes(), 0
            for x, to in zip(some, cuts.tolist()):
                memo[x] = data[at:to]
                at = to

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.splits:
            return [x + self.end for x in self._ids(texts)]
        if len(self.plain) + len(self.after) > MEMO:
            self.plain.clear()
            self.after.clear()
        # A line is a first word and words after blanks; a line feed between ordinary characters is a piece of its own.
        parted: list[tuple[list[str], list[list[str]] | None]] = []
        plain, after = {"\n"}, set()
        for t in texts:
            if odd(t):
                first, rest = _SURE.split(t), None
            else:
                rest = [line.split(" ") for line in t.split("\n")]
                first = [words.pop(0) for words in rest]
                for words in rest:
                    after.update(words)
            plain.update(first)
            parted.append((first, rest))
        self._learn(self.plain, plain, "")
        self._learn(self.after, after, " ")
        p, a, feed = self.plain.__getitem__, self.after.__getitem__, self.plain["\n"]
        out = []
        for first, rest in parted:
            if rest is None:
                out.append(b"".join(map(p, first)) + self.end)
            else:
                out.append(feed.join([p(x) + b"".join(map(a, words)) for x, words in zip(first, rest)]) + self.end)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


MANIFEST = "part int, docs long, ids long, width int"


def write_tokens(docs: DataFrame, vocabulary: str, folder: str | None = None) -> str:
    """Write the files and the manifest of ``docs`` (doc_id, text); returns the folder."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    fs, base = filesystem(folder)
    fs.create_dir(base)

    def write(batches):
        fs, base = filesystem(folder)
        enc, part = encoder(vocabulary), task_id()
        width = np.dtype(enc.dtype).itemsize
        offsets, ids, nulls, out, temp = [0], [], 0, None, f"{base}/.{part}-{uuid.uuid4().hex}"
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                out = out or fs.open_output_stream(temp + ".bin", compression=None)
                for d, x in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist())):
                    out.write(x)
                    offsets.append(offsets[-1] + len(x) // width)
                    ids.append(0 if d is None else d)
                    nulls += d is None
        if out is None:
            return
        out.close()
        with fs.open_output_stream(temp + ".idx", compression=None) as f:
            f.write(np.concatenate(([len(ids), nulls], offsets, ids)).astype("<i8").tobytes())
        for kind in ("bin", "idx"):
            fs.move(f"{temp}.{kind}", f"{base}/tokens-{part:05d}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(ids)]), pa.array([offsets[-1]]), pa.array([width], pa.int32())], ["part", "docs", "ids", "width"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark, folder: str) -> DataFrame:
    """part, docs, ids, width, and the base: ids of all parts before it (a sum over parts, not over documents)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


class Part:
    """A part's files; ids of local files are memory-mapped."""

    def __init__(self, folder: str, part: int, width: int):
        fs, base = filesystem(folder)
        local = fs.type_name == "local"
        name, dtype = f"{base}/tokens-{part:05d}", "<u2" if width == 2 else "<u4"

        def load(path, kind):
            if local:
                return np.memmap(path, dtype=kind, mode="r")
            with fs.open_input_file(path) as f:
                return np.frombuffer(f.read(), dtype=kind)

        index = load(name + ".idx", "<i8")
        n, self.nulls = int(index[0]), int(index[1])
        self.offsets, self.doc_ids = index[2 : n + 3], index[n + 3 :]
        self.ids = load(name + ".bin", dtype) if self.offsets[-1] else np.zeros(0, dtype)

    def __len__(self):
        return len(self.doc_ids)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else int(self.doc_ids[i])

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def read_tokens(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: one row per document, from the files."""
    parts = manifest(spark, folder)
    n = max(1, parts.count())

    def read(batches):
        for b in batches:
            for part, width, base in zip(*[b.column(k).to_pylist() for k in range(3)]):
                p = Part(folder, part, width)
                for lo in range(0, len(p), 4096):
                    hi = min(len(p), lo + 4096)
                    crc = [zlib.crc32(p.tokens(i).astype("<u4").tobytes()) for i in range(lo, hi)]
                    off = np.asarray(p.offsets[lo : hi + 1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p.doc_id(i) for i in range(lo, hi)], pa.int64()), pa.array(off[:-1] + base), pa.array(np.diff(off)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return parts.select("part", "width", "base").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, vocabulary: str) -> DataFrame:
    shared_root(docs.sparkSession)
    return read_tokens(docs.sparkSession, write_tokens(docs, vocabulary))
