"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become lower-case words joined by single spaces; every window of ``window`` consecutive words
of a benchmark item (or the whole item if it is shorter) is a pattern with a space at both ends.
Patterns are grouped by length. Each group has a table of shifts by the hash of the block that ends
the search window: a shift above 0 skips positions where no pattern of the group can start. A shift
of 0 leads to the patterns with that ending and beginning (suffix and prefix hash), which are
compared byte by byte. The search advances thousands of cursors over a batch of texts at once.

The benchmark is read in blocks of ``block_bytes`` of text, each broadcast. A task searches a group of
texts for one block after the other, with one block's tables in memory at a time, so a benchmark of
any size is handled in one pass over the documents.

Edge cases: null or wordless texts have no words and are not hit; wordless items have no window;
repeated items with one item_id count once; an item with null item_id counts under the empty name;
an empty benchmark hits nothing. No shuffle takes place and no row is moved.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, fresh

WINDOW = 13
BLOCK_BYTES = 2 << 20
SEGMENT = 1024
BATCH_BYTES = 4 << 20
#: Text searched for one block before the next block is loaded, where there are several.
GROUP_BYTES = 48 << 20
_KEEP = frozenset(b"0123456789" + LOWER) | frozenset(range(0x80, 0x100))
#: Lower-cases A-Z and turns every byte outside words into a space.
WORDS = bytes.maketrans(UPPER, LOWER).translate(bytes(c if c in _KEEP else 32 for c in range(256)))


def word_bytes(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class _Group:
    """Patterns of similar length, searched together. ``m``: the shortest length, that of the search window."""

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        self.width = w = min(8, m)
        self.mask = np.uint64((1 << (8 * w)) - 1)
        heads = np.frombuffer(b"".join(p[:m].ljust(m + 8, b"\0") for p in patterns), dtype=np.uint8).reshape(len(patterns), m + 8)
        self.bits = int(np.clip(np.ceil(np.log2(len(patterns) * (m - w + 1) * 8 + 2)), 10, 22))
        self.shift = np.full(1 << self.bits, m - w + 1, dtype=np.int64)
        for j in range(m - w + 1):  # ascending j: later, smaller shifts win by minimum
            block = np.ascontiguousarray(heads[:, j : j + 8]).view("<u8").ravel() & self.mask
            np.minimum.at(self.shift, self._slot(block), m - w - j)
        first = np.ascontiguousarray(heads[:, :8]).view("<u8").ravel() & self.mask
        last = np.ascontiguousarray(heads[:, m - w : m - w + 8]).view("<u8").ravel() & self.mask
        keys = _mix(_mix(first) ^ last)
        self.buckets: dict[int, list[bytes]] = {}
        for k, p in zip(keys.tolist(), patterns):
            self.buckets.setdefault(k, []).append(p)
        self.keys = np.unique(keys)

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (_mix(block) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: bytes, view: np.ndarray, size: int):
        """(position, pattern) of every occurrence. ``view``: the eight bytes from each position on."""
        m, w = self.m, self.width
        stop_all = size - m + 1
        if stop_all <= 0:
            return
        pos = np.arange(0, stop_all, SEGMENT, dtype=np.int64)
        stop = np.minimum(pos + SEGMENT, stop_all)
        found = []
        while len(pos):
            step = self.shift[self._slot(view[pos + (m - w)] & self.mask)]
            at = pos[step == 0]
            if len(at):
                found.append(at)
            pos = pos + np.maximum(step, 1)
            live = pos < stop
            if not live.all():
                pos, stop = pos[live], stop[live]
        if not found:
            return
        at = np.sort(np.concatenate(found))
        keys = _mix(_mix(view[at] & self.mask) ^ (view[at + (m - w)] & self.mask))
        hit = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys
        for p, k in zip(at[hit].tolist(), keys[hit].tolist()):
            for pattern in self.buckets[k]:
                if text.startswith(pattern, p):
                    yield p, pattern


class Matcher:
    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.owners: dict[bytes, list[str]] = {}
        for name, text in items:
            words = word_bytes(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                p = b" " + b" ".join(words[i : i + window]) + b" "
                own = self.owners.setdefault(p, [])
                if name not in own:
                    own.append(name)
        classes: dict[int, list[bytes]] = {}
        for p in self.owners:
            classes.setdefault(min(len(p).bit_length(), 7), []).append(p)
        self.groups = [_Group(sorted(ps)) for _, ps in sorted(classes.items())]

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Per text: number of words, occurrences as ranges of word numbers (end excluded), and the items they belong to."""
        out = []
        batch, size = [], 0
        for t in texts:
            line = b" " + b" ".join(word_bytes(t)) + b" "
            batch.append(line)
            size += len(line)
            if size > BATCH_BYTES:
                out += self._scan(batch)
                batch, size = [], 0
        return out + self._scan(batch)

    def _scan(self, lines: list[bytes]):
        out = [(len(x) > 2 and x.count(b" ") - 1, [], set()) for x in lines]
        out = [(int(n), r, s) for n, r, s in out]
        if not lines:
            return out
        text = b"".join(lines)
        padded = text + b"\0" * 16
        view = np.ndarray(shape=(len(text) + 8,), dtype="<u8", buffer=padded, strides=(1,))
        starts = np.concatenate(([0], np.cumsum([len(x) for x in lines])))
        spaces: dict[int, np.ndarray] = {}
        for g in self.groups:
            for p, pattern in g.search(text, view, len(text)):
                d = int(np.searchsorted(starts, p, "right") - 1)
                if d not in spaces:
                    spaces[d] = np.flatnonzero(np.frombuffer(lines[d], dtype=np.uint8) == 32)
                first = int(np.searchsorted(spaces[d], p - starts[d]))
                out[d][1].append((first, first + pattern.count(b" ") - 1))
                out[d][2].update(self.owners[pattern])
        return out


def merged(ranges) -> list[tuple[int, int]]:
    """Disjoint ascending ranges that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int):
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string")).toLocalIterator():
        rows.append((r["item"] or "", r["text"]))
        size += len(r["text"] or "") + 16
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


SPANS = T.ArrayType(T.ArrayType(T.LongType()))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with a struct appended, and that column's name: n_words, spans (word ranges hit, end excluded), items (sorted)."""
    context, name = docs.sparkSession.sparkContext, fresh(docs.columns, "found")
    held = [context.broadcast(pickle.dumps(Matcher(rows, window), pickle.HIGHEST_PROTOCOL)) for rows in _blocks(benchmark, block_bytes)]
    held = held or [context.broadcast(pickle.dumps(Matcher([], window)))]
    schema = T.StructType([*docs.schema.fields, T.StructField(name, FOUND)])
    at = docs.columns.index("text")

    def search(parts):
        texts = [t for _, ts in parts for t in ts]
        counts, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
        for h in held:
            for k, (n, r, s) in enumerate(matcher(h).scan(texts)):
                counts[k] = n
                spans[k] += r
                items[k] |= s
        found = [{"n_words": n, "spans": merged(r), "items": sorted(s)} for n, r, s in zip(counts, spans, items)]
        for part, ts in parts:
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found[: len(ts)], _ARROW)], schema.names)
            found = found[len(ts) :]

    last: list = [None, None]

    def matcher(h):
        if last[0] is not h:
            last[:] = [None, None]  # one at a time
            last[:] = [h, pickle.loads(h.value)]
            if len(held) > 1:
                vars(h).pop("_value", None)  # read again from the worker's file when its turn comes
        return last[1]

    def run(batches):
        parts, size, enough = [], 0, GROUP_BYTES if len(held) > 1 else 0
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                texts = part.column(at).to_pylist()
                parts.append((part, texts))
                size += sum(len(t) for t in texts if t)
                if size >= enough:
                    yield from search(parts)
                    parts, size = [], 0
        if parts:
            yield from search(parts)

    return docs.mapInArrow(run, schema), name


def hit_words(found: str):
    return F.aggregate(F.col(found)["spans"], F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])


def is_contaminated(found: str):
    """At least one word in twenty is hit."""
    return (hit_words(found) > 0) & (20 * hit_words(found) >= F.col(found)["n_words"])


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per document."""
    out, found = contamination(docs.select("doc_id", "text"), benchmark, **how)
    return out.select(
        "doc_id", F.col(found)["n_words"].alias("n_words"), hit_words(found).alias("n_hit"),
        F.size(F.col(found)["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.col(found)["items"]), 256).alias("items_sha256"),
        is_contaminated(found).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the contaminated ones."""
    out, found = contamination(docs, benchmark, **how)
    return out.filter(~is_contaminated(found)).select(*docs.columns)


def sql(window: int = WINDOW) -> str:
    """DuckDB SQL for ``report``."""
    words = lambda t: f"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    leads = ", ".join(f"lead(w, {k}) OVER o AS l{k}" for k in range(1, window))
    runs = " UNION ALL ".join(
        f"SELECT r, p, {n} AS n, concat_ws(' ', {', '.join(f'l{k}' for k in range(n))}) AS s FROM l WHERE l{n - 1} IS NOT NULL AND {n} IN (SELECT n FROM iw)" for n in range(1, window + 1)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({words("text")}, []) AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), {window}) AS n, array_to_string(w[p:p + least(len(w), {window}) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - {window - 1}, 1))) AS p FROM i WHERE len(w) > 0)),
u AS (SELECT r, unnest(w) AS w, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0),
l AS (SELECT r, p, w AS l0, {leads} FROM u WINDOW o AS (PARTITION BY r ORDER BY p)),
dw AS ({runs}),
h AS (SELECT r, p, dw.n AS n, item FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
k AS (SELECT r, count(DISTINCT q) AS hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN k ON k.r = d.r LEFT JOIN t ON t.r = d.r
"""
