"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary texts, one on windows of toxic texts. Which
windows those are is itself decided by compression: toxic texts are cut into halves, a dictionary is
trained on either, and the windows of the other half are kept that it compresses so much better than
the ordinary dictionary does as ordinary windows rarely are; the kept windows train the halves'
next dictionaries, and after the last round the toxic one. What toxic text has in common with
ordinary text cancels out: the toxic dictionary's content stands before all of the ordinary one's,
with the ordinary one's entropy tables, and ordinary windows that it still shortens join the content
of both (hard negatives).

A text is cut into windows of ``WINDOW_WORDS`` words that cover all of it; each is compressed with
either dictionary, and how many bytes the toxic one saves is the window's distance. How often ordinary
windows reach a distance is counted on texts kept apart from the dictionaries. A text's margin says
how unlikely as many windows at or above a distance are in an ordinary text of its length (the least
likely distance from ``HIT`` on, by the Chernoff bound of a Poisson count). Margins are calibrated on
the same labelled texts, by monotone regression, to the probability of the toxic label.

At most ``docs_per_label`` texts a label, chosen by hash, and ``sample_bytes`` bytes of text are learned
from (parameters), and of near copies among them (verified on three-word shingles) only one.

Edge cases: null and wordless texts have the lowest margin; without both labels in the sample every
text scores the share of toxic labels (0 if there are none); repeated rows score alike; rows with a
null label or text are not learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, fresh

DOCS_PER_LABEL = {0: 4000, 1: 3000}
SAMPLE_BYTES = 64 << 20
WINDOW_WORDS = 4
TOXIC_BYTES = 4096
HALF_BYTES = 32768
ORDINARY_BYTES = 49152
HARD_BYTES = 32768
ROUNDS = 2
HIT = 3
LOWEST = -1.0
FARTHEST = 40
#: How many times rarer each further byte is taken to be where no ordinary window reaches it.
RARER = 2.5
#: In front of each window, so that the compressed block is never stored raw.
CARRIER = b"~" * 8 + b" "
#: The end of a trained dictionary's tables: the three first repeated offsets of the format.
_OFFSETS = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])
_SPLIT = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []


def windows(ws: list[bytes], width: int, stride: int) -> list[bytes]:
    """Windows of ``width`` words, ``stride`` apart, that cover all words; the last may be shorter."""
    return [b" " + b" ".join(ws[i : i + width]) + b" " for i in range(0, max(1, len(ws) - width + stride) if ws else 0, stride)]


def shingles(ws: list[bytes]) -> np.ndarray:
    """The distinct hashes of the three-word shingles."""
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3])) for i in range(max(1, len(ws) - 2))], dtype=np.uint64))


class Copies:
    """Tells whether a text is a near copy (half of all shingles in common) of one seen before."""

    def __init__(self):
        self.by_mark: dict[int, list[int]] = {}
        self.seen: list[np.ndarray] = []

    def add(self, ws: list[bytes]) -> bool:
        h = shingles(ws)
        marks = [int((((h ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(7 + k))).min()) for k in range(4)]
        for other in {i for m in marks for i in self.by_mark.get(m, ())}:
            common = len(np.intersect1d(h, self.seen[other], assume_unique=True))
            if 2 * common >= len(h) + len(self.seen[other]) - common:
                return True
        for m in marks:
            self.by_mark.setdefault(m, []).append(len(self.seen))
        self.seen.append(h)
        return False


def _trained(size: int, samples: list[bytes]) -> tuple[bytes, bytes]:
    """(entropy tables, content) of a dictionary; no tables and the samples' tail where they are too few to train on."""
    try:
        data = zstd.train_dictionary(size, samples).as_bytes()
        at = data.index(_OFFSETS) + len(_OFFSETS)
        return data[:at], data[at:]
    except (zstd.ZstdError, ValueError):
        return b"", b"".join(samples)[-size:]


def _compressor(tables: bytes, content: bytes):
    par = zstd.ZstdCompressionParameters.from_level(
        9, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=3, strategy=zstd.STRATEGY_BTOPT, window_log=18, hash_log=16, chain_log=16, target_length=32, search_log=3
    )
    d = zstd.ZstdCompressionDict(tables + content, dict_type=zstd.DICT_TYPE_FULLDICT if tables else zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=par)
    made = zstd.ZstdCompressor(dict_data=d, compression_params=par)

    def sizes(data: list[bytes]) -> list[int]:
        if hasattr(made, "multi_compress_to_buffer"):
            return [len(x) for x in made.multi_compress_to_buffer(data)]
        return [len(made.compress(x)) for x in data]

    return sizes


class Model:
    def __init__(self, tables: bytes = b"", ordinary: bytes = b" ", toxic: bytes = b" ", width: int = WINDOW_WORDS, base: float = 0.0):
        self.tables, self.ordinary, self.toxic, self.width, self.base = tables, ordinary, toxic, width, base
        self.chance = {t: RARER**-t for t in range(HIT, FARTHEST + 1)}
        self.knots: list[float] = []
        self.values: list[float] = []
        self._live = None

    def __getstate__(self):
        return self.__dict__ | {"_live": None}

    def distances(self, ws: list[bytes]) -> list[int]:
        """Bytes that the toxic dictionary saves on each window."""
        if self._live is None:
            self._live = _compressor(self.tables, self.ordinary), _compressor(self.tables, self.toxic + self.ordinary)
        ordinary, toxic = self._live
        out: list[int] = []
        for at in range(0, len(ws), 4096):  # bounded memory for very long texts
            data = [CARRIER + w for w in ws[at : at + 4096]]
            out += [a - b for a, b in zip(ordinary(data), toxic(data))]
        return out

    def margin(self, text: str | None) -> float:
        d = self.distances(windows(words(text), self.width, self.width))
        if not d:
            return LOWEST
        best, high = 0.0, sorted((min(x, FARTHEST) for x in d if x >= HIT), reverse=True)
        for k, t in enumerate(high, 1):  # k windows reach t
            expected = len(d) * self.chance[t]
            if k > expected:
                best = max(best, k * math.log(k / expected) - k + expected)
        return best

    def count_chance(self, ordinary: list[list[bytes]]) -> None:
        """Shares of the windows of ordinary texts that reach each distance from HIT on."""
        found = Counter(min(x, FARTHEST) for ws in ordinary for x in self.distances(windows(ws, self.width, self.width)))
        n, last = sum(found.values()), 0.5
        if not n:
            return
        for t in range(HIT, FARTHEST + 1):
            reach = sum(k for x, k in found.items() if x >= t)
            last = reach if reach else last / RARER if t > HIT else 0.5
            self.chance[t] = last / n

    def fit(self, margins: list[float], labels: list[int]) -> None:
        """Monotone regression by pooling adjacent violators, with one virtual text at the base rate in each pool."""
        pools: list[list[float]] = []  # margin up to, toxic, texts
        for m, y in sorted(zip(margins, labels)):
            if pools and pools[-1][0] == m:
                pools[-1][1] += y
                pools[-1][2] += 1
            else:
                pools.append([m, y, 1])
        merged: list[list[float]] = []
        for p in pools:
            merged.append(p)
            while len(merged) > 1 and merged[-2][1] * merged[-1][2] >= merged[-1][1] * merged[-2][2]:
                last = merged.pop()
                merged[-1] = [last[0], merged[-1][1] + last[1], merged[-1][2] + last[2]]
        self.knots = [p[0] for p in merged]
        self.values = [(p[1] + self.base) / (p[2] + 1) for p in merged]
        self.values = list(np.maximum.accumulate(self.values))

    def score(self, text: str | None) -> float:
        if not self.knots:
            return self.base
        k = int(np.searchsorted(self.knots, self.margin(text)))
        return float(self.values[min(k, len(self.values) - 1)])


def learnable(labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, toxic) of labels whose crc32 of doc_id as text is not ``held_out`` modulo ``folds``; a doc_id with both labels is toxic."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % folds
    use = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold != held_out))
    return use.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _kept(found: list[tuple[int, bytes]], ordinary: Counter, ratio: float) -> list[bytes]:
    """Windows at or above the least distance that is ``ratio`` times as frequent as among ordinary windows."""
    n1, n0 = max(1, len(found)), max(1, sum(ordinary.values()))
    for d in range(2, 24):
        if sum(g >= d for g, _ in found) / n1 >= ratio * (sum(n for g, n in ordinary.items() if g >= d) + 1) / n0:
            return [w for g, w in found if g >= d]
    return []


def dictionaries(ordinary: list[list[bytes]], toxic: list[list[bytes]], width: int = WINDOW_WORDS, ratio: float = 4.0) -> Model:
    """A model without calibration, from the words of ordinary and of toxic texts."""
    rng = random.Random(2)
    plain = [x for ws in ordinary for x in windows(ws, 2 * width, 2 * width)]
    rng.shuffle(plain)
    tables, content = _trained(ORDINARY_BYTES, plain)
    whole = [x for ws in ordinary for x in windows(ws, width, width)]
    some = whole if len(whole) <= 200_000 else rng.sample(whole, 200_000)
    halves = [toxic[0::2], toxic[1::2]]
    source, size = [[x for ws in half for x in windows(ws, 2 * width, 2 * width)] for half in halves], HALF_BYTES
    for _ in range(ROUNDS):
        kept = []
        for k in (0, 1):
            m = Model(tables, content, _trained(size, source[k])[1], width)
            chance = Counter(m.distances(some))
            others = [x for ws in halves[1 - k] for x in windows(ws, width, max(1, width // 2))]
            kept.append(_kept(list(zip(m.distances(others), others)), chance, ratio))
        if not kept[0] and not kept[1]:
            break
        source = [kept[1] or kept[0], kept[0] or kept[1]]
        size = TOXIC_BYTES
    model = Model(tables, content, _trained(TOXIC_BYTES, source[0] + source[1])[1], width)
    for _ in range(4):
        hard = Counter()
        for d, x in zip(model.distances(whole), whole):
            if d >= 2:
                hard[x] += d
        if not hard:
            break
        model = Model(tables, b"".join(x for x, _ in hard.most_common())[:HARD_BYTES] + model.ordinary, model.toxic, width)
    return model


def train(docs: DataFrame, labels: DataFrame, docs_per_label: dict[int, int] | None = None, width: int = WINDOW_WORDS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic. Two thirds of the sample make the dictionaries, one third the calibration.

    The sample is drawn from the labels and is as small as its bound, so it is broadcast and no text is shuffled.
    """
    bound = docs_per_label or DOCS_PER_LABEL
    labels = labels.filter("doc_id is not null")
    found = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = found.get(0, 0), found.get(1, 0)
    base = n1 / (n0 + n1) if n0 + n1 else 0.0
    if not n0 or not n1:
        return Model(base=base)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, bound[1] / n1)).otherwise(min(1.0, bound[0] / n0))
    chosen = F.broadcast(labels.filter(chance < share).select("doc_id", "toxic"))
    sample = docs.select("doc_id", "text").filter("text is not null").join(chosen, "doc_id")
    sample = sample.select("text", "toxic", (F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(3)) == 0).alias("apart"))
    copies, texts, apart, size = Copies(), ([], []), [], 0
    for r in sample.toLocalIterator(prefetchPartitions=False):
        ws = words(r["text"])
        size += len(r["text"])
        if size > sample_bytes:
            break
        if not ws or copies.add(ws):  # of near copies one is learned from: else a text copied often would lend its words its label
            continue
        if r["apart"]:
            apart.append((r["text"], r["toxic"]))
        else:
            texts[r["toxic"]].append(ws)
    if not texts[0] or not texts[1]:
        return Model(base=base)
    model = dictionaries(sorted(texts[0]), sorted(texts[1]), width)
    model.base = base
    model.count_chance([words(t) for t, y in apart if y == 0])
    if len(apart) > 1:
        model.fit([model.margin(t) for t, _ in apart], [y for _, y in apart])
    return model


def score(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """``docs`` with the score appended, and that column's name."""
    name = fresh(docs.columns, "toxicity")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        return [pa.array([held.value.score(t) for t in texts], pa.float64())]

    return append_arrow(docs, "text", [T.StructField(name, T.DoubleType())], run), name
