"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of at most ``docs_per_lang`` documents a language, chosen by hash; that
bound is a parameter. The matrix of log probabilities (buckets x languages) is broadcast, and
batches of texts are scored in numpy as sums of matrix rows over the n-grams of each text.

Letters are lower-cased code point by code point; anything else counts as a space. A text that is
null or holds no letter gets ``und`` and score 0. Without any training row every text is ``und``.
Ties go to the language first in code-point order. The score is the posterior of the language.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, fresh

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
DOCS_PER_LANG = 4000
CHUNK = 1 << 19


@lru_cache(1)
def _fold() -> np.ndarray:
    """Code point -> lower-case letter, or a space for what is no letter."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x30000):  # all cased letters and nearly all others; the rest of the planes below
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    for c in range(0x30000, 0x32000):
        if chr(c).isalpha():
            out[c] = c
    return out


def _points(text: str) -> np.ndarray:
    return _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]


def grams(points: np.ndarray, n: int, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of the n-gram that starts at each point; ``buckets`` itself where all of it is space."""
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.full(m, n, dtype=np.uint32)
    blank = np.ones(m, dtype=bool)
    for k in range(n):
        p = points[k : k + m]
        h = (h ^ p) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        blank &= p == 32
    out = (h % np.uint32(buckets)).astype(np.int64)
    out[blank] = buckets
    return out


def count_grams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    total = np.zeros(buckets, dtype=np.int64)
    pts = np.concatenate(([32], _points(text), [32])).astype(np.uint32)
    for n in ORDERS:
        for lo in range(0, max(1, len(pts) - n + 1), CHUNK):
            total += np.bincount(grams(pts[lo : lo + CHUNK + n - 1], n, buckets), minlength=buckets + 1)[:buckets]
    return total


class Model:
    """languages in code-point order, prior logs, and the (buckets + 1) x languages matrix; its last row is zero."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray, alpha: float = 0.5):
        self.langs = langs
        p = counts.astype(np.float64) + alpha
        logs = np.log(p) - np.log(p.sum(0, keepdims=True)) if langs else p
        self.matrix = np.vstack([logs, np.zeros((1, len(langs)))]).astype(np.float32)
        self.prior = np.log((docs + 1.0) / (docs.sum() + len(langs))) if langs else docs

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        out, best = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return out, best
        group, size = [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            pts = _points(t)
            if not (pts != 32).any():
                continue
            group.append((i, pts))
            size += len(pts)
            if size > CHUNK:
                self._score(group, out, best)
                group, size = [], 0
        self._score(group, out, best)
        return out, best

    def _score(self, group, out, best) -> None:
        if not group:
            return
        gap = np.array([32], dtype=np.uint32)
        pts = np.concatenate([x for _, p in group for x in (gap, p.astype(np.uint32), gap)])
        starts = np.concatenate(([0], np.cumsum([len(p) + 2 for _, p in group])))
        total = np.zeros((len(group), len(self.langs)))
        rows = max(1 << 14, (1 << 21) // len(self.langs))
        for n in ORDERS:
            ids = grams(pts, n)
            for k in range(1, n):  # n-grams that would cross into the next text
                ids[starts[1:-1] - k] = BUCKETS
            for lo in range(0, len(ids), rows):
                hi = min(len(ids), lo + rows)
                a = np.searchsorted(starts, lo, "right") - 1
                b = np.searchsorted(starts, hi, "left")
                cut = np.maximum(starts[a:b], lo) - lo
                total[a:b] += np.add.reduceat(self.matrix[ids[lo:hi]], cut, axis=0, dtype=np.float64)
        total += self.prior
        total -= total.max(1, keepdims=True)
        post = np.exp(total)
        post /= post.sum(1, keepdims=True)
        for (i, _), k, p in zip(group, post.argmax(1), post):
            out[i], best[i] = self.langs[k], p[k]


def train(rows: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """``rows``: doc_id, text, lang. About ``docs_per_lang`` rows of each language are used, the same at each rerun."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(found)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.int64), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, docs_per_lang / found[k]))])
    at = {k: i for i, k in enumerate(langs)}
    chance = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.filter(chance < share[F.col("lang")]).select("text", "lang").repartition(min(32, 2 + len(langs)))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + count_grams(t)
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([v.astype("<i8").tobytes()])], ["lang", "counts"])

    counts = np.zeros((BUCKETS, len(langs)), dtype=np.int64)
    for r in some.mapInArrow(run, "lang string, counts binary").toLocalIterator():
        counts[:, at[r["lang"]]] += np.frombuffer(r["counts"], dtype="<i8")
    return Model(langs, counts, np.array([found[k] for k in langs], dtype=np.float64))


def predict(docs: DataFrame, model: Model) -> tuple[DataFrame, str, str]:
    """``docs`` with the predicted language and its score appended, and the names of these columns."""
    name = fresh(docs.columns, "lang_pred")
    score = fresh([*docs.columns, name], "lang_score")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        langs, scores = held.value.score(texts)
        return pa.array(langs, pa.string()), pa.array(scores, pa.float64())

    out = append_arrow(docs, "text", [T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())], run)
    return out, name, score


def training_rows(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Rows that may be learned from: their crc32 of doc_id as text is not ``held_out`` modulo ``folds``."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % folds
    return docs.filter(fold != held_out)


def keep_known(docs: DataFrame, min_score: float = 0.5, **how) -> DataFrame:
    """``docs`` without those whose language can't be told: ``und``, or a best posterior below ``min_score``."""
    out, name, score = predict(docs, train(training_rows(docs), **how))
    return out.filter((F.col(name) != "und") & (F.col(score) >= min_score)).select(*docs.columns)
