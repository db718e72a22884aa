"""Kernels as SQL functions: vectorised functions of a session, and a table function that lists a fragment's tasks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..kernels import align, stability, threshold
from . import sequence as S


def cigar(path) -> str:
    """A path as lengths and letters: M for a pair, I for a query base against a gap, D for a gap against a target base."""
    out: list[list] = []
    for i, j in path:
        kind = "I" if j < 0 else "D" if i < 0 else "M"
        if out and out[-1][1] == kind:
            out[-1][0] += 1
        else:
            out.append([1, kind])
    return "".join(f"{n}{k}" for n, k in out)


def _best(query: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([int(align.best_score(align.encode(q), align.encode(t)[None, :])[0]) if q and t else 0 for q, t in zip(query, target)], dtype="int64")


def _cigar(query: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([cigar(align.local(align.encode(q), align.encode(t))[1]) if q and t else "" for q, t in zip(query, target)])


def _maxima(query: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([align.column_maxima(align.encode(q), align.encode(t))[0].tolist() if q and t else [] for q, t in zip(query, target)])


def _threshold(query: pd.Series, target: pd.Series, pairs: pd.Series) -> pd.Series:
    return pd.Series([threshold.threshold(q or "", t or "", int(n)) for q, t, n in zip(query, target, pairs)], dtype="int32")


def _stability(source: pd.Series, aligned: pd.Series, parallel: pd.Series) -> pd.Series:
    return pd.Series([stability.mean_stability(s or "", a or "", bool(p)) for s, a, p in zip(source, aligned, parallel)], dtype="float64")


class _Tasks:
    def eval(self, fragment: str):
        for parallel, forward, back in ((1, S.PARALLEL_FORWARD, S.PARALLEL_REVERSE), (-1, S.ANTIPARALLEL_FORWARD, S.ANTIPARALLEL_REVERSE)):
            for rule, images in enumerate(zip(forward, back), 1):
                for reverse, image in enumerate(images):
                    target = "".join(dict(zip("ATGCN", image)).get(c, image[4]) for c in fragment or "")
                    yield parallel, rule, reverse, target[::-1] if reverse else target


def register(spark: SparkSession) -> list[str]:
    """Make the kernels known to the session's SQL; returns the names. Null or empty sequences score 0 and align nowhere."""
    kinds = {
        "alignment_score": (_best, "bigint"), "alignment_cigar": (_cigar, "string"), "alignment_columns": (_maxima, "array<int>"),
        "alignment_threshold": (_threshold, "int"), "alignment_stability": (_stability, "double"),
    }
    for name, (f, kind) in kinds.items():
        spark.udf.register(name, F.pandas_udf(f, kind))
    spark.udtf.register("fragment_tasks", F.udtf(_Tasks, returnType="parallel int, rule int, reverse int, target string"))
    return [*kinds, "fragment_tasks"]
