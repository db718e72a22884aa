"""Scalar functions on windows, scores and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_bp(start: Column, end: Column) -> Column:
    return F.greatest(end - start + 1, F.lit(0))


def margin(best: Column, second: Column) -> Column:
    """Best minus second best; null without a second."""
    return best - second


def interval_distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """0 where [a0, a1] and [b0, b1] meet, else the gap between them."""
    return F.greatest(b0 - a1, a0 - b1, F.lit(0))


def score_band(score: Column) -> Column:
    return F.when(score >= 85, "ge85").when(score >= 80, "80_84").when(score >= 75, "75_79").when(score >= 70, "70_74").otherwise("lt70")


def band_below_85(score: Column) -> Column:
    return F.when(score >= 80, "80_84").when(score >= 75, "75_79").otherwise("lt_75")


def band_below_75(score: Column) -> Column:
    return F.when(score >= 70, "70_74").when(score >= 65, "65_69").otherwise("lt_65")


def support_bin(support: Column) -> Column:
    return F.when(support <= 1, "support1").when(support == 2, "support2").otherwise("support3plus")


def pack(i: Column, j: Column) -> Column:
    """Two 32-bit coordinates in one BIGINT."""
    return F.shiftleft(i.cast("bigint"), 32).bitwiseOR(j.cast("bigint"))


def unpack_i(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 32)


def unpack_j(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))


def share(part: Column, whole: Column) -> Column:
    """part / whole as DOUBLE, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def seed_interval(score: Column, end: Column, match: int = 5, mismatch: int = 4, identity: float = 0.6) -> tuple[Column, Column]:
    """(start, end) of the stretch before a peak that its score could fill at the least identity, both 1-based."""
    slope = (match + mismatch) * identity - mismatch
    length = ((score + 24.0) / F.lit(slope) + 1.0).cast("bigint") if slope > 0 else F.floor(score / match).cast("bigint")
    length = F.least(F.greatest(length, F.lit(1).cast("bigint")), end.cast("bigint"))
    return F.greatest(end - length + 1, F.lit(1)).cast("bigint"), end.cast("bigint")


def integer_list(text: Column) -> Column:
    """Integers of a comma-separated list; fails on an item that is none."""
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(items, lambda x: x.cast("bigint"))


def integers(text: Column, least: int) -> Column:
    """``integer_list``, failing on an item below ``least``."""
    return F.transform(integer_list(text), lambda x: F.when(x < least, F.raise_error(F.lit(f"integer below {least}"))).otherwise(x))


def density(score: Column, bp: Column) -> Column:
    """Score per base; 0 where there is none."""
    return share(score, bp)


def fits_16_bits(*coordinates: Column) -> Column:
    """Whether all coordinates fit 16 unsigned bits."""
    out = F.lit(True)
    for c in coordinates:
        out = out & c.between(0, 65535)
    return out


def tile_key(*columns: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def clamped(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def json_value(column: str, path: str, kind: str, default) -> Column:
    """The value at ``path`` of a JSON text as ``kind``; ``default`` where it is missing or of another kind."""
    return F.coalesce(F.get_json_object(column, path).try_cast(kind), F.lit(default).cast(kind))
