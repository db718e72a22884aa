"""Mixing sources to target weights along a time-varying curriculum.

Each source has a schedule: a piecewise-linear weight over training time 0 to 1. Its integral is
the source's weight in the mix. Targets share the words of the corpus by weight; no source gives
more than ``max_repeats`` times its words, and what it can't give is shared again by weight among
the others (solved in closed form over sources sorted by limit / weight).

Within a source, documents stand in the order of a hash of their doc_id and text (their place) and
are taken from the start, epoch after epoch, until the target is met. The middle of each taken
stretch is a share of the source's cumulative demand; inverting the cumulative integral of its
schedule gives the training position. Documents are then range-sorted by position.

Running sums need no large group: rows alike in doc_id, source and text are counted together first,
words are summed by source and hash bucket, bucket sums are accumulated, and only groups of one
bucket are ordered together. Everything is DataFrame expressions.

``mixture`` moves each text once, into the range sort: what it needs to place a text is the sums of
its bucket and the place where its source's target is met, which are few rows whatever the input.

Edge cases: null text has no words; the null source is a source of its own, last in order; words
that are not there can't be taken, so a source of empty texts has target 0; rows that repeat a
doc_id are separate documents; empty tables give empty results; extra columns don't matter
(``mixture`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
WEIGHTS = (1.0, 2.0, 3.0)
#: Rows of a broadcast side, about 100 bytes each; a larger side is joined by shuffle.
BROADCAST_ROWS = 1 << 19
#: Hex digits of a place that make its bucket, at most.
DIGITS = 3
#: Rows alike that one task gives out again.
CHUNK = 4096
KNOT = "array<struct<t:double,w:double>>"


def default_schedule(rank):
    """Weights 1, 2, 3 in turn; every other source falls from 1.5 to 0.5 of its weight, the rest rise."""
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int"))
    start = F.when(rank % 2 == 1, 1.5).otherwise(0.5)
    knot = lambda t, x: F.struct(F.lit(t).alias("t"), x.alias("w"))
    return F.array(knot(0.0, w * start), knot(1.0, w * (2.0 - start)))


def place():
    """Order of a document in its source: the md5 of its doc_id and its text's md5."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))


def words():
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_key():
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def sized(docs: DataFrame) -> DataFrame:
    """One row per set of rows alike in doc_id, source and text: src, source, place, doc_id, size (of one), k (how many). Written, so texts are counted once."""
    rows = docs.select(source_key().alias("src"), F.col("source").cast("string").alias("source"), place().alias("place"), "doc_id", words().alias("size"))
    return written(rows.groupBy("src", "source", "place", "doc_id", "size").agg(F.count("*").alias("k")), "sizes")


def targets(rows: DataFrame, schedules: DataFrame | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source of ``sized`` rows: src, source_size, weight, target, segments (of the normalised cumulative schedule).

    ``schedules``: (source, knots), knots ascending from t = 0 to t = 1; sources not in it get the default.
    """
    s = rows.groupBy("src", "source").agg(F.sum(F.col("size") * F.col("k")).alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    if schedules is not None:
        given = schedules.select(F.col("source"), F.col("knots").cast(KNOT).alias("knots"))
        s = s.join(given, s.source.eqNullSafe(given.source), "left").select(s["*"], "knots")
        s = s.withColumn("knots", F.coalesce("knots", default_schedule(F.col("rank"))))
    else:
        s = s.withColumn("knots", default_schedule(F.col("rank")))
    area = F.transform(
        F.sequence(F.lit(1), F.size("knots") - 1),
        lambda i: F.struct(
            F.element_at("knots", i)["t"].alias("t0"), F.element_at("knots", i + 1)["t"].alias("t1"),
            F.element_at("knots", i)["w"].alias("w0"), F.element_at("knots", i + 1)["w"].alias("w1"),
            ((F.element_at("knots", i)["w"] + F.element_at("knots", i + 1)["w"]) / 2.0 * (F.element_at("knots", i + 1)["t"] - F.element_at("knots", i)["t"])).alias("a"),
        ),
    )
    s = s.withColumn("area", area).withColumn("weight", F.aggregate("area", F.lit(0.0), lambda n, x: n + x["a"]))
    cap, order = F.col("cap"), Window.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (
        s.withColumn("cap", max_repeats * F.col("source_size"))
        .withColumn("ratio", F.when(F.col("weight") > 0, cap / F.col("weight")).otherwise(F.lit(float("inf"))))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.when(F.col("rest_weight") > 0, F.col("rest") / F.col("rest_weight")))
        .withColumn("at", F.row_number().over(order))
        .withColumn("free", F.coalesce(F.col("weight") * F.col("level") < cap, F.lit(False)))
        .withColumn("first", F.min(F.when(F.col("free"), F.col("at"))).over(everything))
        .withColumn("share", F.min(F.when(F.col("at") == F.col("first"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("first").isNull() | (F.col("at") < F.col("first")), cap.cast("double")).otherwise(F.col("weight") * F.col("share"))
    done = F.aggregate(
        "area", F.array().cast("array<struct<t0:double,t1:double,w0:double,w1:double,d0:double,d1:double>>"),
        lambda acc, x: F.concat(acc, F.array(F.struct(
            x["t0"].alias("t0"), x["t1"].alias("t1"), x["w0"].alias("w0"), x["w1"].alias("w1"),
            F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1)["d1"]).otherwise(0.0).alias("d0"),
            (F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1)["d1"]).otherwise(0.0) + x["a"]).alias("d1"),
        ))),
    )
    return s.select("src", "source_size", "weight", target.alias("target"), done.alias("segments"))


def position(share, segments, weight):
    """Training time at which ``share`` (0 to 1) of a source's demand has been met: the inverse of the integral."""
    x = share * weight
    seg = F.get(F.filter(segments, lambda g: (g["d1"] >= x) & (g["d1"] > g["d0"])), F.lit(0))
    seg = F.coalesce(seg, F.element_at(segments, -1))
    q = F.greatest(x - seg["d0"], F.lit(0.0))
    k = F.try_divide(seg["w1"] - seg["w0"], seg["t1"] - seg["t0"])
    root = F.sqrt(F.greatest(seg["w0"] * seg["w0"] + 2.0 * k * q, F.lit(0.0)))
    return F.least(seg["t0"] + F.coalesce(F.try_divide(2.0 * q, seg["w0"] + root), F.lit(0.0)), F.lit(1.0))


def _small(side: DataFrame) -> DataFrame:
    """``side``, written; to be broadcast if its rows are few enough."""
    side = written(side, "mix-side")
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def _buckets(rows: DataFrame, digits: int) -> DataFrame:
    """(src, bucket, base, n): words of each bucket of a source, and of the buckets before it."""
    sums = rows.groupBy("src", F.substring("place", 1, digits).alias("bucket")).agg(F.sum(F.col("size") * F.col("k")).alias("n"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _starts(rows: DataFrame, bases: DataFrame, digits: int) -> DataFrame:
    """``rows`` with base and start: the words of the source before each set of rows."""
    inside = Window.partitionBy("src", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("bucket", F.substring("place", 1, digits)).join(bases.select("src", "bucket", "base"), ["src", "bucket"])
    return rows.withColumn("start", F.col("base") + F.coalesce(F.sum(F.col("size") * F.col("k")).over(inside), F.lit(0)))


def _one_by_one(sets: DataFrame) -> DataFrame:
    """``sets`` with one row for each of their ``k`` rows, numbered ``i``; large sets are dealt out in chunks."""
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i")
    few = sets.filter(F.col("k") <= CHUNK).select("*", step)
    chunks = sets.filter(F.col("k") > CHUNK).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1, F.lit(CHUNK).cast("long"))).alias("lo"))
    chunks = chunks.repartition(F.col("place"), F.col("lo"))
    many = chunks.select("*", F.explode(F.sequence("lo", F.least(F.col("lo") + CHUNK, F.col("k")) - 1)).alias("i")).drop("lo")
    return few.unionByName(many)


def plan(docs: DataFrame, schedules: DataFrame | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies.

    copies: array of (words, position), one entry for each time the document is taken. The last
    document of a source may be taken in part, so that the words taken equal the target rounded.
    """
    rows = sized(docs)
    t = targets(rows, schedules, max_repeats)
    sets = _starts(rows, _buckets(rows, DIGITS), DIGITS).join(t, "src")
    # Sets of more than one row are few or large: they are dealt out from a table, so that nothing before is done twice.
    placed = _one_by_one(written(sets, "places")).withColumn("start", F.col("start") + F.col("i") * F.col("size"))
    want, size, total = F.round("target").cast("long"), F.col("size"), F.col("source_size")

    def copy(e):
        at = F.col("start") + e * total
        taken = F.greatest(F.least(size, want - at), F.lit(0).cast("long"))
        share = F.least((at + taken / 2.0) / F.col("target"), F.lit(1.0))
        return F.struct(taken.alias("words"), F.when(taken > 0, position(share, F.col("segments"), F.col("weight"))).alias("position"))

    copies = F.filter(F.array(*[copy(F.lit(e).cast("long")) for e in range(max_repeats)]), lambda c: c["words"] > 0)
    return placed.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target",
        F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"]).alias("taken"), "copies",
    )


def ordered_plan(docs: DataFrame, **how) -> DataFrame:
    """The plan, range-sorted by the first position of each document (those not taken first)."""
    first = F.get(F.col("copies"), F.lit(0))["position"]
    return plan(docs, **how).withColumn("position", first).repartitionByRange(F.col("position").asc_nulls_first(), F.col("doc_id")).sortWithinPartitions(
        F.col("position").asc_nulls_first(), "doc_id"
    )


def cuts(rows: DataFrame, t: DataFrame, bases: DataFrame, digits: int) -> DataFrame:
    """Per source: target, source_size, weight, segments, full, cut_place, tie_place, tie_take.

    Whole documents are taken, those whose middle lies before the target: ``full`` epochs of all,
    then the documents up to ``cut_place``, and ``tie_take`` of the rows alike at ``tie_place``. Only
    the bucket in which the target is met is ordered.
    """
    t = t.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    met = bases.join(t.select("src", "rest"), "src").filter((F.col("base") <= F.col("rest")) & (F.col("rest") < F.col("base") + F.col("n"))).select("src", "bucket", "base", "rest")
    inside = rows.filter("size > 0").withColumn("bucket", F.substring("place", 1, digits)).join(_small(met), ["src", "bucket"])
    before = Window.partitionBy("src").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("base") + F.coalesce(F.sum(F.col("size") * F.col("k")).over(before), F.lit(0)))
    take = F.least(F.greatest(F.floor((F.col("rest") - F.col("start")) / F.col("size") + 0.5), F.lit(0)), F.col("k")).cast("long")
    ends = inside.withColumn("take", take).groupBy("src").agg(
        F.min("bucket").alias("met"), F.max(F.when(F.col("take") == F.col("k"), F.col("place"))).alias("last"),
        F.max(F.when((F.col("take") > 0) & (F.col("take") < F.col("k")), F.struct("place", "take"))).alias("tie"),
    )
    return t.join(ends, "src", "left").select(
        "src", "target", "source_size", "weight", "segments", "full", F.coalesce("last", "met", F.lit("")).alias("cut_place"),
        F.col("tie.place").alias("tie_place"), F.col("tie.take").alias("tie_take"),
    )


def mixture(docs: DataFrame, schedules: DataFrame | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``docs`` as the mix takes them, whole, once per copy, range-sorted by training position.

    Demand before a document is read off the sums of its hash bucket, by the document's share of the
    bucket's hash range. Wordless documents weigh nothing and stay, once, at position 0. Of rows
    alike in doc_id, source and text at the target, as many are taken as fit, in the order of their
    columns.
    """
    cols, names = docs.columns, []
    for n in ("mix_src", "mix_bucket", "mix_place", "mix_position", "mix_row", "mix_cut", "mix_base"):
        names.append(fresh([*cols, *names], n))
    src, bucket, at, pos, row, at_s, at_b = names
    rows = sized(docs)
    t = written(targets(rows, schedules, max_repeats), "targets")
    n = t.count()
    digits = max(d for d in range(DIGITS + 1) if d == 0 or n * 16**d <= BROADCAST_ROWS)
    bases = _small(_buckets(rows, digits))
    ends = _small(cuts(rows, t, bases, digits))
    per_source = ends.select(F.col("src").alias(src), F.struct(*[c for c in ends.columns if c != "src"]).alias(at_s))
    per_bucket = bases.select(F.col("src").alias(src), F.col("bucket").alias(bucket), F.struct("base", "n").alias(at_b))
    out = docs.withColumns({src: source_key(), at: place()}).withColumn(bucket, F.substring(at, 1, digits))
    out = out.join(per_source, src).join(per_bucket, [src, bucket])
    S, B = F.col(at_s), F.col(at_b)
    within = F.conv(F.substring(at, digits + 1, 12), 16, 10).cast("double") / float(16**12)
    demand = B["base"] + B["n"] * within
    worded = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))

    def positions(epochs):
        e = F.transform(epochs, lambda k: position(F.least((k * S["source_size"] + demand) / S["target"], F.lit(1.0)), S["segments"], S["weight"]))
        return F.when(worded, e).otherwise(F.array(F.lit(0.0)))

    upto = S["full"] + F.when(F.col(at) <= S["cut_place"], 1).otherwise(0)
    epochs = F.when(upto > 0, F.sequence(F.lit(0).cast("long"), upto - 1)).otherwise(F.array().cast("array<bigint>"))
    every = out.withColumn(pos, F.explode(positions(epochs)))
    ties = out.filter(worded & (F.col(at) == S["tie_place"]))
    if not ends.filter("tie_place is not null").isEmpty():
        alike = ties.groupBy(*out.columns).agg(F.count("*").alias(row))
        before = Window.partitionBy(src, at).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
        left = F.greatest(F.least(S["tie_take"] - F.coalesce(F.sum(row).over(before), F.lit(0)), F.col(row)), F.lit(0))
        more = alike.withColumn(row, left).filter(F.col(row) > 0).withColumn(pos, F.explode(positions(F.array(S["full"]))))
        every = every.unionByName(more.withColumn(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col(row)))).drop(row))
    # Rows alike in position and doc_id are dealt to several partitions by their number.
    every = every.withColumn(row, F.monotonically_increasing_id())
    return every.repartitionByRange(F.col(pos), F.col("doc_id"), F.col(row)).sortWithinPartitions(pos, "doc_id").select(*cols)


SQL = r"""
WITH r AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM r GROUP BY source),
w AS (SELECT *, ((rnk - 1) % 3 + 1)::DOUBLE AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
        coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
        coalesce(sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_weight,
        row_number() OVER (ORDER BY cap / weight, rnk) AS pos FROM w),
l AS (SELECT *, (total - used)::DOUBLE / (all_weight - used_weight) AS level FROM o),
f AS (SELECT *, min(CASE WHEN weight * level < cap THEN pos END) OVER () AS first_free FROM l),
g AS (SELECT *, min(CASE WHEN pos = first_free THEN level END) OVER () AS share FROM f),
t AS (SELECT source, source_size, rnk, weight,
        CASE WHEN first_free IS NULL OR pos < first_free THEN cap::DOUBLE ELSE weight * share END AS target FROM g),
p AS (SELECT r.doc_id, r.size, t.source_size, t.target, t.rnk, t.weight,
        coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(least(size, round(target)::BIGINT - start), 0) + greatest(least(size, round(target)::BIGINT - start - source_size), 0)
   + greatest(least(size, round(target)::BIGINT - start - 2 * source_size), 0))::BIGINT AS taken
FROM p
"""
