"""Candidate hits against reference hits: key sets, recall, retention, score changes, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import share


def best_scores(hits: DataFrame, key: list[str], score: str = "score") -> DataFrame:
    """Largest score per key."""
    return hits.groupBy(*key).agg(F.max(score).alias(score))


def matched(reference: DataFrame, candidate: DataFrame, key: list[str], group: list[str] | None = None) -> DataFrame:
    """Full outer join of best scores: ref_score and cand_score, null on the side that lacks the key. Keys must not be null."""
    on = [*(group or []), *key]
    a = best_scores(reference, on).withColumnRenamed("score", "ref_score")
    b = best_scores(candidate, on).withColumnRenamed("score", "cand_score")
    return a.join(b, on, "full_outer")


def set_metrics(m: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Sizes, precision (0 without candidates), recall (0 without reference), Jaccard (1 if both are empty)."""
    group = group or []
    ref, cand = F.col("ref_score").isNotNull(), F.col("cand_score").isNotNull()
    out = m.groupBy(*group).agg(F.count_if(ref).alias("n_ref"), F.count_if(cand).alias("n_cand"), F.count_if(ref & cand).alias("n_both"))
    union = F.col("n_ref") + F.col("n_cand") - F.col("n_both")
    return out.withColumns({
        "precision": share(F.col("n_both"), F.col("n_cand")), "recall": share(F.col("n_both"), F.col("n_ref")),
        "jaccard": F.when(union == 0, 1.0).otherwise(share(F.col("n_both"), union)),
    })


def retention(m: DataFrame, key: list[str], ks: list[int], group: list[str] | None = None) -> DataFrame:
    """Per group: share of the reference's top hits (all ties), of its first k keys by (score desc, key), and of its score, that the candidate has.

    Within a group only rows up to the largest k are ranked (Spark bounds the sort by the rank
    filter), tops are a maximum; shares are 1 where there is nothing to keep.
    """
    group = group or []
    ref = m.filter("ref_score is not null").withColumn("kept", F.col("cand_score").isNotNull().cast("bigint"))
    top = ref.groupBy(*group).agg(F.max("ref_score").alias("top_score"))
    ref_top = ref.join(top, group) if group else ref.join(F.broadcast(top))
    positive = F.greatest(F.col("ref_score"), F.lit(0))
    sums = ref_top.groupBy(*group).agg(
        F.count_if(F.col("ref_score") == F.col("top_score")).alias("tops"), F.sum(F.when(F.col("ref_score") == F.col("top_score"), F.col("kept")).otherwise(0)).alias("tops_kept"),
        F.sum(positive).alias("weight"), F.sum(positive * F.col("kept")).alias("weight_kept"),
    )
    order = Window.partitionBy(*group).orderBy(F.col("ref_score").desc(), *key)
    first = ref.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= max(ks))
    per_k = first.groupBy(*group).agg(*[x for k in ks for x in (F.count_if(F.col("nth") <= k).alias(f"n{k}"), F.sum(F.when(F.col("nth") <= k, F.col("kept")).otherwise(0)).alias(f"kept{k}"))])
    out = sums.join(per_k, group, "left") if group else sums.join(F.broadcast(per_k))
    one = lambda a, b: F.when(F.coalesce(F.col(b), F.lit(0)) <= 0, 1.0).otherwise(share(F.col(a), F.col(b)))
    return out.select(*group, one("tops_kept", "tops").alias("top_hit_retention"), *[one(f"kept{k}", f"n{k}").alias(f"top{k}_retention") for k in ks], one("weight_kept", "weight").alias("weighted_recall"))


def score_changes(m: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Of keys on both sides: count, changed, smallest, largest and mean change, and signs (zeros without a match)."""
    d = (F.col("cand_score") - F.col("ref_score"))
    both = m.withColumn("d", F.when(F.col("cand_score").isNotNull() & F.col("ref_score").isNotNull(), d))
    n = F.count("d")
    return both.groupBy(*(group or [])).agg(
        n.alias("matched"), F.count_if(F.col("d") != 0).alias("changed"), F.coalesce(F.min("d"), F.lit(0)).alias("min_delta"), F.coalesce(F.max("d"), F.lit(0)).alias("max_delta"),
        share(F.coalesce(F.sum("d"), F.lit(0)), n).alias("mean_delta"), F.count_if(F.col("d") > 0).alias("positive"), F.count_if(F.col("d") < 0).alias("negative"), F.count_if(F.col("d") == 0).alias("zero"),
    )


def missing(reference: DataFrame, candidate: DataFrame, key: list[str]) -> DataFrame:
    """Best reference rows whose key the candidate lacks."""
    return best_scores(reference, key).join(candidate.select(*key).distinct(), key, "left_anti")


def difference_class(a: DataFrame, b: DataFrame, ordered: Column | None = None) -> DataFrame:
    """One row: rows only in a, only in b, and none / content_diff; both sides as multisets."""
    left, right = a.exceptAll(b).agg(F.count("*").alias("only_a")), b.exceptAll(a).agg(F.count("*").alias("only_b"))
    out = left.join(F.broadcast(right))
    return out.withColumn("difference", F.when((F.col("only_a") == 0) & (F.col("only_b") == 0), "none").otherwise("content_diff"))


def overlap(m: DataFrame, group: list[str]) -> DataFrame:
    """Set overlap where empty sides count as full agreement (1)."""
    ref, cand = F.col("ref_score").isNotNull(), F.col("cand_score").isNotNull()
    s = m.groupBy(*group).agg(F.count_if(ref).alias("n_ref"), F.count_if(cand).alias("n_cand"), F.count_if(ref & cand).alias("n_both"))
    full = lambda a, b: F.when(b == 0, 1.0).otherwise(share(a, b))
    return s.select(*group, full(F.col("n_both"), F.col("n_cand")).alias("precision"), full(F.col("n_both"), F.col("n_ref")).alias("recall"), full(F.col("n_both"), F.col("n_ref") + F.col("n_cand") - F.col("n_both")).alias("jaccard"))


def require_same_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Inner join on ``key``, failing with five keys of either side that has no partner."""
    both = a.select(*key, F.lit(1).alias("in_a")).join(b.select(*key, F.lit(1).alias("in_b")), key, "full_outer").filter("in_a is null or in_b is null")
    odd = both.limit(5).collect()
    if odd:
        raise ValueError(f"keys without a partner, for example {[tuple(r)[: len(key)] for r in odd]}")
    return a.join(b, key)


def content_hash(rows: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """Order-free sha256 per group: rows are hashed, the hashes' eight 32-bit parts are added up, and the sums are hashed with the row count.

    Sums are combined in the map task, so nothing grows with the group.
    """
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    h = rows.select(*group, F.sha2(line, 256).alias("h"))
    part = lambda k: F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = h.groupBy(*group).agg(*[F.sum(part(k)).alias(f"s{k}") for k in range(8)], F.count("*").alias("n_rows"))
    return sums.select(*group, F.sha2(F.concat_ws(",", *[F.col(f"s{k}").cast("string") for k in range(8)], F.col("n_rows").cast("string")), 256).alias("content_sha256"), "n_rows")


def raw_hash(lines: DataFrame, text: str, order: list[str], group: list[str]) -> DataFrame:
    """sha256 per group of its lines in order, each ended by a line feed: what hashing the file itself gives. Groups are files; one is read by one task."""
    import hashlib

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        digest = hashlib.sha256()
        for x in pdf[text]:
            digest.update((x + "\n").encode())
        return pdf[group].head(1).assign(raw_sha256=digest.hexdigest())

    schema = lines.select(*group).schema.add("raw_sha256", "string")
    return lines.select(*dict.fromkeys([*group, *order, text])).groupBy(*group).applyInPandas(run, schema)
