"""Learned task ranking with a group left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import folder


def learned_ranking(rows: DataFrame, group: str, features: list[str], target: str, key: list[str], kind: str = "ridge", alpha: float = 1.0) -> DataFrame:
    """Each group's rows ranked by a model fitted on all other groups: key, group, prediction, nth.

    ``ridge`` standardises features and penalises with ``alpha``; ``trees`` boosts regression trees.
    Groups are few (anchors of a panel): one model is fitted for each. Every fit reads the rows several
    times, so they are written once, with the columns that are needed, and read from there.
    """
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array  # noqa: F401  (registers the vector type)
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    spark, at = rows.sparkSession, folder(rows.sparkSession, "ranking")
    needed = rows.select(*dict.fromkeys([*key, group, *features, target]))
    needed.write.parquet(at)
    rows = spark.read.schema(needed.schema).parquet(at)
    ready = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep").transform(rows.fillna(0, features))
    groups = [r[0] for r in ready.select(group).distinct().orderBy(group).collect()]
    parts = []
    for g in groups:
        seen, unseen = ready.filter(F.col(group) != g), ready.filter(F.col(group) == g)
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(seen)
        n = seen.count()
        if n == 0:
            parts.append(unseen.withColumn("prediction", F.lit(0.0)))
            continue
        if kind == "ridge":
            model = LinearRegression(labelCol=target, regParam=alpha / n, elasticNetParam=0.0, standardization=False, solver="normal")
        else:
            model = GBTRegressor(labelCol=target, maxIter=30, maxDepth=3, seed=7)
        parts.append(model.fit(scaler.transform(seen)).transform(scaler.transform(unseen)))
    out = reduce(DataFrame.unionByName, [p.select(*key, group, "prediction") for p in parts])
    return out.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(F.col("prediction").desc(), *key)))
