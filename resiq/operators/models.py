"""Trained models through pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resiq.functions import descriptors as D
from resiq.functions import scales as S
from resiq.operators.stats import quantiles
from resiq.session import cut


def kmeans_medoids(df: DataFrame, columns: list[str], k: int, seed: int = 42) -> DataFrame:
    """(cluster, size, *columns) the member nearest to each centre of k-means over z-scores, and the cluster's size.
    The smallest id on ties. k is lowered to the number of rows; an empty table gives no rows."""
    n = df.count()
    if not n:
        return df.select(F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("size"), *columns).limit(0)
    stages = [VectorAssembler(inputCols=columns, outputCol="__v"), StandardScaler(inputCol="__v", outputCol="__z", withMean=True, withStd=True), KMeans(k=max(2, min(k, n)), seed=seed, featuresCol="__z", predictionCol="cluster")]
    model = Pipeline(stages=stages).fit(df)
    centres = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.stages[-1].clusterCenters())], "cluster int, centre array<double>")
    out = model.transform(df).join(F.broadcast(centres), "cluster")  # k rows
    gap = F.aggregate(F.zip_with(vector_to_array("__z"), "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return out.groupBy("cluster").agg(F.count("*").alias("size"), F.min_by(F.struct(*columns), F.struct(gap.alias("gap"), F.col("id"))).alias("m")).select("cluster", "size", *(F.round(F.col("m")[c], 6).alias(c) for c in columns))


def reduced(df: DataFrame, column: str, k: int) -> DataFrame:
    """M3: (id, features): centred vectors on their first k principal axes (signs are free), each scaled by median and
    interquartile range (1 where that is 0)."""
    v = df.select("id", array_to_vector(F.col(column).cast("array<double>")).alias("__v"))
    model = Pipeline(stages=[StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False), PCA(k=k, inputCol="__c", outputCol="__p")]).fit(v)
    p = model.transform(v).select("id", vector_to_array("__p").alias("p"))
    long = p.select(F.posexplode("p").alias("i", "value"))
    q = {r.i: r.q for r in quantiles(long, ["i"], (0.25, 0.5, 0.75)).collect()}  # k rows
    scaled = F.array(*((F.col("p")[i] - q[i][1]) / ((q[i][2] - q[i][0]) or 1.0) for i in range(k)))
    return p.select("id", F.transform(scaled, lambda x: F.round(x, 4)).alias("features"))


FEATURES = ("length", "charge", "gravy", "aromatic", "basic", "acidic")


def sequence_features(df: DataFrame, seq: str = "sequence") -> DataFrame:
    s = F.col(seq)
    values = (F.length(s).cast("double"), D.net_charge(s), D.mean_scale(s, S.KYTE_DOOLITTLE), D.share(s, "FWY"), D.share(s, "KR"), D.share(s, "DE"))
    return df.withColumns(dict(zip(FEATURES, values, strict=True)))


def rank_and_judge(rows: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """M4: boosted regression trees on relevance, a stand-in for a pairwise ranker, in cross-validation: each fold of
    sequences is judged by trees that were fitted without it. (bacterium, n, ndcg) over all rows; a sequence is in one
    fold with all its rows."""
    from resiq.operators.ranks import ndcg

    df = cut(sequence_features(rows).withColumn("fold", F.pmod(F.xxhash64("sequence", F.lit(seed)), F.lit(folds))).withColumn("label", F.col("relevance").cast("double")))
    told = None
    for f in range(folds):
        stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="features"), GBTRegressor(maxIter=10, maxDepth=4, seed=seed)]
        fit, held = df.where(F.col("fold") != f), df.where(F.col("fold") == f)
        if fit.isEmpty() or held.isEmpty():
            continue
        own = Pipeline(stages=stages).fit(fit).transform(held).select("bacterium", "sequence", "label", "prediction")
        told = own if told is None else told.unionAll(own)
    if told is None:  # too few rows to fit on any
        told = df.select("bacterium", "sequence", "label", F.lit(0.0).alias("prediction"))
    return ndcg(told, "bacterium", "prediction", "label", "sequence").withColumn("ndcg", F.round("ndcg", 4))


def calibrated(df: DataFrame, p: str, label: str, how: str = "platt") -> DataFrame:
    """Df with `calibrated`, by logistic or isotonic regression of the label on the probability; the probability
    itself where only one class occurs. Rows must have both values."""
    if df.select(label).distinct().limit(2).count() < 2:
        return df.withColumn("calibrated", F.col(p))
    v = VectorAssembler(inputCols=[p], outputCol="__f").transform(df)
    if how == "platt":
        out = LogisticRegression(featuresCol="__f", labelCol=label, probabilityCol="__q", predictionCol="__y", rawPredictionCol="__r").fit(v).transform(v)
        return out.withColumn("calibrated", vector_to_array("__q")[1]).drop("__f", "__q", "__y", "__r")
    out = IsotonicRegression(featuresCol="__f", labelCol=label, predictionCol="calibrated").fit(v.withColumn("__w", F.lit(1.0))).transform(v)
    return out.drop("__f")
