"""Ranks, cuts and group metrics (E, F) without a window over the whole table.

A global window would sort everything in one task. Positions come from the groups of equal values instead: counts by
value, a range partitioning of the values, and the totals of the ranges before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resiq.session import cut


def attach(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a table of one row, which travels by broadcast."""
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(one.withColumn("__one", F.lit(1))), "__one").drop("__one")


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with, for each (name: column) of sums, the sum of the column over all rows before in the given order. The
    order must be total: no two rows equal in it. Rows are range-partitioned; only one total a range is brought
    together."""
    parts = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    totals = parts.groupBy("__p").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    offsets = totals.select("__p", *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    inside = W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = parts.join(offsets, "__p")
    return out.select(*df.columns, *((F.col(f"__{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()))


def average_ranks(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): the average rank, from 1, of each row's value; ties share the mean of their ranks. Nulls are
    left out; NaN is the largest value."""
    by_value = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ranks = running(by_value, ["__v"], {"__before": "__n"}).select("__v", (F.col("__before") + (F.col("__n") + 1) / 2).alias(name))
    return df.select(key, F.col(value).alias("__v")).join(ranks, "__v").select(key, name)


def fused(df: DataFrame, key: str, one: str, two: str) -> DataFrame:
    """(key, combined_score): the average ranks of `one` and of the logarithm of `two`, each by the number of rows.
    Rows where either is null, NaN or (for the logarithm) not positive are left out."""
    good = df.where(~F.isnan(one) & ~F.isnan(two) & (F.col(two) > 0)).select(key, F.col(one).alias("__a"), F.log(two).alias("__b"))
    n = good.count()
    both = average_ranks(good, key, "__a", "ra").join(average_ranks(good, key, "__b", "rb"), key)
    return both.select(key, (F.col("ra") / max(n, 1) + F.col("rb") / max(n, 1)).alias("combined_score"))


def positions(df: DataFrame, order: list[Column], name: str = "rank", most: int | None = None) -> DataFrame:
    """Df with its 1-based place in an order. With `most`, only the first rows, which a top-k needs no more
    than `most` rows in one task for; without, rows are numbered range by range."""
    if most is not None:
        top = df.orderBy(*order).limit(most)
        return top.withColumn(name, F.row_number().over(W.orderBy(*order)))
    keyed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    keyed = cut(keyed.withColumn("__i", F.monotonically_increasing_id()))
    n = keyed.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = n.select("__p", (before - F.col("__first")).alias("__off"))
    return keyed.join(offsets, "__p").withColumn(name, F.col("__i") + F.col("__off") + 1).drop("__p", "__i", "__off")


def ndcg(df: DataFrame, group: str, score: str, label: str, tie: str, k: int = 10) -> DataFrame:
    """(group, n, ndcg): linear gain, log2 discount; 1 for fewer than two rows, 0 where no row has a gain. Equal
    scores go by `tie`. A group's rows are ranked in one task up to k only (group limits are pushed below the shuffle)."""
    by_score = F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), tie))
    by_label = F.row_number().over(W.partitionBy(group).orderBy(F.desc(label), tie))
    gain = F.sum(F.col(label) / F.log2(F.col("rn") + 1))
    got = df.withColumn("rn", by_score).where(F.col("rn") <= k).groupBy(group).agg(gain.alias("dcg"))
    best = df.withColumn("rn", by_label).where(F.col("rn") <= k).groupBy(group).agg(gain.alias("idcg"))
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    value = F.when(F.col("n") < 2, 1.0).when(F.col("idcg") <= 0, 0.0).otherwise(F.col("dcg") / F.col("idcg"))
    return n.join(got, group).join(best, group).select(group, "n", value.alias("ndcg"))
