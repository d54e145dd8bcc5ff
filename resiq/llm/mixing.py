"""Mixing sources to target weights (problem 8): budgets met by subset sums over exact token lengths.

A mix's budget for a source is its normalised weight times the mix's target size. Whole passes over the source go
first (up to max_repeats); the rest is met from the counts of documents of each exact length: a share of each
length, so that the sample keeps the source's lengths, and then a bounded knapsack by dynamic programming over the
lengths that are left, which fills the remaining tokens exactly or as nearly below as sums of lengths can.
Which documents of a length are taken is drawn by a seeded hash.

Only (source, length) counts and quotas are gathered: their number is bounded by sources times distinct lengths.
Documents are ranked within (mix, source, length, salt); a length with many documents is salted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resiq.llm.tokens import VOCABULARY, sized
from resiq.session import cut, table

SEED = 20250101
#: Tokens of a budget that are left to the knapsack, so that it has several documents to choose.
SLACK = 4096
#: Documents of one source and length beyond which they are ranked in salted groups of about this many.
RANKED = 20_000


def knapsack(budget: int, length: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many of each length to take (at most count) so that the sum is as near to budget as possible and not
    above it. Sums are bits of one integer; a length's count is split into powers of two. Ties: the lengths
    first considered, short ones, are used least."""
    out = np.zeros(len(length), np.int64)
    if budget <= 0 or not len(length):
        return out
    mask, sums, steps = (1 << (budget + 1)) - 1, 1, []
    for k in np.argsort(-length, kind="stable"):
        left, part = int(min(count[k], budget // max(1, length[k]))), 1
        while left > 0 and not sums >> budget & 1:
            take = min(part, left)
            steps.append((k, take, sums))
            sums |= (sums << (take * int(length[k]))) & mask
            left -= take
            part *= 2
    at = sums.bit_length() - 1
    for k, take, before in reversed(steps):
        if not before >> at & 1:
            out[k] += take
            at -= take * int(length[k])
    return out


def quotas(budget: int, length: np.ndarray, count: np.ndarray, most: int) -> tuple[int, np.ndarray]:
    """(whole passes, further documents of each length)."""
    whole = int((length * count).sum())
    if whole <= 0 or budget <= 0 or most <= 0:
        return 0, np.zeros(len(length), np.int64)
    passes = min(most, budget // whole)
    rest = budget - passes * whole if passes < most else 0
    take, given, aim = np.zeros(len(length), np.int64), 0, 0.0
    for k in np.argsort(-length, kind="stable"):
        aim += count[k] * length[k] * max(0, rest - SLACK) / whole
        take[k] = max(0, min(int(count[k]), int((aim - given) // length[k])))
        given += take[k] * length[k]
    return int(passes), take + knapsack(int(rest - given), length, count - take)


def mix(items: DataFrame, targets: DataFrame, seed: int = SEED, ranked: int = RANKED) -> tuple[DataFrame, DataFrame]:
    """(list, shares). list: (mix_id, doc_id, source, tokens, copies) with copies >= 1. shares: a row for each
    target, with its budget and what it got.

    items: (doc_id, source, tokens); documents of no tokens or a null source are in no mix, but count nothing
    either way. targets: (mix_id, source, weight, max_repeats, size_factor); null and negative weights count as 0,
    and sources without documents keep their budget unfilled: budgets of the others do not grow. A repeated
    (mix_id, source) counts as one target with the summed weight and the larger limit."""
    items = cut(items.where("tokens > 0").select("doc_id", "source", "tokens"))
    total = items.agg(F.sum("tokens")).first()[0] or 0
    w = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    one = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.sum(F.when(F.isnan(w), 0.0).otherwise(w)).alias("weight"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("most"), F.max("size_factor").alias("factor"))
    size = one.groupBy("mix_id").agg(F.sum("weight").alias("all"), F.max("factor").alias("f"))
    one = one.join(size, "mix_id").withColumn("share", F.coalesce(F.try_divide("weight", "all"), F.lit(0.0))).withColumn("budget", F.round(F.col("share") * F.coalesce("f", F.lit(0.0)) * total).cast("long"))
    one = cut(one.select("mix_id", "source", "share", "budget", "most"))
    hist = cut(items.groupBy("source", "tokens").agg(F.count("*").alias("n")))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        length, count = pdf.tokens.to_numpy(np.int64), pdf.n.to_numpy(np.int64)
        passes, more = quotas(int(pdf.budget.iloc[0]), length, count, int(pdf.most.iloc[0]))
        return pd.DataFrame({"mix_id": key[0], "source": key[1], "tokens": length, "n": count, "passes": passes, "more": more})

    plan = one.join(hist, "source").groupBy("mix_id", "source").applyInPandas(fit, "mix_id int, source string, tokens int, n long, passes int, more long")
    plan = cut(plan.where("passes > 0 or more > 0"))

    salts = F.ceil(F.col("n") / ranked)
    salt = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("salts"))
    docs = items.join(hist.select("source", "tokens", salts.alias("salts")), ["source", "tokens"]).withColumn("salt", salt)
    # Quotas of salted lengths: salts are filled in turn
    parts = docs.where("salts > 1").groupBy("source", "tokens", "salt").agg(F.count("*").alias("m"))
    before = F.sum("m").over(W.partitionBy("source", "tokens").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0)))
    near = docs.join(plan.drop("n"), ["source", "tokens"]).join(parts, ["source", "tokens", "salt"], "left")
    near = near.where("more > 0 or passes > 0").withColumn("quota", F.when(F.col("m").isNull(), F.col("more")).otherwise(F.greatest(F.lit(0), F.least("m", F.col("more") - F.col("before")))))
    near = near.where("quota > 0 or passes > 0")  # what is in no list need not be ranked
    draw = F.xxhash64("doc_id", "mix_id", F.lit(seed + 1))
    rank = F.row_number().over(W.partitionBy("mix_id", "source", "tokens", "salt").orderBy(draw, "doc_id"))
    copies = (F.col("passes") + (F.col("rank") <= F.col("quota")).cast("int")).alias("copies")
    chosen = near.withColumn("rank", rank).select("mix_id", "doc_id", "source", "tokens", copies).where("copies > 0")

    got = plan.groupBy("mix_id", "source").agg(F.sum((F.col("passes") * F.col("n") + F.col("more")) * F.col("tokens")).alias("got"), F.sum(F.col("passes") * F.col("n") + F.col("more")).alias("documents"))
    all_got = F.sum("got").over(W.partitionBy("mix_id"))
    shares = one.join(got, ["mix_id", "source"], "left").na.fill(0, ["got", "documents"]).withColumn("actual", F.coalesce(F.try_divide("got", all_got), F.lit(0.0)))
    shares = shares.select("mix_id", "source", F.round("share", 6).alias("target_share"), "budget", "got", "documents", F.round("actual", 6).alias("actual_share"))
    return chosen, shares


def p8_mix(spark: SparkSession, sf: str, path: str = VOCABULARY) -> DataFrame:
    return mix(sized(table(spark, sf, "documents"), path), table(spark, sf, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf: str, path: str = VOCABULARY) -> DataFrame:
    return mix(sized(table(spark, sf, "documents"), path), table(spark, sf, "mix_targets"))[1]
