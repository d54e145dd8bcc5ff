"""Same or near-same sequences across splits (problem 6): a weighted cosine join with pruned inverted lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resiq.llm.blockjoin import HOT, LEFT, RIGHT, broadcast_table, meet, shared_of
from resiq.llm.grams import Counts, Postings, Ranking, Texts, regroup, token_counts, tokens
from resiq.llm.pairs import RATIO, copies, rows_of, texts_of
from resiq.session import table

TRAIN, EVAL = LEFT, RIGHT
#: Cosine of 5-gram vectors: 99.9 % of the alike pairs of the test tables reach it.
COSINE = 0.06


def norms(p: Postings, n: int, ranking: Ranking) -> np.ndarray:
    return np.sqrt(np.bincount(p.text, weights=ranking.weights(p.key) ** 2, minlength=n))


def term_weights(texts: DataFrame, counts: Counts, threshold: float = COSINE) -> Ranking:
    """Tokens weigh their inverse document frequency and come heaviest first; with the smallest norm of a vector over
    all texts, which the pruning bound by the largest weight needs."""
    ranking = Ranking(lambda n: n, broadcast_table(texts.sparkSession, counts.df), counts.idf())

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in regroup(batches):
            n = norms(tokens(t, ranking, whole=True), len(t), ranking)
            if (n > 0).any():
                yield pa.RecordBatch.from_arrays([pa.array([n[n > 0].min()])], ["norm"])

    norm = texts.select("tid", "res", "grp", "x").mapInArrow(least, "norm double").agg(F.min("norm")).first()[0]
    return replace(ranking, cosine=threshold, norm=norm or 1.0)


def cosine_verify(ranking: Ranking, threshold: float):
    """The exact dot product of unit vectors over all tokens."""

    def verify(t: Texts, p: Postings, count: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s, norm = shared_of(p, count, a, b), norms(p, len(t), ranking)
        dot = np.bincount(s.pair, weights=ranking.weights(s.key) ** 2, minlength=len(a))
        return dot >= threshold * norm[a] * norm[b]

    return verify


def cross_pairs(rows: DataFrame, threshold: float = COSINE, hot: int = HOT, **how) -> DataFrame:
    """(ord_a, ord_b): pairs of one row with side TRAIN and one with side EVAL of the same text or alike texts.

    rows: (ord, res, grp, side). Texts that both sides hold pair their own rows as well."""
    texts = texts_of(rows, F.bit_or("side").cast("int").alias("x"))
    counts = token_counts(texts, hot)
    ranking = term_weights(texts, counts, threshold)
    near = meet(texts, ranking, cosine_verify(ranking, threshold), RATIO, counts, cross=True, hot=hot, **how)
    same = texts.where(F.col("x") == TRAIN | EVAL).select(F.col("tid").alias("a"), F.col("tid").alias("b"))
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))  # the join runs once
    both = near.select(ways.alias("w")).select("w.a", "w.b").unionAll(same)
    single = texts.where("n = 1").select("tid", F.shiftright("tid", 8).alias("ord"), F.col("x").alias("side"))
    every = rows_of(rows, texts, "side").unionAll(single)
    train = every.where(F.col("side") == TRAIN).select(F.col("tid").alias("a"), F.col("ord").alias("i"))
    held = every.where(F.col("side") == EVAL).select(F.col("tid").alias("b"), F.col("ord").alias("j"))
    return both.join(train, "a").join(held, "b").select(F.least("i", "j").alias("ord_a"), F.greatest("i", "j").alias("ord_b"))


def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(F.col("split") == "train", TRAIN).when(F.col("split").isin("val", "test"), EVAL)
    df = table(spark, sf, "conditioned_peptides").withColumn("side", side).where("side is not null")
    return copies(df, "sequence", 0, 25, "ord", "side")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return cross_pairs(split_rows(spark, sf))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per split and source of the held-out row: rows, rows with a train overlap, pairs. A null source is told as null."""
    rows = table(spark, sf, "conditioned_peptides").where("split in ('val', 'test')").select("ord", "split", "source")
    pairs = p6_found(spark, sf)
    hit = pairs.select(F.col("ord_a").alias("ord")).unionAll(pairs.select("ord_b")).groupBy("ord").agg(F.count("*").alias("n"))
    return rows.join(hit, "ord", "left").groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
