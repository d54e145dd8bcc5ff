"""Choosing a varied subset (problem 5): a fixed-size weighted sample against local density.

Each repeat hashes a text's 3-grams by one locality-sensitive function, `bands` minima of independent hashes, so
similar texts often share a bucket and others hardly do. A text's density is the mean size of its buckets over the
repeats. Texts are drawn without replacement with probability in proportion to 1 / density: each gets an
exponential waiting time with that rate from a seeded hash, and the smallest `size` are taken (the weighted
reservoir of Efraimidis and Spirakis, 2006).

Buckets are counted by a partial aggregate and an equi-join, so a crowd is never gathered in one task. The cut is
found by counting in ever finer ranges of waiting times: only the rows of one last cell are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resiq.functions.lcs import residue_codes
from resiq.functions.text import residues
from resiq.llm.grams import mix
from resiq.operators.screen import nth
from resiq.session import cut, table

SEED = 11
GRAM, REPEATS, BANDS = 3, 8, 2


def lsh_buckets(texts: DataFrame, repeats: int = REPEATS, bands: int = BANDS) -> DataFrame:
    """(id, r, bucket): a bucket for each repeat r of each text; texts shorter than a 3-gram hash as a whole."""

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat, start, size = residue_codes(b.column("res"))
            code = np.zeros(len(flat), np.uint32)
            for k in range(GRAM):
                code[: len(flat) - k] = code[: len(flat) - k] * np.uint32(27) + flat[k:] + np.uint32(1)
            # a text of under 3 letters takes what follows; it gets its own letters instead
            short = np.flatnonzero(size < GRAM)
            owner = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(flat)) - np.repeat(start, size)
            ok = place <= np.maximum(size[owner] - GRAM, 0)
            code, owner = code[ok], owner[ok]
            for t in short:
                code[owner == t] = np.uint32(1 << 20) + sum(int(flat[start[t] + k] + 1) * 27**k for k in range(size[t]))
            count = np.bincount(owner, minlength=len(size))
            full = np.flatnonzero(count)
            edges = (np.cumsum(count) - count)[full]
            ids = b.column("id").to_numpy()
            for r in range(repeats):
                bucket = np.zeros(len(size), np.uint64)
                for band in range(bands):
                    h = mix(code ^ mix(np.array([SEED + 7919 * (r * bands + band)], np.uint32)))
                    least = np.zeros(len(size), np.uint32)
                    least[full] = np.minimum.reduceat(h, edges) if len(edges) else least[full]
                    bucket = (bucket << np.uint64(32)) | least
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), r, np.int32)), pa.array(bucket.view(np.int64))], ["id", "r", "bucket"])

    return texts.select("id", "res").mapInArrow(hash_all, "id long, r int, bucket long")


def densities(texts: DataFrame, repeats: int = REPEATS, bands: int = BANDS) -> DataFrame:
    """(id, density): the mean number of texts in the buckets of each text, itself included."""
    at = lsh_buckets(texts, repeats, bands)
    shared = at.groupBy("r", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    return at.join(shared, ["r", "bucket"], "left").groupBy("id").agg((F.sum(F.coalesce("n", F.lit(1))) / repeats).alias("density"))


def choose(scored: DataFrame, size: int, seed: int = SEED) -> DataFrame:
    """The `size` rows of (id, density) that come first; all rows if there are fewer. Ties go to the smaller id."""
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    wait = -F.log(u) * F.col("density")
    timed = cut(scored.withColumn("wait", wait).withColumn("cell", F.floor(wait * 1e6)))  # cells of a millionth hold few rows
    if size <= 0:
        return timed.limit(0).drop("cell")
    edge = nth(timed, "cell", size)
    if edge is None:
        return timed.drop("cell")
    sure = timed.where(F.col("cell") < edge)
    last = timed.where(F.col("cell") == edge).orderBy("wait", "id").limit(size - sure.count())
    return sure.unionAll(last).drop("cell")


def varied(rows: DataFrame, size: int | None = None, share: float = 0.05, seed: int = SEED, **lsh) -> DataFrame:
    """(id, density) of a varied subset of the texts of rows (id, res), one row a text: the first of its copies.

    `size` texts, or by default `share` of them (at least one). Null and empty texts are never chosen."""
    texts = cut(rows.where("length(res) > 0").groupBy("res").agg(F.min("id").alias("id")))
    size = max(1, round(share * texts.count())) if size is None else size
    return choose(densities(texts, **lsh), size, seed).select("id", "density")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    cluster = F.nullif(F.lower(F.trim("cluster")), F.lit(""))
    return table(spark, sf, "scored_candidates").select(F.col("ord").alias("id"), residues(F.col("seq")).alias("res"), cluster.alias("cluster"))


def p5_subset(spark: SparkSession, sf: str, size: int | None = None) -> DataFrame:
    """The chosen rows: (ord, cluster, residues, density)."""
    rows = candidates(spark, sf)
    return varied(rows, size).join(rows, "id").select(F.col("id").alias("ord"), "cluster", F.col("res").alias("residues"), "density")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per cluster: texts, their share, chosen texts, their share, and the mean density of either."""
    rows = candidates(spark, sf)
    texts = cut(rows.where("length(res) > 0").groupBy("res").agg(F.min_by("cluster", "id").alias("cluster"), F.min("id").alias("id")))
    scored = cut(densities(texts))
    chosen = choose(scored, max(1, round(0.05 * texts.count()))).select("id", F.lit(1).alias("hit"))
    per = texts.join(scored, "id").join(chosen, "id", "left").groupBy("cluster").agg(F.count("*").alias("n_texts"), F.count("hit").alias("n_chosen"), F.avg("density").alias("density"), F.avg(F.when(F.col("hit") == 1, F.col("density"))).alias("chosen_density"))
    sums = per.agg(F.sum("n_texts").alias("a"), F.sum("n_chosen").alias("b")).first()
    return per.select("cluster", "n_texts", F.round(F.col("n_texts") / (sums.a or 1), 6).alias("share"), "n_chosen", F.round(F.col("n_chosen") / (sums.b or 1), 6).alias("chosen_share"), F.round("density", 3).alias("mean_density"), F.round("chosen_density", 3).alias("mean_density_chosen"))
