"""Near-duplicate pairs (problem 4), their groups, and the shared preparation of sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resiq.functions.text import residues
from resiq.llm.blockjoin import HOT, broadcast_table, key_table, meet, shared_keys, shared_of
from resiq.llm.grams import Counts, Postings, Ranking, Texts, token_counts
from resiq.operators.graph import connected_components
from resiq.session import cut, table

#: Only sequences of so many residues count.
LEAST = 25
#: Alike: indel ratio above 4/5.
RATIO = (4, 5)
#: A text's id is its first row's ord times this, plus the group.
GROUPS = 256


def eligible(df: DataFrame, column: str, least: int = LEAST) -> DataFrame:
    """df with `res`, without rows whose residues are null or too few."""
    return df.withColumn("res", residues(F.col(column))).where(F.length("res") >= least)


def copies(df: DataFrame, column: str, grp: int = 0, least: int = LEAST, order: str = "ord", *more: str) -> DataFrame:
    """(ord, res, grp, *more) of the rows that count."""
    return eligible(df, column, least).select(F.col(order).alias("ord"), "res", F.lit(grp).alias("grp"), *more)


def text_key(grp="grp") -> list:
    """128 bits for a text: different texts share them with a chance below 1e-16 among 1e11 texts."""
    return [F.xxhash64(grp, "res").alias("k1"), F.xxhash64("res", F.lit(7), grp).alias("k2")]


def texts_of(rows: DataFrame, *aggs, first=None) -> DataFrame:
    """One row a different text of a group: (tid, res, grp, n, *aggs); a checkpoint, as it is read several times.
    first: an aggregate that picks one of a text's ords, the smallest by default."""
    own = rows.groupBy("grp", "res").agg((F.min("ord") if first is None else first).alias("first"), F.count("*").alias("n"), *aggs)
    return cut(own.withColumn("tid", F.col("first") * GROUPS + F.col("grp")).drop("first"))


def rows_of(rows: DataFrame, texts: DataFrame, *more: str) -> DataFrame:
    """(tid, ord, *more) of the rows of texts that have several. The key is a hash of the text, so sequences aren't
    shuffled again; a text that holds a third of all rows is a skewed inner join, which adaptive execution splits."""
    many = texts.where("n > 1").select("tid", *text_key())
    return rows.select("ord", *more, *text_key()).join(many, ["k1", "k2"]).select("tid", "ord", *more)


#: Retained values of a sketch.
SKETCH = 32
#: Tokens of more texts than this come later in the order of hashes, the commoner the later: a token that a large part of
#: the texts has tells little, and its list would be the longest.
COMMON = 1024


def bottom_k(k: int = SKETCH, counts: Counts | None = None, table=None) -> Ranking:
    """Sketches: the k tokens of smallest hash. With `counts`, the hashes of tokens of more than COMMON texts rise by
    class, a class for each doubling."""
    if counts is not None:
        late = np.clip((counts.df.astype(np.int64) - 8 * int(np.log2(COMMON)) + 7) // 8, 0, 254).astype(np.uint8)
        table = table(late) if table else late
    return Ranking(lambda n: np.full(n.shape, k), table)


def sketch_verify(k: int, estimate: float, jaccard: float):
    """Union sketches estimate the Jaccard similarity of token sets: of the k smallest hashes of the union,
    the share that both sketches hold. Pairs at or above `estimate` get the exact similarity, which must
    reach `jaccard`."""

    def verify(t: Texts, p: Postings, count: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sketch, size = key_table(p, count, k), np.minimum(count, k)  # the first keys of all are the sketch
        hits, union = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for rows, one, two, hit in shared_keys(sketch, count, a, b):
            # The place in the union of each value that both hold; values up to k count
            kind = np.uint8 if k < 128 else np.int64
            place, upto = np.arange(1, len(one) + 1, dtype=kind)[:, None] - np.cumsum(hit, axis=0, dtype=kind), np.zeros(one.shape, bool)
            for key in two:
                place += np.less_equal(key, one, out=upto).view(np.uint8)
            hits[rows] = (hit & (place <= k)).sum(axis=0)
            union[rows] = np.minimum(k, size[a[rows]] + size[b[rows]] - hit.sum(axis=0))
        ok = np.flatnonzero(hits >= estimate * union)
        e = shared_of(p, count, a[ok], b[ok])
        both = np.bincount(e.pair, minlength=len(ok))
        out = np.zeros(len(a), bool)
        out[ok] = both >= jaccard * (e.one + e.two - both)
        return out

    return verify


def similar_texts(texts: DataFrame, k: int = SKETCH, estimate: float = 0.03, jaccard: float = 0.03, ratio: tuple[int, int] = RATIO, hot: int = HOT, **how) -> DataFrame:
    """Pairs (a, b) of different texts whose 5-gram sketches overlap and whose indel ratio is above `ratio`.

    The thresholds on 5-grams are low because one edit breaks five of them: at a ratio of 0.8 and
    30 residues two of 26 5-grams may be left. The ratio decides last."""
    plain = texts.select("tid", "res", "grp", F.lit(0).alias("x"))
    counts = token_counts(plain, hot, COMMON)
    ranking = bottom_k(k, counts, lambda late: broadcast_table(texts.sparkSession, late))
    return meet(plain, ranking, sketch_verify(k, estimate, jaccard), ratio, counts, hot=hot, **how)


def near_pairs(rows: DataFrame, **how) -> DataFrame:
    """(grp, ord_a, ord_b), ord_a < ord_b: pairs of rows of one group whose residues differ and are alike.

    rows: (ord, res, grp), ord unique in its group, grp below 256. Copies of a text count as one text until
    the end. Empty input gives no rows; rows without residues must have been left out (see `copies`)."""
    texts = texts_of(rows)
    members = rows_of(rows, texts)
    out = similar_texts(texts, **how)
    for side in "ab":
        out = out.join(members.select(F.col("tid").alias(side), F.col("ord").alias(f"of_{side}")), side, "left")
        out = out.withColumn(f"of_{side}", F.coalesce(f"of_{side}", F.shiftright(side, 8)))
    return out.select((F.col("a") % GROUPS).cast("int").alias("grp"), F.least("of_a", "of_b").alias("ord_a"), F.greatest("of_a", "of_b").alias("ord_b"))


TABLES = {0: ("scored_candidates", "seq"), 1: ("controllability_sequences", "sequence")}


def both_tables(spark: SparkSession, sf: str) -> DataFrame:
    one, two = (copies(table(spark, sf, name), column, grp) for grp, (name, column) in TABLES.items())
    return one.unionAll(two)


def named(c: str = "grp"):
    return F.when(F.col(c) == 0, F.lit(TABLES[0][0])).otherwise(F.lit(TABLES[1][0]))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_pairs(both_tables(spark, sf)).select(named().alias("table_name"), "ord_a", "ord_b")


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row a row of the two tables that is alike to some other text: its group (the smallest ord in it), its
    text's first row and the number of its alike texts."""
    rows = both_tables(spark, sf)
    texts = texts_of(rows)
    links = cut(similar_texts(texts))
    degree = links.select(F.col("a").alias("tid")).unionAll(links.select("b")).groupBy("tid").agg(F.count("*").alias("links"))
    group = connected_components(links, "a", "b").withColumnRenamed("node", "tid")
    return (
        group.join(degree, "tid").join(rows_of(rows, texts), "tid", "left")
        .select(named_of("tid"), F.coalesce("ord", F.shiftright("tid", 8)).alias("ord"), F.shiftright("tid", 8).alias("text_ord"), F.shiftright("component", 8).alias("group_ord"), "links")
    )


def named_of(tid: str):
    return F.when(F.col(tid) % GROUPS == 0, F.lit(TABLES[0][0])).otherwise(F.lit(TABLES[1][0])).alias("table_name")
