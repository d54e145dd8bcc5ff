"""Seeded samples, matched cohorts and splits (J). Draws are hash-ordered: MD5 of the seed and the id, then the id.

A quota of each length is met by salting large lengths: rows are ranked within (length, salt) and salts are filled in
turn, so a length that holds a third of all rows is never ranked in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resiq.operators.ranks import running

#: Rows of a group beyond which it is ranked in several parts of about this many.
RANKED = 100_000


def draw(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample(df: DataFrame, key: str, size: int | None, seed: int = 42) -> DataFrame:
    """`size` rows without replacement, all if there are fewer or size is null."""
    return df if size is None else df.orderBy(draw(key, seed), key).limit(size)


def take_by_group(df: DataFrame, group: str, key: str, quotas: DataFrame, seed: int = 42, ranked: int = RANKED) -> DataFrame:
    """The first rows of each group in the order of the draw... of a salt, as many as `quotas` (group, want) says."""
    counts = df.groupBy(group).agg(F.count("*").alias("__n")).select(F.col(group).alias("__g"), F.ceil(F.col("__n") / ranked).alias("__salts"))
    own = df.join(counts, df[group].eqNullSafe(counts["__g"])).withColumn("__salt", F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.col("__salts"))).drop("__g", "__salts")
    parts = own.groupBy(group, "__salt").agg(F.count("*").alias("__m"))
    before = F.coalesce(F.sum("__m").over(W.partitionBy(group).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("__before", before).join(quotas, group).select(F.col(group).alias("__g"), F.col("__salt").alias("__s"), (F.col("want") - F.col("__before")).alias("__want"))
    rank = F.row_number().over(W.partitionBy(group, "__salt").orderBy(draw(key, seed), key))
    near = own.join(parts, own[group].eqNullSafe(parts["__g"]) & (own["__salt"] == parts["__s"])).where("__want > 0")
    return near.withColumn("__rank", rank).where("__rank <= __want").select(*df.columns)


def length_matched(background: DataFrame, wanted: DataFrame, key: str = "ord", length: str = "length", seed: int = 42) -> DataFrame:
    """Rows of the background with the lengths of `wanted`, as many of each; fails with the shortage of each length
    if there are too few."""
    want = wanted.groupBy(length).agg(F.count("*").alias("want"))
    short = want.join(background.groupBy(length).agg(F.count("*").alias("have")), length, "left").where("want > coalesce(have, 0)")
    missing = {r[0]: r[1] for r in short.select(length, F.col("want") - F.coalesce("have", F.lit(0))).collect()}  # a row a length
    if missing:
        raise ValueError(f"too few sequences by length: {missing}")
    return take_by_group(background, length, key, want, seed)


def length_matched_pairs(one: DataFrame, two: DataFrame, key: str = "ord", length: str = "length", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows of both tables, of each common length the smaller of the two numbers."""
    n1, n2 = (d.groupBy(length).agg(F.count("*").alias(n)) for d, n in ((one, "a"), (two, "b")))
    want = n1.join(n2, length).select(length, F.least("a", "b").alias("want"))
    return take_by_group(one, length, key, want, seed), take_by_group(two, length, key, want, seed)


def stratified_split(df: DataFrame, key: str, stratum: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Df with `split`: of each stratum round-half-even(n x share) rows go to val, at least one of ten or more, but
    one at least stays in train; single rows are train."""
    n = df.groupBy(stratum).agg(F.count("*").alias("n"))
    val = F.rint(F.col("n") * share)
    want = F.least(F.when(F.col("n") >= 10, F.greatest(val, F.lit(1.0))).otherwise(val), F.col("n") - 1)
    held = take_by_group(df.select(key, stratum), stratum, key, n.select(stratum, want.cast("long").alias("want")), seed).select(key, F.lit("val").alias("split"))
    return df.join(held, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def pair_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """(a, b): n different unordered pairs of ids, all of them if there are fewer, without forming all pairs of a table
    that has many more: each draw takes two rows by their places, equal and repeated ones fall out, and draws go on
    until there are enough. A table of at most 4n pairs is taken in full, in the order of a hash."""
    from resiq.operators.ranks import positions
    from resiq.session import cut

    rows = cut(positions(df.select(key), [draw(key, seed), F.col(key)], "place"))
    total, spark = rows.count(), df.sparkSession
    most = total * (total - 1) // 2
    if most <= 0 or n <= 0:
        return spark.createDataFrame([], f"a {dict(df.dtypes)[key]}, b {dict(df.dtypes)[key]}")
    if most <= 4 * n:
        at = spark.range(total * total).select((F.floor(F.col("id") / total) + 1).alias("i"), (F.col("id") % total + 1).alias("j")).where("i < j")
        both = at.join(rows.toDF("a", "i"), "i").join(rows.toDF("b", "j"), "j")
        return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).orderBy(F.md5(F.concat_ws(":", F.lit(seed), "a", "b"))).limit(n)
    place = lambda s: F.conv(F.substring(F.md5(F.concat(F.lit(f"{s}:"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long") % total + 1
    draws = 2 * n + 16
    while True:
        at = spark.range(draws).select("id", place(seed).alias("i"), place(seed + 1).alias("j"))
        both = at.join(rows.toDF("a", "i"), "i").join(rows.toDF("b", "j"), "j").where("i <> j")
        once = cut(both.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("id").alias("id")))
        if once.count() >= n:
            return once.orderBy("id").limit(n).select("a", "b")
        draws *= 2


def dealt(load: list[int], n: int, many: int) -> list[int]:
    """How many of `many` groups of size n each fold gets if each goes to the lightest one (the first on ties), without
    a step for each group: folds are filled up to a common level, the few groups left go one by one. load is raised."""
    got = [0] * len(load)
    below = lambda level: [max(0, -(-(level - x) // n)) for x in load]
    lo, hi = min(load), max(load) + n * (many + 1)
    while lo < hi:  # the highest level that all groups reach
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if sum(below(mid)) <= many else (lo, mid - 1)
    for f, k in enumerate(below(lo)):
        got[f], load[f] = k, load[f] + k * n
    for _ in range(many - sum(got)):
        f = min(range(len(load)), key=lambda j: (load[j], j))
        got[f], load[f] = got[f] + 1, load[f] + n
    return got


def group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """(group, fold): groups by falling size, each to the fold with the fewest rows so far (the smaller one on ties).

    Groups of one size are alike to the rule: their order by id is cut into a range a fold. So only sizes and their
    frequencies come to the driver, and what goes back is a row for each size and fold."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    load, plan = [0] * folds, []
    for n, many in sorted(((r.n, r.k) for r in sizes.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True):
        start = 0
        for f, k in enumerate(dealt(load, n, many)):
            if k:
                plan.append((n, start, start + k, f))
                start += k
    deal = df.sparkSession.createDataFrame(plan, "n long, start long, stop long, fold int")
    placed = running(sizes.withColumn("one", F.lit(1)), ["n", group], {"before": "one"})
    base = placed.groupBy("n").agg(F.min("before").alias("base"))
    at = F.col("before") - F.col("base")
    return placed.join(base, "n").join(deal, "n").where((at >= F.col("start")) & (at < F.col("stop"))).select(group, "fold")


def locked_split(df: DataFrame, group: str, stratum: str | None = None, share: float = 0.18, seed: int = 42) -> DataFrame:
    """(group, split): whole groups to test. Without strata max(1, round-half-even(share x groups)); with a stratum
    (a group's commonest value, the smallest on ties) the same of each stratum of four or more groups, one of two or
    three with probability `share`, none of one."""
    label = F.lit("all") if stratum is None else F.coalesce(F.mode(stratum, True).cast("string"), F.lit("NA"))
    groups = df.groupBy(group).agg(label.alias("label"))
    n = groups.groupBy("label").agg(F.count("*").alias("n"))
    many = F.greatest(F.rint(F.col("n") * share), F.lit(1.0))
    lucky = F.pmod(F.xxhash64("label", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
    want = many if stratum is None else F.when(F.col("n") >= 4, many).when((F.col("n") >= 2) & lucky, 1.0).otherwise(0.0)
    test = take_by_group(groups, "label", group, n.select("label", want.cast("long").alias("want")), seed).select(group, F.lit("test").alias("split"))
    return groups.select(group).join(test, group, "left").select(group, F.coalesce("split", F.lit("train")).alias("split"))
