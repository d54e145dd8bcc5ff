"""Aggregations, distributions and two-sample statistics (D, L1-L3).

All descriptors go through one grouped plan over (descriptor, class, value); no loop over columns. Quantiles, ranks
and distribution functions come from counts by value and running sums over ranges of values (`ranks.running`), so no
group of values is ever in one task, however many different ones it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resiq.operators.ranks import attach, running
from resiq.session import cut

PERCENTS = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)


def long_form(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """(*keep, descriptor, value) without nulls and NaNs."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("descriptor"), F.col(c).cast("double").alias("value")) for c in columns)))
    return df.select(*keep, pairs.alias("p")).select(*keep, "p.*").where("value is not null and not isnan(value)")


def finite(df: DataFrame) -> DataFrame:
    return df.where(F.abs("value") < float("inf"))


def quantiles(long: DataFrame, keys: list[str], probs: tuple[float, ...], value: str = "value") -> DataFrame:
    """(*keys, q): exact quantiles of the value by key, linear between ranks. Rows with a null key or value are left
    out; a key without values has no row. Only the rows that hold a wanted rank are gathered."""
    rows = long.select(*keys, F.col(value).alias("value")).where(" and ".join(f"{k} is not null" for k in [*keys, "value"]))
    walk = running(rows.groupBy(*keys, "value").agg(F.count("*").alias("n")), [*keys, "value"], {"before": "n"})
    base = walk.groupBy(*keys).agg(F.min("before").alias("base"), F.sum("n").alias("total"))
    own = walk.join(base, keys) if keys else attach(walk, base)
    at = F.col("before") - F.col("base")
    place = lambda p: (F.col("total") - 1) * F.lit(p)
    held = lambda k: F.max(F.when((at <= k) & (k < at + F.col("n")), F.col("value")))
    ends = own.groupBy(*keys).agg(F.max("total").alias("total"), *(held(f(place(p))).alias(f"{s}{i}") for i, p in enumerate(probs) for s, f in (("lo", F.floor), ("hi", F.ceil))))
    between = lambda i, p: F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (place(p) - F.floor(place(p)))
    return ends.select(*keys, F.array(*(between(i, p) for i, p in enumerate(probs))).alias("q"))


def distribution_summary(long: DataFrame, *keys: str) -> DataFrame:
    """Mean, sample deviation, extremes and seven quantiles (linear between ranks) by key."""
    per = long.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    per = per.join(quantiles(long, list(keys), PERCENTS), list(keys))
    return per.select(*keys, "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")), *(F.round(F.col("q")[i], 6).alias(f"q{int(p * 100):02d}") for i, p in enumerate(PERCENTS)))


def histogram(long: DataFrame, cls: str, bins: int = 50, tails: float = 0.005) -> DataFrame:
    """(descriptor, class, bin, n, density): equal bins between the pooled tail quantiles; the last one is closed,
    values outside are dropped, and equal ends fall back to the extremes. Empty bins have no row."""
    ends = long.groupBy("descriptor").agg(F.min("value").alias("a"), F.max("value").alias("b")).join(quantiles(long, ["descriptor"], (tails, 1 - tails)), "descriptor")
    flat = F.abs(F.col("q")[0] - F.col("q")[1]) <= 1e-9 * F.greatest(F.abs(F.col("q")[0]), F.abs(F.col("q")[1]))
    ends = ends.select("descriptor", F.when(flat, F.col("a")).otherwise(F.col("q")[0]).alias("lo"), F.when(flat, F.col("b")).otherwise(F.col("q")[1]).alias("hi"))
    own = long.join(F.broadcast(ends), "descriptor").where("value between lo and hi")  # one row a descriptor
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    counts = own.groupBy("descriptor", cls, place.cast("int").alias("bin"), width.alias("width")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("descriptor", cls))  # at most `bins` rows
    return counts.select("descriptor", cls, "bin", "n", F.round(F.try_divide(F.col("n"), total * F.col("width")), 6).alias("density"))


def pearson(a: str, b: str) -> Column:
    """Correlation; null for fewer than three rows or no variance."""
    ok = (F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)) >= 3) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return F.when(ok, F.corr(a, b))


def normalizer(long: DataFrame) -> DataFrame:
    """Mean, sample deviation of at least 1e-6, and deciles 1, 5, 9 of each descriptor."""
    per = long.groupBy("descriptor").agg(F.avg("value").alias("mean"), F.greatest(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), F.lit(1e-6)).alias("std"))
    per = per.join(quantiles(long, ["descriptor"], (0.1, 0.5, 0.9)), "descriptor")
    return per.select("descriptor", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p10", "p50", "p90"))))


def finite_points(df: DataFrame, *columns: str) -> DataFrame:
    """df without rows in which one of the columns is null, NaN or infinite."""
    return df.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in columns))


def compare(long: DataFrame, cls: str, one: str, two: str) -> DataFrame:
    """L1: for each descriptor the two classes' sizes, means, medians and quartiles, Mann-Whitney's U and its
    asymptotic two-sided p (tie-corrected, continuity-corrected), Cliff's delta, the Kolmogorov-Smirnov distance and
    its asymptotic p, and the Wasserstein distance, also by the pooled interquartile range (null if that is 0).
    A descriptor that a class lacks has no row."""
    long = cut(finite(long).where(F.col(cls).isin(one, two)).select("descriptor", F.when(F.col(cls) == one, "one").otherwise("two").alias("side"), "value"))
    is_one = F.col("side") == "one"
    by_value = long.groupBy("descriptor", "value").agg(F.count_if(is_one).alias("n1"), F.count_if(~is_one).alias("n2"))
    walk = running(by_value, ["descriptor", "value"], {"below1": "n1", "below2": "n2"})
    sizes = walk.groupBy("descriptor").agg(F.sum("n1").alias("n_one"), F.sum("n2").alias("n_two"), F.min("below1").alias("base1"), F.min("below2").alias("base2")).where("n_one > 0 and n_two > 0")
    own = walk.join(sizes, "descriptor").withColumns({"below1": F.col("below1") - F.col("base1"), "below2": F.col("below2") - F.col("base2")})
    gap = lambda a, b: F.abs(a / F.col("n_one") - b / F.col("n_two"))
    before, after = gap(F.col("below1"), F.col("below2")), gap(F.col("below1") + F.col("n1"), F.col("below2") + F.col("n2"))
    t = (F.col("n1") + F.col("n2")).cast("double")
    sums = own.groupBy("descriptor").agg(
        F.max("n_one").alias("n_one"), F.max("n_two").alias("n_two"),
        F.sum(F.col("n1") * (F.col("below2") + F.col("n2") / 2)).alias("u"),
        F.max(after).alias("ks"),
        # Sum of gaps times steps to the next value, by parts: no row needs the next one
        F.sum(F.col("value") * (before - after)).alias("wd"),
        F.sum(t * t * t - t).alias("ties"),
    )
    means = long.groupBy("descriptor").agg(F.avg(F.when(is_one, F.col("value"))).alias("one_mean"), F.avg(F.when(~is_one, F.col("value"))).alias("two_mean"))
    by_side = quantiles(long, ["descriptor", "side"], (0.25, 0.5, 0.75)).groupBy("descriptor").agg(F.max(F.when(is_one, F.col("q"))).alias("one_q"), F.max(F.when(~is_one, F.col("q"))).alias("two_q"))
    pooled = quantiles(long, ["descriptor"], (0.25, 0.75)).withColumnRenamed("q", "pooled")
    sums = sums.join(means, "descriptor").join(by_side, "descriptor").join(pooled, "descriptor")
    x, y = F.col("n_one").cast("double"), F.col("n_two").cast("double")
    n = x + y
    var = x * y / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - x * y / 2) - 0.5, F.lit(0.0)), F.sqrt(var))
    iqr = F.col("pooled")[1] - F.col("pooled")[0]
    cols = {
        "one_mean": F.col("one_mean"), "two_mean": F.col("two_mean"),
        **{f"{s}_{k}": F.col(f"{s}_q")[i] for s in ("one", "two") for i, k in enumerate(("q25", "median", "q75"))},
        "mwu_u": F.col("u"), "cliffs_delta": 2 * F.col("u") / (x * y) - 1, "mwu_p": F.least(F.lit(1.0), 2 * upper_tail(z)),
        "ks": F.col("ks"), "ks_p": kolmogorov(F.sqrt(x * y / n) * F.col("ks")),
        "wasserstein": F.col("wd"), "wasserstein_iqr": F.try_divide(F.col("wd"), F.when(iqr > 0, iqr)),
    }
    return sums.select("descriptor", "n_one", "n_two", *(F.round(c, 6).alias(k) for k, c in cols.items()))


def upper_tail(z: Column) -> Column:
    """1 - Phi(z) for z >= 0 by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    x = z / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * poly * F.exp(-x * x)


def normal_cdf(z: Column) -> Column:
    """H7: Phi(z), with the approximation above on both sides."""
    tail = upper_tail(F.abs(z))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def kolmogorov(x: Column) -> Column:
    """Upper tail of Kolmogorov's distribution: the first terms of its series; 1 where it starts."""
    terms = [(-1) ** (k - 1) * 2 * F.exp(-2.0 * k * k * x * x) for k in range(1, 21)]
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(terms[1:], terms[0]))))


def spearman(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """L2: (a, b, rho) of each pair of columns over the rows that have all of them."""
    from resiq.operators.ranks import average_ranks

    good = df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in columns)).select(key, *columns)
    ranks = None
    for c in columns:
        r = average_ranks(good, key, c, c)
        ranks = r if ranks is None else ranks.join(r, key)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = ranks.agg(*(F.round(F.corr(a, b), 6).alias(f"{a}|{b}") for a, b in pairs))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs)))
    return one.select(rows.alias("p")).select("p.*")
