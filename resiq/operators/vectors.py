"""Vectors, predictions as columns, uncertainty and applicability (M, L4-L7)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resiq.operators.blocks import nearest
from resiq.operators.stats import normal_cdf, quantiles

#: Ln 128, and the normal quantile of 0.975.
LOG_128 = math.log(128)
Z95 = 1.959963984540054


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalized(v: Column) -> Column:
    """M2: x / (|x| + 1e-8); the norm is taken once a vector."""
    return F.element_at(F.transform(F.array(F.struct(v.alias("v"), (norm(v) + 1e-8).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / s["n"])), 1)


def pooled(tokens: Column, mask: Column, how: str = "mean") -> Column:
    """M1: mean or max over the masked token vectors, or the first one (cls). Null if the mask is empty."""
    if how == "cls":
        return F.try_element_at(tokens, F.lit(1))
    live = F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda s: s["m"] != 0)
    vs = F.transform(live, lambda s: s["v"])
    first = F.try_element_at(vs, F.lit(1))
    rest = F.slice(vs, 2, F.greatest(F.size(vs), F.lit(1)))
    if how == "max":
        return F.aggregate(rest, first, lambda a, v: F.zip_with(a, v, lambda x, y: F.greatest(x, y)))
    total = F.aggregate(rest, first, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(vs))


def interval(mu: Column, sigma: Column) -> tuple[Column, Column]:
    """M9: the Gaussian 95 % interval."""
    return mu - Z95 * sigma, mu + Z95 * sigma


def hc50_report(df: DataFrame, mu: str, sigma: str, p_cal: str, q: float = 1.0) -> DataFrame:
    """M7: df with interval, probability of exceeding 128 and risk, from predicted log values."""
    s = F.greatest(F.col(sigma), F.lit(q / 1.96))
    lo, hi = interval(F.col(mu), s)
    p = 0.5 * F.col(p_cal) + 0.5 * (1 - normal_cdf((F.lit(LOG_128) - F.col(mu)) / F.greatest(s, F.lit(1e-6))))
    return df.withColumns({"hc50_um": F.exp(mu), "lower_95_um": F.exp(lo), "upper_95_um": F.exp(hi), "p_gt_128": p, "risk": 1 - p, "uncertainty": s})


def conformal_q(df: DataFrame, residual: str, alpha: float = 0.05) -> float:
    """M8: the quantile of absolute residuals at ceil((n + 1)(1 - alpha)) / n, at most 1; NaN without rows."""
    n = df.where(F.col(residual).isNotNull()).count()
    if not n:
        return math.nan
    return quantiles(df.select(F.abs(residual).alias("r")), [], (min(1.0, math.ceil((n + 1) * (1 - alpha)) / n),), "r").first()[0][0]


def applicability(queries: DataFrame, train: DataFrame, identity: str = "identity", percentile: float = 0.95, threshold: float = 0.40) -> DataFrame:
    """(id, emb_ood, phys_ood, in_domain, confidence) of queries (id, emb, phys, identity) against train (id, emb, phys).

    Features are scaled by the training mean and population deviation. The unit of a distance is the percentile of
    the training rows' distances to their nearest other one, over all of them (no subsample)."""
    dims = range(len(train.select("phys").first()[0])) if not train.isEmpty() else range(0)
    stats = train.agg(*(f(F.col("phys")[i]).alias(f"{n}{i}") for i in dims for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    z = F.array(*((F.col("phys")[i] - stats[f"m{i}"]) / (stats[f"s{i}"] + 1e-6) for i in dims))
    out = queries.select("id", identity)
    for name, v in (("emb", F.col("emb")), ("phys", z)):
        base, own = train.select("id", v.alias("v")), queries.select("id", v.alias("v"))
        found = quantiles(nearest(base, base), [], (percentile,)).first()
        unit = found[0][0] if found and found[0][0] is not None else 0.0
        out = out.join(nearest(own, base).select("id", (F.col("value") / max(unit, 1e-6)).alias(f"{name}_ood")), "id")
    inside = (F.col(identity) >= threshold * 0.5) & (F.col("emb_ood") <= 1.5) & (F.col("phys_ood") <= 1.5)
    sure = 0.4 * F.col(identity) + 0.3 / (1 + F.col("emb_ood")) + 0.3 / (1 + F.col("phys_ood"))
    return out.select("id", "emb_ood", "phys_ood", inside.alias("in_domain"), F.least(F.greatest(sure, F.lit(0.0)), F.lit(1.0)).alias("confidence"))


def votes(trees: Column, cut: float = 128.0, label: float = 100.0) -> Column:
    """Struct (share of trees above the cut, label by their mean). Null for no trees."""
    n = F.size(trees)
    mean = F.aggregate(trees, F.lit(0.0), lambda s, x: s + x) / F.nullif(n, F.lit(0))
    return F.struct((F.size(F.filter(trees, lambda x: x > cut)) / F.nullif(n, F.lit(0))).alias("share"), F.when(mean < label, "Hemolytic").when(mean.isNotNull(), "Non-Hemolytic").alias("label"))


def best_label(p: Column, labels: list[str]) -> Column:
    """Struct (label, p) of the largest probability, rounded to four decimals; the first on ties."""
    return F.struct(F.element_at(F.array(*(F.lit(x) for x in labels)), F.array_position(p, F.array_max(p)).cast("int")).alias("label"), F.round(F.array_max(p), 4).alias("p"))


def kernel_density(points: DataFrame, at: DataFrame, factor: float = 1.0) -> DataFrame:
    """(id, density) at the places `at` (id, x, y) of a Gaussian kernel estimate over points (x, y): covariance
    of the points times the square of Scott's factor n^(-1/6), times `factor`.

    Each map task sums its points' kernels at all places, which are a grid or another bounded set and travel with the
    task; only these sums are shuffled. Nulls, NaNs and infinities are left out; null density for fewer than three points
    or points on a line."""
    ok = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in "xy")
    points = points.where(ok).select("x", "y")
    n, a, b, c = points.agg(F.count("*"), F.var_samp("x"), F.covar_samp("x", "y"), F.var_samp("y")).first()
    det = (a * c - b * b) if n >= 3 else 0.0
    if not n or n < 3 or det <= 0:
        return at.select("id", F.lit(None).cast("double").alias("density"))
    scale = n ** (-1 / 3) * factor**2
    rows = at.where(ok).select("id", "x", "y").collect()  # the places: a grid of a stated size
    ids = np.array([r.id for r in rows], np.int64)
    place = np.array([(r.x, r.y) for r in rows], float).reshape(-1, 2)
    inverse = np.linalg.inv(np.array([[a, b], [b, c]]) * scale)
    weight = 1 / (n * 2 * math.pi * math.sqrt(det) * scale)
    root = np.linalg.cholesky(inverse)
    grid = place @ root

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids))
        for batch in batches:
            p = np.column_stack([batch.column(k).to_numpy() for k in "xy"]) @ root
            step = max(1, (1 << 21) // max(1, len(ids)))
            for lo in range(0, len(p), step):
                q = p[lo : lo + step]
                d = (grid**2).sum(1)[:, None] + (q**2).sum(1)[None, :] - 2 * grid @ q.T
                total += np.exp(-0.5 * np.maximum(d, 0)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "s"])

    own = points.mapInArrow(sums, "id long, s double").groupBy("id").agg((F.sum("s") * weight).alias("density"))
    return at.select("id").join(own, "id", "left")


def log_enrichment(one: Column, two: Column) -> Column:
    """Difference of the logarithms of two densities."""
    return F.log(one + 1e-12) - F.log(two + 1e-12)
