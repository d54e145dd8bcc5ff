"""Grouping records into similarity clusters (problem 1): grid density clustering in SQL.

Two points are neighbours when each feature differs by at most its reach. Features become integers of a fixed
unit, so comparisons are exact. A grid cell is one unit wider than the reach: all points of a cell are
neighbours, and only adjacent cells can hold neighbours of each other. Whether two adjacent cells do is decided
exactly: beside each other by their extreme points, at a corner by their staircases of extreme points. Cells with
fewer than `dense` points take no part (1: every cell takes part, which gives the chains of TESTDATA.md).
The smallest label then spreads over the links of cells until nothing changes.

After the first aggregate everything is of the size of the grid, however many points a cell holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resiq.operators.graph import connected_components
from resiq.operators.ranks import positions
from resiq.session import cut, table

UNIT = 1_000_000
#: Values of this size and above have no neighbours (they would not fit the unit).
FAR = 1e12
REACH = (1.5, 0.1)


def whole(c: str) -> Column:
    """The feature in units; null for null, NaN, infinite and far values."""
    v = F.col(c)
    return F.when(~F.isnan(v) & (F.abs(v) < FAR), F.round(v * UNIT).cast("long"))


def points(df: DataFrame, x: str, y: str, *keep: str, reach: tuple[float, float] = REACH) -> DataFrame:
    """(x, y, cx, cy, cell, *keep) of the rows that have both features."""
    wide = [round(r * UNIT) + 1 for r in reach]
    out = df.select(whole(x).alias("x"), whole(y).alias("y"), *keep).where("x is not null and y is not null")
    cells = [((F.col(c) - F.pmod(F.col(c), F.lit(w))) / w).cast("long") for c, w in zip("xy", wide, strict=True)]
    return out.withColumns({"cx": cells[0], "cy": cells[1]}).withColumn("cell", F.concat_ws(":", "cx", "cy"))


def grid(pts: DataFrame, dense: int = 1) -> DataFrame:
    """(cell, cx, cy, y, lo, hi): of each dense cell and each y in it the smallest and largest x."""
    lines = pts.groupBy("cell", "cx", "cy", "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    if dense <= 1:
        return lines.drop("n")
    enough = lines.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= dense).select("cell")
    return lines.drop("n").join(enough, "cell")


def cell_links(lines: DataFrame, reach: tuple[float, float] = REACH) -> DataFrame:
    """(a, b): adjacent cells that hold neighbours of each other."""
    rx, ry = (round(r * UNIT) for r in reach)
    box = lines.groupBy("cell", "cx", "cy").agg(F.min("lo").alias("x0"), F.max("hi").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    a, b = (box.select(*(F.col(c).alias(s + c) for c in box.columns)) for s in "ab")
    right = a.join(b, (F.col("bcx") == F.col("acx") + 1) & (F.col("bcy") == F.col("acy"))).where(F.col("bx0") - F.col("ax1") <= rx)
    above = a.join(b, (F.col("bcx") == F.col("acx")) & (F.col("bcy") == F.col("acy") + 1)).where(F.col("by0") - F.col("ay1") <= ry)

    def stairs(side: str, up: bool) -> DataFrame:
        """Points of a cell with none both nearer to the right (or left) edge and nearer to the upper (or lower) one."""
        order = F.col("y").desc() if up else F.col("y").asc()
        w = W.partitionBy("cell").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        best = F.max("hi").over(w) if side == "right" else F.min("lo").over(w)
        x = F.col("hi") if side == "right" else F.col("lo")
        out = lines.withColumn("best", best).where(F.col("best").isNull() | ((x > F.col("best")) if side == "right" else (x < F.col("best"))))
        return out.select("cell", "cx", "cy", x.alias("x"), "y")

    def corner(up: bool) -> DataFrame:
        one, two = stairs("right", up), stairs("left", not up)
        step = 1 if up else -1
        p, q = (d.select(*(F.col(c).alias(s + c) for c in d.columns)) for s, d in (("a", one), ("b", two)))
        met = p.join(q, (F.col("bcx") == F.col("acx") + 1) & (F.col("bcy") == F.col("acy") + step))
        return met.where((F.col("bx") - F.col("ax") <= rx) & (F.abs(F.col("by") - F.col("ay")) <= ry))

    ends = [d.select(F.col("acell").alias("a"), F.col("bcell").alias("b")) for d in (right, above, corner(True), corner(False))]
    return ends[0].unionAll(ends[1]).unionAll(ends[2]).unionAll(ends[3]).distinct()


def grid_clusters(pts: DataFrame, dense: int = 1, reach: tuple[float, float] = REACH) -> DataFrame:
    """(cell, grp) of the dense cells. Empty input gives no rows."""
    lines = cut(grid(pts, dense))
    comp = connected_components(cell_links(lines, reach), "a", "b")
    return lines.select("cell").distinct().join(comp.withColumnRenamed("node", "cell"), "cell", "left").select("cell", F.coalesce("component", "cell").alias("grp"))


FEATURES = ("charge_ph7_4", "hydrophobicity_interfacescale_ph8")


def both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = points(table(spark, sf, "controllability_sequences"), *FEATURES, "ord")
    seeds = points(table(spark, sf, "selected_generation_conditions"), *FEATURES, "cluster")
    return rows, seeds


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    rows, seeds = both(spark, sf)
    cells = cut(grid_clusters(rows.drop("ord").unionByName(seeds.drop("cluster"))))
    known = seeds.join(cells, "cell").select("grp", "cluster").distinct()
    return rows.join(cells.join(known, "grp").select("cell", "cluster"), "cell").select("ord", "cluster")


def p1_clusters(spark: SparkSession, sf: str, members: int = 5) -> DataFrame:
    """Each group of rows: a number by size, its size, its condition clusters, its centre, and the most typical
    members: rows of its densest cell, nearest to that cell's mean (by reach) first. A group of condition rows
    alone has size 0, no centre and no members."""
    rows, seeds = both(spark, sf)
    cells = cut(grid_clusters(rows.drop("ord").unionByName(seeds.drop("cluster"))))
    count = rows.groupBy("cell").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    filled = cells.join(count, "cell", "left").na.fill(0, ["n"])
    per = filled.groupBy("grp").agg(
        F.sum("n").alias("size"),
        (F.sum(F.col("mx") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)) / UNIT).alias("centre_x"),
        (F.sum(F.col("my") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)) / UNIT).alias("centre_y"),
        F.max_by(F.struct("cell", "mx", "my"), F.struct("n", "cell")).alias("densest"),
    )
    top = per.where("size > 0").select("grp", "densest.*")
    rx, ry = (r * UNIT for r in REACH)
    far = F.pow((F.col("x") - F.col("mx")) / rx, 2) + F.pow((F.col("y") - F.col("my")) / ry, 2)
    near = rows.join(top, "cell").select("grp", "ord", far.alias("far"))
    first = near.withColumn("rn", F.row_number().over(W.partitionBy("grp").orderBy("far", "ord"))).where(F.col("rn") <= members)
    named = first.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "ord"))), lambda s: s["ord"]).alias("members"))
    known = seeds.join(cells, "cell").groupBy("grp").agg(F.array_sort(F.collect_set("cluster")).alias("clusters"))
    out = positions(per.drop("densest").join(known, "grp", "left").join(named, "grp", "left"), [F.desc("size"), F.col("grp")], "group_no")
    return out.select("group_no", "size", "clusters", F.round("centre_x", 6).alias("centre_charge"), F.round("centre_y", 6).alias("centre_hydrophobicity"), "members")
