"""Grid clusters (p1) and the varied subset (p5)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from resiq.llm import density, subset
from tests.brute import family


def components(pts):
    left, out = set(pts), []
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            x, y = todo.pop()
            near = {p for p in left if abs(p[0] - x) <= 1_500_000 and abs(p[1] - y) <= 100_000}
            left -= near
            group |= near
            todo += near
        out.append(frozenset(group))
    return set(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_equal_chains_of_neighbours(spark, seed):
    """Values on a coarse lattice make ties, exact reaches and corner contacts common."""
    r = random.Random(seed)
    pts = [(r.randint(-12, 12) * 0.75, r.randint(-12, 12) * 0.05) for _ in range(60)]
    pts += [(r.uniform(-20, 20), r.uniform(-1.5, 1.5)) for _ in range(60)] + [(999.0, 0.0), (-999.0, -999.0)]
    rows = [(i, *p) for i, p in enumerate(pts)] + [(900, None, 0.0), (901, math.nan, 0.0), (902, 0.0, math.inf), (903, 1e300, 0.0)]
    df = density.points(spark.createDataFrame(rows, "id long, a double, b double").withColumn("cell", F.lit("clash")), "a", "b", "id")
    got = df.join(density.grid_clusters(df.drop("id")), "cell").groupBy("grp").agg(F.collect_set(F.struct("x", "y")).alias("p")).collect()
    assert {frozenset((s.x, s.y) for s in g.p) for g in got} == components({(round(a * 1e6), round(b * 1e6)) for a, b in pts})


def test_reach_is_inclusive_and_density_counts(spark):
    df = density.points(spark.createDataFrame([(0, 0.0, 0.0), (1, 1.5, 0.1), (2, 3.0001, 0.1), (3, 3.0001, 0.1)], "id long, a double, b double"), "a", "b", "id")
    groups = density.grid_clusters(df.drop("id"))
    assert groups.select("grp").distinct().count() == 2
    assert density.grid_clusters(df.drop("id"), dense=2).count() == 2 and density.grid_clusters(df.drop("id"), dense=3).count() == 0
    assert density.grid_clusters(df.drop("id").limit(0)).count() == 0


def test_clusters_report(spark, tmp_path):
    q, h = density.FEATURES
    spark.createDataFrame([(i, 5.0 + i * 0.001, 0.0) for i in range(30)] + [(40, -9.0, 0.5), (41, None, 0.5)], f"ord long, {q} double, {h} double").write.parquet(str(tmp_path / "controllability_sequences.parquet"))
    spark.createDataFrame([(7, 5.0, 0.05), (8, 40.0, 3.0)], f"cluster int, {q} double, {h} double").write.parquet(str(tmp_path / "selected_generation_conditions.parquet"))
    rows = {tuple(r.clusters or ()): r for r in density.p1_clusters(spark, str(tmp_path)).collect()}
    assert rows[(7,)].size == 30 and rows[(7,)].group_no == 1 and len(rows[(7,)].members) == 5
    assert rows[(8,)].size == 0 and rows[(8,)].members is None and rows[()].members == [40]
    assert {(r.ord, r.cluster) for r in density.p1_found(spark, str(tmp_path)).collect()} == {(i, 7) for i in range(30)}


@pytest.fixture(scope="module")
def crowd(spark):
    r = random.Random(3)
    root = "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(40))
    near = sorted({root[:i] + c + root[i + 1 :] for i in range(40) for c in "AKL"} - {root})[:100]
    single = family(21, 100, 0, (30, 45))
    rows = [(i, t) for i, t in enumerate(near + single)] + [(1000 + i, near[0]) for i in range(50)] + [(2000, None), (2001, ""), (2002, "K"), (2003, "KR")]
    return spark.createDataFrame(rows, "id long, res string"), len(near)


def test_crowds_are_held_back(spark, crowd):
    df, n = crowd
    got = [r.id for r in subset.varied(df, size=60).collect()]
    assert len(got) == 60 == len(set(got))
    assert sum(i < n for i in got) < 15  # half of the texts are one crowd
    assert all(i < 1000 or i in (2002, 2003) for i in got)  # copies stand for their first row, empty texts for none


def test_sizes_and_seeds(spark, crowd):
    df, _ = crowd
    pick = lambda **k: sorted(r.id for r in subset.varied(df, **k).collect())
    assert pick(size=50) == pick(size=50) != pick(size=50, seed=99)
    assert len(pick(size=10_000)) == df.where("length(res) > 0").select("res").distinct().count()
    assert pick(size=0) == [] and subset.varied(df.limit(0), size=5).count() == 0


def test_density_counts_bucket_mates(spark, crowd):
    df, n = crowd
    d = {r.id: r.density for r in subset.densities(df.where("id < 1000")).collect()}
    crowded = [v for i, v in d.items() if i < n]
    assert sum(crowded) / len(crowded) > 5 and max(v for i, v in d.items() if i >= n) < 2
