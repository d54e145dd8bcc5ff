"""Ranks, statistics, samples, similarity and graphs against plain versions."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from resiq.operators import models, ranks, sampling, similarity, stats, vectors
from resiq.operators.blocks import chunk_pairs, nearest, ratio_limit, text_pairs, unit_limit
from resiq.operators.graph import connected_components
from tests.brute import alike, edits, family


def test_components_with_a_hub_and_a_chain(spark):
    links = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000), (None, 3), (7001, 7000), (7000, 7001)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    want = {i: 0 for i in range(200)} | {1000 + i: 1000 for i in range(61)} | {7000: 7000, 7001: 7000}
    assert got == want
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_average_ranks_and_positions(spark):
    r = random.Random(2)
    values = [r.randint(0, 20) / 2 for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(999, None)], "ord long, v double")
    got = {x.ord: x.rk for x in ranks.average_ranks(df, "ord", "v", "rk").collect()}
    for i, v in enumerate(values):
        assert got[i] == sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2
    assert 999 not in got and ranks.average_ranks(df.limit(0), "ord", "v", "rk").count() == 0
    order = [x.ord for x in ranks.positions(df.where("v is not null"), [F.desc("v"), F.col("ord")]).orderBy("rank").collect()]
    assert order == sorted(range(300), key=lambda i: (-values[i], i))


def test_compare_against_pairs(spark):
    r = random.Random(4)
    a, b = [r.randint(0, 15) / 4 for _ in range(80)], [r.randint(2, 18) / 4 for _ in range(60)]
    rows = [("d", "a", x) for x in a] + [("d", "b", x) for x in b] + [("d", "a", None), ("d", "b", math.nan), ("only", "a", 1.0)]
    out = stats.compare(spark.createDataFrame(rows, "descriptor string, cls string, value double").where("value is not null and not isnan(value)"), "cls", "a", "b").collect()
    assert len(out) == 1
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    grid = sorted({*a, *b})
    f = lambda xs, v: sum(x <= v for x in xs) / len(xs)
    gaps = [abs(f(a, v) - f(b, v)) for v in grid]
    assert out[0].mwu_u == u and out[0].cliffs_delta == pytest.approx(2 * u / 4800 - 1, abs=1e-6)
    assert out[0].ks == pytest.approx(max(gaps), abs=1e-6)
    assert out[0].wasserstein == pytest.approx(sum(g * (y - x) for g, x, y in zip(gaps, grid, grid[1:], strict=False)), abs=1e-6)
    ties = sum(n**3 - n for n in ((a + b).count(v) for v in grid))
    z = (abs(u - 2400) - 0.5) / math.sqrt(4800 / 12 * (141 - ties / (140 * 139)))
    assert out[0].mwu_p == pytest.approx(1 - math.erf(z / 2**0.5), abs=2e-6)
    x = math.sqrt(4800 / 140) * max(gaps)
    assert out[0].ks_p == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 50)), abs=2e-6)


def test_blocks_find_every_pair():
    texts = family(5, 25, 5, (8, 50), 8) + ["", "A", "AA", "K" * 130, "K" * 131]
    i, j, got = chunk_pairs(texts, texts, ratio_limit(4, 5), same=True)
    want = {(x, y) for x in range(len(texts)) for y in range(x + 1, len(texts)) if alike(texts[x], texts[y])}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(got) == len(want)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ACD", min_size=1, max_size=9), min_size=2, max_size=12, unique=True))
def test_unit_limit_loses_no_edit_pair(texts):
    i, j, _ = chunk_pairs(texts, texts, unit_limit(1, 4), same=True)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    for x in range(len(texts)):
        for y in range(x + 1, len(texts)):
            if 4 * edits(texts[x], texts[y]) <= max(len(texts[x]), len(texts[y])):
                assert (x, y) in found


def test_text_pairs_in_chunks(spark):
    texts = sorted(set(family(6, 20, 4, (8, 40), 6)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id long, res string")
    got = {tuple(sorted((r.a, r.b))) for r in text_pairs(df, None, ratio_limit(4, 5)).collect()}
    assert got == {(x, y) for x in range(len(texts)) for y in range(x + 1, len(texts)) if alike(texts[x], texts[y])}
    assert text_pairs(df.limit(0), None, ratio_limit(4, 5)).count() == 0


def greedy(texts, near):
    kept = []
    for i, t in enumerate(texts):
        if not any(near(t, texts[k]) for k in kept):
            kept.append(i)
    return kept


def test_diverse_equals_the_sequential_walk(spark):
    texts = family(7, 15, 5, (10, 40), 7)
    random.Random(1).shuffle(texts)
    texts += texts[:5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9999, None)], "ord long, seq string")
    got = sorted(r.ord for r in similarity.diverse(df).collect())
    want = greedy(texts, lambda a, b: a == b or alike(a, b))
    assert got == want
    assert [r.ord for r in similarity.diverse(df, target=7).orderBy("ord").collect()] == want[:7]
    ref = spark.createDataFrame([(1, texts[0]), (2, texts[3])], "ord long, seq string")
    state = {r.ord: r.state for r in similarity.drop_similar(df, ref).collect()}
    fresh = [i for i, t in enumerate(texts) if not any(t == x or alike(t, x) for x in (texts[0], texts[3]))]
    inner = greedy([texts[i] for i in fresh], lambda a, b: a == b or alike(a, b))
    assert {i for i, s in state.items() if s == "reference"} == set(range(len(texts))) - set(fresh)
    assert {i for i, s in state.items() if s == "kept" and i != 9999} == {fresh[k] for k in inner}


def test_greedy_clusters_equal_the_sequential_walk(spark):
    texts = sorted(set(family(8, 12, 5, (8, 30), 6)))
    order = sorted(texts, key=lambda t: (-len(t), t))
    centres, want = [], {}
    for t in order:
        hit = next((k for k, c in enumerate(centres) if 4 * edits(t, c) <= max(len(t), len(c))), None)
        if hit is None:
            centres.append(t)
        want[t] = len(centres) - 1 if hit is None else hit
    df = spark.createDataFrame([(t,) for t in texts + texts[:3]] + [(None,)], "seq string")
    assert {r.seq: r.cluster_id for r in similarity.greedy_clusters(df).collect()} == want


def test_single_linkage(spark):
    texts = ["KFAKWWLL", "KAAKWWLL", "KAAKWWLM", "DDDDEEEE", "GGGG", "GGGA", None, "KFAKWWLL"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ord long, seq string")
    got = {r.seq: r.cluster_id for r in similarity.single_linkage(df).collect()}
    assert got == {"KFAKWWLL": 0, "KAAKWWLL": 0, "KAAKWWLM": 0, "DDDDEEEE": 1, "GGGG": 2, "GGGA": 2}


def test_pairs_worth_aligning_lose_no_identity(spark):
    texts = sorted(set(family(13, 12, 6, (3, 30), 6)) | {"K", "KR", "KFAK", "KAAK", "R"})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, res string")
    i = similarity.pairwise_identity(F.col("ra"), F.col("rb"))
    both = similarity.kmer_pairs(df).join(df.toDF("a", "ra"), "a").join(df.toDF("b", "rb"), "b").select("a", "b", i.alias("i"))
    want = {(r.a, r.b) for r in both.collect() if r.i.identity >= 0.7}
    got = {tuple(sorted((r.a, r.b))) for r in similarity.worth_aligning(df).collect()}
    assert want <= got and got <= {(r.a, r.b) for r in both.collect()}


def test_nearest_vectors_and_ties(spark):
    g = np.random.default_rng(3)
    v = g.normal(size=(60, 5)).round(2)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(60, v[0].tolist())], "id long, v array<double>")
    got = {r.id: (r.nearest, r.value) for r in nearest(df.where("id < 10"), df, size=16).collect()}
    for i in range(10):
        d = np.linalg.norm(np.vstack([v, v[:1]]) - v[i], axis=1)
        d[i] = np.inf
        assert got[i][0] == int(d.argmin()) and got[i][1] == pytest.approx(d.min(), abs=1e-9)
    assert nearest(df.limit(0), df).count() == 0


def test_splits_and_folds(spark):
    rows = [(i, "a" if i < 300 else "b" if i < 305 else f"c{i}") for i in range(310)]
    df = spark.createDataFrame(rows, "ord long, k string")
    got = {r.k: r.v for r in sampling.stratified_split(df, "ord", "k").groupBy("k").agg(F.count_if(F.col("split") == "val").alias("v")).collect()}
    assert got == {"a": 30, "b": 0, **{f"c{i}": 0 for i in range(305, 310)}}
    small = sampling.take_by_group(df, "k", "ord", spark.createDataFrame([("a", 123), ("b", 9)], "k string, want long"), ranked=20)
    assert {r.k: r.n for r in small.groupBy("k").agg(F.count("*").alias("n")).collect()} == {"a": 123, "b": 5}
    folds = sampling.group_folds(df, "k", 3)
    load = {r.fold: r.n for r in df.join(folds, "k").groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert load == {0: 300, 1: 5, 2: 5}
    with pytest.raises(ValueError, match="too few"):
        sampling.length_matched(df.withColumn("length", F.lit(9)).limit(1), df.withColumn("length", F.lit(9)))
    pairs = sampling.pair_sample(df, "ord", 50).collect()
    assert len(pairs) == 50 == len({(r.a, r.b) for r in pairs}) and all(r.a < r.b for r in pairs)
    assert sampling.pair_sample(df.limit(1), "ord", 5).count() == 0
    locked = sampling.locked_split(df, "k").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in locked} == {"test": 1, "train": 6}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=5), st.integers(1, 9), st.integers(0, 80))
def test_dealing_equals_one_by_one(load, n, many):
    want, sums = [0] * len(load), list(load)
    for _ in range(many):
        f = min(range(len(sums)), key=lambda j: (sums[j], j))
        want[f], sums[f] = want[f] + 1, sums[f] + n
    own = list(load)
    assert sampling.dealt(own, n, many) == want and own == sums


def test_quantiles_by_key(spark):
    r = random.Random(9)
    rows = [(k, float(r.randint(0, 30))) for k in "ab" for _ in range(101 if k == "a" else 1)] + [("c", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, value double")
    got = {x.k: x.q for x in stats.quantiles(df, ["k"], (0.0, 0.1, 0.5, 1.0)).collect()}
    assert set(got) == {"a", "b"}
    for k in "ab":
        assert got[k] == pytest.approx(np.quantile([v for x, v in rows if x == k], (0.0, 0.1, 0.5, 1.0)).tolist())
    whole = stats.quantiles(df, [], (0.25,)).first().q[0]
    assert whole == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.25))
    assert stats.quantiles(df.limit(0), ["k"], (0.5,)).count() == 0


def test_kernel_density_and_conformal(spark):
    g = np.random.default_rng(1)
    p = g.normal(size=(200, 2)) @ np.array([[1, 0.4], [0, 0.7]])
    df = spark.createDataFrame([tuple(map(float, x)) for x in p] + [(None, 1.0), (math.nan, 2.0)], "x double, y double")
    at = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, -1.0)], "id long, x double, y double")
    c = np.cov(p.T) * 200 ** (-1 / 3)
    for r in vectors.kernel_density(df, at).collect():
        d = p - np.array([(0, 0), (1, -1)][r.id])
        want = np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)).sum() / 200 / (2 * math.pi * math.sqrt(np.linalg.det(c)))
        assert r.density == pytest.approx(want, rel=1e-6)
    assert all(r.density is None for r in vectors.kernel_density(df.limit(2), at).collect())
    res = spark.createDataFrame([(float(i),) for i in range(-10, 30)], "r double")
    assert vectors.conformal_q(res, "r") == pytest.approx(np.quantile(np.abs(np.arange(-10, 30)), math.ceil(41 * 0.95) / 40))
    assert math.isnan(vectors.conformal_q(res.limit(0), "r"))


def test_models_on_edges(spark):
    df = spark.createDataFrame([(i, float(i % 3), float(i % 2)) for i in range(30)], "id long, x double, y double")
    out = models.kmeans_medoids(df, ["x", "y"], 3).collect()
    assert sum(r["size"] for r in out) == 30
    assert models.kmeans_medoids(df.limit(0), ["x", "y"], 3).count() == 0
    same = models.calibrated(df.withColumn("l", F.lit(1.0)), "x", "l")
    assert same.where("calibrated <> x").count() == 0
    up = models.calibrated(df.withColumn("l", (F.col("x") > 1).cast("double")), "x", "l", "isotonic")
    assert {r.x: r.calibrated for r in up.select("x", "calibrated").distinct().collect()} == {0.0: 0.0, 1.0: 0.0, 2.0: 1.0}


def test_a_walk_with_a_target_stops_there(spark, monkeypatch):
    r = random.Random(12)
    texts = family(13, 5, 30, (25, 40), 2) + ["".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(30)) for _ in range(2000)] + [None]
    df = spark.createDataFrame([(7 * i, t) for i, t in enumerate(texts)], "ord long, seq string")
    whole = sorted(x.ord for x in similarity.diverse(df).collect())
    compared, pairs = [], similarity.text_pairs
    monkeypatch.setattr(similarity, "text_pairs", lambda left, right, limit: compared.append(left.count()) or pairs(left, right, limit))
    for target in (3, 20, len(whole), 5000):
        assert [x.ord for x in similarity.diverse(df, target=target).collect()] == whole[:target]
    assert compared[0] < 100 and sum(compared[:3]) < 1000
    assert similarity.diverse(df.limit(0), target=3).count() == 0
