"""Alike pairs by pieces against a comparison of all pairs; walks that list few links of a crowd."""

import random

import numpy as np
from pyspark.sql import functions as F

from resiq.operators import blocks, pieces, similarity
from resiq.plans.pipelines import pipeline_mic_table
from resiq.plans.q_relational import training_rows
from tests.brute import alike, edits, family, lcs
from tests.conftest import SF


def mixed():
    texts = sorted({*family(5, 40, 6, (3, 60), 8), *family(9, 20, 6, (3, 12), 3), "A", "AA", "K" * 130, "K" * 131, "K" * 600, "K" * 601})
    random.Random(3).shuffle(texts)
    return texts


def test_pieces_lose_no_pair(monkeypatch):
    monkeypatch.setattr(pieces, "FEW", 0)
    texts = mixed()
    for limit, most, swaps in ((blocks.ratio_limit(4, 5), pieces.indels(blocks.ratio_limit(4, 5)), False), (blocks.unit_limit(1, 4), lambda n: n // 4, True)):
        i, j, lcs = blocks.chunk_pairs(texts, texts, limit, True)
        want = dict(zip(zip(i.tolist(), j.tolist(), strict=True), lcs.tolist(), strict=True))
        if swaps:
            want = {(x, y): v for (x, y), v in want.items() if 4 * edits(texts[x], texts[y]) <= max(len(texts[x]), len(texts[y]))}
        for dense in (1, 1 << 30):
            monkeypatch.setattr(pieces, "DENSE", dense)
            i, j, lcs = pieces.piece_pairs(texts, None, limit, most, swaps, blocks.unary, blocks.chunk_pairs)
            got = dict(zip(zip(i.tolist(), j.tolist(), strict=True), lcs.tolist(), strict=True))
            assert {p: got.get(p) for p in want} == want and (swaps or got.keys() == want.keys())
        half = len(texts) // 2
        i, j, _ = pieces.piece_pairs(texts[:half], texts[half:], limit, most, swaps, blocks.unary, blocks.chunk_pairs)
        assert {(x, y) for x, y in want if x < half <= y} <= set(zip(i.tolist(), (j + half).tolist(), strict=True))


def test_few_pairs_are_looked_at(monkeypatch):
    """The LCS of few of 4.5 million pairs is made; letter counts alone would leave more."""
    r = random.Random(2)
    texts = ["".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(30)) for _ in range(3000)]
    seen, lcs = [0], pieces.lcs_codes
    monkeypatch.setattr(pieces, "FEW", 0)
    monkeypatch.setattr(pieces, "lcs_codes", lambda *x: seen.append(len(x[3])) or lcs(*x))
    pieces.piece_pairs(texts, None, blocks.unit_limit(1, 4), lambda n: n // 4, True, blocks.unary, blocks.chunk_pairs)
    assert sum(seen) < 450


def test_few_windows_are_sorted(monkeypatch):
    """of the windows of a text only those are kept whose key a piece may have."""
    r = random.Random(2)
    texts = ["".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(30)) for _ in range(3000)]
    seen, meetings = [0], pieces.meetings
    monkeypatch.setattr(pieces, "FEW", 0)
    monkeypatch.setattr(pieces, "meetings", lambda p, q, *more: seen.append(len(q)) or meetings(p, q, *more))
    pieces.piece_pairs(texts, None, blocks.unit_limit(1, 4), lambda n: n // 4, True, blocks.unary, blocks.chunk_pairs)
    assert sum(seen) < 3000 * 100  # of about 3000 * 400 windows


def test_smallest_partners_alone(monkeypatch):
    """a text of a crowd comes with its best pair alone, the others are not held."""
    texts = list(dict.fromkeys(family(61, 3, 400, (30, 30), 3)))
    a, b = texts[::2], texts[1::2]
    limit, r = blocks.ratio_limit(4, 5), random.Random(7)
    ids = np.array(r.sample(range(10_000), len(b)))
    i, j, _ = blocks.chunk_pairs(a, b, limit, False)
    want = {}
    for x, y in zip(i.tolist(), ids[j].tolist(), strict=True):
        want[x] = min(y, want.get(x, y))
    for few in (1 << 24, 0):
        monkeypatch.setattr(pieces, "FEW", few)
        i, j, _ = pieces.piece_pairs(a, b, limit, pieces.indels(limit), False, blocks.unary, blocks.chunk_pairs, ids)
        assert dict(zip(i.tolist(), ids[j].tolist(), strict=True)) == want and len(i) == len(want)


def test_groups_meet_without_a_shuffle(spark):
    """a shuffle would hold each group once for each group that it meets."""
    df = spark.createDataFrame(list(enumerate(mixed())), "id long, res string")
    for right in (None, df):
        plan = blocks.text_pairs(df, right, blocks.ratio_limit(4, 5))._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan


def test_edit_distances():
    texts = [*family(3, 20, 5, (1, 40), 9), "", "K" * 70, "K" * 64 + "AAA", "A" * 64, "A" * 63]
    r = random.Random(1)
    a, b = ([r.choice(texts) for _ in range(1000)] for _ in range(2))
    assert pieces.edit_distances(a, b).tolist() == [edits(x, y) for x, y in zip(a, b, strict=True)]


def crowd(seed):
    texts = list(dict.fromkeys([*family(seed, 1, 300, (30, 30), 3), *family(seed + 1, 40, 3, (10, 40), 6)]))
    random.Random(seed).shuffle(texts)
    return texts


def test_a_walk_lists_few_links_of_a_crowd(spark, monkeypatch):
    """K3, K5: the first batch's centres take the crowd before its pairs are listed."""
    texts = crowd(21)
    links = []

    def pairs(*a, **more):
        out = text_pairs(*a, **more)
        links.append(out.count())
        return out

    text_pairs = similarity.text_pairs
    monkeypatch.setattr(similarity, "text_pairs", pairs)
    monkeypatch.setattr(similarity, "BATCH", 16)
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, seq string")
    got = sorted(r.ord for r in similarity.diverse(df).collect())
    kept = []
    for i, t in enumerate(texts):
        if not any(alike(t, texts[k]) for k in kept):
            kept.append(i)
    assert got == kept
    assert sum(links) < sum(alike(s, t) for i, s in enumerate(texts) for t in texts[:i]) / 10
    ref = spark.createDataFrame([(0, texts[0])], "ord long, seq string")
    state = {r.ord: r.state for r in similarity.drop_similar(df, ref).collect()}
    fresh = [i for i, t in enumerate(texts) if t != texts[0] and not alike(t, texts[0])]
    inner = []
    for i in fresh:
        if not any(alike(texts[i], texts[k]) for k in inner):
            inner.append(i)
    assert {i for i, s in state.items() if s == "kept"} == set(inner)
    assert {i for i, s in state.items() if s == "reference"} == set(range(len(texts))) - set(fresh)


def counted(monkeypatch):
    links, pairs = [], similarity.text_pairs

    def count(*a, **more):
        out = pairs(*a, **more)
        links.append(out.count())
        return out

    monkeypatch.setattr(similarity, "text_pairs", count)
    return links


def near(s, t):
    return 4 * edits(s, t) <= max(len(s), len(t))


def test_clusters_list_few_links_of_a_crowd(spark, monkeypatch):
    texts = sorted(crowd(31), key=lambda t: (-len(t), t))
    links = counted(monkeypatch)
    monkeypatch.setattr(similarity, "BATCH", 100)
    centres, want = [], {}
    for t in texts:
        hit = next((k for k, c in enumerate(centres) if near(t, c)), None)
        if hit is None:
            centres.append(t)
        want[t] = len(centres) - 1 if hit is None else hit
    df = spark.createDataFrame([(t,) for t in texts], "seq string")
    assert {r.seq: r.cluster_id for r in similarity.greedy_clusters(df).collect()} == want
    assert sum(links) < sum(near(s, t) for i, s in enumerate(texts) for t in texts[:i]) / 4


def test_mic_table_lists_few_links_of_a_crowd(spark, tmp_path, monkeypatch):
    texts = crowd(41)
    links = counted(monkeypatch)
    monkeypatch.setattr(similarity, "BATCH", 100)
    rows = [(i, f"R{i}", t, "Escherichia coli", "4") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "ord long, record_id string, sequence string, bacterium string, value string").write.parquet(f"{tmp_path}/mic_observations.parquet")
    got = pipeline_mic_table(spark, str(tmp_path)).collect()
    assert {r.sequence for r in got} == set(texts)
    first = {}
    for t in sorted(texts, key=lambda t: (-len(t), t)):
        first[t] = next((c for c, x in first.items() if x == c and near(t, c)), t)
    assert len({(r.cluster_id, first[r.sequence]) for r in got}) == len({r.cluster_id for r in got}) == len(set(first.values()))
    assert sum(links) < sum(near(s, t) for i, s in enumerate(texts) for t in texts[:i]) / 4


def test_single_linkage_of_a_crowd_lists_a_forest(spark, monkeypatch):
    texts = [t for t in crowd(51) if len(t) > 12]
    links = counted(monkeypatch)
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, seq string")
    got = {r.seq: r.cluster_id for r in similarity.single_linkage(df).collect()}
    i, j = np.triu_indices(len(texts), 1)
    v = similarity.identities([texts[x] for x in i], [texts[x] for x in j])
    grams = [{t[x : x + 2] for x in range(len(t) - 1)} for t in texts]
    group = list(range(len(texts)))
    for x, y in zip(i[(v >= (0.7, 0.8)).all(axis=1)].tolist(), j[(v >= (0.7, 0.8)).all(axis=1)].tolist(), strict=True):
        lo, hi = sorted((len(texts[x]), len(texts[y])))
        if len(grams[x] & grams[y]) >= max(1, int(0.5 * (lo - 1 - 0.6 * hi))) and group[x] != group[y]:
            old, new = max(group[x], group[y]), min(group[x], group[y])
            group = [new if g == old else g for g in group]
    assert len({(got[t], g) for t, g in zip(texts, group, strict=True)}) == len(set(got.values())) == len(set(group))
    assert sum(links) < len(texts)


def test_kmer_pairs_come_once_without_a_shuffle(spark, monkeypatch):
    """k-mers of a pair are counted in its cell; they were joined with themselves and made distinct."""
    texts = [*mixed(), "AK", "KA", "W" * 300]
    grams = lambda t, k: {t[x : x + k] for x in range(max(1, len(t) - k + 1))}
    df = spark.createDataFrame([*enumerate(texts), (9999, ""), (9998, None)], "id long, res string")
    for k in (2, 3):
        want = []
        for i, s in enumerate(texts):
            for j in range(i + 1, len(texts)):
                lo, hi = sorted((len(s), len(texts[j])))
                shared = len(grams(s, k) & grams(texts[j], k))
                floor = 0 if lo < k else max(1, int(0.5 * (max(1, lo - k + 1) - k * (1.0 - 0.7) * hi)))
                if lo >= 0.7 * hi and ((shared and shared >= floor) or hi <= 2 * k):
                    want.append((i, j))
        out = similarity.kmer_pairs(df, k)
        assert sorted((r.a, r.b) for r in out.collect()) == want
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_kmer_pairs_lie_small(spark, monkeypatch, tmp_path):
    """F1: a task's rows have few different `a` and runs of `b`, so that files are small: 1.0 bytes a row here, 1.5 before."""
    rng = random.Random(5)
    texts = sorted({"".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=rng.randint(6, 40))) for _ in range(3000)}, key=lambda _: rng.random())
    df = spark.createDataFrame([(7 * i + 3, t) for i, t in enumerate(texts)], "id long, res string")
    similarity.kmer_pairs(df).write.parquet(f"{tmp_path}/pairs")
    rows = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert rows > 500_000
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < 1.2 * rows
    for name, most in (("TALL", 64), ("BLOCK", 8), ("DEEP", 2)):
        monkeypatch.setattr(similarity, name, most)
    few = df.where("id < 1400")
    got = similarity.kmer_pairs(few).withColumn("p", F.spark_partition_id()).collect()
    of, pairs = {7 * i + 3: t for i, t in enumerate(texts) if 7 * i + 3 < 1400}, set()
    grams = {i: {t[x : x + 2] for x in range(len(t) - 1)} for i, t in of.items()}
    for i in of:
        for j in of:
            lo, hi = sorted((len(of[i]), len(of[j])))
            if i < j and lo >= 0.7 * hi and len(grams[i] & grams[j]) >= max(1, int(0.5 * (lo - 1 - 2 * (1.0 - 0.7) * hi))):
                pairs.add((i, j))
    assert len(got) == len(pairs) and {(r.a, r.b) for r in got} == pairs
    assert max(len({r.a for r in got if r.p == p}) for p in {r.p for r in got}) <= 8


def test_ratios_of_length_in_cells(spark):
    """texts of a length go to the cells by slots; they went pair by pair."""
    texts = [t for t in mixed() if len(t) < 100] + ["A" * 64, "AK" * 32, "K" * 65, "KA" * 32 + "A", "A" * 128, "AK" * 64]
    a, b = texts[::2], texts[1::2]
    one, two = (spark.createDataFrame([(t,) for t in [*x, None]], "s string") for x in (a, b))
    out = similarity.ratios_of_length(one, two)
    want = sorted((s, t, round(lcs(s, t) / len(s), 6)) for s in a for t in b if len(s) == len(t))
    assert sorted((r.one, r.two, round(r.ratio, 6)) for r in out.collect()) == want
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_observations_are_parsed_once(spark):
    """organisms, ends and rows come from the means, not each from the table again."""
    plan = training_rows(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan
