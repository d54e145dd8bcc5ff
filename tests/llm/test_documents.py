"""Containers (p7), mixes (p8) and languages (p9)."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from resiq.llm import langid, mixing, packing
from resiq.llm.tokens import encoder, same_text, token_count, VOCABULARY


def items(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, tokens int, dup long")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 2), st.integers(0, 4)), max_size=60))
def test_shards_respect_room_pools_and_conflicts(rows):
    size, pool, dup = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    bins = packing.pack_shard(size, pool, dup, 50)
    for b in set(bins.tolist()):
        mine = bins == b
        assert size[mine].sum() <= 50 and len(set(pool[mine])) == 1
        known = [d for d in dup[mine] if d]
        assert len(known) == len(set(known))


def test_best_fit_takes_the_tightest_compatible_bin():
    # 6 and 5 open two bins of 10; a 4 closes the first; a 3 of the second's cluster needs a new one
    bins = packing.pack_shard(np.array([6, 5, 4, 3]), np.zeros(4, np.int64), np.array([0, 9, 0, 9]), 10)
    assert bins[0] == bins[2] != bins[1] and bins[3] not in (bins[0], bins[1])


def test_packing_whole(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", None]), r.choice([0, 1, 7, 300, 512, 513, 1500, r.randint(1, 500)]), r.choice([0, 0, 1, 2])) for i in range(400)]
    rows += [(1000 + i, "a", 40, 77) for i in range(150)]  # a third of the rows is one text
    specs = [(1, 512, False), (2, 512, True), (3, 0, False), (4, None, True)]
    df = items(spark, rows).withColumn("container_id", F.lit("clash"))
    out = packing.pack(df, specs, shard=20_000).toPandas()
    meta = {i: (s, t, d) for i, s, t, d in rows}
    assert set(out.spec_id) == {1, 2}
    for spec, own in out.groupby("spec_id"):
        got = own.sort_values(["doc_id", "piece_no"])
        for doc, p in got.groupby("doc_id"):
            assert p.from_token.iloc[0] == 0 and p.to_token.iloc[-1] == meta[doc][1]
            assert (p.from_token.iloc[1:].to_numpy() == p.to_token.iloc[:-1].to_numpy()).all()
            assert len(p) == -(-meta[doc][1] // 512)
        assert set(own.doc_id) == {i for i, (_, t, _) in meta.items() if t > 0}
        for _, box in own.groupby("container_id"):
            assert (box.to_token - box.from_token).sum() <= 512
            dups = [meta[d][2] for d in box.doc_id if meta[d][2]]
            assert len(dups) == len(set(dups))
            if spec == 2:
                assert len({str(meta[d][0]) for d in box.doc_id}) == 1
    assert packing.pack(df.limit(0), specs).count() == 0 and packing.pack(df, []).count() == 0


def test_fill_is_close_to_full(spark):
    r = random.Random(6)
    rows = [(i, "a", min(2000, int(r.lognormvariate(4.5, 0.8)) + 1), 0) for i in range(5000)]
    out = packing.pack(items(spark, rows), [(1, 1024, False)], shard=100_000).toPandas()
    assert (out.to_token - out.from_token).sum() / (1024 * out.container_id.nunique()) > 0.985


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 150))
def test_knapsack_is_optimal(have, budget):
    length, count = np.array(sorted(have), np.int64), np.array([have[k] for k in sorted(have)], np.int64)
    take = mixing.knapsack(budget, length, count)
    sums = {0}
    for k, n in have.items():
        sums |= {s + k * m for s in sums for m in range(n + 1)}
    assert (take >= 0).all() and (take <= count).all()
    assert (take * length).sum() == max(s for s in sums if s <= budget)


def test_mix_meets_budgets(spark):
    r = random.Random(2)
    rows = [(i, s, r.randint(5, 400), 0) for i, s in enumerate(["big"] * 600 + ["mid"] * 100 + ["small"] * 10 + [None] * 30)]
    rows += [(2000 + i, "same", 100, 0) for i in range(300)] + [(3000, "big", 0, 0)]
    targets = spark.createDataFrame(
        [(1, "big", 2.0, 1, 0.5), (1, "mid", 1.0, 3, 0.5), (1, "small", 1.0, 2, 0.5), (1, "gone", 1.0, 5, 0.5), (2, "same", 1.0, 4, 0.1), (2, "mid", None, 4, 0.1), (3, None, 1.0, 1, 1.0)],
        "mix_id int, source string, weight double, max_repeats int, size_factor double",
    )
    chosen, shares = mixing.mix(items(spark, rows), targets, ranked=50)
    got, told = chosen.toPandas(), {(r.mix_id, r.source): r for r in shares.collect()}
    most = {(1, "big"): 1, (1, "mid"): 3, (1, "small"): 2, (2, "same"): 4}
    assert not got.duplicated(["mix_id", "doc_id"]).any()
    for (m, s), own in got.groupby(["mix_id", "source"]):
        assert own.copies.max() <= most[m, s]
        assert (own.tokens * own.copies).sum() == told[m, s].got <= told[m, s].budget
        assert own.copies.max() - own.copies.min() <= 1
    assert told[1, "big"].budget - told[1, "big"].got <= 1 and told[1, "mid"].got == told[1, "mid"].budget
    small = sum(t for _, s, t, _ in rows if s == "small")
    assert told[1, "small"].got == min(told[1, "small"].budget, 2 * small)
    assert told[1, "gone"].got == 0 and told[1, "gone"].budget > 0 and told[2, "mid"].budget == 0
    assert told[2, "same"].budget - told[2, "same"].got < 100  # every document has 100 tokens
    assert abs(sum(r.actual_share for k, r in told.items() if k[0] == 1) - 1) < 1e-5
    empty, none = mixing.mix(items(spark, rows).limit(0), targets)
    assert empty.count() == 0 and none.agg(F.sum("got")).first()[0] == 0


def test_token_counts_and_copies(spark):
    texts = ["", None, "two words", "x" * 20_000, "é ß 螺旋", "<|endoftext|>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    e = encoder(VOCABULARY)
    assert [r[0] for r in df.select(token_count(F.col("text")), "i").orderBy("i").collect()] == [len(e.encode_ordinary(t or "")) for t in texts]
    assert all(e.decode(e.encode_ordinary(t)) == t for t in texts if t)
    same = spark.createDataFrame([("A  b",), (" a B\n",), ("ab",), (" ",), (None,)], "t string").select(same_text(F.col("t"))).collect()
    assert same[0] == same[1] != same[2] and same[3][0] == same[4][0] == 0


def numeric(f, w, at, eps=1e-3):
    keep = w[at]
    w[at] = keep + eps
    up = f()
    w[at] = keep - eps
    down = f()
    w[at] = keep
    return (up - down) / (2 * eps)


def test_gradients_through_time():
    r = np.random.default_rng(0)
    net = langid.Tagger(hidden=5, seed=1)
    x = r.integers(97, 110, (4, 7)).astype(np.uint8)
    target = r.dirichlet(np.ones(langid.NONE + 1), 4)
    weight = r.uniform(0.5, 2, 4)
    for w in net.weights():
        w[...] = w.astype(np.float32)

    def loss():
        y, _ = net.run(x)
        return -(np.log(y) * target[None] * (weight / weight.sum())[None, :, None]).sum() / len(y)

    for w, g in zip(net.weights(), net.gradients(x, target, weight), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        assert g[at] == pytest.approx(numeric(loss, w, at), rel=0.03, abs=2e-4)


def test_labels_in_any_notation(spark):
    cases = {"en": "en", "EN": "en", "en-US": "en", "en_GB": "en", "eng": "en", "English": "en", " fre ": "fr", "zh-Hans": "zh", "und": None, "xx": None, "": None, "mul": None, "de-AT": "de", "n/a": None, "unknown": None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "l string, want string")
    assert df.where(~langid.label_code(F.col("l")).eqNullSafe(F.col("want"))).count() == 0


def test_sentences_and_bare_lines():
    text = "One 0.69 mM.  Two? Três!\n>ACDEFGHIK\n22 449 0.6\n螺旋。第二句。 end"
    got = langid.sentences(text)
    assert got == ["One 0.69 mM.", "Two?", "Três!", ">ACDEFGHIK", "22 449 0.6", "螺旋。", "第二句。", "end"]
    assert [langid.bare(s) for s in got] == [False, False, False, True, True, False, False, False]
    assert langid.words("The sequence WHKEKQRGS was A b") == ["the", "sequence", "was", "a", "b"]
    assert langid.words("ALLE WERTE SIND") == ["alle", "werte", "sind"] and langid.sentences(" \n ") == []


def test_path_weighs_changes():
    s = np.zeros((5, langid.NONE))
    s[:, 0], s[2, 0], s[2, 1] = 3, 0, 4
    assert langid.path(s, 6.0).tolist() == [0] * 5 and langid.path(s, 1.0).tolist() == [0, 0, 1, 0, 0]


SAY = {
    "en": "The samples were kept on ice before they were washed with the buffer.",
    "de": "Die Proben wurden auf Eis gehalten, bevor sie mit dem Puffer gewaschen wurden.",
    "fr": "Les échantillons étaient gardés sur glace avant d'être lavés avec le tampon.",
    "ru": "Образцы держали на льду, а затем промывали буфером.",
    "zh": "样品在冰上保存，然后用缓冲液清洗。",
}
MORE = {
    "en": "Red blood cells stayed intact when the dose was raised.",
    "de": "Die roten Blutkörperchen blieben unversehrt, obwohl die Dosis erhöht wurde.",
    "fr": "Les globules rouges sont restés entiers quand la dose a été portée plus haut.",
    "ru": "Эритроциты остались целыми, когда дозу подняли.",
    "zh": "当剂量升高时，红细胞保持完整。",
}


def test_languages_end_to_end(spark, tmp_path):
    docs, want = [], {}
    for k in range(60):
        for i, code in enumerate(SAY):
            docs.append((len(docs), f"{SAY[code]} {MORE[code]}", code))
    odd = [
        ("wrong", f"{SAY['fr']} {MORE['fr']}", "en", [(1, "fr")]),
        ("missing", MORE["de"], None, [(1, "de")]),
        ("capitals", SAY["de"].upper(), "und", [(1, "de")]),
        ("mixed", f"{SAY['en']} {MORE['en']}\n>ACDEFGHIKLMN\n{SAY['ru']} {MORE['ru']} {SAY['zh']}", "en", [(1, "en"), (2, "ru"), (3, "zh")]),
        ("notation", f"{SAY['en']} {MORE['en']}", "ENG", []),
        ("none", "123 4.5\n>ACDEFG", None, []),
        ("empty", "", "en", []),
        ("null", None, "en", []),
        ("long", f"{SAY['zh']}{MORE['zh']}" * 3000, "zh", []),
    ]
    for _, text, label, segs in odd:
        want[len(docs)] = segs
        docs.append((len(docs), text, label))
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, lang string, label string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in langid.p9_found(spark, str(tmp_path)).orderBy("doc_id", "seg_no").collect():
        got.setdefault(r.doc_id, []).append((r.seg_no, r.lang))
    assert got == {k: v for k, v in want.items() if v}
    labels = {r.doc_id: r for r in langid.p9_labels(spark, str(tmp_path)).collect()}
    assert len(labels) == len(docs) and all(0 <= r.confidence <= 1 for r in labels.values())
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.fit(none) is None and langid.tag(none, langid.Tagger()).count() == 0
