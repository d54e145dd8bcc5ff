"""Near-duplicate joins (p3, p4, p6) against brute force, with skew, salting, copies and odd rows."""

import random

import numpy as np
import pytest

from resiq.llm import batches, blockjoin, grams, pairs, splits
from resiq.llm.grams import MINI, NONE, SPAN, Ranking, Texts
from tests.brute import alike, family


def table_of(spark, rows, extra="grp int"):
    return spark.createDataFrame(rows, f"ord long, seq string, {extra}")


@pytest.fixture(scope="module")
def texts():
    out = family(11, 30, 6, (25, 50), 7)
    random.Random(3).shuffle(out)
    return out + out[:10] + ["ACDEFGHIKL" * 12, "ACDEFGHIKL" * 12 + "W", "WYWY" * 5000, None, "", "ACDEF", "kkkk-llll", "A" * 40, "A" * 41]


def truth(texts):
    import re

    res = [re.sub("[^A-Z]", "", (t or "").upper()) for t in texts]
    ok = [i for i, t in enumerate(res) if 25 <= len(t) <= 1000]
    return {(i, j) for n, i in enumerate(ok) for j in ok[n + 1 :] if res[i] != res[j] and alike(res[i], res[j])}


def run(spark, texts, grp=0, **how):
    df = table_of(spark, [(i, t, grp) for i, t in enumerate(texts)])
    return {(r.ord_a, r.ord_b) for r in pairs.near_pairs(pairs.copies(df, "seq", grp), **how).collect()}


def test_pairs_equal_brute_force(spark, texts):
    want, got = truth(texts), run(spark, texts)
    assert got <= want and len(want - got) <= 0.01 * len(want)


def test_salted_lists_lose_nothing(spark, texts):
    """Every token over 4 texts is hot: all lists are split into pairs of chunks."""
    short = [t for t in texts if t is None or len(t) < 1000]
    assert run(spark, short, hot=4, buckets=5) == run(spark, short, buckets=3)


def test_moved_blocks_are_found_at_any_number_of_buckets(spark, tmp_path):
    """The first shared token of many of these pairs stands in a block that moved from one end to the other."""
    r = random.Random(21)
    out = []
    for _ in range(60):
        block, rest = ("".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n)) for n in (8, 42))
        out += [block + rest, rest + block]
    want = truth(out)
    assert {(i, i + 1) for i in range(0, len(out), 2)} <= want
    for buckets in (3, 500):
        assert run(spark, out, buckets=buckets) == want
    rows = [(i, t, i % 2) for i, t in enumerate(out)]
    for buckets in (3, 100):
        index = batches.BatchIndex(spark, str(tmp_path / f"m{buckets}"), buckets=buckets)
        assert {(x.ord_old, x.ord_new) for x in batches.ingest_all(index, as_rows(spark, rows)).collect()} == naive_history(rows)


def test_a_third_of_rows_is_one_text(spark, texts):
    few = [t for t in texts[:40] if t and len(t) < 100]
    many = few + [few[0]] * 60
    got, want = run(spark, many), truth(many)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_empty_tables_and_groups(spark, texts):
    df = table_of(spark, [(i, t, 0) for i, t in enumerate(texts[:20])])
    assert pairs.near_pairs(pairs.copies(df.limit(0), "seq")).count() == 0
    both = pairs.copies(df, "seq", 0).unionAll(pairs.copies(df, "seq", 1))
    got = pairs.near_pairs(both).collect()
    assert {(r.grp, r.ord_a, r.ord_b) for r in got} == {(g, a, b) for g in (0, 1) for a, b in run(spark, texts[:20])}


def some_texts(seed, n, letters=20, size=(25, 50)):
    r = np.random.default_rng(seed)
    size = r.integers(*size, n)
    return Texts(np.arange(n) * 3, r.integers(0, letters, size.sum()).astype(np.uint8), size, np.zeros(n, np.int32), np.zeros(n, np.int32))


def plan_of(buckets, hot=(), chunks=(), listed=24, classes=None):
    return blockjoin.Plan(Ranking(lambda n: np.full(n.shape, listed), classes), buckets, np.array(hot, np.uint32), np.array(chunks, np.int64), np.zeros(MINI, bool))


def test_packing_round_trip():
    r = np.random.default_rng(0)
    size = r.integers(0, 60, 300)
    t = Texts(np.sort(r.integers(0, 2**60, 300)), r.integers(0, 26, size.sum()).astype(np.uint8), size, *(r.integers(-(2**31), 2**31, 300).astype(np.int32) for _ in range(2)))
    many = r.integers(0, 4, 300)
    place = r.integers(0, 1000, many.sum())
    u, owner, at = Texts.unpack(t.pack(many, place))
    for c in ("tid", "flat", "size", "grp", "x"):
        assert (getattr(t, c) == getattr(u, c)).all()
    assert (owner == np.repeat(np.arange(300), many)).all() and (at == place).all()


def test_no_token_has_the_filling_key():
    """NONE fills short rows of key tables; keys are different for different tokens and tell their code."""
    code = np.arange(SPAN, dtype=np.uint32)
    key = Ranking(lambda n: n, np.full(SPAN, 254, np.uint8)).key(code)
    assert not (key == NONE).any() and len(np.unique(key)) == SPAN and (Ranking.code(key) == code).all()


def test_tokens_equal_plain_ones():
    t = some_texts(3, 200, 4, (0, 300))
    got = grams.tokens(t, Ranking(lambda n: np.minimum(n, 7)))
    for i, s in enumerate(t.letters()):
        want = {s[k : k + 5] for k in range(len(s) - 4)}
        keys = sorted(int(Ranking(lambda n: n).key(np.array([sum((ord(c) - 65) * 26 ** (4 - k) for k, c in enumerate(w))]))[0]) for w in want)
        assert got.key[got.text == i].tolist() == keys[:7]
    p = got.place
    assert (grams.codes_at(t, got.text, p) == Ranking.code(got.key)).all()


def test_copies_of_a_text_do_not_grow_with_buckets():
    """A text is copied about half as often as it lists tokens, however many buckets there are."""
    t = some_texts(7, 2000)
    listed = len(grams.tokens(t, plan_of(1).ranking).key)
    copies = {n: sum(len(Texts.unpack(b)[0]) for _, b in blockjoin.pack_blocks(t, plan_of(n))) for n in (12, 144, 5000)}
    assert copies[5000] < 1.06 * copies[144] and copies[5000] < 1.7 * copies[12] and copies[5000] < 0.65 * listed


def test_blocks_hold_every_posting_once():
    """Salted lists and all: over the buckets each list has each of its texts once."""
    t = some_texts(9, 300, 3)
    code = Ranking.code(grams.tokens(t, plan_of(1).ranking).key)
    hot = np.unique(code)[:20]
    plan = plan_of(7, hot, np.full(20, 3))
    rows, name, bucket = plan.lists(grams.tokens(t, plan.ranking), code, t)
    own = grams.tokens(t, plan.ranking).text[rows]
    want = sorted(zip(bucket.tolist(), name.tolist(), t.tid[own].tolist()))
    got = []
    for b, blob in blockjoin.pack_blocks(t, plan):
        u, text, names = blockjoin.unpack_blocks([blob], plan, b)
        got += zip([b] * len(text), names.tolist(), u.tid[text].tolist())
    assert sorted(got) == want


def test_counts_of_tokens_are_exact(spark, texts):
    rows = [(i, t, 0, 0) for i, t in enumerate(x for x in texts if x and 25 <= len(x) < 1000 and x.isalpha())]
    c = grams.token_counts(spark.createDataFrame(rows, grams.TEXT_SCHEMA).repartition(3), 5)
    from collections import Counter

    n = Counter(w for _, t, _, _ in rows for w in {t.upper()[k : k + 5] for k in range(len(t) - 4)})
    code = lambda w: sum((ord(x) - 65) * 26 ** (4 - k) for k, x in enumerate(w))
    assert dict(zip(c.hot_code.tolist(), c.hot_n.tolist())) == {code(w): k for w, k in n.items() if k > 5}
    assert c.n == len(rows) and c.postings == sum(n.values()) == c.load.sum()
    assert all(c.df[code(w)] == np.ceil(8 * np.log2(k)) for w, k in n.items())


def naive_history(rows):
    import re

    res = {o: re.sub("[^A-Z]", "", (s or "").upper()) for o, s, _ in rows}
    ok = [(o, b) for o, s, b in rows if len(res[o]) >= 25 and b is not None]
    out = set()
    for o, b in ok:
        old = [p for p, c in ok if c < b and (res[p] == res[o] or alike(res[p], res[o]))]
        if old:
            out.add((min(old), o))
    return out


@pytest.fixture(scope="module")
def deliveries(texts):
    r = random.Random(8)
    own = [t for t in texts if t is None or len(t) < 500]
    rows = [(i, r.choice(own), min(9, i // 22) if i % 40 else None) for i in range(220)]
    return rows


def as_rows(spark, rows):
    return pairs.copies(table_of(spark, rows, "batch_no int"), "seq", 0, 25, "ord", "batch_no")


def found(index, rows):
    return {(r.ord_old, r.ord_new) for r in batches.ingest_all(index, rows).collect()}


def test_batches_in_turn(spark, deliveries, tmp_path):
    want = naive_history(deliveries)
    index = batches.BatchIndex(spark, str(tmp_path / "i"), buckets=4)
    got = found(index, as_rows(spark, deliveries))
    assert len({n for _, n in got}) == len(got) and len(want ^ got) <= 0.02 * len(want)
    index.close()
    assert not (tmp_path / "i").exists()


def test_indexes_that_are_opened_again_or_refreshed_give_the_same(spark, deliveries, tmp_path):
    rows = as_rows(spark, deliveries)
    whole = found(batches.BatchIndex(spark, str(tmp_path / "a"), buckets=4), rows)
    for name, how in (("b", {}), ("c", {"growth": 1}), ("d", {"hot": 2})):
        got = set()
        for n in range(10):  # a new object each time: all that counts is in the folder
            index = batches.BatchIndex(spark, str(tmp_path / name), buckets=4, **how)
            got |= {(r.ord_old, r.ord_new) for r in index.ingest(rows.where(f"batch_no = {n}").select("ord", "res")).collect()}
        assert got == whole
        generations = {m["generation"] for m in index._marks()}
        assert (len(generations) > 2) == (name == "c")  # the others outgrow the first delivery once


def test_a_backlog_is_one_delivery(spark, deliveries, tmp_path):
    """Batches that wait together cost one pass, with or without a history, and give what batches in turn give."""
    rows = as_rows(spark, deliveries)
    index = batches.BatchIndex(spark, str(tmp_path / "turn"), buckets=4)
    want = set()
    for n in range(10):
        want |= {(r.ord_old, r.ord_new) for r in index.ingest(rows.where(f"batch_no = {n}").select("ord", "res")).collect()}
    index = batches.BatchIndex(spark, str(tmp_path / "whole"), buckets=4)
    assert found(index, rows) == want and len(index._marks()) == 1
    index = batches.BatchIndex(spark, str(tmp_path / "two"), buckets=4, hot=2)
    assert found(index, rows.where("batch_no < 4")) | found(index, rows.where("batch_no >= 4")) == want
    assert len(index._marks()) == 2


def test_a_delivery_that_broke_off_is_made_again(spark, deliveries, tmp_path, monkeypatch):
    rows = as_rows(spark, deliveries)
    want = found(batches.BatchIndex(spark, str(tmp_path / "a"), buckets=4), rows)
    index = batches.BatchIndex(spark, str(tmp_path / "b"), buckets=4)
    got = set()
    for n in range(10):
        part = rows.where(f"batch_no = {n}").select("ord", "res")
        if n in (0, 4):
            with monkeypatch.context() as m:
                m.setattr(index, "_mark", lambda *a: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    index.ingest(part)
        got |= {(r.ord_old, r.ord_new) for r in index.ingest(part).collect()}
    assert got == want


def test_work_of_a_probe_goes_by_the_delivery():
    """Pairs of postings that are walked: of new texts with old ones alone, whatever the size of the history."""
    plan = plan_of(1, listed=50)
    old, more, new = some_texts(1, 2000), some_texts(2, 20_000), some_texts(5, 1)
    new = Texts(new.tid + 10**6, *(getattr(new, c) for c in ("flat", "size", "grp", "x")))
    walked = []
    for history in (old, more):
        tally = []
        batches.probe([b for _, b in blockjoin.pack_blocks(new, plan)], [b for _, b in blockjoin.pack_blocks(history, plan)], plan, 0, tally=tally)
        walked.append(sum(tally))
        tokens = [set(grams.tokens(x, plan.ranking).key.tolist()) for x in (new,)]
        p = grams.tokens(history, plan.ranking)
        assert sum(tally) <= np.isin(p.key, list(tokens[0])).sum()
    assert max(walked) < 200


def test_equal_old_texts_count_once():
    t = some_texts(4, 50)
    twice = Texts.concat([t, Texts(t.tid + 1, t.flat, t.size, t.grp, t.x)])
    assert sorted(twice.tid[batches.once(twice)].tolist()) == t.tid.tolist()


def test_batches_whose_ords_are_out_of_order(spark, texts, tmp_path):
    t = [x for x in texts if x and 25 <= len(x) < 100][0]
    rows = [(50, t, 1), (7, t, 2), (60, t, 3), (1, t, 4)]
    assert found(batches.BatchIndex(spark, str(tmp_path / "o"), buckets=2), as_rows(spark, rows)) == {(50, 7), (7, 60), (7, 1)}


def test_empty_delivery(spark, tmp_path):
    index = batches.BatchIndex(spark, str(tmp_path / "e"), buckets=2)
    assert index.ingest(as_rows(spark, [(1, "A", 1)]).select("ord", "res")).count() == 0
    assert found(batches.BatchIndex(spark, str(tmp_path / "f")), as_rows(spark, [(1, "A", 1)]).limit(0)) == set()
    t = "ACDEFGHIKLMNPQRSTVWYACDEFGHIKL"
    for n, want in ((5, set()), (6, {(5, 6)})):
        assert {(r.ord_old, r.ord_new) for r in index.ingest(as_rows(spark, [(n, t, 1)]).select("ord", "res")).collect()} == want


def test_splits_equal_brute_force(spark, texts):
    r = random.Random(5)
    rows = [(i, t, r.choice((splits.TRAIN, splits.EVAL))) for i, t in enumerate(texts) if t is None or len(t) < 1000]
    df = pairs.copies(table_of(spark, rows, "side int"), "seq", 0, 25, "ord", "side")
    side, text = {i: s for i, _, s in rows}, {i: (t or "").upper() for i, t, _ in rows}
    ids = [i for i in side if len("".join(c for c in text[i] if c.isalpha())) >= 25]
    want = {(i, j) for n, i in enumerate(ids) for j in ids[n + 1 :] if side[i] != side[j] and (text[i] == text[j] or alike(text[i], text[j]))}
    got = {(x.ord_a, x.ord_b) for x in splits.cross_pairs(df).collect()}
    assert got <= want and len(want - got) <= 0.01 * len(want)
    assert splits.cross_pairs(df.limit(0)).count() == 0


def test_pruning_bounds_keep_the_threshold():
    """Tokens that the bounds leave out cannot reach the threshold by themselves."""
    r = np.random.default_rng(2)
    idf = tuple((10 / (1 + np.arange(256) / 20)).tolist())
    rank = Ranking(lambda n: n, r.integers(0, 200, SPAN).astype(np.uint8), idf, cosine=0.3, norm=20.0)
    t = some_texts(2, 40)
    some, every = grams.tokens(t, rank), grams.tokens(t, rank, whole=True)
    w = rank.weights(every.key) ** 2
    for i in range(40):
        mine = every.text == i
        left = w[mine][(some.text == i).sum() :]
        norm = np.sqrt(w[mine].sum())
        assert len(left) and min(np.sqrt(left.sum()) / norm, left.sum() / (norm * 20.0)) < 0.3


def test_union_sketch_counts_the_smallest_of_the_union():
    rank = pairs.bottom_k(4)
    t = some_texts(6, 30, 3, (20, 40))
    p = grams.tokens(t, rank, whole=True)
    count = np.bincount(p.text, minlength=len(t))
    a, b = np.triu_indices(30, 1)
    keys = [set(p.key[p.text == i].tolist()) for i in range(30)]
    for least in (0.25, 0.5, 1.0):
        want = [len(set(sorted(keys[i] | keys[j])[:4]) & keys[i] & keys[j]) / min(4, len(keys[i] | keys[j])) >= least for i, j in zip(a, b)]
        assert pairs.sketch_verify(4, least, 0.0)(t, p, count, a, b).tolist() == want


def test_the_filters_reject_pairs():
    """Of pairs that share a listed token, the estimate and the Jaccard similarity turn a part away."""
    t = some_texts(8, 3000, 6)
    plan = plan_of(1, listed=pairs.SKETCH)
    _, text, name = blockjoin.unpack_blocks([b for _, b in blockjoin.pack_blocks(t, plan)], plan, 0)
    a, b, _, _ = next(blockjoin.walk(t, plan, text, name, (4, 5), False))
    p = grams.tokens(t, plan.ranking, whole=True)
    ok = pairs.sketch_verify(pairs.SKETCH, 0.03, 0.03)(t, p, np.bincount(p.text, minlength=len(t)), a, b)
    assert 0 < ok.sum() < 0.8 * len(ok)


def test_token_sets_are_made_for_pairs_at_home_alone(monkeypatch):
    """Alike texts meet in most of the buckets; whole token sets are made in the one where a pair is kept."""
    texts = list(dict.fromkeys(family(31, 12, 6, (40, 60), 2)))
    size = np.array([len(x) for x in texts])
    flat = np.frombuffer("".join(texts).encode(), np.uint8) - np.uint8(65)
    t = Texts(np.arange(len(texts)), flat, size, *(np.zeros(len(texts), np.int32) for _ in range(2)))
    plan, made, got = plan_of(12, listed=pairs.SKETCH), [], []
    packed = list(blockjoin.pack_blocks(t, plan))
    monkeypatch.setattr(blockjoin, "tokens", lambda few, *a, **how: made.append(len(few)) or grams.tokens(few, *a, **how))
    for bucket in range(12):
        u, a, b = blockjoin.list_pairs(*blockjoin.sorted_out([x for k, x in packed if k == bucket], plan, bucket), pairs.sketch_verify(pairs.SKETCH, 0.03, 0.03), (4, 5), False)
        got += zip(np.minimum(u.tid[a], u.tid[b]).tolist(), np.maximum(u.tid[a], u.tid[b]).tolist())
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] != texts[j] and alike(texts[i], texts[j])}
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)
    assert 0 < sum(made) < 2 * len(texts)


def test_first_keys_and_shared_keys_equal_plain_sets():
    """Texts with repeated tokens, none, and more than the table is wide; a class for some tokens."""
    r = np.random.default_rng(4)
    rank = Ranking(lambda n: n, r.integers(0, 3, SPAN).astype(np.uint8))
    t = some_texts(12, 120, 2, (0, 90))
    every, quick = grams.tokens(t, rank, whole=True), grams.tokens(t, rank, whole=True, places=False)
    assert (every.text == quick.text).all() and (every.key == quick.key).all()
    assert (rank.key(grams.codes_at(t, every.text, every.place)) == every.key).all()
    own = [every.key[every.text == i].tolist() for i in range(len(t))]
    first = grams.first_keys(t, rank, 8)
    assert [[k for k in row if k != NONE] for row in first.tolist()] == [k[:8] for k in own]
    count = np.bincount(every.text, minlength=len(t))
    a, b = np.triu_indices(len(t), 1)
    s = blockjoin.shared_of(every, count, a, b)
    got = {}
    for pair, key in zip(s.pair.tolist(), s.key.tolist()):
        got.setdefault(pair, []).append(key)
    want = {n: k for n, (i, j) in enumerate(zip(a, b)) if (k := sorted(set(own[i]) & set(own[j])))}
    assert got == want
    some = np.array(sorted(want))
    assert blockjoin.first_shared(t, rank, a[some], b[some]).tolist() == [want[n][0] for n in some.tolist()]


def test_postings_are_ordered_by_list_and_size():
    r = np.random.default_rng(1)
    for most in (90, 1 << 17):
        size, name = r.integers(0, most, 4000), r.integers(0, 1 << 63, 300).astype(np.uint64)[r.integers(0, 300, 4000)]
        assert (blockjoin.in_order(size, name) == np.lexsort((size, name))).all()
    assert len(blockjoin.in_order(size[:0], name[:0])) == 0


def test_groups_of_pairs(spark, tmp_path, texts):
    few = [t for t in texts[:60] if t and len(t) < 100]
    spark.createDataFrame([(i, t) for i, t in enumerate(few)], "ord long, seq string").write.parquet(str(tmp_path / "scored_candidates.parquet"))
    spark.createDataFrame([(i, t) for i, t in enumerate(few[:30])], "ord long, sequence string").write.parquet(str(tmp_path / "controllability_sequences.parquet"))
    rows = pairs.p4_groups(spark, str(tmp_path)).collect()
    found = pairs.p4_found(spark, str(tmp_path)).collect()
    assert {(r.table_name, r.ord) for r in rows} == {(p.table_name, o) for p in found for o in (p.ord_a, p.ord_b)}
    group = {(r.table_name, r.ord): r.group_ord for r in rows}
    assert all(group[p.table_name, p.ord_a] == group[p.table_name, p.ord_b] for p in found)
