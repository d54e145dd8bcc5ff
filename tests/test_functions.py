"""Scalar functions against plain Python and hand cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from resiq.functions import descriptors as D
from resiq.functions import scales as S
from resiq.functions import text as X
from resiq.functions.lcs import lcs_length, lcs_long, lcs_pairs
from resiq.operators.similarity import identities, indel_ratio
from resiq.operators.stats import kolmogorov, normal_cdf
from tests.brute import family, lcs
from tests.conftest import SF


def one(spark, rows, column, *more):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    return [r[0] for r in df.select(column, "i", *more).orderBy("i").collect()]


def test_lcs_matches_dynamic_programming():
    r = random.Random(1)
    texts = family(3, 12, 4, (0, 60)) + ["", "A", "K" * 64, "K" * 65, "KR" * 70, "".join(r.choice("ACD") for _ in range(300))]
    a = [r.choice(texts) for _ in range(400)]
    b = [r.choice(texts) for _ in range(400)]
    want = [lcs(x, y) for x, y in zip(a, b, strict=True)]
    assert lcs_pairs(a, b).tolist() == want
    assert [lcs_long(x, y) for x, y in zip(a, b, strict=True)] == want


def test_lcs_of_many_letters_and_of_nulls(spark):
    wide = "".join(chr(0x400 + i) for i in range(300))
    assert lcs_pairs([wide], [wide[::2]]).tolist() == [150]
    df = spark.createDataFrame([("AC", "A"), (None, "A"), ("", "A")], "a string, b string")
    assert [r[0] for r in df.select(lcs_length(F.col("a"), F.col("b"))).collect()] == [1, None, 0]
    assert [r[0] for r in df.select(indel_ratio(F.col("a"), F.col("b"))).collect()] == [pytest.approx(2 / 3), None, 0.0]


def test_assay_texts(spark):
    assert one(spark, [">=12.5", "-3", "1e-5", "abc", None, "4-8", "8 ug/ml"], X.number_in(F.col("s"))) == [12.5, 3.0, 1.0, None, None, 4.0, 8.0]
    names = ["e.coli", " A. baumanii X", "acinetobacter BAUMANNII", "one  two three", None, "", "brassicola"]
    assert one(spark, names, X.organism(F.col("s"))) == ["E.Coli", "Acinetobacter Baumannii", "Acinetobacter Baumannii", "one two three", "unknown", "", "Alternaria Brassicicola"]


def test_direction_and_cleaning(spark):
    got = one(spark, ["1MKT", "2T K\nM", "MKT", None, ""], F.concat_ws("/", X.directed(F.col("s"))["direction"], X.directed(F.col("s"))["seq"]))
    assert got == ["N2C/MKT", "C2N/MKT", "unknown/MKT", "", "unknown/"]
    assert one(spark, [" xbzuo ", None], X.substituted(F.trim("s"))) == ["ANQCK", None]
    assert one(spark, ["ac*d", "ACD", "", None, " nan "], X.normalized(F.col("s"))["err"]) == ["nonstandard residues: *", None, "empty sequence", "empty sequence", "empty sequence"]
    assert one(spark, ["ab-c\t", None, "", "ß1"], X.residues(F.col("s"))) == ["ABC", None, "", "SS"]


def test_header_last_key_wins(spark):
    got = one(spark, ["x a=1 b=2 a=3 c", "", None, "a=1=2"], X.header_fields(F.col("s")))
    assert got == [{"a": "3", "b": "2"}, {}, None, {"a": "1=2"}]


def test_length_bounds(spark):
    df = spark.createDataFrame([(12,)], "n int")
    lo, hi = X.shared_length_bounds(F.col("n"), 0.8)
    assert tuple(df.select(lo, hi).first()) == (9, 17)


def charge(s, ph):
    plus, minus, n, c = S.SAFETY
    if not s:
        return 0.0
    q = 1 / (1 + 10 ** (ph - n)) - 1 / (1 + 10 ** (c - ph))
    return q + sum(1 / (1 + 10 ** (ph - plus[a])) for a in s if a in plus) - sum(1 / (1 + 10 ** (minus[a] - ph)) for a in s if a in minus)


SEQS = ["", "K", "GIGKFLHSAKKFGKAFVGEIMNS", "DDDDEEEE", "XXK", "KWKLFKKIEKVGQNIRDGIIKAGPAVAVVGQATQIAK"]


def test_descriptors_of_edge_cases(spark):
    s = F.col("s")
    assert one(spark, SEQS, D.net_charge(s)) == [pytest.approx(charge(x, 7.4)) for x in SEQS]
    pi = one(spark, [*SEQS, None], D.isoelectric_point(s))
    assert pi[0] == 7.0 and pi[-1] is None
    assert all(abs(charge(x, p)) < 2e-4 for x, p in zip(SEQS[1:], pi[1:-1], strict=True) if p not in (0.0, 14.0))
    assert one(spark, [*SEQS, None], D.mean_scale(s, S.EISENBERG))[-2:] == [pytest.approx(sum(S.EISENBERG[a] for a in SEQS[-1]) / len(SEQS[-1])), None]
    assert one(spark, ["", "DG", "GGG", "A", None], D.unstable_share(s)) == [0.0, 100.0, 100.0, 0.0, None]
    assert one(spark, ["", "AB", "KRA"], D.terminal(s)) == [{}, {"n1": "A", "n2": "B", "c1": "B"}, {"n1": "K", "n2": "R", "c1": "A", "c2": "R"}]
    assert one(spark, ["", "AAK"], D.dipeptides(s)) == [{}, {"AA": 0.5, "AK": 0.5}]
    assert one(spark, ["", None, "K"], D.window_moment(s)) == [0.0, None, pytest.approx(1.5)]


def test_described_columns_equal_single_ones(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*SEQS, None])], "i int, s string").withColumn("mw", F.lit("clash"))
    wide = D.describe(df, "s").orderBy("i").toPandas()
    for name, column in D.summary(F.col("s")).items():
        single = df.select(column.alias("v"), "i").orderBy("i").toPandas().v
        np.testing.assert_allclose(wide[name].astype(float), single.astype(float), rtol=1e-9)


def test_descriptors_agree_with_recorded_ones(spark):
    """Recorded values have three decimals; some rows are dirty on purpose."""
    df = spark.read.parquet(f"{SF}/controllability_sequences.parquet").withColumn("s", X.residues(F.col("sequence")))
    near = lambda c, v: F.abs(c - F.col(v)) < 5.1e-4
    ok = near(D.net_charge(F.col("s"), 7.4, S.LEHNINGER), "charge_ph7_4") & near(D.mean_scale(F.col("s"), S.INTERFACE), "hydrophobicity_interfacescale_ph8")
    assert df.select(F.avg(F.coalesce(ok, F.lit(False)).cast("int"))).first()[0] > 0.9


def test_normal_and_kolmogorov(spark):
    zs = [-3.0, -1.0, 0.0, 0.5, 2.5]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    assert [r[0] for r in df.select(normal_cdf(F.col("z"))).collect()] == [pytest.approx(0.5 * (1 + math.erf(z / 2**0.5)), abs=2e-7) for z in zs]
    xs = spark.createDataFrame([(0.1,), (1.3581,)], "x double")
    assert [r[0] for r in xs.select(kolmogorov(F.col("x"))).collect()] == [1.0, pytest.approx(0.05, abs=1e-4)]


def test_alignment_identity():
    cases = {("KFAK", "KAAK"): (0.75, 1.0), ("ACDEFGH", "ACDEFGH"): (1.0, 1.0), ("", "A"): (0.0, 0.0), ("ACDEFGH", "ACDEFGH" + "K" * 23): (7 / 30, 1.0)}
    got = identities([a for a, _ in cases], [b for _, b in cases])
    for row, want in zip(got, cases.values(), strict=True):
        assert tuple(row) == pytest.approx(want)


def affine(a, b):
    """Best (score, matches, -columns) by the plain recurrence over states."""
    from functools import cache

    @cache
    def best(i, j, state):
        if i == 0 and j == 0:
            return (0.0, 0, 0) if state == "m" else None
        out = []
        if state == "m" and i and j:
            out = [(p[0] + (a[i - 1] == b[j - 1]), p[1] + (a[i - 1] == b[j - 1]), p[2] - 1) for s in "mxy" if (p := best(i - 1, j - 1, s))]
        if state == "x" and i:
            out = [(p[0] - (0.5 if s == "x" else 1.0), p[1], p[2] - 1) for s in "mxy" if (p := best(i - 1, j, s))]
        if state == "y" and j:
            out = [(p[0] - (0.5 if s == "y" else 1.0), p[1], p[2] - 1) for s in "mxy" if (p := best(i, j - 1, s))]
        return max(out, default=None)

    return max(p for s in "mxy" if (p := best(len(a), len(b), s)))


def test_alignment_against_plain_recurrence():
    texts = family(9, 6, 3, (3, 14), 4)
    pairs = [(a, b) for a in texts for b in texts[:8] if a != b]
    got = identities([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), row in zip(pairs, got, strict=True):
        _, matches, columns = affine(a, b)
        assert row[0] == pytest.approx(matches / -columns)
