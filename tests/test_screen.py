"""Screens, sources and segmentation: hand cases, nulls, empty tables, repeats, clashing names."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from resiq.operators import screen
from resiq.operators.segment import Segmenter, explode_values, known_values
from resiq.sources import fasta, tables


def seqs(spark, rows):
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(rows)], "ord long, seq string")


def reasons(df):
    return [r.reason for r in df.orderBy("ord").collect()]


def test_screen_order_and_precedence(spark):
    cand = seqs(spark, ["AAA", "ACDEFGHX", "KKLLKKLL", "KKLLKKLL", "GGGGGGGG", "GGGGGGGG", None, "", "K" * 5000])
    ref = spark.createDataFrame([("GGGGGGGG",), ("GGGGGGGG",), (None,)], "seq string")
    out = screen.syntactic_filter(cand.withColumn("first", F.lit("clash")).drop("first"), ref)
    assert reasons(out) == ["length", "alphabet", "accept", "duplicate", "exact_reference", "exact_reference", "length", "length", "length"]
    stats = screen.syntactic_stats(out).first()
    assert (stats.n_input, stats.n_passed, stats.attrition_rate) == (9, 1, pytest.approx(0.8889))
    assert screen.syntactic_stats(screen.syntactic_filter(cand.limit(0), ref)).first().attrition_rate == 0
    assert reasons(screen.background_clean(cand, ref))[2:6] == ["kept", "duplicate_sequence", "exact_amp_match", "exact_amp_match"]


def test_audit_names_the_first_clean_record(spark):
    df = spark.createDataFrame([(1, "a", "KKLLKKLL"), (2, None, "KKLLKKLL"), (3, "c", "KKLLKKLL"), (4, "d", None), (5, " ", "KX*X"), (6, "e", "KKLLKKLL")], "ord int, header string, sequence string")
    got = {r.ord: (list(r.reasons), r.duplicate_of) for r in screen.audit(df).collect()}
    assert got == {1: ([], None), 2: (["missing_header"], None), 3: (["duplicate_sequence"], 1), 4: (["empty_sequence"], None), 5: (["missing_header", "invalid_residues:*X", "length_outside_8_50"], None), 6: (["duplicate_sequence"], 1)}
    report = screen.audit_report(screen.audit(df)).first()
    assert (report.n_input, report.n_unique, report.n_duplicates, report.n_clean) == (6, 2, 3, 1)
    assert screen.audit_report(screen.audit(df.limit(0))).first().n_input == 0


def walk(draws, reference, targets):
    """The sequential version of quota_accept."""
    seen, out = set(), []
    for target, quota in targets:
        n = 0
        for draw, s in draws[target]:
            if n >= quota:
                break
            bad = "length" if s is None or not 8 <= len(s) <= 50 else "alphabet" if set(s) - set("ACDEFGHIKLMNPQRSTVWY") else "exact_reference" if s in reference else "duplicate" if s in seen else None
            if bad is None:
                seen.add(s)
                n += 1
            out.append((target, draw, bad or "accept"))
    return sorted(out)


def test_quota_shares_what_was_seen(spark):
    base = [f"KKLLKKL{a}" for a in "ACDEFGHIKLMN"]
    draws = {"one": list(enumerate([base[0], base[0], "X", base[1], base[2], base[3], base[4]])), "two": list(enumerate([base[1], base[3], base[4], None, base[5], base[6]])), "three": []}
    rows = [(t, d, s) for t, ds in draws.items() for d, s in ds]
    df = spark.createDataFrame(rows, "target string, draw long, seq string")
    ref = spark.createDataFrame([(base[2],)], "seq string")
    targets = [("one", 2), ("two", 3), ("three", 4)]
    got = sorted((r.target, r.draw, r.reason) for r in screen.quota_accept(df, ref, targets).collect())
    assert got == walk(draws, {base[2]}, targets)


def test_nth_value(spark):
    df = spark.range(0, 100_000, 7).toDF("x")
    assert [screen.nth(df, "x", n) for n in (1, 2, 14286, 14287, 0)] == [0, 7, 99995, None, None]
    assert screen.nth(df.limit(0), "x", 1) is None


def test_fasta_files(spark, tmp_path):
    text = "a remark\n>one x=1\nacd\n\n EFG \n>two\r\nKK\r\n>three\n"
    (tmp_path / "a.fasta").write_text(text)
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(">four\nWW")
    (tmp_path / "c.fasta").write_text("")
    got = [(r.ord, r.header, r.sequence) for r in fasta.fasta_scan(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [(1, "one x=1", "ACDEFG"), (2, "two", "KK"), (3, "three", ""), (4, "four", "WW")]
    with pytest.raises(ValueError, match="before the first header"):
        fasta.fasta_scan_strict(spark, str(tmp_path / "a.fasta"))
    with pytest.raises(ValueError, match="no FASTA"):
        fasta.fasta_scan_strict(spark, str(tmp_path / "c.fasta"))
    out = str(tmp_path / "out")
    fasta.write_fasta(spark.createDataFrame([(1, "h", "KK"), (2, "g", "RR")], "ord int, header string, sequence string"), out)
    assert [(r.header, r.sequence) for r in fasta.fasta_scan(spark, out).orderBy("ord").collect()] == [("h", "KK"), ("g", "RR")]
    assert tables.manifest(spark, str(tmp_path / "a.fasta")).first().records == 3


def test_csv_and_layered_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n,y\n")
    assert [tuple(r) for r in tables.csv_scan(spark, str(tmp_path / "x.csv"), "a int, b string", ["a"]).collect()] == [(1, "x"), (None, "y")]
    with pytest.raises(ValueError, match="missing columns: c"):
        tables.csv_scan(spark, str(tmp_path / "x.csv"), "a int, b string", ["c"])
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}, "b": 3}')
    (tmp_path / "own.json").write_text('{"extends": "base.json", "a": {"y": 5}}')
    (tmp_path / "loop.json").write_text('{"extends": "loop.json"}')
    assert tables.layered(tmp_path / "own.json", json.loads) == {"a": {"x": 1, "y": 5}, "b": 3}
    with pytest.raises(ValueError, match="cycle"):
        tables.layered(tmp_path / "loop.json", json.loads)


CASES = {
    "A|B;C,D\tE": ["A", "B", "C", "D", "E"],
    "A / B": ["A", "B"],
    "in-house 7/8 / B": ["in-house 7/8", "B"],
    "a/b": ["a/b"],
    "/ a /": ["a"],
    '"x; y"|z': ["x; y", "z"],
    "'x, y' ; O'Pep set": ["x, y", "O'Pep set"],
    '"""Lytic"" list"|B': ['"Lytic" list', "B"],
    '"a \\"b\\" c",d': ['a "b" c', "d"],
    '["a", "b \\"c\\"", null, " "]': ["a", 'b "c"'],
    "[broken|x": ["[broken", "x"],
    '"never closed|x': ['"never closed', "x"],
    "A||B|": ["A", "B"],
    "A;A": ["A", "A"],
    "-": [],
    " N/A ": [],
    "": [],
    "  ": [],
    None: [],
    "x" * 100_000 + ";y": ["x" * 100_000, "y"],
}


def test_segmenter_cases():
    for known in ([], ["A", "x; y", "in-house 7/8", "anti-Gram+/-"]):
        s = Segmenter(known)
        for text, want in CASES.items():
            assert s(text) == want, (text, known)


def test_exploded_values(spark):
    rows = [(i, t, None, "clash") for i, t in enumerate(CASES)]
    df = spark.createDataFrame(rows, "ord long, dbs string, activity string, value string")
    got = {}
    for r in explode_values(df, "ord", ["dbs", "activity"]).orderBy("ord", "pos").collect():
        got.setdefault(r.ord, []).append(r.value)
    assert got == {i: v for i, v in enumerate(CASES.values()) if v}
    assert explode_values(df.limit(0), "ord", ["dbs", "activity"]).count() == 0
    many = spark.createDataFrame([("a|b",), ("Katp; x",), *[('"Katp; old"|z',)] * 3, *[("solo",)] * 3], "dbs string")
    assert set(known_values(many, ["dbs"])) == {"Katp; old", "solo"}
