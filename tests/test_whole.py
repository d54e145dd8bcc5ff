"""Queries cover their whole tables: rows of every split, length and content."""

import json
import random

from resiq.operators import segment
from resiq.operators.segment import Segmenter
from resiq.plans import catalog
from tests.brute import family, lcs


def run(spark, path, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{t}.parquet")
    return catalog.queries()[name](spark, str(path)).collect()


LONG = "ACDEFGHIKLMNPQRSTVWY" * 4
PEPTIDES = [
    (1, "ACDEFGHIKL", "train"), (2, "ACDEFGHIKV", "val"), (3, "ACDEFGHIVV", None), (4, LONG, "train"), (5, LONG[:-1] + "A", "test"),
    (6, "WWPPWWPPWW", "test"), (7, "AC", "train"), (8, "AD", "val"), (9, "ac-defghikl", "test"), (100, LONG[:-2], "val"),
]


def peptides():
    return [(*p, "s") for p in PEPTIDES], "ord long, sequence string, split string, source string"


def test_single_linkage_links_through_all_splits_and_lengths(spark, tmp_path):
    cluster = {r.s: r.cluster_id for r in run(spark, tmp_path, "k8_single_linkage", conditioned_peptides=peptides())}
    assert len(cluster) == 9
    assert cluster["ACDEFGHIKL"] == cluster["ACDEFGHIKV"] == cluster["ACDEFGHIVV"]
    assert cluster[LONG] == cluster[LONG[:-1] + "A"] == cluster[LONG[:-2]]
    assert len(set(cluster.values())) == 5


def test_kmer_pairs_of_all_splits_with_short_texts(spark, tmp_path):
    got = {(r.a, r.b) for r in run(spark, tmp_path, "c8_kmer_join", conditioned_peptides=peptides())}
    assert got == {(1, 2), (1, 3), (2, 3), (4, 5), (4, 100), (5, 100), (7, 8)}


def test_nearest_train_of_long_texts(spark, tmp_path):
    (r,) = run(spark, tmp_path, "c9_nearest_train", conditioned_peptides=peptides())
    assert (r.id, r.nearest, round(r.identity, 6)) == (100, 4, 0.975)


def test_json_cells_escape(spark, tmp_path):
    dbs = ['DRAMP|"a, b"|APD', "x\ty|z", "plain|", None]
    rows = [(i, "h", d, "ACD") for i, d in enumerate(dbs)]
    got = {r.ord: r.dbs for r in run(spark, tmp_path, "a7_json_cells", antibacterial_fasta=(rows, "ord long, header string, dbs string, sequence string"))}
    assert {i: json.loads(x) for i, x in got.items()} == {i: d.split("|") for i, d in enumerate(dbs) if d is not None}


def test_fasta_scan_of_sequences_with_spaces(spark, tmp_path):
    seqs = ["AC DE", " ac\n\n d e \r\nFG", "ACD", None]
    rows = [(i, "h", "d", s) for i, s in enumerate(seqs)]
    got = {r.ord: r.sequence for r in run(spark, tmp_path, "a1_fasta_scan", antibacterial_fasta=(rows, "ord long, header string, dbs string, sequence string"))}
    assert got == {0: "AC DE", 1: "ACD EFG", 2: "ACD"}


def test_largest_similarity_of_all_candidates(spark, tmp_path):
    texts = family(4, 30, 7, (12, 40), 5)
    random.Random(1).shuffle(texts)
    rows = [(i, 1 if i < 40 else 9, s) for i, s in enumerate(texts)]
    ref = {s for _, b, s in rows if b == 1 and 8 <= len(s) <= 50}
    ratio = {i: max(2 * lcs(s, x) / (len(s) + len(x)) for x in ref) for i, b, s in rows if b == 9 and 8 <= len(s) <= 50}
    want = {i: round(x, 6) if x > 0.5 else None for i, x in ratio.items()}
    assert len(want) > 100
    assert {r.ord: r.max_ratio for r in run(spark, tmp_path, "c4_max_similarity", scored_candidates=(rows, "ord long, batch_no int, seq string"))} == want


def test_quoted_lists_stay_whole():
    for known in ([], ["A", "B"], ["A", "B", "C", "D"]):
        s = Segmenter(known)
        assert s('"x;A;B;y";z') == ["x;A;B;y", "z"]
        assert s("A|'a;b;c;d;e;f;g;h;i;j'") == ["A", "a;b;c;d;e;f;g;h;i;j"]
        assert s('"A;B;C;D;A;B";C') == ["A;B;C;D;A;B", "C"]
        assert s('"a;B" c;A') == ['"a', 'B" c', "A"]


def test_a_dictionary_is_made_only_where_it_bears_on_the_values(spark, tmp_path, monkeypatch):
    made, count = [], segment.known_values
    monkeypatch.setattr(segment, "known_values", lambda *a: made.append(1) or count(*a))
    rows = [(i, x, None) for i, x in enumerate(['"a;b"|c', "a;b", '"a;b"', '"a;b"', None])]
    spark.createDataFrame(rows, "ord long, dbs string, activity string").write.parquet(f"{tmp_path}/antibacterial_fasta.parquet")
    values = lambda q: sorted((r.ord, r.pos, r.value) for r in q(spark, str(tmp_path)).collect())
    plain = values(segment.p2_found)
    assert not made
    assert plain == [(0, 1, "a;b"), (0, 2, "c"), (1, 1, "a"), (1, 2, "b"), (2, 1, "a;b"), (3, 1, "a;b")]
    assert (1, 1, "a;b") in values(segment.p2_protected) and made
