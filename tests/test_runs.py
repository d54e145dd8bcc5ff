"""Predictions, checks and records of runs; protected values; pairs drawn; odd rows."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from resiq.operators import runs, sampling
from resiq.operators.segment import Segmenter, explode_values
from resiq.session import read_folder


def test_small_files(spark):
    df = spark.createDataFrame([("a", 10), ("b", 2_000_000), ("c", None)], "path string, bytes long")
    assert {r.path for r in runs.unfetched(df).collect()} == {"a", "c"} and runs.unfetched(df.limit(0)).count() == 0


def test_one_hot_takes_default_then_search(spark):
    df = spark.createDataFrame([("PBS",), ("water",), (None,), ("oil",)], "c string")
    get = lambda *a, **k: [r[0] for r in df.select(runs.one_hot(F.col("c"), *a, **k)).collect()]
    assert get(["DPBS", "PBS", "water"], "water") == [[0, 1, 0], [0, 0, 1], [0, 0, 1], [0, 0, 1]]
    assert get(["DPBS", "PBS", "water"], "0.1 M PBS", "PBS", "DPBS")[2:] == [[0, 1, 0], [0, 1, 0]]
    assert get(["a"], "x") == [[0]] * 4 and get([], "x") == [[]] * 4


def test_each_sequence_is_predicted_once(spark):
    rows = [(1, "kk", "x"), (2, "KK ", None), (3, None, "y"), (4, "K1", "z"), (5, "", "w")]
    df = spark.createDataFrame(rows, "ord long, seq string, n string")
    seen = []

    def predict(d):
        seen.append(sorted(r[0] for r in d.collect()))
        return d.select("sequence", F.length("sequence").alias("n"))

    got = {r.ord: (r.clean, r.n, r.error) for r in runs.predicted(df, "seq", predict).collect()}
    assert seen == [["KK"]] and got[1] == got[2] == ("KK", 2, None)
    assert got[3] == got[5] == (None, None, "empty sequence") and got[4][:2] == (None, None) and "1" in got[4][2]
    assert runs.predicted(df.limit(0), "seq", predict).count() == 0
    with pytest.raises(ValueError, match="nonstandard"):
        runs.predicted(df, "seq", predict, strict=True)


def test_every_check_of_a_submission(spark):
    library = spark.createDataFrame([("a", "ACDEFGHIK"), ("", "ACDEFGHIK"), ("c", None), ("d", "ACD"), ("e", "A" * 51), ("f", "ACDEFGHI1")], "header string, sequence string")
    top = spark.createDataFrame([("ACDEFGHIK",), ("ACDEFGHIK",), ("WWWWWWWW",)], "sequence string")
    ref = spark.createDataFrame([("ACD",), (None,)], "sequence string")
    got = {r.check: r.n for r in runs.verify(library, top, ref, 5, 2).collect()}
    assert got == {"header": 1, "empty": 1, "alphabet": 1, "short": 1, "long": 1, "size": 1, "duplicate": 1, "top_duplicate": 1, "top_unknown": 1, "overlap": 1, "top_size": 1}
    good = library.limit(1)
    assert runs.verify(good, good.select("sequence"), ref, 1, 1).count() == 0


def test_digest_tells_runs_apart(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    one = runs.digest(df).first()
    assert runs.digest(df.repartition(3)).first() == one != runs.digest(df.distinct()).first()
    assert runs.digest(df.limit(0)).first().n == 0


def test_manifest_and_stage(spark, tmp_path, caplog):
    with caplog.at_level(logging.INFO, logger="resiq"), runs.stage("one"):
        pass
    assert [m.split()[0] for m in caplog.messages] == ["STAGE", "DONE"] and "seconds=" in caplog.messages[1]
    runs.finish(spark, str(tmp_path / "m" / "run.json"), runs.run_manifest("r", {"a": 1}, ["y", "x"]), rows=3)
    m = json.loads(read_folder(spark, str(tmp_path / "m"))["run.json"])
    assert m["status"] == "done" and m["inputs"] == ["x", "y"] and m["rows"] == 3 and m["seconds"] >= 0
    assert read_folder(spark, str(tmp_path / "none")) == {}


def test_the_dictionary_protects_separators(spark):
    """Taking the dictionary out, or the protection, changes these results."""
    known = ["mammalian cells, HC50>128", "anti-Gram+", "a/b", "HC50>128"]
    field = "anti-Gram+, mammalian cells, HC50>128 ; x"
    assert Segmenter(known, True)(field) == ["anti-Gram+", "mammalian cells, HC50>128", "x"]
    assert Segmenter([], True)(field) == Segmenter(known)(field) == ["anti-Gram+", "mammalian cells", "HC50>128", "x"]
    assert Segmenter(known, True)("mammalian cells, HC50>1289") == ["mammalian cells", "HC50>1289"]
    assert Segmenter(["a,b", "b,c", "a,b,c"], True)("a,b,c") == ["a,b,c"] and Segmenter(["a,b", "b,c"], True)("a,b,c") in (["a,b", "c"], ["a", "b,c"])
    df = spark.createDataFrame([(i, '"p, q"', None) for i in range(3)] + [(9, "p, q", "")], "ord long, a string, b string")
    got = {(r.ord, r.pos, r.value) for r in explode_values(df, "ord", ["a", "b"], protect=True).collect()}
    assert got == {(i, 1, "p, q") for i in (0, 1, 2, 9)}


@pytest.mark.parametrize("rows,n,want", [(0, 5, 0), (1, 5, 0), (5, 100, 10), (5, 4, 4), (40, 100, 100), (40, 700, 700)])
def test_pairs_are_different_and_enough(spark, rows, n, want):
    got = [(r.a, r.b) for r in sampling.pair_sample(spark.range(rows), "id", n).collect()]
    assert len(got) == len(set(got)) == want and all(a < b for a, b in got)
