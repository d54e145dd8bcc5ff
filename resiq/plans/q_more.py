"""Queries of the remaining items: gates, positional concatenation, novel top lists, encodings, verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from resiq.functions import text as X
from resiq.operators import ranks, similarity, vectors
from resiq.plans.q_relational import GOOD, OK, RANKS, combined, controlled, scored
from resiq.plans.q_screen import split_candidates
from resiq.plans.q_sequence import LCS, MASKS
from resiq.plans.registry import AA, REF, query, residues
from resiq.session import table


@query("b13_length_gate", f"SELECT target, count(*) FILTER (least(length({residues('sequence')}), 30) / greatest(length({residues('sequence')}), 30) >= 0.7) AS n_pass, count(*) AS n FROM controllability_sequences WHERE target IS NOT NULL GROUP BY 1")
def b13(spark, sf):
    """Lengths within 0.7 of 30; an empty text fails."""
    n = F.length(X.residues(F.col("sequence")))
    return controlled(spark, sf).where("target is not null").groupBy("target").agg(F.count_if((n > 0) & (F.least(n, F.lit(30)) / F.greatest(n, F.lit(30)) >= 0.7)).alias("n_pass"), F.count("*").alias("n"))


@query("c11_concat_columns", "SELECT a.ord, a.score, b.length FROM scored_candidates a JOIN controllability_sequences b ON a.ord = b.ord")
def c11(spark, sf):
    """Columns of two row-aligned tables, put together by their key."""
    return scored(spark, sf).select("ord", "score").join(controlled(spark, sf).select("ord", "length"), "ord")


NOVEL_TOP = f"""WITH {REF}, {RANKS}, l AS (SELECT f.ord, f.s AS b, row_number() OVER (ORDER BY round(c, 9) DESC, f.s, f.ord) AS inspected FROM f JOIN scored_candidates x ON f.ord = x.ord WHERE batch_no > 8 AND f.s IS NOT NULL),
 r AS (SELECT {MASKS.format(s='s')} AS m, length(s)::INT AS n FROM ref), d AS (SELECT DISTINCT b FROM l WHERE length(b) BETWEEN 1 AND 62),
 near AS (SELECT DISTINCT b FROM d JOIN r ON n BETWEEN floor(length(b) * 2 / 3) + 1 AND ceil(length(b) * 3 / 2) - 1 WHERE 5 * {LCS} > 2 * (length(b) + n))
 SELECT row_number() OVER (ORDER BY inspected) AS rank, inspected, ord FROM l WHERE b NOT IN (SELECT b FROM near) ORDER BY inspected LIMIT 50"""


@query("f3_top_novel", NOVEL_TOP)
def f3(spark, sf):
    """The 50 best novel candidates with their place among all, which tells how many were looked at."""
    _, ref = split_candidates(spark, sf)
    ranked = ranks.positions(combined(spark, sf).where("batch_no > 8 and s is not null").select("ord", F.col("s").alias("seq"), "combined_score"), [F.desc(F.round("combined_score", 9)), F.col("seq"), F.col("ord")], "inspected")
    novel = similarity.novelty(ranked, ref.withColumn("ord", F.xxhash64("seq")))
    return ranks.positions(novel, [F.col("inspected")], "rank", most=50).select("rank", "inspected", "ord")


@query("m9_interval", f"SELECT ord, round(score - 1.959963984540054 * 0.1, 6) AS lo, round(score + 1.959963984540054 * 0.1, 6) AS hi FROM scored_candidates WHERE {OK}")
def m9(spark, sf):
    lo, hi = vectors.interval(F.col("score"), F.lit(0.1))
    return scored(spark, sf).where(OK).select("ord", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("o3_condition_zscore", f"WITH g AS (SELECT * FROM controllability_sequences WHERE {GOOD}), s AS (SELECT avg(charge_ph7_4) AS m, stddev_samp(charge_ph7_4) AS d FROM g) SELECT ord, round((charge_ph7_4 - m) / greatest(d, 1e-6) + 1e-9, 6) AS z FROM g, s")
def o3(spark, sf):
    g = controlled(spark, sf).where(GOOD)
    one = g.agg(F.avg("charge_ph7_4").alias("m"), F.stddev_samp("charge_ph7_4").alias("d"))  # one row
    return ranks.attach(g, one).select("ord", F.round((F.col("charge_ph7_4") - F.col("m")) / F.greatest(F.col("d"), F.lit(1e-6)) + 1e-9, 6).alias("z"))


R = residues("sequence")


@query(
    "o7_verify_errors",
    f"""WITH a AS (SELECT record_id, {R} AS s FROM antibacterial_fasta), e AS (SELECT CASE WHEN coalesce(s, '') = '' THEN 'empty' WHEN length(s) NOT BETWEEN 8 AND 50 THEN 'length' WHEN NOT regexp_full_match(s, '[{AA}]+') THEN 'alphabet' END AS error FROM a
  UNION ALL SELECT 'duplicate' FROM (SELECT s FROM a WHERE s <> '' GROUP BY 1 HAVING count(*) > 1)) SELECT error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY 1""",
)
def o7(spark, sf):
    """What a submission check would report, by kind; repeated sequences count once."""
    s = table(spark, sf, "antibacterial_fasta").select(X.residues(F.col("sequence")).alias("s"))
    kind = F.when(F.coalesce("s", F.lit("")) == "", "empty").when(~F.length("s").between(8, 50), "length").when(~X.is_peptide(F.col("s")), "alphabet")
    again = s.where("s <> ''").groupBy("s").count().where("count > 1").select(F.lit("duplicate").alias("error"))
    return s.select(kind.alias("error")).where("error is not null").unionAll(again).groupBy("error").agg(F.count("*").alias("n"))
