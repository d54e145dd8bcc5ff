"""Whole dataflows: library generation, cohort comparison, assay training table (survey 3.1-3.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resiq.functions import descriptors as D
from resiq.functions import scales as S
from resiq.functions import text as X
from resiq.operators import ranks, sampling, screen, similarity, stats
from resiq.plans.q_relational import training_rows
from resiq.plans.q_screen import split_candidates
from resiq.plans.registry import query
from resiq.session import cut, table


def library(candidates: DataFrame, reference: DataFrame, size: int, top: int) -> DataFrame:
    """3.1: screened, scored, rank-fused, novel candidates: (rank, ord, seq, combined_score, shortlist). Fewer than
    `size` rows come out where fewer are left. The scores are descriptors here, where models are absent."""
    ok = cut(screen.syntactic_filter(candidates, reference).where("reason = 'accept'").select("ord", "seq"))
    novel = similarity.novelty(ok, reference.withColumn("ord", F.xxhash64("seq")))
    s = F.col("seq")
    scored = cut(novel.select("ord", "seq", D.net_charge(s, 7.4, S.LEHNINGER).alias("one"), F.exp(D.mean_scale(s, S.INTERFACE)).alias("two")))
    fused = scored.join(ranks.fused(scored, "ord", "one", "two"), "ord")
    best = ranks.positions(fused, [F.desc(F.round("combined_score", 9)), F.col("seq")], most=size)
    return best.select("rank", "ord", "seq", F.round("combined_score", 6).alias("combined_score"), (F.col("rank") <= top).alias("shortlist"))


@query("pipeline_library")
def pipeline_library(spark: SparkSession, sf: str) -> DataFrame:
    cand, ref = split_candidates(spark, sf)
    return library(cand, ref, 1000, 100)


@query("pipeline_cohorts")
def pipeline_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    """3.2: database records against generated candidates: both cleaned, matched by length, described, compared; joined
    with the comparison of the unmatched cohorts."""
    one = screen.dedup_first(table(spark, sf, "antibacterial_fasta").select("ord", X.tidy(F.col("sequence")).alias("seq")).where(X.is_peptide(F.col("seq"))), "seq")
    two = table(spark, sf, "scored_candidates").select("ord", X.tidy(F.col("seq")).alias("seq"))
    two = screen.background_clean(two, one.select("seq")).where("reason = 'kept'").select("ord", "seq")
    one, two = (cut(d.withColumn("length", F.length("seq"))) for d in (one, two))
    names = ("length", "charge_ph7_4", "hydrophobicity_eisenberg", "aliphatic_index", "boman_index")

    def compared(a: DataFrame, b: DataFrame, suffix: str) -> DataFrame:
        both = a.withColumn("class", F.lit("a")).unionByName(b.withColumn("class", F.lit("b"))).select("class", "seq")
        own = D.describe(both, "seq", names)
        out = stats.compare(stats.long_form(own, list(names), "class"), "class", "a", "b")
        return out.select("descriptor", F.col("n_one").alias(f"n_one_{suffix}"), F.round("cliffs_delta", 4).alias(f"cliffs_delta_{suffix}"), F.round("ks", 4).alias(f"ks_{suffix}"))

    m1, m2 = sampling.length_matched_pairs(one, two)
    return compared(one, two, "unmatched").join(compared(m1, m2, "matched"), "descriptor", "full_outer")


@query("pipeline_mic_table")
def pipeline_mic_table(spark: SparkSession, sf: str) -> DataFrame:
    """3.3: training rows with clusters of similar sequences."""
    rows = training_rows(spark, sf)
    groups = similarity.greedy_clusters(rows.select(F.col("sequence").alias("seq")).distinct())
    return rows.join(groups.withColumnRenamed("seq", "sequence"), "sequence").select("sequence", "bacterium", F.round("pmic", 6).alias("pmic"), "relevance", "cluster_id")
