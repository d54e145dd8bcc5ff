"""Queries of sources, joins, aggregates, ranks, sets and scalar functions (A, C, D, E, F, G, H)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resiq.functions import text as X
from resiq.operators import ranks, screen, stats
from resiq.plans.q_screen import records, split_candidates
from resiq.plans.registry import AA, CAND, REF, query, residues, tidy
from resiq.session import cut, table
from resiq.sources import fasta, tables


def scored(spark, sf):
    return table(spark, sf, "scored_candidates")


def controlled(spark, sf):
    return table(spark, sf, "controllability_sequences")


def observations(spark, sf):
    return table(spark, sf, "mic_observations")


# ---- A: sources and sinks


#: Lines trimmed and joined without blank ones, as the parser does it: white space inside a line stays.
JOINED = "upper(array_to_string(list_filter(list_transform(string_split(regexp_replace(sequence, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ''))"


@query("a1_fasta_scan", f"SELECT ord, 1 AS pos, trim(header) AS header, {JOINED} AS sequence FROM antibacterial_fasta WHERE sequence IS NOT NULL")
def a1(spark, sf):
    """Each record's FASTA text, sequences with line breaks as they are, back to header and sequence."""
    text = records(spark, sf).where("sequence is not null").select("ord", F.concat(F.lit("; a remark\n>"), F.col("header"), F.lit("\r\n"), F.col("sequence"), F.lit("\n\n")).alias("text"))
    return fasta.fasta_text(text, "text", "ord")


@query("a4_first_n_fasta", "SELECT ord, header FROM antibacterial_fasta ORDER BY ord LIMIT 25")
def a4(spark, sf):
    return fasta.first_records(records(spark, sf), 25).select("ord", "header")


@query("a5_fasta_sink", f"SELECT ord, '>amp' || ord || chr(10) || {tidy('sequence')} AS line FROM antibacterial_fasta WHERE sequence IS NOT NULL")
def a5(spark, sf):
    rows = records(spark, sf).where("sequence is not null").withColumn("sequence", X.tidy(F.col("sequence")))
    return fasta.fasta_lines(rows, prefix="amp")


@query("a7_json_cells", "SELECT ord, to_json(string_split(dbs, '|'))::VARCHAR AS dbs FROM antibacterial_fasta WHERE dbs IS NOT NULL")
def a7(spark, sf):
    return tables.json_cells(records(spark, sf).where("dbs is not null").select("ord", F.split("dbs", "[|]").alias("dbs")))


@query("a8_score_csv", "SELECT ord, id, printf('%.6f', score) AS score, printf('%.6f', hc50) AS hc50 FROM scored_candidates WHERE score IS NOT NULL AND hc50 IS NOT NULL AND NOT isnan(hc50)")
def a8(spark, sf):
    df = scored(spark, sf).where("score is not null and hc50 is not null and not isnan(hc50)").select("ord", "id", "score", "hc50")
    return tables.six_decimals(df, "score", "hc50")


@query("a9_json_sink", "SELECT cluster, '{\"cluster\":' || cluster || ',\"cluster_size\":' || cluster_size || '}' AS json FROM selected_generation_conditions")
def a9(spark, sf):
    df = table(spark, sf, "selected_generation_conditions")
    return df.select("cluster", tables.json_rows(df, "cluster", "cluster_size").alias("json"))


@query("a11_manifest", "SELECT ord, octet_length(encode(header)) AS bytes, sha256(header) AS sha256 FROM antibacterial_fasta WHERE header IS NOT NULL")
def a11(spark, sf):
    return records(spark, sf).where("header is not null").select("ord", F.octet_length("header").alias("bytes"), F.sha2("header", 256).alias("sha256"))


@query("a12_cache_key", f"SELECT ord, substr(sha256('esm' || 'mean' || {residues('seq')} || '|' || {residues('seq')}), 1, 16) AS key FROM scored_candidates WHERE seq IS NOT NULL")
def a12(spark, sf):
    r = X.residues(F.col("seq"))
    return scored(spark, sf).where("seq is not null").select("ord", tables.cache_key("esm", "mean", F.array(r, r)).alias("key"))


# ---- C: equi joins


@query("c1_ref_semi", f"WITH {CAND}, {REF} SELECT ord FROM cand WHERE s IN (SELECT s FROM ref)")
def c1_semi(spark, sf):
    cand, ref = split_candidates(spark, sf)
    return cand.join(ref, "seq", "left_semi").select("ord")


@query("c1_ref_anti", f"WITH {CAND}, {REF} SELECT ord FROM cand WHERE s IS NULL OR s NOT IN (SELECT s FROM ref)")
def c1_anti(spark, sf):
    cand, ref = split_candidates(spark, sf)
    return cand.join(ref, "seq", "left_anti").select("ord")


@query("c2_overlap", f"WITH {CAND}, {REF} SELECT count(*) AS n FROM (SELECT s FROM cand INTERSECT SELECT s FROM ref)")
def c2(spark, sf):
    cand, ref = split_candidates(spark, sf)
    return cand.select("seq").intersect(ref).agg(F.count("*").alias("n"))


OUTER = "SELECT coalesce(a.cluster, b.cluster) AS cluster, a.n AS n_a, b.n AS n_b, round(a.m, 6) AS mean_a, round(b.m, 6) AS mean_b FROM a FULL OUTER JOIN b ON a.cluster = b.cluster"


@query("c5_cohort_outer_join", f"WITH a AS (SELECT cluster, count(*) AS n, avg(score) AS m FROM scored_candidates WHERE batch_no <= 6 AND cluster IS NOT NULL GROUP BY 1), b AS (SELECT cluster, count(*) AS n, avg(score) AS m FROM scored_candidates WHERE batch_no > 6 AND cluster IS NOT NULL GROUP BY 1) {OUTER}")
def c5(spark, sf):
    per = lambda where, s: scored(spark, sf).where(where).where("cluster is not null").groupBy("cluster").agg(F.count("*").alias(f"n_{s}"), F.round(F.avg("score"), 6).alias(f"mean_{s}"))
    return per("batch_no <= 6", "a").join(per("batch_no > 6", "b"), "cluster", "full_outer")


@query("c6_map_lookup", "SELECT m.ord, f.charge FROM mic_observations m LEFT JOIN (SELECT record_id, arg_min(charge, ord) AS charge FROM (SELECT * FROM antibacterial_fasta WHERE charge IS NOT NULL) GROUP BY 1) f ON m.record_id = f.record_id")
def c6(spark, sf):
    known = records(spark, sf).where("charge is not null").groupBy("record_id").agg(F.min_by("charge", "ord").alias("charge"))
    return observations(spark, sf).join(known, "record_id", "left").select("ord", "charge")


@query("c7_strain_semi", "SELECT ord FROM mic_observations WHERE bacterium IN (SELECT bacterium FROM mic_observations GROUP BY 1 HAVING count(*) >= 50)")
def c7(spark, sf):
    valid = observations(spark, sf).where("bacterium is not null").groupBy("bacterium").agg(F.count("*").alias("n")).where("n >= 50")
    return observations(spark, sf).join(valid, "bacterium", "left_semi").select("ord")


@query("c12_subset_check", f"WITH {CAND}, {REF} SELECT count(*) AS n_missing FROM (SELECT DISTINCT s FROM cand WHERE s IS NOT NULL) WHERE s NOT IN (SELECT s FROM ref)")
def c12(spark, sf):
    cand, ref = split_candidates(spark, sf)
    return cand.where("seq is not null").select("seq").distinct().join(ref, "seq", "left_anti").agg(F.count("*").alias("n_missing"))


# ---- D: aggregates

ORGANISM = "array_to_string(list_transform(regexp_extract_all(regexp_replace(trim(bacterium), '\\s+', ' ', 'g'), '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"
def sql_phi(z: str) -> str:
    """The normal distribution function by formula 7.1.26 of Abramowitz and Stegun. Fixed values."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + 0.3275911::DOUBLE * {x}))"
    tail = f"(0.5 * {t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))) * exp(-{x} * {x}))"
    return f"CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END"


NAME = f"CASE WHEN bacterium IS NULL THEN 'unknown' WHEN len(string_split(regexp_replace(trim(bacterium), '\\s+', ' ', 'g'), ' ')) <= 2 THEN {ORGANISM} ELSE regexp_replace(trim(bacterium), '\\s+', ' ', 'g') END"
MICS = f"""mic AS (SELECT upper(sequence) AS sequence, {NAME} AS bacterium, TRY_CAST(nullif(regexp_extract(value, '(\\d+(\\.\\d+)?)', 1), '') AS DOUBLE) AS mic
 FROM mic_observations WHERE sequence IS NOT NULL AND bacterium IS NOT NULL AND value IS NOT NULL),
 good AS (SELECT sequence, bacterium, -log10(mic + 1e-6) AS pmic FROM mic WHERE mic IS NOT NULL AND regexp_full_match(sequence, '[{AA}]+') AND length(sequence) BETWEEN 8 AND 100),
 agg AS (SELECT sequence, bacterium, avg(pmic) AS pmic FROM good GROUP BY 1, 2),
 kept AS (SELECT * FROM agg WHERE bacterium IN (SELECT bacterium FROM agg GROUP BY 1 HAVING count(*) >= 5))"""


def pmic(spark, sf):
    """Mean pMIC by sequence and organism."""
    df = observations(spark, sf).where("sequence is not null and bacterium is not null and value is not null")
    df = df.select(F.upper("sequence").alias("sequence"), X.organism(F.col("bacterium")).alias("bacterium"), X.number_in(F.col("value")).alias("mic"))
    df = df.where(X.is_peptide(F.col("sequence"), 8, 100) & F.col("mic").isNotNull())
    return df.groupBy("sequence", "bacterium").agg(F.avg(-F.log10(F.col("mic") + 1e-6)).alias("pmic"))


def training_rows(spark, sf, least: int = 5):
    """Mean pMIC, organisms with enough rows, relevance 0..100."""
    agg = cut(pmic(spark, sf))  # its texts are parsed once
    strains = agg.groupBy("bacterium").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("bacterium")
    kept = agg.join(strains, "bacterium")
    ends = kept.agg(F.min("pmic").alias("lo"), F.max("pmic").alias("hi"))  # one row
    scaled = F.coalesce(F.try_divide(F.col("pmic") - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), F.lit(0.0)) * 100
    return ranks.attach(kept, ends).select("sequence", "bacterium", "pmic", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(100.0)).cast("int").alias("relevance"))


@query("d1_pmic_mean", f"WITH {MICS} SELECT sequence, bacterium, round(pmic, 6) AS pmic FROM agg")
def d1(spark, sf):
    return pmic(spark, sf).withColumn("pmic", F.round("pmic", 6))


@query("d2_strain_counts", f"WITH {MICS} SELECT bacterium, count(*) AS n FROM agg GROUP BY 1 HAVING count(*) >= 5")
def d2(spark, sf):
    return pmic(spark, sf).groupBy("bacterium").agg(F.count("*").alias("n")).where("n >= 5")


@query("d3_relevance", f"WITH {MICS}, e AS (SELECT min(pmic) AS lo, max(pmic) AS hi FROM kept) SELECT sequence, bacterium, trunc(least(greatest((pmic - lo) / (hi - lo) * 100, 0), 100))::INT AS relevance FROM kept, e")
def d3(spark, sf):
    return training_rows(spark, sf).select("sequence", "bacterium", "relevance")


@query("d4_length_hist", f"SELECT split, length({residues('sequence')}) AS length, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS fraction FROM conditioned_peptides WHERE split IS NOT NULL AND sequence IS NOT NULL GROUP BY 1, 2")
def d4(spark, sf):
    df = table(spark, sf, "conditioned_peptides").where("split is not null and sequence is not null")
    n = df.groupBy("split", F.length(X.residues(F.col("sequence"))).alias("length")).agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(W.partitionBy("split")), 6))


@query("d5_tag_counts", "SELECT field, x AS tag, count(*) AS n FROM (SELECT 'dbs' AS field, unnest(string_split(dbs, '|')) AS x FROM antibacterial_fasta UNION ALL SELECT 'activity', unnest(string_split(activity, '|')) FROM antibacterial_fasta) GROUP BY 1, 2")
def d5(spark, sf):
    """Tags between bars; p2 splits by every sign."""
    both = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("dbs", "activity"))))
    return records(spark, sf).select(both.alias("b")).select("b.field", F.explode(F.split("b.v", "[|]")).alias("tag")).groupBy("field", "tag").agg(F.count("*").alias("n"))


@query("d6_aa_composition", f"WITH a AS (SELECT unnest(string_split({residues('sequence')}, '')) AS aa FROM antibacterial_fasta), c AS (SELECT aa, count(*) AS n FROM a WHERE aa <> '' GROUP BY 1), r AS (SELECT unnest(string_split('{AA}', '')) AS aa) SELECT r.aa, coalesce(n, 0) AS n, round(100 * coalesce(n, 0) / (SELECT sum(n) FROM c), 6) AS percent FROM r LEFT JOIN c ON r.aa = c.aa")
def d6(spark, sf):
    """Counts fold inside each row before anything is shuffled: one number a residue and task."""
    r = X.residues(F.col("sequence"))
    per = lambda a: F.coalesce(F.sum((F.length(r) - F.length(F.replace(r, F.lit(a), F.lit("")))).cast("long")), F.lit(0))
    one = records(spark, sf).agg(*(per(a).alias(a) for a in AA), F.coalesce(F.sum(F.length(r)), F.lit(0)).alias("total"))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("aa"), F.col(a).alias("n")) for a in AA)))
    return one.select(rows.alias("r"), "total").select("r.aa", "r.n", F.round(F.try_divide(F.col("r.n") * 100, F.col("total")), 6).alias("percent"))


DESCRIPTORS = ["charge_ph7_4", "hydrophobicity_interfacescale_ph8"]
LONG = "long AS (SELECT target, descriptor, value FROM (SELECT target, charge_ph7_4, hydrophobicity_interfacescale_ph8 FROM controllability_sequences) UNPIVOT (value FOR descriptor IN (charge_ph7_4, hydrophobicity_interfacescale_ph8)) WHERE NOT isnan(value) AND target IS NOT NULL)"


def long(spark, sf):
    return stats.long_form(controlled(spark, sf).where("target is not null"), DESCRIPTORS, "target")


QUANTS = ", ".join(f"round(quantile_cont(value, {p}), 6) AS q{int(p * 100):02d}" for p in stats.PERCENTS)


@query("d8_distribution_summary", f"WITH {LONG} SELECT target, descriptor, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, {QUANTS} FROM long GROUP BY 1, 2")
def d8(spark, sf):
    return stats.distribution_summary(long(spark, sf), "target", "descriptor")


@query(
    "d9_histogram50",
    f"""WITH {LONG}, e AS (SELECT descriptor, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM long GROUP BY 1),
 b AS (SELECT l.descriptor, l.target, least(floor((value - lo) / ((hi - lo) / 50)), 49)::INT AS bin, (hi - lo) / 50 AS w FROM long l JOIN e ON l.descriptor = e.descriptor WHERE value BETWEEN lo AND hi)
 SELECT descriptor, target, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY descriptor, target) * any_value(w)), 6) AS density FROM b GROUP BY 1, 2, 3""",
)
def d9(spark, sf):
    return stats.histogram(long(spark, sf), "target")


R = residues("sequence")


@query(
    "d10_gen_summary",
    f"""WITH a AS (SELECT ord, {R} AS s, length({R}) BETWEEN 8 AND 50 AND regexp_full_match({R}, '[{AA}]+') AS ok FROM controllability_sequences WHERE sequence IS NOT NULL),
 t AS (SELECT DISTINCT {R} AS s FROM conditioned_peptides WHERE split = 'train' AND sequence IS NOT NULL)
 SELECT count(*) AS n, round(100 * avg(ok::INT), 6) AS valid_pct, min(length(s)) AS min_length, max(length(s)) AS max_length, round(avg(length(s)), 6) AS mean_length, count(DISTINCT s) AS n_unique,
 count(*) FILTER (s IN (SELECT s FROM t)) AS train_copies, count(DISTINCT s) FILTER (s IN (SELECT s FROM t)) AS distinct_train_copies, array_to_string(list_sort(list(DISTINCT s))[1:10], ' ') AS samples FROM a""",
)
def d10(spark, sf):
    """The first samples come from a top-10, so no list of all sequences is built."""
    r = X.residues(F.col("sequence"))
    a = controlled(spark, sf).where("sequence is not null").select(r.alias("s"), X.is_peptide(r).alias("ok"))
    train = table(spark, sf, "conditioned_peptides").where("split = 'train' and sequence is not null").select(r.alias("s")).distinct().withColumn("copy", F.lit(1))
    a = a.join(train, "s", "left")
    one = a.agg(F.count("*").alias("n"), F.round(100 * F.avg(F.col("ok").cast("int")), 6).alias("valid_pct"), F.min(F.length("s")).alias("min_length"), F.max(F.length("s")).alias("max_length"), F.round(F.avg(F.length("s")), 6).alias("mean_length"), F.count_distinct("s").alias("n_unique"), F.count("copy").alias("train_copies"), F.count_distinct(F.when(F.col("copy") == 1, F.col("s"))).alias("distinct_train_copies"))
    top = a.select("s").distinct().orderBy("s").limit(10).agg(F.array_join(F.array_sort(F.collect_list("s")), " ").alias("samples"))
    return ranks.attach(one, top)


@query(
    "d11_target_summary",
    """WITH g AS (SELECT * FROM controllability_sequences WHERE charge_ph7_4 IS NOT NULL AND NOT isnan(charge_ph7_4) AND hydrophobicity_interfacescale_ph8 IS NOT NULL AND NOT isnan(hydrophobicity_interfacescale_ph8) AND target IS NOT NULL),
 x AS (SELECT target, string_agg(sequence, ' ' ORDER BY ord) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ord) AS rn FROM g WHERE sequence IS NOT NULL) WHERE rn <= 8 GROUP BY 1)
 SELECT g.target, count(*) AS n, round(avg(charge_ph7_4), 6) AS mean_q, round(avg(hydrophobicity_interfacescale_ph8), 6) AS mean_h, round(avg(charge_ph7_4) - avg(target_charge), 6) AS delta_q, round(avg(hydrophobicity_interfacescale_ph8) - avg(target_hydrophobicity), 6) AS delta_h,
 round(avg(length(sequence)), 6) AS mean_length, any_value(x.examples) AS examples FROM g LEFT JOIN x ON g.target = x.target GROUP BY 1""",
)
def d11(spark, sf):
    q, h = DESCRIPTORS
    g = controlled(spark, sf).where(f"target is not null and {q} is not null and not isnan({q}) and {h} is not null and not isnan({h})")
    per = g.groupBy("target").agg(F.count("*").alias("n"), F.round(F.avg(q), 6).alias("mean_q"), F.round(F.avg(h), 6).alias("mean_h"), F.round(F.avg(q) - F.avg("target_charge"), 6).alias("delta_q"), F.round(F.avg(h) - F.avg("target_hydrophobicity"), 6).alias("delta_h"), F.round(F.avg(F.length("sequence")), 6).alias("mean_length"))
    first = g.where("sequence is not null").withColumn("rn", F.row_number().over(W.partitionBy("target").orderBy("ord"))).where("rn <= 8")
    examples = first.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "sequence"))), lambda s: s["sequence"]), " ").alias("examples"))
    return per.join(examples, "target", "left")


GOOD = "charge_ph7_4 IS NOT NULL AND NOT isnan(charge_ph7_4) AND hydrophobicity_interfacescale_ph8 IS NOT NULL AND NOT isnan(hydrophobicity_interfacescale_ph8)"


@query("d12_pearson", f"SELECT round(corr(target_charge, charge_ph7_4), 6) AS r_q, round(corr(target_hydrophobicity, hydrophobicity_interfacescale_ph8), 6) AS r_h FROM controllability_sequences WHERE {GOOD} AND target_charge IS NOT NULL AND target_hydrophobicity IS NOT NULL")
def d12(spark, sf):
    g = controlled(spark, sf).where(f"{GOOD} and target_charge is not null and target_hydrophobicity is not null")
    return g.agg(F.round(stats.pearson("target_charge", DESCRIPTORS[0]), 6).alias("r_q"), F.round(stats.pearson("target_hydrophobicity", DESCRIPTORS[1]), 6).alias("r_h"))


@query("d13_monotone_check", f"SELECT avg(charge_ph7_4) FILTER (target LIKE 'highQ%') > avg(charge_ph7_4) FILTER (target LIKE 'lowQ%') AS q_rises, avg(hydrophobicity_interfacescale_ph8) FILTER (target LIKE '%midH') > avg(hydrophobicity_interfacescale_ph8) FILTER (target LIKE '%lowH') AS h_rises FROM controllability_sequences WHERE {GOOD}")
def d13(spark, sf):
    q, h = DESCRIPTORS
    mean = lambda c, like: F.avg(F.when(F.col("target").like(like), F.col(c)))
    return controlled(spark, sf).where(GOOD).agg((mean(q, "highQ%") > mean(q, "lowQ%")).alias("q_rises"), (mean(h, "%midH") > mean(h, "%lowH")).alias("h_rises"))


@query("d14_normalizer_fit", f"WITH {LONG} SELECT descriptor, round(avg(value), 6) AS mean, round(greatest(stddev_samp(value), 1e-6), 6) AS std, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM long GROUP BY 1")
def d14(spark, sf):
    return stats.normalizer(long(spark, sf))


@query("d15_match_report", f"WITH a AS (SELECT ord, {residues('seq')} AS s FROM scored_candidates WHERE seq IS NOT NULL), b AS (SELECT ord, {residues('sequence')} AS s FROM controllability_sequences WHERE sequence IS NOT NULL), j AS (SELECT count(*) AS n, count(*) FILTER (a.s = b.s) AS n_equal FROM a JOIN b ON a.ord = b.ord), i AS (SELECT count(*) AS k FROM (SELECT s FROM a INTERSECT SELECT s FROM b)), u AS (SELECT count(*) AS k FROM (SELECT s FROM a UNION SELECT s FROM b)) SELECT n, n_equal, round(n_equal / greatest(n, 1), 6) AS share_equal, round(i.k / greatest(u.k, 1), 6) AS jaccard, n = n_equal AS identical FROM j, i, u")
def d15(spark, sf):
    a = scored(spark, sf).where("seq is not null").select("ord", X.residues(F.col("seq")).alias("s"))
    b = controlled(spark, sf).where("sequence is not null").select("ord", X.residues(F.col("sequence")).alias("t"))
    j = a.join(b, "ord").agg(F.count("*").alias("n"), F.count_if(F.col("s") == F.col("t")).alias("n_equal"))
    both = a.select("s", F.lit(1).alias("w")).unionAll(b.select("t", F.lit(2))).groupBy("s").agg(F.bit_or("w").alias("w"))
    u = both.agg(F.count_if(F.col("w") == 3).alias("i"), F.count("*").alias("u"))
    one = F.greatest(F.col("n"), F.lit(1))
    return ranks.attach(j, u).select("n", "n_equal", F.round(F.col("n_equal") / one, 6).alias("share_equal"), F.round(F.col("i") / F.greatest(F.col("u"), F.lit(1)), 6).alias("jaccard"), (F.col("n") == F.col("n_equal")).alias("identical"))


@query("d16_cluster_mode", "SELECT batch_no, m AS cluster FROM (SELECT batch_no, cluster AS m, row_number() OVER (PARTITION BY batch_no ORDER BY count(*) DESC, cluster) AS rn FROM scored_candidates WHERE cluster IS NOT NULL GROUP BY 1, 2) WHERE rn = 1")
def d16(spark, sf):
    return scored(spark, sf).groupBy("batch_no").agg(F.mode("cluster", True).alias("cluster"))


@query("d17_ensemble_stats", "SELECT ord, round((score + mic / 100 + hc50 / 1000) / 3, 6) AS mean, round(sqrt((score * score + (mic / 100) ** 2 + (hc50 / 1000) ** 2) / 3 - ((score + mic / 100 + hc50 / 1000) / 3) ** 2), 6) AS std FROM scored_candidates WHERE score IS NOT NULL AND mic IS NOT NULL AND hc50 IS NOT NULL AND NOT isnan(hc50) AND NOT isnan(mic)")
def d17(spark, sf):
    """Mean and population deviation over a row's models."""
    df = scored(spark, sf).where("score is not null and mic is not null and hc50 is not null and not isnan(hc50) and not isnan(mic)").select("ord", F.array(F.col("score"), F.col("mic") / 100, F.col("hc50") / 1000).alias("m"))
    mean = F.aggregate("m", F.lit(0.0), lambda s, x: s + x) / F.size("m")
    df = df.withColumn("mean", mean)
    var = F.aggregate("m", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("m")
    return df.select("ord", F.round("mean", 6).alias("mean"), F.round(F.sqrt(var), 6).alias("std"))


@query("d18_nunique", f"SELECT count(DISTINCT bacterium) AS n_bacteria, count(DISTINCT record_id) AS n_records, count(DISTINCT {residues('sequence')}) AS n_sequences FROM mic_observations")
def d18(spark, sf):
    return observations(spark, sf).agg(F.count_distinct("bacterium").alias("n_bacteria"), F.count_distinct("record_id").alias("n_records"), F.count_distinct(X.residues(F.col("sequence"))).alias("n_sequences"))


PCT = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("d19_describe_pct", "SELECT count(*) AS n, round(avg(mic), 6) AS mean, round(stddev_samp(mic), 6) AS std, min(mic) AS min, max(mic) AS max, " + ", ".join(f"round(quantile_cont(mic, {p}), 6) AS p{int(p * 100):02d}" for p in PCT) + " FROM scored_candidates WHERE mic IS NOT NULL AND NOT isnan(mic)")
def d19(spark, sf):
    good = scored(spark, sf).where("mic is not null and not isnan(mic)")
    one = good.agg(F.count("*").alias("n"), F.round(F.avg("mic"), 6).alias("mean"), F.round(F.stddev_samp("mic"), 6).alias("std"), F.min("mic").alias("min"), F.max("mic").alias("max"))
    q = stats.quantiles(good, [], PCT, "mic")  # one row each
    return ranks.attach(one, q).select("n", "mean", "std", "min", "max", *(F.round(F.col("q")[i], 6).alias(f"p{int(p * 100):02d}") for i, p in enumerate(PCT)))


@query("d20_threshold_fractions", "SELECT t AS threshold, round(avg((charge_ph7_4 > t)::INT), 6) AS fraction FROM controllability_sequences, (SELECT unnest([1, 2, 3, 5]) AS t) WHERE charge_ph7_4 IS NOT NULL AND NOT isnan(charge_ph7_4) GROUP BY 1")
def d20(spark, sf):
    one = controlled(spark, sf).where("charge_ph7_4 is not null and not isnan(charge_ph7_4)").agg(*(F.round(F.avg((F.col("charge_ph7_4") > t).cast("int")), 6).alias(f"t{t}") for t in (1, 2, 3, 5)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("fraction")) for t in (1, 2, 3, 5)))).alias("r")).select("r.*")


@query("d21_length_parity", "WITH a AS (SELECT length(sequence) AS length, count(*) AS n FROM conditioned_peptides WHERE split = 'train' AND sequence IS NOT NULL GROUP BY 1), b AS (SELECT length(sequence) AS length, count(*) AS n FROM conditioned_peptides WHERE split = 'val' AND sequence IS NOT NULL GROUP BY 1) SELECT coalesce(a.length, b.length) AS length, coalesce(a.n, 0) - coalesce(b.n, 0) AS difference FROM a FULL JOIN b ON a.length = b.length")
def d21(spark, sf):
    df = table(spark, sf, "conditioned_peptides").where("sequence is not null and split in ('train', 'val')")
    n = lambda s: F.count_if(F.col("split") == s)
    return df.groupBy(F.length("sequence").alias("length")).agg((n("train") - n("val")).alias("difference"))


# ---- E, F: ranks and cuts

OK = "score IS NOT NULL AND NOT isnan(score) AND hc50 IS NOT NULL AND NOT isnan(hc50) AND hc50 > 0"
RANKS = f"g AS (SELECT ord, id, {residues('seq')} AS s, score, ln(hc50) AS lh FROM scored_candidates WHERE {OK}), k AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS ra, rank() OVER (ORDER BY lh) + (count(*) OVER (PARTITION BY lh) - 1) / 2 AS rb, count(*) OVER () AS n FROM g), f AS (SELECT ord, id, s, ra / n + rb / n AS c FROM k)"


@query("e1_avg_rank", f"WITH {RANKS} SELECT ord, ra AS score_rank FROM k")
def e1(spark, sf):
    return ranks.average_ranks(scored(spark, sf).where(OK), "ord", "score", "score_rank")


def combined(spark, sf):
    df = scored(spark, sf).where(OK)
    return df.join(ranks.fused(df, "ord", "score", "hc50"), "ord").withColumn("s", X.residues(F.col("seq")))


@query("e2_combined_score", f"WITH {RANKS} SELECT ord, round(c, 6) AS combined_score FROM f")
def e2(spark, sf):
    return combined(spark, sf).select("ord", F.round("combined_score", 6).alias("combined_score"))


@query("e4_output_rank", f"WITH {RANKS} SELECT ord, r AS rank, 'amp' || r AS name FROM (SELECT ord, row_number() OVER (ORDER BY round(c, 9) DESC, s, ord) AS r FROM f)")
def e4(spark, sf):
    r = ranks.positions(combined(spark, sf), [F.desc(F.round("combined_score", 9)), F.col("s").asc_nulls_last(), F.col("ord")])
    return r.select("ord", "rank", F.concat(F.lit("amp"), F.col("rank").cast("string")).alias("name"))


NDCG = """WITH g AS (SELECT batch_no, ord, score, floor(100 / (1 + mic)) AS y FROM scored_candidates WHERE score IS NOT NULL AND NOT isnan(score) AND mic IS NOT NULL AND NOT isnan(mic) AND mic >= 0),
 a AS (SELECT *, row_number() OVER (PARTITION BY batch_no ORDER BY score DESC, ord) AS r, row_number() OVER (PARTITION BY batch_no ORDER BY y DESC, ord) AS i FROM g)
 SELECT batch_no, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 1 WHEN sum(y / log2(i + 1)) FILTER (i <= 10) <= 0 THEN 0 ELSE sum(y / log2(r + 1)) FILTER (r <= 10) / sum(y / log2(i + 1)) FILTER (i <= 10) END, 6) AS ndcg FROM a GROUP BY 1"""


@query("e6_ndcg_at_k", NDCG)
def e6(spark, sf):
    g = scored(spark, sf).where("score is not null and not isnan(score) and mic is not null and not isnan(mic) and mic >= 0").withColumn("y", F.floor(100 / (1 + F.col("mic"))))
    return ranks.ndcg(g, "batch_no", "score", "y", "ord").withColumn("ndcg", F.round("ndcg", 6))


@query("e7_ecdf", "SELECT value, sum(n) OVER (ORDER BY value)::BIGINT AS at_most FROM (SELECT score AS value, count(*) AS n FROM scored_candidates WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1)")
def e7(spark, sf):
    n = scored(spark, sf).where("score is not null and not isnan(score)").groupBy(F.col("score").alias("value")).agg(F.count("*").alias("n"))
    return ranks.running(n, ["value"], {"before": "n"}).select("value", (F.col("before") + F.col("n")).alias("at_most"))


@query("f1_rank_sort", f"WITH {RANKS} SELECT ord, id, s FROM f ORDER BY round(c, 9) DESC, s, ord LIMIT 500")
def f1(spark, sf):
    return combined(spark, sf).orderBy(F.desc(F.round("combined_score", 9)), F.col("s").asc_nulls_last(), "ord").limit(500).select("ord", "id", "s")


@query("f2_library_cut", f"WITH {RANKS}, l AS (SELECT *, row_number() OVER (ORDER BY round(c, 9) DESC, s, ord) AS r FROM f) SELECT r AS rank, ord, r <= 50 AS shortlist FROM l WHERE r <= 300")
def f2(spark, sf):
    """The library of 300 and in it the shortlist of 50; fails where the library falls short."""
    top = ranks.positions(combined(spark, sf), [F.desc(F.round("combined_score", 9)), F.col("s").asc_nulls_last(), F.col("ord")], most=300)
    n = top.agg(F.count("*").alias("n"))
    enough = screen.require(n, F.col("n") >= 300, "fewer rows than the library's size")
    return ranks.attach(top, enough).select("rank", "ord", (F.col("rank") <= 50).alias("shortlist"))


@query("f5_abs_effect_sort", f"WITH {LONG}, m AS (SELECT descriptor, target, avg(value) AS m FROM long GROUP BY 1, 2), e AS (SELECT descriptor, max(m) - min(m) AS spread FROM m GROUP BY 1) SELECT descriptor, round(spread, 6) AS spread, row_number() OVER (ORDER BY abs(spread) DESC, descriptor) AS place FROM e")
def f5(spark, sf):
    m = long(spark, sf).groupBy("descriptor", "target").agg(F.avg("value").alias("m")).groupBy("descriptor").agg((F.max("m") - F.min("m")).alias("spread"))
    return ranks.positions(m, [F.desc(F.abs("spread")), F.col("descriptor")], "place", most=1000).select("descriptor", F.round("spread", 6).alias("spread"), "place")


@query("f6_length_sort", f"SELECT s, row_number() OVER (ORDER BY length(s) DESC, s) AS place FROM (SELECT DISTINCT {residues('seq')} AS s FROM scored_candidates WHERE seq IS NOT NULL)")
def f6(spark, sf):
    s = scored(spark, sf).where("seq is not null").select(X.residues(F.col("seq")).alias("s")).distinct()
    return ranks.positions(s, [F.desc(F.length("s")), F.col("s")], "place")


@query("f7_hash_order", f"SELECT s, md5('42:' || s) AS score FROM (SELECT DISTINCT {residues('seq')} AS s FROM scored_candidates WHERE seq IS NOT NULL) ORDER BY 2 LIMIT 100")
def f7(spark, sf):
    """A stand-in score: a seeded hash of the sequence, the 100 smallest."""
    s = scored(spark, sf).where("seq is not null").select(X.residues(F.col("seq")).alias("s")).distinct()
    return s.withColumn("score", F.md5(F.concat(F.lit("42:"), F.col("s")))).orderBy("score").limit(100)


# ---- G: sets


@query("g1_intersect", f"SELECT s FROM (SELECT {residues('seq')} AS s FROM scored_candidates WHERE batch_no <= 12 AND seq IS NOT NULL INTERSECT SELECT {residues('seq')} FROM scored_candidates WHERE batch_no > 12 AND seq IS NOT NULL)")
def g1(spark, sf):
    s = scored(spark, sf).where("seq is not null").select("batch_no", X.residues(F.col("seq")).alias("s"))
    return s.where("batch_no <= 12").select("s").intersect(s.where("batch_no > 12").select("s"))


@query("g2_union", f"SELECT count(*) AS n_rows, count(DISTINCT s) AS n_distinct FROM (SELECT {residues('seq')} AS s FROM scored_candidates UNION ALL SELECT {residues('sequence')} FROM controllability_sequences)")
def g2(spark, sf):
    s = scored(spark, sf).select(X.residues(F.col("seq")).alias("s")).unionByName(controlled(spark, sf).select(X.residues(F.col("sequence")).alias("s")))
    return s.agg(F.count("*").alias("n_rows"), F.count_distinct("s").alias("n_distinct"))


@query("g3_except", f"SELECT s FROM (SELECT {residues('seq')} AS s FROM scored_candidates WHERE seq IS NOT NULL EXCEPT ALL SELECT {residues('seq')} FROM scored_candidates WHERE seq IS NOT NULL AND batch_no <= 20)")
def g3(spark, sf):
    s = scored(spark, sf).where("seq is not null").select("batch_no", X.residues(F.col("seq")).alias("s"))
    return s.select("s").exceptAll(s.where("batch_no <= 20").select("s"))


@query("g4_common_lengths", f"WITH a AS (SELECT length({residues('seq')}) AS length, count(*) AS a FROM scored_candidates WHERE seq IS NOT NULL GROUP BY 1), b AS (SELECT length({residues('sequence')}) AS length, count(*) AS b FROM controllability_sequences WHERE sequence IS NOT NULL GROUP BY 1) SELECT a.length, a, b FROM a JOIN b ON a.length = b.length")
def g4(spark, sf):
    n = lambda df, c, name: df.where(f"{c} is not null").groupBy(F.length(X.residues(F.col(c))).alias("length")).agg(F.count("*").alias(name))
    return n(scored(spark, sf), "seq", "a").join(n(controlled(spark, sf), "sequence", "b"), "length")


# ---- H: scalar functions


@query("h1_string_basics", f"SELECT ord, length({tidy('seq')}) AS n, length({tidy('seq')}) - length(replace({tidy('seq')}, 'K', '')) AS n_k, substr({tidy('seq')}, 1, 3) AS head, reverse({tidy('seq')}) AS back, replace({tidy('seq')}, 'KK', '.') AS replaced FROM scored_candidates")
def h1(spark, sf):
    s = X.tidy(F.col("seq"))
    return scored(spark, sf).select("ord", F.length(s).alias("n"), (F.length(s) - F.length(F.replace(s, F.lit("K"), F.lit("")))).alias("n_k"), F.substring(s, 1, 3).alias("head"), F.reverse(s).alias("back"), F.replace(s, F.lit("KK"), F.lit(".")).alias("replaced"))


@query("h2_header_parse", "SELECT ord, nullif(regexp_extract_all(header, '\\scharge=(\\S*)', 1)[-1], '') AS charge, nullif(regexp_extract_all(header, '\\sdisulfide=(\\S*)', 1)[-1], '') AS disulfide FROM antibacterial_fasta")
def h2(spark, sf):
    df = records(spark, sf).select("ord", X.header_fields(F.col("header")).alias("m"))
    get = lambda k: F.nullif(F.try_element_at("m", F.lit(k)), F.lit(""))
    return df.select("ord", get("charge").alias("charge"), get("disulfide").alias("disulfide"))


@query("h3_clean_mic", "SELECT ord, TRY_CAST(nullif(regexp_extract(value, '(\\d+(\\.\\d+)?)', 1), '') AS DOUBLE) AS mic FROM mic_observations")
def h3(spark, sf):
    return observations(spark, sf).select("ord", X.number_in(F.col("value")).alias("mic"))


@query("h4_normalize_bacterium", f"SELECT ord, {NAME} AS bacterium FROM mic_observations")
def h4(spark, sf):
    return observations(spark, sf).select("ord", X.organism(F.col("bacterium")).alias("bacterium"))


@query("h5_pmic", "SELECT ord, round(-log10(TRY_CAST(nullif(regexp_extract(value, '(\\d+(\\.\\d+)?)', 1), '') AS DOUBLE) + 1e-6), 6) AS pmic FROM mic_observations")
def h5(spark, sf):
    return observations(spark, sf).select("ord", F.round(-F.log10(X.number_in(F.col("value")) + 1e-6), 6).alias("pmic"))


@query("h6_math", "SELECT ord, round(exp(-mic / 100), 6) AS e, round(sqrt(mic), 6) AS r, round(cos(radians(mic)), 6) AS c, floor(mic)::BIGINT AS f, ceil(mic)::BIGINT AS k, round(least(greatest(mic, 1), 10), 6) AS clipped FROM scored_candidates WHERE mic > 0 AND NOT isnan(mic)")
def h6(spark, sf):
    m = F.col("mic")
    return scored(spark, sf).where("mic > 0 and not isnan(mic)").select("ord", F.round(F.exp(-m / 100), 6).alias("e"), F.round(F.sqrt(m), 6).alias("r"), F.round(F.cos(F.radians(m)), 6).alias("c"), F.floor(m).alias("f"), F.ceil(m).alias("k"), F.round(F.least(F.greatest(m, F.lit(1.0)), F.lit(10.0)), 6).alias("clipped"))


@query("h7_normal_cdf", f"SELECT ord, round({sql_phi('(score - 0.5) * 4')}, 6) AS phi FROM scored_candidates WHERE score IS NOT NULL AND NOT isnan(score)")
def h7(spark, sf):
    """Phi of the standardised scores; tested against the error function."""
    return scored(spark, sf).where("score is not null and not isnan(score)").select("ord", F.round(stats.normal_cdf((F.col("score") - 0.5) * 4), 6).alias("phi"))


@query("h8_round_half_even", "SELECT ord, round_even(cast(length(seq) AS DOUBLE) / 2, 0)::BIGINT AS half, round_even(length(seq) * 0.125, 2) AS eighth FROM scored_candidates WHERE seq IS NOT NULL")
def h8(spark, sf):
    n = F.length("seq")
    return scored(spark, sf).where("seq is not null").select("ord", F.rint(n / 2).cast("long").alias("half"), F.bround(n * F.lit(0.125), 2).alias("eighth"))


@query("h9_arrays", f"SELECT ord, array_to_string(list_sort(list_distinct(string_split({tidy('seq')}, ''))), '') AS letters, array_to_string(list_filter(string_split({tidy('seq')}, ''), lambda x: x = 'K' OR x = 'R'), '') AS basic FROM scored_candidates WHERE length({tidy('seq')}) > 0")
def h9(spark, sf):
    s = F.filter(F.split(X.tidy(F.col("seq")), ""), lambda x: x != "")
    return scored(spark, sf).where(F.length(X.tidy(F.col("seq"))) > 0).select("ord", F.array_join(F.array_sort(F.array_distinct(s)), "").alias("letters"), F.array_join(F.filter(s, lambda x: x.isin("K", "R")), "").alias("basic"))


@query("h10_map_default", f"SELECT ord, coalesce(CASE substr({residues('seq')}, 1, 1) WHEN 'K' THEN -3.9 WHEN 'R' THEN -4.5 WHEN 'I' THEN 4.5 END, 0)::DOUBLE AS v FROM scored_candidates WHERE seq IS NOT NULL")
def h10(spark, sf):
    m = F.create_map(*(F.lit(x) for kv in (("K", -3.9), ("R", -4.5), ("I", 4.5)) for x in kv))
    return scored(spark, sf).where("seq is not null").select("ord", F.coalesce(F.try_element_at(m, F.substring(X.residues(F.col("seq")), 1, 1)), F.lit(0.0)).alias("v"))


@query("h11_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, '{\"event_id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS json FROM events")
def h11(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.to_json(F.struct("event_id", F.col("event_type").alias("type"))).alias("json"))


@query("h12_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL")
def h12(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("h14_format", "SELECT ord, printf('%.6f', score) AS six, printf('%.4f', 100 * score) || '%' AS percent FROM scored_candidates WHERE score IS NOT NULL AND NOT isnan(score)")
def h14(spark, sf):
    s = F.col("score")
    return scored(spark, sf).where("score is not null and not isnan(score)").select("ord", F.format_string("%.6f", s).alias("six"), F.concat(F.format_string("%.4f", s * 100), F.lit("%")).alias("percent"))


@query("h15_default_columns", "SELECT ord, score, 0.5::DOUBLE AS p_safe, true AS in_domain FROM scored_candidates")
def h15(spark, sf):
    """Absent columns are added with their defaults, present ones stay."""
    df = scored(spark, sf).select("ord", "score")
    defaults = {"score": F.lit(0.0), "p_safe": F.lit(0.5), "in_domain": F.lit(True)}
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})
