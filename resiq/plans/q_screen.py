"""Queries of sources, predicates and screens (A, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from resiq.functions import text as X
from resiq.operators import screen
from resiq.plans.registry import AA, CAND, REF, VALID, query, tidy
from resiq.session import table


def split_candidates(spark, sf):
    """(candidates with ord and seq, reference with seq): later batches against the first eight."""
    all_rows = table(spark, sf, "scored_candidates").select("ord", "batch_no", X.tidy(F.col("seq")).alias("seq"))
    ref = all_rows.where("batch_no <= 8").select("seq").where(X.is_peptide(F.col("seq"))).distinct()
    return all_rows.where("batch_no > 8").select("ord", "seq"), ref


def candidates(spark, sf):
    return table(spark, sf, "scored_candidates").select("ord", "seq")


def records(spark, sf):
    return table(spark, sf, "antibacterial_fasta")


S = tidy("seq")


@query("b1_valid_peptide", f"SELECT ord, coalesce(length({S}) BETWEEN 8 AND 50 AND regexp_full_match({S}, '[{AA}]+'), false) AS valid FROM scored_candidates")
def b1(spark, sf):
    return candidates(spark, sf).select("ord", F.coalesce(X.is_peptide(X.tidy(F.col("seq"))), F.lit(False)).alias("valid"))


@query("b2_model_alphabet", f"SELECT ord FROM scored_candidates WHERE regexp_full_match({S}, '[{AA}BOUXZ]+')")
def b2(spark, sf):
    return candidates(spark, sf).where(X.is_model_text(X.tidy(F.col("seq")))).select("ord")


SCREENED = f"""screened AS (
  SELECT ord, s, CASE WHEN s IS NULL OR length(s) NOT BETWEEN 8 AND 50 THEN 'length'
    WHEN NOT regexp_full_match(s, '[{AA}]+') THEN 'alphabet'
    WHEN s IN (SELECT s FROM ref) THEN 'exact_reference' END AS bad FROM cand),
 done AS (SELECT ord, s, coalesce(bad, CASE WHEN row_number() OVER (PARTITION BY s, bad ORDER BY ord) > 1 THEN 'duplicate' END, 'accept') AS reason FROM screened)"""


@query("b3_syntactic_filter", f"WITH {CAND}, {REF}, {SCREENED} SELECT ord, reason FROM done")
def b3(spark, sf):
    return screen.syntactic_filter(*split_candidates(spark, sf)).select("ord", "reason")


@query(
    "b4_syntactic_stats",
    f"""WITH {CAND}, {REF}, {SCREENED} SELECT count(*) AS n_input, count(*) FILTER (reason = 'length') AS length, count(*) FILTER (reason = 'alphabet') AS alphabet,
 count(*) FILTER (reason = 'duplicate') AS duplicate, count(*) FILTER (reason = 'exact_reference') AS exact_reference, count(*) FILTER (reason = 'accept') AS n_passed,
 round_even((count(*) - count(*) FILTER (reason = 'accept')) / greatest(count(*), 1), 4) AS attrition_rate FROM done""",
)
def b4(spark, sf):
    return screen.syntactic_stats(screen.syntactic_filter(*split_candidates(spark, sf)))


ODD = f"array_to_string(list_sort(list_distinct(list_filter(string_split(coalesce(sequence, ''), ''), lambda x: x <> '' AND NOT contains('{AA}', x)))), '')"
AUDIT = f"""a AS (SELECT ord, header, sequence, coalesce(sequence, '') AS s, {ODD} AS odd FROM antibacterial_fasta),
 b AS (SELECT *, list_filter([CASE WHEN coalesce(trim(header), '') = '' THEN 'missing_header' END, CASE WHEN s = '' THEN 'empty_sequence' END,
   CASE WHEN odd <> '' THEN 'invalid_residues:' || odd END, CASE WHEN s <> '' AND length(s) NOT BETWEEN 8 AND 50 THEN 'length_outside_8_50' END], lambda x: x IS NOT NULL) AS r FROM a),
 c AS (SELECT *, min(CASE WHEN len(r) = 0 THEN ord END) OVER (PARTITION BY sequence) AS f FROM b),
 d AS (SELECT ord, sequence, s, odd, CASE WHEN len(r) = 0 AND f < ord THEN f END AS duplicate_of, CASE WHEN len(r) = 0 AND f < ord THEN ['duplicate_sequence'] ELSE r END AS r FROM c)"""


def audited(spark, sf):
    return screen.audit(records(spark, sf))


@query("b5_audit_reasons", f"WITH {AUDIT} SELECT ord, array_to_string(r, ';') AS reasons, duplicate_of FROM d")
def b5(spark, sf):
    return audited(spark, sf).select("ord", F.array_join("reasons", ";").alias("reasons"), "duplicate_of")


@query("b6_invalid_residues", f"SELECT ord, {ODD} AS invalid FROM antibacterial_fasta WHERE {ODD} <> ''")
def b6(spark, sf):
    return records(spark, sf).select("ord", X.odd_residues(F.coalesce("sequence", F.lit(""))).alias("invalid")).where("invalid <> ''")


@query(
    "b7_background_clean",
    f"""WITH {CAND}, {REF}, {SCREENED} SELECT CASE reason WHEN 'length' THEN 'invalid_length' WHEN 'alphabet' THEN 'noncanonical' WHEN 'exact_reference' THEN 'exact_amp_match'
 WHEN 'duplicate' THEN 'duplicate_sequence' ELSE 'kept' END AS reason, count(*) AS n FROM done GROUP BY 1""",
)
def b7(spark, sf):
    return screen.background_clean(*split_candidates(spark, sf)).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "b8_load_counts",
    f"""WITH a AS (SELECT ord, {S} AS s FROM scored_candidates), b AS (SELECT *, CASE WHEN coalesce(s, '') = '' THEN 'empty' WHEN NOT ({VALID}) THEN 'invalid' END AS st FROM a),
 c AS (SELECT coalesce(st, CASE WHEN row_number() OVER (PARTITION BY s, st ORDER BY ord) > 1 THEN 'duplicate' ELSE 'accepted' END) AS st FROM b)
 SELECT count(*) AS n_rows, count(*) FILTER (st = 'empty') AS n_empty, count(*) FILTER (st = 'invalid') AS n_invalid, count(*) FILTER (st = 'duplicate') AS n_duplicate, count(*) FILTER (st = 'accepted') AS n_accepted FROM c""",
)
def b8(spark, sf):
    return screen.load_counts(candidates(spark, sf).withColumn("seq", X.tidy(F.col("seq"))))


@query(
    "b9_normalize_sequence",
    f"""WITH a AS (SELECT ord, coalesce({S}, '') AS s FROM scored_candidates), b AS (SELECT *, array_to_string(list_sort(list_distinct(list_filter(string_split(s, ''), lambda x: x <> '' AND NOT contains('{AA}', x)))), '') AS odd FROM a),
 c AS (SELECT *, CASE WHEN s IN ('', 'NAN') THEN 'empty sequence' WHEN odd <> '' THEN 'nonstandard residues: ' || odd END AS err FROM b) SELECT ord, CASE WHEN err IS NULL THEN s END AS seq, err FROM c""",
)
def b9(spark, sf):
    return candidates(spark, sf).select("ord", X.normalized(F.col("seq")).alias("x")).select("ord", "x.seq", "x.err")


@query("b10_clean_sequence", "SELECT ord, translate(upper(seq), 'XBZUO', 'ANQCK') AS seq FROM scored_candidates")
def b10(spark, sf):
    return candidates(spark, sf).select("ord", X.substituted(F.col("seq")).alias("seq"))


MARKED = "CASE batch_no % 3 WHEN 0 THEN '1 ' WHEN 1 THEN '2' ELSE '' END || seq"


@query(
    "b11_decode_direction",
    f"""WITH a AS (SELECT ord, regexp_replace({MARKED}, '\\s', '', 'g') AS t FROM scored_candidates)
 SELECT ord, CASE WHEN t IS NULL THEN NULL WHEN t LIKE '1%' THEN 'N2C' WHEN t LIKE '2%' THEN 'C2N' ELSE 'unknown' END AS direction,
 CASE WHEN t LIKE '1%' THEN substr(t, 2) WHEN t LIKE '2%' THEN reverse(substr(t, 2)) ELSE t END AS seq FROM a""",
)
def b11(spark, sf):
    mark = F.expr("case batch_no % 3 when 0 then '1 ' when 1 then '2' else '' end")
    t = table(spark, sf, "scored_candidates").select("ord", X.directed(F.concat(mark, F.col("seq"))).alias("x"))
    return t.select("ord", "x.direction", "x.seq")


@query("b12_finite_guard", "SELECT count(*) AS n, count(*) FILTER (score IS NOT NULL AND isfinite(score) AND hc50 > 0 AND isfinite(hc50)) AS n_good, count(*) FILTER (NOT coalesce(isfinite(score) AND hc50 > 0 AND isfinite(hc50), false)) AS n_bad FROM scored_candidates")
def b12(spark, sf):
    good = F.coalesce(~F.isnan("score") & (F.abs("score") < float("inf")) & (F.col("hc50") > 0) & ~F.isnan("hc50") & (F.col("hc50") < float("inf")), F.lit(False))
    return table(spark, sf, "scored_candidates").agg(F.count("*").alias("n"), F.count_if(good).alias("n_good"), F.count_if(~good).alias("n_bad"))


@query("b15_drop_columns", "SELECT ord, record_id, value FROM mic_observations")
def b15(spark, sf):
    df = table(spark, sf, "mic_observations")
    return df.drop(*(c for c in df.columns if "bacter" in c.lower() or "sequence" in c.lower() or c.endswith("_at")))


@query("b16_replace_features", "SELECT ord, length(sequence) AS length, 1.0 * length AS old_length FROM controllability_sequences")
def b16(spark, sf):
    """Feature columns that are there already are dropped before they are added anew."""
    df = table(spark, sf, "controllability_sequences").withColumn("old_length", F.col("length").cast("double"))
    return df.drop("length").withColumn("length", F.length("sequence")).select("ord", "length", "old_length")


@query("d7_audit_report", f"""WITH {AUDIT} SELECT count(*) AS n_input, count(DISTINCT nullif(s, '')) AS n_unique, count(nullif(s, '')) - count(DISTINCT nullif(s, '')) AS n_duplicates, count(*) FILTER (len(r) = 0) AS n_clean,
 count(*) FILTER (len(r) > 0) AS n_rejected, min(length(nullif(s, ''))) AS min_length, max(length(nullif(s, ''))) AS max_length, round(avg(length(nullif(s, ''))), 6) AS mean_length, round(quantile_cont(length(nullif(s, '')), 0.5), 6) AS median_length FROM d""")
def d7(spark, sf):
    return screen.audit_report(audited(spark, sf))


@query("d7_reason_counts", f"WITH {AUDIT} SELECT split_part(x, ':', 1) AS reason, count(*) AS n FROM (SELECT unnest(r) AS x FROM d) GROUP BY 1")
def d7_reasons(spark, sf):
    return screen.reason_counts(audited(spark, sf))


@query("e3_dedup_first", f"SELECT ord, s FROM (SELECT ord, {S} AS s, row_number() OVER (PARTITION BY {S} ORDER BY ord) AS rn FROM scored_candidates) WHERE rn = 1 AND s IS NOT NULL")
def e3(spark, sf):
    return screen.dedup_first(candidates(spark, sf).select("ord", X.tidy(F.col("seq")).alias("s")), "s")


#: Targets in turn, with what each must accept.
QUOTAS = [("lowQ_lowH", 200), ("midQ_lowH", 100), ("highQ_lowH", 150), ("lowQ_midH", 100), ("midQ_midH", 300), ("highQ_midH", 250)]


def sql_quotas() -> str:
    parts = [f"""ref AS (SELECT DISTINCT {tidy('sequence')} AS s FROM conditioned_peptides), d AS (SELECT target, ord AS draw, {tidy('sequence')} AS s FROM controllability_sequences),
 v AS (SELECT *, CASE WHEN s IS NULL OR length(s) NOT BETWEEN 8 AND 50 THEN 'length' WHEN NOT regexp_full_match(s, '[{AA}]+') THEN 'alphabet' WHEN s IN (SELECT s FROM ref WHERE s IS NOT NULL) THEN 'exact_reference' END AS bad FROM d)"""]
    for k, (target, quota) in enumerate(QUOTAS):
        seen = "".join(f" OR s IN (SELECT s FROM c{j} WHERE reason = 'accept')" for j in range(k))
        parts.append(f"""a{k} AS (SELECT *, coalesce(bad, CASE WHEN row_number() OVER (PARTITION BY s, bad ORDER BY draw) > 1{seen} THEN 'duplicate' ELSE 'accept' END) AS reason FROM v WHERE target = '{target}'),
 b{k} AS (SELECT *, sum((reason = 'accept')::INT) OVER (ORDER BY draw) AS n FROM a{k}), c{k} AS (SELECT * FROM b{k} WHERE n < {quota} OR (n = {quota} AND reason = 'accept'))""")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT target, draw, reason FROM c{k}" for k in range(len(QUOTAS)))


@query("e5_quota_accept", sql_quotas())
def e5(spark, sf):
    """All targets in turn, up to a quota each."""
    draws = table(spark, sf, "controllability_sequences").select("target", F.col("ord").alias("draw"), X.tidy(F.col("sequence")).alias("seq"))
    ref = table(spark, sf, "conditioned_peptides").select(X.tidy(F.col("sequence")).alias("seq"))
    return screen.quota_accept(draws, ref, QUOTAS).select("target", "draw", "reason")
