"""Queries of descriptors, samples, similarity, statistics and models (C3-C10, I, J, K, L, M)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resiq.functions import descriptors as D
from resiq.functions import scales as S
from resiq.functions import text as X
from resiq.operators import models, ranks, sampling, similarity, stats, vectors
from resiq.operators.blocks import nearest
from resiq.plans.q_relational import DESCRIPTORS, LONG, controlled, long, scored, sql_phi, training_rows
from resiq.plans.q_screen import split_candidates
from resiq.plans.registry import AA, CAND, REF, query, residues
from resiq.session import cut, table

R = residues("sequence")
SEQS = f"q AS (SELECT ord, {R} AS s FROM controllability_sequences WHERE sequence IS NOT NULL AND length({R}) > 0)"


#: Added before rounding where means often end in a five at the seventh decimal.
NUDGE = 1e-9


def sequences(spark, sf):
    return controlled(spark, sf).select("ord", X.residues(F.col("sequence")).alias("s")).where("length(s) > 0")


def sql_map(scale: dict[str, float]) -> str:
    return "MAP {" + ", ".join(f"'{k}': {float(v)}::DOUBLE" for k, v in scale.items()) + "}"


def sql_sum(scale: dict[str, float], s: str = "s") -> str:
    return f"list_sum(list_transform(string_split({s}, ''), lambda x: coalesce({sql_map(scale)}[x], 0.0::DOUBLE)))"


def sql_charge(ph: float, pka) -> str:
    ends, of = D.charge_terms(ph, pka)
    return f"({ends}::DOUBLE + {sql_sum(of)})"


def sql_share(letters: str) -> str:
    return f"(length(regexp_replace(s, '[^{letters}]', '', 'g'))::DOUBLE / length(s))"


def sql_moment(angle: float) -> str:
    v = f"coalesce({sql_map(S.EISENBERG)}[substr(s, i + 1, 1)], 0.0::DOUBLE)"
    part = lambda f: f"list_sum(list_transform(range(length(s)), lambda i: {v} * {f}(i * radians({angle}))))"
    return f"(sqrt({part('cos')} ** 2 + {part('sin')} ** 2) / length(s))"


# ---- I: descriptors


@query("i1_charge_lehninger", f"WITH {SEQS} SELECT ord, round({sql_charge(7.4, S.LEHNINGER)}, 6) AS charge FROM q")
def i1(spark, sf):
    return sequences(spark, sf).select("ord", F.round(D.net_charge(F.col("s"), 7.4, S.LEHNINGER), 6).alias("charge"))


@query("i2_hydrophobicity", f"WITH {SEQS} SELECT ord, round({sql_sum(S.INTERFACE)} / length(s) + {NUDGE}, 6) AS interface, round({sql_sum(S.KYTE_DOOLITTLE)} / length(s) + {NUDGE}, 6) AS kyte_doolittle, round({sql_sum(S.EISENBERG)} / length(s) + {NUDGE}, 6) AS eisenberg FROM q")
def i2(spark, sf):
    s = F.col("s")
    return sequences(spark, sf).select("ord", F.round(D.mean_scale(s, S.INTERFACE) + NUDGE, 6).alias("interface"), F.round(D.mean_scale(s, S.KYTE_DOOLITTLE) + NUDGE, 6).alias("kyte_doolittle"), F.round(D.mean_scale(s, S.EISENBERG) + NUDGE, 6).alias("eisenberg"))


WINDOWED = f"""w AS (SELECT ord, s, least(11, length(s)) AS w, list_transform(string_split(s, ''), lambda x: coalesce({sql_map(S.EISENBERG)}[x], 0.0::DOUBLE)) AS v FROM q)
 SELECT ord, round(list_max(list_transform(range(length(s) - w + 1), lambda k: sqrt(list_sum(list_transform(range(w), lambda i: v[k + i + 1] * cos(i * radians(100)))) ** 2 + list_sum(list_transform(range(w), lambda i: v[k + i + 1] * sin(i * radians(100)))) ** 2) / w)), 6) AS moment FROM w"""


@query("i4_window_moment", f"WITH {SEQS}, {WINDOWED}")
def i4(spark, sf):
    return sequences(spark, sf).select("ord", F.round(D.window_moment(F.col("s")), 6).alias("moment"))


@query("i6_training_features", f"WITH {SEQS} SELECT ord, length(s) AS length, round({sql_sum(S.MASS)} + {S.WATER}, 4) AS mw, round({sql_sum(S.KYTE_DOOLITTLE)} / length(s) + {NUDGE}, 6) AS gravy, round({sql_share('FWY')}, 6) AS aromaticity FROM q")
def i6(spark, sf):
    s = F.col("s")
    return sequences(spark, sf).select("ord", F.length(s).alias("length"), F.round(D.mass(s), 4).alias("mw"), F.round(D.mean_scale(s, S.KYTE_DOOLITTLE) + NUDGE, 6).alias("gravy"), F.round(D.share(s, "FWY"), 6).alias("aromaticity"))


@query("i7_mean_scales", f"WITH {SEQS} SELECT ord, " + ", ".join(f"round({sql_sum(v)} / length(s) + {NUDGE}, 6) AS {k}" for k, v in (("ww", S.INTERFACE_CHARGED), ("hopp_woods", S.HOPP_WOODS), ("janin", S.JANIN), ("helix", S.HELIX), ("boman", S.BOMAN))) + " FROM q")
def i7(spark, sf):
    own = {"ww": S.INTERFACE_CHARGED, "hopp_woods": S.HOPP_WOODS, "janin": S.JANIN, "helix": S.HELIX, "boman": S.BOMAN}
    return sequences(spark, sf).select("ord", *(F.round(D.mean_scale(F.col("s"), v) + NUDGE, 6).alias(k) for k, v in own.items()))


@query("i8_moments", f"WITH {SEQS} SELECT ord, round({sql_moment(100)} + {NUDGE}, 6) AS helix, round({sql_moment(180)} + {NUDGE}, 6) AS beta FROM q")
def i8(spark, sf):
    return sequences(spark, sf).select("ord", F.round(D.moment(F.col("s"), 100.0) + NUDGE, 6).alias("helix"), F.round(D.moment(F.col("s"), 180.0) + NUDGE, 6).alias("beta"))


@query("i9_net_charge", f"WITH {SEQS} SELECT ord, round({sql_charge(7.4, S.SAFETY)}, 6) AS ph74, round({sql_charge(5.0, S.SAFETY)}, 6) AS ph5 FROM q")
def i9(spark, sf):
    return sequences(spark, sf).select("ord", F.round(D.net_charge(F.col("s")), 6).alias("ph74"), F.round(D.net_charge(F.col("s"), 5.0), 6).alias("ph5"))


def sql_pi(pka=S.SAFETY) -> str:
    plus, minus, n_end, c_end = pka
    n = {a: f"(length(s) - length(replace(s, '{a}', '')))" for a in [*plus, *minus]}
    counts = ", ".join(f"{v}::DOUBLE AS n{a}" for a, v in n.items())
    m = "(lo + hi) * 0.5"
    pos = lambda k: f"1 / (1 + power(10.0::DOUBLE, {m} - {k}))"
    neg = lambda k: f"1 / (1 + power(10.0::DOUBLE, {k} - {m}))"
    charge = f"{pos(n_end)} - {neg(c_end)}" + "".join(f" + n{a} * {pos(k)}" for a, k in plus.items()) + "".join(f" - n{a} * {neg(k)}" for a, k in minus.items())
    ns = ", ".join(f"n{a}" for a in n)
    return f"""WITH RECURSIVE {SEQS}, c AS (SELECT ord, {counts} FROM q),
 r AS (SELECT 0 AS i, ord, {ns}, 0.0::DOUBLE AS lo, 14.0::DOUBLE AS hi, NULL::DOUBLE AS found FROM c
  UNION ALL SELECT i + 1, ord, {ns}, CASE WHEN abs(e) < 1e-4 OR e <= 0 THEN lo ELSE {m} END, CASE WHEN abs(e) < 1e-4 OR e > 0 THEN hi ELSE {m} END, CASE WHEN abs(e) < 1e-4 THEN {m} END
  FROM (SELECT *, {charge} AS e FROM r WHERE i < 60 AND found IS NULL))
 SELECT ord, round(coalesce(max(found), max_by({m}, i)), 4) AS pi FROM r GROUP BY ord"""


@query("i10_isoelectric_point", sql_pi())
def i10(spark, sf):
    return sequences(spark, sf).select("ord", F.round(D.isoelectric_point(F.col("s")), 4).alias("pi"))


@query("i11_molecular_weight", f"WITH {SEQS} SELECT ord, round({sql_sum(S.MASS)} + {S.WATER}, 4) AS mw FROM q")
def i11(spark, sf):
    return sequences(spark, sf).select("ord", F.round(D.mass(F.col("s")), 4).alias("mw"))


@query("i12_aliphatic_index", f"WITH {SEQS} SELECT ord, round({sql_share('A')} * 100 + 2.9 * 100 * {sql_share('V')} + 3.9 * 100 * {sql_share('IL')}, 6) AS aliphatic FROM q")
def i12(spark, sf):
    return sequences(spark, sf).select("ord", F.round(D.aliphatic_index(F.col("s")), 6).alias("aliphatic"))


UNSTABLE = "[" + ", ".join(f"'{d}'" for d in S.UNSTABLE) + "]"


@query("i13_instability", f"WITH {SEQS} SELECT ord, CASE WHEN length(s) < 2 THEN 0.0 ELSE round(100.0::DOUBLE * len(list_filter(range(1, length(s)), lambda i: list_contains({UNSTABLE}, substr(s, i, 2)))) / (length(s) - 1), 6) END AS instability FROM q")
def i13(spark, sf):
    return sequences(spark, sf).select("ord", F.round(D.unstable_share(F.col("s")), 6).alias("instability"))


@query("i14_solubility_proxy", f"WITH {SEQS} SELECT ord, round(0.5 * abs({sql_charge(7.4, S.SAFETY)}) - 1.2 * {sql_sum(S.EISENBERG)} / length(s) - 0.8 * {sql_share('FWY')}, 6) AS solubility FROM q")
def i14(spark, sf):
    return sequences(spark, sf).select("ord", F.round(D.solubility_proxy(F.col("s")), 6).alias("solubility"))


@query("i15_dipeptides", f"WITH {SEQS}, p AS (SELECT ord, length(s) - 1 AS n, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS dipeptide FROM q WHERE length(s) > 1) SELECT ord, dipeptide, round(count(*) / any_value(n), 6) AS share FROM p GROUP BY 1, 2")
def i15(spark, sf):
    return sequences(spark, sf).where("length(s) > 1").select("ord", F.explode(D.dipeptides(F.col("s"))).alias("dipeptide", "share")).withColumn("share", F.round("share", 6))


@query("i15_terminal", f"WITH {SEQS} SELECT ord, substr(s, 1, 1) AS n1, CASE WHEN length(s) >= 2 THEN substr(s, 2, 1) END AS n2, CASE WHEN length(s) >= 2 THEN substr(s, length(s), 1) END AS c1, CASE WHEN length(s) >= 3 THEN substr(s, length(s) - 1, 1) END AS c2 FROM q")
def i15_terminal(spark, sf):
    t = sequences(spark, sf).select("ord", D.terminal(F.col("s")).alias("m"))
    return t.select("ord", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("n1", "n2", "c1", "c2")))


def sql_summary() -> str:
    mean = lambda scale: f"{sql_sum(scale)} / length(s)"
    charge, arom, eis = sql_charge(7.4, S.SAFETY), sql_share("FWY"), mean(S.EISENBERG)
    unstable = f"CASE WHEN length(s) < 2 THEN 0.0 ELSE 100.0::DOUBLE * len(list_filter(range(1, length(s)), lambda i: list_contains({UNSTABLE}, substr(s, i, 2)))) / (length(s) - 1) END"
    cols = {
        "length": "length(s)::DOUBLE", "mw": f"{sql_sum(S.MASS)} + {S.WATER}", "charge_ph7_4": charge, "charge_ph5": sql_charge(5.0, S.SAFETY), "charge_density": f"{charge} / length(s)",
        "hydrophobicity_kd": mean(S.KYTE_DOOLITTLE), "hydrophobicity_eisenberg": eis, "hydrophobicity_ww": mean(S.INTERFACE_CHARGED), "hydrophobicity_hoppwoods": mean(S.HOPP_WOODS), "hydrophobicity_janin": mean(S.JANIN),
        "hydrophobic_moment_helix": sql_moment(100), "hydrophobic_moment_beta": sql_moment(180), "aromatic_frac": arom, "trp_frac": sql_share("W"), "phe_frac": sql_share("F"), "tyr_frac": sql_share("Y"),
        "lys_arg_frac": sql_share("KR"), "acidic_frac": sql_share("DE"), "hydrophobic_frac": sql_share("AILMFVW"), "aliphatic_index": f"100 * {sql_share('A')} + 2.9 * 100 * {sql_share('V')} + 3.9 * 100 * {sql_share('IL')}",
        "boman_index": mean(S.BOMAN), "instability_index": unstable, "helical_propensity": mean(S.HELIX), "aggregation_propensity": f"{eis} + 0.5 * {arom} - 0.3 * abs({charge})", "amphipathicity": sql_moment(100),
        **{f"cleavage_{k}".lower(): sql_share(v) for k, v in S.CUTS.items()}, "oxidation_sensitive": sql_share("MCW"), "deamidation_prone": sql_share("NQ"), "camsol_like": f"0.5 * abs({charge}) - 1.2 * {eis} - 0.8 * {arom}",
    }
    return f"WITH {SEQS} SELECT q.ord, p.pi, " + ", ".join(f"round({v} + {NUDGE}, 5) AS {k}" for k, v in cols.items()) + f" FROM q JOIN ({sql_pi()}) p ON q.ord = p.ord"


@query("i16_summary", sql_summary())
def i16(spark, sf):
    """The 33 summary descriptors in one pass."""
    own = D.describe(sequences(spark, sf), "s")
    return own.select("ord", F.round("pi", 4).alias("pi"), *(F.round(F.col(c) + NUDGE, 5).alias(c) for c in own.columns if c not in ("ord", "s", "pi")))


@query("i17_unique_then_expand", f"SELECT ord, round({sql_charge(7.4, S.SAFETY).replace('(s,', '(s,')}, 6) AS charge FROM (SELECT ord, {residues('seq')} AS s FROM scored_candidates WHERE length({residues('seq')}) > 0)")
def i17(spark, sf):
    """A descriptor of each different sequence, computed once and joined back."""
    rows = scored(spark, sf).select("ord", X.residues(F.col("seq")).alias("s")).where("length(s) > 0")
    own = rows.select("s").distinct().withColumn("charge", F.round(D.net_charge(F.col("s")), 6))
    return rows.join(own, "s").select("ord", "charge")


# ---- J: samples and splits


def by_split(spark, sf):
    return table(spark, sf, "conditioned_peptides").select("ord", "split", "source", X.residues(F.col("sequence")).alias("s")).where("length(s) > 0").withColumn("length", F.length("s"))


MASKS = "list_transform(range(1, 27), lambda c: coalesce(list_sum(list_transform(list_filter(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i, 1)) = 64 + c), lambda i: 1::BIGINT << (i - 1))), 0)::BIGINT)"
#: LCS of text b against masks m and length n of another of at most 62 letters.
LCS = "(n - bit_count(list_reduce(list_prepend((1::BIGINT << n) - 1, list_transform(string_split(b, ''), lambda c: m[ascii(c) - 64])), lambda v, k: ((v + (v & k)) | (v & xor(k, (1::BIGINT << n) - 1))) & ((1::BIGINT << n) - 1))))"


def sql_draw(key: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || {key})"


@query("j1_unmatched_sample", f"SELECT ord FROM conditioned_peptides WHERE length({R}) > 0 ORDER BY {sql_draw('ord')}, ord LIMIT 200")
def j1(spark, sf):
    return sampling.sample(by_split(spark, sf), "ord", 200).select("ord")


PARTS = f"p AS (SELECT ord, split, length({R}) AS length FROM conditioned_peptides WHERE length({R}) > 0), a AS (SELECT length, count(*) AS n FROM p WHERE split = 'train' GROUP BY 1), b AS (SELECT length, count(*) AS n FROM p WHERE split = 'test' GROUP BY 1)"


def sql_first(rows: str, want: str, by: str = "length", key: str = "ord") -> str:
    """The first rows of each group by the draw, as many as `want` (by, n) says."""
    return f"SELECT r.* EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {sql_draw(key)}, {key}) AS rn FROM ({rows})) r JOIN ({want}) w ON r.{by} = w.{by} WHERE rn <= w.n"


@query("j2_length_matched", f"WITH {PARTS} SELECT ord, length FROM ({sql_first('FROM p', 'FROM b')})")
def j2(spark, sf):
    """As many rows of each length as the test split has, from all rows."""
    rows = by_split(spark, sf)
    return sampling.length_matched(rows, rows.where("split = 'test'")).select("ord", "length")


BOTH = "SELECT a.length, least(a.n, b.n) AS n FROM a JOIN b ON a.length = b.length"
TRAIN_ROWS, TEST_ROWS = ("SELECT * FROM p WHERE split = '" + x + "'" for x in ("train", "test"))


@query("j3_length_matched_pairs", f"WITH {PARTS} SELECT ord, split FROM ({sql_first(TRAIN_ROWS, BOTH)}) UNION ALL SELECT ord, split FROM ({sql_first(TEST_ROWS, BOTH)})")
def j3(spark, sf):
    rows = by_split(spark, sf)
    one, two = sampling.length_matched_pairs(rows.where("split = 'train'"), rows.where("split = 'test'"))
    return one.select("ord", "split").unionAll(two.select("ord", "split"))


HELD = "SELECT length, least(CASE WHEN count(*) >= 10 THEN greatest(round_even(count(*) * 0.1, 0), 1) ELSE round_even(count(*) * 0.1, 0) END, count(*) - 1)::BIGINT AS n FROM p GROUP BY 1"


@query("j4_stratified_split", f"WITH {PARTS}, v AS ({sql_first('FROM p', HELD)}) SELECT p.ord, CASE WHEN v.ord IS NULL THEN 'train' ELSE 'val' END AS split FROM p LEFT JOIN v ON p.ord = v.ord")
def j4(spark, sf):
    return sampling.stratified_split(by_split(spark, sf).drop("split"), "ord", "length").select("ord", "split")


@query("j5_stored_split", "SELECT split, count(*) AS n FROM conditioned_peptides GROUP BY 1")
def j5(spark, sf):
    """A split that is stored is read, not drawn."""
    return table(spark, sf, "conditioned_peptides").groupBy("split").agg(F.count("*").alias("n"))


PLACE = "('0x' || substr(md5('{}:' || i), 1, 12))::BIGINT % (SELECT count(*) FROM p) + 1"
RANDOM_PAIRS = f"""WITH p AS (SELECT ord, s, row_number() OVER (ORDER BY {sql_draw('ord')}, ord) AS place FROM (SELECT ord, {R} AS s FROM conditioned_peptides WHERE length({R}) > 0)),
 d AS (SELECT i, {PLACE.format(42)} AS x, {PLACE.format(43)} AS y FROM range(2 * 500 + 16) t(i)),
 k AS (SELECT least(a.ord, b.ord) AS a, greatest(a.ord, b.ord) AS b, min(i) AS i FROM d JOIN p a ON a.place = x JOIN p b ON b.place = y WHERE x <> y GROUP BY 1, 2 ORDER BY i LIMIT 500),
 t AS (SELECT CASE WHEN length(a.s) <= length(b.s) THEN a.s ELSE b.s END AS s, CASE WHEN length(a.s) <= length(b.s) THEN b.s ELSE a.s END AS b FROM k JOIN p a ON a.ord = k.a JOIN p b ON b.ord = k.b),
 l AS (SELECT b, {MASKS.format(s='s')} AS m, length(s)::INT AS n FROM t), r AS (SELECT 2.0::DOUBLE * {LCS} / (length(b) + n) AS r FROM l)
 SELECT count(*) AS n, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(avg((r > 0.6)::INT), 6) AS above_60, round(avg((r > 0.8)::INT), 6) AS above_80 FROM r"""


@query("j6_unique_pairs", RANDOM_PAIRS)
def j6(spark, sf):
    """Similarity over 500 random pairs: mean, median, share above 0.6 and 0.8."""
    rows = by_split(spark, sf)
    pairs = sampling.pair_sample(rows, "ord", 500)
    s = rows.select("ord", "s")
    both = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").select(similarity.indel_ratio(F.col("sa"), F.col("sb")).alias("r"))
    return both.agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.percentile("r", F.lit(0.5)), 6).alias("median"), F.round(F.avg((F.col("r") > 0.6).cast("int")), 6).alias("above_60"), F.round(F.avg((F.col("r") > 0.8).cast("int")), 6).alias("above_80"))


FOLDS = """WITH RECURSIVE s AS (SELECT cluster, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, cluster) AS i FROM scored_candidates WHERE cluster IS NOT NULL GROUP BY 1),
 r AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS load, NULL::VARCHAR AS cluster, NULL::BIGINT AS n, NULL::INT AS fold
  UNION ALL SELECT s.i, list_transform(range(1, 6), lambda k: load[k] + CASE WHEN k = list_position(load, list_min(load)) THEN s.n ELSE 0 END), s.cluster, s.n, (list_position(load, list_min(load)) - 1)::INT FROM r JOIN s ON s.i = r.i + 1)
 SELECT fold, sum(n)::BIGINT AS n_rows, count(*) AS n_groups FROM r WHERE fold IS NOT NULL GROUP BY 1"""


@query("j7_group_kfold", FOLDS)
def j7(spark, sf):
    rows = scored(spark, sf).where("cluster is not null")
    return rows.join(sampling.group_folds(rows, "cluster"), "cluster").groupBy("fold").agg(F.count("*").alias("n_rows"), F.count_distinct("cluster").alias("n_groups"))


@query("j8_locked_split", f"WITH g AS (SELECT DISTINCT record_id FROM mic_observations WHERE record_id IS NOT NULL), o AS (SELECT record_id, row_number() OVER (ORDER BY {sql_draw('record_id')}, record_id) AS rn FROM g) SELECT record_id, CASE WHEN rn <= (SELECT greatest(1, round_even(0.18 * count(*), 0)) FROM g) THEN 'test' ELSE 'train' END AS split FROM o")
def j8(spark, sf):
    rows = table(spark, sf, "mic_observations").where("record_id is not null")
    return sampling.locked_split(rows, "record_id")


@query("j9_row_sample", f"SELECT ord FROM scored_candidates ORDER BY {sql_draw('ord', 7)}, ord LIMIT 100")
def j9(spark, sf):
    return sampling.sample(scored(spark, sf), "ord", 100, seed=7).select("ord")


# ---- C3-C9, K: similarity

TEXTS = f"t AS (SELECT DISTINCT {R} AS s FROM conditioned_peptides WHERE length({R}) BETWEEN 8 AND 50 AND split = 'val'), u AS (SELECT s, {MASKS.format(s='s')} AS m, length(s)::INT AS n FROM (SELECT DISTINCT {R} AS s FROM conditioned_peptides WHERE length({R}) BETWEEN 8 AND 50 AND split = 'test'))"


def texts(spark, sf, split):
    df = by_split(spark, sf).where(F.col("split") == split).where("length between 8 and 50")
    return df.groupBy("s").agg(F.min("ord").alias("ord"))


@query("k1_indel_ratio", f"WITH {TEXTS}, p AS (SELECT t.s AS b, u.s AS s, u.m AS m, u.n AS n FROM t JOIN u ON length(t.s) = u.n) SELECT b AS one, s AS two, round(2.0::DOUBLE * {LCS} / (length(b) + n), 6) AS ratio FROM p")
def k1(spark, sf):
    """Ratios of all val and test texts of one length."""
    a, b = texts(spark, sf, "val").select(F.col("s").alias("one")), texts(spark, sf, "test").select(F.col("s").alias("two"))
    return similarity.ratios_of_length(a, b)


@query("k2_length_bounds", "SELECT l AS length, greatest(floor(l * 0.8 / (2 - 0.8)) + 1, 1)::INT AS lo, (ceil(l * (2 - 0.8) / 0.8) - 1)::INT AS hi FROM (SELECT DISTINCT length(seq) AS l FROM scored_candidates WHERE length(seq) > 0)")
def k2(spark, sf):
    n = scored(spark, sf).where("length(seq) > 0").select(F.length("seq").alias("length")).distinct()
    lo, hi = X.shared_length_bounds(F.col("length"), 0.8)
    return n.select("length", F.greatest(lo, F.lit(1)).alias("lo"), hi.alias("hi"))


NOVEL = f"""WITH {CAND}, {REF}, c AS (SELECT DISTINCT s AS b FROM cand WHERE length(s) BETWEEN 8 AND 50 AND regexp_full_match(s, '[{AA}]+')),
 r AS (SELECT s, {MASKS.format(s='s')} AS m, length(s)::INT AS n FROM ref), near AS (SELECT DISTINCT b FROM c JOIN r ON n BETWEEN floor(length(b) * 2 / 3) + 1 AND ceil(length(b) * 3 / 2) - 1 WHERE 5 * {LCS} > 2 * (length(b) + n))"""


def clean_candidates(spark, sf):
    cand, ref = split_candidates(spark, sf)
    return cand.where(X.is_peptide(F.col("seq"))), ref.withColumn("ord", F.xxhash64("seq"))


@query("c3_novelty_join", f"{NOVEL} SELECT ord FROM cand WHERE length(s) BETWEEN 8 AND 50 AND regexp_full_match(s, '[{AA}]+') AND s NOT IN (SELECT b FROM near)")
def c3(spark, sf):
    cand, ref = clean_candidates(spark, sf)
    return similarity.novelty(cand, ref).select("ord")


@query("c4_max_similarity")
def c4(spark, sf):
    """Every candidate's largest similarity with the reference, so any top list's too."""
    cand, ref = clean_candidates(spark, sf)
    return similarity.max_similarity(cand, ref).withColumn("max_ratio", F.round("max_ratio", 6))


@query("c8_kmer_join")
def c8(spark, sf):
    """All different texts by 2-mers, short ones with each other."""
    return similarity.kmer_pairs(similarity.distinct_texts(by_split(spark, sf), "s"))


@query("c9_nearest_train")
def c9(spark, sf):
    """Every hundredth row against all training texts; also K9."""
    rows = by_split(spark, sf)
    q = rows.where("ord % 100 = 0").select(F.col("ord").alias("id"), F.col("s").alias("res"))
    best = similarity.nearest_identity(q, rows.where("split = 'train'").select(F.col("ord").alias("id"), F.col("s").alias("res")))
    return best.select("id", F.round("identity", 6).alias("identity"), F.round("coverage", 6).alias("coverage"), "nearest")


@query("c10_vector_nn", "WITH d AS (SELECT q.vec_id AS id, b.vec_id AS nearest, list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS value FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id) SELECT id, round(min(value), 4) AS value FROM d GROUP BY 1")
def c10(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest(e.where("id % 100 = 0"), e).select("id", F.round("value", 4).alias("value"))


@query("k3_internal_diversity")
def k3(spark, sf):
    return similarity.diverse(scored(spark, sf).select("ord", X.residues(F.col("seq")).alias("seq"))).select("ord")


@query("k4_select_diverse")
def k4(spark, sf):
    return similarity.diverse(scored(spark, sf).select("ord", X.residues(F.col("seq")).alias("seq")), target=500).select("ord")


@query("k5_drop_similar")
def k5(spark, sf):
    cand, ref = clean_candidates(spark, sf)
    return similarity.drop_similar(cand, ref).groupBy("state").agg(F.count("*").alias("n"))


@query("k6_greedy_cluster")
def k6(spark, sf):
    return similarity.greedy_clusters(training_rows(spark, sf).select(F.col("sequence").alias("seq")).distinct())


@query("k7_pairwise_identity")
def k7(spark, sf):
    """Identity and coverage of val and test texts that stand at the same place by length and order."""
    at = F.row_number().over(W.partitionBy("n").orderBy("s"))
    a, b = (texts(spark, sf, x).withColumn("n", F.length("s")).withColumn("i", at).select("n", "i", F.col("s").alias(x)) for x in ("val", "test"))
    out = a.join(b, ["n", "i"]).withColumn("k", similarity.pairwise_identity(F.col("val"), F.col("test")))
    return out.select("val", "test", F.round("k.identity", 6).alias("identity"), F.round("k.coverage", 6).alias("coverage"))


@query("k8_single_linkage")
def k8(spark, sf):
    return similarity.single_linkage(by_split(spark, sf), seq="s")


# ---- L: statistics

HL = f"WITH {LONG}, h AS (SELECT descriptor, value, target LIKE 'high%' AS one FROM long WHERE target LIKE 'high%' OR target LIKE 'low%')"


def high_low(spark, sf):
    rows = long(spark, sf).where("target like 'high%' or target like 'low%'")
    return rows.withColumn("side", F.when(F.col("target").like("high%"), "high").otherwise("low"))


COMPARE = f"""{HL}, r AS (SELECT *, rank() OVER (PARTITION BY descriptor ORDER BY value) + (count(*) OVER (PARTITION BY descriptor, value) - 1) / 2 AS rk FROM h),
 s AS (SELECT descriptor, count(*) FILTER (one) AS n1, count(*) FILTER (NOT one) AS n2, sum(rk) FILTER (one) AS rs, avg(value) FILTER (one) AS m1, avg(value) FILTER (NOT one) AS m2, quantile_cont(value, 0.5) FILTER (one) AS d1, quantile_cont(value, 0.5) FILTER (NOT one) AS d2, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM r GROUP BY 1),
 v AS (SELECT descriptor, value, count(*) FILTER (one) AS a, count(*) FILTER (NOT one) AS b FROM h GROUP BY 1, 2),
 f AS (SELECT v.descriptor, value, abs(sum(a) OVER w / n1 - sum(b) OVER w / n2) AS d, lead(value) OVER w - value AS gap FROM v JOIN s ON v.descriptor = s.descriptor WINDOW w AS (PARTITION BY v.descriptor ORDER BY value)),
 k AS (SELECT descriptor, max(d) AS ks, sum(d * gap) AS wd FROM f GROUP BY 1)
 SELECT s.descriptor, n1 AS n_one, n2 AS n_two, round(m1, 6) AS one_mean, round(m2, 6) AS two_mean, round(d1, 6) AS one_median, round(d2, 6) AS two_median, round(rs - n1 * (n1 + 1) / 2, 6) AS mwu_u, round(2 * (rs - n1 * (n1 + 1) / 2) / (n1 * n2) - 1, 6) AS cliffs_delta, round(ks, 6) AS ks, round(wd, 6) AS wasserstein, round(wd / iqr, 6) AS wasserstein_iqr FROM s JOIN k ON s.descriptor = k.descriptor"""


@query("l1_compare_descriptor", COMPARE)
def l1(spark, sf):
    out = stats.compare(high_low(spark, sf), "side", "high", "low")
    return out.select("descriptor", "n_one", "n_two", "one_mean", "two_mean", "one_median", "two_median", "mwu_u", "cliffs_delta", "ks", "wasserstein", "wasserstein_iqr")


P_VALUES = COMPARE.split("\n SELECT s.descriptor")[0] + f""",
 t AS (SELECT descriptor, sum((a + b)::DOUBLE ** 3 - (a + b)) AS ties FROM v GROUP BY 1),
 z AS (SELECT s.descriptor, n1::DOUBLE AS x, n2::DOUBLE AS y, rs - n1 * (n1 + 1) / 2 AS u, ks, ties FROM s JOIN k ON s.descriptor = k.descriptor JOIN t ON s.descriptor = t.descriptor),
 o AS (SELECT descriptor, greatest(abs(u - x * y / 2) - 0.5, 0) / sqrt(x * y / 12 * (x + y + 1 - ties / ((x + y) * (x + y - 1)))) AS zz, sqrt(x * y / (x + y)) * ks AS kk FROM z)
 SELECT descriptor, round(least(1.0, 2 * (1 - {sql_phi('zz')})), 6) AS mwu_p, round(CASE WHEN kk < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 21), lambda i: (-1.0::DOUBLE) ** (i - 1) * 2 * exp(-2.0::DOUBLE * i * i * kk * kk))))) END, 6) AS ks_p FROM o"""


@query("l1_p_values", P_VALUES)
def l1_p(spark, sf):
    return stats.compare(high_low(spark, sf), "side", "high", "low").select("descriptor", "mwu_p", "ks_p")


SP = "g AS (SELECT charge_ph7_4 AS a, hydrophobicity_interfacescale_ph8 AS b FROM controllability_sequences WHERE charge_ph7_4 IS NOT NULL AND NOT isnan(charge_ph7_4) AND hydrophobicity_interfacescale_ph8 IS NOT NULL AND NOT isnan(hydrophobicity_interfacescale_ph8))"


@query("l2_spearman", f"WITH {SP}, r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM g) SELECT 'charge_ph7_4' AS a, 'hydrophobicity_interfacescale_ph8' AS b, round(corr(ra, rb), 6) AS rho FROM r")
def l2(spark, sf):
    return stats.spearman(controlled(spark, sf), "ord", DESCRIPTORS)


#: Places a side of the grid, between the quantiles of all points.
SIDE, EDGES = 200, (0.005, 0.995)


def kde_points(spark, sf):
    q, h = DESCRIPTORS
    return stats.finite_points(controlled(spark, sf).select("target", F.col(q).alias("x"), F.col(h).alias("y")), "x", "y")


def grid(points):
    """SIDE x SIDE places between the 0.5 % and the 99.5 % quantile of either coordinate."""
    (x0, x1), (y0, y1) = (stats.quantiles(points.select(F.col(c).alias("v")), [], EDGES, "v").first()[0] for c in "xy")
    i, j, n = F.floor(F.col("id") / SIDE), F.col("id") % SIDE, SIDE - 1.0
    return points.sparkSession.range(SIDE * SIDE).select("id", (F.lit(x0) + F.lit(x1 - x0) * i / n).alias("x"), (F.lit(y0) + F.lit(y1 - y0) * j / n).alias("y"))


POINTS = """p AS (SELECT target, charge_ph7_4 AS x, hydrophobicity_interfacescale_ph8 AS y FROM controllability_sequences WHERE isfinite(charge_ph7_4) AND isfinite(hydrophobicity_interfacescale_ph8)),
 e AS (SELECT quantile_cont(x, 0.005) AS x0, quantile_cont(x, 0.995) AS x1, quantile_cont(y, 0.005) AS y0, quantile_cont(y, 0.995) AS y1 FROM p),
 grid AS (SELECT i * 200 + j AS id, x0 + (x1 - x0) * i / 199.0::DOUBLE AS x, y0 + (y1 - y0) * j / 199.0::DOUBLE AS y FROM e, range(200) a(i), range(200) b(j))"""


def sql_density(name: str, points: str, factor: str = "1") -> str:
    return f"""c{name} AS (SELECT count(*) AS n, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM {points}), k{name} AS (SELECT *, a * d - b * b AS det, n ** (-1.0 / 3) * {factor} AS sc FROM c{name}),
 {name} AS (SELECT id, sum(exp(-0.5 * (d * (grid.x - o.x) ** 2 - 2 * b * (grid.x - o.x) * (grid.y - o.y) + a * (grid.y - o.y) ** 2) / det / sc)) / any_value(n * 2 * pi() * sqrt(det) * sc) AS density FROM grid, {points} o, k{name} GROUP BY 1)"""


@query("l4_kde2d", f"WITH {POINTS}, {sql_density('r', 'p')} SELECT id, round(density, 6) AS density FROM r")
def l4(spark, sf):
    p = cut(kde_points(spark, sf))
    return vectors.kernel_density(p, grid(p)).select("id", F.round("density", 6).alias("density"))


@query(
    "l5_log_enrichment",
    f"""WITH {POINTS}, u AS (SELECT * FROM p WHERE target LIKE 'high%'), w AS (SELECT * FROM p WHERE target LIKE 'low%'), {sql_density('one', 'u')}, {sql_density('two', 'w')},
 m AS (SELECT one.id, one.density AS a, two.density AS b FROM one JOIN two ON one.id = two.id) SELECT id, round(ln(a + 1e-12::DOUBLE) - ln(b + 1e-12::DOUBLE), 4) AS enrichment, a + b >= (SELECT quantile_cont(a + b, 0.1) FROM m) AS supported FROM m""",
)
def l5(spark, sf):
    """Where high targets are denser than low ones, on places with at least the 10 % quantile of total density."""
    p = cut(kde_points(spark, sf))
    at = cut(grid(p))
    a = vectors.kernel_density(p.where("target like 'high%'"), at).withColumnRenamed("density", "one")
    b = vectors.kernel_density(p.where("target like 'low%'"), at).withColumnRenamed("density", "two")
    both = cut(a.join(b, "id").withColumn("total", F.col("one") + F.col("two")))
    floor = both.agg(F.percentile("total", F.lit(0.1)).alias("floor"))  # one row, from the places of the grid
    return ranks.attach(both, floor).select("id", F.round(vectors.log_enrichment(F.col("one"), F.col("two")), 4).alias("enrichment"), (F.col("total") >= F.col("floor")).alias("supported"))


FACTORS = (0.75, 1.0, 1.5)


@query("l6_bandwidths", f"WITH {POINTS}, " + ", ".join(sql_density(f"r{i}", "p", str(f * f)) for i, f in enumerate(FACTORS)) + " " + " UNION ALL ".join(f"SELECT {f}::DOUBLE AS factor, id, round(density, 6) AS density FROM r{i}" for i, f in enumerate(FACTORS)))
def l6(spark, sf):
    p = cut(kde_points(spark, sf))
    at = cut(grid(p))
    parts = [vectors.kernel_density(p, at, f).select(F.lit(f).alias("factor"), "id", F.round("density", 6).alias("density")) for f in FACTORS]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("l7_kmeans_medoids")
def l7(spark, sf):
    return models.kmeans_medoids(kde_points(spark, sf).withColumn("id", F.monotonically_increasing_id()), ["x", "y"], 5)


@query("l8_family_table", f"WITH {LONG}, m AS (SELECT target, descriptor, avg(value) AS m FROM long GROUP BY 1, 2) SELECT target, round(max(m) FILTER (descriptor = 'charge_ph7_4'), 6) AS charge, round(max(m) FILTER (descriptor <> 'charge_ph7_4'), 6) AS hydrophobicity FROM m GROUP BY 1")
def l8(spark, sf):
    m = long(spark, sf).groupBy("target").pivot("descriptor", DESCRIPTORS).agg(F.avg("value"))
    return m.select("target", F.round(DESCRIPTORS[0], 6).alias("charge"), F.round(DESCRIPTORS[1], 6).alias("hydrophobicity"))


# ---- M: vectors and models


@query("m1_pooling", "SELECT vec_id, round((embedding[1]::DOUBLE + embedding[3]) / 2, 6) AS mean_x, round(greatest(embedding[1], embedding[3])::DOUBLE, 6) AS max_x FROM embeddings")
def m1(spark, sf):
    """Three token vectors cut from an embedding, the second one masked."""
    e = F.col("embedding").cast("array<double>")
    df = table(spark, sf, "embeddings").select("vec_id", F.array(F.slice(e, 1, 2), F.slice(e, 2, 2), F.slice(e, 3, 2)).alias("t"), F.array(F.lit(1), F.lit(0), F.lit(1)).alias("m"))
    return df.select("vec_id", F.round(vectors.pooled(F.col("t"), F.col("m"))[0], 6).alias("mean_x"), F.round(vectors.pooled(F.col("t"), F.col("m"), "max")[0], 6).alias("max_x"))


@query("m2_l2_normalize", "SELECT vec_id, round(embedding[1]::DOUBLE / (sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) + 1e-8), 6) AS first FROM embeddings")
def m2(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.l2_normalized(F.col("embedding").cast("array<double>"))[0], 6).alias("first"))


@query("m3_pca_scaler")
def m3(spark, sf):
    return models.reduced(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "embedding", 8)


@query("m4_ranker_stand_in")
def m4(spark, sf):
    """Regression trees on descriptors, judged by NDCG@10 of each organism over held-out groups."""
    return models.rank_and_judge(training_rows(spark, sf))


P_GT = f"0.5 * least(greatest(coalesce(score, 0.5), 0.0), 1.0) + 0.5 * (1 - {sql_phi('(ln(128.0::DOUBLE) - ln(hc50)) / 0.6::DOUBLE')})"
REPORT = {"hc50_um": "exp(ln(hc50))", "lower_95_um": "exp(ln(hc50) - 1.959963984540054 * 0.6)", "upper_95_um": "exp(ln(hc50) + 1.959963984540054 * 0.6)", "p_gt_128": P_GT, "risk": f"1 - ({P_GT})", "uncertainty": "0.6::DOUBLE"}


@query("m7_hc50_report", "SELECT ord, " + ", ".join(f"round({v}, 4) AS {k}" for k, v in REPORT.items()) + " FROM scored_candidates WHERE hc50 > 0 AND NOT isnan(hc50) AND (score IS NULL OR NOT isnan(score))")
def m7(spark, sf):
    p = F.least(F.greatest(F.coalesce("score", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    df = scored(spark, sf).where("hc50 > 0 and not isnan(hc50) and (score is null or not isnan(score))").select("ord", F.log("hc50").alias("mu"), F.lit(0.6).alias("sigma"), p.alias("p"))
    return vectors.hc50_report(df, "mu", "sigma", "p").select("ord", *(F.round(c, 4).alias(c) for c in REPORT))


@query("m8_conformal_q", "WITH g AS (SELECT abs(charge_ph7_4 - target_charge) AS r FROM controllability_sequences WHERE charge_ph7_4 IS NOT NULL AND NOT isnan(charge_ph7_4) AND target_charge IS NOT NULL), n AS (SELECT least(1.0, ceil((count(*) + 1) * 0.95) / count(*)) AS p FROM g) SELECT round((SELECT list_sort(list(r)) FROM g)[(floor(p * ((SELECT count(*) FROM g) - 1)) + 1)::INT] * (1 - (p * ((SELECT count(*) FROM g) - 1)) % 1) + (SELECT list_sort(list(r)) FROM g)[(ceil(p * ((SELECT count(*) FROM g) - 1)) + 1)::INT] * ((p * ((SELECT count(*) FROM g) - 1)) % 1), 6) AS q FROM n")
def m8(spark, sf):
    df = controlled(spark, sf).where("charge_ph7_4 is not null and not isnan(charge_ph7_4) and target_charge is not null").select((F.col("charge_ph7_4") - F.col("target_charge")).alias("r"))
    return spark.range(1).select(F.round(F.lit(vectors.conformal_q(df, "r")), 6).alias("q"))


@query("m10_calibration")
def m10(spark, sf):
    """Platt and isotonic calibration of the score for a low MIC, on ten equal bins."""
    df = scored(spark, sf).where("score is not null and not isnan(score) and mic is not null and not isnan(mic)").select("ord", F.col("score").alias("p"), (F.col("mic") < 8).cast("double").alias("label"))
    return models.calibrated(df, "p", "label", "isotonic").groupBy(F.floor(F.col("p") * 10).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("calibrated"), 4).alias("mean"))


@query("m11_applicability")
def m11(spark, sf):
    """Vectors with id divisible by 100 against all others; the physical features are the first four dimensions."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"), F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("phys"))
    q = e.where("id % 100 = 0").withColumn("identity", F.lit(0.5))
    return vectors.applicability(q, e.where("id % 100 <> 0")).select("id", F.round("emb_ood", 4).alias("emb_ood"), F.round("phys_ood", 4).alias("phys_ood"), "in_domain", F.round("confidence", 4).alias("confidence"))


@query("m13_half_life", "SELECT ord, round(exp(score), 6) AS hours FROM scored_candidates WHERE score IS NOT NULL AND NOT isnan(score)")
def m13(spark, sf):
    return scored(spark, sf).where("score is not null and not isnan(score)").select("ord", F.round(F.exp("score"), 6).alias("hours"))


@query("m14_deviation", f"WITH q AS (SELECT ord, {R} AS s, charge_ph7_4 AS given FROM controllability_sequences WHERE length({R}) > 0 AND charge_ph7_4 IS NOT NULL AND NOT isnan(charge_ph7_4)) SELECT ord, round({sql_charge(7.4, S.SAFETY)} - given, 5) AS deviation FROM q")
def m14(spark, sf):
    df = controlled(spark, sf).select("ord", X.residues(F.col("sequence")).alias("s"), F.col("charge_ph7_4").alias("given")).where("length(s) > 0 and given is not null and not isnan(given)")
    return df.select("ord", F.round(D.net_charge(F.col("s")) - F.col("given"), 5).alias("deviation"))


@query("m16_votes", "SELECT vec_id, round(len(list_filter(embedding[1:9]::DOUBLE[], lambda x: x > 0)) / 9, 6) AS share FROM embeddings")
def m16(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.votes(F.slice(F.col("embedding").cast("array<double>"), 1, 9), cut=0.0)["share"], 6).alias("share"))


@query("m17_best_label", "SELECT vec_id, ['low', 'mid', 'high'][list_position(embedding[1:3], list_max(embedding[1:3]))] AS label, round(list_max(embedding[1:3])::DOUBLE, 4) AS p FROM embeddings")
def m17(spark, sf):
    best = vectors.best_label(F.slice(F.col("embedding").cast("array<double>"), 1, 3), ["low", "mid", "high"])
    return table(spark, sf, "embeddings").select("vec_id", best.alias("b")).select("vec_id", "b.label", "b.p")


