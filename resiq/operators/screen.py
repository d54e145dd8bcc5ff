"""Validation, rejection reasons and order-dependent deduplication (B, E3, E5).

Order is data: `ord` is unique, and the smallest ord of equal sequences is the first occurrence. First occurrences
come from a min aggregate and an equi-join, not a window, so a sequence that makes up a third of the rows is never
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resiq.functions.text import STANDARD, is_peptide, odd_residues


def with_first(df: DataFrame, key: str, order: str = "ord", where: Column | None = None, name: str = "first") -> DataFrame:
    """df with the smallest `order` among the rows of equal `key` that satisfy `where`. Null keys get null."""
    rows = df if where is None else df.where(where)
    least = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(order).alias(name))
    return df.join(least, F.col(key) == F.col("__key"), "left").drop("__key")


def dedup_first(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Only first occurrences; rows with a null key are dropped."""
    return with_first(df, key, order).where(F.col("first") == F.col(order)).drop("first")


def syntactic_filter(df: DataFrame, reference: DataFrame, seq: str = "seq", lo: int = 8, hi: int = 50) -> DataFrame:
    """Df with `reason`: length, alphabet, duplicate, exact_reference or accept; the first that holds.

    Only accepted sequences make later ones duplicates, so a copy of the reference is always exact_reference. A null
    sequence fails the length. reference: a column `seq`, repeats and nulls allowed."""
    known = reference.select(F.col("seq").alias("__ref")).where("__ref is not null").distinct().withColumn("__known", F.lit(True))
    s = F.col(seq)
    out = df.join(known, s == F.col("__ref"), "left")
    bad = F.when(s.isNull() | ~F.length(s).between(lo, hi), "length").when(~s.rlike(f"^[{STANDARD}]+$"), "alphabet").when(F.col("__known"), "exact_reference")
    out = with_first(out.withColumn("reason", bad).drop("__ref", "__known"), seq, where=F.col("reason").isNull())
    return out.withColumn("reason", F.coalesce("reason", F.when(F.col("first") < F.col("ord"), F.lit("duplicate")), F.lit("accept"))).drop("first")


def syntactic_stats(screened: DataFrame) -> DataFrame:
    """Counts by reason and the attrition rate, 4 decimals; 0 for an empty table."""
    n = {r: F.count_if(F.col("reason") == r).alias(r) for r in ("length", "alphabet", "duplicate", "exact_reference")}
    total, passed = F.count("*"), F.count_if(F.col("reason") == "accept")
    return screened.agg(total.alias("n_input"), *n.values(), passed.alias("n_passed"), F.bround((total - passed) / F.greatest(total, F.lit(1)), 4).alias("attrition_rate"))


def audit(df: DataFrame, header: str = "header", seq: str = "sequence", order: str = "ord", lo: int = 8, hi: int = 50) -> DataFrame:
    """Df with `invalid`, `reasons` (an array) and `duplicate_of` (the first clean record's number, for a record
    whose only fault is that it repeats one)."""
    h, s = F.coalesce(F.trim(header), F.lit("")), F.coalesce(F.col(seq), F.lit(""))
    odd = odd_residues(s)
    found = F.array_compact(
        F.array(
            F.when(h == "", "missing_header"),
            F.when(s == "", "empty_sequence"),
            F.when(odd != "", F.concat(F.lit("invalid_residues:"), odd)),
            F.when((s != "") & ~F.length(s).between(lo, hi), f"length_outside_{lo}_{hi}"),
        )
    )
    out = with_first(df.withColumns({"invalid": odd, "reasons": found}), seq, order, F.size("reasons") == 0)
    again = (F.size("reasons") == 0) & (F.col("first") < F.col(order))
    return out.withColumn("duplicate_of", F.when(again, F.col("first"))).withColumn("reasons", F.when(again, F.array(F.lit("duplicate_sequence"))).otherwise(F.col("reasons"))).drop("first")


def audit_report(audited: DataFrame, seq: str = "sequence") -> DataFrame:
    """One row of counts and length statistics. Duplicates are counted over all non-empty sequences."""
    n = F.when(F.length(seq) > 0, F.length(seq))
    clean = F.size("reasons") == 0
    full = F.count(n)
    return audited.agg(
        F.count("*").alias("n_input"),
        F.count_distinct(F.when(F.length(seq) > 0, F.col(seq))).alias("n_unique"),
        (full - F.count_distinct(F.when(F.length(seq) > 0, F.col(seq)))).alias("n_duplicates"),
        F.count_if(clean).alias("n_clean"),
        F.count_if(~clean).alias("n_rejected"),
        F.min(n).alias("min_length"),
        F.max(n).alias("max_length"),
        F.round(F.avg(n), 6).alias("mean_length"),
        F.round(F.percentile(n, F.lit(0.5)), 6).alias("median_length"),
    )


def reason_counts(audited: DataFrame) -> DataFrame:
    """Records by reason, without what follows a colon."""
    return audited.select(F.explode("reasons").alias("r")).select(F.substring_index("r", ":", 1).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def background_clean(df: DataFrame, reference: DataFrame, seq: str = "seq") -> DataFrame:
    """As the syntactic filter, but a copy of the reference goes before a repeated sequence, and the reasons are
    invalid_length, noncanonical, exact_amp_match, duplicate_sequence, kept."""
    names = {"length": "invalid_length", "alphabet": "noncanonical", "exact_reference": "exact_amp_match", "duplicate": "duplicate_sequence", "accept": "kept"}
    out = syntactic_filter(df, reference, seq)
    return out.withColumn("reason", F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("reason")))


def load_counts(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows, empty, invalid, duplicate and accepted ones of a table of sequences."""
    s = F.col(seq)
    state = F.when(s.isNull() | (s == ""), "empty").when(~is_peptide(s), "invalid")
    out = with_first(df.withColumn("state", state), seq, where=F.col("state").isNull())
    state = F.coalesce("state", F.when(F.col("first") < F.col("ord"), F.lit("duplicate")), F.lit("accepted"))
    return out.select(state.alias("state")).agg(F.count("*").alias("n_rows"), *(F.count_if(F.col("state") == k).alias(f"n_{k}") for k in ("empty", "invalid", "duplicate", "accepted")))


def require(df: DataFrame, good: Column, message: str) -> DataFrame:
    """Df, failing when it runs on the first row for which `good` isn't true."""
    return df.where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def quota_accept(draws: DataFrame, reference: DataFrame, targets: list[tuple[str, int]], seq: str = "seq") -> DataFrame:
    """E5: for each target in turn, its draws by `draw` until its quota is met: df with `reason`.

    The set of sequences seen is shared by the targets. Draws after the one that fills the quota are not considered:
    they come out in no row, make no later draw a duplicate and count nowhere. Each target is one pass of aggregates
    and joins; the place where the quota is met comes from a running count over the draws' ranges."""
    from resiq.session import cut

    out, taken = None, None
    for target, quota in targets:
        own = draws.where(F.col("target") == target).withColumn("ord", F.col("draw"))
        known = reference.select("seq")
        done = syntactic_filter(own, known, seq)
        if taken is not None:
            before = taken.select(F.col(seq).alias("__seen")).distinct()
            done = done.join(before, done[seq] == before["__seen"], "left").withColumn("reason", F.when((F.col("reason") == "accept") & F.col("__seen").isNotNull(), "duplicate").otherwise(F.col("reason"))).drop("__seen")
        done = cut(done)
        last = nth(done.where("reason = 'accept'"), "draw", quota)
        part = done if last is None else done.where(F.col("draw") <= last)
        out = part if out is None else out.unionByName(part)
        got = part.where("reason = 'accept'").select(seq)
        taken = cut(got if taken is None else taken.unionAll(got))
    return out.drop("ord")


def nth(df: DataFrame, order: str, n: int) -> int | None:
    """The n-th smallest value of a column of different integers, or None if there are fewer.

    Found by counting in ever finer ranges, 1024 at a time: counts, not rows, come to the driver."""
    if n <= 0:
        return None
    lo, hi, total = df.agg(F.min(order), F.max(order), F.count(order)).first()
    if total < n:
        return None
    while lo < hi:
        step = -(-(hi - lo + 1) // 1024)
        counts = {r[0]: r[1] for r in df.where(F.col(order).between(lo, hi)).groupBy(F.floor((F.col(order) - lo) / step).cast("long")).count().collect()}
        for k in sorted(counts):
            if n <= counts[k]:
                lo, hi = lo + k * step, min(hi, lo + (k + 1) * step - 1)
                break
            n -= counts[k]
    return lo
