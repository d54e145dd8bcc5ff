"""Sequence descriptors as native column expressions.

Most descriptors are linear in the residue counts: a scale is a dot product of counts with literals, and only
moments and dipeptides look at positions. A function of a sequence counts what it needs; `describe` takes the
twenty counts once, as columns, for many descriptors. The isoelectric point is a search over seven counts, which a
vectorised function does an order of magnitude faster than a fold in SQL. A null sequence gives
null, an empty one 0 (mass: that of water), residues outside the alphabet count 0 but stay in the length.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from resiq.functions import scales as S


class Counted:
    """A sequence whose length and residue counts are columns already."""

    def __init__(self, c: Column, size: Column, counts: dict[str, Column]) -> None:
        self.c, self.size, self.counts = c, size, counts


Sequence = Column | Counted


def size(c: Sequence) -> Column:
    return c.size if isinstance(c, Counted) else F.length(c)


def text(c: Sequence) -> Column:
    return c.c if isinstance(c, Counted) else c


def count(c: Sequence, letters: str) -> Column:
    """How often any of the letters stands in the text."""
    if isinstance(c, Counted):
        terms = [c.counts[x] for x in letters]
        return sum(terms[1:], terms[0])
    return F.length(c) - F.length(F.translate(c, letters, ""))


def share(c: Sequence, letters: str) -> Column:
    """The letters' share of the length; 0 for an empty text."""
    return F.when(size(c) == 0, 0.0).otherwise(count(c, letters) / F.greatest(size(c), F.lit(1)))


def linear(c: Sequence, scale: dict[str, float]) -> Column:
    """Sum of a scale over the residues, one term for all residues of the same value."""
    by_value: dict[float, str] = {}
    for letter, v in scale.items():
        if v:
            by_value[v] = by_value.get(v, "") + letter
    terms = [count(c, letters) * F.lit(v) for v, letters in by_value.items()]
    return sum(terms[1:], terms[0])


def mean_scale(c: Sequence, scale: dict[str, float]) -> Column:
    """Mean of a scale over the residues; 0 for an empty text."""
    return F.when(size(c) == 0, 0.0).otherwise(linear(c, scale) / F.greatest(size(c), F.lit(1)))


def charge_terms(ph: float, pka=S.SAFETY) -> tuple[float, dict[str, float]]:
    """Charge of the two ends, and of each residue, at a pH (Henderson-Hasselbalch)."""
    plus, minus, n_end, c_end = pka
    pos = lambda k: 1 / (1 + 10 ** (ph - k))
    neg = lambda k: -1 / (1 + 10 ** (k - ph))
    return pos(n_end) + neg(c_end), {a: pos(k) for a, k in plus.items()} | {a: neg(k) for a, k in minus.items()}


def net_charge(c: Sequence, ph: float = 7.4, pka=S.SAFETY) -> Column:
    """Net charge with both ends; 0 for an empty text."""
    ends, of = charge_terms(ph, pka)
    return F.when(size(c) == 0, 0.0).otherwise(linear(c, of) + F.lit(ends))


def isoelectric_point(c: Sequence, pka=S.SAFETY, lo: float = 0.0, hi: float = 14.0, steps: int = 60, tol: float = 1e-4) -> Column:
    """Bisection to the pH at which the net charge is within `tol` of 0; the middle at once for an empty text."""
    plus, minus, n_end, c_end = pka

    @F.pandas_udf(DoubleType())
    def search(counts: pd.DataFrame) -> pd.Series:
        known = counts["size"].notna().to_numpy()
        n = {a: counts[a].fillna(0).to_numpy(float) for a in [*plus, *minus]}
        some = counts["size"].fillna(0).to_numpy() > 0
        low, high, found = np.full(len(counts), lo), np.full(len(counts), hi), np.full(len(counts), np.nan)
        for _ in range(steps):
            mid = (low + high) * 0.5
            pos = lambda k, mid=mid: 1 / (1 + 10 ** (mid - k))
            neg = lambda k, mid=mid: 1 / (1 + 10 ** (k - mid))
            q = pos(n_end) - neg(c_end) + sum(n[a] * pos(k) for a, k in plus.items()) - sum(n[a] * neg(k) for a, k in minus.items())
            q = np.where(some, q, 0.0)
            found = np.where(np.isnan(found) & (np.abs(q) < tol), mid, found)
            low, high = np.where(q > 0, mid, low), np.where(q > 0, high, mid)
            if not np.isnan(found).any():
                break
        out = np.where(np.isnan(found), (low + high) * 0.5, found)
        return pd.Series(out).where(pd.Series(known))

    return search(F.struct(*(count(c, a).alias(a) for a in [*plus, *minus]), size(c).alias("size")))


def mass(c: Sequence) -> Column:
    """Residue masses and one water."""
    return linear(c, S.MASS) + F.lit(S.WATER)


def aliphatic_index(c: Sequence) -> Column:
    """I12."""
    return share(c, "A") * 100 + 2.9 * (share(c, "V") * 100) + 3.9 * (share(c, "IL") * 100)


def letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def pairs(c: Column) -> Column:
    """The dipeptides of a text, in order; none for fewer than two residues."""
    at = F.when(F.length(c) >= 2, F.sequence(F.lit(1), F.length(c) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(c, i, F.lit(2)))


def unstable_share(c: Sequence) -> Column:
    """100 times the share of unstable dipeptides; 0 for fewer than two residues."""
    unstable = "|".join(S.UNSTABLE)
    # Overlapping hits: a lookahead counts places, not stretches
    hits = F.regexp_count(text(c), F.lit(f"(?=({unstable})).")).cast("double")
    return F.when(size(c) < 2, 0.0).otherwise(100.0 * hits / F.greatest(size(c) - 1, F.lit(1)))


def solubility_proxy(c: Sequence) -> Column:
    """Charge for, hydrophobicity and aromatic residues against."""
    return F.when(size(c) == 0, 0.0).otherwise(0.5 * F.abs(net_charge(c)) - 1.2 * mean_scale(c, S.EISENBERG) - 0.8 * share(c, "FWY"))


def _wave(values: Column, angle: float) -> Column:
    """Length of the vector sum of values, each turned by `angle` degrees against the one before."""
    a = math.radians(angle)
    zero = F.struct(F.lit(0.0).alias("i"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    fold = lambda s, h: F.struct((s["i"] + 1).alias("i"), (s["x"] + h * F.cos(s["i"] * a)).alias("x"), (s["y"] + h * F.sin(s["i"] * a)).alias("y"))
    return F.aggregate(values, zero, fold, lambda s: F.sqrt(s["x"] * s["x"] + s["y"] * s["y"]))


def on_scale(c: Column, scale: dict[str, float]) -> Column:
    """The scale's values along the text; 0 for other letters."""
    table = F.create_map(*(F.lit(x) for kv in scale.items() for x in kv))
    return F.transform(letters(c), lambda x: F.coalesce(F.try_element_at(table, x), F.lit(0.0)))


def moment(c: Sequence, angle: float = 100.0, scale: dict[str, float] = S.EISENBERG) -> Column:
    """I8: moment of the whole text by its length; 0 for an empty text."""
    return F.when(size(c) == 0, 0.0).otherwise(_wave(on_scale(text(c), scale), angle) / F.greatest(size(c), F.lit(1)))


def window_moment(c: Column, angle: float = 100.0, window: int = 11, scale: dict[str, float] = S.EISENBERG) -> Column:
    """I4: the largest moment of a window of min(window, length) residues; 0 for an empty text."""
    n = F.length(c)
    w = F.least(F.lit(window), n)
    at = F.when(n > 0, F.sequence(F.lit(1), n - w + 1)).otherwise(F.array().cast("array<int>"))
    one = F.transform(F.array(on_scale(c, scale)), lambda v: F.array_max(F.transform(at, lambda i: _wave(F.slice(v, i, F.greatest(w, F.lit(1))), angle) / F.greatest(w, F.lit(1)))))
    return F.when(c.isNotNull(), F.coalesce(F.element_at(one, 1), F.lit(0.0)))


def summary(c: Sequence) -> dict[str, Column]:
    """I16: the summary descriptors, by name."""
    n = size(c)
    aromatic, charge = share(c, "FWY"), net_charge(c)
    eisenberg, helix = mean_scale(c, S.EISENBERG), moment(c, 100.0)
    return {
        "length": n.cast("double"),
        "mw": mass(c),
        "charge_ph7_4": charge,
        "charge_ph5": net_charge(c, 5.0),
        "pi": isoelectric_point(c),
        "charge_density": charge / F.greatest(n, F.lit(1)),
        "hydrophobicity_kd": mean_scale(c, S.KYTE_DOOLITTLE),
        "hydrophobicity_eisenberg": eisenberg,
        "hydrophobicity_ww": mean_scale(c, S.INTERFACE_CHARGED),
        "hydrophobicity_hoppwoods": mean_scale(c, S.HOPP_WOODS),
        "hydrophobicity_janin": mean_scale(c, S.JANIN),
        "hydrophobic_moment_helix": helix,
        "hydrophobic_moment_beta": moment(c, 180.0),
        "aromatic_frac": aromatic,
        "trp_frac": share(c, "W"),
        "phe_frac": share(c, "F"),
        "tyr_frac": share(c, "Y"),
        "lys_arg_frac": share(c, "KR"),
        "acidic_frac": share(c, "DE"),
        "hydrophobic_frac": share(c, "AILMFVW"),
        "aliphatic_index": aliphatic_index(c),
        "boman_index": mean_scale(c, S.BOMAN),
        "instability_index": unstable_share(c),
        "helical_propensity": mean_scale(c, S.HELIX),
        "aggregation_propensity": eisenberg + 0.5 * aromatic - 0.3 * F.abs(charge),
        "amphipathicity": helix,
        **{f"cleavage_{k}".lower(): share(c, v) for k, v in S.CUTS.items()},
        "oxidation_sensitive": share(c, "MCW"),
        "deamidation_prone": share(c, "NQ"),
        "camsol_like": solubility_proxy(c),
    }


def composition(c: Column) -> Column:
    """Residue shares as a map residue -> share, for residues that occur."""
    n = F.greatest(F.length(c), F.lit(1))
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(letters(c))), lambda a: F.struct(a.alias("k"), (F.size(F.filter(letters(c), lambda x: x == a)) / n).alias("v"))))


def dipeptides(c: Column) -> Column:
    """Dipeptide shares as a map, for those that occur: 400 columns would outgrow generated code."""
    p = pairs(c)
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(p)), lambda a: F.struct(a.alias("k"), (F.size(F.filter(p, lambda x: x == a)) / F.greatest(F.size(p), F.lit(1))).alias("v"))))


def terminal(c: Column) -> Column:
    """Residues at places n1, n2, c1, c2 as a map; places that a short text lacks are left out."""
    n = F.length(c)
    at = [("n1", 1, n >= 1), ("n2", 2, n >= 2), ("c1", -1, n >= 2), ("c2", -2, n >= 3)]
    entries = F.array(*(F.struct(F.lit(k).alias("k"), F.when(ok, F.substring(c, i, 1)).alias("v")) for k, i, ok in at))
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def describe(df: DataFrame, seq: str, names: Iterable[str] | None = None) -> DataFrame:
    """df with the summary descriptors (or the named ones): counts in one projection, descriptors in the next."""
    counts = {a: count(F.col(seq), a).alias(f"__n{a}") for a in S.RESIDUES}
    wide = df.select("*", F.length(seq).alias("__size"), *counts.values())
    own = summary(Counted(F.col(seq), F.col("__size"), {a: F.col(f"__n{a}") for a in S.RESIDUES}))
    own = {k: v for k, v in own.items() if names is None or k in names}
    if {"hydrophobic_moment_helix", "amphipathicity"} <= own.keys():
        own["amphipathicity"] = F.col("hydrophobic_moment_helix")
        first = {k: v for k, v in own.items() if k != "amphipathicity"}
        wide = wide.withColumns(first).withColumn("amphipathicity", own["amphipathicity"])
    else:
        wide = wide.withColumns(own)
    return wide.select(*(c for c in df.columns if c not in own), *own)
