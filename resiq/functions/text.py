"""Column expressions over sequences, headers and assay texts. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The twenty standard residues, and those with the ambiguous and rare letters.
STANDARD = "ACDEFGHIKLMNPQRSTVWY"
EXTENDED = STANDARD + "BOUXZ"


def residues(c: Column) -> Column:
    """Upper case without everything that is not a letter A-Z."""
    return F.regexp_replace(F.upper(c), "[^A-Z]", "")


def tidy(c: Column) -> Column:
    """Upper case without surrounding white space."""
    return F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))


def is_peptide(c: Column, lo: int = 8, hi: int = 50) -> Column:
    """B1: length within bounds and standard residues only."""
    return F.length(c).between(lo, hi) & c.rlike(f"^[{STANDARD}]+$")


def is_model_text(c: Column) -> Column:
    """B2: non-empty text over the extended alphabet."""
    return c.rlike(f"^[{EXTENDED}]+$")


def odd_residues(c: Column) -> Column:
    """The sorted different letters outside the standard alphabet, joined."""
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_except(letters, F.array(*(F.lit(a) for a in STANDARD)))), "")


def normalized(c: Column) -> Column:
    """Struct (seq, err): seq for a clean text, else the reason. Null, blank and NAN are empty."""
    s = F.coalesce(tidy(c), F.lit(""))
    odd = odd_residues(s)
    err = F.when(s.isin("", "NAN"), F.lit("empty sequence")).when(odd != "", F.concat(F.lit("nonstandard residues: "), odd))
    return F.struct(F.when(err.isNull(), s).alias("seq"), err.alias("err"))


def substituted(c: Column) -> Column:
    """Rare letters by their nearest standard residue."""
    return F.translate(F.upper(c), "XBZUO", "ANQCK")


def directed(c: Column) -> Column:
    """Struct (direction, seq) of a text whose first sign says which end comes first."""
    s = F.regexp_replace(c, r"\s", "")
    first, rest = F.substring(s, 1, 1), F.substring(s, F.lit(2), F.length(s))
    way = F.when(first == "1", "N2C").when(first == "2", "C2N").otherwise("unknown")
    seq = F.when(first == "1", rest).when(first == "2", F.reverse(rest)).otherwise(s)
    return F.struct(F.when(c.isNotNull(), way).alias("direction"), seq.alias("seq"))


def header_fields(c: Column) -> Column:
    """H2: the k=v tokens of a header as a map; the last of equal keys wins. No tokens give an empty map."""
    tokens = F.filter(F.split(c, r"\s+"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(tokens, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def number_in(c: Column) -> Column:
    """H3: the first plain number in a text; signs, inequality and exponents are dropped. Null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(\d+(\.\d+)?)", 1), F.lit("")).try_cast("double")


#: Name patterns of organisms and what they stand for, applied in this order.
ORGANISMS = (
    (r"^(A\.\s*|A\s+|Acinetobacter\s+)?baumanii.*", "Acinetobacter baumannii"),
    (r"^(A\.\s*|A\s+|Acinetobacter\s+)?baumannii.*", "Acinetobacter baumannii"),
    (r"^(A\.\s*|A\s+|Alternaria\s+)?brassicicola.*", "Alternaria brassicicola"),
    (r"^(A\.\s*|Alternaria\s+)?brassicola.*", "Alternaria brassicicola"),
)


def titled(c: Column) -> Column:
    """The first letter of every run of letters upper, the others lower: unlike initcap, runs start after any
    other sign ('e.coli' gives 'E.Coli')."""
    marked = F.regexp_replace(F.lower(c), r"(\p{L}+)", "\u0001$1")
    return F.array_join(F.transform(F.split(marked, "\u0001"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def organism(c: Column) -> Column:
    """H4: the tidied name of an organism; null gives 'unknown'."""
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    for pattern, name in ORGANISMS:
        s = F.regexp_replace(s, f"(?i){pattern}", name)
    s = F.regexp_replace(s, r"\s+", " ")
    return F.coalesce(F.when(F.size(F.split(s, " ")) <= 2, titled(s)).otherwise(s), F.lit("unknown"))


def shared_length_bounds(length: Column, t: float) -> tuple[Column, Column]:
    """K2: the lengths that a text can have to reach an indel ratio above t with a text of `length`; lo > hi if none."""
    lo = F.floor(length * t / (2 - t)) + 1
    hi = F.ceil(length * (2 - t) / t) - 1 if t > 0 else F.lit(2**31 - 1)
    return lo.cast("int"), hi.cast("int")
