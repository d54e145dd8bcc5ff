"""Registry of the core's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


#: SQL of DuckDB for texts over the standard residues and for tidied and reduced sequences.
AA = "ACDEFGHIKLMNPQRSTVWY"


def tidy(c: str) -> str:
    return f"upper(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


def residues(c: str) -> str:
    return f"regexp_replace(upper({c}), '[^A-Z]', '', 'g')"


#: New candidates and the reference they are screened against: later batches and the first eight.
CAND = f"cand AS (SELECT ord, {tidy('seq')} AS s FROM scored_candidates WHERE batch_no > 8)"
REF = f"ref AS (SELECT DISTINCT {tidy('seq')} AS s FROM scored_candidates WHERE batch_no <= 8 AND length({tidy('seq')}) BETWEEN 8 AND 50 AND regexp_full_match({tidy('seq')}, '[{AA}]+'))"
VALID = f"length(s) BETWEEN 8 AND 50 AND regexp_full_match(s, '[{AA}]+')"
