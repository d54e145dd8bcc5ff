"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from resiq.plans import pipelines, q_more, q_relational, q_rest, q_screen, q_sequence, q_values
from resiq.plans.registry import ORACLE, QUERIES
from resiq.streaming import accept

#: Their import fills the registry.
MODULES = (q_screen, q_relational, q_sequence, q_values, q_more, q_rest, pipelines, accept)
FLAGSHIP = pipelines.pipeline_library


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
