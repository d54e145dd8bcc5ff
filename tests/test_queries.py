"""Every core query runs on the smallest tables; those with SQL agree with it."""

import math
import os

import duckdb
import pytest

from resiq.plans import catalog
from tests.conftest import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SLOW = {"pipeline_cohorts", "m4_ranker_stand_in", "l7_kmeans_medoids", "c9_nearest_train"}


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or hasattr(v, "is_nan"):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - SLOW))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in catalog.oracle_sql():
        rel = con.execute(catalog.oracle_sql()[name])
        have = [x[0] for x in rel.description]
        assert sorted(have) == cols
        want = sorted((tuple(plain(r[have.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
        assert rows == want
