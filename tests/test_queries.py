"""Every query of the core against its SQL at the smallest size; those without SQL must run."""

import pytest

from marlstone.plans import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"
QUERIES = {n: (f, r.sql.get(n)) for r in catalog.registries() for n, f in r.queries.items()}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    f, sql = QUERIES[name]
    if sql:
        oracle.compare(spark, name, f, sql, SF, con)
    else:
        f(spark, SF).count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
