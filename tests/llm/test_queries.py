"""The llm queries against their SQL at the smallest size; those without SQL must run and keep their columns."""

import pytest

from marlstone.llm import queries
from tests import oracle

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["fundno", "crsp_fundno"], "p3_found": ["wficn", "rqdate", "cusip8", "shares", "ticker"], "p5_found": ["name_a", "name_b"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.R.queries))
def test_query(spark, name):
    f, sql = queries.R.queries[name], queries.R.sql.get(name)
    if sql:
        oracle.compare(spark, name, f, sql, SF)
        return
    df = f(spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.count()
    if name in COLUMNS and name != "p7_ids":
        assert df.distinct().count() == rows
