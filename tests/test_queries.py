"""Every query against its SQL counterpart in DuckDB, and the contract of the entry module."""

import pytest
from oracle import canonical, connect, schema_of

from propensity.oracles import ORACLES
from propensity.queries import QUERIES

WITHOUT_SQL = {
    "lr_predict",
    "lr_coefficients",
    "lr_unregularized",
    "rf_predict",
    "gbt_predict",
    "cv_lr",
    "cv_lr_full",
    "cv_gbt",
    "cv_rf",
    "model_leaderboard",
}


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, name):
    ours = QUERIES[name](spark, tables).toPandas()
    theirs = connect(tables).execute(ORACLES[name]).df()
    assert len(ours) == len(theirs) > 0
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)
    assert schema_of(ours) == schema_of(theirs)


def test_missing_report_is_ordered(spark, tables):
    rows = QUERIES["missing_report"](spark, tables).collect()
    assert [tuple(row) for row in rows] == sorted(map(tuple, rows), key=lambda row: (-row[1], row[0]))
