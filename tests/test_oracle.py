"""Every query of the plans against its SQL, and the others for running at all."""

import oracle
import pytest

from vellum import plans


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows_as_sql(spark, sf_dir, con, name):
    assert oracle.differences(plans.QUERIES[name](spark, sf_dir), con, plans.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0
