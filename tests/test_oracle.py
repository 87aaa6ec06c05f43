import pytest

from gapweave import catalog

from .compare import difference, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert difference(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).limit(1).count() == 1
