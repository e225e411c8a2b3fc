import pytest
from oracle import compare

from stratalog.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    compare(spark, name, QUERIES[name], SQL[name], SF)
