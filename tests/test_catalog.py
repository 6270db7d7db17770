from __future__ import annotations

import pytest

from lodestack.plans import catalog

from .oracle import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got = spark_rows(catalog.queries()[name](spark, SF))
    assert got == duck_rows(catalog.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    catalog.queries()[name](spark, SF).limit(5).collect()
