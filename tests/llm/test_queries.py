from __future__ import annotations

import pytest

from lodestack.llm import queries

from ..oracle import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == duck_rows(queries.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_covers_its_table(spark, name):
    got = queries.queries()[name](spark, SF)
    rows = got.collect()
    if name != "op5_benchmark_decontamination":
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert "doc_id" in got.columns
