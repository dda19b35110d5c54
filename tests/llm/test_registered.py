from __future__ import annotations

import pytest
from check import same_rows

import __spark_entry__ as entry
from sparkquill.llm import queries as llm

ORACLES = llm.oracle_sql()


def test_all_operators_and_the_pipeline_are_registered():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    same_rows(llm.queries()[name](spark, sf), ORACLES[name], sf)
