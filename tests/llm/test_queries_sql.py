"""Every contract query that SQL can express against its SQL."""

import oracle
import pytest

from logspark.llm.queries import ORACLES, QUERIES

oracle.KINDS = {**oracle.KINDS, "int": "INTEGER"}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name, folder):
    assert oracle.compare(spark, oracle.connect(folder), name, QUERIES[name], ORACLES[name], folder) is None
