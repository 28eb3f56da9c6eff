"""Every registered query against its SQL twin, on the smallest tables."""

from concurrent.futures import ThreadPoolExecutor

import oracle
import pytest

import __spark_entry__ as entry
from logspark.plans import QUERIES

FOLDER = entry.SMOKE_DIR
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def outcomes(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    con = oracle.connect(FOLDER)

    def run(name):
        try:
            if name not in sql:
                queries[name](spark, FOLDER).collect()
                return None
            return oracle.compare(spark, con.cursor(), name, queries[name], sql[name], FOLDER)
        except Exception as error:
            return f"{type(error).__name__}: {error}"[:2000]

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(NAMES, pool.map(run, NAMES)))


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(outcomes, name):
    assert outcomes[name] is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"module", "call_count", "rank"} <= set(df.columns)
