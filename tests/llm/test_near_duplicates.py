import brute
import duckdb
import numpy as np
import pytest

from logspark.llm import near_duplicates as near
from logspark.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def texts(folder):
    return duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_query_agrees_with_brute_force(spark, folder):
    want = brute.near_duplicates(texts(folder))
    got = QUERIES["op1_near_duplicates"](spark, folder).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_node_of_near_copies_is_compared_in_blocks(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(300):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 8)):
            words[at] = f"x{rng.integers(10**6)}"
        rows.append((d, " ".join(words)))
    rule = near.Similarity(words=3, percent=85, node_limit=16, block_shingles=2000)
    got = near.class_ids(spark.createDataFrame(rows, "doc_id long, text string"), rule=rule).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_duplicates(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b"), (None, "a b"), (None, "zz"),
            (7, "a b"), (7, "a b"), (8, "q " * 5000), (9, "Q " * 4000)]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, size string, class string")
    got = near.class_ids(df, rule=near.Similarity(words=3, percent=85)).collect()
    assert len(got) == len(rows)
    key = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got)
    assert key == sorted([("1", 0, "1"), ("2", 0, "2"), ("3", 0, "3"), ("4", 1, "4"), ("5", 1, "4"), ("6", 1, "6"),
                          ("None", 1, "6"), ("None", 1, "None"), ("7", 1, "6"), ("7", 1, "6"), ("8", 1, "8"), ("9", 1, "8")])
    assert near.class_ids(df.limit(0)).count() == 0


def test_many_rows_without_an_id(spark):
    """Texts without ids are told apart by their text; none meets all the others."""
    base = [f"w{i % 97} x{i} y{i % 13}" for i in range(60)]
    rows = [(None, " ".join(base[: 40 + k % 20]) + f" z{k // 20}") for k in range(400)] + [(7, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rule = near.Similarity(words=3, percent=85)
    got = near.class_ids(df, rule=rule).collect()
    want = brute.near_duplicates([(i, t) for i, (_, t) in enumerate(rows)])
    groups = {}
    for r in got:
        groups.setdefault((r.component_id, r.first_key), []).append(r.text_key)
    assert len(got) == len(rows) and len(groups) == len({root for _, root in want.values()})
