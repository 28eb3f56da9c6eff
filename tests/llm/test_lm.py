import math
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from brute import words
from logspark.llm import lm
from logspark.llm.queries import QUERIES

END = object()


def brute(rows, prior=500.0):
    """{doc_id: (held_out, n_tokens, n_known, N, base, score)} with unrounded probabilities."""
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    texts = {d: [*words(t), END] for d, t in rows}
    count, pairs = Counter(), Counter()
    for d, w in texts.items():
        if not held[d]:
            count.update(w)
            pairs.update(zip([None, *w], w))
    n, v = sum(count.values()), len(count)
    count[None] = count[END]
    p = lambda w: (count[w] + 1) / (n + v + 1)
    out = {}
    for d, w in texts.items():
        base = sum(math.log10(p(x)) for x in w)
        score = sum(math.log10((pairs[u, x] + prior * p(x)) / (count[u] + prior)) for u, x in zip([None, *w], w))
        out[d] = (held[d], len(w), sum(count[x] > 0 for x in w), n, base, score)
    return out


def hold(got, want):
    assert len(got) == len(want)
    for r in got:
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base)
        assert abs(r.score - score) < 0.02 * n + 1e-3  # a step of 1/32 rounds by 1/64 at most


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_agrees_with_brute_force(spark, folder):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    hold(QUERIES["op7_lm_scores"](spark, folder).collect(), brute(rows))


def test_small_chunks_shards_and_hot_contexts(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = lm.scores(df, lm.is_held_out(F.col("doc_id")), chunk_tokens=3000, shard_tokens=7000, hot=200).collect()
    hold(got, brute(rows))


def test_probabilities_sum_to_one(spark):
    rows = [(i, "a b a c " * (1 + i % 3)) for i in range(40)]
    vocabulary = {"a", "b", "c"}
    asked = [(1000 + i, w) for i, w in enumerate(sorted(vocabulary))] + [(2000, "")]
    df = spark.createDataFrame(rows + asked, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.scores(df, F.col("doc_id") >= 1000).collect()}
    counts = Counter()
    for _, t in rows:
        counts.update([*t.split(), END])
    n, v = sum(counts.values()), len(counts)
    # the first word after the start, from texts of one word, and the empty text for the end right away
    ends = {w: Counter(b for _, t in rows for a, b in zip([*t.split()], [*t.split()[1:], END]) if a == w) for w in vocabulary}
    total = 10 ** got[2000].score + 1 / (n + v + 1) * 500 / (40 + 500)
    for d, w in asked[:-1]:
        after = (ends[w][END] + 500 * (counts[END] + 1) / (n + v + 1)) / (counts[w] + 500)
        total += 10 ** got[d].score / after
    assert abs(total - 1) < 0.06


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x y"), (None, "x y"), (3, "é " * 40000), (4, "X y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS chunk")
    got = lm.scores(df, lm.is_held_out(F.col("doc_id"))).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 3, 3, 3, 40001]
    assert lm.scores(df.limit(0), lm.is_held_out(F.col("doc_id"))).count() == 0
    none = lm.scores(df, F.lit(True)).collect()
    assert {r.train_tokens for r in none} == {0} and all(r.n_known == 0 and r.score == r.base_score == 0 for r in none)


def test_numbers_by_bytes_and_gaps():
    import numpy as np

    rng = np.random.default_rng(1)
    for top in (1, 255, 256, 2**24, 2**24 + 5, 2**40):
        x = rng.integers(0, top + 1, 1000)
        x[0] = top
        assert (lm.joined(lm.planes(x)) == x).all()
    sizes = rng.integers(1, 9, 200)
    x = np.concatenate([np.sort(rng.integers(0, 2**30, n)) for n in sizes])
    first = np.cumsum(sizes) - sizes
    assert (lm.from_gaps(lm.gaps(x, first), sizes) == x).all()
    none = np.zeros(0, np.int64)
    assert len(lm.from_gaps(lm.joined(lm.planes(none)), none)) == 0 == len(lm.gaps(none, none))
