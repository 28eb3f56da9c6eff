import numpy as np
import pytest

from logspark.llm import topk


def brute(rows, k, scale=1024):
    ok = [(i, np.floor(scale * np.asarray(v, np.float64)).astype(np.int64)) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in ok), default=1)
    ok = [(i, np.pad(v, (0, width - len(v)))) for i, v in ok]
    out = set()
    for q, x in ok:
        if q % 100 == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q)[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, 6))
    rows = [(i, [float(x) for x in centre[i % 5] + rng.normal(size=6) * (0.02 if seed == 1 else 1.0)]) for i in range(1500)]
    rows += [(2000 + i, [0.5] * 6) for i in range(300)] + [(5000 + i, None) for i in range(3)]
    rows += [(6000, [1.0, None]), (6100, [float("nan")] * 6), (6200, [float("inf")] * 6), (None, [1.0] * 6), (6300, [1.0, 2.0]), (6301, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS block")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), k=10, pivots=6, block_rows=64).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute(rows, 10)


def test_few_rows(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (200, [0.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = topk.top_k(df, df.where("vec_id % 100 = 0")).collect()
    assert {tuple(r) for r in got} == brute([(100, [1.0, 0.0]), (200, [0.0, 0.0]), (3, [1.0, 1.0])], 10)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [0.25] * 4) for i in range(0, 400)], "vec_id long, embedding array<float>")
    got = topk.top_k(same, same.where("vec_id % 100 = 0"), k=3, block_rows=32).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {
        (q, n, i) for q in (0, 100, 200, 300) for n, i in enumerate([x for x in range(5) if x != q][:3], 1)}


def test_large_components_are_exact(spark):
    """Vectors beyond what doubles hold exactly, among others; scores beyond 64 bits rank where they belong."""
    rng = np.random.default_rng(3)
    big = [1.0, 3e3, 3e6, 1e9, 1e18, 1e300]
    rows = [(i, [float(x) for x in rng.normal(size=3) * big[int(rng.integers(6)) if i % 3 else 0]]) for i in range(700)]
    rows += [(1000, [3e6, 1.0, 0.0]), (1001, [3e6, 1.0, 0.0]), (1100, [-1e300, 1.0, 0.0]), (1200, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: [1024 * n // d for n, d in (x.as_integer_ratio() for x in v)] for i, v in rows}
    want = set()
    for q in (i for i in ints if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:10]
        want |= {(q, n, i, -s if -(2**63) <= -s < 2**63 else None) for n, (s, i) in enumerate(scores, 1)}
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), k=10, pivots=4, block_rows=64).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)
    assert any(r.score is None for r in got)


def test_queries_ask_only_for_annuli_within_reach(spark, monkeypatch):
    """Clustered vectors: what is written for a query follows what it visits, not the number of annuli."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(8, 6)) * 20
    rows = [(i, [float(x) for x in centre[i % 8] + rng.normal(size=6)]) for i in range(8000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked, plain = [], topk._requests
    monkeypatch.setattr(topk, "_requests", lambda *a: asked.append(plain(*a)) or asked[-1])
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), k=5, pivots=8, block_rows=32).collect()
    assert set(map(tuple, got)) == brute(rows, 5)
    pairs = [(r.query, r.block) for turn in asked for r in turn.collect()]
    assert len(pairs) == len(set(pairs))  # no annulus is visited twice
    assert len(pairs) < 80 * (8000 // 32) / 2


def test_the_kth_best_bounds_the_search_not_the_best(spark):
    """On a circle an annulus holds two arcs, so k rows are found before the k nearest are."""
    turn = np.random.default_rng(8).uniform(0, 2 * np.pi, 1500)
    rows = [(i, [float(10 * np.cos(t)), float(10 * np.sin(t))]) for i, t in enumerate(turn)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), k=60, pivots=1, block_rows=4).collect()
    assert set(map(tuple, got)) == brute(rows, 60)
