"""Product codes against a plain exhaustive search with whole numbers of any size."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.llm import vector_codes as vc

DDL = "vec_id long, embedding array<double>, label string"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    step = width // parts
    ints = [[vc.whole(c, scale) for c in v] + [0] * (width - len(v)) for _, v, _ in kept]
    cut = [[x[p * step : (p + 1) * step] for p in range(parts)] for x in ints]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, list(kept[i][1])))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], c)), e) for e, c in enumerate(books[p])) for p in range(parts)] for x in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut[i][p] for i, f in enumerate(found) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, g), e in zip(kept, errors):
        total[g] = total.get(g, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    fits = lambda n: n if n < 2**63 else None
    return [
        (i, "".join(f"{e:02x}" for _, e in f), fits(err), None if any(fits(x) is None for (_, _, h), x in zip(kept, errors) if h == g) else fits(total[g]), sha)
        for (i, _, g), f, err in zip(kept, found, errors)
    ]


def same(got, want):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("seed,n,dim,spread", [(1, 150, 16, 1.0), (2, 40, 24, 1e-3), (3, 12, 8, 5.0), (4, 120, 16, 0.0)])
def test_random_vectors(spark, seed, n, dim, spread):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(3 * n), [rnd.gauss(rnd.choice([-1, 0, 1]) * spread, spread) for _ in range(dim)], rnd.choice(["a", "b", None])) for _ in range(n)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, DDL).withColumn("codes", F.lit(1)).withColumn("_group", F.lit(2))
    same(vc.compressed(df).collect(), brute(rows))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, -0.25, 0.1] * 3, "a"), (2, [0.5] * 16, None), (None, [0.1] * 8, None), (None, [0.1] * 8, "a"), (3, None, "a"),
        (4, [None] + [0.1] * 7, "a"), (5, [nan] * 8, "a"), (6, [inf] * 8, "a"), (7, [], "b"), (8, [-1e-12] * 4, "b"), (8, [-1e-12] * 4, "b"),
    ]
    same(vc.compressed(spark.createDataFrame(rows, DDL)).collect(), brute(rows))
    assert vc.compressed(spark.createDataFrame(rows, DDL).limit(0)).count() == 0
    same(vc.compressed(spark.createDataFrame([(1, [], "a")], DDL)).collect(), brute([(1, [], "a")]))


def test_large_components_are_exact(spark):
    rnd = random.Random(5)
    big = [1e3, 3e6, 1e9, 1e15, 1e200, 1.7e308]
    rows = [(i, [rnd.choice([-1, 1]) * rnd.random() * rnd.choice(big) for _ in range(8)], rnd.choice("ab")) for i in range(60)]
    rows += [(100 + i, [rnd.random() * 1e6 for _ in range(8)], "c") for i in range(20)]
    same(vc.compressed(spark.createDataFrame(rows, DDL), entries=4).collect(), brute(rows, entries=4))


def test_search_equals_exhaustive_search():
    rnd = np.random.default_rng(7)
    for kind in (3, 10, 4000):
        entries = rnd.integers(-kind, kind, (16, 5))
        parts = rnd.integers(-kind, kind, (500, 5))
        codes, distances = vc.Codebook(entries.tolist()).nearest(parts)
        apart = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (codes == apart.argmin(axis=1)).all() and (distances == apart.min(axis=1)).all()


def test_codes_stand_for_vectors(spark):
    rows = [(i, [float(i % 7)] * 8, "a") for i in range(50)]
    df = spark.createDataFrame(rows, DDL)
    books = vc.learn(df)
    for r in vc.coded(df, books).collect():
        back = vc.reconstruction(r.codes.code, books)
        assert sum((a - vc.whole(b, 4096)) ** 2 for a, b in zip(back, r.embedding)) == r.codes.error


def test_group_errors_by_shuffle(spark):
    rows = [(i, i % 3 or None, i) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, label int, error long")
    for most in (100_000, 1):
        got = {r.vec_id: r.total for r in vc.with_group_errors(df, "label", "error", "total", most_rows=most).collect()}
        assert got == {i: sum(e for _, h, e in rows if h == g) for i, g, _ in rows}
