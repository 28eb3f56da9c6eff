"""Merkle proofs against a plain tree in lists."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from logspark.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    by = dict(zip(["doc_id", "text", "lang", "source", "n_chars"], row))
    return sha("".join("-" if by[f] is None else f"{len(str(by[f]).encode())}:{by[f]}" for f in FIELDS))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, rank):
    """Siblings, and the digest sides, from the bottom."""
    out = []
    for level in tree[:-1]:
        other = rank ^ 1
        out.append((rank & 1, level[other] if other < len(level) else ""))
        rank >>= 1
    return out


def brute(rows, tamper=lambda row: row):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names]) if names else [[None]]
    out = []
    for k, g in enumerate(names):
        for rank, row in enumerate(groups[g]):
            steps = way(trees[g], rank) + way(top, k)
            node = leaf(tamper(row))
            for bit, other in steps:
                node = sha(other + node if bit else node + other)
            out.append((row[0], leaf(row), trees[g][-1][0], top[-1][0], sha("".join(o for _, o in steps)), node, node == top[-1][0]))
    return out


def run(df, changes=None):
    hexed = lambda c: F.lower(F.hex(c))
    return merkle.proofs(df, FIELDS, changes=changes).select(
        "id", hexed("leaf"), hexed("subroot"), hexed("root"), hexed("proof"), hexed("folded_root"), "verified")


def same(got, want):
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def rows_of(seed, n, langs):
    rnd = random.Random(seed)
    return [(rnd.randrange(10 * n), "t" * rnd.randrange(5), rnd.choice(langs), rnd.choice(["s", None, "é"]), rnd.choice([None, 5])) for _ in range(n)]


@pytest.mark.parametrize("seed,n,langs,height", [
    (1, 1, ["en"], 9), (2, 2, ["en"], 2), (3, 70, ["en"], 2), (4, 90, ["en", "fr", None], 2), (5, 60, [f"l{i}" for i in range(23)], 1),
    (6, 1200, ["en", "en", "en", "", None, "日"], 9), (7, 33, ["a"], 3), (8, 129, ["a", "b"], 3),
])
def test_trees_of_many_shapes(spark, monkeypatch, seed, n, langs, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = rows_of(seed, n, langs)
    df = spark.createDataFrame(rows, DDL)
    odd = F.col("doc_id") % 3 == 0
    got = run(df, {"n_chars": F.when(odd, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}).collect()
    want = brute(rows, lambda r: (*r[:4], r[4] + 1 if r[4] is not None and r[0] % 3 == 0 else r[4]))
    same(got, want)
    assert sum(not r.verified for r in got) == sum(r[0] % 3 == 0 and r[4] is not None for r in rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    big = 2**62 + 1
    rows = [(None, None, None, None, None)] * 5 + [(big, "x", "en", "s", 1), (big, "x", "en", "s", 1), (big + 1, "", "en", None, 2**63 - 1)]
    rows += [(None, "a", "en", None, 1), (None, "b", "en", None, 1), (7, "long " * 100_000, "", "s", 0), (-3, "é\u0000", "en", "", 5)]
    df = spark.createDataFrame(rows, DDL).select("*", *[F.lit(9).alias(c) for c in ("tree", "rank", "node", "n", "path", "id")])
    same(run(df).collect(), brute(rows))
    assert run(df.limit(0)).count() == 0


def test_damaged_records_are_found():
    nodes = [merkle.digest(bytes([i])) for i in range(8)]
    top, records = merkle.segment(nodes, None)
    children = merkle.children_of(records)
    assert merkle.descend(top, 5, 3, children)[0] == nodes[5]
    damaged = bytearray(records)
    damaged[40] ^= 1
    with pytest.raises(KeyError):
        for rank in range(8):
            merkle.descend(top, rank, 3, merkle.children_of(bytes(damaged)))


def test_equal_segments_are_stored_once(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    df = spark.createDataFrame([(1, "x", "en", "s", 1)] * 64, DDL)
    rows = merkle.leaves(df, FIELDS)
    manifest = merkle.build(rows)
    assert manifest.store.count() == 3
    assert {r.n for r in rows.collect()} == {64}
