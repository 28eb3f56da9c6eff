import zlib

import duckdb
import numpy as np

from logspark.llm import quality
from logspark.llm.queries import QUERIES


def auc(good, bad):
    return (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()


def test_held_out_documents_are_ranked_well(spark):
    folder = "/root/testdata/sf0.1"
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    got = QUERIES["op6_quality"](spark, folder).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert len(got) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    good, bad = (np.array([r.score for r in held if labels[r.doc_id] == k]) for k in (1, 0))
    right = np.mean([r.predicted == labels[r.doc_id] for r in held])
    kept = np.mean(good >= 0.3)
    print("AUC", auc(good, bad), "accuracy", right, "good kept", kept, "bad kept", np.mean(bad >= 0.3), len(held))
    assert auc(good, bad) > 0.97 and right > 0.95 and kept > 0.97


def test_odd_rows(spark):
    docs = [(1, "Good plain words here."), (2, "BAD!! WORDS!! HERE!!"), (3, None), (4, ""), (None, "x"), (1, "Good plain words here."), (7, "w " * 50000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS label")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 1), (7, 1), (4, 0)], "doc_id long, quality int")
    out = quality.scored(df, quality.learn(df, labels)).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality.scored(df, None).collect()} == {0.5}
    assert quality.learn(df, labels.where("quality = 1")) is None
    assert quality.good(df, labels).columns == df.columns
    assert quality.scored(df.limit(0), quality.learn(df.limit(0), labels)).count() == 0


def test_all_labels_and_all_pairs_are_learned_from(spark):
    # more good documents than were once drawn; some labels come twice, one document has both
    rng = np.random.default_rng(5)
    texts = {i: " ".join(rng.choice(["plain", "word", "and", "Then", "7"], 1 + i % 23)) + ("!" * int(rng.integers(4)) if i % 9 == 0 else ".") for i in range(6300)}
    labels = [(i, int(i % 9 != 0)) for i in texts] + [(i, 1) for i in range(1, 200, 9)] + [(4, 0)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    learned = [(i, k) for i, k in labels if zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([quality.features(texts[i]) for i, _ in learned]), np.array([k for _, k in learned])
    assert (y == 1).sum() > 4000
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.spread, np.maximum(x.std(axis=0), 1e-6), atol=1e-5)
    z = model.expand(x)
    good, bad = z[y == 1], z[y == 0]
    lost = 1 / (1 + np.exp((good @ model.weights)[:, None] - (bad @ model.weights)[None, :]))
    gradient = (lost.sum(axis=0) @ bad - lost.sum(axis=1) @ good) / lost.size + 1e-3 * model.weights
    assert np.abs(gradient).max() < 1e-5
    assert np.isclose(model.accept, np.quantile(model.strength(x), (y == 0).mean()), rtol=0, atol=1e-8)


def test_nth_counts_values_as_often_as_they_occur(spark):
    values = [(0.5, 3), (-2.0, 1), (7.25, 2), (0.5, 1), (0.500000001, 1)]
    df = spark.createDataFrame(values, "s double, n bigint")
    assert [quality.nth(df, k) for k in range(8)] == [-2.0, 0.5, 0.5, 0.5, 0.5, 0.500000001, 7.25, 7.25]
