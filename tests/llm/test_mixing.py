from pyspark.sql import functions as F

from logspark.llm import mixing


def targets(sizes, weights=(1, 2, 3), times=3):
    """By the words of the contract: share by weight, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(times * sizes[s] for s in capped)
        out = {s: times * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if out[s] > times * sizes[s]}
        if not over:
            return out
        capped |= over


def test_targets_and_taken_words(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), s) for i, s in enumerate(["a"] * 900 + ["b"] * 5 + ["c"] * 300 + [None] * 40 + ["é"] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.lit(1)).withColumn("band", F.lit(2))
    got = mixing.mix(df, bucket_rows=16).collect()
    assert len(got) == len(rows) and got[0].band == 2
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes)
    taken = {}
    for r in got:
        assert r.mix.source_size == sizes[r.source] and abs(r.mix.target - want[r.source]) < 1e-6
        assert 0 <= r.mix["copies"] <= 3
        taken[r.source] = taken.get(r.source, 0) + r.mix.size * r.mix["copies"]
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] + 90 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df, bucket_rows=16).collect()))


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (None, "x y", "a"), (None, "x y", "a"), (3, "x " * 30000, "b"), (4, "z", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert sorted(r.mix.size for r in got) == [0, 0, 1, 2, 2, 30000]
    assert mixing.repeated(df).columns == df.columns
    assert mixing.repeated(df).count() == sum(r.mix["copies"] for r in got)
    assert mixing.mix(df.limit(0)).count() == 0
    empty = mixing.mix(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).collect()
    assert (empty[0].mix.target, empty[0].mix["copies"]) == (0.0, 0)


def test_a_column_of_the_result_name_is_replaced(spark):
    df = spark.createDataFrame([(1, "x y", "a"), (2, "z", "b")], "doc_id long, text string, source string").withColumn("mix", F.lit("m"))
    assert sorted(r.mix.size for r in mixing.mix(df).select("mix").collect()) == [1, 2]
    assert {r.mix for r in mixing.repeated(df).collect()} == {"m"}
