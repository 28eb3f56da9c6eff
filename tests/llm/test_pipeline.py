import brute
import duckdb
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from logspark.llm import secrets
from logspark.llm.words import alphanumeric
from test_mixing import targets

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def windows(spark):
    out = set()
    for (text,) in duckdb.sql(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall():
        w = alphanumeric(text)
        k = min(10, len(w))
        out |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return out


def has_window(text, found):
    w = alphanumeric(text)
    return any(tuple(w[i : i + k]) in found for k in {len(x) for x in found} for i in range(len(w) - k + 1))


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    states = [docs]
    for n, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, states[-1], FOLDER).write.parquet(f"{tmp_path}/{n}")
        states.append(spark.read.parquet(f"{tmp_path}/{n}"))
        assert states[-1].columns == docs.columns
    start, good, unique, clean, safe = map(rows, states[:5])

    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall())
    assert all(d in good for d, q in labels.items() if q == 1) and sum(d in good for d, q in labels.items() if q == 0) <= 1
    assert all(good[d] == start[d] for d in good)

    component = brute.near_duplicates([(d, r.text) for d, r in good.items()], size=5, percent=80)
    assert set(unique) == {d for d, (_, c) in component.items() if d == c}

    found = windows(spark)
    hit = {d for d, r in unique.items() if has_window(r.text, found)}
    assert hit and all(clean[d] == unique[d] for d in unique if d not in hit)
    assert not any(has_window(r.text, found) for r in clean.values())
    assert all(r.n_chars == len(r.text) for r in clean.values())

    assert set(safe) == set(clean)
    for d, r in safe.items():
        spans = secrets.base_spans(clean[d].text)
        assert r.text == secrets.redacted(clean[d].text, spans, "<SECRET>") if spans else r.text == clean[d].text

    sizes, taken = {}, {}
    for r in safe.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    for r in states[5].collect():
        assert r == safe[r.doc_id]
        taken[r.source] = taken.get(r.source, 0) + len(brute.words(r.text))
    want = targets(sizes)
    longest = max(len(brute.words(r.text)) for r in safe.values())
    assert all(abs(taken.get(s, 0) - t) <= 3 * longest for s, t in want.items())


def test_run_gives_the_last_stage(spark):
    assert pipeline.run(spark, FOLDER).count() > 0


def test_repeated_and_null_rows(spark):
    docs = [(1, "a b c d e f g h", "en", "s", 15), (1, "a b c d e f g h", "en", "s", 15), (None, "a b c d e f g h", "en", None, 15),
            (2, None, None, None, None), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (None, "z y x w v u", "en", "s", 11), (None, "z y x w v u", "en", "s", 11)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("text_key", F.lit("x"))
    kept = pipeline.keep_first_of_near_duplicates(spark, df, FOLDER)
    assert kept.columns == df.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, [
        (1, "a b c d e f g h"), (2, None), (3, ""), (3, ""), (None, "z y x w v u")]))
    for _, stage in pipeline.STAGES:
        assert stage(spark, df.limit(0), FOLDER).count() == 0
        assert stage(spark, df, FOLDER).columns == df.columns
