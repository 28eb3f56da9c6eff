import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.llm import repeats
from logspark.llm.queries import QUERIES
from logspark.llm.suffixes import suffix_array


def brute(rows, length=100):
    """[(doc_id, n_bytes, n_removed, n_spans, sha)] for rows (doc_id, text) in document order."""
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            s = hashlib.blake2b(s, digest_size=12).digest() if length > 40 else s
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def columns(rows):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows], key=str)


def test_suffix_array_against_sorting():
    rng = random.Random(1)
    for n in range(400):
        text = [rng.randrange(1 + n % 4) for _ in range(rng.randrange(60))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    text = [0, 1] * 500 + [0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_bucket_is_that_of_the_column(spark):
    ids, keys = np.array([1, -5, 2**62, int(repeats._NO_ID)]), np.array([9, -(2**63), 3, 4])
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, keys)], "a long, b long")
    want = [r[0] for r in df.select(F.pmod(F.xxhash64("a", "b"), F.lit(7))).collect()]
    assert repeats.spark_bucket(ids, keys, 7).tolist() == want


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_agrees_with_brute_force(spark, folder):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()
    assert columns(QUERIES["op10_repeats"](spark, folder).collect()) == sorted(brute(rows), key=str)


def test_hard_texts(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ab é\n") for _ in range(400)) for _ in range(4)]
    rows = []
    for d in range(120):
        text = list(rng.choice(base)[rng.randrange(200) :])
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        rows.append((d, "".join(text)))
    rows += [(200, "ab" * 300), (201, "ab" * 150), (202, "a" * 5000), (203, "b" * 99), (204, "b" * 100), (205, "b" * 101)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = repeats.removed_bytes(df, shard_bytes=9000).collect()
    assert columns(got) == sorted(brute(rows), key=str)


def test_odd_rows(spark):
    text = "0123456789" * 12 + "tail"
    rows = [(1, None), (2, ""), (5, text), (5, text), (9, "x" + text), (2**60 + 1, text), (None, text), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS kind")
    assert columns(repeats.removed_bytes(df).collect()) == sorted(brute(rows), key=str)
    assert repeats.removed_bytes(df.limit(0)).count() == 0


def test_a_crowded_anchor_is_spread(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage = word(53), word(97)
    rows = [(d, word(150) + (line if d % 2 else passage + "same next") + word(150)) for d in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(brute(rows), key=str)
    assert columns(repeats.removed_bytes(df, shard_bytes=9000).collect()) == want
    assert columns(repeats.removed_bytes(df, shard_bytes=9000, crowd=3).collect()) == want
    assert columns(repeats.removed_bytes(df, crowd=1).collect()) == want

    # what one anchor sends: no group by anchor, and strings in all shards
    pieces = [t.encode()[:400] for _, t in rows if line in t]
    sent = []
    for d, data in enumerate(pieces):
        at = data.index(line.encode())
        sent.append((d, at - 47, data[at - 47 : at + 100]))
    doc, start, high, low = repeats.strings(sent, 100)
    assert len(doc) == sum(len(p) - 99 for _, _, p in sent)
    assert all(high[i] == repeats.strings([(0, 0, pieces[doc[i]][start[i] : start[i] + 100])], 100)[2][0] for i in range(0, len(doc), 97))
    per_shard = np.bincount((low % np.uint64(8)).astype(int), minlength=8)
    assert per_shard.max() < 1.3 * len(doc) / 8


def test_anchors_do_not_depend_on_the_size_of_the_text():
    """A passage has the same anchors alone and inside a text above 16 MB, wherever it stands."""
    import numpy as np

    rng = np.random.default_rng(9)
    passage = rng.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    large = rng.integers(0, 256, 17 << 20, dtype=np.uint8).tobytes()

    def places(data, start, count):
        first, last, place, hashes = repeats.anchors(data, 100)
        each = np.repeat(place, last - first + 1)
        return each[start : start + count] - start

    alone = places(passage, 0, 300_000 - 99)
    for at in (0, (1 << 23) - 150_000, (1 << 24) - 1000, 17 << 20):
        inside = large[:at] + passage + large[at:]
        assert (places(inside, at, 300_000 - 99) == alone).all()


def test_repeats_in_a_text_above_16_mb(spark):
    import numpy as np

    rng = np.random.default_rng(10)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz012345", np.uint8)
    random_text = lambda n: letters[rng.integers(0, 32, n)].tobytes().decode()
    passages = [random_text(101) for _ in range(60)]
    large = random_text(16_900_000)
    for k, p in enumerate(passages):
        at = 16_500_000 - k * 200_000
        large = large[:at] + p + large[at:]
    rows = [(1, " ".join(passages)), (2, large)]
    got = {r.doc_id: r for r in repeats.removed_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[2].n_spans == 60 and 60 * 101 <= got[2].n_removed <= 60 * 105
