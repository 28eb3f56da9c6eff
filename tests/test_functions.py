import random

import pytest
from pyspark.sql import functions as F

from logspark.functions import access, levels, masking, numbers, paths, text
from logspark.sources import lookups


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r.out for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_level_names(spark):
    given = ["warn", "WARNING", "err", "severe", "critical", "finest", "fine", "junk", None, " Error "]
    want = ["WARN", "WARN", "ERROR", "ERROR", "FATAL", "TRACE", "DEBUG", "INFO", "INFO", "ERROR"]
    assert one(spark, given, levels.canonical_level) == want


def test_masks(spark):
    given = {
        "call 13812345678 now": "call 138****5678 now",
        "x913812345678": "x913812345678",
        "id 11010519491231002X.": "id 110***********002X.",
        "user@example.com": "u***@example.com",
        "a@b.com": "a@b.com",
        "6222021234567890123": "6222 **** **** 0123",
        "4111111111111": "4111 **** **** 1111",
        "12345678901234567890": "12345678901234567890",
        "from 192.168.1.20:80": "from *.*.*.*:80",
    }
    assert one(spark, list(given), masking.mask_text) == list(given.values())


def test_mask_user_name(spark):
    assert one(spark, ["张三", "Li", "X", "", None], masking.mask_user_name) == ["张**", "L**", "X", "", None]


@pytest.mark.parametrize("value,want", [(1.005, 1.0), (2.345, 2.35), (0.125, 0.13), (-0.125, -0.12)])
def test_round_half_up(spark, value, want):
    assert one(spark, [value], numbers.round_half_up, "double") == [pytest.approx(want)]


def test_growth(spark):
    df = spark.createDataFrame([(5, 0), (0, 0), (15, 10), (5, 10), (3, None)], "a INT, b INT")
    got = [r[0] for r in df.select(numbers.growth_rate(F.col("a"), F.col("b"))).collect()]
    assert got == [100.0, 0.0, 50.0, -50.0, 100.0]


def test_message_hygiene(spark):
    long = "x" * 10_001
    given = ["<SCRIPT>a</Script>", "javascript:go", '<img OnError = "x">', None, long]
    want = ["&lt;script>a&lt;/script&gt;", "go", '<img  "x">', "", "x" * 10_000 + "...[truncated]"]
    assert one(spark, given, text.clean_message) == want


def test_exception_text(spark):
    stack = "a.b.OrderException: no: really\n\tat x\nCaused by: c.IoException: y\nCaused by: d.E\n"
    assert one(spark, [stack, "Plain", "", None], text.exception_class) == ["a.b.OrderException", "Plain", None, None]
    assert one(spark, [stack], text.cause_classes) == [["c.IoException", "d.E"]]
    given = ["java.lang.NullPointerException", "Error", "", None, "Exception"]
    assert one(spark, given, text.exception_short_name) == ["NullPointer", "Error", "未知异常", "未知异常", ""]


def test_fuzzy_words(spark):
    given = ["payment failed", "paymnt", "pay", "PAYMENTS ok", "pent"]
    assert one(spark, given, lambda c: text.matches_fuzzy(c, ["payment"])) == [True, True, False, True, False]
    assert one(spark, ["id", "ie"], lambda c: text.matches_fuzzy(c, ["id"])) == [True, False]


def swap_distance(a, b):
    """Edits between two words, a swap of two neighbours being one; no letter is edited twice."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def edited(rnd, word):
    letters = list(word)
    for _ in range(rnd.randrange(4)):
        at = rnd.randrange(len(letters) + 1)
        kind = rnd.randrange(4)
        if kind == 0:
            letters.insert(at, rnd.choice("abcé1"))
        elif letters and at < len(letters):
            if kind == 1:
                letters.pop(at)
            elif kind == 2:
                letters[at] = rnd.choice("abcé1")
            elif at:
                letters[at - 1 : at + 1] = reversed(letters[at - 1 : at + 1])
    return "".join(letters)


def test_near_words_by_deletions(spark):
    """The dictionary finds exactly the words within the allowed distance, edits beyond the indexed start included."""
    rnd = random.Random(4)
    terms = ["id", "pay", "order", "payment", "purchase", "internationalise"]
    words = sorted({edited(rnd, rnd.choice(terms)) for _ in range(1500)} - {""})
    df = spark.createDataFrame([(w,) for w in words], "word STRING")
    listed = {r.word: sorted(r.d) for r in df.select("word", text.deletions_of(F.col("word")).alias("d")).collect()}
    assert all(listed[w] == text.deletions(w) for w in words)
    near = df.withColumn("deletion", F.explode(text.deletions_of(F.col("word")))).cache()
    for term in terms:
        got = {r.word for r in lookups.near_words(near, [term]).collect()}
        k = text.fuzziness(term)
        # a letter may be edited again after a swap
        near_by = lambda w: swap_distance(w, term) <= k or k and any(swap_distance(w, other) < k for other in text.swaps(term))
        assert got == {w for w in words if near_by(w)}, term
        assert len(got) > 2 or term == "id"


def test_access_rules(spark):
    df = spark.createDataFrame([(500, 1), (404, 9000), (200, 5001), (200, 5000)], "s INT, r INT")
    got = df.select(
        access.access_level(F.col("s"), F.col("r")).alias("l"), access.access_tags(F.col("s"), F.col("r")).alias("t")
    ).collect()
    assert [g.l for g in got] == ["ERROR", "WARN", "WARN", "INFO"]
    assert [g.t for g in got] == [
        ["gateway", "server-error"], ["gateway", "slow-request", "client-error"], ["gateway", "slow-request"], ["gateway"],
    ]


def test_excluded_paths(spark):
    given = ["/health/live", "/api", "/exact", "/exact/more", None]
    assert one(spark, given, lambda c: access.is_excluded(c, ("/exact",))) == [True, False, True, False, False]


def test_client_ip(spark):
    df = spark.createDataFrame(
        [("1.1.1.1 , 2.2.2.2", "3.3.3.3"), ("unknown", "3.3.3.3"), ("", None), (None, None)], "a STRING, b STRING"
    )
    got = [r[0] for r in df.select(access.client_ip([F.col("a"), F.col("b")], F.lit(None).cast("string"))).collect()]
    assert got == ["1.1.1.1", "3.3.3.3", "unknown", "unknown"]


def test_longest_prefix_wins(spark):
    prefixes = {"com.a": "A", "com.a.b": "B"}
    given = ["com.a.X", "com.a.b.Y", "org.Z", "com.a.Main"]
    got = one(spark, given, lambda c: access.module_of(c, {"com.a.Main": "M"}, prefixes, "default"))
    assert got == ["A", "B", "default", "M"]


def test_paths_into_extra(spark):
    extra = '{"order": {"items": [{"price": 7.5}, {"price": "8"}], "n": null}, "list": [1, "two"], "s": "5"}'
    df = spark.createDataFrame([(extra, ["x", "y"], 12)], "extra STRING, tags ARRAY<STRING>, response_time BIGINT")
    paths_ = ["extra.order.items[0].price", "extra.order.items[1].price", "extra.order.items[9].price",
              "extra.list[1]", "extra.s", "tags[1]", "responseTime", "nowhere"]
    row = df.select(*[paths.text_at(p).alias(f"t{i}") for i, p in enumerate(paths_)],
                    *[paths.number_at(p).alias(f"n{i}") for i, p in enumerate(paths_)]).first()
    assert [row[f"t{i}"] for i in range(8)] == ["7.5", "8", None, "two", "5", "y", "12", None]
    assert [row[f"n{i}"] for i in range(8)] == [7.5, None, None, None, None, None, 12.0, None]
    found = df.select(*[paths.exists_at(p).alias(f"e{i}") for i, p in enumerate(["extra.order.n", "extra.order.q", "tags[2]"])]).first()
    assert list(found) == [True, False, False]


def test_masked_api_key(spark):
    (shown,) = one(spark, ["sk_test_key_001"], masking.mask_api_key)
    assert shown.startswith("sk_****") and len(shown) == 15


def test_swapped_letters_count_as_one_edit(spark):
    words = ["usre", "user", "ures", "uesrx", "recieve", "rceieve", "rceievex", "uxxr"]
    near = lambda term: [w for w, ok in zip(words, one(spark, words, lambda c: text.matches_fuzzy(c, [term]))) if ok]
    assert near("user") == ["usre", "user"]
    assert near("receive") == ["recieve", "rceieve"]
