import random

from logspark.llm import decontamination as dc
from logspark.llm.words import alphanumeric


def brute(words, items, window):
    hit, named = set(), set()
    for name, item in items:
        k = min(window, len(item))
        grams = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                named.add(name)
    return hit, named


def test_automaton_agrees_with_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        word = lambda: rng.choice([b"a", b"b", b"c"])
        items = [(n, [word() for _ in range(rng.randint(0, 9))]) for n in range(rng.randint(0, 6))]
        words = [rng.choice([b"a", b"b", b"c", b"zz"]) for _ in range(rng.randint(0, 40))]
        spans, named = dc.ItemAutomaton(items, 4).scan(words)
        hit, want = brute(words, items, 4)
        assert {i for s, e in spans for i in range(s, e)} == hit and named == want


def frames(spark):
    bench = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short item here"), (3, None), (4, ""),
             (None, "alpha beta gamma delta"), (1, "one two three four five six seven eight nine ten eleven")]
    docs = [(1, "X One, two three FOUR five six seven eight nine ten! tail words stay here for sure and more of them", 1), (2, None, 2), (3, "", 3),
            (4, "a short-item here b", 4), (None, "alpha beta gamma delta", 5), (6, "nothing to see", 6), (6, "nothing to see", 6)]
    return (spark.createDataFrame(docs, "doc_id long, text string, found int"),
            spark.createDataFrame(bench, "item_id long, text string"))


def test_odd_rows_and_parts(spark):
    docs, bench = frames(spark)
    whole = sorted(map(str, dc.matches(docs, bench, name="m").select("doc_id", "found", "m.n_words", "m.n_hit", "m.items", "m.n_items").collect()))
    parts = sorted(map(str, dc.matches(docs, bench, most_words=3, name="m").select("doc_id", "found", "m.n_words", "m.n_hit", "m.items", "m.n_items").collect()))
    assert whole == parts
    got = {(r.doc_id, r.m.n_words, r.m.n_hit, r.m["items"], r.m.n_items) for r in dc.matches(docs, bench, name="m").collect()}
    assert got == {(1, 21, 10, "1", 1), (2, 0, 0, "", 0), (3, 0, 0, "", 0), (4, 5, 3, "2", 1), (None, 4, 4, "", 0), (6, 3, 0, "", 0)}
    assert dc.matches(docs.limit(0), bench.limit(0), name="m").count() == 0


def test_cleaning_removes_spans_and_covered_documents(spark):
    docs, bench = frames(spark)
    out = dc.clean(docs, bench)
    assert out.columns == docs.columns
    texts = sorted(str((r.doc_id, r.text)) for r in out.collect())
    assert texts == sorted(map(str, [(1, "X ! tail words stay here for sure and more of them"), (2, None), (3, ""),
                                     (6, "nothing to see"), (6, "nothing to see")]))


def test_removal_that_joins_a_new_window_is_removed_again(spark):
    bench = spark.createDataFrame([(1, "a b c"), (2, "p q")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a p q b c 1 2 3 4 5 6 7 8 9")], "doc_id long, text string")
    assert [alphanumeric(r.text) for r in dc.clean(docs, bench).collect()] == [[b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"]]


def test_passes_are_fetched_one_at_a_time(spark, monkeypatch):
    _, bench = frames(spark)
    passes = dc.item_passes(bench, 10, 3, 1, "item_id", "text")
    fetched, collect = [], type(bench).collect
    monkeypatch.setattr(type(bench), "collect", lambda df: fetched.append(collect(df)) or fetched[-1])
    names, words = [], set()
    for k, automata in enumerate(passes, 1):
        assert len(fetched) == k and len(automata) == 1
        automaton = dc.ItemAutomaton.opened(automata[0])
        names += automaton.names
        words |= set(automaton.number)
    assert k == len(passes) > 1
    items = {(r.item_id, r.text) for r in collect(bench) if r.text is not None}
    assert sorted(map(str, names)) == sorted(str(i) for i, _ in items)
    assert words == {w for _, text in items for w in alphanumeric(text)}


def test_many_passes_agree_with_one(spark):
    """Items over all passes, repeated and empty texts, windows that removals join across parts, ids with commas."""
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    bench = spark.createDataFrame([(f"i,{n}" if n % 3 else None, text(rng.randint(1, 7))) for n in range(60)], "item_id string, text string")
    texts = [text(rng.randint(0, 40)).replace("e", "zz").replace("f", "q1") for _ in range(150)] + [None, None, "", "zz", "zz"]
    docs = spark.createDataFrame([(n, t, 1, "s", "n") for n, t in enumerate(texts)], "doc_id long, text string, key int, spans string, names string")
    one, many = dict(window=5), dict(window=5, most_words=20, most_bytes=2500)
    assert len(dc.item_passes(bench, 5, 20, 2500, "item_id", "text")) > 3
    a, b = (sorted(map(str, dc.matches(docs, bench, **x).collect())) for x in (one, many))
    assert a == b
    items = [(r.item_id, alphanumeric(r.text)) for r in bench.collect()]
    for r in dc.matches(docs, bench, **many).collect():
        hit, named = brute(alphanumeric(r.text), items, 5)
        assert (r.found.n_hit, r.found.n_items) == (len(hit), len(named - {None}))
    a, b = (dc.clean(docs, bench, coverage=0.7, **x) for x in (one, many))
    assert a.columns == b.columns == docs.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert 0 < a.count() < docs.count()


def test_a_pass_writes_only_hits(spark):
    docs, bench = frames(spark)
    passes = dc.item_passes(bench, 10, 3, 1, "item_id", "text")
    hits = dc.hits_of(docs.selectExpr("cast(doc_id AS string) AS key", "text"), passes)
    assert hits.columns == ["key", "spans", "names"]
    assert {(r.key, r.spans) for r in hits.collect()} == {("1", "1:11"), ("4", "1:4"), (None, "0:4")}
