"""Licence scans against plain loops over words and a recursive evaluation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logspark.llm import licenses as lic
from logspark.llm.queries import QUERIES


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def brute_value(tokens):
    """Recursive descent over well-formed tokens."""
    def alternative(at):
        value, at = both(at)
        while at < len(tokens) and tokens[at].lower() == "or":
            right, at = both(at + 1)
            value = max(value, right)
        return value, at

    def both(at):
        value, at = single(at)
        while at < len(tokens) and tokens[at].lower() == "and":
            right, at = single(at + 1)
            value = min(value, right)
        return value, at

    def single(at):
        if tokens[at] == "(":
            value, at = alternative(at + 1)
            return value, at + 1
        value = lic.FREEDOM.get(lic.family_of(tokens[at]), lic.UNKNOWN_FREEDOM)
        if at + 1 < len(tokens) and tokens[at + 1].lower() == "with":
            return max(value, lic.EXCEPTION_FREEDOM), at + 3
        return value, at + 1

    return alternative(0)[0]


def brute(text):
    """Row without statements; tags only where a colon follows."""
    words = words_of(text)
    base = sorted((i, label) for p, label in lic.BASE_PHRASES.items() for i in places(words, p))
    labels = {f for p, f in lic.NOTICES.items() if places(words, p)}
    spans = [(i, i + len(p.split()), f) for p, f in lic.NOTICES.items() for i in places(words, p)]
    least = [
        lic.FREEDOM[f] for a, b, f in spans
        if not any(x <= a and b <= y and (x, y) != (a, b) for x, y, _ in spans)
    ]
    for m in re.finditer(r"(?i)(?<![a-z0-9])(?:spdx-license-identifier|license-expression)[ \t]*:", text or ""):
        line = re.match(r"[ \t()A-Za-z0-9.:+-]*", text[m.end():])[0]
        tokens = re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.:+-]*", line)
        if tokens:
            least.append(brute_value(tokens))
            before = ""
            for t in tokens:
                if t.lower() not in ("and", "or", "with", "(", ")"):
                    labels.add(t.lower() if before == "with" else lic.family_of(t))
                before = t.lower()
    starts = [i for i, _ in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), min(least, default=0.0))


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rnd = random.Random(seed)
    ids = ["MIT", "Apache-2.0", "GPL-3.0-or-later", "LGPL-2.1+", "CC-BY-NC-4.0", "Strange-1.0", "BSD-3-Clause"]

    def expression(depth=0):
        kind = rnd.random()
        if depth > 2 or kind < 0.4:
            return rnd.choice(ids)
        if kind < 0.55:
            return f"{rnd.choice(ids)} WITH Classpath-exception-2.0"
        pair = f"{expression(depth + 1)} {rnd.choice(['AND', 'OR', 'or'])} {expression(depth + 1)}"
        return f"({pair})" if rnd.random() < 0.5 else pair

    def piece():
        kind = rnd.random()
        if kind < 0.2:
            return f"\n// SPDX-License-Identifier: {expression()}\n"
        if kind < 0.5:
            return rnd.choice(list(lic.NOTICES)).replace(" ", rnd.choice([" ", " - ", ", ", "\n"])).title()
        return rnd.choice(["mit", "license", "License", "été", "the", "apache", "general", "public", "x" * 50, "--", "mit-license"])

    rows = [(i, " ".join(piece() for _ in range(rnd.randrange(12)))) for i in range(300)]
    got = lic.licensed(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "licences.*").collect()
    for r in got:
        assert tuple(r)[1:8] == brute(rows[r.doc_id][1]), rows[r.doc_id]


def test_precedence_and_broken_expressions():
    value = lambda text: (lic.evaluate(lic.tokens_at(text.encode(), 0)[0]) or (None,))[0]
    assert value("GPL-3.0 OR MIT AND AGPL-3.0") == 0.4
    assert value("(GPL-3.0 OR MIT) AND AGPL-3.0") == 0.2
    assert value("GPL-2.0 WITH Classpath-exception-2.0 AND MIT") == lic.EXCEPTION_FREEDOM
    assert value("MIT OR") == 1.0 and value("(MIT OR GPL-2.0") == 1.0 and value("MIT) AND GPL-2.0") == 1.0
    assert value("MIT the rest") == 1.0 and value("") is None and value("OR MIT") is None and value("((") is None
    assert [lic.family_of(i) for i in ("GPL-3.0-only", "LGPL-2.1+", "CC-BY-NC-4.0", "Foo-1", "BSD-3-Clause")] == [
        "gpl", "lgpl", "cc-by-nc", "foo-1", "bsd"]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "MIT License"), (None, "MIT License"), (3, "SPDX-License-Identifier:"), (4, "mit-licenseé MIT,License!"),
            (5, "w " * 200_000 + "apache license"), (6, "(* SPDX-License-Identifier: MIT *)")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(7)).withColumn("statements", F.lit(1))
    out = lic.licensed(df)
    got = out.collect()
    assert len(got) == len(rows) and {r.score for r in got} == {7}
    for r in got:
        assert tuple(r.licences)[:7] == brute(r.text)
    by_id = {r.doc_id: r.licences for r in got}
    assert by_id[5].first_word == 200_000 and by_id[6].labels == "mit" and by_id[6].statements[0].expression == "MIT"
    assert by_id[4].n_base == 1 and by_id[4].first_word == 2
    assert lic.licensed(df.limit(0)).count() == 0


def test_query_on_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op11_license_scan"](spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:] == brute(docs[r.doc_id])
