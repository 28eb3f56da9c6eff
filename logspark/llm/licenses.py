"""Licence scans: notices and identifier tags found by an Aho-Corasick automaton, expressions evaluated.

A text is lower-cased (A-Z) and cut into words of digits, letters and anything outside ASCII. One automaton holds the
word sequences of all notices ("mit license", "gnu general public license version 3") and of the tags that announce
an expression ("SPDX-License-Identifier:"), and passes over the whole text once. Behind a tag, the expression is read
from the text itself up to the end of its line and evaluated by a shunting-yard parser: WITH binds before AND, AND
before OR. Every licence family has a freedom from 0 to 1; OR takes the freest side, AND the least free one, and an
exception frees its licence to EXCEPTION_FREEDOM at least. Statements of one document all bind, so its score is the
least freedom among them.

Results of odd rows: a null or empty text has no words, no statement, empty labels and score 0, as has any text
without a statement. Notices may overlap; all places count, but a notice inside a longer one makes no statement of
its own. A tag without a readable expression is no statement. A broken expression counts as far as it reads: operators
without a right side and brackets without a partner are left out. Unknown identifiers are labels of their own
with UNKNOWN_FREEDOM. Repeated rows are rows; extra columns pass through.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logspark.llm.frames import exact
from logspark.llm.words import ALNUM

#: The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: How freely texts under a licence family may be used.
FREEDOM = {
    "mit": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0, "0bsd": 1.0,
    "apache": 0.9, "cc-by": 0.9, "mpl": 0.7, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.2,
    "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nd": 0.2, "cc-by-nc-nd": 0.1, "proprietary": 0.1,
}
UNKNOWN_FREEDOM = 0.3
EXCEPTION_FREEDOM = 0.6

#: Notices besides the base phrases, as words, with the family that they name.
NOTICES = {
    **BASE_PHRASES,
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license version 2 0": "apache",
    "gnu general public license": "gpl",
    "gnu gpl": "gpl",
    "lesser general public license": "lgpl",
    "gnu lesser general public license": "lgpl",
    "gnu lgpl": "lgpl",
    "affero general public license": "agpl",
    "gnu affero general public license": "agpl",
    "gnu agpl": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
    "cc0": "cc0",
    "creative commons zero": "cc0",
}
_CLAUSES = {"nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
for _parts in ((), ("sa",), ("nd",), ("nc",), ("nc", "sa"), ("nc", "nd")):
    _family = "-".join(("cc-by", *_parts))
    NOTICES[" ".join(("cc by", *_parts))] = _family
    NOTICES[" ".join(("creative commons attribution", *(_CLAUSES[p] for p in _parts)))] = _family

#: Words of a tag that announces an expression behind a colon.
TAGS = ("spdx license identifier", "license expression")

FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "statements")
FOUND = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "statements array<struct<word: bigint, kind: string, expression: string, freedom: double>>"
)

_VERSION = re.compile(r"-?v?[0-9][0-9.]*(-only|-or-later|-clause.*)?$")
_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.:+-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def family_of(identifier: str) -> str:
    """The family of a licence identifier: without version, with the longest known name in front; else itself."""
    name = identifier.lower().rstrip("+")
    short = _VERSION.sub("", name)
    for known in (short, name):
        while known:
            if known in FREEDOM:
                return known
            known = known.rpartition("-")[0]
    return name


def tokens_at(data: bytes, start: int) -> tuple[list[str], int]:
    """Tokens of the expression at a place, and where it ends. Stops where no expression can go on."""
    out, depth, operand_next = [], 0, True
    while found := _TOKEN.match(data, start):
        token = found[1].decode("ascii")
        operator = token.lower() in _BINDS
        if token == "(":
            fits, depth = operand_next, depth + 1
        elif token == ")":
            fits, depth = not operand_next and depth > 0, depth - 1
        else:
            fits = operator != operand_next
            operand_next = operator
        if not fits:
            break
        out.append(token)
        start = found.end()
    return out, start


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operands in order, each operator behind its two sides."""
    out: list[str] = []
    waiting: list[str] = []
    for token in tokens:
        name = token.lower()
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if waiting:
                waiting.pop()
        elif name in _BINDS:
            while waiting and _BINDS.get(waiting[-1], 0) >= _BINDS[name]:
                out.append(waiting.pop())
            waiting.append(name)
        else:
            out.append(token)
    return out + [t for t in reversed(waiting) if t != "("]


def evaluate(tokens: list[str]) -> tuple[float, set[str]] | None:
    """Freedom of an expression and the families that it names; None for no expression."""
    stack: list[tuple[float, set[str], str]] = []
    for token in postfix(tokens):
        if token not in _BINDS:
            family = family_of(token)
            stack.append((FREEDOM.get(family, UNKNOWN_FREEDOM), {family}, token.lower()))
            continue
        if len(stack) < 2:
            continue  # an operator without a right side
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((max(left[0], EXCEPTION_FREEDOM), left[1] | {right[2]}, left[2]))
        else:
            pick = max if token == "or" else min
            stack.append((pick(left[0], right[0]), left[1] | right[1], ""))
    return (stack[0][0], stack[0][1]) if stack else None


def automaton():
    """All notices and tags, each between spaces, so that whole words match."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase, family in NOTICES.items():
        out.add_word(f" {phrase} ", (phrase, family))
    for tag in TAGS:
        out.add_word(f" {tag} ", (tag, None))
    out.make_automaton()
    return out


def scan(text: str | None, finder) -> tuple:
    """One row of FOUND for a text."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    plain = data.translate(ALNUM)
    words = plain.split()
    n_words = len(words)
    spaced = b" %b " % b" ".join(words)
    del words
    hits = [(end + 1 - len(p) - 2, p, family) for end, (p, family) in finder.iter(spaced.decode("latin-1"))]
    if not hits:
        return (n_words, 0, None, None, "", "", 0.0, [])
    place = np.cumsum(np.frombuffer(spaced, np.uint8) == 32) - 1  # number of the word behind a space
    found = sorted((int(place[start]), phrase, family) for start, phrase, family in hits)
    base = [(word, BASE_PHRASES[phrase]) for word, phrase, _ in found if phrase in BASE_PHRASES]
    statements, labels = [], {family for _, _, family in found if family}
    reach = -1  # the last word of the notices so far
    for word, phrase, family in sorted(found, key=lambda f: (f[0], -len(f[1].split()))):
        last = word + len(phrase.split()) - 1
        if family and last > reach:
            reach = last
            statements.append((word, "notice", phrase, FREEDOM[family]))
    tags = [(word, phrase) for word, phrase, family in found if family is None]
    if tags:
        ends = _word_ends(plain, [word + len(phrase.split()) - 1 for word, phrase in tags])
        for (word, _), end in zip(tags, ends):
            colon = re.compile(rb"[ \t]*:").match(data, end)
            tokens, _ = tokens_at(data, colon.end()) if colon else ([], 0)
            value = evaluate(tokens)
            if value:
                labels |= value[1]
                statements.append((word, "tag", " ".join(tokens), value[0]))
    starts = [word for word, _ in base]
    return (
        n_words, len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({label for _, label in base})), ",".join(sorted(labels)),
        min((s[3] for s in statements), default=0.0), sorted(statements),
    )


def _word_ends(plain: bytes, numbers: list[int]) -> list[int]:
    """Where the words of these numbers end in the bytes; numbers ascend."""
    out, wanted = [], iter(numbers)
    next_one = next(wanted, None)
    for n, found in enumerate(re.finditer(rb"[^ ]+", plain)):
        while next_one == n:
            out.append(found.end())
            next_one = next(wanted, None)
        if next_one is None:
            break
    return out


def licensed(docs: DataFrame, text_col: str = "text", name: str = "licences") -> DataFrame:
    """The documents with a struct: n_words, n_base, first_word, last_word, base_labels, labels, score, statements."""

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = automaton()
        names = ("word", "kind", "expression", "freedom")
        for texts in batches:
            rows = [scan(t if isinstance(t, str) else None, finder) for t in texts.array]
            rows = [(*row[:-1], [dict(zip(names, s)) for s in row[-1]]) for row in rows]
            yield exact(rows, list(FIELDS), "first_word", "last_word")

    return docs.withColumn(name, F.pandas_udf(find, FOUND)(F.col(f"`{text_col}`")))
