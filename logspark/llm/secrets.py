"""Secret scans: base patterns, and probabilistic automata inferred from the credentials that they find.

The base patterns mark credentials whose form is known. Those found in the corpus are labelled examples: of each
kind a bounded number of distinct ones (smallest hashes first, whole values) becomes a prefix tree with counts, whose
states are merged where their futures are statistically compatible (Hoeffding bound, merging in breadth-first order and
folding the successors). The result is a probabilistic automaton of the credential format. Then all candidates are
scored: every run of credential characters, in every text, that is as long as the shortest labelled example. A run that
is as likely per character as held-out labelled credentials are, and likelier than as a plain run, is added as a span
of kind "format". Plain runs are all those that fit no format: how often which character follows which two is counted
over all distinct ones. A run that base spans cover in part is judged whole, and if it is no secret, by the parts that
are left. Base spans always stay.

Nulls and empty texts have no spans. Repeated rows are judged alike. Extra columns pass through. With no labelled
credentials nothing is added.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logspark.llm.frames import stored

KINDS = ("assign", "access", "hex", "format")
# The pattern of the contract; keywords count in either case, so matching is ASCII-only and case-insensitive.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
KEYWORDS = ("passw", "secret", "token", "api")
# a maximal run that is too short fails whole, so the lengths can stand in the patterns
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: The shortest value that a base pattern labels.
SHORTEST = 12

Span = tuple[int, int, int]


def base_spans(text: str | None) -> list[Span]:
    """(start, kind, end) of the base patterns, in order of start and kind."""
    if not text:
        return []
    out: list[Span] = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def secret_of(text: str, span: Span) -> str:
    start, kind, end = span
    return ASSIGN.match(text, start, end)[2] if kind == 0 else text[start:end]


def candidates(text: str | None, base: list[Span], least: int = SHORTEST) -> list[list[tuple[int, int]]]:
    """Runs of credential characters of a length from ``least`` on, each as the stretches to judge: the whole run, then
    what base spans leave of it. Runs inside a base span have none."""
    out, at = [], 0
    for m in RUN.finditer(text or ""):
        start, end = m.span()
        while at < len(base) and base[at][2] <= start:
            at += 1
        if end - start < least:
            continue
        left, place, k = [], start, at
        while k < len(base) and base[k][0] < end:
            left.append((place, base[k][0]))
            place = max(place, base[k][2])
            k += 1
        left = [(s, e) for s, e in [*left, (place, end)] if e > s]
        if left:
            out.append([(start, end), *[(s, e) for s, e in left if e - s >= least and e - s < end - start]])
    return out


class Automaton:
    """A probabilistic automaton merged from the prefix tree of sample strings."""

    def __init__(self, samples: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends = [0]
        for text in samples:
            state = 0
            for c in text:
                self.count[state][c] = self.count[state].get(c, 0) + 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                state = self.next[state][c]
            self.ends[state] += 1
        self.factor = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def arrays(self) -> tuple[list, list, list]:
        """The automaton as plain lists, to be sent."""
        return self.next, self.count, self.ends

    @classmethod
    def of(cls, arrays: tuple[list, list, list]) -> "Automaton":
        out = cls.__new__(cls)
        out.next, out.count, out.ends = arrays
        return out

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.count[q].values())

    def _apart(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.factor * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            n1, n2 = self._total(a), self._total(b)
            if not n1 or not n2:
                continue
            if self._apart(self.ends[a], n1, self.ends[b], n2):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._apart(self.count[a].get(c, 0), n1, self.count[b].get(c, 0), n2):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, kept: int, gone: int) -> None:
        todo = [(kept, gone)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def _merge(self) -> None:
        red = [0]
        blue = [(0, c) for c in sorted(self.next[0])]
        while blue:
            parent, c = blue.pop(0)
            state = self.next[parent][c]
            if state in red:
                continue
            for q in red:
                if self._compatible(q, state):
                    self.next[parent][c] = q
                    self._fold(q, state)
                    blue += [(q, x) for x in sorted(self.next[q]) if self.next[q][x] not in red and (q, x) not in blue]
                    break
            else:
                red.append(state)
                blue += [(state, x) for x in sorted(self.next[state])]

    def score(self, text: str) -> float:
        """Log-likelihood per character, the end included; unseen steps are smoothed and lead to the start."""
        state, total = 0, 0.0
        for c in text:
            n = self._total(state)
            total += math.log((self.count[state].get(c, 0) + 0.01) / (n + 0.67))
            state = self.next[state].get(c, 0)
        total += math.log((self.ends[state] + 0.01) / (self._total(state) + 0.67))
        return total / (len(text) + 1)


class PlainRuns:
    """How often which character follows which two in plain runs; ends count as a character."""

    def __init__(self, counts: dict[str, int]):
        self.counts, self.totals = counts, {}
        for three, n in counts.items():
            self.totals[three[:2]] = self.totals.get(three[:2], 0) + n

    @staticmethod
    def steps(run: str) -> list[str]:
        framed = f"  {run} "
        return [framed[i : i + 3] for i in range(len(run) + 1)]

    def score(self, run: str) -> float:
        steps = self.steps(run)
        return sum(math.log((self.counts.get(s, 0) + 0.01) / (self.totals.get(s[:2], 0) + 0.67)) for s in steps) / len(steps)


class Formats:
    """Automata with the least score that held-out credentials of the format reach, and the counts of plain runs."""

    def __init__(self, automata: list[tuple[Automaton, float]], plain: PlainRuns | None, least: int):
        self.automata, self.plain, self.least = automata, plain, least

    @classmethod
    def learn(cls, labelled: dict[str, list[str]], quantile: float = 0.02) -> "Formats":
        automata = []
        for kind in sorted(labelled):
            # in the order of their hashes: neighbours in alphabetic order would share prefixes with what was learned
            learn, held = labelled[kind][::2], labelled[kind][1::2]
            if len(learn) >= 8 and held:
                model = Automaton(learn)
                scores = sorted(model.score(t) for t in held)
                automata.append((model, scores[int(quantile * (len(scores) - 1))]))
        return cls(automata, None, min((len(t) for texts in labelled.values() for t in texts), default=SHORTEST))

    def arrays(self) -> tuple:
        """All of it as plain numbers, texts, lists and dicts, so that tasks need no copy of this package to read it."""
        return [(m.arrays(), least) for m, least in self.automata], self.plain and self.plain.counts, self.least

    @classmethod
    def of(cls, arrays: tuple) -> "Formats":
        automata, plain, least = arrays
        return cls([(Automaton.of(a), s) for a, s in automata], PlainRuns(plain) if plain else None, least)

    def fit(self, text: str) -> float | None:
        """The best score among the formats that the text fits."""
        return max((s for s, least in ((m.score(text), least) for m, least in self.automata) if s >= least), default=None)

    def is_secret(self, text: str) -> bool:
        best = self.fit(text)
        return best is not None and (self.plain is None or best > self.plain.score(text))


def scan(docs: DataFrame, text_col: str = "text", samples: int = 600, name: str = "secrets") -> DataFrame:
    """The documents with a struct: n_assign, n_access, n_hex, n_format, base, spans.

    base and spans list kind:start:end in code points. samples bounds the labelled credentials of each kind that the
    automata are learned from.
    """
    formats = learn(docs, text_col, samples)
    broadcast = docs.sparkSession.sparkContext.broadcast(formats.arrays())
    schema = "n_assign bigint, n_access bigint, n_hex bigint, n_format bigint, base string, spans string"
    return docs.withColumn(name, F.pandas_udf(_finder(broadcast), schema)(F.col(text_col)))


def learn(docs: DataFrame, text_col: str, samples: int, characters: int = 200_000) -> Formats:
    """Formats of the labelled credentials; of each kind at most so many, with at most so many characters together."""
    found = stored(
        docs.select(F.col(text_col).alias("text")).mapInPandas(_examples, "kind string, secret string")
        .groupBy("kind", "secret").count().select("kind", "secret")
    )
    order = F.xxhash64("secret"), F.col("secret")
    labelled = {}
    for kind in KINDS[:3]:
        fits = found.where((F.col("kind") == kind) & (F.length("secret") <= characters // 8)).orderBy(*order).limit(samples)
        labelled[kind], room = [], characters
        for secret in (r.secret for r in fits.toLocalIterator()):
            if len(secret) <= room:
                labelled[kind].append(secret)
                room -= len(secret)
    formats = Formats.learn(labelled)
    if formats.automata:
        sent = docs.sparkSession.sparkContext.broadcast(formats.arrays())
        steps = found.where("kind = 'plain'").select("secret").mapInPandas(_plain_steps(sent), "step string, n bigint")
        # as many rows as there are triples of credential characters
        counts = {r.step: r.n for r in steps.groupBy("step").agg(F.sum("n").alias("n")).collect()}
        formats.plain = PlainRuns(counts) if counts else None
    return formats


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = set()
        for text in batch["text"].array:
            if isinstance(text, str):
                base = base_spans(text)
                out.update((KINDS[span[1]], secret_of(text, span)) for span in base)
                out.update(("plain", text[s:e]) for [(s, e), *_] in candidates(text, base) if not any(b < e and s < d for b, _, d in base))
        yield pd.DataFrame(sorted(out), columns=["kind", "secret"])


def _plain_steps(formats):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Formats.of(formats.value)
        for batch in batches:
            steps = Counter(
                step for run in batch["secret"].array if len(run) >= model.least and model.fit(run) is None for step in PlainRuns.steps(run)
            )
            yield pd.DataFrame(list(steps.items()), columns=["step", "n"]).astype({"step": object, "n": "int64"})

    return count


def named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


class Finder:
    """Base spans and added spans of texts; remembers the runs it has judged, up to a bound."""

    def __init__(self, formats: Formats):
        self.formats, self.known = formats, {}

    def is_secret(self, run: str) -> bool:
        if run not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[run] = self.formats.is_secret(run)
        return self.known[run]

    def __call__(self, text: str) -> tuple[list[Span], list[Span]]:
        base, more = base_spans(text), []
        if self.formats.automata:
            for [(start, end), *rest] in candidates(text, base, self.formats.least):
                if self.is_secret(text[start:end]):
                    more.append((start, 3, end))
                else:
                    more += [(s, 3, e) for s, e in rest if self.is_secret(text[s:e])]
        return base, more


def _finder(formats):
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = Finder(Formats.of(formats.value))
        for texts in parts:
            out = []
            for text in texts.array:
                base, more = finder(text if isinstance(text, str) else "")
                n = [sum(s[1] == k for s in base) for k in range(3)]
                out.append((*n, len(more), named(base), named(base + more)))
            yield pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "n_format", "base", "spans"])

    return find


def redact(docs: DataFrame, text_col: str = "text", mark: str = "<SECRET>", samples: int = 600) -> DataFrame:
    """The documents with the secret values replaced; texts without secrets stay as they are."""
    formats = docs.sparkSession.sparkContext.broadcast(learn(docs, text_col, samples).arrays())

    def replace(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(Formats.of(formats.value))
        for texts in parts:
            out = []
            for text in texts.array:
                spans = sum(finder(text), []) if isinstance(text, str) else []
                out.append(redacted(text, spans, mark) if spans else None)
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text_col, F.coalesce(F.pandas_udf(replace, "string")(F.col(text_col)), F.col(text_col)))


def redacted(text: str, spans: list[Span], mark: str) -> str:
    values = [ASSIGN.match(text, s, e).span(2) if kind == 0 else (s, e) for s, kind, e in spans]
    out, at = [], 0
    for start, end in sorted(values):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]
