"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton holds every run of words of every item. A document's words stream through it; after each word the
state tells the longest run that ends here and occurs in an item. Where that run is at least a window long, the
window's words are hit, and the state names the items that contain it. An item shorter than a window counts as
one window of its own length.

The items are split into parts of bounded size, one automaton each, built in tasks and packed into arrays (some 60
bytes an item word). A pass over the documents takes as many automata as a stated number of bytes allows. A benchmark
that fits into one pass is a column of the documents. Beyond that, every pass reads the texts and writes only a digest,
the spans and the items of those that it hits; no text is written again, and at the end the hits join the documents
by the digest.

Nulls and empty texts have no words and no hits. An item with a null id hits words but is not listed. Repeated
items count once; repeated documents are judged alike. Extra columns pass through.
"""

import hashlib
import pickle
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logspark.llm.frames import stored, unused
from logspark.llm.words import ALNUM, alphanumeric

FOUND = "n_words bigint, n_hit bigint, spans string, items string, n_items bigint, items_sha256 string"


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items of each window, packed into arrays."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        n = len(self.next)
        # state in whose strings the suffix of window length lies, for states that are long enough
        at_window = [-1] * n
        listed: list[set] = [set() for _ in range(n)]
        short: list[list] = [[] for _ in range(n)]
        short_above = [-1] * n
        order = sorted(range(1, n), key=self.length.__getitem__)
        for v in order:
            if self.length[v] >= window:
                up = self.link[v]
                at_window[v] = v if self.length[up] < window else at_window[up]
        for k, (_, words) in enumerate(items):
            v = 0
            for i, word in enumerate(words):
                v = self.next[v][word]
                if i + 1 >= window:
                    listed[at_window[v]].add(k)
            if 0 < len(words) < window:
                short[v].append((len(words), k))
        for v in order:
            short_above[v] = v if short[v] else short_above[self.link[v]] if self.link[v] > 0 else -1

        # the root has a transition by every word
        words = sorted(self.next[0])
        number = {word: k for k, word in enumerate(words)}
        edges = [sorted((number[word], to) for word, to in row.items()) for row in self.next]
        packed = [
            _starts(edges), [k for row in edges for k, _ in row], [to for row in edges for _, to in row], self.link, self.length, at_window,
            _starts(listed), [k for row in listed for k in sorted(row)],
            _starts(short), [size for row in short for size, _ in row], [k for row in short for _, k in row], short_above,
        ]
        self._open(window, [name for name, _ in items], b" ".join(words), [array("i", x).tobytes() for x in packed])

    def _open(self, window: int, names: list, words: bytes, packed: list[bytes]) -> None:
        self.plain = window, names, words, packed
        self.window, self.names = window, names
        self.number = {word: k for k, word in enumerate(words.split(b" "))} if words else {}
        (self.first, self.labels, self.to, self.link, self.length, self.at_window, self.listed_first, self.listed,
         self.short_first, self.short_size, self.short_item, self.short_above) = (memoryview(x).cast("i") for x in packed)
        self.next = None

    @classmethod
    def opened(cls, plain: tuple) -> "ItemAutomaton":
        """The automaton of what `plain` holds: numbers, names and bytes alone, which any worker can read."""
        out = cls.__new__(cls)
        out._open(*plain)
        return out

    @property
    def size(self) -> int:
        """Bytes in memory, with some 150 for each different word."""
        return sum(map(len, self.plain[3])) + 150 * len(self.number) + 100 * len(self.names)

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        v = last
        while v != -1 and word not in self.next[v]:
            self.next[v][word] = state
            v = self.link[v]
        if v != -1:
            target = self.next[v][word]
            self.link[state] = target if self.length[target] == self.length[v] + 1 else self._split(v, word, target)
        return state

    def _split(self, v: int, word: bytes, target: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[target]))
        self.length.append(self.length[v] + 1)
        self.link.append(self.link[target])
        self.link[target] = copy
        while v != -1 and self.next[v].get(word) == target:
            self.next[v][word] = copy
            v = self.link[v]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges (start, end exclusive) inside windows, merged, and the items they come from."""
        first, labels, to, link, length, window, names = self.first, self.labels, self.to, self.link, self.length, self.window, self.names
        number, has_short = self.number, len(self.short_size) > 0
        v = run = 0
        hits: list[tuple[int, int]] = []
        items: set = set()
        for i, spelt in enumerate(words):
            word = number.get(spelt)
            if word is None:
                v = run = 0
                continue
            while v:
                low, high = first[v], first[v + 1]
                at = low if high - low == 1 else bisect_left(labels, word, low, high)
                if at < high and labels[at] == word:
                    break
                v = link[v]
                run = length[v]
            else:
                at = word
            v = to[at]
            run += 1
            if run >= window:
                hits.append((i - window + 1, i + 1))
                u = self.at_window[v]
                items.update(names[k] for k in self.listed[self.listed_first[u] : self.listed_first[u + 1]])
            if has_short:
                u = self.short_above[v]
                while u > 0:
                    for k in range(self.short_first[u], self.short_first[u + 1]):
                        if self.short_size[k] <= run:
                            hits.append((i - self.short_size[k] + 1, i + 1))
                            items.add(names[self.short_item[k]])
                    u = self.short_above[link[u]] if link[u] > 0 else -1
        return merged(hits), items


def _starts(rows: list) -> list[int]:
    out = [0]
    for row in rows:
        out.append(out[-1] + len(row))
    return out


def scan_all(automata: Iterable[ItemAutomaton], words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """What several automata find together."""
    hits: list[tuple[int, int]] = []
    items: set = set()
    for automaton in automata:
        more, named = automaton.scan(words)
        hits += more
        items |= named
    return merged(hits), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _ranges(text: str | None) -> list[tuple[int, int]]:
    return [tuple(map(int, r.split(":"))) for r in text.split(",")] if text else []


class ItemPasses:
    """The automata of all items, in the shared folder, grouped into passes of bounded bytes. Going through them fetches
    a pass just before its turn, so the driver and each worker hold one at a time."""

    def __init__(self, items: DataFrame, window: int, most_words: int, most_bytes: int):
        words = items.agg(F.sum(F.regexp_count(_lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
        parts = -(-words // most_words)
        parted = items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(max(parts, 1))))

        def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            named = [(x if isinstance(x, str) else None, alphanumeric(text)) for x, text in zip(rows["item"].array, rows["text"].array)]
            automaton = ItemAutomaton(named, window)
            return pd.DataFrame({"part": [key[0]], "size": [automaton.size], "plain": [pickle.dumps(automaton.plain)]})

        self.built = stored(parted.groupBy("part").applyInPandas(build, "part bigint, size bigint, plain binary"))
        self.passes: list[list[int]] = []
        room = 0
        for part, size in sorted(map(tuple, self.built.select("part", "size").collect())) if words else []:
            if size > room:
                self.passes.append([])
                room = most_bytes
            self.passes[-1].append(part)
            room -= size

    def __len__(self) -> int:
        return len(self.passes)

    def __iter__(self) -> Iterator[list[tuple]]:
        for parts in self.passes:
            yield [pickle.loads(r.plain) for r in self.built.where(F.col("part").isin(parts)).select("plain").collect()]


def _lower(name: str):
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_passes(benchmark: DataFrame, window: int, most_words: int, most_bytes: int, id_col: str, text_col: str) -> ItemPasses:
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    return ItemPasses(items, window, most_words, most_bytes)


def _digest(text_col: str):
    return F.sha2(F.col(text_col), 256)


def hits_of(texts: DataFrame, passes: ItemPasses) -> DataFrame:
    """Rows (key, spans, names) of the texts (key, text) that any pass hits, one a key; only hits are written."""
    found = None
    for automata in passes:
        sent = texts.sparkSession.sparkContext.broadcast(automata)
        hit = stored(texts.where("text IS NOT NULL").mapInPandas(_finder(sent), "key string, spans string, names array<string>"))
        sent.destroy()
        found = hit if found is None else found.unionByName(hit)
    spans = F.array_join(F.sort_array(F.collect_set("spans")), ",").alias("spans")
    return stored(found.groupBy("key").agg(spans, F.array_distinct(F.flatten(F.collect_set("names"))).alias("names")))


def _finder(sent):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automata = [ItemAutomaton.opened(plain) for plain in sent.value]
        for batch in batches:
            out = []
            for key, text in zip(batch["key"].array, batch["text"].array):
                hits, found = scan_all(automata, alphanumeric(text))
                if hits:
                    out.append((key, _written(hits), sorted(x for x in found if x is not None)))
            yield pd.DataFrame(out, columns=["key", "spans", "names"]).astype(object)

    return find


def _written(hits: list[tuple[int, int]]) -> str:
    return ",".join(f"{s}:{e}" for s, e in hits)


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, most_words: int = 200_000, most_bytes: int = 1 << 27, text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", name: str = "found",
) -> DataFrame:
    """The documents with a struct: n_words, n_hit, spans (word ranges), items, n_items, items_sha256."""
    passes = item_passes(benchmark, window, most_words, most_bytes, item_id_col, item_text_col)
    if len(passes) <= 1:
        sent = docs.sparkSession.sparkContext.broadcast(next(iter(passes), []))
        return docs.withColumn(name, F.pandas_udf(_matcher(sent), FOUND)(F.col(text_col)))
    hits = hits_of(docs.select(_digest(text_col).alias("key"), F.col(text_col).alias("text")), passes)
    key, spans, names = (unused(docs, x) for x in ("key", "spans", "names"))
    hits = hits.select(F.col("key").alias(key), F.col("spans").alias(spans), F.col("names").alias(names))
    joined = docs.withColumn(key, _digest(text_col)).join(hits, key, "left")
    told = F.pandas_udf(_teller, FOUND)(F.col(text_col), F.col(spans), F.col(names))
    columns = [c for c in docs.columns if c != name]
    return joined.select(*(F.col(f"`{c}`") for c in columns), told.alias(name))


def _told(words: list[bytes], hits: list[tuple[int, int]], names: Iterable[str]) -> tuple:
    names = sorted(names)
    listed = ",".join(names)
    return len(words), sum(e - s for s, e in hits), _written(hits), listed, len(names), hashlib.sha256(listed.encode()).hexdigest()


FOUND_COLUMNS = [c.split()[0] for c in FOUND.split(", ")]


def _matcher(sent):
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automata = [ItemAutomaton.opened(plain) for plain in sent.value]
        for texts in batches:
            out = []
            for text in texts.array:
                words = alphanumeric(text if isinstance(text, str) else None)
                hits, found = scan_all(automata, words)
                out.append(_told(words, hits, {x for x in found if x is not None}))
            yield pd.DataFrame(out, columns=FOUND_COLUMNS)

    return find


def _teller(texts: pd.Series, spans: pd.Series, names: pd.Series) -> pd.DataFrame:
    out = []
    for text, written, named in zip(texts.array, spans.array, names.array):
        words = alphanumeric(text if isinstance(text, str) else None)
        hits = merged(_ranges(written)) if isinstance(written, str) else []
        out.append(_told(words, hits, named if hits else []))
    return pd.DataFrame(out, columns=FOUND_COLUMNS)


def clean(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, coverage: float = 0.5, most_words: int = 200_000, most_bytes: int = 1 << 27,
    text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Removes hit spans from the texts, and documents of which more than the given share of words is hit.

    Documents without hits come out as they are. A removal can bring new windows together, so a text is matched
    again, by all items, until nothing is left; the result does not depend on how the items are split. With several
    passes, only the distinct texts with hits are gone through again.
    """
    passes = item_passes(benchmark, window, most_words, most_bytes, item_id_col, item_text_col)
    if not len(passes):
        return docs
    name = unused(docs, "cut")
    if len(passes) == 1:
        sent = docs.sparkSession.sparkContext.broadcast(next(iter(passes)))
        cut = F.pandas_udf(_cutter(sent), "text string, lost bigint, words bigint")
        out = docs.withColumn(name, cut(F.col(text_col)))
    else:
        key = unused(docs, "key")
        digest = docs.withColumn(key, _digest(text_col))
        texts = digest.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
        hits = hits_of(texts, passes)
        state = texts.join(hits.select("key"), "key", "left_semi").dropDuplicates(["key"])
        state = stored(state.withColumns({"lost": F.lit(0).cast("bigint"), "words": F.lit(0).cast("bigint")}))
        while not hits.isEmpty():
            cut = F.pandas_udf(_shortened, "text string, lost bigint, words bigint")
            joined = state.join(hits.select("key", "spans"), "key", "left")
            state = stored(joined.select("key", cut("text", "spans", "lost", "words").alias("cut")).select("key", "cut.*"))
            # what was not hit before has not changed since
            hits = hits_of(state.join(hits.select("key"), "key", "left_semi").select("key", "text"), passes)
        found = state.select(F.col("key").alias(key), F.struct("text", "lost", "words").alias(name))
        out = digest.join(found, key, "left").drop(key)
    little = F.coalesce(F.col(f"{name}.lost") <= coverage * F.col(f"{name}.words"), F.lit(True))
    rest = out.where(little).withColumn(text_col, F.coalesce(F.col(f"{name}.text"), F.col(text_col)))
    return rest.select(*(F.col(f"`{c}`") for c in docs.columns))


def _cutter(sent):
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automata = [ItemAutomaton.opened(plain) for plain in sent.value]
        for texts in batches:
            out = []
            for text in texts.array:
                text = text if isinstance(text, str) else None
                words = alphanumeric(text)
                total, gone, changed = len(words), 0, False
                spans, _ = scan_all(automata, words)
                while spans:
                    gone += sum(e - s for s, e in spans)
                    text, changed = without(text, spans), True
                    spans, _ = scan_all(automata, alphanumeric(text))
                out.append((text if changed else None, gone, total))
            yield pd.DataFrame(out, columns=["text", "lost", "words"])

    return cut


def _shortened(texts: pd.Series, spans: pd.Series, lost: pd.Series, before: pd.Series) -> pd.DataFrame:
    out = []
    for text, written, gone, total in zip(texts.array, spans.array, lost.tolist(), before.tolist()):
        total = max(total, len(alphanumeric(text)))
        if isinstance(written, str):
            hits = merged(_ranges(written))
            gone += sum(e - s for s, e in hits)
            text = without(text, hits)
        out.append((text, gone, total))
    return pd.DataFrame(out, columns=["text", "lost", "words"])


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the given ranges of words and what stands between them."""
    import re

    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(ALNUM))]
    out, at = [], 0
    for start, end in ranges:
        out.append(data[at : places[start][0]])
        at = places[end - 1][1]
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")
