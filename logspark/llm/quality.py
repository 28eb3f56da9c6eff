"""Document quality by Bradley-Terry ranking of labelled documents.

A pair of labelled documents of which one is good and the other bad is a preference. Each document has a strength,
linear in its features; the chance that the better one wins is the logistic function of the difference of
strengths. The weights minimise the mean logistic loss over all preference pairs, with a small ridge penalty, by Newton
steps. The score is the logistic function of the strength, shifted so that the accepting score falls on the
quantile of the learning strengths that equals their share of bad documents.

Every labelled document that is not held out is learned from, and every good one meets every bad one. Pairs are not
written: what a document adds to loss and gradient depends on its strength and on how the strengths of the other class
are spread, and that is counted on a fine grid. A Newton step is two passes over the features, which grow with the
labels; the driver gets sums. Features come from whole texts, never from labels, language, source or id. Every
document is scored.

Nulls and empty texts have features of zero and a score like any other. Rows with a null label teach nothing;
repeated labels and rows teach once more each; without labels of both kinds every score is 0.5. Extra columns pass
through.
"""

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from logspark.llm.frames import stored, unused

ACCEPT = 0.3
WIDTH = 19
_GROUPS = [b"!", b"?", b".", b",", b"|", b"#$%&*@^~", b"<>{}[]()=+\\/_", b"0123456789", b"\n", b"\"':;-"]


def features(text: str | None) -> np.ndarray:
    """Shape of a text: lengths, rates of letters and marks, repetition."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return np.zeros(WIDTH)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(1, int(seen[65:91].sum() + seen[97:123].sum()))
    distinct = len(set(words))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in data.split(b"\n") if x]
    out = [
        np.log1p(n), np.log(len(data) / n), seen[65:91].sum() / letters, seen[128:].sum() / len(data),
        np.log(distinct) / np.log(n + 1), np.sqrt(distinct / n), repeats / n, 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
    ]
    out += [np.sqrt(seen[list(group)].sum() / n) for group in _GROUPS]
    return np.array(out)


@dataclass
class Ranking:
    """Weights on standardised features and their squares; accept is the strength that scores ACCEPT."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    accept: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([z, z * z])

    def strength(self, x: np.ndarray) -> np.ndarray:
        # rounded, so that a document has one strength in batches of any size
        return np.round(self.expand(x) @ self.weights, 9)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.accept + np.log(ACCEPT / (1 - ACCEPT)), -500, 500)))

    def reach(self) -> tuple[float, float]:
        """Bounds of all strengths."""
        plain, squares = np.split(self.weights, 2)
        ends = 6 * np.abs(plain).sum()
        return 36 * np.minimum(squares, 0).sum() - ends, 36 * np.maximum(squares, 0).sum() + ends

    @classmethod
    def fit(cls, rows: DataFrame, ridge: float = 1e-3, rounds: int = 25) -> "Ranking | None":
        """The ranking of examples: rows (label 0 or 1, n times, x: features as bytes)."""
        totals = _totals(rows, _moments).reshape(2, -1)
        count = totals[:, 0]
        if not count.all():
            return None
        mean, squares = np.split(totals[:, 1:].sum(axis=0) / count.sum(), 2)
        spread = np.maximum(np.sqrt(np.maximum(squares - mean * mean, 0)), 1e-6)
        model = cls(np.round(mean, 9), np.round(spread, 9), np.zeros(2 * WIDTH), 0.0)
        grid = Spread.of(rows, model)
        loss = grid.loss(ridge)
        for _ in range(rounds):
            gradient, curve = grid.slopes(rows, ridge)
            step = np.linalg.solve(curve, gradient)
            gain = gradient @ step
            while True:
                trial = Spread.of(rows, cls(model.mean, model.spread, model.weights - step, 0.0))
                reached = trial.loss(ridge)
                # the grid tells losses apart down to a millionth
                if reached <= loss + 1e-6:
                    break
                step = step / 2
            model, grid, loss = trial.model, trial, reached
            if gain < 1e-8:
                break
        model.weights = np.round(model.weights, 9)
        values = stored(rows.mapInPandas(_strengths(model), "s double, n bigint"))
        # the quantile between two neighbouring strengths
        at = count[0] / count.sum() * (count.sum() - 1)
        lower = nth(values, math.floor(at))
        model.accept = lower + (nth(values, math.ceil(at)) - lower) * (at - math.floor(at))
        return model


@dataclass
class Spread:
    """How often each strength occurs among bad and good examples: counts on a grid of strengths, a strength between
    two points counting for both by its nearness. Functions of a strength are read off the grid the same way. For the
    curvature the strengths also fall into wider groups."""

    model: Ranking
    low: float
    step: float
    wide: float
    counts: np.ndarray
    groups: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, model: Ranking, step: float = 1 / 32, wide: float = 1 / 8) -> "Spread":
        low, high = model.reach()
        step, wide = max(step, (high - low) / (1 << 17)), max(wide, (high - low) / 4000)
        size, groups = math.ceil((high - low) / step) + 2, math.ceil((high - low) / wide) + 2
        empty = cls(model, low, step, wide, np.zeros((2, size)), np.zeros((2, groups)))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((4, size))
            for label, n, x in _examples(batches):
                strengths = model.expand(x) @ model.weights
                at, part = _places(strengths, low, step)
                np.add.at(total, (label, at), n * (1 - part))
                np.add.at(total, (label, at + 1), n * part)
                np.add.at(total, (label + 2, _group(strengths, low, wide)), n)
            kind, at = np.nonzero(total)
            yield pd.DataFrame({"kind": kind.astype("int32"), "at": at.astype("int32"), "n": total[kind, at]})

        for kind, at, n in rows.mapInPandas(count, "kind int, at int, n double").groupBy("kind", "at").agg(F.sum("n")).collect():
            (empty.groups if kind > 1 else empty.counts)[kind % 2, at] = n
        return empty

    def met(self, label: int, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """At each point of the grid the sum of kernel(point - strength) over the examples of a label."""
        size = self.counts.shape[1]
        values = kernel(np.arange(1 - size, size) * self.step)
        length = 1 << (3 * size).bit_length()
        return np.fft.irfft(np.fft.rfft(self.counts[label], length) * np.fft.rfft(values, length), length)[size - 1 : 2 * size - 1]

    def loss(self, ridge: float) -> float:
        pairs = self.counts.sum(axis=1).prod()
        w = self.model.weights
        return float(self.counts[1] @ self.met(0, lambda d: np.logaddexp(0, -d)) / pairs + ridge / 2 * (w @ w))

    def slopes(self, rows: DataFrame, ridge: float) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the loss. The curvature, which steers the steps and not where they end, takes all
        strengths of a group as its middle."""
        model, low, step, wide, size = self.model, self.low, self.step, self.wide, 2 * WIDTH
        pairs = self.counts.sum(axis=1).prod()
        slope = np.stack([self.met(1, lambda d: _logistic(d)), -self.met(0, lambda d: _logistic(-d))]) / pairs
        # only groups that occur
        used = np.flatnonzero(self.groups.any(axis=0))
        middles = used * wide
        bends = _logistic(middles[:, None] - middles[None, :])
        bends = bends * (1 - bends)
        own = np.stack([bends @ self.groups[1, used], bends @ self.groups[0, used]]) / pairs
        lanes = np.zeros(self.groups.shape[1], int)
        lanes[used] = np.arange(len(used))

        def add(label: np.ndarray, n: np.ndarray, x: np.ndarray) -> np.ndarray:
            z = model.expand(x)
            strengths = z @ model.weights
            at, part = _places(strengths, low, step)
            first = slope[label, at] * (1 - part) + slope[label, at + 1] * part
            lane = lanes[_group(strengths, low, wide)]
            sums = np.zeros((2, len(middles), size))
            np.add.at(sums, (label, lane), n[:, None] * z)
            return np.concatenate([(n * first) @ z, (z.T * (n * own[label, lane]) @ z).ravel(), sums.ravel()])

        totals = _totals(rows, add)
        gradient, curve = totals[:size], totals[size : size + size * size].reshape(size, size)
        sums = totals[size + size * size :].reshape(2, len(used), size)
        cross = sums[1].T @ bends @ sums[0] / pairs
        w = model.weights
        return gradient + ridge * w, curve - cross - cross.T + ridge * np.eye(size)


def _places(strengths: np.ndarray, low: float, step: float) -> tuple[np.ndarray, np.ndarray]:
    at = np.maximum((strengths - low) / step, 0)
    return at.astype(int), at % 1


def _group(strengths: np.ndarray, low: float, wide: float) -> np.ndarray:
    return np.maximum(np.rint((strengths - low) / wide), 0).astype(int)


def _logistic(d: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


def _examples(batches: Iterator[pd.DataFrame], least: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, counts and features of the examples; small batches are put together."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= least:
            yield _arrays(held)
            held = []
    if any(map(len, held)):
        yield _arrays(held)


def _arrays(held: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = pd.concat(held, ignore_index=True)
    return rows["label"].to_numpy(), rows["n"].to_numpy(float), np.frombuffer(b"".join(rows["x"])).reshape(-1, WIDTH)


def _moments(label: np.ndarray, n: np.ndarray, x: np.ndarray) -> np.ndarray:
    parts = [(label == k) * n for k in (0, 1)]
    return np.concatenate([np.concatenate([[p.sum()], p @ x, p @ (x * x)]) for p in parts])


def _strengths(model: Ranking):
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, n, x in _examples(batches):
            yield pd.DataFrame({"s": model.strength(x), "n": n.astype("int64")})

    return measure


def _totals(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of the vectors that part() makes of the examples; summed in the tasks and then by place."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for label, n, x in _examples(batches):
            own = part(label, n, x)
            total = own if total is None else total + own
        if total is not None:
            # the last place is always written: it tells the length
            at = np.flatnonzero(np.append(total[:-1] != 0, True))
            yield pd.DataFrame({"at": at.astype("int32"), "value": total[at]})

    found = rows.mapInPandas(add, "at int, value double").groupBy("at").agg(F.sum("value")).collect()
    out = np.zeros(max((at for at, _ in found), default=2 * (1 + 2 * WIDTH) - 1) + 1)
    for at, value in found:
        out[at] = value
    return out


def nth(values: DataFrame, k: int, bins: int = 1000) -> float:
    """The k-th smallest, from 0, of values s that count n times each; k is less than their number."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    before = 0
    while low < high:
        at = F.least(F.floor((F.col("s") - low) / ((high - low) / bins)), F.lit(bins - 1))
        found = values.where(F.col("s").between(low, high)).groupBy(at.alias("bin")).agg(F.sum("n").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
        for row in sorted(found.collect(), key=lambda r: r.low):
            if before + row.n > k:
                low, high = row.low, row.high
                break
            before += row.n
    return low


def is_held_out(id_column: Column, folds: int = 5) -> Column:
    """Whether a document is kept out of learning: the remainder of the checksum of its id is 0."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    label_id_col: str = "doc_id",
) -> Ranking | None:
    """The ranking learned from all labelled documents that are not held out."""
    usable = labels.select(F.col(label_id_col).alias("key"), F.col(label_col).alias("label"))
    usable = usable.where(F.col("key").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out(F.col("key")))
    usable = usable.groupBy("key", F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    texts = texts.where(F.col("key").isNotNull() & ~is_held_out(F.col("key")))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [features(t if isinstance(t, str) else None).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "x": values})

    # texts are measured before they meet their labels, so that only features are shuffled
    kind = docs.schema[id_col].dataType.simpleString()
    measured = texts.mapInPandas(measure, f"key {kind}, x binary")
    return Ranking.fit(stored(measured.join(usable, "key").select("label", "n", "x")))


def scored(docs: DataFrame, model: Ranking | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """The documents with their score from 0 to 1; those of at least ACCEPT are good."""

    def score(texts: pd.Series) -> pd.Series:
        if model is None or not len(texts):
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(model.score(np.stack([features(t if isinstance(t, str) else None) for t in texts])))

    return docs.withColumn(name, F.pandas_udf(score, "double")(F.col(text_col)))


def good(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """The documents of at least the accepting score."""
    name = unused(docs, "score")
    return scored(docs, learn(docs, labels, **more), name=name).where(F.col(name) >= ACCEPT).drop(name)
