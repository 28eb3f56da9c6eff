"""Product codes of vectors: codebooks learned by rounds of assignment, nearest entries found by equal-average search.

A component x becomes the integer floor(scale * x); a vector is cut into equal consecutive parts. The codebook of a
part position starts as that part of the first vectors by id. A round assigns every part to its nearest entry
(squared distance, ties to the lower index) and moves every entry to the floored mean of its parts; unused entries
stay. After the last round all parts are assigned again.

The nearest entry is found by equal averages: the entries of a position are sorted by their component sum, and the
search expands outward from the place of the part's own sum. By Cauchy-Schwarz the squared gap of two sums is at most
the dimension times the squared distance, so a side is closed once its squared gap over the dimension strictly exceeds
the best distance. All parts of a batch take their steps together; those that are done drop out.

Every round is one pass over the table with one partial sum per task, position and entry; only the codebooks, whose
size depends on the dimension alone, come to the driver and go out to the tasks. All arithmetic is exact: parts small
enough for 64-bit numbers take the fast way, others use whole numbers of any size, and sums travel in limbs.

Results of odd rows: vectors that are null or hold null or non-finite components are left out. Shorter vectors, and
lengths that the number of parts does not divide, count as padded with zeros at the end. Rows without an id are coded like
others but start no codebook before those with ids; of equal ids the smaller vector comes first. With fewer vectors than
entries the codebooks are smaller; an empty table gives no rows. An error, or a sum of errors, beyond 64 bits is null.
Extra columns pass through.
"""

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logspark.llm.frames import stored, unused

#: Magnitudes up to this are held as 64-bit numbers; their sums over a batch stay within 64 bits.
SMALL = 2**40
_LIMB = 40


def whole(x: float, scale: int) -> int:
    """floor(scale * x) without rounding, for a power of two or any other scale."""
    top, bottom = float(x).as_integer_ratio()
    return scale * top // bottom


def integers(vectors: pd.Series, width: int, scale: int) -> np.ndarray:
    """One row of integers a vector: 64-bit numbers if all are small, else Python's."""
    lengths = {len(v) for v in vectors}
    if lengths == {width}:
        x = np.stack([np.asarray(v, np.float64) for v in vectors])
    else:
        x = np.zeros((len(vectors), width))
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v
    if x.size and np.abs(x).max() > SMALL / scale:
        return np.array([[whole(c, scale) for c in row] for row in x], dtype=object).reshape(x.shape)
    # scaling by a power of two is exact; by any other number the product is rounded, so it is done whole
    if scale & (scale - 1):
        return np.array([[whole(c, scale) for c in row] for row in x], np.int64).reshape(x.shape)
    return np.floor(x * scale).astype(np.int64)


class Codebook:
    """The entries of one part position, sorted by component sum for the search."""

    def __init__(self, entries: list[list[int]]):
        self.most = max((abs(c) for e in entries for c in e), default=0)
        kind = np.int64 if self.most <= SMALL else object
        self.entries = np.array(entries, kind).reshape(len(entries), len(entries[0]) if entries else 0)
        sums = self.entries.sum(axis=1) if self.entries.size else np.zeros(len(entries), kind)
        self.order = np.array(sorted(range(len(entries)), key=lambda i: (sums[i], i)), np.int64)
        self.sums = sums[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance, for every part."""
        n, dim, last = len(parts), parts.shape[1], len(self.order)
        most = max(self.most, int(np.abs(parts).max()) if parts.size else 0)
        # the squared gap of two sums is the largest number that occurs
        kind = np.int64 if 2 * most * dim < 2**31 else object
        parts, entries, sums = parts.astype(kind), self.entries.astype(kind), self.sums.astype(kind)
        own = parts.sum(axis=1) if dim else np.zeros(n, kind)
        right = np.searchsorted(sums, own)
        left = right - 1
        best, found = np.full(n, -1, kind), np.full(n, last, np.int64)
        live = np.arange(n)
        while len(live):
            l, r = left[live], right[live]
            # the gaps to the next entry on either side; a side without entries is closed
            gap_l = own[live] - sums[np.maximum(l, 0)]
            gap_r = sums[np.minimum(r, last - 1)] - own[live]
            go_left = (l >= 0) & ((r >= last) | (gap_l <= gap_r))
            gap = np.where(go_left, gap_l, gap_r)
            # closed for good: the nearer side lies too far, so the farther one does as well
            more = ((l >= 0) | (r < last)) & ((best[live] < 0) | (gap * gap <= best[live] * dim))
            live, go_left, l, r = live[more], go_left[more], l[more], r[more]
            entry = self.order[np.where(go_left, l, np.minimum(r, last - 1))]
            apart = parts[live] - entries[entry]
            distance = (apart * apart).sum(axis=1) if dim else np.zeros(len(live), kind)
            better = (best[live] < 0) | (distance < best[live]) | ((distance == best[live]) & (entry < found[live]))
            best[live[better]], found[live[better]] = distance[better], entry[better]
            left[live[go_left]] -= 1
            right[live[~go_left]] += 1
        return found, best


@dataclass
class Codebooks:
    """Entries by part position, entry and component, and what is needed to code more vectors with them."""

    entries: list[list[list[int]]]
    width: int
    scale: int

    @property
    def parts(self) -> int:
        return len(self.entries)

    @property
    def sha256(self) -> str:
        listed = ",".join(str(c) for part in self.entries for entry in part for c in entry)
        return hashlib.sha256(listed.encode()).hexdigest()


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector and components all are there and finite."""
    good = F.forall(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(F.coalesce(good, F.lit(False)))


def first_codebooks(vectors: DataFrame, parts: int, entries: int, scale: int, id_col: str, vector_col: str) -> Codebooks:
    """Codebooks of the parts of the first vectors by id."""
    kept = usable(vectors, vector_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts) * parts
    rows = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    whole_rows = integers(pd.Series([r.vector for r in rows]), width, scale) if rows else np.zeros((0, width), np.int64)
    step = width // parts
    cut = [[[int(c) for c in row[p * step : (p + 1) * step]] for row in whole_rows] for p in range(parts)]
    return Codebooks(cut, width, scale)


def assigned(vectors: pd.Series, books: Codebooks, codebooks: list[Codebook]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer rows of the vectors, the entry of each part, and its squared distance."""
    rows = integers(vectors, books.width, books.scale)
    step = books.width // books.parts
    codes, distances = [], []
    for p, book in enumerate(codebooks):
        code, distance = book.nearest(rows[:, p * step : (p + 1) * step])
        codes.append(code)
        distances.append(distance)
    return rows, np.stack(codes, axis=1), np.stack(distances, axis=1)


def round_sums(vectors: DataFrame, books: Codebooks, vector_col: str) -> DataFrame:
    """Rows (part, entry, place, limb, value) to be added up; place -1 counts the parts of the entry."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codebooks = [Codebook(e) for e in books.entries]
        step = books.width // books.parts
        totals: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            if not len(batch):
                continue
            rows, codes, _ = assigned(batch["vector"], books, codebooks)
            for p in range(books.parts):
                for e in np.unique(codes[:, p]).tolist():
                    mine = codes[:, p] == e
                    sums = [int(mine.sum())] + [int(s) for s in rows[mine, p * step : (p + 1) * step].sum(axis=0)]
                    old = totals.get((p, e))
                    totals[p, e] = [a + b for a, b in zip(old, sums)] if old else sums
        out = []
        for (p, e), sums in totals.items():
            for place, total in enumerate(sums, -1):
                limb = 0
                while not -(2**_LIMB) <= total < 2**_LIMB:
                    total, low = divmod(total, 2**_LIMB)
                    out.append((p, e, place, limb, low))
                    limb += 1
                out.append((p, e, place, limb, total))
        yield pd.DataFrame(out, columns=["part", "entry", "place", "limb", "value"], dtype="int64")

    rows = usable(vectors, vector_col).select(F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    return rows.mapInPandas(add, "part bigint, entry bigint, place bigint, limb bigint, value bigint")


def next_codebooks(vectors: DataFrame, books: Codebooks, vector_col: str) -> Codebooks:
    """The codebooks after one more round."""
    sums = round_sums(vectors, books, vector_col).groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))
    totals: dict[tuple[int, int, int], int] = {}
    for r in sums.collect():  # as many rows as the codebooks have components, times a few limbs
        at = (r.part, r.entry, r.place)
        totals[at] = totals.get(at, 0) + (r.value << (_LIMB * r.limb))
    moved = [
        [
            [totals[p, e, i] // totals[p, e, -1] for i in range(len(entry))] if (p, e, -1) in totals else entry
            for e, entry in enumerate(part)
        ]
        for p, part in enumerate(books.entries)
    ]
    return Codebooks(moved, books.width, books.scale)


def learn(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> Codebooks:
    """Codebooks learned from all usable vectors."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    books = first_codebooks(vectors, parts, entries, scale, id_col, vector_col)
    for _ in range(rounds if books.entries[0] else 0):
        books = next_codebooks(vectors, books, vector_col)
    return books


def coded(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding", name: str = "codes") -> DataFrame:
    """The usable rows with a struct: code (two hex digits a part), error (squared distances summed up)."""

    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codebooks = [Codebook(e) for e in books.entries]
        for batch in batches:
            if not len(batch):
                yield pd.DataFrame({"code": pd.Series([], dtype=object), "error": pd.array([], "Int64")})
                continue
            _, codes, distances = assigned(batch, books, codebooks)
            errors = [sum(map(int, row)) for row in distances]
            yield pd.DataFrame({
                "code": [bytes(row).hex() for row in codes.astype(np.uint8)],
                "error": pd.array([e if e < 2**63 else None for e in errors], "Int64"),
            })

    column = F.pandas_udf(code, "code string, error bigint")(F.col(f"`{vector_col}`").cast("array<double>"))
    return usable(vectors, vector_col).withColumn(name, column)


def with_group_errors(rows: DataFrame, group_col: str, error_col: str, name: str, most_rows: int = 100_000, most_bytes: int = 16_000_000) -> DataFrame:
    """The rows with the error summed over the rows of equal group, nulls together.

    Sums are partial before the shuffle. They are broadcast if their number and bytes are within the bounds, else joined
    by a shuffle, in which adaptive execution splits a hot group.
    """
    rows = stored(rows)
    missing = F.count_if(F.col(error_col).isNull()) > 0
    total = F.sum(F.col(error_col).cast("decimal(38,0)"))
    sums = stored(rows.groupBy(F.col(group_col).alias("_group")).agg(
        F.when(~missing & (total <= F.lit(2**63 - 1)), total).cast("bigint").alias(name)))
    n, size = sums.limit(most_rows + 1).agg(F.count("*"), F.sum(F.length(F.col("_group").cast("string")))).first()
    if n <= most_rows and (size or 0) <= most_bytes:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col(group_col).eqNullSafe(F.col("_group")), "left").drop("_group")


def reconstruction(code: str, books: Codebooks) -> list[int]:
    """The integer vector that a code stands for."""
    return [c for p, e in enumerate(bytes.fromhex(code)) for c in books.entries[p][e]]


def compressed(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id",
    vector_col: str = "embedding", group_col: str = "label",
) -> DataFrame:
    """Rows (id, code, error, group error, codebooks_sha256) of all usable vectors."""
    books = learn(vectors, parts, entries, rounds, scale, id_col, vector_col)
    name = unused(vectors, "codes")
    found = coded(vectors, books, vector_col, name).select(
        F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{group_col}`").alias("label"), f"{name}.code", f"{name}.error",
    )
    summed = with_group_errors(found, "label", "error", "label_error")
    return summed.select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
