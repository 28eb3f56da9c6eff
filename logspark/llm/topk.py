"""Exact top-k by inner product with a pivot-distance index.

Vectors become integers, floor(scale * x). With every vector lifted by one component to the largest norm of all,
the order by inner product is the order by distance, and distances obey the triangle inequality. The index keys a
vector by its nearest pivot and its distance to it; the vectors of a pivot are cut into annuli of bounded size.
A query visits annuli in the order of the least distance that they allow, a few at first and then more, and stops
when no annulus left can hold anything nearer than its k-th best so far. Annuli of a pivot have equal width, so those
within a distance are found by arithmetic from one row a pivot; only visited ones are ever written. The bound is exact
(with a margin for rounding), so results are exact whatever the pivots; scores are integer inner products.

Pivots are chosen from a bounded sample; every vector is indexed. Queries that want an annulus are dealt out in
bounded lots, so neither a popular annulus nor many queries meet in one task.

The index holds vectors whose squared length is below 2^50, where doubles are exact. Longer ones, as vectors and as
queries, are compared with all others block by block in whole numbers of any size. A score beyond 64 bits is null, but
ranks where it belongs.

Vectors that are null or empty, or hold null or non-finite components, and rows without an id take no part. Shorter
vectors count as padded with zeros. Rows with a query's own id are not its candidates; repeated rows of an id
give one query, and every row is a candidate. Extra columns are not read.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from logspark.llm.frames import exact, runs, stored

INDEX = "id bigint, ints binary, norm double"


#: Squared lengths below this are exact as doubles, and so are all scores between such vectors.
LONGEST = 2**50


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Rows (id, ints, norm): the usable vectors as integers, norm their squared length.

    The integers are 32-bit ones; those of vectors too long for the index are decimal text, and their norm is null.
    """

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, vector in zip(batch["id"], batch["vector"]):
                if vector is None or not len(vector):
                    continue
                x = np.asarray(vector, np.float64)
                if not np.isfinite(x).all():
                    continue
                if np.abs(x).max() < 2**24:
                    whole = np.floor(scale * x)
                    norm = float(whole @ whole)
                    if norm < LONGEST and np.abs(whole).max() < 2**31:
                        out.append((name, whole.astype(np.int32).tobytes(), norm))
                        continue
                ratios = (float(c).as_integer_ratio() for c in x)
                out.append((name, ",".join(str(scale * n // d) for n, d in ratios).encode(), None))
            yield pd.DataFrame(out, columns=["id", "ints", "norm"]).astype({"norm": "float64"})

    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    found = rows.where("id IS NOT NULL AND vector IS NOT NULL").mapInPandas(convert, INDEX)
    return found.withColumn("norm", F.nanvl("norm", F.lit(None)))


def grid(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float64)
    data = [np.frombuffer(r, np.int32) for r in rows]
    if data and all(len(x) == width for x in data):
        return np.stack(data).astype(np.float64)
    for i, x in enumerate(data):
        out[i, : len(x)] = x
    return out


def lifted_distances(x: np.ndarray, norm: np.ndarray, pivots: np.ndarray, pivot_norm: np.ndarray, most: float) -> np.ndarray:
    """Distances to the pivots in the lifted space, where all vectors but the queries have the largest norm."""
    lift, pivot_lift = np.sqrt(np.maximum(most - norm, 0)), np.sqrt(np.maximum(most - pivot_norm, 0))
    square = norm[:, None] + pivot_norm[None, :] - 2 * (x @ pivots.T) + (lift[:, None] - pivot_lift[None, :]) ** 2
    return np.sqrt(np.maximum(square, 0))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, pivots: int = 32, sample: int = 2000,
    block_rows: int = 2048, first_blocks: int = 2, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query its k highest scores, ties to the smaller vec_id."""
    every = stored(integers(vectors, id_col, vector_col, scale))
    asking = stored(integers(queries, id_col, vector_col, scale).dropDuplicates(["id"]))
    base, wanted = every.where("norm IS NOT NULL"), asking.where("norm IS NOT NULL")
    near = _indexed(base, wanted, k, pivots, sample, block_rows, first_blocks)
    long_rows, long_asks = every.where("norm IS NULL"), asking.where("norm IS NULL")
    if long_rows.isEmpty() and long_asks.isEmpty():
        return near
    parts = [near.select(F.col("query_id").alias("query"), F.col("vec_id").alias("id"), F.col("score").cast("string").alias("text"))]
    parts += [_compared(asking, long_rows, k, block_rows), _compared(long_asks, base, k, block_rows)]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("place", _place("text"))
    order = Window.partitionBy("query").orderBy(F.desc("place"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("text").try_cast("bigint").alias("score")
    )


def _place(text: str):
    """A text that sorts like the whole number that it stands for."""
    digits = F.regexp_replace(text, "^-", "")
    length = F.length(digits)
    up = F.concat(F.lit("1"), F.lpad(length.cast("string"), 9, "0"), digits)
    down = F.concat(F.lit("0"), F.lpad((999_999_999 - length).cast("string"), 9, "0"), F.translate(digits, "0123456789", "9876543210"))
    return F.when(F.startswith(text, F.lit("-")), down).otherwise(up)


def _whole(ints: bytes, norm: float | None) -> list[int]:
    return list(map(int, bytes(ints).decode().split(","))) if norm is None or norm != norm else np.frombuffer(ints, np.int32).tolist()


def _compared(asks: DataFrame, rows: DataFrame, k: int, block_rows: int) -> DataFrame:
    """The k best of each block of rows for every query, in whole numbers of any size: (query, id, text)."""
    blocks = max(1, -(-rows.count() // block_rows))
    lots = max(1, -(-asks.count() // block_rows))
    block, lot = F.pmod(F.xxhash64("id", "ints"), F.lit(blocks)), F.pmod(F.xxhash64("id"), F.lit(lots))
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(name)
    left = asks.select("id", "ints", "norm", lot.alias("lot"), every(blocks, "block"))
    right = rows.select("id", "ints", "norm", block.alias("block"), every(lots, "lot"))

    def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        vectors = [(i, _whole(x, n)) for i, x, n in zip(held["id"].tolist(), held["ints"], held["norm"].tolist())]
        for query, ints, norm in zip(asked["id"].tolist(), asked["ints"], asked["norm"].tolist()):
            q = _whole(ints, norm)
            scores = [(-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors if i != query]
            out += [(query, i, str(-s)) for s, i in heapq.nsmallest(k, scores)]
        return exact(out, ["query", "id", "text"])

    return left.groupBy("block", "lot").cogroup(right.groupBy("block", "lot")).applyInPandas(compare, "query bigint, id bigint, text string")


def _indexed(base: DataFrame, wanted: DataFrame, k: int, pivots: int, sample: int, block_rows: int, first_blocks: int) -> DataFrame:
    """The search among vectors that the index holds."""
    spread = base.agg(F.max("norm").alias("norm"), F.max(F.octet_length("ints")).alias("bytes"))
    asked = wanted.agg(F.max(F.octet_length("ints")).alias("bytes")).first().bytes or 4
    most, widest = spread.first()
    most, width = most or 0.0, max(widest or 4, asked) // 4
    centres = _pivots(base, pivots, sample, width, most)

    keyed = stored(base.mapInPandas(_nearest(centres, width, most), INDEX + ", pivot int, distance double"))
    spans, crowd, index = _annuli(keyed, block_rows)
    state = stored(wanted.mapInPandas(_starts(centres, width, most), INDEX + ", away array<double>, seen double"))
    best = None
    visit = first_blocks
    while True:
        # the k-th best so far bounds how far the search has to reach
        if best is None:
            reached = state.withColumn("reach", F.lit(None).cast("double"))
        else:
            kth = best.groupBy("query").agg(F.count("*").alias("n"), F.max("reach").alias("reach"))
            kth = kth.select(F.col("query").alias("id"), F.when(F.col("n") >= k, F.col("reach")).alias("reach"))
            reached = state.join(kth, "id", "left")
        state = stored(reached.mapInPandas(_expansion(spans, most, visit), EXPANDED))
        if best is not None and state.isEmpty():
            return ranks.select(
                F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"
            )
        found = _visited(_requests(state, crowd), wanted, index, k, width, most)
        state = state.drop("rings")
        both = found if best is None else best.unionByName(found)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        ranks = stored(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        best = ranks.drop("rank")
        visit *= 8


def _pivots(base: DataFrame, count: int, sample: int, width: int, most: float):
    """Pivots far from each other, from a sample of bounded size: the smallest hashes of the ids."""
    rows = base.orderBy(F.xxhash64("id", "ints"), "id").limit(sample).toPandas()
    x, norm = grid(rows["ints"], width), rows["norm"].to_numpy(np.float64)
    if not len(x):
        return np.zeros((1, width)), np.zeros(1)
    chosen = [0]
    far = lifted_distances(x, norm, x[:1], norm[:1], most)[:, 0]
    while len(chosen) < min(count, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, lifted_distances(x, norm, x[chosen[-1:]], norm[chosen[-1:]], most)[:, 0])
    return x[chosen], norm[chosen]


def _nearest(centres, width: int, most: float):
    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.iloc[start : start + 4096]
                d = lifted_distances(grid(part["ints"], width), part["norm"].to_numpy(), *centres, most)
                near = d.argmin(axis=1)
                yield part.assign(pivot=near.astype(np.int32), distance=d[np.arange(len(part)), near])

    return key


def _annuli(keyed: DataFrame, block_rows: int) -> tuple[pd.DataFrame, DataFrame, DataFrame]:
    """Cuts each pivot's vectors into annuli (rings) of equal width, about block_rows each; a crowded one is spread over lots.

    Returns the spans of the pivots (pivot, low, high, parts; a row a pivot, so never more than there are pivots), the
    lots of each ring that holds vectors (pivot, ring, lots), and the index rows (id, ints, block).
    """
    span = keyed.groupBy("pivot").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n"))
    span = stored(span.select("pivot", "low", "high", F.ceil(F.col("n") / block_rows).cast("double").alias("parts")))
    step = F.least(F.floor((F.col("distance") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("parts")), F.col("parts") - 1)
    ring = F.when(F.col("high") > F.col("low"), step).otherwise(0).cast("bigint")
    ringed = keyed.join(span, "pivot").select("id", "ints", "pivot", ring.alias("ring"))
    crowd = ringed.groupBy("pivot", "ring").agg(F.count("*").alias("n"))
    crowd = stored(crowd.select("pivot", "ring", F.ceil(F.col("n") / block_rows).cast("bigint").alias("lots")))
    lot = F.pmod(F.xxhash64("id", "ints"), "lots")
    index = stored(ringed.join(crowd, ["pivot", "ring"]).select("id", "ints", _block(lot).alias("block")))
    return span.toPandas().sort_values("pivot"), crowd, index


def _block(lot):
    return F.xxhash64("pivot", "ring", lot)


def _starts(centres, width: int, most: float):
    """Queries with their distances to the pivots; nothing is seen yet."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, norm = grid(batch["ints"], width), batch["norm"].to_numpy()
            # a query has no lift of its own
            square = norm[:, None] + most - 2 * (x @ centres[0].T)
            yield batch.assign(away=list(np.sqrt(np.maximum(square, 0))), seen=-1.0)

    return measure


EXPANDED = "id bigint, away array<double>, seen double, rings array<struct<pivot: int, first: bigint, last: bigint>>"


def _expansion(spans: pd.DataFrame, most: float, visit: int):
    """Lets each query reach about `visit` rings further, but not beyond its k-th best; queries that have got there go.

    The rings that a distance r from the query can touch follow from the triangle inequality by arithmetic: for every
    pivot they are one run of rings, which grows at both ends. No query is set against the list of all rings.
    """
    pivot, low, high, parts = (spans[c].to_numpy() for c in ("pivot", "low", "high", "parts"))
    margin = 1e-3 + 1e-7 * most**0.5

    def ring(x: np.ndarray) -> np.ndarray:
        # the same operations as in the index, so that the order of distances is the order of rings
        flat = high <= low
        step = np.floor((x - low) / np.where(flat, 1.0, high - low) * parts)
        return np.where(flat, 0.0, np.clip(step, 0, parts - 1))

    def touched(away: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last ring of each pivot within the radius; the first is above the last where there are none."""
        pad = ((radius + margin) * (1 + 2e-9))[:, None]
        none = (away + pad < low) | (away - pad > high) | (radius < 0)[:, None]
        return np.where(none, 0.0, ring(away - pad)), np.where(none, -1.0, ring(away + pad))

    def count(away: np.ndarray, radius: np.ndarray) -> np.ndarray:
        first, last = touched(away, radius)
        return (last - first + 1).sum(axis=1)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch) or not len(pivot):
                continue
            away = np.stack(batch["away"].to_numpy())[:, pivot]
            seen, reach = batch["seen"].to_numpy(np.float64), batch["reach"].to_numpy(np.float64)
            reach = np.where(np.isnan(reach), np.inf, reach)
            all_of_it = np.maximum(np.abs(away - low), np.abs(away - high)).max(axis=1)
            wanted = count(away, seen) + visit
            near, far = np.maximum(seen, 0.0), np.maximum(all_of_it, seen)
            for _ in range(50):
                middle = (near + far) / 2
                enough = count(away, middle) >= wanted
                near, far = np.where(enough, near, middle), np.where(enough, middle, far)
            radius = np.minimum(far, reach)
            going = (seen < reach) & (seen < all_of_it)
            first, last = touched(away, radius)
            was_first, was_last = touched(away, seen)
            rings = []
            for i in range(len(batch)):
                runs_of = []
                for p, a, b, c, d in zip(pivot, first[i], last[i], was_first[i], was_last[i]):
                    if c > d:
                        runs_of.append((p, a, b))
                    else:
                        runs_of += [(p, a, c - 1), (p, d + 1, b)]
                rings.append([{"pivot": int(p), "first": int(a), "last": int(b)} for p, a, b in runs_of if a <= b])
            out = batch[["id", "away"]].assign(seen=radius, rings=rings)
            yield out[going]

    return expand


def _requests(state: DataFrame, crowd: DataFrame) -> DataFrame:
    """Rows (query, block): the blocks of the rings that queries ask for; rings without vectors have none."""
    asked = state.select("id", F.explode("rings").alias("run"))
    asked = asked.select("id", "run.pivot", F.explode(F.sequence("run.first", "run.last")).alias("ring"))
    lots = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1))
    lotted = asked.join(crowd, ["pivot", "ring"]).select("id", "pivot", "ring", lots.alias("lot"))
    return lotted.select(F.col("id").alias("query"), _block(F.col("lot")).alias("block"))


def _visited(pairs: DataFrame, wanted: DataFrame, index: DataFrame, k: int, width: int, most: float, lot: int = 2048) -> DataFrame:
    """The k best of each block for each query that visits it: (query, id, score, reach)."""
    lots = stored(pairs.groupBy("block").agg(F.ceil(F.count("*") / lot).cast("bigint").alias("lots")))
    asking = pairs.join(lots, "block").join(wanted.withColumnRenamed("id", "query"), "query").select(
        "block", F.pmod(F.xxhash64("query"), "lots").alias("part"), F.col("query").alias("id"), "ints", "norm", F.lit(0).alias("kind"))
    held = index.join(lots, "block").select(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1)).alias("part"), "id", "ints",
        F.lit(0.0).alias("norm"), F.lit(1).alias("kind"))
    meeting = asking.unionByName(held).withColumn("block", F.xxhash64("block", "part")).drop("part")
    meeting = meeting.repartition("block").sortWithinPartitions("block", "kind", "id")

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, "block"):
            asks = group[group["kind"] == 0]
            rows = group[group["kind"] == 1]
            if not len(asks) or not len(rows):
                continue
            ids, x = rows["id"].to_numpy(), grid(rows["ints"], width)
            largest = np.abs(x).max(initial=0)
            for start in range(0, len(asks), 256):
                part = asks.iloc[start : start + 256]
                q = grid(part["ints"], width)
                if largest * np.abs(q).max(initial=0) * width < 2**52:
                    scores = (q @ x.T).astype(np.int64)
                else:
                    scores = q.astype(np.int64) @ x.astype(np.int64).T
                yield _best(part, ids, scores, k, most)

    return meeting.mapInPandas(visit, "query bigint, id bigint, score bigint, reach double")


def _best(asks: pd.DataFrame, ids: np.ndarray, scores: np.ndarray, k: int, most: float) -> pd.DataFrame:
    """Rows are sorted by id, so a stable order by score gives ties to the smaller id."""
    own = ids[None, :] == asks["id"].to_numpy()[:, None]
    order = np.argsort(-scores, axis=1, kind="stable")
    if own.any() or len(ids) > 4 * k:
        order = order[:, : k + int(own.sum(axis=1).max(initial=0))]
    row = np.repeat(np.arange(len(asks)), order.shape[1])
    col = order.ravel()
    free = ~own[row, col]
    row, col = row[free], col[free]
    score = scores[row, col]
    norm = asks["norm"].to_numpy()[row]
    reach = np.sqrt(np.maximum(norm + most - 2.0 * score, 0))
    out = pd.DataFrame({"query": asks["id"].to_numpy()[row], "id": ids[col], "score": score, "reach": reach})
    return out.groupby("query", sort=False).head(k)
