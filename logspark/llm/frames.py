"""Small helpers for frames: lineage cuts, streamed groups, connected components."""

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from logspark.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The frame read back from the shared checkpoint folder, so that lost executors cost no recomputation."""
    return cut_lineage(df)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    return name if name not in df.columns else f"{name}_{uuid.uuid4().hex[:8]}"


def exact(rows: list[tuple], columns: list[str], *nullable: str) -> pd.DataFrame:
    """A pandas frame whose nullable whole numbers do not turn into floats."""
    if not rows:
        # an empty list would become a float column, which Arrow does not turn into any other kind
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
    lists = dict(zip(columns, zip(*rows)))
    return pd.DataFrame({c: pd.array(list(v), "Int64") if c in nullable else list(v) for c, v in lists.items()}, columns=columns)


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lets Python workers take at most so many texts at once, for the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def light(df: DataFrame, rows: int = 100_000, most_bytes: int | None = None) -> DataFrame:
    """Marks a stored frame for broadcast if it has few rows, and few bytes in texts and binaries where that is asked;
    otherwise the join shuffles. Without most_bytes for narrow rows only."""
    if most_bytes is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    long = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("bigint") for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    count, size = df.limit(rows + 1).agg(F.count("*"), F.sum(sum(long, F.lit(0).cast("bigint")))).first()
    return F.broadcast(df) if count <= rows and (size or 0) <= most_bytes else df


def runs(batches: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The groups of a stream that is sorted by the key, one at a time; only one group is held."""
    tail: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[key].to_numpy()
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        if tail and tail[-1][key].iloc[-1] != values[0]:
            yield pd.concat(tail, ignore_index=True) if len(tail) > 1 else tail[0]
            tail = []
        start = 0
        for cut in cuts:
            part = batch.iloc[start:cut]
            yield pd.concat([*tail, part], ignore_index=True) if tail else part
            tail, start = [], cut
        tail.append(batch.iloc[start:])
    if tail:
        yield pd.concat(tail, ignore_index=True) if len(tail) > 1 else tail[0]


def connected(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of the links (a, b), as rows (node, root).

    Alternates large stars and small stars until nothing changes. Every step is an aggregate and a join, so a
    node of any degree is spread over tasks, and no links are collected. Links of a node with itself, and links
    with a null end, say nothing and are left out.
    """
    links = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links, state = _settled(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = light(stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = light(stored(large.groupBy("u").agg(F.min("v").alias("m"))))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links, now = _settled(small.unionByName(least.select("u", F.col("m").alias("v"))))
        if now == state:
            break
        state = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _settled(links: DataFrame) -> tuple[DataFrame, tuple]:
    links = stored(links.distinct())
    check = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return links.coalesce(1 + check[0] // 100_000), tuple(check)


class Union:
    """Disjoint sets of the numbers below n, for the members of one bounded block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j
