"""Lookup tables beside a log table: in which partitions a trace or a word occurs.

A lookup table is written from the rows that are written to the log table (or rebuilt from it) and is appended to in the
same way. Its rows lie in buckets by the hash of their key, sorted by it, so a lookup opens one bucket and few of its pages.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import search as search_ops
from ..operators.search import LogQuery
from ..schema import PARTITION_COLUMNS
from ..session import cut_lineage

BUCKETS = 64
#: Up to so many partitions are named to the scan as literals; more are joined.
MOST_NAMED = 500


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _write(rows: DataFrame, path: str, key: str, mode: str) -> None:
    (
        rows.withColumn("bucket", _bucket(F.col(key))).hint("rebalance", "bucket").sortWithinPartitions("bucket", key)
        .write.mode(mode).partitionBy("bucket").parquet(path)
    )


# --- traces ---


def write_trace_lookup(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Traces of some rows (with partition columns) and the partitions they lie in."""
    rows = logs.filter("trace_id is not null").groupBy("trace_id", *PARTITION_COLUMNS).agg(F.count(F.lit(1)).alias("rows"))
    _write(rows, path, "trace_id", mode)


def read_trace_lookup(spark: SparkSession, path: str) -> DataFrame:
    kinds = "trace_id STRING, tenant_id STRING, system_id STRING, log_date DATE, rows BIGINT, bucket INT"
    return spark.read.schema(kinds).parquet(path)


def trace(logs: DataFrame, lookup: DataFrame, trace_id: str) -> DataFrame:
    """All rows of a trace in time order; only the partitions that hold it are opened, whatever their tenant and day."""
    mine = lookup.filter((F.col("bucket") == _bucket(F.lit(trace_id))) & (F.col("trace_id") == trace_id))
    return search_ops.trace(in_partitions(logs, mine), trace_id)


def in_partitions(logs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the given partitions. A few are named to the scan, so that it never lists the others' files."""
    parts = wanted.select(*PARTITION_COLUMNS).distinct()
    named = parts.limit(MOST_NAMED + 1).collect()
    if len(named) > MOST_NAMED:
        return logs.join(parts, PARTITION_COLUMNS, "left_semi")
    days = {}
    for tenant, system, day in named:
        days.setdefault((tenant, system), set()).add(day)
    hit = F.lit(False)
    for (tenant, system), own in sorted(days.items()):
        hit = hit | ((F.col("tenant_id") == tenant) & (F.col("system_id") == system) & F.col("log_date").isin(*sorted(own)))
    return logs.filter(hit)


# --- words ---


def word_rows(logs: DataFrame) -> DataFrame:
    """Distinct words of messages with the partitions they occur in."""
    words = logs.select(*PARTITION_COLUMNS, F.explode(F.array_distinct(text.tokens(F.col("message")))).alias("word"))
    return words.groupBy("word", *PARTITION_COLUMNS).agg(F.count(F.lit(1)).alias("rows"))


def write_dictionary(logs: DataFrame, path: str, mode: str = "append") -> None:
    """The words of some rows: where each occurs, and under each of its deletions that it exists."""
    _write(word_rows(logs), f"{path}/words", "word", mode)
    near = logs.sparkSession.read.parquet(f"{path}/words").select("word").distinct()
    near = near.withColumn("deletion", F.explode(text.deletions_of(F.col("word"))))
    _write(near, f"{path}/deletions", "deletion", "overwrite")


def near_words(deletions: DataFrame, terms: list[str]) -> DataFrame:
    """Words within the allowed distance of any of the terms, each looked at once however many rows hold it.

    A word and a term within k edits share what is left of their starts after up to k deletions.
    """
    found = None
    for term in sorted(set(terms)):
        keys = text.deletions(term, text.fuzziness(term))
        asked = F.col("deletion").isin(*keys)
        if "bucket" in deletions.columns:
            asked = asked & F.col("bucket").isin(*sorted(_buckets_of(deletions.sparkSession, keys)))
        near = deletions.filter(asked & text.is_near(F.col("word"), term)).select("word")
        found = near if found is None else found.unionByName(near)
    return found.distinct()


def _buckets_of(spark: SparkSession, keys: list[str]) -> set[int]:
    rows = spark.createDataFrame([(k,) for k in keys], "k STRING").select(_bucket(F.col("k"))).collect()
    return {r[0] for r in rows}


def search(logs: DataFrame, path: str, query: LogQuery) -> DataFrame:
    """As ``search``, with the fuzzy keyword looked up in the dictionary at ``path``.

    Words near the keyword are found once a word, and say which partitions to open; in those, rows are kept by equality
    of words.
    """
    terms = search_ops.keyword_terms(query.keyword or "")
    plain = search_ops.search(logs, query.without_keyword())
    if not terms:
        return plain
    spark = logs.sparkSession
    words = near_words(spark.read.parquet(f"{path}/deletions"), terms)
    places = spark.read.parquet(f"{path}/words").join(words, "word", "left_semi")
    return with_words(in_partitions(plain, places), words)


def with_words(logs: DataFrame, words: DataFrame) -> DataFrame:
    """Rows whose message has any of the words. Few words are compared as literals, more by a join."""
    few = words.limit(MOST_NAMED + 1).collect()
    if len(few) <= MOST_NAMED:
        return logs.filter(F.arrays_overlap(text.tokens(F.col("message")), F.array(*[F.lit(w.word) for w in few]).cast("array<string>")))
    numbered = cut_lineage(logs.withColumn("_row", F.monotonically_increasing_id()))
    each = numbered.select("_row", F.explode(F.array_distinct(text.tokens(F.col("message")))).alias("word"))
    return numbered.join(each.join(words, "word", "left_semi").select("_row").distinct(), "_row", "left_semi").drop("_row")
