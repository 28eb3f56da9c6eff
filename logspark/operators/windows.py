"""Ordered operators that stay balanced when one key holds much of the data.

A plain window puts a whole key into one task. The operators here cut a key into
parts or slots, work inside them, and settle what crosses a border on a small summary.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numbers import micros
from .running import one_key, running_sum

SALTS = 32


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int,
                    spread_by: str, salts: int = SALTS) -> DataFrame:
    """First ``n`` rows of each group.

    Two rounds: per group and salt, then per group over at most ``salts * n`` rows.
    Spark pushes the rank filter below both shuffles.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    inner = W.partitionBy(*keys, "_salt").orderBy(*order)
    outer = W.partitionBy(*keys).orderBy(*order)
    first = salted.withColumn("_rn", F.row_number().over(inner)).filter(F.col("_rn") <= n)
    return (
        first.drop("_rn", "_salt")
        .withColumn("_rn", F.row_number().over(outer))
        .filter(F.col("_rn") <= n)
        .drop("_rn")
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last row of each key. The rank filter is applied on the map side too, so copies of
    one key shrink to one row per map task before they are shuffled."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def trailing_count(df: DataFrame, keys: list[str], seconds: int | Column, ts: str = "ts",
                   tie: str = "id", name: str = "trailing_count") -> DataFrame:
    """Rows of the key in ``[ts - seconds, ts]`` that come no later than the row itself.

    Every row counts one, and takes it back one window later: a row for the time at which it leaves is sorted in
    behind the rows of that time. The running sum is the count. The window may differ from key to key.
    """
    width = (seconds if isinstance(seconds, Column) else F.lit(seconds)).cast("bigint") * 1_000_000
    leaves = F.col("_leaves") == 1
    rows = df.select(
        one_key(keys).alias("_key"), F.explode(F.array(F.lit(0), F.lit(1))).alias("_leaves"), micros(F.col(ts)).alias("_at"),
        width.alias("_width"), F.col(tie).alias("_tie"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"),
    ).select(
        "_key", F.when(leaves, F.col("_at") + F.col("_width")).otherwise(F.col("_at")).alias("_us"), "_leaves",
        F.when(~leaves, F.col("_tie")).alias("_tie"), F.when(leaves, -1).otherwise(1).cast("bigint").alias("_value"),
        F.lit(False).alias("_reset"), F.when(~leaves, F.col("_all")).alias("_row"),
    )
    return running_sum(df, rows, ["_us", "_leaves", "_tie"], name)


def run_length(df: DataFrame, keys: list[str], failed: Column, ts: str = "ts", tie: str = "id",
               name: str = "run_length") -> DataFrame:
    """Length of the unbroken run of failures that ends at the row; 0 on a success. A number in
    place of a truth value counts as so many failures at once."""
    value = F.coalesce(failed.cast("bigint"), F.lit(0).cast("bigint"))
    rows = df.select(
        one_key(keys).alias("_key"), micros(F.col(ts)).alias("_us"), F.col(tie).alias("_tie"), value.alias("_value"),
        (value == 0).alias("_reset"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
    )
    return running_sum(df, rows, ["_us", "_tie"], name)


def first_n_per_bucket(df: DataFrame, bucket: Column, limit: int, slot: Column, order: list[Column],
                       spread_by: str) -> DataFrame:
    """First ``limit`` rows of each time bucket, however full a bucket is.

    Slot counts (partial sums) find the slot in which a bucket fills up. Earlier slots
    pass whole without a shuffle, later ones fall away, and only the filling slot is ranked.
    """
    marked = df.withColumn("_bucket", bucket).withColumn("_at", slot)
    counts = marked.groupBy("_bucket", "_at").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy("_bucket").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    cuts = (
        counts.withColumn("_sum", F.sum("_n").over(upto))
        .filter((F.col("_sum") > limit) & (F.col("_sum") - F.col("_n") <= limit))
        .select(
            "_bucket", F.col("_at").alias("_cut"),
            (limit - (F.col("_sum") - F.col("_n"))).alias("_room"),
        )
    )
    joined = marked.join(cuts, "_bucket", "left")
    sure = joined.filter(F.col("_cut").isNull() | (F.col("_at") < F.col("_cut")))
    edge = joined.filter(F.col("_at") == F.col("_cut"))
    salted = edge.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
    for keys in (["_bucket", "_salt"], ["_bucket"]):
        w = W.partitionBy(*keys).orderBy(*order)
        salted = salted.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= F.col("_room"))
    columns = df.columns
    return sure.select(*columns).unionByName(salted.select(*columns))


def restart_keys(df: DataFrame, resets: DataFrame, key: str) -> DataFrame:
    """Give every key of a rule a new name at each reset (``rule_id``, ``reset_time``), so that
    state from before is not seen again. Resets are rare manual acts: their times per rule
    join as one small row."""
    times = resets.groupBy("rule_id").agg(F.collect_set("reset_time").alias("_resets"))
    epoch = F.size(F.filter("_resets", lambda r: r <= F.col("ts")))
    return (
        df.join(times, "rule_id", "left")
        .withColumn(key, F.when(F.coalesce(epoch, F.lit(0)) > 0, F.concat_ws("#", key, epoch)).otherwise(F.col(key)))
        .drop("_resets")
    )
