"""Daily rollups: counts, and mergeable sketches of users and response times, from which reports over days are merged.

A day is rolled up once. A report over a month then reads a month of small rows and no log row. Counts, errors and
means are exact; distinct users and percentiles are as good as their sketches (see `USER_ERROR`, `RANK_ERROR`).
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.numbers import percent, round_long
from . import spans
from .health import scores
from .stats import MODULE_SORT, is_error

KEYS = ["tenant_id", "system_id", "module"]
#: Logarithm of the number of registers of a user sketch, and three standard errors of its estimate.
USER_BITS = 12
USER_ERROR = 3 * 1.04 / 2 ** (USER_BITS / 2)
#: Size of a sketch of response times, and the rank error it is given with by nearly all of them.
TIME_SIZE = 200
RANK_ERROR = 0.0165


def daily_rollup(logs: DataFrame) -> DataFrame:
    """One row per tenant, system, module and day."""
    failed = is_error() | (F.col("status_code") >= 500)
    time = F.col("response_time").cast("bigint")
    return logs.groupBy(*KEYS, F.to_date("ts").alias("log_date")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(is_error()).alias("errors"),
        F.count_if(failed).alias("failed"),
        F.sum(time).alias("time_sum"),
        F.count(time).alias("timed"),
        F.hll_sketch_agg("user_id", F.lit(USER_BITS)).alias("users"),
        F.kll_sketch_agg_bigint(time, F.lit(TIME_SIZE)).alias("times"),
    )


def write_rollup(logs: DataFrame, path: str) -> None:
    """Roll up the days that are present in ``logs`` (whole days); they replace those of an earlier run."""
    (
        daily_rollup(logs).hint("rebalance", "log_date")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date").parquet(path)
    )


def read_rollup(spark: SparkSession, path: str, first_day=None, last_day=None) -> DataFrame:
    """Rollups of some days; other days' files stay closed."""
    kinds = (
        "tenant_id STRING, system_id STRING, module STRING, calls BIGINT, errors BIGINT, failed BIGINT, time_sum BIGINT, "
        "timed BIGINT, users BINARY, times BINARY, log_date DATE"
    )
    df = spark.read.schema(kinds).parquet(path)
    if first_day is not None:
        df = df.filter(F.col("log_date") >= spans.day(first_day))
    if last_day is not None:
        df = df.filter(F.col("log_date") <= spans.day(last_day))
    return df


def merged(rollup: DataFrame, *keys) -> DataFrame:
    """Rollups of groups, with the columns of a rollup."""
    return rollup.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "errors", "failed", "time_sum", "timed")],
        F.hll_union_agg("users").alias("users"), F.kll_merge_agg_bigint("times").alias("times"),
    )


def user_count() -> Column:
    return F.coalesce(F.hll_sketch_estimate("users"), F.lit(0)).cast("bigint")


def mean_time() -> Column:
    return F.when(F.col("timed") > 0, F.col("time_sum") / F.col("timed"))


def time_percentile(share: float) -> Column:
    known = F.kll_sketch_get_n_bigint("times") > 0
    return F.when(known, F.kll_sketch_get_quantile_bigint("times", F.lit(share))).cast("double")


def period_stats(rollup: DataFrame) -> DataFrame:
    """As ``stats.period_stats`` over whole days."""
    return merged(rollup).select(
        F.col("calls").alias("total_count"), F.col("errors").alias("error_count"), user_count().alias("user_count"),
        F.coalesce(round_long(mean_time()), F.lit(0)).alias("avg_response_time"),
    )


def module_stats(rollup: DataFrame, sort_by: str = "call_count", limit: int = 20) -> DataFrame:
    """As ``stats.module_stats`` over whole days."""
    if sort_by not in MODULE_SORT:
        raise ValueError(f"cannot sort by {sort_by}")
    per_module = merged(rollup.filter("module is not null"), "module").select(
        "module", F.col("calls").alias("call_count"), user_count().alias("user_count"),
        percent(F.col("errors"), F.col("calls")).alias("error_rate"), round_long(mean_time()).alias("avg_response_time"),
    )
    order = [F.col(sort_by).desc(), F.col("module").asc()]
    top = per_module.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def health_metrics(rollup: DataFrame, keys: list[str]) -> DataFrame:
    """As ``health.metrics`` over whole days, with the part scores."""
    return merged(rollup, *keys).select(
        *keys, F.col("calls").alias("total"), "errors", "failed", mean_time().alias("avg_ms"), time_percentile(0.99).alias("p99_ms"),
        *[c.alias(n) for n, c in scores(F.col("calls"), F.col("errors"), F.col("failed"), mean_time()).items()],
    )
